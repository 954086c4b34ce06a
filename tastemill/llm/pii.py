"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Base spans follow fixed patterns and checks. Further generators with high recall propose spans (obfuscated e-mail addresses and IP
addresses, card numbers with other separators, national and North American telephone numbers); boosted trees over format and context features
score each proposal, and those above their kind's threshold, calibrated for precision, are added. The trees are fitted on a fixed set of made-up
sentences whose proposals and features come from the same expressions; the sentences that calibrate lead to their proposals with other words than
those that fit. Scoring is nested CASE expressions, one pass over the texts and no shuffle.

Matches are found by marking them with a control character and splitting, which gives code point offsets. Texts' own control
characters of that range are replaced one for one first, so offsets hold. Joining dots and separators are marked before matching, so
that the patterns need no nested repeats and cost linear time and constant stack on any text.

Null texts count as empty. Rows stand alone: repeated rows get equal results, null ids pass through. Other columns are ignored. An
empty table gives no rows. Where spans overlap, redaction replaces all that any of them covers, under the name of the one that begins first.
"""

from __future__ import annotations

import random
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MARK, JOIN, OTHER = "\x01", "\x02", "\x03"
SPAN = "array<struct<start:int,rank:int,end:int>>"
PROPOSALS = "array<struct<start:int,rank:int,end:int,f:array<double>>>"
TREES, RATE, PRECISION = 16, 0.3, 0.99


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def cleaned(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(f"[{MARK}{JOIN}]"), F.translate(text, MARK + JOIN, OTHER + OTHER)).otherwise(text)


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, value, before, after>>`` of the pattern's leftmost matches that don't overlap."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    kind = "array<struct<start:int,value:string,before:string,after:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(kind).alias("found"))

    def spans(p: Column) -> Column:
        def step(acc: Column, piece: Column) -> Column:
            here = F.struct(
                acc["at"].alias("start"), piece.alias("value"),
                F.right(F.get(p, acc["i"] - 1), F.lit(24)).alias("before"), F.left(F.get(p, acc["i"] + 1), F.lit(12)).alias("after"),
            )
            return F.struct(
                (acc["at"] + F.length(piece)).alias("at"), (acc["i"] + 1).alias("i"),
                F.when(acc["i"] % 2 == 1, F.array_append(acc["found"], here)).otherwise(acc["found"]).alias("found"),
            )

        return F.aggregate(p, zero, step)["found"]

    return let(pieces, spans)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substr(number, F.length(number) - i, F.lit(1)).cast("int")
        double = d * 2
        return F.when(i % 2 == 0, d).when(double > 9, double - 9).otherwise(double)

    total = F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda acc, i: acc + worth(i))
    return total % 10 == 0


def _small(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _card(value: Column) -> Column:
    return let(digits(value), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))


def _as_spans(found: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), (m["start"] + F.length(m["value"])).alias("end"))
    ).cast(SPAN)


def base_spans(text: Column, has_digit: Column) -> dict[str, Column]:
    """The base spans of each kind in a cleaned text."""
    dotted = F.regexp_replace(text, r"\.(?=[A-Za-z0-9\-])(?<=[A-Za-z0-9\-]\.)", JOIN)
    email = matches(dotted, rf"(?:\G|(?<![A-Za-z0-9._%+\-{JOIN}]))[A-Za-z0-9._%+\-{JOIN}]++@[A-Za-z0-9\-]++{JOIN}[A-Za-z0-9\-{JOIN}]++")
    ip = F.filter(
        matches(text, r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"), lambda m: F.forall(F.split(m["value"], r"\."), _small)
    )
    joined = F.regexp_replace(text, r"[ \-](?=[0-9])(?<=[0-9][ \-])", JOIN)
    card = F.filter(matches(joined, f"[0-9][0-9{JOIN}]++"), lambda m: _card(m["value"]))
    phone = F.filter(
        matches(text, r"\+[0-9][ ().0-9\-]+[0-9]"), lambda m: F.length(digits(m["value"])).between(9, 15)
    )
    none = F.array().cast(SPAN)
    found = {"email": email, "ip": ip, "card": card, "phone": phone}
    # What no match can lack, told by a cheap look at the text.
    needs = {"email": F.contains(text, F.lit("@")), "ip": has_digit, "card": has_digit, "phone": has_digit & F.contains(text, F.lit("+"))}
    return {kind: F.when(needs[kind], _as_spans(m, kind)).otherwise(none) for kind, m in found.items()}


# Generators: (kind, pattern, strings one of which any match holds). Each repeat is over one class or bounded.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64} ?(?:\[at\]|\(at\)|\{at\}|\bat\b) ?[A-Za-z0-9\-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\bdot\b) ?[A-Za-z0-9\-]{1,63}){1,4}", ("dot",)),
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64} ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,4}", ("at]", "at)", "at}")),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?![0-9])", ("[.]", "(.)")),
    ("card", r"(?<![0-9./_])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{4}(?![0-9])", ()),
    ("phone", r"(?<![0-9+.\-])\(?[0-9]{3}\)?[ .\-]{1,2}[0-9]{3}[ .\-][0-9]{4}(?![0-9])", ()),
    ("phone", r"(?<![0-9+./\-])\(?0[0-9]{1,4}\)?[ /\-]{1,2}[0-9]{2,4}[ \-]?[0-9]{2,5}(?:[ \-]?[0-9]{2,3})?(?![0-9./\-])", ()),
)
NEAR = {
    "email": r"(?i)(e-?mail|mail|contact|write|reach|address|send)",
    "ip": r"(?i)(\bip\b|host|server|address|login|from)",
    "card": r"(?i)(card|visa|master|credit|debit|payment|account|karte|carte|tarjeta)",
    "phone": r"(?i)(\btel|handy|phone|call|mobile|cell|fax|contact|dial|whatsapp|number)",
}
FEATURES = ("kind", "brackets", "digits", "letters", "length", "separators", "near", "before_digit", "after_digit", "upper", "top_level", "zero", "luhn")


def features(m: Column, kind: str) -> Column:
    v = m["value"]

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(v, pattern, ""))

    def flag(c: Column) -> Column:
        return F.coalesce(c.cast("int"), F.lit(0))

    return F.array(
        F.lit(KINDS.index(kind)), flag(v.rlike(r"[\[(]")), count("[^0-9]"), count("[^A-Za-z]"), F.length(v), count(r"[^ .\-]"),
        flag(m["before"].rlike(NEAR[kind])), flag(m["before"].rlike("[0-9][^A-Za-z]{0,2}$")), flag(m["after"].rlike("^[^A-Za-z]{0,2}[0-9]")),
        count("[^A-Z]"), flag(v.rlike(r"(?i)(com|org|net|edu|info|io|de|fr|es|co|uk)$")),
        flag(v.rlike(r"^\(?0")), flag(_card(v)),
    ).cast("array<double>")


def candidates(text: Column, has_digit: Column) -> Column:
    """``array<struct<start, end, rank, f>>`` of all generators' proposals in a cleaned text."""
    found = []
    for kind, pattern, held in GENERATORS:

        def proposal(m: Column) -> Column:
            return F.struct(
                m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (m["start"] + F.length(m["value"])).alias("end"),
                features(m, kind).alias("f"),
            )

        may = reduce(or_, (F.contains(text, F.lit(x)) for x in held)) if held else has_digit
        made = F.transform(matches(text, pattern), proposal)
        found.append(F.when(may, made).otherwise(F.array().cast(PROPOSALS)))
    return F.concat(*found)


Tree = tuple  # (feature, cut, low, high) or a value


def grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, depth: int) -> Tree | float:
    """A regression tree for a logistic boosting step."""
    leaf = float(residual.sum() / (weight.sum() + 1.0))
    if depth == 0 or len(x) < 10:
        return leaf
    best, choice = residual.sum() ** 2 / (weight.sum() + 1.0) + 1e-6, None
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            low = x[:, j] <= cut
            gain = sum(residual[s].sum() ** 2 / (weight[s].sum() + 1.0) for s in (low, ~low))
            if gain > best:
                best, choice = gain, (j, float(cut), low)
    if choice is None:
        return leaf
    j, cut, low = choice
    return (j, cut, grow(x[low], residual[low], weight[low], depth - 1), grow(x[~low], residual[~low], weight[~low], depth - 1))


def value_of(tree: Tree | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, low, high = tree
    return np.where(x[:, j] <= cut, value_of(low, x), value_of(high, x))


def as_column(tree: Tree | float, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    j, cut, low, high = tree
    return F.when(f[j] <= cut, as_column(low, f)).otherwise(as_column(high, f))


def boost(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> tuple[list, dict[int, float]]:
    """Trees, and of each kind the log-odds threshold that keeps ``PRECISION`` on its rows that are held out."""
    logit, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        tree = grow(x[~held], (y - p)[~held], (p * (1 - p))[~held], 3)
        trees.append(tree)
        logit += RATE * value_of(tree, x)
    cuts = {}
    for kind in range(len(KINDS)):
        own = held & (x[:, 0] == kind)
        order = np.argsort(-logit[own])
        score, right = logit[own][order], np.cumsum(y[own][order])
        # Rows of equal scores go together.
        last = np.r_[score[1:] != score[:-1], True] if len(score) else np.zeros(0, bool)
        good = np.flatnonzero(last & (right / np.arange(1, len(order) + 1) >= PRECISION))
        cuts[kind] = max(float(score[good[-1]]), 0.0) if len(good) else np.inf
    return trees, cuts


LEADS = (
    {"email": ("e-mail me: ", "contact ", "write to "), "phone": ("call ", "tel. ", "phone: "), "ip": ("host ", "login from "), "card": ("card ", "visa: ", "credit card no. ")},
    {"email": ("mail ", "reach me under "), "phone": ("mobile ", "fax ", "tel ", "my number is "), "ip": ("ip ", "server "), "card": ("payment by card ", "mastercard ")},
)


def sentences(n: int = 2400) -> list[tuple[str, int, int]]:
    """Made-up sentences, each with one proposal, whether that is personal data, and whether it calibrates."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(("ra", "to", "mi", "len", "sor", "ka", "be", "dun")) for _ in range(rng.randint(1, 3)))
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    three, four, byte = lambda: f"{rng.randint(100, 999)}", lambda: f"{rng.randint(1000, 9999)}", lambda: str(rng.randint(1, 255))
    top = lambda: rng.choice(("com", "org", "net", "de", "fr", "io"))

    def card(good: bool) -> str:
        body = number(15)
        total = sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 == 0 else d for i, d in enumerate(map(int, reversed(body))))
        body += str((10 - total % 10) % 10 if good else (11 - total % 10) % 10)
        return rng.choice("./_").join(body[i : i + 4] for i in range(0, 16, 4)) if rng.random() < 0.5 else ".".join(body[i : i + 4] for i in range(0, 16, 4))

    def national() -> str:
        return f"0{number(rng.randint(2, 4))}{rng.choice((' ', '/', '-'))}{rng.choice((number(6), number(7), number(3) + ' ' + number(4)))}"

    at, dot = (" [at] ", "(at)", "[at]", " (at) "), (" [dot] ", "(dot)", "[dot]", " (dot) ")
    forms = (
        ("email", lambda: f"{word()}.{word()}{rng.choice(at)}{word()}{rng.choice(dot)}{top()}", 1, 0.5),
        ("email", lambda: f"{word()}{rng.choice(at)}{word()}.{top()}", 1, 0.5),
        ("email", lambda: f"{word()} at {word()} dot {top()}", 1, 1.0),
        ("email", lambda: f"{word()} at {word()} dot {word()}", 0, 0.0),
        ("phone", lambda: f"({three()}) {three()}-{four()}", 1, 1.0),
        ("phone", lambda: f"{three()}-{three()}-{four()}", 1, 1.0),
        ("phone", lambda: f"{three()} {three()} {four()} {rng.randint(10, 999)}", 0, 0.0),
        ("phone", lambda: f"{three()}{rng.choice('. -')}{three()}{rng.choice('. -')}{four()}", 0, 0.0),
        ("phone", national, 1, 1.0),
        ("phone", national, 0, 0.0),
        ("ip", lambda: "[.]".join((byte(), byte(), byte(), byte())), 1, 0.5),
        ("card", lambda: card(True), 1, 0.7),
        ("card", lambda: card(False), 0, 0.3),
    )
    out = []
    for i in range(n):
        kind, made, personal, led = forms[i % len(forms)]
        part = rng.randrange(3) == 0
        before, after = (" ".join(word() for _ in range(rng.randint(2, 6))) for _ in range(2))
        lead = rng.choice(LEADS[part][kind]) if rng.random() < led else ""
        out.append((f"{before} {lead}{made()} {after}", personal, int(part)))
    return out


_FITTED: dict[int, tuple[list, dict[int, float]]] = {}


def fitted(spark: SparkSession) -> tuple[list, dict[int, float]]:
    """The model; it depends on the made-up sentences alone and is fitted once a process."""
    if 0 not in _FITTED:
        made = spark.createDataFrame(sentences(), "text string, y int, held int")
        rows = made.select("y", "held", F.explode(candidates(cleaned(F.col("text")), F.lit(True))).alias("c")).select("y", "held", "c.f").collect()
        _FITTED[0] = boost(np.array([r["f"] for r in rows]), np.array([r["y"] for r in rows], float), np.array([r["held"] for r in rows]) == 1)
    return _FITTED[0]


def find_pii(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id, *keep, base, spans``: sorted ``array<struct<start, rank, end>>``; ``rank`` is the place in ``KINDS``."""
    trees, cuts = fitted(docs.sparkSession)

    def chosen(c: Column) -> Column:
        new = ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        cut = F.get(F.array(*(F.lit(cuts[k]) for k in range(len(KINDS)))), c["rank"])
        return new & let(c["f"], lambda f: sum((as_column(t, f) * RATE for t in trees), F.lit(0.0)) >= cut)

    df = docs.select("doc_id", *keep, cleaned(F.col("text")).alias("clean"))
    df = df.withColumn("has_digit", F.col("clean").rlike("[0-9]"))
    kinds = base_spans(F.col("clean"), F.col("has_digit"))
    df = df.select("*", *(spans.alias(kind) for kind, spans in kinds.items()), candidates(F.col("clean"), F.col("has_digit")).alias("proposed"))
    df = df.withColumn("base", F.array_sort(F.concat(*kinds)))
    base = F.col("base")
    added = F.transform(F.filter("proposed", chosen), lambda c: F.struct(c["start"], c["rank"], c["end"])).cast(SPAN)
    return df.select("doc_id", *keep, "base", F.array_sort(F.array_distinct(F.concat(base, added))).alias("spans"), *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with ``[KIND]`` for each span."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        part = F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), names[s["rank"]])
        return F.struct(
            F.greatest(s["end"], acc["at"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.array_append(acc["parts"], part)).otherwise(acc["parts"]).alias("parts"),
        )

    done = let(
        F.aggregate(spans, zero, step),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["at"] + 1)),
    )
    return F.when(F.size(spans) == 0, text).otherwise(done)
