"""Baskets as sorted lists of token codes, and frequent itemsets of any length on them.

A dictionary numbers the frequent tokens, the rarest first, so that the first tokens of a set are its rarest ones and few baskets hold them. The lowest
two bits of a code are the token's family. A pair of codes is one long, counted with map-side sums, and tokens come back only with the frequent sets.

Longer sets are found level by level. Sets of k - 1 codes that share all but their last one make a candidate of k, which stays if its other subsets
are frequent too; the candidates of a level are a trie of shared beginnings. Baskets are walked down it: an occurrence of a beginning carries
the codes of its basket that follow, and each of them that leads to a candidate is counted. Only beginnings of candidates are carried on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import cut
from . import baskets as B
from .mining import metrics

FAMILY_CODES = {"genre": 0, "movie": 1, "tag": 2}
MOST_CANDIDATES, MOST_ITEMS = 5_000_000, 12


@dataclass(frozen=True)
class Coded:
    """``dictionary``: token, code, c; ``baskets``: userId, codes; ``n``: one row with the number of baskets."""

    dictionary: DataFrame
    baskets: DataFrame
    n: DataFrame


def _same(df: DataFrame) -> DataFrame:
    return df


def frequency(tokens: DataFrame) -> DataFrame:
    """``token, c`` of distinct ``userId, token``."""
    return tokens.groupBy("token").agg(F.count("*").alias("c"))


def dictionary(frequent: DataFrame) -> DataFrame:
    """``token, code, c``: numbers from 0 by (c, token), four times as large, plus the family.

    Numbers are given within each c, from where the smaller ones end; there are at most about sqrt(2 * votes) different ones.
    """
    starts = frequent.groupBy("c").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("c", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("c").orderBy("token")) - 1
    kind = F.lit(3)
    for name, code in FAMILY_CODES.items():
        kind = F.when(X.family(F.col("token")) == name, code).otherwise(kind)
    return frequent.join(starts, "c").select("token", ((F.col("start") + place) * 4 + kind).cast("int").alias("code"), "c")


def coded_by(tokens: DataFrame, words: DataFrame, keep: Callable[[DataFrame], DataFrame] = _same) -> Coded:
    """The baskets of distinct ``userId, token`` in the codes of a dictionary; tokens that it lacks go, and so do empty baskets."""
    rows = tokens.join(words.select("token", "code"), "token")
    baskets = keep(rows.groupBy("userId").agg(F.array_sort(F.collect_list("code")).alias("codes")))
    return Coded(words, baskets, F.broadcast(baskets.agg(F.count("*").alias("n"))))  # one row


def coded(tokens: DataFrame, support: float, keep: Callable[[DataFrame], DataFrame] = _same) -> Coded:
    """The baskets of distinct ``userId, token`` in codes of the tokens that ceil(support * n) of them hold.

    The dictionary is cut; ``keep`` persists the baskets.
    """
    need = tokens.agg(X.required_count(support, F.count_distinct("userId")).alias("need"))
    words = cut(dictionary(frequency(tokens).join(F.broadcast(need)).where("c >= need").select("token", "c")))  # one row
    return coded_by(tokens, words, keep)


def coded_baskets(baskets: DataFrame, support: float, keep: Callable[[DataFrame], DataFrame] = _same) -> Coded:
    return coded(B.to_tokens(baskets), support, keep)


def packed_pairs(baskets: DataFrame, families: tuple[str, str] | None = None) -> DataFrame:
    """``pair`` of each two codes of each basket, the smaller one in the upper half; only across ``families`` if given."""
    if families:
        u, v = (_of_family(FAMILY_CODES[kind]) for kind in families)
        sides = baskets.select(u.alias("u"), v.alias("v")).select(F.explode("u").alias("x"), "v").select("x", F.explode("v").alias("y"))
        return sides.select(_packed(F.least("x", "y"), F.greatest("x", "y")).alias("pair"))
    one = baskets.select(F.posexplode("codes").alias("i", "a"), "codes")
    return one.select("a", F.explode(_after("codes", F.col("i"))).alias("b")).select(_packed(F.col("a"), F.col("b")).alias("pair"))


def _of_family(code: int) -> Column:
    return F.filter("codes", lambda c: c.bitwiseAND(F.lit(3)) == code)


def _after(codes: str, i: Column) -> Column:
    """What follows place ``i``, from 0."""
    return F.slice(codes, i + 2, F.size(codes))


def _packed(low: Column, high: Column) -> Column:
    return F.shiftleft(low.cast("bigint"), 32).bitwiseOR(high.cast("bigint"))


def _low(pair: str) -> Column:
    return F.shiftright(pair, 32).cast("int")


def _high(pair: str) -> Column:
    return F.col(pair).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def frequent_pairs(own: Coded, support: float, families: tuple[str, str] | None = None) -> DataFrame:
    """``pair, c_ab, n``."""
    counts = packed_pairs(own.baskets, families).groupBy("pair").agg(F.count("*").alias("c_ab"))
    return counts.join(own.n).where(F.col("c_ab") >= X.required_count(support, F.col("n")))


def candidates(sets: DataFrame, length: int) -> DataFrame:
    """``codes`` of ``length`` whose subsets of one less are all among ``sets``."""
    head, last = F.slice("codes", 1, length - 2), F.element_at("codes", -1)
    a = sets.select(head.alias("head"), "codes", last.alias("last"))
    b = sets.select(head.alias("head"), last.alias("next"))
    made = a.join(b, "head").where("last < next").select(F.concat("codes", F.array("next")).alias("codes"))
    for gone in range(length - 2):  # the two subsets without one of the last two are the joined ones
        kept = F.concat(F.slice("codes", 1, gone), F.slice("codes", gone + 2, length))
        made = made.withColumn("subset", kept).join(sets.select(F.col("codes").alias("subset")), "subset", "left_semi").drop("subset")
    return made


def _extended(occurrences: DataFrame) -> DataFrame:
    """Each occurrence with each of the codes that follow it in its basket."""
    one = occurrences.select("codes", "rest", F.posexplode("rest").alias("i", "code"))
    return one.select(F.concat("codes", F.array("code")).alias("codes"), _after("rest", F.col("i")).alias("rest"))


def frequent_sets(
    own: Coded, support: float, max_len: int = 2, families: tuple[str, str] | None = None, most: int = MOST_CANDIDATES
) -> DataFrame:
    """``items, length, count, support`` of sets of up to ``max_len`` tokens, items in order; pairs only across ``families`` if given.

    Above pairs the levels are found now, and the result is cut. Raises if a level has more than ``most`` candidates.
    """
    if not 1 <= max_len <= MOST_ITEMS:
        raise ValueError(f"max_len must be 1 to {MOST_ITEMS}, not {max_len}")
    if families and max_len > 2:
        raise ValueError("sets across two families are pairs")
    one = own.dictionary.select(F.array("code").alias("codes"), F.lit(1).alias("length"), F.col("c").alias("count"))
    if max_len == 1:
        return _decoded(one, own, 1)
    pairs = frequent_pairs(own, support, families).select(F.array(_low("pair"), _high("pair")).alias("codes"), F.lit(2).alias("length"), F.col("c_ab").alias("count"))
    level = cut(pairs) if max_len > 2 else pairs
    found = one.unionByName(level)
    occurrences = own.baskets.select(F.array().cast("array<int>").alias("codes"), F.col("codes").alias("rest"))
    occurrences = _extended(occurrences)
    for length in range(3, max_len + 1):
        wanted = cut(candidates(level.select("codes"), length))
        n = wanted.count()
        if not n:
            break
        if n > most:
            raise ValueError(f"{n} candidates of {length} tokens, {most} are allowed: raise the support or lower max_len")
        beginnings = wanted.select(F.slice("codes", 1, length - 1).alias("codes")).distinct()
        occurrences = _extended(occurrences).join(beginnings, "codes", "left_semi")
        counts = _extended(occurrences).select("codes").join(wanted, "codes", "left_semi").groupBy("codes").agg(F.count("*").alias("count"))
        level = counts.join(own.n).where(F.col("count") >= X.required_count(support, F.col("n")))
        level = cut(level.select("codes", F.lit(length).alias("length"), "count"))
        found = found.unionByName(level)
    return _decoded(found, own, max_len) if max_len < 3 else cut(_decoded(found, own, max_len))


def _decoded(sets: DataFrame, own: Coded, max_len: int) -> DataFrame:
    words = own.dictionary.select("code", "token")
    for i in range(max_len):
        at = words.select(F.col("code").alias(f"_c{i}"), F.col("token").alias(f"_t{i}"))
        sets = sets.withColumn(f"_c{i}", F.get("codes", F.lit(i))).join(at, f"_c{i}", "inner" if i == 0 else "left").drop(f"_c{i}")
    items = F.array_sort(F.array_compact(F.array(*(f"_t{i}" for i in range(max_len)))))
    return sets.join(own.n).select(items.alias("items"), "length", "count", (F.col("count") / F.col("n")).alias("support"))


def pair_rules(
    own: Coded, support: float, min_confidence: float, min_lift: float | None = None, families: tuple[str, str] | None = None
) -> DataFrame:
    """Both directions of frequent pairs: ``antecedent, consequent, count_ab, count_a, count_b, n`` and the metrics.

    Confidence is inclusive, lift is strict. Codes bring their tokens' counts, which pruning does not change.
    """
    pairs = frequent_pairs(own, support, families).select(_low("pair").alias("a"), _high("pair").alias("b"), "c_ab", "n")
    for side in "ab":
        words = own.dictionary.select(F.col("code").alias(side), F.col("token").alias(f"t_{side}"), F.col("c").alias(f"c_{side}"))
        pairs = pairs.join(words, side)
    way = lambda x, y: F.struct(*(F.col(f"{k}_{s}").alias(f"{k}_{to}") for s, to in ((x, "a"), (y, "b")) for k in "tc"))
    both = pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("s"), "c_ab", "n").select("s.*", "c_ab", "n")
    made = metrics(F.col("c_ab"), F.col("c_a"), F.col("c_b"), F.col("n"))
    out = both.select(
        F.col("t_a").alias("antecedent"), F.col("t_b").alias("consequent"), F.col("c_ab").alias("count_ab"), F.col("c_a").alias("count_a"),
        F.col("c_b").alias("count_b"), "n", *(c.alias(k) for k, c in made.items()),
    ).where(F.col("confidence") >= min_confidence)
    return out if min_lift is None else out.where(F.col("lift") > min_lift)


def set_rules(found: DataFrame, n: DataFrame, min_confidence: float, min_lift: float | None = None) -> DataFrame:
    """All rules whose two sides, of one or more tokens, make up a frequent set: ``antecedent, consequent`` lists, counts and metrics.

    ``found`` holds the subsets of its sets; ``n`` is one row with the number of baskets.
    """
    split = found.where("length > 1").select("items", F.col("count").alias("c_ab"), F.explode(F.expr("sequence(1, shiftleft(1, length) - 2)")).alias("side"))
    parted = lambda bit: F.expr(f"filter(items, (x, i) -> (shiftright(side, i) & 1) = {bit})")
    both = split.select(parted(1).alias("antecedent"), parted(0).alias("consequent"), "c_ab")
    for side, name in (("antecedent", "c_a"), ("consequent", "c_b")):
        both = both.join(found.select(F.col("items").alias(side), F.col("count").alias(name)), side)
    made = metrics(F.col("c_ab"), F.col("c_a"), F.col("c_b"), F.col("n"))
    out = both.join(n).select(
        "antecedent", "consequent", F.col("c_ab").alias("count_ab"), F.col("c_a").alias("count_a"), F.col("c_b").alias("count_b"), "n",
        *(c.alias(k) for k, c in made.items()),
    ).where(F.col("confidence") >= min_confidence)
    return out if min_lift is None else out.where(F.col("lift") > min_lift)


def recounted(found: DataFrame, test: Coded) -> DataFrame:
    """Pair rules with ``n_test``, their counts in the held-out baskets, and what follows from these.

    Only pairs that are rules are counted; the others go before they are summed.
    """
    for side, name in (("antecedent", "_a"), ("consequent", "_b")):
        found = found.join(test.dictionary.select(F.col("token").alias(side), F.col("code").alias(name)), side, "left")
    found = found.withColumn("_pair", _packed(F.least("_a", "_b"), F.greatest("_a", "_b")))
    wanted = found.select(F.col("_pair").alias("pair")).distinct()
    pairs = packed_pairs(test.baskets).join(wanted, "pair", "left_semi").groupBy("pair").agg(F.count("*").alias("count_ab_test"))
    found = found.join(pairs.withColumnRenamed("pair", "_pair"), "_pair", "left")
    singles = test.baskets.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("c"))
    for name in "ab":
        found = found.join(singles.select(F.col("code").alias(f"_{name}"), F.col("c").alias(f"count_{name}_test")), f"_{name}", "left")
    found = found.drop("_a", "_b", "_pair").na.fill(0, ["count_ab_test", "count_a_test", "count_b_test"]).join(test.n.withColumnRenamed("n", "n_test"))
    over = lambda x, y: F.when(y == 0, 0.0).otherwise(x / y)
    ab, a, b, n = (F.col(c) for c in ("count_ab_test", "count_a_test", "count_b_test", "n_test"))
    found = found.withColumns({"support_b_test": over(b, n), "confidence_test": over(ab, a)})
    return found.withColumns({"lift_test": over(F.col("confidence_test"), F.col("support_b_test")), "conf_ratio": over(F.col("confidence_test"), F.col("confidence"))})


def stable(found: DataFrame, test: Coded, min_confidence: float = 0.10, min_ratio: float = 0.80, min_ab: int = 50) -> DataFrame:
    """Gate 2: recounted rules that hold in the held-out baskets; without such baskets all of them."""
    good = (F.col("confidence_test") >= min_confidence) & (F.col("conf_ratio") >= min_ratio) & (F.col("count_ab_test") >= min_ab)
    return recounted(found, test).where((F.col("n_test") == 0) | good)
