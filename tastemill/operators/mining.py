"""Frequent 1- and 2-itemsets, association rules and their gates.

Counts are columns all along: ``n_mode`` baskets come out of the family mode and set the pruning threshold, ``n_kept`` baskets are
left by pruning and are the denominator of supports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import baskets as B


def n_baskets(baskets: DataFrame) -> DataFrame:
    return baskets.agg(F.count("*").alias("n"))


def frequent_tokens(baskets: DataFrame, support: float) -> DataFrame:
    """``token, c`` of tokens in ceil(support * n) baskets or more, one vote a basket."""
    singles = B.doc_freq(baskets).withColumnRenamed("df", "c")
    need = F.broadcast(n_baskets(baskets).select(X.required_count(support, F.col("n")).alias("need")))  # one row
    return singles.join(need).where("c >= need").select("token", "c")


def pruned(baskets: DataFrame, frequent: DataFrame) -> DataFrame:
    """Baskets with frequent tokens only; a vocabulary is joined by size, and empty baskets go."""
    return B.to_baskets(B.to_tokens(baskets).join(frequent.select("token"), "token", "left_semi"))


def pair_counts(baskets: DataFrame, families: tuple[str, str] | None = None) -> DataFrame:
    """``a, b, c_ab`` with a < b, exploded within each sorted basket: one shuffle with map-side sums.

    ``families`` makes only the pairs across two families.
    """
    if families:
        u, v = (_of_family(kind).alias(name) for kind, name in zip(families, ("u", "v"), strict=True))
        sides = baskets.select(u, v).select(F.explode("u").alias("x"), "v").select("x", F.explode("v").alias("y"))
        return sides.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("c_ab"))
    pairs = F.flatten(
        F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    return baskets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("c_ab"))


def _of_family(kind: str) -> Column:
    return F.filter("items", lambda t: X.family(t) == kind)


def pair_counts_by_join(tokens: DataFrame) -> DataFrame:
    """The same from long form; a cross-check."""
    a, b = tokens.select("userId", F.col("token").alias("a")), tokens.select("userId", F.col("token").alias("b"))
    return a.join(b, "userId").where("a < b").groupBy("a", "b").agg(F.count("*").alias("c_ab"))


def itemsets(baskets: DataFrame, support: float, families: tuple[str, str] | None = None) -> DataFrame:
    """``items, length, count, support`` of one or two tokens, pairs only across ``families`` if given. ``baskets`` are pruned ones."""
    n = F.broadcast(n_baskets(baskets))  # one row
    one = B.doc_freq(baskets).select(F.array("token").alias("items"), F.lit(1).alias("length"), F.col("df").alias("count"))
    two = pair_counts(baskets, families).select(F.array("a", "b").alias("items"), F.lit(2).alias("length"), F.col("c_ab").alias("count"))
    return one.unionByName(two).join(n).where(F.col("count") >= X.required_count(support, F.col("n"))).select(
        "items", "length", "count", (F.col("count") / F.col("n")).alias("support")
    )


def movie_tag_itemsets(baskets: DataFrame, support: float) -> DataFrame:
    """Singles of both families and the pairs across them; raises if a family is empty."""
    kinds = {r.family for r in B.family_composition(baskets).select("family").collect()}
    if not {"movie", "tag"} <= kinds:
        raise ValueError(f"movie and tag tokens are needed; there are {sorted(kinds)}")
    return itemsets(baskets, support, ("movie", "tag"))


def top_itemsets(found: DataFrame, k: int = 10) -> DataFrame:
    """A report of the itemsets with most support."""
    return found.orderBy(F.desc("count"), F.array_join("items", ",")).limit(k)


def high_support(found: DataFrame, support: float) -> DataFrame:
    return found.where(F.col("support") >= support)


def metrics(c_ab: Column, c_a: Column, c_b: Column, n: Column) -> dict[str, Column]:
    confidence, s_a, s_b, s_ab = c_ab / c_a, c_a / n, c_b / n, c_ab / n
    return {
        "support": s_ab, "confidence": confidence, "lift": c_ab * n / (c_a * c_b), "leverage": s_ab - s_a * s_b,
        "conviction": F.when(c_ab == c_a, F.lit(float("inf"))).otherwise((1 - s_b) / (1 - confidence)),
    }


def rules(
    baskets: DataFrame, support: float, min_confidence: float, min_lift: float | None = None, families: tuple[str, str] | None = None
) -> DataFrame:
    """Both directions of frequent pairs: ``antecedent, consequent, count_ab, count_a, count_b, n`` and the metrics.

    Confidence is inclusive, lift is strict. ``families`` keeps pairs across two families.
    """
    n = F.broadcast(n_baskets(baskets))  # one row
    pairs = pair_counts(baskets, families).join(n).where(F.col("c_ab") >= X.required_count(support, F.col("n")))
    sides = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    both = pairs.select(sides.alias("s"), "c_ab", "n").select(F.col("s.x").alias("antecedent"), F.col("s.y").alias("consequent"), "c_ab", "n")
    singles = B.doc_freq(baskets)
    both = both.join(singles.select(F.col("token").alias("antecedent"), F.col("df").alias("c_a")), "antecedent")
    both = both.join(singles.select(F.col("token").alias("consequent"), F.col("df").alias("c_b")), "consequent")
    made = metrics(F.col("c_ab"), F.col("c_a"), F.col("c_b"), F.col("n"))
    out = both.select(
        "antecedent", "consequent", F.col("c_ab").alias("count_ab"), F.col("c_a").alias("count_a"), F.col("c_b").alias("count_b"), "n",
        *(c.alias(k) for k, c in made.items()),
    ).where(F.col("confidence") >= min_confidence)
    return out if min_lift is None else out.where(F.col("lift") > min_lift)


def as_exported(found: DataFrame) -> DataFrame:
    """Rules with token lists and their type."""
    lists = {c: F.array(c) for c in ("antecedent", "consequent")}
    return found.select(
        lists["antecedent"].alias("antecedent"), lists["consequent"].alias("consequent"), "support", "confidence", "lift", "leverage", "conviction",
        X.rule_type(lists["antecedent"], lists["consequent"]).alias("rule_type"),
    )


def single_sided(found: DataFrame) -> DataFrame:
    """Rules with one token on each side, of exported rules."""
    return found.where((F.size("antecedent") == 1) & (F.size("consequent") == 1))


def gate_evidence(found: DataFrame, min_ab: int = 50, min_a: int = 100, max_support_b: float | None = None) -> DataFrame:
    """Gate 1: enough baskets behind the pair and the antecedent, and a consequent that is not near universal."""
    kept = found.where((F.col("count_ab") >= min_ab) & (F.col("count_a") >= min_a))
    return kept if max_support_b is None else kept.where(F.col("count_b") / F.col("n") <= max_support_b)


def gate_held_out(
    found: DataFrame, test: DataFrame, mode: str, keep: DataFrame, min_confidence: float = 0.10, min_ratio: float = 0.80, min_ab: int = 50,
    tops: dict[str, int | None] | None = None, caps: dict[str, int | None] | None = None,
) -> DataFrame:
    """Gate 2: rules recounted on held-out baskets that get the mode, limits and caps anew and then only tokens kept in training.

    Without held-out baskets the rules stay as they are.
    """
    from . import itemsets as I

    own = I.coded_by(B.to_tokens(B.controlled(test, mode, tops, caps)), I.dictionary(keep))
    return I.stable(found, own, min_confidence, min_ratio, min_ab)


def across(found: DataFrame, x: str = "genre", y: str = "tag") -> DataFrame:
    """Rules with one side of each family."""
    fa, fb = X.family(F.col("antecedent")), X.family(F.col("consequent"))
    return found.where(((fa == x) & (fb == y)) | ((fa == y) & (fb == x)))


def ranked(found: DataFrame, limit: int | None = None) -> DataFrame:
    """By lift (mirror rules tie up to rounding), then tokens."""
    out = found.orderBy(F.desc(F.round("lift", 9)), "antecedent", "consequent")
    return out.limit(limit) if limit else out


def length_histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("length").agg(F.count("*").alias("n"))


def metric_ranges(found: DataFrame) -> DataFrame:
    names = ("support", "confidence", "lift", "leverage")
    return found.agg(*(f(c).alias(f"{c}_{k}") for c in names for k, f in (("min", F.min), ("max", F.max))))


def metric_histogram(found: DataFrame, metric: str, bins: int = 40) -> DataFrame:
    """Equal-width bins from 1, the last one closed."""
    ends = found.agg(F.min(metric).alias("lo"), F.max(metric).alias("hi"))
    x = F.col(metric)
    place = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins)))
    return found.select(metric).join(F.broadcast(ends)).groupBy(place.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def scatter(found: DataFrame) -> DataFrame:
    return found.select("support", "lift", "confidence")


def fpgrowth(baskets: DataFrame, support: float):
    """Spark ML's itemsets of any length; for small sparse vocabularies and cross-checks."""
    from pyspark.ml.fpm import FPGrowth

    return FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.0).fit(baskets).freqItemsets
