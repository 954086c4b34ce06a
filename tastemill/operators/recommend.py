"""Rule-driven recommendations. Rules hold token lists ``antecedent, consequent`` and ``support, confidence, lift``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

ALIASES = {"antecedents": "antecedent", "consequents": "consequent"}
METRICS = ("support", "confidence", "lift")


def adapt_rules(raw: DataFrame) -> DataFrame:
    """Rules of a file: plural names, lists as text, metrics as text; rows without metrics go. Adds the first movie of the consequent."""
    for old, new in ALIASES.items():
        if old in raw.columns and new not in raw.columns:
            raw = raw.withColumnRenamed(old, new)
    missing = sorted({"antecedent", "consequent", *METRICS} - set(raw.columns))
    if missing:
        raise ValueError(f"rules lack {missing}")
    kinds = dict(raw.dtypes)
    sides = [(F.col(c) if kinds[c].startswith("array") else X.token_list(F.col(c))).alias(c) for c in ("antecedent", "consequent")]
    out = raw.select(*sides, *(F.col(m).try_cast("double").alias(m) for m in METRICS)).dropna(subset=list(METRICS))
    return out.withColumn("rec_token", X.first_movie(F.col("consequent")))


def fired(rules: DataFrame, seed: str, min_lift: float = 1.1, min_confidence: float = 0.4) -> DataFrame:
    """Rules that lead from the seed to another movie; both thresholds are inclusive."""
    return rules.where(
        F.array_contains("antecedent", seed) & F.col("rec_token").isNotNull() & (F.col("rec_token") != seed)
        & (F.col("lift") >= min_lift) & (F.col("confidence") >= min_confidence)
    )


def recommend(rules: DataFrame, seed: str, k: int = 10, min_lift: float = 1.1, min_confidence: float = 0.4) -> DataFrame:
    """``rank, rec_token`` with the best metrics and how many rules speak for it."""
    by = fired(rules, seed, min_lift, min_confidence).groupBy("rec_token").agg(
        F.max("lift").alias("lift"), F.max("confidence").alias("confidence"), F.max("support").alias("support"), F.count("*").alias("evidence_count")
    )
    best = by.orderBy(F.desc(F.round("lift", 9)), F.desc("confidence"), F.desc("support"), "rec_token").limit(k)
    order = Window.orderBy(F.desc(F.round("lift", 9)), F.desc("confidence"), F.desc("support"), "rec_token")
    return best.withColumn("rank", F.row_number().over(order))


def evidence(rules: DataFrame, seed: str, k: int = 10, n: int = 3, min_lift: float = 1.1, min_confidence: float = 0.4) -> DataFrame:
    """Up to n rules for each recommendation, best first."""
    recs = recommend(rules, seed, k, min_lift, min_confidence).select("rec_token", "rank")
    order = Window.partitionBy("rec_token").orderBy(
        F.desc(F.round("lift", 9)), F.desc("confidence"), F.desc("support"), F.array_join("antecedent", ","), F.array_join("consequent", ",")
    )
    rows = fired(rules, seed, min_lift, min_confidence).join(recs, "rec_token").withColumn("evidence_rank", F.row_number().over(order))
    return rows.where(F.col("evidence_rank") <= n)


def tag_dna(rules: DataFrame, seed: str, k: int = 5) -> DataFrame:
    """The tags of rules that hold the seed on either side, with their best metrics."""
    both = F.concat("antecedent", "consequent")
    rows = rules.where(F.array_contains(both, seed)).select(F.explode(F.array_distinct(both)).alias("tag"), *METRICS).where(F.col("tag").startswith("tag:"))
    best = rows.groupBy("tag").agg(*(F.max(m).alias(m) for m in METRICS))
    return best.orderBy(F.desc(F.round("lift", 9)), F.desc("confidence"), F.desc("support"), "tag").limit(k)


def genre_semantics(rules: DataFrame, genres: list[str], k: int = 10) -> DataFrame:
    """The strongest rules that hold one of the genres on a side; without any, the strongest of all, marked ``fallback``."""
    wanted = F.array(*map(F.lit, genres)) if genres else F.array().cast("array<string>")
    order = (F.desc(F.round("lift", 9)), F.desc("confidence"), F.desc("support"), F.array_join("antecedent", ","), F.array_join("consequent", ","))
    names = ("antecedent", "consequent", *METRICS)
    own = F.coalesce(F.arrays_overlap("antecedent", wanted) | F.arrays_overlap("consequent", wanted), F.lit(False))
    # Own rules come first, so that one of them among the first k says that there are some.
    best = rules.select(*names, (~own).alias("fallback")).orderBy("fallback", *order).limit(k)
    some = F.min("fallback").over(Window.partitionBy(F.lit(0)))  # k rows
    return best.withColumn("_some", some).where(F.col("fallback") == F.col("_some")).drop("_some").orderBy(*order)


def covered_seeds(rules: DataFrame) -> DataFrame:
    """Movies that are a seed of some rule."""
    return rules.select(F.explode("antecedent").alias("token")).where(F.col("token").startswith("movie:")).distinct()


def seed_options(movies: DataFrame, rules: DataFrame) -> DataFrame:
    from .present import titles

    return titles(movies).join(covered_seeds(rules), "token", "left_semi").orderBy("title", "token")


def seed_coverage(movies: DataFrame, rules: DataFrame) -> DataFrame:
    from .present import titles

    rows = titles(movies).join(covered_seeds(rules).withColumn("hit", F.lit(1)), "token", "left")
    n = F.count("*")
    return rows.agg(n.alias("movies"), F.count("hit").alias("covered"), F.when(n == 0, 0.0).otherwise(100.0 * F.count("hit") / n).alias("coverage_percent"))


def default_seed(options: DataFrame, preferred: list[str]) -> str | None:
    """The first preferred token among the options, else the first option by title."""
    known = {r.token for r in options.where(F.col("token").isin(preferred)).collect()} if preferred else set()
    for token in preferred:
        if token in known:
            return token
    first = options.first()
    return first.token if first else None


def vocabulary(rules: DataFrame) -> DataFrame:
    return rules.select(F.explode(F.array_union("antecedent", "consequent")).alias("token")).distinct()


def rule_evidence(rules: DataFrame, movies: DataFrame, seed: str, k: int = 10, n: int = 3, **thresholds) -> DataFrame:
    """The export table of a seed."""
    from .present import with_titles

    rows = evidence(rules, seed, k, n, **thresholds).withColumn("seed_movie_token", F.lit(seed)).withColumnRenamed("rec_token", "rec_movie_token")
    named = with_titles(rows, movies, "seed_movie_token", "rec_movie_token")
    return named.select(
        "seed_movie_token", F.col("seed_movie_token_title").alias("seed_title"), "rec_movie_token", F.col("rec_movie_token_title").alias("rec_title"),
        "antecedent", "consequent", *METRICS,
    )
