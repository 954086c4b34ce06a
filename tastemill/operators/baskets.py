"""Token baskets and the reduction of their vocabulary. Baskets are ``userId, items, n_items``; long form is ``userId, token``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .features import exploded_genres

FAMILIES = ("genre", "movie", "tag")
MOST_BROADCAST = 50_000
MODES = {
    "full": FAMILIES, "genre_only": ("genre",), "movie_only": ("movie",), "tag_only": ("tag",), "genre_tag": ("genre", "tag"),
    "genre_movie": ("genre", "movie"), "movie_tag": ("movie", "tag"), "controlled_movie_tag": ("movie", "tag"),
}


def likes(ratings: DataFrame, threshold: float = 4.0) -> DataFrame:
    return ratings.where(F.col("rating") >= threshold).select("userId", "movieId").distinct()


def token_rows(
    ratings: DataFrame, movies: DataFrame, tags: DataFrame, like_threshold: float = 4.0, min_tag_freq: int = 10, families: tuple[str, ...] = FAMILIES
) -> DataFrame:
    """``userId, token`` of liked movies, their genres and the user's own frequent tags on them; a genre or tag comes once for each movie that has it."""
    liked, parts = likes(ratings, like_threshold), []
    if "movie" in families:
        parts.append(liked.select("userId", X.movie_token(F.col("movieId")).alias("token")))
    if "genre" in families:
        parts.append(liked.join(exploded_genres(movies), "movieId").select("userId", X.genre_token(F.col("genre")).alias("token")))
    if "tag" in families:
        frequent = tags.groupBy("tag_norm").agg(F.count("*").alias("n")).where(F.col("n") >= min_tag_freq).select("tag_norm")
        own = tags.join(frequent, "tag_norm", "left_semi").select("userId", "movieId", "tag_norm").distinct()
        parts.append(liked.join(own, ["userId", "movieId"]).select("userId", X.tag_token(F.col("tag_norm")).alias("token")))
    if not parts:
        return ratings.sparkSession.createDataFrame([], "userId int, token string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def basket_tokens(ratings: DataFrame, movies: DataFrame, tags: DataFrame, **options) -> DataFrame:
    """The distinct rows of ``token_rows``; liked movies are distinct before they are tokens."""
    families = options.pop("families", FAMILIES)
    others = tuple(k for k in families if k != "movie")
    if "movie" not in families:
        return token_rows(ratings, movies, tags, families=others, **options).distinct()
    own = token_rows(ratings, movies, tags, families=("movie",), **options)
    return own.unionByName(token_rows(ratings, movies, tags, families=others, **options).distinct()) if others else own


def to_baskets(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("userId").agg(F.array_sort(F.collect_set("token")).alias("items")).withColumn("n_items", F.size("items"))


def to_tokens(baskets: DataFrame) -> DataFrame:
    """``userId, token``, each token of a basket once."""
    return baskets.select("userId", F.explode(F.array_distinct("items")).alias("token")).where("token IS NOT NULL AND token <> ''")


def transactions(
    ratings: DataFrame, movies: DataFrame, tags: DataFrame, like_threshold: float = 4.0, min_tag_freq: int = 10, families: tuple[str, ...] = FAMILIES,
    deal: bool = False,
) -> DataFrame:
    """The baskets of ``token_rows``; sets of tokens drop repeats themselves.

    A like brings the tokens of its movie as one list, and its tags as another. ``deal`` shuffles the lists by user before they are gathered, as rows that
    are scattered over the tasks gain nothing from being gathered there; tables in buckets of users need no shuffle.
    """
    liked, parts = likes(ratings, like_threshold), []
    own = [F.array(X.movie_token(F.col("movieId")))] if "movie" in families else []
    if "genre" in families:
        genres = movies.select("movieId", F.array_distinct(F.transform("genres_list", X.genre_token)).alias("genres"))
        listed = liked.join(genres, "movieId", "left" if own else "inner")
        lists = F.concat(*own, F.coalesce("genres", F.array().cast("array<string>")))
        parts.append((listed if own else listed.where(F.size("genres") > 0)).select("userId", lists.alias("tokens")))
    elif own:
        parts.append(liked.select("userId", own[0].alias("tokens")))
    if "tag" in families:
        frequent = tags.groupBy("tag_norm").agg(F.count("*").alias("n")).where(F.col("n") >= min_tag_freq).select("tag_norm")
        events = tags.join(frequent, "tag_norm", "left_semi").select("userId", "movieId", "tag_norm")
        parts.append(liked.join(events, ["userId", "movieId"]).select("userId", F.array(X.tag_token(F.col("tag_norm"))).alias("tokens")))
    if not parts:
        return to_baskets(token_rows(ratings, movies, tags, families=()))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    lists = (rows.repartition("userId") if deal else rows).groupBy("userId").agg(F.flatten(F.collect_list("tokens")).alias("items"))
    return lists.select("userId", F.sort_array(F.array_distinct(F.array_compact("items"))).alias("items")).withColumn("n_items", F.size("items"))


def doc_freq(baskets: DataFrame) -> DataFrame:
    """``token, df``: baskets that hold each token."""
    return to_tokens(baskets).groupBy("token").agg(F.count("*").alias("df"))


def top_per_family(frequency: DataFrame, tops: dict[str, int | None]) -> DataFrame:
    """The most frequent tokens of the families that have a limit, ties to the smaller token."""
    rank = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("df"), "token"))
    limit = F.lit(None).cast("int")
    for kind, k in tops.items():
        if k:
            limit = F.when(F.col("family") == kind, k).otherwise(limit)
    ranked = frequency.withColumn("family", X.family(F.col("token"))).withColumn("_limit", limit)
    # Only limited families are ranked; the row limit is pushed below the shuffle.
    free = ranked.where("_limit IS NULL")
    best = ranked.where("_limit IS NOT NULL").withColumn("_r", rank).where("_r <= _limit").drop("_r")
    return free.unionByName(best).drop("_limit")


def with_kept(tokens: DataFrame, kept: DataFrame, tops: dict[str, int | None]) -> DataFrame:
    """``tokens`` with the columns of ``kept``, whose families with a limit hold so many tokens at most: above ``MOST_BROADCAST`` of them Spark picks the join."""
    limited = {kind: k for kind, k in tops.items() if k}
    if not limited or sum(limited.values()) > MOST_BROADCAST:
        return tokens.join(kept, "token")
    inside = X.family(F.col("token")).isin(*limited)
    best = tokens.where(inside).join(F.broadcast(kept.where(F.col("family").isin(*limited))), "token")
    return best.unionByName(tokens.where(~inside).join(kept.where(~F.col("family").isin(*limited)), "token"))


def reduce_baskets(
    baskets: DataFrame, families: tuple[str, ...] = FAMILIES, min_df: int = 5, top_movies: int | None = 5000, top_tags: int | None = 500,
    min_items: int = 2, max_items: int | None = None, sample_frac: float | None = None, seed: int = 42,
) -> DataFrame:
    """Family filter, document frequency, top-K per family, minimum size, cap by global priority, exact-size sample."""
    tokens = to_tokens(baskets).where(X.family(F.col("token")).isin(*families))
    frequency = tokens.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    tops = {"movie": top_movies, "tag": top_tags}
    rows = with_kept(tokens, top_per_family(frequency, tops), tops)
    if max_items:
        order = F.when(F.col("family") == "genre", 0).when(F.col("family") == "movie", 1).when(F.col("family") == "tag", 2).otherwise(3)
        key = F.struct(order.alias("o"), (-F.col("df")).alias("d"), "token")
        out = rows.groupBy("userId").agg(F.array_sort(F.collect_set(key)).alias("s")).where(F.size("s") >= min_items)
        out = out.select("userId", F.transform(F.slice("s", 1, max_items), lambda x: x["token"]).alias("items"))
    else:
        out = rows.groupBy("userId").agg(F.array_sort(F.collect_set("token")).alias("items"))
    out = out.where(F.size("items") >= min_items)
    if sample_frac is not None:
        out = exact_sample(out, sample_frac, seed)
    return out.select("userId", "items", F.size("items").alias("n_items"))


def exact_sample(baskets: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """round(fraction * n) baskets (half to even): those with the smallest digests of user and seed, the same for one seed.

    Counts of the digests' first four digits, 65,536 at most, tell which groups are in whole; only the last one is cut by rank.
    """
    rows = baskets.withColumn("_digest", F.md5(F.concat_ws(":", F.col("userId").cast("string"), F.lit(str(seed)))))
    rows = rows.withColumn("_group", F.left("_digest", F.lit(4)))
    every = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_c").over(every.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("_group").agg(F.count("*").alias("_c"))
    sizes = sizes.select("_group", (F.bround(F.sum("_c").over(every) * F.lit(fraction)).cast("bigint") - before).alias("_left"))
    rank = F.row_number().over(Window.partitionBy("_group").orderBy("_digest", "userId"))
    held = rows.join(F.broadcast(sizes.where("_left > 0")), "_group")  # 65,536 rows at most
    return held.withColumn("_r", rank).where("_r <= _left").select(baskets.columns)


def token_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = doc_freq(before).withColumnRenamed("df", "df_before"), doc_freq(after).withColumnRenamed("df", "df_after")
    none = F.lit(0)
    return a.join(b, "token", "full").select(
        "token", X.family(F.col("token")).alias("family"), F.coalesce("df_before", none).alias("df_before"),
        F.coalesce("df_after", none).alias("df_after"), (F.coalesce("df_after", none) > 0).alias("kept"),
    )


def basket_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    def of(df: DataFrame, name: str) -> DataFrame:
        size = F.col("n_items")
        return df.agg(
            F.count("*").alias(f"{name}_baskets"), F.avg(size).alias(f"{name}_mean"), F.median(size).alias(f"{name}_median"),
            F.coalesce(F.sum(size), F.lit(0)).alias(f"{name}_tokens"),
        )

    both = of(before, "before").join(of(after, "after"))

    def cut(what: str):
        a, b = F.col(f"before_{what}"), F.col(f"after_{what}")
        return F.when(a == 0, 0.0).otherwise(1 - b / a)

    return both.select("*", cut("baskets").alias("basket_reduction"), cut("tokens").alias("token_reduction"))


def removed_vocabulary(stats: DataFrame, limit: int = 200) -> DataFrame:
    """A report's sample: the first removed tokens."""
    return stats.where("NOT kept").select("token").orderBy("token").limit(limit)


def family_composition(baskets: DataFrame) -> DataFrame:
    tokens = to_tokens(baskets).withColumn("family", X.family(F.col("token")))
    return tokens.groupBy("family").agg(F.countDistinct("token").alias("vocabulary"), F.count("*").alias("tokens"))


def matrix_density(baskets: DataFrame) -> DataFrame:
    n = baskets.agg(F.count("*").alias("n_baskets"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("cells_set"))
    v = to_tokens(baskets).agg(F.countDistinct("token").alias("vocabulary"))
    cells = F.col("n_baskets") * F.col("vocabulary")
    return n.join(v).select("*", F.when(cells == 0, 0.0).otherwise(F.col("cells_set") / cells).alias("density"))


def with_mode(baskets: DataFrame, mode: str) -> DataFrame:
    """Baskets with the families of a mode; empty ones go."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {sorted(MODES)}")
    kinds = MODES[mode]
    items = F.filter("items", lambda t: F.coalesce(X.family(t).isin(*kinds), F.lit(False)))
    return baskets.select("userId", F.array_distinct(items).alias("items")).where(F.size("items") > 0).withColumn("n_items", F.size("items"))


def controlled(baskets: DataFrame, mode: str, tops: dict[str, int | None] | None = None, caps: dict[str, int | None] | None = None) -> DataFrame:
    """Family mode, top-K vocabularies and per-basket caps by (basket frequency, token).

    Frequencies are those of the unfiltered baskets. With a limit or cap, unknown families go and items stand as genres, movies, tags.
    """
    tops, caps = tops or {}, caps or {}
    if not any(k and k > 0 for k in (*tops.values(), *caps.values())):
        return with_mode(baskets, mode)
    kinds = MODES[mode] if mode in MODES else None
    if kinds is None:
        raise ValueError(f"unknown mode {mode!r}; known: {sorted(MODES)}")
    frequency = doc_freq(baskets).withColumn("family", X.family(F.col("token"))).where(F.col("family").isin(*kinds)).drop("family")
    tops = {k: v for k, v in tops.items() if v and v > 0}
    rows = with_kept(to_tokens(baskets).where(X.family(F.col("token")).isin(*kinds)), top_per_family(frequency, tops), tops)
    cap = F.lit(None).cast("int")
    for kind, k in caps.items():
        if k and k > 0:
            cap = F.when(F.col("family") == kind, k).otherwise(cap)
    place = F.row_number().over(Window.partitionBy("userId", "family").orderBy(F.desc("df"), "token"))
    rows = rows.withColumn("_r", place).withColumn("_cap", cap).where("_cap IS NULL OR _r <= _cap")
    order = F.when(F.col("family") == "genre", 0).when(F.col("family") == "movie", 1).otherwise(2)
    out = rows.groupBy("userId").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("_r").alias("r"), "token"))).alias("s"))
    return out.select("userId", F.transform("s", lambda x: x["token"]).alias("items")).withColumn("n_items", F.size("items"))
