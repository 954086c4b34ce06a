"""The engine's queries over the star schema adapter, each with its SQL.

Results are made plain for comparison: times as integers, small integers as bigint, fractions rounded to 6 digits, lists joined.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import baskets as B
from .operators import clean as C
from .operators import features as FE
from .operators import itemsets as I
from .operators import mining as M
from .operators import present as P
from .operators import quality as Q
from .operators import recommend as R
from .operators import seeds
from .operators import split as S
from .plans.config import PipelineConfig, preset
from .plans.leases import Scope
from .plans.pipeline import audit, mine
from .plans.sizes import size_shuffles
from .sources.adapter import Star

TIES = ("l_orderkey", "l_linenumber", "l_suppkey")
SEED = "movie:1"


def plain(df: DataFrame) -> DataFrame:
    def one(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            c = F.unix_micros(c.cast("timestamp"))
        elif kind in ("tinyint", "smallint", "int"):
            c = c.cast("bigint")
        elif kind in ("float", "double"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind.startswith("array"):
            c = F.array_join(c, ",")
        return c.alias(name)

    return df.select(*(one(n, k) for n, k in df.dtypes))


class Tables:
    """The adapter's tables and what the pipeline makes of them, as lazy frames; ``keep`` leases a frame until the query's result is gone."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.raw = spark, Star(spark, sf_dir)
        self.scope = Scope(spark, [f"{sf_dir}/{name}.parquet" for name in ("orders", "lineitem", "part")])
        self.keep = self.scope.keep
        size_shuffles(spark, sum(size for _, _, size, _ in self.scope.state))
        self.movies, self.links = C.clean_movies(self.raw.movies()), C.clean_links(self.raw.links())
        self.ratings = C.clean_ratings(self.raw.ratings())
        self.tags = C.clean_tags(self.raw.tags())
        self._times = None

    def cutoff(self) -> DataFrame:
        """One row, from the first and last time of the ratings, which are looked for once."""
        if self._times is None:
            self._times = self.raw.times().select(X.utc_seconds(F.col("timestamp")).alias("rating_dt_utc"))
        return S.time_cutoff(self._times)

    def split(self) -> tuple[DataFrame, DataFrame]:
        return S.global_split(self.ratings, at=self.cutoff())

    def split_once(self) -> tuple[DataFrame, DataFrame]:
        """The same for plans that read the ratings several times."""
        return S.global_split(self.keep(self.ratings), at=self.cutoff())

    def user_split(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return S.user_split(C.clean_ratings(self.raw.ratings(keys=True), *TIES), ties=TIES)

    def tags_train(self) -> DataFrame:
        return S.tags_before(self.tags, self.cutoff())

    def tags_once(self) -> DataFrame:
        """What baskets need of the training tags, for their frequencies and for the users' own."""
        return self.keep(self.tags_train().select("userId", "movieId", "tag_norm"))

    def tokens(self, **options) -> DataFrame:
        return self.keep(B.basket_tokens(self.split()[0], self.movies, self.tags_once(), **options))

    def test_tokens(self, **options) -> DataFrame:
        return B.basket_tokens(self.split()[1], self.movies, self.tags, **options)

    def baskets_read_once(self, families: tuple[str, ...] = B.FAMILIES) -> DataFrame:
        tags = self.tags_once() if "tag" in families else self.tags
        return B.transactions(self.split()[0], self.movies, tags, families=families, deal=True)

    def baskets(self) -> DataFrame:
        return self.keep(self.baskets_read_once())

    def vocabulary(self) -> DataFrame:
        """Distinct tokens of all baskets, straight from the rows that make them; read once, so nothing is kept."""
        rows = B.token_rows(self.split()[0], self.movies, self.tags_once())
        return rows.select("token").where("token IS NOT NULL AND token <> ''").distinct()

    def coded(self, support: float, *families: str) -> I.Coded:
        return I.coded(self.tokens(families=families), support, self.keep)

    def genre_tag(self, support: float = 0.005) -> I.Coded:
        return self.coded(support, "genre", "tag")

    def movie_tag(self, support: float = 0.001) -> I.Coded:
        return self.coded(support, "movie", "tag")


# --- SQL of the same tables -------------------------------------------------------------------------------------------------


def _slug(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown')"


def _family(x: str) -> str:
    return f"CASE WHEN contains({x}, ':') THEN split_part({x}, ':', 1) ELSE 'unknown' END"


CTES = f"""
ev AS (SELECT CAST(o_custkey AS BIGINT) AS userId, CAST(l_partkey AS BIGINT) AS movieId, CAST(ceil(l_quantity / 5) / 2 AS DOUBLE) AS rating,
  CAST(epoch(l_shipdate) AS BIGINT) AS ts, epoch_us(l_shipdate) AS us, l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
mr AS (SELECT CAST(p_partkey AS BIGINT) AS movieId, p_name || CASE WHEN p_partkey % 10 <> 0 THEN ' (' || CAST(1950 + p_partkey % 70 AS VARCHAR) || ')' ELSE '' END AS title,
  CASE WHEN p_partkey % 50 <> 0 THEN p_type || '|' || p_brand ELSE '(no genres listed)' END AS genres FROM part),
mc AS (SELECT movieId, title, CAST(TRY_CAST(nullif(regexp_extract(trim(title), '\\((\\d{{4}})\\)\\s*$', 1), '') AS INT) AS BIGINT) AS year, genres,
  CASE WHEN genres IS NULL OR trim(genres) IN ('', '(no genres listed)') THEN [] ELSE list_filter(list_transform(string_split(genres, '|'), lambda x: trim(x)), lambda x: x <> '') END AS gl FROM mr),
tr AS (SELECT userId, movieId, '  ' || upper(p_name) || ' ' AS tag, ts, us FROM ev JOIN part ON p_partkey = movieId WHERE l_linenumber <= 2),
tc AS (SELECT * FROM (SELECT userId, movieId, tag AS tag_raw, trim(regexp_replace(lower(tag), '\\s+', ' ', 'g')) AS tag_norm, ts, us FROM tr) WHERE tag_norm <> ''),
lc AS (SELECT CAST(p_partkey AS BIGINT) AS movieId, CAST(p_partkey + 1000000 AS BIGINT) AS imdbId, CASE WHEN p_size % 7 <> 0 THEN CAST(p_partkey + 2000000 AS BIGINT) END AS tmdbId FROM part),
cut AS (SELECT CAST(floor(min(us) + (max(us) - min(us)) * CAST(0.9 AS DOUBLE)) AS BIGINT) AS cutoff FROM ev),
trn AS (SELECT ev.* FROM ev, cut WHERE us < cutoff),
tst AS (SELECT ev.* FROM ev, cut WHERE us >= cutoff),
pl AS (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY us, ts, movieId, rating, l_orderkey, l_linenumber, l_suppkey) - 1 AS pos, count(*) OVER (PARTITION BY userId) AS n FROM ev),
pk AS (SELECT *, CASE WHEN n >= 2 THEN least(greatest(CAST(floor(CAST(0.9 AS DOUBLE) * n) AS BIGINT), 1), n - 1) ELSE 0 END AS k FROM pl),
utrn AS (SELECT * FROM pk WHERE n >= 2 AND pos < k),
utst AS (SELECT * FROM pk WHERE n >= 2 AND pos >= k),
ucut AS (SELECT userId, min(us) AS cutoff FROM utst GROUP BY 1),
tg AS (SELECT tc.* FROM tc, cut WHERE us < cutoff),
mg AS (SELECT DISTINCT movieId, genre FROM (SELECT movieId, unnest(gl) AS genre FROM mc)),
lk AS (SELECT DISTINCT userId, movieId FROM trn WHERE rating >= 4),
ft AS (SELECT tag_norm FROM tg GROUP BY 1 HAVING count(*) >= 10),
ut AS (SELECT DISTINCT userId, movieId, tag_norm FROM tg WHERE tag_norm IN (SELECT tag_norm FROM ft)),
tok AS (SELECT userId, 'movie:' || CAST(movieId AS VARCHAR) AS token FROM lk
  UNION SELECT userId, 'genre:' || {_slug('genre')} FROM lk JOIN mg USING (movieId)
  UNION SELECT userId, 'tag:' || {_slug('tag_norm')} FROM lk JOIN ut USING (userId, movieId)),
tk AS (SELECT userId, token, {_family('token')} AS family FROM tok),
df AS (SELECT token, family, count(*) AS df FROM tk GROUP BY 1, 2),
lk2 AS (SELECT DISTINCT userId, movieId FROM tst WHERE rating >= 4),
ft2 AS (SELECT tag_norm FROM tc GROUP BY 1 HAVING count(*) >= 10),
ut2 AS (SELECT DISTINCT userId, movieId, tag_norm FROM tc WHERE tag_norm IN (SELECT tag_norm FROM ft2)),
tk2 AS (SELECT userId, 'genre:' || {_slug('genre')} AS token FROM lk2 JOIN mg USING (movieId) UNION SELECT userId, 'tag:' || {_slug('tag_norm')} FROM lk2 JOIN ut2 USING (userId, movieId))
"""

METRICS = """round(c_ab / CAST(n AS DOUBLE), 6) AS support, round(c_ab / CAST(c_a AS DOUBLE), 6) AS confidence,
  round(c_ab * CAST(n AS DOUBLE) / (c_a * c_b), 6) AS lift, round(c_ab / CAST(n AS DOUBLE) - (c_a / CAST(n AS DOUBLE)) * (c_b / CAST(n AS DOUBLE)), 6) AS leverage,
  round(CASE WHEN c_ab = c_a THEN CAST('inf' AS DOUBLE) ELSE (1 - c_b / CAST(n AS DOUBLE)) / (1 - c_ab / CAST(c_a AS DOUBLE)) END, 6) AS conviction"""


def sql(final: str, *more: str) -> str:
    return "WITH " + CTES.strip() + "".join(",\n" + m for m in more) + "\n" + final


def mined(tokens: str, support: float, confidence: float, lift: float | None = None, where: str = "true") -> tuple[str, ...]:
    """CTEs that mine ``tokens (userId, token)``: k0 frequent, kt kept tokens, kn, pr pairs and ru rules."""
    s = f"CAST({support} AS DOUBLE)"
    above = f"AND c_ab * CAST(n AS DOUBLE) / (c_a * c_b) > CAST({lift} AS DOUBLE)" if lift is not None else ""
    return (
        f"b0 AS ({tokens})",
        "n0 AS (SELECT count(DISTINCT userId) AS n FROM b0)",
        f"k0 AS (SELECT token, count(*) AS c FROM b0 GROUP BY 1 HAVING count(*) >= (SELECT ceil({s} * n) FROM n0))",
        "kt AS (SELECT userId, token FROM b0 WHERE token IN (SELECT token FROM k0))",
        "kn AS (SELECT count(DISTINCT userId) AS n FROM kt)",
        "k1 AS (SELECT token, count(*) AS c FROM kt GROUP BY 1)",
        "pr AS (SELECT x.token AS a, y.token AS b, count(*) AS c_ab FROM kt x JOIN kt y ON x.userId = y.userId AND x.token < y.token GROUP BY 1, 2)",
        f"pf AS (SELECT pr.*, kn.n FROM pr, kn WHERE c_ab >= ceil({s} * n) AND ({where}))",
        "pd AS (SELECT a AS antecedent, b AS consequent, c_ab, n FROM pf UNION ALL SELECT b, a, c_ab, n FROM pf)",
        f"""ru AS (SELECT p.*, x.c AS c_a, y.c AS c_b FROM pd p JOIN k1 x ON x.token = p.antecedent JOIN k1 y ON y.token = p.consequent
  WHERE c_ab / CAST(x.c AS DOUBLE) >= CAST({confidence} AS DOUBLE) {above.replace("c_a ", "x.c ").replace("c_b)", "y.c)")})""",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def put(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tables = Tables(spark, sf_dir)
            return tables.scope.bind(plain(f(tables)))

        QUERIES[name] = run
        if text:
            SQL[name] = text
        return f

    return put


def register(name: str, make: Callable[[Tables], DataFrame], text: str | None = None) -> None:
    query(name, text)(make)


# --- Cleaning and scalar functions ------------------------------------------------------------------------------------------

register("clean_movies", lambda t: t.movies.na.fill({"year": -1}), sql("SELECT movieId, title, coalesce(year, -1) AS year, genres, array_to_string(gl, ',') AS genres_list FROM mc"))
register("clean_ratings", lambda t: t.ratings, sql("SELECT userId, movieId, rating, ts AS timestamp, us AS rating_dt_utc FROM ev"))
register("clean_tags", lambda t: t.tags, sql("SELECT userId, movieId, tag_raw, tag_norm, ts AS timestamp, us AS tag_dt_utc FROM tc"))
register("clean_links", lambda t: t.links.na.fill({"tmdbId": -1}), sql("SELECT movieId, imdbId, coalesce(tmdbId, -1) AS tmdbId FROM lc"))
register("clean_genome_tags", lambda t: C.clean_genome_tags(t.raw.genome_tags()), "SELECT DISTINCT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) AS tagId, p_brand AS tag FROM part")
register("clean_genome_scores", lambda t: C.clean_genome_scores(t.raw.genome_scores()), "SELECT CAST(p_partkey AS BIGINT) AS movieId, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) AS tagId, round(CAST(CAST(p_retailprice / 4000 AS FLOAT) AS DOUBLE), 6) AS relevance FROM part")
register("genre_split", lambda t: FE.exploded_genres(t.movies), sql("SELECT movieId, genre FROM mg"))
register("title_year", lambda t: t.movies.na.fill({"year": -1}).groupBy("year").agg(F.count("*").alias("n")), sql("SELECT coalesce(year, -1) AS year, count(*) AS n FROM mc GROUP BY 1"))
register(
    "slugify_tokens",
    lambda t: t.tags.select(X.tag_token(F.col("tag_norm")).alias("token")).distinct().select("token", X.family(F.col("token")).alias("family"), X.title_case(F.col("token")).alias("titled")),
    sql(f"SELECT token, {_family('token')} AS family, (SELECT string_agg(CASE WHEN i = 1 OR NOT regexp_matches(token[i - 1], '[a-z]') THEN upper(token[i]) ELSE token[i] END, '' ORDER BY i) FROM range(1, length(token) + 1) r(i)) AS titled FROM (SELECT DISTINCT 'tag:' || {_slug('tag_norm')} AS token FROM tc)"),
)

# --- Quality ----------------------------------------------------------------------------------------------------------------

register("null_profile", lambda t: Q.null_counts(t.movies, "movieId", "title", "year"), sql("SELECT count(*) AS n_rows, count(*) FILTER (movieId IS NULL) AS movieId_nulls, count(*) FILTER (title IS NULL) AS title_nulls, count(*) FILTER (year IS NULL) AS year_nulls FROM mc"))
register("rating_domain", lambda t: Q.rating_domain(t.ratings), sql("SELECT count(*) AS n_rows, count(*) FILTER (userId IS NULL) AS user_nulls, count(*) FILTER (movieId IS NULL) AS movie_nulls, count(*) FILTER (rating IS NULL) AS rating_nulls, min(rating) AS rating_min, max(rating) AS rating_max, count(DISTINCT rating) FILTER (rating * 2 <> floor(rating * 2) OR rating < 0.5 OR rating > 5) AS off_scale_values, count(*) FILTER (rating * 2 <> floor(rating * 2) OR rating < 0.5 OR rating > 5) AS off_scale_rows FROM ev"))
register("duplicate_stats", lambda t: Q.duplicate_stats(t.ratings, "userId", "movieId", "timestamp"), sql("SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) - count(*) AS BIGINT) AS duplicates, count(*) AS unique_rows, round(CAST(sum(n) - count(*) AS DOUBLE) / sum(n), 6) AS duplicate_rate FROM (SELECT count(*) AS n FROM ev GROUP BY userId, movieId, ts)"))
register(
    "join_coverage", lambda t: Q.join_coverage(t.ratings, t.movies, "movieId"),
    sql("SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(coalesce(sum(n) FILTER (hit), 0) AS BIGINT) AS matched_rows, CAST(coalesce(sum(n) FILTER (NOT hit), 0) AS BIGINT) AS unmatched_rows, round(CAST(coalesce(sum(n) FILTER (hit), 0) AS DOUBLE) / sum(n), 6) AS coverage, count(*) AS fact_keys, count(*) FILTER (hit) AS matched_keys, count(*) FILTER (NOT hit) AS unmatched_keys, CAST(0 AS BIGINT) AS null_key_rows FROM (SELECT movieId, count(*) AS n, movieId IN (SELECT movieId FROM mr) AS hit FROM ev GROUP BY 1)"),
)
register("unmatched_keys", lambda t: Q.unmatched_keys(t.movies, t.split()[1], "movieId"), sql("SELECT DISTINCT movieId FROM mr WHERE movieId NOT IN (SELECT movieId FROM tst)"))
register("matched_rows", lambda t: Q.matched_rows(t.tags, t.movies.where("year >= 2000"), "movieId").select("userId", "movieId", "tag_norm"), sql("SELECT userId, movieId, tag_norm FROM tc WHERE movieId IN (SELECT movieId FROM mc WHERE year >= 2000)"))
register("movie_profile", lambda t: Q.movie_profile(t.movies), sql("SELECT count(*) AS n_rows, count(*) FILTER (year IS NULL) AS year_nulls, round(count(*) FILTER (year IS NULL) / CAST(count(*) AS DOUBLE), 6) AS year_null_share, min(year) AS year_min, max(year) AS year_max, count(*) FILTER (len(gl) = 0) AS no_genres, round(count(*) FILTER (len(gl) = 0) / CAST(count(*) AS DOUBLE), 6) AS no_genre_share FROM mc"))
register("tag_profile", lambda t: Q.tag_profile(t.tags), sql("SELECT count(*) AS n_rows, count(DISTINCT tag_raw) AS unique_raw, count(DISTINCT tag_norm) AS unique_norm, count(DISTINCT tag_raw) - count(DISTINCT tag_norm) AS reduction, count(*) FILTER (tag_norm = '') AS empty_norm FROM tc"))
register("link_coverage", lambda t: Q.link_coverage(t.links), sql("SELECT count(*) AS n_rows, count(*) FILTER (imdbId IS NULL) AS imdb_missing, round(count(imdbId) / CAST(count(*) AS DOUBLE), 6) AS imdb_coverage, count(*) FILTER (tmdbId IS NULL) AS tmdb_missing, round(count(tmdbId) / CAST(count(*) AS DOUBLE), 6) AS tmdb_coverage FROM lc"))
register("retention_stats", lambda t: Q.retention({"movies": t.raw.movies(), "tags": t.raw.tags()}, {"movies": t.movies, "tags": t.tags}), sql("SELECT 'movies' AS \"table\", (SELECT count(*) FROM mr) AS raw_rows, (SELECT count(*) FROM mc) AS clean_rows, round((SELECT count(*) FROM mc) / CAST((SELECT count(*) FROM mr) AS DOUBLE), 6) AS retention UNION ALL SELECT 'tags', (SELECT count(*) FROM tr), (SELECT count(*) FROM tc), round((SELECT count(*) FROM tc) / CAST((SELECT count(*) FROM tr) AS DOUBLE), 6)"))

# --- Splits -----------------------------------------------------------------------------------------------------------------

_RATING = "userId, movieId, rating, ts AS timestamp, us AS rating_dt_utc"
register("global_cutoff", lambda t: S.time_cutoff(t.ratings), sql("SELECT cutoff FROM cut"))
register("explicit_split_test", lambda t: S.global_split(t.ratings, cutoff="1997-06-01 00:00:00")[1], sql(f"SELECT {_RATING} FROM ev WHERE us >= epoch_us(TIMESTAMP '1997-06-01 00:00:00')"))
register("global_split_train", lambda t: t.split()[0], sql(f"SELECT {_RATING} FROM trn"))
register("global_split_test", lambda t: t.split()[1], sql(f"SELECT {_RATING} FROM tst"))
register("per_user_split_train", lambda t: t.user_split()[0], sql(f"SELECT {_RATING}, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey FROM utrn"))
register("per_user_split_test", lambda t: t.user_split()[1], sql(f"SELECT {_RATING}, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey FROM utst"))
register("user_cutoffs", lambda t: t.user_split()[2], sql("SELECT userId, cutoff FROM ucut"))
register("tags_train_global", lambda t: t.tags_train().select("userId", "movieId", "tag_norm", "timestamp"), sql("SELECT userId, movieId, tag_norm, ts AS timestamp FROM tg"))
register("tags_train_per_user", lambda t: S.tags_before(t.tags, t.user_split()[2]).select("userId", "movieId", "tag_norm", "timestamp"), sql("SELECT tc.userId, movieId, tag_norm, ts AS timestamp FROM tc LEFT JOIN ucut ON tc.userId = ucut.userId WHERE cutoff IS NULL OR us < cutoff"))
register("split_overlap", lambda t: S.overlap(*t.user_split()[:2]).agg(F.count("*").alias("n")), sql("SELECT count(*) AS n FROM (SELECT userId, movieId, ts FROM utrn INTERSECT SELECT userId, movieId, ts FROM utst)"))
register("temporal_violations", lambda t: S.order_violations(*t.user_split()[:2]).agg(F.count("*").alias("n")), sql("SELECT count(*) AS n FROM (SELECT userId, max(us) AS a FROM utrn GROUP BY 1) x JOIN (SELECT userId, min(us) AS b FROM utst GROUP BY 1) y USING (userId) WHERE a > b"))
for _key, _name in (("userId", "cold_start_users"), ("movieId", "cold_start_items")):
    register(_name, lambda t, k=_key: S.cold_start(*t.split(), k), sql(f"SELECT count(*) AS test_keys, count(*) FILTER (NOT known) AS cold_keys, round(count(*) FILTER (NOT known) / CAST(count(*) AS DOUBLE), 6) AS cold_rate FROM (SELECT DISTINCT {_key}, {_key} IN (SELECT {_key} FROM trn) AS known FROM tst)"))
register("split_sizes", lambda t: S.split_sizes(*t.split()), sql("SELECT (SELECT count(*) FROM trn) AS train_rows, (SELECT count(*) FROM tst) AS test_rows, round((SELECT count(*) FROM tst) / CAST((SELECT count(*) FROM ev) AS DOUBLE), 6) AS test_fraction"))
_SHARES = "d1 AS (SELECT rating, count(*) / CAST((SELECT count(*) FROM trn) AS DOUBLE) AS p FROM trn GROUP BY 1), d2 AS (SELECT rating, count(*) / CAST((SELECT count(*) FROM tst) AS DOUBLE) AS q FROM tst GROUP BY 1)"
register("rating_distribution", lambda t: S.rating_distribution(*t.split()), sql("SELECT rating, round(p, 6) AS train_share, round(q, 6) AS test_share FROM d1 JOIN d2 USING (rating)", _SHARES))
register("rating_divergence", lambda t: S.rating_divergence(*t.split()), sql("SELECT round((SELECT avg(rating) FROM trn), 6) AS train_mean, round((SELECT stddev_samp(rating) FROM trn), 6) AS train_std, round((SELECT avg(rating) FROM tst), 6) AS test_mean, round((SELECT stddev_samp(rating) FROM tst), 6) AS test_std, round((SELECT sum(q * ln((q + CAST(1e-10 AS DOUBLE)) / (p + CAST(1e-10 AS DOUBLE)))) FROM d1 JOIN d2 USING (rating)), 6) AS divergence", _SHARES))

# --- Features ---------------------------------------------------------------------------------------------------------------

_STATS = "count(*) AS n_ratings, round(avg(rating), 6) AS rating_mean, round(coalesce(stddev_samp(rating), 0), 6) AS rating_std, min(rating) AS rating_min, max(rating) AS rating_max"
_ENTROPY = "ec AS (SELECT movieId, count(*) AS c FROM trn GROUP BY movieId, rating), ep AS (SELECT movieId, c / CAST(sum(c) OVER (PARTITION BY movieId) AS DOUBLE) AS p FROM ec), en AS (SELECT movieId, CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0 END AS e FROM ep GROUP BY 1)"
_TOP = "tf AS (SELECT tag_norm, count(*) AS f FROM tg GROUP BY 1 HAVING count(*) >= 10), tm AS (SELECT movieId, tag_norm, count(*) AS n FROM tg WHERE tag_norm IN (SELECT tag_norm FROM tf) GROUP BY 1, 2), tp AS (SELECT *, row_number() OVER (PARTITION BY movieId ORDER BY n DESC, tag_norm) AS r FROM tm), tt AS (SELECT movieId, CAST(sum(n) AS BIGINT) AS n_tag_events, string_agg(tag_norm, '|' ORDER BY r) FILTER (r <= 3) AS top_tags FROM tp GROUP BY 1)"
register("user_base_features", lambda t: FE.user_base(t.split()[0]), sql(f"SELECT userId, {_STATS}, min(us) AS first_dt, max(us) AS last_dt, count(DISTINCT us // 86400000000) AS active_days FROM trn GROUP BY 1"))
register("user_genre_prefs", lambda t: FE.user_genre_means(t.split()[0], t.movies), sql("SELECT userId, genre, round(avg(rating), 6) AS mean FROM trn JOIN mg USING (movieId) GROUP BY 1, 2"))
register("user_tag_counts", lambda t: FE.user_tag_counts(t.tags_train()), sql("SELECT userId, count(*) AS n_tag_events FROM tg GROUP BY 1"))


def _wide_users(t: Tables) -> DataFrame:
    wide = FE.user_features(t.split_once()[0], t.movies, t.tags_train())
    prefs = [c for c in wide.columns if c.startswith("genre_pref__")]
    total = reduce(lambda a, b: a + b, (F.col(c).cast("double") for c in prefs))
    return wide.select("userId", "n_ratings", "active_days", "n_tag_events", F.round(total, 2).alias("pref_sum"), F.lit(len(prefs)).alias("n_prefs"))


register("user_features", _wide_users, sql("SELECT userId, n_ratings, active_days, coalesce(e, 0) AS n_tag_events, round(coalesce(s, 0), 2) AS pref_sum, (SELECT count(DISTINCT genre) FROM mg JOIN trn USING (movieId)) AS n_prefs FROM (SELECT userId, count(*) AS n_ratings, count(DISTINCT us // 86400000000) AS active_days FROM trn GROUP BY 1) LEFT JOIN (SELECT userId, count(*) AS e FROM tg GROUP BY 1) USING (userId) LEFT JOIN (SELECT userId, sum(CAST(CAST(m AS FLOAT) AS DOUBLE)) AS s FROM (SELECT userId, genre, avg(rating) AS m FROM trn JOIN mg USING (movieId) GROUP BY 1, 2) GROUP BY 1) USING (userId)"))
register("item_base_features", lambda t: FE.item_base(t.split()[0]), sql(f"SELECT movieId, {_STATS} FROM trn GROUP BY 1"))
register("item_rating_entropy", lambda t: FE.item_entropy(t.split()[0]), sql("SELECT movieId, round(e, 6) AS rating_entropy FROM en", _ENTROPY))
register("item_polarization", lambda t: FE.item_polarization(t.split()[0]), sql("SELECT movieId, round(e, 6) AS rating_entropy, round(greatest(s * (1 - e), 0), 6) AS polarization_score FROM (SELECT movieId, coalesce(stddev_samp(rating), 0) AS s FROM trn GROUP BY 1) JOIN en USING (movieId)", _ENTROPY))


def _flag_counts(t: Tables) -> DataFrame:
    wide = FE.item_genre_flags(t.movies)
    flags = [c for c in wide.columns if c != "movieId"]
    return wide.select("movieId", reduce(lambda a, b: a + b, (F.col(c).cast("bigint") for c in flags)).alias("n_genres"), F.lit(len(flags)).alias("n_flags"))


register("item_genre_flags", _flag_counts, sql("SELECT movieId, (SELECT count(*) FROM mg WHERE mg.movieId = mc.movieId) AS n_genres, (SELECT count(DISTINCT genre) FROM mg) AS n_flags FROM mc"))
register("item_top_tags", lambda t: FE.item_tags(t.tags_train()), sql("SELECT movieId, n_tag_events, top_tags FROM tt", _TOP))
register("item_features", lambda t: FE.item_features(t.split_once()[0], t.movies, t.tags_train()).select("movieId", "n_ratings", F.round("rating_mean", 4).alias("rating_mean"), F.round("polarization_score", 4).alias("polarization_score"), "n_tag_events", "top_tags"), sql("SELECT movieId, n_ratings, round(CAST(CAST(m AS FLOAT) AS DOUBLE), 4) AS rating_mean, round(CAST(CAST(greatest(s * (1 - e), 0) AS FLOAT) AS DOUBLE), 4) AS polarization_score, coalesce(n_tag_events, 0) AS n_tag_events, coalesce(top_tags, '') AS top_tags FROM (SELECT movieId, count(*) AS n_ratings, avg(rating) AS m, coalesce(stddev_samp(rating), 0) AS s FROM trn GROUP BY 1) JOIN en USING (movieId) LEFT JOIN tt USING (movieId)", _ENTROPY, _TOP))
register("feature_coverage", lambda t: FE.feature_coverage(FE.user_base(t.split()[1]), t.split()[0], "userId"), sql("SELECT count(*) AS keys, count(*) FILTER (hit) AS covered, round(count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM (SELECT DISTINCT userId, userId IN (SELECT userId FROM tst) AS hit FROM trn)"))


def _melted(wide: DataFrame, key: str, prefix: str) -> DataFrame:
    names = [c for c in wide.columns if c.startswith(prefix)]
    return wide.select(key, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(key, names, "feature", "value")


register("user_preferences_wide", lambda t: _melted(FE.user_features(t.split_once()[0], t.movies, t.tags_train()), "userId", "genre_pref__"), sql(f"SELECT u.userId, 'genre_pref__' || {_slug('g.genre')} AS feature, round(CAST(CAST(coalesce(m.m, 0) AS FLOAT) AS DOUBLE), 6) AS value FROM (SELECT DISTINCT userId FROM trn) u CROSS JOIN (SELECT DISTINCT genre FROM mg JOIN trn USING (movieId)) g LEFT JOIN (SELECT userId, genre, avg(rating) AS m FROM trn JOIN mg USING (movieId) GROUP BY 1, 2) m ON m.userId = u.userId AND m.genre = g.genre"))
register("item_flags_wide", lambda t: _melted(FE.item_genre_flags(t.movies), "movieId", "genre_flag__"), sql(f"SELECT mc.movieId, 'genre_flag__' || {_slug('g.genre')} AS feature, CAST(CASE WHEN mg.movieId IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS value FROM mc CROSS JOIN (SELECT DISTINCT genre FROM mg) g LEFT JOIN mg ON mg.movieId = mc.movieId AND mg.genre = g.genre"))

# --- Baskets ----------------------------------------------------------------------------------------------------------------

register("like_pairs", lambda t: B.likes(t.split()[0]), sql("SELECT userId, movieId FROM lk"))
register("basket_tokens", lambda t: B.basket_tokens(t.split()[0], t.movies, t.tags_once()), sql("SELECT userId, token FROM tok"))
register("transactions", lambda t: t.baskets_read_once(), sql("SELECT userId, string_agg(token, ',' ORDER BY token) AS items, count(*) AS n_items FROM tok GROUP BY 1"))
register("token_doc_freq", lambda t: B.doc_freq(t.baskets_read_once()), sql("SELECT token, df FROM df"))
_RED = "rf AS (SELECT * FROM df WHERE df >= 5), rk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY df DESC, token) AS r FROM rf), rv AS (SELECT * FROM rk WHERE family NOT IN ('movie', 'tag') OR (family = 'movie' AND r <= 800) OR (family = 'tag' AND r <= 40)), rt AS (SELECT tk.userId, tk.token, rv.family, rv.df FROM tk JOIN rv USING (token)), rb AS (SELECT userId FROM rt GROUP BY 1 HAVING count(*) >= 2), ra AS (SELECT rt.* FROM rt JOIN rb USING (userId)), ad AS (SELECT token, count(*) AS n FROM ra GROUP BY 1)"
_REDUCED = dict(top_movies=800, top_tags=40)
register("reduced_topk", lambda t: B.top_per_family(B.doc_freq(t.baskets()).where("df >= 5"), {"movie": 800, "tag": 40}), sql("SELECT token, df, family FROM rv", _RED))
register("reduced_transactions", lambda t: B.reduce_baskets(t.baskets(), **_REDUCED), sql("SELECT userId, string_agg(token, ',' ORDER BY token) AS items, count(*) AS n_items FROM ra GROUP BY 1", _RED))
register("reduced_capped", lambda t: B.reduce_baskets(t.baskets(), **_REDUCED, max_items=12), sql("SELECT userId, string_agg(token, ',' ORDER BY o, df DESC, token) AS items, count(*) AS n_items FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY o, df DESC, token) AS r FROM (SELECT *, CASE family WHEN 'genre' THEN 0 WHEN 'movie' THEN 1 ELSE 2 END AS o FROM ra)) WHERE r <= 12 GROUP BY 1 HAVING count(*) >= 2", _RED))
register("reduced_sampled", lambda t: B.reduce_baskets(t.baskets(), **_REDUCED, sample_frac=0.25), sql("SELECT userId, string_agg(token, ',' ORDER BY token) AS items, count(*) AS n_items FROM ra WHERE userId IN (SELECT userId FROM (SELECT userId, row_number() OVER (ORDER BY md5(CAST(userId AS VARCHAR) || ':42'), userId) AS r FROM rb) WHERE r <= (SELECT round_even(count(*) * CAST(0.25 AS DOUBLE), 0) FROM rb)) GROUP BY 1", _RED))
register("token_stats", lambda t: B.token_stats(b := t.baskets(), B.reduce_baskets(b, **_REDUCED)), sql("SELECT token, family, df AS df_before, coalesce(n, 0) AS df_after, n IS NOT NULL AS kept FROM df LEFT JOIN ad USING (token)", _RED))
_SIZES = "s1 AS (SELECT userId, count(*) AS n FROM tok GROUP BY 1), s2 AS (SELECT userId, count(*) AS n FROM ra GROUP BY 1)"
register("basket_stats", lambda t: B.basket_stats(b := t.baskets(), B.reduce_baskets(b, **_REDUCED)), sql("SELECT *, round(1 - after_baskets / CAST(before_baskets AS DOUBLE), 6) AS basket_reduction, round(1 - after_tokens / CAST(before_tokens AS DOUBLE), 6) AS token_reduction FROM (SELECT count(*) AS before_baskets, round(avg(n), 6) AS before_mean, median(n) AS before_median, CAST(sum(n) AS BIGINT) AS before_tokens FROM s1), (SELECT count(*) AS after_baskets, round(avg(n), 6) AS after_mean, median(n) AS after_median, CAST(sum(n) AS BIGINT) AS after_tokens FROM s2)", _RED, _SIZES))
register("removed_vocab", lambda t: B.removed_vocabulary(B.token_stats(b := t.baskets(), B.reduce_baskets(b, **_REDUCED))), sql("SELECT token FROM df WHERE token NOT IN (SELECT token FROM ad) ORDER BY token LIMIT 200", _RED))
register("baskets_displayed", lambda t: t.baskets_read_once().select("userId", X.join_display(F.filter("items", lambda x: X.family(x) == "tag")).alias("shown")), sql("SELECT userId, coalesce(string_agg(token, ' + ' ORDER BY token) FILTER (family = 'tag'), '[]') AS shown FROM tk GROUP BY 1"))
register("family_composition", lambda t: B.family_composition(t.baskets()), sql("SELECT family, count(DISTINCT token) AS vocabulary, count(*) AS tokens FROM tk GROUP BY 1"))
register("matrix_density", lambda t: B.matrix_density(t.baskets()), sql("SELECT count(DISTINCT userId) AS n_baskets, count(*) AS cells_set, count(DISTINCT token) AS vocabulary, round(count(*) / CAST(count(DISTINCT userId) * count(DISTINCT token) AS DOUBLE), 6) AS density FROM tok"))
for _mode, _kinds in B.MODES.items():
    _in = ", ".join(f"'{k}'" for k in _kinds)
    register(f"family_mode_{_mode}", lambda t, m=_mode: B.with_mode(t.baskets_read_once(B.MODES[m]), m), sql(f"SELECT userId, string_agg(token, ',' ORDER BY token) AS items, count(*) AS n_items FROM tk WHERE family IN ({_in}) GROUP BY 1"))
register("basket_caps", lambda t: B.controlled(t.baskets(), "controlled_movie_tag", {"movie": 600, "tag": 50}, {"movie": 5, "tag": 3}), sql("SELECT userId, string_agg(token, ',' ORDER BY family, p) AS items, count(*) AS n_items FROM (SELECT *, row_number() OVER (PARTITION BY userId, family ORDER BY df DESC, token) AS p FROM (SELECT tk.userId, tk.token, tk.family, q.df FROM tk JOIN (SELECT *, row_number() OVER (PARTITION BY family ORDER BY df DESC, token) AS r FROM df) q USING (token) WHERE (tk.family = 'movie' AND r <= 600) OR (tk.family = 'tag' AND r <= 50))) WHERE (family = 'movie' AND p <= 5) OR (family = 'tag' AND p <= 3) GROUP BY 1"))

# --- Mining -----------------------------------------------------------------------------------------------------------------

_GT = "SELECT userId, token FROM tk WHERE family IN ('genre', 'tag')"
_MT = "SELECT userId, token FROM tk WHERE family IN ('movie', 'tag')"
_MO = "SELECT userId, token FROM tk WHERE family = 'movie'"
_C = mined(_GT, 0.005, 0.25, 1.2)
_CROSS_MT = "(a LIKE 'movie:%' AND b LIKE 'tag:%') OR (a LIKE 'tag:%' AND b LIKE 'movie:%')"
_B = mined(_MT, 0.001, 0.4, 1.5, _CROSS_MT)
_A = mined(_MO, 0.0013, 0.0, 1.5)
_G = mined(_GT, 0.005, 0.02, 1.1)
_RULE = f"antecedent, consequent, c_ab AS count_ab, c_a AS count_a, c_b AS count_b, n, {METRICS}"
_GENRE_TAG = "((antecedent LIKE 'genre:%' AND consequent LIKE 'tag:%') OR (antecedent LIKE 'tag:%' AND consequent LIKE 'genre:%'))"
_TYPE = "CASE WHEN split_part(antecedent, ':', 1) <> split_part(consequent, ':', 1) THEN 'cross_type' ELSE split_part(antecedent, ':', 1) || '_only' END"


def _rules_c(t: Tables, confidence: float = 0.25, lift: float = 1.2) -> DataFrame:
    return I.pair_rules(t.genre_tag(), 0.005, confidence, lift)


def _sets_c(t: Tables) -> DataFrame:
    return I.frequent_sets(t.genre_tag(), 0.005)


_ONE = "SELECT token AS items, CAST(1 AS BIGINT) AS length, c AS count, round(c / CAST(n AS DOUBLE), 6) AS support FROM k1, kn"
_SORTED = "SELECT items, length, count, round(count / CAST(n AS DOUBLE), 6) AS support FROM sets, kn"
register("singleton_prune", lambda t: t.movie_tag().dictionary.select("token", "c"), sql("SELECT token, c FROM k0", *_B))
register("token_codes", lambda t: t.genre_tag().dictionary, sql("SELECT token, (row_number() OVER (ORDER BY c, token) - 1) * 4 + CASE WHEN token LIKE 'genre:%' THEN 0 ELSE 2 END AS code, c FROM k0", *_C))
register("itemsets_low", _sets_c, sql(_ONE + " UNION ALL SELECT a || ',' || b, 2, c_ab, round(c_ab / CAST(n AS DOUBLE), 6) FROM pf", *_C))
register("itemsets_top", lambda t: M.top_itemsets(_sets_c(t)), sql("SELECT * FROM (" + _ONE + " UNION ALL SELECT a || ',' || b, 2, c_ab, round(c_ab / CAST(n AS DOUBLE), 6) FROM pf) ORDER BY count DESC, items LIMIT 10", *_C))
register("itemsets_high", lambda t: M.high_support(_sets_c(t), 0.1), sql(_ONE + " WHERE c / CAST(n AS DOUBLE) >= 0.1 UNION ALL SELECT a || ',' || b, 2, c_ab, round(c_ab / CAST(n AS DOUBLE), 6) FROM pf WHERE c_ab / CAST(n AS DOUBLE) >= 0.1", *_C))
register("itemset_lengths", lambda t: M.length_histogram(_sets_c(t)), sql("SELECT CAST(1 AS BIGINT) AS length, count(*) AS n FROM k1 UNION ALL SELECT 2, count(*) FROM pf", *_C))
register("pairs_movie_tag", lambda t: I.frequent_sets(t.movie_tag(), 0.001, families=("movie", "tag")), sql(_ONE + " UNION ALL SELECT a || ',' || b AS items, CAST(2 AS BIGINT) AS length, c_ab AS count, round(c_ab / CAST(n AS DOUBLE), 6) AS support FROM pf", *_B))
register("pairs_self_join", lambda t: M.pair_counts_by_join(t.tokens(families=("genre", "tag"))), sql("SELECT x.token AS a, y.token AS b, count(*) AS c_ab FROM (" + _GT + ") x JOIN (" + _GT + ") y ON x.userId = y.userId AND x.token < y.token GROUP BY 1, 2"))
register("rules_preset_a", lambda t: I.pair_rules(t.coded(0.0013, "movie"), 0.0013, 0.0, 1.5), sql(f"SELECT {_RULE} FROM ru", *_A))
register("rules_preset_b", lambda t: I.pair_rules(t.movie_tag(), 0.001, 0.4, 1.5, ("movie", "tag")), sql(f"SELECT {_RULE} FROM ru", *_B))
register("rules_preset_c", lambda t: M.across(_rules_c(t)), sql(f"SELECT {_RULE} FROM ru WHERE {_GENRE_TAG}", *_C))
register("rules_gate1", lambda t: M.gate_evidence(_rules_c(t, 0.02, 1.1), 50, 100, 0.20), sql(f"SELECT {_RULE} FROM ru WHERE c_ab >= 50 AND c_a >= 100 AND c_b / CAST(n AS DOUBLE) <= 0.2", *_G))

def many_sided(tokens: str, support: float, confidence: float, lift: float) -> tuple[str, ...]:
    """CTEs of sets of up to three tokens, which SQL finds by joining the kept tokens three times, and ``sm``, their rules with any number of tokens a side."""
    s = f"CAST({support} AS DOUBLE)"
    ways = [(x, f"{y} || ',' || {z}") for x, y, z in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b"))]
    parted = (f"SELECT {x} AS antecedent, {y} AS consequent, c_abc AS c_ab FROM p3" for pair in ways for x, y in (pair, pair[::-1]))
    return (
        *mined(tokens, support, 0.0),
        f"p3 AS (SELECT x.token AS a, y.token AS b, z.token AS c, count(*) AS c_abc FROM kt x JOIN kt y ON x.userId = y.userId AND x.token < y.token JOIN kt z ON x.userId = z.userId AND y.token < z.token GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT ceil({s} * n) FROM kn))",
        "sets AS (SELECT token AS items, CAST(1 AS BIGINT) AS length, c AS count FROM k1 UNION ALL SELECT a || ',' || b, 2, c_ab FROM pf UNION ALL SELECT a || ',' || b || ',' || c, 3, c_abc FROM p3)",
        "sr AS (" + " UNION ALL ".join(parted) + " UNION ALL SELECT antecedent, consequent, c_ab FROM pd)",
        f"sm AS (SELECT sr.antecedent, sr.consequent, sr.c_ab, x.count AS c_a, y.count AS c_b, n FROM sr JOIN sets x ON x.items = sr.antecedent JOIN sets y ON y.items = sr.consequent, kn WHERE sr.c_ab / CAST(x.count AS DOUBLE) >= CAST({confidence} AS DOUBLE) AND sr.c_ab * CAST(n AS DOUBLE) / (x.count * y.count) > CAST({lift} AS DOUBLE))",
    )


_S = many_sided(_GT, 0.05, 0.3, 1.05)


def _set_rules(t: Tables) -> DataFrame:
    own = t.genre_tag(0.05)
    return I.set_rules(I.frequent_sets(own, 0.05, 3), own.n, 0.3, 1.05)


register("itemsets_three", lambda t: I.frequent_sets(t.genre_tag(0.02), 0.02, 3), sql(_SORTED, *many_sided(_GT, 0.02, 0.0, 0.0)))
register("rules_many_sided", _set_rules, sql(f"SELECT {_RULE} FROM sm", *_S))
register("rules_one_sided_of_three", lambda t: M.single_sided(_set_rules(t)), sql(f"SELECT {_RULE} FROM sm WHERE NOT contains(antecedent, ',') AND NOT contains(consequent, ',')", *_S))


def _gate2(t: Tables) -> DataFrame:
    own = t.genre_tag()
    test = I.coded_by(t.test_tokens(families=("genre", "tag")), own.dictionary, t.keep)
    return I.stable(I.pair_rules(own, 0.005, 0.02, 1.1), test, 0.02, 0.5, 5).select(
        "antecedent", "consequent", "count_ab", "count_ab_test", "count_b_test", "support_b_test", "confidence", "confidence_test", "lift_test", "conf_ratio", "n_test"
    )


_H = (
    "h0 AS (SELECT userId, token FROM tk2 WHERE token IN (SELECT token FROM k0))", "h1 AS (SELECT token, count(*) AS c FROM h0 GROUP BY 1)",
    "h2 AS (SELECT x.token AS a, y.token AS b, count(*) AS c FROM h0 x JOIN h0 y ON x.userId = y.userId AND x.token < y.token GROUP BY 1, 2)",
    "hn AS (SELECT count(DISTINCT userId) AS m FROM h0)",
    "h3 AS (SELECT ru.antecedent, ru.consequent, c_ab, c_ab / CAST(c_a AS DOUBLE) AS conf, coalesce(h2.c, 0) AS t_ab, coalesce(h4.c, 0) AS t_b, coalesce(h2.c, 0) / CAST(h1.c AS DOUBLE) AS conf_t FROM ru JOIN h1 ON h1.token = antecedent LEFT JOIN h1 h4 ON h4.token = consequent LEFT JOIN h2 ON h2.a = least(antecedent, consequent) AND h2.b = greatest(antecedent, consequent))",
)
register("rules_gate2", _gate2, sql("SELECT antecedent, consequent, c_ab AS count_ab, t_ab AS count_ab_test, t_b AS count_b_test, round(t_b / CAST(m AS DOUBLE), 6) AS support_b_test, round(conf, 6) AS confidence, round(conf_t, 6) AS confidence_test, round(conf_t / (t_b / CAST(m AS DOUBLE)), 6) AS lift_test, round(conf_t / conf, 6) AS conf_ratio, m AS n_test FROM h3, hn WHERE conf_t >= CAST(0.02 AS DOUBLE) AND conf_t / conf >= 0.5 AND t_ab >= 5", *_G, *_H))
register("rule_types", lambda t: P.type_histogram(M.as_exported(_rules_c(t))), sql(f"SELECT {_TYPE} AS rule_type, count(*) AS n FROM ru GROUP BY 1", *_C))
_NICE = "CASE WHEN {x} LIKE 'genre:%' THEN '[G] ' ELSE '[T] ' END || (SELECT string_agg(CASE WHEN i = 1 OR NOT regexp_matches(v[i - 1], '[a-z]') THEN upper(v[i]) ELSE v[i] END, '' ORDER BY i) FROM (SELECT split_part({x}, ':', 2) AS v), range(1, length(split_part({x}, ':', 2)) + 1) r(i))"
_RD = f"rd AS (SELECT antecedent, consequent, {_NICE.format(x='antecedent')} AS antecedent_decoded, {_NICE.format(x='consequent')} AS consequent_decoded, {METRICS}, {_TYPE} AS rule_type FROM ru)"
register("rules_decoded", lambda t: P.readable(_rules_c(t), t.movies), sql("SELECT antecedent, consequent, antecedent_decoded, consequent_decoded, antecedent_decoded || ' -> ' || consequent_decoded AS label, support, confidence, lift, rule_type FROM rd", *_C, _RD))
register("cross_genre_rules", lambda t: P.cross_rules(P.readable(_rules_c(t), t.movies)).select("antecedent", "consequent", "lift", "rule_type"), sql(f"SELECT antecedent, consequent, round(c_ab * CAST(n AS DOUBLE) / (c_a * c_b), 6) AS lift, {_TYPE} AS rule_type FROM ru WHERE {_TYPE} IN ('genre_only', 'cross_type') ORDER BY round(c_ab * CAST(n AS DOUBLE) / (c_a * c_b), 9) DESC, antecedent, consequent LIMIT 10", *_C))
register("metric_ranges", lambda t: M.metric_ranges(_rules_c(t)), sql("SELECT min(support) AS support_min, max(support) AS support_max, min(confidence) AS confidence_min, max(confidence) AS confidence_max, min(lift) AS lift_min, max(lift) AS lift_max, min(leverage) AS leverage_min, max(leverage) AS leverage_max FROM (SELECT " + METRICS + " FROM ru)", *_C))
register("rule_scatter", lambda t: M.scatter(_rules_c(t)), sql(f"SELECT support, lift, confidence FROM (SELECT {METRICS} FROM ru)", *_C))
register("metric_histogram", lambda t: M.metric_histogram(_rules_c(t), "support"), sql("SELECT CAST(least(floor((s - lo) / (hi - lo) * 40) + 1, 40) AS BIGINT) AS bin, count(*) AS n FROM (SELECT c_ab / CAST(n AS DOUBLE) AS s FROM ru), (SELECT min(c_ab / CAST(n AS DOUBLE)) AS lo, max(c_ab / CAST(n AS DOUBLE)) AS hi FROM ru) GROUP BY 1", *_C))
register("mine_preset_c", lambda t: mine(t.baskets(), preset("C"), keep=t.keep)["rules"].select("antecedent", "consequent", "lift"), sql(f"SELECT antecedent, consequent, round(c_ab * CAST(n AS DOUBLE) / (c_a * c_b), 6) AS lift FROM ru WHERE {_GENRE_TAG}", *_C))



def capped(kinds: str, top: int, cap: int) -> str:
    return f"SELECT userId, token FROM (SELECT *, row_number() OVER (PARTITION BY userId, family ORDER BY df DESC, token) AS p FROM (SELECT tk.userId, tk.token, tk.family, q.df FROM tk JOIN (SELECT *, row_number() OVER (PARTITION BY family ORDER BY df DESC, token) AS r FROM df) q USING (token) WHERE tk.family IN ({kinds}) AND r <= {top})) WHERE p <= {cap}"


_PA = mined(capped("'movie'", 600, 39), 0.001, 0.3, 1.5)
_PB = mined(capped("'movie', 'tag'", 600, 60), 0.001, 0.4, 1.5, _CROSS_MT)
for _p, _ctes in (("A", _PA), ("B", _PB)):
    register(f"mine_preset_{_p.lower()}", lambda t, p=_p: mine(t.baskets(), preset(p), keep=t.keep)["rules"].drop("leverage", "conviction"), sql("SELECT antecedent, consequent, c_ab AS count_ab, c_a AS count_a, c_b AS count_b, n, round(c_ab / CAST(n AS DOUBLE), 6) AS support, round(c_ab / CAST(c_a AS DOUBLE), 6) AS confidence, round(c_ab * CAST(n AS DOUBLE) / (c_a * c_b), 6) AS lift FROM ru", *_ctes))


def _single(t: Tables) -> DataFrame:
    """Rules of one token a side, told from the same rules with a longer antecedent."""
    one = M.as_exported(_rules_c(t))
    longer = one.withColumn("antecedent", F.concat("antecedent", "consequent"))
    return M.single_sided(one.unionByName(longer)).select("antecedent", "consequent", "support")


register("rules_single_sided", _single, sql("SELECT antecedent, consequent, round(c_ab / CAST(n AS DOUBLE), 6) AS support FROM ru", *_C))

# --- Recommendations --------------------------------------------------------------------------------------------------------


def _movie_rules(t: Tables) -> DataFrame:
    found = I.pair_rules(t.movie_tag(0.0013), 0.0013, 0.0, None)
    return R.adapt_rules(found.select(F.array("antecedent").alias("antecedents"), F.array("consequent").alias("consequents"), "support", "confidence", "lift"))


_M = mined(_MT, 0.0013, 0.0)
_SEEDED = f"fr AS (SELECT *, c_ab * CAST(n AS DOUBLE) / (c_a * c_b) AS lift, c_ab / CAST(c_a AS DOUBLE) AS confidence, c_ab / CAST(n AS DOUBLE) AS support FROM ru), fs AS (SELECT * FROM fr WHERE antecedent = '{SEED}' AND consequent LIKE 'movie:%' AND consequent <> '{SEED}' AND lift >= CAST(1.1 AS DOUBLE) AND confidence >= CAST(0.01 AS DOUBLE)), rc AS (SELECT consequent AS rec_token, max(lift) AS lift, max(confidence) AS confidence, max(support) AS support, count(*) AS evidence_count FROM fs GROUP BY 1 ORDER BY round(max(lift), 9) DESC, max(confidence) DESC, max(support) DESC, consequent LIMIT 10)"
register("recommend_seed", lambda t: R.recommend(_movie_rules(t), SEED, min_confidence=0.01), sql("SELECT rec_token, round(lift, 6) AS lift, round(confidence, 6) AS confidence, round(support, 6) AS support, evidence_count, row_number() OVER (ORDER BY round(lift, 9) DESC, confidence DESC, support DESC, rec_token) AS rank FROM rc", *_M, _SEEDED))
register("recommend_evidence", lambda t: R.evidence(_movie_rules(t), SEED, min_confidence=0.01).select("rec_token", "antecedent", "consequent", "lift", "evidence_rank"), sql("SELECT consequent AS rec_token, antecedent, consequent, round(lift, 6) AS lift, CAST(1 AS BIGINT) AS evidence_rank FROM fs WHERE consequent IN (SELECT rec_token FROM rc)", *_M, _SEEDED))
register("item_tag_dna", lambda t: R.tag_dna(_movie_rules(t), SEED), sql(f"SELECT tag, round(max(support), 6) AS support, round(max(confidence), 6) AS confidence, round(max(lift), 6) AS lift FROM (SELECT CASE WHEN antecedent = '{SEED}' THEN consequent ELSE antecedent END AS tag, * FROM fr WHERE '{SEED}' IN (antecedent, consequent)) WHERE tag LIKE 'tag:%' GROUP BY 1 ORDER BY round(max(fr_lift), 9) DESC LIMIT 5".replace("max(fr_lift), 9) DESC", "max(lift), 9) DESC, max(confidence) DESC, max(support) DESC, tag"), *_M, _SEEDED))


# Rules of up to three tokens lead from a genre to its movies: many recommendations, with several rules each.
GENRE_SEED = "genre:brand_12"
_GM = "SELECT userId, token FROM tk WHERE family IN ('genre', 'movie')"
_ORDER = "round(lift, 9) DESC, confidence DESC, support DESC"
_WHY = (
    *many_sided(_GM, 0.008, 0.0, 0.0),
    f"fs AS (SELECT antecedent, consequent, regexp_extract(consequent, 'movie:[0-9]+') AS rec_token, c_ab / CAST(n AS DOUBLE) AS support, c_ab / CAST(c_a AS DOUBLE) AS confidence, c_ab * CAST(n AS DOUBLE) / (c_a * c_b) AS lift FROM sm WHERE list_contains(string_split(antecedent, ','), '{GENRE_SEED}') AND contains(consequent, 'movie:'))",
    "fw AS (SELECT * FROM fs WHERE lift >= CAST(1.1 AS DOUBLE) AND confidence >= CAST(0.02 AS DOUBLE))",
    f"rc AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}, rec_token) AS rank FROM (SELECT rec_token, max(lift) AS lift, max(confidence) AS confidence, max(support) AS support, count(*) AS evidence_count FROM fw GROUP BY 1))",
)


def _genre_rules(t: Tables) -> DataFrame:
    own = t.coded(0.008, "genre", "movie")
    return I.set_rules(I.frequent_sets(own, 0.008, 3), own.n, 0.0, 0.0).withColumn("rec_token", X.first_movie(F.col("consequent")))


register("recommend_many", lambda t: R.recommend(_genre_rules(t), GENRE_SEED, 12, min_confidence=0.02), sql("SELECT rec_token, round(lift, 6) AS lift, round(confidence, 6) AS confidence, round(support, 6) AS support, evidence_count, rank FROM rc WHERE rank <= 12", *_WHY))
register("evidence_many", lambda t: R.evidence(_genre_rules(t), GENRE_SEED, 12, 3, min_confidence=0.02).select("rec_token", "rank", "antecedent", "consequent", "lift", "evidence_rank"), sql("SELECT rec_token, rank, antecedent, consequent, round(lift, 6) AS lift, r AS evidence_rank FROM (SELECT fw.*, rc.rank, row_number() OVER (PARTITION BY fw.rec_token ORDER BY round(fw.lift, 9) DESC, fw.confidence DESC, fw.support DESC, antecedent, consequent) AS r FROM fw JOIN rc ON rc.rec_token = fw.rec_token WHERE rank <= 12) WHERE r <= 3", *_WHY))


def _c_lists(t: Tables) -> DataFrame:
    return M.as_exported(_rules_c(t))


register("genre_semantics", lambda t: R.genre_semantics(_c_lists(t), ["genre:economy"]).select("antecedent", "consequent", "lift", "fallback"), sql("SELECT antecedent, consequent, round(lift, 6) AS lift, NOT own AS fallback FROM (SELECT *, row_number() OVER (ORDER BY own DESC, round(lift, 9) DESC, conf DESC, sup DESC, antecedent, consequent) AS r, max(own) OVER () AS any_own FROM (SELECT *, c_ab * CAST(n AS DOUBLE) / (c_a * c_b) AS lift, c_ab / CAST(c_a AS DOUBLE) AS conf, c_ab / CAST(n AS DOUBLE) AS sup, 'genre:economy' IN (antecedent, consequent) AS own FROM ru)) WHERE r <= 10 AND own = any_own", *_C))
register("seed_coverage", lambda t: R.seed_coverage(t.movies, _movie_rules(t)), sql("SELECT (SELECT count(*) FROM mc) AS movies, (SELECT count(DISTINCT antecedent) FROM ru WHERE antecedent LIKE 'movie:%') AS covered, round(100.0 * CAST((SELECT count(DISTINCT antecedent) FROM ru WHERE antecedent LIKE 'movie:%') AS DOUBLE) / (SELECT count(*) FROM mc), 6) AS coverage_percent", *_M))
register("seed_options", lambda t: R.seed_options(t.movies, _movie_rules(t)), sql("SELECT 'movie:' || CAST(movieId AS VARCHAR) AS token, title FROM mc WHERE 'movie:' || CAST(movieId AS VARCHAR) IN (SELECT antecedent FROM ru)", *_M))


def _first_seed(t: Tables) -> DataFrame:
    """No row where no rule has a seed."""
    token = R.default_seed(R.seed_options(t.movies, _movie_rules(t)), ["movie:-1"])
    return t.spark.createDataFrame([(token,)] if token else [], "token string")


register("default_seed", _first_seed, sql("SELECT 'movie:' || CAST(movieId AS VARCHAR) AS token FROM mc WHERE 'movie:' || CAST(movieId AS VARCHAR) IN (SELECT antecedent FROM ru) ORDER BY title, 'movie:' || CAST(movieId AS VARCHAR) LIMIT 1", *_M))
register("rule_evidence", lambda t: R.rule_evidence(_movie_rules(t), t.movies, SEED, min_confidence=0.01), sql(f"SELECT antecedent AS seed_movie_token, (SELECT title FROM mc WHERE 'movie:' || CAST(movieId AS VARCHAR) = '{SEED}') AS seed_title, consequent AS rec_movie_token, mc.title AS rec_title, antecedent, consequent, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM fs JOIN mc ON 'movie:' || CAST(mc.movieId AS VARCHAR) = consequent WHERE consequent IN (SELECT rec_token FROM rc)", *_M, _SEEDED))
register("seed_genre_tokens", lambda t: FE.exploded_genres(t.movies).select("genre").distinct().select("genre", X.seed_genre_token(F.col("genre")).alias("token")), sql("SELECT DISTINCT genre, 'genre:' || regexp_replace(lower(trim(genre)), '[ -]', '_', 'g') AS token FROM mg"))
register(
    "tokens_displayed",
    lambda t: P.with_titles(t.vocabulary(), t.movies, "token").select("token", X.decode_display(F.col("token"), F.col("token_title")).alias("shown")),
    sql("SELECT token, CASE family WHEN 'movie' THEN coalesce(title, token) WHEN 'tag' THEN split_part(token, ':', 2) WHEN 'genre' THEN (SELECT string_agg(CASE WHEN i = 1 OR NOT regexp_matches(v[i - 1], '[a-z]') THEN upper(v[i]) ELSE v[i] END, '' ORDER BY i) FROM range(1, length(v) + 1) r(i)) ELSE token END AS shown FROM (SELECT token, family, replace(split_part(token, ':', 2), '_', ' ') AS v FROM df) LEFT JOIN (SELECT 'movie:' || CAST(movieId AS VARCHAR) AS token, title FROM mc) USING (token)"),
)
register("rules_by_token", lambda t: seeds.seed_index(_c_lists(t)).groupBy("token").agg(F.count("*").alias("n"), F.round(F.max("lift"), 6).alias("lift"), F.count_distinct("bucket").alias("buckets")), sql("SELECT token, count(*) AS n, round(max(lift), 6) AS lift, CAST(1 AS BIGINT) AS buckets FROM (SELECT antecedent AS token, c_ab * CAST(n AS DOUBLE) / (c_a * c_b) AS lift FROM ru UNION ALL SELECT consequent, c_ab * CAST(n AS DOUBLE) / (c_a * c_b) FROM ru) GROUP BY 1", *_C))


def _preferred(t: Tables) -> DataFrame:
    """The second preferred movie is covered, the first one is not."""
    options = R.seed_options(t.movies, _movie_rules(t))
    last = options.agg(F.max("token")).first()[0]
    return t.spark.createDataFrame([(R.default_seed(options, ["movie:-1", last]),)], "token string")


register("preferred_seed", _preferred, sql("SELECT max('movie:' || CAST(movieId AS VARCHAR)) AS token FROM mc WHERE 'movie:' || CAST(movieId AS VARCHAR) IN (SELECT antecedent FROM ru)", *_M))


def _cells(t: Tables) -> DataFrame:
    """List cells of each kind as text, read back."""
    name, brand, key = (F.col(c) for c in ("p_name", "p_brand", "p_partkey"))
    q = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    kinds = [
        F.concat(F.lit("["), q(name), F.lit(", "), q(brand), F.lit("]")), F.concat(F.lit('("'), name, F.lit('", '), q(F.concat(F.lit("it\\'s "), brand)), F.lit(",)")),
        F.concat(F.lit("{"), q(name), F.lit(","), q(brand), F.lit(","), q(name), F.lit("}")), name, F.concat(F.lit("("), q(name), F.lit(")")),
    ]
    cell = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        cell = F.when(key % 6 == i, kind).otherwise(cell)
    tokens = X.token_list(cell)
    return t.raw.read("part").select(key.alias("movieId"), F.size(tokens).alias("n"), F.array_join(tokens, "|").alias("tokens"))


register("list_cells", _cells, "SELECT p_partkey AS movieId, CAST(CASE p_partkey % 6 WHEN 5 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 2 END AS BIGINT) AS n, CASE p_partkey % 6 WHEN 0 THEN p_name || '|' || p_brand WHEN 1 THEN p_name || '|it' || chr(39) || 's ' || p_brand WHEN 2 THEN p_name || '|' || p_brand WHEN 3 THEN p_name WHEN 4 THEN '(' || chr(39) || p_name || chr(39) || ')' ELSE '' END AS tokens FROM part")
register("rule_vocabulary", lambda t: R.vocabulary(_c_lists(t)), sql("SELECT antecedent AS token FROM ru UNION SELECT consequent FROM ru", *_C))
register("audit_gates", lambda t: Q.join_coverage(t.ratings, t.movies, "movieId").select(F.lit("integrity").alias("gate"), (F.col("coverage") >= 0.95).alias("passed")).unionByName(S.split_sizes(*t.split()).select(F.lit("split").alias("gate"), ((F.col("train_rows") > 0) & (F.col("test_rows") > 0)).alias("passed"))), sql("SELECT 'integrity' AS gate, (SELECT count(*) FROM ev WHERE movieId IN (SELECT movieId FROM mc)) >= CAST(0.95 AS DOUBLE) * (SELECT count(*) FROM ev) AS passed UNION ALL SELECT 'split', (SELECT count(*) FROM trn) > 0 AND (SELECT count(*) FROM tst) > 0"))


def _passes(gate: Callable, *args, **options) -> bool:
    try:
        gate(*args, **options)
    except Q.GateError:
        return False
    return True


def _gates(t: Tables) -> DataFrame:
    """Each hard gate on the tables, and on tables that it must refuse."""
    late = t.movies.where("year >= 2000")
    ratings, tags = t.keep(t.ratings), t.keep(t.tags)  # several gates read them
    by_movie = t.keep(Q.key_counts(ratings, "movieId"))
    found = {
        "movies": _passes(Q.gate_movies, t.movies), "movies_repeated": _passes(Q.gate_movies, t.movies.unionByName(t.movies)),
        "movies_without_title": _passes(Q.gate_movies, t.movies.drop("title")), "ratings": _passes(Q.gate_ratings, ratings),
        "tags": _passes(Q.gate_tags, tags), "links": _passes(Q.gate_links, t.links),
        "ratings_to_movies": _passes(Q.gate_coverage, by_movie, t.movies, "movieId", counted=True),
        "ratings_to_late_movies": _passes(Q.gate_coverage, by_movie, late, "movieId", counted=True),
        "tags_to_movies": _passes(Q.gate_coverage, tags, t.movies, "movieId"),
    }
    return t.spark.createDataFrame(list(found.items()), "gate string, passed boolean")


def _share(facts: str, dims: str) -> str:
    return f"(SELECT count(*) FILTER (movieId IN (SELECT movieId FROM {dims})) >= CAST(0.95 AS DOUBLE) * count(*) FROM {facts})"


register("hard_gates", _gates, sql("SELECT 'movies' AS gate, (SELECT count(*) = count(DISTINCT movieId) FROM mc) AS passed UNION ALL SELECT 'movies_repeated', (SELECT 2 * count(*) = count(DISTINCT movieId) FROM mc) UNION ALL SELECT 'movies_without_title', false UNION ALL SELECT 'ratings', (SELECT count(*) = count(userId) AND count(*) = count(movieId) FROM ev) UNION ALL SELECT 'tags', (SELECT count(*) = count(userId) AND count(*) = count(movieId) AND count(*) = count(nullif(tag_norm, '')) FROM tc) UNION ALL SELECT 'links', (SELECT count(*) = count(DISTINCT movieId) FROM lc) UNION ALL SELECT 'ratings_to_movies', " + _share("ev", "mc") + " UNION ALL SELECT 'ratings_to_late_movies', " + _share("ev", "(SELECT * FROM mc WHERE year >= 2000)") + " UNION ALL SELECT 'tags_to_movies', " + _share("tc", "mc")))


def _audit(t: Tables) -> DataFrame:
    """The four gates of a whole run."""
    train, test = t.split_once()
    for key in ("userId", "movieId"):
        t.keep(train.select(key).distinct())  # for coverage and cold start
    gates = {k: Q.gate_coverage(f, t.movies, "movieId") for k, f in (("ratings_to_movies", t.ratings), ("tags_to_movies", t.tags))}
    users, items = FE.user_base(train), FE.item_base(train)
    coverage = {k: FE.feature_coverage(f, train, k).first().asDict() for k, f in (("userId", users), ("movieId", items))}
    baskets = t.baskets()
    rates = B.basket_stats(baskets, B.reduce_baskets(baskets, **_REDUCED)).first().asDict()
    report = audit(gates, S.validate_split(train, test), coverage, rates, PipelineConfig())
    return t.spark.createDataFrame(list(report["gates"].items()), "gate string, passed boolean")


register("audit_run", _audit, sql("SELECT 'integrity' AS gate, " + _share("ev", "mc") + " AND " + _share("tc", "mc") + " AS passed UNION ALL SELECT 'split', (SELECT count(*) FROM trn) > 0 AND (SELECT count(*) FROM tst) > 0 AND (SELECT max(us) FROM trn) < (SELECT min(us) FROM tst) UNION ALL SELECT 'features', (SELECT count(DISTINCT userId) FROM trn) > 0 UNION ALL SELECT 'readiness', (SELECT count(*) FROM ra) > 0", _RED))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
