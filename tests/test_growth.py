"""What large tables must not cost: repeated joins, shuffles and files of shuffles."""

import contextlib
import io

from tastemill.operators import baskets as B
from tastemill.operators import features as FE
from tastemill.operators import quality as Q
from tastemill.operators import split as S
from tastemill.operators.clean import clean_movies, clean_ratings, clean_tags
from tastemill.plans import sizes
from tastemill.sources.adapter import Star


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def tables(spark):
    rows = [(u, m, r, t) for t, (u, m, r) in enumerate([(1, 1, 4.0), (1, 1, 5.0), (1, 2, 4.5), (2, 2, 3.0), (2, 3, 5.0), (3, 9, 4.0), (4, None, 4.0), (None, 1, 4.0)])]
    ratings = clean_ratings(spark.createDataFrame(rows, "userId int, movieId int, rating float, timestamp bigint"))
    movies = [(1, "a (1990)", "x|y|x"), (2, "b", "(no genres listed)"), (3, "c", "y"), (3, "c", "Z z")]
    movies = clean_movies(spark.createDataFrame(movies, "movieId int, title string, genres string"))
    tags = clean_tags(spark.createDataFrame([(1, 1, " A", 1), (1, 1, "a", 2), (2, 3, "b", 3), (2, 3, "a", 4), (2, 2, "a", 5)], "userId int, movieId int, tag string, timestamp bigint"))
    return ratings, movies, tags


def test_lists_of_tokens_make_the_same_baskets(spark):
    args = tables(spark)
    for families in (*B.MODES.values(), ()):
        for deal in (False, True):
            own = B.transactions(*args, min_tag_freq=2, families=families, deal=deal)
            want = B.to_baskets(B.token_rows(*args, min_tag_freq=2, families=families))
            assert own.dtypes == want.dtypes
            assert sorted(map(repr, own.collect())) == sorted(map(repr, want.collect())), (families, deal)


def test_large_shuffles_write_one_file_a_task():
    assert sizes.enough(200, 37, 200) == 201 and sizes.enough(8, 150, 200) == 201
    assert sizes.enough(200, 225, 200) == 225 and sizes.enough(8, 37, 200) == 37


def test_limited_vocabularies_are_broadcast(spark):
    b = spark.createDataFrame([(1, ["genre:x", "movie:1", "movie:2", "tag:t"], 4), (2, ["genre:x", "movie:1"], 2)], "userId int, items array<string>, n_items int")
    tops = {"movie": 1, "tag": 1}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = B.controlled(b, "movie_tag", tops)
        assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
        assert sorted((r.userId, r.items) for r in found.collect()) == [(1, ["movie:1", "tag:t"]), (2, ["movie:1"])]
        capped = B.reduce_baskets(b, min_df=1, top_movies=1, top_tags=1, max_items=3)
        assert sorted((r.userId, r.items) for r in capped.collect()) == [(1, ["genre:x", "movie:1", "tag:t"]), (2, ["genre:x", "movie:1"])]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_polarization_reads_ratings_once(spark):
    ratings = tables(spark)[0]
    found = FE.item_polarization(ratings)
    assert "Join" not in plan(found)
    base = FE.item_base(ratings).join(FE.item_entropy(ratings), "movieId").collect()
    want = {r.movieId: (round(r.rating_entropy, 9), round(max(r.rating_std * (1 - r.rating_entropy), 0), 9)) for r in base}
    assert {r.movieId: (round(r.rating_entropy, 9), round(r.polarization_score, 9)) for r in found.collect()} == want


def test_overlap_shuffles_only_shared_times(spark):
    ratings = tables(spark)[0].where("userId IS NOT NULL")
    train, test = S.global_split(ratings, 0.5)
    assert S.overlap(train, test).count() == 0
    assert "_low" in plan(S.overlap(train, test))
    assert S.overlap(ratings, ratings.where("timestamp >= 3")).count() == ratings.where("timestamp >= 3").count()


def test_first_and_last_time_without_a_join_of_all_lines(spark, tmp_path):
    spark.range(5, 8).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(20).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "1D AS l_quantity", "timestamp_seconds(id) AS l_shipdate", "id AS l_suppkey", "1 AS l_linenumber"
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for n in (3, 7, 100):  # none, some and all ends are known
        times = [r.timestamp for r in Star(spark, str(tmp_path)).times(n).collect()]
        assert (min(times), max(times)) == (5, 7), n


def test_counted_coverage(spark):
    facts, dims = spark.createDataFrame([(1,), (1,), (2,), (None,)], "movieId int"), spark.createDataFrame([(1,)], "movieId int")
    assert Q.join_coverage(Q.key_counts(facts, "movieId"), dims, "movieId", counted=True).first() == Q.join_coverage(facts, dims, "movieId").first()
