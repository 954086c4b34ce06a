import pytest
from pyspark.sql import functions as F

from tastemill.operators import baskets as B
from tastemill.operators import features as FE
from tastemill.operators import mining as M
from tastemill.operators import quality as Q
from tastemill.operators import recommend as R
from tastemill.operators import split as S
from tastemill.operators.clean import clean_ratings, clean_tags
from tastemill.plans import sizes
from tastemill.plans.config import PipelineConfig, clamp, preset
from tastemill.plans.pipeline import mine, need_families, validation_summary, value_at


def rated(spark, rows):
    return clean_ratings(spark.createDataFrame(rows, "userId int, movieId int, rating double, timestamp bigint"))


def baskets(spark, *items):
    return B.to_baskets(spark.createDataFrame([(i, t) for i, ts in enumerate(items) for t in ts], "userId int, token string"))


def test_user_split(spark):
    rows = [(1, 1, 4.0, 10), (2, 1, 4.0, 10), (2, 2, 3.0, 20), (3, 1, 1.0, 5), (3, 2, 2.0, 6), (3, 3, 3.0, 7)]
    train, test, cut = S.user_split(rated(spark, rows))
    assert sorted((r.userId, r.movieId) for r in train.collect()) == [(2, 1), (3, 1), (3, 2)]
    assert sorted((r.userId, r.movieId) for r in test.collect()) == [(2, 2), (3, 3)]
    tags = clean_tags(spark.createDataFrame([(1, 1, "a", 99), (2, 1, "b", 19), (2, 1, "c", 20)], "userId int, movieId int, tag string, timestamp bigint"))
    assert sorted(r.tag_norm for r in S.tags_before(tags, cut).collect()) == ["a", "b"]
    assert S.overlap(train, test).count() == 0 and S.order_violations(train, test).count() == 0


def test_global_split_and_gates(spark):
    r = rated(spark, [(1, 1, 4.0, 0), (1, 2, 4.0, 50), (2, 1, 3.0, 90), (2, 2, 3.0, 100)])
    train, test = S.global_split(r)
    assert [x.timestamp for x in train.orderBy("timestamp").collect()] == [0, 50]
    assert sorted(x.timestamp for x in test.collect()) == [90, 100]
    assert S.validate_split(train, test)["train_rows"] == 2
    with pytest.raises(Q.GateError):
        S.validate_split(r, r.limit(0))
    with pytest.raises(Q.GateError):
        S.validate_split(r, r)


def test_quality_gates(spark):
    facts = spark.createDataFrame([(i % 10,) for i in range(10)] + [(None,)], "movieId int")
    dims = spark.createDataFrame([(i,) for i in range(9)], "movieId int")
    row = Q.join_coverage(facts, dims, "movieId").first()
    assert (row.total_rows, row.matched_rows, row.unmatched_keys, row.null_key_rows) == (11, 9, 1, 1)
    with pytest.raises(Q.GateError):
        Q.gate_coverage(facts, dims, "movieId")
    assert Q.join_coverage(facts.limit(0), dims, "movieId").first().coverage == 0.0
    r = Q.rating_domain(rated(spark, [(1, 1, 4.0, 1), (1, 2, 3.3, 1), (1, 3, None, 1)])).first()
    assert (r.off_scale_rows, r.rating_nulls) == (1, 1)
    with pytest.raises(Q.GateError):
        Q.require_columns(dims, ("movieId", "title"))


def test_features(spark):
    train = rated(spark, [(1, 7, 4.0, 1), (2, 7, 3.0, 2), (1, 8, 5.0, 3)])
    e = {r.movieId: r.rating_entropy for r in FE.item_entropy(train).collect()}
    assert e[8] == 0.0 and abs(e[7] - 1.0) < 1e-12
    assert {r.userId: r.rating_std for r in FE.user_base(train).collect()}[2] == 0.0
    tags = spark.createDataFrame([(7, t) for t in "aaabbc"] + [(8, "d")], "movieId int, tag_norm string")
    assert {r.movieId: (r.n_tag_events, r.top_tags) for r in FE.item_tags(tags, 2, 1).collect()} == {7: (5, "a")}
    assert {r.movieId: (r.n_tag_events, r.top_tags) for r in FE.item_tags(tags, 10).collect()} == {7: (6, ""), 8: (1, "")}
    movies = spark.createDataFrame([(7, ["A", "B"]), (9, [])], "movieId int, genres_list array<string>")
    assert FE.item_genre_flags(movies).orderBy("movieId").first().asDict() == {"movieId": 7, "genre_flag__a": 1, "genre_flag__b": 1}


def test_reduction(spark):
    b = baskets(spark, *([["genre:x", "movie:1", "tag:t"]] * 3), ["movie:1", "tag:t"], ["movie:1"])
    capped = B.reduce_baskets(b, min_df=3, max_items=2)
    assert {r.userId: r["items"] for r in capped.collect()}[0] == ["genre:x", "movie:1"]
    assert B.reduce_baskets(b, min_df=3).count() == 4
    df = spark.createDataFrame([("movie:a", 5), ("movie:b", 7), ("movie:c", 5), ("movie:d", 5)], "token string, df bigint")
    assert sorted(r.token for r in B.top_per_family(df, {"movie": 3}).collect()) == ["movie:a", "movie:b", "movie:c"]
    assert B.exact_sample(b, 0.4).count() == 2
    with pytest.raises(ValueError):
        B.with_mode(b, "nope")


def test_mining(spark):
    b = baskets(spark, ["a", "b", "c"], ["a", "b"], ["a"], ["b", "c"])
    kept = M.pruned(b, M.frequent_tokens(b, 0.5))
    assert {tuple(r["items"]): r["count"] for r in M.itemsets(kept, 0.5).collect()} == {("a",): 3, ("b",): 3, ("c",): 2, ("a", "b"): 2, ("b", "c"): 2}
    rule = M.rules(kept, 0.5, 0.9).first()
    assert (rule.antecedent, rule.consequent, rule.confidence, rule.conviction) == ("c", "b", 1.0, float("inf"))
    assert abs(rule.lift - 4 / 3) < 1e-12
    assert sorted(map(tuple, M.pair_counts(b).collect())) == sorted(map(tuple, M.pair_counts_by_join(B.to_tokens(b)).collect()))
    ml = {tuple(sorted(r["items"])): r.freq for r in M.fpgrowth(b, 0.5).collect()}
    assert {k: v for k, v in ml.items() if len(k) <= 2} == {tuple(r["items"]): r["count"] for r in M.itemsets(kept, 0.5).collect()}
    none = b.limit(0)
    held = M.gate_held_out(M.rules(kept, 0.5, 0.5), none, "full", M.frequent_tokens(b, 0.5))
    assert held.count() == M.rules(kept, 0.5, 0.5).count()


def test_presets():
    assert preset("B").active_tops and preset("B").algorithm == "movie_tag"
    assert not preset("custom", mode="full").caps_on and preset(" a ") == preset("A") and preset("").preset == "custom"
    full = clamp(preset("custom", mode="full", low_support=0.0001))
    assert full.caps_on and full.limits and full.low_support == 0.001 and max(full.caps.values()) <= 60 and max(full.tops.values()) <= 600
    assert clamp(preset("A")).caps == preset("A").caps and clamp(preset("B")) == preset("B")
    for bad in ({"test_frac": 1.0}, {"split_policy": "x"}, {"max_items": 1}, {"sample_frac": 0.0}):
        with pytest.raises(ValueError):
            PipelineConfig(**bad)
    with pytest.raises(ValueError):
        preset("Z")


def test_mine_genre_tag(spark):
    b = baskets(spark, *([["genre:x", "tag:t"]] * 6), *([["genre:y", "tag:u"]] * 6))
    rules = mine(b, preset("C"))["rules"].collect()
    assert {(r.antecedent, r.consequent) for r in rules} == {("genre:x", "tag:t"), ("tag:t", "genre:x"), ("genre:y", "tag:u"), ("tag:u", "genre:y")}


def test_recommend(spark):
    rows = [
        (["movie:1"], ["movie:1"], 0.1, 0.9, 2.0), (["movie:1"], ["movie:2"], 0.1, 0.9, 1.0), (["movie:1"], ["movie:3"], 0.1, 0.5, 2.0),
        (["movie:1", "tag:x"], ["movie:3"], 0.2, 0.6, 1.5), (["tag:y"], ["movie:1"], 0.1, 0.4, 3.0), (["genre:a"], ["tag:y"], 0.1, 0.4, 3.0),
    ]
    rules = R.adapt_rules(spark.createDataFrame(rows, "antecedents array<string>, consequents array<string>, support double, confidence double, lift double"))
    rec = R.recommend(rules, "movie:1").collect()
    assert [(r.rec_token, r["rank"], r.evidence_count, r.lift, r.confidence) for r in rec] == [("movie:3", 1, 2, 2.0, 0.6)]
    assert R.evidence(rules, "movie:1", n=1).first().lift == 2.0
    assert [r.tag for r in R.tag_dna(rules, "movie:1").collect()] == ["tag:y", "tag:x"]
    assert not R.genre_semantics(rules, ["genre:a"]).first().fallback and R.genre_semantics(rules, ["genre:zz"]).first().fallback
    with pytest.raises(ValueError):
        R.adapt_rules(spark.createDataFrame([(1,)], "x int"))


def test_sample_is_exact(spark):
    b = baskets(spark, *[["genre:a"]] * 50)
    for fraction, n in ((0.05, 2), (0.5, 25), (0.99, 50), (1.0, 50)):
        rows = B.exact_sample(b, fraction).collect()
        assert len(rows) == n and len({r.userId for r in rows}) == n
    assert B.exact_sample(b.limit(0), 0.5).count() == 0


def test_pairs_across_families(spark):
    b = baskets(spark, ["movie:1", "movie:2", "tag:a"], ["movie:1", "tag:a", "tag:b"], ["genre:x", "movie:1"], ["tag:a"])
    every = {(r.a, r.b): r.c_ab for r in M.pair_counts(b).collect()}
    want = {k: n for k, n in every.items() if {t.split(":")[0] for t in k} == {"movie", "tag"}}
    assert want and {(r.a, r.b): r.c_ab for r in M.pair_counts(b, ("movie", "tag")).collect()} == want
    assert {(r.a, r.b): r.c_ab for r in M.pair_counts(b, ("tag", "movie")).collect()} == want


def test_genres_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(FE, "MOST_GENRES", 1)
    movies = spark.createDataFrame([(1, ["a", "b"])], "movieId int, genres_list array<string>")
    with pytest.raises(ValueError):
        FE.genre_values(movies)


def test_default_seed(spark):
    options = spark.createDataFrame([("movie:1", "a"), ("movie:2", "b")], "token string, title string")
    assert R.default_seed(options, ["movie:9", "movie:2"]) == "movie:2" and R.default_seed(options, []) == "movie:1"
    assert R.default_seed(options.limit(0), ["movie:1"]) is None


def test_reports():
    found = validation_summary({"a": {"warnings": ["w"]}, "b": {"error": "e"}, "c": {}})
    assert found == {"all_validations_passed": False, "errors": [{"table": "b", "error": "e"}], "warnings": [{"table": "a", "warning": "w"}]}
    assert validation_summary({})["all_validations_passed"]
    assert value_at({"a": {"b": 1}}, "a", "b") == 1 and value_at({"a": 1}, "a", "b", default=0) == 0 and value_at({}, "x") is None


def test_genres_side_by_side_or_pivoted(spark, monkeypatch):
    train = rated(spark, [(1, 7, 4.0, 1), (2, 7, 3.0, 2), (1, 8, 5.0, 3), (1, 9, 1.0, 4), (3, 9, 2.0, 5)])
    movies = spark.createDataFrame([(7, ["A", "B", "A"]), (8, ["A"]), (9, []), (10, ["C"])], "movieId int, genres_list array<string>")
    key = lambda df: sorted((r.userId, r.genre_pref__a, r.genre_pref__b) for r in df.collect())
    wanted = [(1, 4.5, 4.0), (2, 3.0, 3.0)]
    side = FE.user_genre_prefs(train, movies)
    assert key(side) == wanted and side.columns == ["userId", "genre_pref__a", "genre_pref__b"]
    monkeypatch.setattr(FE, "SIDE_BY_SIDE", 0)
    assert key(FE.user_genre_prefs(train, movies)) == wanted


def test_mine_without_a_family(spark):
    """No movie is frequent: no rules, as in SQL; a written run refuses such baskets."""
    b = baskets(spark, *([["movie:%d" % i, "tag:t"] for i in range(12)]))
    found = mine(b, preset("B", low_support=0.5))
    assert found["rules"].count() == 0 and [r["items"] for r in found["itemsets"].collect()] == [["tag:t"]]
    with pytest.raises(ValueError, match="movie and tag"):
        need_families(found["dictionary"], "movie", "tag")


def test_shuffles_follow_the_tables(spark):
    own = {k: spark.conf.get(k) for k in (sizes.PARTITIONS, *sizes.LARGE)}
    now = lambda: {k: spark.conf.get(k) for k in own}
    cores = spark.sparkContext.defaultParallelism
    sizes.size_shuffles(spark, cores * sizes.PART_BYTES)
    assert now() == own
    for times in (10, 60):
        sizes.size_shuffles(spark, times * cores * sizes.PART_BYTES)
        assert now() == sizes.LARGE | {sizes.PARTITIONS: str(times * cores)}
    sizes.size_shuffles(spark, 1)
    assert now() == own


def test_tokens_are_distinct(spark):
    train = rated(spark, [(1, 7, 5.0, 1), (1, 7, 4.0, 2), (1, 8, 5.0, 3), (2, 7, 4.0, 4)])
    movies = spark.createDataFrame([(7, ["A", "B"]), (8, ["A"])], "movieId int, genres_list array<string>")
    tags = spark.createDataFrame([], "userId int, movieId int, tag_norm string")
    wanted = [(1, "genre:a"), (1, "genre:b"), (1, "movie:7"), (1, "movie:8"), (2, "genre:a"), (2, "genre:b"), (2, "movie:7")]
    for families in (B.FAMILIES, ("movie",), ("genre", "tag")):
        got = sorted(map(tuple, B.basket_tokens(train, movies, tags, families=families).collect()))
        assert got == [r for r in wanted if r[1].split(":")[0] in families]
