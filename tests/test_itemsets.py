"""Coded baskets, itemsets of any length and their rules against brute force; leases of kept frames."""

import random
from collections import Counter
from itertools import combinations
from math import ceil

import pytest
from pyspark.sql import functions as F

from tastemill.operators import baskets as B
from tastemill.operators import itemsets as I
from tastemill.operators import mining as M
from tastemill.plans import leases
from tastemill.plans.config import preset
from tastemill.plans.pipeline import mine


def long_form(spark, baskets):
    return spark.createDataFrame([(u, t) for u, b in enumerate(baskets) for t in b], "userId int, token string")


def drawn(seed, n=80):
    rng = random.Random(seed)
    words = ["genre:a", "genre:b", "movie:1", "movie:2", "movie:3", "tag:x", "tag:y", "odd", "genre:é"]
    return [sorted({w for i, w in enumerate(words) if rng.random() < 0.75 - 0.07 * i}) for _ in range(n)]


def counted(baskets, support, longest):
    """Frequent sets by counting all subsets of the baskets of frequent tokens."""
    baskets = [b for b in baskets if b]
    votes = Counter(t for b in baskets for t in b)
    kept = {t for t, c in votes.items() if c >= ceil(support * len(baskets))}
    own = [x for b in baskets if (x := [t for t in b if t in kept])]
    found = Counter(s for b in own for k in range(1, longest + 1) for s in combinations(sorted(b), k))
    return {s: c for s, c in found.items() if len(s) == 1 or c >= ceil(support * len(own))}, len(own), votes, kept


@pytest.mark.parametrize(("support", "longest"), [(0.1, 5), (0.3, 3), (0.3, 2), (0.05, 1)])
def test_sets_of_any_length(spark, support, longest):
    baskets = drawn(1)
    want, n, _, _ = counted(baskets, support, longest)
    own = I.coded(long_form(spark, baskets), support)
    got = I.frequent_sets(own, support, longest).collect()
    assert {tuple(r["items"]): r["count"] for r in got} == want and len(got) == len(want)
    assert all(r.length == len(r["items"]) and abs(r.support - r["count"] / n) < 1e-12 for r in got)
    assert own.n.first().n == n


def test_sets_against_spark_ml(spark):
    b = B.to_baskets(long_form(spark, drawn(2)))
    got = {tuple(r["items"]): r["count"] for r in I.frequent_sets(I.coded_baskets(b, 0.1), 0.1, 9).collect()}
    assert got == {tuple(sorted(r["items"])): r.freq for r in M.fpgrowth(b, 0.1).collect()} and max(map(len, got)) > 3


def test_codes(spark):
    baskets = drawn(3)
    _, _, votes, kept = counted(baskets, 0.2, 1)
    own = I.coded(long_form(spark, baskets), 0.2)
    rows = sorted(own.dictionary.collect(), key=lambda r: r.code)
    assert [r.token for r in rows] == sorted(kept, key=lambda t: (votes[t], t)) and [r.code // 4 for r in rows] == list(range(len(rows)))
    assert {r.token.split(":")[0]: r.code % 4 for r in rows} == {k: {"genre": 0, "movie": 1, "tag": 2}.get(k, 3) for k in {t.split(":")[0] for t in kept}}
    pairs = Counter(p for b in baskets for p in combinations([t for t in b if t in kept], 2))
    for families in (None, ("movie", "tag"), ("tag", "genre")):
        got = {tuple(r["items"]): r["count"] for r in I.frequent_sets(own, 0.0, families=families).where("length = 2").collect()}
        assert got == {p: c for p, c in pairs.items() if not families or {t.split(":")[0] for t in p} == set(families)}


def test_candidates_and_their_guard(spark):
    sets = spark.createDataFrame([([a, b],) for a, b in [(1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 5), (1, 5)]], "codes array<int>")
    assert sorted(r.codes for r in I.candidates(sets, 3).collect()) == [[1, 2, 3], [1, 2, 4], [1, 3, 5]]
    own = I.coded(long_form(spark, drawn(1)), 0.1)
    with pytest.raises(ValueError, match="candidates of 3 tokens"):
        I.frequent_sets(own, 0.1, 3, most=2)
    for bad in ({"max_len": 0}, {"max_len": 99}, {"max_len": 3, "families": ("movie", "tag")}):
        with pytest.raises(ValueError):
            I.frequent_sets(own, 0.1, **bad)
    with pytest.raises(ValueError):
        preset("custom", max_len=0)


def test_rules_of_several_tokens(spark):
    baskets = drawn(4)
    sets, n, _, _ = counted(baskets, 0.15, 4)
    want = {}
    for s, c in sets.items():
        for k in range(1, len(s)):
            for a in combinations(s, k):
                b = tuple(t for t in s if t not in a)
                if c / sets[a] >= 0.4 and c * n / (sets[a] * sets[b]) > 1.0:
                    want[a, b] = (c, sets[a], sets[b], n)
    own = I.coded(long_form(spark, baskets), 0.15)
    got = I.set_rules(I.frequent_sets(own, 0.15, 4), own.n, 0.4, 1.0)
    rows = got.collect()
    assert {(tuple(r.antecedent), tuple(r.consequent)): (r.count_ab, r.count_a, r.count_b, r.n) for r in rows} == want and len(rows) == len(want)
    assert any(len(r.antecedent) == 2 and len(r.consequent) == 2 for r in rows)
    single = {(r.antecedent[0], r.consequent[0], r.count_ab, r.lift) for r in M.single_sided(got).collect()}
    assert single == {(r.antecedent, r.consequent, r.count_ab, r.lift) for r in I.pair_rules(own, 0.15, 0.4, 1.0).collect()}


def test_recount(spark):
    train, test = drawn(5), [b for b in drawn(6, 40)] + [["new:token"], ["genre:a", "new:token"]]
    _, _, _, kept = counted(train, 0.3, 1)
    own = I.coded(long_form(spark, train), 0.3)
    held = [x for b in test if (x := [t for t in b if t in kept])]
    singles, pairs, n = Counter(t for b in held for t in b), Counter(p for b in held for p in combinations(b, 2)), len(held)
    found = I.recounted(I.pair_rules(own, 0.3, 0.0), I.coded_by(long_form(spark, test), own.dictionary)).collect()
    assert found
    for r in found:
        ab, a, b = pairs[tuple(sorted((r.antecedent, r.consequent)))], singles[r.antecedent], singles[r.consequent]
        assert (r.count_ab_test, r.count_a_test, r.count_b_test, r.n_test) == (ab, a, b, n)
        assert abs(r.confidence_test - ab / a) < 1e-12 and abs(r.support_b_test - b / n) < 1e-12 and abs(r.lift_test - ab / a / (b / n)) < 1e-9
    none = I.recounted(I.pair_rules(own, 0.3, 0.0), I.coded_by(long_form(spark, [["new:token"]]), own.dictionary)).first()
    assert (none.n_test, none.count_b_test, none.lift_test, none.conf_ratio) == (0, 0, 0.0, 0.0)


def test_mine_longer_sets(spark):
    baskets = [["genre:a", "tag:x", "tag:y"]] * 6 + [["genre:b", "tag:x"]] * 4 + [[]]
    rows = spark.createDataFrame([(u, b, len(b)) for u, b in enumerate(baskets)], "userId int, items array<string>, n_items int")
    found = mine(rows, preset("custom", mode="genre_tag", max_len=3, min_confidence=0.1, min_lift=1.0))
    assert {tuple(r["items"]) for r in found["itemsets"].where("length = 3").collect()} == {("genre:a", "tag:x", "tag:y")}
    assert (["genre:a"], ["tag:x", "tag:y"]) in [(r.antecedent, r.consequent) for r in found["set_rules"].collect()]
    assert all(isinstance(r.antecedent, str) for r in found["rules"].collect())
    pairs = mine(rows.where("userId < 0").unionByName(rows), preset("custom", mode="genre_tag", max_len=1))
    assert pairs["itemsets"].agg(F.max("length")).first()[0] == 1


def test_limits_under_the_movie_tag_miner():
    off = preset("custom", mode="movie_tag", algorithm="movie_tag", limits=True, caps_on=True)
    assert not off.active_tops and not off.active_caps and preset("B").active_caps
    assert preset("custom", mode="movie_tag", limits=True).active_tops


def test_leases(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).write.parquet(path)
    before = leases.held()
    seen = []

    def query():
        scope = leases.Scope(spark, [path])
        df = scope.keep(spark.read.parquet(path).groupBy((F.col("id") % 3).alias("k")).count())
        seen.append(df)
        return scope.bind(df.where("k >= 0"))

    first = query()
    assert first.agg(F.sum("count")).first()[0] == 10 and leases.held() == before + 1
    second = query()  # the same state: one lease, two holders
    assert leases.held() == before + 1
    del second
    assert leases.held() == before + 1 and seen[0].storageLevel.useDisk
    spark.range(25).write.mode("overwrite").parquet(path)
    third = query()  # the table was rewritten: the old lease gives way
    assert third.agg(F.sum("count")).first()[0] == 25
    del first, third
    assert leases.held() == before and not seen[-1].storageLevel.useDisk


def test_queries_leave_nothing_persisted(spark):
    import os

    from tastemill import queries as Q

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no driver tables")
    before = leases.held()
    for name in ("rules_preset_c", "itemsets_three", "user_features"):
        result = Q.queries()[name](spark, folder)
        result.count()
        assert leases.held() > before
        del result
        assert leases.held() == before
