import csv
import json

import pytest
from pyspark.sql import functions as F

from tastemill.plans.config import PipelineConfig, preset
from tastemill.plans.pipeline import export_evidence, recommend_from, run_mining, run_pipeline
from tastemill.sources import files
from tastemill.streaming.cleaners import stream_likes


def put(path, header, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    put(d / "movies.csv", ["title", "movieId", "genres", "extra"], [[f'Film "{i}" ({1990 + i})', i, "A|B" if i % 2 else "C", "z"] for i in range(1, 9)])
    put(d / "ratings.csv", ["userId", "movieId", "rating", "timestamp"], [[u, m, 5.0 if (u + m) % 2 else 2.0, u * 10 + m * 100] for u in range(1, 13) for m in range(1, 9)])
    put(d / "tags.csv", ["userId", "movieId", "tag", "timestamp"], [[u, m, ' Good\nOne ' if m % 2 else "", u + m] for u in range(1, 13) for m in range(1, 9)])
    put(d / "links.csv", ["movieId", "imdbId", "tmdbId"], [[i, i + 10, "" if i == 3 else i + 20] for i in range(1, 9)])
    return str(d)


def test_csv(spark, raw, tmp_path):
    movies = files.read_raw(spark, raw, "movies")
    row = movies.where("movieId = 1").first()
    assert (row.title, row.extra) == ('Film "1" (1991)', "z")
    assert files.read_raw(spark, raw, "genome-tags") is None
    with pytest.raises(FileNotFoundError):
        files.read_csv_strict(spark, f"{raw}/none.csv", {})
    with pytest.raises(ValueError):
        files.read_csv_strict(spark, f"{raw}/links.csv", files.RAW["ratings"])
    meta, row = files.file_meta(spark, f"{raw}/links.csv"), files.file_provenance(spark, f"{raw}/links.csv").first()
    assert (meta["sha256"], meta["rows"]) == (row.sha256, 8) and row.rows == 8
    files.write_csv(movies, str(tmp_path / "out"))
    back = spark.read.options(header=True, escape='"').csv(str(tmp_path / "out"))
    assert sorted(r.title for r in back.collect()) == sorted(r.title for r in movies.collect())


@pytest.mark.parametrize("policy", ["global", "per_user"])
def test_whole_run(spark, raw, tmp_path, policy):
    staging, out = str(tmp_path / "staging"), str(tmp_path / "out")
    assert files.stage_raw(spark, raw, staging) and not files.stage_raw(spark, raw, staging)
    run = run_pipeline(spark, staging, out, PipelineConfig(split_policy=policy, min_tag_freq=1, min_token_df=1))
    assert files.latest_run(spark, out) == run
    audit = json.loads("\n".join(r.value for r in spark.read.text(f"{run}/reports/audit_report.json").collect()))
    assert audit["passed"] and audit["gates"]["integrity"] and audit["run"] == run.rsplit("/", 1)[-1]
    assert audit["counts"]["clean_tables"] == {"movies": 8, "ratings": 96, "tags": 48, "links": 8} and audit["missingness"]["links"] == {"imdb_missing": 0, "tmdb_missing": 1}
    assert audit["counts"]["split"]["total_rows"] == sum(audit["counts"]["split"][k] for k in ("train_rows", "test_rows")) and audit["join_coverage"]["tags_to_movies"] == 1.0
    meta = json.loads("\n".join(r.value for r in spark.read.text(f"{run}/reports/metadata_clean.json").collect()))
    assert {r["table"]: (r["raw_rows"], r["clean_rows"], r["retention"]) for r in meta["retention"]} == {"movies": (8, 8, 1.0), "ratings": (96, 96, 1.0), "tags": (96, 48, 0.5), "links": (8, 8, 1.0)}
    found = files.checklist(spark, run, ["transactions_train", "user_features_train", "none"], ["split_report.json", "x.json"])
    assert found["transactions_train"] > 0 and found["none"] == -1 and found["split_report.json"] and not found["x.json"]
    mined = run_mining(spark, run, str(tmp_path / "mined"), preset("custom", mode="full", min_confidence=0.1, min_lift=0.1, low_support=0.01), reduced_input=False)
    rules = spark.read.parquet(f"{mined}/tables/association_rules")
    assert rules.count() > 0 and files.preset_run(spark, [str(tmp_path / "no"), str(tmp_path / "mined")]) == mined
    from tastemill.operators.recommend import adapt_rules

    seed = adapt_rules(rules).where("rec_token IS NOT NULL").select(F.explode("antecedent").alias("t")).where("t LIKE 'movie:%'").first().t
    movies = spark.read.parquet(f"{run}/tables/dim_movies_clean")
    to = export_evidence(spark, adapt_rules(rules), movies, seed, str(tmp_path / "ev"), min_lift=0.0, min_confidence=0.0)
    assert spark.read.parquet(f"{to}/tables/rule_evidence").count() > 0


def test_stream(spark, raw, tmp_path):
    ratings = files.read_raw(spark, raw, "ratings")
    ratings.write.parquet(str(tmp_path / "in"))
    q = stream_likes(spark, str(tmp_path / "in"), ratings.schema).writeStream.format("memory").queryName("likes").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("likes").count() == ratings.where("rating >= 4").count()


def test_hourly_likes(spark, tmp_path):
    """Hours are given once the watermark has passed them, with what came in time; later likes of a closed hour are left out."""
    from tastemill.streaming.cleaners import hourly_likes

    schema, place = "userId int, movieId int, rating float, timestamp bigint", str(tmp_path / "in")
    put_in = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)
    hour = 3600
    put_in((1, 1, 5.0, 10), (2, 1, 4.0, 20), (3, 1, 1.0, 30))
    likes = stream_likes(spark, place, spark.read.parquet(place).schema)
    q = hourly_likes(likes, "1 hour").writeStream.format("memory").queryName("hours").outputMode("append").start()
    q.processAllAvailable()
    put_in((1, 2, 5.0, 50), (1, 3, 5.0, 5 * hour))
    q.processAllAvailable()
    put_in((1, 4, 5.0, 60), (1, 5, 5.0, 9 * hour))
    q.processAllAvailable()
    q.stop()
    assert [(r.s, r.likes) for r in spark.table("hours").selectExpr("unix_seconds(window.start) AS s", "likes").orderBy("s").collect()] == [(0, 3), (5 * hour, 1)]


def test_command_lines(spark, raw, tmp_path):
    from tastemill.__main__ import main

    staged = main(["stage", str(raw), str(tmp_path / "staging")])
    run = main(["run", staged, str(tmp_path / "runs"), "--options", '{"min_token_df": 1, "min_tag_freq": 1}'])
    mined = main(["mine", run, str(tmp_path / "mined"), "--options", '{"min_confidence": 0.0, "min_lift": 0.0}'])
    assert spark.read.parquet(f"{mined}/tables/association_rules").count() > 0
    with pytest.raises(SystemExit):
        main(["stage"])


def test_provenance_against_hashlib(spark, tmp_path):
    """Every way a file can end, a byte order mark, carriage returns, bytes that are no UTF-8, and files of many splits."""
    import hashlib
    import random

    rng = random.Random(1)
    texts = {
        "empty": b"", "end": b"a,b\n1,2\n", "open": b"a,b\n1,2", "newlines": b"\n\n\n", "marked": b"\xef\xbb\xbfa\nb\n", "marked_open": b"\xef\xbb\xbfa\nb",
        "carriage": b"a\r\nb\rc\r\n", "bytes": bytes(range(256)) * 5 + b"\n\xff", "long": b"x" * 300_000 + b"\ny",
        "large": b"".join(b"%d,%d\n" % (i, rng.getrandbits(60)) for i in range(60_000)),
    }
    for name, data in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        paths = [str(tmp_path / f"{n}.csv") for n in texts]
        got = files.file_meta(spark, *paths, str(tmp_path / "none.csv"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for p, data in zip(paths, texts.values(), strict=True):
        lines = data.count(b"\n") + (not data.endswith(b"\n") and bool(data))
        assert got[p] == {"size_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "rows": max(lines - 1, 0)}, p
    assert got[str(tmp_path / "none.csv")] == {"missing": True} == files.file_meta(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        files.file_meta(spark, str(tmp_path / "x.csv.gz")) if (tmp_path / "x.csv.gz").write_bytes(b"x") else None


def test_open_runs_are_not_listed(spark, tmp_path):
    out = str(tmp_path)
    with files.Run(spark, out) as run:
        files.write_table(spark.range(3), f"{run.path}/tables/association_rules")
        assert files.runs(spark, out) == [] and files.preset_run(spark, [out]) is None
    assert files.latest_run(spark, out) == run.final == files.preset_run(spark, [out])
    assert json.loads("\n".join(r.value for r in spark.read.text(f"{run.final}/manifest.json").collect()))["tables"] == {"association_rules": 3}
    with pytest.raises(KeyError), files.Run(spark, out) as broken:
        files.write_table(spark.range(3), f"{broken.path}/tables/association_rules")
        raise KeyError
    assert not files.exists(spark, broken.path) and files.latest_run(spark, out) == run.final
    killed = files.Run(spark, out).__enter__()  # the driver dies here
    files.write_table(spark.range(3), f"{killed.path}/tables/association_rules")
    assert files.latest_run(spark, out) == run.final == files.preset_run(spark, [out])
    for n in (1, 2):
        with files.Run(spark, out, "tagged") as tagged:
            files.write_table(spark.range(n), f"{tagged.path}/tables/t")
    assert spark.read.parquet(f"{out}/tagged/tables/t").count() == 2


def test_presets_side_by_side(spark, raw, tmp_path):
    """A, B and C mined into one root; each is found again, and a seed is advised from all three."""
    staging, out, mined = (str(tmp_path / n) for n in ("staging", "out", "mined"))
    files.stage_raw(spark, raw, staging)
    run = run_pipeline(spark, staging, out, PipelineConfig(min_tag_freq=1, min_token_df=1))
    loose = {"min_confidence": 0.0, "min_lift": 0.0, "gate1": True, "gate1_min_ab": 1, "gate1_min_a": 1, "gate1_max_support_b": None}
    made = {p: run_mining(spark, run, mined, preset(p, **loose)) for p in "ABC"}
    assert len(set(made.values())) == 3
    for p, at in made.items():
        assert files.preset_run(spark, [str(tmp_path / "no"), mined], preset=p) == at
    assert files.preset_run(spark, [mined]) == made["C"] and files.preset_run(spark, [mined], preset="D") is None
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{made['A']}/reports/run_manifest.json").collect()))
    rules = spark.read.parquet(f"{made['A']}/tables/association_rules")
    assert manifest["outputs"]["rules_final"] == manifest["outputs"]["rules_gate1"] == rules.count() > 0
    assert manifest["inputs"]["n_baskets_raw"] == 12 and manifest["parameters"]["mode"] == "movie_only"
    page = "\n".join(r.value for r in spark.read.text(f"{made['A']}/reports/summary.md").collect())
    assert page.count("| [M]") == min(10, rules.count()) and "| cap_movie | 39 |" in page and "- movie_only: " in page

    from tastemill.operators import recommend as R
    from tastemill.operators import seeds

    index = seeds.open_index(spark, f"{made['A']}/tables/rules_by_token")
    seed = rules.select(F.explode("antecedent").alias("t")).orderBy("t").first().t
    own = seeds.of_token(index, seed)
    key = lambda df: sorted((tuple(r.antecedent), tuple(r.consequent), r.lift) for r in df.collect())
    assert key(own) == key(rules.where(F.array_contains(F.concat("antecedent", "consequent"), seed)))
    assert len({f.rsplit("/", 2)[-2] for f in own.inputFiles()}) >= 1 and "PartitionFilters: [isnotnull(bucket" in own._jdf.queryExecution().toString()
    loose = {"min_lift": 0.0, "min_confidence": 0.0}
    at = recommend_from(spark, mined, run, str(tmp_path / "advice"), seed, **loose)
    got = spark.read.parquet(f"{at}/tables/recommendations").orderBy("rank").collect()
    want = R.recommend(R.adapt_rules(rules), seed, **loose).orderBy("rank").collect()
    assert [(r.rec_token, r.lift) for r in got] == [(r.rec_token, r.lift) for r in want] and got
    assert spark.read.parquet(f"{at}/tables/evidence").count() >= len(got)
    assert {r.tag.split(":")[0] for r in spark.read.parquet(f"{at}/tables/tag_dna").collect()} <= {"tag"}
    assert spark.read.parquet(f"{at}/tables/semantics").where("fallback").count() == 0
    unknown = recommend_from(spark, mined, run, str(tmp_path / "advice"), "movie:99")
    assert spark.read.parquet(f"{unknown}/tables/recommendations").count() == 0 and spark.read.parquet(f"{unknown}/tables/semantics").where("NOT fallback").count() == 0
    with pytest.raises(FileNotFoundError):
        recommend_from(spark, str(tmp_path / "no"), run, str(tmp_path / "advice"), seed)

    from tastemill.__main__ import main

    advised = main(["recommend", mined, run, str(tmp_path / "cli"), "--options", json.dumps(loose)])
    assert spark.read.parquet(f"{advised}/tables/recommendations").count() > 0


def test_a_failed_gate_leaves_nothing(spark, raw, tmp_path):
    from tastemill.operators import clean as C
    from tastemill.operators import quality as Q

    staging, out = str(tmp_path / "staging"), str(tmp_path / "out")
    files.stage_raw(spark, raw, staging)
    tables = files.read_staged(spark, staging)
    for name, gate, cleaner in (("movies", Q.gate_movies, C.clean_movies), ("ratings", Q.gate_ratings, C.clean_ratings), ("tags", Q.gate_tags, C.clean_tags), ("links", Q.gate_links, C.clean_links)):
        df, seen = Q.watch(tables[name], cleaner, name)
        df.write.parquet(str(tmp_path / name))
        assert {k: v for k, v in gate(df, seen()).items() if k != "raw_rows"} == gate(cleaner(tables[name])), name
    doubled = tables["movies"].unionByName(tables["movies"])
    doubled.write.mode("overwrite").parquet(str(tmp_path / "twice"))
    spark.read.parquet(str(tmp_path / "twice")).write.mode("overwrite").parquet(f"{staging}/movies_raw")
    with pytest.raises(Q.GateError):
        run_pipeline(spark, staging, out)
    assert files.names_in(spark, out) == []


def shuffled_by(df):
    """The keys of the plan's exchanges."""
    import re

    return re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_user_tables_stay_in_their_buckets(spark, tmp_path):
    """Features and baskets of users read bucketed ratings and tags without a shuffle of either; the results are those of plain tables."""
    import random

    from tastemill.operators import baskets as B
    from tastemill.operators import features as FE

    rng = random.Random(3)
    rows = [(u, rng.randrange(1, 40), float(rng.choice([2, 4, 5])), i, f"tag {rng.randrange(4)}") for i, u in enumerate(rng.choices(range(30), k=600))]
    df = spark.createDataFrame(rows, "userId int, movieId int, rating float, timestamp bigint, tag_norm string").withColumn("rating_dt_utc", F.timestamp_seconds("timestamp"))
    ratings, tags = df.drop("tag_norm"), df.select("userId", "movieId", "tag_norm")
    movies = spark.createDataFrame([(i, ["A", "B"][: i % 3]) for i in range(1, 40)], "movieId int, genres_list array<string>")
    movies = files.write_table(movies.coalesce(1), str(tmp_path / "movies"))  # the smaller side of its join by size
    tables = files.Bucketed(spark, 4)
    own, marks = tables.write(ratings, str(tmp_path / "ratings"), "userId"), tables.write(tags, str(tmp_path / "tags"), "userId")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.sources.bucketing.autoBucketedScan.enabled")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = {"features": (FE.user_features, (own, movies, marks), (ratings, movies, tags)), "baskets": (B.transactions, (own, movies, marks), (ratings, movies, tags))}
        key = lambda d: sorted(map(repr, d.collect()))
        for name, (make, given, plain) in made.items():
            kept, moved = make(*given), make(*plain)
            assert key(kept) == key(moved)
            # Tokens of several kinds meet in one shuffle; ratings and tags are not shuffled.
            stay, go = ([k for k in shuffled_by(x) if "userId" in k] for x in (kept, moved))
            assert len(stay) == (name == "baskets") < len(go), name
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        both = own.join(marks, ["userId", "movieId"])
        assert not shuffled_by(both) and both.count() == ratings.join(tags, ["userId", "movieId"]).count()
        again = tables.read(str(tmp_path / "ratings"), "userId").groupBy("userId").count()
        assert not shuffled_by(again) and key(again) == key(ratings.groupBy("userId").count())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        tables.forget()
    assert spark.read.parquet(str(tmp_path / "ratings")).count() == 600
