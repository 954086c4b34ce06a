"""End-to-end runs: staging to features, baskets and audit; baskets to rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import baskets as B
from ..operators import clean as C
from ..operators import features as FE
from ..operators import itemsets as I
from ..operators import mining as M
from ..operators import present as P
from ..operators import quality as Q
from ..operators import recommend as R
from ..operators import seeds
from ..operators import split as S
from ..sources import files
from .config import MiningConfig, PipelineConfig, clamp
from .leases import Scope

CLEANERS = {
    "movies": ("dim_movies_clean", C.clean_movies), "ratings": ("fact_ratings_clean", C.clean_ratings), "tags": ("dim_tags_clean", C.clean_tags),
    "links": ("dim_links_clean", C.clean_links), "genome-tags": ("dim_genome_tags_clean", C.clean_genome_tags),
    "genome-scores": ("fact_genome_scores_clean", C.clean_genome_scores),
}

GATES = {"movies": Q.gate_movies, "ratings": Q.gate_ratings, "tags": Q.gate_tags, "links": Q.gate_links}


def split(ratings: DataFrame, config: PipelineConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    if config.split_policy == "per_user":
        return S.user_split(ratings, config.test_frac)
    train, test = S.global_split(ratings, config.test_frac, config.cutoff_date)
    return train, test, S.time_cutoff(ratings, config.test_frac, config.cutoff_date)


def reduced(baskets: DataFrame, config: PipelineConfig) -> DataFrame:
    return B.reduce_baskets(
        baskets, config.reduction_families, config.min_token_df, config.top_k_movies, config.top_k_tags, config.min_items, config.max_items,
        config.sample_frac, config.random_seed,
    )


def run_pipeline(spark: SparkSession, staging_dir: str, out_dir: str, config: PipelineConfig | None = None) -> str:
    """Clean, validate, split, build features and baskets, reduce and audit; returns the run's directory.

    Gates use what was seen while clean tables were written; one that fails raises, and the run leaves nothing. Phases hand over by written tables, and the run
    is listed when all of it is there.
    """
    config = config or PipelineConfig()
    tables = files.Bucketed(spark, config.buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        with files.Run(spark, out_dir, config.run_tag) as run:
            _phases(spark, staging_dir, run.path, config, tables)
    finally:
        tables.forget()
    return run.final


def _phases(spark: SparkSession, staging_dir: str, run_dir: str, config: PipelineConfig, tables: files.Bucketed) -> None:
    raw = {k: v for k, v in files.read_staged(spark, staging_dir).items() if v is not None}

    def save(df: DataFrame, name: str) -> DataFrame:
        return files.write_table(df, f"{run_dir}/tables/{name}")

    def save_by_user(df: DataFrame, name: str) -> DataFrame:
        return tables.write(df, f"{run_dir}/tables/{name}", "userId")

    def report(name: str, content: dict) -> None:
        files.write_json(spark, f"{run_dir}/reports/{name}", content)

    clean, seen = {}, {}
    for k, v in raw.items():  # one scan of each raw table
        df, metrics = Q.watch(v, CLEANERS[k][1], k)
        clean[k] = save(df, CLEANERS[k][0])
        seen[k] = metrics()
    gates = {k: gate(clean[k], seen[k]) for k, gate in GATES.items()}
    for k in ("ratings", "tags"):
        gates[f"{k}_to_movies"] = Q.gate_coverage(clean[k], clean["movies"], "movieId", config.min_coverage)
    report("metadata_clean.json", {"created_at": files.now(), "retention": Q.retained(seen), "gates": gates, "schema_version": config.schema_version})

    train, test, cutoff = split(clean["ratings"], config)
    # Users' features and baskets are made from these in the buckets they are written in.
    train, test = save_by_user(train, "interactions_train"), save_by_user(test, "interactions_test")
    split_report = S.validate_split(train, test, config.split_policy == "per_user")
    report("split_report.json", split_report | {"policy": config.split_policy, "test_frac": config.test_frac})

    tags = save_by_user(S.tags_before(clean["tags"], cutoff), "tags_train")
    users = save(FE.user_features(train, clean["movies"], tags), "user_features_train")
    items = save(FE.item_features(train, clean["movies"], tags, config.min_tag_freq), "movie_features_train")
    options = {"like_threshold": config.like_threshold, "min_tag_freq": config.min_tag_freq}
    baskets = save(B.transactions(train, clean["movies"], tags, **options), "transactions_train")
    # Held-out baskets feed the stability gate of the mining run.
    save(B.transactions(test, clean["movies"], clean["tags"], **options), "transactions_test")
    coverage = {k: FE.feature_coverage(f, train, k).first().asDict() for k, f in (("userId", users), ("movieId", items))}
    phase = {"coverage": coverage, "baskets": baskets.count()}

    small = save(reduced(baskets, config), "transactions_train_reduced")
    stats = save(B.token_stats(baskets, small), "token_stats")
    files.write_csv(stats.orderBy("family", F.desc("df_before"), "token"), f"{run_dir}/tables/token_stats_csv")
    rates = B.basket_stats(baskets, small).first().asDict()
    report("basket_stats.json", rates)
    report("reduction_manifest.json", rates | {"removed_sample": [r.token for r in B.removed_vocabulary(stats).collect()], "config": config.__dict__})
    report("phase4_report.json", phase | {"reduction": rates})
    report("audit_report.json", {"run": run_dir.rsplit("/", 1)[-1].removeprefix("open_"), "created_at": files.now()} | audit(gates, split_report, coverage, rates, config, seen))


def audit(gates: dict, split_report: dict, coverage: dict, rates: dict, config: PipelineConfig, seen: dict | None = None) -> dict:
    """Four gates, all warnings, and the figures behind them by section."""
    checks = {
        "integrity": all(gates[k]["coverage"] >= config.min_coverage for k in ("ratings_to_movies", "tags_to_movies")),
        "split": split_report["overlap"] == 0 and split_report["train_rows"] > 0 and split_report["test_rows"] > 0,
        "features": all(c["coverage"] >= 0.99 for c in coverage.values()),
        "readiness": rates["after_baskets"] > 0 and rates["after_tokens"] > 0,
    }
    warnings = [w for part in (*gates.values(), split_report) for w in part.get("warnings", [])]
    of = lambda table, *names: {n: value_at(gates, table, n, default=0) for n in names}
    train, test = split_report["train_rows"], split_report["test_rows"]
    sections = {
        "counts": {
            "clean_tables": {k: m["n_rows"] for k, m in (seen or {}).items()}, "split": {"train_rows": train, "test_rows": test, "total_rows": train + test},
            "features": {k: {"train_keys": c["keys"], "covered": c["covered"]} for k, c in coverage.items()},
            "baskets": {k: v for k, v in rates.items() if k.endswith(("baskets", "tokens"))},
        },
        "join_coverage": {k: gates[k]["coverage"] for k in ("ratings_to_movies", "tags_to_movies")},
        "missingness": {
            "ratings": of("ratings", "user_nulls", "movie_nulls", "rating_nulls"), "movies": of("movies", "year_nulls", "no_genres"),
            "links": of("links", "imdb_missing", "tmdb_missing"),
        },
        "split_sanity": {k: v for k, v in split_report.items() if k not in ("train_rows", "test_rows", "warnings")},
        "feature_coverage": {k: c["coverage"] for k, c in coverage.items()},
    }
    passed = all(checks.values())
    summary = {"passed": passed, "warnings": len(warnings)}
    return {"schema_version": config.schema_version, "summary": summary, "gates": checks, "passed": passed, "warnings": warnings, **sections}


def validation_summary(reports: dict[str, dict]) -> dict:
    """Whether no table's report has an ``error``, and the errors and warnings by table."""
    errors = [{"table": t, "error": r["error"]} for t, r in reports.items() if "error" in r]
    warnings = [{"table": t, "warning": w} for t, r in reports.items() for w in r.get("warnings", [])]
    return {"all_validations_passed": not errors, "errors": errors, "warnings": warnings}


def value_at(report: dict, *path: str, default=None):
    """The value at a path of nested reports, the default where a step is missing."""
    for step in path:
        if not isinstance(report, dict) or step not in report:
            return default
        report = report[step]
    return report


def mine(
    baskets: DataFrame, config: MiningConfig, held_out: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df
) -> dict[str, DataFrame]:
    """``itemsets`` of up to ``max_len`` tokens, ``high`` ones and final ``rules`` of one token a side; above two tokens also ``set_rules`` of several.

    The movie-tag miner makes pairs only; without frequent tokens of both families there are none, which only ``run_mining`` refuses. ``stages`` are the rules before and after each gate that ran, ``profile`` counts baskets and tokens. ``keep``
    persists what is read several times.
    """
    own = B.to_tokens(B.controlled(baskets, config.mode, config.active_tops, config.active_caps))
    coded = I.coded(keep(own), config.low_support, keep)
    families = ("movie", "tag") if config.algorithm == "movie_tag" else None
    longest = min(config.max_len, 2) if families else config.max_len
    sets = I.frequent_sets(coded, config.low_support, longest, families)
    rules = keep(I.pair_rules(coded, config.low_support, config.min_confidence, config.min_lift, families))
    stages = {"candidates": rules}
    if config.gate1:
        rules = stages["gate1"] = M.gate_evidence(rules, config.gate1_min_ab, config.gate1_min_a, config.gate1_max_support_b)
    if config.gate2 and held_out is not None:
        test = B.to_tokens(B.controlled(held_out, config.mode, config.active_tops, config.active_caps))
        test = I.coded_by(test, coded.dictionary, keep)
        rules = stages["gate2"] = I.stable(rules, test, config.gate2_min_confidence, config.gate2_min_ratio, config.gate2_min_ab)
    if config.across:
        rules = M.across(rules, *config.across)
    found = {
        "itemsets": sets, "high": M.high_support(sets, config.high_support), "rules": M.ranked(rules), "stages": stages,
        "profile": _profile(baskets, own, coded), "dictionary": coded.dictionary,
    }
    if longest > 2:
        found["set_rules"] = I.set_rules(sets, coded.n, config.min_confidence, config.min_lift)
    return found


def need_families(dictionary: DataFrame, *families: str) -> None:
    """Raises unless each family has a frequent token."""
    kinds = {r.kind for r in dictionary.select(F.col("code").bitwiseAND(F.lit(3)).alias("kind")).distinct().collect()}
    if not {I.FAMILY_CODES[k] for k in families} <= kinds:
        raise ValueError(f"{' and '.join(families)} tokens are needed")


def _profile(baskets: DataFrame, own: DataFrame, coded: I.Coded) -> DataFrame:
    """Baskets and distinct tokens as given, in the mode, and kept: one row."""
    size = lambda df, name: df.agg(F.count_distinct("userId").alias(f"n_baskets_{name}"), F.count_distinct("token").alias(f"vocab_{name}"))
    kept = coded.n.withColumnRenamed("n", "n_baskets_kept").join(coded.dictionary.agg(F.count("*").alias("vocab_kept")))
    raw = baskets.agg(F.count("*").alias("n_baskets_raw")).join(size(B.to_tokens(baskets), "raw").select("vocab_raw"))
    return raw.join(size(own, "mode")).join(kept)


def _summary(label: str, source: str, config: MiningConfig, profile: dict, outputs: dict, types: dict, best: list) -> str:
    shown = {k: v for k, v in config.__dict__.items() if k not in ("tops", "caps")}
    shown |= {"limits_active": bool(config.active_tops), "caps_active": bool(config.active_caps)}
    shown |= {f"{name}_{k}": v for name, d in (("top", config.active_tops), ("cap", config.active_caps)) for k, v in d.items()}
    return "\n".join([
        f"# Mining run {label}", "", f"{files.now()}, baskets of `{source}`", "", "## Parameters", "", "| parameter | value |", "|---|---|",
        *(f"| {k} | {v} |" for k, v in shown.items()), "", "## Data", "", *(f"- {k}: {v:,}" for k, v in profile.items()), "", "## Results", "",
        *(f"- {k}: {v:,}" for k, v in outputs.items()), "", "### Rules by type", "", *(f"- {k}: {v:,}" for k, v in sorted(types.items())), "",
        "### The ten rules with the most lift", "", "| rule | support | confidence | lift |", "|---|---|---|---|",
        *(f"| {r.label} | {r.support:.4f} | {r.confidence:.3f} | {r.lift:.2f} |" for r in best), "",
    ])


def run_mining(spark: SparkSession, run_dir: str, out_dir: str, config: MiningConfig, reduced_input: bool = True, movies: DataFrame | None = None) -> str:
    """Mine a run's baskets into the preset's folder: itemsets, rules, readable rules, their index by token, manifest and summary.

    Full baskets are mined under the clamp.
    """
    config = config if reduced_input else clamp(config)
    source = files.baskets_path(run_dir, reduced_input)
    baskets = spark.read.parquet(source)
    test_path = files.baskets_path(run_dir, False, True)
    held_out = spark.read.parquet(test_path) if files.exists(spark, test_path) else None
    movies = movies if movies is not None else spark.read.parquet(f"{run_dir}/tables/dim_movies_clean")
    label = f"preset_{config.preset}_{config.mode}_{'reduced' if reduced_input else 'full'}"
    scope = Scope(spark, [source])
    try:
        with files.Run(spark, f"{out_dir}/{label}") as run:
            found = mine(baskets, config, held_out, scope.keep)
            if config.algorithm == "movie_tag":
                need_families(found["dictionary"], "movie", "tag")
            save = lambda df, name: files.write_table(df, f"{run.path}/tables/{name}")
            itemsets, rules = save(found["itemsets"], "frequent_itemsets"), save(found["rules"], "rules_with_evidence")
            exported = save(M.as_exported(rules), "association_rules")
            readable = save(P.readable(rules, movies), "rules_human_readable")
            seeds.write_index(exported, f"{run.path}/tables/rules_by_token")
            if "set_rules" in found:
                save(found["set_rules"], "set_rules")
            outputs = {
                "itemsets_low": itemsets.count(), "itemsets_high": M.high_support(itemsets, config.high_support).count(),
                **{f"rules_{k}": v.count() for k, v in found["stages"].items()}, "rules_final": exported.count(),
            }
            types = {r.rule_type: r.n for r in P.type_histogram(exported).collect()}
            profile = found["profile"].first().asDict()
            best = readable.orderBy(F.desc(F.round("lift", 9)), "antecedent", "consequent").limit(10).collect()
            active = {"tops": config.active_tops, "caps": config.active_caps}
            manifest = {
                "created_at": files.now(), "run": f"{label}/{run.final.rsplit('/', 1)[-1]}", "inputs": {"baskets": source, "held_out": test_path if held_out is not None else None} | profile,
                "parameters": config.__dict__, "active": active, "outputs": outputs, "types": types,
            }
            files.write_json(spark, f"{run.path}/reports/run_manifest.json", manifest)
            files.write_text(spark, f"{run.path}/reports/summary.md", _summary(label, source, config, profile, outputs, types, best))
    finally:
        scope.release()
    return run.final


def recommend_from(spark: SparkSession, mined_dir: str, run_dir: str, out_dir: str, seed: str | None = None, presets: str = "ABC", **options) -> str:
    """What the latest runs of three presets say to a seed movie: recommendations (A), tag DNA (B) and semantics of its genres (C), as tables and a page.

    Without a seed the first covered movie by title is taken. A seed that no rule of A covers has no recommendations, which the manifest says.
    """
    found = {p: files.preset_run(spark, [mined_dir], preset=p) for p in presets}
    if missing := sorted(p for p, at in found.items() if at is None):
        raise FileNotFoundError(f"no mining run of {missing} in {mined_dir}")
    index = [seeds.open_index(spark, f"{at}/tables/rules_by_token") for at in found.values()]
    rules_a, rules_c = (R.adapt_rules(spark.read.parquet(f"{found[p]}/tables/association_rules")) for p in (presets[0], presets[2]))
    movies = spark.read.parquet(f"{run_dir}/tables/dim_movies_clean")
    seed = seed or R.default_seed(R.seed_options(movies, rules_a), [])
    if seed is None:
        raise ValueError("no movie is the seed of a rule")
    index = [df.withColumn("rec_token", X.first_movie(F.col("consequent"))) for df in index]
    made = seeds.advice(*index, rules_c, movies, seed, **options)
    with files.Run(spark, out_dir) as run:
        saved = {k: files.write_table(v, f"{run.path}/tables/{k}") for k, v in made.items()}
        rows = {k: v.count() for k, v in saved.items()}
        covered = not seeds.of_token(index[0], seed).where(F.array_contains("antecedent", seed)).isEmpty()
        files.write_json(spark, f"{run.path}/reports/manifest.json", {"created_at": files.now(), "seed": seed, "covered": covered, "runs": found, "rows": rows, "options": options})
        best = saved["recommendations"].orderBy("rank").collect()  # k rows at most
        lines = [f"# For {seed}", "", *(f"{r.rank}. {r.rec_token_title or r.rec_token} (lift {r.lift:.2f}, {r.evidence_count} rules)" for r in best)]
        files.write_text(spark, f"{run.path}/reports/summary.md", "\n".join(lines) + "\n")
    return run.final


def export_evidence(spark: SparkSession, rules: DataFrame, movies: DataFrame, seed: str, out_dir: str, **options) -> str:
    """A seed's evidence as Parquet with a manifest and a page."""
    with files.Run(spark, out_dir) as run:
        n = files.write_table(R.rule_evidence(rules, movies, seed, **options), f"{run.path}/tables/rule_evidence").count()
        files.write_json(spark, f"{run.path}/reports/manifest.json", {"created_at": files.now(), "seed": seed, "rows": n, "options": options})
        files.write_text(spark, f"{run.path}/reports/summary.md", f"# Evidence for {seed}\n\n{n} rules\n")
    return run.final
