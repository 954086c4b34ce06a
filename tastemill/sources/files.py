"""Scans and sinks: typed CSV, staging, provenance, runs and reports."""

from __future__ import annotations

import datetime as dt
import json
import math
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .provenance import EMPTY, provenance

I, L, S, D = T.IntegerType(), T.LongType(), T.StringType(), T.FloatType()
#: Column types of the raw CSV files; every column is required.
RAW = {
    "movies": {"movieId": I, "title": S, "genres": S},
    "ratings": {"userId": I, "movieId": I, "rating": D, "timestamp": L},
    "tags": {"userId": I, "movieId": I, "tag": S, "timestamp": L},
    "links": {"movieId": I, "imdbId": L, "tmdbId": L},
    "genome-tags": {"tagId": I, "tag": S},
    "genome-scores": {"movieId": I, "tagId": I, "relevance": D},
}
OPTIONAL = ("genome-tags", "genome-scores")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _plain(x):
    if isinstance(x, dt.datetime | dt.date):
        return x.isoformat()
    if isinstance(x, float) and (math.isnan(x) or math.isinf(x)):
        return None
    raise TypeError(type(x).__name__)


def write_json(spark: SparkSession, path: str, report: dict) -> None:
    write_text(spark, path, json.dumps(report, indent=2, default=_plain, sort_keys=True))


def read_csv_strict(spark: SparkSession, path: str, kinds: dict[str, T.DataType]) -> DataFrame:
    """A headed CSV with declared types. A missing file or required column raises; other columns are kept as strings.

    The header is read first, because Spark binds a declared schema by position. Only tables with text columns are read with line breaks
    inside quotes, which makes a file one task; files of numbers alone are split.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    quoted = {"header": True, "quote": '"', "escape": '"', "multiLine": any(k == S for k in kinds.values())}
    header = spark.read.options(**quoted).csv(path).columns
    missing = sorted(set(kinds) - set(header))
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    schema = T.StructType([T.StructField(c, kinds.get(c, S)) for c in header])
    return spark.read.options(**quoted, mode="FAILFAST").schema(schema).csv(path)


def read_raw(spark: SparkSession, raw_dir: str, name: str) -> DataFrame | None:
    """One of the raw tables; an optional one that is absent is None."""
    path = f"{raw_dir}/{name}.csv"
    if name in OPTIONAL and not exists(spark, path):
        return None
    return read_csv_strict(spark, path, RAW[name])


def staged_name(name: str) -> str:
    return name.replace("-", "_") + "_raw"


def stage_raw(spark: SparkSession, raw_dir: str, staging_dir: str, force: bool = False) -> bool:
    """CSV to Parquet with provenance; False if the required tables are staged already."""
    required = [n for n in RAW if n not in OPTIONAL]
    if not force and all(exists(spark, f"{staging_dir}/{staged_name(n)}/_SUCCESS") for n in required):
        return False
    for name in RAW:
        df = read_raw(spark, raw_dir, name)
        if df is not None:
            df.write.mode("overwrite").parquet(f"{staging_dir}/{staged_name(name)}")
    write_json(spark, f"{staging_dir}/metadata_raw.json", raw_metadata(spark, raw_dir))
    return True


def read_staged(spark: SparkSession, staging_dir: str) -> dict[str, DataFrame | None]:
    missing = [n for n in RAW if n not in OPTIONAL and not exists(spark, f"{staging_dir}/{staged_name(n)}")]
    if missing:
        raise FileNotFoundError(f"not staged: {missing}")
    return {
        n: spark.read.parquet(p) if exists(spark, p := f"{staging_dir}/{staged_name(n)}") else None for n in RAW
    }


def file_provenance(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, sha256, rows`` of files; rows are physical lines less the header, 0 at least."""
    return provenance(spark, path).withColumnRenamed("size_bytes", "size")


def file_meta(spark: SparkSession, *paths: str) -> dict:
    """Size, SHA-256 and rows of a file of any size, of several by path; an absent one is ``{"missing": True}``."""
    there = [p for p in paths if exists(spark, p)]
    rows = {r.path.rsplit("/", 1)[-1]: r for r in provenance(spark, *there).collect()} if there else {}  # a row a file
    found = {p: {"missing": True} for p in paths}
    for p in there:
        r = rows.get(p.rsplit("/", 1)[-1])
        found[p] = {"size_bytes": r.size_bytes, "sha256": r.sha256, "rows": r.rows} if r else {"size_bytes": 0, "sha256": EMPTY, "rows": 0}
    return found if len(paths) > 1 else found[paths[0]]


def raw_metadata(spark: SparkSession, raw_dir: str) -> dict:
    found = file_meta(spark, *(f"{raw_dir}/{n}.csv" for n in RAW))
    return {"created_at": now(), "pipeline_version": git_version(), "files": {n: found[f"{raw_dir}/{n}.csv"] for n in RAW}}


def git_version() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=5, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def now() -> str:
    return dt.datetime.now(dt.UTC).isoformat()


def new_run(out_dir: str, tag: str | None = None) -> str:
    moment = dt.datetime.now(dt.UTC)
    return f"{out_dir}/{tag or moment.strftime('run_%Y%m%d_%H%M%S_') + f'{moment.microsecond // 1000:03d}'}"


def rows_in(spark: SparkSession, path: str) -> int:
    """Rows of a table by its footers; a partitioned one without rows has no files."""
    return spark.read.parquet(path).count() if any(n[:1] not in "_." for n in names_in(spark, path)) else 0


class Run:
    """A run's folder, open until all of it is written: ``with Run(...) as run`` writes to ``run.path``, and the end of the block makes it ``run.final``.

    The open folder's name is none that listings find. At the end a manifest with the rows of each table, from the Parquet footers, is added and the folder is
    renamed, at once where the file system can. A block that raises leaves nothing; what a killed driver leaves stays open and unlisted.
    """

    def __init__(self, spark: SparkSession, out_dir: str, tag: str | None = None):
        self.spark, self.final = spark, new_run(out_dir, tag)
        self.path = f"{out_dir}/open_{self.final.rsplit('/', 1)[-1]}"

    def __enter__(self) -> Run:
        return self

    def __exit__(self, kind, error, trace) -> None:
        fs, open_ = _fs(self.spark, self.path)
        if kind is not None:
            fs.delete(open_, True)
            return
        found = [n for n in names_in(self.spark, f"{self.path}/tables") if not n.endswith("_csv")]
        tables = {n: rows_in(self.spark, f"{self.path}/tables/{n}") for n in found}
        write_json(self.spark, f"{self.path}/manifest.json", {"created_at": now(), "pipeline_version": git_version(), "tables": tables})
        final = self.spark._jvm.org.apache.hadoop.fs.Path(self.final)
        fs.delete(final, True)  # a tag that is used again
        if not fs.rename(open_, final):
            raise OSError(f"{self.path} cannot become {self.final}")


def runs(spark: SparkSession, out_dir: str) -> list[str]:
    """Runs with generated names, oldest first; tagged and open ones are not listed."""
    return [n for n in names_in(spark, out_dir) if n.startswith("run_")]


def latest_run(spark: SparkSession, out_dir: str) -> str | None:
    found = runs(spark, out_dir)
    return f"{out_dir}/{found[-1]}" if found else None


def preset_run(spark: SparkSession, dirs: list[str], table: str = "association_rules", preset: str | None = None) -> str | None:
    """The latest run with a rules table in the first directory that has some, in itself or in its folders ``preset_<preset>_...``, of any preset if none is given."""
    for d in dirs:
        start = f"preset_{preset}_" if preset else "preset_"
        folders = [f"{d}/{n}" for n in names_in(spark, d) if n.startswith(start)] + ([] if preset else [d])
        found = [(n, f) for f in folders for n in runs(spark, f) if exists(spark, f"{f}/{n}/tables/{table}")]
        if found:
            name, folder = max(found)
            return f"{folder}/{name}"
    return None


def baskets_path(run_dir: str, reduced: bool = True, held_out: bool = False) -> str:
    return f"{run_dir}/tables/transactions_{'test' if held_out else 'train'}{'_reduced' if reduced else ''}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Bucketed:
    """Tables written in buckets of a key, so that what groups and joins by it reads them without a shuffle.

    Parquet files do not tell their buckets; Spark's catalogue does, so each table has a name there until ``forget``, which leaves the files.
    """

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, df: DataFrame, path: str, key: str) -> DataFrame:
        """``df`` at ``path``, a file a bucket, sorted by ``key``: the one shuffle by it."""
        name = self._name()
        rows = df.repartition(self.buckets, key).sortWithinPartitions(key)
        rows.write.mode("overwrite").format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def read(self, path: str, key: str) -> DataFrame:
        """A table that ``write`` left at ``path``, in this or another session."""
        columns = ", ".join(f"`{n}` {k}" for n, k in self.spark.read.parquet(path).dtypes)
        name = self._name()
        place = path.replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return self.spark.table(name)

    def _name(self) -> str:
        self.names.append(f"tastemill_{uuid.uuid4().hex}")
        return self.names[-1]

    def forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []


def write_csv(df: DataFrame, path: str) -> None:
    """One file; only the writing is one task, not the work before it."""
    df.repartition(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def checklist(spark: SparkSession, run_dir: str, tables: list[str], reports: list[str]) -> dict[str, int | bool]:
    """Rows of each table that reads back (-1: missing) and whether each report is there."""
    found: dict[str, int | bool] = {}
    for t in tables:
        path = f"{run_dir}/tables/{t}"
        found[t] = spark.read.parquet(path).count() if exists(spark, path) else -1
    return found | {r: exists(spark, f"{run_dir}/reports/{r}") for r in reports}


def load_config(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
