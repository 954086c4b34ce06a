"""Sizes, digests and line counts of raw files, taken in tasks: no byte of a file passes the driver, and files may have any size.

Spark reads a file's lines in splits. Each task joins the lines of a batch to one chunk with the chunk's place; a file's chunks meet in one task, sorted by
Spark, and are streamed through the digest. What a line reader leaves out is told by the file's size: the last line's end, and a byte order mark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK, EMPTY = b"\xef\xbb\xbf", hashlib.sha256(b"").hexdigest()
# Endings of files that Spark's line reader would unpack.
PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")
WAYS = ("open", "closed", "marked_open", "marked_closed")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = 0
    for batch in batches:
        keys = list(zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True))
        lines = batch.column("line").to_pylist()
        bounds = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]] + [len(keys)]
        rows = [(*keys[a], at + a, b"\n".join(lines[a:b]), b - a) for a, b in zip(bounds, bounds[1:], strict=False) if a < b]
        at += len(keys)
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", "start", "place", "chunk", "lines"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, plain, marked, lines, size = None, None, None, 0, 0

    def row() -> pa.RecordBatch:
        ways = []
        for digest in (plain, marked):
            closed = digest.copy()
            closed.update(b"\n")
            ways += [digest.hexdigest(), closed.hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (path, lines, size, *ways)], ["path", "lines", "bytes", *WAYS])

    for batch in batches:
        for now, chunk, n in zip(*(batch.column(c).to_pylist() for c in ("path", "chunk", "lines")), strict=True):
            if now != path:
                if path is not None:
                    yield row()
                path, plain, marked, lines, size = now, hashlib.sha256(), hashlib.sha256(MARK), 0, 0
            else:
                chunk = b"\n" + chunk
            plain.update(chunk)
            marked.update(chunk)
            lines, size = lines + n, size + len(chunk)
    if path is not None:
        yield row()


def provenance(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, size_bytes, sha256, rows`` of each file; rows are physical lines less the header, 0 at least.

    Missing paths and packed files raise; Spark's scans leave out files without a byte.
    """
    packed = [p for p in paths if p.endswith(PACKED)]
    if packed:
        raise ValueError(f"a packed file's lines are not its bytes: {packed}")
    meta = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size_bytes"))
    files = spark.read.format("binaryFile").load(list(paths)).select(*meta)
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    chunks = lines.mapInArrow(_chunks, "path string, start bigint, place bigint, chunk binary, lines bigint")
    whole = chunks.repartition("path").sortWithinPartitions("path", "start", "place")
    schema = "path string, lines bigint, bytes bigint, " + ", ".join(f"{w} string" for w in WAYS)
    found = files.join(whole.mapInArrow(_streamed, schema), "path", "left")
    over = F.col("size_bytes") - F.col("bytes")
    digest = F.when(F.col("size_bytes") == 0, EMPTY)
    for n, way in ((0, "open"), (1, "closed"), (len(MARK), "marked_open"), (len(MARK) + 1, "marked_closed")):
        digest = digest.when(over == n, F.col(way))
    odd = F.raise_error(F.concat(F.lit("the file changed while it was read: "), "path"))
    return found.select("path", "size_bytes", F.coalesce(digest, odd).alias("sha256"), F.greatest(F.coalesce("lines", F.lit(0)) - 1, F.lit(0)).alias("rows"))
