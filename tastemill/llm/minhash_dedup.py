"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct ``SHINGLE``-word shingles. ``PERMUTATIONS`` hash functions are evaluated once for each shingle and give
two values each, the smallest and the largest; groups of ``ROWS`` values are bands. Documents whose sets are equal are one class, told by a
digest, and classes that share a band are candidates.

Large buckets are not expanded into all their pairs. A few members of each bucket, the pivots, are compared with the others first;
links found unite groups, and only members of different groups are compared in the following rounds. The last round
compares all that are still in different groups, so that no candidate pair is left open. Pairs are screened inside the join by
a lower bound of their difference, which no linked pair exceeds, and by the share of equal min and max values, far below the threshold. They are then
confirmed on the full sets of 64-bit shingle hashes.

Null or word-less texts have an empty set and link with nothing; shorter texts than a shingle are one shingle. Rows that repeat a
``doc_id`` with another text are documents of their own, told apart by their texts. Rows with a null ``doc_id`` keep a null component and are kept. Other columns are ignored; an empty table
gives no rows. A pair at the threshold is missed as a candidate with a probability of about 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .components import connected
from .store import small_batches, written
from .words import as_long, hashed, lists, mix, ragged

SHINGLE, PERMUTATIONS, ROWS, PERCENT = 4, 100, 5, 80
SCREEN, PARITIES = 0.2, 1024
PIVOTS = (1, 2)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, and where each text's begin."""
    words, bounds = hashed(texts, lower=True)
    totals = np.diff(bounds)
    counts = np.where(totals >= width, totals - width + 1, np.minimum(totals, 1))
    at = ragged(bounds[:-1], counts)
    doc = np.repeat(np.arange(len(totals)), counts)
    length = np.minimum(totals, width)[doc]
    name = length.astype(np.uint64)
    for k in range(width):
        inside = length > k
        name = np.where(inside, mix(name + words[np.minimum(at + k, len(words) - 1)] + np.uint64(k)), name)
    order = np.lexsort((name, doc))
    name, doc = name[order], doc[order]
    first = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])] if len(name) else np.zeros(0, bool)
    name, doc = name[first], doc[first]
    return name, np.searchsorted(doc, np.arange(len(totals) + 1))


def min_max(name: np.ndarray, starts: np.ndarray, permutations: int) -> np.ndarray:
    """(sets, 2 * permutations): the smallest values of all permutations, then the largest. Sets must not be empty."""
    rng = np.random.default_rng(1)
    out = np.empty((len(starts), 2 * permutations), np.uint64)
    for k, (a, b) in enumerate(rng.integers(0, 1 << 63, (permutations, 2), dtype=np.uint64)):
        value = name * (a * np.uint64(2) + np.uint64(1)) + b
        value ^= value >> np.uint64(32)
        value *= MIXER
        out[:, k] = np.minimum.reduceat(value, starts)
        out[:, permutations + k] = np.maximum.reduceat(value, starts)
    return out


MIXER = np.uint64(0xD6E8FEB86659FD93)


def _signed(width: int, permutations: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, bounds = shingle_sets(batch.column("text"), width)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            values = min_max(name, bounds[:-1][full], permutations) if len(full) else np.zeros((0, 2 * permutations), np.uint64)
            banded = values.reshape(len(full), values.shape[1] // rows, rows)
            keys = np.broadcast_to(np.arange(banded.shape[1], dtype=np.uint64), banded.shape[:2]).copy()
            for r in range(rows):
                keys = mix(keys + banded[:, :, r] + np.uint64(r))
            nibbles = (mix(values) & np.uint64(15))[:, : values.shape[1] // 16 * 16].reshape(len(full), values.shape[1] // 16, 16)
            sketch = np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)
            doc = np.repeat(np.arange(len(full)), sizes[full])
            odd = np.bincount(doc * PARITIES + (name >> np.uint64(54)).astype(np.int64), minlength=len(full) * PARITIES) & 1
            odd = np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(len(full), PARITIES // 64)
            sketch = np.concatenate([sketch, odd], 1)
            digests = [None] * len(sizes)
            for j in full:
                digests[j] = xxhash.xxh3_128_digest(name[bounds[j] : bounds[j + 1]].tobytes())
            counts, longs = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            counts[full], longs[full] = keys.shape[1], sketch.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(sizes), pa.array(digests, pa.binary()), lists(sketch.ravel().view(np.int64), longs),
                 lists(keys.ravel().view(np.int64), counts)],
                ["doc_id", "version", "n_shingles", "digest", "sketch", "bands"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, bounds = shingle_sets(batch.column("text"), width)
            made = [name[bounds[i] : bounds[i + 1]].tobytes() for i in range(batch.num_rows)]
            digests = [xxhash.xxh3_128_digest(x) for x in made]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(made, pa.binary())], ["node", "members"])

    return run


def _alike(a: Column, b: Column, values: int) -> Column:
    """The share of equal values of two sketches, which hold four bits of each value, as estimated from these."""
    differ = F.lit(0)
    for i in range(values // 16):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(x)
    return 1 - differ / F.lit(values - values % 16) * F.lit(16 / 15)


@F.pandas_udf(LongType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: bytes, y: bytes) -> int:
        both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
        both.sort()
        return int((both[1:] == both[:-1]).sum())

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def _apart(a: Column, b: Column, values: int) -> Column:
    """A lower bound of the number of members that only one of two sets has: unequal parities of the members' hash classes."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(values // 16, values // 16 + PARITIES // 64)), F.lit(0))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b, a_n, b_n`` whose full sets are alike enough."""
    of_a, of_b = (sets.select(F.col("node").alias(x), F.col("members").alias(f"{x}_members")) for x in "ab")
    shared = pairs.join(of_a, "a").join(of_b, "b").withColumn("shared", _shared("a_members", "b_members"))
    total = F.col("a_n") + F.col("b_n") - F.col("shared")
    return shared.where(F.col("shared") * 100 >= total * percent).select("a", "b")


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, permutations: int = PERMUTATIONS, rows: int = ROWS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, version`` of each row; ``component_id`` is the smallest linked ``doc_id``.

    ``version`` is the text's ``xxhash64``, by which rows that repeat a ``doc_id`` are found again.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("version"))
    schema = "doc_id bigint, version bigint, n_shingles bigint, digest binary, sketch array<bigint>, bands array<bigint>"
    signed = written(texts.mapInArrow(_signed(width, permutations, rows), schema), "signatures")
    known = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "classes")
    nodes = known.join(classes, ["digest", "doc_id"]).select(F.col("digest").alias("node"), F.col("n_shingles").alias("n"), "sketch", "bands")
    nodes = written(nodes.dropDuplicates(["node"]), "nodes")
    banded = nodes.select(F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    buckets = nodes.select("node", F.explode("bands").alias("band")).join(shared.select("band").hint("merge"), "band", "left_semi")
    buckets = written(buckets.join(nodes, "node"), "buckets")
    wanted = buckets.select("node").distinct()
    first = classes.join(wanted.withColumnRenamed("node", "digest"), "digest", "left_semi")
    # Both sides are shuffled at every size, so that the work stays in proportion to the documents.
    sets = texts.join(first.select("doc_id").hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(width), "node binary, members binary")
    sets = written(sets.dropDuplicates(["node"]), "sets")

    found, tested = None, None
    active, groups = buckets.withColumn("component", F.col("node")), None
    for round_, pivots in enumerate((*PIVOTS, None)):
        if groups is not None:  # bands whose members are all of one group are done
            placed = written(active.drop("component").join(groups, "node"), "placed")
            mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
            active = written(placed.join(mixed.select("band"), "band", "left_semi"), "active")
        if pivots:
            slot = F.pmod(F.xxhash64("node", F.lit(round_)), F.lit(pivots)).alias("slot")
            row = F.struct(*(c for c in active.columns if c != "band"))
            others = active.groupBy("band", slot).agg(F.min_by(row, F.xxhash64("node", F.lit(-1 - round_))).alias("other"))
            others = others.select("band", "other.*")
        else:
            others = active
        other = others.select(*(F.col(c).alias(f"o_{c}") for c in others.columns))
        # Screened within the join, and emitted in the first band that both share.
        alike = (
            (F.col("component") != F.col("o_component") if pivots else F.col("component") < F.col("o_component"))
            & (F.least("n", "o_n") * 100 >= F.greatest("n", "o_n") * percent)
            & (_apart(F.col("sketch"), F.col("o_sketch"), 2 * permutations) * (100 + percent) <= (F.col("n") + F.col("o_n")) * (100 - percent))
            & (_alike(F.col("sketch"), F.col("o_sketch"), 2 * permutations) >= percent / 100 - SCREEN)
        )
        if not pivots:
            both = F.zip_with("bands", "o_bands", lambda x, y: x == y)
            alike = alike & (F.get("bands", F.array_position(both, F.lit(True)).cast("int") - 1) == F.col("band"))
        pairs = active.join(other, (F.col("band") == F.col("o_band")) & alike)
        low = F.col("node") < F.col("o_node")
        pairs = pairs.select(
            F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"),
            F.when(low, F.col("n")).otherwise(F.col("o_n")).alias("a_n"), F.when(low, F.col("o_n")).otherwise(F.col("n")).alias("b_n"),
        ).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        fresh = written(confirmed(pairs, sets, percent), "confirmed")
        found = fresh if found is None else found.unionByName(fresh)
        groups = wanted.join(connected(found).select("node", "component"), "node", "left").select(
            "node", F.coalesce("component", "node").alias("component")
        )
    placed = classes.join(groups.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "doc_id", F.coalesce("component", "digest").alias("component"))
    low = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = placed.join(low, "component").select("digest", "component_id")
    return signed.join(labels, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"), "version",
    )


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
  ELSE [array_to_string(words[i:i + 3], ' ') FOR i IN range(1, CAST(len(words) - 2 AS BIGINT))] END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
l AS (SELECT a, b FROM i WHERE 100 * c >= 80 * (an + bn - c)),
y AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS low FROM s),
t AS (WITH RECURSIVE q(id, low) AS (SELECT id, low FROM r UNION SELECT y.b, q.low FROM q JOIN y ON q.id = y.a WHERE q.low < y.b) SELECT id, min(low) AS low FROM q GROUP BY id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, t.low AS component_id, s.doc_id = t.low AS kept FROM s JOIN t ON s.doc_id = t.id
"""
