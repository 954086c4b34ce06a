"""Near-duplicate documents by SimHash fingerprints that meet in codewords of the binary Golay code.

A fingerprint bit is set if it is set in more than half of the document's ``SHINGLE``-word shingles' 64-bit hashes, repeats included. Rows with equal
fingerprints are one node, and nodes link at ``ERRORS`` or fewer differing bits.

The fingerprint's three segments are words of the perfect (23, 12) Golay code, padded with zeros: a word has one codeword within three bits,
and up to five more at four bits. Words that differ in at most two bits have one codeword in common among those within four bits, as each is within
one bit of a word between them, which has a codeword within three. So a segment decodes to several keys, and a key joins one segment's own bits with
a codeword of another segment. With at most four differing bits one of two cases holds:

* a segment is equal, and of the two others one differs in at most two bits: the two nodes share the first's bits and one of the second's codewords;
* all three differ, so that two segments differ in one bit each: one node has every word that is one bit off its first segment as a key, with
  the second segment's nearest codeword, which is within four bits of the other node's.

A node has 32 keys of the first kind on average and 64 of the second; keys have 34 bits, and keys that no two nodes share go at once. Then
nodes of a key are compared with a few of them, the pivots, first. Links unite groups, and only nodes of different groups are compared
further; the last round compares all that are left, so that no candidate pair is left open.

A text with fewer words than a shingle is one shingle. Null or word-less texts have the fingerprint zero and link like others. Rows that repeat a
``doc_id`` with another text are documents of their own. Rows with a null ``doc_id`` get a fingerprint, link nothing and have a null component. Other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .store import small_batches, written

SHINGLE, SEED, ERRORS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR, CHECKS, LENGTH, RADIUS = 0xC75, 11, 23, 4
PIVOTS = (4,)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    several = min(width, len(words))
    starts, ends = starts[: len(words) - several + 1].tolist(), ends[several - 1 :].tolist()
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 14):
        part = slice(at, at + (1 << 14))
        found = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[part], ends[part], strict=True)], "<u8")
        set_ += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x.as_py(), width) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "print"])

    return run


@lru_cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The remainder of each power of x, and by remainder the error patterns within the radius (lightest first) and how many there are."""
    powers = [1]
    while len(powers) < LENGTH:
        up = powers[-1] << 1
        powers.append(up ^ GENERATOR if up >> CHECKS & 1 else up)
    patterns, counts = np.zeros((1 << CHECKS, 6), np.int64), np.zeros(1 << CHECKS, np.int64)
    for weight in range(RADIUS + 1):
        for bits in combinations(range(LENGTH), weight):
            rest = 0
            for b in bits:
                rest ^= powers[b]
            patterns[rest, counts[rest]] = sum(1 << b for b in bits)
            counts[rest] += 1
    return np.array(powers), patterns, counts


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within the radius of each 23-bit word, the nearest first, and how many there are."""
    powers, patterns, counts = golay()
    rest = np.zeros(len(words), np.int64)
    for b in range(LENGTH):
        rest ^= np.where(words >> b & 1, powers[b], 0)
    return (words[:, None] ^ patterns[rest]) >> CHECKS, counts[rest]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 64-bit fingerprints: row numbers, keys, and whether the key is of the node's own bits (not of bits one off)."""
    own = [(prints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    near = [codewords(x) for x in own]
    row, key, home = [], [], []
    every = np.arange(len(prints))
    for i in range(3):
        for j in range(3):
            table = (3 * i + j) << 34
            if i != j:
                inside = np.arange(6) < near[j][1][:, None]
                row.append(np.repeat(every, near[j][1]))
                key.append((table | own[i][:, None] << 12 | near[j][0])[inside])
                home.append(np.ones(len(key[-1]), bool))
            if j == (i + 1) % 3:
                off = own[i][:, None] ^ (1 << np.arange(SEGMENTS[i][1]))
                row.append(np.repeat(every, off.shape[1]))
                key.append((table | off << 12 | near[j][0][:, :1]).ravel())
                home.append(np.zeros(len(key[-1]), bool))
    return np.concatenate(row), np.concatenate(key), np.concatenate(home)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy()
        row, key, home = keys(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(prints[row]), pa.array(key), pa.array(home)], ["print", "key", "home"])


def links(nodes: DataFrame, errors: int = ERRORS) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints within ``errors`` bits whose connected groups are those of all such pairs."""
    if errors > ERRORS:
        raise ValueError(f"the keys cover {ERRORS} differing bits, not {errors}")
    # A node makes about a hundred rows: small files of nodes are dealt to all tasks first.
    dealt = nodes.select("print").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = dealt.mapInArrow(_keyed, "print bigint, key bigint, home boolean")
    # A node has a key once. Both sides are shuffled at every size, so that the work stays in proportion to the nodes.
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("met")).where("met AND n > 1").select("key")
    buckets = written(keyed.join(shared.hint("merge"), "key", "left_semi"), "buckets")
    known = buckets.select("print").distinct()
    active, groups, found = buckets.withColumn("component", F.col("print")), None, None
    for round_, pivots in enumerate((*PIVOTS, None)):
        if groups is not None:  # keys whose nodes are all of one group are done
            placed = written(active.drop("component").join(groups, "print"), "placed")
            mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
            active = written(placed.join(mixed.select("key"), "key", "left_semi"), "active")
        others = active.where("home")
        if pivots:
            slot = F.pmod(F.xxhash64("print", F.lit(round_)), F.lit(pivots)).alias("slot")
            others = others.groupBy("key", slot).agg(F.min_by(F.struct("print", "component"), F.xxhash64("print", F.lit(-1 - round_))).alias("other"))
            others = others.select("key", "other.*")
        others = others.toDF(*(f"o_{c}" if c != "key" else c for c in others.columns))
        near = (F.col("component") != F.col("o_component")) & (F.bit_count(F.col("print").bitwiseXOR(F.col("o_print"))) <= errors)
        met = active.alias("a").join(others.alias("o"), (F.col("a.key") == F.col("o.key")) & near)
        fresh = written(met.select(F.least("print", "o_print").alias("a"), F.greatest("print", "o_print").alias("b")).distinct(), "found")
        found = fresh if found is None else found.unionByName(fresh)
        if pivots:
            groups = known.join(connected(found).withColumnRenamed("node", "print"), "print", "left").select(
                "print", F.coalesce("component", "print").alias("component")
            )
    return found


def near_duplicates(docs: DataFrame, width: int = SHINGLE, errors: int = ERRORS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row; ``component_id`` is the smallest linked ``doc_id``."""
    small_batches(docs.sparkSession)
    made = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_fingerprints(width), "doc_id bigint, print bigint")
    made = written(made, "fingerprints")
    nodes = written(made.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("low")), "prints")
    groups = connected(links(nodes, errors)).withColumnRenamed("node", "print")
    placed = nodes.join(groups, "print", "left").select("print", "low", F.coalesce("component", "print").alias("component"))
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    labels = placed.join(lowest, "component").select("print", "component_id")
    return made.join(labels, "print", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
