"""Substring dedup by recompression.

Each document's words are symbols. In every round each symbol is on the left or right side of that round, by a hash of its
name, and a left symbol followed by a right one becomes one symbol whose name is made from the two. Names are 64-bit hashes of
what they stand for, so equal substrings get equal interior symbols in all documents without a dictionary. A run of a symbol keeps
that symbol's name whatever its length, so that windows inside runs of different length share it.

Every symbol carries its context: the words that determine that it occurs. A window of ``WINDOW`` words is served by one symbol of
the highest level whose context lies inside it, the same wherever the window occurs. Spark finds the serving symbols (named with
their context) that several documents share; only windows they serve are hashed themselves, and the smallest document of
each window decides. Equal windows are told by 64-bit hashes of their words, among those that such symbols serve.

Words are ``[^\\x20\\x09-\\x0D]+`` of whole texts. A word goes if a window that covers it also starts in a document with a smaller
``doc_id``; windows are those of the input. Of equal texts only the first is searched; the others lose all their words. Null and empty texts have no words. Documents of under ``WINDOW`` words keep all. Rows
that share a ``doc_id`` don't remove from each other, and each loses only what its own text repeats; rows with a null ``doc_id`` neither lose words nor make others
lose them. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .words import BASE, BASE_INVERSE, as_long, hashed, mix, ragged, split

WINDOW, ROUNDS = 13, 3
FAR = np.int32(1 << 30)
NONE = np.uint64((1 << 64) - 1)


def levels(symbols: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each level the names and the contexts [from, to) of its symbols, in order."""
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    low = np.arange(len(symbols), dtype=np.int32)
    high = low + np.int32(1)
    found = [(symbols, low, high)]
    for r in range(1, ROUNDS + 1):
        if not len(symbols):
            break
        right = (mix(symbols + np.uint64(r)) >> np.uint64(63)).astype(bool)
        same = doc[1:] == doc[:-1]
        joins = np.r_[~right[:-1] & right[1:] & same, False]
        joined = np.r_[False, joins[:-1]]
        next_low, next_high = np.r_[np.where(same, low[1:], -FAR), -FAR], np.r_[np.where(same, high[1:], FAR), FAR]
        last_low, last_high = np.r_[-FAR, np.where(same, low[:-1], -FAR)], np.r_[FAR, np.where(same, high[:-1], FAR)]
        new_low = np.minimum(low, np.where(right, last_low, np.where(next_high < FAR, next_low, low)))
        new_high = np.maximum(high, np.where(right, np.where(last_low > -FAR, last_high, high), next_high))
        pair = np.r_[mix(symbols[:-1] * np.uint64(3) + np.uint64(1)) ^ mix(symbols[1:] + np.uint64(r << 8)), symbols[-1:]]
        kept = ~joined
        symbols = np.where(joins, mix(pair), symbols)[kept]
        low, high, doc = new_low[kept], new_high[kept], doc[kept]
        found.append((symbols, low, high))
    return found


def serving(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each window and the name of the symbol, with its context, that serves the window.

    Of the symbols of the highest level that has any in the window, that is the one whose name is smallest.
    """
    n = len(symbols)
    lengths = np.maximum(np.diff(bounds) - WINDOW + 1, 0)
    windows = ragged(bounds[:-1], lengths)
    doc_start, doc_end = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE_INVERSE)])
    prefix = np.r_[np.uint64(0), np.cumsum(symbols * power[:-1])]
    best = np.full(n, NONE)
    open_ = np.zeros(n, bool)
    open_[windows] = True
    for r, (_, low, high) in reversed(list(enumerate(levels(symbols, bounds)))):
        fits = (low >= 0) & (high < FAR) & (high - low <= WINDOW)
        low, high = low[fits], high[fits]
        names = mix((prefix[high] - prefix[low]) * inverse[low] + np.uint64(r)) >> np.uint64(1)
        first = np.maximum(high - WINDOW, doc_start[low])
        last = np.minimum(low, doc_end[low] - WINDOW)
        counts = np.r_[0, np.cumsum(open_)]
        used = last >= first
        used[used] = counts[last[used] + 1] > counts[first[used]]
        names, first, last = names[used], first[used], last[used]
        level = np.full(n, NONE)
        for k in range(WINDOW):
            inside = first + k <= last
            names, first, last = names[inside], first[inside], last[inside]
            np.minimum.at(level, first + k, names)
        best = np.where(open_, level, best)
        open_ &= best == NONE
        if not open_.any():
            break
    return windows, best[windows]


def _covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    return np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1))[:n] > 0


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known = batch.filter(pc.and_not(batch.column("doc_id").is_valid(), pc.fill_null(batch.column("copy"), False)))
        symbols, bounds = hashed(known.column("text"))
        at, names = serving(symbols, bounds)
        doc = np.searchsorted(bounds, at, side="right") - 1
        _, once = np.unique(mix(names) ^ mix(doc.astype(np.uint64)), return_index=True)
        once.sort()
        ids = known.column("doc_id").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([as_long(names[once]), pa.array(ids[doc[once]])], ["name", "doc_id"])


def _tags(texts: pa.Array) -> np.ndarray:
    """31 bits that tell rows of one ``doc_id`` apart."""
    return np.array([xxhash.xxh3_64_intdigest(x or b"") >> 33 for x in texts.cast(pa.binary()).to_pylist()], np.int64)


def _windows(role: str):
    """The windows that the symbols listed in column ``role`` serve; ``at`` is the first word with the row's tag above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(role).is_valid())
            symbols, bounds = hashed(batch.column("text"))
            at, served = serving(symbols, bounds)
            doc = np.searchsorted(bounds, at, side="right") - 1
            held = batch.column(role)
            counts = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(len(counts)), counts).astype(np.uint64)
            alive = mix(held.flatten().to_numpy().view(np.uint64)) ^ mix(of)
            good = np.isin(mix(served) ^ mix(doc.astype(np.uint64)), alive)
            at, doc = at[good], doc[good]
            name = np.zeros(len(at), np.uint64)
            for k in range(WINDOW):
                name = mix(name + symbols[at + k] + np.uint64(k))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [as_long(name), pa.array(ids[doc]), pa.array(_tags(batch.column("text"))[doc] << 32 | at - bounds[doc])], ["name", "doc_id", "at"]
            )

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, bounds, words = split(batch.column("text"))
        held = batch.column("starts")
        counts = np.nan_to_num(held.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        at = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        own = at >> 32 == np.repeat(_tags(batch.column("text")), counts)
        at = ((at & 0xFFFFFFFF) + np.repeat(bounds[:-1], counts))[own]
        gone = _covered(at, at + WINDOW, len(codes)) if len(codes) else np.zeros(0, bool)
        totals = np.diff(bounds)
        copy = pc.fill_null(batch.column("copy"), False).to_numpy(zero_copy_only=False) & (totals >= WINDOW)
        gone |= np.repeat(copy, totals)
        kept_bounds = np.r_[0, np.cumsum(~gone)][bounds]
        kept = words.cast(pa.string()).take(pa.array(codes[~gone]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_bounds.astype(np.int32)), kept), " ")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(totals), pa.array(totals - np.diff(kept_bounds)), joined],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``; ``kept`` joins the words that stay by one space."""
    small_batches(docs.sparkSession)
    # One shuffle of the texts serves all passes over them; left joins keep its uses alike, so that Spark reuses it.
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").repartition("doc_id")
    digests = docs.select(F.col("doc_id").cast("bigint"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = digests.join(first, "digest").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("digest").alias("copies"))
    same = F.array_contains("copies", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    marked = texts.join(copies, "doc_id", "left").select("doc_id", "text", F.when(F.col("copies").isNotNull(), same).alias("copy"))
    anchors = marked.mapInArrow(_anchors, "name bigint, doc_id bigint")
    shared = anchors.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    # The last document that holds a symbol has no later one to take words from, the first has none before it.
    per_doc = anchors.join(shared, "name").groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("doc_id") < F.col("high"), F.col("name"))).alias("sources"),
        F.collect_list(F.when(F.col("doc_id") > F.col("low"), F.col("name"))).alias("targets"),
    )
    served = texts.join(per_doc, "doc_id", "left").select("doc_id", "text", "sources", "targets")
    schema = "name bigint, doc_id bigint, at bigint"
    owners = served.drop("targets").mapInArrow(_windows("sources"), schema).groupBy("name").agg(F.min("doc_id").alias("low"))
    targets = served.drop("sources").mapInArrow(_windows("targets"), schema)
    starts = targets.join(owners, "name").where("doc_id > low").groupBy("doc_id").agg(F.collect_list("at").alias("starts"))
    return marked.join(starts, "doc_id", "left").select("doc_id", "text", "copy", "starts").mapInArrow(
        _removed, "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    )


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, CAST(len(words) - 11 AS BIGINT))) AS pos FROM w WHERE len(words) >= 13),
g AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS k FROM p),
m AS (SELECT k, min(doc_id) AS low FROM g GROUP BY k),
r AS (SELECT DISTINCT g.doc_id, unnest(range(g.pos, g.pos + 13)) AS pos FROM g JOIN m ON g.k = m.k WHERE g.doc_id > m.low),
s AS (SELECT doc_id, list(pos) AS gone FROM r GROUP BY doc_id),
f AS (SELECT w.doc_id, w.words, coalesce(s.gone, []) AS gone FROM w LEFT JOIN s ON w.doc_id = s.doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string([words[i] FOR i IN range(1, CAST(len(words) + 1 AS BIGINT)) IF NOT list_contains(gone, i)], ' ')) AS kept_sha256
FROM f
"""
