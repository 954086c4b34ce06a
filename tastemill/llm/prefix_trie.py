"""The trie of conversation prefixes, as the Cartesian tree over the LCP array of the sorted conversations.

A turn's symbol is half the SHA-256 of its role and text. Distinct conversations, with the number of their copies and the smallest conv_id, are
sorted by their symbols over many tasks, a block a task; ``lcp`` is the number of turns that a conversation shares with the one before.

A node of depth d spans the conversations between two values of ``lcp`` smaller than d. Each value with its nearest smaller ones to both sides is a
node where some conversations part; equal values with the same bounds are one node, and depths between a node and its parent, which no
value has, are added with the same span. What a node needs is a sum over its span, taken as a difference of running sums, or a minimum.

Blocks are worked on in parallel. Nearest smaller values inside a block come from one pass over it. A span that leaves its block at depth d goes on
through the blocks whose smallest value is not below d; so each block gives, beside its closed nodes, its parts of spans that are open to the left
(depths up to the value at its border) and the spans it opens to the right (depths above its smallest value, up to the next border's). A part
belongs to the last block before it that opened its depth, and parts are summed. There are at most two rows a block and depth of these.

Copies are not expanded: they are counted, and the digest of their ids is taken over lists of at most 65,536 ids that are streamed in order
through one hash, so that no group of copies is held at once. A conversation itself is a unit: one task holds its symbols and sizes, 24 bytes a turn.

Rows with a null conv_id take no part. Turns are ordered by turn, null first; rows with equal turns by role and text. Null roles and texts are
empty; repeated rows are turns of their own; other columns are ignored. An empty table has no members and gives no rows. ``c % 5`` is the
remainder with the sign of ``c``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .words import ragged

HEADS, SHARED, BLOCK_TURNS, ID_BITS = 9, 5, 500_000, 16
NOTHING = hashlib.sha256(b"").hexdigest()

SORTED = "block int, pos bigint, name string, weight bigint, low bigint, lcp bigint, bytes array<bigint>, first array<binary>, last array<binary>"
PARTS = "block int, kind int, depth bigint, low bigint, weight bigint, weighted bigint, fresh bigint, base bigint, n_leaves bigint, n_children bigint, name string, parent_low bigint, parent_kind int"
CLOSED, LEFT, RIGHT = 0, 1, 2


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its five."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS)).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` with the symbol and size of each turn, conversations with shared heads put in."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    turn = F.struct(at.alias("at"), F.unhex(F.substring(said, 1, 32)).alias("symbol"), F.octet_length("text").cast("bigint").alias("bytes"))
    whole = rows.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: t.dropFields("at")).alias("turns"))
    heads = whole.where(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, HEADS - 1).alias("head"))
    own = whole.withColumn("first", F.col("conv_id") - F.col("conv_id") % SHARED).withColumn("n", head_turns(F.col("conv_id")))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("n"))
    rest = F.slice("turns", F.col("n") + 1, F.greatest(F.size("turns") - F.col("n"), F.lit(0)))
    return own.join(heads, "first", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each name's lists of ids, which come in order, joined by commas."""
    name, state = None, None
    for batch in batches:
        names, found = [], []
        for now, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if now != name:
                if name is not None:
                    names.append(name)
                    found.append(state.hexdigest())
                name, state = now, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], ["name", "ends_sha256"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], ["name", "ends_sha256"])


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two 64-bit halves of all symbols, and where each conversation's begin."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(bounds[0], bounds[-1] - bounds[0])
    data = np.frombuffer(b"".join(values.to_pylist()), np.uint64) if len(values) else np.zeros(0, np.uint64)
    return data.reshape(-1, 2), bounds - bounds[0]


def _common(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of first symbols that each conversation but the first shares with the one before."""
    sizes = np.diff(bounds)
    both = np.minimum(sizes[1:], sizes[:-1])
    differs = (symbols[ragged(bounds[:-2], both)] != symbols[ragged(bounds[1:-1], both)]).any(1)
    pair, starts = np.repeat(np.arange(len(both)), both), np.r_[0, np.cumsum(both)][:-1]
    bad = np.flatnonzero(differs)
    out = both.copy()
    which, first = np.unique(pair[bad], return_index=True)
    out[which] = bad[first] - starts[which]
    return out


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of a sorted partition with their ``lcp``; at the end a row of position -1 with the first and the last key."""
    block, pos, first, last = TaskContext.get().partitionId(), 0, None, None
    kind = pa.list_(pa.binary())
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key")
        if last is not None:
            keys = pa.concat_arrays([pa.array([last], keys.type), keys])
        lcp = _common(*_symbols(keys))
        if last is None:
            first, lcp = keys[0].as_py(), np.r_[np.int64(-1), lcp]
        last = keys[-1].as_py()
        n = batch.num_rows
        none = pa.nulls(n, kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block, np.int32)), pa.array(np.arange(pos, pos + n)), batch.column("name"), batch.column("weight"), batch.column("low"),
             pa.array(lcp), batch.column("bytes"), none, none], ["block", "pos", "name", "weight", "low", "lcp", "bytes", "first", "last"],
        )
        pos += n
    if last is not None:
        row = {"block": block, "pos": -1, "name": None, "weight": None, "low": None, "lcp": None, "bytes": None, "first": first, "last": last}
        types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), kind, kind]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))


def nearest_smaller(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest smaller value's place before (-1: none) and after (the number of values: none) each."""
    before, after, open_ = [-1] * len(values), [len(values)] * len(values), []
    for i, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            after[open_.pop()] = i
        # An equal value has the same bounds: it takes the place of the one before, which ends where it ends.
        before[i] = open_[-1] if open_ and values[open_[-1]] < v else before[open_[-1]] if open_ else -1
        open_.append(i)
    return np.array(before), np.array(after)


class _Minima:
    """Minima of ranges, from minima of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            step, below = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(below[:-step], below[step:]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out, level = np.empty(len(start), np.int64), np.frexp(end - start)[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][start[at]], self.levels[k][end[at] - (1 << k)])
        return out


def _nodes(table: pa.Table) -> pa.Table:
    """The closed nodes of a block and its parts of open ones."""
    table = table.combine_chunks().sort_by("pos")
    n = table.num_rows
    block, left, right = (table.column(c)[0].as_py() for c in ("block", "border", "next_border"))
    column = lambda c: table.column(c).to_numpy()
    weight, low = column("weight"), column("low")
    lcp = np.r_[left, column("lcp")[1:], right].astype(np.int64)
    sizes = table.column("bytes").combine_chunks()
    bounds = sizes.offsets.to_numpy().astype(np.int64)
    values = sizes.values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy()
    bounds = bounds - bounds[0]
    turns = np.diff(bounds)
    running = np.r_[0, np.cumsum(values)]

    def until(i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Bytes of the first turns of conversation i."""
        return running[bounds[i] + np.maximum(depth, 0)] - running[bounds[i]]

    every = np.arange(n)
    size = until(every, turns)
    sums = lambda x: np.r_[0, np.cumsum(x)]
    weights, weighted, leaves = sums(weight), sums(weight * size), sums(lcp[1:] < turns)
    fresh = sums(size - until(every, lcp[:-1]))
    minima = _Minima(low)
    before, after = nearest_smaller(lcp.tolist())

    # Equal values with the same bounds are one group. The border's own value counts as a part of the next block.
    wide = int(lcp.max()) + 2
    label = (before + 1) * wide + lcp + 1
    groups, which, members = np.unique(label[:n], return_index=True, return_counts=True)

    def parted(start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """How many conversations part from the one before at this depth inside the span."""
        if not len(groups):
            return np.zeros(len(start), np.int64)
        at = np.minimum(np.searchsorted(groups, (start + 1) * wide + depth + 1), len(groups) - 1)
        return np.where(groups[at] == (start + 1) * wide + depth + 1, members[at], 0)

    out = []

    def give(kind, depth, start, end, own, base, children, named, parent_low, parent_kind):
        """Rows of spans; ``own``: new bytes of the first conversation of the span, from this depth on."""
        rest = fresh[end] - fresh[np.minimum(start + 1, end)]
        out.append(pa.table({
            "block": np.full(len(depth), block, np.int32), "kind": np.full(len(depth), kind, np.int32), "depth": depth,
            "low": minima.of(start, end), "weight": weights[end] - weights[start], "weighted": weighted[end] - weighted[start],
            "fresh": own + rest, "base": base, "n_leaves": leaves[end] - leaves[start], "n_children": children,
            "name": pc.if_else(pa.array(named), table.column("name").take(pa.array(start)), None),
            "parent_low": pa.array(parent_low, mask=parent_kind != CLOSED), "parent_kind": parent_kind.astype(np.int32),
        }))

    def chains(start: np.ndarray, end: np.ndarray, top: np.ndarray, at_top: np.ndarray) -> None:
        """Closed spans at all depths between a parent's and ``top``; only the topmost branches or ends."""
        floor = np.maximum(lcp[start], lcp[end])
        full = np.flatnonzero(top > floor)
        start, end, top, at_top, floor = (x[full] for x in (start, end, top, at_top, floor))
        length = top - floor
        of = np.repeat(np.arange(len(start)), length)
        depth = ragged(floor + 1, length)
        s, e, bottom = start[of], end[of], depth == floor[of] + 1
        base = until(s, depth - 1)
        # The parent of the lowest depth is the group of the larger border; other depths have the same span as their parent.
        border = np.where(lcp[e] >= lcp[s], e, s)
        kind = np.where(~bottom, CLOSED, np.where(before[border] < 0, LEFT, np.where(after[border] > n, RIGHT, CLOSED)))
        known = minima.of(s, e)
        over = bottom & (kind == CLOSED) & (depth > 0)
        known[over] = minima.of(before[border[over]], after[border[over]])
        kind = np.where(depth == 0, -1, kind)
        children = np.where(depth == top[of], at_top[of], 1)
        give(CLOSED, depth, s, e, size[s] - base, base, children, turns[s] == depth, known, kind)

    inner = which[(before[which] >= 0) & (after[which] <= n)]
    starts = before[inner]
    chains(starts, after[inner], lcp[inner], parted(starts, lcp[inner]) + (turns[starts] > lcp[inner]))
    chains(every, every + 1, turns, np.zeros(n, np.int64))

    depth = np.arange(left + 1)  # open to the left: up to the first smaller value
    if len(depth):
        least = np.minimum.accumulate(lcp[:n])
        end = np.searchsorted(-least, -depth, "right")
        none = np.zeros(len(depth), np.int64)
        give(LEFT, depth, none, end, fresh[np.minimum(1, end)] - fresh[0] + none, none, parted(none - 1, depth), none.astype(bool), none, none - 1)
    smallest = int(lcp[:n].min())
    depth = np.arange(smallest + 1, right + 1)  # opened here and open to the right: from the last smaller value
    if len(depth):
        ahead = np.minimum.accumulate(lcp[:n][::-1])[::-1]
        start = np.searchsorted(ahead, depth, "left") - 1
        base = until(start, depth - 1)
        kind = np.where(depth == 0, -1, np.where(depth - 1 > smallest, RIGHT, LEFT))
        give(RIGHT, depth, start, np.full(len(depth), n), size[start] - base, base, parted(start, depth) + (turns[start] > depth), turns[start] == depth, depth * 0, kind)
    return pa.concat_tables(out)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node."""
    spark = conversations.sparkSession
    whole = rebuilt(conversations).select(
        "conv_id", F.transform("turns", lambda t: t["symbol"]).alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("bytes")
    )
    whole = written(whole.withColumn("name", F.sha2(F.array_join(F.transform("key", F.hex), "").cast("binary"), 256)), "rebuilt")
    distinct = whole.groupBy("name").agg(
        F.count("*").alias("weight"), F.min("conv_id").alias("low"), F.first("key").alias("key"), F.first("bytes").alias("bytes")
    )
    distinct = written(distinct, "distinct")
    chunks = whole.groupBy("name", F.shiftright("conv_id", ID_BITS).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    ends = chunks.repartition("name").sortWithinPartitions("name", "chunk").select("name", "ids").mapInArrow(_digests, "name string, ends_sha256 string")

    turns = distinct.agg(F.coalesce(F.sum(F.size("key")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // BLOCK_TURNS))
    ordered = distinct.select("name", "weight", "low", "key", "bytes").repartitionByRange(blocks, "key").sortWithinPartitions("key")
    ordered = written(ordered.mapInArrow(_sorted, SORTED), "sorted")

    # A row a block: what its first conversation shares with the last one before.
    in_turn = Window.orderBy("block")
    alike = F.zip_with("first", "before", lambda x, y: x.eqNullSafe(y))
    borders = ordered.where("pos < 0").select("block", "first", F.lag("last").over(in_turn).alias("before"))
    borders = borders.select("block", F.when(F.col("before").isNull(), -1).otherwise(F.array_position(alike, False) - 1).alias("border"))
    borders = borders.withColumn("next_border", F.coalesce(F.lead("border").over(in_turn), F.lit(-1)))
    parts = ordered.where("pos >= 0").drop("first", "last").join(F.broadcast(borders), "block")  # 20 bytes a block
    parts = written(parts.groupBy("block").applyInArrow(_nodes, PARTS), "parts")

    pieces = parts.where(F.col("kind") != CLOSED)
    opened = F.when(F.col("kind") == RIGHT, F.col("block"))
    owner = F.last(opened, ignorenulls=True).over(Window.partitionBy("depth").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0))
    pieces = written(pieces.withColumn("owner", owner), "pieces")
    own = lambda c: F.max(F.when(F.col("kind") == RIGHT, F.col(c))).alias(c)
    merged = pieces.groupBy("owner", "depth").agg(
        F.min("low").alias("low"), *(F.sum(c).alias(c) for c in ("weight", "weighted", "fresh", "n_leaves", "n_children")),
        *(own(c) for c in ("base", "name", "parent_low", "parent_kind")),
    )
    merged = written(merged.withColumnRenamed("owner", "block"), "merged")
    named = pieces.join(merged.select(F.col("block").alias("owner"), "depth", F.col("low").alias("found")), ["owner", "depth"])
    named = named.select("block", (F.col("depth") + 1).alias("depth"), F.col("kind").alias("parent_kind"), "found")
    nodes = parts.where(F.col("kind") == CLOSED).drop("kind").unionByName(merged)
    nodes = nodes.join(named, ["block", "depth", "parent_kind"], "left")
    nodes = nodes.select(
        F.col("low").alias("conv_id"), "depth", F.coalesce("parent_low", "found").alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        "n_children", "n_leaves", (F.col("weighted") - F.col("weight") * F.col("base") - F.col("fresh")).alias("saved_tokens"), "name",
    )
    ended = nodes.where("name IS NOT NULL").join(ends, "name").drop("name")
    return ended.unionByName(nodes.where("name IS NULL").drop("name").withColumn("ends_sha256", F.lit(NOTHING)))


ORACLE = r"""
WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS f FROM r),
b AS (SELECT conv_id, f, list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))) AS bits FROM c),
h AS (SELECT conv_id, f, xor(CAST(4294967295 AS BIGINT), list_reduce(bits, lambda s, x: CASE WHEN xor(s, x) % 2 = 1 THEN xor(xor(s, x) // 2, CAST(3988292384 AS BIGINT)) ELSE xor(s, x) // 2 END)) % 9 AS h FROM b),
t AS (SELECT h.conv_id, r.i, r.role, r.text FROM h JOIN r ON r.conv_id = h.f AND r.i <= h.h UNION ALL SELECT h.conv_id, r.i + 100000, r.role, r.text FROM h JOIN r ON r.conv_id = h.conv_id AND r.i > h.h),
u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, md5(concat(strlen(role), ':', role, text)) AS s, strlen(text) AS b FROM t),
p AS (SELECT conv_id, d, b, string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS k FROM u UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT conv_id, max(d) AS n FROM p GROUP BY conv_id),
n AS (SELECT k, p.d, any_value(b) AS b, min(p.conv_id) AS low, count(*) AS n, coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE m.n = p.d), '') AS ends
  FROM p JOIN m ON p.conv_id = m.conv_id GROUP BY k, p.d),
q AS (SELECT a.k, count(*) AS c FROM n a JOIN n x ON x.d = a.d + 1 AND substr(x.k, 1, CAST(a.d * 32 AS BIGINT)) = a.k GROUP BY a.k),
w AS (SELECT a.k, sum((x.n - 1) * x.b) AS saved, count(*) FILTER (WHERE q.c IS NULL) AS leaves FROM n a JOIN n x ON x.d >= a.d AND substr(x.k, 1, CAST(a.d * 32 AS BIGINT)) = a.k LEFT JOIN q ON q.k = x.k GROUP BY a.k)
SELECT n.low AS conv_id, CAST(n.d AS BIGINT) AS depth, u.low AS parent_conv_id, n.n AS n_convs, CAST(coalesce(q.c, 0) AS BIGINT) AS n_children, w.leaves AS n_leaves, CAST(w.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n LEFT JOIN n u ON n.d > 0 AND u.d = n.d - 1 AND u.k = substr(n.k, 1, CAST((n.d - 1) * 32 AS BIGINT)) LEFT JOIN q ON q.k = n.k JOIN w ON w.k = n.k
"""
