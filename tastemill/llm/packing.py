"""Lexical retrieval packing.

Documents are tokenised, each with an end id, and dealt to shards of about ``SHARD`` by content: a weighted min-hash of its token ids, in which the
rarer ids (a byte-pair vocabulary numbers them last) come sooner, is a document's key, so that documents with rare tokens in common tend to share it.
Small keys are put together; a key with more documents than a shard holds has shards of its own, among which they are dealt by hash. In each shard a BM25 inverted index over token ids, weighted with
document frequencies of the whole corpus, returns the unused neighbours of a seed document, best first. They fill the seed's window
greedily; the neighbour that does not fit is cut, fills the window and seeds the next one with its rest, so that only the last
window of a shard is padded, to a power of two. A seed without unused neighbours goes on with the next unused document.

A query is a seed's ``QUERY_TERMS`` heaviest terms. Null texts are empty and give one piece, the end id. Rows that repeat a
``doc_id`` are documents of their own. Other columns are ignored; an empty table gives no rows. Documents longer than a
window fill windows of their own until their rest is shorter.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written
from .words import ragged

WINDOW, END, SHARD, QUERY_TERMS = 2048, 1, 1024, 24
K1, B = 1.2, 0.75
CACHE, MOST_IDS = 600_000, 1 << 26


class Tokens:
    """Ids of whole texts by the byte-level BPE; the chunks of a batch are encoded once each.

    A text is cut before each space that follows a character other than white space; no piece of the tokenizer's own pre-split
    crosses such a place. Texts with other runs of white space are encoded whole, and so are texts that hold one of the tokenizer's own
    marks, which become their ids.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.marks = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.fast = None
        ranks_file = vocabulary.removesuffix(".json") + ".tiktoken"
        try:
            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        except (ImportError, OSError):
            pass

    def _encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast:
            return [self.fast(t) for t in texts]
        return self._encode_marked(texts)

    def _encode_marked(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint16) of all texts, each followed by ``END``, and where each text's begin."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = flat.dictionary.to_pylist()
        # Code 2c is word c at a text's start, 2c + 1 with its space.
        first = np.zeros(len(codes), bool)
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        codes = codes * 2 + ~first
        odd = np.array([not w or w[-1].isspace() for w in words], bool)
        lone = np.zeros(len(texts), bool)
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        lone[doc[odd[codes >> 1]]] = True
        marked = np.zeros(len(texts), bool)
        for mark in self.marks:
            marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        lone |= marked
        keep = ~lone[doc]
        codes, doc, whole = codes[keep], doc[keep], np.flatnonzero(lone)
        used = np.flatnonzero(np.bincount(codes, minlength=2 * len(words)))
        keys = [words[c >> 1] if c % 2 == 0 else " " + words[c >> 1] for c in used.tolist()]
        new = [k for k in keys if k not in self.known]
        fresh = dict(zip(new, (array("H", x).tobytes() for x in self._encode(new)), strict=True))
        pieces = [fresh.get(k) or self.known[k] for k in keys]
        if len(self.known) < CACHE:
            self.known.update(fresh)
        for i in whole:
            encode = self._encode_marked if marked[i] else self._encode
            pieces.append(array("H", encode([texts[int(i)].as_py()])[0]).tobytes())
        pieces.append(array("H", [END]).tobytes())
        # The pieces of all texts in order; a text encoded whole is one piece, and each text is followed by the end.
        place = np.zeros(2 * len(words), np.int32)
        place[used] = np.arange(len(used))
        body = np.insert(place[codes], np.searchsorted(doc, whole), len(used) + np.arange(len(whole)))
        counts = np.bincount(doc, minlength=len(texts)) + lone + 1
        ends = np.cumsum(counts)
        order = np.full(len(body) + len(texts), len(pieces) - 1, np.int32)
        inner = np.ones(len(order), bool)
        inner[ends - 1] = False
        order[inner] = body
        joined = pa.array(pieces, pa.large_binary()).take(pa.array(order))
        _, offsets, data = joined.buffers()
        offsets = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(order) + 1]
        return np.frombuffer(data, np.uint16)[offsets[0] // 2 : offsets[-1] // 2], (offsets[np.r_[0, ends]] - offsets[0]) // 2


@lru_cache(1)
def tokens_for(vocabulary: str) -> Tokens:
    """One a worker process, so that its chunks are kept from task to task."""
    return Tokens(vocabulary)


def tokenised(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n, key, ids``: little-endian 16-bit ids, and the key that deals rows to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, place = tokens_for(vocabulary), key_order()
        for batch in batches:
            ids, ends = tokens.encode(batch.column("text"))
            keys = np.minimum.reduceat(place[ids], ends[:-1]) if batch.num_rows else np.zeros(0, np.int32)
            raw = pa.py_buffer(ids.astype("<u2").tobytes())
            offsets = pa.array(ends * 2)
            packed = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, offsets.buffers()[1], raw])
            # Batches of less than MOST_IDS ids, as a row's binary value has 32-bit offsets.
            cuts = np.flatnonzero(np.diff(ends[:-1] // MOST_IDS, prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows]):
                part = packed.slice(lo, hi - lo).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(ends)[lo:hi]), pa.array(keys[lo:hi]), part], ["doc_id", "n", "key", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n bigint, key int, ids binary")


def key_order() -> np.ndarray:
    """The place of each token id in the order of the weighted min-hash."""
    clock = np.random.default_rng(5).exponential(size=1 << 16) / (np.arange(1 << 16) + 1.0) ** 2
    place = np.empty(1 << 16, np.int32)
    place[np.argsort(clock)] = np.arange(1 << 16)
    return place


def shard_table(counts: list[tuple[int, int]], shard: int) -> list[tuple[int, int, int]]:
    """``key, first shard, shards`` of all keys with their numbers of documents."""
    out, following, held = [], 0, 0
    for key, n in sorted(counts):
        if n > shard:
            continue
        if held + n > shard:
            following, held = following + 1, 0
        out.append((key, following, 1))
        held += n
    following += held > 0
    for key, n in sorted(counts):
        if n > shard:
            out.append((key, following, -(-n // shard)))
            following += -(-n // shard)
    return out


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(1 << 16, np.int64)
    for pdf in batches:
        for raw in pdf.ids:
            total[np.unique(np.frombuffer(raw, "<u2"))] += 1
    term = np.flatnonzero(total)
    yield pd.DataFrame({"term": term, "df": total[term]})


def pack_shard(ids: list[np.ndarray], idf: np.ndarray, mean: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    n = len(ids)
    docs, terms, counts = [], [], []
    for i, x in enumerate(ids):
        t, c = np.unique(x, return_counts=True)
        docs.append(np.full(len(t), i))
        terms.append(t)
        counts.append(c)
    sizes = np.array([len(x) for x in ids], float)
    first = np.r_[0, np.cumsum([len(t) for t in terms])]
    doc, term, tf = np.concatenate(docs), np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.float32)
    weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))).astype(np.float32)
    by = np.argsort(term, kind="stable")
    posting_doc, posting_weight = doc[by], weight[by]
    posting = np.searchsorted(term[by], np.arange((1 << 16) + 1))
    unused, pieces = np.ones(n, bool), []
    sequence, room, following = 0, WINDOW, 0

    def place(i: int, start: int) -> int:
        """Put what fits of document i from ``start`` on; returns where it was cut."""
        nonlocal sequence, room
        length = min(len(ids[i]) - start, room)
        pieces.append((i, start, length, sequence, WINDOW - room))
        room -= length
        if not room:
            sequence, room = sequence + 1, WINDOW
        return start + length

    seed, at = -1, 0
    while True:
        if seed < 0:
            while following < n and not unused[following]:
                following += 1
            if following == n:
                return pieces
            seed, at = following, 0
            unused[seed] = False
        while at < len(ids[seed]) and len(ids[seed]) - at >= room:
            at = place(seed, at)
        if at == len(ids[seed]):
            seed = -1
            continue
        at = place(seed, at)
        own = slice(first[seed], first[seed + 1])
        heavy = term[own][np.argsort(-weight[own], kind="stable")[:QUERY_TERMS]]
        lengths = posting[heavy + 1] - posting[heavy]
        hits = ragged(posting[heavy], lengths)
        score = np.bincount(posting_doc[hits], np.repeat(idf[heavy], lengths) * posting_weight[hits], n)
        score[~unused] = 0
        near = np.argsort(-score, kind="stable")[: WINDOW]
        filled, seed = sequence, -1
        for i in near[score[near] > 0]:
            unused[i] = False
            cut = place(i, 0)
            if sequence != filled:
                if cut < len(ids[i]):
                    seed, at = i, cut
                break


def pack(docs: DataFrame, vocabulary: str, shard: int = SHARD) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of all pieces."""
    small_batches(docs.sparkSession)
    tokens = written(tokenised(docs, vocabulary), "tokens")
    counts = tokens.select("ids").mapInPandas(_frequencies, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    # A row for each of the tokenizer's ids at most.
    keys = tokens.groupBy("key").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).collect()
    total = sum(r["docs"] for r in keys)
    mean = sum(r["n"] for r in keys) / max(total, 1)
    dealing = docs.sparkSession.createDataFrame(shard_table([(r["key"], r["docs"]) for r in keys], shard), "key int, first int, shards int")
    # One number for each of the tokenizer's ids: at most 65,536.
    idf = np.full(1 << 16, np.log(total + 1.0), np.float32)
    for r in counts.collect():
        idf[r["term"]] = np.log(1 + (total - r["df"] + 0.5) / (r["df"] + 0.5))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n", "ids"]).reset_index(drop=True)
        ids = [np.frombuffer(x, "<u2") for x in pdf.ids]
        made = np.array(pack_shard(ids, idf, mean or 1.0), np.int64).reshape(-1, 5)
        crc = [zlib.crc32(ids[i][s : s + k].astype("<u4").tobytes()) for i, s, k in made[:, :3]]
        return pd.DataFrame(
            {
                "doc_id": pdf.doc_id.to_numpy()[made[:, 0]], "start": made[:, 1], "length": made[:, 2], "ids_crc32": crc,
                "doc_tokens": pdf.n.to_numpy()[made[:, 0]], "sequence_id": (int(key[0]) << 32) + made[:, 3], "offset": made[:, 4],
            }
        )

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    # Equal rows are interchangeable, so the place of a row in its file may part them: its pieces depend on its ids alone.
    numbered = tokens.withColumn("h", F.xxhash64("doc_id", F.crc32("ids"), F.col("_metadata.row_index"))).drop("_metadata")
    dealt = numbered.join(F.broadcast(dealing), "key").withColumn("shard", F.col("first") + F.pmod("h", "shards")).drop("h", "first", "shards", "key")
    return dealt.groupBy("shard").applyInPandas(run, schema)
