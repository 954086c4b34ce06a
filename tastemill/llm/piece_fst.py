"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The vocabulary is compiled into a transducer: its normaliser marks the text's start and spaces with U+2581; a trie of the pieces gives
arcs from character positions to character positions; a character that no piece covers takes the arc of its byte pieces. Composing an input with
it gives a lattice, and the encoding is its shortest path in the tropical semiring, (min, +).

For a BPE vocabulary the weights are those of a bigram acceptor: an arc after an arc costs 0 if merging the two pieces' text from single
characters gives the two pieces again, and infinity if not. The path of finite weight is then unique and is what the merges give.
For a unigram vocabulary an arc costs its piece's negative log probability. Words repeat, so a batch's distinct words are composed once.

Null texts count as empty and have no ids. Decoding joins pieces and bytes; malformed bytes become U+FFFD. Rows stand alone; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .words import ragged

SPACE = "▁"
CACHE = 300_000
INFINITY = float("inf")


class Transducer:
    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], special: set[int], bpe: bool = True):
        self.pieces, self.scores, self.byte_ids, self.bpe = pieces, scores, byte_ids, bpe
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special and i not in byte_ids.values()}
        self.bytes_of = {i: b for b, i in byte_ids.items()}
        self.special = special
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.follows: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}

    @classmethod
    def load(cls, model_file: str) -> Transducer:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        pieces, scores = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        own = [s for i, s in enumerate(scores) if i not in special and i not in byte_ids.values()]
        return cls(pieces, scores, byte_ids, special, all(float(s).is_integer() for s in own))

    def merged(self, text: str) -> list[str]:
        """What merging the best pair again and again, the leftmost first, makes of a short text."""
        parts = list(text)
        while True:
            best, at = -INFINITY, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and self.scores[i] > best:
                    best, at = self.scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def cost(self, before: int, piece: int) -> float:
        """The weight of a piece's arc after the arc of the piece ``before`` (-1: at the start or after bytes)."""
        if not self.bpe:
            return -self.scores[piece]
        if before < 0:
            good = self.alone.get(piece)
            if good is None:
                good = self.alone[piece] = len(self.merged(self.pieces[piece])) == 1
        else:
            good = self.follows.get((before, piece))
            if good is None:
                a, b = self.pieces[before], self.pieces[piece]
                good = self.merged(a + b) == [a, b]
                if len(self.follows) < 2_000_000:
                    self.follows[before, piece] = good
        return 0.0 if good else INFINITY

    def shortest(self, text: str) -> list[int]:
        """The ids along the shortest path through the lattice of a normalised text."""
        n = len(text)
        # Of each position the weight of the best path to it, its last piece (-1: start or bytes) and where that began.
        best, last, begin = [INFINITY] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        trie = self.trie
        for at in range(n):
            here, before = best[at], last[at]
            if here == INFINITY:
                continue
            node, known = trie, False
            for end in range(at, n):
                node = node.get(text[end])
                if node is None:
                    break
                piece = node.get("")
                if piece is not None:
                    known |= end == at
                    total = here + self.cost(before, piece)
                    if total < best[end + 1]:
                        best[end + 1], last[end + 1], begin[end + 1] = total, piece, at
            if not known and here + 1e-9 < best[at + 1]:
                best[at + 1], last[at + 1], begin[at + 1] = here if self.bpe else here + 100.0, -1, at
        out, at = [], n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out.extend(self.byte_ids[b] for b in reversed(text[begin[at]].encode()))
            at = begin[at]
        return out[::-1]

    def decode(self, ids) -> str:
        raw = bytearray()
        for i in ids:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
            elif i not in self.special:
                raw += self.pieces[i].replace(SPACE, " ").encode()
        text = raw.decode("utf-8", "replace")
        return text.removeprefix(" ")


class Encoder:
    """Encodes whole texts; the distinct words of a batch take the transducer once each."""

    def __init__(self, model_file: str):
        self.fst = Transducer.load(model_file)
        self.known: dict[str, np.ndarray] = {}
        fst = self.fst
        self.table = [
            bytes([fst.bytes_of[i]]) if i in fst.bytes_of else b"" if i in fst.special else p.replace(SPACE, " ").encode()
            for i, p in enumerate(fst.pieces)
        ]
        crossing = [p for p in self.fst.ids if SPACE in p.lstrip(SPACE)]
        if crossing:
            raise ValueError(f"pieces go on after a space: {crossing[:3]}")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # No piece goes on after a space, so runs of spaces with the word that follows are encoded on their own.
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        codes, words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        gap = np.array([not w or SPACE in w for w in words], bool)
        lone = np.zeros(len(texts), bool)
        lone[np.unique(doc[gap[codes]])] = True
        lone |= np.diff(bounds) == 0
        used = np.unique(codes[~lone[doc]])
        keys = [words[c] for c in used.tolist()]
        pieces = []
        for k in keys:
            own = self.known.get(k)
            if own is None:
                own = np.array(self.fst.shortest(SPACE + k), np.int32)
                if len(self.known) < CACHE:
                    self.known[k] = own
            pieces.append(own)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        keep = ~lone[doc]
        at = np.searchsorted(used, codes[keep])
        starts = np.r_[0, np.cumsum(sizes)]
        ids = np.concatenate([*pieces, np.zeros(0, np.int32)])[ragged(starts[at], sizes[at])] if len(at) else np.zeros(0, np.int32)
        totals = np.bincount(doc[keep], sizes[at], len(texts)).astype(np.int64)
        if lone.any():
            ends = np.r_[0, np.cumsum(totals)]
            own = [ids[ends[i] : ends[i + 1]] for i in range(len(texts))]
            for i in np.flatnonzero(lone):
                text = texts[int(i)].as_py()
                own[i] = np.array(self.fst.shortest(SPACE + text.replace(" ", SPACE)) if text else [], np.int32)
            totals, ids = np.fromiter(map(len, own), np.int64, len(own)), np.concatenate(own)
        return ids, np.r_[0, np.cumsum(totals)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        out = []
        for k in range(len(bounds) - 1):
            text = b"".join(map(self.table.__getitem__, ids[bounds[k] : bounds[k + 1]].tolist())).decode("utf-8", "replace")
            out.append(text.removeprefix(" "))
        return out


@lru_cache(1)
def encoder_for(model_file: str) -> Encoder:
    """One a worker process, so that its words are kept from task to task."""
    return Encoder(model_file)


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, ids, decoded``: the ids of the whole text and what they decode to."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(model_file)
        for batch in batches:
            ids, bounds = encoder.encode(batch.column("text"))
            listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            decoded = pa.array(encoder.decode(ids, bounds), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed, decoded], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digested(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, decoded_sha256, round_trip`` of each text (ids as little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(model_file)
        for batch in batches:
            ids, bounds = encoder.encode(batch.column("text"))
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[bounds[i] : bounds[i + 1]].tobytes()) for i in range(batch.num_rows)]
            decoded = pa.array(encoder.decode(ids, bounds), pa.string())
            same = pc.equal(decoded, pc.fill_null(batch.column("text"), ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), decoded, same],
                ["doc_id", "n_ids", "ids_crc32", "decoded", "round_trip"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids bigint, ids_crc32 bigint, decoded string, round_trip boolean")
    return made.select("doc_id", "n_ids", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")
