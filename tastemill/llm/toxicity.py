"""Toxicity by a convolutional text classifier.

Words are letter runs of the lower-cased text. A word's embedding joins the hashed embeddings of the word and of its
first letters, so that unseen inflections of a known stem are told too. Filters of several widths run over the whole text, each keeps its largest response, and a logistic layer
joins them. As embeddings are hashed, a filter is a sum of table look-ups; training in numpy follows only the maxima back.

It is fitted on the driver on a sample of labelled rows that is bounded by ``TRAIN_DOCUMENTS`` and ``TRAIN_WORDS`` (whole texts, by hash
order; a text that no longer fits is left out and the next ones are tried). Sizes are looked at first, so that no text beyond the bound is
collected, and the sample is worked on in blocks of ``BLOCK`` documents. A part of the sample calibrates: the logit is scaled and, for each language as told from the text's own function words, shifted so that the
threshold of best F1 is a score of ``THRESHOLD``; where that part has under ``LEAST_HELD`` rows of a class, the whole sample calibrates. Scoring
sees texts alone.

Null and empty texts have no words and get the score of the bias. Repeated rows are scored each. With no labelled rows or only one
class among them, every score is the share of positives (0 without rows). Null labels are not used. Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .store import small_batches
from .words import ragged, split

TRAIN_DOCUMENTS, TRAIN_WORDS, CALIBRATION = 6000, 4_000_000, 0.25
BUCKETS, HALF, STEM, WIDTHS, FILTERS = 1 << 18, 6, 4, (1, 2, 3), 6
UPDATES, BATCH, RATE, L2, LEAST_TEXTS = 300, 128, 0.02, 1e-5, 3
CHANCE, LEAST_HELD = 4.0, 10
BLOCK, LETTERS_A_WORD, MOST_KNOWN = 256, 6, 100_000
RARE = 2 * BUCKETS
THRESHOLD = 0.3
LETTERS = re.compile(r"[^\W\d_]+")
# Frequent function words that tell the language of a text.
FUNCTION_WORDS = {
    "de": ("der", "die", "und", "das", "ist", "nicht", "von", "mit"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "was"),
    "es": ("el", "los", "y", "que", "por", "las", "una", "con"),
    "fr": ("le", "les", "et", "des", "est", "du", "dans", "pour"),
}
LANGUAGES = tuple(FUNCTION_WORDS)
LANGUAGE_OF = {w: i for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws}


def tokens(texts: pa.Array, known: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two bucket ids of all words (n, 2), where each text's begin, and the texts' languages (-1: not told)."""
    codes, bounds, words = split(texts)
    two, counts = [], np.zeros(len(words), np.int64)
    for i, raw in enumerate(words.to_pylist()):
        own = known.get(raw)
        if own is None:
            own = tuple((zlib.crc32(b := w.encode()) % BUCKETS, BUCKETS + zlib.crc32(w[:STEM].encode() + b"-") % BUCKETS, LANGUAGE_OF.get(w, -1)) for w in LETTERS.findall(raw.lower()))
            if len(known) < MOST_KNOWN:
                known[raw] = own
        counts[i] = len(own)
        two.extend(own)
    flat = np.array(two, np.int64).reshape(-1, 3)
    starts = np.r_[0, np.cumsum(counts)][:-1]
    picked = ragged(starts[codes], counts[codes]) if len(codes) else np.zeros(0, np.int64)
    ends = np.r_[0, np.cumsum(counts[codes])][bounds]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(ends))
    tongue = flat[picked, 2]
    told = tongue >= 0
    votes = np.bincount(doc[told] * len(LANGUAGES) + tongue[told], minlength=(len(bounds) - 1) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
    return flat[picked, :2], ends, np.where(votes.any(1), votes.argmax(1), -1) if len(votes) else np.zeros(0, np.int64)


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float
    prior: float | None = None
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1))

    def responses(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text and filter the largest response (0 where none is above) and where it is (-1: none)."""
        n, m = len(ids), len(bounds) - 1
        values, places = [], []
        distinct, at = np.unique(ids, return_inverse=True) if n else (np.zeros(0, np.int64), np.zeros((0, 2), np.int64))
        at = at.reshape(-1, 2)
        rows = self.embedding[distinct]
        first = distinct < BUCKETS
        full = np.flatnonzero(np.diff(bounds))
        doc_end = np.repeat(bounds[1:], np.diff(bounds))
        for width, w, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            total = np.zeros((n, FILTERS), np.float32)
            for k in range(width):
                table = np.where(first[:, None], rows @ w[k, :HALF], rows @ w[k, HALF:]).astype(np.float32)
                part = table[at[:, 0]] + table[at[:, 1]]
                if k:
                    inside = np.flatnonzero(np.arange(n) + k < doc_end)
                    total[inside] += part[inside + k]
                else:
                    total += part
            value, place = np.zeros((m, FILTERS), np.float32), np.full((m, FILTERS), -1, np.int64)
            if len(full):
                top = np.maximum.reduceat(total, bounds[:-1][full], axis=0)
                value[full] = np.maximum(top + b, 0)
                if self.prior is None:
                    doc = np.repeat(np.arange(len(full)), np.diff(bounds)[full])
                    is_top = np.where(total == top[doc], np.arange(n)[:, None], n)
                    place[full] = np.where(top + b > 0, np.minimum.reduceat(is_top, bounds[:-1][full], axis=0), -1)
            values.append(value)
            places.append(place)
        return np.concatenate(values, 1), np.concatenate(places, 1)

    def score(self, ids: np.ndarray, bounds: np.ndarray, tongue: np.ndarray) -> np.ndarray:
        if not len(self.weight):
            return np.full(len(bounds) - 1, self.prior)
        value, _ = self.responses(ids, bounds)
        return 1 / (1 + np.exp(-np.clip(value @ self.weight + self.offset + self.shift[tongue], -30, 30)))


def fit(ids: np.ndarray, bounds: np.ndarray, tongue: np.ndarray, labels: np.ndarray) -> Model:
    m = len(labels)
    if not m or labels.min() == labels.max():
        return Model(np.zeros((1, HALF)), [], [], np.zeros(0), 0.0, float(labels.mean()) if m else 0.0)
    # Words and stems of few texts cannot be told from chance; they keep a zero embedding.
    rare = _texts_with(ids, bounds, np.arange(m))[0] < LEAST_TEXTS
    ids[rare[ids]] = RARE
    rng = np.random.default_rng(3)
    order = rng.permutation(m)
    held, train = order[: int(m * CALIBRATION)], order[int(m * CALIBRATION) :]
    model = Model(
        np.zeros((RARE + 1, HALF), np.float32), [rng.normal(0, 0.5, (w, 2 * HALF, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.full(FILTERS, 0.1, np.float32) for _ in WIDTHS], rng.normal(0, 0.5, FILTERS * len(WIDTHS)), -2.0,
    )

    def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.diff(bounds)[rows]
        return ids[ragged(bounds[:-1][rows], lengths)], np.r_[0, np.cumsum(lengths)]

    _start(model, ids, bounds, train, labels)
    best = None
    memory = [np.full(p.shape, 1e-8, np.float32) for p in (model.embedding, *model.filters, *model.bias)]
    top_memory, off_memory = np.full(model.weight.shape, 1e-8), 1e-8
    for _ in range(-(-UPDATES * BATCH // max(len(train), 1))):
        for lo in range(0, len(train), BATCH):
            rows = rng.permutation(train)[:BATCH] if lo == 0 else train[lo : lo + BATCH]
            own, ends = part(rows)
            value, place = model.responses(own, ends)
            p = 1 / (1 + np.exp(-np.clip(value @ model.weight + model.offset, -30, 30)))
            error = (p - labels[rows]) / len(rows)
            g_weight, g_value = value.T @ error + L2 * model.weight, error[:, None] * model.weight
            for i, w in enumerate(model.filters):
                at, g = place[:, i * FILTERS : (i + 1) * FILTERS], g_value[:, i * FILTERS : (i + 1) * FILTERS]
                doc, f = np.nonzero(at >= 0)
                g, at = g[doc, f].astype(np.float32), at[doc, f]
                g_bias = np.bincount(f, g, FILTERS).astype(np.float32)
                _step(model.bias[i], memory[1 + len(WIDTHS) + i], g_bias)
                g_filter = np.zeros_like(w)
                for k in range(WIDTHS[i]):
                    inside = at + k < ends[doc + 1]
                    two, gi, fi = own[at[inside] + k], g[inside], f[inside]
                    for h in (0, 1):
                        cut = slice(h * HALF, (h + 1) * HALF)
                        np.add.at(g_filter[k, cut].T, fi, gi[:, None] * model.embedding[two[:, h]])
                        seen, back = np.unique(two[:, h], return_inverse=True)
                        g_rows = np.zeros((len(seen), HALF), np.float32)
                        np.add.at(g_rows, back, gi[:, None] * w[k, cut][:, fi].T)
                        memory[0][seen] += g_rows**2
                        model.embedding[seen] -= RATE * 5 * g_rows / np.sqrt(memory[0][seen])
                        model.embedding[RARE] = 0
                _step(w, memory[1 + i], g_filter)
            top_memory += g_weight**2
            model.weight -= RATE * 2 * g_weight / np.sqrt(top_memory)
            off_memory += error.sum() ** 2
            model.offset -= RATE * 2 * error.sum() / np.sqrt(off_memory)
        train = rng.permutation(train)
        logit = _logits(model, held, part)
        loss = float((np.log1p(np.exp(logit)) - labels[held] * logit).mean()) if len(held) else 0.0
        if best is None or loss < best[0]:
            best = (loss, [x.copy() for x in (model.embedding, *model.filters, *model.bias, model.weight)], model.offset)
    if best is not None:
        _, (model.embedding, *rest, model.weight), model.offset = best
        model.filters, model.bias = rest[: len(WIDTHS)], rest[len(WIDTHS) :]
    model.prior = float(labels.mean())
    if min(labels[held].sum(), (1 - labels[held]).sum()) < LEAST_HELD:
        held = order
    _calibrate(model, _logits(model, held, part), tongue[held], labels[held])
    return model


def _texts_with(ids: np.ndarray, bounds: np.ndarray, rows: np.ndarray, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket the number of the texts ``rows`` that have it, and of those of label 1."""
    n, hits = np.zeros(RARE + 1, np.int64), np.zeros(RARE + 1)
    for lo in range(0, len(rows), BLOCK):
        block = rows[lo : lo + BLOCK]
        lengths = np.diff(bounds)[block]
        own = ids[ragged(bounds[:-1][block], lengths)].astype(np.int64)
        pairs = np.unique(np.repeat(np.arange(len(block)), lengths)[:, None] * (RARE + 1) + own)
        n += np.bincount(pairs % (RARE + 1), minlength=RARE + 1)
        if labels is not None:
            hits += np.bincount(pairs % (RARE + 1), labels[block[pairs // (RARE + 1)]], RARE + 1)
    return n, hits


def _logits(model: Model, rows: np.ndarray, part) -> np.ndarray:
    made = [model.responses(*part(rows[lo : lo + BLOCK]))[0] @ model.weight + model.offset for lo in range(0, len(rows), BLOCK)]
    return np.clip(np.concatenate([np.zeros(0), *made]), -30, 30)


def _start(model: Model, ids: np.ndarray, bounds: np.ndarray, train: np.ndarray, labels: np.ndarray) -> None:
    """One embedding dimension begins as how far a word's or stem's share of label 1 is beyond chance; one filter reads it."""
    share = max(labels[train].mean(), 1e-3) if len(train) else 0.5
    n, hits = _texts_with(ids, bounds, train, labels)
    beyond = (hits - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share) + 1e-9)
    kept = (n > 0) & (beyond > CHANCE)
    kept[RARE] = False
    model.embedding[kept, 0] = np.minimum(beyond[kept] - CHANCE, 8) / 4
    model.filters[0][0, :, 0] = 0
    model.filters[0][0, (0, HALF), 0] = 1
    model.bias[0][0] = 0
    model.weight[0] = 2


def _step(value: np.ndarray, memory: np.ndarray, gradient: np.ndarray) -> None:
    memory += gradient**2
    value -= RATE * gradient / np.sqrt(memory)


def _best_cut(logit: np.ndarray, labels: np.ndarray) -> float:
    """The cut of best F1; in a gap between classes its middle."""
    order = np.argsort(-logit)
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    best = int(f1.argmax())
    below = logit[order[best + 1]] if best + 1 < len(order) else logit[order[best]] - 2
    return float((logit[order[best]] + below) / 2)


def _calibrate(model: Model, logit: np.ndarray, tongue: np.ndarray, labels: np.ndarray) -> None:
    aim = np.log(THRESHOLD / (1 - THRESHOLD))
    if labels.min() == labels.max():
        return
    model.shift[:] = aim - _best_cut(logit, labels)
    for i in range(len(LANGUAGES)):
        own = tongue == i
        if labels[own].sum() >= 20 and (1 - labels[own]).sum() >= 20:
            model.shift[i] = aim - _best_cut(logit[own], labels[own])


def train(docs: DataFrame, labels: DataFrame, held_out) -> Model:
    """Fit on a bounded sample of the labelled rows that ``held_out`` does not hold back."""
    own = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out)
    # At most TRAIN_DOCUMENTS ids, so the texts need no shuffle.
    chosen = F.broadcast(own.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(TRAIN_DOCUMENTS))
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(chosen, "doc_id").select(
        "doc_id", "toxic", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("version"), F.length("text").alias("size")
    )
    order = ["h", "doc_id", "version", "toxic"]
    sizes = rows.orderBy(*order).limit(TRAIN_DOCUMENTS).select("doc_id", "version", "toxic", "size").collect()
    left, fits = TRAIN_WORDS * LETTERS_A_WORD, []
    for r in sizes:
        if r["size"] <= left:
            left -= r["size"]
            fits.append((r["doc_id"], r["version"], r["toxic"]))
    kept = docs.sparkSession.createDataFrame(fits, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, version bigint, toxic bigint")
    sample = rows.withColumn("toxic", F.col("toxic").cast("bigint")).join(F.broadcast(kept), ["doc_id", "version", "toxic"])
    sample = sample.dropDuplicates(["doc_id", "version", "toxic"]).select(*order, "text").toArrow()
    sample = sample.sort_by([(c, "ascending") for c in order])
    marks = sample.column("toxic").to_numpy().astype(float)
    made, known = [], {}
    for batch in sample.select(["text"]).combine_chunks().to_batches(max_chunksize=BLOCK):
        made.append(tokens(batch.column("text"), known))
    del sample, known
    ids = np.concatenate([np.zeros((0, 2), np.int32), *(x[0].astype(np.int32) for x in made)])
    bounds = np.r_[0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(x[1]) for x in made)]))]
    tongue = np.concatenate([np.zeros(0, np.int64), *(x[2] for x in made)])
    return fit(ids, bounds, tongue, marks)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a double ``score``; an input column of that name is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score")
    if len(model.weight):
        seen = np.flatnonzero(model.embedding.any(1)).astype(np.int32)
        light = (seen, model.embedding[seen], model.filters, model.bias, model.weight, model.offset, model.prior, model.shift)
    else:
        light = (np.zeros(0, np.int32), np.zeros((0, HALF), np.float32), [], [], model.weight, 0.0, model.prior, model.shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows, *rest = light
        embedding = np.zeros((RARE + 1, HALF), np.float32)
        embedding[seen] = rows
        own, known = Model(embedding, *rest), {}
        for batch in batches:
            texts = batch.column("text")
            parts = [own.score(*tokens(texts.slice(lo, BLOCK), known)) for lo in range(0, len(texts), BLOCK)]  # memory of a block's words
            score = np.concatenate([np.zeros(0), *parts])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def held_out():
    """The rows whose labels are never learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score``, learnt from ``labels``."""
    return scored(docs, train(docs, labels, held_out()))
