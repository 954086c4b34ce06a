"""How far the sources of each language diverge in their words, by an inverted index that corrects a baseline.

Terms are runs of ASCII letters and non-ASCII characters, of which only A-Z are lower-cased; a language keeps those that at least
``LEAST_DOCUMENTS`` of its documents hold. With ``V`` kept terms, ``N`` occurrences of them in a group and add-two smoothing, a term's share is
``p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))``, and two groups diverge on it by ``f(p, q) = floor((p - q)**2 / (p + q))``.

No pair of sources is compared term by term. It starts at ``V`` times the ``f`` of two zero counts, and postings add what differs from that:

* a term that one source has adds ``f(p, zero') - f(zero, zero')`` against every other source. Terms of one source with equal counts add the
  same, so that they are counted first and added together;
* a term that both have adds ``f(p, p') - f(p, zero') - f(zero, p') + f(zero, zero')``, summed in the tasks that join a term's postings.

Shares and sums are exact: products that may pass 64 bits are decimals, and ``f`` stays below 2**31. Null texts, languages and sources are
empty ones, and an empty text still makes its group known. Rows are documents of their own also where they repeat a ``doc_id``; other columns
are ignored. An empty table, and a language with one source and no kept term, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import small_batches, written
from .words import split

LEAST_DOCUMENTS, TOP_TERMS, SMOOTH, SCALE = 10, 10, 2, 1_000_000_000

#: Every byte as the tokenizer sees it: letters in lower case, bytes of non-ASCII characters unchanged, a space for all others.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[65:91] = LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all terms, where each text's codes begin (one more at the end), and the terms by code."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    spaced = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(LETTERS[raw].tobytes()))
    return split(spaced)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` summed over a batch; an empty term stands for the group itself."""
    for batch in batches:
        codes, bounds, words = terms(batch.column("text"))
        langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        group = langs.indices.to_numpy().astype(np.int64) * max(len(sources.dictionary), 1) + sources.indices.to_numpy()
        groups, group = np.unique(group, return_inverse=True)
        width = max(len(words), 1)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        held, times = np.unique(doc * width + codes, return_counts=True)
        pair = group[held // width] * width + held % width
        pairs, back = np.unique(pair, return_inverse=True)
        n = np.bincount(back, weights=times, minlength=len(pairs)).astype(np.int64)
        docs = np.bincount(back, minlength=len(pairs))
        of = np.r_[pairs // width, np.arange(len(groups))]
        none = pa.array(np.zeros(len(groups), np.int64))
        term = pa.concat_arrays([words.take(pa.array(pairs % width)).cast(pa.string()), pa.array([""] * len(groups), pa.string())])
        key = groups[of]
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(key // max(len(sources.dictionary), 1))).cast(pa.string()),
             sources.dictionary.take(pa.array(key % max(len(sources.dictionary), 1))).cast(pa.string()),
             term, pa.concat_arrays([pa.array(n), none]), pa.concat_arrays([pa.array(docs.astype(np.int64)), none])],
            ["lang", "source", "term", "n", "docs"],
        )


def share(count: str, total: str, kept: str) -> Column:
    """A smoothed share in billionths, plus one; null without kept terms."""
    return F.expr(
        f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + {SMOOTH} as decimal(19,0))) div nullif(cast({total} + {SMOOTH} * {kept} as decimal(19,0)), 0)"
    )


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def index(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """The groups, ``lang, source, kept, total, zero, lang_total``, and the postings of kept terms with their shares, ``lang, source, term, p, q, zero``."""
    small_batches(docs.sparkSession)
    texts = docs.select("text", *(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    found = texts.mapInArrow(_postings, "lang string, source string, term string, n bigint, docs bigint")
    found = written(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "postings")
    held = found.where("term <> ''")
    kept = held.groupBy("lang", "term").agg(F.sum("docs").alias("held"), F.sum("n").alias("lang_n")).where(F.col("held") >= least).drop("held")
    postings = written(held.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept_postings")
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = found.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.na.fill(0, ["total", "kept", "lang_total"]).withColumn("zero", share("0", "total", "kept"))
    groups = written(groups, "groups")
    shares = postings.join(groups, ["lang", "source"])
    shares = shares.select("lang", "source", "term", share("n", "total", "kept").alias("p"), share("lang_n", "lang_total", "kept").alias("q"), "zero")
    return groups, written(shares, "shares")


def pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of each source and each other one of its language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    met = (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.item"))
    base = groups.alias("a").join(other.alias("b"), met).select("a.lang", "source", "item", F.col("kept") * apart("zero", "other_zero"))
    alike = shares.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("n"))
    single = alike.alias("a").join(other.alias("b"), met)
    single = single.select("a.lang", "source", "item", (F.col("n") * (apart("p", "other_zero") - apart("zero", "other_zero"))).alias("value"))
    single = single.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    mate = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other_p"), F.col("zero").alias("other_zero"))
    both = shares.join(mate, ["lang", "term"]).where("source < item")
    more = apart("p", "other_p") - apart("p", "other_zero") - apart("zero", "other_p") + apart("zero", "other_zero")
    both = both.groupBy("lang", "source", "item").agg(F.sum(more).alias("value"))
    turned = single.unionByName(both)
    turned = turned.unionByName(turned.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    base = base.toDF("lang", "source", "item", "value")
    return base.unionByName(turned).groupBy("lang", "source", "item").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` ranks all other sources, part ``term`` the ``top`` terms that a source has more of than its language."""
    groups, shares = index(docs, least)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    near = pairs(groups, shares).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    own = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    own = own.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= top)
    return near.unionByName(own)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY 1, 2, 3),
z AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS total, count(*) AS v FROM z GROUP BY lang, source),
p AS (SELECT z.lang, z.source, z.term, z.n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (z.n + 2)) // (s.total + 2 * s.v) AS BIGINT) AS p FROM z JOIN s ON z.lang = s.lang AND z.source = s.source),
l AS (SELECT lang, term, sum(n) AS n FROM z GROUP BY lang, term),
ls AS (SELECT lang, sum(n) AS total, count(*) AS v FROM l GROUP BY lang),
q AS (SELECT l.lang, l.term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (l.n + 2)) // (ls.total + 2 * ls.v) AS BIGINT) AS q FROM l JOIN ls ON l.lang = ls.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM y WHERE part = 'pair' OR rank <= 10
"""
