"""Divergence, the prefix trie and Golay fingerprints against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tastemill.llm import divergence, prefix_trie, simhash_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def diverged(rows, least, top):
    """rows: (text, lang, source)."""
    held, count, sources = defaultdict(lambda: defaultdict(set)), defaultdict(Counter), defaultdict(set)
    for i, row in enumerate(rows):
        text, lang, source = (x or "" for x in row)
        sources[lang].add(source)
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text):
            t = t.translate(ASCII)
            held[lang][t].add(i)
            count[lang, source][t] += 1
    out = set()
    for lang, own in sources.items():
        kept = sorted(t for t, d in held[lang].items() if len(d) >= least)
        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        p = {s: shares(count[lang, s]) for s in own}
        q = shares(sum((count[lang, s] for s in own), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in own:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s))
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pair, 1)}
            out |= {(lang, s, "term", o, -v, k) for k, (v, _, o) in enumerate(term[:top], 1)}
    return out


DOC = "doc_id bigint, text string, lang string, source string, term string, n bigint, p bigint, zero bigint"


def test_divergence(spark):
    rng = random.Random(4)
    words = ["The", "the", "été", "ÉTÉ", "a1b", "x-y", "漢字", "\x00z", "Straße", "k"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "É", None, "c"])) for _ in range(120)]
    rows += [rows[0]] * 5 + [("", "en", "empty"), (None, "de", "x"), ("rare", "de", "y"), ("one one one", "it", "only"), ("the " * 4000, "en", "a")]
    df = spark.createDataFrame([(i % 60, *r, "t", 1, 1, 1) for i, r in enumerate(rows)], DOC).repartition(5)
    for least, top in ((10, 10), (2, 3), (1, 5)):
        got = divergence.divergence(df, least, top).collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == diverged(rows, least, top)
    assert divergence.divergence(df.where("doc_id < 0")).count() == 0


def test_divergence_large_counts(spark):
    row = spark.sql("SELECT 900000000000L AS n, 7000000000000L AS total, 1000000L AS kept, 0L AS none, 0L AS nil")
    got = row.select(divergence.share("n", "total", "kept"), divergence.share("none", "none", "nil")).first()
    assert tuple(got) == (1 + 10**9 * (900000000000 + 2) // (7000000000000 + 2000000), None)


def trie(rows):
    """rows: (conv_id, turn, role, text); nodes by brute force over all prefixes."""
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(x)] for c, x in talks.items()}
    members = defaultdict(list)
    made = {}
    for c in sorted(talks):
        h = zlib.crc32(str(c).encode()) % 9
        first = c - int(np.fmod(c, 5))
        made[c] = tuple(talks.get(first, [])[:h] + talks[c][h:])
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, who in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(who) - 1) * len(k[-1][1].encode()) if k else 0
    digest = lambda k: hashlib.sha256(",".join(str(c) for c in members[k] if made[c] == k).encode()).hexdigest()
    return sorted((w[0], len(k), members[k[:-1]][0] if k else -99, len(w), children[k], leaves[k], saved[k], digest(k)) for k, w in members.items())


def talks(seed, n):
    """Conversations over few turns, so that prefixes repeat; copies, gaps, nulls, ties and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in sorted(rng.sample(range(-20, 3 * n), n)):
        for t in range(rng.choice([1, 2, 3, 3, 5, 9, 12])):
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", None]), rng.choice(["é", "b" * 9, "", None, "漢字 x"])))
    same = [(t, "user", f"copied {t}") for t in range(4)]
    rows += [(1000 + i, *s) for i in range(60) for s in same] + rows[:5] + [(None, 0, "user", "x")]
    return rows


CONV = "conv_id bigint, turn bigint, role string, text string, key string, block int, depth bigint, name string"


@pytest.mark.parametrize(("seed", "n", "blocks"), [(1, 60, 1), (2, 80, 4), (3, 30, 40), (4, 120, 7)])
def test_prefix_trie(spark, seed, n, blocks):
    rows = talks(seed, n)
    df = spark.createDataFrame([(*r, "k", 1, 2, "n") for r in rows], CONV).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", blocks)
    try:
        got = sorted(tuple(-99 if x is None else x for x in r) for r in prefix_trie.prefix_trie(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == trie(rows)


def test_prefix_trie_edges(spark):
    make = lambda rows: spark.createDataFrame([(*r, "k", 1, 2, "n") for r in rows], CONV)
    got = lambda rows: sorted(tuple(-99 if x is None else x for x in r) for r in prefix_trie.prefix_trie(make(rows)).collect())
    assert got([]) == []
    gone = [c for c in range(1, 40) if c % 5 and zlib.crc32(str(c).encode()) % 9][:1]
    turnless = [(gone[0], 0, "user", "x")]  # its own turn is replaced by a conversation that is not there
    assert got(turnless) == trie(turnless) == [(gone[0], 0, -99, 1, 0, 1, 0, hashlib.sha256(str(gone[0]).encode()).hexdigest())]
    long = [(5, t, "user", "y" * 50) for t in range(400)] + [(10, t, "user", "y" * 50) for t in range(350)]
    assert got(long) == trie(long)
    ids = [(c * 40_000 - 120_000, 0, "user", "same") for c in range(0, 60, 5)]  # lists of ids of several chunks
    assert got(ids) == trie(ids)


def simhash(text):
    words = [w.encode() for w in WORD.findall((text or "").translate(ASCII))]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """The smallest id reachable from each (id, fingerprint)."""
    low = {}
    for i, f in prints:
        low[f] = min(low.get(f, i), i)
    names, parent = sorted(low), {}
    a = np.array(names, np.uint64)

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, f in enumerate(names):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ np.uint64(f)) <= 4):
            parent[root(f)] = root(names[i + 1 + int(j)])
    best = {}
    for f in names:
        best[root(f)] = min(best.get(root(f), low[f]), low[f])
    return {f: best[root(f)] for f in names}


def test_golay_codewords():
    powers, patterns, counts = simhash_dedup.golay()
    assert counts.min() == 1 and counts.max() == 6 and counts.sum() == 2048 + 8855
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    index, n = simhash_dedup.codewords(words)
    for flips in (1, 2):
        other = words.copy()
        for _ in range(flips):
            other ^= 1 << rng.integers(0, 23, len(words))
        index_o, n_o = simhash_dedup.codewords(other)
        for k in range(len(words)):
            assert set(index[k, : n[k]]) & set(index_o[k, : n_o[k]])
            if flips == 1:
                assert index[k, 0] in index_o[k, : n_o[k]]


def test_golay_keys_cover_all_errors():
    """Each way to spread at most four errors over the segments meets in a key."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 64, 6000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a), dtype=np.uint64)
    (row_a, key_a, home_a), (row_b, key_b, home_b) = simhash_dedup.keys(a), simhash_dedup.keys(b)
    probes = set(zip(row_a.tolist(), key_a.tolist(), strict=True))
    met = {r for r, k, h in zip(row_b.tolist(), key_b.tolist(), home_b.tolist(), strict=True) if h and (r, k) in probes}
    assert met == set(range(len(a)))


def test_links_of_planted_fingerprints(spark):
    """Chains, stars and neighbours at four and five bits, more than a pivot finds."""
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.choice([0, 1, 3, 25])):
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 4, 5])):
                x ^= 1 << b
            prints.add(x)
            if rng.random() < 0.5:
                x = rng.choice(sorted(prints)[-10:])
    base = rng.getrandbits(64)
    prints |= {base ^ 1 << a ^ 1 << b for a in range(12) for b in range(40, 60)}
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(sorted(prints))]
    found = simhash_dedup.links(spark.createDataFrame(rows, "low bigint, print bigint")).collect()
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in found:
        assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 4
        parent[root(r.a)] = root(r.b)
    want = components([(i, f & (1 << 64) - 1) for i, f in rows])
    groups = defaultdict(set)
    for _, f in rows:
        groups[root(f)].add(want[f & (1 << 64) - 1])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))
    with pytest.raises(ValueError):
        simhash_dedup.links(spark.createDataFrame(rows[:2], "low bigint, print bigint"), 5)


def test_simhash_dedup(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(200)] + ["The", "É", "漢字"]
    base = [rng.choice(vocabulary) for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(40)]
    for i in range(40):
        near = list(base)
        for _ in range(i % 5):
            near[rng.randrange(300)] = "changed"
        texts.append(rng.choice([" ", "\t\n", "  "]).join(near))
    texts += [None, "", " \n", "one", "ONE", "a b c", "The " * 5000, texts[0].upper(), " " + texts[1]]
    ids = [*range(len(texts)), 3, 4, None, None]
    texts += ["another text of the same id " * 3, texts[4], "the lost one", texts[5]]
    schema = "doc_id bigint, text string, print bigint, key bigint, component string"
    df = spark.createDataFrame([(i, t, 1, 2, "c") for i, t in zip(ids, texts, strict=True)], schema).repartition(3)
    prints = [simhash(t) for t in texts]
    want = components([(i, f) for i, f in zip(ids, prints, strict=True) if i is not None])
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted(map(key, simhash_dedup.near_duplicates(df).collect()))
    assert got == sorted(key((i, f"{f:016x}", None if i is None else want[f])) for i, f in zip(ids, prints, strict=True))
    assert len({r[2] for r in got}) < len(ids) - 30
    spark_hash = spark.createDataFrame([(t,) for t in ("", "a b c d", "é")], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(r.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(r.t.encode(), 42) for r in spark_hash)
    assert simhash_dedup.near_duplicates(df.where("doc_id < 0")).count() == 0
