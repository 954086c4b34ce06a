"""The operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.llm import ann, chat, components, exact_dedup, line_dedup, minhash_dedup, packing, pii, piece_fst, queries, substring_dedup, toxicity
from tastemill.llm.store import tokenizer

DOC = "doc_id bigint, text string, lang string, name string, key string, n bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, ids=None):
    """Documents with columns that clash with the operators' own names."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "x", "y", 1) for i, t in zip(ids, texts, strict=True)], DOC).repartition(3)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "of", "é", "漢字"]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared, out = make(40), []
    for i in range(n):
        own = make(rng.randint(0, 60))
        if i % 3 == 0:
            at = rng.randint(0, len(own))
            own = own[:at] + shared[: rng.randint(10, 40)] + own[at:]
        out.append(rng.choice([" ", "\n", "  "]).join(own))
    out += [out[3], out[3], out[5] + " end", None, "", " ", "a " * 3000, "b " * 20 + "a " * 30]
    base = make(100)
    for i in range(12):
        near = list(base)
        for _ in range(i % 4):
            near[rng.randrange(100)] = "changed"
        out.append(" ".join(near))
    return out


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}


def test_substring(spark):
    texts = corpus()
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs(spark, texts)).collect()}
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in enumerate(words):
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert got[i].kept == " ".join(x for j, x in enumerate(w) if j not in gone)
    assert substring_dedup.substring_dedup(docs(spark, texts).limit(0)).count() == 0
    odd = substring_dedup.substring_dedup(docs(spark, [texts[3]] * 3, [None, 7, 7])).collect()
    assert all(r.n_removed == 0 for r in odd)
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    for rows in ([(1, a), (7, a), (7, b)], [(1, a + " x"), (7, c + " " + a + " " + c), (7, "short text here")], [(7, a), (7, b), (9, b + " " + a), (9, c), (9, b)]):
        found = substring_dedup.substring_dedup(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
        starts = [(i, tuple(w[k : k + 13])) for i, t in rows for w in [t.split()] for k in range(len(w) - 12)]
        want = []
        for i, t in rows:
            w = t.split()
            gone = {j for k in range(len(w) - 12) if any(o < i and s == tuple(w[k : k + 13]) for o, s in starts) for j in range(k, k + 13)}
            want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
        assert sorted(map(tuple, found)) == sorted(want)


def test_minhash(spark):
    texts = corpus(2)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs(spark, texts)).collect()}
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))} if w else set())
    low = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(a & sets[j])
                if both and 100 * both >= 80 * len(a | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == low
    assert all(got[i].kept == (low[i] == i) for i in got)
    assert minhash_dedup.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    odd = minhash_dedup.near_duplicates(docs(spark, ["one text of seven words in all", long, long + " end", "one text"], [7, 7, 9, None])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in odd if r.doc_id is not None) == [(7, 4, 7, True), (7, 57, 7, True), (9, 58, 7, False)]


def test_exact(spark):
    d = docs(spark, ["A b", "a B", "É", "é", None, "", "a b"], [5, 9, 1, 2, 3, 4, 9])
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(d).collect())
    assert got == [(1, 1, 1, True), (2, 2, 1, True), (3, 4, 2, False), (4, 4, 2, True), (5, 9, 3, False), (9, 9, 3, True), (9, 9, 3, True)]
    index = exact_dedup.DigestIndex(spark)
    index.add(d)
    later = {r.doc_id: (r.keep_id, r.kept) for r in index.add(docs(spark, ["a b", "new"], [100, 101])).collect()}
    assert later == {100: (9, False), 101: (101, True)}
    assert spark.table(index.name).count() == 5
    again = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in index.add(docs(spark, ["a b", "new"], [100, 101])).collect()}
    assert again[101] == (101, 1, True) and again[100][:1] + again[100][2:] == (9, False)
    spark.sql(f"DROP TABLE {index.name}")
    other = exact_dedup.DigestIndex(spark, buckets=index.buckets, path=index.path)
    assert {r.doc_id: r.kept for r in other.add(docs(spark, ["new", "newer"], [200, 201])).collect()} == {200: False, 201: True}
    assert spark.table(other.name).count() == 6


def test_chat(spark):
    rows = [(1, 1, "assistant", "</turn> & <turn:x> &amp;"), (1, 0, "user", None), (1, 0, "user", "é<"), (None, 0, None, "x"), (2, 0, "assistant", "y"), (3, 0, "gpt", "z")]
    t = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = chat.canonical_turns(t)
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert [(x.role, x.text) for x in back[1].turns] == [("user", ""), ("user", "é<"), ("assistant", "</turn> & <turn:x> &amp;")]
    assert back[1].loss_texts == ["</turn> & <turn:x> &amp;"] and back[2].loss_texts == ["y"] and back[None].loss_texts == []
    raw = ['{"messages":[{"role":"user","content":"a"}]}', '{"instruction":"i","output":"o","more":1}', '{"prompt":"p","completion":"c"}', "no json", '{"z":1}', None]
    made = chat.canonical_turns_json(spark.createDataFrame(list(enumerate(raw)), "conv_id int, j string"), "j").orderBy("conv_id").collect()
    assert [r.layout for r in made] == ["messages", "instruction", "completion", None, None, None]
    assert [(x.role, x.text) for x in made[1].turns] == [("user", "i"), ("assistant", "o")]
    with pytest.raises(ValueError):
        chat.canonical_turns(t.select("conv_id"))
    wider = chat.canonical_turns(t.selectExpr("*", "'s' AS system", "'i' AS input", "'p' AS prompt"))
    assert {r.conv_id: r.turns for r in wider.collect()} == {r.conv_id: r.turns for r in turns.collect()}
    assert back[3].turns[0].role == "gpt" and back[3].loss_texts == []
    raw = ['{"messages":[{"role":"human","content":"a"}],"system":"s"}', '{"messages":[]}', '{"prompt":"p","response":"r","system":"s"}', '{"prompt":"p","response":"r"}']
    made = chat.canonical_turns_json(spark.createDataFrame(list(enumerate(raw)), "conv_id int, j string"), "j").orderBy("conv_id").collect()
    assert [r.layout for r in made] == ["messages", "messages", "prompt_system", "prompt"]
    assert [(x.role, x.text) for x in made[0].turns] == [("user", "a")] and made[1].turns == []
    # A changed path changes the print and the outcome; known paths of no mapping change the print only; any element of a list tells its fields.
    paths = ["prompt", "response"]
    assert chat.mapping_of(paths).name == "prompt" and chat.mapping_of(["prompt", "respons"]) is None and chat.mapping_of(["z", *paths]).name == "prompt"
    assert chat.fingerprint(paths) != chat.fingerprint(["prompt", "completion"]) and chat.mapping_of(["prompt", "completion"]).name == "completion"
    raw = ['{"messages":[{"content":"a"},{"role":"user","content":"b"}]}', '{"messages":[{"rol":"user","content":"b"}]}', '{"prompt":"p","response":"r","output":"o"}', '{"prompt":"p","respons":"r"}']
    made = chat.canonical_turns_json(spark.createDataFrame(list(enumerate(raw)), "conv_id int, j string"), "j").orderBy("conv_id").collect()
    assert [r.layout for r in made] == ["messages", None, "prompt", None]
    assert [(x.role, x.text) for x in made[0].turns] == [("", "a"), ("user", "b")]


def test_ann(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 8)).astype(np.float32)
    v[100:140] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] * 8), (5, v[5].tolist())]
    t = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.nearest(t, t.where("vec_id % 50 = 0 OR vec_id >= 900"), shard=256).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 50))
    hits = 0
    x = v.astype(float)
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(s - d[i]) < 1e-12 for _, i, s in found)
        hits += len({f[1] for f in found} & set(want))
    assert hits >= 0.9 * 10 * len(got)
    assert [f[1] for f in got[100]] == [3, *range(101, 110)]
    assert ann.nearest(t.limit(0), t.limit(0)).count() == 0


def luhn(d):
    t = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in t) % 10 == 0


def base(t):
    number = lambda m: re.sub("[^0-9]", "", m[0])
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(number(m)) <= 19 and luhn(number(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(number(m)) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(rules) for m in re.finditer(p, t) if good(m))


def test_pii(spark):
    rng = random.Random(5)
    parts = ["a", "b.c", "@", ".", "-", "1", "22", "255", "0", " ", "+1", "(", "é", "🙂", "%", "\n", "\x01", "x@y.zz", "4111 1111 1111 1111", "1.2.3.4", "+1 (017) 555-7713"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)]
    texts += ["1 " * 20000, "a@" + "b." * 20000 + "c", "a." * 20000 + "@b", None, "", "call me (555) 123-4567 now", "mail jo [at] site [dot] com"]
    found = pii.find_pii(docs(spark, texts), "text")
    rows = {r.doc_id: r for r in found.withColumn("clean", pii.redacted(F.coalesce("text", F.lit("")), F.col("spans"))).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, s.rank, s.end) for s in rows[i].base] == base(t or "")
        assert set(map(tuple, rows[i].base)) <= set(map(tuple, rows[i].spans))
    assert rows[len(texts) - 2].clean == "call me [PHONE] now" and "[EMAIL]" in rows[len(texts) - 1].clean
    assert pii.find_pii(docs(spark, texts).limit(0)).count() == 0
    said = {
        "tel 030 1234567 please": "tel [PHONE] please", "phone: 07911 123456": "phone: [PHONE]", "mail jo(at)site.org": "mail [EMAIL]",
        "card 4111.1111.1111.1111 x": "card [CARD] x", "host 10[.]0[.]0[.]7 x": "host [IP] x", "order 4111.1111.1111.1112 x": "order 4111.1111.1111.1112 x",
        "we meet at noon dot end": "we meet at noon dot end", "part 030 1234567 in stock": "part 030 1234567 in stock",
        "+1 202.555.0173.10@x.org": "[EMAIL]",
    }
    got = pii.find_pii(docs(spark, list(said)), "text").select("text", pii.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    assert {r.text: r.clean.replace("[PHONE][EMAIL]", "[EMAIL]").replace("[PHONE]", "[EMAIL]") if "@x" in r.text else r.clean for r in got} == said


def test_pii_precision_and_recall(spark):
    """On sentences that neither fit nor calibrate, with all kinds' added spans."""
    found, wanted, right = 0, 0, 0
    made = [(t, y) for t, y, held in pii.sentences(3900)[2400:]]
    rows = {r.doc_id: len(r.spans) > 0 for r in pii.find_pii(docs(spark, [t for t, _ in made])).collect()}
    for i, (_, y) in enumerate(made):
        found, wanted, right = found + rows[i], wanted + y, right + (rows[i] and y)
    assert right >= 0.95 * found and right >= 0.85 * wanted, (found, wanted, right)


def test_lines(spark):
    line = "the quick brown fox jumps over the lazy dog near the old river bank today"
    other = line.replace("lazy", "hazy")
    texts = [f"{line}\nOnly Here One Two Three Four", f"{line.upper()}!\nshort", f"{other}\nunique words stand in this very line", None, "", "x y z", "x y z"]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[1].text == "short" and got[3].text is None and got[4].text == "" and got[6].text == "x y z"
    assert (got[1].n_lines, got[1].n_removed) == (2, 1)
    assert got[2].text in (texts[2], "unique words stand in this very line") and got[2].lang == "en" and got[2].key == "y"
    long = " ".join(f"w{i}" for i in range(3000))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, [long, long + " more", long.replace("w7 ", "v7 ")])).collect()}
    assert [got[i].n_removed for i in range(3)] == [0, 1, 1]
    assert line_dedup.dedup_lines(docs(spark, texts).limit(0)).count() == 0


def links_by_brute_force(spark, lines):
    """Groups of the lines (a representative of each) by the edit similarity of all their pairs."""
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    longest = F.greatest(F.length("a.t"), F.length("b.t"))
    pairs = rows.alias("a").join(rows.alias("b"), F.expr("a.i < b.i")).where(F.levenshtein("a.t", "b.t") <= F.floor(longest * (1 - line_dedup.SIMILARITY) + 1e-9))
    group = list(range(len(lines)))
    for a, b in sorted(map(tuple, pairs.select("a.i", "b.i").collect())):
        low, high = sorted((group[a], group[b]))
        group = [low if g == high else g for g in group]
    return group


def test_lines_with_edits(spark):
    """One or two words of lines of 8 to 60 words change; found are those that brute force finds."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    lines = []
    for n in range(8, 61):
        for edits in (1, 2):
            own = [rng.choice(vocabulary) for _ in range(n)]
            near = list(own)
            for i in rng.sample(range(n), edits):
                near[i] = rng.choice(vocabulary)
            lines += [" ".join(own), " ".join(near)]
    group = links_by_brute_force(spark, lines)
    expected = {i for i, g in enumerate(group) if g != i}
    got = {r.doc_id for r in line_dedup.dedup_lines(docs(spark, lines)).where("n_removed > 0").collect()}
    assert len(expected) > 90 and got <= expected
    assert len(got) >= 0.99 * len(expected), f"{len(got)} of {len(expected)}"


def test_lines_of_interleaved_families(spark, monkeypatch):
    """All lines are in one bucket, where neighbours are mostly of other families."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    lines = []
    for _ in range(40):
        own = [word() for _ in range(12)]
        for i in range(3):
            lines.append(" ".join([*own[:i], word(), *own[i + 1 :]]))
    rng.shuffle(lines)
    group = links_by_brute_force(spark, lines)
    monkeypatch.setattr(line_dedup, "buckets_of", lambda: [F.lit(1).cast("bigint")])
    got = {r.doc_id for r in line_dedup.dedup_lines(docs(spark, lines)).where("n_removed > 0").collect()}
    assert len(set(group)) == 40 and got == {i for i, g in enumerate(group) if g != i}


def test_lines_of_rows_that_repeat_an_id(spark, monkeypatch):
    """Rows with one doc_id and other texts keep their own lines; buckets of more than a few lines are split without loss."""
    monkeypatch.setattr(line_dedup, "HOT", 2)
    rng = random.Random(13)
    line = [f"w{rng.randrange(10**6)}" for _ in range(30)]
    near = [" ".join([*line[:i], "changed", *line[i + 1 :]]) for i in range(12)]
    first, second = " ".join(line), "this other text stands alone under the same number here"
    texts, ids = [first, first, second, None, *near], [1, 7, 7, None, *range(10, 22)]
    got = line_dedup.dedup_lines(docs(spark, [*texts, first], [*ids, None])).collect()
    assert sorted(r.text for r in got if r.doc_id == 7) == ["", second]
    assert [r.text for r in got if r.doc_id == 1] == [first] and {r.text for r in got if r.doc_id and r.doc_id >= 10} == {""}
    assert sorted((r.text is None, r.n_removed) for r in got if r.doc_id is None) == [(False, 0), (True, 0)]


def rows_written(monkeypatch):
    """The rows of each table that line dedup writes, by name."""
    rows, write = {}, line_dedup.written

    def counted(df, name):
        out = write(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    return rows


def test_a_family_of_near_lines_is_not_split(spark, monkeypatch):
    """Large buckets whose lines are one group after the first round make no further rows."""
    rows = rows_written(monkeypatch)
    monkeypatch.setattr(line_dedup, "HOT", 2)
    rng = random.Random(15)
    line = [f"w{rng.randrange(10**6)}" for _ in range(30)]
    near = [" ".join([*line[:i], "changed", *line[i + 1 :]]) for i in range(20)]
    got = line_dedup.dedup_lines(docs(spark, near)).where("n_removed > 0").count()
    assert got == 19 and rows["met"] == rows["buckets"] and rows["met"][0] <= 20 * line_dedup.BUCKETS and rows["second"] == [0]


def test_common_short_words_are_no_buckets(spark, monkeypatch):
    rows = rows_written(monkeypatch)
    rng = random.Random(16)
    lines = [" ".join([*(f"word{rng.randrange(10**6)}" for _ in range(12)), "of the in to of a by of the to"]) for _ in range(60)]
    assert line_dedup.dedup_lines(docs(spark, lines)).where("n_removed > 0").count() == 0
    assert rows["buckets"] == [0]


def test_short_lines(spark, tmp_path):
    """The query drops every repeated line that has a letter or digit, and near lines of a script without spaces."""
    han = "".join(chr(0x4E00 + i * 7) for i in range(40))
    texts = ["Page 1\n\nNext", "page 1!\n\nNext", f"{han}\n---\n2", f"{han[:20]}x{han[21:]}\n---\n3", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].text for i in range(5)] == [texts[0], "", texts[2], "---\n3", None]
    assert [got[i].n_removed for i in range(5)] == [0, 2, 0, 1, 0]


def test_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer("byte_bpe_50k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    texts = [*corpus(4), "<|endoftext|>  two\n ", "one<|endoftext|>two <|endoftext|>", "<|endoftext|>", "don't 🙂 漢"]
    rows = packing.pack(docs(spark, texts), path, shard=32).collect()
    ids = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    seen, sequences = {}, {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in enumerate(ids):
        assert sum(n for _, n in seen[i]) == len(x) and sorted(seen[i])[0][0] == 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.WINDOW
    # Only the last sequence of a shard is padded, and that to a power of two.
    totals = [sum(n for _, n in parts) for parts in sequences.values()]
    padding = sum((1 << (t - 1).bit_length()) - t for t in totals if t < packing.WINDOW)
    shards = len({s >> 32 for s in sequences})
    assert sum(t < packing.WINDOW for t in totals) <= shards <= 2 * -(-len(texts) // 32) + 1 and padding < packing.WINDOW / 2 * shards
    assert packing.pack(docs(spark, texts).limit(0), path).count() == 0


def test_packing_brings_related_documents_together(spark):
    """Documents of a family meet in one shard, and mostly in one window, of many shards."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(("the", "of", "and", "to", "in", "it", "was", "for", "on", "with")) for _ in range(60)) for _ in range(400)]
    themes = ("volcano lava magma eruption", "violin orchestra symphony concerto", "penguin antarctica iceberg glacier", "goalkeeper penalty striker midfielder")
    family = {}
    for f, theme in enumerate(themes):
        for _ in range(5):
            family[len(texts)] = f
            texts.append(" ".join([*texts[rng.randrange(400)].split()[:40], *theme.split(), *theme.split()]))
    rows = packing.pack(docs(spark, texts), tokenizer("byte_bpe_50k.json"), shard=32).collect()
    assert len({r.sequence_id >> 32 for r in rows}) >= 12
    shards, windows = {}, {}
    for r in rows:
        if r.doc_id in family:
            shards.setdefault(family[r.doc_id], set()).add(r.sequence_id >> 32)
            windows.setdefault(family[r.doc_id], set()).add(r.sequence_id)
    assert sum(len(s) == 1 for s in shards.values()) >= 3 and sum(len(w) <= 2 for w in windows.values()) >= 3


def test_pieces(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "the", "é", "🙂", "\t", "don't", "</s>", "<0x0A>", "▁", "1", "漢", "hello", "ing"]
    texts = [*corpus(5), *("".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(300))]
    got = {r.doc_id: r for r in piece_fst.encode(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == sp.encode(t or "")
        assert got[i].decoded == sp.decode(got[i].ids)
        assert "▁" in (t or "") or got[i].decoded == (t or "")


def test_unigram_path():
    fst = piece_fst.Transducer(["<unk>", "▁a", "b", "▁ab", "c", "bc"], [0, -1.0, -2.0, -2.5, -1.0, -1.2], {}, {0}, bpe=False)
    assert fst.shortest("▁abc") == [1, 5] and fst.decode([1, 5]) == "abc"


def test_toxicity(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(("ba", "to", "ki", "len", "sor")) for _ in range(rng.randint(1, 3)))
    texts, marks = [], []
    for i in range(900):
        own = [word() for _ in range(rng.randint(5, 40))]
        bad = i % 6 == 0
        if bad:
            own[rng.randrange(len(own))] = rng.choice(("vile", "Foulness", "grub***"))
        texts.append(" ".join(own))
        marks.append(int(bad))
    texts += [None, ""]
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + [(5, None)], "doc_id bigint, toxic bigint")
    d = docs(spark, texts).withColumn("score", F.lit("mine"))
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels).withColumn("held", toxicity.held_out()).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in range(900) if got[i].held} == set(held)
    right = sum((got[i].score >= toxicity.THRESHOLD) == bool(marks[i]) for i in held)
    assert right >= 0.97 * len(held)
    assert 0 <= got[900].score < toxicity.THRESHOLD and got[900].score == got[901].score
    none = toxicity.toxicity(docs(spark, ["a"]), labels.limit(0)).first()
    assert none.score == 0.0 and hashlib is not None


def test_pairs_that_meet_are_verified_by_edit_similarity_alone(spark):
    """Pairs with one letter changed in each of many words, on both sides of the threshold, against the plain edit distance."""
    rng, rows = random.Random(4), []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    for i in range(60):
        words = [word() for _ in range(rng.choice([6, 16, 40]))]
        share = rng.choice([0.4, 0.6, 0.9, 1.0])
        rows.append((2 * i, 2 * i + 1, " ".join(words), " ".join("z" + w[1:] if rng.random() < share else w for w in words)))
    table = spark.createDataFrame(rows, "a long, b long, x string, y string")
    longest = F.greatest(F.length("x"), F.length("y"))
    wanted = table.where(F.levenshtein("x", "y") <= F.floor(longest * (1 - line_dedup.SIMILARITY) + 1e-9)).select("a", "b").collect()
    texts = table.selectExpr("a AS key", "x AS text").unionByName(table.selectExpr("b AS key", "y AS text"))
    got = line_dedup.verified(table.select("a", "b"), texts, line_dedup.SIMILARITY).collect()
    assert 30 < len(wanted) < 60 and sorted(map(tuple, got)) == sorted(map(tuple, wanted))


def test_pairs_are_told_apart_by_their_ends_without_loss(spark):
    """The test by starts and ends keeps every pair that the plain edit distance links, and drops lines that only hold one phrase in common."""
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    line = lambda n: [word() for _ in range(n)]
    for i in range(120):
        words, phrase = line(rng.choice([1, 6, 16, 40])), line(6)
        share, at = rng.choice([0.3, 0.6, 0.9, 1.0]), rng.randrange(len(words) + 1)
        near = ["z" + w[1:] if rng.random() < share else w for w in words]
        near = rng.choice([near, near[:at] + line(rng.randint(0, len(words) // 4)) + near[at:], near[rng.randint(0, len(words) // 4) :] or ["z"]])
        rows.append((4 * i, 4 * i + 1, " ".join(words), " ".join(near)))
        rows.append((4 * i + 2, 4 * i + 3, " ".join([*line(20), *phrase, *line(20)]), " ".join([*line(15), *phrase, *line(25)])))
    table = spark.createDataFrame(rows, "a long, b long, x string, y string")
    most = F.floor(F.greatest(F.length("x"), F.length("y")) * (1 - line_dedup.SIMILARITY) + 1e-9).cast("int")
    wanted = set(map(tuple, table.where(F.levenshtein("x", "y") <= most).select("a", "b").collect()))
    left = set(map(tuple, table.where(line_dedup.ends_match("x", "y", most)).select("a", "b").collect()))
    assert len(wanted) > 30 and wanted <= left and sum(a % 4 == 2 for a, _ in left) < 12
    texts = table.selectExpr("a AS key", "x AS text").unionByName(table.selectExpr("b AS key", "y AS text"))
    for unlike in (False, True):
        got = line_dedup.verified(table.select("a", "b"), texts, line_dedup.SIMILARITY, mostly_unlike=unlike).collect()
        assert set(map(tuple, got)) == wanted
