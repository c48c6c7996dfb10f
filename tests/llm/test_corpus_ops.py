"""Phrases, spelling variants and shards against brute force, with nulls, empties, ties and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from recordloom.llm import collocation, sharding, spelling

ROOT = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def phrases(rows, max_words, least, top):
    """Every rank by counting all runs."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text)):
            words = tuple(w for w in re.split(r"[ \t]+", piece) if w)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    f[lang, words[i : i + m]] += 1
    some = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in some.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(x == lang and len(q) > len(p) and inside(q) and 100 * b >= 80 * a for (x, q), b in some.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), a, l, r, n[lang], score))
    return {(lang, i, p.decode(), *rest) for lang, rows in out.items() for i, (_, _, p, *rest) in enumerate(sorted(rows)[:top], 1)}


def prose(seed, n):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        words = [rng.choice(["New York", "new  York City", "ab", "ÀB", "àb", "x", "y", "z", "very very", "in spite of the", "in spite\tof", "-", "a b"]) for _ in range(rng.randint(0, 30))]
        text = "".join(w + rng.choice([" ", " ", " ", ", ", "\n", ". ", "\r\n", "\t", "!"]) for w in words)
        rows.append((rng.choice([text, text, text, None, "", " .. "]), rng.choice(["en", "en", "de", None, "und"])))
    return rows + rows[:5]


@pytest.mark.parametrize(("sent", "parts", "max_words"), [(1 << 19, 64, 4), (0, 2, 4), (1 << 19, 64, 2), (0, 64, 6)])
def test_collocations_equal_brute_force(spark, monkeypatch, sent, parts, max_words):
    monkeypatch.setattr(collocation, "SENT", sent)
    monkeypatch.setattr(collocation, "PARTS", parts)
    rows = prose(3, 120)
    docs = spark.createDataFrame([(*r, 7, "p", 1) for r in rows], "text string, lang string, n int, phrase string, f int")
    got = collocation.collocations(docs, max_words, 4, 9)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == phrases(rows, max_words, 4, 9)


def test_collocations_of_nothing_and_of_one_long_piece(spark):
    assert collocation.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocation.collocations(spark.createDataFrame([(None, None), ("", "en"), ("one two", "en")], "text string, lang string")).count() == 0
    long = [("go on " * 40_000, "en")]
    got = collocation.collocations(spark.createDataFrame(long, "text string, lang string"))
    assert {tuple(r) for r in got.collect()} == phrases(long, 4, 30, 2000)


def test_collocations_shuffle_no_texts(spark, monkeypatch):
    """With more frequent pairs than were once sent around, texts met them in shuffled joins, a row for each word."""
    monkeypatch.setattr(collocation, "SENT", 0)
    monkeypatch.setattr(collocation, "HELD", 0)
    monkeypatch.setattr(collocation, "NOTED", 4)  # hardly a hash is told apart: all runs are counted as texts
    rows = prose(5, 80)
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = collocation.collocations(docs, 4, 4, 9)
    assert {tuple(r) for r in got.collect()} == phrases(rows, 4, 4, 9)
    plan = collocation._phrases(docs, 4, 4, [])._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_collocation_scores_pass_64_bits(spark):
    a, l, r = 9_000_000_000_000_000_000, 9_100_000_000_000_000_001, 9_200_000_000_000_000_003
    counts = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    score = counts.select(F.expr(f"cast((cast({collocation.SCALE} AS decimal(7,0)) * cast(a AS decimal(20,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0))) AS long)")).first()[0]
    assert score == 2_000_000 * a // (l + r)


def variants(rows, ratio=10):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= ratio * n[w] else None, len(close))
    rows = set()
    for w, (form, close) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n[w], close, n[form] if form else None))
    return rows


def misspelt(seed):
    rng = random.Random(seed)
    base = ["colours", "Colours", "neighbour", "Straßen", "ÉTUDES×", "aaaaaaa", "aabaaaa", "abcdefgh", "short", "a" * 60]
    rows = []
    for d in range(150):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(base[:3] * 6 + base)
            if rng.random() < 0.25:
                p = rng.randrange(len(w) + 1)
                w = w[:p] + rng.choice(["", "a", "b", "é", "s"]) + w[p + rng.randint(0, 1) :]
            words.append(w)
        rows.append((rng.choice([d, d, d, None]), rng.choice([" ", "-", "1", ", "]).join(words)))
    rows += [(900 + i, "rootword " * k + x) for i, (k, x) in enumerate([(400, "rootwort " * 40), (0, "rootwors " * 4), (0, "rootwors"), (1, "tootwort tootwort")])]
    return rows + [(1, None), (2, ""), (3, "12 34"), (4, "colours " * 3000)] + rows[:3]


def test_variants_equal_brute_force(spark):
    rows = misspelt(4)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = spelling.variants(spelling.word_counts(docs))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants(rows)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert any(form != root and form for _, form, root, *_ in want)
    assert spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0


def test_chains_of_forms_are_followed(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(12)] + [("v", "w3"), ("lone", "end")]
    got = spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()
    assert {tuple(r) for r in got} == {(w, "end" if w == "lone" else "w12") for w, _ in forms}


def sharded(rows, shards, whole=64):
    """(doc_id, size, checksum, shard, slot) from one sorted list."""
    key = lambda x: int(hashlib.md5(("" if x is None else str(x)).encode()).hexdigest()[:15], 16)
    order = sorted((key(t), key(d), str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    total, at, out, ends = sum(x[3] for x in order), 0, [], {}
    for k, _, d, size, crc in order:
        ends.setdefault(k, [at, at])[1] = at + size
        out.append([k, d, size, crc, at * shards // total])
        at += size
    slots, done = Counter(), []
    for k, d, size, crc, s in out:
        own = [x[4] for x in out if x[0] == k]
        a, b = ends[k]
        if min(own) < max(own) and (b - a) * shards * whole <= total:
            s = max(own) if 2 * total * max(own) <= shards * (a + b) else min(own)
        done.append((d, size, crc, s, slots[s]))
        slots[s] += 1
    return sorted(done)


def texts(seed, n):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("abc é") for _ in range(rng.randint(0, 400)))) for i in range(n)]
    rows += [(1000 + i, "the same text " * 20) for i in range(n // 3)] + [(2000 + i, rng.choice([None, ""])) for i in range(n)] + [(3000 + i, f"pair {i % 40}") for i in range(80)]
    return rows + [(None, "x"), (5000, "long " * 2000)]


@pytest.mark.parametrize(("shards", "whole", "over"), [(40, 64, 3), (7, 2, 3), (3, 64, 1), (1, 64, 3)])
def test_shards_equal_one_sorted_list(spark, monkeypatch, shards, whole, over):
    for name, value in (("WHOLE", whole), ("OVERFULL", over), ("SAMPLES", 4)):
        monkeypatch.setattr(sharding, name, value)
    rows = texts(shards, 150)
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards, keep=["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in got) == sharded(rows, shards, whole)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_shards_are_even_and_keep_equal_texts_together(spark):
    rows = [(i, f"text {i % 4000} " * (1 + i % 7)) for i in range(8000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    size, groups = Counter(), defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        groups[r.text].add(r.shard)
    mean = sum(size.values()) / 10
    assert len(size) == 10 and max(abs(s - mean) for s in size.values()) < mean / 50
    assert all(len(s) == 1 for s in groups.values())


def test_overfull_ranges_are_cut_by_rows(spark):
    rows = [(i, "") for i in range(3000)] + [(5000 + i, "x" * 5000) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = []
    places = sharding.Ranges.places
    sharding.Ranges.places = lambda self: kept.append(dict(self.sizes)) or places(self)
    try:
        got = sharding.sharded(table, 4, keep=["doc_id"]).collect()
    finally:
        sharding.Ranges.places = places
    counts = [n for _, n in kept[0].values()]
    assert sum(counts) == 3040 and max(counts) <= 3 * sharding.OVERFULL * 3040 / (sharding.RANGES * 4)
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in got) == sharded(rows, 4)


def test_shards_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, size string, shard int, k1 int, at int, row string"
    rows = [(1, "a", "s", 9, 1, 2, "r"), (1, "a", "s", 9, 1, 2, "r"), (1, "a", "s", 9, 1, 2, "r"), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = sharding.sharded(docs, 2)
    assert got.columns == [*docs.columns, "_size", "text_crc32", "law", "_shard", "slot", "grown_shard"]
    assert sorted((str(r.doc_id), r["size"], r.shard, r["_size"]) for r in got.collect()) == [("1", "s", 9, 17)] * 3 + [("None", None, None, 16)]
    for shard in (0, 1):
        assert sorted(r.slot for r in got.where(f"_shard = {shard}").collect()) == list(range(got.where(f"_shard = {shard}").count()))
    assert sharding.sharded(docs.limit(0), 2).count() == 0
    sharding.write(docs.select("doc_id", "text"), str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_sharding_plan_is_native(spark):
    got = sharding.op13_sharding(spark, ROOT)
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn|ExistingRDD", plan)


@pytest.mark.parametrize(("query", "sql"), [(collocation.op11_collocations, collocation.OP11_SQL), (spelling.op12_spelling, spelling.OP12_SQL), (sharding.op13_sharding, sharding.OP13_SQL)])
def test_queries_equal_their_sql(spark, query, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{ROOT}/documents.parquet'")
    got = query(spark, ROOT)
    want = con.execute(sql)
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
