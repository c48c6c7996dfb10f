"""Search, archives, chats, models and the pipeline against brute force or held-out labels."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import chat, quality, top_k, toxicity, warc


def best_rows(rows, asked, k=10):
    """For each row that is asked for, the k best of all others, by row and not by id."""
    want = []
    for n, (i, q) in enumerate(rows):
        if asked(i):
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for m, (j, c) in enumerate(rows) if m != n and len(c) == len(q))[:k]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(want)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SEEDS", 50)
    monkeypatch.setattr(top_k, "TILE", 64)
    monkeypatch.setattr(top_k, "CHUNK_BYTES", 60_000)
    rng = np.random.default_rng(1)
    v = rng.normal(0, 0.2, (700, 48))
    v[100:110] = v[5]
    rows = [(i, [float(np.float32(x)) for x in row], 1) for i, row in enumerate(v)]
    rows += [(900, None, 1), (1000, [float("nan")] * 48, 1), (1100, [None] * 48, 1), (None, [0.1] * 48, 1), (1200, [0.5] * 4, 1), (1201, [0.25] * 4, 1), (1300, [float("inf")] * 4, 1)]
    rows += [(400, rows[7][1], 1), (400, rows[400][1], 1), (8, rows[8][1], 1), (1500, [], 1), (1600, [], 1), (1700, [1e9, 2.0, -3.0], 1), (1800, [1e3, 2e3, 5.0], 1)]
    table = top_k.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"))
    got = top_k.top_k(table, F.col("vec_id") % 100 == 0, 10).collect()
    ints = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in e]) for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = best_rows(ints, lambda i: i % 100 == 0)
    assert sorted(tuple(r) for r in got) == want
    other = top_k.top_k(table, table.where("vec_id = 5"), 3).collect()
    assert sorted((r.rank, r.vec_id) for r in other) == [(1, 5), (2, 100), (3, 101)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k.top_k(top_k.integers(none), F.col("vec_id") % 100 == 0).count() == 0


def test_seeds_are_drawn_in_the_scan(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SEEDS", 40)
    rows = spark.range(20_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 500 == 0, F.array(F.lit(1))).otherwise(F.array("id", F.lit(2))).cast("array<long>").alias("v"))
    rows = rows.select("vec_id", "v", F.size("v").alias("d"), F.col("vec_id").alias("row"))
    drawn = top_k.drawn(rows)
    counts = {r.d: r["count"] for r in drawn.groupBy("d").count().collect()}
    assert 40 <= counts[2] <= 160 and counts[1] == 40
    assert "Exchange" not in drawn._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(top_k, "LENGTHS", 1)
    assert 40 <= top_k.drawn(rows).where("d = 2").count() <= 160


def test_vectors_of_rare_lengths_need_no_seeds(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SEEDS", 2)
    monkeypatch.setattr(top_k, "LENGTHS", 1)
    rng = random.Random(2)
    rows = [(i, [rng.randint(-50, 50) for _ in range(3 if i % 40 else 5)]) for i in range(400)]
    got = top_k.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0, 4).collect()
    assert sorted(map(tuple, got)) == best_rows(rows, lambda i: i % 20 == 0, 4)


def test_segment_bound_holds_and_prunes():
    rng = np.random.default_rng(2)
    v = rng.integers(-400, 400, (60, 40))
    turn = top_k.axes(v)
    assert np.allclose(turn.T @ turn, np.eye(40))
    for size in top_k.levels(40):
        bound = top_k.segments(v.astype(float) @ turn, size) @ top_k.segments(v.astype(float) @ turn, size).T
        assert (bound >= (v @ v.T) - 1e-3).all()
    # vectors that vary in a few directions: most pairs never get an exact score
    centres = rng.normal(0, 300, (20, 64))
    near = lambda n: (centres[rng.integers(0, 20, n)] + rng.normal(0, 20, (n, 64))).astype(np.int64)
    queries, all_of_them = near(500), near(6000)
    turn = top_k.axes(all_of_them[:1000])
    q = top_k.Side(np.arange(500) + 10_000, np.arange(500) + 10_000, queries, turn)
    c = top_k.Side(np.arange(6000), np.arange(6000), all_of_them, turn)
    search, scores = top_k.Search(64, 10), queries @ all_of_them.T
    floor = np.sort(scores[:, :1000], axis=1)[:, -10].astype(float)
    query, cand, score = search.best(q, c, floor[q.order])
    for i in range(0, 500, 50):
        best = sorted((-s, j) for j, s in enumerate(scores[i].tolist()))[:10]
        mine = q.order[query] == i
        assert [(-s, j) for s, j in zip(score[mine].tolist(), c.ids[cand[mine]].tolist())] == best
    assert search.scored < 0.5 * search.pairs, (search.seen, search.scored / search.pairs)


def test_a_full_tile_is_small():
    """One tile of queries and candidates stays far below an executor's memory."""
    import tracemalloc

    rng = np.random.default_rng(3)
    v = rng.integers(-400, 400, (8192, 64))
    turn = top_k.axes(v[:1024])
    q, c = (top_k.Side(np.arange(4096) + s, np.arange(4096) + s, v[s : s + 4096], turn) for s in (0, 4096))
    tracemalloc.start()
    query, _, _ = top_k.Search(64, 10).best(q, c, np.full(4096, -np.inf))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(query) == 40960 and peak < 400 << 20


def test_warc_round_trip(spark, tmp_path):
    pages = [(5, "http://a/", "<p>one</p>"), (2, None, "<p>one</p>"), (9, "u\r\nX: y", "<p>one</p>"), (7, "é", "größe"), (3, "n", None), (4, "n", ""), (None, "n", "größe"), (None, "z", "only"), (9, "u\r\nX: y", "<p>one</p>")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    made = []
    for k in (1, 3):
        folder = f"file://{tmp_path}/w{k}"
        manifest = warc.write(df.repartition(k), folder, shard_bytes=12, file_bytes=700)
        made.append(sorted(tuple(r) for r in manifest.collect()))
        assert sum(r[1] for r in made[-1]) == len(pages)
        (tmp_path / f"w{k}" / "part-000000-00099.warc.gz").write_bytes(b"left by a lost task")
        first = {}
        for i, _, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
            first.setdefault(h or "", i)
        want = []
        for i, u, h in pages:
            raw = (h or "").encode()
            low = first.get(h or "")
            back = low if low is not None and low != i else None
            want.append((i, u, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if back is None else "revisit", back, bytes(raw) if back is None else None))
        key = lambda r: str(r)
        got = [tuple(None if x is None else bytes(x) if isinstance(x, bytearray) else x for x in r) for r in warc.read(spark, folder).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    # rows without an id are cut by their payloads' digests; a shard of one record, and files that roll within one
    nulls = spark.createDataFrame([(None, "u", f"text {k}" * 40) for k in range(60)] + [(1, "u", "x" * 300_000), (2, "u", "y" * 50)], "page_id long, url string, html string")
    parts = warc.write(nulls, f"file://{tmp_path}/nulls", shard_bytes=500, file_bytes=300).collect()
    assert len({r.file[:11] for r in parts}) > 20 and len(parts) >= len({r.file[:11] for r in parts}) and sum(r.records for r in parts) == 62
    whole = warc.write(nulls, f"file://{tmp_path}/rolled", shard_bytes=1 << 30, file_bytes=1000).collect()
    assert {r.file[:11] for r in whole} == {"part-000000"} and len(whole) > 5 and all(r.bytes >= 1000 for r in whole[:-1])
    back = warc.read(spark, f"file://{tmp_path}/rolled").collect()
    assert len(back) == 62 and max(r.payload_bytes for r in back) == 300_000 and sum(r.page_id is None for r in back) == 60
    assert made[0] == made[1]  # the same bytes under the same names, however the rows were dealt
    empty = f"file://{tmp_path}/empty"
    assert warc.write(spark.createDataFrame([], "page_id long, url string, html string"), empty).count() == 0
    assert warc.read(spark, empty).count() == 0


def test_chat_collapses_prefixes(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    rng = random.Random(4)
    turns = [("user" if i % 2 == 0 else "assistant", f"t{rng.randint(0, 2)}") for i in range(12)]
    talks = {1: turns[:4], 2: turns, 3: turns[:7], 4: turns[:7], 5: [("user", "other")] + turns, 6: turns, 7: [(None, None)], 8: turns[1:5]}
    rows = [(c, i, r, t, "x") for c, talk in talks.items() for i, (r, t) in enumerate(talk)] + [(None, 0, "user", "x", ""), (9, None, "user", "x", "")]
    rng.shuffle(rows)
    got = {r.conv_id: r for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string")).collect()}
    clean = {c: [(r or "", t or "") for r, t in talk] for c, talk in talks.items()}
    want = {}
    for c, talk in clean.items():
        longer = any(len(o) > len(talk) and o[: len(talk)] == talk for o in clean.values())
        if not longer and c == min(k for k, o in clean.items() if o == talk):
            want[c] = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in talk)
    assert {c: r.rendered for c, r in got.items()} == want
    assert sum(r.n_collapsed + 1 for r in got.values()) == len(talks)
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    root = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")


def test_toxicity_finds_labelled_documents(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    assert model.thresholds[0] <= model.thresholds[1] and min(model.words.values()) > 0
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    flagged = [r for r in rows if r.grade > 0]
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(truth[r.doc_id] for r in flagged) >= 0.95 * len(flagged) and sum(truth[r.doc_id] for r in flagged) >= 0.6 * sum(truth.values())
    assert all(0 <= r.severity <= 2 for r in rows)


def test_toxicity_learns_from_few_texts_in_every_language(spark, corpus):
    root = "/root/testdata/sf0.001"
    own = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    few, some = toxicity.fit(*own), toxicity.fit(*corpus)
    unseen = corpus[0].join(own[0].select("text"), "text", "left_anti")
    for model, docs, labels, recall in ((few, *own, 0.9), (some, *corpus, 0.9), (few, unseen, corpus[1], 0.4)):
        rows = toxicity.score(docs, model).join(labels.selectExpr("doc_id", "toxic as truth"), "doc_id").collect()
        assert sum(r.grade > 0 for r in rows if r.truth) >= recall * sum(r.truth for r in rows)
        assert sum(r.grade > 0 for r in rows if not r.truth) <= 0.01 * len(rows)
    rows = toxicity.score(corpus[0].where("lang <> 'en'"), some).join(corpus[1].where("toxic = 1").select("doc_id"), "doc_id").collect()
    assert len(rows) > 10 and all(r.grade > 0 for r in rows)


def test_toxicity_edges(spark, corpus):
    odd = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "fine", 3), (2, "fine", 3)], "doc_id long, text string, toxic int")
    none = toxicity.score(odd, toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int")))
    assert none.columns == ["doc_id", "toxic", "severity", "grade", "_toxic"]
    assert none.count() == 4 and none.where("_toxic or severity > 0").count() == 0
    assert toxicity.not_toxic(odd, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")).count() == 4


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 600)
    doc, x = np.arange(600), 1 + grade + rng.normal(0, 0.2, 600)
    w, t = toxicity._cumulative_link(doc, np.zeros(600, int), x, grade, 1)
    guess = (x * w[0] > t[0]).astype(int) + (x * w[0] > t[1])
    assert (guess == grade).mean() > 0.9


def test_growing_fit_is_the_fit_over_all_features():
    """What the growing set ends with meets the conditions of a minimum over every feature."""
    rng = np.random.default_rng(1)
    n, width = 400, 600
    grade = rng.integers(0, 3, n)
    rows = [np.unique(np.concatenate([rng.integers(0, width, 12), rng.choice(5, grade[i], replace=False)])) for i in range(n)]
    doc, at = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows)
    x = 1 + rng.random(len(at))
    w, t = toxicity._growing(doc, at, x, grade, width, steps=3000)
    d1, d2 = toxicity._slopes(np.bincount(doc, weights=x * w[at], minlength=n), t, grade)
    gain = -np.bincount(at, weights=x * (d1 + d2)[doc], minlength=width)
    assert (w >= 0).all() and (w[:5] > 0.5).all() and (gain < 1.1 * toxicity.PRIOR + 0.2).all()
    assert np.abs(gain[w > 0.05] - toxicity.PRIOR).max() < 0.5
    loss = lambda w: -np.log([1 - p[0] if g == 0 else p[0] - p[1] if g == 1 else p[1] for g, p in zip(grade, 1 / (1 + np.exp(t - np.bincount(doc, weights=x * w[at], minlength=n)[:, None])))]).sum() + toxicity.PRIOR * w.sum()
    for _ in range(50):
        other = np.maximum(w + rng.normal(0, 0.05, width) * (rng.random(width) < 0.05), 0)
        assert loss(other) > loss(w) - 0.5


def test_toxicity_on_held_out_documents(spark, corpus):
    docs, labels = corpus
    held = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 0"
    model = toxicity.fit(docs.where(f"not {held}"), labels)
    seen = docs.where(f"not {held}").select("text")
    rows = toxicity.score(docs.where(held).join(seen, "text", "left_anti"), model).join(labels.selectExpr("doc_id", "toxic as truth"), "doc_id").collect()
    assert sum(r.grade > 0 for r in rows if r.truth) >= 0.6 * sum(r.truth for r in rows) > 5
    assert sum(r.grade > 0 for r in rows if not r.truth) <= 0.02 * len(rows)


def test_toxicity_ties_and_long_texts(spark, corpus):
    model = toxicity.Severity({b"bad": 1.0}, (1.0, 2.0))
    rows = [(1, "bad"), (1, "bad"), (2, "good " * 200_000 + "bad"), (3, "BAD! bad")]
    got = {(r.doc_id, round(r.severity, 9), r.grade) for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    at = lambda s: round(sum(float(1 / (1 + np.exp(t - s))) for t in (1.0, 2.0)), 9)
    # a probability of just the threshold passes it
    assert got == {(1, at(1.0), 1), (2, at(1.0), 1), (3, at(1 + np.log(2)), 1)}


def test_quality_on_held_out_documents(spark, corpus):
    docs, labels = corpus
    rows = quality.score(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_quality_equals_plain_class_normals(spark, corpus):
    """Means and covariances of each class by numpy over all learnt rows, densities by their determinants and inverses."""
    docs, labels = corpus
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = docs.select("doc_id", "text").collect()
    x = np.array([quality.statistics(r.text) for r in rows])
    learnt = np.array([r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in rows])
    y = np.array([truth.get(r.doc_id, -1) for r in rows])
    own = [np.cov(x[learnt & (y == c)].T, bias=True) for c in (0, 1)]
    n = [int((learnt & (y == c)).sum()) for c in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    logs = []
    for c in (0, 1):
        s = (1 - quality.POOLED - quality.DIAGONAL) * own[c] + quality.POOLED * pooled + quality.DIAGONAL * np.diag(np.diag(own[c]))
        s = s + quality.RIDGE * np.diag(np.diag(pooled) + quality.RIDGE)
        d = x - x[learnt & (y == c)].mean(axis=0)
        logs.append(np.log(n[c] / sum(n)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    want = {r.doc_id: v for r, v in zip(rows, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))))}
    got = quality.score(docs, labels).collect()
    assert len(got) == len(want) and all(abs(r.score - want[r.doc_id]) < 1e-6 for r in got)


def test_quality_at_the_threshold_and_of_no_rows(spark, corpus):
    docs = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 1000) if zlib.crc32(str(i).encode()) % 5][:3] + [(2000 + i, 0) for i in range(20) if zlib.crc32(str(2000 + i).encode()) % 5][:7], "doc_id long, quality int")
    one_class = quality.score(labels.selectExpr("doc_id", "'x' as text").where("doc_id < 1000").union(docs), labels)
    assert {(r.score, r.predicted) for r in one_class.collect()} == {(1.0, 1)}
    assert quality.score(docs, labels, threshold=0.5).where("score = 0.5 and predicted = 0").count() == 0
    assert quality.score(corpus[0].limit(0), corpus[1]).count() == 0 and toxicity.score(corpus[0].limit(0), toxicity.Severity({}, (0.0, 0.0))).count() == 0


def test_quality_ignores_held_out_labels_and_takes_odd_rows(spark, corpus):
    docs, labels = corpus
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in quality.score(docs, x).collect()) for x in (labels, flipped))
    assert a == b
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "x " * 9000, 1)], "doc_id long, text string, score int")
    assert [r.score for r in quality.score(odd, spark.createDataFrame([], "doc_id long, quality int")).collect()] == [0.5] * 4


def test_pipeline_stages(spark):
    import corpus_pipeline

    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        from recordloom.llm.common import staged

        docs = staged(stage(spark, docs, root), "test")
        counts.append(docs.count())
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    assert corpus_pipeline.run(spark, root).count() == counts[-1]


def test_pipeline_against_brute_force(spark, tmp_path):
    """A table on which each stage takes something away, against plain Python, stage after stage."""
    import corpus_pipeline

    rng = random.Random(3)
    words = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, run = prose(20), [prose(15) for _ in range(5)]
    texts = [prose(120) for _ in range(60)]
    texts[5:15] = [f"{t} vilecurse {t[:40]} vilecurse" for t in texts[5:15]]
    texts[20] = "\n".join([prose(30), *run, prose(30)])
    texts[21] = "\n".join([prose(40), *run])
    texts[30] = texts[31] + " one more"
    texts[40] = f"{prose(30)} {item} {prose(30)}"
    texts[41] = f"{prose(3000)} {item}"
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)] + [(90, None, None, None, None), (91, "", "en", "src", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    toxic = [(i, 1, int("vilecurse" in t)) for i, t in enumerate(texts)]
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("q1", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {i: t for i, t, *_ in rows if "vilecurse" not in (t or "")}
    kept[21] = texts[21].split("\n")[0]
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in kept.items() if t}
    for i in sorted(shingles):
        for j in sorted(shingles):
            if j < i and j in kept and i in kept and 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j]):
                del kept[i]
    del kept[91]  # null and empty texts are alike
    hit = item.split()
    hits = {i for i, t in kept.items() if t and " ".join(hit) in t and 20 * len(hit) >= len(t.split())}
    assert hits == {40} and 41 in kept
    kept.pop(40)
    from public_tokenizers import path
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path("byte_bpe_multi_50k.tiktoken"), "rb").read().splitlines())}
    import public_tokenizers
    import tiktoken

    bpe = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {(i, len(ids := bpe.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in kept.items()}
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and len(want) < len(rows) - 12
