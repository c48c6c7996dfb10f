"""Each operator against brute force on small tables, with nulls, empties, ties and clashing names."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from recordloom.llm import byte_bpe, decontaminate, html_text, jaccard, line_dedup, simhash

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", ".", ","]) for _ in range(n))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [prose(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines)))
    passage = prose(rng, 60)
    for i in (3, 9, 20):
        rows[i] = (i, rows[i][1] + "\n" + passage)
    rows[30] = (30, rows[10][1])
    words = rows[11][1].split(" ")
    rows[31] = (31, " ".join(words[:-1] + ["changed"]))
    rows += [(100, None), (101, ""), (102, " \n "), (None, rows[10][1]), (103, "one"), (104, "one"), (104, "one"), (105, "x " * 5000)]
    return rows


SCHEMA = "doc_id long, text string"


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(ids, fps, radius=4):
    group = list(range(len(ids)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                group[find(i)] = find(j)
    out = {}
    for i in range(len(ids)):
        out.setdefault(find(i), []).append(ids[i])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in out.items()}
    return [low[find(i)] for i in range(len(ids))]


def test_simhash_equals_brute_force(spark):
    rows = documents()
    got = simhash.near_duplicates(spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA + ", fp string, key int")).collect()
    fps = [fingerprint(t) for _, t in rows]
    want = sorted((d is None, d or 0, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, components([d for d, _ in rows], fps)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got) == want


@pytest.mark.parametrize("crowd", [4, 4096])
def test_links_connect_all_pairs(spark, crowd):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base[:3] for _ in range(60)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), crowd).collect()
    unsigned = [x & (1 << 64) - 1 for x in fps]
    want = components(fps, unsigned)
    at = {x: i for i, x in enumerate(fps)}
    group = list(range(len(fps)))
    for e in edges:
        assert bin((e.a ^ e.b) & (1 << 64) - 1).count("1") <= 4
        a, b = group[at[e.a]], group[at[e.b]]
        group = [b if g == a else g for g in group]
    got = [min(f for f, g in zip(fps, group) if g == group[i]) for i in range(len(fps))]
    assert got == want


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def first_of_alike(rows):
    """Ids of the first document of each group of texts that five-word shingles link, by brute force."""
    sets = [five_words(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or (sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                group = [group[j] if g == group[i] else g for g in group]
    return sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))


def test_pipeline_drops_near_duplicates_by_shingles(spark):
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(3, 300))) for i in range(120)]
    for i in range(120, 400):
        words = rows[rng.randrange(i)][1].split(" ")
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "one"), (503, "One"), (504, "one two"), (505, "x " * 5000)]
    want = first_of_alike(rows)
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) != want
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (None, "c"), (None, "c"), (7, "d"), (7, "d")], SCHEMA)
    assert sorted(map(str, (r.doc_id for r in simhash.one_of_each(odd, groups=jaccard.groups).collect()))) == ["3", "7", "None"]
    assert simhash.one_of_each(odd.limit(0), groups=jaccard.groups).count() == 0


def test_simhash_links_say_who_is_compared(spark, monkeypatch):
    signed = jaccard._signed

    def without_bands(batches):
        for batch in signed(batches):
            none = pa.array([[]] * batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], none], names=batch.schema.names)

    monkeypatch.setattr(jaccard, "_signed", without_bands)
    rng = random.Random(5)
    words = prose(rng, 2000).split(" ")
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "last"])), (3, prose(rng, 2000)), (4, ""), (5, None)]
    assert (fingerprint(rows[0][1]) ^ fingerprint(rows[1][1])).bit_count() <= simhash.RADIUS
    kept = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA), groups=jaccard.groups)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] == first_of_alike(rows)


@pytest.mark.parametrize("held, each", [(1 << 19, 1024), (3000, 50), (600, 50)])
def test_crowded_groups_are_taken_apart(spark, monkeypatch, held, each):
    monkeypatch.setattr(jaccard, "HELD", held)
    monkeypatch.setattr(jaccard, "EACH", each)
    rng = random.Random(11)
    base = prose(rng, 150).split(" ")
    rows = []
    for i in range(160):  # one large group of near copies of growing length, partly alike
        words = base[: rng.randint(60, 150)] + prose(rng, rng.randint(1, 30)).split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((i, " ".join(words)))
    for i in range(160, 260):  # a chain, each text a shift of the one before
        words = rows[-1][1].split(" ")[4:] + prose(rng, 4).split(" ")
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, SCHEMA)
    own, labels = jaccard.groups(docs, "doc_id", "text")
    assert sorted(r.rep.doc_id for r in labels.groupBy("root").agg(F.min("rep").alias("rep")).collect()) == first_of_alike(rows)
    sets = spark.createDataFrame([(7, i, 1 + i * 5) for i in range(200)], "group long, fp long, size long")
    cells = jaccard._blocks(sets.withColumnRenamed("group", "unit")).collect()
    met = {}
    for r in cells:
        met.setdefault(r.group, set()).add(r.fp)
    for a in range(200):
        for b in range(a):
            if 5 * (1 + b * 5) >= 4 * (1 + a * 5):
                assert any({a, b} <= c for c in met.values())


def test_keys_with_many_rows_are_joined_without_a_shuffle(spark):
    from recordloom.llm import common

    left = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)], "k long, v long")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").where("k % 2 = 0").withColumn("w", F.col("k") + 1)
    got = common.split_join(left, right, ["k"], "n")
    assert got.columns == ["k", "v", "w"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, v, k + 1) for k, v in ((0 if i % 3 else i, i) for i in range(3000)) if k % 2 == 0)
    assert common.split_join(left, right, ["k"], "n", semi=True).count() == got.count()
    assert common.split_join(left, right.limit(0), ["k"], "n").count() == 0


def test_one_of_each_keeps_columns_and_one_row(spark):
    rows = documents()
    docs = spark.createDataFrame([(d, t, f"k{i}") for i, (d, t) in enumerate(rows)], SCHEMA + ", key string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    fps = [fingerprint(t) for _, t in rows]
    assert kept.count() == len({(c, f if c is None else 0) for c, f in zip(components([d for d, _ in rows], fps), fps)})
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def brute_lines(rows, run_words=50):
    """Deleted line indexes of each row by comparing all shortest runs in order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, gone = {}, {}
    for i in order:
        lines = (rows[i][1] or "").split("\n")
        full = [(k, " ".join(x.lower().split())) for k, x in enumerate(lines) if x.strip()]
        n = [len(x.split()) for _, x in full]
        runs = set()
        for a in range(len(full)):
            for b in range(a, len(full)):
                if sum(n[a : b + 1]) >= run_words:
                    runs.add((a, b))
                    break
            for b in range(a, -1, -1):
                if sum(n[b : a + 1]) >= run_words:
                    runs.add((b, a))
                    break
        cut = set()
        for a, b in sorted(runs):
            key = tuple(x for _, x in full[a : b + 1])
            first = seen.setdefault(key, (rows[i], a, b))
            if first[0] != rows[i] or a > first[2]:
                cut |= set(range(a, b + 1))
        gone[i] = {k for p in cut for k in range(full[p][0], full[p + 1][0] if p + 1 in cut else full[p][0] + 1)}
    return gone


def test_line_dedup_equals_brute_force(spark):
    rows = documents()
    rows.append((200, "\n".join(["same words in a line " * 3] * 12)))
    got = line_dedup.drop_repeated(spark.createDataFrame([(d, t, 5) for d, t in rows], SCHEMA + ", n_lines int"), counts=True)
    assert got.columns == ["doc_id", "text", "n_lines", "_n_lines", "n_deleted"]
    gone = brute_lines(rows)
    want = []
    for i, (d, t) in enumerate(rows):
        lines = (t or "").split("\n")
        text = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone[i])
        want.append((d is None, d or 0, text, 0 if t is None else len(lines), len(gone[i])))
    key = lambda x: (x[0], x[1], x[2] or "", x[3])
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text, r._n_lines, r.n_deleted) for r in got.collect()), key=key) == sorted(want, key=key)
    assert sum(bool(g) for g in gone.values()) >= 4
    assert line_dedup.drop_repeated(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_windows(doc, items, window=13):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, own = norm(doc), set(), set()
    for item, text in items:
        w = norm(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit |= set(range(j, j + k))
                    own.add(item or "")
    return len(words), len(hit), sorted(own)


@pytest.mark.parametrize("window", [13, 5])
def test_decontamination_equals_brute_force(spark, window):
    rng = random.Random(3)
    items = [(f"i{k}", prose(rng, 30)) for k in range(4)] + [("short", "Alpha-Beta gamma"), ("none", "..."), ("null", None), (None, prose(rng, 20)), ("i0", prose(rng, 14))]
    docs = documents(n=40) + [(300, "Größe " + items[0][1] + " é"), (301, items[1][1].upper()), (302, prose(rng, 400) + items[2][1]), (303, items[4][1])]
    got = decontaminate.find_windows(spark.createDataFrame([(d, t, 1) for d, t in docs], SCHEMA + ", items int"), spark.createDataFrame(items, "item_id string, text string"), window=window)
    assert got.columns == ["doc_id", "items", "n_words", "n_hit", "_items", "spans"]
    want = sorted((d is None, d or 0, *brute_windows(t, items, window)) for d, t in docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r._items) for r in got.collect()) == want
    spans = next(r.spans for r in got.collect() if r.doc_id == 300)
    assert docs[-4][1][spans[0].start : spans[-1].end].startswith(items[0][1].split(" ")[0].rstrip(".,"))
    kept = decontaminate.decontaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id string, text string"))
    assert {r.doc_id for r in kept.collect()} >= {100, 101} and 301 not in {r.doc_id for r in kept.collect()}
    none = spark.createDataFrame([], "item_id string, text string")
    twice = decontaminate.find_windows(spark.createDataFrame(docs[-2:] * 2, SCHEMA), spark.createDataFrame(items, "item_id string, text string"))
    assert twice.count() == 4 and twice.distinct().count() == 2
    assert decontaminate.find_windows(spark.createDataFrame(docs, SCHEMA), none).where("n_hit > 0").count() == 0


def test_windows_of_many_items_with_common_phrases():
    rng = random.Random(9)
    few = WORDS[:3]
    items = [(f"i{k}", " ".join(rng.choice(few) for _ in range(rng.choice([4, 7, 12, 13, 20, 60])))) for k in range(80)]
    for window in (1, 2, 6, 7, 13):
        known = decontaminate.Windows(iter(items), window)
        for _ in range(40):
            words = [rng.choice(few + ["other"] * rng.randint(0, 1)) for _ in range(rng.randint(0, 80))]
            if rng.random() < 0.7:
                words += rng.choice(items)[1].split()
            spans, own = known.scan([w.encode() for w in words])
            assert (len(words), sum(b - a for a, b in spans), sorted(own)) == brute_windows(" ".join(words), items, window)
    # a text whose share of hit words is just the limit, and one word more
    item = " ".join(f"w{k}" for k in range(13))
    known = decontaminate.Windows([("a", item)])
    for rest, limit in ((247, True), (248, False)):
        spans, _ = known.scan((item + " x" * rest).encode().split())
        n_hit = sum(b - a for a, b in spans)
        assert n_hit == 13 and (20 * n_hit >= 13 + rest) is limit


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(reference):
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN
    rng = random.Random(2)
    parts = ["'", "s", "t", "re", "'ll", "'ve", " ", "  ", "\n", "\t", "\xa0", "a", "é", "1", "٣", "!", "中", "🙂", "x" * 90, "<|endoftext|>", "　"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)] + ["a" * 3000, " " * 500, ""]
    coder = byte_bpe.codec(public_tokenizers.path(byte_bpe.RANKS))
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert coder.decode(ids.tolist()) == text.encode()
        assert [text.encode()[o:][: len(coder.tokens[i])] for o, i in zip(coder.offsets(ids), ids)] == [coder.tokens[i] for i in ids]


def test_states_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    kinds = rng.integers(0, 9, 10_000).astype(np.uint8)
    s, want = byte_bpe.CLOSED, []
    for k in kinds:
        want.append(s)
        s = byte_bpe.STEP[k, s]
    for block in (7, 64):
        assert byte_bpe.states(kinds, block=block).tolist() == want


def test_bpe_over_a_table(spark, reference):
    rows = documents()
    got = byte_bpe.encode(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA + ", ids string"), offsets=True, digests=True)
    assert got.columns == ["doc_id", "ids", "n_tokens", "_ids", "offsets", "ids_sha256", "decoded_sha256"]
    want = {}
    for d, t in rows:
        ids = reference.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    for r in got.collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id]
    back = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame(rows, SCHEMA)), name="back")
    assert {r.back for r in back.collect()} == {t or "" for _, t in rows}


PAGES = {
    "<body><nav><ul><li><a href=a>Menu</a></ul></nav><article><h1>Title &amp; more</h1><p><b>First   block<br>goes on<p>Second</article><footer>foot</footer>": "Title & more\n\nFirst block goes on\n\nSecond",
    '<div class="ad">buy</div><div id=main><p>A long paragraph of the text that matters here.</p><ul><li>one<li>two</ul></div><div class="comments"><p>reader</p></div>': "A long paragraph of the text that matters here.\n\none\n\ntwo",
    "<main><header><h2>Head</h2></header><form><input>send</form><table><tr><td>a<td>b</table></main><aside>s</aside>": "Head\n\na\n\nb",
    "plain &lt; text": "plain < text",
    "<p>open <!-- comment <p>gone": "open",
    "<script>var a = '</p>'</script><style>p{}</style>": "",
    "": "",
}


def test_html_text(spark):
    for page, text in PAGES.items():
        assert html_text.main_text(page) == text
    rows = [(i, p, "u", 1) for i, p in enumerate(PAGES)] + [(None, None, None, 2)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, url string, text int"))
    assert got.columns == ["page_id", "url", "text", "_text", "n_chars"]
    assert sorted(r._text for r in got.collect()) == sorted([*PAGES.values(), ""])
    assert all(r.n_chars == len(r._text) for r in got.collect())
    assert "x" in html_text.main_text("<div>" * 20000 + "x")


def test_html_names_do_not_overrule_the_article():
    words = "Long plain text of the article goes on and on here. " * 4
    text = words.strip()
    for page in (
        f'<div class="content-sidebar-wrap"><main><p>{words}</p></main></div><div class="sidebar">Other things</div>',
        f'<div class="sidebar"><main><p>{words}</p></main></div>',
        f'<article class="post comments-open"><p>{words}</p></article>',
        f'<form action="/"><div><article><p>{words}</p></article></div><div class="comments">Me too</div></form>',
        f'<form id="aspnet"><div><p>{words}</p></div></form>',
    ):
        assert html_text.main_text(page) == text
    page = f'<article><h2 id="search-algorithms">Search</h2><p>{words}</p><h2 id="related">Related</h2><p>{words}</p><div class="related"><article>Teaser</article></div><form>Name</form></article>'
    assert html_text.main_text(page) == f"Search\n\n{text}\n\nRelated\n\n{text}"
    page = f'<article><p>{words}</p></article><section class="comments"><article class="comment">{words * 9}</article></section>'
    assert html_text.main_text(page) == text


def test_html_keeps_articles_whatever_surrounds_them():
    words = "Long plain text of the article goes on and on here. " * 4
    text = words.strip()
    for page in (
        f'<div class="layout no-sidebar"><article><p>{words}</p></article></div>',
        f'<div id="page" class="with-sidebar"><main><p>{words}</p></main></div>',
        f'<form method="post" action="./page.aspx" id="form1"><div><article><p>{words}</p></article></div></form>',
        f'<article><p class="related-work">{words}</p></article>',
        f'<article><p class="comment-count-0">{words}</p></article>',
        f'<article><p class="dialog">{words}</p></article>',
        f'<article><p title="5" tall">{words}</p></article>',
        f"<article><p title='a>b' x=\"c>d\" y=e>{words}</p></article>",
        f'<article><object data="x.swf"><p>{words}</p></object></article>',
        f'<div class="sidebar"><div><p>{words}</p><p>{words}</p></div></div><div>Other</div>'.replace(f"<p>{words}</p></div>", "</div>"),
    ):
        assert html_text.main_text(page) == text, page
    assert html_text.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be <select><option>no</option></select><textarea><p>no</textarea>given</p></article>") == "Let x=2 be given"
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Part {k}</a>" for k in range(9)) + "</ul>"
    assert html_text.main_text(f"<article>{menu}<p>{words}</p><ul><li>Plain <a href=x>linked</a> item</ul></article>") == f"{text}\n\nPlain linked item"
    talk = f"<div class=comments><div><p>{words}</p><p>{words}</p></div></div>"
    assert html_text.main_text(f"<div><p>{words}</p><p>{words}</p></div>{talk}") == f"{text}\n\n{text}"
    long = "word " * 400_000
    assert html_text.main_text(f"<article><p>{long}</p></article>") == long.strip()
    assert html_text.main_text("<p " + "a=' " * 50_000) == "" and html_text.main_text("<p" + " b" * 50_000 + ">x") == "x"


def test_html_names_go_by_their_parts_where_density_agrees():
    words = "Long plain text of the article goes on and on here. " * 4
    text = words.strip()
    for name, other in (
        ("comment-list", "<ul><li>Reader says nice<li>Me too</ul>"),
        ("reader-comments", f"<p>{words}</p><p>{words}</p>"),
        ("cookie-banner", "<p>We use cookies</p>"),
        ("cookieNotice", "We use cookies"),
        ("site-footer", "<p>All rights reserved</p>"),
        ("ad-slot", "Buy now"),
        ("js-newsletter_v2", "<p>Sign up</p><p>now</p>"),
    ):
        for page in (
            f'<article><p>{words}</p><div class="{name}">{other}</div><p>{words}</p></article>',
            f'<main><div id="{name}">{other}</div><p>{words}</p><p>{words}</p></main>',
            f'<div><p>{words}</p><p>{words}</p><section class="x {name}">{other}</section></div>',
        ):
            assert html_text.main_text(page) == f"{text}\n\n{text}", page
    for name in ("related-work", "comment-count-0", "search-engines", "ad-hoc", "social-history"):
        page = f'<article><p>{words}</p><section class="{name}"><p>{words}</p><p>{words}</p></section></article>'
        assert html_text.main_text(page) == "\n\n".join([text] * 3), page


def test_html_keeps_all_articles_their_titles_and_their_links():
    words = "Long plain text of the article goes on and on here. " * 4
    text = words.strip()
    two = f"<nav>Home</nav><div><article><p>{words}</p></article><aside>Other</aside><article><h1>Two</h1><p>{words}</p></article></div>"
    assert html_text.main_text(two) == f"{text}\n\nTwo\n\n{text}"
    assert html_text.main_text(f"<body><header><h1>Site</h1></header><h1>Title</h1><article><p>{words}</p></article></body>") == f"Title\n\n{text}"
    assert html_text.main_text(f"<body><h1>Site</h1><nav>Home</nav><article><h1>Title</h1><p>{words}</p></article></body>") == f"Title\n\n{text}"
    links = "<ul>" + "".join(f"<li><a href=/{k}>Work number {k}</a>" for k in range(5)) + "</ul>"
    listed = "\n\n".join(f"Work number {k}" for k in range(5))
    assert html_text.main_text(f"<article><p>{words}</p><h2>Works</h2>{links}<p>{words}</p></article>") == f"{text}\n\nWorks\n\n{listed}\n\n{text}"
    assert html_text.main_text(f"<nav><a href=/>Home</a></nav><article><h1>Resources</h1>{links}</article>") == f"Resources\n\n{listed}"
    assert html_text.main_text(f"<article><h1>Title</h1>{links}<p>{words}</p></article>") == f"Title\n\n{text}"
    assert html_text.main_text(f"<article><p>{words}</p><nav>{links}</nav></article>") == text


def test_densities_equal_a_plain_recursion():
    from math import e, log
    from xml.etree import ElementTree

    rng = random.Random(6)

    def made(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            if depth and rng.random() < 0.6:
                out.append(f"<div>{made(depth - 1)}</div>")
            elif rng.random() < 0.3:
                out.append(f"<section><a href='x'>{prose(rng, 3)}</a></section>")
            else:
                out.append(f"<section>{prose(rng, rng.randint(1, 60))}</section>")
        return "".join(out)

    for _ in range(60):
        source = f"<body>{made(4)}</body>"
        nodes = []

        def walk(node):
            """(characters, tags, linked characters, link tags) of a node, and its children's numbers."""
            at = len(nodes)
            nodes.append(None)
            chars, tags, linked, links = len(node.text or ""), 0, 0, 0
            below = []
            for child in node:
                if child.tag == "a":
                    size = len(child.text)
                    chars, tags, linked, links = chars + size, tags + 1, linked + sum(map(len, child.text.split())), links + 1
                else:
                    below.append(len(nodes))
                    c, t, lc, lt = walk(child)
                    chars, tags, linked, links = chars + c, tags + t + 1, linked + lc, links + lt
            nodes[at] = (chars, tags, linked, links, below)
            return chars, tags, linked, links

        walk(ElementTree.fromstring(source))
        whole = nodes[0][2] / nodes[0][0]

        def density(chars, tags, linked, links, _):
            if not chars:
                return 0.0
            tags = max(tags, 1)
            base = log(chars / max(chars - linked, 1) * linked + whole * chars + e)
            ratio = chars / max(linked, 1) * tags / max(links, 1)
            return max(0.0, chars / tags * log(ratio) / log(base)) if base > 1 + 1e-9 else chars / tags * log(max(ratio, 1) + e)

        want = [density(*x) for x in nodes]
        sums = [sum(want[k] for k in x[4]) for x in nodes]
        got = html_text.Densities(html_text.Page(source))
        assert got.density == pytest.approx(want) and got.sums == pytest.approx(sums)
        assert sums[got.best] == pytest.approx(max(sums))
