"""The dealt operators against brute force, on small hand-made tables with nulls, ties, repeated rows,
empty tables and clashing column names."""
import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagetide.llm import hashforest, htmltext, langid, mixing, pieces, quality, simhash, substring, topk, warc
from pagetide.llm.common import shared_folder, unit_hash, word_count, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, `key` string, fp string"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def documents(spark, rows):
    """(doc_id, text, source) rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, 7, 1, "k", "f") for i, t, s in rows], DOCS)


def prose(seed, n, words=60):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghijklmnopqrst") * r.randint(1, 3) + str(r.randint(0, words)) for _ in range(n))


ODD = [(1, None, None), (2, "", "a"), (2, "", "a"), (3, " \t\n", "b"), (None, "one two", "b"), (5, "word", None)]


# --- 2: mixing ------------------------------------------------------------------

def test_mixing_targets_are_filled_up_to_the_cap(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate("a" * 50 + "b" * 2 + "c" * 200)] + ODD
    out = mixing.with_copies(documents(spark, rows), "doc_id", "text", "source", word_count(F.col("text"))).collect()
    assert len(out) == len(rows)
    sizes, targets = Counter(), {}
    for r in out:
        sizes[r["source"]] += r["__mix"]["size"]
        targets[r["source"]] = r["__mix"]["target"]
        assert r["__mix"]["copies"] <= 3
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped: set = set()
    while True:  # water filling
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and weight[s] * left / open_ > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in sizes:
        assert targets[s] == pytest.approx(3 * sizes[s] if s in capped else weight[s] * left / open_)


def test_mixed_rows_are_copies(spark):
    docs = documents(spark, [(i, "w " * 10, "ab"[i % 2]) for i in range(400)])
    out = mixing.mixed(docs, "doc_id", "text", "source", word_count(F.col("text")))
    assert out.columns == docs.columns
    per = Counter(r["source"] for r in out.collect())
    assert abs(per["a"] - 400 * 5 / 7) < 30 and abs(per["b"] - 400 * 2 / 7) < 30
    assert mixing.mixed(docs.limit(0), "doc_id", "text", "source", word_count(F.col("text"))).count() == 0


def test_unit_hash_is_uniform(spark):
    mean = spark.range(4000).select(F.avg(unit_hash(F.lit("x"), F.col("id").cast("string")))).first()[0]
    assert abs(mean - 0.5) < 0.03


# --- 3 and 7: vectors -------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank string")


def vector_rows(n, dim, seed=1):
    r = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in r.standard_normal(dim)], "s", "r") for i in range(n)]


def test_exact_top_k_equals_brute_force(spark):
    rows = vector_rows(300, 8)
    same = rows[7][1]
    rows += [(400 + i, same, "s", "r") for i in range(40)] + [(450, same, "s", "r"), (450, same, "s", "r")]  # ties, repeated rows
    rows += [(500, None, "s", "r"), (600, [1.0, None], "s", "r"), (700, [float("nan")] * 8, "s", "r"), (None, same, "s", "r"), (800, [1.0], "s", "r")]
    df = vectors(spark, rows)
    got = defaultdict(list)
    for r in topk.exact_top_k(df, df.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.floor(1024 * np.array(v + [0.0] * (8 - len(v)))).astype(int)) for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for qi, q in good:
        if qi % 100 == 0:
            best = sorted(((-int(q @ c), i) for i, c in good if i != qi))[:10]
            want[qi] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert topk.exact_top_k(df.limit(0), df.limit(0), "vec_id", "embedding", 10).count() == 0


def test_exact_top_k_with_few_and_huge(spark):
    df = vectors(spark, [(0, [3e5, 1.0], "", ""), (1, [3e5, 2.0], "", ""), (2, [-3e5, 0.0], "", "")])
    out = topk.exact_top_k(df, df.where("vec_id = 0"), "vec_id", "embedding", 10).orderBy("rank").collect()
    a, b = 300_000 * 1024, 1024
    assert [(r["vec_id"], r["score"]) for r in out] == [(1, a * a + b * 2 * b), (2, -a * a)]


def test_forest_recall_and_order(spark):
    rows = vector_rows(2000, 32, 3)
    rows += [(3000 + i, rows[20][1], "", "") for i in range(60)] + [(4000, [0.0] * 32, "", ""), (4020, None, "", "")]
    df = vectors(spark, rows)
    forest = hashforest.build_forest(df, "vec_id", "embedding")
    out = hashforest.search_forest(forest, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 20).collect()
    data = {i: np.array(v) for i, v, *_ in rows if v is not None and any(v)}
    got = defaultdict(list)
    for r in out:
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in (i for i in data if i % 20 == 0):
        found = sorted(got[q])
        assert len(found) == 20 and [-f[2] for f in found] == sorted(-f[2] for f in found)
        assert all(abs(f[2] - data[f[1]] @ data[q]) < 1e-9 for f in found)
        best = sorted(data, key=lambda i: (-round(float(data[i] @ data[q]), 9), i))
        hits += len({i for i in best if i != q and best.index(i) < 21} & {f[1] for f in found[:20]})
    assert hits / (20 * len(got)) >= 0.9
    assert [f[1] for f in sorted(got[20])] == list(range(3000, 3020))  # equal vectors: smaller ids first
    empty = hashforest.build_forest(df.limit(0), "vec_id", "embedding")
    assert hashforest.search_forest(empty, df, "vec_id", "embedding", 5).count() == 0


def test_forest_finds_copies_beside_a_query_row_repeated_often(spark):
    rows = vector_rows(300, 16, 4)
    rows += [rows[20]] * 40 + [(3000 + i, rows[20][1], "", "") for i in range(30)]
    rows += [(1000, [-x * (9 + i) for x in rows[20][1]], "", "") for i in range(30)]  # an id with many vectors
    df = vectors(spark, rows)
    forest = hashforest.build_forest(df, "vec_id", "embedding")
    found = defaultdict(list)
    asked = df.where("vec_id = 20").unionByName(df.where("vec_id = 1000").orderBy("embedding").limit(1))
    for r in hashforest.search_forest(forest, asked, "vec_id", "embedding", 20).orderBy("rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    assert found[20] == list(range(3000, 3020))
    assert len(found[1000]) == 20 and 1000 not in found[1000]


# --- 5: SimHash -------------------------------------------------------------------

def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_the_definition():
    for text in [None, "", "One", "a b c", "É é A a", prose(1, 50), "x " * 100, prose(2, 40_000)]:
        assert simhash.fingerprint(None if text is None else text.encode(), 4) == brute_fingerprint(text)


def test_links_connect_what_brute_force_connects(spark):
    r = random.Random(5)
    prints = {r.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:60]:
        for _ in range(8):  # chains of near ones
            for b in r.sample(range(64), r.randint(1, 5)):
                p ^= 1 << b
            prints.add(p)
    base = r.getrandbits(64)
    prints |= {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}  # a dense group
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {x["node"]: x["root"] for x in simhash.components(simhash.links(df, 4, block=64)).collect()}
    a = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    label = np.arange(len(a))
    while True:
        new = np.where(near, label[None, :], len(a)).min(axis=1)
        if (new == label).all():
            break
        label = new
    groups, found = defaultdict(set), defaultdict(set)
    for s, g in zip(signed, label):
        groups[g].add(s)
        found[roots.get(s, s)].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_one_document_of_each_group_stays(spark):
    text = prose(3, 300)
    rows = [(9, text, "a"), (4, text, "b"), (4, text, "b"), (None, text, "c"), (6, prose(4, 300), "a"), *ODD]
    docs = documents(spark, rows)
    kept = simhash.one_per_group(docs, "doc_id", "text")
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect())
    assert got == sorted([("4", text), ("6", rows[4][1]), ("1", ""), ("None", "one two"), ("5", "word")])
    assert simhash.one_per_group(docs.limit(0), "doc_id", "text").count() == 0
    ids = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs, "doc_id", "text").collect()}
    assert (9, 4) in ids and (None, 4) in ids and (2, 1) in ids and (None, None) in ids


# --- 9: substring dedup -------------------------------------------------------------

def brute_cut(texts, length):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i:i + length])] > 1 for j in range(i, i + length)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [35, 5, 1])
def test_repeats_go_as_brute_force_says(spark, length):
    shared, r = prose(10, 80), random.Random(2)
    texts = [None, "", "  ", shared, "lead in " + shared + " and out", prose(11, 200), prose(11, 200), "x " * 36, "x " * 35, "x y " * 40,
             shared[:200] + " " + prose(12, 30), prose(13, 34), prose(13, 35), prose(13, 36)]
    for i in range(20):
        a = r.randint(0, 40)
        texts.append(prose(100 + i, 30) + " " + " ".join(shared.split()[a:a + r.randint(20, 60)]) + " " + prose(200 + i, 20))
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(5, texts[5], "s"), (None, texts[4], "s")]
    got = substring.without_repeats(documents(spark, rows), "doc_id", "text", length, carry={"n_words_": F.col("fp")}).collect()
    want = brute_cut([t for _, t, _ in rows], length)
    assert sorted((str(g["id"]), g["n_words"], g["n_removed"], g["sha256"]) for g in got) == sorted(
        (str(i), *w) for (i, _, _), w in zip(rows, want))


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    from pagetide.llm import common
    data = (prose(1, 500) + "  \n" + "q" * 300 + " end").encode()
    whole = word_hashes(data)
    monkeypatch.setattr(common, "_SLICE", 64)
    assert (word_hashes(data) == whole).all() and len(whole) == len(data.split())
    by_word = {}
    for w, h in zip(data.split(), whole.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


# --- 10: pieces -----------------------------------------------------------------------

TEXTS = [None, "", " ", "  a  b", "a\0b \0", "ﬁ ½ é é 中文 🙂 x", "\n\n\t", "a" * 300, "<s> </s> <unk> <0x0A>", "1234567890" * 5,
         "      if (x==y) {\n        return;\n    }", "The quick brown fox", "the the the", prose(1, 400)]


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary")
def test_bpe_ids_equal_the_library_and_decode_back(spark):
    import sentencepiece
    r = random.Random(0)
    texts = TEXTS + ["".join(r.choice("abcdefghinorst  .\n,1éßñ") for _ in range(r.randint(0, 60))) for _ in range(200)]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)] * 2)
    vocabulary = pieces.Vocabulary.load(MODEL)
    encoded = pieces.encode(docs, "text", vocabulary, {"doc_id": F.col("doc_id")})
    got = {x["doc_id"]: x["ids"] for x in encoded.collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert got == {i: None if t is None else lib.encode(t) for i, t in enumerate(texts)}
    back = {x["doc_id"]: x["text"] for x in pieces.decode_ids(encoded, "ids", vocabulary, {"doc_id": F.col("doc_id")}).collect()}
    assert back == dict(enumerate(texts))


def test_unigram_paths_are_the_best(monkeypatch):
    strings = ["<unk>", "▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb"]
    scores = np.array([0, -2.1, -1.3, -1.7, -1.9, -2.3, -3.05, -2.9, -3.7, -3.6])
    v = pieces.Vocabulary(strings, scores, np.arange(1, 10), {}, set(), 0, False)
    table = {s: (scores[i], i) for i, s in enumerate(strings) if i}

    def best(t):
        ways = {0: (0.0, [])}
        for e in range(1, len(t) + 1):
            ways[e] = max((ways[b][0] + table[t[b:e]][0], ways[b][1] + [table[t[b:e]][1]]) for b in range(e) if t[b:e] in table)
        return ways[len(t)]

    r = random.Random(4)
    texts = ["".join(r.choice("ab ") for _ in range(12)) for _ in range(60)]
    for t, ids in zip(texts, pieces.Encoder(v).encode(texts).to_pylist()):
        assert sum(scores[i] for i in ids) == pytest.approx(best("▁" + t.replace(" ", "▁"))[0])
    assert pieces.Encoder(v).encode(["zab"]).to_pylist() == [[1, 0, 4]]
    # A small cache that is dropped again and again gives the same ids.
    whole = pieces.Encoder(v).encode(texts).to_pylist()
    monkeypatch.setattr(pieces, "CACHE", 5)
    small = pieces.Encoder(v)
    assert [small.encode([t]).to_pylist()[0] for t in texts] == whole


# --- 8: WARC ---------------------------------------------------------------------------

def test_archives_hold_every_page(spark):
    rows = [(3, "http://a/\r\nX: y", "<p>same</p>"), (1, "http://b/", "<p>same</p>"), (2, None, None), (4, "u", ""), (5, "w", "WARC/1.1\r\n\r\n\r\n"),
            (6, "é", "é" * 3000), (6, "é", "é" * 3000), (None, "n", "<p>same</p>"), (7, "z", "z\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    folder = warc.write_archives(warc.resolve(pages), shared_folder(spark, "warc-test"), 2)
    found = warc.read_archives(spark, folder).collect()
    assert len(found) == len(rows) and len({r["record_id"] for r in found}) == len(rows)
    payload = {r["record_id"]: bytes(r["payload"]) for r in found if r["record_type"] == "response"}
    got = sorted((str(r["page_id"]), payload[r["refers_to"] or r["record_id"]].decode()) for r in found)
    assert got == sorted((str(i), h or "") for i, _, h in rows)
    out = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.resolved_records(spark, folder).collect())
    assert out == Counter([(1, "response", None), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None), (4, "revisit", 2),
                           (5, "response", None), (6, "response", None), (6, "revisit", 6), (7, "response", None)])
    for r in warc.resolved_records(spark, folder).collect():
        html = next(h or "" for i, _, h in rows if i == r["page_id"])
        assert r["payload_bytes"] == len(html.encode()) and len(r["payload_digest"]) == 32
    empty = warc.write_archives(warc.resolve(pages.limit(0)), shared_folder(spark, "warc-empty"), 10)
    assert warc.resolved_records(spark, empty).count() == 0


# --- 4: HTML -----------------------------------------------------------------------------

@pytest.mark.parametrize("html, text", [
    (None, None), ("", ""), ("just  text", "just text"),
    ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
    ("<ul><li>a<li>b<ol><li>x<li>y</ol></ul>", "- a\n- b\n  1. x\n  2. y"),
    ("<table><tr><th>Name<th>N<tr><td>long one<td>1<tr><td><td>2</table>", "Name      N\nlong one  1\n          2"),
    ("<table><td>a<td>b</table>", "a  b"),
    ("x<script>if (a<b) '</p>'</script><style>.h{display:none}</style><b class='h'>no</b><i hidden>no</i> y", "x y"),
    ("<p style='visibility:hidden'>no<b style='visibility:visible'>yes</b>", "yes"),
    ("a<br>b<br/>c", "a\nb\nc"), ("<pre>a\n  b</pre>", "a\n  b"), ("&lt;b&gt; &amp;amp; &copy;", "<b> &amp; ©"),
    ("<!-- no --><p>open <b>bold", "open bold"), ("<details><summary>S</summary>no</details>", "S"),
    ("<a href=\"x>y\">t</a>", "t"), ("1 < 2", "1 < 2"),
])
def test_visible_text(html, text):
    assert htmltext.page_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<html><head><title>t</title><body><p>Hello", "Hello"), ("<head><title>t</title><p>Hello", "Hello"),
    ("<head><meta charset=x>Hello</head> you", "Hello you"), ("<head><title>t</title></head><body>a<head>b", "ab"),
    ("<head><title>t</title></br>x", "x"), ("<head><script>no</script><noscript><p>no</noscript><body>x", "x"),
    ("<ruby>K<rp>(<rt>kan<rp>)</ruby> x", "Kkan x"), ("<rp>(<rt>kan<rp>)", "kan"),
    ("<ruby>K<rtc><rt>a<rt>b<rb>L<rp>(</ruby>x", "KabLx"),
    ("<table><colgroup><col><tr><td>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<table><caption>C<colgroup><col><col><tbody><tr><td>a<td>b</table>", "C\na  b"),
    ("<table><colgroup><col></table>x", "x"), ("<div><colgroup>x</div>y", "x\ny"),
])
def test_end_tags_left_out(html, text):
    assert htmltext.page_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<table><tr>Total: <td>5</table>", "Total:\n5"), ("a<table>b<tr>c<td>d<tbody>e<tr><td>f</table>g", "a\n\nb\nc\ne\nd\nf\n\ng"),
    ("<table><thead>h<tfoot>f</table>", "h\nf"), ("<table hidden><tr style='display:none'>Total:<td>5</table>", "Total:"),
    ("<div hidden><table>no<tr>no</table></div>x", "x"), ("<div style='visibility:hidden'><table><tr>no</table></div>x", "x"),
    ("<table><tr><td>a<table><tr>in<td>b</table></table>", "a in b"), ("<div><tr>a<td>b</div>", "a b"),
    ("<map name=m><area alt=no><p>in the map</map> x", "in the map x"),
])
def test_stray_text_of_tables_and_maps_stays(html, text):
    assert htmltext.page_text(html) == text


@pytest.mark.parametrize("css, body, text", [
    ("@media print{.nav{display:none}}", "<p class=nav>nav", "nav"), ("@media (max-width:600px){.side{display:none}}", "<p class=side>side", "side"),
    ("@media screen{.x{display:none}}", "a<p class=x>no", "a"), ("@media not print{.x{display:none}} @media print,tv{p{display:none}}", "a<b class=x>no</b><p>b", "a\n\nb"),
    (".x{display:none} @media (min-width:600px){.md\\:block{display:block}}", "<b class='x md:block'>yes</b> <b class=x>no</b>", "yes"),
    ("@supports (display:grid){.x{display:none}} .y{display:none} @supports (a:b){.y{display:grid}}", "<b class=x>a</b> <b class=y>b</b>", "a b"),
    (".tab{display:none} .tab.active{display:block}", "<div class=tab>no</div><div class='active tab'>yes</div>", "yes"),
    (".tab.active{display:block} .tab{display:none}", "<div class='tab active'>yes</div>", "yes"),
    (".x{display:none!important} #i{display:block}", "a<p id=i class=x style='display:block'>no", "a"),
    (".x{display:none!important}", "<p class=x style='display:block ! important'>yes", "yes"),
    ("nav ul>li .x, nav + p{display:none}", "<nav><ul><li><i><b class=x>no</b></i>a</ul></nav><p>no<p>b<ul><li><b class=x>c</b></ul>", "- a\n\nb\n\n- c"),
    ("h1 ~ .x{display:none}", "<b class=x>a</b><h1>b</h1><p>c</p><p class=x>no</p>", "a\n\nb\n\nc"),
    ("html.js body .x{display:none} body.y > p{display:none}", "<p class=x>a<div><p>b</div>", "a\n\nb"),
    ("[data-a='q}'][lang|=en], a[href^=x i]{display:none}", "<b data-a='q}' lang=en-us>no</b><b data-a=q>a</b><a href=Xy>no</a>", "a"),
    (".x{display:none} .x:hover, .x::before, .x:before{display:block}", "a<b class=x>no</b>", "a"),
    (".x{display:none} .x:nth-child(2n){display:block} .y:nth-child(1){display:none}", "<b class=x>a</b> <b class=y>b</b>", "a b"),
    ("p:not(.x):is(.y,.z){display:none}", "<p class='x y'>a<p class=y>no<p>b", "a\n\nb"),
    (".m{display:none} :checked ~ .m{display:block}", "<input type=radio checked><p class=m>yes", "yes"),
    (".a{color:red; .b{display:none} &.c{display:none} @media print{display:none} > i{display:none}}", "<p class=a>a<b class=b>no</b><i>no</i><p class='a c'>no<p class=b>b", "a\n\nb"),
    ("@layer z{.x{display:none!important} .y{display:block}} .y{display:none}", "<b class=x>a</b> <b class=y>b</b>", "a b"),
    ("@import url('a;b'); @charset 'x'; .x{background:url(data:a;b}c);display:none}", "a<b class=x>no</b>", "a"),
    ("@keyframes f{from{display:none}} @font-face{display:none} .x{display:none;display:var(--d)}", "<b class=x>a</b>", "a"),
    (".x{/*}*/content:'}/*';display:none}/* .y{display:none}", "a<b class=x>no</b><b class=y>b</b>", "ab"),
    (".x{visibility:hidden} .x .y{visibility:visible} .z{visibility:inherit}", "<p class=x>no<b class=y>yes</b><b class=z>no</b>", "yes"),
    (".f{display:flex}", "a<b hidden>no</b><b hidden class=f>yes</b>", "ayes"), ("div{display:none}", "<table><caption>c<tr><td>a<td>b</table>", "c\na  b"),
    ("tr.x, table > tr, td + .h{display:none}", "<table><tr class=x><td>no<tr><td>a<td class=h>no</table>", "a"),
    ("p:first-child{display:none} style ~ p{display:none}", "<p>no<p>a", "a"),
    ("a:b|c{display:none} ..x, p{display:none}", "<p>a", "a"),
])
def test_style_rules(css, body, text):
    assert htmltext.page_text(f"<head><style>{css}</style><body>{body}") == text


def test_sheets_for_other_media_and_for_no_script_hide_nothing():
    for style in ("<style media=print>", "<style media='(max-width: 9em)'>", "<style type=text/less>", "<noscript><style>"):
        assert htmltext.page_text(f"{style}p{{display:none}}</style></noscript><p>a") == "a"
    assert htmltext.page_text("<style media=screen type=text/css>p{display:none}</style>a<p>no") == "a"


def test_style_rules_cost_their_length():
    for css, body in [(".a " * 90 + ".b{display:none}", "<div class=a>" * 190 + "<i class=b>x</i>" * 3000), ("i~i~i~b~u{display:none}", "<i>x</i>" * 20_000 + "<u>x</u>" * 5000),
                      ("a{" * 3000 + "display:none", "<a>x</a>"), (":is(" * 3000 + "a" + ")" * 3000 + "{display:none}", "<a>x</a>"),
                      ("".join(f".c{i}{{display:none}}" for i in range(20_000)), "<i>x</i>" * 5000)]:
        assert "x" in htmltext.page_text(f"<style>{css}</style>{body}<s>x</s>")


def test_all_visible_words_of_the_given_pages_stay_in_order(spark):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.skip:
                self.words.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = {r["page_id"]: r["text"] for r in htmltext.extract(pages, "html", {"page_id": F.col("page_id")}).collect()}
    for r in pages.collect():
        p = Words()
        p.feed(r["html"])
        assert [w for w in "".join(out[r["page_id"]].split()) if w != "-"] == [w for w in "".join("".join(p.words).split()) if w != "-"]


def test_deep_pages_cost_their_length():
    assert htmltext.page_text("<div>" * 20_000 + "x") == "x"
    assert htmltext.page_text("<table>" * 3000 + "x").strip() == "x"


# --- 6 and 1: models ------------------------------------------------------------------------

def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(100001, None, "en"), (100002, "123 !!", None), (None, "the of and that", "en"), (100003, "", "de")],
                                "doc_id long, text string, lang string")
    docs = docs.select("doc_id", "text", "lang").unionByName(odd).withColumn("score", F.lit("clash"))
    doc_id = F.col("doc_id")
    model = langid.train(docs, "text", "lang", langid.learnable(doc_id), langid.by_checksum(doc_id), per_language=150)
    out = langid.classify(docs, model, "text", {"doc_id": doc_id, "lang": F.col("lang"), "held": langid.held_out(doc_id)}).collect()
    held = [r for r in out if r["held"] and r["lang"] and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"]: r["lang_pred"] for r in out if r["doc_id"] and r["doc_id"] > 100000} == {100001: "und", 100002: "und", 100003: "und"}
    none = langid.train(docs.limit(0), "text", "lang", langid.learnable(doc_id), langid.by_checksum(doc_id))
    assert none is None and langid.classify(docs.limit(3), none, "text", {}).where("lang_pred <> 'und'").count() == 0


def test_ordinal_grades_follow_the_ratings(spark):
    r = random.Random(1)
    words = {0: ["awful", "bad"], 1: ["plain"], 2: ["fine", "good"]}
    rows = [(i, prose(i, 20) + " " + r.choice(words[i % 3]), "s") for i in range(600)] + ODD[:2]
    docs = documents(spark, rows)
    ratings = spark.createDataFrame([(i, i % 3) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, grade int")
    model = quality.train(docs, "doc_id", "text", ratings, "doc_id", F.col("grade"))
    assert list(model.thresholds) == sorted(model.thresholds) and model.grades == [0, 1, 2]
    out = {x["doc_id"]: x for x in quality.score(docs, "text", model, {"doc_id": F.col("doc_id")}).where("doc_id >= 400").collect()}
    mean = [np.mean([x["expected_grade"] for i, x in out.items() if i % 3 == g]) for g in range(3)]
    assert mean[0] < 0.6 < mean[1] < 1.4 < mean[2]
    assert all(0 <= x["expected_grade"] <= 2 and 0 <= x["tail_probability"] <= 1 for x in out.values())
    assert quality.train(docs, "doc_id", "text", ratings.limit(0), "doc_id", F.col("grade")) is None
    assert quality.score(docs, "text", None, {}).where("selected").count() == len(rows)


def test_gradient_is_the_slope_of_the_likelihood(spark):
    rows = [(i % 3, [i % 5, 7, quality.DIMS], [1.0, 0.5, 1.0]) for i in range(30)]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.list_(pa.int32())),
                                        pa.array([x[2] for x in rows], pa.list_(pa.float64()))], names=["grade", "idx", "val"])

    class Given:
        def __init__(self, value):
            self.value = value

    def loss(x):
        out = next(quality._partial(Given(x), 3)([batch]))
        return out.column(0)[0].as_py(), np.frombuffer(out.column(2)[0].as_py())

    x = np.random.default_rng(0).standard_normal(quality.DIMS + quality.STATISTICS + 2) * 0.1
    _, grad = loss(x)
    for i in [0, 3, 7, quality.DIMS, len(x) - 2, len(x) - 1]:
        step = np.zeros(len(x))
        step[i] = 1e-5
        assert grad[i] == pytest.approx((loss(x + step)[0] - loss(x - step)[0]) / 2e-5, rel=1e-4, abs=1e-6)


def test_exact_top_k_of_repeated_query_rows(spark):
    df = vectors(spark, [(0, [1.0], "", ""), (0, [1.0], "", ""), (0, [-1.0], "", ""), *[(i, [float(i)], "", "") for i in range(1, 8)], (8, [-9.0], "", "")])
    out = topk.exact_top_k(df, df.where("vec_id = 0"), "vec_id", "embedding", 5).orderBy("rank").collect()
    unit = 1024 * 1024
    # The best of all pairs of a row of the query and a candidate, as in the SQL.
    assert [tuple(r) for r in out] == [(0, 1, 8, 9 * unit), (0, 2, 7, 7 * unit), (0, 3, 7, 7 * unit), (0, 4, 6, 6 * unit), (0, 5, 6, 6 * unit)]


def test_exact_top_k_ranks_the_least_long_last(spark):
    least = -float(1 << 43)  # times 1024 twice: -2**63
    df = vectors(spark, [(0, [1.0], "", ""), *[(i, [least], "", "") for i in range(1, 21)], (30, [2.0], "", ""), (31, [1.0], "", "")]).coalesce(1)
    out = topk.exact_top_k(df, df.where("vec_id = 0"), "vec_id", "embedding", 4).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(30, 2 << 20), (31, 1 << 20), (1, -(1 << 63)), (2, -(1 << 63))]
