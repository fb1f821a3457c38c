"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetide.llm import lexical, phrases, suffixes
from pagetide.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, n long, w1 string, term string, part int, id string"
ODD = [(1, None, None), (2, "", "a"), (2, "", "a"), (3, " \t\n", "b"), (None, "one two", "b"), (5, "word", None), (6, "..;;", "a")]


def documents(spark, rows):
    """(doc_id, text, lang) rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, 7, "w", "t", 1, "x") for i, t, lang in rows], DOCS)


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# --- 11: phrases ------------------------------------------------------------------

def brute_phrases(rows, least, longest=5, top=2000):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lowered):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    good = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    inside = {(lang, p[i:j]) for (lang, p), v in good.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
              if j - i < len(p) and f[lang, p[i:j]] <= v}
    out = defaultdict(list)
    for (lang, p), a in good.items():
        if (lang, p) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
            for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


def chatter(seed, n, words="the cat sat on a mat É é New york city."):
    r = random.Random(seed)
    return "".join(r.choice(words.split()) + r.choice([" ", " ", " ", "\t ", ", ", ".", "\n"]) for _ in range(n))


@pytest.mark.parametrize("least", [2, 5])
def test_collocations_as_counted_one_by_one(spark, least):
    rows = [*((i, chatter(i, 40 + 20 * i), [None, "en", "fr"][i % 3]) for i in range(12)), *ODD, (1, "a b c a b c " * 30, "en"), (1, "a b c a b c " * 30, "en")]
    got = phrases.collocations(documents(spark, rows), "text", "lang", top=15, least=least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert set(map(tuple, got.collect())) == brute_phrases(rows, least, top=15)


def test_collocations_when_every_bucket_is_shared(spark, monkeypatch):
    rows = [(i, chatter(i, 200), "en") for i in range(4)]
    texts = documents(spark, rows)
    bits = phrases.frequent_bits(spark, texts.select("lang", F.col("text").cast("binary").alias("text")), 5, 3)
    full = spark.sparkContext.broadcast(np.full_like(bits, 255))  # as if all buckets were full: no window is padded
    assert 0 < bits.any(axis=1).sum()
    windows = texts.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(
        phrases._windows(5, full), "lang string, w1 string, w2 string, w3 string, w4 string, w5 string, n long")
    total = windows.agg(F.sum("n")).first()[0]
    assert total == sum(len(w.split()) for _, t, _ in rows for w in re.split(r"[.,;:!?\n-\r]", t))
    pairs = {(r["w1"], r["w2"]): r["n"] for r in windows.where("w2 <> ''").groupBy("w1", "w2").agg(F.sum("n").alias("n")).collect()}
    want = Counter()
    for _, t, _ in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", t):
            words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in piece).split()
            want.update(zip(words, words[1:]))
    assert pairs == dict(want)


@pytest.mark.parametrize("least", [3, 255, 300])
def test_bucket_counts_stop_at_the_least_frequency(spark, monkeypatch, least):
    monkeypatch.setattr(phrases, "BUCKETS", 1 << 16)
    monkeypatch.setattr(phrases, "BLOCK", 1 << 10)
    texts = [("a b " * 64, "en"), ("a b " * 63, "en"), ("a b " * 127 + "a", "fr"), ("c " * 299, "en"), ("c", "en"), ("d " * 254, "en"), ("", "en"), (None, "en")]
    df = spark.createDataFrame([(lang, t) for t, lang in texts], "lang string, text string").select("lang", F.col("text").cast("binary").alias("text"))
    batches = df.repartition(4).mapInArrow(phrases._sketch(1, least), "block int, places binary, counts binary")
    held = Counter()
    for r in batches.collect():
        counts = np.frombuffer(r["counts"], "<u4" if least > 255 else "u1")
        assert counts.max() <= least
        held.update({(r["block"], p): int(c) for p, c in zip(np.frombuffer(r["places"], "<u2").tolist(), counts)})
    assert sorted(min(c, least) for c in held.values()) == sorted(min(c, least) for c in (127, 127, 300, 254, 128, 127))
    bits = phrases.frequent_bits(spark, df, 1, least)
    assert int(np.unpackbits(bits).sum()) == sum(c >= least for c in (127, 127, 300, 254, 128, 127))


def test_bucket_counts_fit_in_a_quarter_of_the_memory():
    """A byte for each bucket of each order (20 MB, 80 MB before), besides what one slice of text takes."""
    import tracemalloc

    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [b"a b c d e f. " * 100]})
    tracemalloc.start()
    list(phrases._sketch(5, 100)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20


def test_rare_words_do_not_fill_the_buckets(spark, monkeypatch):
    """of far more than ``least`` x ``BUCKETS`` words all buckets were full, and no window was padded."""
    monkeypatch.setattr(phrases, "BUCKETS", 1 << 10)
    monkeypatch.setattr(phrases, "BLOCK", 1 << 6)
    rows = [(i, " ".join(f"w{i}x{j} of a" for j in range(500)), "en") for i in range(40)]
    texts = documents(spark, rows).select("lang", F.col("text").cast("binary").alias("text"))
    bits = phrases.frequent_bits(spark, texts.repartition(3), 5, 20)
    assert np.unpackbits(bits, axis=1).mean(axis=1).max() < 0.1
    # 'of', 'a' and 'of a' alone go on: 60,000 words are four windows or few more
    windows = texts.mapInArrow(phrases._windows(5, spark.sparkContext.broadcast([phrases.folded(b) for b in bits])),
                               "lang string, w1 string, w2 string, w3 string, w4 string, w5 string, n long")
    sums = {tuple(r)[1:6]: r["n"] for r in windows.groupBy("lang", *(f"w{j}" for j in range(1, 6))).agg(F.sum("n").alias("n")).collect()}
    assert sum(sums.values()) == 60_000 and len(sums) < 2500 and sums["of", "a", "", "", ""] > 18_000
    counts = phrases.phrase_counts(documents(spark, rows), "text", "lang", least=20)
    assert set(rows_of(counts, "words", "phrase", "f")) == {(0, "", 60_000), (1, "of", 20_000), (1, "a", 20_000), (2, "of a", 20_000)}


@pytest.mark.parametrize(("held", "held_bytes"), [(40, 1 << 26), (1 << 20, 300)])
def test_collocations_in_small_parcels(spark, monkeypatch, held, held_bytes):
    for name, value in {"BUCKETS": 1 << 12, "BLOCK": 1 << 8, "HELD": held, "HELD_BYTES": held_bytes, "ROWS": 7, "PARTS": 3}.items():
        monkeypatch.setattr(phrases, name, value)
    rows = [*((i, chatter(i, 300), [None, "a\nb", "", "\u4e2d \x01"][i % 4]) for i in range(12)), *ODD]
    assert set(map(tuple, phrases.collocations(documents(spark, rows).repartition(2), "text", "lang", least=4).collect())) == brute_phrases(rows, 4)


def test_bits_of_neighbouring_buckets_are_joined(monkeypatch):
    monkeypatch.setattr(phrases, "BUCKETS", 64)
    places = np.array([3, 900, 901, 4095])
    bits = np.zeros(4096 // 8, np.uint8)
    np.bitwise_or.at(bits, places >> 3, np.uint8(128) >> (places & 7).astype(np.uint8))
    small = phrases.folded(bits)
    assert len(small) == 128 // 8 and np.flatnonzero(np.unpackbits(small)).tolist() == sorted({p >> 5 for p in places.tolist()})
    assert phrases._buckets(0, 100) == 64 and phrases._buckets(10**10, 100) == 1 << 26 and phrases._buckets(10**13, 2) == phrases.MOST_BUCKETS


def test_collocations_products_pass_64_bits(spark):
    a, n, left, right = 2 * 10**14 + 7, 3 * 10**15 + 1, 2 * 10**14 + 9, 25 * 10**13 + 3
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    product = F.lit(1000).cast("decimal(9,0)") * phrases._decimal("a") * phrases._decimal("n")
    got = row.select(F.call_function("div", product, phrases._decimal("l") * phrases._decimal("r"))).first()[0]
    assert 1000 * a * n > 1 << 100 and got == 1000 * a * n // (left * right)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(documents(spark, []), "text", "lang").collect() == []
    assert phrases.collocations(documents(spark, ODD), "text", "lang").collect() == []


def test_long_texts_are_cut_between_pieces():
    text = b"ab cd. ef gh, " * 50
    parts = [p for _, some in phrases.slices([None, text, b""], size=64) for p in some]
    assert b"".join(parts) == text and len(parts) > 5 and all(p[-1:] in b".," or p == parts[-1] for p in parts)


# --- 12: ranked search --------------------------------------------------------------

def brute_search(docs, items, k):
    def terms(t):
        return re.findall(lexical.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    texts = [(i, Counter(terms(t))) for i, t in docs]
    big_n = sum(1 for _, c in texts if c)
    words = sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, c in texts:
            m = 100 - 90 + (90 * sum(c.values()) * big_n) // max(1, words)
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def test_nra_reads_until_all_is_settled():
    r = random.Random(5)
    for trial in range(300):
        docs, k = r.randint(1, 40), r.randint(1, 6)
        lists, total = [], Counter()
        for _ in range(r.randint(1, 6)):
            own = sorted(((r.randint(1, 4), d) for d in r.sample(range(docs), r.randint(1, docs))), key=lambda x: (-x[0], x[1]))
            for impact, d in own:
                total[d] += impact
            lists.append((np.array([d for _, d in own]), np.array([i for i, _ in own])))
        best, score = lexical.nra(lists, docs, k, step=1)
        want = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:k]
        assert list(zip(best.tolist(), score.tolist())) == want, trial


@pytest.mark.parametrize("block_bytes", [lexical.BLOCK_BYTES, 60])
def test_search_as_scored_one_by_one(spark, block_bytes):
    words = "Alpha beta gamma delta9 epsilon ZETA éta".split()
    r = random.Random(2)
    docs = [(i // 2, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(60)]
    docs += [(100, "alpha-beta"), (100, "alpha-beta"), (None, "gamma_gamma"), (None, None), (7, ""), (8, "zeta " * 4000)]
    items = [(1, "alpha, beta?"), (2, "ZETA zeta"), (3, "nowhere"), (4, None), (5, ""), (None, "éta"), (6, "gamma"), (6, "delta9"), (1, "alpha, beta?")]
    found = lexical.ranked_search(documents(spark, [(i, t, "x") for i, t in docs]).repartition(3), "doc_id", "text",
                                  spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 5, block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_search(docs, items, 5)


def test_search_over_many_shards(spark, monkeypatch):
    docs = [(i, f"w{i % 7} w{i % 11} common " * (1 + i % 5)) for i in range(300)]
    items = [(1, "w1 w2 common"), (2, "w10 w3")]
    found = lexical.ranked_search(documents(spark, [(i, t, "x") for i, t in docs]).repartition(40), "doc_id", "text",
                                  spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 10)
    assert sorted(map(tuple, found.collect()), key=str) == brute_search(docs, items, 10)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked_search(documents(spark, []), "doc_id", "text", items, "item_id", "text").collect() == []
    assert lexical.ranked_search(documents(spark, ODD), "doc_id", "text", items.limit(0), "item_id", "text").collect() == []


# --- 13: suffixes ---------------------------------------------------------------------

def brute_bytes(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, kept, hashlib.sha256(kept).hexdigest()))
    return out


def copies(seed):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcé \n\x00") for _ in range(r.randint(20, 200))) for _ in range(6)]
    texts = []
    for i in range(40):
        own = "".join(r.choice("abcdefghij klé") for _ in range(r.randint(0, 120)))
        part = r.choice(passages)
        cut = r.randint(0, len(part))
        texts.append(own[:40] + part[cut // 3:len(part) - cut // 4] + own[40:] + (part if r.random() < 0.3 else ""))
    return texts + ["a" * 300, "ab" * 150, "", None, texts[0], texts[0], "é" * 90]


@pytest.mark.parametrize("length,crowded", [(48, 4096), (48, 3), (12, 4096), (12, 5), (100, 2)])
def test_bytes_removed_as_by_brute_force(spark, length, crowded):
    texts = copies(length)
    rows = [(i % 20 if i % 9 else None, t, "x") for i, t in enumerate(texts)]
    found = suffixes.without_repeats(documents(spark, rows).repartition(4), "doc_id", "text", length, {"text": F.col("text"), "marks": F.col("n")}, crowded=crowded)
    got = sorted((r["id"], r["text"], r["marks"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["sha256"]) for r in
                 found.fillna(-1, ["id"]).fillna("-", ["text"]).collect())
    want = sorted((-1 if i is None else i, "-" if t is None else t, 7, *b) for (i, t, _), b in zip(rows, brute_bytes(texts, length)))
    assert got == want


def test_long_texts_in_overlapping_slices(spark, monkeypatch):
    r = random.Random(4)
    texts = [bytes(r.choice(b"abcd") for _ in range(3000)) for _ in range(2)]
    texts[1] = texts[1][:1000] + texts[0][900:2100] + texts[1][1000:]
    whole, cut = ([(np.asarray(o)[b[0]] + b[2], b[3], b[1]) for n, o, p in suffixes.slices(texts, 64, size) for b in [suffixes.chosen_blocks(p, 64)]]
                  for size in (1 << 20, 700))
    def windows(found):
        return sorted((int(f) + j, int(v)) for first, count, value in found for f, c, v in zip(first, count, value) for j in range(c))
    assert windows(whole) == windows(cut) and len(windows(whole)) == sum(len(t) - 63 for t in texts)


def test_loser_tree_gives_order_and_common_prefixes():
    r = random.Random(3)
    for _ in range(150):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 8))) for _ in range(r.randint(1, 7))]
        coded = []
        for run in runs:
            shared = [suffixes.common_prefix(a, b) for a, b in zip([b"", *run], run)]
            coded.append(suffixes.Run(np.array(shared, dtype="u4"), [x[n:] for x, n in zip(run, shared)]))
        at, out = [0] * len(runs), [b""]
        for stream, n in suffixes.merged(coded):
            x = runs[stream][at[stream]]
            at[stream] += 1
            assert n == suffixes.common_prefix(out[-1], x)
            out.append(x)
        assert out[1:] == sorted(sum(runs, []))


def test_bytes_of_nothing(spark):
    assert suffixes.without_repeats(documents(spark, []), "doc_id", "text").collect() == []
    found = suffixes.without_repeats(documents(spark, ODD), "doc_id", "text", with_text=False).collect()
    assert len(found) == len(ODD) and {r["n_removed"] for r in found} == {0} and {r["kept"] for r in found} == {None}


def test_queries_have_the_contract_columns(spark):
    from conftest import SF_SMALL
    want = {"op11_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"], "op12_ranked_search": ["item_id", "rank", "doc_id", "score"],
            "op13_repeated_bytes": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]}
    for name, columns in want.items():
        assert QUERIES[name](spark, SF_SMALL).columns == columns


# --- 3, 6, 7: what was lost ---------------------------------------------------------------

def test_forest_finds_all_of_few_and_most_of_clustered_vectors(spark):
    from pagetide.llm import hashforest
    r = np.random.default_rng(11)

    def recall(near, far, k=20, groups=1):
        centres = r.standard_normal((groups, 64)) * 3
        rows = np.concatenate([centres[i % groups] + 0.01 * r.standard_normal((1, 64)) for i in range(near)] + [r.standard_normal((far, 64))])
        df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").coalesce(1)
        asked = df.where("vec_id % 20 = 0")
        got = {}
        for x in hashforest.search_forest(hashforest.build_forest(df, "vec_id", "embedding"), asked, "vec_id", "embedding", k).collect():
            got.setdefault(x["query_id"], []).append(x["vec_id"])
        hits = wanted = 0
        for q in range(0, near + far, 20):
            best = [i for i in np.argsort(-(rows @ rows[q]), kind="stable") if i != q][:k]
            assert len(got[q]) == min(k, near + far - 1)
            hits, wanted = hits + len(set(best) & set(got[q])), wanted + len(best)
        return hits / wanted

    assert recall(8, 7) == 1.0
    assert recall(8, 300) >= 0.9
    assert recall(14, 1900) >= 0.9
    assert recall(600, 900, groups=40) >= 0.9


def test_top_k_of_huge_scores(spark):
    from pagetide.llm import topk
    rows = [(100, [2097152.0]), (1, [-2097152.0]), (2, [2097152.0]), (3, [3e6]), (4, [-3e6]), (5, [1e200]), (6, [-1e200]), (7, [1.7e308]), (8, [0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.exact_top_k(df, df.where("vec_id = 100"), "vec_id", "embedding", 10).collect()
    low, high = -(1 << 63), (1 << 63) - 1
    q = math.floor(1024 * 2097152.0)
    want = {i: max(low, min(high, q * (math.floor(1024 * v[0]) if abs(v[0]) < 1e300 else int(np.finfo(float).max) * (1 if v[0] > 0 else -1)))) for i, v in rows if i != 100}
    assert {r["vec_id"]: r["score"] for r in out} == want and want[1] == -(1 << 62) and want[6] == low and want[5] == high
    assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"])] == [i for i, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))]


def test_language_of_rows_that_repeat_one_id_is_learned(spark):
    from pagetide.llm import langid
    english, german = "the cat sat on the mat and then it ran away {}", "der Hund und die Katze sind nicht im Haus {}"
    rows = [(i, english.format(i), "en") for i in range(1200)]
    drawn = spark.range(4000).select("id", langid.by_checksum(F.col("id")).alias("d"), langid.learnable(F.col("id")).alias("l")).where("l").orderBy(F.desc("d")).first()
    rows += [(drawn["id"], german.format(i), "de") for i in range(3000)]  # the id that is drawn last
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, "text", "lang", langid.learnable(F.col("doc_id")), langid.by_checksum(F.col("doc_id")))
    assert sorted(x for group in model.members.values() for x in group) == ["de", "en"]
