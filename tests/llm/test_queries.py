"""The registered queries themselves, over whole small tables, against brute force or the reference library."""
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from pagetide.llm.queries import QUERIES, VOCABULARY

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    votes = Counter()
    for p in parts:
        h = xxhash.xxh64(p.encode(), seed=42).intdigest()
        votes.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in votes.items() if 2 * n > len(parts))


def test_simhash_query(spark, texts):
    prints = {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash_groups"](spark, SF_SMALL).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_forest_query(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    matrix = np.stack([rows[i] for i in ids])
    got = {}
    for r in QUERIES["op7_hash_forest"](spark, SF_SMALL).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        scores = matrix @ rows[q]
        scores[ids == q] = -np.inf
        hits += len({int(i) for i in ids[np.lexsort((ids, -scores))][:20]} & {v for v, _ in found.values()})
        order = [found[i] for i in range(1, 21)]
        assert all(s == pytest.approx(float(rows[v] @ rows[q]), abs=1e-9) for v, s in order)
        assert order == sorted(order, key=lambda x: (-x[1], x[0])) and len({v for v, _ in order}) == 20
    assert hits >= 0.9 * 20 * len(got)


def test_sentencepiece_query(spark, texts):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    got = QUERIES["op10_sentencepiece"](spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r["doc_id"]] or "")
        assert list(r["ids"]) == want and r["n_tokens"] == len(want)


def test_language_query(spark, texts):
    learned = {r["lang"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang").collect()
               if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    got = QUERIES["op6_language"](spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        lettered = any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] in learned) if lettered else r["lang_pred"] == "und"


def test_quality_query_ranks_good_above_toxic(spark, texts):
    got = {r["doc_id"]: r for r in QUERIES["op1_ordinal_quality"](spark, SF_SMALL).collect()}
    assert set(got) == set(texts)
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()
    grade = next(c for c in next(iter(got.values())).asDict() if "grade" in c or "expected" in c)
    good = [got[r["doc_id"]][grade] for r in labels if r["quality"] == 1 and r["toxic"] == 0]
    bad = [got[r["doc_id"]][grade] for r in labels if r["toxic"] == 1]
    assert good and (not bad or np.mean(good) > np.mean(bad))
    assert all(0 <= r[grade] <= 2 for r in got.values())
