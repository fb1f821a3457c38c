"""Operator 6: hierarchical language identification.

The language family is predicted first (multinomial logistic regression); inside a family, linear
support vector machines for every pair of its languages vote.  Both read the same features: hashed
character n-grams of the whole text, letters only.  The models are fitted by MLlib on a bounded,
documented number of labelled texts per language; texts of any length are classified whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

DIMS = 1 << 14
ORDERS = (1, 2, 3)
# Bound of the training sample: so many texts per language, those with the smallest draw.
PER_LANGUAGE = 500
# Draws lie in [0, DRAWS).
DRAWS = 1 << 32
UNKNOWN = "und"
_PIECE = 1 << 18

# Language families by ISO 639-1 code.  A code not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "yi", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "celtic": ("ga", "gd", "cy", "br"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "semitic": ("ar", "he", "mt", "am"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
    "dravidian": ("ta", "te", "kn", "ml"),
}


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"only {lang}")


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of square-rooted hashed n-gram counts; None for a text without letters.

    Lower case, every run of other characters is one blank, a blank at both ends.
    """
    if not text:
        return None
    counts, tail, seen = np.zeros(DIMS), np.array([32], dtype=np.uint32), False
    for at in range(0, len(text), _PIECE):
        codes = np.frombuffer(text[at:at + _PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        seen = seen or bool(letter.any())
        codes = np.where(letter, codes, np.uint32(32))
        if at + _PIECE >= len(text):
            codes = np.r_[codes, np.uint32(32)]
        before = np.r_[tail[-1], codes[:-1]]
        codes = codes[(codes != 32) | (before != 32)]
        codes = np.r_[tail, codes]
        for n in ORDERS:
            h = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint32)
            for i in range(n):
                h = (h + codes[i:len(codes) - n + 1 + i]) * np.uint32(0x9E3779B1)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + np.uint32(n)
            # n-grams that lie in the last piece's tail were counted there.
            fresh = h[max(0, len(tail) - n + 1):] if at else h
            counts += np.bincount(fresh >> np.uint32(18), minlength=DIMS)
        tail = codes[-(max(ORDERS) - 1):]
    if not seen:
        return None
    x = np.sqrt(counts)
    return x / np.linalg.norm(x)


@dataclass
class Model:
    """Families with their languages, the family model's rows, and one hyperplane per language pair."""
    families: list[str]
    members: dict[str, list[str]]
    family_weights: np.ndarray  # families x DIMS
    family_bias: np.ndarray
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]]

    def predict(self, x: np.ndarray) -> tuple[str, float, float]:
        """Language, the family's probability, and the winner's least margin against its relatives, as a
        logistic (half or more if it won every vote).  Votes first, then margins, then the smaller code."""
        z = self.family_weights @ x + self.family_bias
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        langs = self.members[self.families[best]]
        votes, least = dict.fromkeys(langs, 0), dict.fromkeys(langs, 1.0)
        for a, b in combinations(langs, 2):
            w, bias = self.pairs[a, b]
            sure = float(1 / (1 + np.exp(-4 * (w @ x + bias))))
            votes[a if sure >= 0.5 else b] += 1
            least[a], least[b] = min(least[a], sure), min(least[b], 1 - sure)
        lang = min(langs, key=lambda c: (-votes[c], -least[c], c))
        return lang, float(p[best]), least[lang]


def _feature_rows(batches):
    for batch in batches:
        langs, idx, val = [], [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            x = features(text)
            if x is not None:
                at = np.flatnonzero(x)
                langs.append(lang)
                idx.append(at)
                val.append(x[at])
        if langs:
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(idx, pa.list_(pa.int32())),
                                              pa.array(val, pa.list_(pa.float64()))], names=["lang", "idx", "val"])


def train(docs: DataFrame, text: str, lang: str, learn: Column, draw: Column,
          per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on rows where ``learn`` holds and text and language are not null: of every language the
    ``per_language`` rows with the smallest ``draw``, a checksum evenly spread over [0, DRAWS).  None if
    no such row has a letter."""
    spark = docs.sparkSession
    rows = docs.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
    # About twice as many different draws as wanted pass the limit, whatever the table's size; those rows are ranked.  Rows
    # that share an id share a draw, so draws are counted, not rows.
    limits = rows.groupBy("lang").agg((F.lit(2.0 * per_language * DRAWS) / F.approx_count_distinct("draw")).alias("limit"))
    order = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))
    sample = (rows.join(F.broadcast(limits), "lang").where(F.col("draw") < F.col("limit")).select("lang", "text", "draw")
                  .withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("lang", "text"))
    found = cut(sample.mapInArrow(_feature_rows, "lang string, idx array<int>, val array<double>"))
    langs = sorted(r[0] for r in found.select("lang").distinct().collect())
    if not langs:
        return None
    families = sorted({family_of(x) for x in langs})
    members = {f: [x for x in langs if family_of(x) == f] for f in families}
    code = {x: i for i, x in enumerate(langs)}
    vectors = found.rdd.map(lambda r: (float(code[r["lang"]]), Vectors.sparse(DIMS, r["idx"], r["val"])))
    data = cut(spark.createDataFrame(vectors, ["lang", "features"]).repartition(6))

    def labelled(classes: dict[str, int]) -> DataFrame:
        pairs = [x for k, v in classes.items() for x in (F.lit(float(code[k])), F.lit(float(v)))]
        return data.withColumn("label", F.element_at(F.create_map(*pairs), F.col("lang"))).where("label IS NOT NULL")

    weights, bias = np.zeros((len(families), DIMS)), np.zeros(len(families))
    if len(families) > 1:
        fit = LogisticRegression(family="multinomial", maxIter=25, regParam=1e-4, standardization=False).fit(
            labelled({x: families.index(family_of(x)) for x in langs}))
        weights, bias = fit.coefficientMatrix.toArray(), fit.interceptVector.toArray()
    pairs = {}
    for group in members.values():
        for a, b in combinations(group, 2):
            fit = LinearSVC(maxIter=25, regParam=1e-4, standardization=False).fit(labelled({a: 1, b: 0}))
            pairs[a, b] = fit.coefficients.toArray(), float(fit.intercept)
    return Model(families, members, weights, bias, pairs)


def _classify(shared, parts):
    def run(batches):
        model = shared.value
        for batch in batches:
            found = []
            for text in batch.column("__text").to_pylist():
                x = features(text) if model else None
                found.append(model.predict(x) if x is not None else (UNKNOWN, 0.0, 0.0))
            columns = {"lang_pred": pa.array([f[0] for f in found], pa.string()),
                       "score": pa.array([round(f[1] * f[2], 6) for f in found], pa.float64())}
            if parts:
                columns |= {"family": pa.array([f[1] for f in found], pa.float64()), "margin": pa.array([f[2] for f in found], pa.float64())}
            rest = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], *columns.values()], names=[*rest, *columns])
    return run


def classify(docs: DataFrame, model: Model | None, text: str, keep: dict[str, Column], parts: bool = False) -> DataFrame:
    """The ``keep`` columns, lang_pred and score of every row; ``und`` and 0 for a text that is null or
    has no letter, or where there is no model.  The score is the family's probability times the margin
    inside it; ``parts`` adds these two as ``family`` and ``margin``.  One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    found = "lang_pred string, score double" + (", family double, margin double" if parts else "")
    return rows.mapInArrow(_classify(shared, parts), ", ".join(x for x in (schema, found) if x))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: a quarter, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return doc_id.isNotNull() & ~held_out(doc_id)


def by_checksum(doc_id: Column) -> Column:
    """The draw that picks the training sample."""
    return F.crc32(F.concat(F.lit("train:"), doc_id.cast("string")).cast("binary"))
