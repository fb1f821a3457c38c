"""Dense vectors: cosine distance, duplicate detection in order, mean pooling,
token chunking for an embedding model, PCA."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.operators.ordering import with_previous

DISTANCE_THRESHOLD = 0.01


def _dbl(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.transform(col, lambda x: x.cast("double"))


def cosine_distance(a, b) -> Column:
    """1 - a.b / (|a| |b|) in double precision (null when a side is null)."""
    a, b = _dbl(a), _dbl(b)

    def fold(arr):
        return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)

    dot = fold(F.zip_with(a, b, lambda x, y: x * y))
    na = F.sqrt(fold(F.transform(a, lambda x: x * x)))
    nb = F.sqrt(fold(F.transform(b, lambda x: x * x)))
    return 1 - F.try_divide(dot, na * nb)


def semantic_duplicates(df: DataFrame, order: str, vec: str, threshold: float = DISTANCE_THRESHOLD,
                        group_cols: list[str] | None = None) -> DataFrame:
    """(order, distance, valid): each vector against the previous non-null vector
    in ``order``; the first is valid, later ones need distance >= threshold,
    rows without a vector are invalid.  One exchange by range; distances alone are checkpointed."""
    groups = group_cols or []
    present = df.filter(F.col(vec).isNotNull()).select(*groups, order, vec)
    dist = cosine_distance(F.col(vec), F.col("prev_" + vec))
    scored = with_previous(present, groups, [order], [vec], {"distance": dist, "valid": ~F.col("has_prev") | (dist >= threshold)}, [*groups, order])
    missing = df.filter(F.col(vec).isNull()).select(*groups, order, F.lit(None).cast("double").alias("distance"),
                                                     F.lit(False).alias("valid"))
    return scored.unionByName(missing)


def mean_vectors(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, dim, mean): element-wise mean per group.  ``Summarizer`` adds vectors up as they are, one buffer per group
    and task; rows with a null vector count nowhere."""
    data = df.where(F.col(vec).isNotNull()).select(group, array_to_vector(_dbl(vec)).alias("_v"))
    mean = data.groupBy(group).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return mean.select(group, F.posexplode(vector_to_array("_m")).alias("dim", "mean"))


def token_chunks(df: DataFrame, key: str, text: str, max_size: int = 512) -> DataFrame:
    """(key, part, start, end, tokens, padding, chunk, chunk_md5): ceil(n / max_size)
    even parts of the whitespace tokens, boundaries ceil(i * n / parts).  ``chunk`` holds the part's
    tokens, space-joined; ``padding`` says how many pad tokens fill it up to ``max_size``."""
    toks = df.select(key, H.words(F.array(F.col(text))).alias("_t"))
    n = F.size("_t")
    parts = F.ceil(n / F.lit(float(max_size))).cast("int")
    with_parts = toks.select(key, "_t", n.alias("_n"), parts.alias("_p"))
    avg = F.col("_n") / F.col("_p")
    # Empty documents get an empty part list (no filter that Catalyst could push below the spread).
    parts_idx = F.when(F.col("_p") > 0, F.sequence(F.lit(0), F.col("_p") - 1)).otherwise(F.array().cast("array<int>"))
    bounds = F.transform(parts_idx,
                         lambda i: F.struct(i.alias("part"), F.ceil(i * avg).cast("int").alias("start"),
                                            F.ceil((i + 1) * avg).cast("int").alias("end")))
    # Each part takes its own tokens before the explode, so no row carries the whole text.
    parts = F.transform("_bounds", lambda b: F.struct(
        b["part"].alias("part"), b["start"].alias("start"), b["end"].alias("end"),
        F.array_join(F.slice("_t", b["start"] + 1, b["end"] - b["start"]), " ").alias("chunk")))
    rows = with_parts.select(key, "_t", bounds.alias("_bounds")).select(key, F.explode(parts).alias("_b"))
    return rows.select(key, "_b.part", "_b.start", "_b.end", (F.col("_b.end") - F.col("_b.start")).alias("tokens"),
                       (F.lit(max_size) - F.col("_b.end") + F.col("_b.start")).alias("padding"),
                       "_b.chunk", F.md5("_b.chunk").alias("chunk_md5"))


def fit_pca(df: DataFrame, vec: str, k: int = 24) -> PipelineModel:
    """Centring and the first k principal components as one model; save it with ``ml.save_model``, load it with
    ``ml.load_model("pca", ...)``.  Null vectors take no part."""
    data = df.where(F.col(vec).isNotNull()).select(array_to_vector(_dbl(vec)).alias("_v"))
    steps = [StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False), PCA(k=k, inputCol="_c", outputCol="_p")]
    return Pipeline(stages=steps).fit(data)


def project_pca(model: PipelineModel, df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, pca): projection of each vector by a fitted model; a null vector has a null projection."""
    data = df.select(key, array_to_vector(_dbl(vec)).alias("_v"), F.col(vec).isNull().alias("_null"))
    done = model.transform(data.where(~F.col("_null"))).select(key, vector_to_array("_p").alias("pca"))
    return done.unionByName(data.where("_null").select(key, F.lit(None).cast("array<double>").alias("pca")))


def pca_components(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(component, explained, loadings) of a fitted model: one row per component."""
    pca = model.stages[-1]
    share, loadings = pca.explainedVariance.toArray().tolist(), pca.pc.toArray().T.tolist()
    rows = [(i, float(x), [float(v) for v in w]) for i, (x, w) in enumerate(zip(share, loadings, strict=True))]
    return spark.createDataFrame(rows, "component int, explained double, loadings array<double>")


def pca_projection(df: DataFrame, key: str, vec: str, k: int = 24) -> DataFrame:
    """(key, pca): projection on the first k principal components after centring."""
    return project_pca(fit_pca(df, vec, k), df, key, vec)
