"""Named queries: each takes (spark, table_dir) and returns a lazy DataFrame.

Every query reads the given tables (or a proxy view Spark derives from them)
in full; nothing is sampled, capped or pre-filtered for the check.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions import dates as DT
from pagetide.operators import change_types as CT
from pagetide.operators import crawl as C
from pagetide.operators import diff as D
from pagetide.operators import ml as M
from pagetide.operators import pages as P
from pagetide.operators import seeds as SD
from pagetide.operators import stats as ST
from pagetide.operators import threats as TH
from pagetide.operators import timeline as T
from pagetide.operators import vectors as V
from pagetide.sources import proxies as X
from pagetide.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


# ---------------------------------------------------------------- page features

@query("page_linkage")
def q_page_linkage(spark, root):
    return P.page_linkage(Tables(spark, root).pages)


@query("page_url_features")
def q_page_url_features(spark, root):
    return P.url_features(Tables(spark, root).pages)


@query("page_html_features")
def q_page_html_features(spark, root):
    return P.html_features(Tables(spark, root).pages)


@query("page_text_features")
def q_page_text_features(spark, root):
    return P.text_features(Tables(spark, root).pages)


@query("page_static_features")
def q_page_static_features(spark, root):
    return P.static_features(Tables(spark, root).pages)


# ---------------------------------------------------------------- change timeline

def _bits(spark, root, only_first_stage=False):
    bits = X.change_bits(Tables(spark, root).events)
    return T.first_stage(bits) if only_first_stage else bits


def _weekly(spark, root):
    bits = _bits(spark, root)
    start, n_weeks = T.study_weeks(bits)
    return bits, start, n_weeks


def _n_pairs(bits):
    return int(bits.agg(F.count_distinct("day2")).first()[0])


@query("weekly_changes")
def q_weekly_changes(spark, root):
    bits, start, n_weeks = _weekly(spark, root)
    return T.weekly_changes(bits, start, n_weeks)


@query("change_matrix")
def q_change_matrix(spark, root):
    bits, start, n_weeks = _weekly(spark, root)
    return T.change_matrix(bits, start, n_weeks)


@query("normalized_matrix")
def q_normalized_matrix(spark, root):
    bits, start, n_weeks = _weekly(spark, root)
    return T.normalized_matrix(T.change_matrix(bits, start, n_weeks))


@query("change_cube")
def q_change_cube(spark, root):
    bits, start, n_weeks = _weekly(spark, root)
    return T.change_cube(bits, start, n_weeks)


@query("alluvial_edges")
def q_alluvial_edges(spark, root):
    bits, start, n_weeks = _weekly(spark, root)
    return T.alluvial_edges(T.change_cube(bits, start, n_weeks))


@query("avg_behaviour")
def q_avg_behaviour(spark, root):
    bits, start, n_weeks = _weekly(spark, root)
    return T.average_behaviour(T.change_matrix(bits, start, n_weeks))


@query("persistence")
def q_persistence(spark, root):
    bits, start, n_weeks = _weekly(spark, root)
    return T.persistence(T.change_cube(bits, start, n_weeks))


@query("persistence3")
def q_persistence3(spark, root):
    bits, start, n_weeks = _weekly(spark, root)
    return T.persistence3(T.change_cube(bits, start, n_weeks))


@query("persistence_all")
def q_persistence_all(spark, root):
    bits, start, n_weeks = _weekly(spark, root)
    return T.persistence_all(T.change_cube(bits, start, n_weeks))


@query("neighbour_moves")
def q_neighbour_moves(spark, root):
    bits, start, n_weeks = _weekly(spark, root)
    return T.neighbour_moves(T.change_cube(bits, start, n_weeks))


@query("neighbour_moves3")
def q_neighbour_moves3(spark, root):
    bits, start, n_weeks = _weekly(spark, root)
    return T.neighbour_moves3(T.change_cube(bits, start, n_weeks))


@query("daily_changes")
def q_daily_changes(spark, root):
    return T.daily_changes(_bits(spark, root))


@query("weekday_changes")
def q_weekday_changes(spark, root):
    return T.daily_changes(_bits(spark, root), limit_weekday=1)


@query("first_stage_daily")
def q_first_stage_daily(spark, root):
    return T.daily_changes(_bits(spark, root, only_first_stage=True))


@query("changes_per_page")
def q_changes_per_page(spark, root):
    return T.changes_per_page(_bits(spark, root))


@query("rare_changes")
def q_rare_changes(spark, root):
    bits = _bits(spark, root)
    # The proxy's pages change on most days; a 0.5 share keeps the rare set non-empty.
    return T.rare_changes(bits, _n_pairs(bits), 0.5)


@query("day_change_curve")
def q_day_change_curve(spark, root):
    bits = _bits(spark, root)
    return T.day_change_curve(bits, _n_pairs(bits))


# ---------------------------------------------------------------- order statistics, training data

def _training(spark, root):
    t = Tables(spark, root)
    return X.training(t.documents, t.labels)


def _counts_long(spark, root):
    return ST.unpivot(X.text_counts(Tables(spark, root).documents), X.TRAINING_FEATURES)


def _predicted(spark, root):
    # Deterministic threshold classifier standing in for stored model predictions.
    tr = _training(spark, root)
    return tr.withColumn("prediction", F.when(F.col("f_dots") > F.col("f_lines"), 1).otherwise(0))


@query("feature_percentiles")
def q_feature_percentiles(spark, root):
    return ST.percentiles(_counts_long(spark, root))


@query("value_statistics")
def q_value_statistics(spark, root):
    return ST.value_statistics(_counts_long(spark, root), ignore_extremes=0.025)


@query("quantity_statistics")
def q_quantity_statistics(spark, root):
    li = Tables(spark, root).lineitem
    long = ST.unpivot(li.select(F.col("l_quantity").cast("int").alias("quantity"),
                                F.col("l_linenumber").alias("linenumber")), ["quantity", "linenumber"])
    return ST.value_statistics(long, ignore_extremes=0.025)


@query("interval_edges")
def q_interval_edges(spark, root):
    return ST.interval_edges(_counts_long(spark, root), 10)


@query("error_heatmap")
def q_error_heatmap(spark, root):
    intervals = ST.interval_edges(ST.unpivot(_training(spark, root), X.TRAINING_FEATURES), 10)
    return ST.error_heatmap(_predicted(spark, root), X.TRAINING_FEATURES, intervals)


@query("min_recall")
def q_min_recall(spark, root):
    return ST.confusion(_predicted(spark, root))


@query("accuracy")
def q_accuracy(spark, root):
    return ST.accuracy(_predicted(spark, root))


@query("hash_split")
def q_hash_split(spark, root):
    return M.hash_split(_training(spark, root)).select("page_id", "label", "validation")


@query("class_weights")
def q_class_weights(spark, root):
    return M.class_weights(_training(spark, root)).select("page_id", "label", "weight")


@query("balanced_sample")
def q_balanced_sample(spark, root):
    return M.balanced_sample(_training(spark, root), 100)


@query("feature_grid")
def q_feature_grid(spark, root):
    counts = X.text_counts(Tables(spark, root).documents)
    st = counts.agg(F.min("f_lines").alias("xl"), F.max("f_lines").alias("xh"),
                    F.min("f_commas").alias("yl"), F.max("f_commas").alias("yh"))
    return ST.feature_grid(st, "xl", "xh", "yl", "yh", 100)


# ---------------------------------------------------------------- crawl clean-up

def _crawl_order(spark, root):
    # The proxy range-partitions first thing: no round-robin spread in front of it.
    return X.crawl_order(Tables(spark, root, spread=False).documents)


@query("crawl_ordered")
def q_crawl_ordered(spark, root):
    co = _crawl_order(spark, root).withColumn("stage_index", F.lit(0))
    return C.with_order_index(co).select("doc_id", "log_index", "url_index", "thread", "order_index")


@query("sampled_pages")
def q_sampled_pages(spark, root):
    return C.sample_crawl(_crawl_order(spark, root)).select("doc_id", "log_index", "url_index")


def _against_previous(spark, root, result, threads=("thread",), order=("url_index",), keep=("doc_id", "log_index", "url_index")):
    # A crawler thread's pages in URL order (FIXTURES: thread = source % 4).
    pages = C.page_signatures(_crawl_order(spark, root))
    return C.against_previous(pages, list(threads), list(order), result, list(keep))


def _starts():
    return {"has_prev": F.col("prev_line_hashes").isNotNull(), "same_start": C.same_start(), "cheap_valid": C.cheap_valid()}


@query("start_duplicates")
def q_start_duplicates(spark, root):
    return _against_previous(spark, root, _starts())


@query("hash_duplicates")
def q_hash_duplicates(spark, root):
    return _against_previous(spark, root, {"valid": C.other_text()})


@query("false_duplicates")
def q_false_duplicates(spark, root):
    return _against_previous(spark, root, {"valid": C.not_false_duplicate()})


@query("log_blob_join")
def q_log_blob_join(spark, root):
    t = Tables(spark, root)
    # Stand-in log: one row per labelled document; quality 1 = fetched, toxic 0 = file kept.
    logs = t.labels.select(
        F.lit(None).cast("date").alias("day"), F.col("doc_id").cast("string").alias("page_key"),
        F.when(F.col("quality") == 1, F.lit(C.SUCCESS_STATUS)).otherwise(F.lit("RequestStatus.HEADLESS_FAILED"))
         .alias("status"),
        (F.col("toxic") == 0).alias("file_present"))
    blobs = t.documents.select(F.lit(None).cast("date").alias("day"), F.col("doc_id").cast("string").alias("page_key"),
                               F.col("text").alias("html"))
    joined = C.join_logs_pages(logs, blobs)
    return joined.select("page_key", F.octet_length("html").alias("size"), F.md5("html").alias("page_md5"))


@query("threat_urls")
def q_threat_urls(spark, root):
    rows = X.log_rows(Tables(spark, root).events)
    threats = rows.filter(F.col("is_threat") == 1).select("ts")
    logs = rows.filter(F.col("is_threat") == 0).select("event_id", "ts")
    return TH.flag_threat_window(logs, threats, seconds=10)


# ---------------------------------------------------------------- crawl days of pages, end to end

ELEMENT_LISTS = ["images", "scripts", "tables", "meta", "html_tags"]
CHANGE_TARGETS = ["text", "internal_outlinks", "external_outlinks"]


def _series(spark, root):
    return X.crawl_series(Tables(spark, root).pages)


def _clean_series(spark, root):
    """Log and pages of the crawl series, cleaned.  The overlap ratio, which SQL can't express, is left to
    ``false_duplicates``."""
    series = _series(spark, root)
    return C.clean_crawl(series.drop("html"), series.select("day", "page_key", "html"), use_ratio=False)


@query("page_element_lists")
def q_page_element_lists(spark, root):
    """Number and digest of the serialised elements of every page and day."""
    lists = P.html_lists(_series(spark, root), keys=("day", "page_key"))
    return lists.select("day", "page_key", *[F.size(k).alias(k) for k in ELEMENT_LISTS],
                        *[F.md5(F.array_join(k, "\n")).alias(f"{k}_md5") for k in ELEMENT_LISTS])


@query("clean_pages")
def q_clean_pages(spark, root):
    return _clean_series(spark, root).select("day", "page_key", "log_index", "url_index", F.size("text_lines").alias("lines"),
                                             F.md5("html").alias("page_md5"))


@query("page_change_bits")
def q_page_change_bits(spark, root):
    """Clean-up, nine feature lists, and the change bits of all nine between consecutive crawl days."""
    return D.crawl_change_bits(_clean_series(spark, root), P.FEATURES)


@query("page_training_pairs")
def q_page_training_pairs(spark, root):
    """Nine list sizes of the first day and three change bits, from cleaned pages."""
    lists = P.page_feature_lists(_clean_series(spark, root), keys=("day", "page_key"), text="text_lines")
    return D.training_pairs(lists, P.FEATURES, CHANGE_TARGETS, key="page_key")


@query("page_hash_duplicates")
def q_page_hash_duplicates(spark, root):
    """Hash check of valid pages in crawl order; pages without text compare their HTML counts."""
    valid = C.valid_log_entries(_series(spark, root))
    keys = ("day", "log_index", "url_index", "page_key")
    texts = P.text_and_counts(valid, keys)
    return C.against_previous(C.page_signatures(texts, "text"), ["day", "log_index"], ["url_index"], {"valid": C.other_text("counts")},
                              ["day", "page_key"], extra=("counts",))


@query("crawl_static_features")
def q_crawl_static_features(spark, root):
    """Full static row of every crawled page, with the weekday of its crawl timestamp."""
    pages = C.valid_log_entries(_series(spark, root)).withColumn("ts", DT.crawl_timestamp("ts"))
    return P.static_features(pages, keys=("day", "page_key"), ts="ts")


# ---------------------------------------------------------------- day-over-day diff

SNAP_FEATURES = ["text", "internal_outlinks", "meta"]


def _snap(spark, root):
    return X.snapshots(Tables(spark, root).documents)


@query("day_pair_bits")
def q_day_pair_bits(spark, root):
    return D.change_bits(_snap(spark, root), SNAP_FEATURES, day="day_no")


@query("feature_numbers")
def q_feature_numbers(spark, root):
    return D.feature_numbers(_snap(spark, root), SNAP_FEATURES, day="day_no")


@query("training_pairs")
def q_training_pairs(spark, root):
    return D.training_pairs(_snap(spark, root), SNAP_FEATURES, ["text", "internal_outlinks"], day="day_no")


def _digest_pairs(spark, root):
    snap = _snap(spark, root)
    dig = snap.select("page_id", "day_no", *[D.digest(f).alias(f) for f in SNAP_FEATURES], "page_hash")
    return D.day_pairs(dig, SNAP_FEATURES + ["page_hash"], day="day_no")


@query("change_fractions")
def q_change_fractions(spark, root):
    return CT.change_fractions(_digest_pairs(spark, root), SNAP_FEATURES)


@query("informative_split")
def q_informative_split(spark, root):
    return CT.informative_split(_digest_pairs(spark, root), SNAP_FEATURES)


@query("feature_diff")
def q_feature_diff(spark, root):
    return D.feature_diff(_snap(spark, root), SNAP_FEATURES, day="day_no")


@query("change_amplitudes")
def q_change_amplitudes(spark, root):
    return CT.change_amplitudes(D.feature_diff(_snap(spark, root), SNAP_FEATURES, day="day_no"))


@query("combined_differences")
def q_combined_differences(spark, root):
    """Per-feature lists of changed list sizes side by side; a feature without a change lacks the key."""
    numbers = D.feature_numbers(_snap(spark, root), SNAP_FEATURES, day="day_no")
    pairs = D.day_pairs(numbers, SNAP_FEATURES, day="day_no")
    frames = {f: pairs.where(F.col(f + "_1") != F.col(f + "_2")).select("page_id", "day1", (F.col(f + "_2") - F.col(f + "_1")).alias("value"))
              for f in SNAP_FEATURES}
    frames["all"] = pairs.select("page_id", "day1", F.lit(0).alias("value"))
    both = D.combine_features(frames, ["page_id", "day1"])
    return both.select("page_id", "day1", *SNAP_FEATURES, F.array_join("missing", ",").alias("missing"), F.size("repeated").alias("repeated"))


@query("diff_totals")
def q_diff_totals(spark, root):
    return D.diff_totals(D.feature_diff(_snap(spark, root), ["text"], day="day_no", page_hash=None), "text")


@query("changed_sample")
def q_changed_sample(spark, root):
    s = D.changed_sample(_snap(spark, root), "text", 10, day="day_no")
    return s.select("page_id", "day1", "day2", F.size("removed").alias("n_removed"), F.size("added").alias("n_added"),
                    F.md5(F.array_join(F.array_sort("removed"), "\n")).alias("removed_md5"),
                    F.md5(F.array_join(F.array_sort("added"), "\n")).alias("added_md5"))


@query("change_categories")
def q_change_categories(spark, root):
    return CT.category_shares(X.categories(Tables(spark, root).events))


@query("useful_changes")
def q_useful_changes(spark, root):
    return CT.useful_share(X.categories(Tables(spark, root).events), useful=("purchase", "signup"))


# ---------------------------------------------------------------- seed selection

def _dump_links(spark, root):
    return SD.dump_links(X.wiki_lines(Tables(spark, root).pages))


@query("wiki_links")
def q_wiki_links(spark, root):
    return _dump_links(spark, root)


@query("tld_links")
def q_tld_links(spark, root):
    return SD.tld_filter(_dump_links(spark, root), "com")


@query("ranked_domains")
def q_ranked_domains(spark, root):
    ranked = X.ranked_domains(Tables(spark, root).pages).select(
        F.col("host").alias("domain"), F.substring_index("host", ".", -1).alias("tld"))
    return SD.ranked_domain_links(ranked, "com")


@query("limited_links")
def q_limited_links(spark, root):
    return SD.limit_per_domain(_dump_links(spark, root), limit=SD.SLD_LIMIT)


@query("popular_links")
def q_popular_links(spark, root):
    return SD.limit_per_domain(_dump_links(spark, root), limit=SD.SLD_LIMIT, by_popularity=True)


@query("stage_sizes")
def q_stage_sizes(spark, root):
    return SD.stage_sizes(SD.limit_per_domain(_dump_links(spark, root), limit=SD.SLD_LIMIT))


@query("domain_split")
def q_domain_split(spark, root):
    staged = SD.limit_per_domain(_dump_links(spark, root), limit=SD.SLD_LIMIT)
    return SD.split_domains(staged.filter(F.col("stage") == 0), train_size=0.8)


# ---------------------------------------------------------------- vectors

# Float sums depend on summation order; registered results are rounded to 9
# places so that engines agree bit for bit (the operators keep full precision).
@query("cosine_neighbours")
def q_cosine_neighbours(spark, root):
    d = V.semantic_duplicates(Tables(spark, root).embeddings, "vec_id", "embedding")
    return d.withColumn("distance", F.round("distance", 9))


@query("vector_mean")
def q_vector_mean(spark, root):
    return V.mean_vectors(Tables(spark, root).embeddings, "label", "embedding").withColumn("mean", F.round("mean", 9))


@query("token_chunks")
def q_token_chunks(spark, root):
    return V.token_chunks(Tables(spark, root).documents, "doc_id", "text", 512)


@query("pca_components")
def q_pca_components(spark, root):
    return V.pca_projection(Tables(spark, root).embeddings, "vec_id", "embedding", k=24)


@query("pca_model")
def q_pca_model(spark, root):
    """Explained variance and loadings of the 24 components."""
    return V.pca_components(V.fit_pca(Tables(spark, root).embeddings, "embedding", 24), spark)


# ---------------------------------------------------------------- models (rows-only checks)

@contextmanager
def _prepared(spark, root):
    """Training data persisted for the fits of one query, released afterwards
    (results that are still lazy recompute from lineage)."""
    prep = M.prepare(_training(spark, root), X.TRAINING_FEATURES)
    try:
        yield prep.train, prep.test, prep.balanced
    finally:
        prep.release()


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


CONF_SCHEMA = "model string, tn long, fp long, fn long, tp long, recall_zero double, recall_one double, min_recall double"


def _conf_row(name, conf):
    return (name, conf["tn"], conf["fp"], conf["fn"], conf["tp"], conf["recall_zero"], conf["recall_one"],
            conf["min_recall"])


@query("rf_eval")
def q_rf_eval(spark, root):
    with _prepared(spark, root) as (train, test, balanced):
        p = M.RF_PARAMS
        model = M.random_forest(balanced, p["numTrees"], p["maxDepth"], p["minInstancesPerNode"])
        conf = M.evaluate(model, test).first().asDict()
        return _rows(spark, [_conf_row("random_forest", conf)], CONF_SCHEMA)


@query("lr_eval")
def q_lr_eval(spark, root):
    with _prepared(spark, root) as (train, test, balanced):
        conf = M.evaluate(M.logistic_regression(balanced), test).first().asDict()
        return _rows(spark, [_conf_row("logistic_regression", conf)], CONF_SCHEMA)


@query("rf_importances")
def q_rf_importances(spark, root):
    with _prepared(spark, root) as (train, test, balanced):
        p = M.RF_PARAMS
        model = M.random_forest(balanced, p["numTrees"], p["maxDepth"], p["minInstancesPerNode"])
        return M.importances(model, X.TRAINING_FEATURES).orderBy(F.desc("importance"))


@query("lr_coefficients")
def q_lr_coefficients(spark, root):
    with _prepared(spark, root) as (train, test, balanced):
        model = M.logistic_regression(balanced)
        return M.normalized_coefficients(model, train, X.TRAINING_FEATURES).orderBy(F.desc(F.abs("share")))


@query("rf_pairs")
def q_rf_pairs(spark, root):
    with _prepared(spark, root) as (train, test, balanced):
        rows = [(X.TRAINING_FEATURES[a], X.TRAINING_FEATURES[b], conf["min_recall"])
                for (a, b), _m, conf in M.pair_models(balanced, test, X.TRAINING_FEATURES)]
        return _rows(spark, rows, "feature_a string, feature_b string, min_recall double")


@query("lr_pairs")
def q_lr_pairs(spark, root):
    """The regression half of the feature pairs: least recall of a logistic regression per pair."""
    with _prepared(spark, root) as (train, test, balanced):
        rows = [(X.TRAINING_FEATURES[a], X.TRAINING_FEATURES[b], conf["min_recall"])
                for (a, b), _m, conf in M.pair_models(balanced, test, X.TRAINING_FEATURES, fit=M.logistic_regression)]
        return _rows(spark, rows, "feature_a string, feature_b string, min_recall double")


@query("rf_depths")
def q_rf_depths(spark, root):
    with _prepared(spark, root) as (train, test, balanced):
        return _rows(spark, M.depth_sweep(balanced, test, range(2, 16)), "depth int, min_recall double")


@query("rf_grid")
def q_rf_grid(spark, root):
    with _prepared(spark, root) as (train, test, balanced):
        a, b = X.TRAINING_FEATURES.index("f_lines"), X.TRAINING_FEATURES.index("f_commas")
        p = M.RF_PARAMS
        model = M.random_forest(M.select_subset(balanced, X.TRAINING_FEATURES, [a, b]), p["numTrees"], p["maxDepth"],
                                p["minInstancesPerNode"])
        st = _training(spark, root).agg(F.min("f_lines").alias("xl"), F.max("f_lines").alias("xh"),
                                        F.min("f_commas").alias("yl"), F.max("f_commas").alias("yh"))
        return M.prediction_grid(model, ST.feature_grid(st, "xl", "xh", "yl", "yh", 100))


@query("rf_elimination")
def q_rf_elimination(spark, root):
    with _prepared(spark, root) as (train, test, balanced):
        steps = M.feature_elimination(balanced, test, X.TRAINING_FEATURES)
        return _rows(spark, steps, "features int, used string, accuracy double, dropped string")


@query("pair_sample_accuracy")
def q_pair_sample_accuracy(spark, root):
    feats = X.TRAINING_FEATURES
    with _prepared(spark, root) as (train, test, balanced):
        sample = M.balanced_sample(_training(spark, root), 100).withColumn("label", F.col("label").cast("double"))
        rows = []
        for kind, fit in (("forest", None), ("regression", M.logistic_regression)):
            for (a, b), model, _conf in M.pair_models(balanced, test, feats, fit=fit):
                cols = [feats[i] for i in sorted((a, b))]  # model input order, whatever order the pair was named in
                vec = VectorAssembler(inputCols=cols, outputCol="features").transform(sample)
                rows.append((kind, feats[a], feats[b], ST.accuracy(model.transform(vec)).first()["accuracy"]))
        return _rows(spark, rows, "model string, feature_a string, feature_b string, accuracy double")


@query("cv_search")
def q_cv_search(spark, root):
    with _prepared(spark, root) as (train, test, balanced):
        cv = M.cross_validated_forest(balanced, num_trees=(50,), max_depth=(20,), min_instances=(1,), folds=5)
        conf = M.evaluate(cv.bestModel, test).first().asDict()
        best = cv.bestModel
        return _rows(spark, [(best.getNumTrees, best.getOrDefault("maxDepth"), best.getOrDefault("minInstancesPerNode"),
                              float(max(cv.avgMetrics)), conf["min_recall"])],
                     "num_trees int, max_depth int, min_instances int, auc double, min_recall double")


@query("lr_cv_search")
def q_lr_cv_search(spark, root):
    """The whole regression grid (family, elastic net, regularisation), five folds: mean area under the curve of every cell."""
    with _prepared(spark, root) as (train, test, balanced):
        cv = M.cross_validated_regression(balanced)
        cells = [{p.name: v for p, v in cell.items()} for cell in cv.getEstimatorParamMaps()]
        best = max(range(len(cells)), key=lambda i: (cv.avgMetrics[i], -i))
        recall = M.evaluate(cv.bestModel, test).first()["min_recall"]
        return _rows(spark, [(c["family"], float(c["elasticNetParam"]), float(c["regParam"]), float(m), recall if i == best else None)
                             for i, (c, m) in enumerate(zip(cells, cv.avgMetrics, strict=True))],
                     "family string, elastic_net double, reg double, auc double, best_min_recall double")


@query("class_downsample")
def q_class_downsample(spark, root):
    with _prepared(spark, root) as (train, test, balanced):
        return balanced.groupBy("label").count()


@query("rf_predictions")
def q_rf_predictions(spark, root):
    with _prepared(spark, root) as (train, test, balanced):
        p = M.RF_PARAMS
        model = M.random_forest(balanced, p["numTrees"], p["maxDepth"], p["minInstancesPerNode"])
        return model.transform(test).select(*X.TRAINING_FEATURES, F.col("label").cast("int").alias("target"),
                                            F.col("prediction").cast("int").alias("prediction"))


@query("normalized_cube")
def q_normalized_cube(spark, root):
    bits, start, n_weeks = _weekly(spark, root)
    return T.normalized_cube(T.change_cube(bits, start, n_weeks))


@query("amplitude_curve")
def q_amplitude_curve(spark, root):
    d = D.feature_diff(_snap(spark, root), SNAP_FEATURES, day="day_no", page_hash=None)
    changed = d.filter((F.col("insert") != 0) | (F.col("delete") != 0))
    total = (F.col("equal") + F.col("insert") + F.col("delete")).cast("double")
    shares = changed.select(F.concat(F.col("feature"), F.lit("/insert")).alias("series"), "page_id", "day1",
                            (F.col("insert") / total).alias("share")).unionByName(
        changed.select(F.concat(F.col("feature"), F.lit("/delete")).alias("series"), "page_id", "day1",
                       (F.col("delete") / total).alias("share")))
    return T.percentile_curve(shares.select("series", "share"), "series", "share")


@query("page_feature_numbers")
def q_page_feature_numbers(spark, root):
    return P.feature_numbers(P.page_feature_lists(Tables(spark, root).pages))


@query("global_start_duplicates")
def q_global_start_duplicates(spark, root):
    """Cross-thread mode: the previous page is the previous one of the whole
    crawl in (thread, URL index) order, across thread borders."""
    return _against_previous(spark, root, _starts(), (), ("thread", "url_index"), ("doc_id", "thread", "url_index"))


@query("rf_top_features")
def q_rf_top_features(spark, root):
    with _prepared(spark, root) as (train, test, balanced):
        rows = M.top_feature_models(balanced, test, X.TRAINING_FEATURES)
        return _rows(spark, rows, "features int, used string, min_recall double")


@query("rf_error_heatmap")
def q_rf_error_heatmap(spark, root):
    """Accuracy per feature decile of forest predictions on the hold-out pages."""
    with _prepared(spark, root) as (train, test, balanced):
        p = M.RF_PARAMS
        model = M.random_forest(balanced, p["numTrees"], p["maxDepth"], p["minInstancesPerNode"])
        preds = model.transform(test).select(*X.TRAINING_FEATURES, F.col("label").cast("int").alias("label"),
                                             F.col("prediction").cast("int").alias("prediction"))
        intervals = ST.interval_edges(ST.unpivot(_training(spark, root), X.TRAINING_FEATURES), 10)
        return ST.error_heatmap(preds, X.TRAINING_FEATURES, intervals)


@query("streamed_pair_bits")
def q_streamed_pair_bits(spark, root):
    """Change bits from the stateful stream: the two snapshot days arrive one
    after the other as parquet files (day 0 = 2021-06-12); the stream keeps
    per-page digests as state and emits a row when the next day lands."""
    import uuid

    from pagetide.session import ensure_checkpoint_dir
    from pagetide.streaming.change_stream import change_bits_stream, read_bits
    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streamed-{uuid.uuid4().hex[:12]}"
    snap = _snap(spark, root).select(
        F.col("page_id").cast("string").alias("page_id"),
        F.date_add(F.lit("2021-06-12").cast("date"), F.col("day_no")).alias("day"), *SNAP_FEATURES)
    for day_no in (0, 1):
        (snap.filter(F.col("day") == F.date_add(F.lit("2021-06-12").cast("date"), F.lit(day_no)))
             .write.mode("append").partitionBy("day").parquet(f"{run}/features"))
        change_bits_stream(spark, f"{run}/features", snap.schema, SNAP_FEATURES, f"{run}/bits",
                           name=run.rsplit("/", 1)[-1]).awaitTermination()
    return read_bits(spark, f"{run}/bits")


@query("rf_grids")
def q_rf_grids(spark, root):
    """Prediction grids for every ordered feature pair: one forest per unordered
    pair (features in sorted order); the reversed pair reports swapped axes,
    ordered by (y, x).  Axes run from each feature's minimum to maximum."""
    with _prepared(spark, root) as (train, test, balanced):
        feats = X.TRAINING_FEATURES
        bounds = _training(spark, root).agg(*[F.min(f).alias(f"{f}_lo") for f in feats],
                                            *[F.max(f).alias(f"{f}_hi") for f in feats]).first()
        grids = None
        for (a, b), model, _conf in M.pair_models(balanced, test, feats):
            fa, fb = feats[a], feats[b]
            st = spark.range(1).select(F.lit(bounds[f"{fa}_lo"]).alias("xl"), F.lit(bounds[f"{fa}_hi"]).alias("xh"),
                                       F.lit(bounds[f"{fb}_lo"]).alias("yl"), F.lit(bounds[f"{fb}_hi"]).alias("yh"))
            grid = ST.feature_grid(st, "xl", "xh", "yl", "yh", 100)
            for swapped, (nx, ny) in ((False, (fa, fb)), (True, (fb, fa))):
                g = M.prediction_grid(model, grid, swapped=swapped).select(
                    F.lit(nx).alias("feature_x"), F.lit(ny).alias("feature_y"), "x", "y", "probability",
                    F.lit(swapped).alias("_swapped"))
                grids = g if grids is None else grids.unionByName(g)
        # One sort after the union, which keeps no order of its own.
        major, minor = (F.when(F.col("_swapped"), F.col(a)).otherwise(F.col(b)) for a, b in (("y", "x"), ("x", "y")))
        return grids.orderBy("feature_x", "feature_y", major, minor).drop("_swapped")

