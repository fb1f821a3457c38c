"""DuckDB oracle SQL for the named queries (same semantics, independent engine)."""

from __future__ import annotations

from pagetide.functions import html as H
from pagetide.plans import sqlfrag as S
from pagetide.sources import proxies as X

ORACLE: dict[str, str] = {}


def _links_cte(src: str = "pages") -> str:
    cur = S.strip_protocol("url")
    return f"""
    l0 AS (SELECT page_id, url, {cur} AS cur, {S.hrefs('html')} AS hrefs FROM {src}),
    l1 AS (SELECT page_id, url, cur, {S.root_domain('cur')} AS root, {S.sl_domain('cur')} AS psld,
                  list_filter(hrefs, lambda h: starts_with(h, 'mailto:')) AS email,
                  list_filter(hrefs, lambda h: NOT starts_with(h, 'mailto:')) AS others FROM l0),
    l2 AS (SELECT page_id, url, psld, email,
                  list_transform(others, lambda h: {S.href_to_url('h', 'root', 'cur')}) AS resolved FROM l1),
    links AS (SELECT page_id, url, email,
                  list_filter(resolved, lambda u: {S.sl_domain('u')} = psld) AS internal,
                  list_filter(resolved, lambda u: {S.sl_domain('u')} <> psld) AS external FROM l2)"""


ORACLE["page_linkage"] = f"""
WITH {_links_cte()}
SELECT page_id, CAST(len(internal) AS INTEGER) AS internal_outlinks,
       CAST(len(external) AS INTEGER) AS external_outlinks, CAST(len(email) AS INTEGER) AS email_links,
       md5(array_to_string(internal, chr(10))) AS internal_md5,
       md5(array_to_string(external, chr(10))) AS external_md5
FROM links"""


def _sld_sql(x):
    return S.sl_domain(x)


ORACLE["page_url_features"] = f"""
WITH u AS (SELECT page_id, url, {S.sl_domain('url')} AS sld FROM pages)
SELECT page_id, CAST(length(url) AS INTEGER) AS url_length, CAST(length(sld) AS INTEGER) AS domain_name_length,
       CAST(length({S.rx_replace('sld', r'[^\p{Nd}]')}) AS INTEGER) AS domain_name_digits,
       CAST(length({S.rx_replace('sld', r'[\p{L}\p{Nd}]')}) AS INTEGER) AS domain_name_special_chars,
       CAST(len(string_split({S.strip_protocol('url')}, '/')) - 1 AS INTEGER) AS url_subdir_depth,
       CAST(greatest(len(string_split({S.root_domain('url')}, '.')) - 2, 0) AS INTEGER) AS url_subdomain_depth,
       CASE WHEN lower(split_part(url, '://', 1)) = 'https' THEN 1 ELSE 0 END AS protocol
FROM u"""


def _html_lists_cte(src: str = "pages") -> str:
    return f"""
    h0 AS (SELECT page_id, {S.without_comments('html')} AS nc FROM {src}),
    h1 AS (SELECT page_id, nc, {S.rx_replace('nc', H.SCRIPT_STYLE_BODY_RE, r'\1\2\3\4')} AS clean FROM h0),
    hl AS (SELECT page_id,
                  {S.extract_all('clean', H.VOID_ELEMENT_RE['images'])} AS images,
                  {S.extract_all('nc', H.SCRIPT_ELEMENT_RE)} AS scripts,
                  {S.extract_all('clean', H.TABLE_OPEN_RE)} AS tables,
                  {S.extract_all('clean', H.VOID_ELEMENT_RE['metas'])} AS meta,
                  {S.tag_names('clean')} AS html_tags FROM h1)"""


ORACLE["page_html_features"] = f"""
WITH {_html_lists_cte()}
SELECT page_id, CAST(len(images) AS INTEGER) AS images, CAST(len(scripts) AS INTEGER) AS scripts,
       CAST(len(tables) AS INTEGER) AS tables, CAST(len(meta) AS INTEGER) AS meta,
       CAST(len(html_tags) AS INTEGER) AS tags_total, CAST(len(list_distinct(html_tags)) AS INTEGER) AS tags_unique
FROM hl"""

ORACLE["page_text_features"] = f"""
WITH t0 AS (SELECT page_id, {S.text_lines('html')} AS text FROM pages),
     t1 AS (SELECT page_id, text, {S.words('text')} AS w FROM t0)
SELECT page_id, CAST(len(text) AS INTEGER) AS text_lines, CAST(len(w) AS INTEGER) AS words_total,
       CAST(len(list_distinct(list_transform(w, lambda x: lower(x)))) AS INTEGER) AS words_unique,
       md5({S.one_line('text')}) AS text_md5
FROM t1"""


# ---------------------------------------------------------------- change timeline

CHANGE_BITS = """
    cb AS (SELECT concat('s', lpad(CAST(user_id % 3 AS VARCHAR), 2, '0'), '-', CAST(user_id AS VARCHAR)) AS page_id,
                  CAST(ts AS DATE) AS day2,
                  max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS text_changed,
                  max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS ilinks_changed,
                  max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS elinks_changed
           FROM events GROUP BY user_id, CAST(ts AS DATE))"""

FEATURES3 = "(VALUES ('text'), ('internal_outlinks'), ('external_outlinks')) f(feature)"


def _weekly_cte(first_stage: bool = False) -> str:
    src = "(SELECT * FROM cb WHERE split_part(page_id, '-', 1) = 's00')" if first_stage else "cb"
    return f"""{CHANGE_BITS},
    cbs AS (SELECT * FROM {src}),
    lb AS (SELECT 'text' AS feature, page_id, day2, text_changed AS bit FROM cbs
           UNION ALL SELECT 'internal_outlinks', page_id, day2, ilinks_changed FROM cbs
           UNION ALL SELECT 'external_outlinks', page_id, day2, elinks_changed FROM cbs),
    span AS (SELECT min(day2) AS lo, max(day2) AS hi FROM cbs),
    st AS (SELECT lo + CAST((8 - isodow(lo)) % 7 AS INTEGER) AS start,
                  hi - CAST(isodow(hi) % 7 AS INTEGER) AS fin FROM span),
    weeks AS (SELECT CAST(i AS INTEGER) AS week_no,
                     CAST(weekofyear((SELECT start FROM st) + CAST(7 * i AS INTEGER)) AS INTEGER) AS week
              FROM (SELECT unnest(range(0, greatest((SELECT (fin - start + 1) // 7 FROM st), 0))) AS i)),
    wsum AS (SELECT feature, page_id, CAST(floor((day2 - (SELECT start FROM st)) / 7) AS INTEGER) AS week_no,
                    sum(bit) AS n FROM lb GROUP BY ALL),
    wk AS (SELECT f.feature, p.page_id, w.week_no, w.week, CAST(coalesce(s.n, 0) AS INTEGER) AS n
           FROM (SELECT DISTINCT page_id FROM cbs) p CROSS JOIN {FEATURES3} CROSS JOIN weeks w
           LEFT JOIN wsum s ON s.feature = f.feature AND s.page_id = p.page_id AND s.week_no = w.week_no),
    cnt AS (SELECT feature, week_no, n, count(*) AS pages FROM wk GROUP BY ALL),
    ns AS (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS n),
    mgrid AS (SELECT f.feature, w.week_no, ns.n FROM {FEATURES3} CROSS JOIN weeks w CROSS JOIN ns),
    matrix0 AS (SELECT coalesce(g.feature, c.feature) AS feature, coalesce(g.week_no, c.week_no) AS week_no,
                       coalesce(g.n, c.n) AS n, coalesce(c.pages, 0) AS pages
                FROM mgrid g FULL JOIN cnt c ON g.feature = c.feature AND g.week_no = c.week_no AND g.n = c.n),
    matrix AS (SELECT m.feature, m.week_no, w.week, m.n, m.pages FROM matrix0 m JOIN weeks w ON w.week_no = m.week_no),
    tr AS (SELECT a.feature, b.week_no, a.n AS prev_n, b.n AS cur_n, count(*) AS pages FROM wk a JOIN wk b
           ON a.feature = b.feature AND a.page_id = b.page_id AND b.week_no = a.week_no + 1 GROUP BY ALL),
    cgrid AS (SELECT f.feature, w.week_no, p.n AS prev_n, c.n AS cur_n
              FROM {FEATURES3} CROSS JOIN (SELECT week_no FROM weeks WHERE week_no > 0) w
              CROSS JOIN ns p CROSS JOIN ns c),
    cube0 AS (SELECT coalesce(g.feature, t.feature) AS feature, coalesce(g.week_no, t.week_no) AS week_no,
                     coalesce(g.prev_n, t.prev_n) AS prev_n, coalesce(g.cur_n, t.cur_n) AS cur_n,
                     coalesce(t.pages, 0) AS pages
              FROM cgrid g FULL JOIN tr t ON g.feature = t.feature AND g.week_no = t.week_no
                   AND g.prev_n = t.prev_n AND g.cur_n = t.cur_n),
    cube AS (SELECT c.feature, c.week_no, w.week, c.prev_n, c.cur_n, c.pages FROM cube0 c JOIN weeks w
             ON w.week_no = c.week_no)"""


def _ratio(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) = 0 THEN NULL ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END)"


def _cls(c: str) -> str:
    return f"(CASE WHEN {c} = 0 THEN 0 WHEN {c} = 7 THEN 2 ELSE 1 END)"


ORACLE["weekly_changes"] = f"WITH {_weekly_cte()} SELECT feature, page_id, week_no, week, n FROM wk"
ORACLE["change_matrix"] = f"WITH {_weekly_cte()} SELECT feature, week_no, week, n, pages FROM matrix"
ORACLE["normalized_matrix"] = f"""WITH {_weekly_cte()}
SELECT feature, week_no, week, n, pages, {_ratio('pages', 'sum(pages) OVER (PARTITION BY feature, week_no)')} AS fraction
FROM matrix"""
ORACLE["change_cube"] = f"WITH {_weekly_cte()} SELECT feature, week_no, week, prev_n, cur_n, pages FROM cube"
ORACLE["alluvial_edges"] = f"""WITH {_weekly_cte()}
SELECT feature, CAST((week_no - 1) * 8 + prev_n AS INTEGER) AS source,
       CAST(week_no * 8 + cur_n AS INTEGER) AS target, pages AS value FROM cube"""
ORACLE["avg_behaviour"] = f"""WITH {_weekly_cte()},
    pn AS (SELECT feature, n, sum(pages) AS s FROM matrix GROUP BY ALL)
SELECT feature, n, {_ratio('s', 'sum(s) OVER (PARTITION BY feature)')} AS fraction FROM pn"""
ORACLE["persistence"] = f"""WITH {_weekly_cte()}
SELECT feature, week_no, week, prev_n,
       {_ratio('sum(CASE WHEN prev_n = cur_n THEN pages ELSE 0 END)', 'sum(pages)')} AS fraction
FROM cube GROUP BY feature, week_no, week, prev_n"""
ORACLE["persistence3"] = f"""WITH {_weekly_cte()}
SELECT feature, week_no, week, {_cls('prev_n')} AS prev_class,
       {_ratio(f"sum(CASE WHEN {_cls('prev_n')} = {_cls('cur_n')} THEN pages ELSE 0 END)", 'sum(pages)')} AS fraction
FROM cube GROUP BY feature, week_no, week, {_cls('prev_n')}"""
ORACLE["persistence_all"] = f"""WITH {_weekly_cte()}
SELECT feature, week_no, week,
       {_ratio('sum(CASE WHEN prev_n = cur_n THEN pages ELSE 0 END)', 'sum(pages)')} AS same8,
       {_ratio(f"sum(CASE WHEN {_cls('prev_n')} = {_cls('cur_n')} THEN pages ELSE 0 END)", 'sum(pages)')} AS same3
FROM cube GROUP BY feature, week_no, week"""
ORACLE["neighbour_moves"] = f"""WITH {_weekly_cte()}
SELECT feature, week_no, week, prev_n,
       {_ratio('sum(CASE WHEN abs(prev_n - cur_n) = 1 THEN pages ELSE 0 END)', 'sum(pages)')} AS fraction
FROM cube GROUP BY feature, week_no, week, prev_n"""
ORACLE["neighbour_moves3"] = f"""WITH {_weekly_cte()}
SELECT feature, week_no, week, {_cls('prev_n')} AS prev_class,
       {_ratio(f"sum(CASE WHEN abs({_cls('prev_n')} - {_cls('cur_n')}) = 1 THEN pages ELSE 0 END)", 'sum(pages)')} AS fraction
FROM cube GROUP BY feature, week_no, week, {_cls('prev_n')}"""


def _daily_sql(first_stage: bool = False, limit_weekday: int | None = None) -> str:
    src = "(SELECT * FROM cb WHERE split_part(page_id, '-', 1) = 's00')" if first_stage else "cb"
    day_no = "CAST(day2 - (SELECT min(day2) FROM cbs) AS INTEGER)"
    where = ""
    if limit_weekday is not None:
        where = f"WHERE isodow(day2 - INTERVAL 1 DAY) - 1 = {limit_weekday}"
        day_no = f"CAST(floor({day_no} / 7) AS INTEGER)"
    return f"""WITH {CHANGE_BITS},
    cbs AS (SELECT * FROM {src}),
    d AS (SELECT {day_no} AS day_no, sum(text_changed) AS t, sum(ilinks_changed) AS i, sum(elinks_changed) AS e
          FROM cbs {where} GROUP BY day2),
    long AS (SELECT 'text' AS feature, day_no, t AS changed FROM d UNION ALL SELECT 'internal_outlinks', day_no, i FROM d
             UNION ALL SELECT 'external_outlinks', day_no, e FROM d),
    agg AS (SELECT feature, day_no, sum(changed) AS changed FROM long GROUP BY ALL),
    grid AS (SELECT f.feature, CAST(unnest(range(0, (SELECT max(day_no) FROM d) + 1)) AS INTEGER) AS day_no FROM {FEATURES3}),
    np AS (SELECT count(DISTINCT page_id) AS n FROM cbs)
SELECT g.feature, g.day_no, CAST(coalesce(a.changed, 0) AS BIGINT) AS changed,
       {_ratio('coalesce(a.changed, 0)', '(SELECT n FROM np)')} AS fraction
FROM grid g LEFT JOIN agg a ON a.feature = g.feature AND a.day_no = g.day_no"""


ORACLE["daily_changes"] = _daily_sql()
ORACLE["weekday_changes"] = _daily_sql(limit_weekday=1)
ORACLE["first_stage_daily"] = _daily_sql(first_stage=True)
ORACLE["changes_per_page"] = f"""WITH {CHANGE_BITS}
SELECT page_id, count(*) AS changes FROM cb WHERE text_changed = 1 GROUP BY page_id"""
ORACLE["rare_changes"] = f"""WITH {CHANGE_BITS},
    np AS (SELECT count(DISTINCT day2) AS n FROM cb),
    per AS (SELECT page_id, count(*) AS c FROM cb WHERE text_changed = 1 GROUP BY page_id),
    rare AS (SELECT page_id FROM per WHERE c < (SELECT n FROM np) * 0.5)
SELECT day2, count(*) AS rare_changes FROM cb WHERE text_changed = 1 AND page_id IN (SELECT page_id FROM rare)
GROUP BY day2"""
ORACLE["day_change_curve"] = f"""WITH {CHANGE_BITS},
    np AS (SELECT count(DISTINCT day2) AS n FROM cb),
    per AS (SELECT page_id, count(*) AS c FROM cb WHERE text_changed = 1 GROUP BY page_id),
    r AS (SELECT row_number() OVER (ORDER BY c DESC, page_id) AS position, c, count(*) OVER () AS total FROM per)
SELECT position, CASE WHEN total > 1 THEN (position - 1) * 100.0 / (total - 1) ELSE 0.0 END AS percentile,
       c / CAST((SELECT n FROM np) AS DOUBLE) AS fraction FROM r"""


# ---------------------------------------------------------------- order statistics, training data

TRAINING = """
    tr AS (SELECT CAST(d.doc_id AS VARCHAR) AS page_id, CAST(d.n_chars AS INTEGER) AS f_chars,
                  CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS INTEGER) AS f_lines,
                  CAST(length(d.text) - length(replace(d.text, ' ', '')) AS INTEGER) AS f_spaces,
                  CAST(length(d.text) - length(replace(d.text, '.', '')) AS INTEGER) AS f_dots,
                  CAST(length(d.text) - length(replace(d.text, ',', '')) AS INTEGER) AS f_commas, l.quality AS label
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
COUNTS = TRAINING.replace(", l.quality AS label", "").replace(" JOIN labels l ON d.doc_id = l.doc_id", "")
TRAINING_FEATURES = ["f_chars", "f_lines", "f_spaces", "f_dots", "f_commas"]


def _long(src: str, features: list[str], extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value{extra} FROM {src}" for f in features)


def _positions(long_cte: str) -> str:
    return f"""s AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS pos,
                  count(*) OVER (PARTITION BY feature) AS n FROM {long_cte} WHERE value IS NOT NULL)"""


def _value_stats_sql(base: str, long_sql: str, e: float) -> str:
    return f"""WITH {base},
    lg AS ({long_sql}),
    {_positions('lg')},
    t AS (SELECT *, CAST(floor(n * {e}) AS BIGINT) AS t FROM s),
    a AS (SELECT feature, max(n) AS n,
                 max(CASE WHEN pos = t THEN value END) AS mn, max(CASE WHEN pos = n - 1 - t THEN value END) AS mx,
                 sum(CASE WHEN pos BETWEEN t AND n - 1 - t THEN value END) AS sm,
                 count(CASE WHEN pos BETWEEN t AND n - 1 - t THEN 1 END) AS ct,
                 max(CASE WHEN pos = n // 2 - 1 THEN value END) AS m1, max(CASE WHEN pos = n // 2 THEN value END) AS m2
          FROM t GROUP BY feature)
SELECT feature, mn AS "min", mx AS "max", {_ratio('sm', 'ct')} AS "avg",
       CASE WHEN n % 2 = 0 THEN CAST(trunc((m1 + m2) / 2.0) AS BIGINT) ELSE CAST(m2 AS BIGINT) END AS med FROM a"""


def _edges_cte(k: int = 10) -> str:
    return f"""{_positions('lg')},
    edges AS (SELECT s.feature, i.i, s.value FROM s JOIN (SELECT unnest(range(0, {k + 1})) AS i) i
              ON s.pos = floor(CAST(s.n - 1 AS DOUBLE) / CAST({k} AS DOUBLE) * i.i)),
    iv AS (SELECT a.feature, CAST(a.i AS INTEGER) AS interval, a.value AS start,
                  b.value + CASE WHEN b.i = {k} THEN 1 ELSE 0 END AS "end"
           FROM edges a JOIN edges b ON a.feature = b.feature AND b.i = a.i + 1)"""


PRED = "pred AS (SELECT *, CASE WHEN f_dots > f_lines THEN 1 ELSE 0 END AS prediction FROM tr)"

ORACLE["feature_percentiles"] = f"""WITH {COUNTS},
    lg AS ({_long('tr', TRAINING_FEATURES)}),
    {_positions('lg')}
SELECT s.feature, p.percentile, s.value FROM s
JOIN (VALUES (0), (20), (40), (60), (80), (100)) p(percentile) ON s.pos = floor((s.n - 1) * p.percentile / 100)"""
ORACLE["value_statistics"] = _value_stats_sql(COUNTS, _long("tr", TRAINING_FEATURES), 0.025)
ORACLE["quantity_statistics"] = _value_stats_sql(
    "li AS (SELECT CAST(l_quantity AS INTEGER) AS quantity, l_linenumber AS linenumber FROM lineitem)",
    _long("li", ["quantity", "linenumber"]), 0.025)
ORACLE["interval_edges"] = f"""WITH {COUNTS},
    lg AS ({_long('tr', TRAINING_FEATURES)}),
    {_edges_cte(10)}
SELECT feature, interval, start, "end" FROM iv"""
ORACLE["error_heatmap"] = f"""WITH {TRAINING}, {PRED},
    lg AS ({_long('tr', TRAINING_FEATURES)}),
    {_edges_cte(10)},
    pl AS ({_long('pred', TRAINING_FEATURES, ', CAST(label = prediction AS INTEGER) AS ok')}),
    hits AS (SELECT iv.feature, iv.interval, sum(pl.ok) AS c, count(*) AS t FROM iv JOIN pl
             ON pl.feature = iv.feature AND iv.start <= pl.value AND pl.value < greatest(iv.start + 1, iv."end")
             GROUP BY ALL)
SELECT iv.feature, iv.interval, round({_ratio('h.c', 'h.t')}, 4) AS accuracy
FROM iv LEFT JOIN hits h ON h.feature = iv.feature AND h.interval = iv.interval"""
ORACLE["min_recall"] = f"""WITH {TRAINING}, {PRED},
    m AS (SELECT CAST(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
                 CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
                 CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
                 CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM pred)
SELECT tn, fp, fn, tp, {_ratio('tn', 'tn + fp')} AS recall_zero, {_ratio('tp', 'fn + tp')} AS recall_one,
       least({_ratio('tn', 'tn + fp')}, {_ratio('tp', 'fn + tp')}) AS min_recall FROM m"""
ORACLE["accuracy"] = f"""WITH {TRAINING}, {PRED}
SELECT avg(CAST(label = prediction AS DOUBLE)) AS accuracy, count(*) AS "rows" FROM pred"""


def _md5_mod5(x: str) -> str:
    parts = " + ".join(f"CAST(('0x' || substr(md5({x}), {1 + 8 * i}, 8)) AS BIGINT)" for i in range(4))
    return f"(({parts}) % 5)"


ORACLE["hash_split"] = f"""WITH {TRAINING}
SELECT page_id, label, {_md5_mod5('page_id')} = 4 AS validation FROM tr"""
ORACLE["class_weights"] = f"""WITH {TRAINING},
    c AS (SELECT sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS n1 FROM tr)
SELECT page_id, label, CASE WHEN label = 0 THEN (SELECT CAST(n1 AS DOUBLE) / n0 FROM c) ELSE 1.0 END AS weight FROM tr"""
ORACLE["balanced_sample"] = f"""WITH {TRAINING},
    k AS (SELECT least(50, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END), sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)) AS k FROM tr),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY md5('42' || page_id), page_id) AS INTEGER) AS pair_no FROM tr)
SELECT * FROM r WHERE pair_no <= (SELECT k FROM k)"""


ORACLE["class_downsample"] = f"""WITH {TRAINING},
    c AS (SELECT CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n0, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS n1 FROM tr),
    t AS (SELECT label, CAST(('0x' || substr(md5('42:' || page_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM tr WHERE {_md5_mod5('page_id')} <> 4)
SELECT CAST(label AS DOUBLE) AS label, count(*) AS count FROM t, c
WHERE u < CASE WHEN label = 0 THEN least(1.0, n1 / n0) ELSE least(1.0, n0 / n1) END GROUP BY label"""


def _axis(lo: str, hi: str, num: int = 100) -> str:
    step = f"(CAST({hi} - {lo} AS DOUBLE) / CAST({num - 1} AS DOUBLE))"
    return (f"SELECT DISTINCT CAST(trunc(CASE WHEN i = {num - 1} THEN CAST({hi} AS DOUBLE) "
            f"ELSE i * {step} + {lo} END) AS BIGINT) AS v FROM st, (SELECT unnest(range(0, {num})) AS i)")


ORACLE["feature_grid"] = f"""WITH {COUNTS},
    st AS (SELECT min(f_lines) AS xl, max(f_lines) AS xh, min(f_commas) AS yl, max(f_commas) AS yh FROM tr),
    xs AS ({_axis('xl', 'xh')}), ys AS ({_axis('yl', 'yh')})
SELECT xs.v AS x, ys.v AS y FROM xs, ys"""


# ---------------------------------------------------------------- crawl clean-up

CRAWL_ORDER = """
    co AS (SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS log_index,
                  row_number() OVER (PARTITION BY CAST(substr(source, 4) AS INTEGER) % 4 ORDER BY text, doc_id) AS url_index,
                  CAST(substr(source, 4) AS INTEGER) % 4 AS thread, string_split(text, chr(10)) AS text_lines
           FROM documents),
    cp AS (SELECT *, lag(text_lines) OVER (PARTITION BY thread ORDER BY url_index) AS prev FROM co)"""

ORACLE["crawl_ordered"] = f"""WITH {CRAWL_ORDER}
SELECT doc_id, log_index, url_index, thread,
       CAST(log_index AS BIGINT) * 1000000000 + 0 * 1000000 + url_index AS order_index FROM co"""
ORACLE["sampled_pages"] = f"""WITH {CRAWL_ORDER}
SELECT doc_id, log_index, url_index FROM co WHERE url_index % 100 = 42"""
ORACLE["start_duplicates"] = f"""WITH {CRAWL_ORDER},
    f AS (SELECT *, prev IS NOT NULL AS has_prev, coalesce(prev[1:3] = text_lines[1:3], false) AS same_start FROM cp)
SELECT doc_id, log_index, url_index, has_prev, same_start,
       (NOT has_prev) OR (len(text_lines) > 0 AND NOT same_start) AS cheap_valid FROM f"""
ORACLE["hash_duplicates"] = f"""WITH {CRAWL_ORDER}
SELECT doc_id, log_index, url_index, prev IS NULL OR prev <> text_lines AS valid FROM cp"""
ORACLE["log_blob_join"] = """
SELECT CAST(d.doc_id AS VARCHAR) AS page_key, CAST(octet_length(encode(d.text)) AS INTEGER) AS size, md5(d.text) AS page_md5
FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1 AND l.toxic = 0"""
ORACLE["threat_urls"] = """WITH r AS (SELECT event_id, date_trunc('second', ts) AS ts, event_type = 'error' AS threat FROM events)
SELECT event_id, ts FROM r WHERE NOT threat
  AND EXISTS (SELECT 1 FROM r t WHERE t.threat AND r.ts BETWEEN t.ts AND t.ts + INTERVAL 10 SECOND)"""


# ---------------------------------------------------------------- crawl days of pages, end to end

def _series_cte() -> str:
    html = "html"
    for find, new in X.SERIES_BASE:
        html = f"replace({html}, {S.q(find)}, {S.q(new)})"
    steps = [f"e0 AS (SELECT page_id AS p, url, {html} AS html, d FROM pages, (SELECT unnest(range(0, {len(X.SERIES_DAYS)})) AS d))"]
    for i, (lo, hi, modulus, rest, find, new) in enumerate(X.SERIES_EDITS):
        steps.append(f"e{i + 1} AS (SELECT p, url, d, CASE WHEN d BETWEEN {lo} AND {hi} AND p % {modulus} = {rest} "
                     f"THEN replace(html, {S.q(find)}, {S.q(new)}) ELSE html END AS html FROM e{i})")
    for i, (at, modulus, rests, source) in enumerate(X.SERIES_REPLACED, len(X.SERIES_EDITS)):
        steps.append(f"e{i + 1} AS (SELECT p, url, d, CASE WHEN d = {at} AND p % {modulus} IN {rests} THEN {S.q(source)} ELSE html END AS html FROM e{i})")
    days = ", ".join(f"DATE '{x}'" for x in X.SERIES_DAYS)
    (fd, fm, fr), (ad, am, ar) = X.SERIES_FAILED, X.SERIES_ABSENT
    steps.append(f"""sr AS (SELECT 'links_s00-' || p || '@' || d AS page_id, 'links_s00-' || p AS page_key, ([{days}])[d + 1] AS day, d, CAST(p AS INTEGER) AS url_index,
        CAST(p // {X.SERIES_THREAD} AS INTEGER) AS log_index, NOT (d = {fd} AND p % {fm} = {fr}) AND NOT (d = {ad} AND p % {am} = {ar}) AS ok,
        url, html FROM e{len(X.SERIES_EDITS) + len(X.SERIES_REPLACED)})""")
    return ",\n    ".join(steps)


def _tables_cte(src: str) -> str:
    """Table elements: the end of an element is the first later tag with a smaller depth."""
    tag = S.q(H.TABLE_TAG_RE)
    return f"""
    g0 AS (SELECT page_id, {S.blank_script_bodies('html')} AS clean FROM {src}),
    g1 AS (SELECT page_id, regexp_extract_all(clean, {tag}) AS tags, regexp_split_to_array(clean, {tag}) AS texts FROM g0),
    g2 AS (SELECT page_id, tags, texts, unnest(range(1, len(tags) + 1)) AS i FROM g1),
    g3 AS (SELECT *, starts_with(tags[i], '</') AS c, sum(CASE WHEN starts_with(tags[i], '</') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM g2),
    g4 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS depth FROM g3),
    g5 AS (SELECT o.page_id, o.i, any_value(o.tags) AS tags, any_value(o.texts) AS texts, min(e.i) AS j FROM g4 o
           LEFT JOIN g4 e ON e.page_id = o.page_id AND e.i > o.i AND e.depth < o.depth WHERE NOT o.c GROUP BY o.page_id, o.i),
    tb AS (SELECT page_id, list(array_to_string(list_transform(range(i, coalesce(j, len(tags) + 1)), lambda k: tags[k] || texts[k + 1]), '')
                  || coalesce(tags[j], '') ORDER BY i) AS tables FROM g5 GROUP BY page_id)"""


_ELEMENTS = {"images": "hl.images", "scripts": "hl.scripts", "tables": "coalesce(tb.tables, [])", "meta": "hl.meta", "html_tags": "hl.html_tags"}
ORACLE["page_element_lists"] = f"""WITH {_series_cte()},
    {_html_lists_cte('sr')},
    {_tables_cte('sr')}
SELECT sr.day, sr.page_key, {', '.join(f"CAST(len({x}) AS INTEGER) AS {k}" for k, x in _ELEMENTS.items())},
       {', '.join(f"md5(array_to_string({x}, chr(10))) AS {k}_md5" for k, x in _ELEMENTS.items())}
FROM sr JOIN hl ON hl.page_id = sr.page_id LEFT JOIN tb ON tb.page_id = sr.page_id"""

_CLEAN = f"""{_series_cte()},
    t0 AS (SELECT *, {S.text_lines('html')} AS text FROM sr WHERE ok),
    t1 AS (SELECT *, lag(text) OVER (PARTITION BY day, log_index ORDER BY url_index) AS prev FROM t0),
    cl AS (SELECT * FROM t1 WHERE prev IS NULL OR (len(text) > 0 AND NOT coalesce(prev[1:3] = text[1:3], false)))"""
ORACLE["clean_pages"] = f"""WITH {_CLEAN}
SELECT day, page_key, log_index, url_index, CAST(len(text) AS INTEGER) AS lines, md5(html) AS page_md5 FROM cl"""

_NINE = f"""{_CLEAN},
    vp AS (SELECT * FROM cl WHERE octet_length(encode(html)) <= {10 * 1048576} AND {S.has_html_element('html')}),
    {_links_cte('vp')},
    {_html_lists_cte('vp')},
    {_tables_cte('vp')},
    nine AS (SELECT vp.page_key, vp.day, vp.d, links.email AS email_links, links.external AS external_outlinks, hl.images, links.internal AS internal_outlinks,
                    hl.meta, vp.text, hl.scripts, coalesce(tb.tables, []) AS tables, hl.html_tags
             FROM vp JOIN links ON links.page_id = vp.page_id JOIN hl ON hl.page_id = vp.page_id LEFT JOIN tb ON tb.page_id = vp.page_id)"""
FEATURES9 = ["email_links", "external_outlinks", "images", "internal_outlinks", "meta", "text", "scripts", "tables", "html_tags"]
ORACLE["page_change_bits"] = f"""WITH {_NINE}
SELECT a.page_key AS page_id, a.day AS day1, b.day AS day2, {', '.join(f"CAST(a.{f} <> b.{f} AS INTEGER) AS {f}_changed" for f in FEATURES9)}
FROM nine a JOIN nine b ON a.page_key = b.page_key AND b.d = a.d + 1"""
ORACLE["page_training_pairs"] = f"""WITH {_NINE}
SELECT a.page_key, a.day AS day1, {', '.join(f"CAST(len(a.{f}) AS INTEGER) AS {f}" for f in FEATURES9)},
       {', '.join(f"CAST(a.{f} <> b.{f} AS INTEGER) AS {f}_changed" for f in ("text", "internal_outlinks", "external_outlinks"))}
FROM nine a JOIN nine b ON a.page_key = b.page_key AND b.d = a.d + 1"""
ORACLE["page_hash_duplicates"] = f"""WITH {_series_cte()},
    ok AS (SELECT * FROM sr WHERE ok),
    {_html_lists_cte('ok')},
    t0 AS (SELECT ok.day, ok.page_key, ok.log_index, ok.url_index, {S.text_lines('ok.html')} AS text,
                  {{'i': len(hl.images), 's': len(hl.scripts), 't': len(hl.tables), 'm': len(hl.meta), 'n': len(hl.html_tags), 'u': len(list_distinct(hl.html_tags))}} AS counts
           FROM ok JOIN hl ON hl.page_id = ok.page_id),
    t1 AS (SELECT *, lag(text) OVER w AS prev, lag(counts) OVER w AS prev_counts FROM t0 WINDOW w AS (PARTITION BY day, log_index ORDER BY url_index))
SELECT day, page_key, CASE WHEN len(text) = 0 THEN counts IS DISTINCT FROM prev_counts ELSE prev IS NULL OR prev <> text END AS valid FROM t1"""


# ---------------------------------------------------------------- day-over-day diff

SNAPSHOTS = """
    sn AS (SELECT doc_id AS page_id, 0 AS day_no, string_split(text, chr(10)) AS text, [source] AS internal_outlinks,
                  [lang] AS meta, md5(concat_ws(chr(1), text, source, lang)) AS page_hash FROM documents
           UNION ALL
           SELECT doc_id, 1, string_split(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat(text, chr(10), 'added line')
                                          WHEN 2 THEN concat('new head', chr(10), text)
                                          ELSE replace(text, ' the ', ' de ') END, chr(10)),
                  [CASE WHEN doc_id % 5 = 0 THEN source || '-moved' ELSE source END],
                  [CASE WHEN doc_id % 7 = 0 THEN lang || '-alt' ELSE lang END],
                  md5(concat_ws(chr(1), CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat(text, chr(10), 'added line')
                                          WHEN 2 THEN concat('new head', chr(10), text)
                                          ELSE replace(text, ' the ', ' de ') END,
                                CASE WHEN doc_id % 5 = 0 THEN source || '-moved' ELSE source END,
                                CASE WHEN doc_id % 7 = 0 THEN lang || '-alt' ELSE lang END))
           FROM documents),
    pr AS (SELECT a.page_id, a.day_no AS day1, b.day_no AS day2,
                  a.text AS text_1, b.text AS text_2, a.internal_outlinks AS internal_outlinks_1,
                  b.internal_outlinks AS internal_outlinks_2, a.meta AS meta_1, b.meta AS meta_2,
                  a.page_hash AS page_hash_1, b.page_hash AS page_hash_2
           FROM sn a JOIN sn b ON a.page_id = b.page_id AND b.day_no = a.day_no + 1)"""

ORACLE["day_pair_bits"] = f"""WITH {SNAPSHOTS}
SELECT page_id, day1, day2, CAST(text_1 <> text_2 AS INTEGER) AS text_changed,
       CAST(internal_outlinks_1 <> internal_outlinks_2 AS INTEGER) AS internal_outlinks_changed,
       CAST(meta_1 <> meta_2 AS INTEGER) AS meta_changed FROM pr"""
ORACLE["feature_numbers"] = f"""WITH {SNAPSHOTS}
SELECT page_id, day_no, CAST(len(text) AS INTEGER) AS text, CAST(len(internal_outlinks) AS INTEGER) AS internal_outlinks,
       CAST(len(meta) AS INTEGER) AS meta FROM sn"""
ORACLE["training_pairs"] = f"""WITH {SNAPSHOTS}
SELECT page_id, day1, CAST(len(text_1) AS INTEGER) AS text, CAST(len(internal_outlinks_1) AS INTEGER) AS internal_outlinks,
       CAST(len(meta_1) AS INTEGER) AS meta, CAST(text_1 <> text_2 AS INTEGER) AS text_changed,
       CAST(internal_outlinks_1 <> internal_outlinks_2 AS INTEGER) AS internal_outlinks_changed FROM pr"""
_GROWN = {f: f"CAST(len({f}_2) - len({f}_1) AS INTEGER)" for f in ("text", "internal_outlinks", "meta")}
ORACLE["combined_differences"] = f"""WITH {SNAPSHOTS}
SELECT page_id, day1, {', '.join(f"CASE WHEN {x} <> 0 THEN {x} END AS {f}" for f, x in _GROWN.items())},
       concat_ws(',', {', '.join(f"CASE WHEN {x} = 0 THEN '{f}' END" for f, x in _GROWN.items())}) AS missing, CAST(0 AS INTEGER) AS repeated FROM pr"""
ORACLE["change_fractions"] = f"""WITH {SNAPSHOTS}
SELECT 'text' AS feature, avg(CAST(text_1 <> text_2 AS DOUBLE)) AS fraction FROM pr
UNION ALL SELECT 'internal_outlinks', avg(CAST(internal_outlinks_1 <> internal_outlinks_2 AS DOUBLE)) FROM pr
UNION ALL SELECT 'meta', avg(CAST(meta_1 <> meta_2 AS DOUBLE)) FROM pr"""
ORACLE["informative_split"] = f"""WITH {SNAPSHOTS},
    fl AS (SELECT (text_1 <> text_2) OR (internal_outlinks_1 <> internal_outlinks_2) AS inf, meta_1 <> meta_2 AS un
           FROM pr WHERE page_hash_1 <> page_hash_2)
SELECT CAST(sum(CASE WHEN inf AND un THEN 1 ELSE 0 END) AS BIGINT) AS both,
       CAST(sum(CASE WHEN inf AND NOT un THEN 1 ELSE 0 END) AS BIGINT) AS only_informative,
       CAST(sum(CASE WHEN NOT inf AND un THEN 1 ELSE 0 END) AS BIGINT) AS only_uninformative,
       CAST(sum(CASE WHEN NOT inf AND NOT un THEN 1 ELSE 0 END) AS BIGINT) AS neither FROM fl"""


def _sorted_md5(x: str) -> str:
    return f"md5(array_to_string(list_sort({x}), chr(10)))"


EXCEPT_A = "list_distinct(list_filter(text_1, lambda x: NOT list_contains(text_2, x)))"
EXCEPT_B = "list_distinct(list_filter(text_2, lambda x: NOT list_contains(text_1, x)))"
ORACLE["changed_sample"] = f"""WITH {SNAPSHOTS},
    pk AS (SELECT * FROM pr WHERE text_1 <> text_2
           ORDER BY md5('42' || CAST(page_id AS VARCHAR) || CAST(day1 AS VARCHAR)), page_id LIMIT 10)
SELECT page_id, day1, day2, CAST(len({EXCEPT_A}) AS INTEGER) AS n_removed, CAST(len({EXCEPT_B}) AS INTEGER) AS n_added,
       {_sorted_md5(EXCEPT_A)} AS removed_md5, {_sorted_md5(EXCEPT_B)} AS added_md5 FROM pk"""

CATEGORIES = """
    cat AS (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS page,
                   string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS categories
            FROM events GROUP BY user_id, CAST(ts AS DATE))"""
ORACLE["change_categories"] = f"""WITH {CATEGORIES},
    ex AS (SELECT unnest(list_distinct(string_split(categories, ','))) AS category FROM cat)
SELECT category, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM cat) AS share FROM ex GROUP BY category"""
ORACLE["useful_changes"] = f"""WITH {CATEGORIES}
SELECT avg(CAST(list_has_any(string_split(categories, ','), ['purchase', 'signup']) AS DOUBLE)) AS useful_share,
       count(*) AS pages FROM cat"""


# ---------------------------------------------------------------- seed selection

def _dump_links_cte() -> str:
    from pagetide.operators.seeds import DUMP_LINK_RE
    line = "concat('* [', url, ' x] ref=', replace(url, '&', '&amp;'), ' end')"
    found = f"regexp_extract_all({S.unescape('line')}, {S.q(DUMP_LINK_RE)}, 1)"
    valid = ("list_filter(found, lambda u: len(string_split(u, '://')) >= 2 "
             "AND instr(split_part(u, '://', 2), '.') > 0)")
    cut = f"list_transform({valid}, lambda u: CASE WHEN ends_with(u, '/') THEN substr(u, 1, length(u) - 1) ELSE u END)"
    return f"""
    ls AS (SELECT page_id, list_concat([{line}], coalesce(string_split(html, chr(10)), [])) AS ls FROM pages),
    li AS (SELECT page_id, ls, unnest(range(len(ls))) AS line_no FROM ls),
    wl AS (SELECT page_id, line_no, {found} AS found FROM (SELECT page_id, line_no, ls[line_no + 1] AS line FROM li)),
    vl AS (SELECT page_id, line_no, {cut} AS links FROM wl),
    ix AS (SELECT page_id, line_no, links, unnest(range(len(links))) AS i FROM vl),
    dl AS (SELECT page_id, CAST(line_no AS INTEGER) AS line_no, CAST(i AS INTEGER) AS link_no, links[i + 1] AS link FROM ix)"""


def _host(x: str) -> str:
    return S.link_host(x)


POP = f"""
    pop AS (SELECT array_to_string(string_split({_host('link')}, '.')[-2:], '.') AS sld, link, count(*) AS n
            FROM dl WHERE len(string_split({_host('link')}, '.')) >= 2 GROUP BY ALL)"""

ORACLE["wiki_links"] = f"WITH {_dump_links_cte()} SELECT page_id, line_no, link_no, link FROM dl"
ORACLE["tld_links"] = f"""WITH {_dump_links_cte()}
SELECT page_id, line_no, link_no, link FROM dl WHERE string_split({_host('link')}, '.')[-1] = 'com'"""
ORACLE["ranked_domains"] = """WITH r AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS n FROM pages GROUP BY 1)
SELECT 'http://' || host AS link FROM r WHERE string_split(host, '.')[-1] = 'com'"""


def _limited(limit: int, popular: bool) -> str:
    order = "n DESC, link" if popular else "md5('links' || link), link"
    extra = ", n" if popular else ""
    return f"""WITH {_dump_links_cte()}, {POP},
    rk AS (SELECT sld, link, n, row_number() OVER (PARTITION BY sld ORDER BY {order}) AS rn FROM pop)
SELECT sld, CAST(rn - 1 AS INTEGER) AS stage, link{extra} FROM rk WHERE rn <= {limit}"""


ORACLE["limited_links"] = _limited(50, False)
ORACLE["popular_links"] = _limited(50, True)
ORACLE["stage_sizes"] = f"""WITH st AS ({_limited(50, False)}),
    per AS (SELECT stage, count(*) AS urls FROM st GROUP BY stage)
SELECT stage, urls, round(CAST(100 AS DOUBLE) * urls / max(urls) OVER (ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS percentage
FROM per"""
ORACLE["domain_split"] = f"""WITH st AS ({_limited(50, False)}),
    sl AS (SELECT DISTINCT {S.sl_domain('link')} AS sld FROM st WHERE stage = 0),
    rk AS (SELECT sld, row_number() OVER (ORDER BY md5('7' || sld), sld) AS pos, count(*) OVER () AS n FROM sl)
SELECT sld, pos <= floor(n * 0.8) AS train FROM rk"""


# ---------------------------------------------------------------- vectors

def _fold(x: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, {x}), lambda acc, v: acc + v)"


def _cos(a: str, b: str) -> str:
    ad, bd = f"list_transform({a}, lambda x: CAST(x AS DOUBLE))", f"list_transform({b}, lambda x: CAST(x AS DOUBLE))"
    dot = _fold(f"list_transform(list_zip({ad}, {bd}), lambda p: p[1] * p[2])")
    na = f"sqrt({_fold(f'list_transform({ad}, lambda x: x * x)')})"
    nb = f"sqrt({_fold(f'list_transform({bd}, lambda x: x * x)')})"
    return f"(1 - CASE WHEN {na} * {nb} = 0 THEN NULL ELSE {dot} / ({na} * {nb}) END)"


ORACLE["cosine_neighbours"] = f"""WITH e AS (SELECT vec_id, embedding,
        lag(embedding) OVER (ORDER BY vec_id) AS prev FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, round({_cos('embedding', 'prev')}, 9) AS distance,
       prev IS NULL OR {_cos('embedding', 'prev')} >= 0.01 AS valid FROM e
UNION ALL SELECT vec_id, NULL::DOUBLE, false FROM embeddings WHERE embedding IS NULL"""
ORACLE["vector_mean"] = """WITH x AS (SELECT label, unnest(range(len(embedding))) AS dim, embedding FROM embeddings)
SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(embedding[dim + 1] AS DOUBLE)), 9) AS mean FROM x GROUP BY label, dim"""
ORACLE["token_chunks"] = f"""WITH t AS (SELECT doc_id, {S.words('[text]')} AS toks FROM documents),
    p AS (SELECT doc_id, toks, len(toks) AS n, CAST(ceil(len(toks) / 512.0::DOUBLE) AS INTEGER) AS parts FROM t),
    i AS (SELECT doc_id, toks, n, parts, unnest(range(parts)) AS part FROM p WHERE parts > 0),
    b AS (SELECT doc_id, toks, CAST(part AS INTEGER) AS part,
                 CAST(ceil(part * (n / CAST(parts AS DOUBLE))) AS INTEGER) AS start,
                 CAST(ceil((part + 1) * (n / CAST(parts AS DOUBLE))) AS INTEGER) AS "end" FROM i)
SELECT doc_id, part, start, "end", "end" - start AS tokens, 512 - "end" + start AS padding,
       array_to_string(toks[start + 1:"end"], ' ') AS chunk, md5(array_to_string(toks[start + 1:"end"], ' ')) AS chunk_md5 FROM b"""

ORACLE["normalized_cube"] = f"""WITH {_weekly_cte()}
SELECT feature, week_no, week, prev_n, cur_n, pages, {_ratio('pages', 'sum(pages) OVER (PARTITION BY feature, week_no)')} AS fraction
FROM cube"""

def _static_sql(before: str, src: str, first: str) -> str:
    return f"""WITH {before}
    vp AS (SELECT * FROM {src} WHERE octet_length(encode(html)) <= {10 * 1048576} AND {S.has_html_element('html')}),
    {_links_cte('vp')},
    {_html_lists_cte('vp')},
    t0 AS (SELECT page_id, {S.words(S.text_lines('html'))} AS w FROM vp),
    u AS (SELECT *, {S.sl_domain('url')} AS sld FROM vp)
SELECT {first}, CAST(octet_length(encode(u.html)) AS INTEGER) AS size, md5(u.html) AS source_md5,
       CAST(length(u.url) AS INTEGER) AS url_length, CAST(length(sld) AS INTEGER) AS domain_name_length,
       CAST(length({S.rx_replace('sld', r'[^\p{Nd}]')}) AS INTEGER) AS domain_name_digits,
       CAST(length({S.rx_replace('sld', r'[\p{L}\p{Nd}]')}) AS INTEGER) AS domain_name_special_chars,
       CAST(len(string_split({S.strip_protocol('u.url')}, '/')) - 1 AS INTEGER) AS url_subdir_depth,
       CAST(greatest(len(string_split({S.root_domain('u.url')}, '.')) - 2, 0) AS INTEGER) AS url_subdomain_depth,
       CASE WHEN lower(split_part(u.url, '://', 1)) = 'https' THEN 1 ELSE 0 END AS protocol,
       CAST(len(links.email) AS INTEGER) AS email_links,
       CAST(len(hl.images) AS INTEGER) AS images, CAST(len(hl.scripts) AS INTEGER) AS scripts,
       CAST(len(hl.tables) AS INTEGER) AS tables, CAST(len(hl.meta) AS INTEGER) AS meta,
       CAST(len(t0.w) AS INTEGER) AS words_total,
       CAST(len(list_distinct(list_transform(t0.w, lambda x: lower(x)))) AS INTEGER) AS words_unique,
       CAST(len(links.internal) AS INTEGER) AS internal_outlinks, CAST(len(links.external) AS INTEGER) AS external_outlinks,
       CAST(len(hl.html_tags) AS INTEGER) AS tags_total, CAST(len(list_distinct(hl.html_tags)) AS INTEGER) AS tags_unique
FROM u JOIN links ON links.page_id = u.page_id JOIN hl ON hl.page_id = u.page_id JOIN t0 ON t0.page_id = u.page_id"""


ORACLE["page_static_features"] = _static_sql("", "pages", "u.page_id")
ORACLE["crawl_static_features"] = _static_sql(_series_cte() + ", ok AS (SELECT * FROM sr WHERE ok),", "ok",
                                              "u.day, u.page_key, CAST(isodow(u.day) - 1 AS INTEGER) AS weekday")

ORACLE["page_feature_numbers"] = f"""WITH
    vp AS (SELECT * FROM pages WHERE octet_length(encode(html)) <= {10 * 1048576} AND {S.has_html_element('html')}),
    {_links_cte('vp')},
    {_html_lists_cte('vp')},
    tx AS (SELECT page_id, {S.text_lines('html')} AS text FROM vp)
SELECT links.page_id, CAST(len(links.email) AS INTEGER) AS email_links,
       CAST(len(links.external) AS INTEGER) AS external_outlinks, CAST(len(hl.images) AS INTEGER) AS images,
       CAST(len(links.internal) AS INTEGER) AS internal_outlinks, CAST(len(hl.meta) AS INTEGER) AS meta,
       CAST(len(tx.text) AS INTEGER) AS text, CAST(len(hl.scripts) AS INTEGER) AS scripts,
       CAST(len(hl.tables) AS INTEGER) AS tables, CAST(len(hl.html_tags) AS INTEGER) AS html_tags
FROM links JOIN hl ON hl.page_id = links.page_id JOIN tx ON tx.page_id = links.page_id"""

ORACLE["global_start_duplicates"] = f"""WITH {CRAWL_ORDER},
    g AS (SELECT *, lag(text_lines) OVER (ORDER BY thread, url_index) AS gp FROM co),
    f AS (SELECT *, gp IS NOT NULL AS has_prev, coalesce(gp[1:3] = text_lines[1:3], false) AS same_start FROM g)
SELECT doc_id, thread, url_index, has_prev, same_start,
       (NOT has_prev) OR (len(text_lines) > 0 AND NOT same_start) AS cheap_valid FROM f"""

ORACLE["streamed_pair_bits"] = f"""WITH {SNAPSHOTS}
SELECT CAST(page_id AS VARCHAR) AS page_id, DATE '2021-06-12' + day1 AS day1, DATE '2021-06-12' + day2 AS day2,
       CAST(text_1 <> text_2 AS INTEGER) AS text_changed,
       CAST(internal_outlinks_1 <> internal_outlinks_2 AS INTEGER) AS internal_outlinks_changed,
       CAST(meta_1 <> meta_2 AS INTEGER) AS meta_changed FROM pr"""
