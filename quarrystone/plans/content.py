"""Tables, metrics and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions.rows import each
from ..operators import comparing as P
from ..operators import extraction as X
from ..sources.tables import table
from .inputs import FILINGS, filings, sql_text
from .questions import any_sql
from .registry import query

W = "WITH " + FILINGS
S = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LINES = "list_filter(list_transform(string_split({}, chr(10)), lambda x: " + S.format("x") + "), lambda x: x <> '')"
_CELLS = "list_filter(list_transform(string_split({}, '|'), lambda c: " + S.format("c") + "), lambda c: c <> '')"
MD = W + f""", mb AS (SELECT doc_id, ticker, year, unnest(z) AS block, unnest(range(len(z))) AS pos FROM (SELECT doc_id, ticker, year, regexp_extract_all(text, {sql_text(fixed.MD_TABLE)}, 1) AS z FROM filings)),
ml AS (SELECT *, {_LINES.format('block')} AS l FROM mb),
mt AS (SELECT doc_id, ticker, year, pos, {_CELLS.format('l[1]')} AS headers, list_filter(list_transform(l[3:], lambda r: {_CELLS.format('r')}), lambda r: len(r) > 0) AS rows FROM ml WHERE len(l) >= 2),
md AS (SELECT * FROM mt WHERE len(headers) > 0 AND len(rows) > 0)"""
_ROWS_TEXT = "array_to_string(list_transform(rows, lambda r: array_to_string(r, '|')), ';')"


def _rows_text(c):
    return F.array_join(F.transform(c, lambda r: F.array_join(r, "|")), ";")


@query("extract_md_tables", MD + f" SELECT doc_id, pos, array_to_string(headers, '|') AS headers, {_ROWS_TEXT} AS rows FROM md")
def extract_md_tables(spark, d):
    t = X.extract_md_tables(filings(spark, d))
    return t.select("doc_id", "pos", F.array_join("headers", "|").alias("headers"), _rows_text("rows").alias("rows"))


@query("extract_lists", W + f""", lb AS (SELECT doc_id, unnest(z) AS block, unnest(range(len(z))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, {sql_text(fixed.BULLET_LIST)}, 1) AS z FROM filings)),
it AS (SELECT doc_id, pos, list_transform(list_filter(list_transform(string_split(block, chr(10)), lambda x: {S.format('x')}), lambda x: x[:2] IN ('- ', '• ')), lambda x: {S.format('x[3:]')}) AS i FROM lb)
SELECT doc_id, pos, array_to_string(list_transform(i, lambda x: CASE WHEN contains(x, ':') THEN {S.format("left(x, strpos(x, ':') - 1)")} || '|' || {S.format("substr(x, strpos(x, ':') + 1)")} ELSE x || '|' END), ';') AS rows FROM it WHERE len(i) >= 2""")
def extract_lists(spark, d):
    return X.extract_lists(filings(spark, d)).select("doc_id", "pos", _rows_text("rows").alias("rows"))


_LINE = "'| ' || array_to_string({}, ' | ') || ' |'"
MARKDOWN = ("array_to_string(list_concat([" + _LINE.format("headers") + ", " + _LINE.format("list_transform(headers, lambda h: '---')") + "], list_transform(rows, lambda r: "
         + _LINE.format("list_resize(r, len(headers), '')") + ")), chr(10))")


@query("table_to_markdown", MD + f" SELECT doc_id, pos, {MARKDOWN} AS markdown FROM md")
def table_to_markdown(spark, d):
    t = X.extract_md_tables(filings(spark, d))
    return t.select("doc_id", "pos", X.table_to_markdown(F.col("headers"), F.col("rows")).alias("markdown"))


@query("table_to_dict", MD + " SELECT doc_id, pos, r[1] AS key, coalesce(r[2], '') AS value FROM (SELECT doc_id, pos, unnest(rows) AS r, unnest(range(len(rows))) AS i FROM md) QUALIFY row_number() OVER (PARTITION BY doc_id, pos, r[1] ORDER BY i DESC) = 1")
def table_to_dict(spark, d):
    t = X.extract_md_tables(filings(spark, d))
    return t.select("doc_id", "pos", F.explode(X.table_to_dict(F.col("rows"))).alias("key", "value"))


@query("table_to_text", MD + " SELECT doc_id, pos, array_to_string(list_concat([array_to_string(headers, ' | '), repeat('-', length(array_to_string(headers, ' | ')))], list_transform(rows, lambda r: array_to_string(r, ' | '))), chr(10)) AS text FROM md")
def table_to_text(spark, d):
    t = X.extract_md_tables(filings(spark, d))
    return t.select("doc_id", "pos", X.table_to_text(F.col("headers"), F.col("rows")).alias("text"))


@query("format_context", MD + f" SELECT doc_id, string_agg('Table ' || CAST(pos + 1 AS VARCHAR) || ' [' || ticker || ' ' || CAST(year AS VARCHAR) || ']:' || chr(10) || {MARKDOWN}, chr(10) || chr(10) ORDER BY pos) AS context FROM md WHERE pos < 3 GROUP BY doc_id")
def format_context(spark, d):
    return X.format_context(X.extract_md_tables(filings(spark, d)))


@query("extract_financials", W + f""" SELECT doc_id, nullif(regexp_extract(text, {sql_text(fixed.REVENUE_PHRASE)}), '') AS revenue, replace(nullif(regexp_extract(text, {sql_text(fixed.EMPLOYEE_COUNT)}, 1), ''), ',', '') AS employees,
  array_to_string(list_transform(regexp_extract_all(regexp_extract(text, {sql_text(fixed.RISK_SECTION)}, 1), {sql_text(fixed.RISK_BULLET)}, 1), lambda r: {S.format('r')})[:5], '|') AS risks,
  {', '.join(f"nullif(regexp_extract(text, {sql_text(p)}, 1), '') AS {n}" for n, p in fixed.FIGURE_PATTERNS)} FROM filings""")
def extract_financials(spark, d):
    t = filings(spark, d).select("doc_id", X.extract_financials(F.col("text")).alias("f")).select("doc_id", "f.*")
    return t.withColumn("risks", F.array_join("risks", "|"))


def _metric_sql(metric: str, at: int) -> str:
    return "coalesce(" + ", ".join(
        f"try_cast(replace(regexp_extract(text, {sql_text(p[0])}, 1), ',', '') AS DOUBLE) * {p[at]}" for p in fixed.METRIC_PATTERNS[metric]) + ", NULL)"


@query("extract_metric", W + " SELECT doc_id, " + ", ".join(
    f"{_metric_sql(m, at)} AS {m}_{label}" for m in fixed.METRIC_PATTERNS for at, label in ((1, "reference"), (2, "fixed"))) + " FROM filings")
def extract_metric(spark, d):
    return filings(spark, d).select("doc_id", *[
        X.extract_metric(F.col("text"), m, scale).alias(f"{m}_{scale}") for m in fixed.METRIC_PATTERNS for scale in ("reference", "fixed")])


@query("parse_chart_text", W + f""", l AS (SELECT doc_id, {_LINES.format('text')} AS l FROM filings)
SELECT doc_id, array_to_string(list_filter(l, lambda x: regexp_matches(x, '[0-9]') AND length(x) < 200)[:10], '|') AS data_points,
  list_filter(l, lambda x: {any_sql('lower(x)', fixed.CHART_TYPES)})[-1] AS chart_type, array_to_string(list_filter(l, lambda x: {any_sql('lower(x)', fixed.INSIGHT_WORDS)})[:5], '|') AS insights FROM l""")
def parse_chart_text(spark, d):
    t = filings(spark, d).select("doc_id", X.parse_chart_text(F.col("text")).alias("c")).select("doc_id", "c.*")
    return t.select("doc_id", F.array_join("data_points", "|").alias("data_points"), "chart_type", F.array_join("insights", "|").alias("insights"))


# --- comparisons ---------------------------------------------------------------------------------


def _yearly(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("entity")), "o_custkey")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return o.groupBy("entity", F.year("o_orderdate").alias("year")).agg((cents / 100).alias("value"))


YEARLY = """yv AS (SELECT c_mktsegment AS entity, CAST(year(o_orderdate) AS INT) AS year, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100 AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
cp AS (SELECT entity, year, value, lag(year) OVER w AS prev_year, value - lag(value) OVER w AS change, round((value - lag(value) OVER w) / abs(lag(value) OVER w) * 100, 2) AS pct_change FROM yv WINDOW w AS (PARTITION BY entity ORDER BY year))"""


@query("compare_periods", "WITH " + YEARLY + " SELECT entity, year, round(value, 2) AS value, prev_year, round(change, 2) AS change, pct_change FROM cp")
def compare_periods(spark, d):
    return P.compare_periods(_yearly(spark, d)).withColumn("value", F.round("value", 2)).withColumn("change", F.round("change", 2))


@query("classify_trend", "WITH " + YEARLY + " SELECT entity, CASE WHEN avg(pct_change) > 5 THEN 'improving' WHEN avg(pct_change) < -5 THEN 'declining' ELSE 'stable' END AS trend, round(avg(pct_change), 6) AS avg_pct FROM cp GROUP BY entity")
def classify_trend(spark, d):
    return P.classify_trend(P.compare_periods(_yearly(spark, d)))


@query("rank_entities", """WITH v AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN v // 1000000 END AS value FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders GROUP BY 1) USING (c_custkey))
SELECT id, CAST(value AS BIGINT) AS value, row_number() OVER (ORDER BY value DESC NULLS LAST, id) AS rank FROM v""")
def rank_entities(spark, d):
    v = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("v"))
    # every third customer has no value, so that the nulls form a large tie
    all_ = table(spark, d, "customer").select("c_custkey").join(v, "c_custkey", "left").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.floor(F.col("v") / 1000000)).alias("value"))
    return P.rank_entities(all_)


def _document_lines(spark, d, new: bool):
    text = F.col("text")
    if new:
        text = F.when(F.col("doc_id") % 4 == 0, F.concat(text, F.lit("\nadded"))).when(F.col("doc_id") % 4 == 1, F.regexp_replace(text, "The ", "A ")).when(
            F.col("doc_id") % 4 == 2, F.regexp_replace(text, "\n[^\n]*$", "")).otherwise(text)
    return each(table(spark, d, "documents"), ["doc_id"], F.split(text, "\n"), "line", "line_no")


@query("compare_versions", r"""WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || chr(10) || 'added' WHEN 1 THEN replace(text, 'The ', 'A ') WHEN 2 THEN regexp_replace(text, '\n[^\n]*$', '') ELSE text END AS text FROM documents),
a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS was, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS now, unnest(range(len(string_split(text, chr(10))))) AS i FROM n)
SELECT doc_id, count(*) FILTER (was IS NULL) AS added, count(*) FILTER (now IS NULL) AS removed, count(*) FILTER (was <> now) AS replaced, bool_or(was IS DISTINCT FROM now) AS changed FROM a FULL JOIN b USING (doc_id, i) GROUP BY doc_id""")
def compare_versions(spark, d):
    return P.compare_versions(_document_lines(spark, d, False), _document_lines(spark, d, True))


@query("diff_versions", r"""WITH o AS (SELECT doc_id, coalesce(text, '') AS old FROM documents),
n AS (SELECT *, doc_id % 4 AS k, contains(old, chr(10)) AS lines, suffix(old, chr(10)) AS closed, CASE doc_id % 4 WHEN 0 THEN old || chr(10) || 'added'
  WHEN 1 THEN split_part(old, chr(10), 1) || chr(10) || 'inserted' || substr(old, length(split_part(old, chr(10), 1)) + 1) WHEN 2 THEN regexp_replace(old, '\n[^\n]*$', '') ELSE old END AS new FROM o)
SELECT doc_id, old <> new AS changed,
  CASE WHEN old = new THEN 0 WHEN k = 2 THEN CAST(new <> '' AS INT) WHEN k = 1 AND lines THEN 1 ELSE 2 END AS added,
  CASE WHEN old = new THEN 0 WHEN k = 2 THEN 2 - CAST(closed AS INT) WHEN k = 1 AND lines OR closed OR old = '' THEN 0 ELSE 1 END AS removed, CAST(old <> new AS INT) AS hunks FROM n""")
def diff_versions(spark, d):
    """Each text against a copy with a line at its end, a line put in after the first, or without its last line."""
    text = F.coalesce("text", F.lit(""))
    first = F.substring_index(text, "\n", 1)
    inserted = F.concat(first, F.lit("\ninserted"), F.substr(text, F.length(first) + 1))
    new = F.when(F.col("doc_id") % 4 == 0, F.concat(text, F.lit("\nadded"))).when(F.col("doc_id") % 4 == 1, inserted).when(
        F.col("doc_id") % 4 == 2, F.regexp_replace(text, "\n[^\n]*\\z", "")).otherwise(text)
    return P.diff_versions(table(spark, d, "documents").select("doc_id", text.alias("old"), new.alias("new"))).drop("diff")
