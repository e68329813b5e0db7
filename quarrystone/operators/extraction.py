"""Tables, figures and metrics in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions.rows import each


def _lines(block: Column) -> Column:
    return F.filter(F.transform(F.split(block, "\n"), T.strip), lambda x: x != "")


def _cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\|"), T.strip), lambda c: c != "")


def extract_md_tables(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, headers array<string>, rows array<array<string>>``; empty cells are dropped."""
    blocks = F.regexp_extract_all("text", F.lit(fixed.MD_TABLE), F.lit(1))
    found = each(docs, [c for c in docs.columns if c != "text"], blocks, "block", "pos").withColumn("_l", _lines(F.col("block")))
    rows = F.filter(F.transform(F.slice("_l", F.lit(3), F.greatest(F.size("_l") - 2, F.lit(0))), _cells), lambda r: F.size(r) > 0)
    return (
        found.where(F.size("_l") >= 2).withColumn("headers", _cells(F.col("_l")[0])).withColumn("rows", rows)
        .where((F.size("headers") > 0) & (F.size("rows") > 0)).drop("block", "_l")
    )


def extract_lists(docs: DataFrame) -> DataFrame:
    """Bullet lists of two items or more as ``Item``/``Value`` rows, split at the first colon."""
    blocks = F.regexp_extract_all("text", F.lit(fixed.BULLET_LIST), F.lit(1))
    found = each(docs, [c for c in docs.columns if c != "text"], blocks, "block", "pos")
    bullets = F.filter(F.transform(F.split("block", "\n"), T.strip), lambda x: x.startswith("- ") | x.startswith("• "))
    items = F.transform(bullets, lambda x: T.strip(F.substr(x, F.lit(3))))

    def row(item: Column) -> Column:
        pair = F.split(item, ":", 2)
        return F.when(F.contains(item, F.lit(":")), F.transform(pair, T.strip)).otherwise(F.array(item, F.lit("")))

    return found.withColumn("rows", F.transform(items, row)).where(F.size("rows") >= 2).withColumn(
        "headers", F.array(F.lit("Item"), F.lit("Value"))).drop("block")


def table_to_markdown(headers: Column, rows: Column) -> Column:
    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def fitted(row: Column) -> Column:
        padding = F.array_repeat(F.lit(""), F.greatest(F.size(headers) - F.size(row), F.lit(0)))
        return F.slice(F.concat(row, padding), F.lit(1), F.size(headers))

    rule = line(F.transform(headers, lambda h: F.lit("---")))
    return F.when(F.size(headers) > 0, F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, lambda r: line(fitted(r)))), "\n")).otherwise("")


def table_to_dict(rows: Column) -> Column:
    """First cell to second; a repeated key keeps its last value."""
    n = F.size(rows)
    keys = F.transform(rows, lambda r: r[0])
    last = F.filter(rows, lambda r, i: ~F.array_contains(F.slice(keys, i + 2, n), r[0]))
    return F.map_from_entries(F.transform(last, lambda r: F.struct(r[0].alias("k"), F.coalesce(F.try_element_at(r, F.lit(2)), F.lit("")).alias("v"))))


def table_to_text(headers: Column, rows: Column) -> Column:
    top = F.array_join(headers, " | ")
    rule = F.repeat(F.lit("-"), F.length(top))
    return F.array_join(F.concat(F.array(top, rule), F.transform(rows, lambda r: F.array_join(r, " | "))), "\n")


def format_context(tables: DataFrame, limit: int = 3) -> DataFrame:
    """The first ``limit`` tables of each document as one text (``doc_id, ticker, year, pos, headers, rows``)."""
    kept = tables.where(F.col("pos") < limit)
    block = F.concat(F.lit("Table "), (F.col("pos") + 1).cast("string"), F.lit(" ["), F.col("ticker"), F.lit(" "), F.col("year").cast("string"), F.lit("]:\n"),
                     table_to_markdown(F.col("headers"), F.col("rows")))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("context"))


def _first(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_financials(text: Column) -> Column:
    risks = F.regexp_extract_all(F.regexp_extract(text, fixed.RISK_SECTION, 1), F.lit(fixed.RISK_BULLET), F.lit(1))
    return F.struct(
        _first(text, fixed.REVENUE_PHRASE, 0).alias("revenue"),
        F.replace(_first(text, fixed.EMPLOYEE_COUNT, 1), F.lit(",")).alias("employees"),
        F.slice(F.transform(risks, T.strip), 1, 5).alias("risks"),
        *[_first(text, pattern, 1).alias(name) for name, pattern in fixed.FIGURE_PATTERNS],
    )


def extract_metric(text: Column, metric: str, scale: str = "reference") -> Column:
    """First pattern that yields a number.  ``scale="fixed"`` also scales billions and thousands rightly."""
    tried = []
    for pattern, published, corrected in fixed.METRIC_PATTERNS[metric]:
        number = F.replace(F.regexp_extract(text, pattern, 1), F.lit(",")).try_cast("double")
        tried.append(number * float(published if scale == "reference" else corrected))
    return F.coalesce(*tried)


def parse_chart_text(text: Column) -> Column:
    """Lines with figures (10 at most), the last line naming a chart, lines with findings (5 at most)."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != "")
    charts = F.filter(lines, lambda x: T.contains_any(F.lower(x), fixed.CHART_TYPES))
    return F.struct(
        F.slice(F.filter(lines, lambda x: x.rlike("[0-9]") & (F.length(x) < 200)), 1, 10).alias("data_points"),
        F.try_element_at(charts, F.lit(-1)).alias("chart_type"),
        F.slice(F.filter(lines, lambda x: T.contains_any(F.lower(x), fixed.INSIGHT_WORDS)), 1, 5).alias("insights"),
    )
