"""Inputs that Spark derives from the given tables, and the same derivations for the SQL check.

The tables hold no question log and no filings, so both are derived row by row:
``requests`` from ``events`` and ``filings`` from ``orders``, ``customer``, ``nation`` and ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

COMPANIES = ("Microsoft", "Amazon", "Facebook", "Alphabet", "Tesla", "Apple", "NVIDIA")
QUESTIONS = (
    "What is {c} revenue in {y}?",
    "Compare {c} and Google profit this year",
    "Define gross margin",
    "Analyze risk for {c} last year",
    "Who is the CEO of {c}?",
    "How many employees did {c} have in {y}",
    "Should I invest in {c}? I think it is certain",
    "revenue",
    "Explain why their profit fell in {y}",
    "Show me {c} gross margin and forecast for {y}",
)
LARGE_MODEL = "purchase"
PRICED_MODELS = (("view", 0.05, 0.10), ("click", 0.05, 0.10), ("purchase", 0.25, 0.50), ("signup", 0.05, 0.10))


def render(template: str, **cols: Column) -> Column:
    """``"a {x} b"`` as a concatenation."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(cols[name].cast("string"))
    return F.concat(*parts)


def render_sql(template: str, **cols: str) -> str:
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(sql_text(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(f"CAST({cols[name]} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(sql_text(i) for i in items) + "]"


def choose(index: Column, items) -> Column:
    return F.element_at(F.array(*[i if isinstance(i, Column) else F.lit(i) for i in items]), (index + 1).cast("int"))


def micros(column: str) -> Column:
    """Epoch microseconds of a zone-less time, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    ts = F.col("ts").cast("timestamp")
    company = choose(F.col("user_id") % 7, COMPANIES)
    year = 2020 + k % 5
    texts = [render(q, c=company, y=year) for q in QUESTIONS]
    ask = F.when(k % 10 == 0, texts[0])
    for i, text in enumerate(texts[1:], 1):
        ask = ask.when(k % 10 == i, text)
    return table(spark, folder, "events").select(
        "event_id", ts.alias("ts"), micros("ts").alias("us"), F.date_format(ts, "yyyy-MM-dd").alias("date"),
        "user_id", F.col("event_type").alias("model"),
        F.when(F.col("user_id") % 2 == 0, "simple").otherwise("complex").alias("complexity"),
        k.alias("tokens_in"), (2 * k + 1).alias("tokens_out"),
        (F.col("value") / 1000.0).alias("cost_usd"), (F.col("value") * 100.0).alias("latency_ms"), ask.alias("query"),
    )


_ASK = "CASE " + " ".join(
    f"WHEN k % 10 = {i} THEN " + render_sql(q, c=f"({sql_list(COMPANIES)})[user_id % 7 + 1]", y="(2020 + k % 5)")
    for i, q in enumerate(QUESTIONS)
) + " END"
REQ = f"""req AS (
  SELECT event_id, ts, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%d') AS date, user_id, event_type AS model,
    CASE WHEN user_id % 2 = 0 THEN 'simple' ELSE 'complex' END AS complexity,
    k AS tokens_in, 2 * k + 1 AS tokens_out, value / 1000.0 AS cost_usd, value * 100.0 AS latency_ms,
    {_ASK} AS query
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"""


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICED_MODELS), "model string, price_in double, price_out double")


PRICES = "prices(model, price_in, price_out) AS (VALUES " + ", ".join(
    f"('{m}', {a}, {b})" for m, a, b in PRICED_MODELS
) + ")"


INDUSTRIES = ("software", "retail", "media", "consumer electronics")
FILING = (
    "Annual report of {name} in {nation}.\n\n"
    "ITEM 1. Business\n"
    "{company} operates in the {industry} industry. {company} reported ${rev} million in total revenue for the year "
    "{year}. The company had approximately {n},000 employees at the end of the year! Revenue of ${rev} million was "
    "shared by {n} customers. CEO Mary Smith{key} said so.\n\n"
    "{company} acquired {other} in Q2 {year}. Is more to come? The chart shows a trend.\n\n"
    "ITEM 1A: Risk Factors\n"
    "- Currency: exposure of {n} orders\n"
    "- Supply: {nation} ports\n"
    "- Demand\n\n"
    "ITEM 7. Discussion\n"
    "| Metric | Year | Value |\n"
    "| --- | --- | --- |\n"
    "| Orders | {year} | {n} |\n"
    "| Revenue | {year} | {rev} |\n\n"
    "{company}'s net income was ${inc} million. Gross margin was {n}.5%. Operating income of ${inc}.25 million grew.\n"
    "Total assets of ${assets} million.\n\n"
    "PART 2 Notes\n"
    "{body}\n"
)


def filings(spark: SparkSession, folder: str, only: DataFrame | None = None) -> DataFrame:
    """One filing per customer with orders and per document: ``doc_id, ticker, year, text``.

    ``only(doc_id)`` names the filings that are wanted; others are not made.
    """

    def wanted(df: DataFrame, key: str) -> DataFrame:
        return df if only is None else df.join(only.select(F.col("doc_id").alias(key)), key, "left_semi")

    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    sums = wanted(table(spark, folder, "orders"), "o_custkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.floor(cents / 100000).alias("rev"), F.count(F.lit(1)).alias("n"), F.max(F.year("o_orderdate")).alias("year")
    )
    docs = wanted(table(spark, folder, "documents"), "doc_id").select(
        F.col("doc_id").alias("c_custkey"), F.regexp_replace("text", "\n", "\n\n").alias("body")
    )
    base = (
        sums.join(table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey")
        .join(table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
        .join(docs, "c_custkey", "full")
        .fillna({"n_name": "NOWHERE", "rev": 0, "n": 0, "year": 2024})
        .withColumn("c_name", F.coalesce("c_name", F.concat(F.lit("Customer "), F.col("c_custkey").cast("string"))))
    )
    key = F.col("c_custkey")
    text = render(
        FILING, name=F.col("c_name"), nation=F.col("n_name"), company=choose(key % 7, COMPANIES),
        other=choose((key + 3) % 7, COMPANIES), industry=choose(key % 4, INDUSTRIES), rev=F.col("rev"),
        year=F.col("year"), n=F.col("n"), inc=F.floor(F.col("rev") / 3), assets=F.col("rev") * 2, key=key,
        body=F.coalesce("body", F.lit("")),
    )
    return base.select(key.alias("doc_id"), choose(key % 7, _tickers()).alias("ticker"), F.col("year").cast("int").alias("year"),
                       text.alias("text"))


def _tickers() -> tuple[str, ...]:
    return ("MSFT", "AMZN", "META", "GOOG", "TSLA", "AAPL", "NVDA")


_FILING_SQL = render_sql(
    FILING, name="c_name", nation="n_name", company=f"({sql_list(COMPANIES)})[c_custkey % 7 + 1]",
    other=f"({sql_list(COMPANIES)})[(c_custkey + 3) % 7 + 1]", industry=f"({sql_list(INDUSTRIES)})[c_custkey % 4 + 1]",
    rev="rev", year="year", n="n", inc="(rev // 3)", assets="(rev * 2)", key="c_custkey", body="coalesce(body, '')",
)
FILINGS = f"""filings AS (
  SELECT c_custkey AS doc_id, ({sql_list(_tickers())})[c_custkey % 7 + 1] AS ticker, year, {_FILING_SQL} AS text
  FROM (SELECT c_custkey, coalesce(c_name, 'Customer ' || c_custkey) AS c_name, coalesce(n_name, 'NOWHERE') AS n_name, coalesce(rev, 0) AS rev,
    coalesce(n, 0) AS n, coalesce(year, 2024) AS year, body
  FROM (SELECT * FROM (SELECT o_custkey AS c_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) // 100000 AS rev,
          count(*) AS n, CAST(max(year(o_orderdate)) AS INT) AS year
        FROM orders GROUP BY o_custkey)
  JOIN customer USING (c_custkey) JOIN nation ON n_nationkey = c_nationkey) f
  FULL JOIN (SELECT doc_id AS c_custkey, replace(text, chr(10), chr(10) || chr(10)) AS body FROM documents) b USING (c_custkey)))"""


# --- answered questions ------------------------------------------------------------------------
ANSWER_TAILS = (
    "",
    " I think revenue was $5.2 billion, probably. [MSFT 2024] (AMZN 2023) Maybe $9 million.",
    " Definitely $1,000 million, guaranteed [GOOG 2021] [GOOG 2021]. i believe so, not sure.",
    "\n\n\n\n```tool_code\nsearch()\n``` Done.<tool_call>x</tool_call>\n\n",
)
CONTEXT_TAIL = "\n\n[MSFT 2024] Revenue of $5.2 billion.\n\n[GOOG 2021] Text.\n\n[MSFT 2024] More.\n\n[AMZN 2022] 12.5 and 1,000"


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as the context of the assistant turns of one conversation, the turn before being the question."""
    turns = table(spark, folder, "conversations")
    said = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("said"))
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    pairs = said.join(asked, ["conv_id", "turn"]).withColumnRenamed("conv_id", "of")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("doc"))
    conversations = turns.select((F.max("conv_id") + 1).alias("n")).scalar()
    base = docs.withColumn("of", F.col("conv_id") % conversations).join(pairs, "of", "left").fillna({"turn": 1, "said": "It says nothing", "question": "What does it say?"}).drop("of")
    tail = choose((F.col("conv_id") + F.col("turn")) % 4, ANSWER_TAILS)
    c, k = F.col("conv_id"), F.col("turn")
    return base.select(
        (c * 1000 + k).alias("qid"), "conv_id", "turn",
        F.when(c % 3 == 0, F.concat(F.lit("Microsoft or Amazon? "), F.col("question"))).otherwise(F.col("question")).alias("query"),
        F.concat("said", tail).alias("answer"), F.concat("doc", F.lit(CONTEXT_TAIL)).alias("context"),
        F.when(c % 2 == 0, F.concat("question", F.lit(" "), "said")).when(c % 5 == 1, F.lit("word")).otherwise(F.col("doc")).alias("truth"),
        F.when(c % 7 == 3, F.array().cast("array<string>")).otherwise(F.array("doc", "question")).alias("contexts"),
    )


ANSWERS = f"""qa AS (SELECT conv_id * 1000 + turn AS qid, conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'Microsoft or Amazon? ' || question ELSE question END AS query,
  said || ({sql_list(ANSWER_TAILS)})[(conv_id + turn) % 4 + 1] AS answer, doc || {sql_text(CONTEXT_TAIL)} AS context,
  CASE WHEN conv_id % 2 = 0 THEN question || ' ' || said WHEN conv_id % 5 = 1 THEN 'word' ELSE doc END AS truth,
  CASE WHEN conv_id % 7 = 3 THEN CAST([] AS VARCHAR[]) ELSE [doc, question] END AS contexts
  FROM (SELECT conv_id, coalesce(turn, 1) AS turn, coalesce(said, 'It says nothing') AS said, coalesce(question, 'What does it say?') AS question, doc
    FROM (SELECT doc_id AS conv_id, doc_id % (SELECT max(conv_id) + 1 FROM conversations) AS part, text AS doc FROM documents)
    LEFT JOIN (SELECT conv_id AS part, turn, said, question FROM (SELECT conv_id, turn, text AS said FROM conversations WHERE role = 'assistant')
      JOIN (SELECT conv_id, turn + 1 AS turn, text AS question FROM conversations) USING (conv_id, turn)) USING (part)))"""
