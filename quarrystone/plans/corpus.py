"""Corpus scans and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rows import each
from ..operators import chunking as C
from ..sources import corpus
from ..sources.tables import table
from .inputs import FILINGS, filings
from .registry import query

# the same string steps for the SQL check; RE2 has no look-behind, so ends are marked, then split
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SENTS = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: " + STRIP.format("s") + "), lambda s: s <> '')"
RAW_SENTS = r"string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
PARAS = r"list_filter(list_transform(string_split_regex({}, '\n\s*\n'), lambda s: " + STRIP.format("s") + "), lambda s: s <> '')"
TOK = "(length({}) // 4)"


def sections_sql(text: str, first: str = " preamble") -> str:
    emit = "CASE WHEN " + STRIP.format("a.content") + " <> '' THEN list_append(a.done, {'header': a.header, 'content': a.content}) ELSE a.done END"
    fold = (
        f"list_reduce(list_transform(string_split({text}, chr(10)), lambda l: {STRIP.format('l')}), lambda a, l: "
        rf"CASE WHEN regexp_matches(l, '(?i)^(ITEM|PART|Section)\s+\d') THEN {{'done': {emit}, 'header': l, 'content': ''}} "
        "ELSE {'done': a.done, 'header': a.header, 'content': a.content || l || chr(10)} END, "
        f"{{'done': CAST([] AS STRUCT(header VARCHAR, content VARCHAR)[]), 'header': '{first}', 'content': ''}})"
    )
    return f"list_transform([{fold}], lambda a: {emit})[1]"


def strict_sql(text: str) -> str:
    emit = "CASE WHEN len(a.body) > 0 THEN list_append(a.done, {'header': a.header, 'content': array_to_string(a.body, chr(10))}) ELSE a.done END"
    fold = (
        f"list_reduce(string_split({text}, chr(10)), lambda a, l: "
        rf"CASE WHEN regexp_matches({STRIP.format('l')}, '(?i)^(?:ITEM|PART|Section)\s+\d+[.:]\s*.*$') THEN {{'done': {emit}, 'header': {STRIP.format('l')}, 'body': CAST([] AS VARCHAR[])}} "
        "ELSE {'done': a.done, 'header': a.header, 'body': list_append(a.body, l)} END, "
        "{'done': CAST([] AS STRUCT(header VARCHAR, content VARCHAR)[]), 'header': 'preamble', 'body': CAST([] AS VARCHAR[])})"
    )
    done = f"list_transform([{fold}], lambda a: {emit})[1]"
    return f"list_transform([{done}], lambda z: CASE WHEN len(z) > 0 THEN z ELSE [{{'header': 'document', 'content': {text}}}] END)[1]"


def pack_text_sql(parts: str, limit: int = 500) -> str:
    fold = (
        f"list_reduce({parts}, lambda a, x: CASE WHEN length(a.cur) + length(x) > {limit} AND a.cur <> '' THEN {{'done': list_append(a.done, a.cur), 'cur': x}} "
        "ELSE {'done': a.done, 'cur': CASE WHEN a.cur = '' THEN x ELSE a.cur || ' ' || x END} END, {'done': CAST([] AS VARCHAR[]), 'cur': ''})"
    )
    return f"list_transform([{fold}], lambda a: CASE WHEN a.cur <> '' THEN list_append(a.done, a.cur) ELSE a.done END)[1]"


def pack_parts_sql(parts: str, limit: int, cost: str, joiner: str, kept: str | None = None) -> str:
    opened = f"list_append({kept}, x)" if kept else "[x]"
    new_cost = cost.format(f"array_to_string({opened}, {joiner})")
    fold = (
        f"list_reduce({parts}, lambda a, x: CASE WHEN a.used + {cost.format('x')} > {limit} AND len(a.op) > 0 "
        f"THEN {{'done': list_append(a.done, array_to_string(a.op, {joiner})), 'op': {opened}, 'used': CAST({new_cost} AS BIGINT)}} "
        f"ELSE {{'done': a.done, 'op': list_append(a.op, x), 'used': CAST(a.used + {cost.format('x')} AS BIGINT)}} END, "
        "{'done': CAST([] AS VARCHAR[]), 'op': CAST([] AS VARCHAR[]), 'used': CAST(0 AS BIGINT)})"
    )
    return f"list_transform([{fold}], lambda a: CASE WHEN len(a.op) > 0 THEN list_append(a.done, array_to_string(a.op, {joiner})) ELSE a.done END)[1]"


NL2 = "chr(10) || chr(10)"
CARRY2 = "(CASE WHEN len(a.op) > 2 THEN a.op[-2:] ELSE a.op END)"


def parents_sql(text: str) -> str:
    p = pack_parts_sql(PARAS.format(text), 1024, TOK, NL2)
    return f"list_transform([{p}], lambda z: CASE WHEN len(z) > 0 THEN z ELSE [left({text}, 2000)] END)[1]"


def children_sql(text: str) -> str:
    p = pack_parts_sql(SENTS.format(text), 256, TOK, "' '", CARRY2)
    return f"list_transform([list_filter({p}, lambda c: length(c) // 4 >= 50)], lambda z: CASE WHEN len(z) > 0 THEN z ELSE [left({text}, 500)] END)[1]"


def numbered(source: str, cols: str, arr: str, pos: str) -> str:
    """Rows of an array with a zero-based position."""
    return f"(SELECT {cols}, unnest(z) AS x, unnest(range(len(z))) AS {pos} FROM (SELECT {cols}, {arr} AS z FROM {source}))"


W = "WITH " + FILINGS


@query("scan_corpus", "SELECT source AS ticker, lang AS year, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def scan_corpus(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy(F.col("source").alias("ticker"), F.col("lang").alias("year")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"))


@query("path_metadata", r"""WITH p AS (SELECT page_id, string_split('filings/' || (['msft', 'AMZN', 'other'])[page_id % 3 + 1] || '/20' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') || '/' || url, '/') AS parts FROM pages)
SELECT page_id, coalesce(list_filter(list_transform(parts, lambda x: upper(x)), lambda x: x IN ('MSFT','AMZN','META','GOOG','TSLA','AAPL','NVDA'))[-1], 'UNKNOWN') AS ticker,
  coalesce(list_filter(parts, lambda x: regexp_matches(x, '^20\d{2}$'))[-1], 'UNKNOWN') AS year FROM p""")
def path_metadata(spark, d):
    from .inputs import choose

    path = F.concat(F.lit("filings/"), choose(F.col("page_id") % 3, ("msft", "AMZN", "other")), F.lit("/20"),
                    F.lpad((F.col("page_id") % 100).cast("string"), 2, "0"), F.lit("/"), F.col("url"))
    return table(spark, d, "pages").select("page_id", *corpus.path_metadata(path))


@query("corpus_inventory", """WITH s AS (SELECT source AS ticker, lang AS year, count(*) AS documents, CAST(sum(octet_length(encode(text))) AS BIGINT) AS size_bytes FROM documents GROUP BY ALL)
SELECT *, greatest(10, size_bytes // 5000) AS chunks, CASE WHEN size_bytes > 1024 THEN CAST(size_bytes // 1024 AS VARCHAR) || ' KB' ELSE CAST(size_bytes AS VARCHAR) || ' B' END AS size FROM s""")
def corpus_inventory(spark, d):
    return corpus.corpus_inventory(table(spark, d, "documents").select(F.col("source").alias("ticker"), F.col("lang").alias("year"), "text"))


@query("split_sections", W + f" SELECT doc_id, section_no, x.header AS header, x.content AS content FROM {numbered('filings', 'doc_id', sections_sql('text'), 'section_no')}")
def split_sections(spark, d):
    return C.split_sections(filings(spark, d))


@query("split_sections_strict", W + f" SELECT doc_id, section_no, x.header AS header, x.content AS content FROM {numbered('filings', 'doc_id', strict_sql('text'), 'section_no')}")
def split_sections_strict(spark, d):
    return C.split_sections_strict(filings(spark, d))


@query("split_sentences", f"SELECT doc_id, pos, x AS sentence FROM {numbered('documents', 'doc_id', SENTS.format('text'), 'pos')}")
def split_sentences(spark, d):
    return each(table(spark, d, "documents"), ["doc_id"], T.sentences(F.col("text")), "sentence", "pos")


@query("split_paragraphs", W + f" SELECT doc_id, pos, x AS paragraph FROM {numbered('filings', 'doc_id', PARAS.format('text'), 'pos')}")
def split_paragraphs(spark, d):
    return each(filings(spark, d), ["doc_id"], T.paragraphs(F.col("text")), "paragraph", "pos")


@query("estimate_tokens", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def estimate_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


_FLAT = f"""flat AS (SELECT doc_id, ticker, year, section, chunk_index, '[' || section || '] ' || x AS text FROM {{src}} WHERE length(x) > 50)""".replace(
    "{src}", "(SELECT doc_id, ticker, year, section, unnest(z) AS x, unnest(range(len(z))) AS chunk_index FROM (SELECT doc_id, ticker, year, s.header AS section, "
    + pack_text_sql(SENTS.format(STRIP.format("s.content"))) + " AS z FROM (SELECT doc_id, ticker, year, unnest(" + sections_sql("text") + ") AS s FROM filings)))")


@query("chunk_flat", W + ", " + _FLAT + " SELECT * FROM flat")
def chunk_flat(spark, d):
    return C.chunk_flat(filings(spark, d))


_UPLOAD_PACKS = pack_text_sql("list_filter(" + RAW_SENTS.format(STRIP.format("s.content")) + ", lambda x: x <> '')")
_UPLOAD = (
    "flatten(list_transform(" + sections_sql("text", "preamble") + ", lambda s: list_transform(list_transform([" + _UPLOAD_PACKS
    + "], lambda z: list_filter(z, lambda p, i: i < len(z) OR length(" + STRIP.format("p") + ") > 50))[1], lambda c: {'section': s.header, 'text': '[' || s.header || '] ' || "
    + STRIP.format("c") + "})))"
)


@query("chunk_upload", W + f" SELECT doc_id, chunk_index, x.section AS section, x.text AS text FROM {numbered('filings', 'doc_id', _UPLOAD, 'chunk_index')}")
def chunk_upload(spark, d):
    return C.chunk_upload(filings(spark, d))


@query("chunk_parent", W + f" SELECT doc_id, parent_no, x AS text FROM {numbered('filings', 'doc_id', parents_sql('text'), 'parent_no')}")
def chunk_parent(spark, d):
    return C.chunk_parent(filings(spark, d))


@query("chunk_child", f"SELECT doc_id, child_no, x AS text FROM {numbered('documents', 'doc_id', children_sql('text'), 'child_no')}")
def chunk_child(spark, d):
    return C.chunk_child(table(spark, d, "documents"))


def _two_level_sql(base: str, cols: str, kids: str) -> str:
    return f""", base AS ({base}), k AS (SELECT *, {kids} AS z FROM base)
SELECT {cols}, type, chunk_id, parent_id, text, length(text) // 4 AS token_estimate FROM (
  SELECT {cols}, 'parent' AS type, pid AS chunk_id, '' AS parent_id, ptext AS text FROM base
  UNION ALL SELECT {cols}, 'child', pid || '_child_' || CAST(i AS VARCHAR), pid, x FROM (SELECT {cols}, pid, unnest(z) AS x, unnest(range(len(z))) AS i FROM k))"""


_PC_BASE = f"""SELECT doc_id, section, CAST(section_no AS VARCHAR) || '_' || section || '_' || CAST(p AS VARCHAR) AS pid, x AS ptext FROM (
  SELECT doc_id, section_no, section, unnest(z) AS x, unnest(range(len(z))) AS p FROM (SELECT doc_id, section_no, x.header AS section, {parents_sql('x.content')} AS z
  FROM {numbered('filings', 'doc_id', strict_sql('text'), 'section_no')}))"""


@query("chunk_parent_child", W + _two_level_sql(_PC_BASE, "doc_id, section", children_sql("ptext")))
def chunk_parent_child(spark, d):
    return C.chunk_parent_child(filings(spark, d))


_CC_PARAS = "list_filter(list_transform(string_split(text, " + NL2 + "), lambda s: " + STRIP.format("s") + "), lambda s: s <> '')"
_CC_BASE = f"SELECT doc_id, 'parent_' || CAST(p AS VARCHAR) AS pid, x AS ptext FROM {numbered('filings', 'doc_id', pack_parts_sql(_CC_PARAS, 2000, 'length({})', NL2), 'p')}"


@query("chunk_chars", W + _two_level_sql(_CC_BASE, "doc_id", pack_parts_sql(RAW_SENTS.format("ptext"), 500, "length({})", "' '", "a.op[-1:]")))
def chunk_chars(spark, d):
    return C.chunk_chars(filings(spark, d))


def _contextual(spark, d):
    flat = C.chunk_flat(filings(spark, d)).withColumn("year", F.col("year").cast("string"))
    return C.contextual_text(flat.withColumn("summary", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("chunk "), F.col("chunk_index").cast("string")))))


_CTX = W + ", " + _FLAT + r""", ctx AS (SELECT *, trim('From ' || ticker || ' (' || CAST(year AS VARCHAR) || ') ' || 'in section ''' || section || ''': ' ||
  CASE WHEN doc_id % 2 = 0 THEN 'chunk ' || CAST(chunk_index AS VARCHAR) ELSE '' END) AS context_summary FROM flat),
ctx2 AS (SELECT *, '[Context: ' || context_summary || ']' || chr(10) || chr(10) || text AS contextual_text FROM ctx)"""


@query("contextual_text", _CTX + " SELECT doc_id, section, chunk_index, context_summary, contextual_text FROM ctx2")
def contextual_text(spark, d):
    return _contextual(spark, d).select("doc_id", "section", "chunk_index", "context_summary", "contextual_text")


@query("truncate_words", r"SELECT doc_id, CASE WHEN length(text) > 400 THEN regexp_replace(left(text, 400), '(?s) [^ ]*$', '') ELSE text END AS text FROM documents")
def truncate_words(spark, d):
    return table(spark, d, "documents").select("doc_id", C.truncate_words(F.col("text")).alias("text"))


@query("chunk_id", W + ", " + _FLAT + """ SELECT doc_id, section, chunk_index, ticker || '_' || left(md5(ticker || '_' || CAST(doc_id AS VARCHAR) || '_' || CAST(chunk_index AS VARCHAR) || '_' || left(text, 100)), 8)
 || '_' || CAST(chunk_index AS VARCHAR) AS chunk_id FROM flat""")
def chunk_id(spark, d):
    flat = C.chunk_flat(filings(spark, d))
    return flat.select("doc_id", "section", "chunk_index", C.chunk_id(F.col("ticker"), F.col("doc_id"), F.col("chunk_index"), F.col("text")).alias("chunk_id"))


@query("ingest_summary", _CTX + " SELECT ticker, count(*) AS chunks, count(*) AS contextualised, count(DISTINCT doc_id) AS documents FROM ctx2 GROUP BY ticker")
def ingest_summary(spark, d):
    return C.ingest_summary(_contextual(spark, d))
