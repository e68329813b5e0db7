"""Suggestions, sessions, cache and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..operators import graph as K
from ..operators import sessions as M
from ..session import materialize
from ..sources.tables import table
from .inputs import FILINGS, REQ, filings, requests, sql_text
from .questions import set_sql
from .registry import query

W = "WITH " + REQ
_NORM = f"regexp_replace(regexp_replace(query, {sql_text(fixed.NORMALIZED_COMPANIES)}, '[COMPANY]', 'g'), {sql_text(fixed.NORMALIZED_YEARS)}, '[YEAR]', 'g')"
_NORM = rf"regexp_replace({_NORM}, '^\s+|\s+$', '', 'g')"
POPULAR = W + f", pp AS (SELECT {_NORM} AS pattern, count(*) AS n, min(event_id) AS first_pos FROM req GROUP BY 1 ORDER BY n DESC, first_pos LIMIT 10)"


def _history(spark, d):
    return requests(spark, d).select(F.col("event_id").alias("pos"), "query")


@query("normalize_query", W + f" SELECT event_id, {_NORM} AS pattern FROM req")
def normalize_query(spark, d):
    return requests(spark, d).select("event_id", M.normalize_query(F.col("query")).alias("pattern"))


@query("popular_patterns", POPULAR + " SELECT * FROM pp")
def popular_patterns(spark, d):
    return M.popular_patterns(_history(spark, d))


@query("suggest", POPULAR + """, sn AS (SELECT DISTINCT source AS name FROM documents ORDER BY name LIMIT 3),
e AS (SELECT pattern AS query, 'popular' AS source, n AS count, 0 AS kind, -n AS a, '' AS b, first_pos AS c FROM pp
  UNION ALL SELECT replace(t, '{}', name), 'document', 0, 1, 0, name, i FROM sn, (VALUES """ + ", ".join(f"({sql_text(t)}, {i})" for i, t in enumerate(fixed.SOURCE_SUGGESTIONS)) + """) s(t, i)
  UNION ALL SELECT t, 'default', 0, 2, i, '', 0 FROM (VALUES """ + ", ".join(f"({sql_text(t)}, {i})" for i, t in enumerate(fixed.DEFAULT_SUGGESTIONS)) + """) s(t, i))
SELECT query, source, count FROM e ORDER BY kind, a, b, c LIMIT 22""")
def suggest(spark, d):
    return M.suggest(_history(spark, d), table(spark, d, "documents").select(F.col("source").alias("name")), limit=22)


@query("related_queries", W + f""", h AS (SELECT query, min(event_id) AS hid FROM req GROUP BY query), w AS (SELECT *, {set_sql('query')} AS ws FROM h),
p AS (SELECT a.hid AS qid, b.hid, b.query, len(list_intersect(a.ws, b.ws)) AS i, len(a.ws) + len(b.ws) AS s FROM w a JOIN w b ON lower(a.query) <> lower(b.query)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hid) AS rank FROM p WHERE i / (s - i) > 0.3)
SELECT qid, rank, query AS related FROM r WHERE rank <= 3""")
def related_queries(spark, d):
    asked = requests(spark, d).groupBy("query").agg(F.min("event_id").alias("qid"))
    return M.related_queries(asked, _history(spark, d))


@query("session_history", "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5")
def session_history(spark, d):
    return M.session_history(table(spark, d, "conversations")).select("conv_id", "turn", "role", "text")


@query("session_context", """SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || left(text, 200), chr(10) ORDER BY turn) AS context
FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5) GROUP BY conv_id""")
def session_context(spark, d):
    return M.session_context(table(spark, d, "conversations"))


NOW = 1_700_000_000


def _entries(spark, d):
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        v.alias("entry_id"), F.concat(F.lit("topic "), F.col("label").cast("string"), F.lit(" item "), (v % 20).cast("string")).alias("query"),
        "embedding", (F.lit(NOW) - v * 7919 % 172800).alias("ts_s"), F.concat(F.lit("reply "), v.cast("string")).alias("response"))


def _lookups(spark, d):
    """One lookup per passage; every third vector is turned round so that only its text can match."""
    e = table(spark, d, "embeddings").join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id")
    turned = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.col("vec_id") % 3 == 0, -x).otherwise(x))
    return e.select(F.col("vec_id").alias("qid"), turned.alias("embedding"),
                    F.concat(F.lit("topic "), F.col("label").cast("string"), F.lit(" item "), (F.col("vec_id") % 20).cast("string")).alias("query"))


CACHE = f"""en AS (SELECT vec_id AS entry_id, 'topic ' || CAST(label AS VARCHAR) || ' item ' || CAST(vec_id % 20 AS VARCHAR) AS query, CAST(embedding AS DOUBLE[]) AS v, {NOW} - vec_id * 7919 % 172800 AS ts_s, 'reply ' || CAST(vec_id AS VARCHAR) AS response FROM embeddings),
lk AS (SELECT vec_id AS qid, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN vec_id % 3 = 0 THEN -x ELSE x END) AS q, 'topic ' || CAST(label AS VARCHAR) || ' item ' || CAST(vec_id % 20 AS VARCHAR) AS query FROM embeddings JOIN benchmark ON item_id = vec_id),
lv AS (SELECT * FROM en WHERE {NOW} - ts_s < 86400),
nr AS (SELECT qid, entry_id, round(list_cosine_similarity(v, q), 9) AS score FROM lk, lv QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(v, q), 9) DESC, entry_id) = 1),
tx AS (SELECT query, min(entry_id) AS text_id FROM lv GROUP BY query),
oc AS (SELECT lk.qid, CASE WHEN nr.entry_id IS NOT NULL THEN 'semantic' WHEN text_id IS NOT NULL THEN 'exact' ELSE 'miss' END AS outcome, coalesce(nr.entry_id, text_id) AS entry_id, round(score, 6) AS score
  FROM lk LEFT JOIN nr ON nr.qid = lk.qid AND score >= 0.92 LEFT JOIN tx USING (query))"""


@query("semantic_lookup", "WITH " + CACHE + " SELECT qid, outcome, entry_id, score, response FROM oc LEFT JOIN lv USING (entry_id)")
def semantic_lookup(spark, d):
    out = M.semantic_lookup(_lookups(spark, d), _entries(spark, d), F.lit(NOW))
    return out.select("qid", "outcome", "entry_id", T.rounded(F.col("score"), 6).alias("score"), "response")


def _timed_lookups(spark, d) -> DataFrame:
    """A lookup for every vector, at a time of its own over two days; every third is turned round, every fifth is as late as an entry."""
    v = F.col("vec_id")
    turned = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(v % 3 == 0, -x).otherwise(x))
    at = F.when(v % 5 == 0, F.lit(NOW) - v * 7919 % 172800).otherwise(F.lit(NOW) - v * 5003 % 172800)
    return table(spark, d, "embeddings").select(
        v.alias("qid"), turned.alias("embedding"), at.alias("ts_s"),
        F.concat(F.lit("topic "), F.col("label").cast("string"), F.lit(" item "), (v % 20).cast("string")).alias("query"))


@query("semantic_lookup_in_time", f"""WITH en AS (SELECT *, row_number() OVER (ORDER BY ts_s, entry_id) AS no FROM (
  SELECT vec_id AS entry_id, 'topic ' || CAST(label AS VARCHAR) || ' item ' || CAST(vec_id % 20 AS VARCHAR) AS query, CAST(embedding AS DOUBLE[]) AS v, {NOW} - vec_id * 7919 % 172800 AS ts_s, 'reply ' || CAST(vec_id AS VARCHAR) AS response FROM embeddings)),
lk AS (SELECT vec_id AS qid, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN vec_id % 3 = 0 THEN -x ELSE x END) AS q, 'topic ' || CAST(label AS VARCHAR) || ' item ' || CAST(vec_id % 20 AS VARCHAR) AS query,
  CASE WHEN vec_id % 5 = 0 THEN {NOW} - vec_id * 7919 % 172800 ELSE {NOW} - vec_id * 5003 % 172800 END AS asked_at FROM embeddings),
put AS (SELECT qid, count(entry_id) AS upto FROM lk LEFT JOIN en ON ts_s < asked_at GROUP BY qid),
sn AS (SELECT qid, entry_id, no, en.query = lk.query AS alike, round(list_cosine_similarity(v, q), 9) AS score FROM lk JOIN put USING (qid) JOIN en ON no <= upto AND no > upto - 100 AND asked_at - ts_s < 86400),
b AS (SELECT qid, count(*) AS n_seen, arg_min(entry_id, {{'s': -score, 'n': no}}) AS near_id, max(score) AS score, arg_min(entry_id, no) FILTER (alike) AS text_id FROM sn GROUP BY qid),
oc AS (SELECT qid, CASE WHEN score >= 0.92 THEN 'semantic' WHEN text_id IS NOT NULL THEN 'exact' ELSE 'miss' END AS outcome, CASE WHEN score >= 0.92 THEN near_id ELSE text_id END AS entry_id,
  CASE WHEN score >= 0.92 THEN round(score, 6) END AS score, coalesce(n_seen, 0) AS n_seen FROM lk LEFT JOIN b USING (qid))
SELECT qid, outcome, entry_id, score, n_seen, response FROM oc LEFT JOIN en USING (entry_id)""")
def semantic_lookup_in_time(spark, d):
    """Lookups and entries interleave; the cache holds a hundred entries."""
    out = M.lookup_in_time(_timed_lookups(spark, d), _entries(spark, d), max_entries=100, block=64)
    return out.select("qid", "outcome", "entry_id", T.rounded(F.col("score"), 6).alias("score"), "n_seen", "response")


@query("cache_evict", "WITH " + CACHE + " SELECT entry_id, ts_s FROM lv ORDER BY ts_s DESC, entry_id DESC LIMIT 1000")
def cache_evict(spark, d):
    return M.cache_evict(_entries(spark, d), F.lit(NOW)).select("entry_id", "ts_s")


@query("cache_stats", "WITH " + CACHE + " SELECT count(*) FILTER (outcome <> 'miss') AS hits, count(*) FILTER (outcome = 'miss') AS misses, round(count(*) FILTER (outcome <> 'miss') / count(*), 4) AS hit_rate, (SELECT count(*) FROM en) AS entries FROM oc")
def cache_stats(spark, d):
    entries = _entries(spark, d)
    return M.cache_stats(M.semantic_lookup(_lookups(spark, d), entries, F.lit(NOW)), entries)


# --- graph ------------------------------------------------------------------------------------------

S = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_ENT = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS p, unnest(range(len(z))) AS i, {S.format('unnest(z)')} AS name, '{kind}' AS type FROM (SELECT doc_id, regexp_extract_all(text, {sql_text(pattern)}) AS z FROM filings)"
    for i, (pattern, kind) in enumerate(fixed.ENTITY_PATTERNS))
ENTITIES = f"ea AS ({_ENT}), en AS (SELECT doc_id, type, arg_min(name, p * 1000000 + i) AS name FROM ea GROUP BY doc_id, type, lower(name))"


def _triple_sql(i: int, predicate: str, confidence: float, pattern: str) -> str:
    g = [f"regexp_extract_all(text, {sql_text(pattern)}, {n})" for n in (1, 2, 3)]
    if predicate in ("REPORTED_REVENUE", "NET_INCOME"):
        z, obj = f"list_zip({g[0]}, {g[1]}, {g[2]})", "'$' || t[2] || ' ' || t[3]"
    else:
        z, obj = f"list_zip({g[0]}, {g[1]})", "t[2]"
    return (f"SELECT doc_id, {i} AS p, i, {S.format('t[1]')} AS subject, '{predicate}' AS predicate, {S.format(obj)} AS object, CAST({confidence} AS DOUBLE) AS confidence "
            f"FROM (SELECT doc_id, unnest(z) AS t, unnest(range(len(z))) AS i FROM (SELECT doc_id, {z} AS z FROM filings))")


TRIPLES = "tr AS (" + " UNION ALL ".join(_triple_sql(i, *t) for i, t in enumerate(fixed.TRIPLE_PATTERNS)) + ")"
GRAPH = "ge AS (SELECT subject, object, arg_max(predicate, doc_id * 100000000 + p * 1000000 + i) AS predicate, arg_max(confidence, doc_id * 100000000 + p * 1000000 + i) AS confidence FROM tr GROUP BY subject, object)"


@query("extract_entities", "WITH " + FILINGS + ", " + ENTITIES + " SELECT * FROM en")
def extract_entities(spark, d):
    return K.extract_entities(filings(spark, d)).select("doc_id", "type", "name")


@query("extract_triples", "WITH " + FILINGS + ", " + TRIPLES + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, i) - 1 AS pos, subject, predicate, object, confidence FROM tr")
def extract_triples(spark, d):
    return K.extract_triples(filings(spark, d))


@query("build_graph", "WITH " + FILINGS + ", " + TRIPLES + ", " + GRAPH + " SELECT * FROM ge")
def build_graph(spark, d):
    return K.build_graph(K.extract_triples(filings(spark, d)))


@query("graph_io", "WITH " + FILINGS + ", " + ENTITIES + ", " + TRIPLES + ", " + GRAPH + " SELECT (SELECT count(*) FROM en) AS entities, (SELECT count(*) FROM tr) AS triples, (SELECT count(*) FROM (SELECT subject FROM ge UNION SELECT object FROM ge)) AS graph_nodes, (SELECT count(*) FROM ge) AS graph_edges")
def graph_io(spark, d):
    docs = filings(spark, d)
    triples = materialize(K.extract_triples(docs), "triples")
    stored = K.load_graph(spark, K.save_graph(K.build_graph(triples)))
    return K.build_summary(K.extract_entities(docs), triples, *stored)


def _trade_edges(spark, d):
    """Who supplies what and where: supplier to part, supplier to nation, nation to region."""

    def edges(df, subject, predicate, obj):
        return df.select(subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"), F.lit(1.0).alias("confidence")).distinct()

    def tag(t, c):
        return F.concat(F.lit(t), F.col(c).cast("string"))

    return (
        edges(table(spark, d, "lineitem"), tag("S", "l_suppkey"), "SUPPLIES", tag("P", "l_partkey"))
        .unionByName(edges(table(spark, d, "supplier"), tag("S", "s_suppkey"), "LOCATED_IN", tag("N", "s_nationkey")))
        .unionByName(edges(table(spark, d, "nation"), tag("N", "n_nationkey"), "PART_OF", tag("R", "n_regionkey")))
    )


TRADE = """te AS (SELECT DISTINCT 'S' || CAST(l_suppkey AS VARCHAR) AS subject, 'SUPPLIES' AS predicate, 'P' || CAST(l_partkey AS VARCHAR) AS object FROM lineitem
  UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'LOCATED_IN', 'N' || CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'PART_OF', 'R' || CAST(n_regionkey AS VARCHAR) FROM nation)"""
TRADE_NEXT = TRADE + """, es AS (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS entity FROM nation UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier UNION ALL SELECT 'X' || CAST(r_regionkey AS VARCHAR) FROM region),
nb AS (SELECT entity, 'outgoing' AS direction, predicate AS relation, object AS other FROM te JOIN es ON subject = entity UNION ALL SELECT entity, 'incoming', predicate, subject FROM te JOIN es ON object = entity)"""


def _asked_entities(spark, d):
    """Nations, suppliers, and names the graph does not know."""

    def names(t, c, tag):
        return table(spark, d, t).select(F.concat(F.lit(tag), F.col(c).cast("string")).alias("entity"))

    return names("nation", "n_nationkey", "N").union(names("supplier", "s_suppkey", "S")).union(names("region", "r_regionkey", "X"))


@query("query_entity", "WITH " + TRADE_NEXT + " SELECT * FROM nb")
def query_entity(spark, d):
    return K.query_entity(_trade_edges(spark, d), _asked_entities(spark, d)).drop("confidence")


@query("query_entity_hops", "WITH RECURSIVE " + TRADE + """, ln AS (SELECT subject AS a, object AS b FROM te UNION SELECT object, subject FROM te),
h AS (SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS entity, 'R' || CAST(r_regionkey AS VARCHAR) AS node, 0 AS hops FROM region
  UNION SELECT entity, b, hops + 1 FROM h JOIN ln ON a = node WHERE hops < 2)
SELECT entity, node, min(hops) AS hops FROM h GROUP BY entity, node""")
def query_entity_hops(spark, d):
    regions = table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("entity"))
    return K.within_hops(_trade_edges(spark, d), regions, 2)


@query("entity_context", "WITH " + TRADE_NEXT + """, k AS (SELECT DISTINCT entity AS known FROM nb)
SELECT entity, 0 AS part, '' AS other, CASE WHEN known IS NULL THEN 'No information found for ' ELSE 'Entity: ' END || entity AS line FROM es LEFT JOIN k ON entity = known
UNION ALL SELECT entity, CASE WHEN direction = 'outgoing' THEN 1 ELSE 2 END, other, '  - ' || relation || ' -> ' || other FROM nb""")
def entity_context(spark, d):
    return K.entity_context(_trade_edges(spark, d), _asked_entities(spark, d))


@query("graph_stats", "WITH RECURSIVE " + FILINGS + ", " + TRIPLES + """, te AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) || subject AS subject, CAST(doc_id // 3 AS VARCHAR) || object AS object FROM tr),
nd AS (SELECT subject AS node FROM te UNION SELECT object FROM te), ln AS (SELECT subject AS a, object AS b FROM te UNION SELECT object, subject FROM te),
cc AS (SELECT node, node AS c FROM nd UNION SELECT b, c FROM cc JOIN ln ON a = node), lb AS (SELECT node, min(c) AS c FROM cc GROUP BY node)
SELECT (SELECT count(*) FROM nd) AS nodes, count(DISTINCT c) AS connected_components, (SELECT count(*) FROM te) AS edges,
  round((SELECT count(*) FROM te) / ((SELECT count(*) FROM nd) * ((SELECT count(*) FROM nd) - 1)), 9) AS density FROM lb""")
def graph_stats(spark, d):
    """Statements of the filings, with names told apart by document so that many parts remain."""
    t = K.extract_triples(filings(spark, d))
    edges = t.select(F.concat(F.col("doc_id").cast("string"), "subject").alias("subject"), F.concat(F.floor(F.col("doc_id") / 3).cast("string"), "object").alias("object")).distinct()
    return K.graph_stats(materialize(edges, "graph-edges"))
