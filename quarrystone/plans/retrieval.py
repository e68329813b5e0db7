"""Sparse, dense and fused rankings, access filters, and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions import vectors as V
from ..operators import access, cells, dense, evaluation, fusion, hybrid, sparse
from ..session import materialize
from ..sources.tables import table
from .content import MARKDOWN, MD
from .inputs import choose, filings, sql_list, sql_text
from .registry import query

_INDEXES: dict[tuple[str, str], sparse.SparseIndex] = {}


def corpus_index(spark: SparkSession, d: str) -> sparse.SparseIndex:
    """The stored index of a folder, built on first use in a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = sparse.build_index(table(spark, d, "documents"))
    return _INDEXES[key]


def passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def passage_hits(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return sparse.search(passages(spark, d), corpus_index(spark, d), k)


def stem_sql(w: str) -> str:
    ends = " OR ".join(f"suffix({w}, '{e}')" for e in fixed.UNSTEMMED_ENDINGS)
    rules = " ".join(
        f"WHEN suffix({w}, '{s}') AND length({w}) - {len(s)} >= 3 THEN left({w}, length({w}) - {len(s)})" + (f" || '{r}'" if r else "")
        for s, r in fixed.SUFFIX_RULES
    )
    return f"CASE WHEN length({w}) <= 3 OR {ends} THEN {w} {rules} ELSE {w} END"


def terms_sql(source: str, key: str, text: str = "text") -> str:
    stop = ", ".join(sql_text(w) for w in fixed.STOP_WORDS)
    return f"""(SELECT {key}, {stem_sql('w')} AS term FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {source})
      WHERE length(w) > 1 AND w NOT IN ({stop}))"""


INDEX = f"""dt AS (SELECT doc_id, term, count(*) AS tf FROM {terms_sql('documents', 'doc_id')} GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM dt GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS avgdl),
tr AS (SELECT term, count(*) AS df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM dt, st GROUP BY term),
ts AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM tr) ELSE raw END AS idf FROM tr)"""
BM25 = "WITH " + INDEX + f""", qt AS (SELECT item_id AS qid, term, count(*) AS qtf FROM {terms_sql('benchmark', 'item_id')} GROUP BY ALL),
bs AS (SELECT qid, doc_id, round(sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN ts USING (term) JOIN dt USING (term) JOIN dl USING (doc_id), st GROUP BY qid, doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bs WHERE score > 0)"""


@query("tokenize", f"SELECT doc_id, term, count(*) AS tf FROM {terms_sql('documents', 'doc_id')} GROUP BY ALL")
def tokenize(spark, d):
    return sparse.postings(table(spark, d, "documents")).select("doc_id", "term", "tf")


@query("stem", f"SELECT w AS token, {stem_sql('w')} AS stem FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)")
def stem(spark, d):
    words = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return T.stemmed(words, "token", "stem")


@query("bm25_index", "WITH " + INDEX + " SELECT term, df, round(idf, 6) AS idf FROM ts")
def bm25_index(spark, d):
    index = sparse.build_index(table(spark, d, "documents"))
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_search", BM25 + " SELECT qid, doc_id, score, rank FROM bm WHERE rank <= 10")
def bm25_search(spark, d):
    return passage_hits(spark, d)


@query("bm25_search_bounded", BM25 + " SELECT qid, doc_id, score, rank FROM bm WHERE rank <= 10")
def bm25_search_bounded(spark, d):
    """The same rows; common terms are looked up only for documents that they could lift."""
    index = corpus_index(spark, d)
    hits, _ = sparse.bounded_search(passages(spark, d), index, sparse.term_bounds(index), 10)
    return hits


# --- dense ----------------------------------------------------------------------------------


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def _centroid_queries(spark, d) -> DataFrame:
    return dense.centroids(_vectors(spark, d), "label").withColumnRenamed("label", "qid")


CENT = """c AS (SELECT label AS qid, list(x ORDER BY pos) AS q FROM (SELECT label, pos, avg(x) AS x FROM (
  SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)"""


@query("cosine", "WITH " + CENT + " SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS cosine FROM embeddings JOIN c ON qid = label")
def cosine(spark, d):
    joined = _vectors(spark, d).join(_centroid_queries(spark, d).select(F.col("qid").alias("label"), F.col("embedding").alias("q")), "label")
    return joined.select("vec_id", F.round(V.cosine(V.as_double(F.col("embedding")), F.col("q")), 6).alias("cosine"))


@query("l2_normalize", """WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM n)
SELECT vec_id, pos, round(x, 9) AS x FROM (SELECT vec_id, unnest(u) AS x, unnest(range(len(u))) AS pos FROM m)""")
def l2_normalize(spark, d):
    unit = _vectors(spark, d).select("vec_id", F.posexplode(V.normalized(V.as_double(F.col("embedding")))).alias("pos", "x"))
    return unit.select("vec_id", "pos", F.round("x", 9).alias("x"))


NEAR = """SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT qid, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 9) AS score FROM {c}, {v})"""


@query("vector_topk", "WITH " + CENT + ", r AS (" + NEAR.format(c="c", v="embeddings") + ") SELECT qid, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def vector_topk(spark, d):
    hits = dense.nearest(_centroid_queries(spark, d), _vectors(spark, d), 10)
    return hits.withColumn("score", T.rounded(F.col("score"), 6))


@query("vector_index_search", "WITH " + CENT + ", r AS (" + NEAR.format(c="c", v="embeddings") + ") SELECT qid, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def vector_index_search(spark, d):
    """The same rows from a stored index that is written first and then loaded again."""
    path = cells.build_index(_vectors(spark, d), rows=100).path
    hits, _ = cells.search(_centroid_queries(spark, d), cells.VectorIndex.load(spark, path), 10)
    return hits.withColumn("score", T.rounded(F.col("score"), 6))


LANGS = ("en", "fr", "de", "es")


@query("vector_topk_filtered", "WITH " + CENT + ", v AS (SELECT vec_id, embedding, lang, source FROM embeddings LEFT JOIN documents ON doc_id = vec_id), r AS (" + NEAR.format(
    c="c", v=f"v WHERE (qid % 2 = 0 OR lang = ({sql_list(LANGS)})[qid % 4 + 1]) AND (qid % 3 <> 1 OR source = 'src' || (qid % 20))") + ") SELECT qid, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def vector_topk_filtered(spark, d):
    """Queries with a language, a source, both, or no filter; vectors without a document have neither."""
    parts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    queries = _centroid_queries(spark, d).withColumns({
        "lang": F.when(F.col("qid") % 2 == 1, choose(F.col("qid") % 4, LANGS)), "source": F.when(F.col("qid") % 3 == 1, F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")))})
    hits = dense.nearest(queries, _vectors(spark, d).join(parts, "vec_id", "left"), 10)
    return hits.withColumn("score", T.rounded(F.col("score"), 6))


PASSAGE_VECTORS = "pv AS (SELECT item_id AS qid, CAST(e.embedding AS DOUBLE[]) AS q FROM benchmark JOIN embeddings e ON vec_id = item_id)"
DOC_VECTORS = "dv AS (SELECT vec_id, embedding FROM embeddings SEMI JOIN documents ON doc_id = vec_id)"


def _passage_vectors(spark, d) -> DataFrame:
    return _vectors(spark, d).select(F.col("vec_id").alias("qid"), "embedding").join(passages(spark, d).select("qid"), "qid")


def _doc_vectors(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    return _vectors(spark, d).join(docs, "vec_id", "left_semi")


@query("image_text_search", "WITH " + PASSAGE_VECTORS + ", r AS (" + NEAR.format(c="pv", v="embeddings") + ") SELECT qid, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def image_text_search(spark, d):
    hits = dense.nearest(_passage_vectors(spark, d), _vectors(spark, d), 5)
    return hits.withColumn("score", T.rounded(F.col("score"), 6))


@query("embedding_write", """SELECT vec_id, coalesce(source, 'UNKNOWN') AS ticker, coalesce(lang, 'UNKNOWN') AS year, 'unknown' AS section, '' AS source, coalesce(n_chars, vec_id) AS chunk_index, len(embedding) AS dims
FROM embeddings LEFT JOIN documents ON doc_id = vec_id""")
def embedding_write(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("vec_id"), F.col("source").alias("ticker"), F.col("lang").alias("year"), F.col("n_chars").alias("chunk_index"))
    chunks = _vectors(spark, d).join(docs, "vec_id", "left").withColumn("section", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    stored = materialize(dense.with_defaults(chunks), "vectors")
    return stored.select("vec_id", "ticker", "year", "section", "source", "chunk_index", F.size("embedding").alias("dims"))


# --- fusion ----------------------------------------------------------------------------------


def _ranked_lists(spark, d, k: int) -> DataFrame:
    """Dense (list 0) and sparse (list 1) rankings of the passages, with the text of each hit."""
    near = dense.nearest(_passage_vectors(spark, d), _doc_vectors(spark, d), k).select("qid", F.col("vec_id").alias("doc_id"), "score", "rank", F.lit(0).alias("list_no"))
    both = near.unionByName(passage_hits(spark, d, k).withColumn("list_no", F.lit(1)).select("qid", "doc_id", "score", "rank", "list_no"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return both.join(docs, "doc_id").select("qid", "list_no", (F.col("rank") - 1).alias("pos"), "doc_id", "score", "text")


_KEY = r"left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 500)"


def lists_sql(k: int, where: str = "true") -> str:
    return BM25 + ", " + PASSAGE_VECTORS + ", " + DOC_VECTORS + ", nr AS (" + NEAR.format(c="pv", v=f"dv WHERE {where}") + f"""),
ls AS (SELECT qid, 0 AS list_no, rank - 1 AS pos, vec_id AS doc_id, score FROM nr WHERE rank <= {k} UNION ALL SELECT qid, 1, rank - 1, doc_id, score FROM bm WHERE rank <= {k}),
lt AS (SELECT ls.*, {_KEY} AS key FROM ls JOIN documents USING (doc_id))"""


def fuse_sql(part: str, shown: str, k: int, top: int, where: str = "true") -> str:
    return lists_sql(k, where) + f""", fp AS (SELECT qid, key, list_no, pos, doc_id, {part} AS part, {shown} AS shown FROM (SELECT *, max(score) OVER (PARTITION BY qid, list_no) AS best FROM lt)),
fk AS (SELECT qid, key, list_no, sum(part) AS part, arg_max(shown, pos) AS shown, min(pos) AS pos, arg_min(doc_id, pos) AS doc_id FROM fp GROUP BY ALL),
fu AS (SELECT qid, key AS text, round(sum(part), 12) AS score, min(list_no * 1000000 + pos) AS seen, arg_min(doc_id, list_no * 1000000 + pos) AS doc_id,
  max(CASE WHEN list_no = 0 THEN shown END) AS s0, max(CASE WHEN list_no = 1 THEN shown END) AS s1 FROM fk GROUP BY qid, key),
fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS rank FROM fu)
SELECT qid, rank, doc_id, text, round(score, 6) AS score, round(s0, 6) AS list_0, round(s1, 6) AS list_1 FROM fr WHERE rank <= {top}"""


def _fused_view(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", "doc_id", "text", F.round("score", 6).alias("score"),
                     *[F.round(F.try_element_at("source_scores", F.lit(f"list_{i}")), 6).alias(f"list_{i}") for i in (0, 1)])


_RRF = "CAST(1.0 AS DOUBLE) / (60 + pos + 1)"


@query("rrf_fusion", fuse_sql(_RRF, _RRF, 20, 20))
def rrf_fusion(spark, d):
    return _fused_view(fusion.rrf_fusion(_ranked_lists(spark, d, 20), ["doc_id"]))


_SCALED = "score / CASE WHEN best = 0 THEN 1 ELSE best END"


@query("weighted_fusion", fuse_sql(f"{_SCALED} * CASE WHEN list_no = 0 THEN CAST(2.0 AS DOUBLE) / 5 ELSE CAST(3.0 AS DOUBLE) / 5 END", _SCALED, 20, 20))
def weighted_fusion(spark, d):
    return _fused_view(fusion.weighted_fusion(_ranked_lists(spark, d, 20), ["doc_id"], [2.0, 3.0]))


@query("hybrid_weighted", lists_sql(30) + """, a AS (SELECT qid, doc_id, score / max(score) OVER (PARTITION BY qid) AS s FROM ls WHERE list_no = 0),
b AS (SELECT qid, doc_id, score / max(score) OVER (PARTITION BY qid) AS s FROM ls WHERE list_no = 1),
f AS (SELECT qid, doc_id, coalesce(a.s, 0) AS v, coalesce(b.s, 0) AS b, round(0.6 * coalesce(a.s, 0) + 0.4 * coalesce(b.s, 0), 12) AS score FROM a FULL JOIN b USING (qid, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT qid, doc_id, round(v, 6) AS vector_score, round(b, 6) AS bm25_score, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def hybrid_weighted(spark, d):
    near = dense.nearest(_passage_vectors(spark, d), _doc_vectors(spark, d), 30).select("qid", F.col("vec_id").alias("doc_id"), "score")
    out = fusion.hybrid_weighted(near, passage_hits(spark, d, 30).select("qid", "doc_id", "score"))
    return out.select("qid", "doc_id", *[F.round(c, 6).alias(c) for c in ("vector_score", "bm25_score", "score")], "rank")


def _hybrid_questions(spark, d) -> DataFrame:
    """Passages that also name a company, a year, both or neither."""
    q = passages(spark, d).withColumn("query", F.concat(
        "query", F.when(F.col("qid") % 4 % 2 == 1, " Amazon").otherwise(""), F.when(F.col("qid") % 4 >= 2, " in 2021").otherwise("")))
    return q.join(_passage_vectors(spark, d), "qid")


def _hybrid(spark, d, **options) -> DataFrame:
    key = F.col("vec_id")
    vectors = _doc_vectors(spark, d).withColumns({"ticker": choose(key % 7, fixed.TICKERS), "year": (2020 + key % 5).cast("string")})
    found = hybrid.hybrid_retrieve(_hybrid_questions(spark, d), vectors, passage_hits(spark, d, 30), table(spark, d, "documents"), 10, **options)
    return found.select("qid", "rank", "doc_id", "text", F.round("fused_score", 6).alias("fused_score"), F.round("rerank_score", 6).alias("rerank_score"))


def hybrid_sql(part: str, shown: str, where: str) -> str:
    return f"SELECT qid, rank, doc_id, text, score AS fused_score, round(1 - (rank - 1) * 0.01, 6) AS rerank_score FROM ({fuse_sql(part, shown, 30, 10, where)})"


_NAMED = " ".join(f"WHEN {' OR '.join(f'contains(asked, {sql_text(w)})' for w in words)} THEN {sql_text(t)}" for t, words in fixed.FILTER_KEYWORDS)
# the company a question names, by the same keywords as anywhere in its text, and its year
_AGREES = f"""(SELECT coalesce(({sql_list(fixed.TICKERS)})[vec_id % 7 + 1] = CASE {_NAMED} END, true) AND coalesce(CAST(2020 + vec_id % 5 AS VARCHAR) = nullif(regexp_extract(asked, '\\b(20\\d{{2}})\\b', 1), ''), true)
  FROM (SELECT lower(text || CASE WHEN qid % 4 % 2 = 1 THEN ' Amazon' ELSE '' END || CASE WHEN qid % 4 >= 2 THEN ' in 2021' ELSE '' END) AS asked FROM benchmark WHERE item_id = qid))"""


@query("hybrid_retrieve", hybrid_sql(_RRF, _RRF, _AGREES))
def hybrid_retrieve(spark, d):
    return _hybrid(spark, d)


@query("hybrid_retrieve_unfiltered", hybrid_sql(f"{_SCALED} * CASE WHEN list_no = 0 THEN CAST(0.6 AS DOUBLE) / (CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE)) ELSE CAST(0.4 AS DOUBLE) / (CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE)) END", _SCALED, "true"))
def hybrid_retrieve_unfiltered(spark, d):
    """Without filters, fused by scaled scores."""
    return _hybrid(spark, d, use_filters=False, use_rrf=False)


_LEX = r"""list_distinct(list_filter(string_split_regex(lower({}), '\s+'), lambda w: w <> ''))"""


@query("rerank", BM25 + f""", p AS (SELECT bm.qid, bm.doc_id, bm.rank - 1 AS pos, {_LEX.format('b.text')} AS q, {_LEX.format('t.text')} AS w FROM bm JOIN benchmark b ON item_id = qid JOIN documents t USING (doc_id) WHERE bm.rank <= 30),
s AS (SELECT qid, doc_id, pos, len(list_intersect(q, w)) / len(q) AS rerank_score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, pos) AS rank FROM s)
SELECT qid, doc_id, rank, round(rerank_score, 6) AS rerank_score FROM r WHERE rank <= 5""")
def rerank(spark, d):
    hits = passage_hits(spark, d, 30).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").join(passages(spark, d), "qid")
    out = fusion.rerank(hits.select("qid", "doc_id", "query", "text", (F.col("rank") - 1).alias("pos")), fusion.lexical_scorer, 5)
    return out.select("qid", "doc_id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


@query("rerank_udf", BM25 + """, p AS (SELECT bm.qid, bm.doc_id, bm.rank - 1 AS pos, length(b.text) AS q, length(t.text) AS w FROM bm JOIN benchmark b ON item_id = qid JOIN documents t USING (doc_id) WHERE bm.rank <= 30),
r AS (SELECT *, q / (q + w) AS rerank_score, row_number() OVER (PARTITION BY qid ORDER BY q / (q + w) DESC, pos) AS rank FROM p)
SELECT qid, doc_id, rank, round(rerank_score, 6) AS rerank_score FROM r WHERE rank <= 5""")
def rerank_udf(spark, d):
    """The same with a batch scorer in Python, where a cross-encoder would go; this one compares lengths."""

    def load():
        def share(q, t):
            return (q.str.len() / (q.str.len() + t.str.len())).astype("float64")

        return share

    hits = passage_hits(spark, d, 30).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").join(passages(spark, d), "qid")
    out = fusion.rerank(hits.select("qid", "doc_id", "query", "text", (F.col("rank") - 1).alias("pos")), fusion.pair_scorer(load), 5)
    return out.select("qid", "doc_id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


@query("dedupe_best", lists_sql(5).replace(_KEY + " AS key", "left(text, 200) AS key") + """, k AS (SELECT qid, key, round(max(score), 6) AS score, min(list_no * 1000000 + pos) AS seq, arg_max(doc_id, {'s': score, 'p': -(list_no * 1000000 + pos)}) AS doc_id FROM lt GROUP BY qid, key),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM k) SELECT qid, rank, score, doc_id FROM r WHERE rank <= 5""")
def dedupe_best(spark, d):
    hits = _ranked_lists(spark, d, 5).withColumn("score", F.round("score", 6)).withColumn("seq", F.col("list_no") * 1000000 + F.col("pos"))
    return fusion.dedupe_best(hits.select("qid", "seq", "doc_id", "text", "score")).select("qid", "rank", "score", "doc_id")


# --- access ----------------------------------------------------------------------------------


def tenants(spark, d) -> DataFrame:
    key = F.col("n_nationkey")
    names = F.array(*[F.lit(t) for t in fixed.TICKERS])
    allowed = F.slice(names, (key % 7 + 1).cast("int"), (key % 4).cast("int"))
    return table(spark, d, "nation").select(
        key.alias("tenant_id"), F.when(key % 6 == 0, "admin").when(key % 6 == 1, "analyst").otherwise("tenant").alias("role"),
        F.when(key % 2 == 1, F.transform(allowed, F.lower)).otherwise(allowed).alias("allowed_tickers"))


TENANTS = f"""tn AS (SELECT n_nationkey AS tenant_id, CASE WHEN n_nationkey % 6 = 0 THEN 'admin' WHEN n_nationkey % 6 = 1 THEN 'analyst' ELSE 'tenant' END AS role,
  list_slice({sql_list(fixed.TICKERS)}, n_nationkey % 7 + 1, n_nationkey % 7 + n_nationkey % 4) AS allowed FROM nation)"""


def permissions(spark, d) -> DataFrame:
    key = F.col("r_regionkey")
    roles = F.when(key % 3 == 1, F.array(F.lit("analyst"))).when(key % 3 == 2, F.array(F.lit("analyst"), F.lit("tenant"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "region").select(choose(key, fixed.TICKERS).alias("ticker"), roles.alias("roles"))


PERMS = f"""pm AS (SELECT ({sql_list(fixed.TICKERS)})[r_regionkey + 1] AS ticker, CASE WHEN r_regionkey % 3 = 1 THEN ['analyst'] WHEN r_regionkey % 3 = 2 THEN ['analyst', 'tenant'] ELSE [] END AS roles FROM region)"""


def _asked_hits(spark, d) -> DataFrame:
    """Hits with a ticker and the asking tenant; tenants from 25 on are unknown."""
    return passage_hits(spark, d).select("qid", "doc_id", "rank", choose(F.col("doc_id") % 7, fixed.TICKERS).alias("ticker"), (F.col("qid") % 30).alias("tenant_id"))


ASKED = BM25 + ", " + TENANTS + ", " + PERMS + f", ah AS (SELECT qid, doc_id, rank, ({sql_list(fixed.TICKERS)})[doc_id % 7 + 1] AS ticker, qid % 30 AS tenant_id FROM bm WHERE rank <= 10)"


@query("rbac_filter", ASKED + """ SELECT qid, doc_id, rank, ah.ticker, role FROM ah JOIN tn USING (tenant_id) LEFT JOIN pm USING (ticker)
WHERE role = 'admin' OR coalesce(len(roles), 0) = 0 OR list_contains(roles, role)""")
def rbac_filter(spark, d):
    hits = _asked_hits(spark, d).join(tenants(spark, d).select("tenant_id", "role"), "tenant_id")
    return access.rbac_filter(hits, permissions(spark, d)).select("qid", "doc_id", "rank", "ticker", "role")


@query("tenant_filter", ASKED + " SELECT qid, doc_id, rank, ticker, tenant_id FROM ah JOIN tn USING (tenant_id) WHERE role = 'admin' OR list_contains(allowed, ticker)")
def tenant_filter(spark, d):
    return access.tenant_filter(_asked_hits(spark, d), tenants(spark, d)).select("qid", "doc_id", "rank", "ticker", "tenant_id")


@query("tenant_rbac_filter", ASKED + " SELECT qid, doc_id, rank, ticker, role FROM ah JOIN tn USING (tenant_id) WHERE role = 'admin' OR list_contains(allowed, ticker)")
def tenant_rbac_filter(spark, d):
    hits = _asked_hits(spark, d).withColumn("role", F.lit("tenant"))
    return access.tenant_rbac_filter(hits, tenants(spark, d), permissions(spark, d)).select("qid", "doc_id", "rank", "ticker", "role")


def _contexts(spark, d) -> DataFrame:
    hits = passage_hits(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select(
        "qid", (F.col("rank") - 1).alias("pos"), choose(F.col("doc_id") % 7, fixed.TICKERS).alias("ticker"), (F.lit(2020) + F.col("doc_id") % 5).alias("year"), "text")
    return fusion.build_context(hits)


CONTEXTS = ASKED + """, cx AS (SELECT qid, string_agg('[' || ticker || ' ' || CAST(2020 + doc_id % 5 AS VARCHAR) || '] ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM ah JOIN documents USING (doc_id) GROUP BY qid)"""


@query("build_context", BM25 + ", " + MD.removeprefix("WITH ") + f""", hf AS (SELECT qid, rank, doc_id, f.ticker, f.year, f.text FROM bm JOIN filings f USING (doc_id) WHERE rank <= 3 + qid % 8),
hb AS (SELECT qid, list('[' || ticker || ' ' || CAST(year AS VARCHAR) || '] ' || text ORDER BY rank) AS b FROM hf GROUP BY qid),
ht AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank, pos) AS n, md.ticker, md.year, headers, rows FROM hf JOIN md USING (doc_id)),
tx AS (SELECT qid, chr(10) || 'Structured Data:' || chr(10) || string_agg('Table ' || CAST(n AS VARCHAR) || ' [' || ticker || ' ' || CAST(year AS VARCHAR) || ']:' || chr(10) || {MARKDOWN}, chr(10) || chr(10) ORDER BY n) AS t FROM ht WHERE n <= 3 GROUP BY qid)
SELECT qid, array_to_string(list_slice(list_concat(b, CASE WHEN t IS NULL THEN [] ELSE [t] END), 1, 10), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS context FROM hb LEFT JOIN tx USING (qid)""")
def build_context(spark, d):
    """Three to ten filings a question; with ten there is no room for their tables."""
    asked = materialize(passage_hits(spark, d).where(F.col("rank") <= 3 + F.col("qid") % 8), "context-hits")
    hits = asked.join(filings(spark, d, asked.select("doc_id")), "doc_id").select("qid", (F.col("rank") - 1).alias("pos"), "ticker", "year", "text")
    return fusion.build_context(materialize(hits, "context-filings"))


@query("context_tenant_filter", CONTEXTS + r""" SELECT qid, CASE WHEN role = 'admin' THEN context WHEN len(allowed) > 0 THEN
  array_to_string(list_filter(string_split(context, chr(10) || chr(10)), lambda b: regexp_extract(b, '\[([A-Z]{2,5})\s+\d{4}\]', 1) = '' OR list_contains(allowed, regexp_extract(b, '\[([A-Z]{2,5})\s+\d{4}\]', 1))), chr(10) || chr(10))
  ELSE '' END AS context FROM cx LEFT JOIN tn ON tenant_id = qid % 30""")
def context_tenant_filter(spark, d):
    asked = _contexts(spark, d).withColumn("tenant_id", F.col("qid") % 30).join(tenants(spark, d), "tenant_id", "left")
    return asked.select("qid", access.context_tenant_filter(F.col("context"), F.col("role"), F.col("allowed_tickers")).alias("context"))


# --- ranking metrics -----------------------------------------------------------------------------


def _passage_lists(spark, d) -> DataFrame:
    qrels = evaluation.contained_passages(table(spark, d, "documents"), table(spark, d, "benchmark")).withColumnRenamed("item_id", "qid")
    return evaluation.relevance_lists(passage_hits(spark, d), qrels, passages(spark, d))


JUDGED = BM25 + """, qr AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents t ON contains(t.text, b.text) WHERE b.text <> ''),
nr AS (SELECT qid, count(*) AS n_rel FROM qr GROUP BY qid),
jl AS (SELECT b.item_id AS qid, bm.rank, CASE WHEN qr.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM benchmark b LEFT JOIN bm ON bm.qid = item_id AND rank <= 10 LEFT JOIN qr ON qr.qid = bm.qid AND qr.doc_id = bm.doc_id),
ir AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS irank FROM jl),
qm AS (SELECT qid, coalesce(1 / min(CASE WHEN rel = 1 THEN rank END), 0) AS mrr,
  coalesce(sum(CASE WHEN rank <= 5 THEN rel / log2(rank + 1) END) / nullif(sum(CASE WHEN irank <= 5 THEN rel / log2(irank + 1) END), 0), 0) AS ndcg_5,
  coalesce(sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) END) / nullif(sum(CASE WHEN irank <= 10 THEN rel / log2(irank + 1) END), 0), 0) AS ndcg_10,
  coalesce(sum(CASE WHEN rank <= 5 THEN rel END) / max(n_rel), 0) AS recall_5, coalesce(sum(CASE WHEN rank <= 10 THEN rel END) / max(n_rel), 0) AS recall_10,
  coalesce(sum(CASE WHEN rank <= 5 THEN rel END), 0) / 5 AS precision_5, coalesce(sum(CASE WHEN rank <= 10 THEN rel END), 0) / 10 AS precision_10,
  CAST(max(rel) AS DOUBLE) AS hit_rate FROM ir LEFT JOIN nr USING (qid) GROUP BY qid)"""


@query("contained_passages", "SELECT item_id, doc_id FROM benchmark b JOIN documents t ON contains(t.text, b.text) WHERE b.text <> ''")
def contained_passages(spark, d):
    return evaluation.contained_passages(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("ndcg", JUDGED + " SELECT qid, round(ndcg_5, 6) AS ndcg_5, round(ndcg_10, 6) AS ndcg_10 FROM qm")
def ndcg(spark, d):
    return evaluation.query_metrics(_passage_lists(spark, d)).select("qid", "ndcg_5", "ndcg_10")


@query("mrr", JUDGED + " SELECT round(avg(mrr), 6) AS mrr FROM qm")
def mrr(spark, d):
    return _passage_lists(spark, d).agg(F.round(F.avg(evaluation.reciprocal_rank(F.col("rels"))), 6).alias("mrr"))


@query("recall_at_k", JUDGED + " SELECT qid, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10 FROM qm")
def recall_at_k(spark, d):
    return evaluation.query_metrics(_passage_lists(spark, d)).select("qid", "recall_5", "recall_10")


@query("precision_at_k", JUDGED + " SELECT qid, round(precision_5, 6) AS precision_5, round(precision_10, 6) AS precision_10 FROM qm")
def precision_at_k(spark, d):
    return evaluation.query_metrics(_passage_lists(spark, d)).select("qid", "precision_5", "precision_10")


_REPORT = ", ".join(f"round(avg(round({c}, 6)), 4) AS {c}" for c in ("mrr", "ndcg_5", "ndcg_10", "recall_5", "recall_10", "precision_5", "precision_10", "hit_rate"))


@query("retrieval_report", JUDGED + f" SELECT count(*) AS queries, {_REPORT} FROM qm")
def retrieval_report(spark, d):
    return evaluation.retrieval_report(_passage_lists(spark, d))
