"""Line de-duplication by a log-template tree of fixed depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import each
from ..session import materialize
from .common import free_names, quoted

BLANKS = " \t\n\x0b\x0c\r"
#: A token with a digit is a variable field.
VARIABLE = "<*>"


def plain_line(line: Column) -> Column:
    """A line without outer blanks, its tokens with a digit replaced."""
    return F.btrim(F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ \\t-\\r0-9]*+[0-9][^ \\t-\\r]*+", VARIABLE)).otherwise(line), F.lit(BLANKS))


def masked_tokens(line: Column) -> Column:
    return F.array_remove(F.split(plain_line(line), "[ \\t-\\r]+"), "")


def explode_lines(docs: DataFrame, keep: list[str], depth: int, min_tokens: int) -> DataFrame:
    """``keep``, ``tokens, leaf, body`` of each judged line: its tree path and a hash of all its tokens.

    The path is the number of tokens and the first ``depth`` of them.
    """
    lines = docs.select(*keep, F.explode(F.split(F.col("text"), "\n")).alias("line"))
    # a row of its own keeps the tokens from being worked out for the filter and again for the path
    cut = each(lines, keep, F.array(masked_tokens(F.col("line"))), "tokens").where(F.size("tokens") >= min_tokens)
    return cut.select(*keep, "tokens", *path(F.col("tokens"), depth))


def path(tokens: Column, depth: int) -> list[Column]:
    return [F.xxhash64(F.size(tokens), *[F.get(tokens, F.lit(k)) for k in range(depth)]).alias("leaf"), F.xxhash64(F.array_join(tokens, " ")).alias("body")]


def recurring_lines(docs: DataFrame, depth: int, min_docs: int, min_share: float, min_tokens: int) -> DataFrame:
    """``id, drop``: of each id the ``body`` hashes of its lines that go.

    A leaf of the tree generalises its lines: a token is a constant of the leaf at its position if lines of
    ``min_docs`` documents have it there, all others are variable.  A line of at least ``min_share`` constants is an
    instance of a recurring template, which its constants and their positions name.  Lines of ``min_docs`` documents that are equal need no
    generalising: they are a template of their own.  The least id that holds a template's lines keeps them, all others drop them.
    """
    narrow = materialize(explode_lines(docs, ["id"], depth, min_tokens).select("id", "leaf", "body").distinct(), "line-paths")
    bodies = materialize(narrow.groupBy("leaf", "body").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")), "line-bodies")
    full = F.col("n") >= min_docs
    leaves = bodies.groupBy("leaf").agg(F.sum("n").alias("total"), F.count_if(~full).alias("open"))
    busy = materialize(leaves.where((F.col("total") >= min_docs) & (F.col("open") > 0)).select("leaf", F.lit(True).alias("busy")), "line-leaves")
    marked = bodies.join(busy, "leaf", "left").select("leaf", "body", "n", "least", F.coalesce("busy", F.lit(False)).alias("busy"))
    marked = materialize(marked.where(full | F.col("busy")), "line-marked")

    said = narrow.join(marked, ["leaf", "body"])
    model = F.col("busy") & (F.col("id") == F.col("least"))
    told = said.where(full | F.col("busy")).groupBy("id").agg(
        F.collect_set(F.when(full & (F.col("id") != F.col("least")), F.col("body"))).alias("drop"),
        F.collect_set(F.when(F.col("busy") & ~full, F.col("body"))).alias("open"),
        F.collect_set(F.when(model, F.struct("body", "n"))).alias("models"))
    told = materialize(told, "line-told")

    # tokens of one line of each body in a leaf that is still open
    texts = docs.join(told.where(F.size("models") > 0).select("id", "models"), "id").select("id", "text", F.map_from_entries("models").alias("models"))
    known = explode_lines(texts, ["models"], depth, min_tokens).select("leaf", "body", "tokens", F.try_element_at("models", F.col("body")).alias("n")).where("n IS NOT NULL")
    # a line may stand twice in its document
    cells = known.select("leaf", "body", "n", F.posexplode("tokens").alias("at", "token")).distinct()
    cells = materialize(cells.select("leaf", "body", "n", "at", F.xxhash64("token").alias("token")), "line-cells")
    constants = materialize(cells.groupBy("leaf", "at", "token").agg(F.sum("n").alias("docs")).where(F.col("docs") >= min_docs).select("leaf", "at", "token", F.lit(1).alias("constant")), "line-constants")
    shape = F.array_sort(F.collect_list(F.when(F.col("constant").isNotNull(), F.struct("at", "token"))))
    judged = cells.where(~full).join(constants, ["leaf", "at", "token"], "left").groupBy("leaf", "body").agg(
        (F.count("constant") / F.count(F.lit(1))).alias("share"), F.xxhash64("leaf", shape).alias("template"))
    judged = materialize(judged.where(F.col("share") >= min_share).join(marked.select("leaf", "body", "least"), ["leaf", "body"]).select("body", "template", "least"), "line-judged")
    keepers = materialize(judged.groupBy("template").agg(F.min("least").alias("keeper")), "line-keepers")
    kept_by = materialize(judged.join(keepers, "template").select("body", "keeper"), "line-kept-by")
    more = told.select("id", F.explode("open").alias("body")).join(kept_by, "body").where(F.col("id") != F.col("keeper")).groupBy("id").agg(F.collect_set("body").alias("more"))
    return told.join(more, "id", "left").select("id", F.array_union("drop", F.coalesce("more", F.array().cast("array<bigint>"))).alias("drop"))


def dedup_lines(docs: DataFrame, depth: int = 3, min_docs: int = 3, min_share: float = 0.8, min_tokens: int = 1) -> DataFrame:
    """Every row of ``docs`` with one struct column more, the result's last: ``text, n_lines, n_dropped``.

    Lines that are instances of a template of ``min_docs`` documents or more go, but for the least ``doc_id`` that holds the
    template, so one copy of every line is left in the corpus.  Lines below ``min_tokens`` tokens (blank ones) are never judged.

    Rows of equal ids count as one document and are judged alike; rows of null id count for nothing and stay whole.  A
    null text stays null, with no lines; a text all of whose lines go becomes empty.  No column of ``docs`` is changed.
    """
    fid, fdrop, flines, fgone, out = free_names(docs, "line_id", "drop", "lines", "gone", "deduped")
    narrow = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "text")
    drop = recurring_lines(narrow, depth, min_docs, min_share, min_tokens).select(F.col("id").alias(fid), F.col("drop").alias(fdrop))
    told = docs.join(drop, F.col("doc_id") == F.col(fid), "left")

    def judge(line: Column) -> Column:
        # arrays of one element keep the tokens from being worked out again
        return F.transform(F.array(masked_tokens(line)), lambda t: F.struct(
            line.alias("line"),
            ((F.size(t) >= min_tokens) & F.array_contains(fdrop, F.xxhash64(F.array_join(t, " ")))).alias("gone")))[0]

    split = F.split(F.col("text"), "\n")
    # rows without a verdict are not looked into
    with_lines = told.withColumn(flines, F.when(F.size(fdrop) > 0, F.transform(split, judge)))
    cut = with_lines.withColumn(fgone, F.coalesce(F.exists(flines, lambda x: x["gone"]), F.lit(False)))
    left = F.filter(F.col(flines), lambda x: ~x["gone"])
    text = F.when(F.col(fgone), F.array_join(F.transform(left, lambda x: x["line"]), "\n")).otherwise(F.col("text"))
    n_lines = F.coalesce(F.size(split), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("bigint")
    n_dropped = F.when(F.col(fgone), F.size(flines) - F.size(left)).otherwise(0).cast("bigint")
    return cut.select(*quoted(docs.columns), F.struct(text.alias("text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped")).alias(out))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of each row."""
    found = dedup_lines(docs.select("doc_id", "text"), **options)
    x = F.col(found.columns[-1])
    return found.select("doc_id", x["n_lines"].alias("n_lines"), x["n_dropped"].alias("n_dropped"), F.sha2(F.coalesce(x["text"], F.lit("")), 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with ``text`` and ``n_chars`` of what is left."""
    found = dedup_lines(docs, **options)
    text = F.col(found.columns[-1])["text"]
    new = {"text": text, "n_chars": F.when(text.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.char_length(text).cast("bigint"))}
    return found.select(*[new[c].alias(c) if c in new else q for c, q in zip(docs.columns, quoted(docs.columns), strict=True)])


SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
toks AS (
  SELECT doc_id, no, line, CASE WHEN s = '' THEN [] ELSE string_split_regex(s, '[ \t-\r]+') END AS toks
  FROM (SELECT *, trim(regexp_replace(line, '[^ \t-\r0-9]*[0-9][^ \t-\r]*', '<*>', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM raw)),
lines AS (SELECT *, len(toks) AS n, toks[1:3] AS head FROM toks),
judged AS (SELECT * FROM lines WHERE n >= 1),
bodies AS (SELECT toks, n, head, count(DISTINCT doc_id) AS docs, min(doc_id) AS least FROM judged GROUP BY ALL),
busy AS (SELECT n, head FROM bodies GROUP BY ALL HAVING sum(docs) >= 3 AND count(*) FILTER (docs < 3) > 0),
cells AS (SELECT toks, n, head, docs, least, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM bodies JOIN busy USING (n, head)),
consts AS (SELECT n, head, pos, tok FROM cells GROUP BY ALL HAVING sum(docs) >= 3),
open AS (
  SELECT c.toks, c.n, c.head, min(least) AS least, list(k.tok ORDER BY c.pos) AS template
  FROM cells c LEFT JOIN consts k ON c.n = k.n AND c.head = k.head AND c.pos = k.pos AND c.tok = k.tok
  WHERE docs < 3 GROUP BY c.toks, c.n, c.head HAVING count(k.tok) / count(*) >= 0.8),
gone AS (
  SELECT toks, least AS keeper FROM bodies WHERE docs >= 3
  UNION ALL SELECT toks, min(least) OVER (PARTITION BY n, head, template) FROM open),
marked AS (SELECT l.*, g.keeper IS NOT NULL AND g.keeper <> doc_id AS gone FROM lines l LEFT JOIN gone g ON l.toks = g.toks AND l.n >= 1),
docs AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS lost, string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone) AS rest
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(lost, 0) AS n_dropped,
  sha256(CASE WHEN lost > 0 THEN coalesce(rest, '') ELSE coalesce(text, '') END) AS kept_sha256
FROM documents d LEFT JOIN docs USING (doc_id)
"""
