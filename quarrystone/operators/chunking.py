"""Documents to sections, paragraphs, sentences and chunks.

Every packer is one fold inside the row (a higher-order function), so a document is chunked where
it is read: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions.rows import each

TEXTS = "array<string>"


def _cut(docs: DataFrame, heading, first_header: str, strip_lines: bool, ends: str) -> DataFrame:
    """Add ``_sections``: the lines between headings, as ``(header, content)``.

    Lines and heading positions are columns of their own, so every section is one slice of the line
    list and the work is linear in the text.
    """
    lines = F.split("text", "\n")
    d = docs.withColumn("_l", F.transform(lines, T.strip) if strip_lines else lines)
    at = F.filter(F.transform("_l", lambda line, i: F.when(heading(line), i)), lambda i: i.isNotNull())
    d = d.withColumn("_s", F.concat(F.array(F.lit(-1)), at))

    def one(start: Column, i: Column) -> Column:
        end = F.coalesce(F.try_element_at("_s", i + 2), F.size("_l"))
        body = F.slice("_l", start + 2, end - start - 1)
        header = F.when(start < 0, first_header).otherwise(T.strip(F.try_element_at("_l", F.greatest(start, F.lit(0)) + 1)))
        return F.struct(header.alias("header"), F.concat(F.array_join(body, "\n"), F.lit(ends)).alias("content"), F.size(body).alias("lines"))

    return d.withColumn("_sections", F.transform("_s", one)).drop("_l", "_s")


def with_sections(docs: DataFrame, first_header: str = " preamble") -> DataFrame:
    """Headings by number; lines are stripped, a blank line stays as an empty one, blank sections go."""
    d = _cut(docs, lambda line: line.rlike(fixed.HEADING), first_header, True, "\n")
    return d.withColumn("_sections", F.filter("_sections", lambda s: T.strip(s["content"]) != ""))


def with_sections_strict(docs: DataFrame) -> DataFrame:
    """Headings need a dot or colon; body lines keep their blanks; a heading without lines is lost."""
    d = _cut(docs, lambda line: T.strip(line).rlike(fixed.STRICT_HEADING), "preamble", False, "")
    d = d.withColumn("_sections", F.filter("_sections", lambda s: s["lines"] > 0))
    whole = F.array(F.struct(F.lit("document").alias("header"), F.col("text").alias("content"), F.lit(1).alias("lines")))
    return d.withColumn("_sections", F.when(F.size("_sections") > 0, F.col("_sections")).otherwise(whole))


def pack_text(parts: Column, limit: int, last_over: int = 0) -> Column:
    """Join parts with a blank while the text so far plus the next part fits ``limit`` characters.

    The last pack stays only if longer than ``last_over``.
    """

    def step(acc: Column, part: Column) -> Column:
        full = (F.length(acc["text"]) + F.length(part) > limit) & (acc["text"] != "")
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["text"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["text"] == ""), part).otherwise(F.concat(acc["text"], F.lit(" "), part)).alias("text"),
        )

    start = F.struct(F.array().cast(TEXTS).alias("done"), F.lit("").alias("text"))
    return F.aggregate(parts, start, step, lambda a: F.when(
        F.length(T.strip(a["text"])) > last_over, F.concat(a["done"], F.array(a["text"]))).otherwise(a["done"]))


def pack_parts(parts: Column, limit: int, cost, joiner: str, carry: int = 0, carry_all_below: int = 0) -> Column:
    """Pack whole parts while the sum of ``cost(part)`` fits; join each pack with ``joiner``.

    After a full pack its last ``carry`` parts open the next one (all of them when the pack has no
    more than ``carry_all_below``), and the cost is taken anew from the joined text.
    """

    def step(acc: Column, part: Column) -> Column:
        full = (acc["used"] + cost(part) > limit) & (F.size(acc["open"]) > 0)
        if carry:
            kept = F.when(F.size(acc["open"]) > max(carry, carry_all_below), F.slice(acc["open"], -carry, carry)).otherwise(acc["open"])
            if not carry_all_below:
                kept = F.slice(acc["open"], -carry, carry)
            opened = F.concat(kept, F.array(part))
            cost_new = cost(F.array_join(opened, joiner))
        else:
            opened, cost_new = F.array(part), cost(part)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["open"], joiner)))).otherwise(acc["done"]).alias("done"),
            F.when(full, opened).otherwise(F.concat(acc["open"], F.array(part))).alias("open"),
            F.when(full, cost_new).otherwise(acc["used"] + cost(part)).cast("bigint").alias("used"),
        )

    empty = F.array().cast(TEXTS)
    start = F.struct(empty.alias("done"), empty.alias("open"), F.lit(0).cast("bigint").alias("used"))
    return F.aggregate(
        parts, start, step,
        lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], joiner)))).otherwise(a["done"]),
    )


def split_sections(docs: DataFrame) -> DataFrame:
    return each(with_sections(docs), ["doc_id"], F.col("_sections"), "s", "section_no").select("doc_id", "section_no", "s.header", "s.content")


def split_sections_strict(docs: DataFrame) -> DataFrame:
    return each(with_sections_strict(docs), ["doc_id"], F.col("_sections"), "s", "section_no").select("doc_id", "section_no", "s.header", "s.content")


def chunk_flat(docs: DataFrame, max_chunk_size: int = 500) -> DataFrame:
    """Sentence packs per section; packs of 50 characters or less are dropped after numbering."""
    keep = [c for c in docs.columns if c != "text"]
    parts = each(with_sections(docs), keep, F.col("_sections"), "s")
    packs = pack_text(T.sentences(T.strip(F.col("s.content"))), max_chunk_size)
    return (
        each(parts, [*keep, F.col("s.header").alias("section")], packs, "chunk", "chunk_index")
        .where(F.length("chunk") > 50)
        .select(*keep, "section", "chunk_index", F.concat(F.lit("["), F.col("section"), F.lit("] "), F.col("chunk")).alias("text"))
    )


def chunk_upload(docs: DataFrame, max_chunk_size: int = 500) -> DataFrame:
    """As ``chunk_flat``, but only a short last pack is dropped and numbers run over the document."""
    per_section = F.transform("_sections", lambda s: F.transform(
        pack_text(F.filter(F.split(T.strip(s["content"]), fixed.SENTENCE_END), lambda x: x != ""), max_chunk_size, last_over=50),
        lambda c: F.struct(s["header"].alias("section"), F.concat(F.lit("["), s["header"], F.lit("] "), T.strip(c)).alias("text")),
    ))
    return each(with_sections(docs, "preamble"), ["doc_id"], F.flatten(per_section), "c", "chunk_index").select("doc_id", "chunk_index", "c.*")


def with_parents(df: DataFrame, text: str, max_tokens: int = 1024) -> DataFrame:
    """Add ``_parents``.  The packs are a column of their own: asked for their number and their texts, they are packed once."""
    d = df.withColumn("_packs", pack_parts(T.paragraphs(F.col(text)), max_tokens, T.token_estimate, "\n\n"))
    return d.withColumn("_parents", F.when(F.size("_packs") > 0, F.col("_packs")).otherwise(F.array(F.left(text, F.lit(2000))))).drop("_packs")


def with_children(df: DataFrame, text: str, max_tokens: int = 256, min_tokens: int = 50) -> DataFrame:
    """Add ``_children``, packed once as well."""
    packed = pack_parts(T.sentences(F.col(text)), max_tokens, T.token_estimate, " ", carry=2, carry_all_below=2)
    d = df.withColumn("_packs", F.filter(packed, lambda c: T.token_estimate(c) >= min_tokens))
    return d.withColumn("_children", F.when(F.size("_packs") > 0, F.col("_packs")).otherwise(F.array(F.left(text, F.lit(500))))).drop("_packs")


def chunk_parent(docs: DataFrame) -> DataFrame:
    return each(with_parents(docs, "text"), ["doc_id"], F.col("_parents"), "text", "parent_no")


def chunk_child(docs: DataFrame) -> DataFrame:
    return each(with_children(docs, "text"), ["doc_id"], F.col("_children"), "text", "child_no")


def _two_levels(base: DataFrame, keep: list[str]) -> DataFrame:
    """One scan: each parent row carries itself and its ``_children``, then both are exploded together."""
    tree = F.concat(
        F.array(F.struct(F.lit("parent").alias("type"), F.col("pid").alias("chunk_id"), F.lit("").alias("parent_id"), F.col("ptext").alias("text"))),
        F.transform("_children", lambda c, i: F.struct(
            F.lit("child").alias("type"), F.concat(F.col("pid"), F.lit("_child_"), i.cast("string")).alias("chunk_id"),
            F.col("pid").alias("parent_id"), c.alias("text"))),
    )
    return each(base, keep, tree, "c").select(*keep, "c.*").withColumn("token_estimate", T.token_estimate(F.col("text")))


def chunk_parent_child(docs: DataFrame) -> DataFrame:
    """Section, parent and child chunks.  Ids hold the section number, so repeated titles stay apart."""
    filled = docs.where(T.strip(F.col("text")) != "")
    parts = each(with_sections_strict(filled), ["doc_id"], F.col("_sections"), "s", "section_no")
    parts = with_parents(parts.select("doc_id", "section_no", F.col("s.header").alias("section"), F.col("s.content").alias("content")), "content")
    base = each(parts, ["doc_id", "section_no", "section"], F.col("_parents"), "ptext", "p")
    base = base.withColumn("pid", F.concat_ws("_", "section_no", "section", "p"))
    return _two_levels(with_children(base, "ptext"), ["doc_id", "section"])


def chunk_chars(docs: DataFrame, parent_max: int = 2000, child_max: int = 500) -> DataFrame:
    paras = F.filter(F.transform(F.split(F.col("text"), "\n\n"), T.strip), lambda p: p != "")
    packed = pack_parts(paras, parent_max, F.length, "\n\n")
    base = each(docs, ["doc_id"], packed, "ptext", "p").withColumn("pid", F.concat(F.lit("parent_"), F.col("p").cast("string")))
    return _two_levels(base.withColumn("_children", pack_parts(F.split("ptext", fixed.SENTENCE_END), child_max, F.length, " ", carry=1)), ["doc_id"])


def contextual_text(chunks: DataFrame) -> DataFrame:
    """``[Context: From T (Y) in section 'S': summary]`` ahead of the chunk, if there is any context."""

    def part(col: str, before: str, after: str) -> Column:
        return F.when(F.coalesce(F.col(col), F.lit("")) != "", F.concat(F.lit(before), F.col(col), F.lit(after))).otherwise("")

    context = T.strip(F.concat(part("ticker", "From ", " "), part("year", "(", ") "), part("section", "in section '", "': "),
                               F.coalesce("summary", F.lit(""))))
    return chunks.withColumn("context_summary", context).withColumn(
        "contextual_text",
        F.when(F.col("context_summary") != "", F.concat(F.lit("[Context: "), F.col("context_summary"), F.lit("]\n\n"), F.col("text"))).otherwise(F.col("text")),
    )


def truncate_words(text: Column, max_tokens: int = 100) -> Column:
    """Cut at ``4 * max_tokens`` characters and back to the last blank."""
    size = 4 * max_tokens
    return F.when(F.length(text) > size, F.regexp_replace(F.left(text, F.lit(size)), r"(?s) [^ ]*$", "")).otherwise(text)


def chunk_id(ticker: Column, document: Column, index: Column, text: Column) -> Column:
    """Repeatable id: it hashes the document and position where a clock was used before."""
    digest = F.md5(F.concat_ws("_", ticker, document.cast("string"), index.cast("string"), F.left(text, F.lit(100))))
    return F.concat_ws("_", ticker, F.left(digest, F.lit(8)), index.cast("string"))


def ingest_summary(chunks: DataFrame) -> DataFrame:
    has_context = F.coalesce(F.col("contextual_text") != F.col("text"), F.lit(False))
    return chunks.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(has_context).alias("contextualised"),
        F.countDistinct("doc_id").alias("documents"),
    )
