"""Personal data: pattern matches, and terms that reveal them by what the corpus says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_names, quoted

KINDS = ("email", "ip", "card", "phone")
# Possessive where no shorter match could succeed, and started only where a run begins or the last match ended: the
# same leftmost matches in linear time and constant stack for texts of any length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}"
MATCH = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """``start, end, value`` of the leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # what lies between the matches tells where they are
    between = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
    pairs = F.filter(F.arrays_zip(found.alias("value"), between.alias("gap")), lambda p: p["value"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(MATCH).alias("out"))

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + p["gap"]
        end = begin + F.char_length(p["value"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), p["value"].alias("value")))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step)["out"]).otherwise(F.array().cast(MATCH))


def luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(digits)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^(0*+(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)(\.|$)){4}$")
    if kind == "card":
        return F.when(F.char_length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(8, 15)
    return F.lit(True)


def base_matches(text: Column, kind: str) -> Column:
    return F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["value"]))


def told_places(rows: DataFrame) -> DataFrame:
    """``row, start, end, strength``: where the terms that ``told`` (term to strength) names stand in ``row, text, told``, in code points.

    Terms become rows of numbers and places a running sum of lengths, so a text of any length takes time in proportion.
    """
    words = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    gaps = F.slice(F.transform(F.split("text", TERM, -1), lambda g: F.char_length(g)), F.lit(1), F.size(words))
    sizes, known = F.transform(words, lambda w: F.char_length(w)), F.transform(words, lambda w: F.try_element_at("told", F.lower(w)))
    each = rows.select("row", F.posexplode(F.arrays_zip(sizes.alias("size"), gaps.alias("gap"), known.alias("strength"))).alias("no", "w")).select("row", "no", "w.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row").orderBy("no")).cast("int")
    return each.select("row", (end - F.col("size")).alias("start"), end.alias("end"), "strength").where("strength IS NOT NULL")


def find(docs: DataFrame, disclose: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """All columns of ``docs`` with a column ``row`` and one of base matches per kind; and ``row, terms``.

    Both names are the first free ones; see :func:`pii_report` for the meaning.
    """
    row, *kinds = free_names(docs, "row", *KINDS)
    text = F.coalesce(F.col("text"), F.lit(""))
    # row numbers are fixed by writing them, so rows of equal or null ids stay apart
    base = docs.withColumn(row, F.monotonically_increasing_id()).withColumns({c: base_matches(text, k) for c, k in zip(kinds, KINDS, strict=True)})
    base = materialize(base, "pii-base")

    def named(c: str, kind: str) -> Column:
        return F.transform(F.col(c), lambda m: F.struct(F.lit(kind).alias("kind"), m["value"].alias("value"), m["start"].alias("start"), m["end"].alias("end")))

    held = F.concat(*map(named, kinds, KINDS))
    private = base.where(sum(F.size(c) for c in kinds) > 0)

    # what a row protects: each value, and that it holds any of the kind
    own = F.array_distinct(F.flatten(F.transform(held, lambda m: F.array(F.struct(m["kind"], m["value"]), F.struct(m["kind"], F.lit(None).cast("string").alias("value"))))))
    holds = materialize(private.select(F.col(row).alias("row"), F.explode(own).alias("e")).select("row", "e.kind", "e.value"), "pii-holds")
    entity = holds.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_entity"))
    own_terms = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))
    said = materialize(private.select(F.col(row).alias("row"), F.explode(own_terms).alias("term")), "pii-said")
    every = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))).alias("term"))
    term = every.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(said.select("term").distinct(), "term", "left_semi")
    term = materialize(term, "pii-terms")
    n = base.select(F.count(F.lit(1)).cast("double").alias("n")).scalar()

    # a term in more rows cannot give away enough of a value, however often they meet: most pairs are never formed
    most = F.pow(n, F.lit(1 - disclose)) * F.pow(F.col("n_entity").cast("double"), F.lit(disclose)) * 1.000001
    counts = entity.select(F.col("kind").alias("k"), F.col("value").alias("v"), "n_entity")
    sized = holds.join(counts, (F.col("kind") == F.col("k")) & F.col("value").eqNullSafe(F.col("v"))).drop("k", "v")
    sized = materialize(sized.withColumn("most", most), "pii-sized")
    reach = sized.groupBy("row").agg(F.max("most").alias("most"))
    rare = said.join(term, "term").join(reach, "row").where(F.col("n_term") <= F.col("most")).select("row", "term", "n_term")
    pairs = materialize(rare.join(sized, "row").where(F.col("n_term") <= F.col("most")).select("row", "term", "n_term", "kind", "value", "n_entity"), "pii-pairs")
    reveals = F.ln(F.col("n_both") * n / (F.col("n_term").cast("double") * F.col("n_entity")))
    content = F.ln(n / F.col("n_entity"))
    # a value of one row meets each of its terms once
    once = pairs.where("n_entity = 1").withColumn("n_both", F.lit(1).cast("bigint"))
    both = pairs.where("n_entity > 1").groupBy("kind", "value", "term").agg(F.count(F.lit(1)).alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    told = both.where((content > 0) & (reveals >= F.lit(disclose) * content)).select(F.col("kind").alias("k"), F.col("value").alias("v"), F.col("term").alias("t"), (reveals / content).alias("strength"))
    many = pairs.where("n_entity > 1").join(told, (F.col("kind") == F.col("k")) & F.col("value").eqNullSafe(F.col("v")) & (F.col("term") == F.col("t"))).select("row", "term", "strength")
    single = once.where((content > 0) & (reveals >= F.lit(disclose) * content)).select("row", "term", (reveals / content).alias("strength"))
    strong = materialize(single.unionByName(many).groupBy("row", "term").agg(F.max("strength").alias("strength")), "pii-told")

    spans = private.select(F.col(row).alias("row"), F.transform(held, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("all"))
    per_row = strong.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "strength"))).alias("told"))
    places = told_places(private.select(F.col(row).alias("row"), text.alias("text")).join(per_row, "row"))
    marked = places.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "strength"))).alias("terms"))
    clear = F.filter("terms", lambda t: ~F.exists("all", lambda m: (m["start"] < t["end"]) & (t["start"] < m["end"])))
    return base, marked.join(spans, "row").select("row", clear.alias("terms"))


def labels(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))


def pii_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, the number of matches per kind, ``base_sha256`` and ``spans`` of each row; and ``n_term``.

    Base: e-mail addresses, IP addresses (parts up to 255), card numbers (16 to 19 digits, Luhn) and phone
    numbers (8 to 15 digits), leftmost and non-overlapping per kind, as ``kind:start:end`` in code points.

    Method: terms are words of three letters or more, protected entities the values found and, for each kind, the
    presence of any.  Terms and entities meet in a row, wherever in the text.  Over all rows, pointwise mutual
    information says how much of an entity's information content a term gives away; from a share of ``disclose`` every
    occurrence of the term in a row that holds the entity becomes a span of kind ``term``.  Spans never overlap base ones.
    ``clean_sha256`` is the hash of the text that :func:`sanitise` leaves.

    Null texts are empty; a null ``doc_id`` is passed on; every row, repeated or not, counts as one.  Texts without a
    base match have no term spans; very long ones are read as rows of terms.  No rows give none.
    """
    base, terms = find(docs.select("doc_id", "text"), **options)
    joined = base.join(terms, "row", "left")
    plain = F.concat(*[labels(k, F.col(k)) for k in KINDS])
    extra = F.coalesce(labels("term", F.col("terms")), F.array().cast("array<string>"))
    clean = cleaned(F.coalesce("text", F.lit("")), dict(zip(KINDS, KINDS)), F.col("terms"), REMOVE)
    return joined.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(plain, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(plain, extra), ",").alias("spans"), F.size(extra).cast("bigint").alias("n_term"), F.sha2(clean, 256).alias("clean_sha256"))


#: Terms that give away such a share are taken out altogether, those below are generalised.
REMOVE = 0.95


def cleaned(text: Column, found: dict[str, str], terms: Column, remove: float) -> Column:
    """``text`` with its matches (columns ``found`` by kind) and revealing ``terms`` replaced; null stays null."""

    def cut(m: Column, by: Column) -> Column:
        return F.struct(m["start"].alias("start"), (-m["end"]).alias("order"), by.alias("by"))

    def kind_cuts(kind: str) -> Column:
        return F.transform(F.col(f"`{found[kind]}`"), lambda m: cut(m, F.lit(f"[{kind.upper()}]")))

    cuts = [kind_cuts(kind) for kind in found]
    told = F.transform(terms, lambda m: cut(m, F.when(m["strength"] >= remove, "").otherwise("[TERM]")))
    cuts = F.concat(*cuts, F.coalesce(told, F.array().cast("array<struct<start:int,order:int,by:string>>")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        return F.when(c["start"] < a["at"], a).otherwise(F.struct(
            (-c["order"]).alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, c["start"] - a["at"]), c["by"])).alias("out")))

    done = F.aggregate(F.array_sort(cuts), start, step)
    return F.when(F.size(cuts) > 0, F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.char_length(text)))).otherwise(text)


def sanitise(docs: DataFrame, remove: float = REMOVE, **options) -> DataFrame:
    """The rows of ``docs`` with a clean ``text``: base matches become ``[KIND]``, revealing terms ``[TERM]``.

    Terms that give away a share of ``remove`` or more are taken out altogether.  Of matches of different kinds that overlap, the first
    counts, of equal starts the longer.  A null text stays null.
    """
    base, terms = find(docs, **options)
    row, *kinds = free_names(docs, "row", *KINDS)
    mine, span = free_names(base, "terms_row", "terms_")
    joined = base.join(terms.select(F.col("row").alias(mine), F.col("terms").alias(span)), F.col(row) == F.col(mine), "left")
    clean = cleaned(F.col("text"), dict(zip(KINDS, kinds, strict=True)), F.col(span), remove)
    return joined.select(*[clean.alias(c) if c == "text" else q for c, q in zip(docs.columns, quoted(docs.columns), strict=True)])
