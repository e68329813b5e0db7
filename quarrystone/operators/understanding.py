"""Query understanding and routing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T


def entity_filter(query: Column) -> Column:
    """First ticker in list order one of whose words occurs anywhere in the text; null without one."""
    low = F.lower(query)
    return F.coalesce(*[F.when(T.contains_any(low, words), t) for t, words in fixed.FILTER_KEYWORDS])


def all_entities(query: Column) -> Column:
    """Every company named, in list order."""
    low = F.lower(query)
    named = F.array(*[F.when(T.contains_any(low, words), t) for t, words in fixed.COMPANY_KEYWORDS])
    return F.filter(named, lambda t: t.isNotNull())


def year(query: Column) -> Column:
    return F.nullif(F.regexp_extract(query, r"\b(20\d{2})\b", 1), F.lit(""))


def rewrite(query: Column) -> Column:
    out = query
    for pattern, replacement in fixed.REWRITES:
        out = F.regexp_replace(out, pattern, replacement)
    short = (T.word_count(query) < 4) & ~T.contains_any(F.upper(query), fixed.TICKERS)
    return F.when(short, F.concat(F.lit(fixed.SHORT_QUERY_PREFIX), out)).otherwise(out)


def expand_variants(query: Column, variants: Column) -> Column:
    """The query, then those of the first three variants that differ and have three words; no repeats."""
    kept = F.filter(F.slice(variants, 1, 3), lambda v: (F.lower(v) != F.lower(query)) & (T.word_count(v) >= 3))
    every = F.concat(F.array(query), kept)
    keys = F.transform(every, lambda v: T.strip(F.lower(v)))
    return F.filter(every, lambda v, i: F.array_position(keys, T.strip(F.lower(v))) == i + 1)


def skip_retrieval(query: Column) -> Column:
    return T.matches_any(T.strip(F.lower(query)), fixed.SKIP_RETRIEVAL)


def keyword_complexity(query: Column) -> Column:
    low = F.lower(query)
    return (
        F.when(T.contains_any(low, fixed.COMPLEX_KEYWORDS), "complex")
        .when(T.contains_any(low, fixed.SIMPLE_KEYWORDS), "simple").otherwise("ambiguous")
    )


def route(predictions: DataFrame, prices: dict[str, tuple[float, float]] = fixed.PRICES, threshold: float = 0.6) -> DataFrame:
    """``query, label, confidence`` to model, method and cost; an unsure label falls back to keywords."""
    unsure = F.col("confidence") < threshold
    complexity = F.when(unsure, keyword_complexity(F.col("query"))).otherwise(F.col("label"))
    model = F.when(F.col("complexity") == "complex", "large").otherwise("small")
    price_in = F.when(F.col("model") == "large", prices["large"][0]).otherwise(prices["small"][0])
    return (
        predictions.withColumn("complexity", complexity).withColumn("method", F.when(unsure, "keywords").otherwise("classifier"))
        .withColumn("confidence", F.when(unsure, 0.7).otherwise(F.col("confidence"))).withColumn("model", model)
        .withColumn("cost_estimate", F.length("query") / 4 * price_in / 1_000_000)
    )


def ab_assign(routed: DataFrame, split: float, model_a: str, model_b: str, enabled: bool = True, key: str = "query") -> DataFrame:
    """Share ``split`` of the keys goes to B.  The draw is a hash, so a retried task draws the same."""
    if not enabled:
        return routed.withColumn("variant", F.lit(None).cast("string")).withColumn("assigned_model", F.col("model"))
    draw = F.conv(F.left(F.md5(F.col(key).cast("string")), F.lit(8)), 16, 10).cast("bigint") / 4294967296.0
    return routed.withColumn("variant", F.when(draw < split, "B").otherwise("A")).withColumn(
        "assigned_model", F.when(F.col("variant") == "B", model_b).otherwise(model_a))
