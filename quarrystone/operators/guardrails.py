"""Checks on questions and answers, citations, escalation and reply parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from . import ranks


def _present(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda i: i.isNotNull())


def redact_pii(text: Column) -> tuple[Column, Column]:
    """Redacted text and the issue list; each pattern sees what the earlier ones left."""
    issues = []
    for kind, pattern in fixed.PII_PATTERNS:
        issues.append(F.when(text.rlike("(?i)" + pattern), f"pii_{kind}_redacted"))
        text = F.regexp_replace(text, pattern, f"[REDACTED_{kind.upper()}]")
    return text, _present(*issues)


def detect_injection(text: Column) -> Column:
    return T.matches_any(text, ["(?i)" + p for p in fixed.INJECTION_PATTERNS])


def validate_input(queries: DataFrame, max_length: int = 2000, min_length: int = 3) -> DataFrame:
    """``query`` to ``passed, issues, sanitized`` (null when refused)."""
    d = queries.withColumn("_s", T.strip(F.col("query")))
    d = d.withColumn("_cut", F.length("_s") > max_length).withColumn("_short", F.length("_s") < min_length)
    d = d.withColumn("_s", F.left("_s", F.lit(max_length)))
    d = d.withColumn("_bad", detect_injection(F.col("_s")))
    clean, found = redact_pii(F.col("_s"))
    refused = F.when(F.col("_short"), F.array(F.lit("query_too_short"))).when(F.col("_bad"), F.array(F.lit("prompt_injection_detected")))
    issues = F.coalesce(refused, F.concat(_present(F.when(F.col("_cut"), "query_truncated")), found))
    return d.select(
        *queries.columns, (~F.col("_short") & ~F.col("_bad")).alias("passed"), issues.alias("issues"),
        F.when(~F.col("_short") & ~F.col("_bad"), clean).alias("sanitized"),
    )


def amounts(text: Column, ignore_case: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit(("(?i)" if ignore_case else "") + fixed.DOLLAR_AMOUNT), F.lit(0))


def ungrounded_amounts(answer: Column, context: Column) -> Column:
    """Amounts of the answer that the context does not hold, in order, repeats kept."""
    low = F.lower(context)
    return F.filter(F.transform(amounts(answer), T.strip), lambda a: ~F.contains(low, F.lower(a)))


def key_nouns(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in fixed.NOUN_STOP_WORDS])
    # word boundaries count accented letters as letters
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit("(?U)" + fixed.NOUN), F.lit(0)), stop)


def noun_grounding(answer: Column, context: Column) -> Column:
    """Share of the answer's key nouns found in the context; null without nouns."""
    nouns = key_nouns(answer)
    return F.when(F.size(nouns) > 0, T.overlap(nouns, key_nouns(context)) / F.size(nouns))


def validate_output(rows: DataFrame) -> DataFrame:
    """``query, answer, context``: ordered issue list and ``passed``."""
    low = F.lower("answer")
    d = rows.withColumn("_a", T.word_set(F.col("answer"))).withColumn("_c", T.word_set(F.col("context"))).withColumn("_q", T.word_set(F.col("query")))
    d = d.withColumn("_g", F.when(F.size("_a") > 0, T.overlap(F.col("_a"), F.col("_c")) / F.size("_a")))
    d = d.withColumn("_r", F.when(F.size("_q") > 0, T.overlap(F.col("_q"), F.col("_a")) / F.size("_q")))
    d = d.withColumn("_n", noun_grounding(F.col("answer"), F.col("context")))

    def named(prefix: str, phrases) -> Column:
        return F.transform(T.phrases_in(low, phrases), lambda p: F.concat(F.lit(prefix), p))

    def below(col: str, limit: float, label: str) -> Column:
        return _present(F.when(F.col(col) < limit, F.concat(F.lit(label), T.two_places(F.col(col)))))

    d = d.withColumn("_i", F.concat(
        named("financial_advice_language: ", fixed.ADVICE_KEYWORDS), below("_g", 0.3, "low_grounding: "),
        named("hallucination_indicator: ", fixed.HEDGE_PHRASES), below("_r", 0.2, "low_relevance: "),
        F.transform(ungrounded_amounts(F.col("answer"), F.col("context")), lambda a: F.concat(F.lit("ungrounded_amount: "), a)),
        below("_n", 0.2, "low_semantic_grounding: "),
    ))
    issues = F.when(F.size("_i") > 0, F.concat("_i", F.array(F.lit("add_disclaimer")))).otherwise(F.col("_i"))
    return d.select(*rows.columns, issues.alias("issues"), (F.size("_i") == 0).alias("passed"))


def add_disclaimer(answer: Column) -> Column:
    note = F.lit(fixed.DISCLAIMER)
    return F.when(F.contains(answer, note), answer).otherwise(F.concat(answer, note))


def _pairs(text: Column, pattern: str) -> Column:
    tickers, years = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))
    return F.zip_with(tickers, years, lambda t, y: F.concat_ws(" ", t, y))


def extract_citations(context: Column, mentioned: Column, limit: int = 5) -> Column:
    """Distinct ``T Y`` marks in order, only of companies the query names, if it names any."""
    marks = F.array_distinct(_pairs(context, fixed.CITATION_IN_CONTEXT))
    return F.slice(F.filter(marks, lambda m: (F.size(mentioned) == 0) | F.array_contains(mentioned, F.substring_index(m, " ", 1))), 1, limit)


def verify_citations(answer: Column, context: Column) -> Column:
    """Marks of the answer, bracketed or in parentheses, whose text the context holds; repeats kept."""
    low = F.lower(context)
    return F.filter(_pairs(answer, fixed.CITATION_IN_ANSWER), lambda m: F.contains(low, F.lower(m)))


def verification(answer: Column, context: Column) -> tuple[Column, Column]:
    """Issues and a score that loses a fifth per issue."""
    low = F.lower(context)
    loose = F.filter(amounts(answer, ignore_case=False), lambda a: ~F.contains(low, F.lower(a)))
    issues = F.concat(F.transform(loose, lambda a: F.concat(F.lit("ungrounded_amount: "), a)),
                      _present(F.when(T.word_count(answer) < 10, "answer_too_short")))
    return issues, F.greatest(F.lit(0.0), 1.0 - F.size(issues) * 0.2)


def clean_response(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?s)```tool_code.*?```", "")
    out = F.regexp_replace(out, r"(?s)<tool_call>.*?</tool_call>", "")
    return T.strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def escalation_reason(query: Column, answer: Column, confidence: Column, n_guardrail: Column, n_reflection: Column,
                      threshold: float = 0.5, max_issues: int = 3) -> Column:
    """The first rule that asks for a human; null when none does."""
    stakes = T.phrases_in(F.lower(query), fixed.HIGH_STAKES)
    hedges = F.size(T.phrases_in(F.lower(answer), fixed.ESCALATION_HEDGES))
    return (
        F.when(confidence < threshold, F.concat(F.lit("low_confidence:"), T.two_places(confidence)))
        .when(n_guardrail > max_issues, F.concat(F.lit("too_many_guardrail_issues:"), n_guardrail.cast("string")))
        .when(n_reflection >= 2, F.concat(F.lit("reflection_flagged:"), n_reflection.cast("string"), F.lit("_issues")))
        .when(F.size(stakes) > 0, F.concat(F.lit("high_stakes_keyword:"), F.try_element_at(stakes, F.lit(1))))
        .when(hedges >= 2, F.concat(F.lit("hedging_language:"), hedges.cast("string")))
    )


def escalation_queue(escalated: DataFrame, decisions: DataFrame) -> DataFrame:
    """``event_id, us, date, reason`` to tickets numbered per day; a decision resolves its ticket.

    Numbers are exact over a day of any size: see ``ranks.ordered_prefix``.
    """
    numbered = ranks.ordered_prefix(escalated, ["date"], F.col("us"), F.col("event_id"), rank="no")
    digits = F.col("no").cast("string")
    ticket = F.concat(F.lit("ESC-"), F.regexp_replace("date", "-", ""), F.lit("-"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))
    return numbered.join(decisions, "event_id", "left").select(
        ticket.alias("ticket_id"), "event_id", "reason", F.when(F.col("final_answer").isNotNull(), "resolved").otherwise("pending").alias("status"), "final_answer")


# --- replies -----------------------------------------------------------------------------------


def _object(candidate: Column) -> Column:
    """The text if it is one JSON object, else null."""
    parsed = F.try_parse_json(T.strip(candidate))
    return F.when(parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT"), T.strip(candidate))


def _balanced(text: Column) -> Column:
    """From the first opening brace to the one that closes it; null if none does."""
    pieces = F.regexp_extract_all(F.regexp_extract(text, r"(?s)\{.*", 0), F.lit(r"[{}]|[^{}]+"), F.lit(0))

    def step(acc: Column, p: Column) -> Column:
        depth = acc["depth"] + F.when(p == "{", 1).when(p == "}", -1).otherwise(0)
        return F.struct(
            F.when(acc["closed"], acc["end"]).otherwise(acc["end"] + F.length(p)).alias("end"),
            F.when(acc["closed"], acc["depth"]).otherwise(depth).alias("depth"),
            (acc["closed"] | ((p == "}") & (depth == 0))).alias("closed"),
        )

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("depth"), F.lit(False).alias("closed"))
    found = F.aggregate(pieces, start, step)
    return F.when(found["closed"], F.substring(F.regexp_extract(text, r"(?s)\{.*", 0), F.lit(1), found["end"]))


def parse_structured(replies: DataFrame) -> DataFrame:
    """``reply`` to fields: the whole text, else a fenced block, else an object inside, else field by field."""
    fences = F.regexp_extract_all("reply", F.lit(r"(?s)```(?:json)?\s*\n(.*?)\n\s*```"), F.lit(1))
    d = replies.withColumn("_whole", _object(F.col("reply")))
    d = d.withColumn("_fence", F.try_element_at(F.filter(F.transform(fences, _object), lambda c: c.isNotNull()), F.lit(1)))
    d = d.withColumn("_inner", _object(_balanced(F.col("reply"))))
    d = d.withColumn("_json", F.coalesce("_whole", "_fence", "_inner"))
    loose = {name: F.nullif(F.regexp_extract("reply", pattern, 1), F.lit("")) for name, pattern in fixed.REPLY_FIELDS}
    listed = F.regexp_extract("reply", fixed.REPLY_CITATIONS, 1)
    strings = F.array_join(F.regexp_extract_all(listed, F.lit(r'"([^"]*)"'), F.lit(1)), ",")
    in_json = F.array_join(F.from_json(F.get_json_object("_json", "$.citations"), "array<string>"), ",")
    has_json = F.col("_json").isNotNull()

    def field(name: str) -> Column:
        return F.when(has_json, F.get_json_object("_json", f"$.{name}")).otherwise(loose[name])

    any_loose = F.coalesce(*loose.values(), F.when(listed != "", listed)).isNotNull()
    return d.select(
        *replies.columns,
        F.when(F.col("_whole").isNotNull(), "json").when(F.col("_fence").isNotNull(), "fence").when(F.col("_inner").isNotNull(), "object")
        .when(any_loose, "fields").otherwise("none").alias("found_as"),
        field("answer").alias("answer"),
        field("confidence").try_cast("double").alias("confidence"), field("reasoning").alias("reasoning"),
        F.when(has_json, F.coalesce(in_json, F.lit(""))).otherwise(strings).alias("citations"),
        repaired(F.col("reply")).alias("repaired"),
    )


def repaired(reply: Column) -> Column:
    """JSON after removing fences and trailing commas and turning single quotes; null if still none."""
    out = F.regexp_replace(reply, r"```(?:json)?\s*\n?", "")
    out = F.regexp_replace(out, r"(?m)```\s*$", "")
    out = F.regexp_replace(out, r",\s*([}\]])", "$1")
    out = F.replace(out, F.lit("'"), F.lit('"'))
    return F.coalesce(_object(out), _object(_balanced(out)))


def judge_score(reply: Column) -> Column:
    decimal = F.regexp_extract(reply, r"(\d+\.\d+)", 1).try_cast("double")
    digit = F.regexp_extract(reply, r"(\d)", 1).try_cast("double")
    return F.when(decimal <= 1, decimal).when(decimal <= 10, decimal / 10).when(digit.isNotNull(), digit / 10).otherwise(0.5)


def eval_score(reply: Column, metric: str) -> Column:
    as_json = _object(reply)
    number = F.regexp_extract(reply, r"\d+\.?\d*", 0).try_cast("double")
    from_json = F.coalesce(F.get_json_object(as_json, f"$.{metric}").try_cast("double"), F.lit(0.0))
    return F.when(as_json.isNotNull(), from_json / 10).otherwise(F.coalesce(number, F.lit(0.0)) / 10)
