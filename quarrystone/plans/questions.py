"""Query understanding, guardrails, citations, escalation, reply parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import guardrails as G
from ..operators import understanding as U
from ..sources.tables import table
from .inputs import ANSWERS, REQ, answers, choose, render, render_sql, requests, sql_list, sql_text
from .registry import query

W = "WITH " + REQ
WA = "WITH " + ANSWERS


def any_sql(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, {sql_text(p)})" for p in phrases) + ")"


def match_sql(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {sql_text(p)})" for p in patterns) + ")"


def words_sql(text: str) -> str:
    return rf"list_filter(string_split_regex(lower({text}), '\s+'), lambda w: w <> '')"


def set_sql(text: str) -> str:
    return f"list_distinct({words_sql(text)})"


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_FILTER = "CASE " + " ".join(f"WHEN {any_sql('lower(query)', w)} THEN '{t}'" for t, w in fixed.FILTER_KEYWORDS) + " END"
_ALL = "list_filter([" + ", ".join(f"CASE WHEN {any_sql('lower({q})', w)} THEN '{t}' END" for t, w in fixed.COMPANY_KEYWORDS) + "], lambda t: t IS NOT NULL)"


@query("extract_entity_filter", W + f" SELECT event_id, {_FILTER} AS ticker FROM req")
def extract_entity_filter(spark, d):
    return requests(spark, d).select("event_id", U.entity_filter(F.col("query")).alias("ticker"))


@query("extract_all_entities", W + f" SELECT event_id, array_to_string({_ALL.replace('{q}', 'query')}, ',') AS tickers FROM req")
def extract_all_entities(spark, d):
    return requests(spark, d).select("event_id", F.array_join(U.all_entities(F.col("query")), ",").alias("tickers"))


@query("extract_year", W + r" SELECT event_id, nullif(regexp_extract(query, '\b(20\d{2})\b', 1), '') AS year FROM req")
def extract_year(spark, d):
    return requests(spark, d).select("event_id", U.year(F.col("query")).alias("year"))


def _rewrite_sql() -> str:
    out = "query"
    for p, r in fixed.REWRITES:
        out = f"regexp_replace({out}, {sql_text(p)}, {sql_text(r)}, 'g')"
    return f"CASE WHEN len({words_sql('query')}) < 4 AND NOT {any_sql('upper(query)', fixed.TICKERS)} THEN {sql_text(fixed.SHORT_QUERY_PREFIX)} || {out} ELSE {out} END"


@query("rewrite_query", W + f" SELECT event_id, {_rewrite_sql()} AS rewritten FROM req")
def rewrite_query(spark, d):
    return requests(spark, d).select("event_id", U.rewrite(F.col("query")).alias("rewritten"))


_VARIANTS = ("{up}", "Explain {q} in detail", "tell me", "Explain {q} in detail")


@query("expand_variants", W + f""", v AS (SELECT event_id, query AS q, [{', '.join(render_sql(v, up='upper(query)', q='query') for v in _VARIANTS)}] AS vs FROM req),
c AS (SELECT event_id, 0 AS pos, q AS x FROM v UNION ALL SELECT event_id, i, x FROM (SELECT event_id, q, unnest(vs[:3]) AS x, unnest(range(1, 4)) AS i FROM v) WHERE lower(x) <> lower(q) AND len({words_sql('x')}) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id, {STRIP.format('lower(x)')} ORDER BY pos) AS n FROM c)
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS pos, x AS variant FROM r WHERE n = 1""")
def expand_variants(spark, d):
    variants = F.array(*[render(v, up=F.upper("query"), q=F.col("query")) for v in _VARIANTS])
    return requests(spark, d).select("event_id", F.posexplode(U.expand_variants(F.col("query"), variants)).alias("pos", "variant"))


@query("skip_retrieval", W + f" SELECT event_id, {match_sql(STRIP.format('lower(query)'), fixed.SKIP_RETRIEVAL)} AS skip FROM req")
def skip_retrieval(spark, d):
    return requests(spark, d).select("event_id", U.skip_retrieval(F.col("query")).alias("skip"))


_COMPLEXITY = f"CASE WHEN {any_sql('lower(query)', fixed.COMPLEX_KEYWORDS)} THEN 'complex' WHEN {any_sql('lower(query)', fixed.SIMPLE_KEYWORDS)} THEN 'simple' ELSE 'ambiguous' END"


@query("keyword_complexity", W + f" SELECT event_id, {_COMPLEXITY} AS complexity FROM req")
def keyword_complexity(spark, d):
    return requests(spark, d).select("event_id", U.keyword_complexity(F.col("query")).alias("complexity"))


def _predictions(spark, d):
    return requests(spark, d).select("event_id", "query", F.col("complexity").alias("label"), (F.col("tokens_in") / 100).alias("confidence"))


_ROUTED = f"""p AS (SELECT event_id, query, complexity AS label, tokens_in / 100 AS conf FROM req),
rt AS (SELECT event_id, query, CASE WHEN conf < 0.6 THEN {_COMPLEXITY} ELSE label END AS complexity, CASE WHEN conf < 0.6 THEN 'keywords' ELSE 'classifier' END AS method,
  CASE WHEN conf < 0.6 THEN CAST(0.7 AS DOUBLE) ELSE conf END AS confidence FROM p),
rm AS (SELECT *, CASE WHEN complexity = 'complex' THEN 'large' ELSE 'small' END AS model FROM rt)"""


@query("route", W + ", " + _ROUTED + " SELECT event_id, complexity, method, round(confidence, 6) AS confidence, model, round(length(query) / 4 * CASE WHEN model = 'large' THEN 0.25 ELSE 0.05 END / 1000000, 12) AS cost_estimate FROM rm")
def route(spark, d):
    out = U.route(_predictions(spark, d))
    return out.select("event_id", "complexity", "method", F.round("confidence", 6).alias("confidence"), "model", F.round("cost_estimate", 12).alias("cost_estimate"))


@query("ab_assign", W + ", " + _ROUTED + """, v AS (SELECT *, CASE WHEN CAST('0x' || left(md5(CAST(event_id AS VARCHAR)), 8) AS BIGINT) / 4294967296 < 0.3 THEN 'B' ELSE 'A' END AS variant FROM rm)
SELECT event_id, complexity, round(confidence, 6) AS confidence, variant, CASE WHEN variant = 'B' THEN 'large' ELSE 'small' END AS assigned_model FROM v""")
def ab_assign(spark, d):
    out = U.ab_assign(U.route(_predictions(spark, d)), 0.3, "small", "large", key="event_id")
    return out.select("event_id", "complexity", F.round("confidence", 6).alias("confidence"), "variant", "assigned_model")


# --- guardrails ----------------------------------------------------------------------------------


def _pii_sql(text: str) -> tuple[str, str]:
    issues = []
    for kind, pattern in fixed.PII_PATTERNS:
        issues.append(f"CASE WHEN regexp_matches({text}, {sql_text('(?i)' + pattern)}) THEN 'pii_{kind}_redacted' END")
        text = f"regexp_replace({text}, {sql_text(pattern)}, '[REDACTED_{kind.upper()}]', 'g')"
    return text, "list_filter([" + ", ".join(issues) + "], lambda i: i IS NOT NULL)"


_INJ = match_sql("{}", ["(?i)" + p for p in fixed.INJECTION_PATTERNS])
# every whole document, and every turn, is a question here
ASKED_TEXTS = """tx AS (SELECT doc_id AS id, text AS query FROM documents UNION ALL SELECT -1 - conv_id * 1000 - turn, CASE WHEN turn % 5 = 0 THEN role || ' : ' || text WHEN turn % 7 = 3 THEN ' a ' ELSE text END FROM conversations)"""


def _texts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("query"))
    turns = table(spark, d, "conversations").select(
        (-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("id"),
        F.when(F.col("turn") % 5 == 0, F.concat("role", F.lit(" : "), "text")).when(F.col("turn") % 7 == 3, " a ").otherwise(F.col("text")).alias("query"))
    return docs.unionByName(turns)


@query("validate_input", "WITH " + ASKED_TEXTS + f""", s AS (SELECT id, left({STRIP.format('query')}, 2000) AS s, length({STRIP.format('query')}) AS n FROM tx),
f AS (SELECT *, {_INJ.replace('{}', 's')} AS bad, n < 3 AS short FROM s)
SELECT id, NOT short AND NOT bad AS passed, CASE WHEN short THEN 'query_too_short' WHEN bad THEN 'prompt_injection_detected' ELSE
  array_to_string(list_concat(CASE WHEN n > 2000 THEN ['query_truncated'] ELSE CAST([] AS VARCHAR[]) END, {_pii_sql('s')[1]}), ',') END AS issues,
  CASE WHEN NOT short AND NOT bad THEN {_pii_sql('s')[0]} END AS sanitized FROM f""")
def validate_input(spark, d):
    out = G.validate_input(_texts(spark, d))
    return out.select("id", "passed", F.array_join("issues", ",").alias("issues"), "sanitized")


@query("redact_pii", f"SELECT doc_id, {_pii_sql('text')[0]} AS text, array_to_string({_pii_sql('text')[1]}, ',') AS issues FROM documents")
def redact_pii(spark, d):
    clean, issues = G.redact_pii(F.col("text"))
    return table(spark, d, "documents").select("doc_id", clean.alias("text"), F.array_join(issues, ",").alias("issues"))


@query("detect_injection", "WITH " + ASKED_TEXTS + f" SELECT id, {_INJ.replace('{}', 'query')} AS injected FROM tx")
def detect_injection(spark, d):
    return _texts(spark, d).select("id", G.detect_injection(F.col("query")).alias("injected"))


def amounts_sql(text: str, flags: str = "(?i)") -> str:
    return f"regexp_extract_all({text}, {sql_text(flags + fixed.DOLLAR_AMOUNT)})"


_LOOSE = f"list_filter(list_transform({amounts_sql('answer')}, lambda a: {STRIP.format('a')}), lambda a: NOT contains(lower(context), lower(a)))"


def nouns_sql(text: str) -> str:
    # RE2's word boundary knows ASCII only: take whole words, keep the plain ones
    runs = rf"list_distinct(regexp_extract_all(lower({text}), '[\p{{L}}\p{{M}}\p{{N}}_]+'))"
    return f"list_filter({runs}, lambda w: regexp_full_match(w, '[a-z]{{4,}}') AND w NOT IN ({', '.join(sql_text(w) for w in fixed.NOUN_STOP_WORDS)}))"


_NOUNS = f"(CASE WHEN len({nouns_sql('answer')}) > 0 THEN len(list_intersect({nouns_sql('answer')}, {nouns_sql('context')})) / len({nouns_sql('answer')}) END)"


def in_sql(text: str, phrases) -> str:
    return f"list_filter({sql_list(phrases)}, lambda p: contains(lower({text}), p))"


@query("ungrounded_amounts", WA + f" SELECT qid, array_to_string({_LOOSE}, '|') AS loose FROM qa")
def ungrounded_amounts(spark, d):
    return answers(spark, d).select("qid", F.array_join(G.ungrounded_amounts(F.col("answer"), F.col("context")), "|").alias("loose"))


@query("noun_grounding", WA + f" SELECT qid, round({_NOUNS}, 6) AS ratio FROM qa")
def noun_grounding(spark, d):
    return answers(spark, d).select("qid", F.round(G.noun_grounding(F.col("answer"), F.col("context")), 6).alias("ratio"))


_OUT_ISSUES = f"""list_concat(list_transform({in_sql('answer', fixed.ADVICE_KEYWORDS)}, lambda p: 'financial_advice_language: ' || p),
  list_concat(CASE WHEN g < 0.3 THEN ['low_grounding: ' || printf('%.2f', round(g, 2))] ELSE CAST([] AS VARCHAR[]) END,
  list_concat(list_transform({in_sql('answer', fixed.HEDGE_PHRASES)}, lambda p: 'hallucination_indicator: ' || p),
  list_concat(CASE WHEN r < 0.2 THEN ['low_relevance: ' || printf('%.2f', round(r, 2))] ELSE CAST([] AS VARCHAR[]) END,
  list_concat(list_transform({_LOOSE}, lambda a: 'ungrounded_amount: ' || a),
  CASE WHEN n < 0.2 THEN ['low_semantic_grounding: ' || printf('%.2f', round(n, 2))] ELSE CAST([] AS VARCHAR[]) END)))))"""


@query("validate_output", WA + f""", w AS (SELECT qid, answer, context, {set_sql('answer')} AS a, {set_sql('context')} AS c, {set_sql('query')} AS q, {_NOUNS} AS n FROM qa),
m AS (SELECT *, CASE WHEN len(a) > 0 THEN len(list_intersect(a, c)) / len(a) END AS g, CASE WHEN len(q) > 0 THEN len(list_intersect(q, a)) / len(q) END AS r FROM w),
i AS (SELECT qid, {_OUT_ISSUES} AS z FROM m)
SELECT qid, len(z) = 0 AS passed, array_to_string(CASE WHEN len(z) > 0 THEN list_append(z, 'add_disclaimer') ELSE z END, '|') AS issues FROM i""")
def validate_output(spark, d):
    return G.validate_output(answers(spark, d)).select("qid", "passed", F.array_join("issues", "|").alias("issues"))


@query("add_disclaimer", WA + f" SELECT qid, answer || {sql_text(fixed.DISCLAIMER)} AS once, answer || {sql_text(fixed.DISCLAIMER)} AS twice FROM qa")
def add_disclaimer(spark, d):
    once = answers(spark, d).select("qid", G.add_disclaimer(F.col("answer")).alias("once"))
    return once.select("qid", "once", G.add_disclaimer(F.col("once")).alias("twice"))


def pairs_sql(text: str, pattern: str) -> str:
    a, b = (f"regexp_extract_all({text}, {sql_text(pattern)}, {g})" for g in (1, 2))
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] || ' ' || z[2])"


@query("extract_citations", WA + f""", m AS (SELECT qid, {pairs_sql('context', fixed.CITATION_IN_CONTEXT)} AS z, {_ALL.replace('{q}', 'query')} AS t FROM qa),
u AS (SELECT qid, t, list_filter(z, lambda x, i: list_position(z, x) = i) AS z FROM m)
SELECT qid, array_to_string(list_filter(z, lambda x: len(t) = 0 OR list_contains(t, string_split(x, ' ')[1]))[:5], ',') AS citations FROM u""")
def extract_citations(spark, d):
    found = G.extract_citations(F.col("context"), U.all_entities(F.col("query")))
    return answers(spark, d).select("qid", F.array_join(found, ",").alias("citations"))


@query("verify_citations", WA + f" SELECT qid, array_to_string(list_filter({pairs_sql('answer', fixed.CITATION_IN_ANSWER)}, lambda x: contains(lower(context), lower(x))), ',') AS valid FROM qa")
def verify_citations(spark, d):
    return answers(spark, d).select("qid", F.array_join(G.verify_citations(F.col("answer"), F.col("context")), ",").alias("valid"))


@query("verification_score", WA + f""", i AS (SELECT qid, len(list_filter({amounts_sql('answer', '')}, lambda a: NOT contains(lower(context), lower(a)))) + CASE WHEN len({words_sql('answer')}) < 10 THEN 1 ELSE 0 END AS n FROM qa)
SELECT qid, n AS issues, round(greatest(0, 1 - n * 0.2), 6) AS score FROM i""")
def verification_score(spark, d):
    issues, score = G.verification(F.col("answer"), F.col("context"))
    return answers(spark, d).select("qid", F.size(issues).alias("issues"), F.round(score, 6).alias("score"))


@query("clean_response", WA + r" SELECT qid, " + STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(answer, '(?s)```tool_code.*?```', '', 'g'), '(?s)<tool_call>.*?</tool_call>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + " AS answer FROM qa")
def clean_response(spark, d):
    return answers(spark, d).select("qid", G.clean_response(F.col("answer")).alias("answer"))


_SAID = ("I think so, maybe.", "Yes.", "Possibly, but I am not sure.")
ESC = W + f""", ei AS (SELECT event_id, us, date, query, ({sql_list(_SAID)})[tokens_in % 3 + 1] AS answer, (tokens_in % 10) / 10 AS c, user_id % 6 AS g, tokens_in % 3 AS f FROM req),
ep AS (SELECT *, {in_sql('query', fixed.HIGH_STAKES)} AS hs, len({in_sql('answer', fixed.ESCALATION_HEDGES)}) AS hd FROM ei),
er AS (SELECT event_id, us, date, CASE WHEN c < 0.5 THEN 'low_confidence:' || printf('%.2f', round(c, 2)) WHEN g > 3 THEN 'too_many_guardrail_issues:' || CAST(g AS VARCHAR)
  WHEN f >= 2 THEN 'reflection_flagged:' || CAST(f AS VARCHAR) || '_issues' WHEN len(hs) > 0 THEN 'high_stakes_keyword:' || hs[1] WHEN hd >= 2 THEN 'hedging_language:' || CAST(hd AS VARCHAR) END AS reason FROM ep)"""


def _escalations(spark, d):
    r = requests(spark, d)
    k = F.col("tokens_in")
    reason = G.escalation_reason(F.col("query"), choose(k % 3, _SAID), (k % 10) / 10, (F.col("user_id") % 6).cast("int"), (k % 3).cast("int"))
    return r.select("event_id", "us", "date", reason.alias("reason"))


@query("escalate", ESC + " SELECT event_id, reason IS NOT NULL AS escalate, coalesce(reason, '') AS reason FROM er")
def escalate(spark, d):
    e = _escalations(spark, d)
    return e.select("event_id", F.col("reason").isNotNull().alias("escalate"), F.coalesce("reason", F.lit("")).alias("reason"))


@query("escalation_queue", ESC + """, t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY us, event_id) AS no FROM er WHERE reason IS NOT NULL)
SELECT 'ESC-' || replace(date, '-', '') || '-' || lpad(CAST(no AS VARCHAR), CAST(greatest(4, length(CAST(no AS VARCHAR))) AS INT), '0') AS ticket_id, event_id, reason,
  CASE WHEN doc_id IS NULL THEN 'pending' ELSE 'resolved' END AS status, 'label ' || CAST(quality AS VARCHAR) AS final_answer FROM t LEFT JOIN labels ON doc_id = event_id""")
def escalation_queue(spark, d):
    decisions = table(spark, d, "labels").select(F.col("doc_id").alias("event_id"), F.concat(F.lit("label "), F.col("quality").cast("string")).alias("final_answer"))
    return G.escalation_queue(_escalations(spark, d).where(F.col("reason").isNotNull()), decisions)


# --- replies ----------------------------------------------------------------------------------------
_REPLIES = (
    '{{"answer": "{t}", "confidence": 0.8, "citations": ["A 1", "B 2"], "reasoning": "r"}}',
    'Here:\n```json\n{{"answer": "{t}", "confidence": 0.5}}\n```\nDone.',
    'I say {{"answer": "{t}", "more": {{"a": 1}}, "reasoning": "why"}} and no more }}',
    '"answer": "{t}", "confidence": 0.25, "citations": ["C 3"] {{ open',
    "{{'answer': 'x', 'confidence': 0.5,}}",
    "{t}",
)
_CLEAN = r"""regexp_replace(text, '["''{}\\\x00-\x1f]', ' ', 'g')"""


def _reply_sql() -> str:
    parts = []
    for i, r in enumerate(_REPLIES):
        bits = [sql_text(b.replace("{{", "{").replace("}}", "}")) for b in r.split("{t}")]
        parts.append(f"WHEN (conv_id + turn) % {len(_REPLIES)} = {i} THEN " + " || t || ".join(bits))
    return "CASE " + " ".join(parts) + " END"


_OBJ = r"regexp_extract(reply, '\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}')"
_VALID = "CASE WHEN try_cast({} AS JSON) IS NOT NULL AND json_type(try_cast({} AS JSON)) = 'OBJECT' THEN {} END"


@query("parse_structured", f"""WITH s AS (SELECT conv_id, turn, {_CLEAN} AS t FROM conversations), p AS (SELECT conv_id, turn, {_reply_sql()} AS reply FROM s),
q AS (SELECT *, trim(reply) AS w, regexp_extract(reply, '(?s)```(?:json)?\\s*\\n(.*?)\\n\\s*```', 1) AS f, {_OBJ} AS o, regexp_replace(regexp_replace(regexp_replace(reply, '```(?:json)?\\s*\\n?', '', 'g'), ',\\s*([}}\\]])', '\\1', 'g'), '''', '"', 'g') AS rp FROM p),
v AS (SELECT *, {_VALID.replace('{}', 'w')} AS jw, {_VALID.replace('{}', 'f')} AS jf, {_VALID.replace('{}', 'o')} AS jo, {_OBJ.replace('reply', 'rp')} AS ro FROM q),
j AS (SELECT *, coalesce(jw, jf, jo) AS js FROM v)
SELECT conv_id, turn, CASE WHEN jw IS NOT NULL THEN 'json' WHEN jf IS NOT NULL THEN 'fence' WHEN jo IS NOT NULL THEN 'object' WHEN contains(reply, '"answer"') THEN 'fields' ELSE 'none' END AS found_as,
  CASE WHEN js IS NOT NULL THEN json_extract_string(js, '$.answer') ELSE nullif(regexp_extract(reply, '"answer"\\s*:\\s*"([^"]*)"', 1), '') END AS answer,
  CASE WHEN js IS NOT NULL THEN CAST(json_extract_string(js, '$.confidence') AS DOUBLE) ELSE try_cast(regexp_extract(reply, '"confidence"\\s*:\\s*([\\d.]+)', 1) AS DOUBLE) END AS confidence,
  CASE WHEN js IS NOT NULL THEN json_extract_string(js, '$.reasoning') END AS reasoning,
  CASE WHEN js IS NOT NULL THEN CASE WHEN jw IS NOT NULL THEN 'A 1,B 2' ELSE '' END WHEN contains(reply, '"citations"') THEN 'C 3' ELSE '' END AS citations,
  ({_VALID.replace('{}', 'ro')}) IS NOT NULL AS repairable FROM j""")
def parse_structured(spark, d):
    clean = F.regexp_replace("text", r"""["'{}\\\x00-\x1f]""", " ")
    turns = table(spark, d, "conversations").select("conv_id", "turn", clean.alias("t"))
    reply = None
    for i, r in enumerate(_REPLIES):
        bits = [F.lit(b.replace("{{", "{").replace("}}", "}")) for b in r.split("{t}")]
        text = bits[0] if len(bits) == 1 else F.concat(bits[0], F.col("t"), bits[1])
        hit = (F.col("conv_id") + F.col("turn")) % len(_REPLIES) == i
        reply = F.when(hit, text) if reply is None else reply.when(hit, text)
    out = G.parse_structured(turns.select("conv_id", "turn", reply.alias("reply")))
    return out.select("conv_id", "turn", "found_as", "answer", "confidence", "reasoning", "citations", F.col("repaired").isNotNull().alias("repairable"))


_JUDGE = ("Score: {v}", "0.85 of one", "{v}/10", "I give {k}", "no score", "{v} then 7", '{"relevance": {k}, "x": 1}', '{"x": 1}')


def _judge_sql() -> str:
    out = []
    for i, r in enumerate(_JUDGE):
        body = sql_text(r).replace("{k}", "' || CAST(k AS VARCHAR) || '").replace("{v}", "' || CAST(value AS VARCHAR) || '")
        out.append(f"WHEN k % {len(_JUDGE)} = {i} THEN {body}")
    return "CASE " + " ".join(out) + " END"


JUDGED_TEXT = f"jt AS (SELECT event_id, {_judge_sql()} AS reply FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"


def _judge_replies(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    reply = None
    for i, r in enumerate(_JUDGE):
        text = F.replace(F.replace(F.lit(r), F.lit("{k}"), k.cast("string")), F.lit("{v}"), F.col("value").cast("string"))
        hit = k % len(_JUDGE) == i
        reply = F.when(hit, text) if reply is None else reply.when(hit, text)
    return table(spark, d, "events").select("event_id", reply.alias("reply"))


@query("parse_judge_score", "WITH " + JUDGED_TEXT + r""", s AS (SELECT event_id, try_cast(regexp_extract(reply, '(\d+\.\d+)', 1) AS DOUBLE) AS a, try_cast(regexp_extract(reply, '(\d)', 1) AS DOUBLE) AS b FROM jt)
SELECT event_id, round(CASE WHEN a <= 1 THEN a WHEN a <= 10 THEN a / 10 WHEN b IS NOT NULL THEN b / 10 ELSE 0.5 END, 6) AS score FROM s""")
def parse_judge_score(spark, d):
    return _judge_replies(spark, d).select("event_id", F.round(G.judge_score(F.col("reply")), 6).alias("score"))


@query("parse_eval_score", "WITH " + JUDGED_TEXT + r""" SELECT event_id, round(CASE WHEN reply LIKE '{%' THEN coalesce(CAST(json_extract_string(reply, '$.relevance') AS DOUBLE), 0) / 10
  ELSE coalesce(try_cast(regexp_extract(reply, '\d+\.?\d*') AS DOUBLE), 0) / 10 END, 6) AS score FROM jt""")
def parse_eval_score(spark, d):
    return _judge_replies(spark, d).select("event_id", F.round(G.eval_score(F.col("reply"), "relevance"), 6).alias("score"))
