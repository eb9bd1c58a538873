"""P4-P12, V10, D4, X3-X5, G1-G4, F1-F8 on driver tables.

Each query derives its input text from driver columns with one fixed rule that
is spelled identically in Spark and in the oracle SQL; the oracle then re-parses
that text with SQL regexes.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from variantlake import constants as K
from variantlake.functions import text as TX
from variantlake.functions.latex import answers_equal, normalize_latex
from variantlake.functions.parse import parse_problems
from variantlake.operators import prompts as PR
from variantlake.operators import verify as V
from variantlake.operators.verify import score_exact
from variantlake.plans import sqlfrag as S
from variantlake.plans.registry import register, spread, table
from variantlake.session import scratch_path

# ---------------------------------------------------------------------------
# P6 extract_answer: documents wrapped in answer tags at known places
# ---------------------------------------------------------------------------
_RESP_SQL = """CASE lang
  WHEN 'de' THEN 'no tags here: ' || text
  WHEN 'fr' THEN '<answer>integrate(' || text || ', x)</answer>'
  WHEN 'es' THEN '<instruction><answer>' || source || '</answer></instruction> <answer>' || text || '</answer>'
  ELSE '<answer>' || source || E'</answer>\\n<ANSWER>\\n' || text || E'\\n</Answer> done'
END"""


def _response_col():
    t, s = F.col("text"), F.col("source")
    return (F.when(F.col("lang") == "de", F.concat(F.lit("no tags here: "), t))
            .when(F.col("lang") == "fr", F.concat(F.lit("<answer>integrate("), t, F.lit(", x)</answer>")))
            .when(F.col("lang") == "es", F.concat(F.lit("<instruction><answer>"), s,
                                                  F.lit("</answer></instruction> <answer>"), t, F.lit("</answer>")))
            .otherwise(F.concat(F.lit("<answer>"), s, F.lit("</answer>\n<ANSWER>\n"), t, F.lit("\n</Answer> done"))))


@register("extract_answer", f"""
WITH r AS (SELECT doc_id, {_RESP_SQL} AS response FROM documents)
SELECT doc_id, {S.extract_answer('response')} AS answer,
       {S.strip("(CASE WHEN strpos(response, '</instruction>') > 0 THEN string_split(response, '</instruction>')[-1] ELSE response END)")} AS flexible
FROM r
""")
def q_extract_answer(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", _response_col().alias("response"))
    return docs.select("doc_id", TX.extract_answer("response").alias("answer"),
                       TX.py_strip(TX.after_last("response", "</instruction>")).alias("flexible"))


# ---------------------------------------------------------------------------
# P7 extract_boxed and V10 score_exact: part names in \boxed{...}
# ---------------------------------------------------------------------------
_BOXED_SQL = r"""CASE p_type
  WHEN 'PROMO' THEN 'only \fbox{' || p_name || '}'
  WHEN 'SMALL' THEN 'so \boxed ' || p_name || '$ done'
  WHEN 'LARGE' THEN 'open \boxed{' || p_name
  WHEN 'MEDIUM' THEN '\boxed{' || p_name || '} and $\boxed{\frac{' || p_size || '}{2}}$'
  ELSE 'We get $\boxed{\frac{' || p_size || '}{' || p_partkey || '}}$ first, then \boxed{' || p_name || '} finally.'
END"""


def _boxed_col():
    ty, nm = F.col("p_type"), F.col("p_name")
    sz, pk = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    return (F.when(ty == "PROMO", F.concat(F.lit("only \\fbox{"), nm, F.lit("}")))
            .when(ty == "SMALL", F.concat(F.lit("so \\boxed "), nm, F.lit("$ done")))
            .when(ty == "LARGE", F.concat(F.lit("open \\boxed{"), nm))
            .when(ty == "MEDIUM", F.concat(F.lit("\\boxed{"), nm, F.lit("} and $\\boxed{\\frac{"), sz, F.lit("}{2}}$")))
            .otherwise(F.concat(F.lit("We get $\\boxed{\\frac{"), sz, F.lit("}{"), pk,
                                F.lit("}}$ first, then \\boxed{"), nm, F.lit("} finally."))))


_BOXED_EXTRACT_SQL = r"""CASE
  WHEN strpos(t, '\boxed ') > 0 THEN split_part(string_split(t, '\boxed ')[-1], '$', 1)
  ELSE regexp_extract_all(t, '\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}', 1)[-1]
END"""


@register("extract_boxed", f"""
WITH r AS (SELECT p_partkey, {_BOXED_SQL} AS t FROM part)
SELECT p_partkey, {_BOXED_EXTRACT_SQL} AS boxed FROM r
""")
def q_extract_boxed(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", _boxed_col().alias("t"))
    return p.select("p_partkey", TX.extract_boxed("t").alias("boxed"))


@register("score_exact", f"""
WITH r AS (SELECT p_partkey, p_name, {_BOXED_SQL} AS t FROM part),
b AS (SELECT p_partkey, p_name, {_BOXED_EXTRACT_SQL} AS boxed FROM r)
SELECT p_partkey, CAST(CASE WHEN boxed IS NOT NULL AND replace(boxed, ' ', '') = replace(p_name, ' ', '') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score
FROM b
""")
def q_score_exact(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", _boxed_col().alias("t"))
    return score_exact(p, response="t", truth="p_name").select("p_partkey", "score")


# ---------------------------------------------------------------------------
# P4/P5 clean_expr: answer-like text from p_size and p_type
# ---------------------------------------------------------------------------
_EXPR_SQL = r"""CASE p_type
  WHEN 'ECONOMY' THEN '\(' || p_size || '*e^x + \ln(x) + C\)'
  WHEN 'PROMO' THEN 'arcsin(x)*' || p_size || ' * ... + x^' || p_size
  WHEN 'LARGE' THEN 'e**' || p_size || '*x + \arccos(x)...'
  WHEN 'SMALL' THEN '$x^' || p_size || '$ + C'
  WHEN 'MEDIUM' THEN '  \sqrt(' || p_name || ') + \arctan(x)  '
  ELSE ''
END"""


def _expr_col():
    ty, sz = F.col("p_type"), F.col("p_size").cast("string")
    return (F.when(ty == "ECONOMY", F.concat(F.lit("\\("), sz, F.lit("*e^x + \\ln(x) + C\\)")))
            .when(ty == "PROMO", F.concat(F.lit("arcsin(x)*"), sz, F.lit(" * ... + x^"), sz))
            .when(ty == "LARGE", F.concat(F.lit("e**"), sz, F.lit("*x + \\arccos(x)...")))
            .when(ty == "SMALL", F.concat(F.lit("$x^"), sz, F.lit("$ + C")))
            .when(ty == "MEDIUM", F.concat(F.lit("  \\sqrt("), F.col("p_name"), F.lit(") + \\arctan(x)  ")))
            .otherwise(F.lit("")))


@register("clean_expr", f"""
WITH r AS (SELECT p_partkey, {_EXPR_SQL} AS e FROM part)
SELECT p_partkey, {S.clean_expr('e', 'current')} AS cleaned, {S.clean_expr('e', 'legacy')} AS cleaned_legacy,
       {S.clean_expr('e', 'legacy_boxed')} AS cleaned_boxed
FROM r
""")
def q_clean_expr(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", _expr_col().alias("e"))
    return p.select("p_partkey", TX.clean_expr("e").alias("cleaned"),
                    TX.clean_expr("e", "legacy").alias("cleaned_legacy"),
                    TX.clean_expr("e", "legacy_boxed").alias("cleaned_boxed"))


# ---------------------------------------------------------------------------
# P8/P9 normalize_latex: \frac spellings of p_size/2
# ---------------------------------------------------------------------------
_FRAC_SQL = r"""CASE p_type
  WHEN 'ECONOMY' THEN '\dfrac{' || p_size || '}{2}'
  WHEN 'PROMO' THEN p_size || '/2'
  WHEN 'LARGE' THEN '\left(\frac{' || p_size || '}{2}\right)'
  WHEN 'SMALL' THEN 'k = \tfrac{' || p_size || '}{2}'
  WHEN 'MEDIUM' THEN '\frac' || (p_size % 10) || '2'
  ELSE NULL
END"""


def _frac_col():
    ty, sz = F.col("p_type"), F.col("p_size").cast("string")
    return (F.when(ty == "ECONOMY", F.concat(F.lit("\\dfrac{"), sz, F.lit("}{2}")))
            .when(ty == "PROMO", F.concat(sz, F.lit("/2")))
            .when(ty == "LARGE", F.concat(F.lit("\\left(\\frac{"), sz, F.lit("}{2}\\right)")))
            .when(ty == "SMALL", F.concat(F.lit("k = \\tfrac{"), sz, F.lit("}{2}")))
            .when(ty == "MEDIUM", F.concat(F.lit("\\frac"), (F.col("p_size") % 10).cast("string"), F.lit("2"))))


_NORM_SQL = r"""regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(
   replace(replace(replace(replace(a, 'dfrac', 'frac'), 'tfrac', 'frac'), '\left', ''), '\right', ''),
   '^[^=]{0,2}=([^=]*)$', '\1'), ' ', ''),
   '\\frac([^{])([^{])', '\\frac{\1}{\2}', 'g'),
   '^([0-9]+)/([0-9]+)$', '\\frac{\1}{\2}'), '^0\.5$', '\\frac{1}{2}')"""


@register("normalize_latex", f"""
WITH r AS (SELECT p_partkey, {_FRAC_SQL} AS a, '\\frac{{' || (CASE WHEN p_type = 'MEDIUM' THEN p_size % 10 ELSE p_size END) || '}}{{2}}' AS b FROM part),
n AS (SELECT p_partkey, a, b, {_NORM_SQL} AS na FROM r)
SELECT p_partkey, na AS normalized, CASE WHEN a IS NULL THEN false ELSE na = b END AS equal FROM n
""")
def q_normalize_latex(spark, sf):
    p = table(spark, sf, "part")
    b = F.concat(F.lit("\\frac{"), F.when(F.col("p_type") == "MEDIUM", F.col("p_size") % 10)
                 .otherwise(F.col("p_size")).cast("string"), F.lit("}{2}"))
    r = p.select("p_partkey", _frac_col().alias("a"), b.alias("b"))
    return r.select("p_partkey", normalize_latex(F.col("a")).alias("normalized"),
                    answers_equal(F.col("a"), F.col("b")).alias("equal"))


# ---------------------------------------------------------------------------
# P10 parse_judge: verdict texts from lineitem
# ---------------------------------------------------------------------------
_JUDGE_TEXT_SQL = """CASE l_linenumber
  WHEN 1 THEN 'verdict ' || l_returnflag || ': <JUDGE_SCORE>1</JUDGE_SCORE>'
  WHEN 2 THEN 'no match <judge_score> 0 </judge_score>'
  WHEN 3 THEN '<JUDGE_SCORE>2</JUDGE_SCORE>'
  WHEN 4 THEN 'I think it is right (' || l_linestatus || ')'
  WHEN 5 THEN ''
  WHEN 6 THEN '<JUDGE_SCORE>0</JUDGE_SCORE> wait <JUDGE_SCORE>' || chr(10) || '1' || chr(10) || '</JUDGE_SCORE>'
  ELSE NULL
END"""


def _judge_text_col():
    n = F.col("l_linenumber")
    return (F.when(n == 1, F.concat(F.lit("verdict "), F.col("l_returnflag"), F.lit(": <JUDGE_SCORE>1</JUDGE_SCORE>")))
            .when(n == 2, F.lit("no match <judge_score> 0 </judge_score>"))
            .when(n == 3, F.lit("<JUDGE_SCORE>2</JUDGE_SCORE>"))
            .when(n == 4, F.concat(F.lit("I think it is right ("), F.col("l_linestatus"), F.lit(")")))
            .when(n == 5, F.lit(""))
            .when(n == 6, F.lit("<JUDGE_SCORE>0</JUDGE_SCORE> wait <JUDGE_SCORE>\n1\n</JUDGE_SCORE>")))


_PARSED_JUDGE_SQL = f"""CASE WHEN j IS NULL OR j = '' THEN 'NO_JUDGE_RESPONSE'
  WHEN TRY_CAST({S.last_tag('j', 'JUDGE_SCORE')} AS INTEGER) = 1 THEN 'OK'
  WHEN TRY_CAST({S.last_tag('j', 'JUDGE_SCORE')} AS INTEGER) = 0 THEN 'NO_OK' ELSE 'ERROR' END"""


@register("parse_judge", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {_JUDGE_TEXT_SQL} AS j FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, {_PARSED_JUDGE_SQL} AS judge_status FROM r)
SELECT l_orderkey, l_linenumber, CASE WHEN judge_status = 'OK' THEN 1 ELSE 0 END AS judge_result, judge_status FROM s
""")
def q_parse_judge(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _judge_text_col().alias("j"))
    p = TX.parse_judge("j")
    return li.select("l_orderkey", "l_linenumber", p["judge_result"].alias("judge_result"),
                     p["judge_status"].alias("judge_status"))


# ---------------------------------------------------------------------------
# P11 parse_generations: documents as generation responses with ==== blocks
# ---------------------------------------------------------------------------
_GEN_SQL = r"""'Here are the variants' || chr(10) || '====' || chr(10)
 || 'Variant 1:' || chr(10) || 'Reasoning: ' || source || ' persona' || chr(10) || 'Variant: integrate(x**' || (doc_id % 5 + 1) || ', x)' || chr(10) || '====' || chr(10)
 || 'Variant 2:' || chr(10) || 'Reasoning: none' || chr(10) || 'Variant: integrate(sin(x), y)' || chr(10) || '====' || chr(10)
 || 'Variant 3:' || chr(10) || 'Variant: integrate(' || lang || '*x, x)' || chr(10) || '====' || chr(10)
 || 'Variant 4:' || chr(10) || 'Reasoning: ' || text || chr(10) || 'Variant: integrate(exp(x)*' || n_chars || ', x)' || chr(10) || '===='"""


def _gen_col():
    nl = F.lit("\n")
    sep = F.lit("\n====\n")
    return F.concat(
        F.lit("Here are the variants"), sep,
        F.lit("Variant 1:\nReasoning: "), F.col("source"), F.lit(" persona\nVariant: integrate(x**"),
        (F.col("doc_id") % 5 + 1).cast("string"), F.lit(", x)"), sep,
        F.lit("Variant 2:\nReasoning: none\nVariant: integrate(sin(x), y)"), sep,
        F.lit("Variant 3:\nVariant: integrate("), F.col("lang"), F.lit("*x, x)"), sep,
        F.lit("Variant 4:\nReasoning: "), F.col("text"), nl, F.lit("Variant: integrate(exp(x)*"),
        F.col("n_chars").cast("string"), F.lit(", x)"), F.lit("\n===="),
    )


@register("parse_generations", rf"""
WITH r AS (SELECT doc_id, {_GEN_SQL} AS response FROM documents),
b AS (SELECT doc_id, unnest(string_split_regex(response, '====\s*')) AS block,
             unnest(range(len(string_split_regex(response, '====\s*')))) AS block_idx FROM r),
p AS (
  SELECT doc_id, CAST(block_idx AS INTEGER) AS block_idx,
         {S.strip("regexp_extract(block, '(?s)Reasoning:\\s*(.*?)\\s*Variant:', 1)")} AS reasoning,
         {S.strip("regexp_extract(block, 'Variant:\\s*(integrate\\([^,]+,\\s*x\\))', 1)")} AS variant
  FROM b WHERE strpos(block, 'Variant:') > 0 AND strpos(block, 'Reasoning:') > 0
)
SELECT * FROM p WHERE variant <> ''
""")
def q_parse_generations(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", _gen_col().alias("response"))
    return TX.parse_generations(docs, "response", keep=("doc_id",))


# ---------------------------------------------------------------------------
# P12 parse_difficulty: events as one-word difficulty verdicts
# ---------------------------------------------------------------------------
@register("parse_difficulty", rf"""
WITH r AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE '  ' || upper(event_type) || ' because ' || props END AS resp FROM events)
SELECT event_id, coalesce(nullif(lower(regexp_extract(resp, '^{S.WS}*([^\t\n\x0B\f\r\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+)', 1)), ''), 'unknown') AS difficulty FROM r
""")
def q_parse_difficulty(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.lit(None))
        .otherwise(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" because "), F.col("props"))).alias("resp"))
    return ev.select("event_id", TX.parse_difficulty("resp").alias("difficulty"))


# ---------------------------------------------------------------------------
# P1-P3, P13 parse_problems: integrate(...) calls built from part rows
# ---------------------------------------------------------------------------
_CALL_SQL = """CASE p_type
  WHEN 'ECONOMY' THEN 'integrate(' || p_size || '*x**2, (x, 0, ' || p_size || '))'
  WHEN 'PROMO' THEN 'integrate(sin(' || p_size || '*x), x)'
  WHEN 'LARGE' THEN 'integrate(f(x, ' || p_size || '), t, 1, ' || p_size || ')'
  WHEN 'SMALL' THEN 'integrate(x^' || p_size || ' + C, (x, -1, 2))'
  WHEN 'MEDIUM' THEN 'integrate(x, ' || p_name || ')'
  ELSE 'Integral of x'
END"""


def call_col():
    ty, sz = F.col("p_type"), F.col("p_size").cast("string")
    return (F.when(ty == "ECONOMY", F.concat(F.lit("integrate("), sz, F.lit("*x**2, (x, 0, "), sz, F.lit("))")))
            .when(ty == "PROMO", F.concat(F.lit("integrate(sin("), sz, F.lit("*x), x)")))
            .when(ty == "LARGE", F.concat(F.lit("integrate(f(x, "), sz, F.lit("), t, 1, "), sz, F.lit(")")))
            .when(ty == "SMALL", F.concat(F.lit("integrate(x^"), sz, F.lit(" + C, (x, -1, 2))")))
            .when(ty == "MEDIUM", F.concat(F.lit("integrate(x, "), F.col("p_name"), F.lit(")")))
            .otherwise(F.lit("Integral of x")))


_TUPLE_RE = r"^integrate\((.*), \((\w), ([^,]*), ([^,]*)\)\)$"
_SEP_RE = r"^integrate\((.*), (\w+), ([^,]+), ([^,]+)\)$"
_IND_RE = r"^integrate\((.*), ([^,()]+)\)$"


@register("parse_problems", rf"""
WITH r AS (SELECT p_partkey, {_CALL_SQL} AS c FROM part),
m AS (
  SELECT p_partkey, c,
    CASE WHEN regexp_matches(c, '{_TUPLE_RE}') THEN 'DEFINITE_TUPLE'
         WHEN regexp_matches(c, '{_SEP_RE}') THEN 'DEFINITE_SEPARATE'
         WHEN regexp_matches(c, '{_IND_RE}') AND length(regexp_extract(c, '{_IND_RE}', 2)) = 1 THEN 'INDEFINITE'
         ELSE 'ERROR' END AS kind
  FROM r
), p AS (
  SELECT p_partkey, c, kind,
    CASE kind WHEN 'DEFINITE_TUPLE' THEN regexp_extract(c, '{_TUPLE_RE}', 1)
              WHEN 'DEFINITE_SEPARATE' THEN regexp_extract(c, '{_SEP_RE}', 1)
              WHEN 'INDEFINITE' THEN regexp_extract(c, '{_IND_RE}', 1) END AS raw_integrand,
    CASE kind WHEN 'DEFINITE_TUPLE' THEN regexp_extract(c, '{_TUPLE_RE}', 2)
              WHEN 'DEFINITE_SEPARATE' THEN regexp_extract(c, '{_SEP_RE}', 2)
              WHEN 'INDEFINITE' THEN regexp_extract(c, '{_IND_RE}', 2) END AS v,
    CASE kind WHEN 'DEFINITE_TUPLE' THEN regexp_extract(c, '{_TUPLE_RE}', 3)
              WHEN 'DEFINITE_SEPARATE' THEN regexp_extract(c, '{_SEP_RE}', 3) END AS lo,
    CASE kind WHEN 'DEFINITE_TUPLE' THEN regexp_extract(c, '{_TUPLE_RE}', 4)
              WHEN 'DEFINITE_SEPARATE' THEN regexp_extract(c, '{_SEP_RE}', 4) END AS hi
  FROM m
), q AS (
  SELECT *, CASE WHEN kind = 'ERROR' THEN 'unparsable_call'
                 WHEN NOT regexp_matches(v, '^\pL$') THEN 'bad_variable'
                 WHEN kind <> 'INDEFINITE' AND NOT (regexp_matches(lo, '^[0-9]+$') AND regexp_matches(hi, '^[0-9]+$')) THEN 'bad_bounds'
            END AS reject_reason
  FROM p
), legacy AS (
  SELECT p_partkey,
    CASE WHEN len(string_split(substr(c, strpos(c, '(') + 1, length(c) - strpos(c, '(') - 1), ',')) = 2
              AND strpos(c, '(') > 0 AND c LIKE '%)' THEN string_split(substr(c, strpos(c, '(') + 1, length(c) - strpos(c, '(') - 1), ',')[1] END AS integrand_legacy,
    CASE WHEN len(string_split(substr(c, strpos(c, '(') + 1, length(c) - strpos(c, '(') - 1), ',')) = 2
              AND strpos(c, '(') > 0 AND c LIKE '%)' THEN string_split(substr(c, strpos(c, '(') + 1, length(c) - strpos(c, '(') - 1), ',')[2] END AS var_legacy
  FROM r
)
SELECT q.p_partkey, kind,
  CASE WHEN reject_reason IS NULL THEN {S.clean_expr('raw_integrand')} END AS integrand,
  CASE WHEN reject_reason IS NULL THEN v END AS var,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN kind = 'INDEFINITE' THEN CAST('-inf' AS DOUBLE) ELSE CAST(lo AS DOUBLE) END END AS lb,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN kind = 'INDEFINITE' THEN CAST('inf' AS DOUBLE) ELSE CAST(hi AS DOUBLE) END END AS ub,
  coalesce(CASE WHEN reject_reason IS NULL THEN kind <> 'INDEFINITE' END, false) AS is_definite,
  reject_reason, integrand_legacy, var_legacy
FROM q JOIN legacy ON q.p_partkey = legacy.p_partkey
""")
def q_parse_problems(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", call_col().alias("c"))
    cur = parse_problems(p, "c")
    leg = parse_problems(p.select("p_partkey", "c"), "c", dialect="legacy", prefix="l_").select(
        "p_partkey", F.col("l_integrand").alias("integrand_legacy"), F.col("l_var").alias("var_legacy"))
    return cur.join(leg, "p_partkey").select(
        "p_partkey", "kind", "integrand", "var", "lb", "ub",
        F.coalesce("is_definite", F.lit(False)).alias("is_definite"), "reject_reason",
        "integrand_legacy", "var_legacy")


# ---------------------------------------------------------------------------
# D4 dedup_exact: exact text dedup per source, first document wins
# ---------------------------------------------------------------------------
@register("dedup_exact", """
SELECT source AS question, min(doc_id) AS doc_id, length(text) AS n_chars
FROM documents GROUP BY source, text
""")
def q_dedup_exact(spark, sf):
    from variantlake.operators.dedup import dedup_exact

    d = table(spark, sf, "documents").select(F.col("source").alias("question"), F.col("text").alias("variant"),
                                             F.col("doc_id").alias("request_order"))
    kept = dedup_exact(d, keys=("question", "variant"), order=("request_order",))
    return kept.select("question", F.col("request_order").alias("doc_id"),
                       F.length("variant").cast("long").alias("n_chars"))


# ---------------------------------------------------------------------------
# X4 question_index / G4 limit_per_group on lineitem in a total order
# ---------------------------------------------------------------------------
_LI_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("question_index", f"""
SELECT l_orderkey AS tree_id, l_linenumber, l_partkey, l_suppkey,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LI_ORDER)}) - 1 AS INTEGER) AS question_index
FROM lineitem
""")
def q_question_index(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "tree_id")
    out = PR.with_question_index(li, tree="tree_id", order=_LI_ORDER)
    return out.select("tree_id", "l_linenumber", "l_partkey", "l_suppkey", "question_index")


@register("limit_per_group", f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {', '.join(_LI_ORDER)}) AS rn FROM lineitem
) WHERE rn <= 2
""")
def q_limit_per_group(spark, sf):
    li = table(spark, sf, "lineitem")
    return PR.limit_per_group(li, ["l_orderkey", "l_returnflag"], _LI_ORDER, 2).select(
        "l_orderkey", "l_linenumber", "l_partkey")


# The calls built by ``call_col`` that parse: ECONOMY (tuple bounds), PROMO
# (indefinite) and LARGE (separate bounds, variable t); the other three shapes are
# rejected (negative bound, multi-character variable, no call).
_PARSED_SQL = f"""
parsed AS (
  SELECT p_partkey, p_brand, p_size,
    CASE p_type WHEN 'ECONOMY' THEN CAST(p_size AS VARCHAR) || '*x**2'
                WHEN 'PROMO' THEN 'sin(' || CAST(p_size AS VARCHAR) || '*x)'
                ELSE 'f(x, ' || CAST(p_size AS VARCHAR) || ')' END AS integrand,
    CASE p_type WHEN 'LARGE' THEN 't' ELSE 'x' END AS var,
    CASE p_type WHEN 'ECONOMY' THEN 0.0 WHEN 'LARGE' THEN 1.0 ELSE CAST('-inf' AS DOUBLE) END AS lb,
    CASE p_type WHEN 'PROMO' THEN CAST('inf' AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS ub,
    p_type <> 'PROMO' AS is_definite
  FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'LARGE')
)"""


def _parsed_part(spark, sf):
    """Every part row's call through the parser; the variants that parse.

    The narrow rows are dealt out by count before the calls are made: the table may be one task's.
    They are written, as Spark moves the filter and the parser with it below a mere deal."""
    path = scratch_path(spark, "part_rows")
    spread(table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size")).write.parquet(path)
    p = spark.read.parquet(path).select("p_partkey", "p_brand", "p_size", call_col().alias("c"))
    return parse_problems(p, "c").where(F.col("reject_reason").isNull()).select(
        "p_partkey", "p_brand", "p_size", "integrand", "var", "lb", "ub", "is_definite")


# ---------------------------------------------------------------------------
# X5 make_splits and F6 chunk_plan
# ---------------------------------------------------------------------------
@register("make_splits", f"""
WITH {_PARSED_SQL.strip()}, train AS (
  SELECT p_brand AS tree_id, 'train' AS split, p_partkey AS key, integrand FROM parsed
), evals AS (
  SELECT 'Brand#' || item_id AS tree_id, 'eval' AS split, CAST(unnest(range(16)) AS BIGINT) AS key,
         'x**' || item_id AS integrand, NULL AS reject_reason
  FROM benchmark WHERE item_id % 4 < 2
  UNION ALL SELECT 'Brand#' || item_id, 'eval', -1, CASE item_id % 4 WHEN 2 THEN 'x**' END, 'base_not_verifiable' FROM benchmark WHERE item_id % 4 >= 2
)
SELECT tree_id, split, key, integrand, NULL AS reject_reason FROM train UNION ALL SELECT tree_id, split, key, integrand, reject_reason FROM evals
""")
def q_make_splits(spark, sf):
    parsed = _parsed_part(spark, sf)
    train = parsed.select(F.col("p_brand").alias("tree_id"), F.col("p_partkey").cast("int").alias("question_index"),
                          "integrand", "var", "lb", "ub", "is_definite", F.lit(1).alias("level"))
    splits = PR.make_splits(train, _bases(spark, sf), num_eval=16)
    return splits.select("tree_id", "split", F.coalesce("question_index", F.lit(-1)).cast("long").alias("key"), "integrand", "reject_reason")


def _bases(spark, sf):
    """Base questions x**item_id, validated; of four, one does not evaluate and one does not parse."""
    item = F.col("item_id").cast("string")
    bench = table(spark, sf, "benchmark").select(
        F.concat(F.lit("Brand#"), item).alias("tree_id"),
        F.when(F.col("item_id") % 4 == 2, F.lit("integrate(x**, x)")).when(F.col("item_id") % 4 == 3, F.lit("what is it?"))
        .otherwise(F.concat(F.lit("integrate(x**"), item, F.lit(", x)"))).alias("base"))
    return V.validate(parse_problems(bench, "base")).select("tree_id", "integrand", "var", "lb", "ub", "is_definite", "valid")


@register("eval_prompts", f"""
SELECT 'Brand#' || item_id AS tree_id, 'eval' AS split, CAST(unnest(range(16)) AS INTEGER) AS question_index, 0 AS level,
       'x**' || item_id AS ground_truth, {S.lit(K.SYSTEM_PROMPT)} AS system_content,
       {S.lit(K.TASK_PROMPT_INDEFINITE)}.replace('{{{{integrand}}}}', 'x**' || item_id).replace('{{{{var}}}}', 'x') AS user_content
FROM benchmark WHERE item_id % 4 < 2
""".replace("{{", "{").replace("}}", "}"))
def q_eval_prompts(spark, sf):
    """the base questions' eval records."""
    none = _parsed_part(spark, sf).limit(0).select(F.col("p_brand").alias("tree_id"), F.lit(0).alias("question_index"),
                                                  "integrand", "var", "lb", "ub", "is_definite", F.lit(1).alias("level"))
    rec = PR.eval_prompts(PR.make_splits(none, _bases(spark, sf), num_eval=16))
    return rec.select("tree_id", "split", "extra_info.question_index", "extra_info.level", F.col("reward_model.ground_truth").alias("ground_truth"),
                      F.col("prompt")[0]["content"].alias("system_content"), F.col("prompt")[1]["content"].alias("user_content"))


@register("chunk_plan", """
WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT user_id, event_type, n * 2 AS total, CAST(ceil(n * 2 / 10) AS INTEGER) AS chunks FROM g),
e AS (SELECT user_id, event_type, total, chunks, CAST(unnest(range(chunks)) AS INTEGER) AS chunk FROM c)
SELECT user_id, event_type, chunk, CAST(CASE WHEN chunk < chunks - 1 THEN 10 ELSE total - 10 * (chunks - 1) END AS INTEGER) AS count
FROM e
""")
def q_chunk_plan(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("num_variants"))
    return PR.chunk_plan(g).select("user_id", "event_type", "chunk", F.col("count").cast("int").alias("count"))


# ---------------------------------------------------------------------------
# F1/F3/F8 prompt records, F4 judge prompts, F2/F7 legacy prompts, F5 ideas
# ---------------------------------------------------------------------------
def _sql_fill(template: str, **values) -> str:
    import string as _s

    parts = []
    for literal, field, _spec, _conv in _s.Formatter().parse(template):
        if literal:
            parts.append("'" + literal.replace("'", "''") + "'")
        if field is not None:
            parts.append(f"CAST({values[field]} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"


def _bound_sql(e):
    return f"(CASE WHEN {e} = floor({e}) THEN CAST(CAST(floor({e}) AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({e} AS VARCHAR) END)"


@register("prompt_records", f"""
WITH {_PARSED_SQL}
SELECT p_partkey, p_brand AS tree_id, '{K.DATA_SOURCE}' AS data_source, '{K.ABILITY}' AS ability,
  {S.lit(K.SYSTEM_PROMPT)} AS system_content,
  CASE WHEN is_definite THEN {_sql_fill(K.TASK_PROMPT_DEFINITE, integrand='integrand', var='var', lb=_bound_sql('lb'), ub=_bound_sql('ub'))}
       ELSE {_sql_fill(K.TASK_PROMPT_INDEFINITE, integrand='integrand', var='var')} END AS user_content,
  integrand AS ground_truth, var, lb, ub, is_definite,
  CASE WHEN length(CASE WHEN is_definite THEN {_sql_fill(K.TASK_PROMPT_DEFINITE, integrand='integrand', var='var', lb=_bound_sql('lb'), ub=_bound_sql('ub'))}
       ELSE {_sql_fill(K.TASK_PROMPT_INDEFINITE, integrand='integrand', var='var')} END) > 520 THEN 'too_long' END AS reject_reason
FROM parsed
""")
def q_prompt_records(spark, sf):
    parsed = _parsed_part(spark, sf).withColumns({"tree_id": F.col("p_brand"), "question_index": F.col("p_partkey"),
                                                  "level": F.lit(1)})
    rec = PR.to_prompts(parsed)
    flat = rec.select(
        "p_partkey", F.col("extra_info.tree_id").alias("tree_id"), "data_source", "ability",
        F.col("prompt")[0]["content"].alias("system_content"), F.col("prompt")[1]["content"].alias("user_content"),
        F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.var").alias("var"),
        F.col("extra_info.lb").alias("lb"), F.col("extra_info.ub").alias("ub"),
        F.col("extra_info.is_definite").alias("is_definite"))
    return PR.gate_length(flat, "user_content", max_len=520)


@register("judge_prompts", f"""
WITH {_PARSED_SQL},
a AS (SELECT *, CASE WHEN p_size % 7 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) || '*x**3/3' END AS answer FROM parsed)
, j AS (SELECT p_partkey,
  CASE WHEN answer IS NULL OR answer = '' THEN NULL
       WHEN lb > CAST('-inf' AS DOUBLE) AND ub < CAST('inf' AS DOUBLE)
         THEN {_sql_fill(K.JUDGE_PROMPT_DEFINITE, response='answer', integrand='integrand', var='var', lb=_bound_sql('lb'), ub=_bound_sql('ub'))}
       ELSE {_sql_fill(K.JUDGE_PROMPT_INDEFINITE, response='answer', integrand='integrand')} END AS judge_prompt
FROM a)
SELECT p_partkey, judge_prompt, CASE WHEN judge_prompt IS NOT NULL THEN {S.lit(K.JUDGE_SYSTEM_PROMPT)} END AS system_content,
       CASE WHEN length(judge_prompt) + {len(K.JUDGE_SYSTEM_PROMPT)} > {len(K.JUDGE_SYSTEM_PROMPT) + 420} THEN 'too_long' END AS reject_reason
FROM j
""")
def q_judge_prompts(spark, sf):
    parsed = _parsed_part(spark, sf).withColumn(
        "answer", F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("*x**3/3"))))
    chats = PR.judge_chats(parsed.drop("reject_reason"), max_len=len(K.JUDGE_SYSTEM_PROMPT) + 420)
    return chats.select("p_partkey", F.get("judge_chat", 1)["content"].alias("judge_prompt"),
                        F.get("judge_chat", 0)["content"].alias("system_content"), "reject_reason")


@register("legacy_prompts", f"""
SELECT item_id, text || chr(10) || {S.lit(K.LEGACY_INSTRUCTION)} AS content, text AS ground_truth,
       {_sql_fill(K.DIFFICULTY_PROMPT, original="'integrate(x**2, x)'", variant='text')} AS difficulty_prompt
FROM benchmark
""")
def q_legacy_prompts(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("question_index", F.col("item_id"))
    rec = PR.to_plain_prompts(b, question="text")
    return rec.select("item_id", F.col("prompt")[0]["content"].alias("content"),
                      F.col("reward_model.ground_truth").alias("ground_truth"),
                      PR.difficulty_prompt(F.lit("integrate(x**2, x)"), F.col("text")).alias("difficulty_prompt"))


_IDEAS_SQL = ", ".join(f"({S.lit(d)}, {i}, {S.lit(idea)})" for d, ideas in K.TRANSFORMATIONS_BY_DIFFICULTY.items() for i, idea in enumerate(ideas))


@register("sample_ideas", f"""
WITH ideas(difficulty, pos, idea) AS (VALUES {_IDEAS_SQL}),
o AS (SELECT o_orderkey AS request_id, CAST(o_totalprice AS VARCHAR) AS price,
             CASE WHEN o_orderpriority LIKE '1%' THEN 'harder' WHEN o_orderpriority LIKE '2%' THEN 'equivalent'
                  WHEN o_orderpriority LIKE '5%' THEN 'unknown' ELSE 'easier' END AS difficulty FROM orders),
c AS (SELECT o.*, coalesce(idea, {S.lit(K.DEFAULT_TRANSFORMATION)}) AS idea, md5(request_id || '|' || coalesce(pos, 0) || '|0') AS h
      FROM o LEFT JOIN ideas USING (difficulty)),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY h, idea) AS rank FROM c)
SELECT request_id, difficulty, CAST(count(*) AS INTEGER) AS n_ideas, string_agg(idea, ' and ' ORDER BY rank) AS ideas
FROM r WHERE rank <= CASE WHEN substr(md5(request_id || '|n|0'), 1, 1) < '8' THEN 3 ELSE 5 END GROUP BY ALL
""")
def q_sample_ideas(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("integrate("), F.col("o_totalprice").cast("string"), F.lit("*x, x)")).alias("question"),
        F.when(F.col("o_orderpriority").startswith("1"), "harder")
        .when(F.col("o_orderpriority").startswith("2"), "equivalent")
        .when(F.col("o_orderpriority").startswith("5"), "unknown").otherwise("easier").alias("difficulty"),
        F.lit(10).alias("count"))
    out = PR.to_generation_prompts(o)
    return out.select("request_id", "difficulty", F.size("transformations_used").alias("n_ideas"),
                      F.array_join("transformations_used", " and ").alias("ideas"))


# ---------------------------------------------------------------------------
# X3 explode_buckets + G1 + G3: events as raw variant files
# ---------------------------------------------------------------------------
def _bucket_file(ev):
    item = lambda v, r, d: F.struct(v.alias("variant"), r.alias("reasoning"), d.alias("requested_difficulty"))
    v1 = F.concat(F.lit("integrate("), F.col("value").cast("string"), F.lit("*x, x)"))
    v2 = F.concat(F.lit("integrate(x**"), F.col("user_id").cast("string"), F.lit(", x)"))
    req = F.when(F.col("event_type") == "click", "easier").when(F.col("event_type") == "purchase", "harder")
    reason = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("props"))
    return ev.select(
        "event_id", F.col("user_id").alias("question"), "value",
        F.create_map(
            F.col("event_type"), F.array(item(v1, reason, req), item(v2, F.col("props"), F.lit(None).cast("string"))),
            F.lit("equivalent"), F.array(item(F.lit(""), F.col("props"), F.lit("equivalent"))),
        ).alias("variants"))


@register("explode_buckets", """
WITH items AS (
  SELECT event_id, user_id AS question, value, event_type AS bucket, 0 AS pos,
         'integrate(' || CAST(value AS VARCHAR) || '*x, x)' AS variant,
         CASE WHEN event_type = 'view' THEN '' ELSE props END AS reasoning,
         CASE event_type WHEN 'click' THEN 'easier' WHEN 'purchase' THEN 'harder' END AS req
  FROM events
  UNION ALL
  SELECT event_id, user_id, value, event_type, 1, 'integrate(x**' || CAST(user_id AS VARCHAR) || ', x)', props, NULL FROM events
  UNION ALL
  SELECT event_id, user_id, value, 'equivalent', 0, '', props, 'equivalent' FROM events
)
SELECT event_id, question, bucket, CAST(pos AS INTEGER) AS pos, variant, coalesce(req, 'unknown') AS difficulty,
       CASE WHEN value > 50 THEN 'harder' ELSE 'easier' END AS evaluation
FROM items
WHERE length(coalesce(variant, '')) > 0 AND length(coalesce(reasoning, '')) > 0
  AND NOT (value > 50 AND coalesce(req, 'unknown') <> 'harder')
""")
def q_explode_buckets(spark, sf):
    from variantlake.operators.flatten import explode_buckets

    files = _bucket_file(table(spark, sf, "events"))
    rows = explode_buckets(files, keep=("event_id", "question", "value"))
    rows = PR.filter_nonempty(rows, ("variant", "reasoning"))
    rows = rows.withColumn("evaluation", F.when(F.col("value") > 50, "harder").otherwise("easier"))
    rows = PR.filter_difficulty(rows, "evaluation", "difficulty")
    return rows.select("event_id", "question", "bucket", "pos", "variant", "difficulty", "evaluation")
