"""V1-V14 on driver tables: rollouts built from lineitem x part.

Every part row defines a problem from its type and size (a = p_size):

  ECONOMY  definite  a*x**2 on [0, p_size % 5 + 1]
  PROMO    a*x        -> a*x**2/2          LARGE    a*x**3   -> a*x**4/4
  SMALL    cos(a*x)   -> sin(a*x)/a        MEDIUM   a/x      -> a*log(x)
  STANDARD a*sin(x)   -> -a*cos(x)

and every lineitem row (a sampled answer to its part's problem) answers according
to its line number: 1 right, 2 right in another spelling, 3 twice the right answer,
4 malformed, 5 no answer tag, 6 the integrand itself (the bare variable for definite
problems), 7 right plus a drift inside the loose default tolerance.  The derivation
is one SQL text run by both engines; Spark then verifies the answers numerically,
while the oracle states the verdict each construction must get.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from variantlake.operators import verify as V
from variantlake.plans.registry import register, rounded, spread, sql_on, table

_ANTI = """CASE p_type
    WHEN 'PROMO' THEN CAST(p_size AS STRING) || '*x**2/2'
    WHEN 'LARGE' THEN CAST(p_size AS STRING) || '*x**4/4'
    WHEN 'SMALL' THEN 'sin(' || CAST(p_size AS STRING) || '*x)/' || CAST(p_size AS STRING)
    WHEN 'MEDIUM' THEN CAST(p_size AS STRING) || '*log(x)'
    WHEN 'STANDARD' THEN '-' || CAST(p_size AS STRING) || '*cos(x)'
  END"""
_ALT = """CASE p_type
    WHEN 'PROMO' THEN 'x**2*' || CAST(p_size AS STRING) || '/2'
    WHEN 'LARGE' THEN 'x**4*' || CAST(p_size AS STRING) || '/4'
    WHEN 'SMALL' THEN '(1/' || CAST(p_size AS STRING) || ')*sin(x*' || CAST(p_size AS STRING) || ')'
    WHEN 'MEDIUM' THEN 'log(x)*' || CAST(p_size AS STRING)
    WHEN 'STANDARD' THEN '-cos(x)*' || CAST(p_size AS STRING)
  END"""
_TRUTH = """CASE p_type
    WHEN 'ECONOMY' THEN CAST(p_size AS STRING) || '*x**2'
    WHEN 'PROMO' THEN CAST(p_size AS STRING) || '*x'
    WHEN 'LARGE' THEN CAST(p_size AS STRING) || '*x**3'
    WHEN 'SMALL' THEN 'cos(' || CAST(p_size AS STRING) || '*x)'
    WHEN 'MEDIUM' THEN CAST(p_size AS STRING) || '/x'
    WHEN 'STANDARD' THEN CAST(p_size AS STRING) || '*sin(x)'
  END"""
# exact value of the definite problem, as an integer over 3
_NUM3 = "CAST(p_size * (p_size % 5 + 1) * (p_size % 5 + 1) * (p_size % 5 + 1) AS STRING)"

ROLLOUTS_SQL = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_type AS kind,
  md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                 l_returnflag, l_linestatus, l_shipdate)) AS rollout_id,
  truth_text AS ground_truth, 'x' AS var,
  CASE WHEN p_type = 'ECONOMY' THEN 0.0 ELSE CAST('-inf' AS DOUBLE) END AS lb,
  CASE WHEN p_type = 'ECONOMY' THEN CAST(p_size % 5 + 1 AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END AS ub,
  CASE WHEN p_type = 'ECONOMY' THEN
    CASE l_linenumber
      WHEN 1 THEN num3_text || '/3'
      WHEN 2 THEN CAST(p_size AS STRING) || '*' || CAST(p_size % 5 + 1 AS STRING) || '**3/3'
      WHEN 3 THEN '2*' || num3_text || '/3'
      WHEN 4 THEN CAST(p_size AS STRING) || '*' || CAST(p_size % 5 + 1 AS STRING) || '**'
      WHEN 5 THEN NULL
      WHEN 6 THEN 'x'
      ELSE num3_text || '/3 + 0.001'
    END
  ELSE
    CASE l_linenumber
      WHEN 1 THEN anti_text || ' + C'
      WHEN 2 THEN alt_text
      WHEN 3 THEN '2*(' || anti_text || ')'
      WHEN 4 THEN anti_text || '**'
      WHEN 5 THEN NULL
      WHEN 6 THEN truth_text
      ELSE anti_text || ' + 0.05*x'
    END
  END AS answer_text,
  CASE l_returnflag WHEN 'A' THEN 'Checked. <JUDGE_SCORE>1</JUDGE_SCORE>'
                    WHEN 'N' THEN 'Checked. <JUDGE_SCORE>0</JUDGE_SCORE>' ELSE 'I cannot tell.' END AS judge_response,
  CAST(l_quantity AS INT) * 10 AS response_tokens,
  CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS step
FROM lineitem JOIN (
  SELECT p_partkey, p_type, p_size, {_TRUTH} AS truth_text, {_ANTI} AS anti_text, {_ALT} AS alt_text,
         {_NUM3} AS num3_text FROM part
) p ON l_partkey = p_partkey
"""


# the rollout id is a 128-bit digest of the whole lineitem row; no oracle compares it


def _with_response(answer_col: str = "answer_text") -> str:
    return (f"CASE WHEN {answer_col} IS NULL THEN 'I could not solve it.' "
            f"ELSE 'Working: differentiate and compare. <answer>' || {answer_col} || '</answer>' END")


def _part(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_type", "p_size")


def rollouts(spark, sf):
    """The derived rollout table (Spark side)."""
    # a driver table is one row group, so one task; AQE spreads the narrow source by size
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate").hint("rebalance")
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    df = sql_on(spark, ROLLOUTS_SQL, lineitem=li, part=part)
    return df.withColumn("response", F.expr(_with_response()))


def _rollouts_of(spark, sf, dealt):
    """``rollouts`` with the rows joined first and ``dealt`` while they are narrow; the texts are made last."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate")
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    rows = dealt(li.join(part, li.l_partkey == part.p_partkey).drop("p_partkey"))
    made = ROLLOUTS_SQL[:ROLLOUTS_SQL.index("FROM lineitem JOIN")] + (
        f"FROM (SELECT *, {_TRUTH} AS truth_text, {_ANTI} AS anti_text, {_ALT} AS alt_text, {_NUM3} AS num3_text FROM narrow_rows) n")
    return sql_on(spark, made, narrow_rows=rows).withColumn("response", F.expr(_with_response()))


def rollouts_by_step(spark, sf):
    """``rollouts`` with a step's rows brought together."""
    month = F.year("l_shipdate") * 100 + F.month("l_shipdate")
    return _rollouts_of(spark, sf, lambda rows: rows.withColumn("_month", month).hint("rebalance", "_month"))


def rollouts_dealt(spark, sf, tasks: int):
    """``rollouts`` in ``tasks`` parts, each with rows of every step."""
    return _rollouts_of(spark, sf, lambda rows: rows.repartition(tasks))


_EXPECTED_FORMAL = """CASE
    WHEN kind = 'ECONOMY' THEN CASE l_linenumber WHEN 1 THEN 'OK' WHEN 2 THEN 'OK' WHEN 3 THEN 'NO_OK'
      WHEN 4 THEN 'NO_SYMPY_EXPR' WHEN 5 THEN 'NO_INP_IN_TAGS' WHEN 6 THEN 'ERROR_EVAL_EXPR' ELSE 'OK' END
    ELSE CASE l_linenumber WHEN 1 THEN 'OK' WHEN 2 THEN 'OK' WHEN 3 THEN 'NO_OK'
      WHEN 4 THEN 'NO_SYMPY_EXPR' WHEN 5 THEN 'NO_INP_IN_TAGS' WHEN 6 THEN 'NO_OK' ELSE 'OK' END
  END"""
_EXPECTED_JUDGE = """CASE WHEN answer_text IS NULL THEN 'NO_INP_IN_TAGS'
    WHEN judge_response LIKE '%<JUDGE_SCORE>1<%' THEN 'OK'
    WHEN judge_response LIKE '%<JUDGE_SCORE>0<%' THEN 'NO_OK' ELSE 'ERROR' END"""


@register("score_rollouts", f"""
WITH r AS ({ROLLOUTS_SQL}),
e AS (SELECT *, {_EXPECTED_FORMAL} AS formal_status, {_EXPECTED_JUDGE} AS judge_status FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, formal_status,
       CAST(CASE WHEN formal_status = 'OK' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS formal_result,
       judge_status, CASE WHEN judge_status = 'OK' THEN 1 ELSE 0 END AS judge_result,
       CAST(CASE WHEN judge_status = 'OK' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS reward,
       response_tokens - 1 AS reward_pos
FROM e
""")
def q_score_rollouts(spark, sf):
    scored = V.score_rollouts(rollouts(spark, sf))
    rewarded = V.assign_reward(scored)
    return rewarded.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "formal_status", "formal_result",
                           "judge_status", "judge_result", "reward", "reward_pos")


@register("score_strict", f"""
WITH r AS ({ROLLOUTS_SQL})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linenumber = 7 AND kind <> 'ECONOMY' THEN 'NO_OK'
       WHEN l_linenumber = 7 THEN CASE WHEN 1e-6 + 1e-6 * (CAST(num3_text AS DOUBLE) / 3.0) >= 0.001 THEN 'OK' ELSE 'NO_OK' END
       ELSE {_EXPECTED_FORMAL} END AS formal_status
FROM (SELECT *, CAST(regexp_extract(ground_truth, '([0-9]+)', 1) AS INT) AS a,
             CASE WHEN kind = 'ECONOMY' THEN CAST(CAST(regexp_extract(ground_truth, '([0-9]+)', 1) AS INT) * CAST(ub AS INT) * CAST(ub AS INT) * CAST(ub AS INT) AS STRING) END AS num3_text
      FROM r) r
""")
def q_score_strict(spark, sf):
    r = rollouts(spark, sf).withColumn("answer", F.col("answer_text"))
    scored = V.score_answers(r, policy="strict")
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "formal_status")


# --- V8: legacy relative tolerance, truth is the whole integrate(...) call ---
_LEGACY_SQL = f"""
SELECT l_orderkey, l_linenumber, l_partkey, kind,
  CASE WHEN kind = 'ECONOMY' THEN 'integrate(' || ground_truth || ', (x, 0, ' || CAST(CAST(ub AS INT) AS STRING) || '))'
       ELSE 'integrate(' || ground_truth || ', x)' END AS truth_call,
  CASE WHEN l_linenumber = 7 AND kind <> 'ECONOMY' THEN '(' || {_ANTI.replace('p_type', 'kind').replace('p_size', 'a')} || ')*1.001'
       ELSE answer_text END AS answer_text
FROM (SELECT *, CAST(regexp_extract(ground_truth, '([0-9]+)', 1) AS INT) AS a FROM r0) r
"""


@register("score_relative", f"""
WITH r0 AS ({ROLLOUTS_SQL}), r AS ({_LEGACY_SQL})
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN answer_text IS NULL THEN 'NO_INP_IN_TAGS'
       WHEN l_linenumber = 4 THEN 'ERROR'
       WHEN l_linenumber IN (1, 2, 7) THEN 'OK' ELSE 'NO_OK' END AS formal_status,
  CAST(CASE WHEN answer_text IS NULL THEN 0.0 WHEN l_linenumber = 4 THEN 0.0
       WHEN l_linenumber IN (1, 2, 7) THEN 1.05 ELSE 0.05 END AS DOUBLE) AS formal_result
FROM r
""")
def q_score_relative(spark, sf):
    r = sql_on(spark, _LEGACY_SQL, r0=rollouts(spark, sf)).withColumn("response", F.expr(_with_response()))
    out = V.score_relative(r, response="response", truth="truth_call")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "formal_status", "formal_result"))


# --- V9: legacy boxed answers, absolute tolerance on independent a, b ---
_ABS_SQL = f"""
SELECT l_orderkey, l_linenumber, l_partkey,
  'integrate(' || CASE WHEN kind IN ('ECONOMY', 'MEDIUM') THEN CAST(a AS STRING) || '*x**5' ELSE ground_truth END || ', x)' AS truth_call,
  CASE WHEN kind IN ('ECONOMY', 'MEDIUM') THEN CAST(a AS STRING) || '*x**6/6' ELSE {_ANTI.replace('p_type', 'kind').replace('p_size', 'a')} END AS f,
  CASE WHEN kind IN ('ECONOMY', 'MEDIUM') THEN 'x**6*' || CAST(a AS STRING) || '/6' ELSE {_ALT.replace('p_type', 'kind').replace('p_size', 'a')} END AS alt,
  CASE WHEN kind IN ('ECONOMY', 'MEDIUM') THEN CAST(a AS STRING) || '*x**5' ELSE ground_truth END AS integrand
FROM (SELECT *, CAST(regexp_extract(ground_truth, '([0-9]+)', 1) AS INT) AS a FROM r0) r
"""


def _abs_response(line="l_linenumber"):
    return f"""CASE {line}
      WHEN 1 THEN 'The result is $\\boxed{{' || f || '}}$.'
      WHEN 2 THEN 'So \\boxed{{' || alt || '}}'
      WHEN 3 THEN '\\boxed{{2*(' || f || ')}}'
      WHEN 4 THEN '\\boxed{{' || f || '**}}'
      WHEN 5 THEN 'no box here'
      WHEN 6 THEN '\\boxed{{' || integrand || '}}'
      ELSE '\\boxed{{integrate(' || integrand || ', x)}}'
    END"""


@register("score_absolute", f"""
WITH r0 AS ({ROLLOUTS_SQL}), r AS ({_ABS_SQL})
SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber IN (1, 2) AS correct FROM r
""")
def q_score_absolute(spark, sf):
    r = sql_on(spark, _ABS_SQL, r0=rollouts(spark, sf)).withColumn("response", F.expr(_abs_response().replace("\\", "\\\\")))
    out = V.score_absolute(r, response="response", truth="truth_call")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "correct")


# --- V1-V5: validity of part-derived variants ---
_VALID_SQL = """
SELECT p_partkey,
  CASE p_type
    WHEN 'ECONOMY' THEN CAST(p_size AS STRING) || '*x**2'
    WHEN 'PROMO' THEN CAST(p_size AS STRING) || '*x'
    WHEN 'LARGE' THEN CAST(p_size AS STRING) || '*x**'
    WHEN 'SMALL' THEN 'cos(' || CAST(p_size AS STRING) || '*x)'
    WHEN 'MEDIUM' THEN CAST(p_size AS STRING) || CASE p_partkey % 3 WHEN 0 THEN '/x' WHEN 1 THEN '/(x - 3)' ELSE '/(x - 0.3)' END
    ELSE CASE WHEN p_size > 25 THEN 'y*x' ELSE 'log(' || CAST(p_size AS STRING) || '*x)' END
  END AS integrand,
  'x' AS var,
  CASE WHEN p_type = 'ECONOMY' THEN 0.0 ELSE CAST('-inf' AS DOUBLE) END AS lb,
  CASE WHEN p_type = 'ECONOMY' THEN CAST(p_size % 5 + 1 AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END AS ub,
  p_type, p_size
FROM part
"""


@register("validate_variants", f"""
WITH v AS ({_VALID_SQL})
SELECT p_partkey, p_type IN ('ECONOMY', 'PROMO', 'SMALL') OR (p_type = 'STANDARD' AND p_size <= 25) AS valid,
  CASE WHEN p_type = 'LARGE' THEN 'syntax' WHEN p_type = 'MEDIUM' OR (p_type = 'STANDARD' AND p_size > 25) THEN 'numeric' END AS invalid_reason
FROM v
""")
def q_validate_variants(spark, sf):
    v = sql_on(spark, _VALID_SQL, part=_part(spark, sf))
    return V.validate(v).select("p_partkey", "valid", "invalid_reason")


# --- V11: supplied solutions checked against their question ---
@register("verify_solutions", f"""
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'NO_OK' ELSE 'OK' END AS check_status
FROM part
""")
def q_verify_solutions(spark, sf):
    q = sql_on(spark, f"""
      SELECT p_partkey,
        'integrate(' || CASE WHEN p_type = 'ECONOMY' THEN CAST(p_size AS STRING) || '*exp(-x**2)' ELSE {_TRUTH} END || ', x)' AS question,
        CASE WHEN p_type = 'ECONOMY' THEN CAST(p_size AS STRING) || '*sqrt(pi)*erf(x)/2' || CASE WHEN p_size > 25 THEN ' + x' ELSE '' END
             WHEN p_size > 25 THEN '2*(' || {_ANTI} || ')' ELSE {_ANTI} END AS ground_truth_solution
      FROM part""", part=_part(spark, sf))
    return V.verify_solutions(q).select("p_partkey", "check_status")


# --- V12: solution values at fixed points where they are real ---
_POINTS = [-1.0, 0.5, 1.5, 2.5]


@register("evaluate_points", f"""
WITH s AS (SELECT p_partkey, p_type, CAST(p_size AS DOUBLE) AS a FROM part),
pts AS (SELECT unnest([-1.0, 0.5, 1.5, 2.5]::DOUBLE[]) AS x, unnest([0, 1, 2, 3]) AS i),
v AS (
  SELECT p_partkey, p_type, i, x,
    CASE p_type WHEN 'ECONOMY' THEN a * x * x * x / 3 WHEN 'PROMO' THEN a * x * x / 2
      WHEN 'LARGE' THEN a * x * x * x * x / 4 WHEN 'SMALL' THEN sin(a * x) / a
      WHEN 'MEDIUM' THEN CASE WHEN x > 0 THEN a * ln(x) END ELSE -a * cos(x) END AS value
  FROM s, pts
), k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS point_idx FROM v WHERE value IS NOT NULL)
SELECT p_partkey, CAST(point_idx AS INTEGER) AS point_idx, x, round(value, 6) AS value FROM k WHERE point_idx < 3
""")
def q_evaluate_points(spark, sf):
    s = sql_on(spark, f"""SELECT p_partkey,
        CASE WHEN p_type = 'ECONOMY' THEN CAST(p_size AS STRING) || '*x**3/3' ELSE {_ANTI} END AS solution FROM part""",
               part=_part(spark, sf))
    out = V.evaluate_points(s, solution="solution", n=3, points=_POINTS, keep=("p_partkey",))
    return out.select("p_partkey", "point_idx", "x", F.round("value", 6).alias("value"))


@register("evaluate_rollouts", f"""
WITH r AS ({ROLLOUTS_SQL}),
g AS (
  SELECT l_partkey AS question, count(*) AS n,
         CAST(sum(CASE WHEN ({_EXPECTED_FORMAL}) = 'OK' THEN 1 ELSE 0 END) AS BIGINT) AS c
  FROM r GROUP BY l_partkey
), e AS (SELECT question, n, c, unnest([1, 5, 10, 20]) AS k FROM g)
SELECT question, n, c, k,
       round(CASE WHEN n < k THEN NULL WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0
                  ELSE 1.0 - list_aggregate(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k / i), 'product')
             END, 9) AS pass_at_k, CASE WHEN n < k THEN 'fewer_samples' END AS reason
FROM e
""")
def q_evaluate_rollouts(spark, sf):
    from variantlake.operators.metrics import evaluate_rollouts

    r = rollouts(spark, sf).withColumn("question", F.col("l_partkey"))
    out = evaluate_rollouts(r, by=("question",), ks=(1, 5, 10, 20))
    return rounded(out.select("question", "n", "c", "k", "pass_at_k", "reason"))


@register("validate_syntax", """
SELECT p_partkey, p_type NOT IN ('LARGE') AND NOT (p_type = 'STANDARD' AND p_size > 25) AS formatting_ok FROM part
""")
def q_validate_syntax(spark, sf):
    v = sql_on(spark, _VALID_SQL, part=_part(spark, sf))
    return V.validate_syntax(v, col="integrand").select("p_partkey", "formatting_ok")


# --- answers that must fail, or pass, alone: never the job ---
_HOSTILE_TRUTH = "CAST(p_size AS STRING) || '*x**2 + 1'"
_HOSTILE_SQL = f"""
SELECT l_orderkey, l_linenumber, l_partkey, {_HOSTILE_TRUTH} AS ground_truth, 'x' AS var, CAST('-inf' AS DOUBLE) AS lb, CAST('inf' AS DOUBLE) AS ub,
  '<answer>' || CASE l_linenumber
    WHEN 1 THEN repeat('1', 400)
    WHEN 2 THEN CAST(p_size AS STRING) || '*x**3/3 + x' || repeat('+1', 1000 + p_size % 5)
    WHEN 3 THEN '$$'
    WHEN 4 THEN 'C'
    WHEN 5 THEN 'x**' || repeat('9', 400)
    WHEN 6 THEN repeat('(', 300) || CAST(p_size AS STRING) || '*x**3/3 + x' || repeat(')', 300)
    ELSE 'Rational(' || CAST(p_size AS STRING) || ', 3)*x**3 + x' END || '</answer>' AS response
FROM lineitem JOIN part ON l_partkey = p_partkey
"""


@register("score_hostile", """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE l_linenumber WHEN 1 THEN 'NO_OK' WHEN 2 THEN 'OK' WHEN 3 THEN 'NO_SYMPY_EXPR' WHEN 4 THEN 'NO_SYMPY_EXPR'
       WHEN 5 THEN 'NO_OK' ELSE 'OK' END AS formal_status
FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def q_score_hostile(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    # the narrow joined rows are dealt out before the long answers are made of them
    asked = spread(li.join(_part(spark, sf), F.col("l_partkey") == F.col("p_partkey")), rows=50_000, of=li)
    r = sql_on(spark, _HOSTILE_SQL.replace("lineitem JOIN part ON l_partkey = p_partkey", "asked"), asked=asked).withColumn("judge_response", F.lit(None).cast("string"))
    return V.score_rollouts(r).select("l_orderkey", "l_linenumber", "l_partkey", "formal_status")
