"""A1-A11, J2 on driver tables (lineitem as rollouts, labels as verdicts)."""
from __future__ import annotations

from pyspark.sql import functions as F

from variantlake.operators import metrics as M
from variantlake.plans.registry import register, rounded, table

# lineitem as a rollout table: one question per order, a sample is "correct" when
# its return flag is R; k values fit the 1-13 samples per order.
KS = (1, 2, 5)


@register("pass_at_k", """
WITH g AS (
  SELECT l_orderkey AS question, count(*) AS n,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS c
  FROM lineitem GROUP BY l_orderkey
), e AS (SELECT question, n, c, unnest([1, 2, 5]) AS k FROM g)
SELECT question, n, c, k,
       round(CASE WHEN n < k THEN NULL
                  WHEN n - c < k THEN 1.0
                  WHEN c = 0 THEN 0.0
                  ELSE 1.0 - list_aggregate(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k / i), 'product')
             END, 9) AS pass_at_k, CASE WHEN n < k THEN 'fewer_samples' END AS reason
FROM e
""")
def q_pass_at_k(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question"), "l_returnflag")
    out = M.pass_at_k(li, ["question"], F.col("l_returnflag") == "R", ks=KS)
    return rounded(out.select("question", "n", "c", "k", "pass_at_k", "reason"))


# ---------------------------------------------------------------------------
# rollout-like derivations shared by several queries (Spark and SQL spellings)
# ---------------------------------------------------------------------------
LI_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_ORDER_SQL = ", ".join(LI_ORDER)
FIRST_KS = (1, 5, 10)


def _judge_status():
    return (F.when(F.col("l_returnflag") == "A", "OK").when(F.col("l_returnflag") == "N", "NO_OK")
            .otherwise("ERROR"))


_JUDGE_SQL = "CASE l_returnflag WHEN 'A' THEN 'OK' WHEN 'N' THEN 'NO_OK' ELSE 'ERROR' END"


def _formal_status():
    n = F.col("l_linenumber")
    return (F.when(n <= 2, "OK").when(n == 3, "NO_OK").when(n == 4, "NO_SYMPY_EXPR")
            .when(n == 5, "NO_INP_IN_TAGS").when(n == 6, "ERROR_EVAL_EXPR").otherwise("NO_OK"))


_FORMAL_SQL = ("CASE WHEN l_linenumber <= 2 THEN 'OK' WHEN l_linenumber = 3 THEN 'NO_OK' "
               "WHEN l_linenumber = 4 THEN 'NO_SYMPY_EXPR' WHEN l_linenumber = 5 THEN 'NO_INP_IN_TAGS' "
               "WHEN l_linenumber = 6 THEN 'ERROR_EVAL_EXPR' ELSE 'NO_OK' END")


def _step():
    return (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("int")


_STEP_SQL = "CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER)"


def _scored_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        _step().alias("step"),
        _judge_status().alias("judge_status"),
        _formal_status().alias("formal_status"),
        F.when(_formal_status() == "OK", 1.0).otherwise(0.0).alias("formal_result"),
        F.col("l_quantity").cast("int").alias("response_tokens"),
        F.when(F.col("l_linenumber") == 7, F.lit(None))
        .otherwise(F.repeat(F.concat("l_returnflag", "l_linestatus"), F.col("l_linenumber"))).alias("judge_response"),
    )


_SCORED_SQL = f"""
scored AS (
  SELECT {_STEP_SQL} AS step, {_JUDGE_SQL} AS judge_status, {_FORMAL_SQL} AS formal_status,
         CASE WHEN ({_FORMAL_SQL}) = 'OK' THEN 1.0 ELSE 0.0 END AS formal_result,
         CAST(l_quantity AS INTEGER) AS response_tokens,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE repeat(l_returnflag || l_linestatus, l_linenumber) END AS judge_response
  FROM lineitem
)"""


@register("pass_first_k", f"""
WITH r AS (
  SELECT l_orderkey AS question, l_returnflag = 'R' AS correct,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {LI_ORDER_SQL}) - 1 AS idx
  FROM lineitem
), g AS (
  SELECT question, count(*) AS n, min(CASE WHEN correct THEN idx END) AS first_ok FROM r GROUP BY question
), e AS (SELECT question, n, first_ok, unnest([1, 5, 10]) AS k FROM g)
SELECT question, k, n, coalesce(first_ok < k, false) AS passed FROM e
""")
def q_pass_first_k(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question"), *LI_ORDER)
    li = li.withColumn("correct", F.col("l_returnflag") == "R")
    return M.pass_first_k(li, ["question"], LI_ORDER, ks=FIRST_KS)


@register("accuracy_summary", f"""
WITH r AS (
  SELECT l_linestatus AS model, l_orderkey AS question, l_returnflag = 'R' AS correct,
         row_number() OVER (PARTITION BY l_linestatus, l_orderkey ORDER BY {LI_ORDER_SQL}) - 1 AS idx
  FROM lineitem
), g AS (
  SELECT model, question, min(CASE WHEN correct THEN idx END) AS first_ok FROM r GROUP BY model, question
), e AS (SELECT model, question, first_ok, unnest([1, 5, 10]) AS k FROM g)
SELECT model, k, CAST(sum(CASE WHEN coalesce(first_ok < k, false) THEN 1 ELSE 0 END) AS BIGINT) AS num_correct,
       count(*) AS num_total,
       round(sum(CASE WHEN coalesce(first_ok < k, false) THEN 1 ELSE 0 END) / count(*), 9) AS accuracy
FROM e GROUP BY model, k
""")
def q_accuracy_summary(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("model"), F.col("l_orderkey").alias("question"), *LI_ORDER)
    li = li.withColumn("correct", F.col("l_returnflag") == "R")
    per_q = M.pass_first_k(li, ["model", "question"], LI_ORDER, ks=FIRST_KS)
    return rounded(M.accuracy(per_q, ["model", "k"]))


@register("phase_compare", """
WITH g AS (
  SELECT l_orderkey AS question, CASE l_linestatus WHEN 'F' THEN 'base' ELSE 'final' END AS phase,
         count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS c
  FROM lineitem GROUP BY 1, 2
), e AS (SELECT question, phase, n, c, unnest([1, 2, 5]) AS k FROM g),
p AS (
  SELECT question, phase, k,
         CASE WHEN n < k THEN NULL WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0
              ELSE 1.0 - list_aggregate(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k / i), 'product') END AS v
  FROM e
), b AS (SELECT * FROM p WHERE phase = 'base'), f AS (SELECT * FROM p WHERE phase = 'final')
SELECT coalesce(b.question, f.question) AS question, coalesce(b.k, f.k) AS k,
       round(b.v, 9) AS pass_at_k_base, round(f.v, 9) AS pass_at_k_final, round(f.v - b.v, 9) AS delta
FROM b FULL OUTER JOIN f ON b.question = f.question AND b.k = f.k
""")
def q_phase_compare(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("question"),
        F.when(F.col("l_linestatus") == "F", "base").otherwise("final").alias("phase"), "l_returnflag")
    per_phase = M.pass_at_k(li, ["question", "phase"], F.col("l_returnflag") == "R", ks=KS)
    return rounded(M.compare_phases(per_phase, ["question", "k"]))


def _status_sql() -> str:
    parts = []
    for prefix, col, domain in (("JUDGE", "judge_status", M.K.JUDGE_STATUSES),
                                ("FORMAL", "formal_status", M.K.FORMAL_STATUSES)):
        for st in domain:
            hit = f"CASE WHEN {col} = '{st}' THEN 1 ELSE 0 END"
            parts.append(f"SELECT step, '{prefix}/{st}' AS metric, round(avg({hit}), 9) AS mean, "
                         f"CAST(sum({hit}) AS DOUBLE) AS sum FROM scored GROUP BY step")
    parts.append("SELECT step, 'FORMAL/REWARD' AS metric, round(avg(formal_result), 9) AS mean, "
                 "CAST(sum(formal_result) AS DOUBLE) AS sum FROM scored GROUP BY step")
    return f"WITH {_SCORED_SQL}\n" + "\nUNION ALL\n".join(parts)


@register("status_metrics", _status_sql())
def q_status_metrics(spark, sf):
    return rounded(M.status_metrics(_scored_lineitem(spark, sf), by=["step"]))


@register("length_metrics", f"""
WITH {_SCORED_SQL}
SELECT step, judge_status AS status, round(avg(CAST(response_tokens AS DOUBLE)), 9) AS agent_len,
       round(avg(CAST(coalesce(length(judge_response), 0) AS DOUBLE)), 9) AS judge_len
FROM scored GROUP BY step, judge_status
UNION ALL
SELECT step, 'FORMAL_' || formal_status AS status, round(avg(CAST(response_tokens AS DOUBLE)), 9) AS agent_len,
       CAST(NULL AS DOUBLE) AS judge_len
FROM scored GROUP BY step, formal_status
""")
def q_length_metrics(spark, sf):
    return rounded(M.length_metrics(_scored_lineitem(spark, sf), by=["step"]))


def _confusion_sql() -> str:
    cells = {"TP": ("OK", "OK"), "FP": ("NO_OK", "OK"), "TN": ("NO_OK", "NO_OK"), "FN": ("OK", "NO_OK")}
    base = """
v AS (
  SELECT d.lang AS lang,
         CASE WHEN l.quality = 1 THEN 'OK' ELSE 'NO_OK' END AS formal_status,
         CASE WHEN l.toxic = 1 THEN 'OK' ELSE 'NO_OK' END AS judge_status
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""
    parts = []
    for cell, (f, j) in cells.items():
        hit = f"CASE WHEN formal_status = '{f}' AND judge_status = '{j}' THEN 1 ELSE 0 END"
        parts.append(f"SELECT lang, 'CONFUSION_MATRIX/{cell}' AS metric, round(avg({hit}), 9) AS mean, "
                     f"CAST(sum({hit}) AS DOUBLE) AS sum FROM v GROUP BY lang")
    return f"WITH {base}\n" + "\nUNION ALL\n".join(parts)


@register("confusion", _confusion_sql())
def q_confusion(spark, sf):
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    v = labels.join(docs, "doc_id").select(
        "lang",
        F.when(F.col("quality") == 1, "OK").otherwise("NO_OK").alias("formal_status"),
        F.when(F.col("toxic") == 1, "OK").otherwise("NO_OK").alias("judge_status"),
    )
    return rounded(M.confusion(v, by=["lang"]))


@register("census", """
SELECT lang AS difficulty, count(*) AS variants, count(DISTINCT source) AS questions,
       round(count(*) / count(DISTINCT source), 9) AS mean
FROM documents GROUP BY lang
UNION ALL
SELECT 'total', count(*), count(DISTINCT source), round(count(*) / count(DISTINCT source), 9) FROM documents
""")
def q_census(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("question"), F.col("lang").alias("difficulty"))
    return rounded(M.census(docs))


@register("difficulty_histogram", """
SELECT source AS question, lang AS difficulty, count(*) AS variants
FROM documents GROUP BY ROLLUP (source, lang) HAVING source IS NOT NULL
""")
def q_difficulty_histogram(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("question"), F.col("lang").alias("difficulty"))
    return M.difficulty_histogram(docs)


@register("pass_first_k_as_written", f"""
WITH r AS (
  SELECT l_orderkey AS question, l_returnflag = 'R' AS correct,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {LI_ORDER_SQL}) - 1 AS idx
  FROM lineitem
), g AS (
  SELECT question, count(*) AS n,
         bool_or(correct AND idx < 1) AS p1,
         bool_or(correct AND idx >= 1 AND idx < 5) AS p5,
         bool_or(correct AND idx >= 5 AND idx < 10) AS p10
  FROM r GROUP BY question
)
SELECT question, 1 AS k, n, p1 AS passed FROM g
UNION ALL SELECT question, 5, n, p5 FROM g
UNION ALL SELECT question, 10, n, p10 FROM g
""")
def q_pass_first_k_as_written(spark, sf):
    from variantlake.operators.ranking import group_index

    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question"), *LI_ORDER)
    li = group_index(li.withColumn("correct", F.col("l_returnflag") == "R"), ["question"], LI_ORDER, out="sample_idx")
    return M.pass_first_k_as_written(li, ["question"], ks=FIRST_KS)
