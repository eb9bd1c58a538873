"""Readers, sinks and small operators driven end to end: written to the shared folder,
read back with the package's own readers, and compared by content."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from variantlake.functions import text as TX
from variantlake.functions.parse import parse_problems
from variantlake.operators import flatten as FL
from variantlake.operators import metrics as M
from variantlake.operators import prompts as PR
from variantlake.operators import verify as V
from variantlake.operators.variants import kept_variants
from variantlake.plans import scoring_queries as SQ
from variantlake.plans import text_queries as TQ
from variantlake.plans.registry import ORACLES, register, rounded, table, task_count
from variantlake.session import scratch_path
from variantlake.sources import readers as R
from variantlake.sources import writers as W


def _write_folders(rows, of, name: str, fmt: str, path: str) -> None:
    """One folder and file for each value of ``name``.  Shares of equal count write side by side
    (by bytes, small rows would all be one task's), and tasks commit their own files: the driver
    would move them one after another."""
    (rows.repartition(task_count(of, rows=500), name).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
     .partitionBy(name).format(fmt).save(path))


# --- S1, S2: tree files in named folders, some broken ---
@register("read_trees", """
SELECT CAST(s_suppkey AS VARCHAR) AS tree_id, CASE WHEN s_suppkey % 10 < 7 THEN 2 ELSE 0 END AS kept,
       CASE s_suppkey % 10 WHEN 7 THEN 'broken_json' WHEN 8 THEN 'missing_keys' WHEN 9 THEN 'wrong_type' END AS reject_reason
FROM supplier
""")
def q_read_trees(spark, sf):
    key = F.col("s_suppkey").cast("string")
    good = F.concat(F.lit('{"base_question":"integrate(x, x)","tree":[{"level":0,"variants":["integrate('), key,
                    F.lit('*x + 1, x)","integrate(x**2, x)"],"children":[{"variants":["integrate(x*x, x)"]}]}]}'))
    text = (F.when(F.col("s_suppkey") % 10 == 7, "{oops").when(F.col("s_suppkey") % 10 == 8, '{"tree": []}')
            .when(F.col("s_suppkey") % 10 == 9, '{"base_question": "integrate(x, x)", "tree": [{"variants": 3}]}').otherwise(good))
    path = scratch_path(spark, "tree_files")
    suppliers = table(spark, sf, "supplier")
    _write_folders(suppliers.select(text.alias("value"), F.concat(F.lit("tree_"), key).alias("name")), suppliers, "name", "text", path)  # one folder and file a tree
    ok, bad = R.read_trees(spark, path, glob="*.txt", name=R.parent_folder())
    kept = kept_variants(ok).groupBy("tree_id").agg(F.count(F.lit(1)).cast("int").alias("kept"))
    return kept.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(
        bad.select("tree_id", F.lit(0).alias("kept"), "reject_reason"))


# --- S3 with X3, A9: raw variant files; S4: test questions, ground-truth share ---
@register("read_raw_questions", """
SELECT 'integrate(' || event_type || ', x)' AS integral, CAST(event_id AS BIGINT) AS event_id, b.bucket_pos, b.pos, b.variant, b.difficulty
FROM events, (VALUES (0, 0, 'z1', 'easier'), (0, 1, 'z2', 'unknown'), (1, 0, 'a1', 'harder')) AS b(bucket_pos, pos, variant, difficulty)
WHERE event_id % 7 <> 0
""")
def q_read_raw_questions(spark, sf):
    body = F.concat(F.lit('{"integral":"integrate('), "event_type", F.lit(', x)","variants":{"zeta":[{"variant":"z1","reasoning":"r","requested_difficulty":"easier"},'
                    '{"variant":"z2","reasoning":"'), F.col("event_id").cast("string"), F.lit('"}],"alpha":[{"variant":"a1","reasoning":"r","requested_difficulty":"harder"}]}}'))
    docs = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 7 == 0, F.lit('{"integral": 3, ')).otherwise(body).alias("value"), F.col("event_id"))
    path = scratch_path(spark, "raw_files")
    # the layout of the raw files, many documents a file: arrays of documents
    docs.groupBy((F.col("event_id") % 7 == 0).alias("broken"), F.floor(F.col("event_id") / 10_000).alias("part")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")).select("value", "broken", "part").repartition(
            "broken", "part").write.partitionBy("broken", "part").text(path)
    ok, _bad = R.read_raw_questions(spark, path, glob="*.txt")
    ids = ok.select("integral", F.element_at("variants", "zeta")[1]["reasoning"].cast("long").alias("event_id"), "variants")
    rows = FL.explode_buckets(ids, keep=("integral", "event_id"))
    return rows.select("integral", "event_id", "bucket_pos", "pos", "variant", "difficulty")


@register("ground_truth_share", """
SELECT CAST(count_if(p_size % 3 = 0) AS BIGINT) AS with_ground_truth, count(*) AS questions, round(count_if(p_size % 3 = 0) / count(*), 9) AS share FROM part
""")
def q_ground_truth_share(spark, sf):
    path = scratch_path(spark, "test_files")
    part = table(spark, sf, "part").select(
        F.concat(F.lit("integrate("), "p_size", F.lit(", x)")).alias("question"),
        F.when(F.col("p_size") % 3 == 0, F.concat("p_size", F.lit("*x"))).alias("ground_truth_solution"))
    part.write.json(path)
    # JSON lines: each row is a question
    lines = spark.read.schema(R.TEST_FILE).json(path)
    return rounded(M.ground_truth_share(lines))


@register("read_test_questions", """
SELECT 'question=' || s_suppkey AS question_id, 'integrate(' || s_suppkey || ', x)' AS question FROM supplier
""")
def q_read_test_questions(spark, sf):
    path = scratch_path(spark, "test_dirs")
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("dir"), F.concat(F.lit("integrate("), F.col("s_suppkey").cast("string"), F.lit(", x)")).alias("question"),
        F.lit(None).cast("string").alias("ground_truth_solution"))
    _write_folders(s.withColumnRenamed("dir", "question_dir"), s, "question_dir", "json", path)
    back = R.read_test_questions(spark, path, glob="*.json")
    return back.select(F.regexp_replace("question_id", "^question_dir", "question").alias("question_id"), "question")


# --- K6, S5: formatted questions keep file order; fifty parts make a question ---
@register("formatted_roundtrip", """
SELECT 'q' || (p_partkey // 50) AS question, count(*) AS n, string_agg('v' || p_partkey, ',' ORDER BY p_size % 3, p_partkey) AS variants FROM part GROUP BY 1
""")
def q_formatted_roundtrip(spark, sf):
    rows = table(spark, sf, "part").select(
        _part_question().alias("question"), (F.col("p_size") % 3).alias("bucket_pos"), F.col("p_partkey").alias("pos"),
        F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("variant"), F.lit("r").alias("reasoning"), F.lit("easier").alias("difficulty"))
    path = scratch_path(spark, "formatted")
    W.write_formatted(rows, path)
    back = R.read_formatted(spark, path, lines=True)
    return back.select("question", F.size("variants").cast("long").alias("n"), F.array_join(F.transform("variants", lambda v: v["variant"]), ",").alias("variants"))


def _part_question():
    return F.concat(F.lit("q"), F.floor(F.col("p_partkey") / 50).cast("string"))


# --- S5: formatted questions as top-level arrays, with brackets and quotes inside the texts ---
@register("read_formatted_array", """
SELECT 'q' || p_partkey AS question, CAST(p_partkey AS VARCHAR) || ' "}],[{\\ ' || p_name AS variant, p_brand AS difficulty FROM part
""")
def q_read_formatted_array(spark, sf):
    text = F.concat(F.col("p_partkey").cast("string"), F.lit(' "}],[{\\ '), "p_name")
    record = F.struct(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("question"), F.array(
        F.struct(text.alias("variant"), F.lit("r").alias("reasoning"), F.col("p_brand").alias("difficulty"))).alias("variants"))
    path = scratch_path(spark, "formatted_arrays")
    docs = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 5_000).alias("part"), F.to_json(record).alias("value"))
    docs.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n "), F.lit("]")).alias("value")).write.partitionBy("part").text(path)
    back = R.read_formatted(spark, path)
    return back.select("question", F.explode("variants").alias("v")).select("question", "v.variant", "v.difficulty")


# --- S6, K8: rollout tables in Parquet and JSON ---
@register("read_rollouts", """
SELECT CAST(l_linenumber AS INTEGER) AS sample_idx, f.fmt, count(*) AS n, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS tokens
FROM lineitem, (VALUES ('json'), ('parquet')) AS f(fmt) GROUP BY ALL
""")
def q_read_rollouts(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("rollout_id"), F.col("l_partkey").cast("string").alias("tree_id"), F.lit(0).alias("question_index"),
        F.col("l_linenumber").cast("int").alias("sample_idx"), F.lit("base").alias("phase"), F.lit(1).alias("step"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("<answer>x</answer>").alias("response"),
        F.col("l_quantity").cast("int").alias("response_tokens"), F.lit(None).cast("string").alias("judge_response"))
    base = scratch_path(spark, "rollout_tables")
    li.write.parquet(f"{base}/parquet")
    W.write_generated(li, f"{base}/json")
    both = None
    for fmt in ("parquet", "json"):
        back = R.read_rollouts(spark, f"{base}/{fmt}", fmt=fmt).withColumn("fmt", F.lit(fmt))
        both = back if both is None else both.unionByName(back)
    return both.groupBy("sample_idx", "fmt").agg(F.count(F.lit(1)).alias("n"), F.sum("response_tokens").cast("long").alias("tokens"))


# --- K2: the JSON twin of the prompt dataset ---
@register("roundtrip_prompts_json", ORACLES["roundtrip_prompts"].replace("lb, ub, is_definite", "CASE WHEN is_definite THEN lb END AS lb, CASE WHEN is_definite THEN ub END AS ub, is_definite", 1))
def q_roundtrip_prompts_json(spark, sf):
    parsed = TQ._parsed_part(spark, sf).withColumns({
        "tree_id": F.col("p_brand"), "question_index": F.col("p_partkey").cast("int"), "level": F.lit(1), "split": F.lit("train")})
    records, path = PR.to_prompts(parsed), scratch_path(spark, "prompts_json")
    W.write_prompts(records, path, also_json=True, files=task_count(table(spark, sf, "part"), rows=100_000))
    schema = T.StructType([records.schema[c] for c in W.PROMPT_COLUMNS])
    back = spark.read.schema(schema.add("tree_id", "string").add("split", "string")).json(f"{path}/json")
    finite = lambda c: F.when(F.col("extra_info.is_definite"), F.col(f"extra_info.{c}"))
    flat = back.select(
        F.col("extra_info.question_index").cast("long").alias("p_partkey"), "tree_id", "data_source", "ability",
        F.col("prompt")[0]["content"].alias("system_content"), F.col("prompt")[1]["content"].alias("user_content"),
        F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.var").alias("var"),
        finite("lb").alias("lb"), finite("ub").alias("ub"), F.col("extra_info.is_definite").alias("is_definite"), "split")
    return PR.gate_length(flat, "user_content", max_len=520)


# --- K5: legacy report; K7: question list ---
@register("legacy_report", """
WITH r AS (SELECT l_partkey AS question_id, l_linestatus AS model, l_returnflag = 'R' AS correct, l_linenumber - 1 AS i FROM lineitem),
q AS (SELECT question_id, model, min(CASE WHEN correct THEN i END) AS f, count(*) AS n FROM r GROUP BY ALL)
SELECT model, CAST(count_if(coalesce(f < 1, false)) AS BIGINT) AS at_1, CAST(count_if(coalesce(f < 5, false)) AS BIGINT) AS at_5,
       round(count_if(coalesce(f < 5, false)) / count(*), 9) AS accuracy_5, CAST(sum(n) AS BIGINT) AS responses
FROM q GROUP BY model
""")
def q_legacy_report(spark, sf):
    samples = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("question_id"), F.concat(F.lit("q"), F.col("l_partkey").cast("string")).alias("question"),
        F.col("l_linestatus").alias("model"), (F.col("l_linenumber") - 1).alias("sample_idx"), F.lit("resp").alias("response"),
        (F.col("l_returnflag") == "R").alias("correct"))
    questions, summary, _total = M.legacy_report(samples, models=("F", "O"), ks=(1, 5))
    path = scratch_path(spark, "report")
    W.write_report(questions, summary, path)
    back = spark.read.schema(summary.schema).json(f"{path}/summary")
    per = spark.read.schema(questions.schema).json(f"{path}/questions")
    sizes = per.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.size(F.coalesce(F.col(f"{m}.responses"), F.array().cast("array<string>"))).alias("n"))
                                           for m in ("F", "O")])).alias("s")).groupBy(F.col("s.m").alias("model")).agg(F.sum("s.n").cast("long").alias("responses"))
    return rounded(back.join(sizes, "model").select(
        "model", F.col("`pass@1`.num_correct").alias("at_1"), F.col("`pass@5`.num_correct").alias("at_5"), F.col("`pass@5`.accuracy").alias("accuracy_5"), "responses"))


@register("question_list", "SELECT DISTINCT p_brand AS question FROM part")
def q_question_list(spark, sf):
    path = scratch_path(spark, "questions")
    W.write_question_list(table(spark, sf, "part").select(F.col("p_brand").alias("question")).distinct(), path)
    return spark.read.schema("question string").json(path)


# --- G2 ---
@register("drop_empty_questions", """
SELECT o_orderkey AS question FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
""")
def q_drop_empty_questions(spark, sf):
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("question"))
    v = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("question"))
    return PR.drop_empty_questions(q, v)


# --- P14, P15 ---
@register("parse_dialects", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size || '*x + f(1,2)' END AS regex_integrand,
       CASE WHEN p_size % 2 = 1 THEN p_size || '*x' ELSE p_size || '*x + f(1' END AS tuple_integrand, p_size % 2 = 1 AS is_definite,
       CASE WHEN p_size % 2 = 1 THEN '-pi/2' END AS lb_text, CASE WHEN p_size % 2 = 1 THEN CAST(p_size AS VARCHAR) END AS ub_text
FROM part
""")
def q_parse_dialects(spark, sf):
    size = F.col("p_size").cast("string")
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("integrate("), size, F.lit("*x + f(1,2), x)"))).otherwise(
        F.concat(F.lit("integrate("), size, F.lit("*x, (x, -pi/2, "), size, F.lit("))"))).alias("call"))
    p = parse_problems(p, "call", dialect="regex", prefix="r_")
    p = parse_problems(p, "call", dialect="tuple", prefix="t_")
    return p.select("p_partkey", F.col("r_integrand").alias("regex_integrand"), F.col("t_integrand").alias("tuple_integrand"),
                    F.col("t_is_definite").alias("is_definite"), F.col("t_lb_text").alias("lb_text"), F.col("t_ub_text").alias("ub_text"))


# --- U1 custom scorer, U2 extractor choice, U3 batch scoring with its metrics ---
@register("score_with", "SELECT l_linestatus, count(*) AS n, CAST(count_if(l_quantity % 2 = 0) AS BIGINT) AS even FROM lineitem GROUP BY 1")
def q_score_with(spark, sf):
    li = table(spark, sf, "lineitem").select("l_linestatus", F.col("l_quantity").cast("long").alias("q"))
    scored = V.score_with(li, lambda q: (q is not None and q % 2 == 0,), {"q": "q"}, [T.StructField("is_even", T.BooleanType())])
    return scored.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_even").alias("even"))


@register("extract_flexible", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size || '*x' WHEN 1 THEN 'the answer is <answer>' || p_size || '</answer>' ELSE NULL END AS answer FROM part
""")
def q_extract_flexible(spark, sf):
    """The flexible extractor takes the whole rest after the instructions."""
    size = F.col("p_size").cast("string")
    text = (F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("solve it</instruction>  "), size, F.lit("*x \n")))
            .when(F.col("p_size") % 3 == 1, F.concat(F.lit("the answer is <answer>"), size, F.lit("</answer>")))
            .otherwise(F.concat(F.lit("a</instruction>integrate("), size, F.lit(", x)"))))
    return table(spark, sf, "part").select("p_partkey", TX.extract_answer(text, "flexible").alias("answer"))


@register("score_batch", f"""
WITH r AS ({SQ.ROLLOUTS_SQL}),
e AS (SELECT step, response_tokens, {SQ._EXPECTED_FORMAL} AS f, {SQ._EXPECTED_JUDGE} AS j FROM r)
SELECT step, CAST(count_if(f = 'OK') AS DOUBLE) AS formal_ok, CAST(count_if(f = 'OK' AND j = 'NO_OK') AS DOUBLE) AS fn,
       round(avg(CASE WHEN j = 'OK' THEN response_tokens END), 6) AS judged_ok_len
FROM e GROUP BY step
""")
def q_score_batch(spark, sf):
    _scored, metrics = V.score_batch(SQ.rollouts(spark, sf), scratch_path(spark, "batch"), by=("step",))
    value = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return metrics.groupBy("step").agg(
        value("FORMAL/OK", "sum").alias("formal_ok"), value("CONFUSION_MATRIX/FN", "sum").alias("fn"),
        F.round(value("AGENT_LEN/JUDGE/OK", "mean"), 6).alias("judged_ok_len"))
