"""Readers, tree flattening and dedup on small fixtures, sinks, streaming, entry contract."""
import json
import os

from pyspark.sql import functions as F

from variantlake.operators.flatten import explode_buckets, flatten_trees
from variantlake.operators.variants import kept_variants, label_variants
from variantlake.sources import readers as R

TREE = {
    "base_question": "integrate(2*x + 3, x)",
    "tree": [
        {"level": 0, "variants": ["integrate(3 + x*2, x)", "integrate(x**2, x)"],
         "children": [{"level": 1, "variants": ["integrate(x*x, x)", "integrate(sin(x), (x, 0, 3))"],
                       "children": [{"level": 2, "variants": ["integrate(cos(x), x)"]}]},
                      {"level": 1, "variants": [], "children": []}]},
        {"level": 0, "variants": ["integrate(exp(x), x)", "integrate(y*x, x)"], "children": []},
    ],
}


def _write_tree_files(root):
    os.makedirs(f"{root}/a", exist_ok=True)
    with open(f"{root}/a/tree_t1.json", "w") as f:
        json.dump(TREE, f)
    with open(f"{root}/tree_t2.json", "w") as f:
        f.write("{broken")
    open(f"{root}/tree_t3.json", "w").close()
    with open(f"{root}/tree_t4.json", "w") as f:
        json.dump({"no_tree": 1}, f)
    with open(f"{root}/tree_t5.json", "w") as f:
        json.dump({"base_question": "integrate(x, x)", "tree": "oops"}, f)
    with open(f"{root}/q1.json", "w") as f:  # no id in the name
        json.dump(TREE, f)


def test_read_trees_quarantines_and_flattens_bfs_dfs(spark, tmpdir_path):
    _write_tree_files(tmpdir_path)
    ok, bad = R.read_trees(spark, tmpdir_path)
    # zero-byte files yield no row at all (skipped, as in the original)
    assert sorted((r.tree_id, r.reject_reason) for r in bad.collect()) == [
        ("", "no_tree_id"), ("t2", "broken_json"), ("t4", "missing_keys"), ("t5", "wrong_type")]
    bfs = [r.variant for r in flatten_trees(ok, "bfs").orderBy("order_key").collect()]
    assert bfs == ["integrate(3 + x*2, x)", "integrate(x**2, x)", "integrate(x*x, x)",
                   "integrate(sin(x), (x, 0, 3))", "integrate(cos(x), x)", "integrate(exp(x), x)",
                   "integrate(y*x, x)"]
    dfs = [r.variant for r in flatten_trees(ok, "dfs").orderBy("order_key").collect()]
    assert dfs[:5] == bfs[:5] and len(dfs) == 7


def test_kept_variants_dedup_base_and_index(spark, tmpdir_path):
    _write_tree_files(tmpdir_path)
    ok, _ = R.read_trees(spark, tmpdir_path)
    labels = {r.variant: r.reject_reason for r in label_variants(ok).collect()}
    assert labels["integrate(3 + x*2, x)"] == "base_question"
    assert labels["integrate(x*x, x)"] == "duplicate"  # same as x**2, which comes first in BFS
    assert labels["integrate(y*x, x)"] == "numeric"
    kept = [(r.question_index, r.integrand) for r in kept_variants(ok).orderBy("question_index").collect()]
    assert kept == [(0, "x**2"), (1, "sin(x)"), (2, "cos(x)"), (3, "exp(x)")]
    # idempotent: deduplicating the kept set again changes nothing
    assert kept_variants(ok).count() == 4


def test_trees_of_one_id_in_two_files_stay_apart(spark, tmpdir_path):
    _write_tree_files(tmpdir_path)
    os.makedirs(f"{tmpdir_path}/b")
    with open(f"{tmpdir_path}/b/tree_t1.json", "w") as f:
        json.dump(TREE, f)
    kept = kept_variants(R.read_trees(spark, tmpdir_path)[0])
    assert sorted((r.question_index, r.integrand) for r in kept.collect()) == sorted(
        [(0, "x**2"), (1, "sin(x)"), (2, "cos(x)"), (3, "exp(x)")] * 2)
    assert kept.select("file").distinct().count() == 2


def test_deep_trees_are_whole(spark):
    depth = 400
    node = {"variants": ["leaf"]}
    for _ in range(depth):
        node = {"variants": ["integrate(x, x)"], "children": [node]}
    docs = spark.createDataFrame([("t", json.dumps({"base_question": "integrate(2*x, x)", "tree": [node]}))], "tree_id string, value string")
    rows = flatten_trees(docs).collect()
    assert len(rows) == depth + 1 and max(r.depth for r in rows) == depth


def _chain(depth):
    return '{"variants":["integrate(x, x)"],"children":[' * depth + '{"variants":["leaf \\\\ \\" [{"]}' + "]}" * depth


def test_chains_beyond_the_parser_are_whole(spark):
    """Deeper than the JSON parser follows: 700 to 3,000 levels, with side branches and broken ones."""
    doc = '{"base_question":"integrate(2*x, x)","tree":[%s]}'
    side = '{"variants":["side","' + "y" * 30 + '"],"children":[{"level":"7","variants":["below"]}]}'
    rows = [("a", doc % _chain(700)), ("b", doc % (_chain(3) + "," + _chain(3000))), ("c", doc % _chain(1200).replace('{"variants":["leaf', '{"children":[%s],"variants":["leaf' % side, 1)),
            ("d", doc % _chain(800)[:-1]), ("e", doc % _chain(800) + "x"), ("f", '{"tree":[%s]}' % _chain(600)), ("g", doc % _chain(900).replace('["leaf', '[5],"children":["leaf', 1)),
            ("h", doc % '{"variants":[%s]}' % ("[" * 1200 + "]" * 1200)), ("i", doc % ",".join([_chain(2)] * 600)), ("a", doc % _chain(700))]
    docs = spark.createDataFrame(rows, "tree_id string, value string")
    from variantlake.operators.flatten import parsed_trees

    reasons = sorted((r.tree_id, r.reason or "", len(r.variants or [])) for r in parsed_trees(docs).collect())
    assert reasons == [("a", "", 701), ("a", "", 701), ("b", "", 3005), ("c", "", 1204), ("d", "broken_json", 0), ("e", "broken_json", 0),
                       ("f", "missing_keys", 0), ("g", "wrong_type", 0), ("h", "wrong_type", 0), ("i", "", 1800)]
    flat = flatten_trees(docs.where("tree_id = 'b'")).orderBy("order_idx").collect()
    assert [r.root_idx for r in flat] == [0] * 4 + [1] * 3001 and flat[-1].depth == 3000 and flat[-1].path == [0] * 3000
    assert flat[-1].variant == flat[3].variant == 'leaf \\ " [{'
    side_rows = {r.variant: (r.depth, r.level, r.path) for r in flatten_trees(docs.where("tree_id = 'c'"), "dfs").where("vpos < 2 AND variant IN ('side', 'below')").collect()}
    assert side_rows["side"] == (1201, None, [0] * 1201) and side_rows["below"] == (1202, 7, [0] * 1202)


def test_odd_tree_documents(spark):
    doc = '{"base_question":"integrate(2*x, x)","tree":%s}'
    cases = {
        doc % '[{"level":2.7,"variants":[1.5,null,true,{"a":[1]}],"children":null},{"level":"x","variants":["b"]}]': None,
        doc % "[5]": "wrong_type", doc % "[null]": "wrong_type", doc % '[{"variants":"a"}]': "wrong_type", doc % '[{"children":{}}]': "wrong_type",
        doc % "[{}]": None, doc % "[]": None, doc % "null": "missing_keys", doc % "7": "wrong_type", doc % "[] x": "broken_json", doc % "[],": "broken_json",
        "[]": "missing_keys", "5": "missing_keys", "": "empty", None: "empty", '{"base_question":null,"tree":[]}': "missing_keys",
        doc % "[]" + "," + doc % "[]": "broken_json", '{"base_question":3,"tree":[{"variants":["v"]}]}': None}
    docs = spark.createDataFrame([(str(i), t, 1) for i, t in enumerate(cases)], "tree_id string, value string, variants int").drop("variants")
    from variantlake.operators.flatten import parsed_trees

    got = {int(r.tree_id): r for r in parsed_trees(docs).collect()}
    assert [got[i].reason for i in range(len(cases))] == list(cases.values())
    assert [(v.level, v.vpos, v.variant) for v in got[0].variants] == [(2, 0, "1.5"), (2, 1, None), (2, 2, "true"), (2, 3, '{"a":[1]}'), (None, 0, "b")]
    assert got[len(cases) - 1].base_question == "3" and flatten_trees(docs.limit(0)).count() == 0
    plan = flatten_trees(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_base_questions_that_fail_are_rejected(spark):
    from variantlake.operators.prompts import make_splits
    from variantlake.operators.variants import base_questions

    docs = spark.createDataFrame([(t, json.dumps({"base_question": q, "tree": [{"variants": ["integrate(x, x)"]}]}))
                                  for t, q in (("a", "integrate(x**2, x)"), ("b", "integrate(x**, x)"), ("c", "what?"))], "tree_id string, value string")
    base = base_questions(docs)
    assert {r.tree_id: r.reject_reason for r in base.collect()} == {"a": None, "b": "syntax", "c": "unparsable_call"}
    splits = make_splits(kept_variants(docs), base, num_eval=2).where("split = 'eval'").collect()
    assert sorted((r.tree_id, r.question_index, r.reject_reason) for r in splits if r.tree_id == "a") == [("a", 0, None), ("a", 1, None)]
    assert sorted((r.tree_id, r.reject_reason) for r in splits if r.tree_id != "a") == [("b", "base_not_verifiable"), ("c", "base_not_verifiable")]


def test_raw_and_test_question_readers(spark, tmpdir_path):
    q = f"{tmpdir_path}/question_1"
    os.makedirs(q)
    with open(f"{q}/train.json", "w") as f:
        json.dump({"integral": "integrate(x, x)", "variants": {
            "easier": [{"variant": "integrate(1, x)", "reasoning": "r", "requested_difficulty": "easier"},
                       {"variant": "integrate(2, x)", "reasoning": ""}],
            "harder": [{"variant": "integrate(x**9, x)", "reasoning": "h"}]}}, f)
    with open(f"{q}/test.json", "w") as f:
        json.dump({"question": "integrate(cosh(2*x), x)", "ground_truth_solution": "sinh(2*x)/2"}, f)
    raw, _ = R.read_raw_questions(spark, tmpdir_path)
    rows = explode_buckets(raw, keep=("integral",)).collect()
    assert sorted((r.bucket, r.difficulty) for r in rows) == [("easier", "easier"), ("easier", "unknown"),
                                                              ("harder", "unknown")]
    t = R.read_test_questions(spark, tmpdir_path).first()
    assert (t.question_id, t.ground_truth_solution) == ("question_1", "sinh(2*x)/2")


def test_streaming_matches_batch(spark, tmpdir_path):
    from variantlake.operators.verify import score_rollouts
    from variantlake.streaming.score_stream import rollout_stream, score_stream, score_rows, windowed_status_counts

    rows = [(f"r{i}", f"<answer>{i}*x**2/2</answer>" if i % 3 else "none", f"{i}*x", "x", float("-inf"),
             float("inf"), "<JUDGE_SCORE>1</JUDGE_SCORE>", i % 4, f"2024-01-0{1 + i % 5} 00:00:00") for i in range(1, 31)]
    df = spark.createDataFrame(rows, "rollout_id string, response string, ground_truth string, var string, lb double, "
                                     "ub double, judge_response string, step int, ts string").withColumn("ts", F.to_timestamp("ts"))
    src = f"{tmpdir_path}/src"
    df.union(df).write.parquet(src)  # every rollout twice: the stream drops the copies
    stream = rollout_stream(spark, src, spark.read.parquet(src).schema, watermark="3650 days")
    score_stream(stream, f"{tmpdir_path}/sink", f"{tmpdir_path}/ckpt")
    got = sorted((r.rollout_id, r.formal_status) for r in spark.read.parquet(f"{tmpdir_path}/sink").collect())
    want = sorted((r.rollout_id, r.formal_status) for r in score_rollouts(df).collect())
    assert got == want
    counts = (windowed_status_counts(score_rows(spark.readStream.schema(df.schema).parquet(src)), watermark="3650 days")
              .writeStream.outputMode("complete").format("memory").queryName("vl_counts").start())
    counts.processAllAvailable()
    counts.stop()
    assert spark.sql("SELECT sum(n) FROM vl_counts").first()[0] == 60


def test_entry_contract(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sinks_roundtrip(spark, tmpdir_path):
    from variantlake.sources import writers as W

    v = spark.createDataFrame([("q1", 1, 0, "integrate(1, x)", "r", "easier"), ("q1", 0, 1, "integrate(4, x)", "u", "harder"),
                               ("q1", 0, 0, "integrate(2, x)", "s", "harder"), ("q2", 0, 0, "integrate(3, x)", "t", "unknown")],
                              "question string, bucket_pos int, pos int, variant string, reasoning string, difficulty string")
    W.write_formatted(v, f"{tmpdir_path}/fmt")
    back = R.read_formatted(spark, f"{tmpdir_path}/fmt", lines=True)
    got = {r.question: [x.variant for x in r.variants] for r in back.collect()}
    assert got == {"q1": ["integrate(2, x)", "integrate(4, x)", "integrate(1, x)"], "q2": ["integrate(3, x)"]}
    with open(f"{tmpdir_path}/array.json", "w") as f:  # the original's top-level array layout
        json.dump([{"question": "q", "variants": [{"variant": "v", "reasoning": "r", "difficulty": "easier"}]}], f)
    assert R.read_formatted(spark, f"{tmpdir_path}/array.json").first().variants[0].variant == "v"
    W.write_question_list(v.select("question").distinct(), f"{tmpdir_path}/ql")
    assert spark.read.json(f"{tmpdir_path}/ql").count() == 2
    W.write_generated(v, f"{tmpdir_path}/gen")
    W.write_report(v, v.groupBy("question").count(), f"{tmpdir_path}/rep")
    assert spark.read.json(f"{tmpdir_path}/rep/summary").count() == 2


def test_parse_dialects_and_v2(spark, tmpdir_path):
    from variantlake.functions.parse import parse_problems
    from variantlake.operators.verify import score_batch, validate_syntax

    df = spark.createDataFrame([("integrate(x**2 + sin(x), x)",), ("integrate(x, (x, 0, pi/2))",)], "p string")
    rx = {r.p: r.integrand for r in parse_problems(df, "p", dialect="regex").collect()}
    assert rx["integrate(x**2 + sin(x), x)"] == "x**2 + sin(x)"
    tp = {r.p: (r.is_definite, r.lb_text, r.ub_text) for r in parse_problems(df, "p", dialect="tuple").collect()}
    assert tp["integrate(x, (x, 0, pi/2))"] == (True, "0", "pi/2")
    lg = {r.p: (r.integrand, r.var) for r in parse_problems(df, "p", dialect="legacy").collect()}
    assert lg["integrate(x**2 + sin(x), x)"] == ("x**2 + sin(x)", " x")
    s = spark.createDataFrame([("x^2 + C",), ("x**",), ("log(x - 20)",)], "solution string")
    assert {r.solution: r.formatting_ok for r in validate_syntax(s).collect()} == {
        "x^2 + C": True, "x**": False, "log(x - 20)": True}
    r = spark.createDataFrame([("r1", "<answer>x**2</answer>", "<JUDGE_SCORE>1</JUDGE_SCORE>", "2*x", 5, 1)],
                              "rollout_id string, response string, judge_response string, ground_truth string, "
                              "response_tokens int, step int").selectExpr(
        "*", "'x' AS var", "CAST('-inf' AS DOUBLE) AS lb", "CAST('inf' AS DOUBLE) AS ub")
    scored, metrics = score_batch(r, f"{tmpdir_path}/scored")
    assert scored.first().reward == 1.0
    assert {m.metric: m.sum for m in metrics.collect()}["CONFUSION_MATRIX/TP"] == 1.0


def test_windowed_counts_drop_late_rows(spark, tmpdir_path):
    import datetime as dt

    from variantlake.streaming.score_stream import score_rows, windowed_status_counts

    schema = ("rollout_id string, response string, ground_truth string, var string, lb double, ub double, "
              "ts timestamp")

    def batch(rows, path):
        spark.createDataFrame([(rid, "<answer>x**2</answer>", "2*x", "x", float("-inf"), float("inf"), ts)
                               for rid, ts in rows], schema).coalesce(1).write.mode("overwrite").parquet(path)

    src = f"{tmpdir_path}/arrivals"
    day = lambda d: dt.datetime(2024, 1, d, 12)
    batch([("a", day(1)), ("b", day(1)), ("c", day(3)), ("d", day(5))], f"{src}/b1")
    stream = spark.readStream.schema(schema).parquet(f"{src}/*")  # one arrival = one file = one batch
    q = (windowed_status_counts(score_rows(stream), window="1 day", watermark="1 day")
         .writeStream.outputMode("append").format("memory").queryName("vl_late").start())
    q.processAllAvailable()
    batch([("e", day(1)), ("f", day(6))], f"{src}/b2")  # e is behind the watermark (day 4)
    q.processAllAvailable()
    q.stop()
    got = {r.window.start.day: (r.n, r.formal_OK) for r in spark.table("vl_late").collect()}
    assert got.get(1) == (2, 2)  # the late row did not reopen the closed day-1 window
    assert 5 not in got and 6 not in got  # open windows are not emitted in append mode


def test_census_of_raw_question_dirs(spark, tmpdir_path):
    from variantlake.operators.metrics import census, ground_truth_share

    def write(q, variants, solution):
        os.makedirs(f"{tmpdir_path}/{q}")
        with open(f"{tmpdir_path}/{q}/train.json", "w") as f:
            json.dump({"integral": f"integrate({q}, x)", "variants": variants}, f)
        with open(f"{tmpdir_path}/{q}/test.json", "w") as f:
            json.dump({"question": f"integrate({q}, x)", "ground_truth_solution": solution}, f)

    item = {"variant": "integrate(1, x)", "reasoning": "r"}
    write("q1", {"easier": [item] * 3, "equivalent": [item]}, "x")
    write("q2", {"easier": [item], "harder": [item] * 2}, None)
    raw, _ = R.read_raw_questions(spark, tmpdir_path)
    rows = explode_buckets(raw, keep=("integral",))
    got = {r.difficulty: (r.variants, r.questions, r.mean)
           for r in census(rows, question="integral", difficulty="bucket").withColumnRenamed("bucket", "difficulty").collect()}
    assert got == {"easier": (4, 2, 2.0), "equivalent": (1, 1, 1.0), "harder": (2, 1, 2.0), "total": (7, 2, 3.5)}
    share = ground_truth_share(R.read_test_questions(spark, tmpdir_path)).first()
    assert (share.with_ground_truth, share.questions, share.share) == (1, 2, 0.5)


def test_readme_flow_end_to_end(spark, tmpdir_path):
    """Trees -> kept variants -> prompt dataset -> rollouts joined by key -> scores and pass@k."""
    from variantlake.operators import metrics as M
    from variantlake.operators import prompts as PR
    from variantlake.operators import variants as VA
    from variantlake.operators import verify as V
    from variantlake.sources import writers as W

    _write_tree_files(f"{tmpdir_path}/trees")
    trees, _ = R.read_trees(spark, f"{tmpdir_path}/trees")
    kept = VA.kept_variants(trees, order="bfs")
    W.write_prompts(PR.to_prompts(kept.withColumn("split", F.lit("train"))), f"{tmpdir_path}/prompts")
    prompts = spark.read.parquet(f"{tmpdir_path}/prompts/parquet").select(
        "tree_id", "extra_info.question_index", "extra_info.var", "extra_info.lb", "extra_info.ub",
        F.col("reward_model.ground_truth").alias("ground_truth"))
    # kept: 0 x**2, 1 sin(x) on [0, 3], 2 cos(x), 3 exp(x); answers right for 0, 1, 3 and wrong for 2
    answers = {0: "x**3/3", 1: "1 - cos(3)", 2: "cos(x)", 3: "exp(x)"}
    rows = [(f"r{q}-{i}", "t1", q, i, "eval", 1, None, f"<answer>{answers[q]}</answer>" if i % 2 == 0 else "none",
             40, "<JUDGE_SCORE>1</JUDGE_SCORE>") for q in answers for i in range(4)]
    W.write_generated(spark.createDataFrame(rows, R.ROLLOUTS), f"{tmpdir_path}/rollouts")
    rollouts = R.read_rollouts(spark, f"{tmpdir_path}/rollouts", fmt="json").join(prompts, ["tree_id", "question_index"])
    scored, metrics = V.score_batch(rollouts, f"{tmpdir_path}/scored", by=["step"])
    status = {(r.question_index, r.sample_idx): r.formal_status for r in scored.collect()}
    assert status[(0, 0)] == "OK" and status[(1, 0)] == "OK" and status[(2, 0)] == "NO_OK" and status[(3, 2)] == "OK"
    assert status[(0, 1)] == "NO_INP_IN_TAGS"
    m = {r.metric: r.sum for r in metrics.collect()}
    assert m["FORMAL/OK"] == 6.0 and m["CONFUSION_MATRIX/FP"] == 2.0
    passk = {(r.question_index, r.k): r.pass_at_k for r in
             M.evaluate_rollouts(rollouts, by=["question_index"], ks=[1, 4]).collect()}
    assert passk[(0, 1)] == 0.5 and passk[(0, 4)] == 1.0 and passk[(2, 4)] == 0.0


def test_stream_writes_per_batch_metrics(spark, tmpdir_path):
    from variantlake.streaming.score_stream import rollout_stream, score_stream

    rows = [(f"r{i}", "<answer>x**2</answer>" if i % 2 else "<answer>x**3</answer>", "2*x", "x", float("-inf"),
             float("inf"), "<JUDGE_SCORE>1</JUDGE_SCORE>", 7) for i in range(10)]
    df = spark.createDataFrame(rows, "rollout_id string, response string, ground_truth string, var string, lb double, "
                                     "ub double, judge_response string, step int").withColumn("ts", F.current_timestamp())
    src = f"{tmpdir_path}/src"
    df.write.parquet(src)
    stream = rollout_stream(spark, src, spark.read.parquet(src).schema)
    score_stream(stream, f"{tmpdir_path}/sink", f"{tmpdir_path}/ckpt", metrics_sink=f"{tmpdir_path}/metrics")
    m = {r.metric: (r.mean, r.sum) for r in spark.read.parquet(f"{tmpdir_path}/metrics").collect()}
    assert m["FORMAL/OK"] == (0.5, 5.0) and m["FORMAL/NO_OK"] == (0.5, 5.0) and m["JUDGE/OK"] == (1.0, 10.0)


def _scored_steps(spark, start, n, day):
    """Scored rollouts of steps 0..2 at one day; step 2 only in the first days."""
    steps = [(i % 3 if day < 3 else i % 2) for i in range(start, start + n)]
    rows = [(f"r{start + i}", s, ("OK", "NO_OK", "NO_SYMPY_EXPR")[(start + i) % 3], ("OK", "NO_OK")[(start + i) % 2], float((start + i) % 3 == 0), 10 + i, "j" * (i % 5))
            for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "rollout_id string, step int, formal_status string, judge_status string, formal_result double, response_tokens int, judge_response string"
                                 ).withColumn("ts", F.to_timestamp(F.lit(f"2024-01-{day:02d} 12:00:00")))


def _step_rows(df):
    return sorted((r.step, r.metric, None if r["mean"] is None else round(r["mean"], 9), r["sum"]) for r in df.collect())


def test_a_step_over_several_batches_is_one_row(spark, tmpdir_path):
    """Three batches, a restart from the checkpoint, a step that expires and one that comes back late."""
    from variantlake.operators.metrics import batch_metrics
    from variantlake.streaming.step_metrics import read_step_metrics, step_totals, write_step_totals

    src, sink, ckpt = (f"{tmpdir_path}/{d}" for d in ("src", "sink", "ckpt"))
    arrivals = [_scored_steps(spark, 0, 40, 1), _scored_steps(spark, 40, 25, 2), _scored_steps(spark, 65, 30, 20), _scored_steps(spark, 95, 12, 21), _scored_steps(spark, 107, 9, 2)]
    everything = None
    for i, rows in enumerate(arrivals):
        rows.coalesce(2).write.parquet(f"{src}/{i}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{src}/*")
        write_step_totals(step_totals(stream, watermark="1 hour", expiry_seconds=3 * 86400), sink, ckpt)  # a new start each time
        everything = rows if everything is None else everything.unionByName(rows)
        got = read_step_metrics(spark, sink, rows.columns)
        assert _step_rows(got) == _step_rows(batch_metrics(everything)), i
    state = {r.step: (r.n, r.closed) for r in got.select("step", "n", "closed").distinct().collect()}
    counts = {r.step: r["count"] for r in everything.groupBy("step").count().collect()}
    assert {s: n for s, (n, _) in state.items()} == counts
    parts = spark.read.parquet(sink)
    assert parts.where("step = 2 AND closed").count() == 1 and parts.where("step = 2").select("part").distinct().count() == 2  # expired, then late rows
    assert parts.where("step = 0").select("part").distinct().count() == 1  # new rows put its end off


def test_the_log_shows_committed_batches_once(spark, tmpdir_path):
    """A batch that failed after writing files, and one that runs again, leave one copy of each row."""
    from variantlake.sources import writers as W

    src, log, ckpt = (f"{tmpdir_path}/{d}" for d in ("src", "log", "ckpt"))
    row = lambda i: (f"r{i}", 0, "t", "x", 0.0, 1.0, 1, True, "rule", "x", "a", "j", "OK", "OK", 1, 1.0, i % 2)
    for i in range(3):
        spark.createDataFrame([row(10 * i + k) for k in range(5)], W.EVAL_LOG).write.parquet(f"{src}/{i}")
        W.stream_eval_log(spark.readStream.schema(W.EVAL_LOG).parquet(f"{src}/*"), log, ckpt)
    ids = [10 * i + k for i in range(3) for k in range(5)]
    with open(f"{log}/eval_step=0/part-of-a-failed-batch.json", "w") as f:
        f.write(json.dumps({"rollout_id": "never committed"}) + "\n")
    assert sorted(r.rollout_id for r in W.read_eval_log(spark, log).collect()) == sorted(f"r{i}" for i in ids)
    for name in ("2", ".2.crc"):  # the query forgets that its last batch was done and runs it again
        if os.path.exists(f"{ckpt}/commits/{name}"):
            os.remove(f"{ckpt}/commits/{name}")
    W.stream_eval_log(spark.readStream.schema(W.EVAL_LOG).parquet(f"{src}/*"), log, ckpt)
    assert sorted(r.rollout_id for r in W.read_eval_log(spark, log).collect()) == sorted(f"r{i}" for i in ids)


def test_filter_on_tree_id_opens_its_file_alone(spark, tmpdir_path):
    for i in range(300):
        with open(f"{tmpdir_path}/tree_{i}.json", "w") as f:
            json.dump({"base_question": "integrate(x, x)", "tree": [{"level": 0, "variants": [f"integrate({i}*x, x)"], "children": []}]}, f)
    trees, _ = R.read_trees(spark, tmpdir_path)
    assert trees.rdd.getNumPartitions() <= 30
    one = trees.where(F.col("tree_id") == "77")
    assert [r.tree_id for r in one.collect()] == ["77"]
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numFiles").value() == 1
    assert [r.variant for r in flatten_trees(one, order="bfs").collect()] == ["integrate(77*x, x)"]


def test_rows_of_a_batch_are_scored_by_their_distinct_arguments(spark):
    import pandas as pd
    from pyspark.sql import types as T
    from variantlake.operators import verify as V

    first, of = V._distinct_rows(pd.DataFrame({"a": ["x", None, "x", None, "y"], "b": [1.0, float("nan"), 1.0, 2.0, 1.0]}))
    assert list(first[of]) == [0, 1, 0, 3, 4]
    assert [len(x) for x in V._distinct_rows(pd.DataFrame({"a": pd.Series([], dtype=object)}))] == [0, 0]
    rows = [("x", 1.0, 1), ("x", 1.0, 2), (None, float("nan"), 3), (None, None, 4), ("x", None, 5)]
    df = spark.createDataFrame(rows, "a string, b double, id int").coalesce(1)
    out = V.score_with(df, lambda a, b: (f"{a}/{b}", [a, a]), {"a": "a", "b": "b"}, [T.StructField("s", T.StringType()), T.StructField("l", T.ArrayType(T.StringType()))])
    assert [(r.s, r.l) for r in out.orderBy("id").collect()] == [("x/1.0", ["x", "x"])] * 2 + [("None/None", [None, None])] * 2 + [("x/None", ["x", "x"])]


def test_a_run_over_what_is_there_adds_no_empty_batch(spark, tmpdir_path):
    import os

    from variantlake.streaming.score_stream import rollout_stream, score_stream

    one = spark.createDataFrame([("a", "<answer>x**2/2</answer>", "x", "x", float("-inf"), float("inf"), "<JUDGE_SCORE>1</JUDGE_SCORE>", 1)],
                                "rollout_id string, response string, ground_truth string, var string, lb double, ub double, judge_response string, step int")
    src, before = f"{tmpdir_path}/src", spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    for day, ids in ((1, ["a", "a", "b"]), (1, ["b", "c"]), (9, ["d", "d"])):  # three runs on one checkpoint
        rows = one.drop("rollout_id").crossJoin(spark.createDataFrame([(i,) for i in ids], "rollout_id string"))
        rows.withColumn("ts", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(day), F.lit(0), F.lit(0), F.lit(0))).coalesce(1).write.mode("append").parquet(src)
        stream = rollout_stream(spark, src, spark.read.parquet(src).schema, watermark="2 days")
        score_stream(stream, f"{tmpdir_path}/sink", f"{tmpdir_path}/ckpt")
    assert sorted(f for f in os.listdir(f"{tmpdir_path}/sink") if f.startswith("epoch")) == ["epoch=0", "epoch=1", "epoch=2"]
    assert sorted(r.rollout_id for r in spark.read.parquet(f"{tmpdir_path}/sink").collect()) == ["a", "b", "c", "d"]
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == before


def _line_tables(spark, path):
    """Small lineitem and part with null and repeated keys."""
    import datetime

    days = [datetime.datetime(1995, m, 3) for m in (1, 2, 3)] + [None]
    lines = [(i, i % 7 if i % 11 else None, 1, i % 7 + 1, float(i % 50), 10.0 * i, 0.1, 0.0, "ANR"[i % 3], "FO"[i % 2], days[i % 4]) for i in range(60)]
    parts = [(k, kind, k + 3) for k, kind in enumerate(("ECONOMY", "PROMO", "LARGE", "SMALL", "MEDIUM", "STANDARD"))] + [(2, "LARGE", 9), (None, "PROMO", 4)]
    spark.createDataFrame(lines + lines[:5], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_size int").write.parquet(f"{path}/part.parquet")


def test_the_streamed_log_is_compressed_and_its_rows_are_dealt_while_narrow(spark, tmpdir_path):
    import glob

    from variantlake.plans import scoring_queries as SQ
    from variantlake.sources import writers as W

    _line_tables(spark, tmpdir_path)
    dealt = SQ.rollouts_dealt(spark, tmpdir_path, 3)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(dealt) == rows(SQ.rollouts(spark, tmpdir_path)) and dealt.rdd.getNumPartitions() == 3
    deal = next(line for line in dealt._jdf.queryExecution().executedPlan().toString().split("\n") if "REPARTITION_BY_NUM" in line)
    below = dealt._jdf.queryExecution().optimizedPlan().toString().split("Repartition 3")[1]
    assert deal and "Working:" not in below and "md5" not in below  # no text is made before the rows are dealt
    src, log = f"{tmpdir_path}/src", f"{tmpdir_path}/log"
    row = ("r", 0, "t", "x", 0.0, 1.0, 1, True, "rule", "x", "a", "j", "OK", "OK", 1, 1.0, 5)
    spark.createDataFrame([row], W.EVAL_LOG).write.parquet(src)
    W.stream_eval_log(spark.readStream.schema(W.EVAL_LOG).parquet(src), log, f"{tmpdir_path}/ckpt")
    files = glob.glob(f"{log}/eval_step=5/part-*")
    assert files and all(f.endswith(".json.gz") for f in files)
    assert [r.eval_step for r in W.read_eval_log(spark, log).collect()] == [5]


def test_a_batch_of_arrow_columns_is_scored_by_its_distinct_rows(spark):
    import pyarrow as pa
    from pyspark.sql import types as T
    from variantlake.operators import verify as V

    first, of = V._distinct_rows([pa.array(["x", None, "x", None, "y"]), pa.array([1.0, float("nan"), 1.0, 2.0, 1.0]), pa.array([None, 1, None, 1, None])])
    assert list(first[of]) == [0, 1, 0, 3, 4]
    assert [len(x) for x in V._distinct_rows([pa.array([], pa.string())])] == [0, 0]
    rows = [(1, 1.5, True, "2024-01-02 03:00:00"), (None, float("nan"), None, None), (1, 1.5, True, "2024-01-02 03:00:00")]
    df = spark.createDataFrame(rows, "i long, d double, b boolean, t string").coalesce(1).withColumn("t", F.to_timestamp("t"))
    kinds = T.ArrayType(T.StringType())
    out = V.score_with(df, lambda *a: ([f"{x}" for x in a], float("nan")), {c: c for c in df.columns}, [T.StructField("l", kinds), T.StructField("n", T.DoubleType())])
    assert [r.l[1:] for r in out.collect()] == [["1.5", "True", "2024-01-02 03:00:00"], ["None"] * 3, ["1.5", "True", "2024-01-02 03:00:00"]]
    assert out.where("n IS NOT NULL").count() == 0  # as before, a NaN is no result


def test_only_spellings_with_others_near_are_compared(spark):
    from variantlake.operators import dedup as D

    expanded = "x**10 - 10*x**9 + 45*x**8 - 120*x**7 + 210*x**6 - 252*x**5 + 210*x**4 - 120*x**3 + 45*x**2 - 10*x + 1"
    one = ["x", "x*x", "x**2", "(x - 1)**10", expanded, "x + 10**(-9)", "sqrt(x**2)", "Abs(x)", "x", "cos(x)**2 + sin(x)**2", "1 + 0*x", "exp(x)", "no_such(x)", "log(x)"]
    noisy = ["x + 10**6*(cos(x)**2 + sin(x)**2) - 10**6", "x", "sin(x) + 10**8 - 10**8", "sin(x)", "3*x", "x**3"]
    rows = [(t, i, e, v) for t, es in (("a", one), ("b", noisy), ("c", ["x", "sin(x)", "x**3"]), (None, one[:6])) for v in ("x",) for i, e in enumerate(es)]
    rows += [("a", 20, "t", "t"), ("a", 21, "t*t", "t"), ("a", 3, "(x - 1)**10", "x")]  # another variable, and a repeated row
    df = D.add_fingerprint(spark.createDataFrame(rows, "tree_id string, order_idx int, integrand string, var string")).withColumn("spelled", D.spelled())
    seen = df.withColumn("near", D.near_others(["tree_id", "var"])).cache()
    found = lambda d: sorted((str(r.tree_id), r.var, r.spelled, r.earlier) for r in D.earlier_equals(d, ["tree_id"], "order_idx").collect())
    assert found(seen.where("near")) == found(seen) != []
    assert seen.where("near IS NULL").count() == 0 and not seen.where("tree_id = 'c' AND near").count()
    assert 0 < seen.where("tree_id = 'a' AND near").count() < seen.where("tree_id = 'a'").count() / 2
