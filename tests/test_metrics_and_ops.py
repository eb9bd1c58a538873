"""Aggregations, rankings, dedup and prompt projections."""
import math

import pytest
from pyspark.sql import functions as F

from variantlake.operators import metrics as M
from variantlake.operators import prompts as PR
from variantlake.operators.dedup import dedup_exact
from variantlake.operators.ranking import first_per_group, group_index, top_n_per_group


@pytest.mark.parametrize("n,c,k,expected", [(50, 3, 1, 0.06), (50, 3, 5, 0.2760204081632653), (50, 0, 1, 0.0),
                                            (5, 5, 1, 1.0), (50, 48, 5, 1.0)])
def test_pass_at_k_values(spark, n, c, k, expected):
    rows = [("q", i < c) for i in range(n)]
    out = M.pass_at_k(spark.createDataFrame(rows, "q string, correct boolean"), ["q"], ks=[k]).first()
    assert math.isclose(out.pass_at_k, expected, rel_tol=1e-12, abs_tol=1e-12)


def test_pass_at_k_monotone_in_k(spark):
    rows = [("q", i % 7 == 0) for i in range(50)]
    vals = [r.pass_at_k for r in M.pass_at_k(spark.createDataFrame(rows, "q string, correct boolean"), ["q"],
                                             ks=[1, 5, 10, 20]).orderBy("k").collect()]
    assert vals == sorted(vals) and all(0 <= v <= 1 for v in vals)


def test_group_index_is_exact_under_a_hot_group(spark):
    rows = [("hot", i) for i in range(5000)] + [(f"g{i}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v int")
    out = group_index(df, ["g"], ["v"], out="idx", num_partitions=16)
    hot = [r.idx for r in out.where("g = 'hot'").orderBy("v").collect()]
    assert hot == list(range(5000))
    assert out.where("g <> 'hot'").agg(F.max("idx")).first()[0] == 0


def test_first_wins_and_top_n(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("a", 2, "w")], "g string, o int, t string")
    assert sorted(tuple(r) for r in first_per_group(df, ["g"], ["o"]).collect()) == [("a", 1, "y"), ("b", 2, "z")]
    assert sorted(r.o for r in top_n_per_group(df, ["g"], ["o"], 2).where("g='a'").collect()) == [1, 2]
    d = spark.createDataFrame([("q", "v", 2), ("q", "v", 1), ("q", "w", 3)], "question string, variant string, request_order int")
    assert sorted(tuple(r) for r in dedup_exact(d).collect()) == [("q", "v", 1), ("q", "w", 3)]


def test_status_confusion_and_lengths(spark):
    rows = [(1, "OK", "OK", 1.0, 10, "ab"), (1, "NO_OK", "OK", 0.0, 20, None), (1, "NO_OK", "NO_OK", 0.0, 30, "abcd"),
            (1, "OK", "NO_OK", 1.0, 40, "")]
    df = spark.createDataFrame(rows, "step int, formal_status string, judge_status string, formal_result double, "
                                     "response_tokens int, judge_response string")
    cm = {r.metric: r.sum for r in M.confusion(df).collect()}
    assert cm == {"CONFUSION_MATRIX/TP": 1.0, "CONFUSION_MATRIX/FP": 1.0, "CONFUSION_MATRIX/TN": 1.0,
                  "CONFUSION_MATRIX/FN": 1.0}
    st = {r.metric: (r.mean, r.sum) for r in M.status_metrics(df).collect()}
    assert st["JUDGE/OK"] == (0.5, 2.0) and st["FORMAL/REWARD"] == (0.5, 2.0) and st["FORMAL/ERROR"] == (0.0, 0.0)
    ln = {r.status: (r.agent_len, r.judge_len) for r in M.length_metrics(df).collect()}
    assert ln["OK"] == (15.0, 1.0) and ln["FORMAL_OK"] == (25.0, None)


def test_chunk_plan_and_splits(spark):
    df = spark.createDataFrame([("q", 13), ("r", 0)], "question string, num_variants int")
    plan = [(r.chunk, r["count"]) for r in PR.chunk_plan(df).where("question='q'").orderBy("chunk").collect()]
    assert plan == [(0, 10), (1, 10), (2, 6)]
    assert PR.chunk_plan(df).where("question='r'").count() == 0


def test_prompt_templates(spark):
    df = spark.createDataFrame([("t", 0, "x**2", "x", 0.0, 3.0, True, 1), ("t", 1, "sin(x)", "x", -math.inf, math.inf, False, 1)],
                               "tree_id string, question_index int, integrand string, var string, lb double, ub double, "
                               "is_definite boolean, level int")
    recs = {r.extra_info.question_index: r for r in PR.to_prompts(df).collect()}
    assert "integrate(x**2, (x, 0.0, 3.0))" in recs[0].prompt[1].content
    assert "integrate(sin(x), x)" in recs[1].prompt[1].content
    assert recs[0].reward_model.ground_truth == "x**2"
    j = df.select(PR.judge_prompt(F.lit("x**3/3"), "integrand", "var", "lb", "ub").alias("p")).collect()
    assert "integrate(x**2, x, 0.0, 3.0)" in j[0].p and "functionally equal to sin(x)" in j[1].p


def test_filter_difficulty_is_null_safe(spark):
    df = spark.createDataFrame([("harder", None), ("harder", "harder"), ("easier", None), (None, "easier")],
                               "evaluation string, difficulty string")
    kept = sorted((r.evaluation or "", r.difficulty or "") for r in PR.filter_difficulty(df).collect())
    assert kept == [("", "easier"), ("easier", ""), ("harder", "harder")]


def test_generation_prompts_sample_deterministically(spark):
    from variantlake import constants as K

    req = spark.createDataFrame([(i, "integrate(x, x)", d, 10) for i, d in enumerate(["easier", "harder", "equivalent",
                                                                                     "weird"] * 5)],
                                "request_id int, question string, difficulty string, count int")
    a = {r.request_id: r for r in PR.to_generation_prompts(req).collect()}
    b = {r.request_id: tuple(r.transformations_used) for r in PR.to_generation_prompts(req).collect()}
    for rid, r in a.items():
        chosen = list(r.transformations_used)
        pool = K.TRANSFORMATIONS_BY_DIFFICULTY.get(r.difficulty, [K.DEFAULT_TRANSFORMATION])
        assert len(chosen) == min(len(pool), len(chosen)) and len(chosen) in (1, 3, 5)
        assert all(c in pool for c in chosen)
        assert " and ".join(chosen) in r.generation_prompt
        assert b[rid] == tuple(chosen)  # reruns pick the same ideas


def test_a_question_is_one_formatted_record(spark):
    from variantlake.operators.flatten import formatted_questions

    v = spark.createDataFrame([("q", i, f"v{i}", "r", "easier") for i in range(10_001)],
                              "question string, pos int, variant string, reasoning string, difficulty string")
    recs = formatted_questions(v, order=("pos",)).collect()
    assert [[x.variant for x in r.variants] for r in recs] == [[f"v{i}" for i in range(10_001)]]


def test_groups_of_null_are_numbered_too(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 0), ("a", 1)], "g string, v int")
    assert sorted((str(r.g), r.v, r.idx) for r in group_index(df, ["g"], ["v"], out="idx").collect()) == [
        ("None", 0, 0), ("None", 1, 1), ("a", 1, 0), ("a", 2, 1)]


def test_pass_at_k_says_why_there_is_no_estimate(spark):
    out = M.pass_at_k(spark.createDataFrame([("q", True), ("q", False)], "q string, correct boolean"), ["q"], ks=[1, 5]).collect()
    assert {r.k: (r.pass_at_k, r.reason) for r in out} == {1: (0.5, None), 5: (None, "fewer_samples")}


def test_variables_are_part_of_the_dedup_key(spark):
    from variantlake.operators.dedup import add_fingerprint, dedup_semantic

    rows = [("t", 0, "x**2", "x"), ("t", 1, "t**2", "t"), ("t", 2, "t*t", "t")]
    df = add_fingerprint(spark.createDataFrame(rows, "tree_id string, order_key int, integrand string, var string"))
    assert sorted(r.order_key for r in dedup_semantic(df).collect()) == [0, 1]


def test_dedup_on_problem_keeps_different_bounds(spark):
    from variantlake.operators.dedup import add_fingerprint, dedup_semantic

    rows = [("t", 0, "x*2", "x", 0.0, 1.0), ("t", 1, "2*x", "x", 0.0, 1.0), ("t", 2, "2*x", "x", 0.0, 2.0)]
    df = add_fingerprint(spark.createDataFrame(rows, "tree_id string, order_key int, integrand string, var string, "
                                                     "lb double, ub double"))
    assert sorted(r.order_key for r in dedup_semantic(df).collect()) == [0]  # D1 ignores bounds
    assert sorted(r.order_key for r in dedup_semantic(df, on="problem").collect()) == [0, 2]  # D2 does not


def test_evaluate_points_seeded_and_real(spark):
    from variantlake.operators.verify import evaluate_points

    df = spark.createDataFrame([("sqrt(x)",), ("x**2",)], "solution string")
    a = sorted(tuple(r) for r in evaluate_points(df, n=3).collect())
    b = sorted(tuple(r) for r in evaluate_points(df, n=3).collect())
    assert a == b and len(a) == 6
    assert all(r[2] > 0 for r in a if r[0] == "sqrt(x)")  # only points where the value is real


def test_make_splits_rejects_unverifiable_base(spark):
    train = spark.createDataFrame([("t1", 0, "x", "x", float("-inf"), float("inf"), False, 1)],
                                  "tree_id string, question_index int, integrand string, var string, lb double, "
                                  "ub double, is_definite boolean, level int")
    base = spark.createDataFrame([("t1", "x**2", "x", float("-inf"), float("inf"), False, True),
                                  ("t2", None, None, None, None, None, None)],
                                 "tree_id string, integrand string, var string, lb double, ub double, "
                                 "is_definite boolean, valid boolean")
    out = PR.make_splits(train, base, num_eval=4)
    assert out.where("split = 'eval' AND tree_id = 't1'").count() == 4
    bad = out.where("tree_id = 't2'").collect()
    assert len(bad) == 1 and bad[0].reject_reason == "base_not_verifiable" and bad[0].question_index is None


def test_legacy_report_shape(spark):
    rows = [(q, f"integrate(x**{q}, x)", m, i, f"resp{i}", (m == "rl_model" and i == 3) or (q == 1 and i == 0))
            for q in (1, 2) for m in ("base_model", "rl_model") for i in range(10)]
    samples = spark.createDataFrame(rows, "question_id int, question string, model string, sample_idx int, "
                                          "response string, correct boolean")
    questions, summary, total = M.legacy_report(samples)
    q2 = questions.where("question_id = 2").first()
    assert q2.base_model["pass@10"] is False and q2.rl_model["pass@1"] is False and q2.rl_model["pass@5"] is True
    assert q2.rl_model.responses[:2] == ["resp0", "resp1"] and len(q2.rl_model.responses) == 10
    s = {r.model: r for r in summary.collect()}
    assert s["rl_model"]["pass@5"].num_correct == 2 and s["base_model"]["pass@1"].accuracy == 0.5
    assert total.first().num_total == 2


def test_pass_first_k_as_written_buckets(spark):
    # one correct sample at index 3: cumulative intent passes k=5 and 10; as written only k=5
    df = spark.createDataFrame([("q", i, i == 3) for i in range(10)], "q string, sample_idx int, correct boolean")
    cumulative = {r.k: r.passed for r in M.pass_first_k(df, ["q"], [], sample_idx="sample_idx").collect()}
    written = {r.k: r.passed for r in M.pass_first_k_as_written(df, ["q"]).collect()}
    assert cumulative == {1: False, 5: True, 10: True}
    assert written == {1: False, 5: True, 10: False}


def test_drop_empty_questions(spark):
    q = spark.createDataFrame([("a",), ("b",)], "question string")
    v = spark.createDataFrame([("a", "v1"), ("a", "v2")], "question string, variant string")
    assert [r.question for r in PR.drop_empty_questions(q, v).collect()] == ["a"]
