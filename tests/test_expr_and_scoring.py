"""V0 evaluator and the numeric scorers (pure Python helpers + Spark jobs)."""
import math

import numpy as np
from pyspark.sql import functions as F
import pytest

from variantlake.functions import expr as E
from variantlake.operators import verify as V

INF = math.inf


@pytest.mark.parametrize("text", ["__import__('os')", "x.real", "lambda: 1", "[1, 2]", "x if x else 1", "f(x)(y)",
                                  "sin(x, k=1)"])
def test_rejects_unsafe_or_unknown_syntax(text):
    with pytest.raises(E.ExprError):
        E.compile_expr(text)


def test_unknown_functions_parse_but_never_evaluate():
    comp = E.compile_expr("foo(x) + 1")  # a call of an unknown name: parsed, never run
    assert comp.free == {"foo()", "x"}
    with pytest.raises(E.ExprError):
        comp("x", [1.0])
    assert V.score_one("foo(x)", "2*x", "x", -INF, INF)[1] == "NO_OK"
    assert V.score_one("foo(1)", "x**2", "x", 0.0, 3.0)[1] == "ERROR_EVAL_EXPR"


def test_power_tower_overflows_instead_of_hanging():
    assert np.isinf(E.compile_expr("9**9**9")(None, [0.0])[0])


@pytest.mark.parametrize("text", ["x y", "2x", "(x", "x)", "f(", "()", "sin()", "sin(x, x)", "x,", "(1, 2)", "x..2", "007", "True", "x**", "a.b",
                                  "sin", "x == 1", "*x", "x +\n1", "'a'", "x!", "sin(x,,)", ""])
def test_rejects_broken_syntax(text):
    assert E.try_compile(text) is None


@pytest.mark.parametrize("text", ["-x**2", "2**-x**2", "-2**2", "2*-3", "(x - 1)**3", "x**-2", "1e3 + .5 + 5.", "2**3**2", "-(-x)", "x - 1 - 2", "x/2/3",
                                  "(x +\n1)", "+x", "3 # note"])
def test_precedence_is_pythons(text):
    assert abs(E.compile_expr(text)("x", [0.7])[0] - eval(text.split("#")[0], {"x": 0.7})) < 1e-12  # noqa: S307  (fixed texts)


def test_no_size_limits_and_no_crashes():
    assert E.compile_expr("+".join(["x"] * 5000))("x", [2.0])[0] == 10000
    assert E.compile_expr("(" * 3000 + "x" + ")" * 3000)("x", [2.0])[0] == 2
    assert np.isinf(E.compile_expr("1" * 400)(None, [0.0])[0]) and np.isinf(E.compile_expr("-" + "1" * 400)(None, [0.0])[0])
    assert E.compile_expr("x**" + "9" * 400)("x", [0.5])[0] == 0
    assert abs(E.compile_expr("x**65")("x", [-1.5])[0] + 1.5**65) < 1e-4 * 1.5**65
    assert V.score_one("1" * 400, "2*x", "x", -INF, INF)[1] == "NO_OK"
    assert V.score_one("", "2*x", "x", -INF, INF)[1] == V.score_one("", "2*x", "x", 0.0, 1.0)[1] == "NO_SYMPY_EXPR"


@pytest.mark.parametrize("text,want", [
    ("erf(1)", 0.8427007929497149), ("erfc(-2)", 1.995322265018953), ("erfi(1)", 1.6504257587975429), ("gamma(5)", 24), ("gamma(-1/2)", -3.5449077018110318),
    ("factorial(4)", 24), ("Ei(1)", 1.8951178163559368), ("Ei(-1)", -0.21938393439552029), ("li(2)", 1.0451637801174928), ("Si(1)", 0.946083070367183),
    ("Si(20)", 1.5482417010434397), ("Ci(1)", 0.3374039229009681), ("Ci(20)", 0.04441982084535331), ("fresnels(1)", 0.4382591473903548),
    ("fresnelc(9)", 0.5353661274681198), ("Rational(1, 2)", 0.5), ("atan2(1, -1)", 2.356194490192345), ("asec(2)", 1.0471975511965979),
    ("acsch(1)", 0.881373587019543), ("Max(1, 3, 2)", 3), ("Min(1, 3)", 1)])
def test_special_functions(text, want):
    assert abs(E.compile_expr(text)(None, [0.0])[0] - want) < 1e-9 * max(1, abs(want))


def test_special_antiderivatives_verify():
    for truth, answer in (("exp(-x**2)", "sqrt(pi)*erf(x)/2"), ("exp(x)/x", "Ei(x) + 0*log(x)"), ("sin(x)/x", "Si(x)"), ("1/log(x)", "li(x)"),
                          ("sin(pi*x**2/2)", "fresnels(x)"), ("exp(x**2)", "sqrt(pi)*erfi(x)/2")):
        assert V.score_one(answer, truth, "x", -INF, INF)[1] == "OK", truth


def test_quadrature_finds_poles_and_resolves_the_rest():
    integral = lambda t, a=-10.0, b=10.0: E.integrate(E.compile_expr(t), "x", [a], [b])[0]
    for pole in ("1/(x - 3)", "1/(x - 0.3)", "1/x", "1/(x - 0.3)**2", "tan(x)"):
        assert np.isnan(integral(pole)), pole
    assert abs(integral("Abs(x - 0.3)") - (10.3**2 + 9.7**2) / 2) < 1e-8
    assert abs(integral("sin(x)", 0.0, 1e6) - (1 - math.cos(1e6))) < 1e-6
    assert abs(integral("x**3", 3.0, 0.0) + 81 / 4) < 1e-9
    both = E.integrate(E.compile_expr("1/x"), "x", [1.0, -1.0], [2.0, 1.0])  # a bad row leaves others alone
    assert abs(both[0] - math.log(2)) < 1e-10 and np.isnan(both[1])


def test_quadrature_smooth_singular_and_oscillating():
    assert abs(E.integrate(E.compile_expr("x**2"), "x", [0.0], [3.0])[0] - 9) < 1e-10
    assert abs(E.integrate(E.compile_expr("1/sqrt(x)"), "x", [0.0], [1.0])[0] - 2) < 1e-6
    val = E.integrate(E.compile_expr("cos(50*x)"), "x", [-9.0], [8.0])[0]
    assert abs(val - (math.sin(400) - math.sin(-450)) / 50) < 1e-9
    assert np.isnan(E.integrate(E.compile_expr("1/x"), "x", [-10.0], [10.0])[0])  # hits 0


EQUAL = [("2*x + 3", "3 + x*2"), ("sin(x)**2 + cos(x)**2", "1"), ("(x+1)**2", "x**2 + 2*x + 1"), ("sin(x)**2 + cos(x)**2 - 1", "0"), ("0.1*x + 0.2*x", "0.3*x"),
         ("(x-1)**10", "x**10-10*x**9+45*x**8-120*x**7+210*x**6-252*x**5+210*x**4-120*x**3+45*x**2-10*x+1"), ("y*x", "y*x"), ("exp(2*x)", "exp(x)**2"),
         ("1/(x*(x+1))", "1/x - 1/(x+1)"), ("tan(x)", "sin(x)/cos(x)"), ("10**9*x", "x*1000000000"), ("(x**2-1)/(x-1)", "x+1"), ("log(x)/log(x)", "x/x")]
DIFFERENT = [("x", "x + 1e-3"), ("x", "x + 10**(-9)"), ("x", "x + 10**(-8)"), ("Abs(x)", "sqrt(x**2)"), ("Abs(x)", "x"), ("log(x**2)", "2*log(x)"), ("x/3", "0.333333*x"),
             ("y*x", "x*y"), ("x**2", "x**2 + 1e-7*sin(x)"), ("exp(x)", "2.718281828**x"), ("1/x", "1/x + 1e-9")]


def test_equal_expressions_go_and_different_ones_stay(spark):
    from variantlake.operators.dedup import add_fingerprint, dedup_semantic

    rows = [(f"{kind}{i}", k, text, "x") for kind, pairs in (("e", EQUAL), ("d", DIFFERENT)) for i, pair in enumerate(pairs) for k, text in enumerate(pair)]
    got = dedup_semantic(add_fingerprint(spark.createDataFrame(rows, "tree_id string, order_key int, integrand string, var string")))
    kept = {t: sorted(r.order_key for r in got.collect() if r.tree_id == t) for t in {r[0] for r in rows}}
    assert kept == {t: [0] if t[0] == "e" else [0, 1] for t in kept}


def test_values_at_the_edge_of_a_cell_meet(spark):
    """Expressions whose places straddle cells of either grid, by the thousand, against the rule itself."""
    from variantlake.operators.dedup import add_fingerprint, dedup_semantic

    rows = [(str(i // 4), i % 4, t, "x") for k in range(300) for i, t in enumerate(
        (f"(x + {k})*(x + 1)", f"x**2 + {k + 1}*x + {k}", f"x*(x + {k + 1}) + {k}", f"x**2 + {k + 1}*x + {k} + 1e-7"), 4 * k)]
    got = dedup_semantic(add_fingerprint(spark.createDataFrame(rows, "tree_id string, order_key int, integrand string, var string"))).collect()
    assert sorted((int(r.tree_id), r.order_key) for r in got) == [(k, o) for k in range(300) for o in (0, 3)]
    base = spark.createDataFrame([("0", "x*x + 1*x", "x"), ("5", "y", "x")], "tree_id string, integrand string, var string")
    less = dedup_semantic(add_fingerprint(spark.createDataFrame(rows[:24], "tree_id string, order_key int, integrand string, var string")), base=add_fingerprint(base))
    assert sorted((r.tree_id, r.order_key) for r in less.collect()) == [("0", 3)] + [(str(k), o) for k in range(1, 6) for o in (0, 3)]


# Golden pairs (truth, var, lb, ub, answer, expected status), FIXTURES.md
GOLDEN = [
    ("2*x", "x", -INF, INF, "x**2 + C", "OK"),
    ("2*x", "x", -INF, INF, "x**3", "NO_OK"),
    ("1/x", "x", -INF, INF, "log(x)", "OK"),
    ("2*x", "x", -INF, INF, "x**2 + 0.05*x", "OK"),
    ("x**2", "x", 0.0, 3.0, "9", "OK"),
    ("x**2", "x", 0.0, 3.0, "8", "NO_OK"),
    ("x**2", "x", 0.0, 3.0, "x", "ERROR_EVAL_EXPR"),
    ("2*x", "x", -INF, INF, "x**", "NO_SYMPY_EXPR"),
    ("2*x", "x", -INF, INF, None, "NO_INP_IN_TAGS"),
    ("cosh(2*x)", "x", -INF, INF, "sinh(2*x)/2", "OK"),
    ("2*t", "t", -INF, INF, "t**2", "NO_OK"),  # compat binds the answer's variable to x
]


@pytest.mark.parametrize("truth,var,lb,ub,answer,expected", GOLDEN)
def test_compat_golden_pairs(truth, var, lb, ub, answer, expected):
    cleaned = None if answer is None else answer.replace(" + C", "")
    assert V.score_one(cleaned, truth, var, lb, ub, "compat")[1] == expected


def test_strict_policy_rejects_drift_and_binds_declared_variable():
    assert V.score_one("x**2 + 0.05*x", "2*x", "x", -INF, INF, "strict")[1] == "NO_OK"
    assert V.score_one("t**2", "2*t", "t", -INF, INF, "strict")[1] == "OK"


def test_scoring_is_reproducible():
    a = [V.score_one("x**3/3", "x**2", "x", -INF, INF)[2] for _ in range(3)]
    assert len(set(a)) == 1


def test_legacy_relative_and_absolute():
    assert V.score_relative_one("x**2", "2*x", None, None, False, "k")[1] == "OK"
    assert V.score_relative_one("x**3", "2*x", None, None, False, "k")[1] == "NO_OK"
    assert V.score_relative_one("x**", "2*x", None, None, False, "k") == (0.0, "ERROR")
    assert V.score_relative_one("pi/2", "sin(x)**2", "0", "pi", False, "k")[1] == "OK"
    assert V.score_relative_one("x", "sin(x)**2", "0", "pi", False, "k")[1] == "NO_OK"
    assert V.score_absolute_one("x**2", "2*x", "k") is True
    assert V.score_absolute_one("x**2 + x", "2*x", "k") is False


def test_score_answers_job_matches_row_function(spark):
    rows = [(i, t, v, lb, ub, a) for i, (t, v, lb, ub, a, _) in enumerate(GOLDEN)] * 3
    df = spark.createDataFrame(rows, "id int, ground_truth string, var string, lb double, ub double, answer string")
    out = {r.id: r.formal_status for r in V.score_answers(df).collect()}
    assert len(out) == len(GOLDEN)
    for i, g in enumerate(GOLDEN):
        assert out[i] == g[5], g


def test_score_rollouts_and_reward(spark):
    rows = [("r1", "<answer>x**2 + C</answer>", "<JUDGE_SCORE>1</JUDGE_SCORE>", "2*x", 5),
            ("r2", "no tag", "<JUDGE_SCORE>1</JUDGE_SCORE>", "2*x", 7),
            ("r3", "</instruction><answer>x**3</answer>", "<JUDGE_SCORE>0</JUDGE_SCORE>", "2*x", 3)]
    df = spark.createDataFrame(rows, "rollout_id string, response string, judge_response string, ground_truth string, "
                                     "response_tokens int").selectExpr(
        "*", "'x' AS var", "CAST('-inf' AS DOUBLE) AS lb", "CAST('inf' AS DOUBLE) AS ub")
    out = {r.rollout_id: r for r in V.assign_reward(V.score_rollouts(df)).collect()}
    assert (out["r1"].formal_status, out["r1"].judge_status, out["r1"].reward, out["r1"].reward_pos) == ("OK", "OK", 1.0, 4)
    assert (out["r2"].formal_status, out["r2"].judge_status, out["r2"].reward) == ("NO_INP_IN_TAGS", "NO_INP_IN_TAGS", 0.0)
    assert (out["r3"].formal_status, out["r3"].judge_status) == ("NO_OK", "NO_OK")


def test_validate_and_points(spark):
    df = spark.createDataFrame([("x**2", "x", 0.0, 3.0), ("x**", "x", -INF, INF), ("1/x", "x", -INF, INF),
                                ("log(x)", "x", -INF, INF)], "integrand string, var string, lb double, ub double")
    got = {r.integrand: (r.valid, r.invalid_reason) for r in V.validate(df).collect()}
    assert got == {"x**2": (True, None), "x**": (False, "syntax"), "1/x": (False, "numeric"), "log(x)": (True, None)}
    pts = V.evaluate_points(spark.createDataFrame([("log(x)",)], "solution string"), n=2, points=[-1.0, 2.0, 3.0, 4.0])
    assert [(r.x, round(r.value, 6)) for r in pts.orderBy("point_idx").collect()] == [(2.0, round(math.log(2), 6)),
                                                                                   (3.0, round(math.log(3), 6))]


# FIXED VALUES: question / solution pairs shipped with the original workflow's test questions.
SOLVED = [
    ("integrate(cosh(2*x), x)", "sinh(2*x)/2"),
    ("integrate(12*sinh(x)**2, x)", "6*x*sinh(x)**2 - 6*x*cosh(x)**2 + 6*sinh(x)*cosh(x)"),
    ("integrate(1/(x**2+4*x+5), x)", "atan(x + 2)"),
    ("integrate((x+2)/(x**2+2*x+2)+x^3, x)", "x**4/4 + log(x**2 + 2*x + 2)/2 + atan(x + 1)"),
    ("integrate(exp(x)*sinh(x), x)", "x*exp(x)*sinh(x)/2 - x*exp(x)*cosh(x)/2 + exp(x)*cosh(x)/2"),
    ("integrate((x-1)/(x**2+3), x)", "log(x**2 + 3)/2 - sqrt(3)*atan(sqrt(3)*x/3)/3"),
    ("integrate(exp(-2*x)*sin(x), x)", "-2*exp(-2*x)*sin(x)/5 - exp(-2*x)*cos(x)/5"),
    ("integrate(x/sqrt(1+x**2), x)", "sqrt(x**2 + 1)"),
    ("integrate((x-1)/sqrt(x**2+1), x)", "sqrt(x**2 + 1) - asinh(x)"),
    ("integrate(exp(x)*sqrt(1+exp(2*x)), x)", "sqrt(exp(2*x) + 1)*exp(x)/2 + asinh(exp(x))/2"),
]


def test_supplied_solutions_verify_and_wrong_ones_do_not(spark):
    rows = []
    for i, (q, s) in enumerate(SOLVED):
        rows += [(i, "right", q, s), (i, "double", q, f"2*({s})"), (i, "shifted", q, f"{s} + x")]
    df = spark.createDataFrame(rows, "i int, kind string, question string, ground_truth_solution string")
    got = {(r.i, r.kind): r.check_status for r in V.verify_solutions(df).collect()}
    for i in range(len(SOLVED)):
        assert got[(i, "right")] == "OK", SOLVED[i]
        assert got[(i, "double")] == "NO_OK", SOLVED[i]
        assert got[(i, "shifted")] == "NO_OK", SOLVED[i]


def test_definite_non_finite_answer_is_not_close():
    assert V.score_one("oo", "x**2", "x", 0.0, 3.0)[1] == "NO_OK"
    assert V.score_one("9**9**9", "x**2", "x", 0.0, 3.0)[1] == "NO_OK"


def test_row_wise_scoring_matches_distinct_key_scoring(spark):
    from variantlake.streaming.score_stream import score_rows

    rows = [(i, t, v, lb, ub, None if a is None else f"<answer>{a}</answer>") for i, (t, v, lb, ub, a, _) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "id int, ground_truth string, var string, lb double, ub double, response string")
    row_wise = {r.id: r.formal_status for r in score_rows(df).collect()}
    batch = {r.id: r.formal_status for r in V.score_rollouts(df.withColumn("judge_response", F.lit(None))).collect()}
    assert row_wise == batch


def test_precise_dialect_changes_the_verdict(spark):
    df = spark.createDataFrame([("e**x+x", "exp(x) + 1")], "answer string, ground_truth string").selectExpr(
        "*", "'x' AS var", "CAST('-inf' AS DOUBLE) AS lb", "CAST('inf' AS DOUBLE) AS ub")
    assert V.score_answers(df).first().formal_status == "NO_OK"  # as written: exp(x+x)
    assert V.score_answers(df, dialect="precise").first().formal_status == "OK"
