"""Validation and scoring as Spark jobs.

Every numeric check is one narrow pass: native expressions extract and clean, one Arrow
UDF gets the few key columns and returns the verdict next to the row.  Nothing is shuffled
or joined back, and wide columns never reach Python.  Identical keys - common when a
prompt is sampled 10-50 times - are answered from a bounded memo of the task, and a
truth's integrals are computed once per worker.

Probe points are drawn from a generator seeded by the ground truth, so reruns and
retried tasks agree.  An answer that cannot be evaluated fails its own row only.
"""
from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from variantlake import constants as K
from variantlake.functions import expr as E
from variantlake.functions import text as TX
from variantlake.functions.latex import answers_equal
from variantlake.functions.parse import parse_problems
from variantlake.session import ship_package

# ---------------------------------------------------------------------------
# per-task caches (bounded)
# ---------------------------------------------------------------------------


class _LRU(OrderedDict):
    def __init__(self, cap=8192):
        super().__init__()
        self.cap = cap

    def get_or(self, key, make):
        if key in self:
            self.move_to_end(key)
            return self[key]
        val = make()
        self[key] = val
        if len(self) > self.cap:
            self.popitem(last=False)
        return val


_TRUTH_CACHE = _LRU()


def _probe_intervals(truth: str, var: str, lo: float, hi: float, n: int, width: float = K.PROBE_WIDTH):
    u = E.seeded_uniform(f"{truth}\x1f{var}", n)
    a = lo + (hi - lo) * u
    return a, a + width


def _truth_integrals(tr, truth, var, lo, hi, n):
    def make():
        a, b = _probe_intervals(truth, var, lo, hi, n)
        return a, b, E.integrate(tr, var, a, b)
    return _TRUTH_CACHE.get_or(("probe", truth, var, lo, hi, n), make)


def _truth_definite(tr, truth, var, lb, ub):
    return _TRUTH_CACHE.get_or(("def", truth, var, lb, ub),
                               lambda: E.integrate(tr, var, np.array([lb]), np.array([ub]))[0])


# ---------------------------------------------------------------------------
# row scorers (pure Python/NumPy; unit-testable without Spark)
# ---------------------------------------------------------------------------

POLICIES = {
    # the current verifier: candidate in x, positive domain iff a log appears,
    # atol 1e-2 / rtol 1e-3 on 0.1-wide intervals, one successful probe suffices
    "compat": dict(cand_var="x", sqrt_domain=False, atol=K.COMPAT_TOL, rtol=K.COMPAT_RTOL, min_ok=1),
    # stricter: declared variable, sqrt also restricts the domain, tight tolerances
    # and at least half of the probes must evaluate
    "strict": dict(cand_var=None, sqrt_domain=True, atol=1e-6, rtol=1e-6, min_ok=K.COMPAT_NUM_TESTS // 2),
}


def score_one(answer, truth, var, lb, ub, policy="compat", num_tests=K.COMPAT_NUM_TESTS):
    """V6/V7 for one key -> (formal_result, formal_status, successes).

    ``answer`` is the cleaned answer: None means no input, an answer that cleaning left
    empty does not parse.
    """
    if answer is None:
        return 0.0, "NO_INP_IN_TAGS", 0
    pol = POLICIES[policy]
    cand = E.try_compile(answer)
    if cand is None:
        return 0.0, "NO_SYMPY_EXPR", 0
    tr = E.try_compile(truth)
    if tr is None or var is None or lb is None or ub is None or (tr.free - {var}):
        return 0.0, "ERROR", 0  # the ground truth itself is broken
    try:
        if math.isfinite(lb) and math.isfinite(ub):
            return _score_definite(cand, tr, truth, var, lb, ub, pol)
        return _score_indefinite(cand, tr, truth, var, pol, num_tests)
    except E.ExprError:
        return 0.0, "ERROR", 0


def _score_definite(cand, tr, truth, var, lb, ub, pol):
    gt = _truth_definite(tr, truth, var, lb, ub)
    if not np.isfinite(gt):
        return 0.0, "ERROR", 0
    try:
        val = cand(None, np.zeros(1))[0]  # free symbols (e.g. x) -> not a number
    except E.ExprError:
        return 0.0, "ERROR_EVAL_EXPR", 0
    # an infinite or NaN value is still a number: it simply is not close
    ok = bool(np.isfinite(val)) and bool(E.isclose(val, gt, pol["atol"], pol["rtol"]))
    return (1.0, "OK", 1) if ok else (0.0, "NO_OK", 1)


def _score_indefinite(cand, tr, truth, var, pol, num_tests):
    positive = cand.has_log() or tr.has_log()
    if pol["sqrt_domain"]:
        positive = positive or "sqrt" in cand.calls or "sqrt" in tr.calls
    lo, hi = K.POSITIVE_DOMAIN if positive else K.FULL_DOMAIN
    a, b, gt = _truth_integrals(tr, truth, var, lo, hi, num_tests)
    usable, diff = _probed(cand, pol["cand_var"] or var, a, b, gt)
    mismatch = usable & ~E.isclose(diff, gt, pol["atol"], pol["rtol"])
    n_ok = int(usable.sum())
    if mismatch.any() or n_ok < pol["min_ok"]:
        return 0.0, "NO_OK", n_ok
    return 1.0, "OK", n_ok


def _probed(cand, var, a, b, gt):
    """(usable, differences): the candidate's change over each probe interval."""
    try:
        vals = cand(var, np.concatenate([a, b]))
        diff = vals[len(a):] - vals[: len(a)]
    except E.ExprError:
        diff = np.full(len(a), np.nan + 0j)
    return np.isfinite(diff) & np.isfinite(gt), diff


def _is_real(z) -> bool:
    return bool(np.isfinite(z)) and abs(z.imag) <= 1e-9 * max(1.0, abs(z.real))


def _relative_close(c, g, tol) -> bool:
    if not (_is_real(c) and _is_real(g)) or g.real == 0:
        return False
    return abs((c.real - g.real) / g.real) <= tol


def _number(text):
    """Value of a closed expression."""
    return E.compile_expr(text)(None, np.zeros(1))[0]


def score_relative_one(candidate, integrand, lb_text, ub_text, positive, seed_key, tol=K.COMPAT_TOL,
                       num_tests=K.RELATIVE_NUM_TESTS, format_score=K.RELATIVE_FORMAT_SCORE):
    """V8 (legacy): relative tolerance, real values only; whatever fails -> ERROR.

    All inputs come parsed: the cleaned candidate, the truth's integrand, its bounds as
    texts (None when indefinite) and whether probes stay positive.
    """
    if candidate is None or integrand is None:
        return 0.0, "NO_INP_IN_TAGS"
    miss, hit = (format_score, "NO_OK"), (1.0 + format_score, "OK")
    try:
        cand, tr = E.compile_expr(candidate), E.compile_expr(integrand)
        if lb_text is not None:
            lo, hi = _number(lb_text), _number(ub_text)
            if not (_is_real(lo) and _is_real(hi)):
                return 0.0, "ERROR"
            gt = E.integrate(tr, "x", lo.real, hi.real)[0]
            return hit if not cand.free and _relative_close(_number(candidate), gt, tol) else miss
        a, b = _probe_intervals(seed_key, "", *(K.POSITIVE_DOMAIN if positive else K.FULL_DOMAIN), num_tests)
        gt = E.integrate(tr, "x", a, b)
        usable, diff = _probed(cand, "x", a, b, gt)  # probes that fail are skipped
        close = [_relative_close(d, g, tol) for d, g in zip(diff[usable], gt[usable])]
        return hit if close and all(close) else miss
    except E.ExprError:
        return 0.0, "ERROR"


def score_absolute_one(candidate, integrand, seed_key, tol=K.COMPAT_TOL, num_tests=K.ABSOLUTE_NUM_TESTS):
    """V9 (legacy): independent interval ends in [-10, 10], absolute tolerance -> bool."""
    cand, tr = E.try_compile(candidate), E.try_compile(integrand)
    if cand is None or tr is None:
        return False
    lo, hi = K.FULL_DOMAIN
    a, b = (lo + (hi - lo) * E.seeded_uniform(seed_key, 2 * num_tests)).reshape(2, num_tests)
    wide = np.abs(b - a) >= K.ABSOLUTE_MIN_GAP
    try:
        gt = E.integrate(tr, "x", a[wide], b[wide])
    except E.ExprError:
        return False
    usable, diff = _probed(cand, "x", a[wide], b[wide], gt)
    return bool(usable.any() and (np.abs(diff - gt)[usable] <= tol).all())


def validate_one(integrand, var, lb, ub):
    """V1-V5 for one variant -> (valid, reason)."""
    if integrand is None or var is None or lb is None or ub is None:
        return False, "unparsed"
    tr = E.try_compile(integrand)
    if tr is None:
        return False, "syntax"
    if math.isfinite(lb) and math.isfinite(ub):
        lo, hi = lb, ub
    else:
        lo, hi = K.POSITIVE_DOMAIN if tr.has_log() else K.FULL_DOMAIN
    try:
        val = E.integrate(tr, var, np.array([lo]), np.array([hi]))[0]
    except E.ExprError:
        return False, "numeric"
    return (True, None) if np.isfinite(val) else (False, "numeric")


# ---------------------------------------------------------------------------
# Spark jobs
# ---------------------------------------------------------------------------

def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _codes(column) -> tuple[np.ndarray, int]:
    """(the number of every value, how many numbers); missing values have one too."""
    if isinstance(column, pd.Series):
        codes, values = pd.factorize(column, use_na_sentinel=False)
        return codes, len(values)
    encoded = column.dictionary_encode("encode")
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(encoded.dictionary)


def _distinct_rows(columns) -> tuple[np.ndarray, np.ndarray]:
    """(the first row of each distinct one, the number of every row's distinct one) of a frame or of Arrow arrays."""
    columns = [columns[c] for c in columns] if isinstance(columns, pd.DataFrame) else columns
    of = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        codes, n = _codes(column)
        of, values = pd.factorize(of * n + codes)
    first = np.zeros(len(values), dtype=np.int64)
    first[of[::-1]] = np.arange(len(of))[::-1]
    return first, of


def _plain(values: pa.Array, zone: str) -> pd.Series:
    """Arrow values as Python objects, missing ones as None, times in the session's zone."""
    found = values.to_pandas()
    if isinstance(found.dtype, pd.DatetimeTZDtype):
        found = found.dt.tz_convert(zone).dt.tz_localize(None)
    return found.astype(object).where(found.notna(), None)


def _verdicts(df: DataFrame, fn, args: dict, out_fields: list) -> DataFrame:
    """``df`` with the struct column ``_verdict`` = ``fn(*args)``, row by row in Arrow batches.

    Only the columns ``args`` (name -> Column) travel to Python; missing values arrive as
    None, and equal arguments are computed once per batch and once per task (bounded memo):
    the rows of a batch are numbered by their arguments, column by column in Arrow, and only
    its distinct arguments become Python tuples; the verdicts are dealt to the rows in Arrow
    too.  The UDF is marked nondeterministic so that no filter or projection makes Spark run
    it twice.
    """
    ship_package(df.sparkSession)
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    fields = list(to_arrow_type(T.StructType(out_fields)))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = _LRU(65536)
        for batch in batches:
            columns = batch.flatten()
            first, of = _distinct_rows(columns)
            asked = [_plain(c.take(pa.array(first)), zone) for c in columns]
            rows = [memo.get_or(key, lambda key=key: fn(*key)) for key in zip(*asked)]
            found = [pa.array([r[i] for r in rows], f.type, from_pandas=True) for i, f in enumerate(fields)]
            yield pa.StructArray.from_arrays([c.take(pa.array(of)) for c in found], fields=fields)

    udf = F.arrow_udf(run, T.StructType(out_fields)).asNondeterministic()
    return df.withColumn("_verdict", udf(F.struct(*[c.alias(n) for n, c in args.items()])))


def _take(df: DataFrame, columns: dict, *drop: str) -> DataFrame:
    return df.withColumns(columns).drop("_verdict", *drop)


_FORMAL = [T.StructField("result", T.DoubleType()), T.StructField("status", T.StringType()),
           T.StructField("successes", T.IntegerType())]


def score_answers(df: DataFrame, answer="answer", truth="ground_truth", var="var", lb="lb", ub="ub",
                  policy: str = "compat", prefix: str = "formal_", dialect: str = "current") -> DataFrame:
    """V6/V7: add ``{prefix}result``, ``{prefix}status``, ``{prefix}successes``.

    ``answer`` is an extracted answer (see ``extract_answer``).  Definite when both bounds
    are finite.  An answer that is NULL or empty before cleaning is NO_INP_IN_TAGS; one
    that cleans to nothing fails to parse (NO_SYMPY_EXPR), as in the original.
    ``dialect="precise"`` cleans ``e^T`` as ``exp(T)`` instead of the original rules.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    raw = _c(answer)
    clean = F.when(raw.isNull() | (raw == ""), F.lit(None)).otherwise(TX.clean_expr(raw, dialect))
    out = _verdicts(df, lambda a, t, v, lo, hi: score_one(a, t, v, lo, hi, policy),
                    {"a": clean, "t": _c(truth), "v": _c(var), "lo": _c(lb).cast("double"), "hi": _c(ub).cast("double")}, _FORMAL)
    return _take(out, {f"{prefix}{f.name}": F.col(f"_verdict.{f.name}") for f in _FORMAL})


def score_relative(df: DataFrame, response="response", truth="ground_truth", prefix="formal_") -> DataFrame:
    """V8: legacy relative-tolerance scoring of a raw response against ``integrate(...)``."""
    staged = df.withColumns({"_raw": TX.extract_answer(_c(response)), "_truth": TX.clean_expr(_c(truth), "legacy"), "_seed": _c(truth)})
    staged = parse_problems(staged, "_truth", dialect="tuple", prefix="_t_").withColumn("_cand", TX.clean_expr(F.col("_raw"), "legacy"))
    positive = F.greatest(*[F.contains(c, F.lit(f)) for c in (F.col("_truth"), F.col("_cand")) for f in ("sqrt(", "log(")])
    out = _verdicts(staged, score_relative_one,
                    {"c": F.col("_cand"), "i": F.col("_t_integrand"), "lo": F.col("_t_lb_text"), "hi": F.col("_t_ub_text"), "p": positive, "s": F.col("_seed")},
                    [T.StructField("result", T.DoubleType()), T.StructField("status", T.StringType())])
    no_sol = _c(response).isNull() | (_c(response) == "") | F.col("_seed").isNull() | (F.col("_seed") == "")
    no_inp = F.col("_raw").isNull() | (F.col("_raw") == "")
    return _take(out, {
        f"{prefix}result": F.when(no_sol | no_inp, F.lit(0.0)).otherwise(F.col("_verdict.result")),
        f"{prefix}status": F.when(no_sol, F.lit("NO_SOL_OR_NO_GT")).when(no_inp, F.lit("NO_INP_IN_TAGS")).otherwise(F.col("_verdict.status")),
    }, *[c for c in staged.columns if c not in df.columns])


def score_absolute(df: DataFrame, response="response", truth="ground_truth", out="correct") -> DataFrame:
    """V9: legacy boxed-answer check with absolute tolerance -> boolean ``out``."""
    boxed = TX.extract_boxed(_c(response))
    staged = df.withColumns({"_box": boxed, "_truth": TX.clean_expr(_c(truth), "legacy_boxed"), "_seed": _c(truth)})
    staged = parse_problems(staged, "_truth", dialect="tuple", prefix="_t_")
    cand = F.when((F.col("_box") != "") & ~TX.contains_word(F.col("_box"), "integrate"), TX.clean_expr(F.col("_box"), "legacy_boxed"))
    res = _verdicts(staged, lambda c, i, s: (score_absolute_one(c, i, s),), {"c": cand, "i": F.col("_t_integrand"), "s": F.col("_seed")},
                    [T.StructField("ok", T.BooleanType())])
    return _take(res, {out: F.coalesce(F.col("_verdict.ok"), F.lit(False))}, *[c for c in staged.columns if c not in df.columns])


def score_exact(df: DataFrame, response="response", truth="ground_truth", out="score") -> DataFrame:
    """1.0 when the last boxed answer equals the truth after LaTeX normalisation."""
    boxed = TX.extract_boxed(_c(response))
    return df.withColumn(
        out, F.when(boxed.isNotNull() & answers_equal(boxed, _c(truth)), F.lit(1.0)).otherwise(F.lit(0.0))
    )


PROBE = [T.StructField("fingerprint", T.LongType()), T.StructField("place", T.DoubleType()), T.StructField("blur", T.DoubleType()), T.StructField("finite", T.IntegerType())]


def probe_one(integrand, var):
    """Summary of the integrand's probe values (nulls when it cannot be evaluated)."""
    comp = E.try_compile(integrand) if integrand is not None and var is not None else None
    return (comp is not None and E.probe_summary(comp, var)) or (None,) * len(PROBE)


def validate(df: DataFrame, integrand="integrand", var="var", lb="lb", ub="ub",
             out="valid", reason="invalid_reason", probes: bool = False) -> DataFrame:
    """V1-V5: the integrand parses and its integral over the bounds or domain is finite;
    with ``probes`` the columns of ``PROBE`` come from the same pass."""
    fields = [T.StructField("valid", T.BooleanType()), T.StructField("why", T.StringType()), *(PROBE if probes else [])]
    fn = (lambda i, v, lo, hi: (*validate_one(i, v, lo, hi), *probe_one(i, v))) if probes else validate_one
    res = _verdicts(df, fn, {"i": _c(integrand), "v": _c(var), "lo": _c(lb).cast("double"), "hi": _c(ub).cast("double")}, fields)
    columns = {out: F.col("_verdict.valid"), reason: F.col("_verdict.why")}
    return _take(res, columns | ({f.name: F.col(f"_verdict.{f.name}") for f in PROBE} if probes else {}))


def verify_solutions(df: DataFrame, question="question", solution="ground_truth_solution",
                     policy="compat", prefix="check_") -> DataFrame:
    """Numeric check that a supplied solution is an antiderivative of the question."""
    staged = parse_problems(df.withColumn("_q_text", _c(question)), "_q_text", prefix="_q_")
    out = score_answers(staged, answer=_c(solution), truth="_q_integrand", var="_q_var",
                        lb=F.coalesce("_q_lb", F.lit(-math.inf)), ub=F.coalesce("_q_ub", F.lit(math.inf)),
                        policy=policy, prefix=prefix)
    return out.drop(*[c for c in out.columns if c.startswith("_q_")])


def points_one(text, var, candidates, n, tol):
    """Up to ``n`` (x, value) of the candidates, x rounded to 3 places, where the value is real."""
    comp = E.try_compile(text)
    if comp is None:
        return []
    try:
        vals = comp(var, candidates)
    except E.ExprError:
        return []
    found: dict = {}
    for x, v in zip(np.round(candidates, 3).tolist(), vals):
        if len(found) < n and np.isfinite(v) and abs(v.imag) < tol:
            found.setdefault(x, float(v.real))
    return list(found.items())


def evaluate_points(df: DataFrame, solution="solution", var="x", n: int = 3, points=None,
                    lower: float = -10.0, upper: float = 10.0, tol: float = 1e-6,
                    keep: tuple = ()) -> DataFrame:
    """Up to ``n`` points where the solution is real, as rows ``(x, value)``.

    With ``points`` the candidates are those fixed values (in order); otherwise up to
    ``10 n`` seeded draws in ``[lower, upper]``.  Keys are rounded to 3 places.
    """
    fixed = None if points is None else np.asarray(points, dtype=np.float64)

    def found(text):
        draws = fixed if fixed is not None else lower + (upper - lower) * E.seeded_uniform(text or "", 10 * n)
        pairs = points_one(text, var, draws, n, tol)
        return [p[0] for p in pairs], [p[1] for p in pairs]

    src = df.select(*keep, _c(solution).alias("solution"))
    numbers = T.ArrayType(T.DoubleType())
    out = _verdicts(src, found, {"t": F.col("solution")}, [T.StructField("xs", numbers), T.StructField("values", numbers)])
    return out.select(*keep, "solution", F.posexplode(F.arrays_zip("_verdict.xs", "_verdict.values")).alias("point_idx", "_p")).select(
        *keep, "solution", "point_idx", F.col("_p.xs").alias("x"), F.col("_p.values").alias("value"))


def score_rollouts(rollouts: DataFrame, response="response", judge="judge_response", truth="ground_truth",
                   var="var", lb="lb", ub="ub", method="strict", policy="compat") -> DataFrame:
    """Extract -> numeric score (definite iff both bounds finite) -> judge verdict.

    An empty answer forces the judge to ``(0, NO_INP_IN_TAGS)``.
    """
    with_ans = rollouts.withColumn("answer", TX.extract_answer(_c(response), method))
    scored = score_answers(with_ans, answer="answer", truth=truth, var=var, lb=lb, ub=ub, policy=policy)
    empty = F.col("answer").isNull() | (F.col("answer") == "")
    unasked = F.struct(F.lit(0).alias("judge_result"), F.lit("NO_INP_IN_TAGS").alias("judge_status"))
    # the verdict is one column of two fields, so that the judge's text is read once
    judged = scored.withColumn("_judged", F.when(empty, unasked).otherwise(TX.parse_judge(_c(judge), method)))
    return judged.withColumns({f: F.col(f"_judged.{f}") for f in ("judge_result", "judge_status")}).drop("_judged", "formal_successes")


def assign_reward(scored: DataFrame, tokens="response_tokens") -> DataFrame:
    """reward = judge result, placed on the last valid response token (sparse form)."""
    return scored.withColumns({
        "reward": F.col("judge_result").cast("double"),
        "reward_pos": (_c(tokens) - 1).cast("int"),
    })


def syntax_probe_one(text, probe: float = 10.0) -> bool:
    """V2 (legacy): the cleaned text parses and evaluates at x = probe."""
    comp = E.try_compile(text)
    if comp is None:
        return False
    try:
        comp("x", np.array([probe]))
    except E.ExprError:
        return False
    return True


def validate_syntax(df: DataFrame, col="solution", out="formatting_ok", probe: float = 10.0) -> DataFrame:
    """V2: legacy formatting check of a solution text (legacy cleaning, probe at x=10)."""
    res = _verdicts(df, lambda t: (syntax_probe_one(t, probe),), {"t": TX.clean_expr(_c(col), "legacy")}, [T.StructField("ok", T.BooleanType())])
    return _take(res, {out: F.coalesce(F.col("_verdict.ok"), F.lit(False))})


def score_with(df: DataFrame, fn, keys: dict, out_fields: list) -> DataFrame:
    """Plug in a custom row scorer.

    ``keys`` maps key names to columns; ``fn(*key_values)`` returns a tuple matching
    ``out_fields`` (a list of StructFields).  It runs in Arrow batches, once per distinct
    key of a task, like the built-in policies.
    """
    res = _verdicts(df, fn, {n: _c(c) for n, c in keys.items()}, out_fields)
    return _take(res, {f.name: F.col(f"_verdict.{f.name}") for f in out_fields})


def score_batch(rollouts: DataFrame, path: str, by=("step",), **kwargs):
    """The dual return of the original reward call - (scored rows, metrics).

    The rows are scored once and written to ``path``; the metrics and whoever reads the
    rows use the written table.
    """
    from variantlake.operators.metrics import batch_metrics

    assign_reward(score_rollouts(rollouts, **kwargs)).write.mode("overwrite").parquet(path)
    scored = rollouts.sparkSession.read.parquet(path)
    return scored, batch_metrics(scored, by=list(by))
