"""pass@k, status rates, lengths, confusion matrix, censuses.

All of them are hash aggregations with map-side partial aggregation; none
materialises a group.  Status domains are listed, so pivots never need a
pre-pass to discover their values.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantlake import constants as K


def _ks_col(ks) -> Column:
    return F.explode(F.array(*[F.lit(int(k)) for k in ks]))


def pass_at_k_expr(n: Column, c: Column, k: Column) -> Column:
    """Unbiased pass@k: 1 if n-c<k else 1 - prod_{j<k} (n-c-j)/(n-j).

    Same value as the usual ``1 - prod_{i=n-c+1..n} (1-k/i)``, but the product runs
    over k terms, so a question with millions of samples costs k multiplications.
    """
    terms = F.transform(F.sequence(F.lit(0), k - 1),
                        lambda j: (n - c - j).cast("double") / (n - j).cast("double"))
    prod = F.aggregate(terms, F.lit(1.0), lambda acc, t: acc * t)
    return F.when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - prod)


def pass_at_k(df: DataFrame, by: list[str], correct: str | Column = "correct",
              ks=tuple(K.PASS_AT_K)) -> DataFrame:
    """A1: per group and k -> ``n, c, pass_at_k, reason``.

    A group with fewer samples than k has no estimate: NULL, with the reason
    ``fewer_samples`` (the original asserts)."""
    ok = F.col(correct) if isinstance(correct, str) else correct
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("c")
    )
    out = counts.select(*by, "n", "c", _ks_col(ks).alias("k"))
    few = F.col("n") < F.col("k")
    return out.withColumns({
        "pass_at_k": F.when(~few, pass_at_k_expr(F.col("n"), F.col("c"), F.least("n", "k").cast("int"))),
        "reason": F.when(few, F.lit("fewer_samples"))})


def pass_first_k_as_written(df: DataFrame, by: list[str], sample_idx: str = "sample_idx",
                            correct: str = "correct", ks=tuple(K.LEGACY_PASSES)) -> DataFrame:
    """A3 as the legacy counters actually behave: a correct sample counts only for the
    smallest k above its index, so pass@k looks at indices [previous k, k).
    One aggregation with a conditional count per k."""
    ks = sorted(ks)
    bounds = list(zip([0, *ks[:-1]], ks))
    idx, ok = F.col(sample_idx), F.col(correct)
    agg = [F.max(F.when(ok & (idx >= lo) & (idx < hi), 1).otherwise(0)).alias(f"_p{hi}") for lo, hi in bounds]
    per = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *agg)
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"_p{k}") == 1).alias("passed"))
                                  for k in ks])).alias("_s")
    return per.select(*by, "n", stacked).select(*by, "_s.k", "n", "_s.passed")


def pass_first_k(df: DataFrame, by: list[str], order: list, correct: str = "correct",
                 ks=tuple(K.LEGACY_PASSES), sample_idx: str | None = None) -> DataFrame:
    """A3: did any of the first k samples (in ``order``) pass?  Cumulative intent.

    The position of the first correct sample is the number of samples ordered
    before it: one aggregation finds each group's smallest correct order key, a
    second counts the samples below it.  No per-group sort, no window, so a hot
    group costs two map-side-combined aggregations.  ``sample_idx`` may be given
    instead of ``order``.
    """
    if sample_idx is not None:
        firsts = df.groupBy(*by).agg(
            F.min(F.when(F.col(correct), F.col(sample_idx))).alias("first_ok"), F.count(F.lit(1)).alias("n"))
    else:
        key = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
        keyed = df.select(*by, key.alias("_k"), F.col(correct).alias("_ok"))
        first_key = keyed.where("_ok").groupBy(*by).agg(F.min("_k").alias("_first"))
        firsts = keyed.join(first_key, by, "left").groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"),
            F.when(F.first(F.col("_first").isNotNull(), ignorenulls=True),
                   F.count_if(F.col("_k") < F.col("_first"))).alias("first_ok"),
        )
    return firsts.select(*by, "n", _ks_col(ks).alias("k"), "first_ok").select(
        *by, "k", "n", F.coalesce(F.col("first_ok") < F.col("k"), F.lit(False)).alias("passed")
    )


def accuracy(per_question: DataFrame, by: list[str], passed: str = "passed") -> DataFrame:
    """A4: per model and k -> solved questions, total, accuracy."""
    return per_question.groupBy(*by).agg(
        F.sum(F.when(F.col(passed), 1).otherwise(0)).cast("long").alias("num_correct"),
        F.count(F.lit(1)).alias("num_total"),
    ).withColumn("accuracy", F.col("num_correct") / F.col("num_total"))


def compare_phases(per_phase: DataFrame, keys: list[str], phase: str = "phase",
                   value: str = "pass_at_k", phases=("base", "final")) -> DataFrame:
    """Same metric before and after, side by side, with the change."""
    before, after = phases
    # two conditional firsts are a hash aggregate of two fixed fields a key; a pivot keeps an array a key
    held = lambda p: F.first(F.when(F.col(phase) == p, F.col(value)), ignorenulls=True).alias(p)
    wide = per_phase.groupBy(*keys).agg(*[held(p) for p in phases])
    return wide.select(
        *keys,
        F.col(before).alias(f"{value}_{before}"),
        F.col(after).alias(f"{value}_{after}"),
        (F.col(after) - F.col(before)).alias("delta"),
    )


def _long(wide: DataFrame, by: list[str], metrics: list[tuple[str, str, str]]) -> DataFrame:
    """Unpivot (metric name, mean column, sum column) triples with ``stack``."""
    parts = ", ".join(f"'{m}', `{mean}`, `{s}`" for m, mean, s in metrics)
    return wide.selectExpr(*[f"`{b}`" for b in by], f"stack({len(metrics)}, {parts}) as (metric, mean, sum)")


def _status_hits(judge, formal):
    """(metric, value) of every status and of the confusion cells (truth = formal,
    prediction = judge; other statuses fall in no cell)."""
    hits = [(f"{prefix}/{st}", F.when(F.col(col) == st, 1).otherwise(0))
            for prefix, col, domain in (("JUDGE", judge, K.JUDGE_STATUSES), ("FORMAL", formal, K.FORMAL_STATUSES)) for st in domain]
    cells = {"TP": ("OK", "OK"), "FP": ("NO_OK", "OK"), "TN": ("NO_OK", "NO_OK"), "FN": ("OK", "NO_OK")}
    return hits, [(f"CONFUSION_MATRIX/{cell}", F.when((F.col(formal) == f) & (F.col(judge) == j), 1).otherwise(0)) for cell, (f, j) in cells.items()]


def _mean_sum(scored: DataFrame, by: list[str], values: list) -> DataFrame:
    """Mean and sum of every (metric, value) per group, as rows, from one aggregation."""
    aggs = [a for m, v in values for a in (F.avg(v).cast("double").alias(f"m_{m}"), F.sum(v).cast("double").alias(f"s_{m}"))]
    return _long(scored.groupBy(*by).agg(*aggs), by, [(m, f"m_{m}", f"s_{m}") for m, _ in values])


def status_metrics(scored: DataFrame, by=("step",), judge="judge_status", formal="formal_status",
                   reward="formal_result") -> DataFrame:
    """A5 + A8: rate (mean) and count (sum) of every judge and formal status, and the formal reward."""
    return _mean_sum(scored, list(by), [*_status_hits(judge, formal)[0], ("FORMAL/REWARD", F.col(reward))])


def confusion(scored: DataFrame, by=("step",), judge="judge_status", formal="formal_status") -> DataFrame:
    """truth = formal, prediction = judge; other statuses fall in no cell."""
    return _mean_sum(scored, list(by), _status_hits(judge, formal)[1])


def metric_values(columns: list[str], judge="judge_status", formal="formal_status", reward="formal_result",
                  tokens="response_tokens", judge_text="judge_response") -> list:
    """(metric, value) of A5-A8: statuses, reward, confusion cells, and the answer and judge
    lengths within each status (NULL where it does not occur)."""
    hits, cells = _status_hits(judge, formal)
    judge_len = F.coalesce(F.length(F.col(judge_text)), F.lit(0))
    lengths = []
    for prefix, col, domain in (("JUDGE", judge, K.JUDGE_STATUSES), ("FORMAL", formal, K.FORMAL_STATUSES)):
        for st in domain:
            lengths.append((f"AGENT_LEN/{prefix}/{st}", F.when(F.col(col) == st, F.col(tokens))))
            if prefix == "JUDGE":
                lengths.append((f"JUDGE_LEN/{st}", F.when(F.col(col) == st, judge_len)))
    return [*hits, ("FORMAL/REWARD", F.col(reward)), *cells, *[x for x in lengths if tokens in columns]]


def batch_metrics(scored: DataFrame, by=("step",), **columns) -> DataFrame:
    """A5-A8 from one aggregation (see ``metric_values``)."""
    return _mean_sum(scored, list(by), metric_values(scored.columns, **columns))


def length_metrics(scored: DataFrame, by=("step",), judge="judge_status", formal="formal_status",
                   tokens="response_tokens", judge_text="judge_response") -> DataFrame:
    """Mean answer length (tokens) and judge length (characters) within each status.

    Formal statuses appear as ``FORMAL_<status>`` with no judge length, as in the
    original's metric names.  Only statuses that occur produce rows.  One aggregation.
    """
    by = list(by)
    judge_len = F.coalesce(F.length(F.col(judge_text)), F.lit(0)).cast("double")
    aggs, rows = [], []
    for prefix, col, domain in (("", judge, K.JUDGE_STATUSES), ("FORMAL_", formal, K.FORMAL_STATUSES)):
        for st in domain:
            hit, name = F.col(col) == st, f"{prefix}{st}"
            aggs += [F.count_if(hit).alias(f"n_{name}"), F.avg(F.when(hit, F.col(tokens).cast("double"))).alias(f"t_{name}")]
            if not prefix:
                aggs.append(F.avg(F.when(hit, judge_len)).alias(f"j_{name}"))
            rows.append(F.when(F.col(f"n_{name}") > 0, F.struct(
                F.lit(name).alias("status"), F.col(f"t_{name}").alias("agent_len"),
                (F.lit(None).cast("double") if prefix else F.col(f"j_{name}")).alias("judge_len"))))
    found = scored.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*rows)).alias("r"))
    return found.where(F.col("r").isNotNull()).select(*by, "r.*")


def census(variants: DataFrame, question="question", difficulty="difficulty") -> DataFrame:
    """Variants per bucket, questions having the bucket, mean over those questions.

    A ``total`` row divides all variants by all questions present.
    """
    per = variants.groupBy(difficulty).agg(
        F.count(F.lit(1)).alias("variants"), F.countDistinct(question).alias("questions"))
    total = variants.agg(F.lit("total").alias(difficulty), F.count(F.lit(1)).alias("variants"),
                         F.countDistinct(question).alias("questions"))
    return per.unionByName(total).withColumn("mean", F.col("variants") / F.col("questions"))


def difficulty_histogram(variants: DataFrame, question="question", difficulty="difficulty") -> DataFrame:
    """A10 + G5: per question total (difficulty NULL) and per difficulty counts, via ROLLUP."""
    return (variants.rollup(question, difficulty).agg(F.count(F.lit(1)).alias("variants"))
            .where(F.col(question).isNotNull())
            .orderBy(question, F.col(difficulty).asc_nulls_first()))


def flatten_report(flat: DataFrame, tree="tree_id", reason="reject_reason", fingerprint="fingerprint") -> DataFrame:
    """Raw, rejected by reason, text-fallback and kept counts per tree."""
    r = F.col(reason)
    return flat.groupBy(tree).agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(r == "unparsable_call").alias("unparsable"),
        F.count_if(r.isin("bad_variable", "bad_bounds")).alias("bad_form"),
        F.count_if(r.isin("syntax", "numeric", "unparsed")).alias("invalid"),
        F.count_if(r == "duplicate").alias("duplicates"),
        F.count_if(r == "base_question").alias("base_copies"),
        F.count_if(r.isNull() & F.col(fingerprint).isNull()).alias("text_fallback"),
        F.count_if(r.isNull()).alias("kept"),
    )


def evaluate_rollouts(rollouts: DataFrame, by=("tree_id",), ks=tuple(K.PASS_AT_K), policy: str = "compat",
                      response="response", **score_kwargs) -> DataFrame:
    """A2: score the base question's samples formally, count OK, pass@k for each k.

    Groups with fewer samples than k get NULL for that k and a reason (the original asserts).
    """
    from variantlake.functions.text import extract_answer
    from variantlake.operators.verify import score_answers

    answered = rollouts.withColumn("answer", extract_answer(F.col(response)))
    scored = score_answers(answered, policy=policy, **score_kwargs)
    return pass_at_k(scored, list(by), F.col("formal_status") == "OK", ks=ks)


def ground_truth_share(tests: DataFrame, solution="ground_truth_solution") -> DataFrame:
    """A9 (last line): test questions with a ground-truth solution, of all present."""
    return tests.agg(
        F.count_if(F.col(solution).isNotNull()).alias("with_ground_truth"),
        F.count(F.lit(1)).alias("questions"),
    ).withColumn("share", F.col("with_ground_truth") / F.col("questions"))


def legacy_report(samples: DataFrame, question_id="question_id", question="question", model="model",
                  sample_idx="sample_idx", response="response", correct="correct",
                  models=("base_model", "rl_model"), ks=tuple(K.LEGACY_PASSES)):
    """K5 shape: per question one struct per model (ordered responses, pass@k flags),
    a summary of solved questions and accuracy per model and k, and the total.

    A question's response list has one entry per sample (10 in the original run),
    so its size is a run parameter, not a data size.
    """
    per = pass_first_k(samples, [question_id, model], [], correct=correct, ks=ks, sample_idx=sample_idx)
    flags = per.groupBy(question_id, model).pivot("k", list(ks)).agg(F.first("passed"))
    lists = samples.groupBy(question_id, question, model).agg(
        F.array_sort(F.collect_list(F.struct(F.col(sample_idx).alias("i"), F.col(response).alias("r")))).alias("_rs"))
    per_model = lists.join(flags, [question_id, model]).select(
        question_id, question, model,
        F.struct(F.transform("_rs", lambda s: s["r"]).alias("responses"),
                 *[F.col(str(k)).alias(f"pass@{k}") for k in ks]).alias("result"))
    questions = per_model.groupBy(question_id, question).pivot(model, list(models)).agg(F.first("result"))
    acc = accuracy(per, [model, "k"])
    summary = acc.groupBy(model).pivot("k", list(ks)).agg(
        F.first(F.struct("num_correct", "accuracy")))
    summary = summary.select(model, *[F.col(str(k)).alias(f"pass@{k}") for k in ks])
    total = samples.select(question_id).distinct().agg(F.count(F.lit(1)).alias("num_total"))
    return questions, summary, total
