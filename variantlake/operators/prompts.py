"""Prompt records, splits, chunk plans and simple filters.

All projections: templates are filled with ``concat`` of literal pieces and
columns, so no Python runs per row.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantlake import constants as K
from variantlake.operators.ranking import group_index, top_n_per_group


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fill(template: str, **values) -> Column:
    """``template.format(**values)`` with columns as values (native ``concat``)."""
    pieces = []
    for literal, field, _spec, _conv in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            pieces.append(_c(values[field]).cast("string"))
    return F.concat(*pieces)


def py_float_text(col) -> Column:
    """Python's ``str(float)`` for the integral bounds that reach prompts (e.g. ``3.0``)."""
    c = _c(col).cast("double")
    return F.when(c == F.floor(c), F.concat(F.floor(c).cast("long").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def user_prompt(integrand, var, lb, ub, is_definite, compat_bounds: bool = False) -> Column:
    """F1/F3 task text.  ``compat_bounds`` reproduces the original's definite-prompt
    defect of printing the upper bound twice; the default prints ``lb``."""
    lb_txt = py_float_text(ub if compat_bounds else lb)
    definite = fill(K.TASK_PROMPT_DEFINITE, integrand=integrand, var=var, lb=lb_txt, ub=py_float_text(ub))
    indefinite = fill(K.TASK_PROMPT_INDEFINITE, integrand=integrand, var=var)
    return F.when(_c(is_definite), definite).otherwise(indefinite)


def to_prompts(df: DataFrame, tree_id="tree_id", index="question_index", integrand="integrand", var="var",
               lb="lb", ub="ub", is_definite="is_definite", level="level", compat_bounds: bool = False) -> DataFrame:
    """the nested prompt record of the prompt dataset."""
    prompt = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(K.SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"),
                 user_prompt(integrand, var, lb, ub, is_definite, compat_bounds).alias("content")),
    )
    return df.select(
        "*",
        F.lit(K.DATA_SOURCE).alias("data_source"),
        prompt.alias("prompt"),
        F.lit(K.ABILITY).alias("ability"),
        F.struct(F.lit(K.REWARD_STYLE).alias("style"), _c(integrand).alias("ground_truth")).alias("reward_model"),
        F.struct(
            _c(index).cast("int").alias("question_index"), _c(tree_id).cast("string").alias("tree_id"),
            _c(var).alias("var"), _c(lb).cast("double").alias("lb"), _c(ub).cast("double").alias("ub"),
            _c(level).cast("int").alias("level"), _c(is_definite).alias("is_definite"),
        ).alias("extra_info"),
    )


def to_plain_prompts(df: DataFrame, question="variant", index="question_index", question_id=None) -> DataFrame:
    """F2 (legacy): one user message, question + newline + instruction."""
    qid = _c(question_id) if question_id is not None else _c(question)
    return df.select(
        "*",
        F.lit(K.DATA_SOURCE).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"),
                         F.concat(_c(question), F.lit("\n"), F.lit(K.LEGACY_INSTRUCTION)).alias("content"))).alias("prompt"),
        F.lit(K.ABILITY).alias("ability"),
        F.struct(F.lit(K.REWARD_STYLE).alias("style"), _c(question).alias("ground_truth")).alias("reward_model"),
        F.struct(_c(index).cast("int").alias("question_index"), qid.alias("question_id")).alias("extra_info"),
    )


def judge_prompt(answer, integrand, var, lb, ub) -> Column:
    """judge prompt; definite iff both bounds finite; NULL for empty answers
    (the original sends a filler prompt there only to keep its batch size)."""
    lbc, ubc = _c(lb).cast("double"), _c(ub).cast("double")
    definite = (lbc > F.lit(float("-inf"))) & (ubc < F.lit(float("inf")))
    text = F.when(definite, fill(K.JUDGE_PROMPT_DEFINITE, response=answer, integrand=integrand, var=var,
                                 lb=py_float_text(lbc), ub=py_float_text(ubc))) \
        .otherwise(fill(K.JUDGE_PROMPT_INDEFINITE, response=answer, integrand=integrand))
    return F.when(_c(answer).isNotNull() & (_c(answer) != ""), text)


def judge_chats(df: DataFrame, answer="answer", integrand="integrand", var="var", lb="lb", ub="ub",
                max_len: int = 10000, out="judge_chat") -> DataFrame:
    """the judge's chat (system and user message) and the F8 gate on the whole chat.

    Rows without an answer get no chat; a chat over ``max_len`` characters gets a
    ``reject_reason``."""
    text = judge_prompt(answer, integrand, var, lb, ub)
    chat = F.when(text.isNotNull(), F.array(
        F.struct(F.lit("system").alias("role"), F.lit(K.JUDGE_SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), text.alias("content"))))
    size = F.length(text) + len(K.JUDGE_SYSTEM_PROMPT)
    return df.withColumns({out: chat, "reject_reason": F.when(size > max_len, F.lit("too_long"))})


def eval_prompts(splits: DataFrame) -> DataFrame:
    """prompt records of ``make_splits`` rows, train and eval, with their ``split``;
    rejected base questions give none."""
    return to_prompts(splits.where(F.col("reject_reason").isNull()))


def difficulty_prompt(original, variant) -> Column:
    """ask whether a variant is easier, harder or equivalent."""
    return fill(K.DIFFICULTY_PROMPT, original=original, variant=variant)


def gate_length(df: DataFrame, text="content", max_len: int = 10000, tokens=None, out="reject_reason") -> DataFrame:
    """F8: prompts over ``max_len`` (tokens if given, else characters) get a reject reason."""
    size = _c(tokens) if tokens is not None else F.length(_c(text))
    return df.withColumn(out, F.when(size > max_len, F.lit("too_long")))


def with_question_index(df: DataFrame, tree="tree_id", order=("order_key",), out="question_index") -> DataFrame:
    """0-based position of each kept variant inside its tree (skew-safe)."""
    return group_index(df, [tree], list(order), out=out).withColumn(out, F.col(out).cast("int"))


def make_splits(train: DataFrame, base: DataFrame, num_eval: int = K.NUM_EVAL_DEFAULT,
                tree="tree_id") -> DataFrame:
    """Train rows as given plus ``num_eval`` copies of each tree's base question.

    ``base`` must hold one parsed base question per tree (``integrand, var, lb, ub,
    is_definite``); trees whose base did not parse or validate get ``reject_reason``
    instead of eval rows (the original raises).
    """
    cols = [tree, "question_index", "integrand", "var", "lb", "ub", "is_definite", "level"]
    tr = train.select(*cols, F.lit("train").alias("split"), F.lit(None).cast("string").alias("reject_reason"))
    ok = F.col("integrand").isNotNull() & F.coalesce(F.col("valid"), F.lit(True))
    ev = base.select(
        tree,
        F.explode(F.when(ok, F.sequence(F.lit(0), F.lit(num_eval - 1)))
                  .otherwise(F.array(F.lit(-1)))).alias("question_index"),
        "integrand", "var", "lb", "ub", "is_definite", F.lit(0).alias("level"),
        F.lit("eval").alias("split"),
        F.when(~ok, F.lit("base_not_verifiable")).alias("reject_reason"),
    )
    ev = ev.withColumn("question_index", F.when(F.col("question_index") >= 0, F.col("question_index")))
    return tr.unionByName(ev)


def chunk_plan(df: DataFrame, n="num_variants", chunk_size: int = K.CHUNK_SIZE,
               multiplier: int = K.BUFFER_MULTIPLIER) -> DataFrame:
    """``multiplier * n`` requested variants in chunks of ``chunk_size``, last one smaller."""
    total = _c(n).cast("int") * multiplier
    chunks = F.ceil(total / F.lit(chunk_size)).cast("int")
    planned = df.withColumns({"_total": total, "_chunks": chunks}).select(
        "*", F.explode(F.when(F.col("_chunks") > 0, F.sequence(F.lit(0), F.col("_chunks") - 1))
                       .otherwise(F.array().cast("array<int>"))).alias("chunk"))
    return planned.withColumn(
        "count", F.when(F.col("chunk") < F.col("_chunks") - 1, F.lit(chunk_size))
        .otherwise(F.col("_total") - chunk_size * (F.col("_chunks") - 1))
    ).drop("_total", "_chunks")


def to_generation_prompts(requests: DataFrame, request="request_id", question="question",
                          difficulty="difficulty", count="count", seed: int = 0) -> DataFrame:
    """per request, 3 or 5 ideas sampled from the difficulty's list, then the prompt.

    The sample is deterministic: the row's fixed list of ideas is ordered by the md5 of
    request, position and seed, and its first 3 or 5 are taken.  No join, no shuffle.
    """
    key = lambda *parts: F.md5(F.concat_ws("|", _c(request).cast("string"), *parts, F.lit(str(seed))))
    level = F.lower(_c(difficulty))
    pools = F.array(F.lit(K.DEFAULT_TRANSFORMATION))
    for name, ideas in K.TRANSFORMATIONS_BY_DIFFICULTY.items():
        pools = F.when(level == name, F.array(*[F.lit(i) for i in ideas])).otherwise(pools)
    ranked = F.array_sort(F.transform(F.col("_pool"), lambda idea, i: F.struct(key(i.cast("string")).alias("h"), idea.alias("idea"))))
    n_pick = F.when(F.substring(key(F.lit("n")), 1, 1) < "8", 3).otherwise(5)
    out = requests.withColumn("_pool", F.coalesce(pools, F.array(F.lit(K.DEFAULT_TRANSFORMATION))))
    out = out.withColumn("transformations_used", F.transform(F.slice(ranked, 1, n_pick), lambda s: s["idea"])).drop("_pool")
    return out.withColumn("generation_prompt", fill(
        K.GENERATION_PROMPT, personas=F.lit(", ".join(K.PERSONAS)), integral=question, count=count,
        difficulty=difficulty, ideas=F.array_join("transformations_used", " and ")))


# --- filters ---------------------------------------------------------------

def filter_nonempty(df: DataFrame, cols=("variant", "reasoning")) -> DataFrame:
    """G1: keep rows whose listed texts are all non-empty."""
    cond = None
    for c in cols:
        term = F.length(F.coalesce(F.col(c), F.lit(""))) > 0
        cond = term if cond is None else cond & term
    return df.where(cond)


def drop_empty_questions(questions: DataFrame, variants: DataFrame, key="question") -> DataFrame:
    """Questions left with no variants disappear (semi join)."""
    return questions.join(variants.select(key).distinct(), key, "left_semi")


def filter_difficulty(df: DataFrame, evaluation="evaluation", requested="difficulty") -> DataFrame:
    """Drop variants judged harder unless harder was requested (NULL-safe)."""
    judged_harder = F.coalesce(F.col(evaluation) == "harder", F.lit(False))
    requested_other = F.coalesce(F.col(requested) != "harder", F.lit(True))
    return df.where(~(judged_harder & requested_other))


def limit_per_group(df: DataFrame, group, order, n: int) -> DataFrame:
    """First ``n`` rows per group."""
    return top_n_per_group(df, list(group), list(order), n)
