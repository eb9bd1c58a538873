"""Files of JSON records, split at any byte among tasks."""
import json
import os
import random

import pytest

from variantlake.sources import readers as R
from variantlake.sources.json_arrays import json_array_records

BROKEN = ['{"a": 1', '[{"a":1}', '[{"a":1}] {"a":1}', '[{"a":1} {"a":2}]', '[1, {"a":1}]', '[{"a":1}, 2]', '{"a": "x}', '[{"a": "x\\"}]',
          "{oops", '[[{"a":1}]]', '[{"a":1}]]', '{"a":1}}', "3", "[", "]", "}{"]


def _value(rng, depth=0):
    kind = rng.random()
    if kind < 0.4 or depth > 3:
        return "".join(rng.choice('ab{}[]"\\,: \né') for _ in range(rng.randrange(30)))
    if kind < 0.6:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    if kind < 0.8:
        return {_value(rng, 9): _value(rng, depth + 1) for _ in range(rng.randrange(3))}
    return rng.choice([1, None, True, 2.5])


@pytest.fixture
def split_size(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]

    def small(size):
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], 0)
    yield small
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [64, 1 << 27])
def test_records_of_any_split_equal_plain_json(spark, tmpdir_path, split_size, size):
    rng = random.Random(5)
    files = {"one.json": ([{"a": 1}], '{"a": 1}'), "one_nl.json": ([{"a": "}"}], '{"a": "}"}\n'), "lines.json": ([{"a": 1}, {"a": {}}], '{"a": 1}\n{"a": {}}\n'),
             "none.json": ([], " [ ]\n"), "empty.json": ([], ""), "bom.json": ([{"a": 1}], '\ufeff{"a": 1}')}
    for i in range(9):
        records = [{"k": _value(rng), "n": j} for j in range(rng.randrange(60))]
        files[f"f{i}.json"] = (records, json.dumps(records, indent=i % 3 or None, ensure_ascii=i % 2 == 0))
    files |= {f"bad{i}.json": (None, text) for i, text in enumerate(BROKEN)}
    for name, (_, text) in files.items():
        with open(f"{tmpdir_path}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    split_size(size)
    records, broken = json_array_records(spark, tmpdir_path)
    got = {}
    for r in records.orderBy("file", "record").collect():
        got.setdefault(os.path.basename(r.file), []).append(json.loads(r.value))
    assert got == {n: want for n, (want, _) in files.items() if want}
    assert {os.path.basename(r.file) for r in broken.collect()} == {n for n, (want, _) in files.items() if want is None}


def test_one_array_is_read_by_many_tasks(spark, tmpdir_path, split_size):
    with open(f"{tmpdir_path}/array.json", "w") as f:
        json.dump([{"question": f"q{i}", "variants": [{"variant": "{" * (i % 5), "reasoning": "r", "difficulty": "easier"}]} for i in range(2000)], f)
    split_size(8192)
    assert spark.read.option("lineSep", "}").text(f"{tmpdir_path}/array.json").rdd.getNumPartitions() > 10
    rows = R.read_formatted(spark, tmpdir_path).collect()
    assert sorted((int(r.question[1:]), r.variants[0].variant) for r in rows) == [(i, "{" * (i % 5)) for i in range(2000)]


def test_a_bad_record_is_rejected_alone_and_a_broken_file_whole(spark, tmpdir_path):
    good = {"integral": "integrate(x, x)", "variants": {"easier": [{"variant": "v", "reasoning": "r", "requested_difficulty": "d"}]}}
    with open(f"{tmpdir_path}/a_train.json", "w") as f:
        f.write("[" + json.dumps(good) + ', {"integral" 1}, {"integral": "no variants"}]')
    with open(f"{tmpdir_path}/b_train.json", "w") as f:
        f.write("[" + json.dumps(good) + ", ")
    ok, bad = R.read_raw_questions(spark, tmpdir_path)
    assert [(os.path.basename(r.file), r.record, r.variants["easier"][0].variant) for r in ok.collect()] == [("a_train.json", 0, "v")]
    assert sorted(os.path.basename(r.file) for r in bad.collect()) == ["a_train.json", "a_train.json", "b_train.json"]


def test_lookup_of_one_tree_passes_over_other_row_groups(spark, tmpdir_path):
    from pyspark.sql import functions as F

    from variantlake.sources import writers as W

    prompts = spark.range(60_000).select(
        F.lit("d").alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.sha2(F.col("id").cast("string"), 256).alias("content"))).alias("prompt"),
        F.lit("math").alias("ability"), F.struct(F.lit("x").alias("ground_truth")).alias("reward_model"),
        F.struct((F.col("id") % 3).cast("int").alias("question_index")).alias("extra_info"),
        F.concat(F.lit("t"), F.floor(F.col("id") / 3)).alias("tree_id"), F.when(F.col("id") % 2 == 0, "train").otherwise("eval").alias("split"))
    W.write_prompts(prompts, tmpdir_path, row_group_bytes=1 << 17)
    assert sorted(p for p in os.listdir(f"{tmpdir_path}/parquet") if p.startswith("split")) == ["split=eval", "split=train"]

    def rows_scanned(df):
        rows = df.collect()
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return rows, scan.metrics().apply("numOutputRows").value()

    rows, scanned = rows_scanned(R.read_prompts(spark, tmpdir_path, trees=["t777"]))
    assert sorted(r.extra_info.question_index for r in rows) == [0, 1, 2] and scanned < 12_000
    rows, scanned = rows_scanned(R.read_prompts(spark, tmpdir_path, trees=["t777x"]))  # in the range of a file, in no filter
    assert rows == [] and scanned == 0
    assert R.read_prompts(spark, tmpdir_path, split="eval").count() == 30_000


def test_bucketed_key_join_has_no_exchange(spark):
    from conftest import SF_SMALL

    from variantlake.plans.io_queries import bucketed_rollouts

    plan = bucketed_rollouts(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
