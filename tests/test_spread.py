"""Work is dealt among tasks by rows, not by the bytes of small or repetitive rows."""
import glob

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from variantlake.operators import flatten as FL
from variantlake.operators import incremental as I
from variantlake.operators import metrics as M
from variantlake.plans import registry
from variantlake.plans.registry import task_count
from variantlake.sources import writers as W
from variantlake.streaming import step_metrics as SM

registry.load_all()
CQ, TR = registry.QUERIES["read_trees"].__globals__, registry.QUERIES["flatten_bfs"].__globals__
TQ, SQ = registry.QUERIES["prompt_records"].__globals__, registry.QUERIES["score_rollouts"].__globals__


def test_task_count_follows_the_rows(spark):
    assert [task_count(spark.range(n), rows=10) for n in (0, 1, 10, 11, 95)] == [1, 1, 1, 2, 10]
    assert [task_count(spark.range(n), rows=10, batches=3) for n in (0, 30, 31, 95)] == [3, 3, 6, 12]


def test_tree_documents_are_dealt_by_rows(spark, tmp_path):
    tables = {"orders": spark.range(25_000).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey"), "customer": spark.range(7).selectExpr("id AS c_custkey", "0 AS c_nationkey"),
              "nation": spark.sql("SELECT 0 AS n_nationkey, 'N' AS n_name, 1 AS n_regionkey"), "region": spark.sql("SELECT 1 AS r_regionkey")}
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    counts = [r["count"] for r in TR["tree_texts"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 25_000 and len(counts) == 3


def test_folders_are_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(1_100).selectExpr("concat('d', id) AS dir", "'x' AS value")
    CQ["_write_folders"](rows, rows, "dir", "text", f"{tmp_path}/out")
    files = glob.glob(f"{tmp_path}/out/dir=*/part-*")
    assert len(files) == 1_100 and len({f.rsplit("/part-", 1)[1][:5] for f in files}) == 3


@pytest.mark.parametrize("depth", [1, FL.LEVELS - 1, FL.LEVELS, FL.LEVELS + 1, 3 * FL.LEVELS + 2])
@pytest.mark.parametrize("order", ["bfs", "dfs"])
def test_levels_decoded_together_match_the_walk_level_by_level(spark, depth, order):
    text = '{"variants":["leaf",null,1.50,{"k":[1]}]}'
    for i in range(depth):
        text = f'{{"level":{i},"variants":["v{i}"],"children":[{text},{{"level":"{i}","variants":["w"],"children":null}}]}}'
    good = f'{{"base_question":"q","tree":[{text},{{"children":[]}}]}}'
    escaped = good.replace('"leaf"', '"\\u006ceaf"')  # an escape: level by level
    bad = good.replace('{"level":"0"', '3,{"level":"0"')
    df = spark.createDataFrame([("good", good), ("escaped", escaped), ("bad", bad), ("worse", good.replace('["w"]', '"w"'))], "tree_id string, value string")
    found = {r["tree_id"]: r for r in FL.parsed_trees(df, order=order).collect()}
    assert found["good"]["variants"] == found["escaped"]["variants"] and len(found["good"]["variants"]) == 4 + 2 * depth
    assert found["good"]["reason"] is None and found["bad"]["reason"] == found["worse"]["reason"] == "wrong_type"
    assert max(v["depth"] for v in found["good"]["variants"]) == depth


def test_phases_are_compared_without_a_pivot(spark):
    rows = spark.createDataFrame([("a", 1, "base", 0.5), ("a", 1, "final", 0.75), ("b", 1, "final", None), (None, 1, "base", 1.0)], "q string, k int, phase string, pass_at_k double")
    wide = M.compare_phases(rows, ["q", "k"])
    assert "pivotfirst" not in wide._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {tuple(r) for r in wide.collect()} == {("a", 1, 0.5, 0.75, 0.25), ("b", 1, None, None, None), (None, 1, 1.0, None, None)}


def test_partial_sums_take_a_column_per_metric():
    pdf = pd.DataFrame({"step": [1, 1, 2], "ts": pd.to_datetime(["2024-01-01", "2024-01-03", "2024-01-02"]), "m0": [1.0, np.nan, 2.0], "m1": [0.5, 0.25, np.nan]})
    (out,) = SM._partial_sums(iter([pdf]))
    assert out[["step", "n", "counts", "sums"]].values.tolist() == [[1, 2, [1, 2], [1.0, 0.75]], [2, 1, [1, 0], [2.0, 0.0]]]
    assert out["latest"].tolist() == [pd.Timestamp("2024-01-03"), pd.Timestamp("2024-01-02")]


def test_calls_are_parsed_by_many_tasks(spark, tmp_path):
    rows = spark.range(25_000).selectExpr("id AS p_partkey", "'b' AS p_brand", "'n' AS p_name", "if(id % 2 = 0, 'PROMO', 'OTHER') AS p_type", "CAST(id % 50 AS INT) AS p_size")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    parsed = TQ["_parsed_part"](spark, str(tmp_path))
    assert parsed.count() == 12_500 and parsed.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("mode", ["overwrite", "append"])
def test_prompt_files_and_their_twin(spark, tmp_path, mode):
    rows = spark.range(90).selectExpr("'s' AS data_source", "array(struct('user' AS role, concat('q', id) AS content)) AS prompt", "'m' AS ability", "struct('rule' AS style, 'x' AS ground_truth) AS reward_model",
                                      "struct(CAST(id AS INT) AS question_index, '-Infinity' AS lb) AS extra_info", "concat('t', id % 3) AS tree_id", "if(id % 9 = 0, '01', NULL) AS split")
    W.write_prompts(rows, f"{tmp_path}/p", also_json=True, mode=mode, files=3)
    if mode == "append":
        W.write_prompts(rows, f"{tmp_path}/p", also_json=True, mode=mode, files=3)
    assert len({f.rsplit("/part-", 1)[1][:5] for f in glob.glob(f"{tmp_path}/p/parquet/split=*/part-*")}) == 3
    twin = spark.read.schema(rows.schema).json(f"{tmp_path}/p/json")
    assert sorted(map(repr, twin.collect())) == sorted(map(repr, rows.collect() * (1 + (mode == "append"))))


def test_census_broadcasts_no_texts(spark, tmp_path, monkeypatch):
    plans = {}
    put, numbered = I._put, I.group_index
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(I, "_put", lambda df, path, name, load: (plans.update({name: plan(df)}), put(df, path, name, load)))
    monkeypatch.setattr(I, "group_index", lambda df, group, order, **k: (plans.update(new=plan(df), order=order), numbered(df, group, order, **k))[1])
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "question string, difficulty string")
    I.create_census(spark, f"{tmp_path}/c")
    I.add_census(rows, f"{tmp_path}/c", 0)
    assert "Broadcast" not in plans["new"] + plans["bitmaps"] and plans["order"] != ["question"]
    assert {r["difficulty"]: (r["variants"], r["questions"]) for r in I.read_census(spark, f"{tmp_path}/c").collect()} == {"x": (3, 2), "y": (1, 1), "total": (4, 2)}


def test_eval_log_is_compressed_and_dealt_while_narrow(spark, tmp_path):
    li = spark.range(400).selectExpr("id AS l_orderkey", "CAST(id % 7 + 1 AS INT) AS l_linenumber", "id % 11 AS l_partkey", "id % 3 AS l_suppkey", "CAST(id % 50 AS DOUBLE) AS l_quantity", "1.5D AS l_extendedprice",
                                     "0.1D AS l_discount", "0.2D AS l_tax", "'R' AS l_returnflag", "'F' AS l_linestatus", "date_add(DATE'2024-01-01', CAST(id AS INT)) AS l_shipdate")
    li.unionByName(li.limit(9)).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(10).selectExpr("id AS p_partkey", "element_at(array('ECONOMY', 'PROMO', 'SMALL'), CAST(id % 3 + 1 AS INT)) AS p_type", "CAST(id AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plain, by_step = (SQ[n](spark, str(tmp_path)) for n in ("rollouts", "rollouts_by_step"))
    assert plain.columns == by_step.columns and sorted(map(repr, plain.collect())) == sorted(map(repr, by_step.collect()))
    log = [("r1", "x", 1), ("r2", "y", 2)]
    rows = spark.createDataFrame(log, "rollout_id string, agent_response string, eval_step int").select(
        *[F.col(f.name) if f.name in ("rollout_id", "agent_response", "eval_step") else F.lit(None).cast(f.dataType).alias(f.name) for f in W.EVAL_LOG.fields])
    for clustered in (False, True):
        W.write_eval_log(rows, f"{tmp_path}/log", clustered=clustered)
    assert len(glob.glob(f"{tmp_path}/log/eval_step=*/*.json.gz")) == 4
    assert sorted((r["rollout_id"], r["agent_response"], r["eval_step"]) for r in W.read_eval_log(spark, f"{tmp_path}/log").collect()) == sorted(log * 2)


def test_stored_trees_are_parsed_once_for_both_sides(spark, tmp_path):
    from variantlake.sources.readers import parse_tree_docs

    good = '{"base_question":"q","tree":[{"variants":["a"],"children":[{"variants":["b",null,3],"level":1}]},{"variants":["c"]}]}'
    docs = spark.createDataFrame([("t", good), ("t", good), ("u", '{"base_question":"q","tree":[]}'), ("bad", "{no"), ("odd", '{"base_question":"q","tree":[{"variants":[],"children":[1]}]}'),
                                  ("", good), (None, good), ("none", None)], "tree_id string, value string")
    for order in ("bfs", "dfs"):
        ok, rejects = parse_tree_docs(docs)
        ok2, rejects2 = parse_tree_docs(docs, stored=f"{tmp_path}/{order}", order=order)
        listed = lambda df: sorted(map(str, df.collect()))
        assert listed(rejects2) == listed(rejects) and rejects.count() == 5
        flat, flat2 = FL.flatten_trees(ok, order=order), FL.flatten_trees(ok2, order=order)
        assert flat2.schema.names == flat.schema.names and listed(flat2) == listed(flat) and flat.count() == 10
        assert listed(FL.flatten_trees(ok2, order=order, with_base=True)) == listed(FL.flatten_trees(ok, order=order, with_base=True))
        for df in (flat2, rejects2):
            assert "parse_json" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    with pytest.raises(ValueError):
        FL.flatten_trees(ok2, order="bfs")


def test_a_let_value_stands_once_in_the_plan(spark):
    from variantlake.functions import text as TX

    df = spark.createDataFrame([("<answer> x </answer>", "<JUDGE_SCORE>1</JUDGE_SCORE>"), (None, ""), ("<answer>integrate(x, x)</answer>", "<JUDGE_SCORE>7</JUDGE_SCORE>")], "r string, j string")
    out = df.select(TX.extract_answer("r").alias("a"), TX.parse_judge("j").alias("v"))
    assert [(r.a, *r.v) for r in out.collect()] == [("x", 1, "OK"), (None, 0, "NO_JUDGE_RESPONSE"), (None, 0, "ERROR")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<answer>") == 1 and plan.count("<JUDGE_SCORE>") == 1
