"""Summarise the physical plan of every registered query into PLANS.md.

For each query: shuffles (Exchange), join strategies, Python nodes, whole-stage
codegen spans, and per scan the columns read and the filters pushed to Parquet.
Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from variantlake.plans import registry  # noqa: E402
from variantlake.session import get_spark  # noqa: E402


def plan_text(df) -> str:
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def summarise(text: str) -> dict:
    tree, _, details = text.partition("\n\n(")
    details = "(" + details
    final = tree.split("== Initial Plan ==")[0]  # executed AQE plans print both
    ids = set(re.findall(r"\((\d+)\)", final))
    blocks = {m.group(1): b for b in re.split(r"\n(?=\(\d+\) )", details)
              if (m := re.match(r"\((\d+)\) ", b))}
    final_blocks = [b for i, b in blocks.items() if i in ids]
    names = [re.match(r"\(\d+\) ([A-Za-z]+)", b).group(1) for b in final_blocks]
    count = lambda name: names.count(name)
    scans = []
    for block in final_blocks:
        if not re.match(r"\(\d+\) Scan parquet", block):
            continue
        table = re.search(r"Location: [^\n]*?/([a-z]+)\.parquet", block)
        schema = re.search(r"ReadSchema: struct<([^\n]*)>", block)
        pushed = re.search(r"PushedFilters: \[([^\n]*)\]", block)
        ncols = len(re.findall(r"(?:^|,)([A-Za-z_]+):", schema.group(1))) if schema else 0
        scans.append(f"{table.group(1) if table else '?'}({ncols} cols"
                     + (f"; pushed {pushed.group(1)[:70]}" if pushed and pushed.group(1) else "") + ")")
    codegen = set()
    for block in final_blocks:
        codegen.update(re.findall(r"\[codegen id : (\d+)\]", block))
    return {
        "exchanges": count("Exchange"),
        "joins": ", ".join(f"{n}x{j}" for j in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
                                                  "BroadcastNestedLoopJoin", "CartesianProduct")
                           if (n := count(j))),
        "python": count("MapInPandas") + count("ArrowEvalPython") + count("BatchEvalPython"),
        "codegen": len(codegen),
        "windows": count("Window") + count("WindowGroupLimit"),
        "scans": "; ".join(scans),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    registry.load_all()
    spark = get_spark()
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` at `{sf}`: each query is executed first, so these are AQE's final")
    print("plans (run-time join strategies, code-generated stages).")
    print("Columns: shuffles, join strategies, Python nodes (Arrow), whole-stage codegen spans, window")
    print("operators, and per Parquet scan the number of columns read and the filters pushed down.\n")
    print("| query | shuffles | joins | python | codegen | windows | scans |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in registry.QUERIES.items():
        try:
            df = fn(spark, sf)
            df.collect()  # execute, so the explain shows AQE's final plan (codegen, run-time joins)
            s = summarise(plan_text(df))
        except Exception as exc:  # noqa: BLE001
            print(f"| {name} | error: {type(exc).__name__} | | | | | |")
            continue
        print(f"| {name} | {s['exchanges']} | {s['joins'] or '-'} | {s['python']} | {s['codegen']} | "
              f"{s['windows']} | {s['scans'] or '(reads a checkpoint or a written table)'} |")


if __name__ == "__main__":
    main()
