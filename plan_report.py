"""Physical-plan audit of the registered queries.

usage: plan_report.py [table_dir] [name-prefix ...]

Prints, per query, what matters at scale: raw table scans, shuffles, reused
shuffles, nested-loop and cartesian joins, Python nodes and the number of
columns each raw scan reads. A settled (checkpointed) input is not a raw scan.
"""

from __future__ import annotations

import re
import sys

from hourmark.plans import ENTRIES
from hourmark.session import build_session


def final_plan(df) -> str:
    """Executed plan text without the pre-execution copy AQE keeps."""
    df.collect()  # report tool only: small test tables
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def summarise(plan: str) -> dict[str, int]:
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    return {
        "scans": len(scans),
        "max_cols": max((len(s.split(",")) for s in scans), default=0),
        "shuffles": len(re.findall(r"\bExchange (?:hash|range|Round)", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "reused": len(re.findall(r"Reused(?:Exchange|Query)", plan)),
        "nested_loop": len(re.findall(r"BroadcastNestedLoopJoin", plan)),
        "cartesian": len(re.findall(r"CartesianProduct", plan)),
        "python": len(re.findall(r"(?:ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas)", plan)),
    }


def main(path: str, prefixes: list[str]) -> None:
    spark = build_session(
        "plans", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name, e in ENTRIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            counts = summarise(final_plan(e.run(spark, path)))
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            print(f"{name:34s} failed: {str(error).splitlines()[0][:200]}", flush=True)
            continue
        print(f"{name:34s} " + " ".join(f"{k}={v}" for k, v in counts.items()), flush=True)


if __name__ == "__main__":
    args = sys.argv[1:]
    main(args[0] if args else "/root/testdata/sf0.001", args[1:])
