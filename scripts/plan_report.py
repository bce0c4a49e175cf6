"""Summarise the executed plans of queries: exchanges, joins, windows, scans.

Usage: python scripts/plan_report.py [sf_dir] [name ...]

Only the final plan of each query is shown; stages cut by checkpoints ran as
their own jobs and appear as ``Scan ExistingRDD``.
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

PATTERNS = {
    "exchange": r"\bExchange hashpartitioning",
    "round_robin": r"\bExchange RoundRobinPartitioning",
    "broadcast_join": r"BroadcastHashJoin",
    "sort_merge_join": r"SortMergeJoin",
    "window": r"\bWindow \[",
    "checkpointed_scan": r"Scan ExistingRDD",
    "parquet_scan": r"FileScan parquet|Scan parquet",
}


def main():
    from repsight.plans import QUERIES
    from repsight.session import local_session

    base = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or ["scale_frame_state", "frame_state", "pushup_form", "set_summary", "set_segments"]
    spark = local_session(8, 8)
    for name in names:
        df = QUERIES[name](spark, base)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
        schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))))
        print(name, counts)
        for sch in schemas:
            print("   ReadSchema", sch[:160])
    # column pruning of the sources: the scans run in the first (checkpointed) jobs
    from repsight.sources import adapters as A

    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for label, src in (
        ("lineitem_signal", A.lineitem_signal(spark, base)),
        ("events_signal", A.events_signal(spark, base)),
        ("set_poses", A.set_poses(spark, base)),
        ("embedding_poses", A.embedding_poses(spark, base)),
    ):
        text = src._jdf.queryExecution().explainString(mode)
        for sch in sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", text))):
            print(f"source {label:16s} ReadSchema {sch[:150]}")
    spark.stop()


if __name__ == "__main__":
    main()
