"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tablesync.operators.verify import verify_full  # noqa: E402
from tablesync.sinks.files import stage  # noqa: E402
from tablesync.sinks.snapshot import SnapshotTarget  # noqa: E402
from tablesync.sources.folders import fresh_folder  # noqa: E402
from tablesync.workload import fixtures as fx  # noqa: E402
from tablesync.workload.queries import REGISTRY  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "scan_full", "scan_by_keys", "changes_since", "changed_keys", "change_summary", "apply_counts", "delete_by_keys",
    "replace_by_keys", "replace_by_keys_window", "apply_ops", "row_hash", "row_hash_documents", "tsv_encode",
    "tail_by_key", "verify_tail", "verify_buckets", "verify_full", "verify_full_documents", "validate_schema",
    "recent_logs", "recent_logs_literal", "recent_errors", "sync_summary", "full_sync", "cdc_sync", "stream_sync",
]
# Share of the keys that changed, in one of so many.
SHARES = {"replace_0.1pct": 1000, "replace_1pct": 100, "replace_30pct": 3}


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tablesync-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(job) -> float:
    """Shortest of the runs after one run that warms up."""
    times = []
    for _ in range(RUNS + 1):
        begun = time.perf_counter()
        job()
        times.append(time.perf_counter() - begun)
    return round(min(times[1:]), 3)


def replace_times(spark: SparkSession) -> dict[str, float]:
    """One pass over a published target with a given share of changed keys, and the check of the result."""
    src = fx.replication(spark, SF_DIR).src
    target = SnapshotTarget(spark, fresh_folder(spark, "bench"), fx.KEY, 8)
    target.overwrite(src)
    times = {}
    for name, one_of in SHARES.items():
        keys = stage(src.where(F.pmod(F.hash(fx.KEY), F.lit(one_of)) == 0).select(fx.KEY), fresh_folder(spark, "keys"))
        times[name] = best(lambda keys=keys: target.replace_by_keys(src, keys))
    if verify_full(src, target.read(), fx.KEY).count():
        raise RuntimeError("the target differs from its source")
    return times


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: best(lambda name=name: run(REGISTRY[name](spark, SF_DIR))) for name in HEADLINE}
    times |= replace_times(spark)
    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
