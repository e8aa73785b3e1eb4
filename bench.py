"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the folder of Parquet tables, ``BENCH_CPUS`` the local cores.
Every query writes to the no-op sink, so each row is computed and none is
collected. Each query runs ``BENCH_RUNS`` times, two by default, and the fastest run
counts; before that the first two run once unmeasured. Both keep class loading and
compilation, which a long-lived session pays once, out of the figures.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tablekin.plans.queries import QUERIES  # noqa: E402
from tablekin.session import configure  # noqa: E402

HEADLINES = [
    "pair_overlap",
    "pair_overlap_orders_lineitem",
    "pair_overlap_documents_labels",
    "value_sets",
    "value_sets_text",
    "match_key",
    "value_index",
    "row_pair_count",
    "row_pairs",
    "matched_rows",
    "peer_row_overlap",
    "peer_row_overlap_orders_lineitem",
    "peer_containment",
    "column_profile",
    "distinct_counts",
    "join_discovery",
    "catalog_overlap",
    "evidence_report",
    "row_pairs_chosen",
    "value_index_lookup",
    "bucketed_overlap",
    "distinct_sketches",
    "dump_scan",
    "set_intersect",
    "set_comparison",
    "set_next",
    "set_complement",
    "bitmap_encode",
    "bitmap_xor",
]


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablekin-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    for name in HEADLINES[:2]:
        run(spark, sf_dir, name)
    seconds = {
        name: round(min(run(spark, sf_dir, name) for _ in range(runs)), 3)
        for name in HEADLINES
    }
    scale = Path(sf_dir).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline queries, total of the fastest runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
