"""Compare every registered query with its SQL twin: ``check_oracles.py [dir] [names]``.

Prints one line per query: time, rows on both sides and whether they agree.
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tablekin.session import configure


SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def normal(value):
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def compare(spark, sf_dir, name, run, sql):
    start = time.time()
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    spark_types = dict(df.dtypes)
    ours = Counter(
        tuple(normal(row[c]) for c in columns) for row in df.select(columns).collect()
    )
    took = time.time() - start
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    order = [names.index(c) for c in columns] if sorted(names) == columns else None
    if order is None:
        return took, f"COLUMNS {columns} {sorted(names)}"
    odd = {c: (spark_types[c], types[c]) for c in columns if SAME_TYPE[spark_types[c]] != types[c]}
    if odd:
        return took, f"TYPES {odd}"
    theirs = Counter(tuple(normal(row[i]) for i in order) for row in cursor.fetchall())
    if ours == theirs:
        return took, f"ok {sum(ours.values())} rows"
    return took, (
        f"DIFFER {sum(ours.values())} {sum(theirs.values())}\n"
        f"  spark {spark_types} {list((ours - theirs).items())[:3]}\n"
        f"  sql   {types} {list((theirs - ours).items())[:3]}"
    )


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    builder = SparkSession.builder.master("local[8]").config(
        "spark.sql.shuffle.partitions", "8"
    )
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", "12g")
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sqls, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            took, verdict = compare(spark, sf_dir, name, run, sqls[name])
        except Exception as error:  # report and go on with the next query
            took, verdict = 0.0, f"ERROR {type(error).__name__} {str(error)[:600]}"
        bad += not verdict.startswith("ok")
        print(f"{name:40s} {took:6.2f}s {verdict}", flush=True)
    print("missing SQL:", sorted(set(entry.queries()) - set(sqls)))
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
