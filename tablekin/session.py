"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    # Timestamps are profiled through their text, so the zone must be fixed.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


#: Most bytes that one task reads, of files and of a shuffle, as they lie compressed. Rows of
#: numbers take forty times as much when a task groups or sorts them, so these bound its
#: memory, however large the table.
MOST_BYTES = {
    "spark.sql.files.maxPartitionBytes": 16 * 2**20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 * 2**20,
}
#: Shuffle partitions per split of a scan before small ones are merged.
PARTS_PER_SPLIT = 24
_UNITS = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"\s*([0-9]+)\s*([a-z]?)b?\s*", text.lower()).groups()
    return int(number) << _UNITS[unit]


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings of this package to a session builder."""
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return builder


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    for key, most in MOST_BYTES.items():
        if _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    return spark


def divided(scan: DataFrame) -> DataFrame:
    """Let shuffles begin with partitions in proportion to the splits of a scan.

    A fixed number of them makes each grow with the table, and with it the memory of its
    task. Adaptive execution merges those that turn out small, so a small table loses
    nothing. The number only ever rises in a session.
    """
    spark, name = scan.sparkSession, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    told = int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = PARTS_PER_SPLIT * scan.rdd.getNumPartitions()
    if wanted > told:
        spark.conf.set(name, str(wanted))
    return scan


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only a local master may
    run without it; there a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="tablekin-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work folder, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def _changed(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    told = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if told is None else spark.conf.set(name, told)


def lies_with(spark: SparkSession):
    """Lets rows that lie with one of their keys be joined on several keys where they lie.

    Else they would be shuffled once more, by all keys of the join.
    """
    return _changed(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def settle(df: DataFrame, label: str, root: str | None = None) -> DataFrame:
    """Write a result that is used several times and go on from the files.

    Executors may be lost at any later point; only files are read again then. The
    files lie below ``root`` if it is given. What was shuffled for them is dropped at once.
    """
    path = f"{root}/{label}-{uuid.uuid4().hex}" if root else work_dir(df.sparkSession, label)
    with _changed(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a small scan out over all cores.

    For work that multiplies rows. A scan that already has a split per core, as
    any large one does, is left alone. Pass only what is read from files as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
