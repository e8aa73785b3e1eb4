"""Stored value sets, value indexes and shared values.

Everything is Parquet, a folder per table or pair of tables and below it one per column
and class letter. Writing replaces the whole folder of its table or pair, so nothing of
an earlier run stays behind. The full category, which holds the byte length, stays a
data column: with free text there are tens of thousands of lengths, too many for
folders. Rows are rebalanced by layout before writing, which cuts a large column into
several files and keeps a small one in a single file. A value index is written by ranges
of keys instead, with Bloom filters on them, so that a look-up by key opens few files and
few parts of them.

Tables that grow need no full rewrite: value sets can be added load by load, are merged
when read, and compacted now and then.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETS = (
    "category string, match_key string, n bigint, column_name string, letter string"
)
COMPACTED = "generation int, load string"
INDEX = (
    "category string, match_key string, row_id {row_type}, "
    "column_name string, letter string"
)
PAIRS = (
    "category string, match_key string, l_n bigint, r_n bigint, "
    "l_col string, r_col string, letter string"
)


class Store:
    """Intermediate results under one folder every executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, kind: str, *names: str) -> str:
        return "/".join([self.root, kind, *(quote(n, safe="") for n in names)])

    def _write(self, df: DataFrame, folder: str, *layout: str) -> None:
        lettered = df.withColumn("letter", F.substring("category", 1, 1))
        parts = [*layout, "letter"]
        (
            lettered.hint("rebalance", *parts)
            .sortWithinPartitions(*parts, "category")
            .write.partitionBy(*parts)
            .option("partitionOverwriteMode", "static")
            .mode("overwrite")
            .parquet(folder)
        )

    def _read(self, folder: str, schema: str, **wanted: str | None) -> DataFrame:
        df = self.spark.read.schema(schema).parquet(folder)
        category = wanted.pop("category", None)
        for column, value in wanted.items():
            if value is not None:
                df = df.filter(F.col(column) == value)
        if category is not None:
            df = df.filter(
                (F.col("letter") == category[:1]) & (F.col("category") == category)
            )
        return df.drop("letter")

    def write_value_sets(self, sets: DataFrame, table: str) -> None:
        self._write(sets, self._folder("value_sets", table), "column_name")

    def read_value_sets(
        self, table: str, column: str | None = None, category: str | None = None
    ) -> DataFrame:
        folder = self._folder("value_sets", table)
        found = self._read(folder, SETS, column_name=column, category=category)
        return found.select("column_name", "category", "match_key", "n")

    def add_value_sets(self, sets: DataFrame, table: str, load: str) -> None:
        """Store the counts of one load of rows beside those of earlier loads.

        Only the new rows are grouped and written; nothing stored is touched. A load
        that failed, or of which a part was lost, is written again under its name and
        takes its own place. What a compaction has taken in already is not counted twice.
        """
        empty = self.spark.createDataFrame([], COMPACTED)
        empty.write.mode("ignore").parquet(self._folder("value_set_compacted", table))
        run = f"{self._folder('value_set_runs', table)}/load={quote(load, safe='')}"
        self._write(sets, run, "column_name")

    def _compacted(self, table: str) -> tuple[int, list[str]]:
        """The last whole generation of merged loads and the loads in it: a row each."""
        folder = self._folder("value_set_compacted", table)
        listed = self.spark.read.schema(COMPACTED).parquet(folder).collect()
        last = max((r["generation"] for r in listed), default=0)
        return last, [r["load"] for r in listed if r["generation"] == last]

    def _generation(self, table: str, number: int) -> str:
        return self._folder("value_set_generations", table) + f"/{number}"

    def _runs(self, table: str) -> DataFrame:
        schema = f"{SETS}, load string"
        return self.spark.read.schema(schema).parquet(self._folder("value_set_runs", table))

    def read_added_value_sets(self, table: str, column: str | None = None) -> DataFrame:
        """Value sets of all loads together, as a full build gives them.

        Counts of the last compaction and of the loads after it are added up by one
        grouping; the loads before it are left out by their folders.
        """
        generation, taken_in = self._compacted(table)
        found = self._runs(table)
        if taken_in:
            found = found.filter(~F.col("load").isin(taken_in))
        return self._merged(table, generation, found, column)

    def _merged(self, table: str, generation: int, runs: DataFrame, column: str | None = None) -> DataFrame:
        names = ["column_name", "category", "match_key"]
        found = runs.select(*names, "n")
        if generation:
            merged = self.spark.read.schema(SETS).parquet(self._generation(table, generation))
            found = merged.select(*names, "n").unionByName(found)
        if column is not None:
            found = found.filter(F.col("column_name") == column)
        return found.groupBy(*names).agg(F.sum("n").alias("n"))

    def compact_value_sets(self, table: str) -> None:
        """Merge all loads so far into a new generation.

        The loads that go into it are named first, so one that is added meanwhile stays
        a run of its own. The generation counts only once it is listed, which is the last
        step: a compaction that fails leaves everything as it was, and the next one
        writes over its remains. Earlier generations stay for readers that began before.
        """
        generation, taken_in = self._compacted(table)
        loads = [r["load"] for r in self._runs(table).select("load").distinct().collect()]
        new = sorted(set(loads) - set(taken_in))
        if not new:
            return
        merged = self._merged(table, generation, self._runs(table).filter(F.col("load").isin(new)))
        self._write(merged, self._generation(table, generation + 1), "column_name")
        listed = [(generation + 1, load) for load in [*taken_in, *new]]
        (
            self.spark.createDataFrame(listed, COMPACTED).coalesce(1)
            .write.mode("append").parquet(self._folder("value_set_compacted", table))
        )

    def write_value_index(
        self, index: DataFrame, table: str, distinct_keys: int = 1_000_000
    ) -> None:
        """Cells in order of their keys, a range of them per file.

        The row takes part in the ranges, so a key that a large part of the table holds
        spreads over several files. ``distinct_keys`` sizes the Bloom filters of a file.
        """
        parts = ["column_name", "letter"]
        lettered = index.withColumn("letter", F.substring("category", 1, 1))
        (
            lettered.repartitionByRange(*parts, "match_key", F.xxhash64("row_id"))
            .sortWithinPartitions(*parts, "match_key", "category")
            .write.partitionBy(*parts)
            .option("partitionOverwriteMode", "static")
            .option("parquet.bloom.filter.enabled#match_key", "true")
            .option("parquet.bloom.filter.expected.ndv#match_key", str(distinct_keys))
            .mode("overwrite")
            .parquet(self._folder("value_index", table))
        )

    def read_value_index(
        self,
        table: str,
        column: str | None = None,
        category: str | None = None,
        row_type: str = "bigint",
        match_key: str | None = None,
    ) -> DataFrame:
        """Cells of a table, of one column, category or key where these are given.

        A key is compared in the scan, which skips files and row groups whose range or
        Bloom filter does not hold it.
        """
        found = self._read(
            self._folder("value_index", table),
            INDEX.format(row_type=row_type),
            column_name=column,
            category=category,
            match_key=match_key,
        )
        return found.select("row_id", "column_name", "category", "match_key")

    def add_sketches(self, sketches: DataFrame, table: str) -> None:
        """Put the sketches of a part of a table beside those of its other parts."""
        sketches.write.mode("append").parquet(self._folder("sketches", table))

    def read_sketches(self, table: str) -> DataFrame:
        """The sketches of all parts, to be merged: ``(column_name, sketch)``."""
        schema = "column_name string, sketch binary"
        return self.spark.read.schema(schema).parquet(self._folder("sketches", table))

    def write_shared_values(
        self, shared: DataFrame, l_table: str, r_table: str
    ) -> None:
        folder = self._folder("shared_values", l_table, r_table)
        self._write(shared, folder, "l_col", "r_col")

    def read_shared_values(
        self,
        l_table: str,
        r_table: str,
        l_col: str | None = None,
        r_col: str | None = None,
        category: str | None = None,
    ) -> DataFrame:
        """Shared values of two tables, of one column on either side where given."""
        folder = self._folder("shared_values", l_table, r_table)
        found = self._read(folder, PAIRS, l_col=l_col, r_col=r_col, category=category)
        return found.select("l_col", "r_col", "category", "match_key", "l_n", "r_n")

    def save_bucketed_sets(self, sets: DataFrame, name: str, buckets: int) -> None:
        """Keep value sets as a table bucketed by what they are joined on.

        Tables of equally many buckets are then compared without a shuffle, which
        pays when many tables are compared with one another. A key occurs once
        per column in value sets, so buckets are even whatever the data.
        """
        (
            sets.repartition(buckets, "category", "match_key")
            .write.bucketBy(buckets, "category", "match_key")
            .sortBy("category", "match_key")
            .option("path", f"{self.root}/bucketed/{name}")
            .mode("overwrite")
            .saveAsTable(name)
        )

    def read_bucketed_sets(self, name: str) -> DataFrame:
        return self.spark.table(name)
