"""Join discovery between two tables, from scan to report."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekin.operators import cells as C
from tablekin.operators import overlap as O
from tablekin.operators import peers as P
from tablekin.operators import rows as R
from tablekin.session import remove, settle, work_dir
from tablekin.sources.catalog import catalog_from_tables, require_complete
from tablekin.sources.dump import dump_scan
from tablekin.sources.store import Store


@dataclass
class Table:
    """A DataFrame with its name and the column that tells its rows apart."""

    name: str
    df: DataFrame
    row_id: str
    schema: str = ""
    columns: list[str] | None = None

    def described(self) -> DataFrame:
        """The columns to compare; all scalar ones unless some are named."""
        return self.df.select([C.quoted(c) for c in self.columns or C.scalar_columns(self.df)])


class JoinDiscovery:
    """Profiles two tables once, stores the result and answers from it.

    Value sets and value indexes are written to a shared folder before anything
    is joined: every later question reads them back instead of the tables, and
    a lost executor costs only the files being read. Each side has its own place
    there, whatever the tables are called. ``close`` removes the folder unless it was
    given; answers not yet written are gone with it.
    """

    def __init__(
        self, spark: SparkSession, left: Table, right: Table, root: str | None = None
    ):
        same = (left.schema, left.name) == (right.schema, right.name)
        if same and left.df is not right.df and not left.df.sameSemantics(right.df):
            raise ValueError(f"two different tables are called {left.name}")
        self.spark, self.left, self.right = spark, left, right
        self.own = root is None
        self.root = root or work_dir(spark, "discovery")
        self.store = Store(spark, self.root)
        self.sets = {}
        for side, table in self._named():
            self.store.write_value_sets(C.value_sets(table.df, table.columns), side)
            self.sets[side] = self.store.read_value_sets(side)
        self._indexed: set[str] = set()

    def _named(self) -> list[tuple[str, Table]]:
        return [
            (f"{side} {table.schema}.{table.name}", table)
            for side, table in (("left", self.left), ("right", self.right))
        ]

    @property
    def l_sets(self) -> DataFrame:
        return self.sets[self._named()[0][0]]

    @property
    def r_sets(self) -> DataFrame:
        return self.sets[self._named()[1][0]]

    def close(self) -> None:
        """Remove what the job has written to a folder of its own."""
        if self.own:
            remove(self.spark, self.root)

    @cached_property
    def overlap(self) -> DataFrame:
        """Overlapping column pairs; computed once, as everything else asks it."""
        found = O.pair_overlap(self.l_sets, self.r_sets, stored=True)
        return settle(found, "overlap", self.root)

    def report(self) -> DataFrame:
        return O.match_report(
            self.overlap,
            self.left.name,
            self.right.name,
            self.left.schema,
            self.right.schema,
        )

    def sides(self) -> tuple[R.Side, R.Side]:
        """Both tables with their row numbers; writes the indexes when first asked."""
        made = []
        for side, table in self._named():
            if side not in self._indexed:
                index = C.value_index(table.df, table.row_id, table.columns)
                self.store.write_value_index(index, side)
                self._indexed.add(side)
            row_type = table.df.schema[table.row_id].dataType.simpleString()
            index = self.store.read_value_index(side, row_type=row_type)
            made.append(R.Side(index, self.sets[side]))
        return made[0], made[1]

    def row_pairs(self, pairs: DataFrame | None = None) -> DataFrame:
        """Row pairs of all column pairs, or of the chosen ones.

        ``overlap`` says beforehand how many there are of each.
        """
        return R.row_pairs(*self.sides(), pairs=pairs)

    def pair_rows(self, l_col: str, r_col: str) -> tuple[DataFrame, DataFrame]:
        """Full rows of the left and of the right table behind one column pair."""
        left, right = self.sides()
        return (
            R.fetch_pair_rows(
                self.left.df, self.left.row_id, left, self.r_sets, l_col, r_col
            ),
            R.fetch_pair_rows(
                self.right.df, self.right.row_id, right, self.l_sets, r_col, l_col
            ),
        )

    def peers(self) -> DataFrame:
        """Row pairs every two peers have in common."""
        return P.peer_row_overlap(
            self.left.described(), self.right.described(), self.overlap, self.l_sets, self.r_sets
        )

    def scored_peers(self) -> DataFrame:
        return P.peer_score(P.peer_containment(*self.sides()))

    def evidence(self, truth: Iterable[tuple[str, str]] = ()) -> DataFrame:
        """Pairs and their peers with rows, containment, score and known truth."""
        return P.evidence_report(*self.sides(), truth)


def from_dumps(
    spark: SparkSession,
    table_info: DataFrame,
    column_info: DataFrame,
    left: str,
    right: str,
    root: str | None = None,
) -> JoinDiscovery:
    """Discovery between two described tables whose rows lie in dumps.

    The descriptions, which must be complete, are those of ``catalog_from_tables``;
    a row is known by its number in the dump.
    """
    wanted = table_info.filter(F.col("name").isin(left, right))
    of_wanted = wanted.select(F.col("id").alias("table_info_id"))
    columns = column_info.join(of_wanted, "table_info_id", "left_semi")
    require_complete(wanted, columns)
    described = catalog_from_tables(wanted, columns).collect()
    tables = []
    for name in (left, right):
        rows = sorted((r for r in described if r["table_name"] == name), key=lambda r: r["num"])
        if not rows:
            raise ValueError(f"no table is called {name}")
        columns = [r["column_name"] for r in rows]
        df = dump_scan(spark, rows[0]["dumpfile"], columns)
        tables.append(Table(name, df, "row_id", columns=columns))
    return JoinDiscovery(spark, *tables, root=root)
