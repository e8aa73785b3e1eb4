from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablekin.operators import cells as C
from tablekin.operators import load as L
from tablekin.operators import overlap as O
from tablekin.plans.discovery import JoinDiscovery, Table, from_dumps
from tablekin.session import work_dir
from tablekin.sources import catalog as CT
from tablekin.sources import dump as D
from tablekin.sources.store import Store


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_dump_scan(spark, tmp_path):
    path = write(tmp_path / "t.txt", 'a|1|\n|2|"q\nlast||z')
    assert rows(D.dump_scan(spark, path, ["x", "y", "z"])) == [
        (1, "a", "1", None),
        (2, None, "2", '"q'),
        (3, "last", None, "z"),
    ]


@pytest.mark.parametrize("line", ["only|two", "now|there|are|four", ""])
def test_a_line_of_another_width_fails_whatever_is_asked(spark, tmp_path, line):
    path = write(tmp_path / "t.txt", f"a|1|b\n{line}\na|1|b\n")
    scan = D.dump_scan(spark, path, ["x", "y", "z"])
    for question in (scan, scan.select("x"), scan.agg(F.count(F.lit(1)))):
        with pytest.raises(Exception, match="expected 3 columns"):
            question.collect()
    width = line.count("|") + 1
    assert rows(D.bad_lines(spark, path, 3)) == [(2, width)]


def test_line_numbers_over_many_splits_and_files(spark, tmp_path):
    folder = tmp_path / "dump"
    folder.mkdir()
    for part in range(3):
        lines = [f"{part}-{i}" + "x" * (i % 50) for i in range(2000)]
        write(folder / f"part{part}.txt", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        found = D.read_lines(spark, str(folder)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    numbers = {}
    for row in found:
        part, i = row["line"].split("x")[0].split("-")
        numbers[row["row_id"]] = (int(part), int(i))
    assert [numbers[k] for k in sorted(numbers)] == [
        (p, i) for p in range(3) for i in range(2000)
    ]
    assert min(numbers) == 1 and max(numbers) == 6000


def test_row_numbers_of_parquet_files(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1000).repartition(4).write.parquet(path)
    numbered = D.with_row_number(spark.read.parquet(path), "rn")
    assert numbered.columns == ["rn", "id"]
    got = [r["rn"] for r in numbered.collect()]
    assert sorted(got) == list(range(1, 1001))


def test_dump_round_trip(spark, tmp_path, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    path = str(tmp_path / "orders")
    D.write_dump(orders, path)
    scanned = D.dump_scan(spark, path, orders.columns)
    left = C.value_sets(scanned, orders.columns)
    assert rows(left) == rows(C.value_sets(orders))


def test_store_round_trips_and_prunes(spark, tmp_path, small):
    store = Store(spark, str(tmp_path / "store"))
    orders = spark.read.parquet(f"{small}/orders.parquet")
    customer = spark.read.parquet(f"{small}/customer.parquet")
    o_sets, c_sets = C.value_sets(orders), C.value_sets(customer)
    for _ in range(2):  # writing again replaces
        store.write_value_sets(o_sets, "orders")
        store.write_value_sets(c_sets, "customer")
    assert rows(store.read_value_sets("orders")) == rows(o_sets)
    one = store.read_value_sets("orders", "o_custkey", "P2")
    expected = o_sets.filter("column_name = 'o_custkey' AND category = 'P2'")
    assert rows(one) == rows(expected)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(column_name" in plan
    index = C.value_index(orders, "o_orderkey")
    store.write_value_index(index, "orders")
    assert rows(store.read_value_index("orders")) == rows(index)
    shared = O.shared_values(o_sets, c_sets)
    store.write_shared_values(shared, "orders", "customer")
    assert rows(store.read_shared_values("orders", "customer")) == rows(shared)
    pair = shared.filter("l_col = 'o_custkey' AND r_col = 'c_custkey'")
    found = store.read_shared_values("orders", "customer", "o_custkey", "c_custkey")
    assert rows(found) == rows(pair)
    key = index.filter("column_name = 'o_custkey'").first()
    looked_up = store.read_value_index(
        "orders", "o_custkey", key["category"], match_key=key["match_key"]
    )
    same = (F.col("column_name") == "o_custkey") & (F.col("match_key") == key["match_key"])
    assert rows(looked_up) == rows(index.filter(same))


def test_store_forgets_earlier_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for value in ("x", "5"):
        df = spark.createDataFrame([(value,)], "c string")
        store.write_value_sets(C.value_sets(df), "t")
    assert [r["category"] for r in store.read_value_sets("t").collect()] == ["P1"]


def test_store_keeps_pairs_and_tables_apart(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    left = spark.createDataFrame([(1, 2), (3, 4)], "a bigint, b bigint")
    right = spark.createDataFrame([(2, 1), (4, 9)], "a bigint, b bigint")
    other = spark.createDataFrame([(7, 7)], "a bigint, b bigint")
    l_sets, r_sets, o_sets = map(C.value_sets, (left, right, other))
    store.write_shared_values(O.shared_values(l_sets, r_sets), "l", "r-s")
    store.write_shared_values(O.shared_values(o_sets, o_sets), "l-r", "s")
    found = store.read_shared_values("l", "r-s", "a", "b")
    assert rows(found, "l_col", "r_col", "match_key") == [("a", "b", "1")]
    back = store.read_shared_values("l", "r-s", "b", "a")
    assert rows(back, "match_key") == [("2",), ("4",)]
    assert store.read_shared_values("l-r", "s").count() == 4


def test_dumps_refuse_what_needs_quoting(spark, tmp_path):
    for bad in ("a|b", "a\nb"):
        df = spark.createDataFrame([(bad, "c")], "v string, w string")
        with pytest.raises(Exception, match="quoting"):
            D.write_dump(df, str(tmp_path / f"bad{len(bad)}{ord(bad[1])}"))


def test_delimiter_of_several_characters(spark, tmp_path):
    path = str(tmp_path / "wide")
    df = spark.createDataFrame([("a", None, "c|d")], "x string, y string, z string")
    D.write_dump(df, path, "||")
    scanned = D.dump_scan(spark, path, df.columns, "||")
    assert rows(scanned, *df.columns) == [("a", None, "c|d")]
    assert D.bad_lines(spark, path, 3, "||").count() == 0


def test_bucketed_sets_join_without_a_shuffle(spark, tmp_path, small):
    store = Store(spark, str(tmp_path / "store"))
    named = {}
    for name in ("orders", "customer"):
        named[name] = C.value_sets(spark.read.parquet(f"{small}/{name}.parquet"))
        store.save_bucketed_sets(named[name], f"{name}_sets", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shared = O.shared_values(
            store.read_bucketed_sets("orders_sets"),
            store.read_bucketed_sets("customer_sets"),
            bucketed=True,
        )
        plan = shared._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert rows(shared) == rows(O.shared_values(named["orders"], named["customer"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in named:
            spark.sql(f"DROP TABLE {name}_sets")


def test_work_folders_lie_under_the_shared_one(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = work_dir(spark, "x"), work_dir(spark, "x")
    assert first != second and first.startswith(root) and second.startswith(root)


def test_catalog_from_schemas(spark):
    df = spark.createDataFrame([(1, "a")], "k bigint, d string")
    tables, columns = CT.catalog(spark, {"t": df, "u": df}, schema="s")
    assert rows(tables) == [(1, "s", "t", "t.parquet"), (2, "s", "u", "u.parquet")]
    assert rows(columns, "id", "table_id", "num", "name") == [
        (1001, 1, 1, "k"),
        (1002, 1, 2, "d"),
        (2001, 2, 1, "k"),
        (2002, 2, 2, "d"),
    ]
    CT.require_complete(tables, columns.withColumnRenamed("table_id", "table_info_id"))


def test_catalog_checks(spark):
    tables = spark.createDataFrame(
        [(1, "t", "f"), (2, "", "f"), (None, "n", "f"), (4, "w", None)],
        "id bigint, name string, dumpfile string",
    )
    columns = spark.createDataFrame(
        [(1, 1, "a"), (None, 2, "b"), (3, 9, "c"), (4, None, "d")],
        "id bigint, table_info_id bigint, name string",
    )
    assert rows(CT.catalog_checks(tables, columns)) == sorted(
        [
            ("table id", "table ?:n"),
            ("table name", "table 2:"),
            ("dump file", "table 4:w"),
            ("table columns", "table ?:n"),
            ("table columns", "table 4:w"),
            ("column id", "column ?:b"),
            ("column table", "column 3:c"),
            ("column table", "column 4:d"),
        ]
    )
    with pytest.raises(CT.CatalogError, match="table"):
        CT.require_complete(tables, columns)


def test_catalog_from_tables_orders_columns_and_keeps_empty_tables(spark):
    tables = spark.createDataFrame([(1, "t", "f"), (2, "u", "g")], "id bigint, name string, dumpfile string")
    columns = spark.createDataFrame(
        [(11, 1, 2, "b"), (12, 1, 1, "a")], "id bigint, table_info_id bigint, num int, name string"
    ).selectExpr("*", "'CHAR' data_type", "1 char_length", "1 precision", "0 scale")
    found = CT.catalog_from_tables(tables, columns).collect()
    assert [(r["table_name"], r["column_name"]) for r in found] == [
        ("t", "a"),
        ("t", "b"),
        ("u", None),
    ]


def test_typed_load(spark):
    df = spark.createDataFrame(
        [(1, "abc", "12.345", "2020-01-01", "x"), (2, "abcd", "oops", "", "y")],
        "k bigint, v string, n string, d string, c string",
    )
    spec = [
        {"name": "v", "data_type": "VARCHAR2", "char_length": 3},
        {"name": "n", "data_type": "NUMBER", "precision": 6, "scale": 2},
        {"name": "d", "data_type": "DATE"},
        {"name": "c", "data_type": "CHAR", "char_length": 1},
    ]
    with pytest.raises(Exception, match="breaks the rule"):
        L.typed_load(df, "k", spec).collect()
    loaded = L.typed_load(df, "k", spec, strict=False)
    assert dict(loaded.dtypes)["n"] == "decimal(6,2)"
    assert [tuple(map(str, r)) for r in loaded.collect()] == [
        ("1", "abc", "12.35", "2020-01-01", "x"),
        ("2", "abcd", "None", "None", "y"),
    ]
    assert rows(L.load_rejects(df, "k", spec)) == [
        (1, "n", "12.345", "scale"),
        (2, "n", "oops", "number"),
        (2, "v", "abcd", "length"),
    ]
    late = spark.createDataFrame([(1, "2" * 31)], "k bigint, d string")
    kept = L.typed_load(late, "k", [{"name": "d", "data_type": "DATE"}])
    assert kept.first()["d"] == "2" * 31
    with pytest.raises(ValueError):
        L.typed_load(df, "k", [{"name": "v", "data_type": "BLOB"}])


def test_hashed_projection(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "")], "k bigint, v string")
    found = L.hashed_projection(df, "k").collect()
    assert found[0]["h_v"] == found[1]["h_v"] is not None
    assert found[2]["h_v"] is None


def test_discovery_from_scan_to_report(spark, tmp_path):
    left = spark.createDataFrame(
        [(i, i % 5, f"n{i % 7}") for i in range(30)], "a bigint, b bigint, c string"
    )
    right = spark.createDataFrame(
        [(i + 20, i % 5, f"n{i}") for i in range(12)], "x bigint, y bigint, z string"
    )
    job = JoinDiscovery(
        spark,
        Table("l", left, "a"),
        Table("r", right, "x", schema="s"),
        str(tmp_path / "job"),
    )
    direct = O.pair_overlap(C.value_sets(left), C.value_sets(right))
    assert rows(job.overlap, *sorted(direct.columns)) == rows(
        direct, *sorted(direct.columns)
    )
    assert rows(job.report(), "l_name", "r_name") == [
        ("l.a", "s.r.x"),
        ("l.a", "s.r.y"),
        ("l.b", "s.r.y"),
        ("l.c", "s.r.z"),
    ]
    assert job.row_pairs().count() == int(
        direct.agg(F.sum("row_pairs")).first()[0]
    )
    few = job.overlap.filter("row_pairs <= 12")
    listed = job.row_pairs(few).select("l_col", "r_col").distinct()
    assert rows(listed) == [("a", "x"), ("a", "y")]
    l_rows, r_rows = job.pair_rows("a", "x")
    assert rows(l_rows, "a") == rows(r_rows, "x") == [(i,) for i in range(20, 30)]
    assert job.peers().filter("row_pairs > 0").count() > 0
    assert job.scored_peers().count() > 0
    marked = job.evidence([("a", "x")]).filter("true_positive")
    assert {(r["l_col"], r["r_col"]) for r in marked.collect()} == {("a", "x")}


def test_tables_of_one_name(spark):
    left = spark.createDataFrame([(1,), (2,)], "a bigint")
    right = spark.createDataFrame([(2,), (3,)], "a bigint")
    with pytest.raises(ValueError):
        JoinDiscovery(spark, Table("t", left, "a"), Table("t", right, "a"))
    job = JoinDiscovery(spark, Table("t", left, "a", "s"), Table("t", right, "a", "z"))
    assert rows(job.overlap, "shared", "l_distinct", "r_distinct") == [(1, 2, 2)]
    job.close()


def test_discovery_from_dumps_needs_known_tables(spark, tmp_path):
    tables = spark.createDataFrame([(1, "t", str(tmp_path))], "id bigint, name string, dumpfile string")
    columns = spark.createDataFrame(
        [(11, 1, 1, "a", "CHAR", 1, 1, 0)],
        "id bigint, table_info_id bigint, num int, name string, data_type string, "
        "char_length int, precision int, scale int",
    )
    with pytest.raises(ValueError, match="no table"):
        from_dumps(spark, tables, columns, "t", "u")


NUMBERS = {
    "1.23": None, "1.239": "scale", "1.2300": None, "-0.0": None, "0.000": None, "": None,
    "1234567890123.45": None, "12345678901234.5": "precision", "+7.": None, ".5": None,
    ".": "number", "1e3": None, "12e-3": "scale", "120e-3": None, "1e20": "precision", "1e-99": "scale",
    "0e99": None, " 5 ": None, "1,5": "number", "NaN": "number", "1" * 39: "digits",
    "0." + "0" * 40 + "1": "scale", "0" * 60 + "12": None, "1" * 20 + "." + "1" * 20: "digits", "e5": "number",
}


def test_numbers_must_fit_without_loss(spark):
    spec = [{"name": "n", "data_type": "NUMBER", "precision": 15, "scale": 2}]
    df = spark.createDataFrame(list(enumerate(NUMBERS)), "k bigint, n string")
    rules = {r["value"]: r["rule"] for r in L.load_rejects(df, "k", spec).collect()}
    assert rules == {v: rule for v, rule in NUMBERS.items() if rule}
    good = df.filter(~F.col("n").isin(list(rules)))
    loaded = {r["row_id"]: r["n"] for r in L.typed_load(good, "k", spec).collect()}
    for k, text in enumerate(NUMBERS):
        if text and not NUMBERS[text]:
            assert loaded[k] == Decimal(text.strip())
    for value in ("1.239", "7.555"):
        bad = spark.createDataFrame([(1, value)], "k bigint, n string")
        with pytest.raises(Exception, match="scale"):
            L.typed_load(bad, "k", spec).collect()
    whole = [{"name": "n", "data_type": "NUMBER", "precision": 15}]
    half = spark.createDataFrame([(1, "7.5")], "k bigint, n string")
    assert rows(L.load_rejects(half, "k", whole)) == [(1, "n", "7.5", "scale")]


def test_lookup_by_key_reads_few_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # A third of all rows hold one key.
        df = spark.range(9000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
        store = Store(spark, str(tmp_path))
        index = C.value_index(df, "k")
        store.write_value_index(index, "t")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted(tmp_path.glob("value_index/t/**/*.parquet"))
    spans = {}
    for file in files:
        column = pq.ParquetFile(file).metadata.row_group(0)
        at = [i for i in range(column.num_columns) if column.column(i).path_in_schema == "match_key"][0]
        spans[file] = (column.column(at).statistics.min, column.column(at).statistics.max)
    holding = [f for f, (low, high) in spans.items() if low <= "1234" <= high]
    assert len(files) >= 8 and len(holding) <= 2
    # The frequent key is spread over files.
    assert len([f for f, (low, high) in spans.items() if low <= "7" <= high and "column_name=v" in str(f)]) >= 2
    found = store.read_value_index("t", match_key="1234")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(match_key,1234)" in plan
    assert rows(found) == rows(index.filter("match_key = '1234'"))
    assert store.read_value_index("t", column="v", match_key="7").count() == 3000 + 1


def test_bucketed_sets_are_compared_without_a_shuffle(spark, small):
    from tablekin.plans.queries import QUERIES

    plan = QUERIES["bucketed_overlap"](spark, small)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("SortMergeJoin") if "SortMergeJoin" in plan else plan.index("HashJoin"):]
    assert "Exchange hashpartitioning" not in below


def _loads(spark):
    parts = {"a": [(1, "x"), (1, None)], "b/2=": [(1, "y"), (2, "x")], "c": [(3, "x")]}
    return {k: spark.createDataFrame(v, "n bigint, t string") for k, v in parts.items()}


def test_loads_add_up_to_a_full_build(spark, tmp_path):
    store, loads = Store(spark, str(tmp_path / "store")), _loads(spark)
    seen = None
    for name, part in loads.items():
        store.add_value_sets(C.value_sets(part), "t", name)
        seen = part if seen is None else seen.unionByName(part)
        assert rows(store.read_added_value_sets("t")) == rows(C.value_sets(seen))
        store.compact_value_sets("t")
        store.compact_value_sets("t")  # nothing new: changes nothing
        assert rows(store.read_added_value_sets("t")) == rows(C.value_sets(seen))
        one = store.read_added_value_sets("t", "n")
        assert rows(one) == rows(C.value_sets(seen, ["n"]))


def test_a_load_written_again_counts_once(spark, tmp_path):
    store, loads = Store(spark, str(tmp_path / "store")), _loads(spark)
    full = rows(C.value_sets(loads["a"].unionByName(loads["c"])))
    store.add_value_sets(C.value_sets(loads["a"]), "t", "a")
    store.add_value_sets(C.value_sets(loads["b/2="]), "t", "c")  # wrong rows, replaced by the next line
    store.add_value_sets(C.value_sets(loads["c"]), "t", "c")
    assert rows(store.read_added_value_sets("t")) == full
    store.compact_value_sets("t")
    store.add_value_sets(C.value_sets(loads["a"]), "t", "a")  # merged already
    assert rows(store.read_added_value_sets("t")) == full


def test_what_a_lost_run_leaves_behind_is_not_read(spark, tmp_path):
    """A load that is lost is written again; a compaction that dies changes nothing."""
    import shutil

    store, loads = Store(spark, str(tmp_path / "store")), _loads(spark)
    for name in ("a", "c"):
        store.add_value_sets(C.value_sets(loads[name]), "t", name)
    full = rows(store.read_added_value_sets("t"))
    shutil.rmtree(tmp_path / "store" / "value_set_runs" / "t" / "load=c")
    store.add_value_sets(C.value_sets(loads["c"]), "t", "c")
    assert rows(store.read_added_value_sets("t")) == full
    store._write(C.value_sets(loads["b/2="]), store._generation("t", 1), "column_name")  # never listed
    assert rows(store.read_added_value_sets("t")) == full
    store.compact_value_sets("t")
    shutil.rmtree(tmp_path / "store" / "value_set_runs" / "t" / "load=c")  # no longer needed
    assert rows(store.read_added_value_sets("t")) == full


def test_tasks_of_large_tables_stay_small(spark, tmp_path):
    """What a task reads is bounded, and shuffles begin with parts by the size of a scan."""
    from tablekin import session
    from tablekin.plans.queries import table

    keys = (*session.MOST_BYTES, "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        for key in session.MOST_BYTES:
            spark.conf.set(key, "128MB")
        session.prepare(spark)
        assert {key: int(spark.conf.get(key)) for key in session.MOST_BYTES} == session.MOST_BYTES
        spark.conf.set(keys[0], "64k")
        session.prepare(spark)
        assert spark.conf.get(keys[0]) == "64k"
        spark.range(40_000).repartition(8).write.parquet(f"{tmp_path}/t.parquet")
        splits = table(spark, str(tmp_path), "t").rdd.getNumPartitions()
        assert int(spark.conf.get(keys[-1])) >= session.PARTS_PER_SPLIT * splits
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_plain_numbers_are_told_without_a_pattern(spark):
    texts = ["0", "00", "12", "123", "1.2", "12.", ".5", "1.23", ".", "1.2.3", "-1", "+1", " 1", "1e1", "x", "9" * 40, "0" * 40, "12.30", "٣"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    plain = L._plainly_fits(F.col("v"), 4, 2).alias("plain")
    rule = L.broken_rule(F.col("v"), {"name": "v", "data_type": "NUMBER", "precision": 4, "scale": 2}).alias("rule")
    told = {r["v"]: (r["plain"], r["rule"]) for r in df.select("v", plain, rule).collect()}
    assert {v for v, (fits, _) in told.items() if fits} == {"0", "00", "12", "1.2", "12.", ".5", "1.23", "12.30"}
    assert all(rule is None for fits, rule in told.values() if fits)
    assert {v: told[v][1] for v in (".", "123", "9" * 40, "0" * 40, "-1", "1e1", "x", "٣")} == {
        ".": "number", "123": "precision", "9" * 40: "digits", "0" * 40: None, "-1": None, "1e1": None, "x": "number", "٣": "number",
    }
