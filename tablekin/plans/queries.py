"""One query per operator, each over whole tables of a folder of Parquet files.

Counts of row pairs leave Spark as text where they may pass 64 bits: they are
exact decimals inside, and text is the one form every client reads alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekin.functions import ids, values, words
from tablekin.operators import cells as C
from tablekin.operators import intset as I
from tablekin.operators import load as L
from tablekin.operators import overlap as O
from tablekin.operators import peers as P
from tablekin.operators import profile as PR
from tablekin.operators import rows as R
from tablekin.plans.discovery import JoinDiscovery, Table, from_dumps
from tablekin.session import divided, prepare, settle, spread, work_dir
from tablekin.sources import catalog as CT
from tablekin.sources import dump as D
from tablekin.sources.store import Store

ROW_IDS = {
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "orders": "o_orderkey",
    "part": "p_partkey",
    "documents": "doc_id",
    "labels": "doc_id",
    "events": "event_id",
}
ORDER_MATCHES = [
    ("o_orderkey", "l_orderkey"),
    ("o_orderstatus", "l_linestatus"),
    ("o_orderdate", "l_shipdate"),
]
# Declared types of the orders columns, as a source system would state them.
DECLARED_ORDERS = [
    {"name": "o_orderkey", "data_type": "NUMBER", "precision": 18, "scale": 0},
    {"name": "o_custkey", "data_type": "NUMERIC", "precision": 18, "scale": 0},
    {"name": "o_orderstatus", "data_type": "CHAR", "char_length": 1},
    {"name": "o_totalprice", "data_type": "NUMBER", "precision": 15, "scale": 2},
    {"name": "o_orderdate", "data_type": "DATE"},
    {"name": "o_orderpriority", "data_type": "VARCHAR2", "char_length": 8},
]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return divided(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def sets(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return C.value_sets(table(spark, sf_dir, name))


def side(spark: SparkSession, sf_dir: str, name: str) -> R.Side:
    return R.Side.of(table(spark, sf_dir, name), ROW_IDS[name])


def overlap_of(spark: SparkSession, sf_dir: str, left: str, right: str) -> DataFrame:
    found = O.pair_overlap(sets(spark, sf_dir, left), sets(spark, sf_dir, right))
    return _overlap_columns(found)


def _overlap_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "l_col",
        "r_col",
        "shared",
        F.col("row_pairs").cast("string").alias("row_pairs"),
        "l_distinct",
        "r_distinct",
        "l_ratio",
        "r_ratio",
    )


def integers(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    return I.set_build(table(spark, sf_dir, name), column)


def probes(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(column).cast("bigint").alias("n"))


def _order_customers(spark, sf_dir):
    return integers(spark, sf_dir, "orders", "o_custkey")


def _line_suppliers(spark, sf_dir):
    return integers(spark, sf_dir, "lineitem", "l_suppkey")


def _parts(spark, sf_dir):
    return integers(spark, sf_dir, "part", "p_partkey")


def _line_orders(spark, sf_dir):
    """Order keys of all lines; some orders have none, which leaves gaps."""
    return integers(spark, sf_dir, "lineitem", "l_orderkey")


def _label_documents(spark, sf_dir):
    """Keys of all labelled documents, which overlap the order keys in part."""
    return integers(spark, sf_dir, "labels", "doc_id")


# Column pairs -----------------------------------------------------------------


@query
def q_pair_overlap(spark, sf_dir):
    return overlap_of(spark, sf_dir, "customer", "supplier")


@query
def q_pair_overlap_orders_lineitem(spark, sf_dir):
    return overlap_of(spark, sf_dir, "orders", "lineitem")


@query
def q_pair_overlap_documents_labels(spark, sf_dir):
    return overlap_of(spark, sf_dir, "documents", "labels")


@query
def q_pair_overlap_events_customer(spark, sf_dir):
    return overlap_of(spark, sf_dir, "events", "customer")


@query
def q_match_report(spark, sf_dir):
    found = O.pair_overlap(
        sets(spark, sf_dir, "orders"), sets(spark, sf_dir, "lineitem")
    )
    return O.match_report(found, "orders", "lineitem", r_schema="sales")


@query
def q_candidate_pairs(spark, sf_dir):
    left, right = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    found = O.pair_overlap(C.value_sets(left), C.value_sets(right))
    candidates = O.candidate_pairs(
        spark, C.scalar_columns(left), C.scalar_columns(right)
    )
    return O.scored_candidates(candidates, found)


@query
def q_common_categories(spark, sf_dir):
    return O.common_categories(
        sets(spark, sf_dir, "orders"), sets(spark, sf_dir, "lineitem")
    )


@query
def q_shared_per_category(spark, sf_dir):
    found = O.shared_per_category(
        sets(spark, sf_dir, "orders"), sets(spark, sf_dir, "lineitem")
    )
    return found.withColumn("row_pairs", F.col("row_pairs").cast("string"))


@query
def q_shared_values(spark, sf_dir):
    return O.shared_values(
        sets(spark, sf_dir, "orders"), sets(spark, sf_dir, "lineitem")
    )


@query
def q_truth_flag(spark, sf_dir):
    found = O.pair_overlap(
        sets(spark, sf_dir, "orders"), sets(spark, sf_dir, "lineitem")
    )
    return O.truth_flag(spark, found, ORDER_MATCHES).select(
        "l_col", "r_col", "shared", "true_positive"
    )


@query
def q_join_discovery(spark, sf_dir):
    job = JoinDiscovery(
        spark,
        Table("orders", table(spark, sf_dir, "orders"), "o_orderkey"),
        Table("customer", table(spark, sf_dir, "customer"), "c_custkey"),
    )
    return job.report()


def _from_dumps(spark, sf_dir, left, right):
    root = work_dir(prepare(spark), "dumps")
    named = {n: table(spark, sf_dir, n) for n in (left, right)}
    for name, df in named.items():
        D.write_dump(df, f"{root}/{name}")
    tables, columns = CT.catalog(spark, named)
    tables = tables.withColumn("dumpfile", F.concat(F.lit(f"{root}/"), "name"))
    columns = columns.withColumnRenamed("table_id", "table_info_id")
    return from_dumps(spark, tables, columns, left, right)


@query
def q_discovery_from_dumps(spark, sf_dir):
    """The whole way: dumps and their descriptions, value sets, report."""
    return _from_dumps(spark, sf_dir, "orders", "customer").report()


@query
def q_evidence_from_dumps(spark, sf_dir):
    """As far as it goes: from dumps to the evidence for and against each column pair."""
    known = [("c_nationkey", "s_nationkey")]
    return _from_dumps(spark, sf_dir, "customer", "supplier").evidence(known)


# Cells and value sets ---------------------------------------------------------


CATALOG = (
    "benchmark conversations customer documents embeddings events labels lineitem nation "
    "orders pages part region supplier"
).split()


@query
def q_catalog_overlap(spark, sf_dir):
    """All tables against all: columns of any two that share values."""
    every = O.catalog_sets({name: sets(spark, sf_dir, name) for name in CATALOG})
    return O.catalog_overlap(settle(every, "catalog"))


@query
def q_cells(spark, sf_dir):
    return C.cells(table(spark, sf_dir, "customer"), "c_custkey")


@query
def q_drop_empty(spark, sf_dir):
    """Cells left per column when empty ones are skipped.

    The tables have none, so some are made: names and brands that start in one way
    are emptied.
    """
    part = table(spark, sf_dir, "part").withColumns(
        {
            "p_name": F.regexp_replace("p_name", "^(small|red) .*", ""),
            "p_brand": F.regexp_replace("p_brand", "^Brand#1.*", ""),
        }
    )
    found = C.cells(part, "p_partkey")
    return found.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_cells"))


def _tokens(spark, sf_dir):
    text = table(spark, sf_dir, "documents").select(
        F.explode(F.split("text", " ", -1)).alias("token")
    )
    return text.filter("token <> ''")


@query
def q_value_category(spark, sf_dir):
    category = values.value_category(F.col("token")).alias("category")
    return (
        _tokens(spark, sf_dir)
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(category, "n")
        .groupBy("category")
        .agg(F.sum("n").alias("n"))
    )


@query
def q_match_key(spark, sf_dir):
    token = F.col("token")
    counted = _tokens(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.select(
            values.value_category(token).alias("category"),
            values.match_key(token).alias("match_key"),
            "n",
        )
        .groupBy("category", "match_key")
        .agg(F.sum("n").alias("n"))
    )


@query
def q_value_sets(spark, sf_dir):
    return sets(spark, sf_dir, "lineitem")


@query
def q_value_sets_text(spark, sf_dir):
    return sets(spark, sf_dir, "documents")


@query
def q_category_summary(spark, sf_dir):
    return C.category_summary(sets(spark, sf_dir, "lineitem"))


@query
def q_column_categories(spark, sf_dir):
    found = C.column_categories(sets(spark, sf_dir, "events"))
    return found.select(
        "column_name", F.concat_ws(",", "categories").alias("categories")
    )


@query
def q_prototype_single_column(spark, sf_dir):
    return C.single_column_set(table(spark, sf_dir, "lineitem"), "l_shipdate")


@query
def q_bucket_of(spark, sf_dir):
    """Buckets of all keys; those of integers have one, other keys none."""
    found = sets(spark, sf_dir, "lineitem")
    whole = F.when(F.substring("category", 1, 1).isin("P", "N"), F.col("match_key"))
    bucket = values.bucket_of(whole.cast("bigint")).alias("bucket")
    return found.groupBy("column_name", bucket).agg(
        F.count(F.lit(1)).alias("distinct_keys")
    )


@query
def q_text_bucket_of(spark, sf_dir):
    """Keys per column when spread over buckets and added up again."""
    found = sets(spark, sf_dir, "documents")
    bucket = values.text_bucket_of(F.col("match_key")).alias("bucket")
    per_bucket = found.groupBy("column_name", bucket).agg(
        F.count(F.lit(1)).alias("keys")
    )
    return per_bucket.groupBy("column_name").agg(
        F.sum("keys").alias("distinct_keys"),
        (F.max(F.length("bucket")) <= 2).alias("fits_a_byte"),
    )


@query
def q_word_split(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        words.word_offset(key).alias("word_offset"),
        words.word_bit(key).alias("word_bit"),
    )


@query
def q_align_ids(spark, sf_dir):
    high, low = ids.aligned_pair(F.col("o_orderkey"), F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        high.alias("high_id"),
        low.alias("low_id"),
        ids.pair_id(F.col("o_orderkey"), F.col("o_custkey")).alias("pair_id"),
    )


# Rows -------------------------------------------------------------------------


@query
def q_row_pairs(spark, sf_dir):
    """Row pairs of customers and orders.

    Orders refer to few customers each, so the list stays linear in the tables.
    """
    return R.row_pairs(side(spark, sf_dir, "customer"), side(spark, sf_dir, "orders"))


@query
def q_row_pair_key(spark, sf_dir):
    """Labels of the row pairs, columns being numbered by their position."""
    left, right = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    _, columns = CT.catalog(spark, {"customer": left, "orders": right})
    numbers = columns.select("name", "id")
    found = R.row_pairs(R.Side.of(left, "c_custkey"), R.Side.of(right, "o_orderkey"))
    numbered = found.join(
        F.broadcast(numbers.toDF("l_col", "l_id")), "l_col"
    ).join(F.broadcast(numbers.toDF("r_col", "r_id")), "r_col")
    key = ids.row_pair_key(
        F.col("l_id"), F.col("r_id"), F.col("l_row"), F.col("r_row")
    )
    return numbered.select("l_col", "r_col", key.alias("row_pair_key"))


@query
def q_row_pair_count(spark, sf_dir):
    found = O.row_pair_count(
        sets(spark, sf_dir, "orders"), sets(spark, sf_dir, "lineitem")
    )
    return found.withColumn("row_pairs", F.col("row_pairs").cast("string"))


@query
def q_matched_rows(spark, sf_dir):
    return R.matched_rows(
        side(spark, sf_dir, "customer"), side(spark, sf_dir, "supplier")
    )


@query
def q_matched_row_counts(spark, sf_dir):
    return R.matched_row_counts(
        sets(spark, sf_dir, "orders"), sets(spark, sf_dir, "lineitem")
    )


@query
def q_fetch_matched_rows(spark, sf_dir):
    """Documents of which any column has a value of the labels table."""
    documents = table(spark, sf_dir, "documents")
    kept = R.Side.of(documents, "doc_id")
    found = R.fetch_matched_rows(
        documents, "doc_id", kept, sets(spark, sf_dir, "labels")
    )
    return found


@query
def q_fetch_pair_rows(spark, sf_dir):
    """Documents behind one column pair: those whose key is a labelled one."""
    documents = table(spark, sf_dir, "documents")
    kept = R.Side.of(documents, "doc_id")
    labels = sets(spark, sf_dir, "labels")
    return R.fetch_pair_rows(documents, "doc_id", kept, labels, "doc_id", "doc_id")


@query
def q_row_pairs_chosen(spark, sf_dir):
    """Row pairs of suppliers and customers by key; nations, of which the two tables
    have few, are not wanted and not listed."""
    left, right = side(spark, sf_dir, "supplier"), side(spark, sf_dir, "customer")
    wanted = spark.createDataFrame([("s_suppkey", "c_custkey")], "l_col string, r_col string")
    return R.row_pairs(left, right, pairs=wanted)


@query
def q_value_index(spark, sf_dir):
    return C.value_index(table(spark, sf_dir, "orders"), "o_orderkey")


# Peers ------------------------------------------------------------------------


@query
def q_peer_pairs(spark, sf_dir):
    found = O.pair_overlap(
        sets(spark, sf_dir, "orders"), sets(spark, sf_dir, "lineitem")
    )
    return P.peer_pairs(found)


@query
def q_peer_row_overlap(spark, sf_dir):
    return _peer_rows(spark, sf_dir, "customer", "supplier")


@query
def q_peer_row_overlap_orders_lineitem(spark, sf_dir):
    return _peer_rows(spark, sf_dir, "orders", "lineitem")


def _peer_rows(spark, sf_dir, l_name, r_name):
    left, right = table(spark, sf_dir, l_name), table(spark, sf_dir, r_name)
    l_sets, r_sets = settle(C.value_sets(left), "sets"), settle(C.value_sets(right), "sets")
    pairs = settle(O.pair_overlap(l_sets, r_sets, stored=True), "pairs")
    found = P.peer_row_overlap(spread(left), spread(right), pairs, l_sets, r_sets)
    return found.withColumn("row_pairs", F.col("row_pairs").cast("string"))


@query
def q_peer_containment(spark, sf_dir):
    return P.peer_containment(
        side(spark, sf_dir, "customer"), side(spark, sf_dir, "supplier")
    )


@query
def q_peer_score(spark, sf_dir):
    return P.peer_score(
        P.peer_containment(
            side(spark, sf_dir, "customer"), side(spark, sf_dir, "supplier")
        )
    )


@query
def q_peer_score_orders_lineitem(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    # Lines have no key of their own; their number in the table tells them apart.
    numbered = settle(D.with_row_number(lines, "line"), "lines")
    left = side(spark, sf_dir, "orders")
    right = R.Side.of(numbered, "line", lines.columns, unique=True)
    return P.peer_score(P.peer_containment(left, right))


@query
def q_evidence_report(spark, sf_dir):
    return P.evidence_report(
        side(spark, sf_dir, "customer"),
        side(spark, sf_dir, "supplier"),
        [("c_nationkey", "s_nationkey")],
    )


# Profiles ---------------------------------------------------------------------


@query
def q_column_profile(spark, sf_dir):
    return PR.column_profile(spread(table(spark, sf_dir, "lineitem")))


@query
def q_column_profile_text(spark, sf_dir):
    return PR.column_profile(spread(table(spark, sf_dir, "documents")))


@query
def q_real_type(spark, sf_dir):
    orders = spread(table(spark, sf_dir, "orders"))
    texts = orders.select([C.quoted(c).cast("string").alias(c) for c in orders.columns])
    return PR.real_type(texts)


@query
def q_distinct_counts(spark, sf_dir):
    found = PR.distinct_counts(table(spark, sf_dir, "documents"))
    return found.select("column_name", "distinct_count", "hash_unique_count")


# Catalog ----------------------------------------------------------------------


@query
def q_distinct_sketches(spark, sf_dir):
    """Exact counts of lines, and whether merged sketches of their parts are within 3 %."""
    store = Store(spark, work_dir(prepare(spark), "sketches"))
    lines = table(spark, sf_dir, "lineitem")
    for flag in (F.col("l_returnflag") == "R", F.col("l_returnflag") != "R"):
        store.add_sketches(PR.distinct_sketches(lines.filter(flag)), "lineitem")
    told = PR.sketched_counts(PR.merged_sketches(store.read_sketches("lineitem")))
    exact = PR.distinct_counts(lines).select("column_name", "distinct_count")
    near = F.abs(F.col("estimate") - F.col("distinct_count")) <= 0.03 * F.col("distinct_count")
    return exact.join(told, "column_name").select("column_name", "distinct_count", near.alias("within_3_percent"))


@query
def q_catalog(spark, sf_dir):
    named = {n: table(spark, sf_dir, n) for n in ("nation", "customer", "orders")}
    return CT.column_catalog(spark, named).withColumn(
        "categories", F.concat_ws(",", "categories")
    )


def _described(spark, sf_dir):
    """Customers as descriptions of tables, orders as descriptions of columns."""
    tables = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat("c_name", F.lit(".txt")).alias("dumpfile"),
    )
    columns = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("table_info_id"),
        F.col("o_orderkey").alias("num"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("data_type"),
        F.lit(None).cast("int").alias("char_length"),
        F.lit(None).cast("int").alias("precision"),
        F.lit(None).cast("int").alias("scale"),
    )
    return tables, columns


@query
def q_catalog_from_tables(spark, sf_dir):
    return CT.catalog_from_tables(*_described(spark, sf_dir)).select(
        "table_id",
        "table_name",
        "dumpfile",
        "column_id",
        "num",
        "column_name",
        "data_type",
    )


@query
def q_catalog_checks(spark, sf_dir):
    """Documents as tables and labels as columns; most documents have none."""
    tables = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.nullif("lang", F.lit("en")).alias("name"),
        F.when(F.col("n_chars") > 500, F.col("source")).alias("dumpfile"),
        F.nullif("source", F.lit("src0")).alias("source_id"),
    )
    columns = table(spark, sf_dir, "labels").select(
        F.when(F.col("toxic") == 0, F.col("doc_id")).alias("id"),
        (F.col("doc_id") * 2).alias("table_info_id"),
        F.col("quality").cast("string").alias("name"),
    )
    return CT.catalog_checks(tables, columns)


# Dumps, typed forms and stored results ---------------------------------------


@query
def q_dump_scan(spark, sf_dir):
    path = work_dir(prepare(spark), "dump")
    orders = table(spark, sf_dir, "orders")
    D.write_dump(orders, path)
    return D.dump_scan(spark, path, orders.columns).select(*orders.columns)


@query
def q_dump_row_id(spark, sf_dir):
    """Row numbers of a dump: how many, from where to where, how many distinct."""
    path = work_dir(prepare(spark), "dump")
    orders = table(spark, sf_dir, "orders")
    D.write_dump(orders, path)
    return (
        D.dump_scan(spark, path, orders.columns)
        .groupBy("row_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum("n").alias("n_rows"),
            F.min("row_id").alias("first_row"),
            F.max("row_id").alias("last_row"),
            F.count(F.lit(1)).alias("distinct_rows"),
        )
    )


@query
def q_row_id(spark, sf_dir):
    return D.with_row_number(table(spark, sf_dir, "orders")).select(
        "row_id", "o_orderkey", "o_custkey"
    )


@query
def q_bad_lines(spark, sf_dir):
    """Lines of all conversations by word count, those of twelve words left out."""
    path = work_dir(prepare(spark), "lines")
    lines = F.explode(F.split("text", "\n", -1)).alias("line")
    D.write_dump(table(spark, sf_dir, "conversations").select(lines), path, None)
    found = D.bad_lines(spark, path, 12, delimiter=" ")
    return found.groupBy("n_fields").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def q_typed_load(spark, sf_dir):
    orders = spread(table(spark, sf_dir, "orders"))
    texts = orders.select([C.quoted(c).cast("string").alias(c) for c in orders.columns])
    found = L.typed_load(texts, "o_orderkey", DECLARED_ORDERS, strict=False)
    return found.select(
        F.col("row_id").cast("bigint").alias("row_id"),
        F.col("o_custkey").cast("bigint").alias("o_custkey"),
        "o_orderstatus",
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
    )


@query
def q_load_rejects(spark, sf_dir):
    orders = spread(table(spark, sf_dir, "orders"))
    texts = orders.select([C.quoted(c).cast("string").alias(c) for c in orders.columns])
    found = L.load_rejects(texts, "o_orderkey", DECLARED_ORDERS)
    return found.withColumn("row_id", F.col("row_id").cast("bigint"))


@query
def q_load_rejects_numbers(spark, sf_dir):
    """Balances and prices that a narrower number would round or cut."""
    found = None
    for name, key, column in (("customer", "c_custkey", "c_acctbal"), ("orders", "o_orderkey", "o_totalprice")):
        texts = table(spark, sf_dir, name).select(key, F.col(column).cast("string").alias(column))
        spec = [{"name": column, "data_type": "NUMBER", "precision": 5, "scale": 1}]
        rejects = L.load_rejects(texts, key, spec)
        found = rejects if found is None else found.unionByName(rejects)
    return found


@query
def q_hashed_projection(spark, sf_dir):
    """Distinct hashes per column, which must equal its distinct values."""
    orders = table(spark, sf_dir, "orders")
    hashed = L.hashed_projection(orders, "o_orderkey")
    long = hashed.unpivot("row_id", [f"h_{c}" for c in orders.columns], "name", "hash")
    per_hash = long.groupBy("name", "hash").agg(F.count(F.lit(1)).alias("n"))
    return per_hash.groupBy(F.substring("name", 3, 100).alias("column_name")).agg(
        F.count(F.lit(1)).alias("distinct_hashes"), F.sum("n").alias("n_rows")
    )


@query
def q_value_set_store(spark, sf_dir):
    store = Store(spark, work_dir(prepare(spark), "sets"))
    store.write_value_sets(sets(spark, sf_dir, "orders"), "orders")
    store.write_value_sets(sets(spark, sf_dir, "customer"), "customer")
    return store.read_value_sets("orders")


@query
def q_value_set_loads(spark, sf_dir):
    """Value sets of orders from a load per priority, compacted in between."""
    store = Store(spark, work_dir(prepare(spark), "loads"))
    orders = table(spark, sf_dir, "orders")
    urgent = F.col("o_orderpriority") < "3"
    for load, part in (("urgent", urgent), ("rest", ~urgent), ("none", F.col("o_orderpriority").isNull())):
        store.add_value_sets(C.value_sets(orders.filter(part)), "orders", load)
        if load == "urgent":
            store.compact_value_sets("orders")
    return store.read_added_value_sets("orders")


@query
def q_value_index_store(spark, sf_dir):
    store = Store(spark, work_dir(prepare(spark), "index"))
    index = C.value_index(table(spark, sf_dir, "customer"), "c_custkey")
    store.write_value_index(index, "customer")
    return store.read_value_index("customer")


@query
def q_value_index_lookup(spark, sf_dir):
    """Cells of all columns of lines whose key is that of the number 1."""
    store = Store(spark, work_dir(prepare(spark), "index"))
    lines = spread(table(spark, sf_dir, "lineitem"))
    store.write_value_index(C.value_index(lines, "l_orderkey"), "lineitem")
    return store.read_value_index("lineitem", match_key="1")


@query
def q_bucketed_overlap(spark, sf_dir):
    """Overlap of two stored tables, joined bucket by bucket without a shuffle."""
    store = Store(spark, work_dir(prepare(spark), "bucketed"))
    names = {}
    for name in ("orders", "lineitem"):
        names[name] = f"sets_{name}_{store.root.rsplit('-', 1)[-1]}"
        store.save_bucketed_sets(sets(spark, sf_dir, name), names[name], 16)
    left, right = (store.read_bucketed_sets(n) for n in names.values())
    shared = O.shared_values(left, right, bucketed=True)
    return shared.groupBy("l_col", "r_col").agg(
        F.count(F.lit(1)).alias("shared"), O.row_pair_total().cast("string").alias("row_pairs")
    )


@query
def q_pair_store(spark, sf_dir):
    store = Store(spark, work_dir(prepare(spark), "pairs"))
    store.write_shared_values(
        O.shared_values(
            sets(spark, sf_dir, "orders"), sets(spark, sf_dir, "lineitem")
        ),
        "orders",
        "lineitem",
    )
    return store.read_shared_values("orders", "lineitem", "o_orderkey", "l_orderkey")


# Integer sets -----------------------------------------------------------------


@query
def q_set_build(spark, sf_dir):
    return _line_suppliers(spark, sf_dir)


@query
def q_set_cardinality(spark, sf_dir):
    return I.set_cardinality(_line_suppliers(spark, sf_dir))


@query
def q_set_contains(spark, sf_dir):
    return I.set_contains(
        _line_orders(spark, sf_dir), probes(spark, sf_dir, "lineitem", "l_orderkey")
    )


def _two_sets(operator):
    def run(spark, sf_dir):
        return operator(_line_orders(spark, sf_dir), _label_documents(spark, sf_dir))

    return run


for _name in (
    "set_intersect",
    "set_difference",
    "set_union",
    "set_symmetric_difference",
    "set_intersect_cardinality",
    "set_difference_cardinality",
    "set_union_cardinality",
    "set_symmetric_difference_cardinality",
    "set_comparison",
):
    QUERIES[_name] = _two_sets(getattr(I, _name))


#: Columns of whole numbers by table, each of them a set.
INTEGER_COLUMNS = {
    "customer": ["c_custkey", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey", "p_size"],
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
}


@query
def q_set_pair_sizes(spark, sf_dir):
    """Every two integer columns of five tables as sets."""
    each = [I.integer_sets(table(spark, sf_dir, t), t, c) for t, c in INTEGER_COLUMNS.items()]
    return I.set_pair_sizes(reduce(DataFrame.unionByName, each))


@query
def q_set_equal(spark, sf_dir):
    """Customer keys on orders against customer keys on file."""
    on_file = integers(spark, sf_dir, "customer", "c_custkey")
    return I.set_equal(_order_customers(spark, sf_dir), on_file)


@query
def q_set_is_superset(spark, sf_dir):
    on_file = integers(spark, sf_dir, "customer", "c_custkey")
    users = integers(spark, sf_dir, "events", "user_id")
    return I.set_is_superset(on_file, users)


@query
def q_set_is_strict_superset(spark, sf_dir):
    on_file = integers(spark, sf_dir, "customer", "c_custkey")
    users = integers(spark, sf_dir, "events", "user_id")
    return I.set_is_strict_superset(on_file, users)


@query
def q_set_emptiness(spark, sf_dir):
    """Order keys that no line has, which is the question of orphans."""
    orders = integers(spark, sf_dir, "orders", "o_orderkey")
    lines = integers(spark, sf_dir, "lineitem", "l_orderkey")
    return I.set_emptiness(I.set_difference(lines, orders))


@query
def q_set_all(spark, sf_dir):
    return I.set_all(_parts(spark, sf_dir))


@query
def q_set_all_scattered(spark, sf_dir):
    return I.set_all(_line_orders(spark, sf_dir))


@query
def q_set_complement(spark, sf_dir):
    return I.set_complement(spark, _line_orders(spark, sf_dir))


@query
def q_set_next(spark, sf_dir):
    return I.set_next(
        _line_orders(spark, sf_dir), probes(spark, sf_dir, "orders", "o_orderkey")
    )


@query
def q_set_elements(spark, sf_dir):
    return I.bitmap_decode(I.bitmap_encode(_line_orders(spark, sf_dir)))


@query
def q_set_point_updates(spark, sf_dir):
    """One update per customer key, the op depending on the market segment."""
    segment = F.col("c_mktsegment")
    op = (
        F.when(segment == "BUILDING", "set")
        .when(segment == "MACHINERY", "clear")
        .otherwise("flip")
    )
    updates = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("element"), op.alias("op")
    )
    return I.set_point_updates(_line_orders(spark, sf_dir), updates)


@query
def q_set_storage_size(spark, sf_dir):
    return I.set_storage_size(_line_orders(spark, sf_dir))


def _line_words(spark, sf_dir):
    return I.bitmap_encode(_line_orders(spark, sf_dir))


def _label_words(spark, sf_dir):
    return I.bitmap_encode(_label_documents(spark, sf_dir))


@query
def q_bitmap_encode(spark, sf_dir):
    return _line_words(spark, sf_dir)


@query
def q_bitmap_cardinality(spark, sf_dir):
    return I.bitmap_cardinality(_line_words(spark, sf_dir))


@query
def q_bitmap_pages(spark, sf_dir):
    return I.bitmap_pages_cardinality(I.bitmap_pages(_line_orders(spark, sf_dir)))


def _two_bitmaps(operator):
    def run(spark, sf_dir):
        return operator(_line_words(spark, sf_dir), _label_words(spark, sf_dir))

    return run


for _name in ("bitmap_and", "bitmap_andnot", "bitmap_or", "bitmap_xor"):
    QUERIES[_name] = _two_bitmaps(getattr(I, _name))


@query
def q_trailing_zeros(spark, sf_dir):
    found = _line_words(spark, sf_dir)
    first = F.shiftleft("word_offset", words.WORD_SHIFT) + words.trailing_zeros(
        F.col("bits")
    )
    return found.select(
        "word_offset",
        first.alias("first_element"),
        words.popcount(F.col("bits")).alias("n_elements"),
    )
