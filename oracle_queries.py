"""The registered queries once more, as SQL for an independent engine.

Nothing is shared with the Spark side: cells are spelled out column by column and
categories are told apart by a CASE of their own.
"""

from __future__ import annotations

COLUMNS = {
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "orders": [
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        "o_orderdate",
        "o_orderpriority",
    ],
    "lineitem": [
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "labels": ["doc_id", "quality", "toxic"],
}
ROW_IDS = {
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "orders": "o_orderkey",
    "documents": "doc_id",
    "labels": "doc_id",
}

CATALOG = COLUMNS | {
    "region": ["r_regionkey", "r_name"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "embeddings": ["vec_id", "label"],
}

INTEGER = "(regexp_full_match(v, '[+-]?[0-9]+') AND TRY_CAST(v AS BIGINT) IS NOT NULL)"
FLOAT = (
    "((regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') "
    "AND abs(TRY_CAST(v AS DOUBLE)) < CAST('Infinity' AS DOUBLE)) "
    "OR regexp_full_match(v, '(?i)([+-]?(inf|infinity)|nan)'))"
)
BYTES = "octet_length(encode(v))"
CATEGORY = (
    f"CASE WHEN {INTEGER} THEN CASE WHEN TRY_CAST(v AS BIGINT) < 0 THEN 'N' ELSE 'P' END "
    f"WHEN {FLOAT} THEN 'F' ELSE 'S' END || CAST({BYTES} AS VARCHAR)"
)
KEY = (
    f"CASE WHEN {INTEGER} THEN CAST(TRY_CAST(v AS BIGINT) AS VARCHAR) "
    f"WHEN {FLOAT} THEN v ELSE sha256(v) END"
)


def cells(table: str, columns: list[str] | None = None) -> str:
    row = ROW_IDS.get(table)
    row = f"CAST({row} AS BIGINT)" if row else "CAST(NULL AS BIGINT)"
    parts = [
        f"SELECT {row} AS row_id, '{c}' AS column_name, CAST({c} AS VARCHAR) AS v "
        f"FROM {table}"
        for c in columns or COLUMNS[table]
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE v <> ''"


def index(table: str, columns: list[str] | None = None) -> str:
    return (
        f"SELECT row_id, column_name, {CATEGORY} AS category, {KEY} AS match_key "
        f"FROM ({cells(table, columns)})"
    )


def sets(table: str, columns: list[str] | None = None) -> str:
    return (
        "SELECT column_name, category, match_key, CAST(sum(c) AS BIGINT) AS n FROM ("
        f"SELECT column_name, {CATEGORY} AS category, {KEY} AS match_key, c FROM ("
        f"SELECT column_name, v, count(*) AS c FROM ({cells(table, columns)}) "
        "GROUP BY ALL)) GROUP BY column_name, category, match_key"
    )


def both_sets(left: str, right: str) -> str:
    return f"WITH l AS ({sets(left)}), r AS ({sets(right)}), " + (
        "s AS (SELECT l.column_name AS l_col, r.column_name AS r_col, l.category, "
        "l.match_key, l.n AS l_n, r.n AS r_n FROM l JOIN r "
        "ON l.category = r.category AND l.match_key = r.match_key), "
        "o AS (SELECT l_col, r_col, count(*) AS shared, "
        "sum(CAST(l_n AS HUGEINT) * r_n) AS row_pairs, "
        "CAST(sum(l_n) AS BIGINT) AS l_rows, CAST(sum(r_n) AS BIGINT) AS r_rows "
        "FROM s GROUP BY l_col, r_col), "
        "lt AS (SELECT column_name AS l_col, count(*) AS l_distinct FROM l GROUP BY 1), "
        "rt AS (SELECT column_name AS r_col, count(*) AS r_distinct FROM r GROUP BY 1), "
        "p AS (SELECT o.*, l_distinct, r_distinct, "
        "CAST(shared AS DOUBLE) / CAST(l_distinct AS DOUBLE) AS l_ratio, "
        "CAST(shared AS DOUBLE) / CAST(r_distinct AS DOUBLE) AS r_ratio "
        "FROM o JOIN lt USING (l_col) JOIN rt USING (r_col)) "
    )


def set_pair_sizes() -> str:
    columns = (
        "customer.c_custkey customer.c_nationkey supplier.s_suppkey supplier.s_nationkey part.p_partkey part.p_size "
        "orders.o_orderkey orders.o_custkey lineitem.l_orderkey lineitem.l_partkey lineitem.l_suppkey lineitem.l_linenumber"
    ).split()
    every = " UNION ".join(
        f"SELECT '{c}' AS id, CAST({c} AS BIGINT) AS e FROM {c.split('.')[0]} WHERE {c} IS NOT NULL" for c in columns
    )
    return (
        f"WITH x AS MATERIALIZED ({every}), s AS (SELECT id, count(*) AS n FROM x GROUP BY id), "
        "p AS (SELECT a.id AS a_id, b.id AS b_id, count(*) AS k FROM x a JOIN x b ON a.e = b.e AND a.id < b.id GROUP BY 1, 2) "
        "SELECT a_id, b_id, u.n AS a_cardinality, v.n AS b_cardinality, k AS intersect_cardinality, "
        "u.n - k AS difference_cardinality, u.n + v.n - k AS union_cardinality, "
        "u.n + v.n - 2 * k AS symmetric_difference_cardinality "
        "FROM p JOIN s u ON u.id = a_id JOIN s v ON v.id = b_id"
    )


def catalog_overlap() -> str:
    every = " UNION ALL ".join(
        f"SELECT '{t}' AS t, column_name AS c, category, match_key FROM ({sets(t, columns)})"
        for t, columns in CATALOG.items()
    )
    return (
        f"WITH e AS MATERIALIZED ({every}), n AS (SELECT t, c, count(*) AS n FROM e GROUP BY 1, 2), "
        "p AS (SELECT x.t AS l_table, x.c AS l_col, y.t AS r_table, y.c AS r_col, "
        "count(*) AS shared FROM e x JOIN e y ON x.category = y.category "
        "AND x.match_key = y.match_key AND x.t < y.t GROUP BY 1, 2, 3, 4) "
        "SELECT p.*, a.n AS l_distinct, b.n AS r_distinct, "
        "CAST(shared AS DOUBLE) / a.n AS l_ratio, CAST(shared AS DOUBLE) / b.n AS r_ratio "
        "FROM p JOIN n a ON a.t = l_table AND a.c = l_col JOIN n b ON b.t = r_table AND b.c = r_col"
    )


def pair_overlap(left: str, right: str) -> str:
    return both_sets(left, right) + (
        "SELECT l_col, r_col, shared, CAST(row_pairs AS VARCHAR) AS row_pairs, "
        "l_distinct, r_distinct, l_ratio, r_ratio FROM p"
    )


def match_report(left: str, right: str, l_name: str, r_name: str) -> str:
    return both_sets(left, right) + (
        f"SELECT l_distinct AS l_card, '{l_name}.' || l_col AS l_name, "
        "100 * l_ratio AS l_percent, shared, 100 * r_ratio AS r_percent, "
        f"'{r_name}.' || r_col AS r_name, r_distinct AS r_card FROM p"
    )


def both_indexes(left: str, right: str) -> str:
    return both_sets(left, right) + (
        f", li AS ({index(left)}), ri AS ({index(right)}), "
        "lm AS (SELECT DISTINCT s.l_col, s.r_col, li.row_id FROM li JOIN s ON "
        "li.column_name = s.l_col AND li.category = s.category "
        "AND li.match_key = s.match_key), "
        "rm AS (SELECT DISTINCT s.l_col, s.r_col, ri.row_id FROM ri JOIN s ON "
        "ri.column_name = s.r_col AND ri.category = s.category "
        "AND ri.match_key = s.match_key), "
        "rp AS (SELECT li.column_name AS l_col, ri.column_name AS r_col, "
        "li.row_id AS l_row, ri.row_id AS r_row FROM li JOIN ri ON "
        "li.category = ri.category AND li.match_key = ri.match_key), "
        "peers AS (SELECT a.l_col, a.r_col, b.l_col AS peer_l_col, "
        "b.r_col AS peer_r_col FROM p a JOIN p b "
        "ON a.l_col < b.l_col AND a.r_col <> b.r_col) "
    )


def containment(left: str, right: str) -> str:
    return both_indexes(left, right) + (
        ", lo AS (SELECT l_col, r_col, peer_l_col, peer_r_col, count(*) AS l_overlap "
        "FROM peers JOIN lm a USING (l_col, r_col) JOIN lm b ON b.l_col = peer_l_col "
        "AND b.r_col = peer_r_col AND b.row_id = a.row_id GROUP BY ALL), "
        "ro AS (SELECT l_col, r_col, peer_l_col, peer_r_col, count(*) AS r_overlap "
        "FROM peers JOIN rm a USING (l_col, r_col) JOIN rm b ON b.l_col = peer_l_col "
        "AND b.r_col = peer_r_col AND b.row_id = a.row_id GROUP BY ALL), "
        "lc AS (SELECT l_col, r_col, count(*) AS l_rows FROM lm GROUP BY ALL), "
        "rc AS (SELECT l_col, r_col, count(*) AS r_rows FROM rm GROUP BY ALL), "
        "sz AS (SELECT l_col, r_col, shared, lc.l_rows, rc.r_rows FROM p "
        "JOIN lc USING (l_col, r_col) JOIN rc USING (l_col, r_col)), "
        "c AS (SELECT lo.*, r_overlap, a.shared, a.l_rows, a.r_rows, "
        "b.shared AS peer_shared, b.l_rows AS peer_l_rows, b.r_rows AS peer_r_rows, "
        "l_overlap = a.l_rows AS peer_contains_pair_l, "
        "l_overlap = b.l_rows AS pair_contains_peer_l, "
        "r_overlap = a.r_rows AS peer_contains_pair_r, "
        "r_overlap = b.r_rows AS pair_contains_peer_r "
        "FROM lo JOIN ro USING (l_col, r_col, peer_l_col, peer_r_col) "
        "JOIN sz a USING (l_col, r_col) "
        "JOIN sz b ON b.l_col = peer_l_col AND b.r_col = peer_r_col) "
    )


def score(size: str) -> str:
    outer = "(peer_contains_pair_l AND peer_contains_pair_r)"
    inner = "(pair_contains_peer_l AND pair_contains_peer_r)"
    return (
        f"CAST({outer} AS INT) + CAST({inner} AS INT) + CAST({outer} AND {inner} AS INT)"
        " + CASE WHEN l_overlap = r_overlap THEN 1 ELSE 0 END"
        f" + CASE WHEN l_overlap = r_overlap AND l_overlap = {size} THEN 6 ELSE 0 END"
    )


def score_by_rows(left: str, right: str) -> str:
    """Scores of two peers from rows numbered as they come."""

    def rows(table: str, prefix: str) -> str:
        columns = f"SELECT row_number() OVER () AS rid, * FROM {table}"
        long = " UNION ALL ".join(
            f"SELECT rid, '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM t"
            for c in COLUMNS[table]
        )
        return (
            f"{prefix}k AS (WITH t AS MATERIALIZED ({columns}) SELECT rid, column_name, "
            f"{CATEGORY} AS category, {KEY} AS match_key FROM ({long}) WHERE v <> ''), "
            f"{prefix}m AS (SELECT DISTINCT s.l_col, s.r_col, k.rid AS row_id FROM {prefix}k k "
            f"JOIN s ON k.column_name = s.{prefix}_col AND k.category = s.category "
            "AND k.match_key = s.match_key)"
        )

    found = containment(left, right)
    peers = (
        "peers AS (SELECT a.l_col, a.r_col, b.l_col AS peer_l_col, b.r_col AS peer_r_col "
        "FROM p a JOIN p b ON a.l_col < b.l_col AND a.r_col <> b.r_col) "
    )
    head = both_sets(left, right) + f", {rows(left, 'l')}, {rows(right, 'r')}, {peers}"
    return (
        head
        + found[found.index(", lo AS") :]
        + "SELECT l_col, r_col, peer_l_col, peer_r_col, l_overlap, r_overlap, "
        f"{score('shared')} AS score, {score('peer_shared')} AS peer_score FROM c"
    )


def profile(table: str) -> str:
    rows = []
    for c in COLUMNS[table]:
        rows.append(
            f"SELECT '{c}' AS column_name, "
            "count(*) FILTER (WHERE v IS NULL) AS null_count, "
            "min(v) AS min_string, max(v) AS max_string, "
            f"CAST(min({BYTES}) AS INT) AS min_length, "
            f"CAST(max({BYTES}) AS INT) AS max_length, "
            "CASE WHEN bool_and(d IS NOT NULL) FILTER (WHERE v IS NOT NULL) "
            "THEN min(d) FILTER (WHERE NOT isnan(d)) END AS min_numeric, "
            "CASE WHEN bool_and(d IS NOT NULL) FILTER (WHERE v IS NOT NULL) "
            "THEN max(d) FILTER (WHERE NOT isnan(d)) END AS max_numeric, "
            "CASE WHEN NOT bool_and(d IS NOT NULL) FILTER (WHERE v IS NOT NULL) "
            "THEN 'STRING' WHEN bool_and(NOT isnan(d) AND d = trunc(d)) "
            "FILTER (WHERE d IS NOT NULL) THEN 'INTEGER' "
            "WHEN count(v) > 0 THEN 'FLOAT' END AS real_type "
            f"FROM (SELECT v, CASE WHEN {FLOAT} THEN TRY_CAST(v AS DOUBLE) END AS d "
            f"FROM (SELECT nullif(CAST({c} AS VARCHAR), '') AS v FROM {table}))"
        )
    return " UNION ALL ".join(rows)


def peer_rows_by_count(left: str, right: str) -> str:
    """Row pairs behind two peers, from rows grouped by two keys.

    For tables whose single row pairs are too many to list. A table without a
    row id numbers its rows as they come, which only has to tell them apart.
    """

    def keys(table: str, prefix: str) -> str:
        columns = (
            f"SELECT row_number() OVER () AS rid, {', '.join(COLUMNS[table])} FROM {table}"
        )
        long = " UNION ALL ".join(
            f"SELECT rid, '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM t"
            for c in COLUMNS[table]
        )
        return (
            f"{prefix}k AS (WITH t AS MATERIALIZED ({columns}) SELECT rid, column_name, "
            f"{CATEGORY} || '|' || {KEY} AS k FROM ({long}) WHERE v <> ''), "
            f"{prefix}h AS (SELECT x.* FROM {prefix}k x WHERE (column_name, k) IN "
            f"(SELECT ({prefix}_col, category || '|' || match_key) FROM s)), "
            f"{prefix}g AS (SELECT a.column_name AS c1, b.column_name AS c2, a.k AS k1, "
            f"b.k AS k2, count(*) AS n FROM {prefix}h a JOIN {prefix}h b "
            "ON a.rid = b.rid AND a.column_name <> b.column_name GROUP BY ALL)"
        )

    return both_sets(left, right) + (
        f", {keys(left, 'l')}, {keys(right, 'r')}, "
        "m AS (SELECT x.c1 AS l_col, y.c1 AS r_col, x.c2 AS peer_l_col, "
        "y.c2 AS peer_r_col, sum(CAST(x.n AS HUGEINT) * y.n) AS row_pairs FROM lg x "
        "JOIN rg y ON x.k1 = y.k1 AND x.k2 = y.k2 WHERE x.c1 < x.c2 GROUP BY ALL), "
        "peers AS (SELECT a.l_col, a.r_col, b.l_col AS peer_l_col, "
        "b.r_col AS peer_r_col FROM p a JOIN p b "
        "ON a.l_col < b.l_col AND a.r_col <> b.r_col) "
        "SELECT l_col, r_col, peer_l_col, peer_r_col, "
        "CAST(coalesce(row_pairs, 0) AS VARCHAR) AS row_pairs FROM peers "
        "LEFT JOIN m USING (l_col, r_col, peer_l_col, peer_r_col)"
    )


TOKENS = (
    "SELECT v, count(*) AS c FROM (SELECT unnest(string_split(text, ' ')) AS v "
    "FROM documents) WHERE v <> '' GROUP BY v"
)
LINE_ORDERS = "SELECT DISTINCT l_orderkey AS element FROM lineitem"
LABELLED = "SELECT DISTINCT doc_id AS element FROM labels"
TWO = f"WITH a AS ({LINE_ORDERS}), b AS ({LABELLED}) "
INTERSECT = "SELECT element FROM a INTERSECT SELECT element FROM b"
EXCEPT = "SELECT element FROM a EXCEPT SELECT element FROM b"
UNION = "SELECT element FROM a UNION SELECT element FROM b"
SYMMETRIC = (
    "(SELECT element FROM a EXCEPT SELECT element FROM b) UNION ALL "
    "(SELECT element FROM b EXCEPT SELECT element FROM a)"
)
CUSTOMERS_USERS = (
    "WITH a AS (SELECT DISTINCT c_custkey AS element FROM customer), "
    "b AS (SELECT DISTINCT user_id AS element FROM events) "
)


def count_of(elements: str) -> str:
    return f"{TWO} SELECT count(*) AS cardinality FROM ({elements})"


def word_mask(element: str) -> str:
    bit = f"({element} & 63)"
    return (
        f"CASE WHEN {bit} = 63 THEN CAST(-9223372036854775808 AS BIGINT) "
        f"ELSE CAST(1 AS BIGINT) << {bit} END"
    )


def words(elements: str) -> str:
    return (
        "SELECT element >> 6 AS word_offset, "
        f"bit_or({word_mask('element')}) AS bits FROM ({elements}) GROUP BY 1"
    )


def two_words(elements: str) -> str:
    """The word form of a set operation done on elements, not on words."""
    return f"{TWO} {words(elements)}"


def has_all(elements: str) -> str:
    return (
        "SELECT count(*) FILTER (WHERE element >= 1) = coalesce(max(element), 0) "
        f"AS has_all FROM ({elements})"
    )


def queries() -> dict[str, str]:
    customer_supplier = both_indexes("customer", "supplier")
    customer_orders = both_indexes("customer", "orders")
    orders_lines = both_sets("orders", "lineitem")
    orders_columns = ", ".join(
        f"CAST({c} AS VARCHAR) AS {c}" for c in COLUMNS["orders"]
    )
    distinct_documents = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, "
        f"count(DISTINCT CAST({c} AS VARCHAR)) FILTER (WHERE CAST({c} AS VARCHAR) <> '') "
        "AS distinct_count, "
        f"count(DISTINCT CAST({c} AS VARCHAR)) FILTER (WHERE CAST({c} AS VARCHAR) <> '') "
        "AS hash_unique_count FROM documents"
        for c in COLUMNS["documents"]
    )
    hashed_orders = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_hashes, "
        "count(*) AS n_rows FROM orders"
        for c in COLUMNS["orders"]
    )
    catalog_types = {
        "nation": ["int", "string", "int"],
        "customer": ["bigint", "string", "int", "double", "string"],
        "orders": [
            "bigint",
            "bigint",
            "string",
            "double",
            "timestamp_ntz",
            "string",
        ],
    }
    catalog_rows = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
        f"CAST({num} AS INT) AS num, '{kind}' AS data_type"
        for t, kinds in catalog_types.items()
        for num, (c, kind) in enumerate(zip(COLUMNS[t], kinds), 1)
    )
    catalog_data = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, column_name, "
        "CAST(sum(n) AS BIGINT) AS n_cells, count(*) AS distinct_keys, "
        "string_agg(DISTINCT category, ',' ORDER BY category) AS categories "
        f"FROM ({sets(t)}) GROUP BY column_name"
        for t in catalog_types
    )
    parts = (
        "SELECT 'p_name' AS column_name, CASE WHEN p_name LIKE 'small %' "
        "OR p_name LIKE 'red %' THEN '' ELSE p_name END AS v FROM part "
        "UNION ALL SELECT 'p_brand', CASE WHEN p_brand LIKE 'Brand#1%' THEN '' "
        "ELSE p_brand END FROM part"
    ) + "".join(
        f" UNION ALL SELECT '{c}', CAST({c} AS VARCHAR) FROM part"
        for c in ("p_partkey", "p_type", "p_size", "p_retailprice")
    )
    left_ids = " ".join(
        f"WHEN '{c}' THEN {1000 + i}" for i, c in enumerate(COLUMNS["customer"], 1)
    )
    right_ids = " ".join(
        f"WHEN '{c}' THEN {2000 + i}" for i, c in enumerate(COLUMNS["orders"], 1)
    )
    evidence = (
        containment("customer", "supplier")
        + f", e AS (SELECT *, {score('shared')} AS score, {score('peer_shared')} AS peer_score FROM c), "
        "b AS (SELECT l_col, r_col, peer_l_col, peer_r_col, l_overlap, r_overlap, score, "
        "peer_contains_pair_l, peer_contains_pair_r, pair_contains_peer_l, "
        "pair_contains_peer_r FROM e UNION ALL SELECT peer_l_col, peer_r_col, l_col, r_col, "
        "l_overlap, r_overlap, peer_score, pair_contains_peer_l, pair_contains_peer_r, "
        "peer_contains_pair_l, peer_contains_pair_r FROM e) "
        "SELECT l_col, r_col, p.shared, p.l_rows, p.r_rows, "
        "l_col = 'c_nationkey' AND r_col = 's_nationkey' AS true_positive, "
        "b.* EXCLUDE (l_col, r_col), CASE WHEN peer_l_col IS NOT NULL THEN "
        "peer_l_col = 'c_nationkey' AND peer_r_col = 's_nationkey' END AS peer_true_positive "
        "FROM p LEFT JOIN b USING (l_col, r_col)"
    )
    return {
        "pair_overlap": pair_overlap("customer", "supplier"),
        "pair_overlap_orders_lineitem": pair_overlap("orders", "lineitem"),
        "pair_overlap_documents_labels": pair_overlap("documents", "labels"),
        "pair_overlap_events_customer": pair_overlap("events", "customer"),
        "match_report": match_report("orders", "lineitem", "orders", "sales.lineitem"),
        "join_discovery": match_report("orders", "customer", "orders", "customer"),
        "candidate_pairs": both_sets("orders", "customer")
        + "SELECT a.c AS l_col, b.c AS r_col, coalesce(shared, 0) AS shared FROM "
        f"(SELECT unnest({COLUMNS['orders']!r}) AS c) a CROSS JOIN "
        f"(SELECT unnest({COLUMNS['customer']!r}) AS c) b "
        "LEFT JOIN o ON l_col = a.c AND r_col = b.c",
        "common_categories": orders_lines
        + "SELECT l_col, r_col, x.category, l_keys, r_keys FROM "
        "(SELECT column_name AS l_col, category, count(*) AS l_keys FROM l GROUP BY ALL) x "
        "JOIN (SELECT column_name AS r_col, category, count(*) AS r_keys FROM r "
        "GROUP BY ALL) y ON x.category = y.category",
        "shared_values": orders_lines + "SELECT * FROM s",
        "truth_flag": orders_lines
        + "SELECT l_col, r_col, shared, (l_col, r_col) IN "
        "(('o_orderkey', 'l_orderkey'), ('o_orderstatus', 'l_linestatus'), "
        "('o_orderdate', 'l_shipdate')) AS true_positive FROM o",
        "catalog_overlap": catalog_overlap(),
        "cells": f"SELECT row_id, column_name, v AS value FROM ({cells('customer')})",
        "drop_empty": "SELECT column_name, count(*) AS n_cells FROM "
        f"({parts}) WHERE v <> '' GROUP BY column_name",
        "value_category": f"SELECT {CATEGORY} AS category, CAST(sum(c) AS BIGINT) AS n "
        f"FROM ({TOKENS}) GROUP BY 1",
        "match_key": f"SELECT {CATEGORY} AS category, {KEY} AS match_key, "
        f"CAST(sum(c) AS BIGINT) AS n FROM ({TOKENS}) GROUP BY 1, 2",
        "value_sets": sets("lineitem"),
        "value_sets_text": sets("documents"),
        "category_summary": "SELECT column_name, category, count(*) AS distinct_keys, "
        f"CAST(sum(n) AS BIGINT) AS n_cells FROM ({sets('lineitem')}) GROUP BY 1, 2",
        "column_categories": "SELECT column_name, "
        "string_agg(DISTINCT category, ',' ORDER BY category) AS categories "
        f"FROM ({sets('events')}) GROUP BY 1",
        "prototype_single_column": "SELECT category, match_key, n "
        f"FROM ({sets('lineitem', ['l_shipdate'])})",
        "bucket_of": "SELECT column_name, CASE WHEN substr(category, 1, 1) IN ('P', 'N') "
        "THEN printf('%X', CAST(match_key AS BIGINT) & 255) END AS bucket, "
        f"count(*) AS distinct_keys FROM ({sets('lineitem')}) GROUP BY 1, 2",
        "text_bucket_of": "SELECT column_name, count(*) AS distinct_keys, "
        f"true AS fits_a_byte FROM ({sets('documents')}) GROUP BY 1",
        "word_split": "SELECT o_orderkey, o_orderkey >> 6 AS word_offset, "
        "CAST(o_orderkey & 63 AS INT) AS word_bit FROM orders",
        "align_ids": "SELECT o_orderkey, o_custkey, "
        "greatest(o_orderkey, o_custkey) AS high_id, "
        "least(o_orderkey, o_custkey) AS low_id, "
        "greatest(o_orderkey, o_custkey) || '-' || least(o_orderkey, o_custkey) "
        "AS pair_id FROM orders",
        "row_pairs": customer_orders + "SELECT * FROM rp",
        "row_pair_key": customer_orders
        + f"SELECT l_col, r_col, CASE WHEN CASE l_col {left_ids} END > "
        f"CASE r_col {right_ids} END THEN l_row || ':' || r_row "
        "ELSE r_row || ':' || l_row END AS row_pair_key FROM rp",
        "row_pair_count": orders_lines
        + "SELECT l_col, r_col, CAST(row_pairs AS VARCHAR) AS row_pairs FROM o",
        "matched_rows": customer_supplier
        + "SELECT l_col, r_col, 'left' AS side, row_id FROM lm UNION ALL "
        "SELECT l_col, r_col, 'right' AS side, row_id FROM rm",
        "matched_row_counts": orders_lines + "SELECT l_col, r_col, l_rows, r_rows FROM o",
        "fetch_pair_rows": "SELECT * FROM documents WHERE doc_id IN "
        "(SELECT doc_id FROM labels)",
        "row_pairs_chosen": both_indexes("supplier", "customer")
        + "SELECT * FROM rp WHERE l_col = 's_suppkey' AND r_col = 'c_custkey'",
        "shared_per_category": orders_lines
        + "SELECT l_col, r_col, category, count(*) AS shared, "
        "CAST(sum(CAST(l_n AS HUGEINT) * r_n) AS VARCHAR) AS row_pairs FROM s GROUP BY ALL",
        "discovery_from_dumps": match_report("orders", "customer", "orders", "customer"),
        "fetch_matched_rows": "SELECT * FROM documents "
        "WHERE doc_id IN (SELECT row_id FROM "
        f"({index('documents', ['doc_id', 'lang', 'n_chars'])}) i JOIN "
        f"({sets('labels')}) s ON i.category = s.category AND i.match_key = s.match_key)",
        "value_index": index("orders"),
        "peer_pairs": orders_lines
        + "SELECT a.l_col, a.r_col, b.l_col AS peer_l_col, b.r_col AS peer_r_col "
        "FROM p a JOIN p b ON a.l_col < b.l_col AND a.r_col <> b.r_col",
        "peer_row_overlap": customer_supplier
        + "SELECT l_col, r_col, peer_l_col, peer_r_col, "
        "CAST(count(b.l_row) AS VARCHAR) AS row_pairs FROM peers "
        "JOIN rp a USING (l_col, r_col) LEFT JOIN rp b ON b.l_col = peer_l_col "
        "AND b.r_col = peer_r_col AND b.l_row = a.l_row AND b.r_row = a.r_row "
        "GROUP BY l_col, r_col, peer_l_col, peer_r_col",
        "peer_row_overlap_orders_lineitem": peer_rows_by_count("orders", "lineitem"),
        "peer_containment": containment("customer", "supplier") + "SELECT * FROM c",
        "evidence_report": evidence,
        "evidence_from_dumps": evidence,
        "peer_score_orders_lineitem": score_by_rows("orders", "lineitem"),
        "peer_score": containment("customer", "supplier")
        + "SELECT l_col, r_col, peer_l_col, peer_r_col, l_overlap, r_overlap, "
        f"{score('shared')} AS score, {score('peer_shared')} AS peer_score FROM c",
        "column_profile": profile("lineitem"),
        "column_profile_text": profile("documents"),
        "real_type": f"SELECT column_name, real_type FROM ({profile('orders')})",
        "distinct_counts": distinct_documents,
        "distinct_sketches": " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, "
            "true AS within_3_percent FROM lineitem"
            for c in COLUMNS["lineitem"]
        ),
        "catalog": f"SELECT table_name, column_name, num, data_type, n_cells, "
        f"distinct_keys, categories FROM ({catalog_rows}) "
        f"LEFT JOIN ({catalog_data}) USING (table_name, column_name)",
        "catalog_from_tables": "SELECT c_custkey AS table_id, c_name AS table_name, "
        "c_name || '.txt' AS dumpfile, o_orderkey AS column_id, o_orderkey AS num, "
        "o_orderpriority AS column_name, o_orderstatus AS data_type "
        "FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
        "catalog_checks": "WITH t AS (SELECT doc_id AS id, nullif(lang, 'en') AS name, "
        "CASE WHEN n_chars > 500 THEN source END AS dumpfile, "
        "nullif(source, 'src0') AS source_id FROM documents), "
        "c AS (SELECT CASE WHEN toxic = 0 THEN doc_id END AS id, "
        "doc_id * 2 AS table_info_id, CAST(quality AS VARCHAR) AS name FROM labels), "
        "tl AS (SELECT *, 'table ' || coalesce(CAST(id AS VARCHAR), '?') || ':' || "
        "coalesce(name, '?') AS label FROM t), "
        "cl AS (SELECT *, 'column ' || coalesce(CAST(id AS VARCHAR), '?') || ':' || "
        "coalesce(name, '?') AS label FROM c) "
        "SELECT 'table id' AS rule, label AS object FROM tl WHERE id IS NULL UNION ALL "
        "SELECT 'table name', label FROM tl WHERE coalesce(name, '') = '' UNION ALL "
        "SELECT 'dump file', label FROM tl WHERE coalesce(dumpfile, '') = '' UNION ALL "
        "SELECT 'table columns', label FROM tl WHERE id NOT IN "
        "(SELECT table_info_id FROM c) UNION ALL "
        "SELECT 'table source', label FROM tl WHERE source_id IS NULL UNION ALL "
        "SELECT 'column id', label FROM cl WHERE id IS NULL UNION ALL "
        "SELECT 'column table', label FROM cl WHERE table_info_id NOT IN "
        "(SELECT id FROM t)",
        "dump_scan": f"SELECT {orders_columns} FROM orders",
        "dump_row_id": "SELECT count(*) AS n_rows, CAST(1 AS BIGINT) AS first_row, "
        "count(*) AS last_row, count(*) AS distinct_rows FROM orders",
        "row_id": "SELECT row_number() OVER () AS row_id, o_orderkey, o_custkey "
        "FROM orders",
        "bad_lines": "SELECT CAST(n_fields AS INT) AS n_fields, count(*) AS n_lines "
        "FROM (SELECT length(v) - length(replace(v, ' ', '')) + 1 AS n_fields "
        "FROM (SELECT unnest(string_split(text, chr(10))) AS v FROM conversations)) "
        "WHERE n_fields <> 12 GROUP BY 1",
        "typed_load": "SELECT o_orderkey AS row_id, o_custkey, "
        "o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, "
        "o_orderpriority FROM orders",
        "load_rejects": "SELECT o_orderkey AS row_id, 'o_orderpriority' AS column_name, "
        "o_orderpriority AS value, 'length' AS rule FROM orders "
        "WHERE length(o_orderpriority) > 8 UNION ALL SELECT o_orderkey, 'o_orderstatus', "
        "o_orderstatus, 'length' FROM orders WHERE length(o_orderstatus) > 1",
        "load_rejects_numbers": " UNION ALL ".join(
            f"SELECT row_id, '{c}' AS column_name, value, CASE WHEN value LIKE '%._%' AND "
            "length(rtrim(split_part(value, '.', 2), '0')) > 1 THEN 'scale' ELSE 'precision' "
            f"END AS rule FROM (SELECT {k} AS row_id, CAST({c} AS VARCHAR) AS value FROM {t}) "
            "WHERE length(rtrim(split_part(value, '.', 2), '0')) > 1 "
            "OR length(ltrim(split_part(value, '.', 1), '-')) > 4"
            for t, k, c in (("customer", "c_custkey", "c_acctbal"), ("orders", "o_orderkey", "o_totalprice"))
        ),
        "hashed_projection": hashed_orders,
        "value_set_store": sets("orders"),
        "value_set_loads": sets("orders"),
        "value_index_store": index("customer"),
        "value_index_lookup": "SELECT * FROM ("
        + index("lineitem").replace("CAST(NULL AS BIGINT) AS row_id", "l_orderkey AS row_id")
        + ") WHERE match_key = '1'",
        "bucketed_overlap": orders_lines
        + "SELECT l_col, r_col, shared, CAST(row_pairs AS VARCHAR) AS row_pairs FROM o",
        "pair_store": orders_lines
        + "SELECT * FROM s WHERE l_col = 'o_orderkey' AND r_col = 'l_orderkey'",
        "set_build": "SELECT DISTINCT l_suppkey AS element FROM lineitem",
        "set_cardinality": "SELECT count(DISTINCT l_suppkey) AS cardinality FROM lineitem",
        "set_contains": "SELECT n, n IN (SELECT l_orderkey FROM lineitem) AS present "
        "FROM (SELECT DISTINCT l_orderkey AS n FROM lineitem)",
        "set_intersect": TWO + INTERSECT,
        "set_difference": TWO + EXCEPT,
        "set_union": TWO + UNION,
        "set_symmetric_difference": TWO + SYMMETRIC,
        "set_intersect_cardinality": count_of(INTERSECT),
        "set_difference_cardinality": count_of(EXCEPT),
        "set_union_cardinality": count_of(UNION),
        "set_symmetric_difference_cardinality": count_of(SYMMETRIC),
        "set_comparison": TWO
        + ", x AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, "
        f"(SELECT count(*) FROM ({INTERSECT})) AS ni) "
        "SELECT na AS a_cardinality, nb AS b_cardinality, ni AS intersect_cardinality, "
        "na - ni AS difference_cardinality, na + nb - ni AS union_cardinality, "
        "na + nb - 2 * ni AS symmetric_difference_cardinality, "
        "na = ni AND nb = ni AS is_equal, nb = ni AS is_superset, "
        "nb = ni AND na > ni AS is_strict_superset FROM x",
        "set_pair_sizes": set_pair_sizes(),
        "set_equal": "WITH a AS (SELECT o_custkey AS element FROM orders), "
        "b AS (SELECT c_custkey AS element FROM customer) "
        f"SELECT count(*) = 0 AS is_equal FROM ({SYMMETRIC})",
        "set_is_superset": CUSTOMERS_USERS + "SELECT count(*) = 0 AS is_superset "
        "FROM (SELECT element FROM b EXCEPT SELECT element FROM a)",
        "set_is_strict_superset": CUSTOMERS_USERS
        + "SELECT (SELECT count(*) FROM b) < (SELECT count(*) FROM a) AND "
        "(SELECT count(*) FROM (SELECT element FROM b EXCEPT SELECT element FROM a)) = 0 "
        "AS is_strict_superset",
        "set_emptiness": "SELECT count(*) = 0 AS is_empty, count(*) > 0 AS has_any FROM "
        "(SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)",
        "set_all": has_all("SELECT DISTINCT p_partkey AS element FROM part"),
        "set_all_scattered": has_all(LINE_ORDERS),
        "set_complement": "SELECT g AS element FROM (SELECT unnest(generate_series(1, "
        "(SELECT max(l_orderkey) FROM lineitem))) AS g) "
        f"WHERE g NOT IN (SELECT element FROM ({LINE_ORDERS}))",
        "set_next": "SELECT o_orderkey AS n, (SELECT min(element) FROM "
        f"({LINE_ORDERS}) WHERE element >= o_orderkey) AS next_element FROM orders",
        "set_elements": LINE_ORDERS,
        "set_point_updates": f"WITH a AS ({LINE_ORDERS}), u AS (SELECT c_custkey AS element, "
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'set' WHEN 'MACHINERY' THEN 'clear' "
        "ELSE 'flip' END AS op FROM customer) "
        "SELECT element FROM a WHERE element NOT IN "
        "(SELECT element FROM u WHERE op IN ('clear', 'flip')) UNION "
        "SELECT element FROM u WHERE op = 'set' UNION "
        "SELECT element FROM u WHERE op = 'flip' AND element NOT IN "
        "(SELECT element FROM a)",
        "set_storage_size": "SELECT 4 + 16 * count(DISTINCT element >> 6) "
        f"AS storage_bytes FROM ({LINE_ORDERS})",
        "bitmap_encode": words(LINE_ORDERS),
        "bitmap_cardinality": f"SELECT count(*) AS cardinality FROM ({LINE_ORDERS})",
        "bitmap_pages": f"SELECT count(*) AS cardinality FROM ({LINE_ORDERS})",
        "bitmap_and": two_words(INTERSECT),
        "bitmap_andnot": two_words(EXCEPT),
        "bitmap_or": two_words(UNION),
        "bitmap_xor": two_words(SYMMETRIC),
        "trailing_zeros": "SELECT element >> 6 AS word_offset, "
        "min(element) AS first_element, CAST(count(*) AS INT) AS n_elements "
        f"FROM ({LINE_ORDERS}) GROUP BY 1",
    }
