"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from check_oracles import compare

import __spark_entry__ as entry
from tablekin.plans.queries import QUERIES as OWN

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_every_query_has_a_twin():
    assert set(OWN) <= set(QUERIES) and set(OWN) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_twin(spark, small, name):
    _, verdict = compare(spark, small, name, QUERIES[name], SQL[name])
    assert verdict.startswith("ok"), verdict


def test_flagship(spark):
    found = {
        (r["l_col"], r["r_col"]): (r["shared"], int(r["row_pairs"]))
        for r in entry.entry(spark).collect()
    }
    assert found == {
        ("c_custkey", "s_suppkey"): (10, 10),
        ("c_custkey", "s_nationkey"): (10, 10),
        ("c_nationkey", "s_nationkey"): (10, 62),
        ("c_nationkey", "s_suppkey"): (10, 50),
    }


def test_fetch_matched_rows_looks_at_all_columns(spark, tmp_path):
    from tablekin.plans.queries import QUERIES

    docs = [(901, "777", "en", "s", 50), (902, "x", "en", "778", 51), (903, "x", "en", "s", 52)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    spark.createDataFrame([(777, 1, 0), (778, 2, 1)], "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    found = QUERIES["fetch_matched_rows"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in found) == [901, 902]
