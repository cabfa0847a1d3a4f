"""Inputs of the queries on tables whose keys are large."""

from datetime import datetime

import pytest
from estatelens import catalog
from estatelens.plans.base import Inputs

#: Orders whose ids fit 64 bits, and orders beyond them.
ORDERS = (1, 5_764_606, 5_764_608, 9_000_000, 12_000_000, 54_000_000)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    lines = [(order, 10 + order % 7, order % 5, line, float(2 + line), 901.25 * line, "ARN"[line % 3], "OF"[line % 2], datetime(2024, 1, line)) for order in ORDERS for line in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(n, f"Supplier#{n:09d}") for n in range(5)], "s_suppkey long, s_name string").write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame([(n, f"p{n}", f"Brand#{n % 3}", "T", n % 2) for n in range(20)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{path}/part.parquet")
    return path


def wanted(order: int, line: int) -> int:
    exact = ((order * 8 + line) * 20000 + 10 + order % 7) * 10_000_000 + round(901.25 * line * 100)
    return (exact + (1 << 63)) % (1 << 64) - (1 << 63)


def test_ids_of_any_order(spark, folder):
    found = {(r["order_id"], r["line"]): r["id"] for r in Inputs(spark, folder).records.collect()}
    assert found == {(order, line): wanted(order, line) for order in ORDERS for line in range(1, 8)}
    assert len(set(found.values())) == len(found)


@pytest.mark.parametrize("name", ["j1_correlate", "j8_object_evidence", "j10_details_to_parent", "a6_usage_by_level", "g1_package_links", "g3_build_clusters"])
def test_queries_on_late_orders(spark, folder, name):
    rows = catalog.QUERIES[name](spark, folder).collect()
    if name == "j1_correlate":
        assert {r["id"] for r in rows} == {wanted(order, line) for order in ORDERS for line in range(1, 8)} and len(rows) == 7 * len(ORDERS)
    elif name == "j10_details_to_parent":
        assert {(r["detail_id"], r["issue_id"]) for r in rows} == {(wanted(order, 2), wanted(order, 1)) for order in ORDERS}
    else:
        assert rows


#: Other queries that read lines' ids, of these three tables.
READERS_OF_IDS = (
    "a8_usage_level_per_object", "f8_matched_only", "f9_usage_rows", "g3_cluster_signals", "g3_update_clusters", "j1_update_correlations", "j2_correlate_findings", "j3_recorrelate", "j3_recorrelate_names", "j4_propagate_targets",
    "v8_split_pools",
)


@pytest.mark.parametrize("name", READERS_OF_IDS)
def test_other_queries_end_on_late_orders(spark, folder, name):
    catalog.QUERIES[name](spark, folder).collect()


FAR = (6, 23_611_832_417, 60_000_000_003, 10**15 + 1, 10**17 + 4)


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Tables of which a copy's keys lie far from another's: a key times 2 * 10^11 outgrows 64 bits before it is shifted."""
    path = str(tmp_path_factory.mktemp("far"))
    lines = [(order, 10 + order % 7, order % 5, line, float(2 + line), 901.25 * line, "ARN"[line % 3], "OF"[line % 2], datetime(2024, 1, line)) for order in FAR for line in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(n, f"Supplier#{n:09d}") for n in range(5)], "s_suppkey long, s_name string").write.parquet(f"{path}/supplier.parquet")
    return path


def test_ids_of_keys_that_lie_far_apart(spark, far):
    found = {(r["order_id"], r["line"]): r["id"] for r in Inputs(spark, far).records.collect()}
    assert found == {(order, line): wanted(order, line) for order in FAR for line in range(1, 8)}


@pytest.mark.parametrize("name", ["a8_usage_level_per_object", "j1_update_correlations", "j4_propagate_targets", "j8_object_evidence", "j10_details_to_parent"])
def test_queries_on_keys_that_lie_far_apart(spark, far, name):
    assert catalog.QUERIES[name](spark, far).collect()
