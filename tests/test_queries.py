"""Every registered query against its SQL check, on the smallest tables."""

import pytest

from lineforge.operators.antijoin import not_in
from lineforge.operators.dedupe import dedupe_max_max
from lineforge.operators.sampling import holdout_tail
from lineforge.operators.upsert import upsert
from lineforge.plans import gold, silver
from lineforge.workload.all import ORACLES, QUERIES
from lineforge.workload.bronze import bronze_table
from lineforge.workload.compare import oracle_connection, verdict

# Operators of the inventory, by the key under which they are registered.
INVENTORY = """
scan_parquet write_parquet append_parquet read_csv write_csv table_overwrite table_append
csv_multi_line raw_landing stage_table json_pages flatten_struct seed_status table_scan dtype_schema
clean_columns add_md apply_schema to_integer to_timestamp mdy_to_date iso_to_date nan_to_null
void_to_string stamp_provenance silver_parts silver_status gold_dimstatus cast_int trim_all
mixed_date pso_pad default_purged default_status day_diffs encode_categories filter_not_null
gold_emergency filter_keep_unknown after_watermark_row rmse gold_factparts not_in_anti
merge_upsert align_predictions gold_dimcarrier batch_size dq_unique dq_freshness dedupe_max_max
dedupe_latest holdout_tail holdout_head holdout_unique holdout_text split_train_test union_pages fetch_windows window_select
new_rows_to_score score_append dq_date_format dq_length dq_string_type dq_not_null
dq_entry_after_ship dq_report ml_features ml_fit ml_moments ml_train_evaluate ml_score daily_run_end_to_end
""".split()


@pytest.fixture(scope="module")
def duck():
    return oracle_connection("/root/testdata/sf0.001")


def test_inventory_is_registered_and_checked():
    assert set(INVENTORY) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    assert verdict(QUERIES[name](spark, small), duck, ORACLES[name]).startswith("ok")


def test_building_an_operator_runs_nothing(spark, small):
    lines = bronze_table(spark, small)
    parts = silver.silver_parts(lines)
    status = spark.createDataFrame([(1, "Shipped")], "sequence int, status string")
    keyed = lines.selectExpr("polExternalID as k", "insertDateTime as JOTSTP", "pso as JOSEQN")
    spark.sparkContext.setJobGroup("building", "operators")
    try:
        dedupe_max_max(keyed, ["k"])
        not_in(lines, lines.limit(3), "polExternalID")
        upsert(lines, lines)
        gold.fact_parts(parts, status)
        holdout_tail(lines, ("orderEntryDate", "polExternalID"))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_entry(spark):
    import __spark_entry__ as contract

    frame = contract.entry(spark)
    assert frame.columns == ["DISTRIBUTION_CENTER", "ORDERTYPE", "COUNT_OF_ITEMS"]
    assert 0 < frame.count() <= 10
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())
