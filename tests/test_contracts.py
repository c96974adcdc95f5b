from __future__ import annotations

from datetime import date, datetime

import pytest
from conftest import CHARGE_DDL, charge_rows
from pyspark.sql import functions as F

from cashtide.operators import contracts

AS_OF = date(2021, 4, 10)


def test_valid_charges_pass(charges):
    assert contracts.enforce(charges, contracts.charge_rules(AS_OF)) == 5


@pytest.mark.parametrize("column", ["amount", "status", "created"])
def test_missing_column_is_named(charges, column):
    with pytest.raises(contracts.ContractError, match=column):
        contracts.enforce(charges.drop(column), contracts.charge_rules(AS_OF))


def test_extra_columns_and_order_do_not_matter(charges):
    shuffled = charges.withColumn("extra", F.lit(1)).select(
        "extra", "description", "amount", "created", "status"
    )
    assert contracts.enforce(shuffled, contracts.charge_rules(AS_OF)) == 5


@pytest.mark.parametrize("when", [datetime(2099, 1, 1), datetime(2009, 6, 15)])
def test_dates_out_of_range_are_rejected(spark, when):
    rows = charge_rows()
    rows[0] = (rows[0][0], when, *rows[0][2:])
    with pytest.raises(contracts.ContractError, match="created_in_range"):
        contracts.enforce(spark.createDataFrame(rows, CHARGE_DDL), contracts.charge_rules(AS_OF))


def test_one_day_ahead_is_allowed(spark):
    rows = [("Paid", datetime(2021, 4, 11), 1.0, "aud", "x")]
    assert contracts.enforce(spark.createDataFrame(rows, CHARGE_DDL), contracts.charge_rules(AS_OF)) == 1


def test_all_failures_are_reported_together(spark):
    frame = spark.createDataFrame(
        [(None, "x", "2021-01-01"), ("Paid", None, "never"), ("Paid", "1", None)],
        "status string, amount string, created string",
    ).withColumn("description", F.lit(None).cast("string"))
    with pytest.raises(contracts.ContractError) as caught:
        contracts.enforce(frame, contracts.charge_rules(AS_OF))
    for rule in ("status_present", "amount_present", "amount_numeric", "created_present", "created_timestamp"):
        assert rule in str(caught.value)


def test_quarantine_splits_without_losing_rows(spark):
    frame = spark.createDataFrame(
        [("Paid", "1", "2021-01-01"), (None, "x", "2021-01-01")],
        "status string, amount string, created string",
    )
    good, bad = contracts.split_valid(frame, contracts.charge_rules(AS_OF))
    assert good.count() == 1
    assert bad.first()["reasons"] == ["status_present", "amount_numeric"]


def test_nothing_left_is_an_error(charges):
    with pytest.raises(contracts.ContractError, match="no rows survived"):
        contracts.require_rows(charges.filter("status = 'x'"))


@pytest.mark.parametrize(
    "horizon, level, valid",
    [(1.0, 80, True), (24.0, 95, True), (0.0, 80, False), (25.0, 80, False), (12.0, 90, False),
     (12.0, None, True), (1.5, 80, False), (None, 80, False), (float("nan"), 80, False),
     (float("inf"), 80, False), (float("-inf"), 80, False)],
)
def test_request_rules(spark, horizon, level, valid):
    frame = spark.createDataFrame([(1, horizon, level)], "request_id long, horizon double, level int")
    ready = contracts.with_default_level(contracts.require_known_columns(frame))
    good, _ = contracts.split_valid(ready, contracts.request_rules())
    assert (good.count() == 1) is valid


def test_unknown_request_field_is_rejected(spark):
    frame = spark.createDataFrame([(1, 2, 80, True)], "request_id long, horizon int, level int, x boolean")
    with pytest.raises(contracts.ContractError, match="unknown request fields"):
        contracts.require_known_columns(frame)


def test_forecast_contract_rejects_each_defect(spark):
    rows = [
        (1, 2, 1, 5.0, 4.0, 6.0), (1, 2, 2, 5.0, 4.0, 6.0),  # fine
        (2, 2, 1, 5.0, 4.0, 6.0),  # a month is missing
        (3, 1, 1, float("nan"), 4.0, 6.0),
        (4, 1, 1, -1.0, 4.0, 6.0),
        (5, 1, 1, 5.0, 7.0, 6.0),
        (6, 1, 1, 5.0, None, 6.0),
    ]
    frame = spark.createDataFrame(
        rows, "request_id int, horizon int, step int, yhat double, lo double, hi double"
    )
    verdict = {r["request_id"]: r["accepted"] for r in contracts.forecast_contract(frame).collect()}
    assert verdict == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    with pytest.raises(contracts.ContractError, match="lacks columns"):
        contracts.forecast_contract(frame.drop("lo"))


@pytest.mark.parametrize("amount", ["NaN", "Infinity", "99999999999999999999"])
def test_amounts_cleaning_cannot_read_break_the_contract(spark, amount):
    row = [("Paid", "2021-01-10 09:00:00", amount, "x")]
    charges = spark.createDataFrame(row, "status string, created string, amount string, description string")
    with pytest.raises(contracts.ContractError, match="amount_numeric"):
        contracts.enforce(charges, contracts.charge_rules(date(2021, 4, 10)))
