from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cashtide import Settings  # noqa: E402
from cashtide.session import local_session, send_code_with_tasks  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    send_code_with_tasks()
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(
        "4",
        app="tests",
        **{"spark.checkpoint.dir": str(shared), "spark.sql.shuffle.partitions": "4"},
    )
    yield session
    session.stop()


@pytest.fixture
def settings():
    return Settings(as_of=date(2021, 4, 10), series_start=date(2020, 12, 1))


CHARGE_DDL = "status string, created timestamp_ntz, amount double, currency string, description string"


def charge_rows():
    from datetime import datetime as dt

    return [
        ("Paid", dt(2021, 1, 10, 9), 349.0, "aud", "Subscription update"),
        ("Paid", dt(2021, 1, 20, 12), 250.0, "usd", "IV League - Booking"),
        ("Paid", dt(2021, 2, 5, 15), 599.0, "aud", "Subscription creation"),
        ("Refunded", dt(2021, 2, 6, 15), 349.0, "aud", "Subscription update"),
        ("Paid", dt(2021, 3, 1, 10), 2200.0, "aud", "Package initiation"),
    ]


@pytest.fixture
def charges(spark):
    """Five rows that trigger every cleaning rule; three survive."""
    return spark.createDataFrame(charge_rows(), CHARGE_DDL)


@pytest.fixture
def make_arrays(spark):
    """Series arrays from a dict of lists."""

    def build(series: dict[str, list[float]], first_month: date = date(2015, 1, 1)):
        rows = [(k, first_month, [float(v) for v in ys]) for k, ys in series.items()]
        return spark.createDataFrame(
            rows, "series_id string, first_month date, ys array<double>"
        )

    return build
