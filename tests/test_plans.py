"""Every named query against its DuckDB twin."""

import datetime
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import registry
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf, name):
    assert differences(registry.queries()[name](spark, sf), sf, registry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_kth_distance_counts_all_ties(spark, sf, tmp_path):
    for f in os.listdir(sf):
        os.symlink(f"{sf}/{f}", tmp_path / f)
    (tmp_path / "customer.parquet").unlink()
    pq.write_table(pq.read_table(f"{sf}/customer.parquet").take([1] * 3000), tmp_path / "customer.parquet")
    got = registry.queries()["gis_kth_distance"](spark, str(tmp_path))
    assert [r.ties for r in got.collect()] == [3000]
    assert differences(got, str(tmp_path), registry.oracle_sql()["gis_kth_distance"]) == ""


def test_messages_are_in_the_order_of_rounded_milliseconds(spark, sf, tmp_path):
    for f in os.listdir(sf):
        os.symlink(f"{sf}/{f}", tmp_path / f)
    (tmp_path / "events.parquet").unlink()
    at = lambda us: datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us)
    # Pairs of one business id 6000 ms apart to the millisecond or nearly so, which the offset's part of the time makes up for; halves; moments before 1970; no moment.
    times = {6: 10_000_400, 7: 15_999_600, 20: 1_704_067_200_000_500, 21: 1_704_067_206_000_499, 34: -1_500, 35: 5_998_501, 48: -6_000_501, 49: -500, 62: 7_000_600, 63: 13_000_400, 68: None, 69: 5_000, 76: 10_000_600, 77: 16_000_499}
    pq.write_table(pa.table({"event_id": list(times), "ts": pa.array([None if t is None else at(t) for t in times.values()], pa.timestamp("us")), "user_id": [k * 5 % 7 for k in times], "event_type": ["click"] * len(times), "value": [k / 4 for k in times], "props": ["{}"] * len(times)}), tmp_path / "events.parquet")
    for name in ("a9_unique_by_business_key", "a9_health", "a9_latency"):
        assert differences(registry.queries()[name](spark, str(tmp_path)), str(tmp_path), registry.oracle_sql()[name]) == "", name
