"""Every registered query of the library against its SQL."""

import os
from datetime import datetime, timedelta

import pytest

from mediaspark.plans import queries
from mediaspark.plans.fixtures import TABLES
from oracle import oracle, same


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_oracle(spark, sf_dir, name):
    assert same(queries.QUERIES[name](spark, sf_dir), *oracle(queries.ORACLE[name], sf_dir))


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_rate_and_eta_of_part_seconds(spark, sf_dir, tmp_path, zone):
    at = datetime
    ends = {  # first and last time, whole seconds between them
        "down": (at(2024, 1, 1, 0, 0, 0, 900000), at(2024, 1, 1, 0, 0, 10, 100000), 9), "up": (at(2024, 1, 1, 0, 0, 0, 100000), at(2024, 1, 1, 0, 0, 9, 900000), 10),
        "half, even": (at(2024, 1, 1), at(2024, 1, 1, 0, 0, 2, 500000), 2), "half, odd": (at(2024, 1, 1), at(2024, 1, 1, 0, 0, 3, 500000), 4),
        "no time": (at(2024, 1, 1, 0, 0, 0, 900000), at(2024, 1, 1, 0, 0, 1, 200000), 0), "early": (at(1959, 12, 31, 23, 59, 59, 700000), at(1960, 1, 1, 0, 0, 2, 100000), 2),
        "late": (at(2500, 1, 1, 0, 0, 0, 100001), at(2500, 1, 1, 0, 0, 7, 900002), 8), "clock change": (at(2024, 3, 10, 1, 30, 0, 250000), at(2024, 3, 10, 2, 30, 0, 900000), 3601),
        "null": (None, None, None), None: (at(2024, 1, 1, 0, 0, 0, 900000), at(2024, 1, 1, 0, 0, 2, 800000), 2)}
    rows = [(k, t) for k, (a, b, _) in ends.items() for t in (a, b)]
    rows += [("tie", at(2024, 1, 1) + timedelta(seconds=2_000_000 if k else 0)) for k in range(249)]  # 0.0001245 a second
    for t in TABLES:
        if t != "events":
            os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.createDataFrame(rows, "event_type string, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = queries.QUERIES["a21_rate_and_eta"](spark, str(tmp_path))
        assert same(got, *oracle(queries.ORACLE["a21_rate_and_eta"], str(tmp_path)))
        assert {r["event_type"]: r["elapsed"] for r in got.collect()} == {k: s for k, (_, _, s) in ends.items()} | {"tie": 2_000_000}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
