from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from listweave.functions import times

A = F.col("a")
NOW = datetime(2026, 3, 30, 12, tzinfo=timezone.utc)


def test_time_recency(value_of):
    texts = {
        "2026-03-29T12:00:00": False,  # equal to the cutoff
        "2026-03-29T11:59:59": True,
        "2026-03-29 11:59": True,
        "2026-03-29T11:59:59.999999+00:00": True,
        "2026-03-29T13:59:59+02:00": True,
        "2026-03-29T14:00:00+02:00": False,
        "2026-03-29T11:59:59Z": True,
        "2026-03-29T13:59:59+0200": True,
        "2026-03-29T14:00+0200": False,
        "2026-03-28": True,
        "20260328": True,
        "20260230": False,
        "2026": False,
        "10:00:00": False,
        "not-a-date": False,
        "2026-02-30": False,
        "2020-01-01T10:00:00 Europe/Paris": False,
        "": False,
        None: False,
    }
    old = times.older_than_time(A, NOW, 1)
    assert dict(zip(texts, value_of(old, *texts))) == texts


def test_forms_equal_fromisoformat(value_of):
    forms = [
        "2026-03-27T10", "20260327T100000", "20260327T1000", "20260327T10", "20260327T100000Z",
        "2026-03-27T10:00:00+02", "2026-03-27T10:00:00,25", "2026-03-27 10:00:00.123456",
        "2026-W13-5", "2026W135", "2026-W13", "2026-W01-1", "2020-W53-7", "2026-W13-5T10:30-05:30",
        "20260327T103000+0130", "2026-03-27T23:59:59Z", "1999-12-31",
    ]
    got = value_of(F.unix_micros(times.iso_timestamp(A)), *forms)
    zero = datetime(1970, 1, 1, tzinfo=timezone.utc)
    for form, micros in zip(forms, got, strict=True):
        expected = datetime.fromisoformat(form)
        if expected.tzinfo is None:
            expected = expected.replace(tzinfo=timezone.utc)
        assert micros == (expected - zero) // timedelta(microseconds=1), form
    broken = ["2026-W54-1", "2021-W53-1", "2026-W13-8", "2026-3-27", "2026-03-27T1", "2026-03-27T10:0",
              "2026-03-27T25", "2026-03-27T10:00:00+2", "2026-13-01", "26-03-27", "T10:00"]
    assert value_of(times.iso_timestamp(A), *broken) == [None] * len(broken)
    days = value_of(times.iso_date(A).cast("string"), "2026-W13-5", "20260327", "2026-03-27T10")
    assert days == ["2026-03-27", "2026-03-27", None]


def test_date_recency(value_of):
    texts = {
        "2026-03-29": False,
        "2026-03-28": True,
        "20260328": True,
        "2026-03-27T10:00:00": False,
        "2026": False,
        "x": False,
        "": False,
        None: False,
    }
    old = times.older_than_date(A, NOW, 1)
    assert dict(zip(texts, value_of(old, *texts))) == texts


def test_days_zero_is_a_cutoff_and_none_is_off(value_of):
    text = "2026-03-30T11:00:00"
    assert value_of(times.older_than_time(A, NOW, 0), text) == [True]
    assert value_of(times.older_than_time(A, NOW, None), text, "1999-01-01") == [False, False]
    assert value_of(times.older_than_date(A, NOW, 0), "2026-03-29", "2026-03-30") == [True, False]
    assert value_of(times.older_than_date(A, NOW, None), "1999-01-01") == [False]


def test_naive_as_of_means_utc():
    assert times.cutoff_time(datetime(2026, 3, 30, 12), 1) == NOW - timedelta(days=1)
    zoned = datetime(2026, 3, 30, 1, tzinfo=timezone(timedelta(hours=2)))
    assert times.cutoff_date(zoned, 0).isoformat() == "2026-03-29"


def test_window_seconds(value_of):
    days = A.cast("int")
    assert value_of(times.window_seconds(days), "0", "1", "2", "7", "8", "365") == [
        86400, 86400, 604800, 604800, 2592000, 2592000,
    ]


def test_ingest_stamp(spark):
    stamps = {r[0] for r in spark.range(50).select(times.ingest_stamp()).collect()}
    assert len(stamps) == 1
    stamp = stamps.pop()
    assert len(stamp) == len("2026-03-30T10:00:00+00:00") and stamp.endswith("+00:00")
    age = datetime.now(timezone.utc) - datetime.fromisoformat(stamp)
    assert timedelta(0) <= age < timedelta(minutes=5)


def test_newest_first(spark):
    times_ = ["2026-03-01", "x", "2026-03-30T10:00:00Z", None, "2026-03-30T10:00:00.5Z"]
    df = spark.createDataFrame([(t,) for t in times_], "a string")
    got = [r.a for r in df.orderBy(times.newest_first(A), F.col("a").desc()).collect()]
    assert got == ["2026-03-30T10:00:00.5Z", "2026-03-30T10:00:00Z", "2026-03-01", "x", None]
