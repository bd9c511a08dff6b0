from __future__ import annotations

import os

from listweave.session import pinned, run_folder, scratch, shared_dir


def test_scratch_removes_what_was_pinned_in_it(spark):
    kept = pinned(spark.range(3))
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch(spark):
        inner = pinned(spark.range(5))
        assert inner.count() == 5 and "scratch-" in run_folder(spark, "x")
        assert set(os.listdir(folder)) != before
    assert set(os.listdir(folder)) == before
    assert kept.count() == 3 and "scratch-" not in run_folder(spark, "x")
