"""Versions of tables, released cuts, ledgers and failure rows."""
from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from silvergrain import session
from silvergrain.operators import sidecars
from silvergrain.sources.tables import VersionedTable


def test_a_failed_write_changes_nothing(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path))
    with pytest.raises(ValueError):
        table.current()
    table.commit(spark.range(3))
    with pytest.raises(Exception):
        table.commit(table.current().select(F.raise_error(F.lit("lost")).alias("id")))
    assert table.log().count() == 1 and table.current().count() == 3
    table.commit(table.current().where("id > 0"), "without the first")
    assert sorted(r["id"] for r in table.current().collect()) == [1, 2]
    assert [r["version"] for r in table.log().orderBy("version").collect()] == [1, 2]
    table.drop_old()
    assert table.current().count() == 2 and sum(f.startswith("v") for f in os.listdir(tmp_path)) == 2  # the failed one stays


def test_cuts_are_deleted_when_released(spark):
    cut = session.cut_lineage(spark.range(5))
    path = session._CUTS[-1]
    assert cut.count() == 5 and os.path.isdir(path)
    session.release_cuts()
    assert not os.path.exists(path) and not session._CUTS


def test_runs_are_numbered_on(spark):
    scored = spark.createDataFrame([("a", "v1", "t1", ""), ("b", "v1", "t3", "x_failed"), ("c", "v2", "t2", None)],
                                   "sha1 string, model_version string, scored_at string, warnings string")
    runs = sidecars.ledger_rows(scored, "m", "n")
    once = sidecars.appended_runs(None, runs)
    twice = sidecars.appended_runs(once, runs).orderBy("run_id").collect()
    assert [(r["run_id"], r["model_version"], r["images_attempted"], r["images_failed"]) for r in twice] == [
        (1, "v1", 2, 1), (2, "v2", 1, 0), (3, "v1", 2, 1), (4, "v2", 1, 0)]
    assert (twice[0]["started_at"], twice[0]["completed_at"]) == ("t1", "t3")


def test_failure_rows_have_the_columns_of_the_table(spark):
    template = spark.createDataFrame([], "sha1 string, score double, flag int, note string, warnings string")
    rows = sidecars.failure_rows(spark.createDataFrame([("a",)], "sha1 string"), template, {"warnings": F.lit("open_failed")})
    assert rows.dtypes == template.dtypes and rows.first() == ("a", 0.0, 0, "", "open_failed")
