"""Joins of tables that grow with the archive send none of them whole through the driver."""
from __future__ import annotations

import pytest

import silvergrain.plans.catalog  # noqa: F401
from silvergrain.plans.registry import PLANS
from silvergrain.sources.archive import Archive


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["score_failures", "hero_scores", "interesting_scores"])
def test_signal_tables_are_not_broadcast(spark, data_dir, name):
    """However small their files: Spark would judge them by these and not by their rows."""
    text = plan_text(PLANS[name](Archive(spark, data_dir)))
    assert "SortMergeJoin" in text and "Broadcast" not in text


@pytest.mark.parametrize("name, heavy", [("minute_best", "path_tags"), ("timeline_day_rows", "custom_tags"),
                                         ("grid_keys", "top_labels_json"), ("detail_record", "")])
def test_joins_carry_what_the_result_reads(spark, data_dir, name, heavy):
    """The long texts of a photo aren't shuffled for results that don't show them, nor are its tables broadcast."""
    df = PLANS[name](Archive(spark, data_dir))
    text = plan_text(df)
    assert text.count("SortMergeJoin") >= 5 and "BroadcastHashJoin [sha1" not in text
    for line in text.splitlines():  # what an exchange sends is the project or scan below it
        if heavy and "Project" in line:
            assert f" {heavy}#" not in line.replace(f"AS {heavy}#", "")


def test_a_hot_second_in_state_keeps_nulls_and_the_best():
    """Photos of a group become sessions without a frame operation per group; nulls come before all others."""
    import pandas as pd
    from pyspark.sql.types import StructType

    from silvergrain.streaming.session_state import Sessions

    class Kept:
        rows: list = []
        get = lambda self: iter(self.rows)
        put = lambda self, rows: setattr(self, "rows", rows)

    step = Sessions(["k"], 15, StructType().add("size", "long").add("first_taken", "long").add("last_taken", "long")
                    .add("hero_score", "double").add("final_dt", "string").add("sha1", "string"))
    step.sessions = Kept()
    part = pd.DataFrame({"ts": [9, 9, 40], "hero_score": [None, 0.0, float("nan")], "final_dt": [None, None, "x"], "sha1": ["a", "b", "c"]})
    out = next(step.handleInputRows(("k",), iter([part, part]), None))
    assert step.sessions.rows == [(4, 9, 9, 0.0, None, "b"), (2, 40, 40, None, "x", "c")] and len(out) == 2
