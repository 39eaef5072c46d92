"""Tables of a run of removals that nothing reads any more."""
from __future__ import annotations

from silvergrain.llm import shared_passages
from silvergrain.session import cut_lineage, drop_cut


def test_anchors_are_dropped_once_shared_ones_are_written(spark, monkeypatch):
    """All anchors are the largest table, and no later step reads it; groups dealt anew drop theirs, too."""
    dropped = []
    monkeypatch.setattr(shared_passages, "drop_cut", lambda cut: (dropped.append(cut.columns), drop_cut(cut)), raising=False)
    passage = "".join(f"{i * 7919 % 1000:03} " for i in range(150))
    rows = [(i, f"{i} start {passage} end {i * i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    settings = shared_passages.Settings(limit=2)
    got = {r["doc_id"]: r for r in shared_passages.without_repeats(docs, settings).collect()}
    assert all(r["n_removed"] >= 600 and r["n_spans"] == 1 for r in got.values())
    assert len(dropped) >= 2 and all("cid" in columns for columns in dropped)


def test_a_dropped_cut_is_gone(spark):
    import os

    cut = cut_lineage(spark.range(3))
    folder = os.path.dirname(cut.inputFiles()[0]).removeprefix("file:")
    assert os.path.isdir(folder)
    drop_cut(cut)
    assert not os.path.exists(folder)


def test_a_cut_leaves_no_shuffle_files(spark):
    """They go when the table is written, and the session's own setting is as before."""
    import glob
    import os
    import tempfile
    import time

    from silvergrain import session

    local = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
    count = lambda: len(glob.glob(f"{local}/**/blockmgr-*/**/shuffle_*.data", recursive=True))
    assert glob.glob(f"{local}/**/blockmgr-*", recursive=True)
    before = spark.conf.get(session.CLEANUP)
    held = count()
    cut = cut_lineage(spark.range(1000).groupBy("id").count())
    for _ in range(50):  # files are removed by a thread of their own
        if count() <= held:
            break
        time.sleep(0.2)
    assert count() <= held and spark.conf.get(session.CLEANUP) == before and cut.count() == 1000
