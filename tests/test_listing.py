"""Folder trees listed by tasks, against a walk of the same folders."""
from __future__ import annotations

import os

from silvergrain.sources import listing


def walked(root) -> dict[str, int]:
    found = {}
    for folder, folders, names in os.walk(root):
        folders[:] = [f for f in folders if not f.startswith("_")]
        for name in names:
            full = os.path.join(folder, name)
            found[os.path.relpath(full, root)] = os.path.getsize(full)
    return found


def listed(spark, roots) -> dict:
    rows = listing.list_tree(spark, {k: str(v) for k, v in roots.items()}, tasks=3).collect()
    assert len({(r["source"], r["rel_path"]) for r in rows}) == len(rows)
    return {source: {r["rel_path"]: r["file_size"] for r in rows if r["source"] == source} for source in roots}


def test_equals_a_walk(spark, tmp_path):
    names = ["1.jpg", "a/2.JPG", "a/b/c/d/3.txt", "a/_private/4.jpg", "_top/5.jpg", "a/_odd.jpg", "ä ö/6 %20#?.png", "a/b/none"]
    for i, name in enumerate(names):
        full = tmp_path / "one" / name
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(b"x" * i)
    (tmp_path / "one" / "empty" / "deeper").mkdir(parents=True)
    os.symlink(tmp_path / "one", tmp_path / "one" / "a" / "loop")
    (tmp_path / "two").mkdir()
    got = listed(spark, {"one": tmp_path / "one", "two": f"{tmp_path}/two/", "none": tmp_path / "missing"})
    assert got == {"one": walked(tmp_path / "one"), "two": {}, "none": {}} and len(got["one"]) == 6


def test_a_written_tree_comes_back(spark, tmp_path):
    rows = [(f"{i % 7}/{i % 3}/{i}.jpg", "é" * i) for i in range(60)]
    files = spark.createDataFrame(rows, "rel_path string, content string").repartition(5)
    assert listing.write_tree(files, str(tmp_path / "t")) == 60 == listing.write_tree(files, str(tmp_path / "t"))
    assert listed(spark, {"s": tmp_path / "t"}) == {"s": {p: 2 * len(c) for p, c in rows}}
    seen = listing.list_tree(spark, {"s": str(tmp_path / "t")}).where("mtime > 1600000000")
    assert seen.count() == 60
    assert listing.write_tree(files.where("false"), str(tmp_path / "u")) == 0
