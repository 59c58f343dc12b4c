"""Steps whose tasks must stay small when the tables grow."""

import hashlib
from collections import Counter

import pytest

from verdictframe.catalog import load_all
from verdictframe.catalog.base import run
from verdictframe.operators import intervals as U
from verdictframe.operators import ratings as S
from verdictframe.sources import labelled as L


def widest(spark, group, action):
    """The action's result and the largest number of tasks that one of its stages had."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    out = action()
    tracker = sc.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    sc.setJobGroup("rest", "rest")
    return out, max(i.numTasks for s in stages if (i := tracker.getStageInfo(s)))


def test_hash_draws_are_dealt(spark):
    # one evaluation is one row, so its draws used to be made by one task
    sizes, b, seed = [70_000, 5, 60_001], 3, 42
    cells = spark.createDataFrame([(None, c, n) for c, n in enumerate(sizes)], "e bigint, cell int, n bigint").coalesce(1)
    rows, tasks = widest(spark, "draws", lambda: U.replicate_cells(cells, ["e"], ["cell"], b, seed, "hash").collect())
    total, want = sum(sizes), Counter()
    for rep in range(b):
        for k in range(total):
            u = int(hashlib.md5(f"{seed}:{rep}:{k}".encode()).hexdigest()[:8], 16) % total
            want[rep, sum(u >= sum(sizes[: i + 1]) for i in range(len(sizes)))] += 1
    assert {(r["b"], r["cell"]): r["n"] for r in rows} == dict(want)
    assert {r["e"] for r in rows} == {None}
    assert tasks >= spark.sparkContext.defaultParallelism


def test_file_in_parts_is_one_file(spark, tmp_path):
    # a large file used to be written by one task, as only single files were classified
    for name, parts in {"a": [b" \n", b"<html>x\n", b"{}\n"], "b": [b"x,y\n", b"\xff\xfe\n"], "c": [b"\n", b" \n"], "d": [b"x,y\n", b"{}\n"]}.items():
        (tmp_path / name).mkdir()
        for i, data in enumerate(parts):
            (tmp_path / name / f"part-{i:05d}.txt").write_bytes(data)
        (tmp_path / name / "other.log").write_bytes(b"[]")
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["verdict"]) for r in L.classify_parts(spark, str(tmp_path), ".txt").collect()}
    assert got == {"a": (13, "web_page"), "b": (7, "not_utf8"), "c": (3, "table"), "d": (7, "table")}


@pytest.mark.parametrize("name", ["sco_11_total_score", "stu_11_export_runs"])
def test_ratings_are_dealt_by_rows(spark, monkeypatch, name):
    # partitions used to be joined by their compressed size, so that a task's rows grew with the table
    load_all()
    sf = "/root/testdata/sf0.001"
    want, _ = widest(spark, f"{name} whole", lambda: sorted(map(str, run(name, spark, sf).collect())))
    rows = 5 * spark.read.parquet(f"{sf}/orders.parquet").count()
    monkeypatch.setattr(S, "TASK_ROWS", rows // 40)
    got, tasks = widest(spark, f"{name} dealt", lambda: sorted(map(str, run(name, spark, sf).collect())))
    assert got == want
    assert tasks >= 40
