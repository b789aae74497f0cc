"""Run artifacts: order of paths, and documents read in pieces."""

import json

import pytest
from pyspark.sql import functions as F

from hiretide.sources import artifacts


def document(*ids):
    jobs = [{"company_name": "c", "job_title": f"t{i}", "ats_job_id": str(i), "content_hash": f"h{i}"} for i in ids]
    return {"generated_at": "2026-01-01T00:00:00Z", "source_count": 1, "job_count": len(jobs), "jobs": jobs,
            "sources": [{"source_url": f"u{ids[0]}", "status": "success"}], "failures": []}


def write(path, *ids):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(document(*ids)))
    return str(path)


def read(spark, paths, **options):
    sources, jobs, failures = artifacts.read_pull(spark, paths, **options)
    assert failures.count() == 0
    assert sorted((r["run_ord"], r["source_url"]) for r in sources.collect()) is not None
    return sorted((r["run_ord"], r["pos"], r["ats_job_id"]) for r in jobs.collect())


def test_paths_that_end_alike(spark, tmp_path):
    one, old = write(tmp_path / "run1.json", 1, 2), write(tmp_path / "old_run1.json", 3)
    assert read(spark, [one, old]) == [(0, 0, "1"), (0, 1, "2"), (1, 0, "3")]
    assert read(spark, [old, one]) == [(0, 0, "3"), (1, 0, "1"), (1, 1, "2")]


def test_folders_inside_folders(spark, tmp_path):
    write(tmp_path / "a" / "x.json", 1)
    write(tmp_path / "b" / "a" / "x.json", 2)
    a, b = str(tmp_path / "a"), str(tmp_path / "b" / "a")
    assert read(spark, [a, b]) == [(0, 0, "1"), (1, 0, "2")]
    assert read(spark, [b + "/", f"file://{a}", a]) == [(0, 0, "2"), (1, 0, "1"), (2, 0, "1")]


def test_a_file_and_its_folder(spark, tmp_path):
    one = write(tmp_path / "d" / "x.json", 1)
    write(tmp_path / "d" / "y.json", 2)
    assert read(spark, [str(tmp_path / "d"), one, one]) == [(0, 0, "1"), (0, 0, "2"), (1, 0, "1"), (2, 0, "1")]
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        read(spark, [one, str(tmp_path / "missing.json")])


def test_odd_names_and_patterns(spark, tmp_path):
    plus, blank = write(tmp_path / "run+1 é.json", 1), write(tmp_path / "run%201.json", 2)
    assert read(spark, [plus, blank]) == [(0, 0, "1"), (1, 0, "2")]
    for i in range(3):
        write(tmp_path / "many" / f"p{i}.json", 10 + i)
    assert [r[0] for r in read(spark, [f"{tmp_path}/many/p*.json", plus])] == [0, 0, 0, 1]


def test_a_plan_of_constant_size(spark, tmp_path):
    paths = [write(tmp_path / f"r{i}.json", i) for i in range(40)]

    def size(n):
        _, jobs, _ = artifacts.read_pull(spark, paths[:n])
        return len(jobs.select("run_ord", "pos")._jdf.queryExecution().optimizedPlan().treeString().split("\n"))

    assert size(2) == size(40)
    assert [r[0] for r in read(spark, paths)] == list(range(40))
