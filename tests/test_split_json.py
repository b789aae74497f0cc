"""Documents read in byte ranges give what a whole read gives, wherever the cuts fall."""

import io
import json
import random

import pytest

from hiretide.sources import artifacts, split_json


def odd_document(seed):
    draw = random.Random(seed)
    texts = ['a "b" {[:]}', "\\", '\\"', "ends with \\\\", "é 日本", "}, {", '"jobs": [{', "", "\n\t", "x" * 50]

    def job(i):
        return {"job_title": draw.choice(texts), "ats_job_id": str(i), "departments": [draw.choice(texts) for _ in range(draw.randrange(3))],
                "extra": {"jobs": [{"a": {}}], draw.choice(texts): 1}}

    sections = {
        "generated_at": "2026-01-01T00:00:00Z", "status_counts": {"jobs": 3}, "sources": [{"source_url": draw.choice(texts), "status": "success"}],
        "jobs": [job(i) for i in range(draw.randrange(12))], "failures": [], "note": draw.choice(texts),
    }
    keys = list(sections)
    draw.shuffle(keys)
    return {k: sections[k] for k in keys}


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [1, 2, 3, 7, 20, 101, 10**6])
def test_every_cut(size, indent):
    for seed in range(12):
        wanted = odd_document(seed)
        data = json.dumps(wanted, indent=indent, ensure_ascii=seed % 2 == 0).encode()
        if seed % 3 == 0:
            data = b"  \n" + data + b"\n\n"
        file = io.BytesIO(data)
        cuts = list(range(0, len(data), size))
        told = split_json.states([
            split_json.summary(data[a:a + size], data[max(0, a - split_json.LONGEST_KEY):a]) for a in cuts
        ])
        found = [
            row for a, state in zip(cuts, told, strict=True)
            for row in split_json.elements(file, a, min(a + size, len(data)), state, {"jobs", "sources", "failures"})
        ]
        assert [at for _, at, _ in found] == sorted({at for _, at, _ in found})
        for name in ("jobs", "sources", "failures"):
            assert [json.loads(text) for section, _, text in found if section == name] == wanted[name]


def test_reads_what_a_whole_read_gives(spark, tmp_path):
    paths = []
    for i, name in enumerate(["run1.json", "old_run1.json", "odd +%20é name.json"]):
        (tmp_path / name).write_text(json.dumps(odd_document(40 + i), indent=i or None))
        paths.append(str(tmp_path / name))
    (tmp_path / "empty.json").write_text("")
    paths = [*paths, paths[0], str(tmp_path / "empty.json")]
    for whole, split in zip(artifacts.read_pull(spark, paths), artifacts.read_pull(spark, paths, range_bytes=64), strict=True):
        assert split.columns == whole.columns
        order = lambda df: [tuple(r)[0:1] + tuple(r)[2:] for r in df.orderBy("run_ord", "pos").collect()]
        assert order(split) == order(whole)


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    jobs = [{"ats_job_id": str(i), "job_title": "t" * 300} for i in range(20_000)]
    (tmp_path / "run.json").write_text(json.dumps({"jobs": jobs, "sources": [], "failures": []}))
    _, found, _ = artifacts.read_pull(spark, [str(tmp_path / "run.json")], range_bytes=1 << 20)
    assert found.rdd.getNumPartitions() >= 6
    assert found.select("ats_job_id").distinct().count() == found.count() == 20_000


def test_other_files_are_an_error(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"jobs": []}]')
    with pytest.raises(Exception, match="not a document with sections"):
        artifacts.read_pull(spark, [str(tmp_path / "list.json")], range_bytes=64)
