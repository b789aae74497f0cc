import math
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from hiretide.llm import mixing, sharding
from hiretide.llm.common import numbered


def targets(sizes):
    """Excess over three sizes handed on by weight until nobody is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total = sum(sizes.values())
    target = {s: total * weight[s] / sum(weight.values()) for s in names}
    full = set()
    while True:
        over = {s: target[s] - 3 * sizes[s] for s in names if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= set(over)
        for s in over:
            target[s] = 3.0 * sizes[s]
        rest = sum(weight[s] for s in names if s not in full)
        for s in names:
            if s not in full:
                target[s] += sum(over.values()) * weight[s] / rest


def test_mix(spark, odd_documents, odd_rows, no_documents):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += size(r[1])
    want = targets(sizes)
    rows = odd_documents.select("doc_id", "source", mixing.words("text").alias("size"))
    got = mixing.systematic_copies(rows, "size").collect()
    assert len(got) == len(odd_rows)
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        rate = r.target / r.source_size if r.source_size else 0
        assert math.floor(rate - 1e-9) <= r.copies <= min(3, math.ceil(rate + 1e-9))
        taken[r.source] += r.copies * r["size"]
        most[r.source] = max(most[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s]
    again = mixing.systematic_copies(rows.repartition(7), "size").collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    mixed = mixing.mix(odd_documents)
    assert mixed.columns == odd_documents.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(no_documents).count() == 0
    only_empty = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert mixing.mix(only_empty).count() == 0


def test_targets_stop_at_three_sizes():
    sizes = {"a": 1, "b": 1, "c": 1000, "d": 5, None: 2}
    got = targets(sizes)
    assert math.isclose(sum(got.values()), 1009) and got["b"] == 3


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 3, 5, 40, 97, 1000, 4097):
        got = spark.range(n).select(sharding.permuted(F.col("id"), n).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))
    shuffled = [r.p for r in spark.range(1000).select(sharding.permuted(F.col("id"), 1000).alias("p")).orderBy("id").collect()]
    assert shuffled != sorted(shuffled)


def test_shards(odd_documents, odd_rows, no_documents):
    size, crc = sharding.sizes("text")
    rows = odd_documents.select("doc_id", size.alias("size"), crc.alias("crc"))
    order = [F.col("doc_id"), F.col("crc"), F.col("size")]
    got = sharding.sharded(rows, order, 7).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(odd_rows) and set(slots) <= set(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert Counter((r.doc_id, r["size"], r.crc) for r in got) == want
    again = sharding.sharded(rows.repartition(9), order, 7).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.sharded(no_documents.select("doc_id"), [F.col("doc_id")]).count() == 0
    few = rows.limit(3)
    assert sorted(r.shard for r in sharding.sharded(few, order, 40).collect()) == [0, 1, 2]
    plan = sharding.sharded(rows, order)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_row_numbers_of_ties(spark):
    same = spark.range(1000).select(F.lit(1).alias("k"), F.lit("x").alias("_range"))
    got = numbered(same, [F.col("k")], "number").collect()
    assert sorted(r.number for r in got) == list(range(1000))
