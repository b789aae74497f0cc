from collections import Counter

import numpy as np

from hiretide.llm import ngram_join
from hiretide.llm.common import row_keys


def sets_of(rows):
    out = []
    for row in rows:
        words = (row[1] or "").split()
        out.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute_force(rows):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and len(a & b) / len(a | b) >= 0.8:
                links[i] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    name = {root: min((d for d in ids if d is not None), default=None) for root, ids in groups.items()}
    return Counter((rows[i][0], name[find(i)], links[i]) for i in range(len(rows))), groups


def test_classes_and_links_match_brute_force(odd_documents, odd_rows):
    want, _ = brute_force(odd_rows)
    for options in ({}, {"block_shingles": 150}):
        got = ngram_join.jaccard_classes(odd_documents, **options).collect()
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want


def test_one_of_each_class_stays(odd_documents, odd_rows):
    _, groups = brute_force(odd_rows)
    kept = ngram_join.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    blanks = sum(not (r[1] or "").split() for r in odd_rows)
    with_words = sum(bool(s) for s in (sets_of(odd_rows)[root] for root in groups))
    assert kept.count() == blanks + with_words


def test_empty_table(no_documents):
    assert ngram_join.jaccard_classes(no_documents).collect() == []
    assert ngram_join.keep_one(no_documents).collect() == []


def test_prefix_depth_reaches_the_recall():
    depth = ngram_join.prefix_depth()
    assert 1 - (1 - 0.8**depth) ** ngram_join.TREES >= ngram_join.RECALL
    assert 1 - (1 - 0.8 ** (depth + 1)) ** ngram_join.TREES < ngram_join.RECALL
    assert ngram_join.prefix_depth(trees=1, recall=0.999999) == 1


def test_stop_depths_follow_what_a_size_can_reach():
    stops = ngram_join.stop_depths(ngram_join.THRESHOLD, ngram_join.TREES, ngram_join.DEEPEST, ngram_join.RECALL)
    assert stops[0] == stops[1] == stops[2] == ngram_join.DEEPEST + 1  # three shingles: 3/4 at most
    assert stops[-1] == ngram_join.prefix_depth() and max(stops[3:]) > min(stops)
    for n, depth in enumerate(stops[:-1], 1):
        pairs = [i / (n + m - i) for m in range(1, 2 * n + 2) for i in range(1, min(n, m) + 1)]
        reached = [s for s in pairs if 0.8 - 1e-9 <= s < 1]
        assert bool(reached) == (depth <= ngram_join.DEEPEST)
        if reached:
            assert 1 - (1 - min(reached) ** depth) ** ngram_join.TREES >= ngram_join.RECALL


def test_sorted_tries_join_what_shares_a_prefix(spark):
    """Against all pairs of sequences, with ranges that cut through long runs."""
    rng = np.random.default_rng(4)
    trees, deepest, rows = 3, 4, []
    for hi in range(300):
        forest = rng.integers(0, 3, (trees, deepest)).astype(">u2")
        if hi % 3 == 0:
            forest[0] = 1  # a prefix of a third of all sets
        rows.append((hi, int(rng.integers(1, 90)), forest.tobytes()))
    nodes = spark.createDataFrame(rows, "hi long, n_shingles long, forest binary").repartition(6)
    stops = ngram_join.stop_depths(0.8, trees, deepest, 0.9)
    stop = {hi: stops[min(n, len(stops)) - 1] for hi, n, _ in rows}
    parent = list(range(300))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for t in range(trees):
        for level in range(min(stops), deepest + 1):
            met = {}
            for hi, _, forest in rows:
                if stop[hi] <= level:
                    at = t * deepest * 2
                    other = met.setdefault(forest[at:at + 2 * level], hi)
                    parent[max(find(hi), find(other))] = min(find(hi), find(other))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = ngram_join.forest_edges(nodes, 0.8, trees, deepest, 0.9)
        got = {r.node: r.root for r in ngram_join.connected(edges).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {i: find(i) for i in range(300) if sum(find(j) == find(i) for j in range(300)) > 1}


def test_pairs_near_the_threshold_are_found(spark):
    """150 pairs with a similarity between 0.80 and 0.85: recall against brute force."""
    rng = np.random.default_rng(6)
    rows, pairs = [], 0
    for k in range(150):
        words = [f"w{k}x{i}" for i in range(int(rng.integers(60, 300)))]
        changed = list(words)
        shingles = len(words) - 4
        # each changed word far from others changes five shingles on both sides
        for c in range(max(1, round(shingles * 0.1 / 5))):
            changed[7 + 9 * c] = f"new{k}x{c}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
    want, _ = brute_force(rows)
    near = sum(c for (_, _, links), c in want.items() if links)
    assert near >= 200
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want


def test_only_wanted_texts_move(spark):
    rows = [(i, f"text {i}") for i in range(500)]
    thin = spark.createDataFrame(rows, "_id long, _text string").select("_id", "_text", *row_keys("_id", "_text"))
    wanted = thin.filter("_id % 50 = 0").select("_k1", "_k2", "_id").withColumnRenamed("_id", "no")
    got = ngram_join.wanted_rows(thin.union(thin), wanted)
    assert sorted((r["_id"], r["no"]) for r in got.collect()) == [(i, i) for i in range(0, 500, 50)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan  # at any size


def test_a_group_of_near_copies_costs_its_differences():
    rng = np.random.default_rng(1)
    base = np.arange(2000, dtype=np.uint64)
    sets = [np.setdiff1d(base, rng.integers(0, 2000, 20).astype(np.uint64)) for _ in range(40)]
    every = np.arange(40)
    for a, linked in ngram_join.compare(sets, every, every, True, 0.8):
        assert list(linked) == [b for b in range(a + 1, 40) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in ngram_join.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
