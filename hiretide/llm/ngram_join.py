"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

Every text is the set of its five-word shingles; equal sets count once from there
on.  A forest of tries holds one sequence of MinHash labels per set and tree.  The
sequences of all trees are sorted, which lays every trie out in order: sets that
share a prefix lie side by side.  Matched prefixes are shortened level by level from
the deepest, for each set only until pairs at the least similarity that a set of its
size can have above the threshold are found with the target recall
(``stop_depths``); sets without any such partner are not looked for at all.

Sets that meet are joined to candidate components, and within each component every
pair of different shingle sets is compared exactly, block against block, so that no
group has to fit into one task and no pair is written out: a task returns link
counts and a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiretide.llm import arrays
from hiretide.llm.common import SPACE, row_keys, whole
from hiretide.session import materialize

WIDTH = 5
THRESHOLD = 0.8
TREES = 32
DEEPEST = 8
RECALL = 0.9999
# Shingles that one side of a block comparison may hold.
BLOCK_SHINGLES = 200_000
# Shingles signed together (their hashes stay in a core's cache).
RUN_SHINGLES = 1 << 15

# Words of 64 bits in the filter for texts that are compared (a proven bound of what
# is broadcast; a full filter lets more texts through to the join, never fewer).
FILTER_WORDS = 1 << 20

SIGNATURES = "hi long, lo long, n_shingles long, forest binary"
LABEL_BYTES = 2


def prefix_depth(similarity: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of that similarity meets in some tree with
    the target recall; longer pairs of labels are found with more."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def least_similarity(n: int, threshold: float) -> float | None:
    """The least Jaccard similarity from the threshold on that a set of ``n`` shingles
    can have with another set; None where only equal sets reach it."""
    found = None
    for m in range(math.ceil(threshold * n - 1e-9), math.floor(n / threshold + 1e-9) + 1):
        for shared in range(1, min(n, m) + 1):
            s = shared / (n + m - shared)
            if threshold - 1e-9 <= s < 1 and (found is None or s < found):
                found = s
    return found


def stop_depths(threshold: float, trees: int, deepest: int, recall: float, sizes: int = 65) -> list[int]:
    """For sets of 1, 2, ... shingles the depth at which shortening stops; the last
    entry is for all larger sets.  ``deepest + 1``: nothing to look for."""
    known = [least_similarity(n, threshold) for n in range(1, sizes)]
    return [deepest + 1 if s is None else prefix_depth(s, trees, deepest, recall) for s in known] + [
        prefix_depth(threshold, trees, deepest, recall)
    ]


def distinct_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, words, counts in arrays.word_hashes(texts):
        shingles, sizes = arrays.shingle_hashes(words, counts, width)
        at = 0
        for n in sizes:
            yield np.unique(shingles[at:at + n])
            at += n


def signer(width: int, trees: int, deepest: int):
    """Arrow function: shingle-set identity and the label sequences of all trees.  Runs
    of sets are signed together, function by function, over one flat array."""
    rng = np.random.default_rng(20_240_607)
    flips = rng.integers(0, 1 << 63, trees * deepest, dtype=np.uint64)
    factors = rng.integers(0, 1 << 63, trees * deepest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def labels(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), trees * deepest), dtype=">u2")
        for j in range(trees * deepest):
            low = np.minimum.reduceat((flat ^ flips[j]) * factors[j], starts)
            out[:, j] = arrays.mix(low) >> np.uint64(48)
        return out

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            n = len(texts)
            hi, lo = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            size, table = np.zeros(n, np.int64), np.zeros((n, trees * deepest), ">u2")
            held: list[np.ndarray] = []
            rows: list[int] = []

            def flush() -> None:
                if not rows:
                    return
                flat, sizes = np.concatenate(held), np.array([len(s) for s in held])
                starts = np.cumsum(sizes) - sizes
                hi[rows] = arrays.mix(np.add.reduceat(arrays.mix(flat), starts) + sizes.astype(np.uint64))
                lo[rows] = arrays.mix(np.add.reduceat(arrays.mix(flat ^ arrays.BASE), starts))
                table[rows] = labels(flat, starts)
                held.clear()
                rows.clear()

            total = 0
            for i, found in enumerate(distinct_sets(texts, width)):
                size[i] = len(found)
                if len(found):
                    held.append(found)
                    rows.append(i)
                    total += len(found)
                    if total >= RUN_SHINGLES:
                        flush()
                        total = 0
            flush()
            bounds = np.arange(n + 1, dtype=np.int32) * (trees * deepest * LABEL_BYTES)
            forest = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(table.tobytes())])
            made = [pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(size), forest]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = [*batch.schema.names[:-1], "hi", "lo", "n_shingles", "forest"]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=names)

    return sign


EDGE, FIRST, LAST = 0, 1, 2
CLIMBED = "kind int, level int, part int, prefix binary, u long, v long"


def climber(deepest: int, highest: int):
    """Arrow function over one range of the sorted tries (key, hi, stop, part): for every
    level from the deepest up to ``highest``, an edge from each set that still takes
    part to the first such set with its prefix; and per level the first and the last
    prefix of the range with their first sets, by which ranges are joined."""
    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: dict[int, tuple[bytes, int]] = {}
        first: dict[int, tuple[bytes, int]] = {}
        part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            hi, stop = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            part = batch.column(3)[0].as_py()
            for level in range(deepest, highest - 1, -1):
                takes = np.flatnonzero(stop <= level)
                if not len(takes):
                    continue
                mine, nodes = key[takes, : 1 + level * LABEL_BYTES], hi[takes]
                new = np.ones(len(takes), dtype=bool)
                new[1:] = (mine[1:] != mine[:-1]).any(axis=1)
                anchors = nodes[np.maximum.accumulate(np.where(new, np.arange(len(takes)), 0))]
                before = carried.get(level)
                if before is not None and before[0] == mine[0].tobytes():
                    runs = np.flatnonzero(new)
                    anchors[: runs[1] if len(runs) > 1 else len(takes)] = before[1]
                first.setdefault(level, (mine[0].tobytes(), int(nodes[0])))
                carried[level] = (mine[-1].tobytes(), int(anchors[-1]))
                met = nodes != anchors
                n = int(met.sum())
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, EDGE, np.int32)), pa.array(np.full(n, level, np.int32)),
                            pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.binary()), pa.array(nodes[met]), pa.array(anchors[met]),
                        ],
                        names=["kind", "level", "part", "prefix", "u", "v"],
                    )
        rows = [(kind, level, part, prefix, node, node) for kind, held in ((FIRST, first), (LAST, carried))
                for level, (prefix, node) in held.items()]
        if rows:
            types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["kind", "level", "part", "prefix", "u", "v"]
            )

    return climb


def forest_edges(nodes: DataFrame, threshold: float, trees: int, deepest: int, recall: float) -> DataFrame:
    """Candidate edges (u, v) between sets (hi, n_shingles, forest), from the sorted
    tries.  Ranges cut the sorted sequences anywhere, so a prefix that very many sets
    share lies in many ranges; those are joined by their border rows, a few per range."""
    stops = stop_depths(threshold, trees, deepest, recall)
    stop = F.element_at(F.array(*[F.lit(d) for d in stops]), F.least(F.col("n_shingles"), F.lit(len(stops))).cast("int"))
    size = deepest * LABEL_BYTES
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.concat(F.unhex(F.lpad(F.hex(t), 2, "0")), F.substring("forest", t * size + 1, F.lit(size))),
    )
    laid = nodes.withColumn("_stop", stop.cast("int")).filter(F.col("_stop") <= deepest)
    sequences = laid.select(F.explode(keys).alias("key"), "hi", "_stop")
    ranges = sequences.repartitionByRange("key", "hi").sortWithinPartitions("key", "hi")
    climbed = materialize(
        ranges.withColumn("part", F.spark_partition_id()).mapInArrow(climber(deepest, min(stops)), CLIMBED), "tries"
    )
    # bounded: two rows per range and level
    order = Window.partitionBy("level").orderBy("part", "kind")
    borders = climbed.filter(F.col("kind") != EDGE).select(
        "kind", "prefix", "u", *[F.lag(c).over(order).alias(f"_{c}") for c in ("kind", "prefix", "u")]
    )
    joined = borders.filter((F.col("kind") == FIRST) & (F.col("_kind") == LAST) & (F.col("prefix") == F.col("_prefix")))
    return climbed.filter(F.col("kind") == EDGE).select("u", "v").union(joined.select("u", F.col("_u").alias("v")))


def wanted_rows(thin: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``thin`` that one of the row keys (_k1, _k2) of ``wanted`` names, once
    each, with its columns.

    A filter of fixed size first drops nearly all other rows where they are read, so
    that only texts that are compared move.  The join is a merge join at any size.
    """
    word, bit = F.pmod("_k1", F.lit(FILTER_WORDS)), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("_k2", F.lit(64)).cast("int"))
    words = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    near = thin.withColumn("_word", word).join(F.broadcast(words), "_word").filter(F.col("_bits").bitwiseAND(bit) != 0)
    return near.drop("_word", "_bits").join(wanted.hint("merge"), ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v; longs); the root is the
    smallest node of its component.

    Large-star and small-star steps in turn, each round written to the shared
    folder; only two numbers a round come to the driver.
    """
    turned = F.expr("greatest(u, v) AS u"), F.expr("least(u, v) AS v")
    edges, before = materialize(edges.select(*turned).filter("u > v").distinct(), "edges"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct()
            )
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(lowest).distinct(), "edges")


def compare(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, threshold: float):
    """For each row of ``left`` against ``right`` (row numbers of ``sets``): yields
    (row, rows linked with it).  ``same``: each pair once, from its smaller row.

    A shingle that most sets hold is turned into the list of sets lacking it, so
    that a large group of near copies costs what its members differ in.
    """
    n = len(sets)
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    values, code = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    common = np.bincount(code, minlength=len(values)) * 2 > n
    ranks = np.cumsum(common) - 1
    often = int(common.sum())
    rare = ~common[code]
    rows, cols = owner[rare], code[rare]
    lacking = np.zeros(n, dtype=np.int64)
    if often:
        held = ~rare
        missing_rows, missing_cols = [], []
        at = np.searchsorted(owner[held], np.arange(n + 1))
        ranked = ranks[code[held]]
        columns = np.flatnonzero(common)
        for i in range(n):
            absent = np.ones(often, dtype=bool)
            absent[ranked[at[i]:at[i + 1]]] = False
            gone = columns[absent]
            lacking[i] = len(gone)
            missing_rows.append(np.full(len(gone), i))
            missing_cols.append(gone)
        rows = np.concatenate([rows, *missing_rows])
        cols = np.concatenate([cols, *missing_cols])
    by_col = np.argsort(cols, kind="stable")
    postings = rows[by_col]
    bounds = np.searchsorted(cols[by_col], np.arange(len(values) + 1))
    by_row = np.argsort(rows, kind="stable")
    row_cols = cols[by_row]
    row_bounds = np.searchsorted(rows[by_row], np.arange(n + 1))
    for a in left:
        mine = row_cols[row_bounds[a]:row_bounds[a + 1]]
        lengths = bounds[mine + 1] - bounds[mine]
        shift = np.repeat(bounds[mine] - np.cumsum(lengths) + lengths, lengths)
        shared = np.bincount(postings[shift + np.arange(len(shift))], minlength=n)
        shared = shared[right] + often - lacking[a] - lacking[right]
        near = shared >= threshold * (sizes[a] + sizes[right] - shared) - 1e-9
        linked = right[near]
        yield a, linked[linked > a] if same else linked


def block_comparer(width: int, threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        texts = table.column("_text").to_pylist()
        sets = list(distinct_sets(texts, width))
        block, hi = np.array(table.column("_block").to_pylist()), table.column("hi").to_pylist()
        copies = np.array(table.column("copies").to_pylist(), dtype=np.int64)
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        links, texts_linked = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        parent = np.arange(len(sets))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        if len(left) and len(right):
            for a, linked in compare(sets, left, right, first == second, threshold):
                if len(linked):
                    links[a] += copies[linked].sum()
                    links[linked] += copies[a]
                    texts_linked[a] += len(linked)
                    texts_linked[linked] += 1
                    for b in np.unique(parent[linked]):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
        roots = [hi[find(i)] for i in range(len(sets))]
        return pa.table({
            "hi": pa.array(hi, pa.int64()), "lo": table.column("lo"), "root": pa.array(roots, pa.int64()),
            "links": links, "texts": texts_linked,
        })

    return run


def classified(docs: DataFrame, doc_id: str, text: str, threshold: float, width: int, trees: int, deepest: int,
               recall: float, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and for each shingle set (hi, lo) its class, links and the row
    that stands for it."""
    plain = docs.select(F.col(doc_id).alias("_id"), whole(text).alias("_text"))
    thin = plain.select("_id", *row_keys("_id", "_text"), "_text")
    kind = docs.schema[doc_id].dataType.simpleString()
    signed = materialize(
        thin.mapInArrow(signer(width, trees, deepest), f"_id {kind}, _k1 long, _k2 long, {SIGNATURES}"), "signatures"
    )
    filled = signed.filter("n_shingles > 0")
    # from here on a row per set, however many copies there are
    nodes = materialize(
        filled.groupBy("hi", "lo").agg(
            F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles"),
            F.min(F.struct(F.isnull("_id").alias("unnamed"), "_id", "_k1", "_k2")).alias("rep"),
            F.max("forest").alias("forest"),
        ),
        "sets",
    )
    groups = connected(forest_edges(nodes, threshold, trees, deepest, recall)).withColumnRenamed("root", "comp")
    nodes = nodes.drop("forest")

    members = materialize(nodes.join(groups, nodes.hi == groups.node).drop("node"), "members")
    blocks = members.groupBy("comp").agg(F.ceil(F.sum("n_shingles") / block_shingles).cast("int").alias("_blocks"))
    wanted = members.join(blocks, "comp").select("hi", "lo", "copies", "comp", "_blocks", "rep._k1", "rep._k2")
    texts = (
        wanted_rows(thin.drop("_id"), wanted)
        .withColumn("_block", F.expr("cast(pmod(lo, _blocks) AS int)"))
        .withColumn("_other", F.expr("explode(sequence(0, _blocks - 1))"))
        .select("hi", "lo", "copies", "_text", "_block", "comp", F.expr("least(_block, _other) AS _a"),
                F.expr("greatest(_block, _other) AS _b"))
    )
    compared = materialize(
        texts.groupBy("comp", "_a", "_b").applyInArrow(
            block_comparer(width, threshold), "hi long, lo long, root long, links long, texts long"
        ),
        "links",
    )
    counts = compared.groupBy("hi", "lo").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    classes = connected(compared.select(F.col("hi").alias("u"), F.col("root").alias("v")))
    known = (
        nodes.join(classes, nodes.hi == classes.node, "left").join(counts, ["hi", "lo"], "left")
        .select(
            "hi", "lo", "least", "rep", F.coalesce("root", "hi").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("texts", F.lit(0)).alias("n_text_links"),
        )
    )
    return signed, known


def jaccard_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH,
    trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, n_text_links``.

    Two documents are linked when the Jaccard similarity of their shingle sets is
    at least ``threshold``; classes are the connected groups of links, named by
    their smallest doc_id.  ``n_links`` counts linked documents, copies included,
    ``n_text_links`` the different shingle sets among them other than its own.
    Texts of one to four words are one shingle.  NULL, empty and blank texts have
    no shingle, hence no link: each is its own class.  Repeated rows are copies.
    A NULL doc_id is a document like any other, but names no class (a class of
    such documents only has a NULL class_id).  Other columns are ignored.
    """
    signed, known = classified(docs, doc_id, text, threshold, width, trees, deepest, recall, block_shingles)
    named = known.groupBy("root").agg(F.min("least").alias("class_id"))
    known = known.join(named, "root").select("hi", "lo", "class_id", "n_links", "n_text_links")
    found = signed.filter("n_shingles > 0").select("_id", "hi", "lo").join(known, ["hi", "lo"])
    none = F.lit(0).cast("long")
    alone = signed.filter("n_shingles = 0").select(
        "_id", F.col("_id").alias("class_id"), none.alias("n_links"), none.alias("n_text_links")
    )
    return found.select("_id", "class_id", "n_links", "n_text_links").union(alone).withColumnRenamed("_id", doc_id)


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH,
    trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """The documents, all columns, with one of each class: that with the smallest
    doc_id (NULL last; of equal ids any one, the same in each run; of a repeated
    row one).  Texts without words are in no class and all stay."""
    signed, known = classified(docs, doc_id, text, threshold, width, trees, deepest, recall, block_shingles)
    first = known.groupBy("root").agg(F.min("rep").alias("rep")).select("rep._k1", "rep._k2")
    keys = row_keys(f"_row.{doc_id}", "_whole")
    marked = docs.select(F.struct("*").alias("_row")).withColumn("_whole", whole(f"_row.{text}"))
    marked = marked.select("_row", *keys, "_whole")
    has_word = F.col("_whole").rlike(SPACE)
    kept = marked.filter(has_word).drop("_whole").join(first, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    return kept.select("_row.*").union(marked.filter(~has_word).select("_row.*"))
