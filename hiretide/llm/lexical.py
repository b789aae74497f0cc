"""Ranked lexical search over a length-stratified index.

A document's length enters its scores only through a whole number m, so documents
of equal m form a stratum.  Inside a stratum the score of a term depends on its
frequency tf alone: postings are grouped by term, stratum and tf, and the impact of
a group is computed once.  The highest tf of a term in a stratum bounds what the
stratum can give; an item visits strata in descending order of that bound and stops
where the bound falls below the scores it already has.

The index is a table of segments: documents sorted by m, cut into runs of bounded
size, so that a stratum of any size spreads over tasks.  Each task searches its
segments for all items of a block and returns their best documents; the first
segments searched give every item a least score that spares the others most visits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hiretide.llm import arrays
from hiretide.llm.common import whole
from hiretide.session import materialize

TOP = 20
# Characters of items that are searched for together; further blocks take passes of
# their own over the index.
BLOCK_CHARS = 8_000_000
# A segment ends at any of these.
SEGMENT_POSTINGS, SEGMENT_DOCS, SEGMENT_STRATA = 1 << 18, 8192, 256
LIMITS = (SEGMENT_POSTINGS, SEGMENT_DOCS, SEGMENT_STRATA)
# One in so many segments is searched first.
FIRST_OF = 16
EXACT = float(1 << 53)

_TERM_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def pieces(text: str, limit: int = arrays.BLOCK) -> Iterator[str]:
    """Cuts a very long text between terms."""
    at = 0
    while len(text) - at > limit:
        cut = _BETWEEN.search(text, at + limit)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.end()
    yield text[at:]


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of the given texts, and terms per text.  A hash is
    a polynomial in the term's bytes, taken from one running sum."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _FOLDED[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _TERM_BYTES[data])).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * arrays.powers(arrays.BASE, len(data)))
    total = np.concatenate((np.zeros(1, np.uint64), sums))
    falling = arrays.powers(arrays.BASE_INVERSE, len(data))
    hashes = arrays.mix((total[last] - total[first]) * falling[first] + (last - first).astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.diff(np.searchsorted(first, np.concatenate(([0], ends))))


def term_hashes(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For ranges of texts: index of the first, hashes of all terms, terms per text."""
    for a, b in arrays.spans([len(t) for t in texts]):
        if b == a + 1:
            joined = np.concatenate([hashed([p])[0] for p in pieces(texts[a])])
            yield a, joined, np.array([len(joined)])
        else:
            yield a, *hashed(texts[a:b])


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


@dataclass
class Items:
    """A block of items: ids, and per item its terms (numbers in the sorted
    ``vocabulary`` of hashes) with their repeats."""

    ids: pa.Array
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def read_items(ids: pa.Array, texts: list[str]) -> Items:
    found = [h[1] for t in texts for h in [next(term_hashes([t]))]]
    vocabulary = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))
    pairs = [np.unique(np.searchsorted(vocabulary, f), return_counts=True) for f in found]
    return Items(ids, vocabulary, [p[0] for p in pairs], [p[1].astype(np.int64) for p in pairs])


def counter(vocabulary: np.ndarray):
    """Arrow function: (_id, _text) to _id, number of terms, and the frequencies of
    the terms of the vocabulary."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, hashes, sizes in term_hashes(texts):
                row = np.repeat(np.arange(len(sizes)), sizes)
                at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), dtype=bool)
                keys, tf = np.unique(row[known] * len(vocabulary) + at[known], return_counts=True)
                held = np.bincount(keys // max(len(vocabulary), 1), minlength=len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(sizes)), pa.array(sizes, pa.int64()),
                        lists(keys % max(len(vocabulary), 1), held, pa.int32()), lists(tf, held, pa.int32()),
                    ],
                    names=["_id", "n", "terms", "tf"],
                )

    return count


SEGMENT = (
    "ranks array<int>, stratum_m array<long>, stratum array<int>, terms array<int>, term_start array<int>, "
    "group_stratum array<int>, group_tf array<int>, group_start array<int>, docs array<int>"
)


def segmenter(id_type: pa.DataType, limits: tuple[int, int, int] = LIMITS):
    """Arrow function: (m, _id, terms, tf) sorted by m to segments; a segment ends when
    it has as many postings, documents or strata as ``limits`` say."""
    most_postings, most_docs, most_strata = limits

    def segment(m: np.ndarray, ids: pa.Array, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        stratum_m, stratum = np.unique(m, return_inverse=True)
        doc = np.repeat(np.arange(len(m)), sizes)
        order = np.lexsort((doc, tf, stratum[doc], terms))
        doc, terms, tf = doc[order], terms[order], tf[order]
        kind = stratum[doc]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (terms[1:] != terms[:-1]) | (kind[1:] != kind[:-1]) | (tf[1:] != tf[:-1])
        start = np.flatnonzero(new)
        held, term_start = np.unique(terms[start], return_index=True)
        ranks = np.empty(len(m), dtype=np.int64)
        ranks[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(m))
        columns = [
            ranks, stratum_m, stratum, held, np.append(term_start, len(start)), kind[start], tf[start],
            np.append(start, len(doc)), doc,
        ]
        kinds = [pa.int32(), pa.int64(), *[pa.int32()] * 7]
        made = [lists(c, np.array([len(c)]), k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *made],
            names=["ids", *(c.split()[0] for c in SEGMENT.split(", "))],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            m, ids, sizes, terms, tf = zip(*held, strict=True)
            held.clear()
            return segment(np.concatenate(m), pa.concat_arrays(ids), *map(np.concatenate, (sizes, terms, tf)))

        docs = postings = 0
        last, strata = None, 0
        for batch in batches:
            m, ids = batch.column(0).to_numpy(), batch.column(1).cast(id_type)
            sizes = pc.list_value_length(batch.column(2)).to_numpy()
            terms, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            ends = np.concatenate(([0], np.cumsum(sizes)))
            fresh = np.ones(len(m), dtype=bool)
            fresh[1:] = m[1:] != m[:-1]
            at = 0

            def take(to: int) -> None:
                held.append((m[at:to], ids.slice(at, to - at), sizes[at:to], terms[ends[at]:ends[to]], tf[ends[at]:ends[to]]))

            for i in range(len(m)):
                strata += int(fresh[i] and m[i] != last)
                docs += 1
                postings += int(sizes[i])
                last = m[i]
                if postings >= most_postings or docs >= most_docs or strata >= most_strata:
                    take(i + 1)
                    at = i + 1
                    yield close()
                    docs = postings = strata = 0
                    last = None
            if at < len(m):
                take(len(m))
        if held:
            yield close()

    return cut


class Segment:
    """One segment as arrays, ready to be searched."""

    def __init__(self, batch: pa.RecordBatch, i: int, weights: np.ndarray):
        def values(name: str) -> np.ndarray:
            return batch.column(batch.schema.get_field_index(name))[i].values.to_numpy()

        self.ids = batch.column(batch.schema.get_field_index("ids"))[i].values
        self.ranks, self.stratum, self.docs = values("ranks"), values("stratum"), values("docs")
        self.terms, self.term_start, self.group_start = values("terms"), values("term_start"), values("group_start")
        self.group_stratum = values("group_stratum")
        m, tf = values("stratum_m"), values("group_tf").astype(np.int64)
        self.strata = len(m)
        # impacts: once for each stratum and tf
        top = int(tf.max()) + 1
        pairs, which = np.unique(self.group_stratum.astype(np.int64) * top + tf, return_inverse=True)
        pair_tf = pairs % top
        self.impact = ((1_000_000_000 * pair_tf) // (1000 * pair_tf + 12 * m[pairs // top]))[which]
        self.weights = weights[self.terms]
        # what a term gives at most, per stratum (groups of a term and stratum ascend by tf)
        self.most = np.zeros((len(self.terms), self.strata), dtype=np.int64)
        owner = np.repeat(np.arange(len(self.terms)), np.diff(self.term_start))
        np.maximum.at(self.most, (owner, self.group_stratum), self.impact)

    def search(self, terms: np.ndarray, repeats: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The best documents (numbers in the segment) and scores of an item, among
        those with a score of at least ``least``."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == terms
        at, factor = at[known], repeats[known] * self.weights[at[known]]
        best, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not len(at):
            return best, scores
        bounds = (self.most[at] * factor[:, None]).sum(axis=0)
        order = np.argsort(-bounds, kind="stable")
        groups = np.concatenate([np.arange(self.term_start[t], self.term_start[t + 1]) for t in at])
        factors = np.repeat(factor, self.term_start[at + 1] - self.term_start[at])
        kinds = self.group_stratum[groups]
        exact = bounds.max() < EXACT
        least, seen, step = max(least, 1), 0, 8
        while seen < self.strata and bounds[order[seen]] >= least:
            visit = order[seen:seen + step]
            visit = visit[bounds[visit] >= least]
            seen, step = seen + step, step * 4
            chosen = np.zeros(self.strata, dtype=bool)
            chosen[visit] = True
            mine = groups[chosen[kinds]]
            sizes = self.group_start[mine + 1] - self.group_start[mine]
            gives = np.repeat(self.impact[mine] * factors[chosen[kinds]], sizes)
            docs = self.docs[np.repeat(self.group_start[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            if exact:
                total = np.bincount(docs, weights=gives, minlength=len(self.ranks)).astype(np.int64)
            else:
                total = np.zeros(len(self.ranks), dtype=np.int64)
                np.add.at(total, docs, gives)
            near = np.flatnonzero(total >= least)
            best, scores = np.concatenate((best, near)), np.concatenate((scores, total[near]))
            if len(best) > top:
                kth = np.partition(scores, -top)[-top]
                best, scores = best[scores >= kth], scores[scores >= kth]
                first = np.lexsort((self.ranks[best], -scores))[:top]
                best, scores = best[first], scores[first]
            if len(best) == top:
                least = max(least, int(scores.min()))
        return best, scores


def searcher(items: Items, weights: np.ndarray, least: np.ndarray, top: int):
    """Arrow function: segments to (_no, item, doc, score) of the items' best."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch, i, weights)
                numbers, docs, scores = [], [], []
                for no, (terms, repeats) in enumerate(zip(items.terms, items.repeats, strict=True)):
                    found, score = segment.search(terms, repeats, top, int(least[no]))
                    numbers.append(np.full(len(found), no))
                    docs.append(found)
                    scores.append(score)
                if not sum(map(len, docs)):
                    continue
                number = pa.array(np.concatenate(numbers), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [number, items.ids.take(number), segment.ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))],
                    names=["_no", "_item", "_id", "score"],
                )

    return search


@dataclass
class Index:
    """Segments over ``vocabulary``, and the weights of its terms."""

    segments: DataFrame
    weights: np.ndarray


def build(
    docs: DataFrame, vocabulary: np.ndarray, doc_id: str = "doc_id", text: str = "text", limits: tuple[int, int, int] = LIMITS,
) -> Index | None:
    """The index of all documents for the terms of ``vocabulary`` (sorted hashes);
    None where no document has a term.  Texts are read once; what is kept of them are
    frequencies.  The driver gets two totals and one count per term."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, id_type = docs.schema[doc_id].dataType.simpleString(), to_arrow_type(docs.schema[doc_id].dataType)
    plain = docs.select(F.col(doc_id).alias("_id"), whole(text).alias("_text"))
    counts = plain.mapInArrow(counter(vocabulary), f"_id {kind}, n long, terms array<int>, tf array<int>").filter("n > 0")
    counts = materialize(counts, "term-counts")
    n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    m = F.expr(f"{100 - 25}L + ((25L * n * {n_docs}L) div {n_terms}L)")
    held = counts.filter(F.size("terms") > 0).select(m.alias("m"), "_id", "terms", "tf")
    spread = F.xxhash64("_id", "terms")  # a stratum of any size covers many ranges
    segments = (
        held.repartitionByRange("m", spread).sortWithinPartitions("m")
        .mapInArrow(segmenter(id_type, limits), f"ids array<{kind}>, {SEGMENT}")
    )
    return Index(materialize(segments, "segments"), weights)


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_first("_id")]
    rank = F.row_number().over(Window.partitionBy("_no").orderBy(*order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top)


def search_block(
    docs: DataFrame, items: Items, doc_id: str, text: str, schema: str, top: int, limits: tuple[int, int, int],
) -> DataFrame | None:
    """Rows of ``schema`` with their rank, or None where no document has a term."""
    index = build(docs, items.vocabulary, doc_id, text, limits)
    if index is None:
        return None
    part = F.pmod(F.xxhash64("stratum_m", F.size("docs"), F.slice("docs", 1, 64)), F.lit(FIRST_OF))
    least = np.zeros(len(items.terms), dtype=np.int64)
    first = index.segments.filter(part == 0).mapInArrow(searcher(items, index.weights, least, top), schema)
    first = materialize(ranked(first, top), "first-ranks")
    # at most one row an item of the block
    for r in first.filter(F.col("rank") == top).select("_no", "score").collect():
        least[r["_no"]] = r["score"]
    rest = index.segments.filter(part != 0).mapInArrow(searcher(items, index.weights, least, top), schema)
    return ranked(first.drop("rank").union(rest), top)


def search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", top: int = TOP, block_chars: int = BLOCK_CHARS, limits: tuple[int, int, int] = LIMITS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents with a score
    above 0; equal scores by ascending doc_id (NULL first).

    Terms are runs of ASCII letters, digits and characters beyond ASCII, only A-Z
    lower-cased, compared by 64-bit hashes.  NULL texts have none.  Every document
    row counts and ranks on its own, repeated rows too; equal item rows count once,
    and items of one id with different texts are ranked each.  An item without a
    known term has no row.  Other columns are ignored.  Items are searched for in
    blocks of about ``block_chars`` characters, by hash, each of which reaches the
    driver and the tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark: SparkSession = docs.sparkSession
    listed = items.select(F.col(item_id).alias("_item"), whole(item_text).alias("_text")).distinct()
    listed = materialize(listed, "search-items")
    chars = listed.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = int(chars // block_chars + 1)
    item_kind, kind = (d.schema[c].dataType.simpleString() for d, c in ((items, item_id), (docs, doc_id)))
    schema = f"_no int, _item {item_kind}, _id {kind}, score long"
    found = spark.createDataFrame([], f"{schema}, rank int")
    for b in range(blocks):
        rows = listed.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == b).orderBy("_item", "_text").collect()
        ids = pa.array([r["_item"] for r in rows], to_arrow_type(items.schema[item_id].dataType))
        block = search_block(docs, read_items(ids, [r["_text"] for r in rows]), doc_id, text, schema, top, limits)
        if block is not None:
            found = found.union(block)
    return found.select(F.col("_item").alias(item_id), "rank", F.col("_id").alias(doc_id), "score")
