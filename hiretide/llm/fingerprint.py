"""Document fingerprints: a homomorphic multiset hash of paragraphs.

The fingerprint of a text is the sum of one wide vector per paragraph (line),
lane by lane, modulo powers of two.  So it does not depend on the order of the
paragraphs, and a paragraph is put in or taken out by adding or subtracting its
vector, without reading the rest.  A paragraph's vector has two parts:

* 32 lanes modulo 2^32, expanded from a keyed hash of the whole paragraph, decide
  equality;
* 128 lanes modulo 2^16 hold the paragraph's character runs, each adding +1 or -1
  to one lane.  Read as signed numbers they give the share of runs two texts have
  in common (``likeness``).
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiretide.llm import arrays
from hiretide.llm.common import whole

EQUAL_LANES = 32
LIKE_LANES = 128
RUN = 8
RISING = arrays.powers(arrays.BASE, RUN)


class MultisetHash:
    """A fingerprint that paragraphs can be added to and removed from."""

    def __init__(self, equal: np.ndarray | None = None, like: np.ndarray | None = None):
        self.equal = np.zeros(EQUAL_LANES, np.uint32) if equal is None else equal
        self.like = np.zeros(LIKE_LANES, np.uint16) if like is None else like

    @classmethod
    def of(cls, text: str) -> MultisetHash:
        return cls().add(text.split("\n"))

    def copy(self) -> MultisetHash:
        return MultisetHash(self.equal.copy(), self.like.copy())

    def add(self, paragraphs: Iterable[str], sign: int = 1) -> MultisetHash:
        counted = Counter(paragraphs)
        if not counted:
            return self
        times = np.array(list(counted.values()), dtype=np.int64) * sign
        wide = b"".join(
            hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(EQUAL_LANES * 4) for p in counted
        )
        lanes = np.frombuffer(wide, dtype="<u4").reshape(-1, EQUAL_LANES).astype(np.uint64)
        self.equal = (self.equal + (lanes * times.astype(np.uint64)[:, None]).sum(axis=0)).astype(np.uint32)
        names = list(counted)
        for a, b in arrays.spans([len(p) for p in names]):
            self._add_runs(names[a:b], times[a:b])
        return self

    def remove(self, paragraphs: Iterable[str]) -> MultisetHash:
        return self.add(paragraphs, -1)

    def _add_runs(self, paragraphs: list[str], times: np.ndarray) -> None:
        """Runs of ``RUN`` characters; a shorter paragraph is one run, NUL-padded."""
        padded = [p if len(p) >= RUN else p.ljust(RUN, "\0") for p in paragraphs]
        chars, sizes = arrays.code_points(padded)
        n = len(chars) - RUN + 1
        codes = chars.astype(np.uint64) + np.uint64(1)
        hashes = np.zeros(n, np.uint64)
        for j in range(RUN):
            hashes += codes[j:j + n] * RISING[j]
        hashes = arrays.mix(hashes)
        weight = np.repeat(times, sizes)[:n]
        inside = np.ones(n, dtype=bool)
        ends = np.cumsum(sizes)[:-1]
        for j in range(1, RUN):
            inside[ends - j] = False
        lane = (hashes % np.uint64(LIKE_LANES)).astype(np.int64)[inside]
        signed = np.where(hashes >> np.uint64(63), weight, -weight)[inside]
        sums = np.bincount(lane, weights=signed, minlength=LIKE_LANES).astype(np.int64)
        self.like = (self.like + sums).astype(np.uint16)

    def __str__(self) -> str:
        return base64.b64encode(self.equal.astype("<u4").tobytes() + self.like.astype("<u2").tobytes()).decode()

    def likeness(self, other: MultisetHash) -> float:
        """About the share of character runs in common: 1 for equal fingerprints."""
        if (self.equal == other.equal).all():
            return 1.0
        a, b = self.like.view(np.int16).astype(float), other.like.view(np.int16).astype(float)
        size = np.sqrt((a @ a) * (b @ b))
        return float(min(1.0, max(0.0, (a @ b) / size))) if size else 0.0


def parse(fingerprint: str) -> MultisetHash:
    raw = base64.b64decode(fingerprint)
    cut = EQUAL_LANES * 4
    return MultisetHash(np.frombuffer(raw[:cut], "<u4").copy(), np.frombuffer(raw[cut:], "<u2").copy())


def replace_tail(prints: MultisetHash, text: str, cut: int, tail: str) -> tuple[str, MultisetHash]:
    """The text with everything from ``cut`` replaced by ``tail``, and its
    fingerprint, for which only the lines touched are taken out and put in."""
    edited = text[:cut] + tail
    line = text.rfind("\n", 0, cut) + 1
    changed = prints.copy().remove(text[line:].split("\n")).add(edited[line:].split("\n"))
    return edited, changed


EDITED = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _edit(kind: pa.DataType):
    """Rows sorted by part, place and id; each edits its text with the next row's.
    A guest (the first row of the following part) is only read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None
        for batch in batches:
            out = []
            for part, guest, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prints = MultisetHash.of(text) if pending or not guest else None
                if pending and pending[0] == part:
                    _, old_key, old, old_prints = pending
                    k = len(old) // 4
                    edited, changed = replace_tail(old_prints, old, len(old) - k, text[:k])
                    out.append((
                        old_key, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                        str(old_prints), str(changed), old_prints.likeness(changed), old_prints.likeness(prints),
                    ))
                pending = None if guest else (part, key, text, prints)
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["_id", *(c.split()[0] for c in EDITED.split(", "))],
            )

    return run


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    The edited text has its last quarter of code points replaced by the first as
    many of the next document's, in ascending doc_id; the last is followed by the
    first, a lone document by itself.  NULL texts are empty texts; a NULL doc_id
    comes first; rows of equal doc_id follow each other by a hash of the text.

    Rows are dealt into ``parts`` id ranges (several for each shuffle partition, so
    that partitions come out even) by cut points (one row of numbers on
    the driver, as the first id of each range) and sorted there; the first row of
    a range also goes to the range before, as a guest.
    """
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or partitions * 4
    plain = docs.select(F.col(doc_id).alias("_id"), whole(text).alias("_text"))
    share = [i / parts for i in range(1, parts)]
    cuts = sorted(set(plain.agg(F.percentile_approx("_id", share).alias("c")).first()["c"] or [])) if share else []
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.expr("cast(array() AS array<bigint>)")
    part = F.coalesce(F.size(F.filter(bounds, lambda c: c <= F.col("_id"))), F.lit(0))
    part = F.when(F.isnull("_id"), 0).otherwise(part)
    dealt = plain.withColumn("_part", part)
    heads = dealt.groupBy("_part").agg(
        F.min("_id").alias("head"), F.max(F.isnull("_id")).alias("unnamed")
    ).orderBy("_part").collect()
    # per part: its first id, and the part before it that reads that row as a guest
    head, before = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1)
    for here, following in zip(heads, heads[1:] + heads[:1], strict=True):
        head[following["_part"]], before[following["_part"]] = following["head"], here["_part"]
    unnamed = bool(heads) and heads[0]["unnamed"]
    own_head = F.element_at(F.lit(head).cast(f"array<{kind}>"), F.col("_part") + 1)
    first = F.when(F.isnull("_id"), True).when((F.col("_part") == 0) & F.lit(unnamed), False).otherwise(F.col("_id") == own_head)
    reader = F.element_at(F.lit(before).cast("array<int>"), F.col("_part") + 1)
    visits = F.when(first, F.array(reader)).otherwise(F.expr("cast(array() AS array<int>)"))
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("guest"))
    placed = dealt.withColumn(
        "_place",
        F.explode(F.concat(F.array(own), F.transform(visits, lambda p: F.struct(p.alias("part"), F.lit(True).alias("guest"))))),
    )
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
    done = (
        placed.select("_place.part", "_place.guest", "_id", "_text")
        .repartition(partitions, "part")
        .sortWithinPartitions("part", "guest", F.col("_id").asc_nulls_first(), F.xxhash64("_text"), "_text")
        .mapInArrow(_edit(arrow), f"_id {kind}, {EDITED}")
    )
    return done.withColumnRenamed("_id", doc_id)
