"""Fill-in-the-middle transformation by secondary sort.

A text is cut into prefix, middle and suffix, which a form puts in another order
behind marks.  No task ever holds a long output: texts are emitted as pieces of a
bounded number of characters, keyed by document and output position, brought
together by one repartition with a sort inside the partitions (the DataFrame form
of repartitionAndSortWithinPartitions), and streamed in that order into digests,
files or texts.  Restoration reads the output pieces alone: it finds the marks in
the stream, which may lie across two pieces, gives every piece its source position
and sorts again inside the same partitions, without another shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiretide.llm.common import row_keys, whole

PIECE_CHARS = 8192
# Pieces written together.
OUT_ROWS = 2000
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Marks in output order, and the rank of each mark's segment in the source.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
RANKS = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
END = 3
STEP = 1 << 40  # source positions: rank * STEP + number of the piece


def planned(docs: DataFrame, doc_id: str, text: str, seed: int, plain_percent: int, spm_percent: int) -> DataFrame:
    """(_id, _k1, _k2, _salt, form, _a, _b, _text): the form and the two cuts, drawn
    from a digest of the doc_id.  Rows of equal id and text share their keys; the
    salt keeps copies from many tasks apart."""
    df = docs.select(F.col(doc_id).alias("_id"), whole(text).alias("_text"))
    named = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    df = df.withColumn("_hex", F.sha2(F.concat(F.lit(f"{seed}:"), named), 256)).withColumn("_n", F.length("_text"))

    def drawn(i: int):
        return F.conv(F.substring("_hex", 8 * i + 1, 8), 16, 10).cast("long")

    cuts = [drawn(i) % (F.col("_n") + 1) for i in (0, 1)]
    marked = F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE)
    plain = (F.col("_n") == 0) | marked | (drawn(2) % 100 >= plain_percent)
    form = F.when(plain, "plain").when(drawn(3) % 100 < spm_percent, "spm").otherwise("psm")
    return df.select(
        "_id", *row_keys("_id", "_text"), F.spark_partition_id().alias("_salt"), form.alias("form"),
        F.least(*cuts).alias("_a"), F.greatest(*cuts).alias("_b"), "_text",
    )


def cutter(size: int, key_columns: int):
    """Arrow function: planned rows to output pieces (key columns, position, piece)."""
    def units(form: str, a: int, b: int, text: str) -> Iterator[str]:
        if form == "plain":
            segments = [("", 0, len(text))]
        else:
            bounds = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text))}
            segments = [(mark, *bounds[mark]) for mark in ORDERS[form]]
        for mark, start, end in segments:
            yield mark + text[start:min(end, start + size)]
            for at in range(start + size, end, size):
                yield text[at:min(end, at + size)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.select(list(range(key_columns)))
            rows, positions, pieces = [], [], []

            def flush() -> pa.RecordBatch:
                taken = keys.take(pa.array(rows, pa.int32()))
                out = pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(positions, pa.int64()), pa.array(pieces, pa.string())],
                    names=[*taken.schema.names, "position", "piece"],
                )
                rows.clear(), positions.clear(), pieces.clear()
                return out

            columns = [batch.column(i) for i in range(key_columns - 1, batch.num_columns)]
            for i in range(batch.num_rows):
                form, a, b, text = (c[i].as_py() for c in columns)
                for position, piece in enumerate(units(form, a, b, text)):
                    rows.append(i), positions.append(position), pieces.append(piece)
                    if len(rows) >= OUT_ROWS:
                        yield flush()
            if rows:
                yield flush()

    return cut


def arranged(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, plain_percent: int = 90,
    spm_percent: int = 20, piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """The transformed texts as pieces ``_id, _k1, _k2, _salt, form, position, piece``:
    all pieces of a document lie in one partition, in output order.

    NULL texts count as empty; empty texts are ``plain`` and one empty piece.  A NULL
    doc_id draws like an empty one.  Repeated rows are kept: copies that meet in a
    partition repeat each position.  Ids may be of any type that sorts; other columns
    are ignored.
    """
    rows = planned(docs, doc_id, text, seed, plain_percent, spm_percent)
    kind = docs.schema[doc_id].dataType.simpleString()
    keys = f"_id {kind}, _k1 long, _k2 long, _salt int, form string"
    pieces = rows.mapInArrow(cutter(piece_chars, 5), f"{keys}, position long, piece string")
    return pieces.repartition("_k1", "_k2", "_salt").sortWithinPartitions("_k1", "_k2", "_salt", "position")


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, object, int, str, int]]:
    """(key, id, position, piece, copies) from sorted pieces, each position once; the
    copies are the rows of that position."""
    held = None
    for batch in batches:
        names = batch.schema.names
        ids = batch.column(names.index("_id"))
        k1, k2, salt, form, position, piece = (
            batch.column(names.index(n)).to_pylist() for n in ("_k1", "_k2", "_salt", "form", "position", "piece")
        )
        for i in range(batch.num_rows):
            key = (k1[i], k2[i], salt[i], form[i])
            if held is not None and held[0] == key and held[2] == position[i]:
                held[4] += 1
                continue
            if held is not None:
                yield tuple(held)
            held = [key, ids[i], position[i], piece[i], 1]
    if held is not None:
        yield tuple(held)


class MarkReader:
    """Splits a stream of pieces at the marks of a form into (rank, text)."""

    def __init__(self, form: str):
        self.waiting = list(ORDERS.get(form, ()))
        self.rank, self.kept = 0, ""

    def feed(self, piece: str) -> Iterator[tuple[int, str]]:
        left = self.kept + piece
        self.kept = ""
        while self.waiting:
            mark = self.waiting[0]
            at = left.find(mark)
            if at < 0:
                # a mark may go on in the next piece
                cut = max(0, len(left) - len(mark) + 1)
                left, self.kept = left[:cut], left[cut:]
                break
            if at:
                yield self.rank, left[:at]
            self.rank, left = RANKS[mark], left[at + len(mark):]
            self.waiting.pop(0)
        if left:
            yield self.rank, left

    def rest(self) -> Iterator[tuple[int, str]]:
        if self.kept:
            yield self.rank, self.kept


def reorderer(id_type: pa.DataType):
    """Arrow function: output pieces to source pieces, and at the end of a document a
    row with the digest of its output and the number of its copies."""
    names = ["_id", "_k1", "_k2", "_salt", "form", "position", "piece", "copies"]
    types = [id_type, pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def reorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        key = reader = None

        def finish() -> None:
            for rank, part in reader.rest():
                out.append((name, *key, rank * STEP + seq, part, 0))
            out.append((name, *key, END * STEP, digest.hexdigest(), copies))

        for now, ident, _, piece, count in streamed(batches):
            if now != key:
                if key is not None:
                    finish()
                key, name, copies, seq = now, ident.as_py(), count, 0
                reader, digest = MarkReader(now[3]), hashlib.sha256()
            digest.update(piece.encode("utf-8", "surrogatepass"))
            for rank, part in reader.feed(piece):
                out.append((name, *key, rank * STEP + seq, part, 0))
                seq += 1
            if len(out) >= OUT_ROWS:
                yield flush()
        if key is not None:
            finish()
        if out:
            yield flush()

    return reorder


def digester(id_type: pa.DataType):
    """Arrow function: source pieces and end rows to one row per document."""
    names = ["_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, chars = hashlib.sha256(), [0, 0, 0]
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            position, piece = columns["position"].to_pylist(), columns["piece"].to_pylist()
            form, copies = columns["form"].to_pylist(), columns["copies"].to_pylist()
            out: list[tuple] = []
            for i in range(batch.num_rows):
                rank = position[i] // STEP
                if rank < END:
                    digest.update(piece[i].encode("utf-8", "surrogatepass"))
                    chars[rank] += len(piece[i])
                    continue
                cuts = (None, None) if form[i] == "plain" else (chars[0], chars[1])
                row = (columns["_id"][i].as_py(), sum(chars), form[i], *cuts, piece[i], digest.hexdigest())
                out.extend([row] * copies[i])
                digest, chars = hashlib.sha256(), [0, 0, 0]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return digest_rows


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def restored(pieces: DataFrame) -> DataFrame:
    """Output pieces (``arranged``) as source pieces in source order, in the same
    partitions; the last row of a document (position END * STEP) holds the digest of
    its output and its number of copies."""
    kind = pieces.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _k1 long, _k2 long, _salt int, form string, position long, piece string, copies long"
    moved = pieces.mapInArrow(reorderer(arrow_type(pieces, "_id")), schema)
    return moved.sortWithinPartitions("_k1", "_k2", "_salt", "position")


def outputs(pieces: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, form, output): the transformed texts in one row each, for readers that
    want whole texts; repeated rows give repeated results."""
    id_type, kind = arrow_type(pieces, "_id"), pieces.schema["_id"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def rows() -> pa.RecordBatch:
            made = [[name] * copies, [key[3]] * copies, ["".join(parts)] * copies]
            types = [id_type, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types)], names=["_id", "form", "output"])

        for now, ident, _, piece, count in streamed(batches):
            if now != key:
                if key is not None:
                    yield rows()
                key, name, copies, parts = now, ident.as_py(), count, []
            parts.append(piece)
        if key is not None:
            yield rows()

    return pieces.mapInArrow(join, f"_id {kind}, form string, output string").withColumnRenamed("_id", doc_id)


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars,
    output_sha256, restored_sha256``; see ``arranged`` for odd rows.  All but the ids
    are read off the output pieces."""
    pieces = arranged(docs, doc_id, text, **options)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return restored(pieces).mapInArrow(digester(arrow_type(pieces, "_id")), schema).withColumnRenamed("_id", doc_id)
