"""Large nested JSON documents read in byte ranges, by many tasks.

A document is an object with arrays of objects (``sections``).  A first read sums up
every range: whether it leaves the reader inside of a string, how much deeper it goes
and which key it names last, for a start outside and inside of a string.  Composed in
order these give the state at the start of each range, so a second read can hand out
the elements that start in it.  What is known of a range is a short row; there are as
many as input splits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 8 << 20
# A key that is longer names no section.
LONGEST_KEY = 1024
ELEMENTS_PER_BATCH = 256
QUOTE, BACKSLASH, COLON = 34, 92, 58
DEEPER, HIGHER = (123, 91), (125, 93)
DOCUMENT, ARRAY, ELEMENT = 1, 2, 3  # depth inside of each


def _read(file, start: int, length: int) -> bytes:
    file.seek(max(0, start))
    return file.read(length + min(0, start))


class Structure:
    """Quotes and structural characters of a piece of JSON text; ``before`` is text
    that ends where the piece starts."""

    def __init__(self, data: bytes, before: bytes = b""):
        self.data, self.before = data, before
        chars = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(chars == QUOTE)
        places = np.arange(len(chars), dtype=np.int32)
        plain = np.maximum.accumulate(np.where(chars != BACKSLASH, places, -1)) if len(chars) else places
        last = np.where(quotes > 0, plain[quotes - 1], -1) if len(quotes) else quotes
        run = quotes - 1 - last
        ahead = len(before) - len(before.rstrip(b"\\"))
        self.quotes = quotes[(run + np.where(last < 0, ahead, 0)) % 2 == 0]
        found = np.flatnonzero(np.isin(chars, (*DEEPER, *HIGHER, COLON)))
        self.inside = np.searchsorted(self.quotes, found) % 2 == 1
        self.found, self.chars = found, chars[found]

    def outside(self, in_string: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, characters and depth (from 0 at the start) of what is structure."""
        kept = self.inside == in_string
        chars = self.chars[kept]
        return self.found[kept], chars, np.cumsum(np.isin(chars, DEEPER).astype(int) - np.isin(chars, HIGHER))

    def key(self, colon: int) -> str:
        """The string before a colon."""
        start = max(0, colon - LONGEST_KEY)
        text = self.data[start:colon]
        if start == 0:
            text = self.before[-LONGEST_KEY:] + text
        text = text.rstrip()[:-1]
        return text[text.rfind(b'"') + 1:].decode("utf-8", "replace")


def summary(data: bytes, before: bytes) -> str:
    """What a range does to the state, as JSON: [flips, [deeper, keys], [deeper, keys]],
    for a start outside and inside of a string; keys by relative depth, those of levels
    that were open at the start, and of the one below."""
    read = Structure(data, before)
    cases = []
    for in_string in (False, True):
        places, chars, depth = read.outside(in_string)
        named = (chars == COLON) & (depth <= DOCUMENT)
        last = dict(zip(depth[named].tolist(), places[named].tolist(), strict=True))
        cases.append([int(depth[-1]) if len(depth) else 0, {str(d): read.key(p) for d, p in last.items()}])
    return json.dumps([len(read.quotes) % 2, *cases])


def states(summaries: list[str]) -> list[tuple[bool, int, str]]:
    """(inside of a string, depth, section) at the start of each range of a file."""
    out, in_string, depth, section = [], False, 0, ""
    for text in summaries:
        out.append((in_string, depth, section))
        flips, *cases = json.loads(text)
        deeper, keys = cases[in_string]
        section = keys.get(str(DOCUMENT - depth), section)
        in_string, depth = in_string != bool(flips), depth + deeper
    return out


def elements(file, start: int, end: int, state: tuple[bool, int, str], sections: set[str]) -> Iterator[tuple[str, int, str]]:
    """(section, offset, text) of the elements that start in a range."""
    in_string, entered, section = state
    data = _read(file, start, end - start)
    read = Structure(data, _read(file, start - LONGEST_KEY, LONGEST_KEY))
    places, chars, depth = read.outside(in_string)
    depth = depth + entered
    keys = places[(chars == COLON) & (depth == DOCUMENT)]
    names = [section, *(read.key(int(k)) for k in keys)]
    starts = places[(chars == DEEPER[0]) & (depth == ELEMENT)]
    ends = places[(chars == HIGHER[0]) & (depth == ARRAY)]
    closed = np.searchsorted(ends, starts)
    for at, name, close in zip(starts.tolist(), np.searchsorted(keys, starts).tolist(), closed.tolist(), strict=True):
        if names[name] in sections:
            text = data[at:ends[close] + 1] if close < len(ends) else _whole_element(file, start + at, data[at:])
            yield names[name], start + at, text.decode("utf-8")


def _whole_element(file, at: int, known: bytes) -> bytes:
    """An element that ends beyond its range."""
    more = max(1 << 16, len(known))
    while True:
        added = _read(file, at + len(known), more)
        if not added:
            raise ValueError(f"document ends within the element at {at}")
        known, more = known + added, more * 2
        places, _, depth = Structure(known).outside(False)
        done = places[depth == 0]
        if len(done):
            return known[:int(done[0]) + 1]


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    state: tuple[bool, int, str] | None


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.ranges = [Range(p, a, b, s and tuple(s)) for p, a, b, s in json.loads(options["ranges"])]
        self.sections = set(json.loads(options.get("sections", "[]")))

    def partitions(self) -> list[Range]:
        return self.ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(partition.path)
        with store.open_input_file(path) as file:
            if partition.state is None:
                data = _read(file, partition.start, partition.end - partition.start)
                head = b"{" if partition.start else data.lstrip(b"\xef\xbb\xbf \t\r\n")
                if head and not head.startswith(b"{"):
                    raise ValueError(f"not a document with sections: {partition.path}")
                told = summary(data, _read(file, partition.start - LONGEST_KEY, LONGEST_KEY))
                yield self._batch(partition.path, [("", partition.start, told)])
                return
            waiting = []
            for row in elements(file, partition.start, partition.end, partition.state, self.sections):
                waiting.append(row)
                if len(waiting) == ELEMENTS_PER_BATCH:
                    yield self._batch(partition.path, waiting)
                    waiting = []
            if waiting:
                yield self._batch(partition.path, waiting)

    @staticmethod
    def _batch(path: str, rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
        sections, places, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * len(rows)), pa.array(sections), pa.array(places, pa.int64()), pa.array(texts)],
            names=["path", "section", "at", "text"],
        )


class JsonRanges(DataSource):
    """Ranges of JSON documents: their summaries, or the elements that start in them."""

    @classmethod
    def name(cls) -> str:
        return "hiretide_json_ranges"

    def schema(self) -> str:
        return "path string, section string, at bigint, text string"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def read_elements(spark: SparkSession, files: list[tuple[str, int]], sections: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, section, at, text): the objects in the named top-level arrays of the files
    (URI, length), with the byte each starts at.

    A file is one object; empty files have no elements, anything else than objects in
    an array is passed over, and a document that ends within an element is an error.
    """
    spark.dataSource.register(JsonRanges)
    ranges = [(p, a, min(a + range_bytes, size)) for p, size in files for a in range(0, size, range_bytes)]

    def scan(rows: list) -> DataFrame:
        return (
            spark.read.format(JsonRanges.name()).option("ranges", json.dumps(rows))
            .option("sections", json.dumps(sections)).load()
        )

    if not ranges:
        return spark.createDataFrame([], "path string, section string, at bigint, text string")
    told: dict[str, list] = {}
    for row in scan([(*r, None) for r in ranges]).select("path", "at", "text").collect():
        told.setdefault(row["path"], []).append((row["at"], row["text"]))
    known = {}
    for path, rows in told.items():
        rows.sort()
        known.update(zip(((path, at) for at, _ in rows), states([text for _, text in rows]), strict=True))
    return scan([(p, a, b, known[p, a]) for p, a, b in ranges])
