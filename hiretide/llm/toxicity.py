"""Toxicity by a subsequence-kernel support vector machine on Nyström landmarks.

The kernel compares short pieces of text (words, and runs of single letters) by
their subsequences of three letters, which may have gaps: each occurrence counts
``DECAY`` to the power of the characters it spans, so inserted characters, dots or
blanks weaken a match but do not end it.  Landmark pieces span the feature space
(Nyström); a linear support vector machine is trained there on pieces of labelled
texts.  Since the kernel is a dot product of subsequence counts, the trained
machine is a weight per subsequence, and a piece is scored without comparing it
with every landmark.  A text has the highest margin of its pieces, turned into a
probability by logistic calibration on texts that the machine was not fitted on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide.llm import arrays
from hiretide.llm.common import fresh, unit_hash, whole
from hiretide.llm.ngram_join import jaccard_classes
from hiretide.session import materialize

DECAY = 0.7
SPAN = 7
BITS = 18
# Long words and letter runs are read in overlapping pieces of this many characters.
PIECE = 24
LANDMARKS = 256
# Labelled texts that are read for fitting, about, per class (chosen by a hash of
# the text); as many others calibrate.
FIT_TOXIC, FIT_CLEAN = 2500, 5000
# Pieces that reach the driver: telling ones, ordinary ones, and per mining round
# the clean ones scored highest.
POSITIVES, NEGATIVES, MINED, MINING_ROUNDS = 1500, 6000, 3000, 2
# How much likelier in toxic texts a telling piece is (the next of these where none
# is), and how many of all pieces may be taken for telling by chance.
LEAST_RATIOS, BY_CHANCE = (25.0, 10.0, 4.0, 1.5, 1.0), 0.05
# Share of few labels that goes into fitting.
FIT_SHARE = 0.7
# Of the first pieces of both sides, disguised spellings are learned as well.
DISGUISED = 500
# Margin of a text without pieces, and lower bound of all margins.
FLOOR = -3.0
KNOWN_PIECES = 300_000
# Columns of dense vectors that the driver holds at once.
COLUMN_BLOCK = 4096
# Rows of features that are weighed at once.
ROW_BLOCK = 2048


# ---- pieces ----


def pieces(text: str) -> set[str]:
    """Words in lower case, runs of three and more single characters, and
    overlapping cuts of what is longer than ``PIECE``."""
    words = text.lower().split()
    found = set(words)
    if sum(len(w) == 1 for w in words) >= 3:
        run: list[str] = []
        for w in [*words, ""]:
            if len(w) == 1:
                run.append(w)
                continue
            if len(run) >= 3:
                found.add(" ".join(run))
            run = []
    long = [w for w in found if len(w) > PIECE]
    for w in long:
        found.discard(w)
        found.update(w[i:i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2))
    return found


def subsequences(batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of pieces: their places in the batch, and per piece the hashed
    subsequences and their weights (0: none), scaled to length 1.

    Only letters take part, with a mark before and after the piece; any other
    character is a gap that a subsequence spans.
    """
    sizes = np.array([len(p) for p in batch])
    by_size = np.argsort(sizes, kind="stable")
    for a, b in arrays.spans([int(s) + 2 for s in sizes[by_size]], 1 << 15):
        at = by_size[a:b]
        width = int(sizes[at].max()) + 2
        padded = [f"^{batch[i]}$".ljust(width, "\0") for i in at]
        chars = arrays.code_points(padded)[0].reshape(len(at), width)
        letter = arrays.is_letter(chars.ravel()).reshape(chars.shape) | (chars == 94)
        last = np.arange(width) == (sizes[at] + 1)[:, None]
        codes = np.where(letter | last, chars, 0).astype(np.uint64)
        codes[:, 1:][chars[:, 1:] == 94] = 0
        hashes, weights = [], []
        for i in range(1, SPAN - 1):
            for j in range(i + 1, SPAN):
                if j >= width:
                    continue
                x, y, z = codes[:, :width - j], codes[:, i:width - j + i], codes[:, j:]
                h = arrays.mix(x * arrays.RISING_CHARS[3] + y * arrays.RISING_CHARS[2] + z * arrays.RISING_CHARS[1])
                hashes.append((h >> np.uint64(64 - BITS)).astype(np.int32))
                weights.append(((x > 0) & (y > 0) & (z > 0)) * np.float32(DECAY ** (j + 1)))
        if not hashes:
            yield at, np.zeros((len(at), 1), np.int32), np.zeros((len(at), 1), np.float32)
            continue
        hashes, weights = np.concatenate(hashes, axis=1), np.concatenate(weights, axis=1)
        size = np.sqrt((weights**2).sum(axis=1, keepdims=True))
        yield at, hashes, weights / np.where(size, size, 1)


# ---- the machine ----


@dataclass
class Machine:
    """Margin of a piece: sum of weight x table[subsequence], plus bias."""

    table: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, batch: list[str]) -> np.ndarray:
        out = np.full(len(batch), FLOOR)
        for at, hashes, weights in subsequences(batch):
            out[at] = np.maximum(FLOOR, (self.table[hashes] * weights).sum(axis=1) + self.bias)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


class Scorer:
    """Highest margin of a text's pieces; remembers a bounded number of pieces."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), FLOOR)
        for a, b in arrays.spans([len(t) for t in texts], 1 << 21):
            found = [pieces(t) for t in texts[a:b]]
            if len(self.known) > KNOWN_PIECES:
                self.known = {}
            new = list(set().union(*found) - self.known.keys())
            self.known.update(zip(new, self.machine.margins(new).tolist(), strict=True))
            for i, ps in enumerate(found):
                out[a + i] = max(map(self.known.__getitem__, ps), default=FLOOR)
        return out


def _dense(batch: list[str], columns: np.ndarray) -> np.ndarray:
    """Subsequence weights of pieces in the given columns (sorted hashes)."""
    out = np.zeros((len(batch), len(columns)), dtype=np.float32)
    if not len(columns):
        return out
    for at, hashes, weights in subsequences(batch):
        place = np.searchsorted(columns, hashes).clip(0, max(0, len(columns) - 1))
        hit = (columns[place] == hashes) & (weights > 0)
        row = np.broadcast_to(at[:, None], hashes.shape)
        np.add.at(out, (row[hit], place[hit]), weights[hit])
    return out


def columns_of(batch: list[str]) -> np.ndarray:
    return np.unique(np.concatenate([h[w > 0] for _, h, w in subsequences(batch)] or [np.zeros(0, np.int32)]))


def likeness(batch: list[str]) -> np.ndarray:
    """Kernel of all pairs of pieces, summed up over blocks of columns, so that the
    dense vectors of the driver stay small."""
    columns = columns_of(batch)
    gram = np.zeros((len(batch), len(batch)), dtype=np.float32)
    for i in range(0, len(columns), COLUMN_BLOCK):
        block = _dense(batch, columns[i:i + COLUMN_BLOCK])
        gram += block @ block.T
    return gram


def spread(gram: np.ndarray, n: int) -> list[int]:
    """Pieces chosen one by one, each least like those before, by their kernel."""
    if not len(gram):
        return []
    chosen, nearest = [0], gram[0].copy()
    while len(chosen) < min(n, len(gram)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, gram[chosen[-1]])
    return sorted(set(chosen))


def train(positive: list[str], weight: np.ndarray, negative: list[str], landmarks: int = LANDMARKS) -> Machine:
    """Landmarks from both sides, Nyström features, squared hinge loss, Newton."""
    told = with_disguises(positive, DISGUISED)
    positive, weight = [w for _, w in told], weight[[i for i, _ in told]] if told else weight
    negative = [w for _, w in with_disguises(negative, DISGUISED * 3)]
    chosen = []
    for side, share in ((positive[: landmarks * 2], landmarks * 2 // 3), (negative[: landmarks * 2], landmarks // 3)):
        chosen += [side[i] for i in spread(likeness(side), share)]
    columns = columns_of(chosen)
    if not len(columns):
        return Machine(np.zeros(1 << BITS, np.float32), FLOOR)
    marks = _dense(chosen, columns)
    gram = marks @ marks.T
    values, turns = np.linalg.eigh(gram.astype(float))
    good = values > 1e-6 * values.max()
    project = turns[:, good] / np.sqrt(values[good])
    everything = positive + negative
    # held once; a second copy in any form would double what the driver needs
    z = np.ones((len(everything), project.shape[1] + 1))
    for i in range(0, len(everything), 100):
        z[i:i + 100, :-1] = _dense(everything[i:i + 100], columns) @ marks.T @ project
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    c = np.concatenate([weight / weight.sum(), np.full(len(negative), 1 / max(1, len(negative)))]) * len(y)
    w = np.zeros(z.shape[1])
    for _ in range(40):
        active = y * (z @ w) < 1
        square, side = np.eye(z.shape[1]) * 0.05, np.zeros(z.shape[1])
        for i in range(0, len(z), ROW_BLOCK):
            block = slice(i, i + ROW_BLOCK)
            za, ca = z[block][active[block]], c[block][active[block]]
            square += za.T @ (za * ca[:, None])
            side += za.T @ (ca * y[block][active[block]])
        new = np.linalg.solve(square, side)
        if np.abs(new - w).max() < 1e-6:
            break
        w = (w + new) / 2 if _ > 20 else new
    table = np.zeros(1 << BITS, dtype=np.float32)
    table[columns] = marks.T @ (project @ w[:-1])
    return Machine(table, float(w[-1]))


# ---- fitting ----


def disguised(piece: str, salt: int) -> list[str]:
    """A word as it may be written to slip through: letters apart, and one
    character put in (place and character follow from the word)."""
    if len(piece) < 4 or " " in piece:
        return []
    at = 1 + (sum(map(ord, piece)) + salt) % (len(piece) - 1)
    put = "x.*-_qz'"[(len(piece) * 3 + salt + ord(piece[0])) % 8]
    return [".".join(piece), " ".join(piece), piece[:at] + put + piece[at:], piece[:at] + piece[at - 1] + piece[at:]]


def with_disguises(words: list[str], most: int) -> list[tuple[int, str]]:
    """(place of the word, written form): all words, and disguises of the first."""
    plain = list(enumerate(words))
    return plain + [(i, d) for i, w in plain[:most] for salt in (0, 3) for d in sorted(set(disguised(w, salt)))]


def _list_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text: id, label and its pieces."""
    for batch in batches:
        found = [sorted(pieces(t)) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["_id", "_toxic", "_pieces"]
        )


def count_pieces(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of different texts (_toxic, _text): (class_id, _toxic), one row for each class of
    near copies and label, and for each piece in how many of these it is, toxic (up)
    and clean (down).

    Classes are those of the n-gram join, compared exactly.  Near copies count once
    with the pieces of all of them, so no text is left out.
    """
    named = texts.select(F.sha2("_text", 256).alias("_id"), "_toxic", "_text")
    classes = materialize(jaccard_classes(named, "_id", "_text").select("_id", "class_id"), "near-copies")
    listed = named.mapInArrow(_list_pieces, "_id string, _toxic int, _pieces array<string>")
    held = listed.join(classes, "_id").select("class_id", "_toxic", F.explode("_pieces").alias("_piece")).distinct()
    counted = held.groupBy("_piece").agg(F.sum("_toxic").alias("up"), F.sum(1 - F.col("_toxic")).alias("down"))
    return named.join(classes, "_id").select("class_id", "_toxic").distinct(), counted


def _margins_of_pieces(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch_pieces = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(machine.margins(batch_pieces))], names=["_piece", "_margin"]
            )

    return run


def _margins_of_texts(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scorer(batch.column(1).to_pylist()))], names=["_toxic", "_margin"]
            )

    return run


def calibrate(machine: Machine, margin: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> Machine:
    """Logistic regression of the label on the margin."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3 * weight.sum() / len(weight)
        step = np.linalg.solve(slope, x.T @ (weight * (toxic - p)) - 1e-3 * weight.sum() / len(weight) * w)
        w = w + np.clip(step, -2, 2)
    return Machine(machine.table, machine.bias, float(max(w[0], 0.0)), float(w[1]))


def fit(docs: DataFrame, labels: DataFrame, wanted: Column | None = None, doc_id: str = "doc_id", text: str = "text",
        toxic: str = "toxic") -> Machine | None:
    """A machine from the documents with a label 0 or 1 (of a document with both,
    neither counts); None where one of the two is missing.  ``wanted`` may restrict
    the labels, by ``_of``, the id they belong to.

    About ``FIT_TOXIC`` and ``FIT_CLEAN`` labels for fitting and as many for
    calibration are drawn by a hash of the id, so the ids that are broadcast to
    fetch their texts are bounded.  Equal texts count once, near copies once for each piece.
    """
    told = labels.select(F.col(doc_id).alias("_of"), F.col(toxic).cast("int").alias("_toxic")).filter("_toxic IN (0, 1)")
    if wanted is not None:
        told = told.filter(wanted)
    told = told.groupBy("_of").agg(F.min("_toxic").alias("_toxic"), F.max("_toxic").alias("most")).filter("_toxic = most")
    sizes = {r["_toxic"]: r["count"] for r in told.groupBy("_toxic").count().collect()}
    if len(sizes) < 2:
        return None
    drawn = F.when(F.col("_toxic") == 1, FIT_TOXIC / sizes[1]).otherwise(FIT_CLEAN / sizes[0])
    half = F.least(drawn, F.lit(FIT_SHARE))
    marked = told.withColumn("_place", unit_hash("_of")).filter(F.col("_place") < half * 2)
    marked = marked.select("_of", "_toxic", (F.col("_place") < half).alias("_fits"))
    plain = docs.select(F.col(doc_id).alias("_id"), whole(text).alias("_text"))
    rows = plain.join(F.broadcast(marked), F.col("_id") == F.col("_of")).select("_toxic", "_fits", "_text")
    rows = rows.groupBy("_text").agg(F.max("_toxic").alias("_toxic"), F.min("_fits").alias("_fits")).persist()
    groups, counted = count_pieces(rows.filter("_fits").select("_toxic", "_text"))
    counted = counted.persist()
    n = {r["_toxic"]: r["count"] for r in groups.groupBy("_toxic").count().collect()}
    share = max(1, n.get(1, 0)) / max(2, n.get(0, 0) + n.get(1, 0))
    # log-likelihood that the piece favours toxic texts, against what chance brings among all pieces
    up, down = F.col("up").cast("double"), F.col("down").cast("double")
    total = up + down
    favour = up * F.log(up / (total * share)) + F.when(down > 0, down * F.log(down / (total * (1 - share)))).otherwise(0.0)
    needed = float(np.log(max(1, counted.count()) / BY_CHANCE))
    ratio = (up / share) / ((down + 0.5) / (1 - share))
    weighed = counted.filter("up > 0").withColumns({"_favour": favour, "_ratio": ratio})
    # labels with weak signs only give a machine as well: gates are lowered one by one
    for least, gate in [*((r, needed) for r in LEAST_RATIOS), (1.0, 0.0), (0.0, -math.inf)]:
        telling = (
            weighed.filter((F.col("_favour") >= gate) & (F.col("_ratio") >= least)).orderBy(F.desc("up"), "_piece")
            .limit(POSITIVES).collect()
        )
        if telling:
            break
    ordinary = counted.filter("down > 0").orderBy(F.xxhash64("_piece"), "_piece").limit(NEGATIVES).collect()
    positive, weight = [r["_piece"] for r in telling], np.sqrt([float(r["up"]) for r in telling])
    negative = [r["_piece"] for r in ordinary]
    if not positive:
        counted.unpersist()
        rows.unpersist()
        return None
    machine = train(positive, weight, negative)
    clean = counted.filter("down > 0").select("_piece")
    for _ in range(MINING_ROUNDS):
        hard = clean.mapInArrow(_margins_of_pieces(machine), "_piece string, _margin double").orderBy(
            F.desc("_margin"), "_piece"
        ).limit(MINED).collect()
        known = set(negative)
        negative = [r["_piece"] for r in hard if r["_piece"] not in known] + negative
        machine = train(positive, weight, negative)
    counted.unpersist()
    other = rows.filter("NOT _fits")
    judged = other.select("_toxic", "_text").mapInArrow(_margins_of_texts(machine), "_toxic int, _margin double").toPandas()
    rows.unpersist()
    toxic_rows = judged["_toxic"].to_numpy()
    share = np.array([max(1, (toxic_rows == k).sum()) for k in (0, 1)])
    prior = np.array([sizes[0], sizes[1]]) / (sizes[0] + sizes[1])
    return calibrate(machine, judged["_margin"].to_numpy(), toxic_rows, (prior / share)[toxic_rows] * len(toxic_rows))


# ---- scoring ----


def scorer(machine: Machine | None):
    """Arrow function of texts: probability of label 1 (0 where nothing could be learned)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = machine and Scorer(machine)
        for texts in batches:
            yield pd.Series(machine.probability(judge(texts.tolist())) if judge else np.zeros(len(texts)))

    return score


def scores(docs: DataFrame, machine: Machine | None, name: str = "score", text: str = "text") -> DataFrame:
    """The documents with their score.  NULL and empty texts have the score of a
    text without pieces.  Rows are judged one by one: NULL ids, repeated rows and
    other columns do not matter (``name`` must be free)."""
    return docs.withColumn(name, scorer(machine)(whole(text)))


def clean(docs: DataFrame, machine: Machine | None, text: str = "text") -> DataFrame:
    """The documents, all columns, that score below one half."""
    (name,) = fresh(docs, "_score")
    return scores(docs, machine, name, text).filter(F.col(name) < 0.5).drop(name)
