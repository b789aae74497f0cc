"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed character n-grams (one to three
characters, words padded with blanks).  Each language has several centroids,
found by k-means with cosine similarity; a text gets the language of the nearest
centroid.  Texts farther from it than nearly all training texts of that language
are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiretide.llm import arrays
from hiretide.llm.common import unit_hash, whole

BUCKETS = 4096
ORDERS = (1, 2, 3)
CENTROIDS = 4
ROUNDS = 12
# Texts the centroids of one language are fitted on, about (chosen by a hash of
# the id); document frequencies come from all training texts.
FIT_PER_LANGUAGE = 1500
# Share of a language's fitting texts that would be rejected.
REJECTED = 0.005
UNDETERMINED = "und"


def term_counts(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For ranges of texts: index of the first, letters per text, n-gram counts
    (texts x buckets).  Everything but letters is a blank; blanks count once."""
    for a, b in arrays.spans([len(t) + 2 for t in texts], 1 << 18):
        chars, sizes = arrays.code_points([f" {t.lower()} " for t in texts[a:b]])
        row = np.repeat(np.arange(b - a), sizes)
        letter = arrays.is_letter(chars)
        keep = letter | np.concatenate(([True], letter[:-1])) | (np.diff(row, prepend=-1) > 0)
        chars, row, letter = np.where(letter, chars, 32)[keep].astype(np.uint64), row[keep], letter[keep]
        letters = np.bincount(row[letter], minlength=b - a)
        counts = np.zeros((b - a) * BUCKETS, dtype=np.int64)
        code = np.zeros(len(chars), dtype=np.uint64)
        for n in ORDERS:
            code[: max(0, len(chars) - n + 1)] += chars[n - 1:] * arrays.RISING_CHARS[n]
            end = len(chars) - n + 1
            if end <= 0:
                break
            inside = (row[:end] == row[n - 1:]) if n > 1 else letter
            bucket = (arrays.mix(code[:end] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64)
            counts += np.bincount((row[:end] * BUCKETS + bucket)[inside], minlength=len(counts))
        yield a, letters, counts.reshape(b - a, BUCKETS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts) * idf
    size = np.linalg.norm(weighted, axis=1, keepdims=True)
    return (weighted / np.where(size, size, 1)).astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for _, letters, counts in term_counts(batch.column(0).to_pylist()):
            total += (counts > 0).sum(axis=0)
            n += int((letters > 0).sum())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate(([n], total)))], names=["bucket", "n"]
    )


def cluster(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means, started from points far from each other."""
    centres = [points.mean(axis=0)]
    while len(centres) < min(k, len(points)):
        centres.append(points[np.argmin((points @ np.array(centres).T).max(axis=1))])
    centres = np.array(centres)
    for _ in range(rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        nearest = (points @ centres.T).argmax(axis=1)
        centres = np.array([
            points[nearest == j].mean(axis=0) if (nearest == j).any() else centres[j] for j in range(len(centres))
        ])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def _fit(idf: np.ndarray):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_id", "_text"])
        points = [vectors(c, idf)[n > 0] for _, n, c in term_counts(frame["_text"].tolist())]
        points = np.concatenate(points)
        if not len(points):
            return pd.DataFrame({"lang": [], "centre": [], "least": []})
        centres = cluster(points, CENTROIDS)
        best = points @ centres.T
        nearest = best.argmax(axis=1)
        least = [
            float(np.quantile(best[nearest == j, j], REJECTED)) if (nearest == j).any() else 0.0
            for j in range(len(centres))
        ]
        return pd.DataFrame({
            "lang": frame["_lang"].iloc[0], "centre": [c.astype(np.float32).tobytes() for c in centres], "least": least,
        })

    return run


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict | None:
    """Centroids from the texts with a language; None where there is none.

    Document frequencies are counted over all rows.  What reaches the driver is
    4096 counts and a few centroids per language.
    """
    plain = docs.select(F.col(doc_id).alias("_id"), whole(text).alias("_text"), F.col(lang).alias("_lang"))
    plain = plain.filter("_lang IS NOT NULL")
    rows = (
        plain.select("_text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    ).collect()
    seen = {r["bucket"]: r["n"] for r in rows}
    n = seen.pop(-1, 0)
    if not n:
        return None
    df = np.zeros(BUCKETS)
    df[list(seen)] = list(seen.values())
    idf = np.log((1 + n) / (1 + df)) + 1
    sizes = plain.groupBy("_lang").agg(F.count(F.lit(1)).alias("_rows"))
    drawn = plain.join(F.broadcast(sizes) if sizes.count() < 10_000 else sizes, "_lang").filter(
        unit_hash("_id", "_text") * F.col("_rows") < FIT_PER_LANGUAGE
    )
    fitted = drawn.select("_id", "_text", "_lang").groupBy("_lang").applyInPandas(
        _fit(idf), "lang string, centre binary, least double"
    )
    found = fitted.orderBy("lang", "centre").collect()
    if not found:
        return None
    return {
        "idf": idf, "langs": [r["lang"] for r in found], "least": np.array([r["least"] for r in found]),
        "centres": np.array([np.frombuffer(r["centre"], np.float32) for r in found]),
    }


def _predictor(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            langs, scores, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            for a, letters, counts in term_counts(texts):
                if model is None:
                    continue
                likeness = vectors(counts, model["idf"]) @ model["centres"].T
                best = likeness.argmax(axis=1)
                for i in np.flatnonzero(letters):
                    langs[a + i] = model["langs"][best[i]]
                    scores[a + i] = min(1.0, max(0.0, float(likeness[i, best[i]])))
                    rejected[a + i] = likeness[i, best[i]] < model["least"][best[i]]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(langs), pa.array(scores), pa.array(rejected)],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"],
            )

    return run


def predict(docs: DataFrame, model: dict | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``lang_pred, score, rejected`` per row.

    ``score`` is the cosine to the nearest centroid (0 to 1).  NULL texts and texts
    without a letter are ``und`` with score 0 and rejected; so is every text where
    no model could be learned.
    """
    rows = docs.select(*keep, whole(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_predictor(model), f"{schema}, lang_pred string, score double, rejected boolean")
