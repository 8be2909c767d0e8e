"""Compression classifier for document quality.

Two Zstandard dictionaries are built, one from good and one from bad labelled text.  A text is cut into pieces of
`piece` bytes, all of it, and every piece is compressed on its own with each dictionary; so a long document can't
become its own dictionary and its end counts as much as its beginning.  The normalised difference is

    (size with the bad dictionary - size with the good one) / bytes,  summed over the pieces,

positive where the good dictionary explains the text better.  A logistic curve fitted on labelled texts that took no
part in the dictionaries turns it into the calibrated probability that the document is good.  A few bytes are little
evidence, so the curve's argument is weighed against the prior odds of the labels, n/(n+PRIOR_BYTES) to the rest.

Both fits read a sample of the labelled rows: per class about `dict_rows` documents for the dictionaries and as many
others for the curve (those whose id's hash is below the share that gives so many), with all their text.  `dict_rows` is
the parameter of that bound; scoring covers every document and all its text.  The sample is cut to documents that there
are; dictionaries are trained and differences computed by tasks, so the driver gets dictionaries and numbers, no texts.

Defined cases: null, empty and blank texts say nothing and get difference 0 and the score of that difference, but are
never good (`is_good` false); repeated rows get equal rows each; a null id is kept; labelled rows with null labels or
without a document, and ids with contradictory labels, are ignored; of an id with several texts the first in byte order is learnt from; without labelled rows of both classes nothing can be fitted, so every non-blank document
gets score 0.5 and is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.grams import string_buffers
from factloom.storage import shared_table

DICT_ROWS = 1500
DICT_BYTES = 64 * 1024
PIECE = 2048
LEVEL = 3
KEEP = 0.5
PRIOR_BYTES = 96
SCHEMA = "doc_id bigint, difference double, score double, is_good boolean"


def build_dictionary(texts: list[str], size: int = DICT_BYTES) -> bytes:
    """Trained dictionary; where the sample is too small to train on, the sample itself serves as raw content."""
    pieces = [raw[i : i + PIECE] for raw in (t.encode() for t in texts) for i in range(0, len(raw), PIECE)]
    total = sum(map(len, pieces))
    if total >= 8 * 1024 and len(pieces) >= 8:
        try:
            return zstandard.train_dictionary(min(size, max(1024, total // 4)), pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(pieces)[-size:]


class Compressors:
    """Compressors with the two dictionaries; made once in each Python worker."""

    def __init__(self, good: bytes, bad: bytes):
        self.sides = []
        for raw in (bad, good):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False))

    def difference(self, raw: bytes | memoryview) -> float:
        if not len(raw):
            return 0.0
        bad, good = self.sides
        change = 0
        for i in range(0, len(raw), PIECE):
            part = raw[i : i + PIECE]
            change += len(bad.compress(part)) - len(good.compress(part))
        return change / len(raw)


def fit_curve(difference: np.ndarray, size: np.ndarray, good: np.ndarray, odds: float, steps: int = 60) -> tuple[float, float, float, float]:
    """(scale, slope, offset, prior) of the curve in chance(), by Newton's method.

    odds: good to bad among all labels; the sample's classes are weighted to it.  A small ridge keeps separable
    samples finite.
    """
    weight = np.where(good > 0, odds * (len(good) - good.sum()) / max(good.sum(), 1), 1.0)
    weight *= len(good) / weight.sum()
    scale = float(np.std(difference)) or 1.0
    share = size / (size + PRIOR_BYTES)
    prior = float(np.log(odds))
    x = np.stack([share * difference / scale, share], 1)
    w = np.zeros(2)
    ridge = np.diag([1e-2, 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + (1 - share) * prior, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (good - p)) - ridge @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return scale, float(w[0]), float(w[1]), prior


def chance(curve: tuple[float, float, float, float], difference: np.ndarray, size: np.ndarray) -> np.ndarray:
    scale, slope, offset, prior = curve
    share = size / (size + PRIOR_BYTES)
    return 1 / (1 + np.exp(-np.clip(share * (slope * difference / scale + offset) + (1 - share) * prior, -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, mark: str = "quality") -> DataFrame:
    """(doc_id, text, class, half) of labelled documents, about 2*rows of each class of the 0/1 column `mark`, halves 0 and 1.

    An id counts with the label that all its rows agree on; the sample are the ids with the smallest hashes.  Classes of
    fewer documents are taken whole.  A written table of a bounded number of rows.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).cast("int").alias("class")).filter("doc_id IS NOT NULL AND class IN (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("class").alias("class"), F.max("class").alias("most")).filter("class = most")
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = shared_table(marks.join(there.select("doc_id"), "doc_id", "left_semi").select("doc_id", "class"), "labelled")
    share = {r["class"]: 2 * rows / r["n"] for r in marks.groupBy("class").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    chosen = marks.filter(place < F.when(F.col("class") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    met = there.filter("length(text) > 0").join(F.broadcast(chosen), "doc_id")  # about 4*rows ids
    sample = met.groupBy("doc_id", "class").agg(F.min("text").alias("text"))
    return shared_table(sample.select("doc_id", "text", "class", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(2)).cast("int").alias("half")), "labelled-sample")


def fit(docs: DataFrame, labels: DataFrame, dict_rows: int = DICT_ROWS) -> tuple | None:
    """(good dictionary, bad dictionary, curve), or None without labelled text of both classes."""
    sample = labelled_sample(docs, labels, dict_rows)
    count = {(r["class"], r["half"]): r["n"] for r in sample.groupBy("class", "half").agg(F.count("*").alias("n")).collect()}
    if not all(count.get((c, 0), 0) + count.get((c, 1), 0) for c in (0, 1)):
        return None
    # where a half lacks a class, all of the sample serves both fits
    whole = len(count) < 4

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        texts = frame.sort_values("doc_id", kind="stable")["text"].tolist()
        return pd.DataFrame({"class": [frame["class"].iloc[0]], "dictionary": [build_dictionary(texts)]})

    trained = sample.filter(F.lit(whole) | (F.col("half") == 0)).groupBy("class").applyInPandas(train, "class int, dictionary binary").collect()
    made = {r["class"]: bytes(r["dictionary"]) for r in trained}
    good, bad = made[1], made[0]

    def differ(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = Compressors(good, bad)
        for frame in frames:
            raw = [t.encode() for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "class": frame["class"], "x": [both.difference(r) for r in raw], "n": [float(len(r)) for r in raw]})

    seen = sample.filter(F.lit(whole) | (F.col("half") == 1)).mapInPandas(differ, "doc_id bigint, class int, x double, n double").toPandas().sort_values("doc_id")
    share = dict(labels.filter("quality IN (0, 1)").groupBy(F.col("quality").cast("int")).count().collect())
    odds = (share.get(1, 0) + 1) / (share.get(0, 0) + 1)
    return good, bad, fit_curve(seen["x"].to_numpy(), seen["n"].to_numpy(), seen["class"].to_numpy(float), odds)


def quality_scores(docs: DataFrame, labels: DataFrame, keep: float = KEEP, dict_rows: int = DICT_ROWS) -> DataFrame:
    """One row per document: (doc_id, difference, score, is_good)."""
    spark = docs.sparkSession
    model = fit(docs, labels, dict_rows)
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of a fixed size and three numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        both = Compressors(fitted[0], fitted[1]) if fitted else None
        for batch in batches:
            offsets, raw = string_buffers(batch.column(1))
            view = memoryview(raw)
            if both:
                x = np.array([both.difference(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], dtype=float)
                p = chance(fitted[2], x, np.diff(offsets).astype(float))
            else:
                x = np.zeros(len(batch))
                p = np.full(len(batch), 0.5)
            blank = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(p), pa.array((p >= keep) & ~blank)], names=["doc_id", "difference", "score", "is_good"])

    blank = ~F.coalesce(F.col("text").rlike("\\S"), F.lit(False))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.select("doc_id", "text", blank.alias("blank")).mapInArrow(score, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that quality_scores() calls good."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def good(texts: pd.Series) -> pd.Series:
        fitted = shared.value
        both = Compressors(fitted[0], fitted[1]) if fitted else None
        raw = [(t or "").encode() for t in texts]
        p = chance(fitted[2], np.array([both.difference(r) for r in raw], float), np.array([len(r) for r in raw], float)) if both else np.full(len(raw), 0.5)
        return pd.Series(p >= keep)

    return docs.filter(F.col(text_col).rlike("\\S")).filter(F.pandas_udf(good, "boolean")(F.col(text_col).cast("string")))
