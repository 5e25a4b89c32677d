"""Quality classifier by compression (operator 1).

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text is cut into
blocks of BLOCK bytes, each block is compressed with either dictionary, and the sizes are summed over the
whole text: (bad - good) / (bad + good) is positive where the good dictionary helps more. The blocks are
short so that the dictionary, and not the text's own past, decides. A logistic curve, fitted to labelled rows
that are in neither dictionary, turns the difference into the probability of label 1; a second term tells
how well the text compresses at all, which parts repeated words from prose.

Fitting uses a bounded sample: SAMPLE labelled rows of each class, chosen by hash, without texts of more than LONGEST
characters; of repeated rows of a doc_id the least text counts. Dictionaries are built from at most SAMPLE_BYTES a
class. Everything else covers all rows and whole texts.

Edge cases. Null text counts as empty; texts without a byte get the fitted share of label 1. Null or
repeated labels: rows with a null doc_id or quality are ignored, a doc_id with both labels counts for both.
Without labelled rows of both classes the score is the share of label 1 (0.5 if there is none). A null
doc_id is never held out. Empty tables give no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

SAMPLE, LONGEST, SAMPLE_BYTES, DICTIONARY_BYTES, BLOCK, LEVEL, THRESHOLD = 1500, 50_000, 4_000_000, 65_536, 2048, 3, 0.3
#: Added to each compressed size, so that a short text, of which little is known, stays near the middle. Chosen by
#: cross-validation over the four folds that are not held out; 60 to 1,500 do about alike.
PRIOR_BYTES = 400


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


class Sizer:
    """Compressed sizes of a text under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes, block: int = BLOCK, level: int = LEVEL):
        self.block = block
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.good, self.bad = (
            zstandard.ZstdCompressor(level=level, dict_data=self._dictionary(d, level), **options) for d in (good, bad)
        )

    @staticmethod
    def _dictionary(data: bytes, level: int) -> zstandard.ZstdCompressionDict:
        made = zstandard.ZstdCompressionDict(data)
        made.precompute_compress(level=level)
        return made

    def features(self, text: str) -> tuple[float, float] | None:
        """(normalised difference, log of bytes over compressed bytes); None for no bytes."""
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return None
        good = bad = 0
        for at in range(0, len(data), self.block):
            part = data[at : at + self.block]
            good += len(self.good.compress(part))
            bad += len(self.bad.compress(part))
        both = good + bad + 2 * PRIOR_BYTES
        return (bad - good) / both, float(np.log(2 * (len(data) + 2 * PRIOR_BYTES) / both))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 100) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method with halved steps; the last is the intercept."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * w @ w)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step, now = np.linalg.solve(curve, slope), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    """Dictionaries, calibration and the share of label 1; a few hundred kilobytes whatever the corpus."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    spread: tuple[float, ...]
    share: float

    def score(self, found: tuple[float, float] | None) -> float:
        if found is None or not self.weights:
            return self.share
        z = (np.array(found) - self.centre) / self.spread
        return float(1 / (1 + np.exp(-np.clip(_terms(z) @ self.weights[:-1] + self.weights[-1], -30, 30))))


def _terms(z: np.ndarray) -> np.ndarray:
    """The difference, the compressibility, and their squares."""
    return np.concatenate((z, z * z), axis=-1)


def _dictionary(texts: list[str], most: int, size: int) -> bytes:
    parts, used = [], 0
    for t in texts:
        data = t.encode("utf-8", "surrogatepass")
        for at in range(0, len(data), BLOCK):
            if used >= most:
                break
            parts.append(data[at : at + BLOCK])
            used += len(parts[-1])
    try:
        return zstandard.train_dictionary(size, parts, k=64, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the text itself is the dictionary
        return b"".join(parts)[-size:]


def fit_texts(
    good: list[str],
    bad: list[str],
    share: float | None = None,
    dictionary_bytes: int = DICTIONARY_BYTES,
    sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Even rows build the dictionaries, odd rows calibrate. ``share`` is that of label 1 among all labelled
    rows; the sample holds as many of either class as it can, so the intercept is moved to that share."""
    n = len(good) + len(bad)
    if share is None:
        share = len(good) / n if n else 0.5
    if len(good) < 4 or len(bad) < 4:
        return Model(b"", b"", (), (), (), share)
    dictionaries = [_dictionary(x[::2], sample_bytes, dictionary_bytes) for x in (good, bad)]
    sizer = Sizer(*dictionaries)
    rows = [(f, label) for x, label in ((good, 1), (bad, 0)) for t in x[1::2] if (f := sizer.features(t)) is not None]
    x, y = np.array([r[0] for r in rows]).reshape(-1, 2), np.array([r[1] for r in rows], float)
    if len(set(y)) < 2:
        return Model(b"", b"", (), (), (), share)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = logistic_fit(_terms((x - centre) / spread), y)
    likely = min(max(share, 1e-6), 1 - 1e-6)
    weights[-1] += np.log(likely / (1 - likely)) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(*dictionaries, tuple(weights), tuple(centre), tuple(spread), share)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Learns from labels (doc_id, quality) outside the held-out fold; ``sample`` texts of a class with ``longest`` characters
    at most, which bounds what the driver gets."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    texts: dict[int, list[str]] = {}
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    chosen = [
        known.where(F.col("quality") == q).select("doc_id", "quality").distinct().orderBy(order, "doc_id").limit(sample)
        for q in (0, 1)
    ]
    # at most 2 * sample ids: the bound that makes this broadcast safe
    ids = F.broadcast(chosen[0].union(chosen[1]))
    short = docs.select("doc_id", text_or_empty().alias("text")).where(F.length("text") <= longest)
    rows = short.join(ids, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    for row in sorted(rows.collect()):
        texts.setdefault(row.quality, []).append(row.text)
    share = known.agg(F.avg("quality")).first()[0]
    return fit_texts(texts.get(1, []), texts.get(0, []), share)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 if score >= threshold), which take the place
    of columns of these names."""

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizer = Sizer(model.good, model.bad) if model.weights else None
        for texts in columns:
            yield pd.Series([model.score(sizer.features(t) if sizer else None) for t in texts], dtype="float64")

    run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = docs.withColumn("score", F.pandas_udf(run, "double")(text_or_empty()))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", held_out()), model).select("doc_id", "held_out", "score", "predicted")


def keep_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject, with their columns as they were."""
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score(rows, model).where("predicted = 1").select("row.*")


QUERIES = {"op1_compression_quality": op1_compression_quality}
