"""Document fingerprints: bottom-k sketches of shingle hashes (operator 3).

A sketch holds the k least distinct 64-bit hashes of a text's five-word shingles and whether there were more. Sketches
merge: that of a union of shingle sets comes from the sketches of its parts, so parts of a
document or corpus can be sketched apart. They estimate the number of distinct shingles, resemblance and
containment; for sets of at most k shingles all three are exact up to hash collisions.

A fingerprint is the base64 of the sketch's hashes, big-endian and ascending, with a trailing ``+`` if the set
had more than k. Equal texts have equal fingerprints.

Edge cases. Null text counts as empty; a text without words has the empty fingerprint, and two empty
fingerprints have likeness 1, an empty and another 0. Texts of fewer than five words have one shingle.
The next document is that of the next greater doc_id, of rows with equal doc_id the next by text; after the last row
comes the first; nulls order first; doc_id may be of any type with an order. A lone row is its own next. Empty tables give no rows. Other
columns do not matter.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, IntegralType, TimestampType

from .common import shuffle_parts, table, text_or_empty
from .shingles import shingles

K, SIZE, DRAWN = 128, 5, 20
MOST = float(1 << 64)


class Sketch:
    """Bottom-k sketch: ascending distinct hashes, and whether the set has more of them."""

    __slots__ = ("hashes", "k", "more")

    def __init__(self, hashes: np.ndarray, more: bool, k: int = K):
        self.hashes, self.more, self.k = hashes, more, k

    @classmethod
    def of(cls, text: str, k: int = K, size: int = SIZE) -> Sketch:
        found = shingles(text, size)
        return cls(found[:k], len(found) > k, k)

    def merge(self, other: Sketch) -> Sketch:
        k = min(self.k, other.k)
        both = np.union1d(self.hashes, other.hashes)
        if self.more or other.more:
            # beyond the lesser last hash a set may hold hashes that its sketch does not
            ends = [s.hashes[-1] for s in (self, other) if s.more]
            both = both[both <= min(ends)]
        return Sketch(both[:k], self.more or other.more or len(both) > k, k)

    def distinct(self) -> float:
        """Estimated number of distinct shingles."""
        n = len(self.hashes)
        return float(n) if not self.more else (n - 1) * MOST / float(self.hashes[-1])

    def resemblance(self, other: Sketch) -> float:
        """Estimated Jaccard index of the two sets; 1 of two empty ones."""
        union = self.merge(other).hashes
        if not len(union):
            return 1.0
        return float(np.isin(union, np.intersect1d(self.hashes, other.hashes, assume_unique=True), assume_unique=True).mean())

    def containment(self, other: Sketch) -> float:
        """Estimated share of this set that lies in the other one; 1 of an empty set."""
        if not len(self.hashes):
            return 1.0
        common = self.resemblance(other) * self.merge(other).distinct()
        return min(1.0, common / self.distinct())

    def text(self) -> str:
        return base64.b64encode(self.hashes.astype(">u8").tobytes()).decode() + "+" * self.more

    @classmethod
    def parse(cls, text: str, k: int = K) -> Sketch:
        more = text.endswith("+") and len(text) % 4 == 1
        data = base64.b64decode(text[:-1] if more else text)
        return cls(np.frombuffer(data, ">u8").astype(np.uint64), more, k)


def fingerprint(docs: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    """docs with a column ``fingerprint``."""

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([Sketch.of(t, k, size).text() for t in column], dtype=object)

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return docs.withColumn("fingerprint", F.pandas_udf(run, "string")(text_or_empty()))


def merged(prints: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """prints (by..., fingerprint) -> by..., fingerprint of the union. Sketches merge within each task first,
    then k hashes a task and key meet; a hot key is spread over its tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Sketch] = {}
        for frame in frames:
            for *key, text in frame[[*by, "fingerprint"]].itertuples(index=False):
                key = tuple(None if pd.isna(x) else x for x in key)
                new = Sketch.parse(text, k)
                held[key] = held[key].merge(new) if key in held else new
        yield pd.DataFrame([(*key, s.text()) for key, s in held.items()], columns=[*by, "fingerprint"])

    kind = prints.select(*by, "fingerprint").schema
    spread = F.pmod(F.xxhash64("fingerprint"), F.lit(32))
    once = prints.select(*by, "fingerprint").mapInPandas(run, kind)
    n = shuffle_parts(prints.sparkSession)
    salted = once.withColumn("_salt", spread).repartition(n, *by, "_salt").drop("_salt").mapInPandas(run, kind)
    return salted.repartition(n, *by).mapInPandas(run, kind)


def bounds_of(rows: DataFrame, ranges: int) -> tuple[list, object]:
    """Ids that begin the ranges but the first, ascending, and the id that begins the first (null if there are null ids). A range begins
    with an id of the table, so none is empty. About DRAWN distinct ids a range, those with the least hashes, are collected."""
    of = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.min("doc_id").alias("least")).first()
    whole = 1 << 30
    share = min(whole, -(-DRAWN * ranges * whole // max(of["n"], 1)))
    drawn = rows.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < share)).select("doc_id").distinct()
    found = sorted(r[0] for r in drawn.collect() if r[0] == r[0])
    starts = sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []
    return [x for x in starts if x != of["least"]], of["least"] if of["known"] == of["n"] else None


def followed(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, place, doc_id, text, copy): docs dealt to ranges of doc_id, each with the row that follows its last
    one as a copy at its end. The bounds travel as one sorted list, so the plan does not grow with their number."""
    kind = docs.schema["doc_id"].dataType
    # a point in time has no one form in Python, its microseconds have
    plain = F.unix_micros("doc_id") if isinstance(kind, TimestampType) else F.col("doc_id")
    rows = docs.select(plain.alias("doc_id"), text_or_empty().alias("text"))
    starts, least = bounds_of(rows, buckets)
    quick = isinstance(rows.schema["doc_id"].dataType, IntegralType | FractionalType) and not isinstance(rows.schema["doc_id"].dataType, DecimalType)

    @F.arrow_udf("struct<bucket: int, begins: boolean>")
    def dealt(ids: pa.Array) -> pa.Array:
        if quick:
            keys = np.asarray(ids.drop_null())
            some = np.searchsorted(np.asarray(starts, dtype=keys.dtype), keys, side="right")
        else:
            keys = ids.drop_null().to_pylist()
            some = np.array([bisect.bisect_right(starts, x) for x in keys], dtype=np.int64)
        opens = np.fromiter((b > 0 and starts[b - 1] == x for b, x in zip(some.tolist(), keys, strict=True)), bool, len(some))
        known = np.asarray(ids.is_valid())
        bucket, begins = np.zeros(len(ids), np.int32), np.zeros(len(ids), bool)
        bucket[known], begins[known] = some, opens
        return pa.StructArray.from_arrays([pa.array(bucket), pa.array(begins)], names=["bucket", "begins"])

    first = F.col("doc_id").eqNullSafe(F.lit(least).cast(rows.schema["doc_id"].dataType))
    # the first row of a range goes to the range before as well, that of the first range behind the last
    placed = rows.withColumn("own", dealt("doc_id"))
    own = F.struct(F.col("own.bucket").alias("bucket"), F.lit(0).alias("place"), F.lit(False).alias("copy"))
    before = F.struct((F.col("own.bucket") - 1).alias("bucket"), F.lit(0).alias("place"), F.lit(True).alias("copy"))
    behind = F.struct(F.lit(len(starts)).alias("bucket"), F.lit(1).alias("place"), F.lit(True).alias("copy"))
    at = F.when(F.col("own.begins"), F.array(own, before)).when(first, F.array(own, behind)).otherwise(F.array(own))
    dealt_rows = placed.select(F.explode(at).alias("at"), "doc_id", "text")
    back = F.timestamp_micros("doc_id") if isinstance(kind, TimestampType) else F.col("doc_id")
    return dealt_rows.select("at.bucket", "at.place", back.alias("doc_id"), "text", "at.copy")


def compare(docs: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_shingles, contained: each text beside its edited text and the next document. The last is how
    much of the text the edited text is estimated to contain."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    dealt = followed(docs, 4 * parts)
    placed = dealt.withColumn("id", F.col("doc_id").cast("string")).repartition(parts, "bucket")
    ordered = placed.sortWithinPartitions("bucket", "place", F.col("doc_id").asc_nulls_first(), "text", "copy")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(key, text: str, sketch: Sketch, following: str, next_sketch: Sketch) -> tuple:
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            other = Sketch.of(edited, k, size)
            return (
                key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), sketch.text(), other.text(),
                sketch.resemblance(other), sketch.resemblance(next_sketch), sketch.distinct(), sketch.containment(other),
            )

        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "contained"]
        held = None  # the last row seen that is no copy, while its next is awaited
        for frame in frames:
            out = []
            for bucket, key, text, copy in zip(*(frame[c] for c in ("bucket", "id", "text", "copy")), strict=True):
                sketch = None
                if held is not None and held[0] == bucket:
                    sketch = Sketch.of(text, k, size)
                    out.append(row(held[1], held[2], held[3], text, sketch))
                held = None if copy else (bucket, key, text, sketch or Sketch.of(text, k, size))
            yield pd.DataFrame(out, columns=names)

    schema = (
        "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, n_shingles double, contained double"
    )
    made = ordered.select("bucket", "id", "text", "copy").mapInPandas(run, schema)
    return made.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *[c for c in made.columns if c != "id"])


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
