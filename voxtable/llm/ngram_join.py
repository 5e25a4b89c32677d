"""N-gram Jaccard join with Bayesian pruning of candidates (operator 6).

Candidates share a MinHash band. Of each candidate pair the MinHash values are compared a few at a
time, and the pair is dropped once the posterior probability that its resemblance reaches the
threshold is below the tolerance; what remains is checked on the whole shingle sets.

Five words a shingle, resemblance 0.8, 24 bands of 5 values: a pair at exactly 0.8 goes unseen with
a probability under 1e-4, less above it. Shingles are compared by 64-bit hashes.

Edge cases. Null text counts as the empty text. Equal texts are one class, empty ones too. A text
without words resembles nothing but its copies; one of fewer than five words has one shingle, all
its words. Rows may repeat and doc_id may be null or repeat: each row gets its class; class_id is
null only where all rows of a class have a null doc_id. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, spool, table, text_or_empty
from .components import components
from .neardup import PairChecker, candidate_components, into_blocks, text_key, verified_links
from .shingles import Words, band_keys, minhash, portions, tune_bands, window_hashes

SIZE, THRESHOLD, MISS, LANES, TOLERANCE, STEP, BLOCK = 5, 0.8, 1e-4, 128, 1e-6, 24, 256


def _banded(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, bands) of each row; bands are null where a text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            keys, words = [], []
            for low, high in portions(texts):
                many = Words(texts[low:high])
                for a, b in zip(many.first[:-1], many.first[1:], strict=True):
                    words.append(b > a)
                    if b > a:
                        grams = np.unique(window_hashes(many.hashes[a:b], size))
                        keys.append(band_keys(minhash(grams, bands * rows), bands, rows))
            ends = np.cumsum(np.array([0, *words], np.int32) * bands, dtype=np.int32)
            values = pa.array(np.concatenate([np.empty(0, np.uint64), *keys]).view("int64"))
            lists = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(~np.array(words, bool)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), lists], ["doc_id", "key", "bands"])

    rows_in = docs.select("doc_id", text_or_empty().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows_in.select("doc_id", text_key(F.col("text")).alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key binary, bands array<bigint>")


def join(
    docs: DataFrame,
    size: int = SIZE,
    threshold: float = THRESHOLD,
    miss: float = MISS,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, key, class_id, head_key, copy_of, n_copies, n_links, a row per row.

    class_id: the least doc_id among the documents that are connected by links; copy_of: the least
    among those of equal text, n_copies how many there are; n_links: how many other texts reach
    the threshold; key: the text's hash, head_key that of the class's text with the least doc_id.
    """
    bands, rows = tune_bands(threshold, miss, LANES)
    seen = spool(_banded(docs, size, bands, rows))
    classes = spool(
        seen.groupBy("key").agg(
            F.min("doc_id").alias("copy_of"), F.count("*").alias("n_copies"), F.first("bands").alias("bands")
        )
    )
    near = candidate_components(classes.where("bands is not null").select("key", "bands"))
    wanted = spool(
        near.join(classes.select(F.col("key").alias("node"), "copy_of"), "node").select("node", "component", "copy_of")
    )
    texts = docs.select(text_or_empty().alias("text"), "doc_id").withColumn("node", text_key(F.col("text")))
    # always by a shuffle, so that the plan is the same at every size
    members = texts.join(wanted.hint("merge"), (texts.node == wanted.node) & texts.doc_id.eqNullSafe(wanted.copy_of)).select(
        wanted.node, "component", "text"
    )
    sizes = spool(wanted.groupBy("component").agg(F.count("*").alias("n")))  # from the ids alone: texts are read once
    checker = PairChecker(threshold, size, bands, rows, tolerance, STEP)
    links = spool(verified_links(into_blocks(members, block, sizes), checker))
    release(wanted, sizes)
    groups = components(links, "key", "peer")
    totals = links.groupBy("key").agg(F.sum("links").alias("n_links"))
    named = (
        classes.select("key", "copy_of", "n_copies")
        .join(totals, "key", "left")
        .join(groups.withColumnRenamed("node", "key"), "key", "left")
    )
    named = spool(named.select("key", "copy_of", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component"))
    rank = F.struct(F.col("copy_of").isNull(), "copy_of", "key")
    heads = spool(named.where("component is not null").groupBy("component").agg(F.min(rank).alias("head")))
    named = spool(
        named.join(heads, "component", "left").select(
            "key", F.coalesce("head.copy_of", "copy_of").alias("class_id"),
            F.coalesce("head.key", "key").alias("head_key"), "copy_of", "n_copies", "n_links",
        )
    )
    return seen.select("doc_id", "key").join(named, "key").select(
        "doc_id", "key", "class_id", "head_key", "copy_of", "n_copies", "n_links"
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the further members of each class: the row of the least doc_id stays. Rows that
    repeat as a whole (doc_id and text) stay once."""
    found = join(docs, **options)
    stay = spool(
        found.where((F.col("key") == F.col("head_key")) & F.col("doc_id").eqNullSafe(F.col("copy_of")))
        .groupBy(F.col("key").alias("kept_key"), F.col("doc_id").alias("kept_id"))
        .agg(F.count("*").alias("times"))
    )
    # the rows as structs, whatever their columns are called
    hashed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", text_key(text_or_empty()).alias("text_key"))
    left = hashed.join(stay.hint("merge"), (F.col("text_key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_id")))
    once = left.where("times = 1").select("row.*")
    again = left.where("times > 1").dropDuplicates(["kept_key", "kept_id"]).select("row.*")
    return once.unionByName(again)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class, the number of its copies and of its links to other texts."""
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", "n_copies", "n_links")


def keep_one_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


QUERIES = {"op6_ngram_join": op6_ngram_join}
