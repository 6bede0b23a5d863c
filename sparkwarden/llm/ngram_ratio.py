"""Quality rule: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Tokens are words and runs of punctuation, case kept.  Unigrams and bigrams are hashed
into ``buckets``; their counts over *all* documents give the raw multinomial, over all
trusted ones the target's (both smoothed by adding ``smoothing`` to every count).  A
document's score is the mean over its n-grams of ``log(target / raw)``.

The threshold is deterministic too: the score (of four decimals) below which at most
``trusted_loss`` of the trusted documents lie, counted over all of them.

Plan.  Two scans of the text and no shuffle of it: each task of the first adds up one
short vector of counts; the second looks up one broadcast vector of ``buckets`` doubles.
Trusted ids are broadcast as a bitmap of at most ``broadcast_blocks`` blocks of 4 KiB (each of 32,768 ids in a row); beyond
that they are joined, which shuffles the texts once.

Result: ``doc_id, n_grams, score, keep`` for every row.

Edge cases.  Null and empty texts, and texts of white space, have no n-grams: score 0,
and they are not kept.  Texts of any length count and score whole; a score of just the threshold is kept.  A doc_id is trusted if any of its labels is.  With no trusted
documents all scores are 0 and every text with an n-gram stays.  Repeated rows count and
score each for itself; a null doc_id is never trusted; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

BUCKETS = 1 << 14
BROADCAST_BLOCKS = 8192
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, counts)`` of words and runs of punctuation."""
    n = len(offsets) - 1
    kind = np.where(_BLANK[data], 0, np.where(_WORD[data], 1, 2)).astype(np.int8)
    begin = kind > 0
    begin[1:] &= kind[1:] != kind[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = kind[edges] > 0
    at = np.flatnonzero(kind)
    if len(at) == 0:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    first = np.flatnonzero(begin[at])
    hashes = arrays.run_hashes(data[at], first)
    return hashes, np.diff(np.searchsorted(at[first], offsets))


def grams(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, per)``: the n-grams of all texts in order, and how many each has."""
    hashes, counts = tokens(*arrays.raw(texts))
    total = len(hashes)
    if total == 0:
        return np.zeros(0, np.int64), counts
    pair = arrays.mix(hashes[:-1] * arrays.BASE + hashes[1:])
    last = np.zeros(total, bool)
    ends = np.cumsum(counts)[counts > 0] - 1
    last[ends] = True
    # Side by side: each token, and the pair that it begins.
    grid = np.zeros((total, 2), np.uint64)
    grid[:, 0] = hashes
    grid[:-1, 1] = pair
    there = np.ones((total, 2), bool)
    there[:, 1] = ~last
    return ((grid.reshape(-1) >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)[there.reshape(-1)], np.maximum(2 * counts - 1, 0)


class IdSet:
    """Ids as bitmaps of 32,768 each."""

    def __init__(self, blocks: np.ndarray, bits: np.ndarray):
        order = np.argsort(blocks)
        self.blocks, self.bits = blocks[order], bits[order]

    def holds(self, ids: np.ndarray) -> np.ndarray:
        if len(self.blocks) == 0:
            return np.zeros(len(ids), bool)
        block, place = ids >> 15, ids & 32767
        at = np.minimum(np.searchsorted(self.blocks, block), len(self.blocks) - 1)
        return (self.blocks[at] == block) & ((self.bits[at, place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def id_set(ids: DataFrame, most_blocks: int) -> IdSet | None:
    """The ``k`` of ``ids``; None if they lie in more than ``most_blocks`` blocks."""
    block = F.shiftright("k", 15).alias("block")
    if ids.select(block).distinct().limit(most_blocks + 1).count() > most_blocks:
        return None
    found = ids.groupBy(block).agg(F.bitmap_construct_agg(F.col("k").bitwiseAND(F.lit(32767).cast("long"))).alias("bits")).toArrow()
    return IdSet(found.column("block").to_numpy().astype(np.int64), np.frombuffer(b"".join(found.column("bits").to_pylist()), np.uint8).reshape(-1, 4096))


def counted(df: DataFrame, id_column: str, text_column: str, trusted: DataFrame, buckets: int, broadcast_blocks: int) -> DataFrame:
    """``bucket, raw, target`` counts over all rows; ``trusted`` has ``k``."""
    rows = df.select(df[id_column].cast("long").alias("k"), df[text_column].cast("string").alias("t"))
    known = id_set(trusted, broadcast_blocks)
    held = df.sparkSession.sparkContext.broadcast(known)
    if known is None:
        rows = rows.join(trusted.withColumn("trusted", F.lit(True)), "k", "left").select(F.coalesce("trusted", F.lit(False)).cast("long").alias("k"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, raw, target = held.value, np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in arrays.eased(batches):
            names, texts = batch.column(0), arrays.text_column(batch.column(1))
            there, ids = names.is_valid().to_numpy(zero_copy_only=False), names.fill_null(0).to_numpy()
            good = there & (known.holds(ids) if known else ids == 1)
            for lo, hi in arrays.slices(texts):
                at, per = grams(texts.slice(lo, hi - lo), buckets)
                raw += np.bincount(at, minlength=buckets)
                target += np.bincount(at[np.repeat(good[lo:hi], per)], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    parts = rows.mapInArrow(run, "bucket int, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int, smoothing: float) -> np.ndarray:
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in counts.collect():  # one row a bucket
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if target.sum() == 0:
        return np.zeros(buckets)
    share = lambda c: (c + smoothing) / (c.sum() + smoothing * buckets)
    return np.log(share(target)) - np.log(share(raw))


def ratio_scores(df: DataFrame, id_column: str, text_column: str, ratios: np.ndarray) -> DataFrame:
    """``doc_id, n_grams, score`` of every row."""
    spark, buckets = df.sparkSession, len(ratios)
    held = spark.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in arrays.eased(batches):
            texts = arrays.text_column(batch.column(1))
            for lo, hi in arrays.slices(texts):
                at, per = grams(texts.slice(lo, hi - lo), buckets)
                score = np.zeros(hi - lo)
                rows = np.flatnonzero(per)
                if len(rows):
                    score[rows] = np.add.reduceat(table[at], (np.cumsum(per) - per)[rows]) / per[rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(per, pa.int64()), pa.array(np.round(score, 4) + 0.0)], names=["doc_id", "n_grams", "score"])

    rows = df.select(df[id_column].cast("long").alias("doc_id"), df[text_column].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_grams long, score double")


def thresholded(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int = BUCKETS, smoothing: float = 1.0, trusted_loss: float = 0.005, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """``doc_id, n_grams, score, keep``; trusted are the labels of quality 1 that aren't toxic."""
    from .storage import stored

    good = (labels["quality"] == 1) & (F.coalesce(labels["toxic"], F.lit(0)) == 0)
    trusted = labels.where(good & labels[id_column].isNotNull()).select(labels[id_column].cast("long").alias("k")).distinct()
    ratios = log_ratios(counted(df, id_column, text_column, trusted, buckets, broadcast_blocks), buckets, smoothing)
    scores = stored(ratio_scores(df, id_column, text_column, ratios), "ratios")
    # A count for each score of four decimals: as many rows as scores differ.
    tally = scores.where("n_grams > 0").join(trusted, scores["doc_id"] == trusted["k"], "left_semi").groupBy("score").count()
    rows = sorted((r["score"], r["count"]) for r in tally.collect())
    least, below, total = float("-inf"), 0, sum(c for _, c in rows)
    for score, count in rows:
        least = score
        below += count
        if below > trusted_loss * total:
            break
    return scores.withColumn("keep", (F.col("n_grams") > 0) & (F.col("score") >= F.lit(least)))
