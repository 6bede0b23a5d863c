"""Moderation of whole tables: results, summary, samples, flagged words."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns, kernel
from ..functions.pii import PiiOptions
from ..functions.registry import FilterOptions
from . import ai as models

GATES = ("matched", "unmatched", "all")


@dataclass(frozen=True)
class ModerateOptions:
    """``filter`` or ``pii`` None leaves that stage out; ``gate`` says which records a model is asked about: that of ``ai``, or
    just the callable ``complete``.  At most ``max_calls`` records are asked about, each up to ``retries`` times more."""

    filter: FilterOptions | None = FilterOptions()
    pii: PiiOptions | None = None
    segments: bool = False
    complete: Callable | None = None
    ai: models.AiOptions | None = None
    gate: str | Callable[[DataFrame], Column] = "matched"
    max_calls: int | None = None
    retries: int = 2
    backoff_ms: int = 500
    concurrency: int = 8

    def model_options(self) -> models.AiOptions | None:
        """None if no model is to be asked."""
        own = self.ai or (models.AiOptions() if self.complete else None)
        return replace(own, complete=self.complete or own.complete) if own and own.enabled else None


def indexed(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """An ``index`` from 0.  With ``order_by`` in that order; else in that of partitions.

    Rows are numbered within partitions, and the partitions' sizes, one row each, give
    where each begins: no row goes through a single task."""
    rows = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by) if order_by else df
    marked = rows.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    sizes = marked.groupBy(part.alias("__part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    return marked.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("index", F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__before")


def moderate(df: DataFrame, options: ModerateOptions = ModerateOptions(), text_column: str = "text", id_column: str | None = None, index_column: str | None = None) -> DataFrame:
    """``index, id, text, flagged, matched_list, segments, pii, ai, error`` of every record.

    Filter and personal data are one Arrow evaluation that gives back no more than is asked for.  Without a model the plan is narrow."""
    if isinstance(options.gate, str) and options.gate not in GATES:
        raise ValueError(f"unknown gate {options.gate!r}; known: {', '.join(GATES)}")
    text = df[text_column].cast("string")
    index = df[index_column].cast("long") if index_column else F.lit(None).cast("long") if df.isStreaming else F.monotonically_increasing_id()
    rows = df.select(index.alias("index"), (df[id_column].cast("string") if id_column else F.lit(None).cast("string")).alias("id"), text.alias("text"))
    if options.filter or options.pii:
        rows = rows.withColumn("a", columns.analysis(F.col("text"), options.filter, options.pii, options.segments, False))
    else:
        rows = rows.withColumn("a", F.lit(None).cast(columns.ANALYSIS))
    matched = F.coalesce("a.flagged", F.lit(False))
    pieces = F.coalesce("a.segments", columns.clean_segments(F.col("text"))) if options.filter else F.lit(None).cast(columns.SEGMENTS)
    found = F.coalesce("a.pii", F.array().cast(columns.FINDINGS))
    rows = rows.select("index", "id", "text", matched.alias("matched_list"), (pieces if options.segments else F.lit(None).cast(columns.SEGMENTS)).alias("segments"), found.alias("pii"), F.col("a.error").alias("error"))
    if options.model_options():
        rows = models.ask(rows, _wanted(rows, options), options)
    else:
        rows = rows.withColumn("ai", F.lit(None).cast(models.VERDICT))
    flagged = F.col("matched_list") | (F.size("pii") > 0) | F.coalesce("ai.flagged", F.lit(False))
    return rows.select("index", "id", "text", flagged.alias("flagged"), "matched_list", "segments", "pii", "ai", "error")


def moderate_text(text: str, options: FilterOptions = FilterOptions(), ai: models.AiOptions | None = None) -> dict:
    """One text without Spark: ``flagged, matched_list, segments, ai``; a model is asked only if one is given."""
    pieces = kernel.segments(text, options)
    matched = any(bad for _, bad in pieces)
    verdict = models.analyze(text, ai) if ai else None
    return {"flagged": matched or bool(verdict and verdict["flagged"]), "matched_list": matched, "segments": [{"text": t, "is_profane": bad} for t, bad in pieces], "ai": verdict}


def _wanted(rows: DataFrame, options: ModerateOptions) -> Column:
    if callable(options.gate):
        return F.coalesce(options.gate(rows), F.lit(False))
    return {"matched": F.col("matched_list"), "unmatched": ~F.col("matched_list"), "all": F.lit(True)}[options.gate]


def summarize(results: DataFrame) -> DataFrame:
    """One row of counts; ``pii_by_kind`` is a map."""
    asked = F.col("ai").isNotNull() & ~F.coalesce(F.col("ai.status").isin("skipped", "disabled"), F.lit(True))
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    of_kind = lambda k: F.coalesce(F.sum(F.size(F.filter("pii", lambda p: p["kind"] == k)).cast("long")), F.lit(0))
    totals = results.agg(
        F.count(F.lit(1)).alias("processed"), count(F.col("flagged")).alias("flagged"), count(F.col("matched_list")).alias("matched_list"),
        count(F.size("pii") > 0).alias("pii_records"), F.coalesce(F.sum(F.size("pii").cast("long")), F.lit(0)).alias("pii_findings"),
        count(asked).alias("ai_calls"), count(F.col("ai.flagged")).alias("ai_flagged"), count(F.col("ai.status") == "error").alias("ai_errors"), count(F.col("error").isNotNull()).alias("errors"),
        count(F.col("ai.reason") == models.OVER_BUDGET).alias("ai_over_budget"),
        *(of_kind(k).alias(f"k{i}") for i, k in enumerate(columns.pii.KINDS)),
    )
    kinds = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, columns.pii.KINDS)), F.array(*(f"k{i}" for i in range(len(columns.pii.KINDS))))), lambda _, n: n > 0)
    return totals.withColumn("pii_by_kind", kinds).withColumn("ai_budget_exhausted", F.col("ai_over_budget") > 0).drop("ai_over_budget", *(f"k{i}" for i in range(len(columns.pii.KINDS))))


def pii_by_kind(results: DataFrame) -> DataFrame:
    return results.select(F.explode("pii").alias("p")).groupBy(F.col("p.kind").alias("kind")).agg(F.count(F.lit(1)).alias("findings")).orderBy(F.desc("findings"), "kind")


def samples(results: DataFrame, most: int = 20) -> DataFrame:
    """The first flagged records."""
    return results.where("flagged").orderBy("index").limit(most)


def flagged_words(df: DataFrame, options: FilterOptions = FilterOptions(), text_column: str = "text", index_column: str | None = None, min_count: int = 1, most_samples: int = 3) -> DataFrame:
    """``word, hits, count, samples``: in how many records each word is flagged."""
    index = df[index_column].cast("long") if index_column else F.monotonically_increasing_id()
    rows = df.select(index.alias("index"), df[text_column].cast("string").alias("text"))
    rows = rows.withColumn("h", columns.profane_hits(F.col("text"), options))
    words = F.array_distinct(F.transform("h", lambda h: h["word"]))
    # Counts shuffle words and hits alone.  For samples each partition keeps its first few of a word before anything is
    # shuffled (a window group limit), so no more texts than those move.
    each = rows.select(F.explode(F.transform(words, lambda w: F.struct(w.alias("word"), F.array_distinct(F.transform(F.filter("h", lambda h: h["word"] == w), lambda h: h["hit"])).alias("hits")))).alias("e")).select("e.*")
    counted = each.groupBy("word").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"), F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
    nth = F.row_number().over(Window.partitionBy("word").orderBy("index"))
    first = rows.select("index", "text", F.explode(words).alias("word")).withColumn("n", nth).where(F.col("n") <= most_samples)
    texts = first.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]).alias("samples"))
    return counted.join(texts, "word").select("word", "hits", "count", "samples").orderBy(F.desc("count"), F.collate("word", "UNICODE"), "word")


def overlapping_findings(results: DataFrame) -> DataFrame:
    """Pairs of findings of one record that overlap; there are none."""
    each = results.select("index", F.posexplode("pii").alias("n", "p"))
    previous = F.max("p.end").over(Window.partitionBy("index").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return each.withColumn("before", previous).where(F.col("before") > F.col("p.start")).select("index", "n")
