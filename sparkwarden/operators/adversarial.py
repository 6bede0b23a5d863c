"""How well a detector withstands disguises, and how often it is wrong about clean text."""

from __future__ import annotations

import csv
import unicodedata
from collections.abc import Callable
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns
from ..functions.registry import FilterOptions


def attacks(spark: SparkSession, languages: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """``id, category, languages, expect, text`` of the labelled corpus."""
    text = files("sparkwarden.resources").joinpath("attacks.csv").read_text(encoding="utf-8")
    rows = [(r["id"], r["category"], [r["language"]], r["expect"], r["text"]) for r in csv.DictReader(text.splitlines())]
    out = spark.createDataFrame(rows, "id string, category string, languages array<string>, expect string, text string")
    if languages:
        out = out.where(F.arrays_overlap("languages", F.array(*map(F.lit, languages))))
    return out.where(F.col("category").isin(categories)) if categories else out


def preset(text: Column) -> Column:
    """The detector of this library with both built-in languages."""
    return columns.is_profane(text, FilterOptions(languages=("en", "de")))


def detector(detect: Callable[[str], bool]) -> Callable[[Column], Column]:
    """A Python function as a detector, called on Arrow batches.  A text on which it raises counts as neither."""

    def one(text: str) -> bool | None:
        try:
            return bool(detect(text))
        except Exception:
            return None

    @F.arrow_udf(T.BooleanType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in column.to_pylist()], pa.bool_())

    return run


def evaluate(corpus: DataFrame, detect: Callable[[Column], Column] = preset) -> DataFrame:
    """The corpus with ``detected`` (null where the detector failed) and ``passed``."""
    rows = corpus.withColumn("detected", detect(F.col("text")))
    return rows.withColumn("passed", F.coalesce(F.col("detected") == (F.col("expect") == "flag"), F.lit(False)))


def score(evaluated: DataFrame) -> DataFrame:
    """``evasion_resistance`` over texts to flag, ``precision`` over clean ones; 1 where there are none."""
    share = lambda kind: F.coalesce(F.avg(F.when(F.col("expect") == kind, F.col("passed").cast("double"))), F.lit(1.0))
    return evaluated.agg(share("flag").alias("evasion_resistance"), share("clean").alias("precision"), F.count(F.lit(1)).alias("total"), F.sum(F.col("passed").cast("long")).alias("passed"))


def by_category(evaluated: DataFrame) -> DataFrame:
    """``category, total, passed``; the row with null is all of them."""
    return evaluated.rollup("category").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("passed").cast("long")).alias("passed"))


def visible(text: str) -> str:
    """Characters that don't show, as their code points."""
    return "".join(f"<U+{ord(c):04X}>" if unicodedata.category(c)[0] in "CM" or c.isspace() and c != " " else c for c in text)


def report(evaluated: DataFrame, name: str = "filter", verbose: bool = False) -> str:
    total = score(evaluated).first()
    lines = [f"{name}: evasion resistance {total['evasion_resistance']:.0%}, precision {total['precision']:.0%}"]
    for row in by_category(evaluated).where("category is not null").orderBy("category").collect():
        lines.append(f"  {row['category']:<16} {'#' * row['passed']}{'.' * (row['total'] - row['passed'])} {row['passed']}/{row['total']}")
    failed = evaluated.where("not passed").orderBy("id").collect()
    lines += [f"  failed {r['id']}: {visible(r['text'])}" for r in (failed if verbose else failed[:10])]
    return "\n".join(lines)


def comparison(scores: dict[str, DataFrame]) -> str:
    """A line for each detector."""
    rows = {name: score(e).first() for name, e in scores.items()}
    return "\n".join(f"{name:<20} {r['evasion_resistance']:>5.0%} {r['precision']:>5.0%}" for name, r in rows.items())
