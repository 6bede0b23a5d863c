"""Allowlist tuning: measure, propose, verify, measure again."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns, kernel, patterns
from ..functions.registry import FilterOptions
from .moderate import flagged_words

VERDICTS = ("ordinary", "offensive", "unsure")


@dataclass
class Report:
    before: dict
    accepted: list[dict] = field(default_factory=list)
    rejected: list[dict] = field(default_factory=list)
    judged: list[dict] = field(default_factory=list)
    unjudged: list[str] = field(default_factory=list)
    after: dict | None = None
    rerun: bool = True


def escape(word: str) -> str:
    return re.sub(r"[.*+?^${}()|\[\]\\]", r"\\\g<0>", word)


def measure(df: DataFrame, options: FilterOptions, text_column: str = "text") -> dict:
    row = df.select(F.coalesce(columns.is_profane(df[text_column], options), F.lit(False)).alias("p")).agg(F.count(F.lit(1)).alias("scanned"), F.coalesce(F.sum(F.col("p").cast("long")), F.lit(0)).alias("flagged")).first()
    return {"scanned": row["scanned"], "flagged_records": row["flagged"]}


def verify(entry: str, words: list[str], offensive: list[str], options: FilterOptions) -> dict:
    """Whether an entry clears ``words`` and lets none of the ``offensive`` through."""
    try:
        patterns.check(f"^(?:{entry})$")
        patterns.check(f"^(?:{patterns.expand(entry)})$")
    except patterns.PatternError as why:
        return {"ok": False, "reason": "invalid", "detail": str(why)}
    wider = replace(options, allow_list=(*options.allow_list, entry))
    if any(kernel.is_profane(w, wider) for w in words):
        return {"ok": False, "reason": "no-effect"}
    for word in offensive:
        if kernel.is_profane(word, options) and not kernel.is_profane(word, wider):
            return {"ok": False, "reason": "too-broad", "word": word}
    return {"ok": True}


def judgement_prompt(words: list[dict]) -> str:
    return "\n".join(["For each flagged word say whether it is ordinary, offensive or unsure, and for an ordinary one give a pattern that matches its forms only.", *(f"- {w['word']} (flagged for {', '.join(w['hits'])})" for w in words)])


def judgement_schema() -> dict:
    item = {"type": "object", "properties": {"word": {"type": "string"}, "verdict": {"type": "string", "enum": list(VERDICTS)}, "entry": {"type": "string"}, "reason": {"type": "string"}}, "required": ["word", "verdict"], "additionalProperties": False}
    return {"type": "object", "properties": {"words": {"type": "array", "items": item}}, "required": ["words"], "additionalProperties": False}


def tune(df: DataFrame, options: FilterOptions = FilterOptions(), verdicts: Mapping[str, str] | None = None, complete: Callable[[dict], dict] | None = None, text_column: str = "text", limit: int = 50, min_count: int = 1) -> Report:
    """The ``limit`` most frequent flagged words are judged, by hand or by a model in one call;
    entries are verified against every word judged offensive before they are accepted."""
    top = [r.asDict() for r in flagged_words(df, options, text_column, min_count=min_count).limit(limit).collect()]
    report = Report(before=measure(df, options, text_column), rerun=not df.isStreaming)
    supplied = dict(verdicts or {})
    open_words = [w for w in top if w["word"] not in supplied]
    judged = {w: {"word": w, "verdict": v, "by": "hand"} for w, v in supplied.items() if v in VERDICTS}
    if complete and open_words:
        try:
            for item in json.loads(complete({"system": judgement_prompt(open_words), "text": "", "schema": judgement_schema()})["json"])["words"]:
                if item.get("verdict") in VERDICTS and any(w["word"] == item.get("word") for w in open_words):
                    judged[item["word"]] = item | {"by": "model"}
        except Exception as why:  # a model that fails leaves words unjudged
            report.rejected.append({"entry": None, "reason": "model", "detail": str(why)})
    report.judged = list(judged.values())
    report.unjudged = [w["word"] for w in top if w["word"] not in judged]
    offensive = [w for w, j in judged.items() if j["verdict"] == "offensive"]
    wanted: dict[str, list[str]] = {}
    for w in top:
        j = judged.get(w["word"])
        if j and j["verdict"] == "ordinary":
            wanted.setdefault(j.get("entry") or escape(w["word"]), []).append(w["word"])
    for entry, words in wanted.items():
        found = verify(entry, words, offensive, options)
        if found.pop("ok"):
            report.accepted.append({"entry": entry, "words": words})
        else:
            report.rejected.append({"entry": entry, "words": words} | found)
    if report.accepted and report.rerun:
        report.after = measure(df, _wider(options, [a["entry"] for a in report.accepted]), text_column)
    return report


def with_verdicts(words: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``words`` (of :func:`.moderate.flagged_words`) with the ``verdict`` of each in a table ``word, verdict``; ``unjudged`` where it has none.

    Of several verdicts of one word the first in the order of :data:`VERDICTS` counts, so that no word is multiplied."""
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    known = verdicts.where(F.col("verdict").isin(*VERDICTS)).groupBy("word").agg(F.min_by("verdict", rank).alias("verdict"))
    return words.join(known, "word", "left").withColumn("verdict", F.coalesce("verdict", F.lit("unjudged")))


def _wider(options: FilterOptions, entries: list[str]) -> FilterOptions:
    return replace(options, allow_list=(*options.allow_list, *entries))


def cleared_words(report: Report) -> list[dict]:
    """``entry, words``: what each accepted entry clears."""
    return [{"entry": a["entry"], "words": sorted(a["words"])} for a in report.accepted]


def snippet(report: Report, code: str = "en") -> str:
    """The accepted entries as code."""
    lines = [f"    {a['entry']!r},  # {', '.join(a['words'])}" for a in report.accepted]
    return "\n".join([f"registry = registry.register({code + '-tuned'!r}, extends={code!r}, allow=(", *lines, "))"])
