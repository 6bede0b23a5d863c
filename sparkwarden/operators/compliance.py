"""Statements of reasons: what was done, why, and on which facts, as columns."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from .ai import AiOptions, complete_json

ACTIONS = ("CONTENT_REMOVED", "CONTENT_DEMOTION", "ACCOUNT_SUSPENSION", "ACCOUNT_TERMINATION", "FEATURE_RESTRICTION")
NO_QUOTE = "[content]"

_REASONS = {
    "en": ("What you posted breaks the community's rules and was taken down.", "What you posted is now shown to fewer people.", "You cannot use your account for the time being.", "Your account has been closed for good.", "Part of what your account can do was switched off."),
    "de": ("Ihr Beitrag verletzt die Regeln der Gemeinschaft und wurde entfernt.", "Ihr Beitrag wird nun weniger Menschen gezeigt.", "Ihr Konto ist vorläufig gesperrt.", "Ihr Konto wurde endgültig geschlossen.", "Einige Möglichkeiten Ihres Kontos wurden abgeschaltet."),
}
_GRADES = {
    "en": {"none": "The case was not graded.", "low": "The language is rough but not directed at a person.", "medium": "The language is plainly insulting, a violation in substance.", "high": "The language is abuse aimed at someone and counts heavily.", "critical": "The language belongs to the gravest kind that is told apart."},
    "de": {"none": "Der Fall wurde nicht gewichtet.", "low": "Die Sprache ist derb, gilt aber niemandem.", "medium": "Die Sprache ist klar beleidigend, ein Verstoß in der Sache.", "high": "Die Sprache ist Beschimpfung einer Person und zählt schwer.", "critical": "Die Sprache gehört zur schwersten unterschiedenen Art."},
}
_PHRASES = {
    "en": {"model": "Categories found: %s. Stated confidence: %s%%.", "unsure": "That confidence is low, so the case counts as doubtful.", "list": "A listed word was found. That says which word was used, not what the sentence means by it.", "contest": "You may object if you read the passage otherwise."},
    "de": {"model": "Erkannte Kategorien: %s. Genannte Sicherheit: %s%%.", "unsure": "Diese Sicherheit ist gering, der Fall gilt als zweifelhaft.", "list": "Ein gelistetes Wort kam vor. Das sagt, welches Wort fiel, nicht, was der Satz damit meint.", "contest": "Sie können widersprechen, wenn Sie die Stelle anders lesen."},
}
_LABELS = {
    "en": dict(action="Action:", reason="Why:", assessment="Assessment:", quote="Passage:", policies="Rules:", categories="Categories:", severity="Severity:", confidence="Confidence:", automated="Found automatically:", human="Reviewed by a person:", date="Date:", duration="Duration:", appeal="Object here:", yes="Yes", no="No"),
    "de": dict(action="Maßnahme:", reason="Warum:", assessment="Einschätzung:", quote="Stelle:", policies="Regeln:", categories="Kategorien:", severity="Schwere:", confidence="Sicherheit:", automated="Automatisch gefunden:", human="Von Menschen geprüft:", date="Datum:", duration="Dauer:", appeal="Widerspruch:", yes="Ja", no="Nein"),
}


def reason_table(spark: SparkSession) -> DataFrame:
    """``language, action, wording``: ten rows."""
    return spark.createDataFrame([(lang, action, text) for lang, texts in _REASONS.items() for action, text in zip(ACTIONS, texts, strict=True)], "language string, action string, wording string")


def _in(language: Column, texts: dict[str, str]) -> Column:
    return F.when(language == "de", texts["de"]).otherwise(texts["en"])


def _phrase(language: Column, key: str) -> Column:
    return _in(language, {lang: texts[key] for lang, texts in _PHRASES.items()})


def justify(results: DataFrame, action: str = "CONTENT_REMOVED", policies: Sequence[str | tuple[str, str]] = ("Community Guidelines",), language: str | None = None, duration: str = "permanent", appeal_url: str | None = None, notes: str | None = None, timestamp: Column | None = None, ai: AiOptions | None = None) -> DataFrame:
    """``results`` (with ``segments``) and a ``justification`` struct.

    The wording is looked up in a table of ten rows by a broadcast join, English where a
    language has none.  With ``ai`` a model is given the facts and may word ``reason`` and ``assessment``; what it leaves
    blank, refuses or fails at stays as it was."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}; known: {', '.join(ACTIONS)}")
    rows = results.withColumn("__lang", F.lit(language) if language else columns.detect_language(F.col("text"))).withColumn("__action", F.lit(action))
    table = reason_table(results.sparkSession)
    own = table.select(F.col("language").alias("__lang"), F.col("action").alias("__action"), F.col("wording").alias("__own"))
    fallback = table.where("language = 'en'").select(F.col("action").alias("__action"), F.col("wording").alias("__fallback"))
    rows = rows.join(F.broadcast(own), ["__lang", "__action"], "left").join(F.broadcast(fallback), "__action", "left")
    lang, ok = F.col("__lang"), F.coalesce(F.col("ai.status") == "ok", F.lit(False))
    severity = F.when(ok, F.col("ai.severity")).otherwise("none")
    categories = F.coalesce("ai.categories", F.array().cast("array<string>"))
    confidence = F.coalesce("ai.confidence", F.lit(0.0))
    grade = F.coalesce(*(F.when((severity == s), _in(lang, {k: v[s] for k, v in _GRADES.items()})) for s in _GRADES["en"]))
    by_model = ok & (F.size(categories) > 0)
    parts = F.array(
        F.when(severity != "none", grade),
        F.when(by_model, F.format_string(_PHRASES["en"]["model"], F.array_join(categories, ", "), F.floor(confidence * 100 + 0.5).cast("string")) if language not in (None, "de") else F.when(lang == "de", F.format_string(_PHRASES["de"]["model"], F.array_join(categories, ", "), F.floor(confidence * 100 + 0.5).cast("string"))).otherwise(F.format_string(_PHRASES["en"]["model"], F.array_join(categories, ", "), F.floor(confidence * 100 + 0.5).cast("string")))),
        F.when(by_model & (confidence > 0) & (confidence < 0.6), _phrase(lang, "unsure")),
        F.when(~by_model & F.col("matched_list"), _phrase(lang, "list")),
        F.when((severity == "none") & ~by_model & ~F.col("matched_list"), _in(lang, {k: v["none"] for k, v in _GRADES.items()})),
        _phrase(lang, "contest"),
    )
    listed = F.array_join(F.transform(F.filter("segments", lambda s: s["is_profane"]), lambda s: s["text"]), ", ")
    quote = F.coalesce(F.nullif("ai.quote", F.lit("")), F.nullif(listed, F.lit("")), F.lit(NO_QUOTE))
    bases = F.array(*(F.struct(F.lit(p if isinstance(p, str) else p[0]).alias("name"), F.lit(None if isinstance(p, str) else p[1]).cast("string").alias("section")) for p in policies))
    facts = F.struct(quote.alias("quote"), categories.alias("categories"), severity.alias("severity"), confidence.alias("confidence"), (ok | F.col("matched_list")).alias("automated_detection"), F.lit(False).alias("human_review"))
    reason, assessment = F.coalesce("__own", "__fallback"), F.concat_ws(" ", F.array_compact(parts))
    if ai is not None and ai.enabled:
        told = F.to_json(F.struct(F.col("__action").alias("action"), lang.alias("language"), severity.alias("severity"), categories.alias("categories"), confidence.alias("confidence"), quote.alias("quote"), bases.alias("policies"), F.lit(duration).alias("duration"), ok.alias("judged")))
        rows = rows.withColumn("__worded", _worded(ai)(told))
        reason, assessment = (F.coalesce(F.when(F.trim(f"__worded.{k}") != "", F.col(f"__worded.{k}")), own) for k, own in (("reason", reason), ("assessment", assessment)))
    made = F.struct(
        F.col("__action").alias("action"), reason.alias("reason"), assessment.alias("assessment"), bases.alias("policy_bases"), facts.alias("facts"),
        (timestamp if timestamp is not None else F.current_timestamp()).alias("timestamp"), F.lit(duration).alias("duration"), lang.alias("language"), F.lit(appeal_url).cast("string").alias("appeal_url"), F.lit(notes).cast("string").alias("additional_notes"),
    )
    return rows.withColumn("justification", made).drop("__lang", "__action", "__own", "__fallback", "__worded")


def _worded(options: AiOptions):
    """What a model makes of the facts, given as JSON: ``struct<reason, assessment>``."""
    own = options.resolved()
    options.check_key()

    @F.arrow_udf("reason string, assessment string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([wording(json.loads(told), own) for told in column.to_pylist()], pa.struct([("reason", pa.string()), ("assessment", pa.string())]))

    return run.asNondeterministic()


def wording(facts: dict, options: AiOptions) -> dict[str, str | None]:
    """``reason`` and ``assessment`` as a model words them; None where it doesn't."""
    system = prompt(facts["action"], facts["severity"], facts["categories"], facts["language"])
    text = "\n".join(
        [
            f"Action: {facts['action']}", f"Categories: {', '.join(facts['categories']) or '(none)'}", f"Severity: {facts['severity']}", f"Confidence: {round(facts['confidence'] * 100)}%",
            f"Rules: {', '.join(' '.join(filter(None, (p['name'], p.get('section')))) for p in facts['policies'])}", f"Passage: {json.dumps(facts['quote'], ensure_ascii=False)}", f"Duration: {facts['duration']}",
            "Found by: a model that read the sentence" if facts["judged"] else "Found by: a word list alone; nobody judged the sentence",
        ]
    )
    answer = complete_json("\n".join(filter(None, (system, options.extra))), text, wording_schema(), replace(options, on_error="return"))
    try:
        said = json.loads(answer["json"]) if answer else {}
    except ValueError:
        said = {}
    return {k: said[k] if isinstance(said, dict) and isinstance(said.get(k), str) else None for k in ("reason", "assessment")}


def as_json(justification: str | Column = "justification") -> Column:
    return F.to_json(justification, {"pretty": "true"})


def as_text(name: str = "justification") -> Column:
    """Labelled lines; those with nothing to say are left out.  Dates are ISO, in the session's time zone."""
    at = lambda path: F.col(f"{name}.{path}")
    label = lambda key: _in(at("language"), {lang: texts[key] for lang, texts in _LABELS.items()})
    line = lambda key, value: F.concat(label(key), F.lit(" "), value)
    yes = lambda c: F.when(c, label("yes")).otherwise(label("no"))
    named = F.array_join(F.transform(at("policy_bases"), lambda p: F.concat_ws(" ", p["name"], p["section"])), ", ")
    lines = F.array(
        line("action", at("action")),
        line("reason", at("reason")),
        F.when(at("assessment") != "", line("assessment", at("assessment"))),
        F.when(at("facts.quote") != NO_QUOTE, line("quote", F.concat(F.lit('"'), F.regexp_replace(at("facts.quote"), r'(["\\])', r"\\$1"), F.lit('"')))),
        line("policies", named),
        F.when(F.size(at("facts.categories")) > 0, line("categories", F.array_join(at("facts.categories"), ", "))),
        F.when(at("facts.severity") != "none", line("severity", at("facts.severity"))),
        F.when(at("facts.confidence") > 0, line("confidence", F.concat(F.floor(at("facts.confidence") * 100 + 0.5).cast("string"), F.lit("%")))),
        line("automated", yes(at("facts.automated_detection"))),
        line("human", yes(at("facts.human_review"))),
        line("date", F.date_format(at("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")),
        line("duration", at("duration")),
        F.when(at("appeal_url").isNotNull(), line("appeal", at("appeal_url"))),
        F.when(at("additional_notes").isNotNull(), F.concat(F.lit("\n"), at("additional_notes"))),
    )
    return F.concat_ws("\n", F.array_compact(lines))


def prompt(action: str, severity: str, categories: Sequence[str], language: str) -> str:
    """For a model that may word a notice: it gets the facts and writes ``reason`` and ``assessment`` only."""
    return "\n".join([f"Write in the language with code {language}.", "The facts below are settled; don't add to them or weigh them anew.", f"Action: {action}. Severity: {severity}. Categories: {', '.join(categories) or '(none)'}.", "Give JSON with the strings reason and assessment."])


def wording_schema() -> dict:
    return {"type": "object", "properties": {"reason": {"type": "string"}, "assessment": {"type": "string"}}, "required": ["reason", "assessment"], "additionalProperties": False}
