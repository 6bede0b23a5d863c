"""Text functions as Spark columns.

Texts go to the kernel in Arrow batches; regular expressions of Java as a gate before it were measured to cost more
than they save.  Flagging and personal data share one Arrow evaluation (:func:`analysis`), which
returns no more than is asked for.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import checksums, kernel, patterns, pii
from .pii import PiiOptions
from .registry import FilterOptions

SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("is_profane", T.BooleanType())]))
HITS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("hit", T.StringType())]))
FINDINGS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("confidence", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.StringType()))])
)
ERROR = T.StructType([T.StructField("stage", T.StringType()), T.StructField("message", T.StringType())])
ANALYSIS = T.StructType([T.StructField("flagged", T.BooleanType()), T.StructField("segments", SEGMENTS), T.StructField("hits", HITS), T.StructField("pii", FINDINGS), T.StructField("error", ERROR)])

_A_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("is_profane", pa.bool_())]))
_A_HITS = pa.list_(pa.struct([("word", pa.string()), ("hit", pa.string())]))
_A_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("evidence", pa.list_(pa.string()))]))
_A_ANALYSIS = pa.struct([("flagged", pa.bool_()), ("segments", _A_SEGMENTS), ("hits", _A_HITS), ("pii", _A_FINDINGS), ("error", pa.struct([("stage", pa.string()), ("message", pa.string())]))])

#: Rows go to a worker in batches of about this many bytes.
BATCH_BYTES = 4 << 20


def batched(spark: SparkSession) -> None:
    """Sets batches of ``BATCH_BYTES`` for this session, unless it has a bound of its own.

    A worker holds a batch as Arrow and as strings at once; Spark's bounds are 10,000 rows and 64 MB."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _segment_rows(pieces) -> list[dict]:
    return [{"text": t, "is_profane": bad} for t, bad in pieces]


def _finding_rows(text: str, found) -> list[dict]:
    """Offsets in UTF-16 units."""
    at = kernel.utf16_offsets(text, [x for f in found for x in (f.start, f.end)])
    return [{"kind": f.kind, "text": f.text, "start": at[2 * i], "end": at[2 * i + 1], "confidence": f.confidence, "evidence": list(f.evidence)} for i, f in enumerate(found)]


def _analysed(text: str, options: FilterOptions | None, pii_options: PiiOptions | None, segments: bool, words: bool) -> dict | None:
    """One row, None if nothing is found; an error in one stage leaves the other's result, and the first is told."""
    out: dict = {}
    if options:
        try:
            if spans := kernel.hits(text, options):
                out["flagged"] = True
                if segments:
                    out["segments"] = _segment_rows(kernel.segments_of(text, spans))
                if words:
                    out["hits"] = [{"word": kernel.enclosing_word(text, a, b).lower(), "hit": text[a:b].lower()} for a, b in spans]
        except Exception as why:  # isolated per record
            out["error"] = {"stage": "filter", "message": str(why)}
    if pii_options:
        try:
            if found := pii.detect(text, pii_options):
                out["pii"] = _finding_rows(text, found)
        except Exception as why:
            out.setdefault("error", {"stage": "pii", "message": str(why)})
    return out or None


def analysis(text: Column, options: FilterOptions | None = None, pii_options: PiiOptions | None = None, segments: bool = True, words: bool = True) -> Column:
    """``struct<flagged, segments, hits, pii, error>``, null for rows in which nothing is found."""
    if options:
        options.resolved()
    if pii_options:
        pii_options.selected()

    @F.arrow_udf(ANALYSIS)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _analysed(t, options, pii_options, segments, words) for t in column.to_pylist()], _A_ANALYSIS)

    text = text.cast("string")
    return run.asNondeterministic()(text if options else F.when(may_hold_pii(text), text))


def may_match(text: Column, stems: tuple[str, ...]) -> Column:
    """True wherever a literal stem is found, and seldom else."""
    finder = patterns.finder(stems, False)
    if finder is None:
        return text.rlike(patterns.java_source(stems, False))

    @F.arrow_udf(T.BooleanType())
    def run(column: pa.Array) -> pa.Array:
        low = pc.utf8_lower(column).to_pylist()
        return pa.array([None if t is None else next(finder.automaton.iter(t.replace("ſ", "s")), None) is not None or not t.isascii() and any(c in t for c in "\u0307ı") for t in low], pa.bool_())

    return run(text)


def may_hold_pii(text: Column) -> Column:
    return text.rlike("[@:0-9]")


def clean_segments(text: Column) -> Column:
    return F.array(F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(False).alias("is_profane")))


def profane_segments(text: Column, options: FilterOptions = FilterOptions()) -> Column:
    """Lossless pieces of the text, each flagged or not; null text is one clean empty piece."""
    return F.coalesce(analysis(text, options, words=False)["segments"], clean_segments(text.cast("string")))


def profane_hits(text: Column, options: FilterOptions = FilterOptions()) -> Column:
    """``array<struct<word, hit>>`` in lower case."""
    return F.coalesce(analysis(text, options, segments=False)["hits"], F.array().cast(HITS))


def is_profane(text: Column, options: FilterOptions = FilterOptions()) -> Column:
    """False for null."""
    options.resolved()

    @F.arrow_udf(T.BooleanType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([t is not None and kernel.is_profane(t, options) for t in column.to_pylist()], pa.bool_())

    return run(text.cast("string"))


def words_with_hits(text: Column, options: FilterOptions) -> Column:
    """For plain, literal stems: the words that hold a hit and aren't allowed.

    A hit of such a stem lies within one word, so words can be judged one by one, without Python."""
    lists = options.resolved()
    block = patterns.java_source(lists.block, False)
    words = F.filter(F.regexp_extract_all(text, F.lit(rf"({patterns.WORD}+)"), 1), lambda w: w.rlike(block))
    if lists.allow:
        allow = patterns.java_source(lists.allow, False, True)
        words = F.filter(words, lambda w: ~w.rlike(allow))
    return F.when(may_match(text, lists.block), words).otherwise(F.array().cast("array<string>"))


def mask_profane(text: Column, options: FilterOptions = FilterOptions(), sign: str = "*") -> Column:
    """Flagged pieces give way to as many signs as they have UTF-16 units."""

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else kernel.mask(t, options, sign) for t in column.to_pylist()], pa.string())

    text = text.cast("string")
    return run(text)


def highlighted(text: Column, options: FilterOptions = FilterOptions(), tag: str = "mark") -> Column:
    """The text as HTML, flagged pieces within ``tag``: what notebooks and pages show.  Null stays null."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    piece = lambda s: F.when(s["is_profane"], F.concat(F.lit(f"<{tag}>"), escape(s["text"]), F.lit(f"</{tag}>"))).otherwise(escape(s["text"]))
    return F.when(text.isNotNull(), F.array_join(F.transform(profane_segments(text, options), piece), ""))


def pii_findings(text: Column, options: PiiOptions = PiiOptions()) -> Column:
    return F.coalesce(analysis(text, None, options)["pii"], F.array().cast(FINDINGS))


def has_pii(text: Column, options: PiiOptions = PiiOptions()) -> Column:
    return F.size(pii_findings(text, options)) > 0


def pii_segments(text: Column, options: PiiOptions = PiiOptions()) -> Column:
    """``array<struct<text, is_pii, kind>>``; null and empty text have none."""
    kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("is_pii", T.BooleanType()), T.StructField("kind", T.StringType())]))
    arrow = pa.list_(pa.struct([("text", pa.string()), ("is_pii", pa.bool_()), ("kind", pa.string())]))

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        rows = [None if t is None else [{"text": x, "is_pii": p, "kind": k} for x, p, k in pii.pii_segments(t, pii.detect(t, options))] for t in column.to_pylist()]
        return pa.array(rows, arrow)

    text = text.cast("string")
    whole = F.when(text != "", F.array(F.struct(text.alias("text"), F.lit(False).alias("is_pii"), F.lit(None).cast("string").alias("kind")))).otherwise(F.array().cast(kind))
    return F.coalesce(run(F.when(may_hold_pii(text), text)), whole)


def detect_language(text: Column) -> Column:
    """``de`` if more than 15 in 100 words are German function words, else ``en``.  A leading blank counts as a word.

    Both cases of ü are spelled out: Java folds ASCII alone, or else the dotless i and the long s with it."""
    found = F.regexp_count(text, F.lit(r"(?i)(?<![A-Za-z0-9_])(?:auch|das|der|die|ein|f[üÜ]r|in|ist|mit|nicht|sich|und|von|zu)(?![A-Za-z0-9_])"))
    return F.when(found / F.size(F.split(text, rf"[{patterns.JS_SPACE}]+")) > 0.15, "de").otherwise("en")


def excerpt(text: Column, most: int = 72) -> Column:
    flat = F.trim(F.regexp_replace(text, rf"[{patterns.JS_SPACE}]+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))


def register_sql(spark: SparkSession, options: FilterOptions = FilterOptions(), pii_options: PiiOptions = PiiOptions()) -> None:
    """``is_profane``, ``mask_profane``, ``has_pii`` ... for SQL, and ``profane_hits`` and ``pii_hits`` for LATERAL."""

    def scalar(kind, one):
        return F.arrow_udf(lambda column: pa.array([one(t) for t in column.to_pylist()], T_TO_ARROW[kind]), kind)

    boolean, string = T.BooleanType(), T.StringType()
    T_TO_ARROW = {boolean: pa.bool_(), string: pa.string()}
    spark.udf.register("is_profane", scalar(boolean, lambda t: kernel.is_profane(t, options)))
    spark.udf.register("mask_profane", scalar(string, lambda t: None if t is None else kernel.mask(t, options)))
    spark.udf.register("has_pii", scalar(boolean, lambda t: bool(pii.detect(t, pii_options))))
    spark.udf.register("is_valid_luhn", scalar(boolean, lambda t: t is not None and checksums.is_luhn(t)))
    spark.udf.register("is_valid_iban", scalar(boolean, lambda t: t is not None and checksums.is_iban(t)))
    spark.udf.register("is_valid_tax_id", scalar(boolean, lambda t: t is not None and checksums.is_german_tax_id(t)))

    class ProfaneHits:
        def eval(self, text: str):
            yield from kernel.flagged_words(text or "", options)

    class PiiHits:
        def eval(self, text: str):
            for row in _finding_rows(text or "", pii.detect(text, pii_options)):
                yield row["kind"], row["text"], row["start"], row["end"], row["confidence"]

    spark.udtf.register("profane_hits", F.udtf(ProfaneHits, returnType="word string, hit string"))
    spark.udtf.register("pii_hits", F.udtf(PiiHits, returnType="kind string, text string, start int, end int, confidence double"))
