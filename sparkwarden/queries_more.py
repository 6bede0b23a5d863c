"""Further queries over whole tables, each with SQL that computes the same anew."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import streaming
from .functions import columns, patterns, pii
from .functions.pii import PiiOptions
from .functions.registry import DEFAULT, FilterOptions
from .operators import adversarial, ai, allowlist, compliance
from .operators import moderate as M
from .queries import _GUESS, _LUHN, BOTH, LITERAL, _quoted, _sql_words, _t
from .sources import readers, sinks


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; on one machine, of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sparkwarden-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- lists and registry --------------------------------------------------------------


def _regional():
    return DEFAULT.register("de-AT", block=("trottl",), allow=("trottoir",), extends="de").register("de-AT-wien", block=("beidl",), extends="de-at").register("en-GB", extends="en")


def registry_lists(spark: SparkSession, sf: str) -> DataFrame:
    """How many stems are in force for each code asked for: ancestors' with one's own, the nearest known code for an unknown one."""
    own = _regional()
    rows = []
    for code in CODES:
        lists = own.lists(code)
        rows.append((code, own.resolve(code), len(lists.block) if lists else None, len(lists.allow) if lists else None))
    return spark.createDataFrame(rows, "asked string, code string, block int, allow int")


CODES = ("en", "EN-us", "en-GB-oxendict", "de", "de-at", "de-AT-wien-x", "de-CH", "fr", "")
_BUILT_IN = ", ".join(f"('{lang}', '{kind}')" for lang, x in patterns.builtin_lists().items() for kind, stems in x.items() for _ in stems)
_REGISTRY_SQL = f"""
WITH RECURSIVE known(code, parent) AS (VALUES ('en', NULL), ('de', NULL), ('de-at', 'de'), ('de-at-wien', 'de-at'), ('en-gb', 'en')),
stems(code, kind) AS (VALUES {_BUILT_IN}, ('de-at', 'block'), ('de-at', 'allow'), ('de-at-wien', 'block')),
line(code, here) AS (SELECT code, code FROM known UNION ALL SELECT line.code, known.parent FROM line JOIN known ON known.code = line.here WHERE known.parent IS NOT NULL),
counts AS (SELECT line.code, count(*) FILTER (kind = 'block')::INT AS block, count(*) FILTER (kind = 'allow')::INT AS allow FROM line JOIN stems ON stems.code = line.here GROUP BY line.code),
asked(asked) AS (VALUES {", ".join(f"('{c}')" for c in CODES)}),
best AS (SELECT asked, arg_max(code, length(code)) AS code FROM asked JOIN known ON lower(asked) = code OR starts_with(lower(asked), code || '-') GROUP BY asked)
SELECT asked.asked, best.code, block, allow FROM asked LEFT JOIN best ON best.asked = asked.asked LEFT JOIN counts ON counts.code = best.code
"""


# --- sources and sinks -----------------------------------------------------------------


def ndjson_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as NDJSON and read again."""
    path = _scratch(spark, "documents") + ".ndjson"
    sinks.write_ndjson(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), path)
    return readers.records(spark, path)


def line_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written one a line end, read line by line: how often each line occurs."""
    path = _scratch(spark, "lines")
    _t(spark, sf, "documents").select("text").write.option("lineSep", "\r\n").text(path)
    return readers.records(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("lines"))


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with quotes, delimiters and line ends in quoted fields, read as records."""
    path = _scratch(spark, "documents") + ".csv"
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.concat(F.lit('say "'), "text", F.lit('", then'))
    _t(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(","), quoted(text)).alias("value")).write.text(path)
    return readers.records(spark, path, column=1, id_column=0, header=False)


def skipped_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Why lines of NDJSON are skipped, and how often."""
    path = _scratch(spark, "bad") + ".ndjson"
    n = F.col("doc_id") % 6
    line = F.when(n == 0, F.concat(F.lit("{"), "doc_id")).when(n == 1, F.to_json(F.struct("doc_id"))).when(n == 2, F.lit('"bare"')).when(n == 3, F.lit("[1, 2]")).when(n == 4, F.lit("  ")).otherwise(F.to_json(F.struct("text")))
    _t(spark, sf, "documents").select(line.alias("value")).write.text(path)
    return readers.skip_counts(readers.ndjson_lines(spark, path))


def flagged_output(spark: SparkSession, sf: str) -> DataFrame:
    """What is told of flagged records, without their texts."""
    results = M.moderate(_t(spark, sf, "documents"), M.ModerateOptions(filter=BOTH), id_column="doc_id", index_column="doc_id")
    out = sinks.flagged_output(results)
    assert "text" not in out.columns
    return out.select("id", "flagged", "matched_list", F.size("pii").alias("findings"))


def stored_notices(spark: SparkSession, sf: str) -> DataFrame:
    """A keyed store after an insert and an update: of each key the latest version."""
    path = _scratch(spark, "store")
    rows = _t(spark, sf, "documents").select((F.col("doc_id") % 97).alias("k"), F.col("doc_id").alias("version"), "n_chars")
    sinks.upsert(spark, path, rows.where("doc_id % 2 = 0"), "k", "version")
    sinks.upsert(spark, path, rows.where("doc_id % 2 = 1"), "k", "version")
    return sinks.listed(spark, path)


def dense_index(spark: SparkSession, sf: str) -> DataFrame:
    return M.indexed(_t(spark, sf, "documents").select("doc_id"), ["doc_id"])


def streamed_flags(spark: SparkSession, sf: str) -> DataFrame:
    """A stream over the documents' file or folder of files, flagged batch by batch into a sink that is read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    source = spark.readStream.schema(_t(spark, sf, "documents").schema)
    # A stream reads folders only; a file is what a filter leaves of the one it lies in.
    single = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    source = source.option("pathGlobFilter", "documents.parquet").parquet(sf) if single else source.parquet(f"{sf}/documents.parquet")
    out = _scratch(spark, "flags")
    streaming.stream(source, out, out + "-checkpoint", M.ModerateOptions(filter=BOTH), id_column="doc_id").awaitTermination()
    return spark.read.parquet(out).select(F.col("id").cast("long").alias("doc_id"), "flagged", "matched_list")


# --- flagging -----------------------------------------------------------------------------


def literal_segments(spark: SparkSession, sf: str) -> DataFrame:
    """How many pieces of each document are flagged, how long they are together, and what the pieces joined come to."""
    pieces = _t(spark, sf, "documents").select("doc_id", columns.profane_segments(F.col("text"), LITERAL).alias("s"))
    bad = F.filter("s", lambda x: x["is_profane"])
    return pieces.select("doc_id", F.size(bad).cast("long").alias("pieces"), F.length(F.array_join(F.transform(bad, lambda x: x["text"]), "")).cast("long").alias("chars"), F.md5(F.array_join(F.transform("s", lambda x: x["text"]), "")).alias("joined"))


def literal_words(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged words with their hits, counts and first samples."""
    words = M.flagged_words(_t(spark, sf, "documents"), LITERAL, index_column="doc_id")
    return words.select("word", F.array_join("hits", ",").alias("hits"), F.col("count").alias("documents"), F.transform("samples", lambda t: F.md5(t)).alias("s")).select("word", "hits", "documents", F.array_join("s", ",").alias("samples"))


def frequent_words(spark: SparkSession, sf: str) -> DataFrame:
    """Only words that are flagged in two documents at least."""
    return M.flagged_words(_t(spark, sf, "documents"), LITERAL, index_column="doc_id", min_count=2).select("word", F.col("count").alias("documents"))


def disguised_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Look-alikes and all, over the documents in which nothing has to be undone first: ASCII, no letter thrice in a row, no spaced letters."""
    docs = _t(spark, sf, "documents").where(~F.col("text").rlike(r"[^\x00-\x7F]") & ~F.col("text").rlike(r"(.)\1\1") & ~F.col("text").rlike(_SPACED))
    found = F.array_distinct(F.transform(columns.profane_hits(F.col("text"), FilterOptions()), lambda h: h["word"]))
    return docs.select("doc_id", F.array_join(F.array_sort(found), ",").alias("words"))


_SPACED = r"(?:^|[^A-Za-z])[A-Za-z][\s._*+~|-]+[A-Za-z][\s._*+~|-]+[A-Za-z](?:[^A-Za-z]|$)"


def folded_text(spark: SparkSession, sf: str) -> DataFrame:
    """Documents disguised by marks, invisible signs and full width, and flagged as what they are."""
    stem = F.lit("bitch")
    disguise = F.element_at(F.array(F.lit("b\u200bitch"), F.lit("ｂｉｔｃｈ"), F.lit("b i t c h"), F.lit("b\u0336itch"), F.lit("biiiitch"), F.lit("b!tch"), F.lit("birch")), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("so a "), disguise, F.lit(". "), F.lit("ok")).alias("text"), F.concat(F.lit("so a "), stem, F.lit(". ok")).alias("plain"))
    own = FilterOptions(custom_list=("bitch",))
    return rows.select("doc_id", columns.is_profane(F.col("text"), own).alias("flagged"), F.length(columns.mask_profane(F.col("text"), own)).cast("long").alias("chars"), columns.mask_profane(F.col("plain"), own).alias("plain"))


def highlighted_text(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as HTML with listed words marked."""
    own = FilterOptions(custom_list=("the",), cross_check=False, aggressive=False)
    return _t(spark, sf, "documents").select("doc_id", F.md5(columns.highlighted(F.col("text"), own)).alias("html"))


def judged_words(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged words by what a table of verdicts says of them."""
    verdicts = spark.createDataFrame([("scum", "ordinary"), ("whores", "offensive"), ("whorer", "unsure"), ("whorer", "offensive"), ("other", "ordinary"), ("whored", "nonsense")], "word string, verdict string")
    words = M.flagged_words(_t(spark, sf, "documents"), LITERAL, index_column="doc_id")
    return allowlist.with_verdicts(words, verdicts).groupBy("verdict").agg(F.count(F.lit(1)).alias("words"), F.sum("count").alias("documents"))


def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The functions and table functions as SQL sees them."""
    columns.register_sql(spark, LITERAL)
    _t(spark, sf, "documents").createOrReplaceTempView("sparkwarden_documents")
    return spark.sql("SELECT hit, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM sparkwarden_documents, LATERAL profane_hits(text) WHERE is_profane(text) GROUP BY hit")


def asked_within_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Which flagged documents a model is asked about if it may be asked 25 times."""
    answer = json.dumps({"flagged": True, "severity": "low", "categories": ["insult"], "confidence": 0.5, "reason": "r", "quote": "q"})
    options = M.ModerateOptions(filter=LITERAL, ai=ai.AiOptions(lambda request: {"json": answer, "model": "stub"}), gate="matched", max_calls=25)
    rows = M.moderate(_t(spark, sf, "documents"), options, index_column="doc_id")
    return rows.where("matched_list").select(F.col("index").alias("doc_id"), F.col("ai.status").alias("status"), F.coalesce("ai.reason", F.lit("")).alias("reason"))


def parsed_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Stored answers of a model, parsed strictly: unknown categories go, confidence is clamped."""
    n = F.col("doc_id")
    answer = F.to_json(F.struct((n % 3 == 0).alias("flagged"), F.element_at(F.array(*map(F.lit, ("none", "low", "grave", "high"))), (n % 4 + 1).cast("int")).alias("severity"), F.array(F.lit("insult"), F.concat(F.lit("c"), n % 2)).alias("categories"), ((n % 7 - 2) / 4).alias("confidence"), F.left("text", F.lit(5)).alias("reason")))
    v = ai.parse_verdict_column(answer)
    return _t(spark, sf, "documents").select("doc_id", v["flagged"].alias("flagged"), v["severity"].alias("severity"), F.array_join(v["categories"], ",").alias("categories"), F.round(v["confidence"], 6).alias("confidence"), v["reason"].alias("reason"), v["quote"].alias("quote"))


def literal_notices(spark: SparkSession, sf: str) -> DataFrame:
    """The whole notice of each document that a listed word was found in."""
    results = M.moderate(_t(spark, sf, "documents"), M.ModerateOptions(filter=BOTH, segments=True), index_column="doc_id").where("matched_list")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    made = compliance.justify(results, policies=["Rules"], timestamp=at)
    return made.select(F.col("index").alias("doc_id"), "justification.language", "justification.assessment", "justification.facts.quote", F.regexp_replace(compliance.as_text(), r"2026-01-01T00:00:00\S*", "(date)").alias("notice"))


# --- personal data -----------------------------------------------------------------------


def card_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return _kind(spark, sf, "card")


def phone_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return _kind(spark, sf, "phone")


def ip_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return _kind(spark, sf, "ip")


def _kind(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """In how many places of each document a kind of personal data is found."""
    found = _t(spark, sf, "documents").select("doc_id", columns.pii_findings(F.col("text"), PiiOptions((kind,))).alias("p"))
    return found.where(F.size("p") > 0).select("doc_id", F.size("p").cast("long").alias("findings"), F.array_join(F.transform("p", lambda p: p["text"]), "|").alias("texts"))


def made_up_data(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences made of order keys, a sixth each: IBANs, tax numbers, phones, IPv6 addresses, cards of no issuer and version numbers, about half of them wrong."""
    k = F.col("o_orderkey")
    d = F.lpad((k * 7919).cast("string"), 18, "0")
    odd = F.floor(k / 6) % 2 == 1
    check = 98 - (F.concat(d, F.lit("131400")).cast("decimal(24,0)") % 97).cast("int")
    iban = F.concat(F.lit("pay to DE"), F.lpad(F.when(odd, (check + 1) % 100).otherwise(check).cast("string"), 2, "0"), d, F.lit(" now"))
    tax = F.concat(F.lit("Steuer-ID "), (k * 7919 + 10_000_000_000).cast("string"), F.lit(" bitte"))
    phone = F.concat(F.lit("see 0"), F.substr(F.reverse(d), F.lit(1), (5 + F.floor(k / 6) % 13).cast("int")), F.lit(" soon"))
    six = F.concat(F.lit("at 2001:db8:"), F.lower(F.hex(k)), F.when(odd, ":::").otherwise("::"), F.lower(F.hex(k % 65536)), F.lit(" it is"))
    card = F.concat(F.when(odd, "the code 9").otherwise("the card 9"), F.left(F.reverse(d), F.lit(14)), (F.floor(k / 12) % 10).cast("string"), F.lit("."))
    four = F.concat(F.when(odd, "version 1.2.3.").otherwise("from 1.2.3."), (k % 300).cast("string"), F.lit(" on"))
    text = F.element_at(F.array(iban, tax, phone, six, card, four), (k % 6 + 1).cast("int"))
    found = columns.pii_findings(text)
    rows = _t(spark, sf, "orders").select("o_orderkey", text.alias("text"), found.alias("p"))
    return rows.select("o_orderkey", F.array_join(F.transform("p", lambda p: p["kind"]), ",").alias("kinds"), F.array_join(F.transform("p", lambda p: p["text"]), "|").alias("texts"))


def private_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of each document that are an email or not, and what they come to."""
    own = PiiOptions(("email",))
    rows = _t(spark, sf, "documents").select("doc_id", columns.has_pii(F.col("text"), own).alias("private"), columns.pii_segments(F.col("text"), own).alias("s"))
    return rows.select("doc_id", "private", F.size(F.filter("s", lambda x: x["is_pii"])).cast("long").alias("emails"), F.md5(F.array_join(F.transform("s", lambda x: x["text"]), "")).alias("joined"), F.array_join(F.transform(F.filter("s", lambda x: x["is_pii"]), lambda x: x["text"]), "|").alias("texts"))


def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of a run with literal lists and personal data."""
    results = M.moderate(_t(spark, sf, "documents"), M.ModerateOptions(filter=BOTH, pii=PiiOptions()), index_column="doc_id")
    kinds = lambda k: F.coalesce(F.element_at("pii_by_kind", k), F.lit(0)).alias(k)
    return M.summarize(results).select("processed", "flagged", "matched_list", "pii_records", "pii_findings", "errors", *map(kinds, ("email", "card", "phone", "ip")))


# --- tuning and the benchmark --------------------------------------------------------------

_TUNED = {"scum": "ordinary", "whorer": "ordinary", "whores": "offensive"}
_ENTRIES = [{"word": "whoren", "verdict": "ordinary", "entry": r"whore\p{L}*"}, {"word": "whored", "verdict": "unsure"}, {"word": "thwhorea", "verdict": "ordinary", "entry": r"\p{L}hwhorea"}, {"word": "onwhorea", "verdict": "ordinary", "entry": "("}, {"word": "erwhorer", "verdict": "ordinary", "entry": "zzz"}]


def tuning_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A whole tuning run: verdicts by hand and by a model, entries accepted and rejected, and what the accepted ones change."""
    report = allowlist.tune(_t(spark, sf, "documents"), LITERAL, _TUNED, lambda request: {"json": json.dumps({"words": _ENTRIES})})
    rows = [("accepted", a["entry"], ",".join(a["words"]), None) for a in allowlist.cleared_words(report)] + [("rejected", r["entry"], ",".join(r["words"]), r["reason"]) for r in report.rejected]
    rows += [("before", str(report.before["flagged_records"]), str(report.before["scanned"]), None), ("after", str(report.after["flagged_records"]), str(report.after["scanned"]), None), ("unjudged", str(len(report.unjudged)), None, None)]
    return spark.createDataFrame(rows, "what string, entry string, words string, reason string")


CANDIDATES = (("scum", "scum"), (r"\p{L}*cum", "scum"), ("whores", "whores"), (r"whore\p{L}*", "whorer"), ("other", "scum"), ("sc?um", "scum"))


def entry_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an allow entry does what it is for and lets none of the offensive words through."""
    rows = [(e, w, found["ok"], found.get("reason"), found.get("word")) for e, w in CANDIDATES for found in [allowlist.verify(e, [w], ["whores", "bitch"], LITERAL)]]
    return spark.createDataFrame(rows, "entry string, word string, ok boolean, reason string, offensive string")


def attack_scores_literal(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus of disguises against literal lists: in all and by category."""
    literal = lambda text: columns.is_profane(text, BOTH)
    return adversarial.by_category(adversarial.evaluate(adversarial.attacks(spark), literal))


def attack_selection(spark: SparkSession, sf: str) -> DataFrame:
    return adversarial.attacks(spark, ["de"], ["leet", "false-positive"]).groupBy("category", "expect").agg(F.count(F.lit(1)).alias("attacks"))


QUERIES = {
    f.__name__: f
    for f in (
        registry_lists, ndjson_round_trip, line_round_trip, csv_round_trip, skipped_lines, flagged_output, stored_notices, dense_index, streamed_flags, literal_segments, literal_words, frequent_words, highlighted_text, judged_words, disguised_flags, folded_text, sql_functions, asked_within_budget,
        parsed_verdicts, literal_notices, card_shapes, phone_shapes, ip_shapes, made_up_data, private_pieces, run_totals, tuning_runs, entry_checks, attack_scores_literal, attack_selection,
    )
}

# --- SQL --------------------------------------------------------------------------------------

_BLOCK = {k: _quoted("|".join(o.resolved().block)) for k, o in (("en", LITERAL),)}
_HITS = f"flatten(list_transform({_sql_words('text', LITERAL)}, lambda w: regexp_extract_all(w, '(?i){_BLOCK['en']}')))"
_FLAGGED = f"len({_sql_words('text', LITERAL)}) > 0"
_FLAGGED_BOTH = f"len({_sql_words('text', BOTH)}) > 0"
_WORDS = f"SELECT doc_id, text, unnest(list_distinct(list_transform({_sql_words('text', LITERAL)}, lambda w: lower(w)))) AS word FROM documents"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPS = rf"list_filter(list_transform(regexp_extract_all(text, '(?:^|[^0-9A-Za-z.])({_OCTET}(?:\.{_OCTET}){{3}})(?:\.?$|\.[^0-9]|[^0-9A-Za-z.])'), lambda m: regexp_extract(m, '{_OCTET}(?:\.{_OCTET}){{3}}')), lambda m: m <> '')"
_PHONES = r"regexp_extract_all(text, '\+[1-9][0-9]{0,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}')"
_BRANDED = re.sub(r"\(\?x\)|\s+", "", pii._BRANDS.pattern)
# Numbers that stand close together are one.
_CARDS = f"list_filter(regexp_extract_all(text, '[0-9]+(?:[ ./()\u00a0\u202f\u2011-]{{1,2}}[0-9]+)*'), lambda m: list_contains(list_transform([regexp_replace(m, '[^0-9]', '', 'g')], lambda d: regexp_full_match(d, '{_BRANDED}') AND {_LUHN}), true))"
_EMAILS = r"regexp_extract_all(text, '[\p{L}\p{N}._%+\-!#$&''*/=?^`{|}~]+@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,24}')"
_KIND_SQL = lambda found: f"SELECT doc_id, len(f)::BIGINT AS findings, array_to_string(f, '|') AS texts FROM (SELECT doc_id, {found} AS f FROM documents) WHERE len(f) > 0"
_REASON = {lang: _quoted(compliance._REASONS[lang][0]) for lang in ("en", "de")}
_PH, _LB = compliance._PHRASES, compliance._LABELS


def _notice_sql() -> str:
    texts = {}
    for lang in ("en", "de"):
        label = {k: _quoted(v) for k, v in _LB[lang].items()}
        assessment = _quoted(_PH[lang]["list"] + " " + _PH[lang]["contest"])
        lines = [f"'{label['action']} CONTENT_REMOVED'", f"'{label['reason']} {_REASON[lang]}'", f"'{label['assessment']} {assessment}'", f"'{label['quote']} \"' || quote || '\"'", f"'{label['policies']} Rules'", f"'{label['automated']} {label['yes']}'", f"'{label['human']} {label['no']}'", f"'{label['date']} (date)'", f"'{label['duration']} permanent'"]
        texts[lang] = (f"'{assessment}'", " || chr(10) || ".join(lines))
    en_block = "|".join(LITERAL.resolved().block)
    head, tail = patterns.whole_word("\0").split("\0")
    whole = [s.removeprefix(head).removesuffix(tail) for s in FilterOptions(languages=("de",)).resolved().block if s.startswith(head)]
    part = [s for s in FilterOptions(languages=("de",)).resolved().block if not s.startswith(head)]
    # Stems in list order; whole words only where they are the word.
    parts = _quoted("|".join([en_block, *part]))
    hits = f"flatten(list_transform({_sql_words('text', BOTH)}, lambda w: CASE WHEN regexp_full_match(w, '(?i)(?:{'|'.join(whole)})') THEN [w] ELSE regexp_extract_all(w, '(?i){parts}') END))"
    return f"SELECT doc_id, language, CASE language WHEN 'de' THEN {texts['de'][0]} ELSE {texts['en'][0]} END AS assessment, quote, CASE language WHEN 'de' THEN {texts['de'][1]} ELSE {texts['en'][1]} END AS notice FROM (SELECT doc_id, {_GUESS} AS language, array_to_string({hits}, ', ') AS quote FROM documents WHERE {_FLAGGED_BOTH})"


def _corpus_values() -> str:
    import csv
    from importlib.resources import files

    rows = csv.DictReader(files("sparkwarden.resources").joinpath("attacks.csv").read_text(encoding="utf-8").splitlines())
    return ", ".join("('{category}', '{language}', '{expect}', '{text}')".format(**{k: _quoted(v) for k, v in r.items()}) for r in rows)


_CORPUS = f"(VALUES {_corpus_values()}) AS t(category, language, expect, text)"
_ACCEPTED = ("scum", "whorer", r"\p{L}hwhorea")


def _tuned_sql() -> str:
    wider = FilterOptions(languages=("en",), aggressive=False, allow_list=_ACCEPTED)
    judged = [*_TUNED, *(e["word"] for e in _ENTRIES)]
    in_list = lambda words: ", ".join(f"'{w}'" for w in words)
    return f"""
WITH d AS (SELECT ({_FLAGGED})::INT AS b, (len({_sql_words('text', wider)}) > 0)::INT AS a FROM documents),
top AS (SELECT word FROM ({_WORDS}) GROUP BY word ORDER BY count(*) DESC, word LIMIT 50),
wanted(word, entry) AS (VALUES ('scum', 'scum'), ('whorer', 'whorer'), {", ".join(f"('{e['word']}', '{_quoted(e['entry'])}')" for e in _ENTRIES if e['verdict'] == 'ordinary')}),
checked AS (SELECT entry, word, CASE WHEN entry = '(' THEN 'invalid' WHEN NOT regexp_full_match(word, CASE WHEN entry = '(' THEN 'x' ELSE entry END) THEN 'no-effect' WHEN regexp_full_match('whores', CASE WHEN entry = '(' THEN 'x' ELSE entry END) THEN 'too-broad' END AS reason FROM wanted WHERE word IN (FROM top))
SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS what, entry, word AS words, reason FROM checked
UNION ALL SELECT 'before', sum(b)::VARCHAR, count(*)::VARCHAR, NULL FROM d
UNION ALL SELECT 'after', sum(a)::VARCHAR, count(*)::VARCHAR, NULL FROM d
UNION ALL SELECT 'unjudged', count(*)::VARCHAR, NULL, NULL FROM top WHERE word NOT IN ({in_list(judged)})
"""


_THRICE = "|".join(re.escape(chr(c)) * 3 for c in range(32, 127)) + r"|\t\t\t"
_W = r"[\p{L}\p{M}\p{N}_]"
_WIDE = _quoted(patterns.alternation(FilterOptions().resolved().block, True))
_WIDE_ALLOW = _quoted(patterns.alternation(FilterOptions().resolved().allow, True))
_DISGUISED_SQL = f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '(?i){_W}*(?:{_WIDE}){_W}*'), lambda w: NOT regexp_full_match(w, '(?i)(?:{_WIDE_ALLOW})')), lambda w: lower(w)))), ',') AS words
FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]') AND NOT regexp_matches(text, '{_quoted(_THRICE)}') AND NOT regexp_matches(text, '{_SPACED}')
"""


_TAX = "list_max(n) <= 3 AND len(list_filter(n, lambda x: x > 1)) = 1 AND (11 - list_reduce(list_prepend(10, list_transform(string_split(d[1:10], ''), lambda c: c::INT)), lambda p, c: (CASE WHEN (c + p) % 10 = 0 THEN 10 ELSE (c + p) % 10 END) * 2 % 11)) % 10 = d[11]::INT"
_MADE_UP_SQL = f"""
WITH keys AS (SELECT o_orderkey AS k, lpad((o_orderkey * 7919)::VARCHAR, 18, '0') AS z, (o_orderkey // 6) % 2 = 1 AS odd FROM orders),
ibans AS (SELECT k, 'iban' AS kind, c AS v FROM (SELECT k, odd, z, 'DE' || lpad(((98 - (z || '131400')::HUGEINT % 97 + odd::INT) % 100)::VARCHAR, 2, '0') || z AS c FROM keys WHERE k % 6 = 0) WHERE (substr(c, 5) || '1314' || substr(c, 3, 2))::HUGEINT % 97 = 1),
taxes AS (SELECT k, 'taxid-de' AS kind, d AS v FROM (SELECT k, d, list_transform(range(0, 10), lambda x: 10 - length(replace(d[1:10], x::VARCHAR, ''))) AS n FROM (SELECT k, (k * 7919 + 10000000000)::VARCHAR AS d FROM keys WHERE k % 6 = 1)) WHERE {_TAX}),
phones AS (SELECT k, 'phone' AS kind, d AS v FROM (SELECT k, '0' || substr(reverse(z), 1, (5 + (k // 6) % 13)::INT) AS d FROM keys WHERE k % 6 = 2) WHERE CASE WHEN d[2] = '0' THEN length(d) BETWEEN 10 AND 17 ELSE length(d) BETWEEN 7 AND 14 END),
sixes AS (SELECT k, 'ip' AS kind, '2001:db8:' || lower(hex(k)) || '::' || lower(hex(k % 65536)) AS v FROM keys WHERE k % 6 = 3 AND NOT odd AND length(hex(k)) <= 4),
cards AS (SELECT k, 'card' AS kind, d AS v FROM (SELECT k, odd, '9' || left(reverse(z), 14) || ((k // 12) % 10)::VARCHAR AS d FROM keys WHERE k % 6 = 4) WHERE NOT odd AND {_LUHN}),
fours AS (SELECT k, 'ip' AS kind, '1.2.3.' || (k % 300)::VARCHAR AS v FROM keys WHERE k % 6 = 5 AND NOT odd AND k % 300 BETWEEN 10 AND 255),
found AS (FROM ibans UNION ALL FROM taxes UNION ALL FROM phones UNION ALL FROM sixes UNION ALL FROM cards UNION ALL FROM fours)
SELECT keys.k AS o_orderkey, coalesce(kind, '') AS kinds, coalesce(v, '') AS texts FROM keys LEFT JOIN found USING (k)
"""


_EACH = f"SELECT doc_id, text, {_FLAGGED_BOTH} AS listed, len({_EMAILS}) AS email, len({_CARDS}) AS card, len({_PHONES}) AS phone, len({_IPS}) AS ip FROM documents"
ORACLE_SQL = {
    "registry_lists": _REGISTRY_SQL,
    "ndjson_round_trip": "SELECT text, doc_id::VARCHAR AS id FROM documents WHERE text IS NOT NULL",
    "line_round_trip": r"SELECT text, count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY text",
    "csv_round_trip": "SELECT 'say \"' || text || '\", then' AS text, doc_id::VARCHAR AS id FROM documents",
    "skipped_lines": "SELECT CASE doc_id % 6 WHEN 0 THEN 'json' WHEN 2 THEN 'not-object' ELSE 'no-text' END AS reason, count(*) AS lines FROM documents WHERE doc_id % 6 < 4 GROUP BY 1",
    "flagged_output": f"SELECT doc_id::VARCHAR AS id, true AS flagged, true AS matched_list, 0 AS findings FROM documents WHERE {_FLAGGED_BOTH}",
    "stored_notices": "SELECT doc_id % 97 AS k, doc_id AS version, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id DESC) = 1",
    "dense_index": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents",
    "streamed_flags": f"SELECT doc_id, {_FLAGGED_BOTH} AS flagged, {_FLAGGED_BOTH} AS matched_list FROM documents",
    "literal_segments": f"SELECT doc_id, len(h)::BIGINT AS pieces, length(array_to_string(h, ''))::BIGINT AS chars, md5(text) AS joined FROM (SELECT doc_id, text, {_HITS} AS h FROM documents)",
    "literal_words": f"SELECT word, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(word, '(?i){_BLOCK['en']}'))))), ',') AS hits, count(*) AS documents, array_to_string(list(md5(text) ORDER BY doc_id)[1:3], ',') AS samples FROM ({_WORDS}) GROUP BY word",
    "frequent_words": f"SELECT word, count(*) AS documents FROM ({_WORDS}) GROUP BY word HAVING count(*) >= 2",
    "highlighted_text": "SELECT doc_id, md5(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(the)', '<mark>\\1</mark>', 'gi')) AS html FROM documents",
    "judged_words": f"SELECT coalesce(verdict, 'unjudged') AS verdict, count(*) AS words, sum(n)::BIGINT AS documents FROM (SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY word) LEFT JOIN (VALUES ('scum', 'ordinary'), ('whores', 'offensive'), ('whorer', 'offensive'), ('other', 'ordinary')) AS v(word, verdict) USING (word) GROUP BY 1",
    "disguised_flags": _DISGUISED_SQL,
    "folded_text": "SELECT doc_id, doc_id % 7 < 6 AS flagged, [15, 14, 18, 15, 17, 14, 14][doc_id % 7 + 1]::BIGINT AS chars, 'so a *****. ok' AS plain FROM documents",
    "sql_functions": f"SELECT lower(hit) AS hit, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({_HITS}) AS hit FROM documents) GROUP BY 1",
    "asked_within_budget": f"SELECT doc_id, CASE WHEN n <= 25 THEN 'ok' ELSE 'skipped' END AS status, CASE WHEN n <= 25 THEN 'r' ELSE '{ai.OVER_BUDGET}' END AS reason FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE {_FLAGGED})",
    "parsed_verdicts": "SELECT doc_id, doc_id % 3 = 0 AS flagged, CASE doc_id % 4 WHEN 1 THEN 'low' WHEN 3 THEN 'high' ELSE 'none' END AS severity, 'insult' AS categories, greatest(0, least(1, (doc_id % 7 - 2) / 4))::DOUBLE AS confidence, substr(text, 1, 5) AS reason, '' AS quote FROM documents",
    "literal_notices": _notice_sql(),
    "card_shapes": _KIND_SQL(_CARDS),
    "phone_shapes": _KIND_SQL(_PHONES),
    "ip_shapes": _KIND_SQL(_IPS),
    "run_totals": f"SELECT count(*) AS processed, count(*) FILTER (listed OR email + card + phone + ip > 0) AS flagged, count(*) FILTER (listed) AS matched_list, count(*) FILTER (email + card + phone + ip > 0) AS pii_records, sum(email + card + phone + ip)::BIGINT AS pii_findings, 0::BIGINT AS errors, sum(email)::BIGINT AS email, sum(card)::BIGINT AS card, sum(phone)::BIGINT AS phone, sum(ip)::BIGINT AS ip FROM ({_EACH})",
    "made_up_data": _MADE_UP_SQL,
    "private_pieces": f"SELECT doc_id, len(f) > 0 AS private, len(f)::BIGINT AS emails, md5(text) AS joined, array_to_string(f, '|') AS texts FROM (SELECT doc_id, text, {_EMAILS} AS f FROM documents)",
    "tuning_runs": _tuned_sql(),
    "entry_checks": "SELECT entry, word, reason IS NULL AS ok, reason, CASE WHEN reason = 'too-broad' THEN 'whores' END AS offensive FROM (SELECT entry, word, CASE WHEN NOT regexp_full_match(word, entry) THEN 'no-effect' WHEN regexp_full_match('whores', entry) THEN 'too-broad' END AS reason FROM (VALUES " + ", ".join(f"('{_quoted(e)}', '{w}')" for e, w in CANDIDATES) + ") AS t(entry, word))",
    "attack_scores_literal": f"SELECT category, count(*) AS total, sum((({_FLAGGED_BOTH}) = (expect = 'flag'))::INT)::BIGINT AS passed FROM {_CORPUS} GROUP BY ROLLUP (category)",
    "attack_selection": f"SELECT category, expect, count(*) AS attacks FROM {_CORPUS} WHERE language = 'de' AND category IN ('leet', 'false-positive') GROUP BY ALL",
}
ORACLE_SQL["pii_by_kind"] = f"SELECT kind, n AS findings FROM (SELECT unnest(['email', 'card', 'phone', 'ip']) AS kind, unnest([sum(email), sum(card), sum(phone), sum(ip)])::BIGINT AS n FROM ({_EACH})) WHERE n > 0"
