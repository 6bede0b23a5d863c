"""Queries over whole tables, and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import streaming
from .functions import checksums, columns, patterns
from .functions.pii import PiiOptions
from .functions.registry import FilterOptions
from .operators import adversarial, allowlist, compliance
from .operators import moderate as M

#: Literal stems are what SQL can follow word by word; look-alikes are tested in tests/.
LITERAL = FilterOptions(languages=("en",), aggressive=False)
BOTH = FilterOptions(languages=("en", "de"), aggressive=False)
UNCHECKED = FilterOptions(languages=("en",), aggressive=False, cross_check=False)
FULL = FilterOptions(languages=("en", "de"))


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    columns.batched(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _sql_words(column: str, options: FilterOptions) -> str:
    """The words of a text that hold a literal hit and aren't allowed."""
    lists = options.resolved()
    parts, whole = [], []
    head, tail = patterns.whole_word("\0").split("\0")
    for stem in lists.block:
        (whole if stem.startswith(head) else parts).append(stem.removeprefix(head).removesuffix(tail))
    block = "|".join([*parts, *(f"^(?:{w})$" for w in whole)])
    out = f"list_filter(regexp_extract_all({column}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '(?i){_quoted(block)}'))"
    if lists.allow:
        out = f"list_filter({out}, lambda w: NOT regexp_full_match(w, '(?i)(?:{_quoted('|'.join(lists.allow))})'))"
    return out


def flagged_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("lang", columns.is_profane(F.col("text"), BOTH).alias("p"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("p").cast("long")).alias("flagged")).orderBy("lang")


def flagged_by_source(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("source", "lang", columns.is_profane(F.col("text"), LITERAL).alias("p"))
    return docs.rollup("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("p").cast("long")).alias("flagged"))


def raw_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Without the cross-check: every stem that occurs."""
    found = F.regexp_extract_all("text", F.lit(f"({patterns.java_source(UNCHECKED.resolved().block, False)})"), 1)
    each = _t(spark, sf, "documents").select(F.explode(found).alias("hit"))
    return each.groupBy(F.lower("hit").alias("hit")).agg(F.count(F.lit(1)).alias("occurrences"))


def unchecked_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    return docs.agg(F.sum(columns.is_profane(F.col("text"), UNCHECKED).cast("long")).alias("raw"), F.sum(columns.is_profane(F.col("text"), LITERAL).cast("long")).alias("checked"))


def top_flagged_words(spark: SparkSession, sf: str) -> DataFrame:
    """In how many documents each word is flagged."""
    words = F.array_distinct(F.transform(columns.words_with_hits(F.col("text"), LITERAL), F.lower))
    return _t(spark, sf, "documents").select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), "word")


def custom_masked(spark: SparkSession, sf: str) -> DataFrame:
    """A custom list in place of the built-in one, masked."""
    own = FilterOptions(custom_list=("idiot",), cross_check=False, aggressive=False)
    return _t(spark, sf, "documents").select("doc_id", columns.mask_profane(F.col("text"), own).alias("masked"))


def label_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Flags against labels of toxicity."""
    own = FilterOptions(custom_list=TOXIC, cross_check=False, aggressive=False)
    docs = _t(spark, sf, "documents").select("doc_id", columns.is_profane(F.col("text"), own).alias("p"))
    joined = docs.join(_t(spark, sf, "labels").where("toxic is not null"), "doc_id")
    return joined.groupBy("toxic").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("p").cast("long")).alias("flagged"))


TOXIC = ("idiot", "moron", "stupid", "loser", "pathetic", "disgusting", "trash", "clown")


def conversation_roles(spark: SparkSession, sf: str) -> DataFrame:
    turns = _t(spark, sf, "conversations").select("role", columns.is_profane(F.col("text"), LITERAL).alias("p"))
    return turns.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.col("p").cast("long")).alias("flagged"))


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    """Pages scanned without their markup."""
    text = F.regexp_replace("html", "<[^>]*>", " ")
    return _t(spark, sf, "pages").select("page_id", columns.is_profane(text, LITERAL).alias("flagged"), F.length(text).cast("long").alias("chars"))


def benchmark_control(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "benchmark").select("item_id", columns.is_profane(F.col("text"), LITERAL).alias("flagged"))


def language_guess(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", columns.detect_language(F.col("text")).alias("guess"))


def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", columns.excerpt(F.col("text")).alias("excerpt"))


def card_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of 13 to 19 digits, by whether their checksum holds."""
    numbers = _t(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]+)"), 1)).alias("d")).where(F.length("d").between(13, 19))
    return numbers.groupBy(checksums.luhn_column(F.col("d")).alias("valid")).agg(F.count(F.lit(1)).alias("numbers"))


def tax_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Check digits of order keys made eleven digits long."""
    digits = F.lpad((F.col("o_orderkey") * 7919 + 10_000_000_000).cast("string"), 11, "0")
    return _t(spark, sf, "orders").select("o_orderkey", checksums.tax_id_column(digits).alias("valid"))


IBANS = ("GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "FR1420041010050500013M02606", "GB82WEST12345698765431", "DE8937040044053201300", "XX82WEST12345698765432", "NO93 8601 1117 947", "nl91abna0417164300", "")


def iban_checks(spark: SparkSession, sf: str) -> DataFrame:
    values = spark.createDataFrame([(v,) for v in IBANS], "value string")
    return values.select("value", checksums.iban_column(F.col("value")).alias("valid"))


def email_shapes(spark: SparkSession, sf: str) -> DataFrame:
    results = M.moderate(_t(spark, sf, "documents"), M.ModerateOptions(filter=None, pii=PiiOptions(("email",))), index_column="doc_id")
    return results.where(F.size("pii") > 0).select(F.col("index").alias("doc_id"), F.size("pii").cast("long").alias("emails"))


def pii_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return M.pii_by_kind(M.moderate(_t(spark, sf, "documents"), M.ModerateOptions(filter=None, pii=PiiOptions()), index_column="doc_id"))


def pii_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of one record never overlap: there is no row."""
    return M.overlapping_findings(M.moderate(_t(spark, sf, "documents"), M.ModerateOptions(filter=None, pii=PiiOptions()), index_column="doc_id"))


def lossless_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments joined are the text: with look-alikes and everything undone."""
    pieces = _t(spark, sf, "documents").select("text", columns.profane_segments(F.col("text"), FULL).alias("s"))
    return pieces.agg(F.count(F.lit(1)).alias("documents"), F.sum((F.array_join(F.transform("s", lambda x: x["text"]), "") == F.col("text")).cast("long")).alias("lossless"))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """All stages without a model over all documents, in one row."""
    results = M.moderate(_t(spark, sf, "documents"), M.ModerateOptions(filter=FULL, pii=PiiOptions()), index_column="doc_id")
    return M.summarize(results).withColumn("pii_by_kind", F.to_json("pii_by_kind"))


def first_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 flagged documents: a report's samples."""
    results = M.moderate(_t(spark, sf, "documents"), M.ModerateOptions(filter=LITERAL), index_column="doc_id")
    return M.samples(results.select("index", "flagged"))


def flagged_words_full(spark: SparkSession, sf: str) -> DataFrame:
    return M.flagged_words(_t(spark, sf, "documents"), FULL, index_column="doc_id")


def before_after(spark: SparkSession, sf: str) -> DataFrame:
    """What one more allow entry does."""
    wider = FilterOptions(languages=("en",), aggressive=False, allow_list=(r"\p{L}*shit\p{L}*",))
    docs = _t(spark, sf, "documents")
    return docs.agg(F.count(F.lit(1)).alias("scanned"), F.sum(columns.is_profane(F.col("text"), LITERAL).cast("long")).alias("before"), F.sum(columns.is_profane(F.col("text"), wider).cast("long")).alias("after"))


def tuned(spark: SparkSession, sf: str) -> DataFrame:
    """A whole tuning run with verdicts by hand."""
    report = allowlist.tune(_t(spark, sf, "documents"), LITERAL, {"shit": "offensive", "cum": "offensive"})
    return spark.createDataFrame([(report.before["scanned"], report.before["flagged_records"], len(report.accepted), len(report.unjudged))], "scanned long, flagged long, accepted int, unjudged int")


def notices(spark: SparkSession, sf: str) -> DataFrame:
    """A notice for each flagged document."""
    results = M.moderate(_t(spark, sf, "documents"), M.ModerateOptions(filter=FULL, segments=True), index_column="doc_id").where("flagged")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return compliance.justify(results, timestamp=at).select(F.col("index").alias("doc_id"), "justification.language", "justification.reason", compliance.as_text().alias("notice"))


def notice_wording(spark: SparkSession, sf: str) -> DataFrame:
    """Guessed language and action looked up in the table of wordings."""
    rows = _t(spark, sf, "documents").select("doc_id", columns.detect_language(F.col("text")).alias("language"), F.lit("CONTENT_DEMOTION").alias("action"))
    return rows.join(F.broadcast(compliance.reason_table(spark)), ["language", "action"]).groupBy("language", "wording").agg(F.count(F.lit(1)).alias("documents"))


def attack_scores(spark: SparkSession, sf: str) -> DataFrame:
    return adversarial.by_category(adversarial.evaluate(adversarial.attacks(spark)))


def user_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Users with more than one event within an hour."""
    return streaming.over_limit(_t(spark, sf, "events"), "user_id", "ts", 1, "1 hour")


def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that no flagged word occurs in: an anti join."""
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    flagged = docs.where(columns.is_profane(F.col("text"), LITERAL)).select("doc_id")
    return docs.join(flagged, "doc_id", "left_anti").select("doc_id")


def stem_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Which stem occurs in how many documents: texts against all stems, flagged ones only."""
    stems = spark.createDataFrame([(s,) for s in UNCHECKED.resolved().block], "stem string")
    docs = _t(spark, sf, "documents").where(F.col("text").rlike(patterns.java_source(UNCHECKED.resolved().block, False))).select("doc_id", "text")
    pairs = docs.join(F.broadcast(stems), F.expr("text RLIKE concat('(?iu)', stem)"))
    return pairs.groupBy("stem").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {f.__name__: f for f in (flagged_by_lang, flagged_by_source, raw_hits, unchecked_counts, top_flagged_words, custom_masked, label_agreement, conversation_roles, page_text, benchmark_control, language_guess, excerpts, card_numbers, tax_ids, iban_checks, email_shapes, pii_by_kind, pii_overlaps, lossless_segments, run_summary, first_samples, flagged_words_full, before_after, tuned, notices, notice_wording, attack_scores, user_limits, clean_documents, stem_hits)}

_RAW = _quoted("|".join(UNCHECKED.resolved().block))
_GUESS = r"CASE WHEN len(regexp_extract_all(text, '(?i)\b(?:auch|das|der|die|ein|für|in|ist|mit|nicht|sich|und|von|zu)\b')) / len(regexp_split_to_array(text, '\s+')) > 0.15 THEN 'de' ELSE 'en' END"
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(d, length(d) - i + 1, 1)::INT ELSE (substr(d, length(d) - i + 1, 1)::INT * 2) // 10 + (substr(d, length(d) - i + 1, 1)::INT * 2) % 10 END)) % 10 = 0"
_MOD97 = "list_reduce(list_prepend(0, list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda x: CASE WHEN ascii(x) >= 65 THEN ascii(x) - 55 ELSE ascii(x) - 48 END)), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"
_LENGTHS = ", ".join(f"('{k}', {v})" for k, v in checksums.IBAN_LENGTHS.items())
_WORD = lambda options, column="text": f"len({_sql_words(column, options)}) > 0"
_EXTENDED = FilterOptions(languages=("en",), aggressive=False, allow_list=(r"\p{L}*shit\p{L}*",))

ORACLE_SQL = {
    "flagged_by_lang": f"SELECT lang, count(*) AS documents, sum(({_WORD(BOTH)})::INT)::BIGINT AS flagged FROM documents GROUP BY lang",
    "flagged_by_source": f"SELECT source, lang, count(*) AS documents, sum(({_WORD(LITERAL)})::INT)::BIGINT AS flagged FROM documents GROUP BY ROLLUP (source, lang)",
    "raw_hits": f"SELECT lower(hit) AS hit, count(*) AS occurrences FROM (SELECT unnest(regexp_extract_all(text, '(?i){_RAW}')) AS hit FROM documents) GROUP BY 1",
    "unchecked_counts": f"SELECT sum(regexp_matches(text, '(?i){_RAW}')::INT)::BIGINT AS raw, sum(({_WORD(LITERAL)})::INT)::BIGINT AS checked FROM documents",
    "top_flagged_words": f"SELECT word, count(*) AS documents FROM (SELECT unnest(list_distinct(list_transform({_sql_words('text', LITERAL)}, lambda w: lower(w)))) AS word FROM documents) GROUP BY word",
    "custom_masked": "SELECT doc_id, regexp_replace(text, 'idiot', '*****', 'gi') AS masked FROM documents",
    "label_agreement": f"SELECT toxic, count(*) AS documents, sum(regexp_matches(text, '(?i){'|'.join(TOXIC)}')::INT)::BIGINT AS flagged FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY toxic",
    "conversation_roles": f"SELECT role, count(*) AS turns, sum(({_WORD(LITERAL)})::INT)::BIGINT AS flagged FROM conversations GROUP BY role",
    "page_text": f"SELECT page_id, {_WORD(LITERAL, 't')} AS flagged, length(t)::BIGINT AS chars FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages)",
    "benchmark_control": f"SELECT item_id, {_WORD(LITERAL)} AS flagged FROM benchmark",
    "language_guess": f"SELECT doc_id, {_GUESS} AS guess FROM documents",
    "excerpts": r"SELECT doc_id, CASE WHEN length(t) <= 72 THEN t ELSE substr(t, 1, 71) || '…' END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)",
    "card_numbers": f"SELECT {_LUHN} AS valid, count(*) AS numbers FROM (SELECT unnest(regexp_extract_all(text, '[0-9]+')) AS d FROM documents) WHERE length(d) BETWEEN 13 AND 19 GROUP BY 1",
    "tax_ids": "SELECT o_orderkey, d[1] <> '0' AND list_max(n) <= 3 AND len(list_filter(n, lambda x: x > 1)) = 1 AND (11 - list_reduce(list_prepend(10, list_transform(string_split(d[1:10], ''), lambda c: c::INT)), lambda p, c: (CASE WHEN (c + p) % 10 = 0 THEN 10 ELSE (c + p) % 10 END) * 2 % 11)) % 10 = d[11]::INT AS valid FROM (SELECT o_orderkey, d, list_transform(range(0, 10), lambda x: 10 - length(replace(d[1:10], x::VARCHAR, ''))) AS n FROM (SELECT o_orderkey, lpad((o_orderkey * 7919 + 10000000000)::VARCHAR, 11, '0') AS d FROM orders))",
    "iban_checks": f"WITH v AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{v}{chr(39)})' for v in IBANS)}) AS t(value)), l AS (SELECT * FROM (VALUES {_LENGTHS}) AS t(country, size)), c AS (SELECT value, upper(regexp_replace(value, '[\\s.-]', '', 'g')) AS c FROM v) SELECT value, coalesce(CASE WHEN regexp_full_match(c, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{10,30}}') AND size = length(c) THEN {_MOD97} END, false) AS valid FROM c LEFT JOIN l ON country = substr(c, 1, 2)",
    "email_shapes": r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}._%+\-!#$&''*/=?^`{|}~]+@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,24}'))::BIGINT AS emails FROM documents WHERE emails > 0",
    "pii_overlaps": "SELECT 0::BIGINT AS index, 0 AS n WHERE false",
    "lossless_segments": "SELECT count(*) AS documents, count(*) AS lossless FROM documents",
    "first_samples": f"SELECT doc_id AS index, true AS flagged FROM documents WHERE {_WORD(LITERAL)} ORDER BY doc_id LIMIT 20",
    "before_after": f"SELECT count(*) AS scanned, sum(({_WORD(LITERAL)})::INT)::BIGINT AS before, sum(({_WORD(_EXTENDED)})::INT)::BIGINT AS after FROM documents",
    "notice_wording": f"SELECT language, wording, count(*) AS documents FROM (SELECT {_GUESS} AS language FROM documents) JOIN (VALUES ('en', '{_quoted(compliance._REASONS['en'][1])}'), ('de', '{_quoted(compliance._REASONS['de'][1])}')) AS t(lang, wording) ON lang = language GROUP BY ALL",
    "user_limits": "SELECT date_trunc('hour', ts) AS window_start, user_id, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 1",
    "clean_documents": f"SELECT doc_id FROM documents WHERE NOT {_WORD(LITERAL)}",
    "stem_hits": f"SELECT stem, count(*) AS documents FROM documents, (SELECT unnest([{', '.join(chr(39) + _quoted(s) + chr(39) for s in UNCHECKED.resolved().block)}]) AS stem) WHERE regexp_matches(text, '(?i)' || stem) GROUP BY stem",
}
