"""The queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import anchors, arrays, bpe, crf, minhash, ngram_ratio, packing, rotated_codes, rule_ensemble, sharding, tokenbits


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbits.packed_tokens(_table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.detected(_table(spark, sf_dir, "documents"))


def op5_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_ratio.thresholded(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.neighbours(_table(spark, sf_dir, "embeddings"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.identified(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), "doc_id", shards=SHARDS)


SHARDS = 64

# The same binary search: 64 halvings decide any 63-bit capacity; each is checked greedily
# over the running sums, a shard at a time.
OP10_SQL = f"""
WITH RECURSIVE
g AS (SELECT doc_id, greatest(sum(coalesce(strlen(text), 0)), 0)::BIGINT AS n FROM documents GROUP BY doc_id),
o AS (SELECT doc_id, n, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS i, (sum(n) OVER (ORDER BY doc_id NULLS FIRST))::BIGINT AS s FROM g),
t AS (SELECT max(s) AS total, max(n) AS largest FROM o),
search(step, lo, hi, mid, used, done) AS (
  SELECT 0, greatest(largest, (total + {SHARDS} - 1) // {SHARDS}), greatest(largest, total),
         (greatest(largest, (total + {SHARDS} - 1) // {SHARDS}) + greatest(largest, total)) // 2, 0, 0::BIGINT FROM t
  UNION ALL
  SELECT step + 1,
         CASE WHEN done < total AND used = {SHARDS} THEN mid + 1 ELSE lo END,
         CASE WHEN done >= total THEN mid ELSE hi END,
         CASE WHEN done >= total THEN (lo + mid) // 2 WHEN used = {SHARDS} THEN (mid + 1 + hi) // 2 ELSE mid END,
         CASE WHEN done >= total OR used = {SHARDS} THEN 0 ELSE used + 1 END,
         CASE WHEN done >= total OR used = {SHARDS} THEN 0 ELSE (SELECT max(s) FROM o WHERE s <= done + mid) END
  FROM search, t WHERE lo < hi),
best AS (SELECT lo AS capacity FROM search WHERE lo >= hi LIMIT 1),
cuts(shard, done) AS (
  SELECT 0, 0::BIGINT
  UNION ALL
  SELECT shard + 1, (SELECT max(s) FROM o WHERE s <= done + capacity) FROM cuts, best, t WHERE done < total)
SELECT doc_id, n AS group_size, (SELECT greatest(max(shard), 0) FROM cuts, t WHERE cuts.done < o.s OR (cuts.done = 0 AND cuts.shard = 0))::INTEGER AS shard FROM o
"""

# What min-max hashing estimates, exactly: groups of documents of which each is joined to the next by a Jaccard similarity of
# 0.55 on shingles of three words.  On these tables no pair is so near the threshold that the estimate would err.
OP7_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.55 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT doc_id, min(other) AS group_id, min(other) = doc_id AS keep FROM reach GROUP BY doc_id
"""

_MULTIPLIED = "((({a})::UHUGEINT * {b}::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def _mixed(table: str, column: str, keep: str) -> str:
    """SQL of the finaliser of hashes: ``column`` of ``table`` (UBIGINT) becomes ``m``."""
    step = f"SELECT {keep}, xor({column}, {column} >> 33) AS m FROM {table}"
    for factor, shift in ((0xFF51AFD7ED558CCD, 29), (0xC4CEB9FE1A85EC53, 32)):
        step = f"SELECT {keep}, {_MULTIPLIED.format(a='m', b=factor)}::UBIGINT AS m FROM ({step})"
        step = f"SELECT {keep}, xor(m, m >> {shift}) AS m FROM ({step})"
    return step


# The same hashes of words and pairs in unsigned arithmetic, the same counts, and the least score kept by a running count.
OP5_SQL = rf"""
WITH
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(doc_id IN (SELECT doc_id FROM trusted), false) AS good FROM documents),
words AS (SELECT r, good, i, w[i] AS t FROM (SELECT r, good, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT r, good, regexp_extract_all(text, '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+|[^0-9A-Za-z\x{{80}}-\x{{10FFFF}}\t-\r ]+') AS w FROM docs))),
kinds AS (SELECT t, hex(encode(t)) AS x FROM (SELECT DISTINCT t FROM words)),
sums AS (SELECT t, ((list_reduce(list_prepend(0::UHUGEINT, list_transform(range(len(x) // 2, 0, -1), lambda i: [{", ".join(f"{v}" for v in arrays.BYTE_VALUES.tolist())}][(strpos('0123456789ABCDEF', x[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i])]::UHUGEINT)), lambda a, v: (a * {int(arrays.BASE)}::UHUGEINT % 18446744073709551616::UHUGEINT + v) % 18446744073709551616::UHUGEINT) + (len(x) // 2)::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM kinds),
hashes AS (SELECT t, m | 9223372036854775808::UBIGINT AS h FROM ({_mixed("sums", "h", "t")})),
ones AS (SELECT r, good, i, h FROM words JOIN hashes USING (t)),
pairs AS (SELECT r, good, ((({_MULTIPLIED.format(a="h", b=int(arrays.BASE))}) + n::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS p FROM (SELECT r, good, h, lead(h) OVER (PARTITION BY r ORDER BY i) AS n FROM ones) WHERE n IS NOT NULL),
grams AS (SELECT r, good, (h >> 7) % {ngram_ratio.BUCKETS} AS b FROM ones UNION ALL SELECT r, good, (m >> 7) % {ngram_ratio.BUCKETS} FROM ({_mixed("pairs", "p", "r, good")})),
counts AS (SELECT b, count(*) AS raw, count(*) FILTER (good) AS target FROM grams GROUP BY b),
totals AS (SELECT sum(raw) AS raw, sum(target) AS target FROM counts),
ratios AS (SELECT b, CASE WHEN totals.target = 0 THEN 0 ELSE ln((counts.target + 1) / (totals.target + {ngram_ratio.BUCKETS})) - ln((counts.raw + 1) / (totals.raw + {ngram_ratio.BUCKETS})) END AS l FROM counts, totals),
scores AS (SELECT docs.r, doc_id, good, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM docs LEFT JOIN (SELECT r, count(*) AS n, round(avg(l), 4) AS s FROM grams JOIN ratios USING (b) GROUP BY r) AS g USING (r)),
running AS (SELECT s, sum(c) OVER (ORDER BY s) AS below, sum(c) OVER () AS total FROM (SELECT s, count(*) AS c FROM scores WHERE good AND n > 0 GROUP BY s)),
least AS (SELECT coalesce(min(s) FILTER (below > 0.005 * total), max(s)) AS least FROM running)
SELECT doc_id, n AS n_grams, s + 0.0::DOUBLE AS score, n > 0 AND s >= coalesce(least, '-infinity'::DOUBLE) AS keep FROM scores, least
"""

QUERIES = {f.__name__: f for f in (op1_quality, op2_packing, op3_token_bits, op4_personal_data, op5_ngram_ratio, op6_neighbours, op7_near_duplicates, op8_bpe, op9_language, op10_sharding)}
ORACLE_SQL = {"op5_ngram_ratio": OP5_SQL, "op7_near_duplicates": OP7_SQL, "op10_sharding": OP10_SQL}
