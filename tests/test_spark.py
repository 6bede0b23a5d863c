"""Columns, operators, sources and streams on Spark."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__
from sparkwarden import queries, queries_more, streaming
from sparkwarden.__main__ import main
from sparkwarden.functions import checksums, columns, kernel, pii
from sparkwarden.functions.registry import FilterOptions
from sparkwarden.operators import adversarial, ai, allowlist, compliance, providers
from sparkwarden.operators import moderate as M
from sparkwarden.operators.report import duration, text_report
from sparkwarden.sources import readers, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SF = "/root/testdata/sf0.001"
EVERY, SQL = queries.QUERIES | queries_more.QUERIES, queries.ORACLE_SQL | queries_more.ORACLE_SQL
BOTH = FilterOptions(languages=("en", "de"))
TEXTS = ["what an asshole", "all is well", None, "", "f u c k", "call +1 202 5550123", "Ein Dokument, du Dr3cks4u", "😀 sh1t a@b.example", "sc​hön", "İ shit"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "index long, text string").cache()


def test_columns_are_the_kernel(df):
    rows = df.select("text", columns.profane_segments(F.col("text"), BOTH).alias("s"), columns.is_profane(F.col("text"), BOTH).alias("p"), columns.mask_profane(F.col("text"), BOTH).alias("m"), columns.has_pii(F.col("text")).alias("h"), columns.pii_segments(F.col("text")).alias("g")).collect()
    for r in rows:
        assert [tuple(x) for x in r.s] == kernel.segments(r.text, BOTH)
        assert r.p == kernel.is_profane(r.text, BOTH) and r.m == (None if r.text is None else kernel.mask(r.text, BOTH))
        assert r.h == bool(pii.detect(r.text)) and "".join(x.text for x in r.g) == (r.text or "")


def test_gated_rows_agree_with_the_kernel_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", columns.is_profane(F.col("text"), BOTH).alias("p"), columns.is_profane(F.col("text"), FilterOptions(aggressive=False)).alias("q"))
    for r in docs.collect():
        assert r.p == kernel.is_profane(r.text, BOTH) and r.q == kernel.is_profane(r.text, FilterOptions(aggressive=False))


def test_one_python_node_for_filter_and_personal_data(df):
    plan = M.moderate(df, M.ModerateOptions(filter=BOTH, pii=pii.PiiOptions()), index_column="index")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_offsets_are_utf16(df):
    found = df.where("index = 7").select(F.explode(columns.pii_findings(F.col("text"))).alias("f")).select("f.*").first()
    assert (found.kind, found.start, found.end) == ("email", 8, 19)


def test_checksum_columns(spark):
    values = ["4111111111111111", "4111111111111112", "0", "", "86095742719", "86095742718", "GB82WEST12345698765432", "de89 3704 0044 0532 0130 00", "x", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", checksums.luhn_column(F.col("v")).alias("l"), checksums.iban_column(F.col("v")).alias("i"), checksums.tax_id_column(F.col("v")).alias("t")).collect()
    for r in rows:
        v = r.v or ""
        assert (r.l, r.i, r.t) == (checksums.is_luhn(v), checksums.is_iban(v), checksums.is_german_tax_id(v)), v


def test_moderate_and_summary(df):
    results = M.moderate(df, M.ModerateOptions(filter=BOTH, pii=pii.PiiOptions(), segments=True), index_column="index")
    total = M.summarize(results).first()
    assert (total.processed, total.matched_list, total.pii_records, total.pii_by_kind, total.errors) == (10, 5, 2, {"email": 1, "phone": 1}, 0)
    assert [r["index"] for r in M.samples(results, 2).collect()] == [0, 4]
    assert M.overlapping_findings(results).count() == 0
    out = sinks.flagged_output(results)
    assert "text" not in out.columns and out.count() == total.flagged == 6
    report = text_report(total.asDict(True) | {"elapsed_ms": 50}, [r.asDict(True) for r in M.samples(results).collect()])
    assert "6 (60.0%)" in report and "row 0" in report and "200/s" in report
    empty = M.summarize(M.moderate(df.limit(0), index_column="index")).first()
    assert empty.processed == 0 and empty.pii_by_kind == {}
    assert duration(61_000) == "1 min 1 s"


def complete(request):
    if "boom" in request["text"]:
        raise RuntimeError("no answer")
    if "well" in request["text"]:
        return {"refused": True, "refusal_reason": "no"}
    return {"json": json.dumps({"flagged": True, "severity": "high", "categories": ["insult", "other"], "confidence": 7, "reason": "r", "quote": "q"}), "model": "m"}


def test_model_gate_and_budget(df):
    ask = lambda **o: {r["index"]: r for r in M.moderate(df.where("text <> ''"), M.ModerateOptions(filter=BOTH, complete=complete, backoff_ms=1, **o), index_column="index").collect()}
    matched = ask()
    assert matched[0].ai.status == "ok" and matched[0].ai.categories == ["insult"] and matched[0].ai.confidence == 1.0 and matched[1].ai is None
    every = ask(gate="all")
    assert every[1].ai.status == "refused" and not every[1].ai.flagged
    few = ask(gate="all", max_calls=2)
    assert [i for i, r in sorted(few.items()) if r.ai.status in ("ok", "refused")] == [0, 1] and few[4].ai.reason == ai.OVER_BUDGET
    assert all(r.ai.status == "skipped" for r in ask(gate="all", max_calls=0).values())
    own = ask(gate=lambda rows: F.length("text") > 20)
    assert {i for i, r in own.items() if r.ai} == {6}
    with pytest.raises(ValueError):
        ask(gate="some")
    assert ai.analyze("boom sk-123456789", ai.AiOptions(complete), retries=1, backoff_ms=1)["status"] == "error" and ai.redact("key sk-123456789", "sk-123456789") == "key [redacted]"
    assert ai.analyze("x", ai.AiOptions(enabled=False))["status"] == "disabled" and ai.analyze(" ", ai.AiOptions(complete))["status"] == "skipped"
    assert "additionalProperties" not in json.dumps(providers.without_additional(ai.schema()))


def test_stored_verdicts_are_parsed_alike(spark):
    texts = ['{"flagged": true, "severity": "odd", "categories": ["hate", "x"], "confidence": -1}', '{"confidence": 0.5}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ai.parse_verdict_column(F.col("t")).alias("v")).collect()
    for r in rows:
        want = ai.parse_verdict(r.t)
        assert all(r.v[k] == want[k] for k in ("flagged", "severity", "categories", "confidence", "reason", "quote"))


def test_flagged_words(df):
    rows = M.flagged_words(df, BOTH, index_column="index").collect()
    assert {(r["word"], r["count"]) for r in rows} >= {("asshole", 1), ("shit", 1)}


def test_index_is_dense(spark):
    rows = M.indexed(spark.range(1000).repartition(7)).collect()
    assert sorted(r["index"] for r in rows) == list(range(1000))
    assert [r["id"] for r in sorted(M.indexed(spark.range(100).repartition(3), ["id"]).collect(), key=lambda r: r["index"])] == list(range(100))


def test_tuning(spark):
    corpus = spark.createDataFrame([("the shitake soup",), ("what shit",), ("shitake again",), ("fine",)], "text string")
    report = allowlist.tune(corpus, verdicts={"shitake": "ordinary", "shit": "offensive"})
    assert report.before == {"scanned": 4, "flagged_records": 3} and report.accepted == [{"entry": "shitake", "words": ["shitake"]}] and report.after["flagged_records"] == 1
    model = allowlist.tune(corpus, verdicts={"shit": "offensive"}, complete=lambda r: {"json": json.dumps({"words": [{"word": "shitake", "verdict": "ordinary", "entry": "\\p{L}*shit\\p{L}*"}]})})
    assert model.rejected[0]["reason"] == "too-broad" and model.after is None
    assert allowlist.verify("(", [], [], FilterOptions())["reason"] == "invalid" and allowlist.verify("zzz", ["shit"], [], FilterOptions())["reason"] == "no-effect"
    assert "shitake" in allowlist.snippet(report) and allowlist.escape("a.b") == "a\\.b"


def test_attack_scores(spark):
    done = adversarial.evaluate(adversarial.attacks(spark))
    for lang, passed, clean in (("en", 30 / 35, 1.0), ("de", 25 / 34, 1.0)):
        total = adversarial.score(adversarial.evaluate(adversarial.attacks(spark, [lang]))).first()
        assert (total.evasion_resistance, total.precision) == (pytest.approx(passed), clean)
    assert adversarial.by_category(done).where("category is null").first()["total"] == 111
    assert "rewriting-en-1" in adversarial.report(done, verbose=True) and adversarial.visible("a​") == "a<U+200B>"
    broken = adversarial.evaluate(adversarial.attacks(spark, categories=["control"]), adversarial.detector(lambda t: 1 / 0))
    assert adversarial.score(broken).first().passed == 0
    assert adversarial.score(done.limit(0)).first().precision == 1.0


def test_notices(df):
    results = M.moderate(df, M.ModerateOptions(filter=BOTH, segments=True), index_column="index").where("matched_list")
    rows = compliance.justify(results, policies=["Rules", ("Law", "§ 1")], appeal_url="https://x.example", timestamp=F.lit("2026-01-02 03:04:05").cast("timestamp")).withColumn("t", compliance.as_text()).orderBy("index").collect()
    assert rows[0].justification.facts.quote == "ass" and rows[0].justification.language == "en" and rows[0].justification.facts.automated_detection
    assert "Rules, Law § 1" in rows[0].t and "2026-01-02T03:04:05" in rows[0].t and "Confidence" not in rows[0].t
    with pytest.raises(ValueError):
        compliance.justify(results, "NOTHING")
    assert json.loads(compliance.justify(results).select(compliance.as_json().alias("j")).first().j)["action"] == "CONTENT_REMOVED"


def test_line_and_ndjson_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"first\r\nsecond\n\nthird")
    assert [r.text for r in readers.records(spark, str(tmp_path / "a.txt")).collect()] == ["first", "second", "", "third"]
    lines = ['{"id": 1, "text": "a"}', "", "nope", '"bare"', "[1]", '{"id": "x"}', '{"text": 5}', '{"id": true, "text": "b", "text": "c"}']
    (tmp_path / "a.ndjson").write_text("\n".join(lines))
    rows = readers.ndjson(spark, str(tmp_path / "a.ndjson")).collect()
    assert [(r.text, r.id) for r in rows] == [("a", "1"), ("c", None)]
    assert {r.reason: r.lines for r in readers.skip_counts(readers.ndjson_lines(spark, str(tmp_path / "a.ndjson"))).collect()} == {"json": 1, "not-object": 1, "no-text": 3}
    with pytest.raises(Exception, match="unusable"):
        readers.ndjson(spark, str(tmp_path / "a.ndjson"), on_bad_line="throw").collect()


def test_csv_is_split_anywhere(spark, tmp_path):
    import random

    rng = random.Random(2)
    field = lambda: rng.choice(["a", "", "x y", '"q"tail', '"a ""b"" c"', '"line\nend"', '"two\n\nends, and more"', 'a"b"c', '"\r\n"', "é\r", '"' + "long\n" * 20 + '"', '""', '"",""'])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for n in range(6):
            want = []
            for k in range(2):
                text = "id,message\n" + "".join(f"{i},{field()}\n" for i in range(rng.randint(0, 60))) + ("id,message\n" if n % 2 else "") + ('9,"open' if n == 5 else "")
                (tmp_path / f"{n}").mkdir(exist_ok=True)
                (tmp_path / f"{n}" / f"{k}.csv").write_bytes(text.encode())
                want += [(r[0], r[1] if len(r) > 1 else "") for r in list(readers.split_csv(text))[1:]]
            rows = readers.csv_rows(spark, str(tmp_path / f"{n}"))
            assert rows.columns == ["id", "message"] and sorted(map(tuple, rows.collect())) == sorted(want)
            plain = readers.csv_rows(spark, str(tmp_path / f"{n}"), header=False)
            assert plain.columns == ["_c0", "_c1"] and plain.count() == len(want) + 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_sources(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(b'id,author,message\r\n1,x,"a ""b"" c"\r\n2,y,"two\nlines"\r\n,z,plain\r\n4,w,\r\n5,v,"q"tail\r\n')
    for strict in (False, True):
        got = [(r.text, r.id) for r in readers.csv(spark, str(path), id_column="id", strict=strict).collect()]
        assert got[:3] == [('a "b" c', "1"), ("two\nlines", "2"), ("plain", None)] and len(got) == 4
    assert got[3] == ("qtail", "5")
    assert list(readers.split_csv('a,"b\nc"\nd,')) == [["a", "b\nc"], ["d", ""]]
    assert readers.column_of(["x"], None) == "x" and readers.column_of(["Body ", "message"], None) == "message" and readers.column_of(["a", "b"], 1) == "b"
    with pytest.raises(ValueError, match="columns: a, b"):
        readers.column_of(["a", "b"], None)
    (tmp_path / "b.tsv").write_text("text\tid\nhi\t3\n")
    assert readers.records(spark, str(tmp_path / "b.tsv"), id_column="id").first().id == "3"


def test_sinks(spark, df, tmp_path):
    out = str(tmp_path / "o")
    sinks.write_ndjson(df.where("index < 3"), out)
    assert sorted((tmp_path / "o").glob("*.json")) and spark.read.json(out).count() == 3
    store = str(tmp_path / "store")
    sinks.upsert(spark, store, spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, at int, v string"), "k", "at")
    sinks.upsert(spark, store, spark.createDataFrame([("a", 2, "z")], "k string, at int, v string"), "k", "at")
    assert sinks.get(spark, store, "k", "a").first().v == "z" and spark.read.parquet(store).count() == 2


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("shit\nfine\ncall +1 202 5550123")
    source = readers.lines(spark, str(tmp_path / "in"), streaming=True)
    streaming.stream(source, str(tmp_path / "out"), str(tmp_path / "c1"), M.ModerateOptions(pii=pii.PiiOptions())).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("flagged").count() == 2
    got = []
    streaming.moderated_batches(source, lambda r, n: got.append(streaming.running_totals(r).first()), str(tmp_path / "c2"), M.ModerateOptions(complete=complete, gate="all", max_calls=1)).awaitTermination()
    assert sum(r.processed for r in got) == 3
    with pytest.raises(ValueError):
        streaming.stream(source, "x", "y", M.ModerateOptions(max_calls=1))


def test_sql_functions(spark, df):
    columns.register_sql(spark, BOTH)
    df.createOrReplaceTempView("records")
    assert spark.sql("SELECT count(*) FROM records WHERE is_profane(text)").first()[0] == 5
    assert spark.sql("SELECT mask_profane('sh1t'), is_valid_luhn('4111111111111111'), has_pii('a@b.example')").first() == ("****", True, True)
    assert spark.sql("SELECT r.index, h.word FROM records r, LATERAL profane_hits(r.text) h WHERE r.index = 0").first().word == "asshole"
    assert spark.sql("SELECT p.kind FROM records r, LATERAL pii_hits(r.text) p WHERE r.index = 5").first().kind == "phone"


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "log.csv"
    path.write_text('id,message\n1,what the sh1t\n2,"Du @rschloch, echt"\n3,fine\n4,a@b.example\n')
    assert main(["scan", str(path), "--languages", "en,de", "--pii", "--json", "--id-column", "id", "--out", str(tmp_path / "out")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["flagged"] == 3
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert main(["scan", str(path), "--fail-on-flagged"]) == 1 and main(["scan", str(path), "--languages", "xx"]) == 2
    assert main(["benchmark", "--lang", "en", "--min-evasion", "0.99"]) == 1 and main(["benchmark", "--lang", "en", "--min-precision", "1"]) == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def sql_rows(spark, con, name):
    ours = EVERY[name](spark, SF)
    theirs = con.sql(SQL[name])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in names]
    key = lambda rows: sorted(map(repr, rows))
    return key(tuple(r[c] for c in names) for r in ours.collect()), key(tuple(r[i] for i in at) for r in theirs.fetchall())


@pytest.fixture(scope="module")
def con():
    import duckdb

    made = duckdb.connect()
    for t in "orders events documents pages benchmark labels conversations".split():
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, con, name):
    ours, theirs = sql_rows(spark, con, name)
    assert ours == theirs
