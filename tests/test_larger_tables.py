"""What tables other than the small ones hold: folders of files, capitals, numbers side by side."""

import sys

import duckdb
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sparkwarden import queries, queries_more
from sparkwarden.functions import columns, pii

cloudpickle.register_pickle_by_value(sys.modules[__name__])
EVERY, SQL = queries.QUERIES | queries_more.QUERIES, queries.ORACLE_SQL | queries_more.ORACLE_SQL


def documents(spark, folder, texts, files=1):
    """A folder of tables with ``documents`` as a folder of files."""
    rows = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.repartition(files, F.col("doc_id")).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def both(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    ours, theirs = EVERY[name](spark, sf), con.sql(SQL[name])
    return sorted(tuple(r[c] for c in theirs.columns) for r in ours.collect()), sorted(theirs.fetchall())


@pytest.mark.parametrize("files", [1, 3])
def test_streamed_flags_of_a_folder_of_files(spark, tmp_path, files):
    ours, theirs = both(spark, documents(spark, tmp_path / "sf", ["you bitch", "all is well", "so ein arschloch", "fine"] * 5, files), "streamed_flags")
    assert ours == theirs and len(ours) == 20 and sum(r[1] for r in ours) == 10


GERMAN = ["FÜR alles andere Wetter kommt", "Für alles andere Wetter kommt", "für alles andere Wetter kommt", "fur alles andere Wetter kommt", "xfür alles andere Wetter kommt", "FÜRS alles andere Wetter kommt", "the ıst andere Wetter kommt"]


def test_language_guess_of_capitals(spark, tmp_path):
    sf = documents(spark, tmp_path / "sf", GERMAN)
    ours, theirs = both(spark, sf, "language_guess")
    assert ours == theirs and [g for _, g in ours] == ["de"] * 3 + ["en"] * 4


def test_notice_wording_of_capitals(spark, tmp_path):
    ours, theirs = both(spark, documents(spark, tmp_path / "sf", GERMAN), "notice_wording")
    assert ours == theirs and sorted(n for *_, n in ours) == [3, 4]


#: Numbers that stand close together are one, but for a phone number that is whole.
PHONES = [
    "call +1 (208) 555-1177 4284896609045836 now", "+1 (836) 555-9331 4913187196670932 53.121.55.90", "4702217622377057 +1 (318) 555-6532", "25.102.19.31 +1 (208) 555-1177\n53.121.55.90",
    "+1 (208) 555-1177 +1 (208) 555-1178", "+1 (208) 555-1177 00d9ceff5950", "+1 (208) 555-1177", "no +1 (208)", "none", "",
]


def test_phone_shapes_before_another_number(spark, tmp_path):
    ours, theirs = both(spark, documents(spark, tmp_path / "sf", PHONES), "phone_shapes")
    assert ours == theirs and [n for _, n, _ in ours] == [1, 1, 1, 1, 2, 1, 1]


def test_whole_phone_numbers_leave_other_findings_as_they_were():
    kinds = lambda text: [(f.kind, f.text) for f in pii.detect(text)]
    assert kinds(PHONES[1]) == [("phone", "+1 (836) 555-9331"), ("ip", "53.121.55.90")]
    assert kinds("+1 (208) 555-11775") == [("phone", "+1 (208) 555-11775")] and kinds("+1 (208) 555-1177x") == []
    assert kinds("+49 170 1234567") == [("phone", "+49 170 1234567")] and kinds("(030) 123456") == [("phone", "(030) 123456")]


def test_pii_by_kind_with_numbers_side_by_side(spark, tmp_path):
    ours, theirs = both(spark, documents(spark, tmp_path / "sf", PHONES), "pii_by_kind")
    assert ours == theirs and dict(ours) == {"phone": 8, "ip": 3}


def test_run_totals_with_numbers_side_by_side(spark, tmp_path):
    ours, theirs = both(spark, documents(spark, tmp_path / "sf", PHONES), "run_totals")
    assert ours == theirs


def test_cues_are_no_pieces_of_words_cut_by_the_window():
    kinds = lambda text: [f.text for f in pii.detect(text, pii.PiiOptions(("phone",), context_window=8))]
    assert kinds("als 16.154.196.162 so der telicher") == [] and kinds("ein hotel ja is 16.154.196.162") == []
    assert kinds("1701234567 so der telicher") == [] and kinds("1701234567 nur so tel") == [] and kinds("1701234567 so, tel") == ["1701234567"]
    assert kinds("hotel is 1701234567") == [] and kinds("tel geht 1701234567") == [] and kinds("tel ja: 1701234567") == ["1701234567"]


def test_first_samples_goes_to_python_once_and_in_small_batches(spark, tmp_path, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(columns, "BATCH_BYTES", 64 << 10)
    sf = documents(spark, tmp_path / "sf", [("so a bitch is " if i % 7 == 0 else "all is well ") + "x" * 1000 for i in range(900)])
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        rows = queries.first_samples(spark, sf)
        assert spark.conf.get(key) == str(64 << 10)
        assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        assert [tuple(r) for r in rows.collect()] == [(7 * i, True) for i in range(20)]
        rows_of = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
        sent = [r.n for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").mapInArrow(rows_of, "n long").collect()]
        assert max(sent) < 200 and sum(sent) == 900
        spark.conf.set(key, "1000000")
        queries.first_samples(spark, sf)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_what_the_sql_of_cards_and_addresses_has_otherwise():
    """REPLY_r03: digits of a secret are no card, and don't hide the one behind it; versions are no addresses, and both of two addresses are found."""
    found = lambda text: [(f.kind, f.text) for f in pii.detect(text)]
    assert found('token = "ef4036945a4549410493623f4251ef044b32630c"') == []
    assert found("password=89c4eb5d8bab4f7ac9 4868212564805657") == [("card", "4868212564805657")]
    assert found("the Apache License, Version 67.3.169.251 2.0.") == [] and found("the 67.3.169.251 2.0") == [("ip", "67.3.169.251")]
    assert found("reth, 47.129.145.209 108.13.130.27 de") == [("ip", "47.129.145.209"), ("ip", "108.13.130.27")]
