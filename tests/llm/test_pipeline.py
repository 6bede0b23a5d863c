"""The pipeline, stage by stage, against brute force and on odd tables."""

import importlib.util

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import anchors, crf, rule_ensemble

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)

import corpus_pipeline as P

from .test_brute_force import plain_found, shingles_of, statistics_of
from .test_operators import groups_of_all_pairs

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "The thing was here, and the other was there with it. " * 8_000
ODD = [
    (1, "The quick ship was on the river, and the others went with it to the old town.", "en", "s", 10), (1, "The quick ship was on the river, and the others went with it to the old town.", "en", "s", 10),
    (2, None, "en", None, None), (3, "", None, "s", 0), (4, "  \n", "en", "s", 3), (None, "A ship was on the river, and others came to the town.", None, None, None), (None, None, None, None, None),
    (5, LONG, "en", "s", len(LONG)), (6, "!!! ###", "", "s", 7), (7, "write to a.b@c.example.com, and she will come to the town with the others", "en", "s", 1), (8, "Ganz etwas anderes steht in diesem schönen Satz, und das ist gut.", "de", "s", 1),
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages_on_an_empty_table(spark, name, stage):
    out = stage(spark, spark.createDataFrame([], SCHEMA), SF)
    assert out.count() == 0 and (name == "packing" or out.columns == list(P.COLUMNS))


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages_on_odd_rows_with_clashing_columns(spark, name, stage):
    docs = spark.createDataFrame(ODD, SCHEMA)
    for i, extra in enumerate(("k", "keep", "score", "nth", "statistics", "group_id", "bands", "found", "share", "t", "l", "n")):
        docs = docs.withColumn(extra, F.lit(i))
    got = rows(stage(spark, docs, SF))
    texts = [r[1] for r in got]
    if name == "quality":
        assert all(t is not None and t.strip() for t in texts) and LONG in texts and sum(r[0] == 1 for r in got) in (0, 2)
    elif name == "language":
        assert LONG in texts and texts.count(ODD[0][1]) == 2 and None not in texts and "" not in texts
    elif name == "near_duplicates":
        assert [r[0] for r in got if r[0] is not None] == [1, 2, 3, 4, 5, 6, 7, 8] and sum(r[0] is None for r in got) == 2
    elif name == "personal_data":
        assert len(got) == len(ODD) and any(t and "write to [EMAIL]," in t for t in texts) and all(r[4] == (None if r[1] is None else len(r[1])) for r in got)
    else:
        docs_in = {d for r in got for d in r[2]}
        assert docs_in == {1, None, 4, 5, 6, 7, 8}


def test_every_stage_does_what_brute_force_does(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        before = {r.doc_id: r for r in docs.collect()}
        if name == "packing":
            assert {d for r in after.collect() for d in r.doc_ids} == set(before)
            break
        got = kept[name] = {r.doc_id: r for r in after.collect()}
        assert after.columns == list(P.COLUMNS) and after.count() == len(got)
        if name == "quality":
            model = rule_ensemble.fitted(docs, labels)
            x = np.array([statistics_of(r.text) for r in before.values()]).round(6)
            assert set(got) == {d for d, p in zip(before, model.probability(x)) if p >= rule_ensemble.THRESHOLD}
            good = {r.doc_id for r in labels.where("quality = 1").collect()} & set(before)
            assert len(good & set(got)) >= 0.98 * len(good)
        elif name == "language":
            shares = {r.doc_id: r.share for r in crf.identified(docs).collect()}
            assert set(got) == {d for d, s in shares.items() if s >= crf.MIN_SHARE}
        elif name == "near_duplicates":
            sets = {d: shingles_of(r.text) for d, r in before.items()}
            like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
            for d in before:
                if d in got:
                    assert not any(o != d and like(o, d) >= 0.65 for o in got)
                else:
                    assert any(o != d and like(o, d) >= 0.45 for o in before)
        else:
            for d, r in got.items():
                spans = plain_found(before[d].text)
                assert r.text == anchors.redact(before[d].text, spans) and r.n_chars == len(r.text) and not anchors.find(r.text)
            assert set(got) == set(before)
        docs = after
    covered = lambda df: sorted(x for r in df.collect() for x in zip(r.doc_ids, r.starts, r.lengths))
    total = lambda pieces: {d: sum(n for e, _, n in pieces if e == d) for d, _, _ in pieces}
    assert total(covered(P.run(spark, SF))) == total(covered(after))


def test_near_duplicates_keeps_one_of_each_group_of_all_pairs(spark):
    """Passages in common: many documents are joined only through one that is no leader."""
    rng = np.random.default_rng(11)
    passages = [" ".join(f"s{i}x{j}" for j in range(8)) for i in range(60)]
    texts = [" . ".join(s for s, k in zip(passages, rng.random(60) < 0.62) if k) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = rows(P.near_duplicates(spark, docs, SF))
    assert sorted(r[0] for r in got) == sorted(set(groups_of_all_pairs(texts))) and all(r[1] == texts[r[0]] for r in got)


def test_near_duplicates_finds_every_link_above_the_threshold(spark):
    """Pairs of similarity 0.63: 32 buckets of four values leave out about one of 240."""
    text = lambda i, own: " ".join([f"w{i}x{j}" for j in range(78)] + [f"{own}{i}x{j}" for j in range(22)])
    texts = [text(i // 2, "ab"[i % 2]) for i in range(4000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, SF).select("doc_id").collect()) == list(range(0, 4000, 2))


def test_near_duplicates_with_an_id_of_which_one_row_is_empty(spark):
    """Documents that are joined only through others are compared again; what has no words takes no part."""
    passages = [" ".join(f"s{i}x{j}" for j in range(8)) for i in range(60)]
    rng = np.random.default_rng(11)
    texts = [" . ".join(s for s, k in zip(passages, rng.random(60) < 0.62) if k) for _ in range(300)]
    odd = [(i, "", "en", "s", 0) for i in range(0, 300, 3)] + [(i, None, "en", "s", None) for i in range(1, 300, 3)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + odd, SCHEMA)
    assert sorted({r[0] for r in rows(P.near_duplicates(spark, docs, SF))}) == sorted(set(groups_of_all_pairs(texts)))


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages_send_texts_to_python_in_small_batches(spark, name, stage):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("some text "), 4000).alias("t"))
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        stage(spark, spark.createDataFrame([], SCHEMA), SF)
        sent = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
        assert max(sent) < 6 << 20 and sum(sent) > 15 << 20
        spark.conf.set(key, "64m")
        stage(spark, spark.createDataFrame([], SCHEMA), SF)
        assert spark.conf.get(key) == "64m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
