"""Operators on tables: edge cases, and the pipeline."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import anchors, bpe, crf, minhash, ngram_ratio, packing, queries, rotated_codes, rule_ensemble, sharding, tokenbits

LONG = "the thing was here and there " * 20_000
GOOD = "The quick ship was on the river, and the others went with it to the old town. "
ROWS = [
    (1, GOOD, "en"), (2, GOOD, "en"), (3, GOOD.replace("river", "sea"), "en"), (4, None, "en"), (5, "", "en"), (6, "   ", None), (7, LONG, "en"),
    (8, "write to a.b@c.example.com please", "en"), (None, GOOD + "Null id.", "en"), (9, "einzeln", "de"), (9, "einzeln", "de"), (10, "!!! &&& ###", ""), (11, "Ganz etwas anderes steht in diesem schönen Satz.", "de"),
]
SCHEMA = "doc_id long, text string, lang string"
CLASH = ["k", "keep", "score", "nth", "statistics", "trusted", "bands", "group_id", "found"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for i, name in enumerate(CLASH):
        df = df.withColumn(name, F.lit(i))
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, None), (10, 0, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda x: (x is None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_quality(docs, labels, none):
    rows = {(r.doc_id): r for r in rule_ensemble.scored(docs, labels).collect()}
    assert ids(rule_ensemble.scored(docs, labels)) == ALL
    assert not rows[4].keep and not rows[5].keep and rows[4].score == 0
    kept = rule_ensemble.filtered(docs, labels)
    assert kept.columns == docs.columns
    assert ids(kept) == sorted([k for k, r in rows.items() if r.keep for _ in range(2 if k == 9 else 1)], key=lambda x: (x is None, x))
    assert rule_ensemble.scored(none, labels).count() == 0
    free = rule_ensemble.scored(docs, labels.limit(0)).where("keep")
    assert set(ids(free)) == {1, 2, 3, 7, 8, 9, 11, None}


def test_compiled_rules_are_the_model(docs):
    rng = np.random.default_rng(1)
    x = rng.random((800, len(rule_ensemble.STATISTICS))).round(6)
    model = rule_ensemble.trained(x, (x[:, 2] + x[:, 4] > 1).astype(int))
    spark = docs.sparkSession
    df = spark.createDataFrame([(r.tolist(),) for r in x], "s array<double>")
    got = [r[0] for r in df.select(model.column(F.col("s"))).collect()]
    assert np.allclose(got, model.probability(x))


def test_packing_covers_every_token_once(docs, none):
    rows = packing.pack(docs, capacity=64, open_windows=3).collect()
    assert all(r.n_tokens == sum(r.lengths) <= 64 for r in rows)
    assert len({r.window_id for r in rows}) == len(rows)
    pieces = sorted((d if d is not None else -1, s, n) for r in rows for d, s, n in zip(r.doc_ids, r.starts, r.lengths))
    counts = {(-1 if r.doc_id is None else r.doc_id): r.n_tokens for r in bpe.encode_decode(docs).collect()}
    for doc, n in counts.items():
        own = [(s, k) for d, s, k in pieces if d == doc]
        own = sorted(set(own)) if doc == 9 else own
        assert sum(k for _, k in own) == n and [s for s, _ in own] == list(np.cumsum([0] + [k for _, k in own])[:-1]) if n else own == []
    assert packing.pack(none).count() == 0


def test_token_bits_round_trip(docs, none):
    blobs = tokenbits.packed_tokens(docs, blob_tokens=50)
    got = sorted((str(r.doc_id), list(r.token_ids)) for r in tokenbits.unpacked(blobs).collect())
    want = sorted((str(r.doc_id), list(r.token_ids)) for r in bpe.encode_decode(docs).collect())
    assert got == want and len(got) == len(ROWS)
    assert tokenbits.packed_tokens(none).count() == 0


def test_bpe_restores_every_text(docs, none):
    rows = bpe.encode_decode(docs).collect()
    assert len(rows) == len(ROWS) and all(r.restored for r in rows)
    assert all(r.n_tokens == 0 for r in rows if r.doc_id in (4, 5))
    assert bpe.encode_decode(none).count() == 0


def test_private_data(docs, none):
    rows = {r.doc_id: r for r in anchors.detected(docs).collect()}
    assert rows[8].text == "write to [EMAIL] please" and rows[8].found[0][:2] == ("email", 9)
    assert rows[4].text is None and rows[5].text == "" and rows[7].text == LONG and rows[1].n_found == 0
    assert anchors.redacted(docs).columns == docs.columns
    assert anchors.detected(none).count() == 0


def test_ngram_ratio_against_brute_force(docs, labels, none):
    got = sorted((str(r.doc_id), r.n_grams, r.score, r.keep) for r in ngram_ratio.thresholded(docs, labels, buckets=257).collect())
    import pyarrow as pa

    from sparkwarden.llm import arrays

    raw, target, own = np.zeros(257), np.zeros(257), []
    for doc, text, _ in ROWS:
        at, _ = ngram_ratio.grams(arrays.text_column(pa.array([text], pa.string())), 257)
        raw += np.bincount(at, minlength=257)
        target += np.bincount(at, minlength=257) * (doc in (1, 2))
        own.append((doc, at))
    ratio = np.log((target + 1) / (target.sum() + 257)) - np.log((raw + 1) / (raw.sum() + 257))
    scores = [(doc, len(at), round(float(ratio[at].mean()), 4) if len(at) else 0.0) for doc, at in own]
    least = min(s for d, _, s in scores if d in (1, 2))
    want = sorted((str(d), n, s, n > 0 and s >= least) for d, n, s in scores)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1.01e-4)
    assert all(r.keep == (r.n_grams > 0) for r in ngram_ratio.thresholded(docs, labels.limit(0)).collect())
    far = lambda df: df.withColumn("doc_id", F.col("doc_id") * 1_000_003 - 4_000_000)
    for some, known, blocks in ((docs, labels, 0), (far(docs), far(labels), 8192)):
        assert sorted((r.n_grams, r.score, r.keep) for r in ngram_ratio.thresholded(some, known, buckets=257, broadcast_blocks=blocks).collect()) == sorted(g[1:] for g in got)
    assert ngram_ratio.thresholded(none, labels).count() == 0


@pytest.mark.parametrize("clustered,every,options", [(True, 1, {"part_rows": 100, "part_queries": 200}), (True, 5, {}), (False, 3, {"part_rows": 50, "bits": 64})])
def test_neighbours_against_brute_force(spark, clustered, every, options):
    rng = np.random.default_rng(7)
    center = rng.standard_normal((12, 24))
    x = (center[rng.integers(0, 12, 900)] * clustered + 0.4 * rng.standard_normal((900, 24))).astype(np.float32)
    x[5] = x[6] = x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2, x[2].tolist()), (None, x[0].tolist()), (1000, None), (1001, []), (1002, [0.0] * 24), (1003, [1.0, 2.0]), (1004, [float("nan")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("v", "cell", "q", "block", "share", "rank"):
        df = df.withColumn(name, F.lit(1))
    got: dict = {}
    for r in rotated_codes.neighbours(df, k=10, every=every, **options).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbour_id, r.similarity)
    asked = range(0, 900, every)
    assert set(got) == set(asked) and all(sorted(v) == list(range(1, 11)) for v in got.values())
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    top = np.argsort(-s, axis=1)[:, :10]
    recall = np.mean([len({n for n, _ in got[i].values()} & set(top[i].tolist())) / 10 for i in asked])
    assert recall >= 0.9
    assert all(abs(s[i, n] - v) < 2e-6 for i, own in got.items() for n, v in own.values())
    if every == 1:
        assert got[4][1][0] == 5 and got[4][2][0] == 6 and abs(got[4][1][1] - 1) < 1e-5
        few = rotated_codes.neighbours(df.where("vec_id < 3"), k=10, every=1).collect()
        assert len(few) == 6
        assert rotated_codes.neighbours(df.limit(0)).count() == 0 and rotated_codes.neighbours(df.where("vec_id = 1"), every=1).count() == 0
        assert rotated_codes.neighbours(df.where("vec_id between 1 and 9")).count() == 0


def test_near_duplicates(spark, docs, none):
    rows = {r.doc_id: r for r in minhash.groups(docs).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert rows[2].group_id == rows[1].group_id == 1 and rows[1].keep and not rows[2].keep
    assert all(rows[i].keep for i in (4, 5, 6, 7, 8, 9, 10, 11))
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns and ids(kept).count(9) == 1 and None in ids(kept) and 2 not in ids(kept)
    assert ids(minhash.deduplicated(docs, broadcast_ids=0)) == ids(kept)
    assert minhash.groups(none).count() == 0 and minhash.deduplicated(none).count() == 0


def test_near_duplicates_find_pairs_of_high_similarity(spark):
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(5000)])
    texts, true = [], []
    for g in range(60):
        base = rng.choice(words, 300)
        texts.append(" ".join(base))
        copy = base.copy()
        copy[rng.choice(300, 8, replace=False)] = rng.choice(words, 8)
        texts.append(" ".join(copy))
        true.append((2 * g, 2 * g + 1))
    texts += [texts[0]] * 500  # a hot group
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r.doc_id: r.group_id for r in minhash.groups(df).collect()}
    assert np.mean([group[a] == group[b] for a, b in true]) >= 0.95
    assert len(set(group.values())) >= 60 and all(group[i] == 0 for i in range(120, 620))
    # Blocks of three rows: the same groups, put together across blocks.
    assert {r.doc_id: r.group_id for r in minhash.groups(df, block=3).collect()} == group


def test_near_duplicates_in_blocks_of_a_hot_bucket(spark):
    rng = np.random.default_rng(2)
    common = " ".join(f"c{i}" for i in range(40))
    texts = [common + "".join(f" u{d // 2 if d % 5 else d}x{i}" for i in range(int(rng.integers(26, 30)))) for d in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in minhash.groups(df, block=20).collect()} == {tuple(r) for r in minhash.groups(df).collect()}


def groups_of_all_pairs(texts):
    """For each text the first of those that it is joined to, by comparing all pairs that share a bucket."""
    _, signature = minhash.signatures(pa.array(texts, pa.large_string()), 3, minhash.CHECKED)
    codes, bands, most = minhash.packed(signature), minhash.band_hashes(signature[:, :128], 4), int(minhash.CHECKED * 0.45 * 0.75)
    group = np.arange(len(texts))
    for i in range(len(texts)):
        like = (minhash.different(codes, codes[[i]]) <= most) & (bands == bands[i]).any(1)
        for g in np.unique(group[like]):
            group[np.isin(group, (g, group[i]))] = min(g, group[i])
    return group.tolist()


@pytest.mark.parametrize("block", [8192, 40])
def test_near_duplicates_lose_no_link_of_a_document_that_is_no_leader(spark, block):
    """Documents of passages in common, many of which are alike only through others."""
    rng = np.random.default_rng(4)
    passages = [" ".join(f"s{i}x{j}" for j in range(8)) for i in range(60)]
    texts = [" . ".join(s for s, k in zip(passages, rng.random(60) < 0.62) if k) for _ in range(300)]
    want = groups_of_all_pairs(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [g for _, g in sorted((r.doc_id, r.group_id) for r in minhash.groups(df, block=block).collect())] == want


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.doc_id: r.group_id for r in minhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}


def test_language(docs, none):
    rows = {r.doc_id: r for r in crf.identified(docs).collect()}
    assert rows[4].lang is None and not rows[4].accepted and rows[4].spans == [] and rows[10].n_words == 0
    assert rows[1].lang == "en" and rows[11].lang == "de"
    assert all(sum(s.words for s in r.spans) == r.n_words for r in rows.values())
    kept = crf.filtered(docs)
    assert kept.columns == docs.columns
    assert set(ids(kept)) == {k for k, r in rows.items() if r.accepted}
    assert crf.identified(none).count() == 0
    bare = crf.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.lang is None and r.accepted == (r.n_words > 0) for r in bare)


def test_sharding_by_brute_force(docs, none):
    rows = sharding.shard(docs.where("doc_id is null or doc_id <> 7"), "doc_id", shards=3, block=2).collect()
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    sizes = [r.group_size for r in order]
    assert [r.shard for r in order] == sorted(r.shard for r in order)
    loads = [sum(r.group_size for r in order if r.shard == s) for s in range(3)]
    cuts = [(i, j) for i in range(len(sizes) + 1) for j in range(i, len(sizes) + 1)]
    assert max(loads) == min(max(sum(sizes[:i]), sum(sizes[i:j]), sum(sizes[j:])) for i, j in cuts)
    assert sharding.shard(none).count() == 0


def test_intermediate_tables_go(spark, monkeypatch):
    import os

    from sparkwarden.llm import storage

    one, two = (storage.stored(spark.range(3), "kept") for _ in range(2))
    where = storage.folder(spark)
    assert where.startswith(spark.conf.get("spark.checkpoint.dir")) and len([x for x in os.listdir(where) if x.startswith("kept-")]) >= 2
    before = len(os.listdir(where))
    storage.dropped(one)
    assert len(os.listdir(where)) == before - 1 and two.count() == 3
    storage.dropped(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))
    assert os.path.exists("/root/testdata/sf0.001/region.parquet")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as S

    from sparkwarden.llm import storage

    spark = S(conf=S(get=lambda *_: None), sparkContext=S(master="local-cluster[2,1,512]", applicationId="a"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.folder(spark)


def test_sharding_needs_a_shard(docs):
    with pytest.raises(ValueError):
        sharding.shard(docs, shards=0)


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
