"""Queries against brute force: plain Python over the rows, written independently of the operators."""

import base64
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from sparkwarden.llm import anchors, bpe, crf, minhash, packing, queries, rule_ensemble, tokenbits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(bpe.DEFAULT_VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def words_of(text: str, fold: bool) -> list[bytes]:
    return re.findall(rb"[0-9a-zA-Z\x80-\xff]+", "".join(c.lower() if fold and c.isascii() else c for c in text).encode())


def statistics_of(text: str) -> list[float]:
    words = words_of(text, False)
    if not words:
        return [0.0] * len(rule_ensemble.STATISTICS)
    n, data = len(words), text.encode()
    beyond = sum(c > "\x7f" for c in text)
    wide = sum(b >= 192 for b in data)
    letters = max(1, sum(c.isascii() and c.isalpha() for c in text) + beyond)
    each = lambda c: text.count(c) / n
    return [
        n, sum(map(len, words)) / n, max(map(len, words)), sum(c.isascii() and c.isupper() for c in text) / letters, sum(c.isascii() and c.isdigit() for c in text) / n,
        sum(c in "#$%&*+/<=>@[\\]^_`{}~" for c in text) / n, each("!"), each("|"), each("."), each(","), each("\n"), len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, wide / letters,
    ]


def test_op1_is_the_sum_of_its_rules_over_plain_counts(spark, rows):
    df, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = rule_ensemble.fitted(df, labels)
    assert model.rules
    got = Counter((r.doc_id, r.score, r.keep) for r in queries.op1_quality(spark, SF).collect())
    want = Counter()
    for doc, text, _ in rows:
        s = [round(x, 6) for x in statistics_of(text or "")]
        z = model.intercept + sum(w for rule, w in model.rules if all((s[j] > v) == above for j, above, v in rule.conditions))
        score = round(1 / (1 + math.exp(-z)), 6) if s[0] else 0.0
        want[(doc, score, score >= rule_ensemble.THRESHOLD)] += 1
    assert got == want


def test_op1_separates_labels_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null")
    half = labels.where("pmod(doc_id, 2) = 0")
    scored = rule_ensemble.scored(df, half).join(labels.where("pmod(doc_id, 2) = 1"), "doc_id").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in scored]) >= 0.99
    assert np.mean([r.keep for r in scored if r.quality == 1]) >= 0.99


def test_equal_texts_score_alike_at_any_length(spark):
    text = "A quiet street, and a long way home. " * 20_000
    df = spark.createDataFrame([(1, text), (2, text), (3, "!!!! $$$$ ####"), (4, text[:400])], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in rule_ensemble.scored(df, labels).collect()}
    assert got[1] == got[2]


class PlainPacker:
    """The same rule without an ordered list."""

    def __init__(self, capacity, most):
        self.capacity, self.most, self.open, self.n = capacity, most, [], 0

    def add(self, size, pieces):
        fits = [w for w in self.open if w[0] >= size]
        out = []
        if fits:
            best = min(fits, key=lambda w: (w[0], w[1]))
        else:
            if len(self.open) >= self.most:
                fullest = min(self.open, key=lambda w: (w[0], w[1]))
                self.open.remove(fullest)
                out.append((self.capacity - fullest[0], fullest[2]))
            best = [self.capacity, self.n, []]
            self.n += 1
            self.open.append(best)
        best[0] -= size
        best[2] += pieces
        if best[0] == 0:
            self.open.remove(best)
            out.append((self.capacity, best[2]))
        return out

    def close(self):
        return [(self.capacity - w[0], w[2]) for w in sorted(self.open, key=lambda w: (w[0], w[1]))]


def test_op2_chooses_the_windows_that_the_rule_says(spark, rows, library):
    """One partition, so that the order of documents is known; then leftovers are packed again, the fullest first."""
    ordered = sorted(rows, key=lambda r: r[0])
    df = spark.createDataFrame([r[:2] for r in ordered], "doc_id long, text string").coalesce(1)
    got = sorted((r.n_tokens, list(zip(r.doc_ids, r.starts, r.lengths))) for r in packing.pack(df, capacity=512, open_windows=4).collect())
    packer, done = PlainPacker(512, 4), []
    for doc, text, _ in ordered:
        size, start = len(library.encode_ordinary(text or "")), 0
        while size - start >= 512:
            done.append((512, [(doc, start, 512)]))
            start += 512
        if size > start:
            done += packer.add(size - start, [(doc, start, size - start)])
    again = PlainPacker(512, 4)
    for n, pieces in sorted(packer.close(), key=lambda w: (-w[0], [p[0] for p in w[1]], [p[1] for p in w[1]])):
        done += again.add(n, pieces)
    assert got == sorted(done + again.close())


def test_op2_and_op3_hold_every_token_of_every_document(spark, rows, library):
    want = {doc: library.encode_ordinary(text or "") for doc, text, _ in rows}
    pieces: dict = {}
    for r in queries.op2_packing(spark, SF).collect():
        assert sum(r.lengths) == r.n_tokens <= 2048
        for doc, start, n in zip(r.doc_ids, r.starts, r.lengths):
            pieces.setdefault(doc, []).append((start, n))
    for doc, ids in want.items():
        own = sorted(pieces.get(doc, []))
        assert [s for s, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) == len(ids)
    seen = {}
    for r in queries.op3_token_bits(spark, SF).collect():
        payload = bytes(r.payload)
        magic, bits, count, blocks = payload[:4], int.from_bytes(payload[4:6], "little"), int.from_bytes(payload[8:16], "little"), int.from_bytes(payload[16:24], "little")
        offsets = [int.from_bytes(payload[24 + 8 * i : 32 + 8 * i], "little") for i in range(blocks + 1)]
        ids = []
        for a, b in zip(offsets, offsets[1:]):
            number = int.from_bytes(payload[a:b], "little")
            ids += [(number >> (bits * i)) & ((1 << bits) - 1) for i in range(min(tokenbits.BLOCK, count - len(ids)))]
        assert magic == tokenbits.MAGIC and bits == 16 and r.n_tokens == count == len(ids)
        for doc, a, b in zip(r.doc_ids, r.doc_starts, r.doc_starts[1:]):
            seen[doc] = ids[a:b]
    assert seen == want


def plain_found(text: str) -> list[tuple[int, int, str]]:
    """Every parser at every position that its anchor stands at, found by plain search."""
    low = "".join(c.lower() if len(c.lower()) == 1 else ("i" if c == "İ" else c) for c in text)
    out = []
    put = lambda kind, span: out.append((*span, kind)) if span else None
    addresses, values = anchors.Runs(text, anchors._URL, ".,;:!?)]*#$%&"), anchors.Runs(text, anchors._VALUE, anchors._TAIL)
    cues = {}
    for words, kind in ((anchors.SECRET_CUES, "secret"), (anchors.ACCOUNT_CUES, "account"), (anchors.PHONE_CUES, "phone")):
        for cue in words:
            for joint in (" ", "-", "_", ""):
                if kind != "phone" or joint == " ":
                    for form in ("NFC", "NFD"):
                        cues[unicodedata.normalize(form, re.sub("[ _-]", joint, cue) if cue != "mot de passe" else cue)] = kind
    for m in re.finditer(r"[0-9a-fA-F:.]*:[0-9a-fA-F:.]*", text):
        lo = m.start()
        while text[lo : lo + 1] == ".":
            lo += 1
        for start in [lo, *(i + 1 for i in range(lo, m.end()) if text[i] == ".")]:
            put("ip", anchors._ip6(text, start, m.end()) if start < m.end() else None)
    for i, c in enumerate(text):
        if c.isdigit() and c.isascii() and not (i and text[i - 1].isdigit()):
            put("ip", anchors._ip4(text, i))
            put("card", anchors._card(text, i))
            put("iban", anchors._iban(text, i))
            m = re.compile(r"\d{3}-\d{2}-\d{4}").match(text, i)
            put("ssn", m.span() if m and anchors._SSN.match(text, i) and anchors._bounded(text, *m.span()) else None)
        put("email", anchors._email(text, i) if c == "@" else None)
        put("phone", anchors._phone(text, i, False) if c == "+" else None)
        put("url", anchors._url(text, i + 3, addresses) if text.startswith("://", i) else None)
        for prefix in anchors.KEY_PREFIXES:
            if text.startswith(prefix, i) and not (i and text[i - 1].isalnum()):
                m = (anchors._BLOCK if prefix[0] == "-" else anchors._KEY).match(text, i)
                put("secret", m.span() if m and (prefix[0] == "-" or any(x.isdigit() for x in m.group())) else None)
        for cue, kind in cues.items():
            end = i + len(cue)
            if low.startswith(cue, i) and not text[end : end + 1].isalpha() and not (i and text[i - 1].isalpha()):
                if kind == "secret":
                    put("secret", anchors._secret(text, end, text[i:end], values))
                elif kind == "account":
                    m = anchors._ACCOUNT.match(text, end)
                    put("account", m.span("v") if m and anchors._bounded(text, *m.span("v")) else None)
                else:
                    put("phone", anchors._phone(text, anchors._TO_PHONE.match(text, end).end(), True))
    kept = []
    for a, b, kind in sorted(set(out), key=lambda x: (x[0], -x[1], anchors.KINDS.index(x[2]))):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b, kind))
    return kept


PARTS = ["a.b@c.example.com", "+1 (614) 555-8001", "10.0.0.1", "2001:db8::1", "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "123-45-6789", "account number: 12345678", "token=abcd1234efgh", "PassWord: \"x9x9x9x9x9\"", "https://u:pw1@h.example/x", "ghp_0123456789abcdefghij", "tel: 030 1234567", "v 1.2.3.4", "::", "@", "+", "://", "12:30", "2024-05-01", "Müller", "…", "1", "44", ".", "-", "::ffff:1.2.3.4", "x" * 30]


def test_op4_finds_what_a_look_at_every_position_finds(spark, rows):
    rng = random.Random(8)
    texts = [t or "" for _, t, _ in rows] + ["".join(rng.choice(PARTS) + rng.choice(["", " ", " ", ", ", "/"]) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    for text in texts:
        assert anchors.find(text) == plain_found(text), text
    got = {r.doc_id: (r.n_found, [tuple(f) for f in r.found], r.text) for r in queries.op4_personal_data(spark, SF).collect()}
    for doc, text, _ in rows:
        spans = plain_found(text or "")
        out, at = "", 0
        for a, b, kind in spans:
            out, at = out + (text or "")[at:a] + f"[{kind.upper()}]", b
        assert got[doc] == (len(spans), [(k, a, b) for a, b, k in spans], out + (text or "")[at:])


def plain_hash(word: bytes) -> int:
    from sparkwarden.llm import arrays

    total, power = len(word), 1
    for b in word:
        total += int(arrays.BYTE_VALUES[b]) * power
        power = power * int(arrays.BASE) % 2**64
    return plain_mix(total % 2**64) | 1 << 63


def plain_mix(h: int) -> int:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53), (32, 1)):
        h = (h ^ h >> shift) * factor % 2**64
    return h


def test_op5_counts_hashes_and_thresholds_as_plain_numbers_do(spark, rows):
    from sparkwarden.llm import arrays, ngram_ratio

    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    trusted = {r.doc_id for r in labels if r.quality == 1 and not r.toxic}
    buckets, known = ngram_ratio.BUCKETS, {}
    raw, target, own = Counter(), Counter(), {}
    for doc, text, _ in rows:
        hashes = []
        for token in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t-\r ]+", (text or "").encode()):
            if token not in known:
                known[token] = plain_hash(token)
            hashes.append(known[token])
        pairs = [plain_mix((a * int(arrays.BASE) + b) % 2**64) for a, b in zip(hashes, hashes[1:])]
        own[doc] = [(h >> 7) % buckets for h in hashes + pairs]
        raw.update(own[doc])
        if doc in trusted:
            target.update(own[doc])
    all_raw, all_target = sum(raw.values()) + buckets, sum(target.values()) + buckets
    ratio = lambda b: math.log((target[b] + 1) / all_target) - math.log((raw[b] + 1) / all_raw)
    scores = {d: sum(map(ratio, at)) / len(at) if at else 0.0 for d, at in own.items()}
    good = sorted(round(scores[d], 4) for d in trusted & set(own) if own[d])
    least = good[int(0.005 * len(good))]
    got = {r.doc_id: r for r in queries.op5_ngram_ratio(spark, SF).collect()}
    assert set(got) == set(own)
    for d, r in got.items():
        assert r.n_grams == len(own[d]) and abs(r.score - scores[d]) < 1.01e-4
        assert r.keep == (r.n_grams > 0 and r.score >= least - 1e-9) or abs(scores[d] - least) < 2e-4


def test_op7_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op7_near_duplicates"]).fetchall())
    assert sorted((r.doc_id, r.group_id, r.keep) for r in queries.op7_near_duplicates(spark, SF).collect()) == want


def shingles_of(text: str) -> frozenset:
    words = words_of(text, True)
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2)) if len(words) >= 3 else frozenset([tuple(words)] if words else [])


def test_op7_against_exact_similarity(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sets = {d: shingles_of(t or "") for d, t in texts.items()}
    where: dict = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    common: Counter = Counter()
    for own in where.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                common[(a, b)] += 1
    jaccard = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in common.items()}
    got = {r.doc_id: r for r in queries.op7_near_duplicates(spark, sf).collect()}
    assert set(got) == set(texts)
    sure, possible = {d: d for d in texts}, {d: d for d in texts}

    def root(of, x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for (a, b), j in jaccard.items():
        for of, least in ((sure, 0.62), (possible, 0.49)):
            if j >= least:
                a_, b_ = root(of, a), root(of, b)
                of[max(a_, b_)] = min(a_, b_)
    for d, r in got.items():
        assert got[root(sure, d)].group_id == r.group_id, "alike but apart"
        assert root(possible, d) == root(possible, r.group_id), "together but unlike"
        assert r.keep == (r.group_id == d) and r.group_id <= d
    assert sum(r.keep for r in got.values()) < len(got)


def test_op7_takes_very_long_texts_whole(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(50_000)}" for _ in range(60_000)]
    late = words[:59_000] + [f"z{i}" for i in range(1_000)]
    other = words[:20_000] + [f"y{i}" for i in range(40_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(late)), (3, " ".join(other))], "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in minhash.groups(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_op8_is_the_library_s_encoding(spark, rows, library):
    got = {r.doc_id: r for r in queries.op8_bpe(spark, SF).collect()}
    for doc, text, _ in rows:
        assert list(got[doc].token_ids) == library.encode_ordinary(text or "") and got[doc].restored and got[doc].n_tokens == len(got[doc].token_ids)


def test_op9_is_forward_backward_over_each_document_alone(spark, rows):
    import pyarrow as pa

    from sparkwarden.llm import arrays

    model = crf.fitted(spark.read.parquet(f"{SF}/documents.parquet"))
    a, pi = np.exp(model.transitions), np.exp(model.initial)
    got = {r.doc_id: r for r in queries.op9_language(spark, SF).collect()}
    for doc, text, _ in rows[:120]:
        data, offsets = arrays.raw(arrays.text_column(pa.array([text], pa.string())))
        hashes, start, end, counts = arrays.words(data, offsets)
        if not counts[0]:
            assert got[doc].lang is None and not got[doc].accepted
            continue
        emit = np.exp(crf.word_scores(model.weights, *crf.word_features(data, start, end, hashes)).astype(float))
        forward = [pi * emit[0]]
        for e in emit[1:]:
            forward.append(forward[-1] / forward[-1].sum() @ a * e)
        backward = [np.ones(len(pi))]
        for e in emit[:0:-1]:
            b = a @ (e * backward[-1])
            backward.append(b / b.sum())
        p = np.array(forward) * np.array(backward[::-1])
        share = (p / p.sum(1, keepdims=True)).mean(0)
        r = got[doc]
        assert abs(r.share - share.max()) < 2e-4 and r.n_words == counts[0]
        assert r.lang == model.languages[int(share.argmax())] or np.sort(share)[-1] - np.sort(share)[-2] < 3e-4
        assert r.accepted == (r.share >= crf.MIN_SHARE)


def test_op9_learns_forty_languages(spark):
    rng = random.Random(3)
    parts = [["".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(2, 3))) for _ in range(25)] for _ in range(40)]
    word = lambda i: "".join(rng.choice(parts[i]) for _ in range(rng.randint(1, 3)))
    data = [(40 * n + i, " ".join(word(i) for _ in range(60)), f"l{i:02}") for n in range(8) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in crf.identified(df, sample_words=24_000).collect()}
    assert np.mean([got[d] == lang for d, _, lang in data]) > 0.97 and len(set(got.values())) == 40
    few = {r.lang for r in crf.identified(df, sample_words=24_000, max_languages=3).collect()}
    assert len(few) == 3
