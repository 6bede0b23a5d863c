"""Language identification of every word by a linear-chain conditional random field.

A word's features are its identity (the lexicon), its prefixes and suffixes of one to
three bytes and its byte n-grams of two to four, all hashed into ``2**BITS`` rows of
weights, one weight a language.  A matrix of learned transitions links neighbours, so
that a word is labelled with regard to those around it: text may change its language
midway.  Forward-backward gives the probability of each language for each word.

Training.  Bounded: chunks of ``CHUNK`` words, drawn by hash from all of the text of at most ``sample_rows``
documents of each language (those with the least hash of their id), ``sample_words`` words in all, shared out
evenly among all languages that occur.  Only these words come to the driver.  They are shuffled into sequences that change
language, which teaches transitions.  ``max_languages`` is None: no language is left out.

Inference works on the words of an Arrow slice as one chain, broken between documents.
The chain is cut into lanes that advance together; the product of each lane's step
matrices carries messages from lane to lane, so the result is exact whatever the length.

Result: ``doc_id, lang, share, n_words, accepted, spans``.  ``lang`` has the largest
expected share of the words, ``share``; ``spans`` are runs of words that are most
probably of one language (``lang, first, words``).  ``accepted`` is
``share >= min_share``.

Edge cases.  Null and empty texts, and texts without a word, have null ``lang``, share
0, no spans, and aren't accepted.  Words without a letter take the language of their
neighbours.  Ties go to the language first in order.  Without any labelled document
``lang`` is null and every text with a word is accepted with share 1.  Repeated rows and
null doc_ids are labelled each for itself; an empty table gives no rows; extra columns are
handed on by :func:`filtered`, ignored by :func:`identified`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays

BITS = 16
SAMPLE_ROWS = 150
SAMPLE_WORDS = 160_000
CHUNK = 40
MIN_SHARE = 0.5
SCHEMA = "doc_id long, lang string, share double, n_words long, accepted boolean, spans array<struct<lang:string,first:int,words:int>>"
_U64 = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, per)``: rows of weights for each word, one word after the other.  Words without a letter have none."""
    size = end - start
    mapped = arrays.FOLDED[data]
    inside = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    letters = mapped[inside]
    first = np.cumsum(size) - size
    some = np.logical_or.reduceat(_LETTER[letters], first)
    # Each word between two marks, all in one array.
    padded_size = size + 2
    at = np.cumsum(padded_size) - padded_size
    line = np.full(int(padded_size.sum()) + 4, 1, np.uint64)
    line[np.repeat(at + 1 - first, size) + np.arange(len(letters))] = letters
    owner = np.repeat(np.arange(len(size)), padded_size)
    place = np.arange(len(owner)) - at[owner]
    left = padded_size[owner] - place  # bytes from here to the end, the mark with it
    keys, owners = [hashes ^ _U64(0x5BD1E995)], [np.arange(len(size))]
    gram = np.zeros(len(owner), np.uint64)
    for n in range(1, 5):
        gram = gram * _U64(257) + line[n - 1 : n - 1 + len(owner)]
        for kind, where in ((n, n > 1), (10 + n, place == 1), (20 + n, left == n + 1)):
            if kind > 10 and n > 3:
                continue
            ok = np.flatnonzero((left >= n) & where) if kind < 10 else np.flatnonzero(where & (left > n))
            keys.append(gram[ok] * _U64(32) + _U64(kind))
            owners.append(owner[ok])
    owner = np.concatenate(owners)
    key = np.concatenate(keys)
    ok = some[owner]
    owner, key = owner[ok], key[ok]
    order = np.argsort(owner, kind="stable")
    return (arrays.mix(key[order]) >> _U64(64 - BITS)).astype(np.int64), np.bincount(owner, minlength=len(size))


def word_scores(weights: np.ndarray, rows: np.ndarray, per: np.ndarray) -> np.ndarray:
    """For each word and language, the mean weight of its features times the root of their number."""
    out = np.zeros((len(per), weights.shape[1]), np.float32)
    some = np.flatnonzero(per)
    if len(some):
        out[some] = np.add.reduceat(weights[rows], (np.cumsum(per) - per)[some], axis=0)
    return out / np.sqrt(np.maximum(per, 1))[:, None].astype(np.float32)


@dataclass
class Chain:
    """Probabilities over one chain of words, broken where ``fresh`` is true."""

    transitions: np.ndarray  # from, to; all positive
    initial: np.ndarray

    def marginals(self, scores: np.ndarray, fresh: np.ndarray, lanes: int | None = None, pairs: bool = False):
        """Probabilities of each word's languages; with ``pairs``, also the sum over neighbours' pairs and the log-likelihood terms."""
        n, k = scores.shape
        width = max(1, int(np.ceil(np.sqrt(n)))) if lanes is None else lanes
        steps = -(-n // width)
        shape = (width, steps)
        e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64) + 1e-30
        emit = np.ones((width * steps, k))
        emit[:n] = e
        emit = np.ascontiguousarray(emit.reshape(*shape, k).transpose(1, 0, 2))
        new = np.zeros(width * steps, bool)
        new[:n] = fresh
        new[n:] = True
        new[0] = True
        new = np.ascontiguousarray(new.reshape(shape).T)
        a, pi = self.transitions, self.initial
        if new[0].all():  # no message crosses from lane to lane
            enter, leave = np.broadcast_to(pi, (width, k)), np.ones((width, k))
        else:
            enter, leave = self._messages(emit, new)
        alpha = np.empty((steps, width, k))
        now = enter
        for t in range(steps):
            now = np.where(new[t][:, None], pi, now @ a) * emit[t]
            now /= now.sum(1, keepdims=True)
            alpha[t] = now
        beta = np.empty((steps, width, k))
        now, back = leave, a.T
        for t in range(steps - 1, -1, -1):
            beta[t] = now
            into = emit[t] * now
            now = np.where(new[t][:, None], (into @ pi)[:, None], into @ back)
            now /= now.sum(1, keepdims=True)
        both = alpha * beta
        both /= both.sum(2, keepdims=True)
        flat = lambda x: x.transpose(1, 0, 2).reshape(width * steps, k)[:n]
        probability = flat(both)
        if not pairs:
            return probability
        before, after = flat(alpha)[:-1], flat(emit)[1:] * flat(beta)[1:]
        linked = ~fresh[1:]
        before, after = before[linked], after[linked]
        return probability, a * ((before / ((before @ a) * after).sum(1, keepdims=True)).T @ after)

    def _messages(self, emit: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What enters each lane from the left and from the right."""
        (steps, width, k), a, pi = emit.shape, self.transitions, self.initial
        # Each lane's product of step matrices, scaled.
        product = np.broadcast_to(np.eye(k), (width, k, k)).copy()
        for t in range(steps):
            moved = product @ a
            if new[t].any():
                rows = np.flatnonzero(new[t])
                moved[rows] = product[rows].sum(2, keepdims=True) * pi
            product = moved * emit[t][:, None, :]
            product /= product.max(axis=(1, 2), keepdims=True)
        enter = np.empty((width, k))
        message = pi.copy()
        for w in range(width):
            enter[w] = message
            message = message @ product[w]
            message /= message.sum()
        leave = np.empty((width, k))
        message = np.ones(k)
        for w in range(width - 1, -1, -1):
            leave[w] = message
            message = product[w] @ message
            message /= message.sum()
        return enter, leave


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray = field(repr=False)
    transitions: np.ndarray
    initial: np.ndarray

    @property
    def chain(self) -> Chain:
        return Chain(np.exp(self.transitions), np.exp(self.initial))


def trained(texts: list[str], langs: list[str], rounds: int = 24, rate: float = 0.35, chunk: int = CHUNK, chunks: int = 8, seed: int = 3) -> Model | None:
    """A model of whole ``texts``, each in one language as far as is known.

    Sequences of ``chunks`` chunks are worked on some at a time, so that memory doesn't grow with their number."""
    names = sorted(set(langs))
    if not names:
        return None
    data, offsets = arrays.raw(arrays.text_column(pa.array(texts, pa.large_string())))
    hashes, start, end, counts = arrays.words(data, offsets)
    k = len(names)
    if len(hashes) == 0:
        return None
    number = {x: i for i, x in enumerate(names)}
    label = np.repeat(np.array([number[x] for x in langs]), counts)
    _, at, kind = np.unique(hashes, return_index=True, return_inverse=True)
    parts = [word_features(data, start[at[lo : lo + 4096]], end[at[lo : lo + 4096]], hashes[at[lo : lo + 4096]]) for lo in range(0, len(at), 4096)]
    rows, per = np.concatenate([r.astype(np.int32) for r, _ in parts]), np.concatenate([n for _, n in parts])
    # Chunks of words of one document, in an order that mixes languages.
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    piece = doc * (int(counts.max()) // chunk + 1) + place // chunk
    _, piece = np.unique(piece, return_inverse=True)
    rng = np.random.Generator(np.random.PCG64(seed))
    order = np.argsort(rng.permutation(int(piece.max()) + 1)[piece], kind="stable")
    kind, label = kind[order], label[order]
    length, lanes = chunk * chunks, max(16, 2048 // k)
    fresh = np.arange(len(kind)) % length == 0
    wanted = np.zeros((len(at), k), np.float32)
    np.add.at(wanted, (kind, label), 1.0)
    linked = ~fresh[1:]
    wanted_pairs = np.zeros((k, k))
    np.add.at(wanted_pairs, (label[:-1][linked], label[1:][linked]), 1.0)
    starts = np.bincount(label[fresh], minlength=k)
    model = Model(names, np.zeros((1 << BITS, k), np.float32), np.log(np.full((k, k), 0.1 / k) + np.eye(k) * 0.9), np.log((starts + 1) / (starts + 1).sum()))
    scale = (1 / np.sqrt(np.maximum(per, 1))).astype(np.float32)
    by_row = np.argsort(rows, kind="stable")
    sorted_rows, sorted_entry = rows[by_row], np.repeat(np.arange(len(at), dtype=np.int32), per)[by_row]
    cut = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    used = sorted_rows[cut]
    squares = np.full((len(cut), k), 1e-6, np.float32)
    pair_squares = np.full((k, k), 1e-6)
    for _ in range(rounds):
        known = word_scores(model.weights, rows, per)
        got, pairs, chain = np.zeros((len(at), k), np.float32), np.zeros((k, k)), model.chain
        for lo in range(0, len(kind), length * lanes):
            here = kind[lo : lo + length * lanes]
            p, some = chain.marginals(known[here], fresh[lo : lo + length * lanes], -(-len(here) // length), pairs=True)
            pairs += some
            for j in range(k):
                got[:, j] += np.bincount(here, p[:, j], len(at))
        slope = (wanted - got) * scale[:, None]
        for lo in range(0, len(cut), 4096):
            block = slice(lo, min(lo + 4096, len(cut)))
            first, last = cut[lo], cut[block.stop] if block.stop < len(cut) else len(sorted_entry)
            g = np.add.reduceat(slope[sorted_entry[first:last]], cut[block] - first, axis=0) - 0.02 * model.weights[used[block]]
            squares[block] += g**2
            model.weights[used[block]] += rate * g / np.sqrt(squares[block])
        g = wanted_pairs - pairs - 0.1 * model.transitions
        pair_squares += g**2
        model.transitions = np.clip(model.transitions + rate * g / np.sqrt(pair_squares), -9, 3)
    return model


def chunks(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``k, l, n, t``: every chunk of ``chunk`` words of the texts of ``df`` (``k, l, t``), ``n`` its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.eased(batches):
            texts = arrays.text_column(batch.column(2))
            for lo, hi in arrays.slices(texts):
                data, offsets = arrays.raw(texts.slice(lo, hi - lo))
                _, start, end, counts = arrays.words(data, offsets)
                pieces = -(-counts // chunk)
                row = np.repeat(np.arange(hi - lo), pieces)
                n = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = np.repeat(np.cumsum(counts) - counts, pieces) + n * chunk
                last = np.minimum(first + chunk, np.repeat(np.cumsum(counts), pieces)) - 1
                body = data.tobytes()
                cut = [body[a:b] for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)] if len(row) else []
                own = batch.select([0, 1]).slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(n, pa.int32()), pa.array(cut, pa.binary()).cast(pa.string())], names=["k", "l", "n", "t"])

    return df.select("k", "l", "t").mapInArrow(run, "k long, l string, n int, t string")


def fitted(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS, max_languages: int | None = None
) -> Model | None:
    """The model of a bounded sample of the words of every language, or of the ``max_languages`` most frequent ones."""
    tagged = df.select(df[id_column].cast("long").alias("k"), df[lang_column].cast("string").alias("l")).where("k is not null and l is not null and l <> ''")
    top = tagged.groupBy("l").count().orderBy(F.desc("count"), "l")
    languages = [r["l"] for r in (top.limit(max_languages) if max_languages else top).collect()]
    if not languages:
        return None
    if max_languages:
        tagged = tagged.where(F.col("l").isin(languages))
    nth = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k"), "k"))
    chosen = tagged.withColumn("n", nth).where(F.col("n") <= sample_rows).select("k", "l").distinct()
    rows = df.select(df[id_column].cast("long").alias("k"), df[lang_column].cast("string").alias("l"), df[text_column].cast("string").alias("t")).where("t is not null")
    each = max(1, sample_words // CHUNK // len(languages))
    share = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k", "n"), "k", "n", "t"))
    sample = chunks(rows.join(F.broadcast(chosen), ["k", "l"], "left_semi")).withColumn("i", share).where(F.col("i") <= each)
    sample = sample.orderBy("k", "l", "n", "t").select("l", "t").toArrow()
    return trained(sample.column("t").to_pylist(), sample.column("l").to_pylist())


class Labeller:
    """Scores of known words are kept, up to ``most`` of them."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most, self.chain = model, most, model.chain
        self._forget()

    def _forget(self) -> None:
        self.index, self.table = arrays.HashIndex(18), np.zeros((1 << 16, len(self.model.languages)), np.float32)

    def scores(self, data, start, end, hashes) -> np.ndarray:
        if self.index.used > self.most:
            self._forget()
        slot = self.index.find(hashes)
        new = np.flatnonzero(slot < 0)
        if len(new):
            keys, at = np.unique(hashes[new], return_index=True)
            at = new[at]
            rows, per = word_features(data, start[at], end[at], keys)
            found = word_scores(self.model.weights, rows, per)
            used = self.index.used
            while used + len(keys) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[used : used + len(keys)] = found
            self.index.add(keys, np.arange(used, used + len(keys), dtype=np.int32))
            slot[new] = self.index.find(hashes[new])
        return self.table[slot]

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(probability, counts)`` of all words of the texts."""
        data, offsets = arrays.raw(texts)
        hashes, start, end, counts = arrays.words(data, offsets)
        if len(hashes) == 0:
            return np.zeros((0, len(self.model.languages))), counts
        fresh = np.zeros(len(hashes), bool)
        fresh[(np.cumsum(counts) - counts)[counts > 0]] = True
        return self.chain.marginals(self.scores(data, start, end, hashes), fresh), counts

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """``(best, share, counts, spans)``: spans as ``(text, language, first word, words)``."""
        probability, counts = self.words(texts)
        n, k = len(counts), len(self.model.languages)
        best, share = np.full(n, -1), np.zeros(n)
        some = np.flatnonzero(counts)
        if len(some) == 0:
            z = np.zeros(0, np.int64)
            return best, share, counts, (z, z, z, z)
        first = np.cumsum(counts) - counts
        mean = np.round(np.add.reduceat(probability, first[some], axis=0) / counts[some][:, None], 4)
        best[some] = mean.argmax(1)
        share[some] = mean.max(1)
        word = np.round(probability, 6).argmax(1)
        begin = np.append(True, word[1:] != word[:-1])
        begin[first[some]] = True
        at = np.flatnonzero(begin)
        doc = np.repeat(np.arange(n), counts)[at]
        return best, share, counts, (doc, word[at], at - first[doc], np.diff(np.append(at, len(word))))


def _run(held, min_share: float, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        labeller = Labeller(model) if model else None
        names = pa.array(model.languages if model else [], pa.string())
        for batch in arrays.eased(batches):
            texts = arrays.text_column(batch.column(1))
            for lo, hi in arrays.slices(texts):
                part, n = texts.slice(lo, hi - lo), hi - lo
                if labeller:
                    best, share, counts, spans = labeller.label(part)
                else:
                    counts = arrays.words(*arrays.raw(part))[3]
                    best, share = np.full(n, -1), (counts > 0).astype(float)
                    spans = (np.zeros(0, np.int64),) * 4
                doc, lang, first, words = spans
                structs = pa.StructArray.from_arrays([names.take(pa.array(lang, pa.int64())), pa.array(first, pa.int32()), pa.array(words, pa.int32())], names=["lang", "first", "words"])
                cuts = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                columns = [batch.column(0).slice(lo, n), names.take(pa.array(best, pa.int64(), mask=best < 0)), pa.array(share), pa.array(counts, pa.int64()), pa.array((counts > 0) & (share >= min_share))]
                if with_spans:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), structs))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "share", "n_words", "accepted", "spans"][: len(columns)])

    return run


def identified(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", min_share: float = MIN_SHARE, sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS, max_languages: int | None = None
) -> DataFrame:
    """``doc_id, lang, share, n_words, accepted, spans`` of every row."""
    held = df.sparkSession.sparkContext.broadcast(fitted(df, id_column, text_column, lang_column, sample_rows, sample_words, max_languages))
    rows = df.select(df[id_column].cast("long").alias("doc_id"), df[text_column].cast("string").alias("text"))
    return rows.mapInArrow(_run(held, min_share, True), SCHEMA)


def filtered(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", min_share: float = MIN_SHARE, sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS, max_languages: int | None = None
) -> DataFrame:
    """The rows of ``df`` that are accepted, with all its columns."""
    held = df.sparkSession.sparkContext.broadcast(fitted(df, id_column, text_column, lang_column, sample_rows, sample_words, max_languages))

    @F.arrow_udf("boolean")
    def accepted(column: pa.Array) -> pa.Array:
        model = held.value
        labeller = accepted_state.setdefault("labeller", Labeller(model) if model else None)
        texts, out = arrays.text_column(column), []
        for lo, hi in arrays.slices(texts):
            if labeller:
                _, share, counts, _ = labeller.label(texts.slice(lo, hi - lo))
                out.append((counts > 0) & (share >= min_share))
            else:
                out.append(arrays.words(*arrays.raw(texts.slice(lo, hi - lo)))[3] > 0)
        arrays.release()
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    accepted_state: dict = {}
    return df.where(accepted.asNondeterministic()(df[text_column].cast("string")))
