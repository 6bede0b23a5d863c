"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its inverse.

Encoding.  For a merge list the encoding of every prefix of a text is unique, so
each prefix has one *last token*: the only token ``t`` ending there that may
follow the last token of the prefix before it ("may follow": the two tokens side
by side are their own encoding).  A transducer keeps just these last
tokens.  A later byte can change a token only through a chain of merges of
falling rank, so the merge list itself bounds how far ahead one must look
(:func:`sufficient_lookahead`).  A transducer holds at most that lookahead plus the longest token
(``MergeList.keep`` bytes); when so many are held, all tokens that end before the lookahead are stable,
are emitted and forgotten.  Memory is constant, whatever the length of the input.

:class:`Lockstep` is the transducer over many pretokens at once, a byte of all of them at a time; what
is left of a few very long ones is handed over, state and all, to a :class:`Transducer` each, which is the same machine for one.

Decoding.  :class:`TextDecoder` is a byte-to-text state machine that gives out
whole characters only and carries the unfinished tail of one from token to token.

Texts are cut into pretokens first, vectorised over a whole Arrow slice, and each
distinct pretoken is encoded once per worker (the memory of known pretokens is
bounded and starts afresh when full).  What is looked up by hash is compared byte by byte.

Edge cases.  Null and empty texts have no tokens; repeated rows are encoded each
for itself; texts of any length are encoded whole; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank (which is the id), of a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class MergeList:
    """The vocabulary with, for each token, the two tokens that it is merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks), default=1)
        self.left = [-1] * self.size
        self.right = [-1] * self.size
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
            if len(token) > 1 and (parts := self._split(token, rank)):
                self.left[rank], self.right[rank] = parts
                self.pairs[parts] = rank
        self.known_pairs: dict[int, bool] = {}
        self.lengths = [n for n in (3, 2, 4, 1, 5, 6, *range(7, self.longest + 1)) if n in {len(t) for t in ranks}]
        self.lookahead = sufficient_lookahead(self)
        self.keep = self.lookahead + self.longest

    def _split(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two parts left when ``token`` is encoded by merges of lower rank alone."""
        parts = [token[i : i + 1] for i in range(len(token))]
        get = self.ranks.get
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) != 2 or parts[0] not in self.ranks or parts[1] not in self.ranks:
            return None
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` side by side stay as they are."""
        key = a * self.size + b
        known = self.known_pairs.get(key)
        if known is None:
            if len(self.known_pairs) > 1_000_000:
                self.known_pairs.clear()
            known = self.known_pairs[key] = self._may_follow(a, b)
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        # Undo the merges at the edge, the latest first: no merge across the edge may
        # have come before one that is undone.
        limit, pairs, left, right = self.size, self.pairs, self.left, self.right
        while pairs.get((a, b), limit) >= limit:
            if right[a] >= 0 and (a > b or left[b] < 0):
                limit, a = a, right[a]
            elif left[b] >= 0:
                limit, b = b + 1, left[b]
            else:
                return True
        return False


def sufficient_lookahead(merges: MergeList) -> int:
    """Bytes beyond a token's end after which no further byte can change it.

    Merge ``(u, v)`` is pre-empted on the right only by a merge ``(v, x)`` of lower
    rank, which in turn needs ``x`` to be formed and not to be pre-empted itself.
    Going through the merges by rank, ``reach[t]`` is what must be seen beyond ``t``
    to know whether a merge so far takes ``t`` as its left part, ``formed[t]`` what
    must be seen beyond ``t`` to know that it comes about at all.
    """
    size, length = merges.size, [len(t) for t in merges.tokens]
    reach, formed = [0] * size, [0] * size
    for rank in range(size):
        u, v = merges.left[rank], merges.right[rank]
        if u < 0:
            continue
        need = max(reach[v], formed[v])
        formed[rank] = max(need, reach[u] - length[v], formed[u] - length[v], 0)
        reach[u] = max(reach[u], length[v] + need)
    return max([1, *(max(a, b) for a, b in zip(reach, formed, strict=True))])


class Transducer:
    """Encodes one pretoken fed in pieces; emits tokens as soon as they are stable."""

    def __init__(self, merges: MergeList, held: bytes = b"", last: Iterable[int] = (), before: int = -1):
        self.merges = merges
        self._reset()
        self.bytes += held
        self.last += last
        self.before = before

    def _reset(self) -> None:
        self.bytes = bytearray()
        self.last: list[int] = []  # last token of the prefix that ends at each byte
        self.before = -1  # the token emitted last

    def feed(self, piece: bytes) -> list[int]:
        out: list[int] = []
        at, keep, ahead = 0, self.merges.keep, self.merges.lookahead
        while at < len(piece):
            room = keep - len(self.bytes)
            self.bytes += piece[at : at + room]
            at += room
            self._advance()
            if len(self.bytes) >= keep:
                out += self._emit(len(self.bytes) - ahead)
        return out

    def finish(self) -> list[int]:
        out = self._emit(len(self.bytes))
        self._reset()
        return out

    def _advance(self) -> None:
        text, last, merges = bytes(self.bytes), self.last, self.merges
        get, compatible, known, size, before = merges.ranks.get, merges.compatible, merges.known_pairs, merges.size, self.before
        for end in range(len(last) + 1, len(text) + 1):
            # Just one token fits, so lengths are tried by how common they are.
            for length in merges.lengths:
                start = end - length
                if start < 0 or (token := get(text[start:end])) is None:
                    continue
                previous = last[start - 1] if start else before
                if previous < 0:
                    if start == 0 and previous == -1:
                        break
                    continue
                fits = known.get(previous * size + token)
                if fits or fits is None and compatible(previous, token):
                    break
            else:
                token = -2
            last.append(token)

    def _emit(self, until: int) -> list[int]:
        """Tokens of the encoding so far that end at byte ``until`` or before it."""
        tokens, end, length = [], len(self.bytes), self.merges.tokens
        while end > 0:
            token = self.last[end - 1]
            if token < 0:
                raise ValueError("the vocabulary lacks a token for a byte of the input")
            if end <= until:
                tokens.append(token)
            end -= len(length[token])
        tokens.reverse()
        done = sum(len(length[t]) for t in tokens)
        if tokens:
            self.before = tokens[-1]
        del self.bytes[:done]
        del self.last[:done]
        return tokens


class Lockstep:
    """Transducers over many pretokens at once, a byte position of all at a time.

    Each lane holds the last tokens and prefix hashes of its ``keep`` latest bytes at most, in a ring.
    ``held`` is the most bytes that any lane has held so far."""

    #: So few lanes are quicker one by one.
    FEW = 4

    def __init__(self, merges: MergeList):
        self.merges, self.held = merges, 0
        items = sorted(merges.ranks.items(), key=lambda kv: kv[1])
        self.body = np.frombuffer(b"".join(t for t, _ in items), np.uint8)
        sizes = np.array([len(t) for t, _ in items], np.int64)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(self.body)) - np.repeat(first, sizes)
        sums = np.add.reduceat(arrays.BYTE_VALUES[self.body] * arrays.powers(merges.longest + 1)[place], first)
        self.vocabulary = arrays.HashIndex(18)
        ids = np.array([r for _, r in items], np.int32)
        self.vocabulary.add(self._key(sums, sizes), ids)
        self.first, self.sizes = np.zeros(merges.size, np.int64), np.zeros(merges.size, np.int64)
        self.first[ids], self.sizes[ids] = first, sizes
        self.fits = arrays.HashIndex(16)
        self.inverse = pow(int(arrays.BASE), -1, 1 << 64)

    @staticmethod
    def _key(sums: np.ndarray, size) -> np.ndarray:
        return arrays.mix(sums + np.asarray(size).astype(np.uint64)) | np.uint64(1 << 63)

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # The pair itself is the key, so that no two pairs are taken for one another.
        keys = (a.astype(np.uint64) * np.uint64(self.merges.size) + b.astype(np.uint64)) | np.uint64(1 << 63)
        out = self.fits.find(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            if self.fits.used > 1_000_000:
                self.fits, new = arrays.HashIndex(16), np.arange(len(keys))
            distinct, at = np.unique(keys[new], return_index=True)
            may = self.merges._may_follow
            self.fits.add(distinct, np.array([may(x, y) for x, y in zip(a[new[at]].tolist(), b[new[at]].tolist(), strict=True)], np.int32))
            out = self.fits.find(keys)
        return out > 0

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, sizes)``: the tokens of all pieces one after the other, and how many each has."""
        keep, ahead = self.merges.keep, self.merges.lookahead
        lengths = np.array([len(x) for x in pieces], np.int64)
        order = np.argsort(-lengths, kind="stable")
        n, first, size = len(pieces), (np.cumsum(lengths) - lengths)[order], lengths[order]
        width = int(size[0]) if n else 0
        body = np.frombuffer(b"".join(pieces), np.uint8)
        ring = min(keep, width) + 1
        prefix, last = np.zeros((ring, n), np.uint64), np.full((ring, n), -1, np.int32)
        base = np.zeros(n, np.int64)  # what lies before it has been emitted
        back = [1] * ring  # the inverse of BASE to the power of each position held
        power, inverse = 1, 1
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rest: list[tuple[int, int, list[int]]] = []

        def emit(lanes: np.ndarray, end: int, until: int) -> None:
            """Tokens of ``lanes`` from their base on that end at byte ``until`` or before it."""
            at, now = np.full(len(lanes), end), lanes
            done = base[lanes].copy()
            which = np.arange(len(lanes))
            while len(which):
                token = last[at % ring, now]
                if (token < 0).any():
                    raise ValueError("the vocabulary lacks a token for a byte of the input")
                stable = at <= until
                out.append((now[stable], at[stable], token[stable]))
                done[which] = np.maximum(done[which], np.where(stable, at, 0))
                at = at - self.sizes[token]
                more = at > base[now]
                which, now, at = which[more], now[more], at[more]
            base[lanes] = done

        for e in range(1, width + 1):
            active = int(np.searchsorted(-size, -e, "right"))
            if active <= self.FEW and width - e > keep:
                for lane in range(active):
                    lo, hi = int(base[lane]), int(first[lane] + size[lane])
                    single = Transducer(self.merges, body[first[lane] + lo : first[lane] + e - 1].tobytes(), [int(last[i % ring, lane]) for i in range(lo + 1, e)], int(last[lo % ring, lane]))
                    rest.append((lane, e, single.feed(body[first[lane] + e - 1 : hi].tobytes()) + single.finish()))
                break
            now, before = e % ring, (e - 1) % ring
            prefix[now, :active] = prefix[before, :active] + arrays.BYTE_VALUES[body[first[:active] + (e - 1)]] * np.uint64(power)
            last[now, :active] = -2
            power = power * int(arrays.BASE) & 0xFFFFFFFFFFFFFFFF
            inverse = inverse * self.inverse & 0xFFFFFFFFFFFFFFFF
            back[now] = inverse
            todo = np.arange(active)
            for length in self.merges.lengths:
                start = e - length
                if start < 0 or not len(todo):
                    continue
                there = start % ring
                token = self.vocabulary.find(self._key((prefix[now, todo] - prefix[there, todo]) * np.uint64(back[there] if start else 1), length))
                known = np.flatnonzero((token >= 0) & (start >= base[todo]))
                for i in range(length):  # equal hashes aren't taken for equal bytes
                    if len(known):
                        known = known[self.body[self.first[token[known]] + i] == body[first[todo[known]] + (start + i)]]
                known = known[self.sizes[token[known]] == length]
                if start and len(known):
                    previous = last[there, todo[known]]
                    known, previous = known[previous >= 0], previous[previous >= 0]
                    known = known[self._compatible(previous, token[known])]
                if len(known):
                    last[now, todo[known]] = token[known]
                    todo = np.delete(todo, known)
            self.held = max(self.held, int((e - base[:active]).max()))
            going = int(np.searchsorted(-size, -(e + 1), "right"))
            if going < active:
                emit(np.arange(going, active), e, e)
            full = np.flatnonzero(e - base[:going] >= keep)
            if len(full):
                emit(full, e, e - ahead)
        for lane, e, tokens in rest:
            out.append((np.full(len(tokens), lane), e + np.arange(len(tokens)), np.array(tokens, np.int32)))
        if not out:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        lane, at, token = (np.concatenate(x) for x in zip(*out, strict=True))
        row = order[lane]
        return token[np.lexsort((at, row))].astype(np.int32), np.bincount(row, minlength=n)


class TextDecoder:
    """Bytes in, whole characters out; the unfinished tail of a character is its state."""

    def __init__(self) -> None:
        self.tail = b""

    def feed(self, piece: bytes) -> str:
        piece = self.tail + piece
        cut = len(piece)
        for back in range(1, min(4, cut) + 1):  # find the last lead byte
            b = piece[cut - back]
            if b & 0xC0 != 0x80:
                need = 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                if need > back:
                    cut -= back
                break
        self.tail = piece[cut:]
        return piece[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        tail, self.tail = self.tail, b""
        return tail.decode("utf-8", "replace")


def decoded(merges: MergeList, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
    """The text of ``ids`` in pieces, ``block`` tokens at a time; nothing but the unfinished tail of a character is kept."""
    machine, tokens = TextDecoder(), merges.tokens
    for some in batched(ids, block):
        yield machine.feed(b"".join([tokens[i] for i in some]))
    yield machine.finish()


def decode(merges: MergeList, ids: Iterable[int]) -> str:
    return "".join(decoded(merges, ids))


def restores(merges: MergeList, ids: Iterable[int], text: str) -> bool:
    """Whether ``ids`` decode to ``text``, compared piece by piece."""
    at = 0
    for piece in decoded(merges, ids):
        if not text.startswith(piece, at):
            return False
        at += len(piece)
    return at == len(text)


@lru_cache(maxsize=4)
def merge_list(path: str) -> MergeList:
    return MergeList(read_ranks(path))


# --- pretokens -------------------------------------------------------------------

_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point: letter, number, other, white space."""
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    whole = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, whole):
            lo, hi = m.span()
            shift = lambda i: i if i < 0xD800 else i + 0x800
            out[shift(lo) : shift(hi - 1) + 1] = kind
    return out


def pretokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(data, start, counts)``: the bytes, where each pretoken begins, and pretokens per text.

    The cut is that of byte-level vocabularies of 50k tokens: contractions, runs of
    letters, of numbers or of other characters, each with one space before it, and
    white space."""
    data, offsets = arrays.raw(texts)
    n = len(offsets) - 1
    if len(data) == 0:
        return data, np.zeros(0, np.int64), np.zeros(n, np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points = _code_points(data, at)
    kind = _classes()[points]
    m = len(at)
    doc_start = np.zeros(m, bool)
    doc_start[np.searchsorted(at, offsets[:-1][offsets[:-1] < len(data)])] = True
    last_of_doc = np.append(doc_start[1:], True)
    before, after = np.empty(m, np.uint8), np.empty(m, np.uint8)
    before[0] = 9
    before[1:] = kind[:-1]
    before[doc_start] = 9
    after[-1] = 9
    after[:-1] = kind[1:]
    after[last_of_doc] = 9
    begin = kind != before  # a new run
    space = kind == _SPACE
    # The last white space before something else stands alone, or goes with it if it is a space.
    ends_run = space & (after != _SPACE) & (after != 9)
    begin |= ends_run
    joins = np.flatnonzero(ends_run & (points == 32)) + 1
    begin[joins] = False
    quotes = np.flatnonzero((points == 39) & begin & (after == _LETTER))
    for q in quotes.tolist():
        stop = q + 1
        while stop < m and stop < q + 3 and not doc_start[stop]:
            stop += 1
        tail = "".join(map(chr, points[q + 1 : stop].tolist()))
        size = 2 if tail in ("re", "ve", "ll") else 1 if tail[:1] in ("s", "t", "m", "d") and tail else 0
        if size:
            begin[q + 1] = False
            if q + 1 + size < m:
                begin[q + 1 + size] = True
    begin |= doc_start
    start = at[begin]
    return data, start, np.diff(np.searchsorted(start, offsets))


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    points = data[at].astype(np.uint32)
    wide = np.flatnonzero(points >= 0x80)
    if len(wide):
        p, lead = at[wide], points[wide]
        size = np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))
        value = np.where(size == 2, lead & 0x1F, np.where(size == 3, lead & 0x0F, lead & 0x07))
        for k in (1, 2, 3):
            more = size > k
            value[more] = (value[more] << 6) | (data[p[more] + k] & 0x3F)
        points[wide] = value
    return points


class Encoder:
    """Encodes Arrow slices of texts; each distinct pretoken only once.

    ``pieces`` gives the tokens of a list of pretokens, and how many each has.
    ``most`` bounds the pretokens remembered."""

    def __init__(self, pieces, most: int = 600_000):
        self.pieces, self.most = pieces, most
        self._forget()

    def _forget(self) -> None:
        self.index = arrays.HashIndex(18)
        self.flat, self.used, self.slots = np.zeros(1 << 18, np.int32), 0, 0
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.body, self.bytes_used, self.at = np.zeros(1 << 20, np.uint8), 0, np.zeros(1 << 16, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: the tokens of all texts, and where those of each text begin."""
        data, start, counts = pretokens(texts)
        if len(start) == 0:
            return np.zeros(0, np.int32), np.zeros(len(counts) + 1, np.int64)
        length = np.diff(np.append(start, len(data)))
        keys = _pretoken_keys(data, start, length)
        if self.index.used > self.most:
            self._forget()
        slots = self.index.find(keys)
        new = np.flatnonzero(slots < 0)
        cut = lambda at: [data[lo:hi].tobytes() for lo, hi in zip(start[at].tolist(), (start + length)[at].tolist(), strict=True)]
        if len(new):
            own, at = np.unique(keys[new], return_index=True)
            pieces = cut(new[at])
            self._add(own, pieces, *self.pieces(pieces))
            slots[new] = self.index.find(keys[new])
        # Long pretokens were looked up by hash: those of other bytes get ids of their own.
        long = np.flatnonzero(length > 7)
        if len(long):
            n = length[long]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            differ = self.body[np.repeat(self.at[slots[long]], n) + inside] != data[np.repeat(start[long], n) + inside]
            other = long[np.logical_or.reduceat(differ, np.cumsum(n) - n)] if differ.any() else long[:0]
            if len(other):
                pieces = cut(other)
                slots[other] = self._remember(pieces, *self.pieces(pieces))
        first, size = self.first[slots], self.size[slots]
        ends = np.cumsum(size, dtype=np.int64)
        take = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(first - (ends - size), size)
        per_text = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        return self.flat[take], per_text

    def _add(self, keys: np.ndarray, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.index.add(keys, self._remember(pieces, ids, sizes))

    def _remember(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The slots of ``pieces`` with their ids."""
        slots = np.arange(self.slots, self.slots + len(pieces), dtype=np.int32)
        self.slots += len(pieces)
        body = np.frombuffer(b"".join(pieces) + bytes(8), np.uint8)
        self.flat = _grown(self.flat, self.used + len(ids))
        self.body = _grown(self.body, self.bytes_used + len(body))
        self.first, self.size, self.at = (_grown(x, self.slots) for x in (self.first, self.size, self.at))
        self.flat[self.used : self.used + len(ids)] = ids
        self.body[self.bytes_used : self.bytes_used + len(body)] = body
        length = np.array([len(x) for x in pieces], np.int64)
        self.first[slots], self.size[slots], self.at[slots] = self.used + np.cumsum(sizes) - sizes, sizes, self.bytes_used + np.cumsum(length) - length
        self.used += len(ids)
        self.bytes_used += len(body) - 8
        return slots


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(len(x), size - len(x)), x.dtype)])


def _pretoken_keys(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to seven bytes and their number are their own key; longer pretokens have a hash with the highest bit set."""
    keys = arrays.run_hashes(data, start)
    short = np.flatnonzero(length <= 7)
    own, n, at = length[short].astype(np.uint64) << np.uint64(56), length[short], start[short]
    for i in range(7):
        more = np.flatnonzero(n > i) if i else slice(None)
        own[more] |= data[at[more] + i].astype(np.uint64) << np.uint64(8 * i)
    keys[short] = own
    return keys


@lru_cache(maxsize=2)
def transducing_encoder(path: str) -> Encoder:
    """This worker's encoder by transducer."""
    return Encoder(Lockstep(merge_list(path)).encode)


@lru_cache(maxsize=2)
def library_encoder(path: str) -> Encoder:
    """This worker's encoder by the installed tokenizer library, for operators that only need ids."""
    import tiktoken

    piece = tiktoken.Encoding("given", pat_str=r"(?s).+", mergeable_ranks=read_ranks(path), special_tokens={})._core_bpe.encode_single_piece

    def pieces(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [piece(x) for x in items]
        return np.array(list(chain.from_iterable(ids)), np.int32), np.array([len(x) for x in ids], np.int64)

    return Encoder(pieces)


def encode_decode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, token_ids, restored`` for each row of ``df``.

    ``restored`` says whether decoding the ids gave the very text back; it is true
    for null and empty texts, which have no tokens.  Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, merges = transducing_encoder(vocabulary), merge_list(vocabulary)
        for batch in arrays.eased(batches):
            ids_column, texts = batch.column(0), arrays.text_column(batch.column(1))
            for lo, hi in arrays.slices(texts):
                part = texts.slice(lo, hi - lo)
                ids, offsets = encoder.encode(part)
                flat, cuts = ids.tolist(), offsets.tolist()
                same = [restores(merges, flat[a:b], t) for a, b, t in zip(cuts[:-1], cuts[1:], part.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids_column.slice(lo, hi - lo), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_tokens", "token_ids", "restored"],
                )

    source = df.select(df[id_column].cast("long").alias("doc_id"), df[text_column].cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, restored boolean")
