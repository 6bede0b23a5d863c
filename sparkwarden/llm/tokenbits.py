"""Token ids as fixed-width bit fields: each id takes the fewest bits that the vocabulary needs.

A blob is a header, the byte offset of each block and the blocks.  A block holds
``BLOCK`` ids (the last one fewer) and begins at a multiple of eight bytes, so any
range of ids is unpacked by a few vectorised numpy steps on the blocks it touches.

Each result row is one blob with whole documents of one partition: ``part``,
``blob``, ``doc_ids``, ``doc_starts`` (one more than documents: where each begins
among the ids), ``n_tokens``, ``bits``, ``payload``.

Edge cases.  Null and empty texts are documents of no ids; null doc_ids stay null;
repeated rows are written each; a text of any length is one document of one blob;
an empty table gives no rows; extra columns are ignored.  Ids beyond the
vocabulary raise ``ValueError``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import arrays, bpe

MAGIC = b"SWT1"
BLOCK = 4096
_HEAD = struct.Struct("<4sHHqq")
SCHEMA = "part int, blob long, doc_ids array<long>, doc_starts array<long>, n_tokens long, bits int, payload binary"


def width(vocabulary_size: int) -> int:
    """Bits for ids below ``vocabulary_size``, one more than the greatest id."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_words(ids: np.ndarray, bits: int) -> np.ndarray:
    """The ids as 64-bit words, lowest bits first; a multiple of 64 ids at a time."""
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> bits):
        raise ValueError(f"an id does not fit in {bits} bits")
    rows = -(-len(ids) // 64)
    full = np.zeros(rows * 64, np.uint64)
    full[: len(ids)] = ids
    grid = np.ascontiguousarray(full.reshape(rows, 64).T)
    out = np.zeros((bits, rows), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[word] |= grid[j] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= grid[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(-1)[: -(-len(ids) * bits // 64)]


def unpack_words(words: np.ndarray, bits: int, lo: int, hi: int) -> np.ndarray:
    """Ids ``lo`` to ``hi`` of packed words."""
    bit = np.arange(lo, hi, dtype=np.int64) * bits
    at, shift = bit >> 6, (bit & 63).astype(np.uint64)
    low = words[at] >> shift
    over = (shift + np.uint64(bits)) > np.uint64(64)
    high = np.zeros_like(low)
    high[over] = words[at[over] + 1] << (np.uint64(64) - shift[over])
    return ((low | high) & np.uint64((1 << bits) - 1)).astype(np.int64)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """A blob of all ``ids``."""
    blocks = [pack_words(ids[lo : lo + BLOCK], bits).tobytes() for lo in range(0, len(ids), BLOCK)]
    head = _HEAD.size + 8 * (len(blocks) + 1)
    offsets = head + np.cumsum([0, *map(len, blocks)])
    return b"".join([_HEAD.pack(MAGIC, bits, 0, len(ids), len(blocks)), offsets.astype("<i8").tobytes(), *blocks])


class Blob:
    """Random access to the ids of a blob."""

    def __init__(self, payload: bytes):
        magic, self.bits, _, self.n_tokens, n = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a blob of token ids")
        self.payload = payload
        self.offsets = np.frombuffer(payload, "<i8", n + 1, _HEAD.size)

    def read(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids ``lo`` to ``hi``; only the blocks they lie in are looked at."""
        hi = self.n_tokens if hi is None else min(hi, self.n_tokens)
        out = []
        for block in range(lo // BLOCK, -(-hi // BLOCK)) if lo < hi else ():
            a, b = int(self.offsets[block]), int(self.offsets[block + 1])
            words = np.frombuffer(self.payload, "<u8", (b - a) // 8, a)
            out.append(unpack_words(words, self.bits, max(lo - block * BLOCK, 0), min(hi - block * BLOCK, BLOCK)))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def packed_tokens(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = bpe.DEFAULT_VOCABULARY, blob_tokens: int = 1 << 18) -> DataFrame:
    """Tokenizes every text and packs whole documents into blobs of ``blob_tokens`` ids or a little more.

    Narrow: each partition makes its own blobs, and only one blob's ids are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bits = bpe.library_encoder(vocabulary), width(max(bpe.read_ranks(vocabulary).values(), default=0) + 1)
        part, blob = TaskContext.get().partitionId(), 0
        docs: list[pa.Array] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            starts = np.append(0, np.cumsum(np.concatenate(sizes)))
            names = pa.concat_arrays(docs)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([blob], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([starts.tolist()], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([bits], pa.int32()), pa.array([pack(ids, bits)], pa.binary())],
                names=["part", "blob", "doc_ids", "doc_starts", "n_tokens", "bits", "payload"],
            )

        for batch in arrays.eased(batches):
            names, texts = batch.column(0), arrays.text_column(batch.column(1))
            for lo, hi in arrays.slices(texts):
                ids, offsets = encoder.encode(texts.slice(lo, hi - lo))
                row = 0
                while row < hi - lo:  # cut behind the document that fills the blob
                    stop = int(np.searchsorted(offsets, offsets[row] + max(1, blob_tokens - held), "left"))
                    stop = min(max(stop, row + 1), hi - lo)
                    docs.append(names.slice(lo + row, stop - row))
                    parts.append(ids[offsets[row] : offsets[stop]])
                    sizes.append(np.diff(offsets[row : stop + 1]))
                    held += len(parts[-1])
                    row = stop
                    if held >= blob_tokens:
                        yield flush()
                        blob, held = blob + 1, 0
                        docs, parts, sizes = [], [], []
        if docs:
            yield flush()

    source = df.select(df[id_column].cast("long").alias("doc_id"), df[text_column].cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA)


def unpacked(blobs: DataFrame) -> DataFrame:
    """``doc_id, token_ids`` of each document in the blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Blob(row["payload"]).read()
                names = pa.array(row["doc_ids"], pa.int64())
                yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(row["doc_starts"], pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "token_ids"])

    return blobs.select("doc_ids", "doc_starts", "payload").mapInArrow(run, "doc_id long, token_ids array<int>")
