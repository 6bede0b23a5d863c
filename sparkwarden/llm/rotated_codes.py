"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to unit length and put into cells around centroids (Lloyd's steps over
all vectors).  A vector's offset from its centroid is padded with zeros to ``bits``
dimensions, rotated at random and reduced to its signs, one bit a dimension, with two correction
scalars: its length and the inner product of the offset's direction with its code.  A query's offset is
turned likewise and rounded to ``PLANES`` bits a dimension, so that its inner product with a code
is a few ANDs and bit counts of packed words.  The estimate has no bias; its error bound shrinks with the root of
``bits``.  Only vectors whose bound reaches the best so far are compared exactly.

Queries are the rows whose id is divisible by ``every``; they are held against all rows.  A
query looks into the cells nearest to it.  How many is measured: for
``probe_sample`` queries all vectors are searched exactly, and as many cells are probed as hold
``target`` of the true neighbours.

Plan.  Neighbouring cells are put together into blocks of about ``part_rows`` vectors (a crowded cell is
several blocks), so that bounds within a block are sharp and a query goes once to each block that
holds a cell of its own.  What is shuffled to blocks is codes with their scalars and queries with their planes, no
vectors; these are joined to the candidates that are left.  Blocks beyond ``part_queries`` queries are met by
several tasks.  Broadcast: centroids (``sqrt(n)/2``, at most ``max_cells`` of them, beyond which
cells grow), the rotation, and the block of each cell.

Result: ``vec_id, rank, neighbour_id, similarity``: the ``k`` nearest of each query by
cosine similarity (six decimals), ties by the lesser id.

Edge cases.  Vectors that are null or empty, of length zero, with a null, NaN or infinite
part, or of another dimension than most are neither queries nor neighbours, nor are those
with a null id.  Several rows of one id are one vector, the greatest of them.  A vector isn't its own
neighbour, but another with the same values is; with fewer than ``k`` others, all are
neighbours.  An empty table, or one without a query, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored

#: Estimates made at once: what bounds a task's memory.
PAIRS = 1 << 18
#: Vectors of queries are broadcast up to so many bytes, beyond that shuffled.
BROADCAST_BYTES = 16 << 20
#: Bits to which a query's dimensions are rounded.
PLANES = 5


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def code_size(dim: int, bits: int) -> int:
    """Dimensions after padding: whole words of 64 bits."""
    return -(-max(dim, bits) // 64) * 64


def encode(offsets: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, length, inner)`` of each offset: signs in words, norm, and inner product of direction and code.

    ``turn`` has as many columns as the code has bits and a row for each dimension of the vectors."""
    length = np.linalg.norm(offsets, axis=1)
    turned = (offsets / np.maximum(length, 1e-12)[:, None]) @ turn
    inner = np.abs(turned).sum(1) / np.sqrt(turn.shape[1])
    return np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64), length, np.where(length > 1e-9, inner, 1.0)


def planes(offsets: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(planes, low, step, total)``: each turned offset rounded to ``low + step * u``, the bits of ``u`` in words, and its sum."""
    turned = offsets @ turn
    low, high = turned.min(1), turned.max(1)
    step = np.maximum((high - low) / ((1 << PLANES) - 1), 1e-12)
    u = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    out = np.stack([np.packbits((u >> j) & 1, axis=1, bitorder="little").view(np.uint64) for j in range(PLANES)], axis=1)
    return out, low, step, low * turn.shape[1] + step * u.sum(1)


def estimate(codes: np.ndarray, length: np.ndarray, inner: np.ndarray, asked: tuple, norm: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner product of each query (its :func:`planes` and norm) with each offset, and its error bound."""
    bit_planes, low, step, total = asked
    size = codes.shape[1] * 64
    ones = np.bitwise_count(codes).sum(1, dtype=np.int32)
    held = np.zeros((len(bit_planes), len(codes)), np.int32)
    for j in range(PLANES):
        both = np.zeros(held.shape, np.uint16)
        for w in range(codes.shape[1]):
            both += np.bitwise_count(bit_planes[:, j, w][:, None] & codes[:, w][None])
        held += np.left_shift(both, j, dtype=np.int32)
    # Sum of the query's dimensions where the code's bit is set, less that of all others.
    product = 2 * (low[:, None] * ones[None] + step[:, None] * held) - total[:, None]
    product *= (length / inner / np.sqrt(size))[None]
    slack = np.sqrt(np.maximum(1 - np.minimum(inner, 1) ** 2, 0)) / inner / np.sqrt(size - 1) * length * epsilon
    rounding = step / np.sqrt(12) * epsilon
    return product, norm[:, None] * slack[None] + rounding[:, None] * (length / inner)[None]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def as_lists(rows: np.ndarray) -> pa.Array:
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(rows.reshape(-1).astype(np.float32)))


def unit_vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, v`` of usable vectors, scaled to unit length, one row an id."""
    v = df[vector_column].cast("array<double>")
    usable = df.select(df[id_column].cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & F.exists("v", lambda x: F.abs(x) > 1e-150))
    sized = usable.groupBy("vec_id").agg(F.max("v").alias("v"))
    common = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 1

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                x = x / np.abs(x).max(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(x / np.linalg.norm(x, axis=1, keepdims=True))], names=["vec_id", "v"])

    return sized.where(F.size("v") == dim).mapInArrow(scale, "vec_id long, v array<float>")


def centroids(vectors: DataFrame, cells: int, rounds: int) -> np.ndarray:
    """Lloyd's steps over all vectors, from the ``cells`` of least hash."""
    start = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells).toPandas()
    now = np.array(start["v"].tolist(), np.float64)
    spark = vectors.sparkSession
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(now)

        def add(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            c = held.value
            sums, counts = np.zeros_like(c), np.zeros(len(c), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(0))
                    own = nearest(x, c)
                    order = np.argsort(own, kind="stable")
                    first = np.flatnonzero(np.append(True, np.diff(own[order]) > 0))
                    sums[own[order][first]] += np.add.reduceat(x[order], first, axis=0)
                    counts += np.bincount(own, minlength=len(c))
            some = np.flatnonzero(counts)
            # Sums as whole numbers: the same in whatever order parts arrive.
            whole = np.round(sums[some] * 2**20).astype(np.int64)
            dim = c.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dim), pa.int64()), pa.array(np.tile(np.arange(dim), len(some)), pa.int32()), pa.array(whole.reshape(-1)), pa.array(np.repeat(counts[some], dim))], names=["cell", "at", "total", "count"])

        parts = vectors.select("v").mapInArrow(add, "cell long, at int, total long, count long")
        total = parts.groupBy("cell", "at").agg(F.sum("total").alias("total"), F.sum("count").alias("count")).toPandas()
        after = now.copy()
        after[total["cell"], total["at"]] = total["total"] / 2**20 / total["count"]
        held.unpersist()
        now = after
    return now


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)


def probes_needed(vectors: DataFrame, asking: DataFrame, c: np.ndarray, sample: int, k: int, target: float) -> int:
    """How many nearest cells hold ``target`` of the true neighbours of sampled queries, all vectors being searched."""
    rows = asking.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(sample).toPandas()
    ids, queries = rows["vec_id"].to_numpy(), np.array(rows["v"].tolist(), np.float64)
    held = vectors.sparkSession.sparkContext.broadcast((ids, queries, c))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, cells = held.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, names = matrix(batch.column(1)), batch.column(0).to_numpy()
            s = q @ x.T
            s[own[:, None] == names[None]] = -np.inf
            top = np.argpartition(-s, min(k, len(names)) - 1, axis=1)[:, : min(k, len(names))]
            cell = nearest(x, cells)
            at = np.repeat(np.arange(len(q)), top.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.take_along_axis(s, top, 1).reshape(-1)), pa.array(cell[top.reshape(-1)])], names=["q", "s", "cell"])

    found = vectors.mapInArrow(search, "q long, s double, cell long").where(F.col("s") > -2)
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "cell"))
    true = found.withColumn("n", nth).where(F.col("n") <= k).select("q", "cell").toPandas()
    if len(true) == 0:
        return len(c)
    order = np.argsort(((c**2).sum(1)[None] - 2 * queries @ c.T), axis=1)
    place = np.argsort(order, axis=1)[true["q"], true["cell"]] + 1
    return int(np.quantile(place, target, method="higher"))


def blocks(c: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``(block, parts)`` of each cell: near cells share a block of at most ``most`` vectors; a larger cell has ``parts`` blocks from ``block`` on."""
    order: list[int] = []

    def halve(some: np.ndarray) -> None:
        if len(some) <= 2:
            order.extend(some.tolist())
            return
        x = c[some]
        axis = x.var(0).argmax()
        by = some[np.argsort(x[:, axis], kind="stable")]
        halve(by[: len(by) // 2])
        halve(by[len(by) // 2 :])

    halve(np.arange(len(c)))
    block, parts = np.zeros(len(c), np.int64), np.ones(len(c), np.int64)
    now = held = 0
    for cell in order:
        n = int(counts[cell])
        if held and held + n > most:
            now, held = now + 1, 0
        block[cell], parts[cell] = now, max(1, -(-n // most))
        held += n
        if held >= most:
            now, held = now + int(parts[cell]), 0
    return block, parts


_CANDIDATE = "q long, vec_id long, least double, most double"


def _search(k: int, epsilon: float, c_held, turn_held):
    """Candidates of one block: those whose upper bound reaches the ``k``-th lower bound of their query."""

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if data.num_rows and asked.num_rows:
            centers, turn = c_held.value, turn_held.value
            by = np.lexsort((data.column("vec_id").to_numpy(), data.column("cell").to_numpy()))
            ids, cell, length, inner, along = (data.column(x).to_numpy()[by] for x in ("vec_id", "cell", "length", "inner", "along"))
            codes = np.frombuffer(b"".join(data.column("code").to_pylist()), np.uint64).reshape(len(ids), -1)[by]
            names, q = asked.column("q").to_numpy(), matrix(asked.column("v"))
            lists = asked.column("cells").combine_chunks()
            starts, wanted = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            sizes = np.diff(starts)
            floor = np.full((len(names), k), -np.inf)  # the best lower bounds of each query so far, the least first
            for place in range(int(sizes.max())):  # the nearest cell of all queries, then the next
                now = np.flatnonzero(sizes > place)
                now = now[np.argsort(wanted[starts[now] + place], kind="stable")]
                here = wanted[starts[now] + place]
                for group in np.split(now, np.flatnonzero(np.diff(here)) + 1):
                    which = wanted[starts[group[0]] + place]
                    a, b = np.searchsorted(cell, [which, which + 1])
                    for part in np.array_split(group, -(-len(group) * (b - a) // PAIRS)) if b > a else ():
                        offset = q[part] - centers[which]
                        guess, slack = estimate(codes[a:b], length[a:b], inner[a:b], planes(offset, turn), np.linalg.norm(offset, axis=1), epsilon)
                        # <o, q> = <o, c> + <c, q - c> + <o - c, q - c>
                        guess += along[a:b][None] + (offset @ centers[which])[:, None]
                        guess[names[part][:, None] == ids[a:b][None]] = -np.inf
                        under = guess - slack
                        size = min(k, b - a)
                        floor[part] = np.sort(np.concatenate([floor[part], np.partition(under, b - a - size, axis=1)[:, b - a - size :]], axis=1), axis=1)[:, -k:]
                        over = guess + slack
                        row, col = np.nonzero((over >= floor[part, :1]) & (guess > -9))
                        out.append((part[row], ids[a:b][col], under[row, col], over[row, col]))
        if not out:
            return pa.table({"q": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "least": pa.array([], pa.float64()), "most": pa.array([], pa.float64())})
        at, other, least, most = (np.concatenate(x) for x in zip(*out, strict=True))
        stays = most >= floor[at, 0]  # what was let through before its query's bound was known goes now
        return pa.table({"q": names[at[stays]], "vec_id": other[stays], "least": least[stays], "most": most[stays]})

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarity of pairs of vectors."""
    for batch in batches:
        if batch.num_rows:
            exact = np.einsum("ij,ij->i", matrix(batch.column(2)), matrix(batch.column(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(exact, 6))], names=["vec_id", "neighbour_id", "similarity"])


def neighbours(
    df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 10, every: int = 20, target: float = 0.97, bits: int = 256, epsilon: float = 1.5, probe_sample: int = 256, rounds: int = 3,
    part_rows: int = 32768, part_queries: int = 4096, max_cells: int = 1 << 15,
) -> DataFrame:
    """``vec_id, rank, neighbour_id, similarity`` for every usable vector whose id is divisible by ``every``."""
    spark = df.sparkSession
    sc = spark.sparkContext
    vectors = stored(unit_vectors(df, id_column, vector_column), "vectors")
    n = vectors.count()
    asking = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    if n < 2 or asking.isEmpty():
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, similarity double")
    cells = min(max(1, round(n**0.5 / 2)), max_cells)
    c = centroids(vectors, cells, rounds)
    probes = min(cells, probes_needed(vectors, asking, c, probe_sample, k, target))
    size = code_size(c.shape[1], bits)
    c_held, turn_held = sc.broadcast(c), sc.broadcast(rotation(size)[: c.shape[1]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, turn = c_held.value, turn_held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = matrix(part.column(1))
                cell = nearest(x, c)
                codes, length, inner = encode(x - c[cell], turn)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cell, pa.int32()), _binary(codes), pa.array(length), pa.array(inner), pa.array((x * c[cell]).sum(1))], names=["vec_id", "cell", "code", "length", "inner", "along"])

    placed = stored(vectors.mapInArrow(place, "vec_id long, cell int, code binary, length double, inner double, along double"), "placed")
    # At most ``max_cells`` rows.
    counts = np.zeros(cells, np.int64)
    for cell, held in placed.groupBy("cell").count().collect():
        counts[cell] = held
    block, parts = blocks(c, counts, part_rows)
    cut_held = sc.broadcast((block, parts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and each block that holds some of its cells, the nearest first."""
        c, (block, parts) = c_held.value, cut_held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, max(1, (1 << 21) // cells)):
                part = batch.slice(lo, max(1, (1 << 21) // cells))
                x = matrix(part.column(1))
                far = (c**2).sum(1)[None] - 2 * x @ c.T
                first = np.argpartition(far, probes - 1, axis=1)[:, :probes] if probes < cells else np.tile(np.arange(cells), (len(x), 1))
                first = np.take_along_axis(first, np.argsort(np.take_along_axis(far, first, 1), axis=1, kind="stable"), 1)
                own, cell = np.repeat(np.arange(len(x)), probes), first.reshape(-1)
                times = parts[cell]
                nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                own, cell, where = np.repeat(own, times), np.repeat(cell, times), np.repeat(block[cell], times) + nth
                by = np.lexsort((np.arange(len(own)), where, own))
                own, cell, where = own[by], cell[by], where[by]
                begin = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (where[1:] != where[:-1])))
                rows = pa.array(own[begin])
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(own)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(where[begin]), lists], names=["q", "v", "block", "cells"])

    cut = F.broadcast(spark.createDataFrame([(i, int(b), int(p)) for i, (b, p) in enumerate(zip(block, parts, strict=True))], "cell int, block long, parts long"))
    here = placed.join(cut, "cell").select("vec_id", "cell", "code", "length", "inner", "along", (F.col("block") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("block"))
    questions = asking.mapInArrow(ask, "q long, v array<float>, block long, cells array<int>")
    asked = asking.count()
    shares = max(1, -(-asked // part_queries))
    here = here.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))) if shares > 1 else here.withColumn("share", F.lit(0))
    questions = questions.withColumn("share", F.pmod(F.xxhash64("q"), F.lit(shares)).cast("int"))
    found = here.groupBy("block", "share").cogroup(questions.groupBy("block", "share")).applyInArrow(_search(k, epsilon, c_held, turn_held), _CANDIDATE)
    # The bound of all blocks together; then vectors come to the few candidates left.
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("least")))
    floor = F.min(F.when(F.col("nth") == k, F.col("least"))).over(Window.partitionBy("q"))
    left = found.withColumn("nth", nth).withColumn("floor", floor).where("floor is null or most >= floor").select("q", "vec_id")
    own = asking.select(F.col("vec_id").alias("q"), F.col("v").alias("w"))
    own = F.broadcast(own) if asked * c.shape[1] * 4 <= BROADCAST_BYTES else own
    pairs = left.join(vectors.select("vec_id", "v"), "vec_id").join(own, "q").select("q", "vec_id", "v", "w")
    exact = pairs.mapInArrow(_compared, "vec_id long, neighbour_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return exact.withColumn("rank", rank.cast(T.IntegerType())).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "similarity")


def _binary(words: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(words.shape[1] * 8), len(words), [None, pa.py_buffer(np.ascontiguousarray(words).tobytes())]).cast(pa.binary())
