"""Near-duplicate documents by min-max hashing.

Every permutation of a document's word shingles gives two values, the least and the
greatest hash, so ``values`` signature values cost half as many hash evaluations;
both collide with probability J (Jaccard similarity), and their mean has a lower
variance than that of as many minima.  The first values are banded for candidates (by default 32 buckets of four, which leave out
5 % of pairs at the threshold; 64 of three leave out 0.001 % and cost twice the rows); a
candidate is compared by the share of equal values among all ``CHECKED``, of each of which two bits are
kept: an estimate with a standard deviation of about 0.02, so that chance adds up to
next to nothing even where thousands of documents share a passage.

Plan.  One narrow pass sketches all texts.  Documents of one signature collapse to
one.  Of the rest, ``(bucket, doc)`` rows are counted by bucket, with partial sums before the shuffle, to find buckets with
company; the few rows that have any fetch their code and meet in their bucket, sorted,
where each is compared with the bucket's *leaders* and becomes one if it resembles
none.  A bucket of more than ``BLOCK`` rows is cut into blocks by a hash of the document; the leaders of
each block (a block of copies has one) then meet those of every other block, a pair of blocks a group, so that no task holds
more than two blocks.  No pairs are written but links, and nothing is capped.  Documents that are alike only below the threshold
are all leaders: each comparison is a few operations on packed words, but there are as many as pairs.
Links are joined into groups by alternating large-star and small-star steps.  What resembles a document that is no leader, but not its leader, is
then looked for in those buckets that hold several groups, one of them of several rows: all rows of different groups are compared, but for
those that distances from a leader rule out, and the groups that a link joins become one.  So the groups are those of all similar pairs that
share a bucket.

Result: ``doc_id, group_id, keep`` for every distinct doc_id; ``group_id`` is the
least doc_id of the group, the one that is kept.

Edge cases.  Null and empty texts, and texts without a word, resemble nothing and
stay; a text of fewer than ``shingle`` words is one shingle; rows of one doc_id are one
document (:func:`deduplicated` leaves one of them, that of the least hash over all its columns); rows with a null doc_id are left
alone; an empty table gives no rows; extra columns are ignored and handed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays
from .storage import dropped, free_name, stored

BROADCAST_IDS = 1_000_000
#: Values by which candidates are compared, or those that are banded if they are more; a multiple of 32.
CHECKED = 1024
#: Rows of a bucket that meet in one group.
BLOCK = 8192
#: Buckets of so many rows are gone through one by one, smaller ones all together.
LARGE = 192
_ODD_BITS = np.uint64(0x5555555555555555)
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, (4096, 2), dtype=np.uint64)


def signatures(texts: pa.Array, shingle: int, values: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, signature)``: the texts that have a word, and minimum and maximum of each permutation side by side."""
    hashes, _, _, counts = arrays.words(*arrays.raw(texts))
    grams, per = arrays.shingles(hashes, counts, shingle)
    rows = np.flatnonzero(per)
    out = np.empty((len(rows), values), np.uint64)
    if len(rows) == 0:
        return rows, out
    first = (np.cumsum(per) - per)[rows]
    for i in range(values // 2):
        v = grams * (_SEEDS[i, 0] << np.uint64(1) | np.uint64(1)) + _SEEDS[i, 1]
        out[:, 2 * i] = np.minimum.reduceat(v, first)
        out[:, 2 * i + 1] = np.maximum.reduceat(v, first)
    return rows, out


def band_hashes(signature: np.ndarray, rows_per_band: int) -> np.ndarray:
    """One 64-bit bucket for each band of each signature."""
    n, values = signature.shape
    bands = values // rows_per_band
    parts = signature[:, : bands * rows_per_band].reshape(n, bands, rows_per_band)
    out = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], n, 0)
    for j in range(rows_per_band):
        out = arrays.mix(out * arrays.BASE + parts[:, :, j])
    return out.view(np.int64)


def packed(signature: np.ndarray) -> np.ndarray:
    """Two bits of each value, 32 values a word."""
    two = (arrays.mix(signature) & np.uint64(3)).astype(np.uint8).reshape(len(signature), signature.shape[1] // 4, 4)
    return (two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6).view(np.uint64)


def different(a: np.ndarray, b: np.ndarray, axis: int = 1) -> np.ndarray:
    """How many values differ between rows of packed words."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & _ODD_BITS).sum(axis, dtype=np.int32)


def sketches(df: DataFrame, id_column: str, text_column: str, shingle: int, values: int, rows_per_band: int) -> DataFrame:
    """``doc_id, bands, code``, with nulls for texts without a word."""
    checked = max(values, CHECKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.eased(batches):
            texts = arrays.text_column(batch.column(1))
            for lo, hi in arrays.slices(texts):
                rows, signature = signatures(texts.slice(lo, hi - lo), shingle, checked)
                bands = band_hashes(signature[:, :values], rows_per_band)
                code = packed(signature)
                some = np.full(hi - lo, -1)
                some[rows] = np.arange(len(rows))
                take = pa.array(some, pa.int64(), mask=some < 0)
                band_list = pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1)), bands.shape[1]).cast(pa.list_(pa.int64()))
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(checked // 4), len(rows), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), band_list.take(take), codes.take(take)], names=["doc_id", "bands", "code"])

    source = df.select(df[id_column].cast("long").alias("doc_id"), df[text_column].cast("string").alias("text")).where("doc_id is not null")
    return source.mapInArrow(run, "doc_id long, bands array<long>, code binary")


def _most_different(values: int, threshold: float) -> int:
    """How many of the values checked may differ: a quarter of unequal ones has equal bits."""
    return int(max(values, CHECKED) * (1 - threshold) * 0.75)


def leaders_of(codes: np.ndarray, most: int) -> np.ndarray:
    """For each row the row that it is linked to, or itself."""
    leader = np.arange(len(codes))
    left = leader.copy()
    table = np.ascontiguousarray(codes.T)
    at = 0
    while at < len(left):
        own = left[at]
        if leader[own] == own:
            like = (different(table[:, at + 1 :], table[:, at : at + 1], 0) <= most) & (leader[left[at + 1 :]] == left[at + 1 :])
            leader[left[at + 1 :][like]] = own
            if 2 * np.count_nonzero(like) > len(like):  # of what is left a table of its own
                stay = np.append(np.full(at + 1, False), ~like)
                left, table, at = left[stay], np.ascontiguousarray(table[:, stay]), 0
                continue
        at += 1
    return leader


def _link(values: int, threshold: float):
    """Rows (``bucket, block, blocks, doc_id, code``) in order of bucket, block and doc: links each to a leader of its block (``a, b``), or makes it
    one.  Leaders of buckets with several blocks are given back too, without ``b``."""
    words, most = max(values, CHECKED) // 32, _most_different(values, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the leaders of the group that the last batch ended in

        def heads(bucket, block, ids, codes):
            none = np.full(len(ids), True)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids, mask=none), pa.array(bucket), pa.array(block), pa.array(np.full(len(ids), 0), pa.int64(), mask=none), _codes(codes)], names=_LINKED)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            bucket, block, blocks, ids = (batch.column(i).to_numpy() for i in range(4))
            codes = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, words)
            if held is not None:
                bucket, block, blocks, ids, codes = (np.concatenate([x, y]) for x, y in zip(held, (bucket, block, blocks, ids, codes), strict=True))
            begin = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])))
            size = np.diff(np.append(begin, len(bucket)))
            leader = np.arange(len(ids))
            for first, n in zip(begin[size >= LARGE].tolist(), size[size >= LARGE].tolist(), strict=True):
                leader[first : first + n] = first + leaders_of(codes[first : first + n], most)
            left = np.flatnonzero(np.repeat(size < LARGE, size))
            group = np.repeat(np.arange(len(size)), size)
            while len(left):
                new = np.append(True, group[left][1:] != group[left][:-1])
                own = left[np.flatnonzero(new)[np.cumsum(new) - 1]]
                like = np.empty(len(left), bool)
                for lo in range(0, len(left), 16384):
                    part = slice(lo, lo + 16384)
                    like[part] = different(codes[left[part]], codes[own[part]]) <= most
                leader[left[like]] = own[like]
                left = left[~like & ~new]
            linked = ids != ids[leader]
            n, none = int(linked.sum()), np.full(int(linked.sum()), True)
            empty = np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[leader[linked]]), *(pa.array(empty, mask=none) for _ in range(3)), pa.array([None] * n, pa.binary())], names=_LINKED)
            is_head = leader == np.arange(len(ids))
            done = is_head & (blocks > 1) & (group < group[-1])
            if done.any():
                yield heads(bucket[done], block[done], ids[done], codes[done])
            last = is_head & (group == group[-1])
            held = bucket[last], block[last], blocks[last], ids[last], codes[last]
        if held is not None and held[2][0] > 1:
            bucket, block, _, ids, codes = held
            yield heads(bucket, block, ids, codes)

    return run


_LINKED = ["a", "b", "bucket", "block", "other", "code"]


def _codes(codes: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1] * 8), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())


def _cross(values: int, threshold: float):
    """Links each leader of the later of two blocks to one that it resembles of the earlier."""
    most = _most_different(values, threshold)

    def run(table: pa.Table) -> pa.Table:
        late = table.column("late").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("doc_id").to_numpy()
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint64).reshape(len(ids), -1)
        first, second, codes_second = ids[~late], ids[late], codes[late]
        order = np.argsort(first)
        found, left = np.full(len(second), -1), np.arange(len(second))
        turned = np.ascontiguousarray(codes_second.T)
        for i, code in zip(first[order].tolist(), codes[~late][order], strict=True):
            if len(left) == 0:
                break
            like = different(turned, code[:, None], 0) <= most
            if like.any():
                found[left[like]] = i
                left, turned = left[~like], np.ascontiguousarray(turned[:, ~like])
        some = found >= 0
        return pa.table({"a": second[some], "b": found[some].astype(np.int64)})

    return run


def candidates(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b`` of documents of one signature, and ``bucket, doc_id, n`` of one of each signature, where a bucket has ``n`` of them, two at least."""
    some = sketched.where("code is not null")
    # Equal signatures collapse to the least id.  Only ids and hashes move; a hot
    # signature is a skewed join of 24-byte rows, not an array.
    keyed = some.select("doc_id", F.xxhash64("code").alias("m"), F.xxhash64("bands").alias("x"))
    same = stored(keyed.groupBy("m", "x").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("n")), "same")
    exact = keyed.join(same.where("n > 1"), ["m", "x"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    apart = some.join(same.select(F.col("b").alias("doc_id")), "doc_id", "left_semi")
    buckets = apart.select("doc_id", F.explode("bands").alias("bucket"))
    counts = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return exact, stored(buckets.join(counts, "bucket").select("bucket", "doc_id", "n"), "company")


def links(sketched: DataFrame, exact: DataFrame, company: DataFrame, values: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """``a, b``: ``exact``, and of each bucket the links to leaders; :func:`links_between` finds those that these leave open."""
    some = sketched.where("code is not null")
    company = company.withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    company = company.withColumn("block", F.pmod(F.xxhash64("doc_id", "bucket"), F.col("blocks")))
    meeting = company.join(some.select("doc_id", "code"), "doc_id").select("bucket", "block", "blocks", "doc_id", "code")
    met = meeting.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "doc_id").mapInArrow(_link(values, threshold), "a long, b long, bucket long, block long, other long, code binary")
    met = stored(met, "met")
    near = met.where("b is not null").select("a", "b")
    if met.where("b is null").isEmpty():
        return exact.unionByName(near).where("a != b").distinct()
    # Leaders of the blocks of one bucket: each pair of blocks is a group.
    heads = met.where("b is null").select("bucket", "block", F.col("a").alias("doc_id"), "code")
    ends = heads.groupBy("bucket").agg(F.max("block").alias("last")).where("last > 0")
    others = heads.join(ends, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).where("other <> block")
    pairs = others.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).alias("late"), "doc_id", "code")
    near = near.unionByName(pairs.groupBy("bucket", "lo", "hi").applyInArrow(_cross(values, threshold), "a long, b long"))
    return exact.unionByName(near).where("a != b").distinct()


def _between(values: int, threshold: float):
    """Pairs of groups (``a, b``) that a pair of similar rows (``doc_id, root, visits, code``) joins: rows that visit with those that don't, or all
    with all if none does.

    The rows of the fewer groups are cut into balls around leaders.  The number of unequal values is a metric, so a row is compared only with
    those of a ball whose distance from the leader differs from its own by no more than alike ones may."""
    most = _most_different(values, threshold)

    def run(table: pa.Table) -> pa.Table:
        root = table.column("root").to_numpy()
        visits = table.column("visits").to_numpy(zero_copy_only=False).astype(bool)
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint64).reshape(len(root), -1)
        one = not visits.any()
        x, y = (np.arange(len(root)),) * 2 if one else (np.flatnonzero(~visits), np.flatnonzero(visits))
        if len(np.unique(root[x])) > len(np.unique(root[y])):
            x, y = y, x
        x = x[np.argsort(root[x], kind="stable")]
        begin = np.flatnonzero(np.append(True, root[x][1:] != root[x][:-1])) if len(x) else []
        out: list[tuple[int, int]] = []
        for own in np.split(x, begin[1:]) if len(x) else []:  # a block may have visitors only
            if one and len(own) == 1:  # single rows are leaders and have met, and groups of several meet them
                continue
            left = y[root[y] != root[own[0]]]
            leader = leaders_of(codes[own], most)
            for at in np.unique(leader):
                if len(left) == 0:
                    break
                ball = own[leader == at]
                near, far = (different(codes[rows], codes[own[at]][None]) for rows in (ball, left))
                some = far <= most + near.max()
                hits = _joined_roots(codes, root, ball, near, left[some], far[some], most)
                out += [(int(root[own[0]]), r) for r in hits]
                left = left[~np.isin(root[left], hits)] if hits else left
            if one:
                y = y[root[y] != root[own[0]]]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _joined_roots(codes: np.ndarray, root: np.ndarray, ball: np.ndarray, near: np.ndarray, others: np.ndarray, far: np.ndarray, most: int) -> list[int]:
    """The roots of those ``others`` that resemble a row of the ball; ``near`` and ``far`` are the distances from its leader."""
    out: list[int] = []
    if len(ball) <= len(others):
        for own, r in zip(ball, near, strict=True):
            at = others[np.abs(far - r) <= most]
            hits = np.unique(root[at[different(codes[at], codes[own][None]) <= most]])
            if len(hits):
                out += hits.tolist()
                stay = ~np.isin(root[others], hits)
                others, far = others[stay], far[stay]
        return out
    for other, r in zip(others, far, strict=True):
        if root[other] not in out and (different(codes[ball[np.abs(near - r) <= most]], codes[other][None]) <= most).any():
            out.append(int(root[other]))
    return out


def links_between(sketched: DataFrame, company: DataFrame, found: DataFrame, values: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """``a, b``: groups of ``found`` (``doc_id, group_id``) that belong together, as documents of theirs that are not leaders are alike.

    A bucket of one group, or whose rows are each a group of its own (all leaders), is settled.  In others all pairs of different groups meet but
    pairs of single rows: the rows outside the largest group, or those of groups of several if they are fewer, visit all.  If a bucket has more
    than ``block`` rows, visitors and visited are both cut into blocks."""
    rows = stored(company.where("n > 2").join(found, "doc_id", "left").select("bucket", "doc_id", F.coalesce("group_id", "doc_id").alias("root")), "roots")
    per = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    several = F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0).cast("long"))
    open_ = per.groupBy("bucket").agg(F.count(F.lit(1)).alias("groups"), F.sum("c").alias("n"), F.max("c").alias("largest"), F.max_by("root", F.struct("c", "root")).alias("main"), several.alias("several")).where("1 < groups and groups < n")
    open_ = open_.withColumn("outside", F.col("n") - F.col("largest") <= F.col("several"))
    open_ = open_.withColumn("blocks", F.ceil(F.col("n") / block).cast("long")).withColumn("parts", F.ceil(F.least(F.col("n") - F.col("largest"), "several") / block).cast("long"))
    every, rows = rows, stored(rows.join(open_.drop("groups", "largest", "several"), "bucket").join(per, ["bucket", "root"]), "open")
    dropped(every)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "bucket"), F.col("blocks"))).withColumn("part", F.expr("block * parts div blocks"))
    no = F.lit(0).cast("long")
    own = rows.withColumn("part", F.explode(F.sequence(no, F.col("parts") - 1))).withColumn("visits", F.lit(False))
    guests = rows.where("blocks > 1 and if(outside, root <> main, c > 1)").withColumn("block", F.explode(F.sequence(no, F.col("blocks") - 1))).withColumn("visits", F.lit(True))
    meeting = own.unionByName(guests).select("bucket", "block", "part", "doc_id", "root", "visits")
    meeting = meeting.join(sketched.where("code is not null").select("doc_id", "code"), "doc_id")
    return meeting.groupBy("bucket", "block", "part").applyInArrow(_between(values, threshold), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``doc_id, group_id``: the least id that each id of the undirected ``edges`` (``a, b``) is joined to.

    Large-star and small-star steps in turn until nothing changes; each round is
    written to the shared folder, so that lineage stays short."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        state = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least("a", F.min("b").over(Window.partitionBy("a")))
        large = both.select("a", "b", least.alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        m = F.min("b").over(Window.partitionBy("a"))
        small = large.select("a", "b", m.alias("m")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        before, now = now, stored(small.where("a != b").distinct(), "edges")
        dropped(before)
    return now.select(F.col("a").alias("doc_id"), F.col("b").alias("group_id"))


def groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, values: int = 128, rows_per_band: int = 4, threshold: float = 0.55, block: int = BLOCK) -> DataFrame:
    """``doc_id, group_id, keep`` for every distinct, non-null doc_id."""
    sketched = stored(sketches(df, id_column, text_column, shingle, values, rows_per_band), "sketches")
    exact, company = candidates(sketched)
    found = components(links(sketched, exact, company, values, threshold, block))
    between = stored(links_between(sketched, company, found, values, threshold, block), "between")
    if not between.isEmpty():
        joined = components(between).select(F.col("doc_id").alias("group_id"), F.col("group_id").alias("least"))
        # A document alone may now be in a group too.
        found = found.unionByName(joined.select(F.col("group_id").alias("doc_id"), "group_id")).distinct()
        found = found.join(joined, "group_id", "left").select("doc_id", F.coalesce("least", "group_id").alias("group_id"))
    ids = sketched.select("doc_id").distinct()
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id")).withColumn("keep", F.col("group_id") == F.col("doc_id"))


def deduplicated(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", broadcast_ids: int = BROADCAST_IDS, **options) -> DataFrame:
    """The rows of ``df``, with its columns, that are the one of their group that stays.

    Ids that go are broadcast up to ``broadcast_ids``, so that texts stay where they are;
    beyond that it is a shuffled join.  Only rows of ids that occur more than once are
    brought together to leave one of each."""
    key = df[id_column].cast("long")
    gone = stored(groups(df, id_column, text_column, **options).where("not keep").select(F.col("doc_id").alias("k")), "gone")
    rest = df.join(_small(gone, broadcast_ids), key == gone["k"], "left_anti")
    again = stored(df.select(key.alias("k")).where("k is not null").groupBy("k").count().where("count > 1").select("k"), "again")
    if again.isEmpty():
        return rest
    plain = [df[f.name] for f in df.schema if "map<" not in f.dataType.simpleString()]
    nth, mark = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*plain))), free_name(df, "nth")
    twice = _small(again, broadcast_ids)
    once = rest.join(twice, key == again["k"], "left_semi").withColumn(mark, nth).where(F.col(mark) == 1).drop(mark)
    return rest.join(twice, key == again["k"], "left_anti").unionByName(once)


def _small(ids: DataFrame, most: int) -> DataFrame:
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids
