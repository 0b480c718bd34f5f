"""Repeated substrings over all documents, by bucket-pointer refinement of suffixes.

A byte goes if it lies in a 50-byte string that also starts in a document with a smaller id. Only
the order of suffixes up to 50 bytes matters for that, and only whether two of them fall into the
same bucket. Buckets are named by their content, so that every task gives a bucket the same
identifier without a global sort:

* 1-byte buckets are refined to 2, 4, 8, 16, 32 and 50 bytes by the pair of the identifiers at
  offset 0 and at a later offset; each round reuses the identifiers of the round before;
* the 50-byte suffix at a position joins the 16-byte bucket whose identifier is smallest among the
  35 that lie inside it, a later offset that equal suffixes share. Runs of neighbouring suffixes
  choose the same bucket, so that a bucket holds runs, not single suffixes. A bucket that only one
  document reaches is settled;
* in the others, runs are refined by the identifiers of their first and last 50-byte bucket, which
  together cover the run: equal runs repeat as a whole;
* where a bucket holds different runs, the first of each is cut where its suffixes reach further to
  the left or to the right of the 16 bytes, and refined by the 33 bytes on that side; what is still
  mixed is refined to its 50-byte buckets.

The documents are kept once, in compressed batches, in a table bucketed by batch; the later steps meet
it there. A batch settles what its own documents show (a run that a smaller document of the batch has
too), so that a passage in many documents reaches its bucket once per batch.

Defined results
---------------
* null text has no bytes; texts below 50 bytes lose nothing;
* ids may be of any type that Spark orders; documents with equal ids are not smaller than one another; a null id is
  larger than any other;
* rows that are equal in id and text get equal results;
* an empty table gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .blocks import cuts, grouped, sorted_in, sorted_out, spread, squeeze, unsqueeze
from .common import bucketed, free_name, materialize, table

WIDTH = 50
GRAM = 16
CHOICES = WIDTH - GRAM + 1
#: Bytes that are refined together; longer documents are cut into overlapping pieces.
PIECE = 1 << 20
#: Text and rows that a batch holds.
BATCH_BYTES, BATCH_ROWS = 12 << 20, 50_000
#: Text whose buckets one part answers for on average at most.
PART_BYTES = 64 << 20
#: Bytes that a suffix reaches beyond its 16 on one side at least.
SIDE = (WIDTH - GRAM) // 2
#: In a packed (position, length, flag): bits of the length, and the flag of a run settled in its batch.
LEN_BITS, SETTLED, ROW_SHIFT = 6, 1 << 6, 40
LAST_ID = (1 << 63) - 1

_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of the bucket that joins bucket ``a`` with bucket ``b`` at a later offset."""
    x = a * _A
    x += b * _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def refined(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers of the 16-, 32- and 50-byte bucket at each position that has one."""
    h, k = _BYTES[data], 1
    while k < GRAM:
        h = _pair(h[:-k], h[k:])
        k *= 2
    h32 = _pair(h[:-GRAM], h[GRAM:])
    return h, h32, _pair(h32[: -(WIDTH - 32)], h32[WIDTH - 32 :])


def _least(h: np.ndarray) -> np.ndarray:
    """The smallest of each CHOICES (35) neighbouring identifiers."""
    m, k = h, 1
    while 2 * k <= CHOICES:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[: len(m) - (CHOICES - k)], m[CHOICES - k :])


def _least_from(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The same at the positions ``p`` only."""
    m = h[p]
    for k in range(1, CHOICES):
        np.minimum(m, h[p + k], out=m)
    return m


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of (row, offset, bytes) of about PIECE bytes; pieces of one text overlap by WIDTH - 1."""
    rows, offsets, parts, size = [], [], [], 0
    for r, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WIDTH + 1), PIECE):
            part = t[at : at + PIECE + WIDTH - 1]
            if len(part) < WIDTH:
                continue
            rows.append(r)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
    if parts:
        yield rows, offsets, parts


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``row, position, length, bucket, name`` of the runs of suffixes in all texts."""
    out = []
    for rows, offsets, parts in _pieces(texts):
        data = np.frombuffer(b"".join(parts), np.uint8)
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        h16, _, h50 = refined(data)
        least = _least(h16)
        ends = np.cumsum(lens)
        part = np.repeat(np.arange(len(parts)), lens - (WIDTH - 1))
        begin = ends - lens
        count = lens - (WIDTH - 1)
        at = np.arange(len(part)) + np.repeat(begin - (np.cumsum(count) - count), count)
        m = least[at]
        new = np.empty(len(at), bool)
        new[:1] = True
        np.not_equal(m[1:], m[:-1], out=new[1:])
        new[1:] |= part[1:] != part[:-1]
        first = np.flatnonzero(new)
        length = np.diff(first, append=len(at))
        if (length > CHOICES).any():  # periodic text: no run may outgrow what its first and last bucket cover
            cuts = -(-length // CHOICES)
            step = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            length = np.minimum(CHOICES, np.repeat(length, cuts) - CHOICES * step)
            first = np.repeat(first, cuts) + CHOICES * step
        left, p = at[first], part[first]
        name = _pair(h50[left], h50[left + length - 1]) + length.astype(np.uint64) * _A
        out.append((np.array(rows)[p], left - begin[p] + np.array(offsets)[p], length, m[first], name))
    return _joined(out)


def _located(texts: list[bytes], row: np.ndarray, pos: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs sorted by row: groups of ``data``, and of each suffix its place in it, its row and its position."""
    def group(items):
        data = np.frombuffer(b"".join(part for part, *_ in items), np.uint8)
        base = np.cumsum([0, *(len(part) for part, *_ in items)])
        n = np.concatenate([length[a:b] for _, _, a, b in items])
        first = np.concatenate([pos[a:b] - at + o for (_, at, a, b), o in zip(items, base, strict=False)])
        runs_ = np.concatenate([np.arange(a, b) for _, _, a, b in items])
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return data, np.repeat(first, n) + step, np.repeat(row[runs_], n), np.repeat(pos[runs_], n) + step

    items, size = [], 0
    for a, b in _bounds(row):
        t = texts[int(row[a])]
        for at in range(0, len(t), PIECE):
            lo, hi = a + np.searchsorted(pos[a:b], at), a + np.searchsorted(pos[a:b], at + PIECE)
            if lo < hi:
                part = t[at : at + PIECE + CHOICES + WIDTH]
                items.append((part, at, int(lo), int(hi)))
                size += len(part)
                if size >= PIECE:
                    yield group(items)
                    items, size = [], 0
    if items:
        yield group(items)


def _bounds(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    if not len(sorted_keys):
        return []
    starts = _groups(sorted_keys)
    return list(zip(starts.tolist(), np.append(starts[1:], len(sorted_keys)).tolist(), strict=True))


def sided(texts: list[bytes], row: np.ndarray, pos: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Like :func:`runs`, for the given runs, cut by the side of the 16 bytes that their suffixes reach further to."""
    out = []
    for data, p, r, at in _located(texts, row, pos, length):
        h16, h32, h50 = refined(data)
        near = _least_from(h16, p)
        offset = np.zeros(len(p), np.int64)
        for k in range(CHOICES - 1, -1, -1):  # the first place of the 16 bytes in the suffix
            offset[h16[p + k] == near] = k
        anchor, left = p + offset, offset >= SIDE
        bucket = np.empty(len(p), np.uint64)
        a = anchor[left]
        bucket[left] = _pair(h32[a - SIDE], h16[a])
        a = anchor[~left]
        bucket[~left] = _pair(h32[a], h16[a + SIDE]) ^ _C
        first = _groups(r, anchor, left, at - np.arange(len(at)))
        n = np.diff(first, append=len(p))
        name = _pair(h50[p[first]], h50[p[first] + n - 1]) + n.astype(np.uint64) * _A
        out.append((r[first], at[first], n, bucket[first], name))
    return _joined(out)


def single(texts: list[bytes], row: np.ndarray, pos: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Like :func:`runs`, for each suffix of the given runs on its own."""
    out = []
    for data, p, r, at in _located(texts, row, pos, length):
        h16, _, h50 = refined(data)
        near = _least_from(h16, p)
        out.append((r, at, np.ones(len(p), np.int64), _pair(near, h50[p]), h50[p]))
    return _joined(out)


def _joined(out: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    if not out:
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where the groups of equal neighbours begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _least_of_group(doc: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.minimum.reduceat(doc, starts), np.diff(starts, append=len(doc)))


def _packed(row: np.ndarray, pos: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Row of the batch, position and length of a run in one number that sorts by them."""
    return (row << ROW_SHIFT) | (pos << (LEN_BITS + 1)) | length


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pos = (packed & ((1 << ROW_SHIFT) - 1)) >> (LEN_BITS + 1)
    return packed >> ROW_SHIFT, pos, packed & ((1 << LEN_BITS) - 1)


#: What is sent to the buckets; ``doc`` orders documents.
SENT = "bucket long, name long, doc long, batch long, packed long"
_NAMES = ["bucket", "name", "doc", "batch", "packed"]


def _sent(found: tuple[np.ndarray, ...], doc: np.ndarray, batch: int) -> pa.Table:
    row, pos, length, bucket, name = found
    packed = _packed(row, pos, length)
    d = doc[row]
    order = np.lexsort((name, bucket))
    n, b = name[order], bucket[order]
    if len(order):
        settled = np.zeros(len(order), bool)
        settled[order] = d[order] > _least_of_group(d[order], _groups(n, b))
        packed = packed | np.where(settled, SETTLED, 0)
        # what is settled needs no bucket; it is dealt out evenly
        bucket = np.where(settled, _pair(name, packed.astype(np.uint64)), bucket)
    columns = (bucket.view(np.int64), name.view(np.int64), d, np.full(len(d), batch), packed)
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=_NAMES)


#: What the buckets decide: a run to remove, or one to be refined further.
DECIDED = "batch long, packed long, remove boolean"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        bucket, name, doc, batch, packed = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        done = (packed & SETTLED) != 0
        out = [(batch[done], packed[done], np.ones(done.sum(), bool))]
        bucket, name, doc, batch, packed = (x[~done] for x in (bucket, name, doc, batch, packed))
        if len(bucket):
            starts = _groups(bucket)
            several = np.repeat(np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts), np.diff(starts, append=len(doc)))
            bucket, name, doc, batch, packed = (x[several] for x in (bucket, name, doc, batch, packed))
        if len(bucket):
            order = np.lexsort((name, bucket))
            bucket, name, doc, batch, packed = (x[order] for x in (bucket, name, doc, batch, packed))
            remove = doc > _least_of_group(doc, _groups(bucket, name))
            starts = _groups(bucket)
            mixed = np.repeat(name[starts] != name[np.append(starts[1:], len(name)) - 1], np.diff(starts, append=len(name)))
            keep = remove | mixed
            out.append((batch[keep], packed[keep], remove[keep]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        columns[1] = columns[1] & ~np.int64(SETTLED)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["batch", "packed", "remove"])

    size = 0
    for rows in batches:
        columns = tuple(rows.column(k).to_numpy() for k in range(5))
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last bucket may go on
        if cut:
            held.append(tuple(c[:cut] for c in columns))
            size += cut
            if size >= 200_000:
                yield flush()
                size = 0
        held.append(tuple(c[cut:] for c in columns))
    if held:
        yield flush()


# ---------------------------------------------------------------- batches

BATCHES = "batch long, docs array<long>, keys array<long>, lengths array<long>, z binary"


def _batches(rows: DataFrame) -> DataFrame:
    """``doc, key, text`` as batches of about BATCH_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        number, docs, keys, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def close() -> pa.RecordBatch:
            z = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([docs], longs), pa.array([keys], longs), pa.array([[len(t) for t in texts]], longs), pa.array([z])], names=["batch", "docs", "keys", "lengths", "z"])

        for b in batches:
            for d, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                docs.append(d)
                keys.append(k)
                texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= BATCH_BYTES or len(docs) >= BATCH_ROWS:
                    yield close()
                    number, docs, keys, texts, size = number + 1, [], [], [], 0
        if docs:
            yield close()

    return rows.mapInArrow(run, BATCHES)


def _texts(row: dict) -> list[bytes]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(row["z"])
    ends = np.cumsum(row["lengths"]).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _reached(parts: int):
    """Sends the 16-byte buckets that a batch reaches; a bit says whether two of its documents do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                found, doc = runs(_texts(row)), np.array(row["docs"], np.int64)
                keys, several = _buckets_of(found, doc)
                sent = [(p, row["batch"], sorted_out(keys[a:b]), squeeze(several[a:b])) for p, a, b in cuts(keys, parts)]
                columns = list(zip(*sent, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "batch", "keys", "several"])

    return run


def _buckets_of(found: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, bucket = doc[found[0]], found[3]
    if not len(bucket):
        return bucket, np.empty(0, np.uint8)
    order = np.argsort(bucket)
    b, d = bucket[order], d[order]
    starts = _groups(b)
    return b[starts], (np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts)).astype(np.uint8)


def _shared(part: pa.Table) -> pa.Table:
    """For each bucket sent, whether several documents reach it."""
    rows = part.to_pylist()
    order, starts, lens = grouped([r["keys"] for r in rows])
    several = np.concatenate([unsqueeze(r["several"], np.uint8) for r in rows])[order]
    shared = (np.diff(starts, append=len(order)) > 1) | (np.maximum.reduceat(several, starts) > 0)
    out = np.split(spread(shared.astype(np.uint8), order, starts), np.cumsum(lens)[:-1])
    columns = [[r["batch"] for r in rows], [r["part"] for r in rows], [squeeze(x) for x in out]]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["batch", "part", "shared"])


def _tables(tables: list[pa.Table], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.concat_tables([*tables, pa.table({n: pa.array([], k) for n, k in schema})])


_SENT_SCHEMA = [(n, pa.int64()) for n in _NAMES]


def _send_shared(left: pa.Table, right: pa.Table) -> pa.Table:
    """The runs of a batch in buckets that several documents reach."""
    out = []
    answers = [unsqueeze(r["shared"], np.uint8) for r in sorted(right.to_pylist(), key=lambda r: r["part"])]
    for row in left.to_pylist():
        found, doc = runs(_texts(row)), np.array(row["docs"], np.int64)
        if answers:
            shared = np.concatenate(answers).astype(bool)[np.searchsorted(np.unique(found[3]), found[3])]
            out.append(_sent(tuple(x[shared] for x in found), doc, row["batch"]))
    return _tables(out, _SENT_SCHEMA)


def _send_again(how):
    """The runs given for a batch, refined further."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        packed = np.sort(right.column("packed").to_numpy())
        out = [_sent(how(_texts(row), *_unpacked(packed)), np.array(row["docs"], np.int64), row["batch"]) for row in left.to_pylist() if len(packed)]
        return _tables(out, _SENT_SCHEMA)

    return run


def _decided(sent: DataFrame, label: str) -> DataFrame:
    return materialize(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_decide, DECIDED), label)


def spans(pos: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the suffixes cover."""
    order = np.argsort(pos)
    start, end = pos[order], np.maximum.accumulate((pos + length + WIDTH - 1)[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True))


def _with_place(docs: DataFrame, id_col: str, place: str) -> DataFrame:
    """``docs`` with the place of each id in their order, counted over sorted partitions; null for a null id."""
    ids = docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    ids = materialize(ids.orderBy("id").select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "substring-ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = ids.groupBy("part").agg(F.count("*").alias("n"), F.min("pos").alias("first")).select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = ids.join(F.broadcast(parts), "part").select(F.col("id").alias(f"{place}_id"), (F.col("before") + F.col("pos") - F.col("first")).alias(place))
    return docs.join(placed, F.col(id_col) == F.col(f"{place}_id"), "left").drop(f"{place}_id")


def substring_deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", with_text: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (of removed bytes) and ``kept_sha256``.

    The text column is left out, or with ``with_text`` holds what is kept, as binary (a cut may fall inside a character).
    """
    # the id names a row where it is unique; else a hash does
    n = docs.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("d"), F.max(id_col).alias("last")).first()
    unique = n["n"] == n["d"]
    whole = isinstance(docs.schema[id_col].dataType, IntegralType) and n["last"] != LAST_ID
    place = free_name(docs, "_place")
    ordered = docs if whole else _with_place(docs, id_col, place)
    doc = F.coalesce(F.col(id_col if whole else place).cast("long"), F.lit(LAST_ID))
    key = doc if unique and whole else F.xxhash64(id_col, text_col)
    batches = bucketed(_batches(ordered.select(doc.alias("doc"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))), "batch", "substring-batches")
    n_bytes = batches.select(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))
    with_batch = lambda other, how, schema: batches.groupBy("batch").cogroup(other.groupBy("batch")).applyInArrow(how, schema)

    reached = batches.mapInArrow(_reached(parts), "part int, batch long, keys binary, several binary")
    shared = materialize(reached.groupBy("part").applyInArrow(_shared, "batch long, part int, shared binary"), "substring-shared")
    first = _decided(with_batch(shared, _send_shared, SENT), "substring-runs")
    second = _decided(with_batch(first.filter("not remove"), _send_again(sided), SENT), "substring-sides")
    third = _decided(with_batch(second.filter("not remove"), _send_again(single), SENT), "substring-single")
    removed = first.union(second).union(third).filter("remove").select("batch", "packed")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        packed = np.sort(right.column("packed").to_numpy())
        row, pos, length = _unpacked(packed)
        bounds = {int(row[a]): (a, b) for a, b in _bounds(row)}
        out = []
        for batch in left.to_pylist():
            for i, (k, t) in enumerate(zip(batch["keys"], _texts(batch), strict=True)):
                a, b = bounds.get(i, (0, 0))
                found = spans(pos[a:b], length[a:b]) if b > a else []
                edges = [0, *(x for s in found for x in s), len(t)]
                left_over = b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((k, len(t), len(t) - len(left_over), len(found), [x for s in found for x in s], hashlib.sha256(left_over).hexdigest(), left_over if with_text else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.binary())
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.Table.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], names=["key", *names, "kept"])

    names = ["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]
    result = with_batch(removed, finish, "key long, n_bytes long, n_removed long, n_spans long, spans array<bigint>, kept_sha256 string, kept binary")
    result = result if unique and whole else result.dropDuplicates(["key"])
    own, text = free_name(docs, "_key"), [F.col("kept").alias(text_col)] if with_text else []
    kept = [c for c in docs.columns if c not in names and c != text_col]
    results = result.select(F.col("key").alias(own), *(F.col(c).alias(c) for c in names), *text)
    own_key = key if unique and whole else F.xxhash64(id_col, text_col)
    return docs.select(*(F.col(f"`{c}`") for c in kept), own_key.alias(own)).join(results, own).drop(own)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
