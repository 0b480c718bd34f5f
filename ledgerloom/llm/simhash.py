"""SimHash near-duplicates, searched with vantage-point trees.

Distances from a vantage point to random 64-bit fingerprints lie close to 32, so that a tree over whole
fingerprints prunes hardly anything at 4 bits. The trees therefore measure the distance on three bands of
21, 21 and 22 bits: two fingerprints within 4 bits are within 1 in the first band, or within 1 in the
second, or equal in the third (else they differed in 2 + 2 + 1 bits). Each band has one tree, searched
with that radius.

A node of a tree holds a vantage point and the median distance to it; nearer fingerprints go to the left,
the others to the right, down to leaves, which are the shards. A fingerprint is at home in one leaf. The
triangle bound says on which side of a node its neighbours can be: where its ball overlaps the boundary,
it goes down both ways, and is a guest in the leaves it touches beyond its own. A pair meets in the leaf
where one of the two is at home and the other is, too, or is a guest; only leaves after one's own need to
be visited, since each pair has a later home. Within a leaf the distance to one more vantage point, over
all 64 bits, prunes again by the triangle bound; what is left is compared exactly.

The trees are grown from a sample: about SAMPLE_PER_LEAF fingerprints for each leaf of LEAF_ROWS, chosen by
a hash, MAX_SAMPLE at most (8 MB on the driver; its nodes are broadcast, 9 bytes each). The sample shapes
the leaves only; every fingerprint is at home in one. Leaves that turn out above MAX_LEAF rows, as those of
many near copies do, are cut into blocks by the distance to a vantage point, and pairs of blocks that the
triangle bound cannot exclude are rows of their own, so that no task has to hold a large leaf.

Defined results
---------------
* null or empty text, or one without words: fingerprint 0, linked like any other;
* fewer than 4 words: the whole sequence is the one shingle;
* a row with a null id has a fingerprint and no component of its own: it gets the smallest
  non-null id that is linked to it, or null;
* rows with equal ids each get a row; ties do not arise (a bit is set by strict majority);
* an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialize, shipped, table
from .graph import components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: (shift, width, radius) of the bands; the radii and one for each band sum to more than MAX_BITS.
BANDS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
#: Fingerprints that a leaf holds on average.
LEAF_ROWS = 2_000
SAMPLE_PER_LEAF = 8
#: Fingerprints of the sample at most, whatever the corpus.
MAX_SAMPLE = 1_000_000
#: Rows of a leaf, guests included, that one task takes at once; larger leaves are cut into blocks.
MAX_LEAF = 40_000
BLOCK_ROWS = 8_192
#: Rows that are compared with others at once.
CHUNK = 1_024


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the text's 4-word shingles, unsigned."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - SHINGLE_WORDS + 1)
    joined = memoryview(b" ".join(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(SHINGLE_WORDS, len(w)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        votes += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, fp)``, ``fp`` as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


# ------------------------------------------------------------------ the trees


@dataclass
class Tree:
    """A vantage-point tree of one band. Inner node k has children 2k + 1 (nearer) and 2k + 2; ``depth`` levels of inner nodes."""

    shift: int
    width: int
    radius: int
    depth: int
    vantage: np.ndarray
    median: np.ndarray

    def distance(self, fp: np.ndarray, node: np.ndarray) -> np.ndarray:
        x = ((fp ^ self.vantage[node]) >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)
        return np.bitwise_count(x).astype(np.int16)

    def leaves(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, leaf, guest)``: each fingerprint's home, and the later leaves that its ball touches."""
        home = np.zeros(len(fp), np.int64)
        row, node = np.arange(len(fp)), np.zeros(len(fp), np.int64)
        for _ in range(self.depth):
            home = 2 * home + 1 + (self.distance(fp, home) > self.median[home])
            d, m = self.distance(fp[row], node), self.median[node]
            near, far = d - self.radius <= m, d + self.radius > m
            row, node = np.concatenate((row[near], row[far])), np.concatenate((2 * node[near] + 1, 2 * node[far] + 2))
            # what lies left of the path home leads to earlier leaves only
            later = node >= home[row]
            row, node = row[later], node[later]
        return row, node, node != home[row]


def grow(sample: np.ndarray, shift: int, width: int, radius: int, depth: int) -> Tree:
    """A tree from a sample of fingerprints: of a node's sample, the vantage point is the one that spreads the others most."""
    size = (1 << depth) - 1
    tree = Tree(shift, width, radius, depth, np.zeros(size, np.uint64), np.full(size, 64, np.int16))
    of = [sample]
    for k in range(size):
        here, of[k] = of[k], None
        below = (here, here[:0])
        if len(here):
            tries = here[np.linspace(0, len(here) - 1, min(8, len(here))).astype(int)]
            mask = np.uint64(((1 << width) - 1) << shift)
            away = np.bitwise_count((here[None, :] ^ tries[:, None]) & mask).astype(np.int16)
            best = int(np.argmax(away.var(axis=1)))
            tree.vantage[k] = tries[best]
            # of the two cuts beside the median, the more even one
            d = away[best]
            middle = int(np.median(d))
            cut = min((middle, max(0, middle - 1)), key=lambda m: abs(int((d <= m).sum()) * 2 - len(d)))
            tree.median[k] = cut
            below = (here[d <= cut], here[d > cut])
        if 2 * k + 2 < size:
            of += below
    return tree


def _trees(points: DataFrame) -> list[Tree]:
    n = points.count()
    depth = max(0, (n // LEAF_ROWS).bit_length())
    want = min(MAX_SAMPLE, SAMPLE_PER_LEAF << depth) if depth else 0
    depth = min(depth, max(0, (want // SAMPLE_PER_LEAF).bit_length() - 1))
    chosen = points.filter(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, want / n))).select("fp") if depth else points.limit(0).select("fp")
    sample = np.array(sorted(r["fp"] for r in chosen.collect()), np.int64).view(np.uint64)  # about SAMPLE_PER_LEAF / LEAF_ROWS of all, at most MAX_SAMPLE
    return [grow(sample, *band, depth) for band in BANDS]


def shards(points: DataFrame) -> DataFrame:
    """``(leaf, guest, fp)`` of all trees' leaves."""
    sent = shipped(points.sparkSession, _trees(points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent()
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for k, tree in enumerate(trees):
                row, leaf, guest = tree.leaves(fp)
                yield pa.RecordBatch.from_arrays([pa.array((leaf << 2) | k), pa.array(guest), pa.array(fp[row].view(np.int64))], names=["leaf", "guest", "fp"])

    return points.select("fp").mapInArrow(run, "leaf long, guest boolean, fp long")


# ------------------------------------------------------------ inside the leaves


def link_leaf(fp: np.ndarray, guest: np.ndarray) -> np.ndarray:
    """For each of a leaf's fingerprints, the index of a representative of its component within the leaf.

    Pairs of guests are left out: they meet elsewhere. Sorted by the distance to a vantage point, so that
    the triangle bound cuts the chunks to compare; each pair of chunks is looked at once.
    """
    d = np.bitwise_count(fp ^ fp[0])
    order = np.lexsort((guest, d))
    x, d, g = fp[order], d[order].astype(np.int16), guest[order]
    n = len(x)
    root = np.arange(n)
    for a in range(0, n, CHUNK):
        b = min(a + CHUNK, n)
        for c in range(int(np.searchsorted(d, d[a] - MAX_BITS)) // CHUNK * CHUNK, b, CHUNK):
            e = min(c + CHUNK, b)
            i, j = np.nonzero(np.bitwise_count(x[a:b, None] ^ x[None, c:e]) <= MAX_BITS)
            i, j = i + a, j + c
            ok = (i > j) & ~(g[i] & g[j])
            i, j = i[ok], j[ok]
            while len(i):
                p, q = root[i], root[j]
                np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
                while (root != root[root]).any():
                    root = root[root]
                open_ = root[i] != root[j]
                i, j = i[open_], j[open_]
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leaf, guest, fp) sorted by leaf, each of which fits a task; gives links that span each leaf's components."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        leaf, guest, fp = (np.concatenate(p) for p in zip(*held, strict=True))
        held.clear()
        starts = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for s, e in zip(starts, np.append(starts[1:], len(leaf)), strict=True):
            if e - s > 1:
                x = fp[s:e]
                to = link_leaf(x, guest[s:e])
                i = np.flatnonzero(x != x[to])
                a.append(x[i])
                b.append(x[to[i]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).view(np.int64)) for p in (a, b)], names=["a", "b"])

    for batch in batches:
        leaf, guest, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(leaf):
            continue
        cut = int(np.searchsorted(leaf, leaf[-1]))  # the last leaf may go on in the next batch
        if cut:
            held.append((leaf[:cut], guest[:cut], fp[:cut].view(np.uint64)))
            yield flush()
        held.append((leaf[cut:], guest[cut:], fp[cut:].view(np.uint64)))
    if held:
        yield flush()


def _searched(rows: DataFrame) -> DataFrame:
    return rows.select("leaf", "guest", "fp").repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_search, "a long, b long")


def _block_pairs(rows: DataFrame, vantage: DataFrame) -> DataFrame:
    """The rows of large leaves once for each pair of blocks that they are in; the pair is their new leaf.

    Blocks hold rows of one distance to the leaf's vantage point. Blocks whose distances differ by more
    than MAX_BITS cannot hold a pair.
    """
    d = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
    placed = materialize(rows.join(vantage, "leaf").select("leaf", "guest", "fp", d.alias("d")), "simhash-large")
    sizes = placed.groupBy("leaf", "d").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = placed.join(sizes, ["leaf", "d"]).withColumn("s", F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")).drop("blocks")
    block = sizes.select("leaf", "d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("s"))
    other = block.select("leaf", F.col("d").alias("d2"), F.col("s").alias("s2"))
    after = (F.col("d2") > F.col("d")) | ((F.col("d2") == F.col("d")) & (F.col("s2") >= F.col("s")))
    pairs = block.join(other, "leaf").filter(after & (F.col("d2") - F.col("d") <= MAX_BITS))
    pairs = materialize(pairs.withColumn("pair", F.xxhash64("leaf", "d", "s", "d2", "s2")), "simhash-blocks")
    first = pairs.select("leaf", "d", "s", "pair")
    second = pairs.filter((F.col("d") != F.col("d2")) | (F.col("s") != F.col("s2"))).select("leaf", F.col("d2").alias("d"), F.col("s2").alias("s"), "pair")
    return placed.join(first.union(second), ["leaf", "d", "s"]).select(F.col("pair").alias("leaf"), "guest", "fp")


def links(points: DataFrame) -> DataFrame:
    """``(a, b)``: links within MAX_BITS that span the components of ``points`` (``fp`` once each)."""
    rows = materialize(shards(points), "simhash-shards")
    large = materialize(rows.groupBy("leaf").agg(F.count("*").alias("n"), F.min("fp").alias("vantage")).filter(F.col("n") > MAX_LEAF).drop("n"), "simhash-large-leaves")
    out = _searched(rows.join(large, "leaf", "left_anti"))
    if not large.isEmpty():
        out = out.union(_searched(_block_pairs(rows, large)))
    return materialize(out.distinct(), "simhash-links")


def _groups(points: DataFrame) -> DataFrame:
    """``points`` (``fp`` once each) with the ``group`` of fingerprints that each is linked to."""
    of_point = components(links(points))
    return points.join(of_point, points["fp"] == of_point["node"], "left").select(*points.columns, F.coalesce("component", "fp").alias("group"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``; components join over fingerprints within 4 bits."""
    fps = materialize(fingerprints(docs, text_col, id_col), "simhash-fps")
    points = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-points")
    joined = _groups(points)
    # as a table of its own, so that the join can split a large component
    least = materialize(joined.groupBy("group").agg(F.min("doc_id").alias("component_id")), "simhash-least")
    of_fp = joined.join(least, "group").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def near_deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: the smallest by id (null last), then by a hash of the text, then of the row.

    Rows with equal ids are documents of their own.
    """
    r1, r2 = (free_name(docs, x) for x in ("_r1", "_r2"))
    row = [F.struct(F.col(c).isNull(), c) for c in docs.columns]
    keyed = docs.withColumns({r1: F.xxhash64(*row), r2: F.xxhash64(F.lit("row"), *row)})
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("said"), F.col(r1).alias("r1"), F.col(r2).alias("r2"))
    fps = materialize(fingerprints(keyed.select(place.alias("doc_id"), "text")), "simhash-fps")
    points = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-points")
    least = _groups(points).groupBy("group").agg(F.min("least").alias("least"))
    keep = materialize(least.select(F.col("least.r1").alias(r1), F.col("least.r2").alias(r2)), "simhash-keep")
    # rows of one key are equal in every column
    return keyed.join(keep, [r1, r2], "left_semi").dropDuplicates([r1, r2]).drop(r1, r2)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
