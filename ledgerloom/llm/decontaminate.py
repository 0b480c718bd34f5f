"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of 13 consecutive words (an item of fewer words is one window). A window is a set
of shingles of five words at fixed places (fewer, if the window is shorter). Shingles are ordered by rarity:
their count over all documents. A window can only occur where its rarest shingle does, so that this one
shingle is the prefix that has to be joined (containment 1 needs a prefix of 1). Each occurrence of a prefix
proposes its windows; the shingle's place in the window bounds where the window would start and end in the
document, and the words there are compared exactly.

The join has two forms with equal results, chosen by the benchmark's size. Up to ``broadcast_bytes`` of text
the windows are broadcast as numpy arrays, some 25 bytes a word, with their vocabulary; then documents are
read twice (to count shingles, and to judge) and not shuffled. Beyond, the documents' shingles are a table,
rarity is an aggregate, and prefixes meet occurrences in joins; only occurrences of benchmark shingles are
kept on the way.

Defined results
---------------
* null or empty text has no words; a document without words is not contaminated;
* an item without words has no window; a null item id counts as no item, its words still hit;
* items with equal text or equal ids: each distinct id counts once;
* an empty benchmark hits nothing; an empty table of documents gives an empty result;
* documents are judged row by row; input columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name, materialize, shipped, table

WINDOW = 13
SHINGLE = 5
#: Contaminated from this many hit words in a hundred.
MIN_PERCENT = 5
#: Benchmark text up to which its windows are broadcast.
BROADCAST_BYTES = 8 * 1024 * 1024
#: Words of documents that are looked at together.
CHUNK_WORDS = 200_000

#: Bytes of words: letters (in lower case), digits, all of non-ASCII characters. Others separate.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

RESULTS = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def _judgement(n_words: list[int], n_hit: list[int], items: list[list[str]]) -> list[pa.Array]:
    """The result columns of some documents; ``items`` sorted."""
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    bad = [h > 0 and 100 * h >= MIN_PERCENT * w for h, w in zip(n_hit, n_words, strict=True)]
    return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_())]


# ------------------------------------------------------- the benchmark in memory


class _Numbers(dict):
    """Word numbers; 0 for words that the benchmark does not have."""

    def __missing__(self, word: bytes) -> int:
        return 0


def _codes(ids: np.ndarray, size: int) -> np.ndarray:
    """A code of the ``size`` words from each place on. Equal shingles have equal codes; others may collide."""
    x = ids.astype(np.uint64)
    code = x[: len(x) - size + 1].copy()
    for k in range(1, size):
        code *= _A
        code ^= code >> np.uint64(31)
        code += x[k : len(x) - size + 1 + k] * _B
    return code


class Index:
    """The benchmark's words as numbers, its windows, and per shingle size the codes of their shingles."""

    def __init__(self, items: list[tuple[str | None, str | None]]) -> None:
        self.ids = [i for i, _ in items]
        words = [word_list(t) for _, t in items]
        self.number = _Numbers((w, k) for k, w in enumerate(dict.fromkeys(w for ws in words for w in ws), 1))
        # items are kept apart by a 0
        self.tokens = np.array([k for ws in words for k in (*map(self.number.__getitem__, ws), 0)], np.int64)
        lens = np.array([len(ws) for ws in words], np.int64)
        first = np.cumsum(lens + 1) - lens - 1
        count = np.where(lens > 0, np.maximum(1, lens - WINDOW + 1), 0)
        self.item = np.repeat(np.arange(len(items)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.start = np.repeat(first, count) + step
        self.length = np.repeat(np.minimum(lens, WINDOW), count)
        self.sizes = sorted(set(np.minimum(self.length, SHINGLE).tolist()))
        self.shingles = {s: self._shingles(s) for s in self.sizes}

    def _shingles(self, size: int) -> np.ndarray:
        mine = np.minimum(self.length, SHINGLE) == size
        at = np.unique(np.concatenate([self.start[mine] + k for k in range(WINDOW)])) if mine.any() else np.empty(0, np.int64)
        at = at[at + size <= len(self.tokens)]
        return np.unique(_codes(self.tokens, size)[at]) if len(at) else np.empty(0, np.uint64)

    def choose_prefixes(self, counts: dict[int, np.ndarray]) -> None:
        """Each window's rarest shingle; ``counts`` beside ``shingles``."""
        self.prefixes = {}
        for s in self.sizes:
            mine = np.flatnonzero(np.minimum(self.length, SHINGLE) == s)
            codes = _codes(self.tokens, s)
            best = np.full(len(mine), np.iinfo(np.int64).max)
            offset = np.zeros(len(mine), np.int64)
            for k in range(WINDOW - s + 1):
                inside = np.flatnonzero(k + s <= self.length[mine])
                n = counts[s][np.searchsorted(self.shingles[s], codes[self.start[mine[inside]] + k])]
                rarer = n < best[inside]
                best[inside[rarer]], offset[inside[rarer]] = n[rarer], k
            code = codes[self.start[mine] + offset]
            order = np.argsort(code, kind="stable")
            keys, begin = np.unique(code[order], return_index=True)
            self.prefixes[s] = (keys, np.append(begin, len(order)), mine[order], offset[order])
        del self.shingles

    def numbered(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of documents: their words' numbers, each document followed by a 0, and the documents' lengths."""
        ids, lens, size = [], [], 0
        for t in texts:
            w = word_list(t)
            ids.append(np.fromiter(map(self.number.__getitem__, w), np.int64, len(w)))
            ids.append(np.zeros(1, np.int64))
            lens.append(len(w))
            size += len(w) + 1
            if size >= CHUNK_WORDS:
                yield np.concatenate(ids), np.array(lens)
                ids, lens, size = [], [], 0
        if lens:
            yield np.concatenate(ids), np.array(lens)

    @staticmethod
    def places(ids: np.ndarray, size: int) -> np.ndarray:
        """Where ``size`` benchmark words follow one another."""
        if len(ids) < size:
            return np.empty(0, np.int64)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        return np.flatnonzero(known[size:] - known[:-size] == size)

    def found(self, ids: np.ndarray, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the chunk whose shingle is one of the sorted ``keys``, and which."""
        at = self.places(ids, size)
        if not len(at) or not len(keys):
            return at[:0], at[:0]
        code = _codes(ids, size)[at]
        k = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        hit = keys[k] == code
        return at[hit], k[hit]

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, window)`` of the windows that occur in a chunk."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for s in self.sizes:
            keys, begin, window, offset = self.prefixes[s]
            at, k = self.found(ids, s, keys)
            n = begin[k + 1] - begin[k]
            pick = np.repeat(begin[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            win, place = window[pick], np.repeat(at, n) - offset[pick]
            # positional bound: the window must lie inside the text
            inside = (place >= 0) & (place + self.length[win] <= len(ids))
            win, place = win[inside], place[inside]
            same = np.ones(len(win), bool)
            for j in range(WINDOW):
                open_ = np.flatnonzero(same & (j < self.length[win]))
                same[open_] = ids[place[open_] + j] == self.tokens[self.start[win[open_]] + j]
            out.append((place[same], win[same]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def judged(self, texts: list[str | None]) -> list[pa.Array]:
        n_words, n_hit, items = [], [], []
        for ids, lens in self.numbered(texts):
            place, win = self.occurrences(ids)
            edge = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + self.length[win], -1)
            first = np.cumsum(lens + 1) - lens - 1
            n_hit += np.add.reduceat((np.cumsum(edge[:-1]) > 0).astype(np.int64), first).tolist()
            n_words += lens.tolist()
            mine: list[set] = [set() for _ in lens]
            pairs = np.unique((np.searchsorted(first, place, side="right") - 1) * len(self.ids) + self.item[win]) if len(place) else ()
            for p in pairs:
                d, i = divmod(int(p), len(self.ids))
                if self.ids[i] is not None:
                    mine[d].add(self.ids[i])
            items += [sorted(x) for x in mine]
        return _judgement(n_words, n_hit, items)


def _counted(docs: DataFrame, index: Index, text_col: str) -> dict[int, np.ndarray]:
    """How often each of the index's shingles occurs in all documents."""
    sent = shipped(docs.sparkSession, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent()
        total = {s: np.zeros(len(index.shingles[s]), np.int64) for s in index.sizes}
        for b in batches:
            for ids, _ in index.numbered(b.column(0).to_pylist()):
                for s in index.sizes:
                    total[s] += np.bincount(index.found(ids, s, index.shingles[s])[1], minlength=len(total[s]))
        for s, n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), s)), pa.array(seen), pa.array(n[seen])], names=["size", "shingle", "n"])

    counts = {s: np.zeros(len(index.shingles[s]), np.int64) for s in index.sizes}
    for r in docs.select(text_col).mapInArrow(run, "size long, shingle long, n long").groupBy("size", "shingle").agg(F.sum("n").alias("n")).collect():  # at most the index's shingles
        counts[r["size"]][r["shingle"]] = r["n"]
    return counts


def _by_broadcast(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    index = Index([(r["item_id"], r["text"]) for r in items.collect()])  # BROADCAST_BYTES of text at most
    if index.sizes:
        index.choose_prefixes(_counted(docs, index, text_col))
    sent = shipped(docs.sparkSession, index)
    at, rest = docs.columns.index(text_col), [c for c in docs.columns if c not in RESULTS]
    keep = [docs.columns.index(c) for c in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *known.judged(b.column(at).to_pylist())], names=[*rest, *RESULTS])

    return docs.mapInArrow(run, _schema(docs, rest))


def _schema(docs: DataFrame, rest: list[str]) -> StructType:
    schema = StructType([docs.schema[c] for c in rest])
    for name, kind in RESULTS.items():
        schema.add(name, kind)
    return schema


# ------------------------------------------------------- the benchmark in tables


def _shingle_hashes(words: list[bytes], size: int) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(b" ".join(words[k : k + size])) - 2**63 for k in range(len(words) - size + 1)]


def _windows(items: DataFrame) -> DataFrame:
    """``(item_id, window, n, shingles)``: each window as its words joined by spaces, with its shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = word_list(t)
                for k in range(max(1, len(w) - WINDOW + 1)) if w else ():
                    x = w[k : k + WINDOW]
                    rows.append((i, b" ".join(x), len(x), _shingle_hashes(x, min(SHINGLE, len(x)))))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item_id", "window", "n", "shingles"])

    return items.mapInArrow(run, "item_id string, window binary, n int, shingles array<bigint>")


def _doc_shingles(docs: DataFrame, text_col: str, sizes: list[int]) -> DataFrame:
    """``(r1, r2, at, size, shingle)`` of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r1, r2, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = word_list(t)
                for s in sizes:
                    h = _shingle_hashes(w, s)
                    n = len(h)
                    yield pa.RecordBatch.from_arrays([pa.array([r1] * n, pa.int64()), pa.array([r2] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([s] * n, pa.int32()), pa.array(h, pa.int64())], names=["r1", "r2", "at", "size", "shingle"])

    rows = docs.select(*_row_keys(text_col), text_col).dropDuplicates(["r1", "r2"])
    return rows.mapInArrow(run, "r1 long, r2 long, at int, size int, shingle long")


def _row_keys(text_col: str) -> list:
    """Equal texts are judged alike."""
    return [F.xxhash64(text_col).alias("r1"), F.xxhash64(F.lit("row"), F.col(text_col)).alias("r2")]


def _by_joins(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    windows = materialize(_windows(items), "windows")
    sizes = [r["n"] for r in windows.select(F.least("n", F.lit(SHINGLE)).alias("n")).distinct().collect()]  # SHINGLE rows at most
    distinct = windows.select("window", "n", "shingles").dropDuplicates(["window"])
    places = distinct.select("window", "n", F.least("n", F.lit(SHINGLE)).alias("size"), F.posexplode("shingles").alias("offset", "shingle"))
    met = materialize(_doc_shingles(docs, text_col, sizes).join(places.select("size", "shingle").distinct(), ["size", "shingle"], "left_semi"), "shingles-met")
    rarity = met.groupBy("size", "shingle").agg(F.count("*").alias("count"))
    ranked = places.join(rarity, ["size", "shingle"], "left").fillna(0, ["count"])
    prefix = ranked.groupBy("window", "n", "size").agg(F.min(F.struct("count", "shingle", "offset")).alias("p")).select("window", "n", "size", "p.shingle", "p.offset")
    met_at = met.join(materialize(prefix, "prefixes"), ["size", "shingle"])
    # positional bound at the start; the end is checked with the words
    proposed = met_at.select("r1", "r2", (F.col("at") - F.col("offset")).alias("start"), "window").filter("start >= 0")
    per_text = proposed.groupBy("r1", "r2").agg(F.collect_set(F.struct("start", "window")).alias("proposed"))
    texts = docs.select(*_row_keys(text_col), F.col(text_col).alias("text")).dropDuplicates(["r1", "r2"]).join(per_text, ["r1", "r2"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r1, r2, t, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = word_list(t)
                rows = []
                for f in found:
                    x = f["window"].split()
                    if w[f["start"] : f["start"] + len(x)] == x:
                        rows.append((r1, r2, f["start"], f["start"] + len(x), f["window"]))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["r1", "r2", "start", "stop", "window"])

    occurs = materialize(texts.select("r1", "r2", "text", "proposed").mapInArrow(verify, "r1 long, r2 long, start int, stop int, window binary"), "windows-met")
    spans = occurs.groupBy("r1", "r2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    having = occurs.join(windows.select("item_id", "window").filter("item_id is not null").distinct(), "window").groupBy("r1", "r2").agg(F.collect_set("item_id").alias("items"))
    k1, k2, s, i = (free_name(docs, x) for x in ("_r1", "_r2", "_spans", "_items"))
    found = spans.join(having, ["r1", "r2"], "left").select(F.col("r1").alias(k1), F.col("r2").alias(k2), F.col("spans").alias(s), F.col("items").alias(i))
    rest = [c for c in docs.columns if c not in RESULTS]
    r1, r2 = _row_keys(text_col)
    joined = docs.select(*rest, r1.alias(k1), r2.alias(k2)).join(materialize(found, "texts-met"), [k1, k2], "left").select(*rest, s, i)
    at = rest.index(text_col)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words = [len(word_list(t)) for t in b.column(at).to_pylist()]
            hit = [covered([(x["start"], x["stop"]) for x in f or ()]) for f in b.column(len(rest)).to_pylist()]
            items = [sorted(x or ()) for x in b.column(len(rest) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *_judgement(n_words, hit, items)], names=[*rest, *RESULTS])

    return joined.mapInArrow(finish, _schema(docs, rest))


def covered(spans: list[tuple[int, int]]) -> int:
    n = end = 0
    for a, b in sorted(spans):
        n += max(0, b - max(a, end))
        end = max(end, b)
    return n


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    if text_col in RESULTS:
        raise ValueError(f"{text_col} is the name of a result")
    # equal pairs need to be looked for once
    items = materialize(benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).distinct(), "benchmark")
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    return (_by_broadcast if size <= broadcast_bytes else _by_joins)(docs, items, text_col)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    # whole rows are carried in one column, so that their own columns may have any names
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return contamination(rows, benchmark).filter("not contaminated").select("row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(list_slice(w, i, i + least({WINDOW}, len(w)) - 1), ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM pos JOIN win USING (g, n)),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
