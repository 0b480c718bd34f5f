"""Alignment of two tokenizers over the same texts, and which of their tokens go together corpus-wide.

A byte-level BPE (A) reads a space and the text; a sentencepiece model (B) reads the text and adds the space itself.
Both are cut where tokens of both end. The spans that the libraries give are coarse: A's are in characters, so that
tokens inside one character share its span, and B's of byte-fallback tokens are empty or whole characters. So the
places where both libraries end a token on a character's border are the coarse cuts, and where a token between two
of them does not cover whole characters, the tokens' decoded bytes refine the stretch. In ASCII a byte is a character, so
that a token's span is its bytes: such stretches are read apart from others, and the libraries asked for ids alone.

Neither tokenizer joins a character to white space behind it (checked for the model's pieces; otherwise texts are
worked on whole), so that texts are cut there and equal stretches are aligned once a task.

Token pairs of one group are linked. Each text's distinct pairs are written once, with their occurrences; the pairs'
document counts are an aggregate over them. Counts come back by a broadcast of the ``HOT_PAIRS`` most frequent pairs
(24 bytes each) and a join for the rest; no pair of the rest is frequent, so that the join has no hot key.

Defined results
---------------
* null and empty texts, and those whose tokens' bytes are not a space and the text (in either vocabulary), have no tokens;
* special tokens' strings are plain text;
* a document is a row: repeated rows and ids count as often as they occur;
* an empty table gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import MEMO_CHARS, VOCABULARY, installed, read_small, vocabulary
from .common import free_name, materialize, table

#: The sentencepiece model; any path of such a file may be given instead.
PIECE_MODEL = "piece_bpe_32k.model"
#: Pairs whose counts are broadcast; the counts of others are joined.
HOT_PAIRS = 1_000_000
#: Stretches that a worker keeps, twice at most (new and old ones), and those that are read together.
MEMO, TOGETHER = 250_000, 2_000
#: Links of a group above which they are counted by distinct ids.
LARGE = 4_096
#: Bytes of texts that are worked on together.
BYTES = 2_000_000

#: A space in front of other white space or at the end: elsewhere every space is a border.
SPACED = re.compile(r" (?!\S)|^\s")

#: Of a text: tokens of A and of B, groups, their listing, linked pairs and how often each is.
Aligned = tuple[int, int, int, str, np.ndarray, np.ndarray]
NOTHING: Aligned = (0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))


# ---------------------------------------------------------------------- cutting


def borders(pieces: list[str]) -> re.Pattern | None:
    """Where neither vocabulary joins characters: before the white space that no piece joins to another character.

    A cuts before any white space that follows another character (Python's ``\\S`` is narrower than A's).
    """

    def apart(c: str) -> bool:
        joined = re.compile(rf"\S{c}" if c == " " else rf"\S{c}| {c}|{c} ")
        return not any(joined.search(p) for p in pieces)

    free = "".join(c for c in " \t\n\v\f\r" if apart(c))
    return re.compile(rf"(?<=\S)(?=[{free}])") if " " in free else None


def _clean_ends(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The ends of spans that no later span begins before."""
    reached = np.maximum.accumulate(end)
    return reached[np.r_[begin[1:] >= reached[:-1], True]]


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distinct values that two ordered arrays share."""
    z = x[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x]
    return z[np.r_[True, z[1:] != z[:-1]]] if len(z) else z


def token_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_spans: np.ndarray, b_spans: np.ndarray) -> np.ndarray:
    """The places where tokens of both end: coarse cuts by spans (begin, end in bytes), refined by the tokens' own ends."""
    coarse = _common(_clean_ends(*a_spans), _clean_ends(*b_spans))
    # stretches between coarse cuts with tokens inside characters
    inside = np.concatenate([np.searchsorted(coarse, e[e != s[1]]) for e, s in ((a_ends, a_spans), (b_ends, b_spans))])
    if not len(inside):
        return coarse
    both = _common(a_ends, b_ends)
    return np.sort(np.concatenate([coarse, both[np.isin(np.searchsorted(coarse, both), inside) & ~np.isin(both, coarse)]]))


def product_counts(a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a large group and how often each occurs."""
    (a, n), (b, m) = (np.unique(x, return_counts=True) for x in (a_ids, b_ids))
    return (a[:, None] << 32 | b).ravel(), (n[:, None] * m).ravel()


def summed(pairs: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order and their counts."""
    order = np.argsort(pairs)
    p, n = pairs[order], often[order]
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    return p[first], np.add.reduceat(n, first)


# ---------------------------------------------------------------------- aligning


def aligner(a_data: bytes, b_data: bytes) -> Callable[[list[str | None]], list[Aligned]]:
    """A function from texts to their alignments."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(a_data.decode())
    if a.post_processor is not None:  # it would trim spans
        a = Tokenizer.from_str(json.dumps(json.loads(a_data) | {"post_processor": None}))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=b_data)
    ids, _, special = vocabulary(a_data)
    a_bytes = {i: t.encode() for t, i in special.items()} | {i: t.encode("latin-1") for t, i in ids.items()}
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
    a_size = np.array([len(a_bytes.get(i, b"")) for i in range(max(a_bytes) + 1)], np.int64)
    b_size = np.array([len(x) for x in b_bytes], np.int64)
    a_name, b_name = ([str(i) for i in range(len(size))] for size in (a_size, b_size))
    cut = borders([p.replace("▁", " ") for p in pieces])
    #: counts (40 bits each), listing, links (as bytes), and large groups' links; False if bytes differ
    memo: dict[str, tuple[int, str, bytes, tuple] | bool] = {}
    old: dict[str, tuple[int, str, bytes, tuple] | bool] = {}
    #: few stretches have counts of their own: kept once, as they take as much memory as a listing
    once: dict[int, int] = {}

    def look_up(stretches: list[str]) -> None:
        """Align stretches that can stand one behind another, by reading them as one text; halves if that text cannot be read so."""
        # both libraries read a word first, so that the model's own space does not touch a stretch
        text = " a" + "".join(stretches)
        raw, plain = text.encode("utf-8", "surrogatepass"), text.isascii()
        x = a.encode(text, add_special_tokens=False)
        y = () if plain else b.encode(text[1:], return_type="proto").pieces
        x_ids, y_ids = x.ids, b.encode(text[1:], return_type=int) if plain else [t.id for t in y]
        a_ids, b_ids = np.fromiter(x_ids, np.int64, len(x_ids)), np.fromiter(y_ids, np.int64, len(y_ids))
        same = b"".join([a_bytes[i] for i in x_ids]) == raw == b"".join([b_bytes[i] for i in y_ids])
        ends = np.cumsum([2, *(map(len, stretches) if plain else (len(s.encode("utf-8", "surrogatepass")) for s in stretches))])
        if same:
            a_ends, b_ends = np.cumsum(a_size[a_ids]), np.cumsum(b_size[b_ids])
            if plain:
                a_spans, b_spans = np.stack((a_ends - a_size[a_ids], a_ends)), np.stack((b_ends - b_size[b_ids], b_ends))
            else:
                code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                at = np.r_[0, np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), dtype=np.int64)]
                a_spans = at[np.fromiter(chain.from_iterable(x.offsets), np.int64, 2 * len(x_ids)).reshape(-1, 2).T]
                b_spans = np.fromiter((v for t in y for v in (t.begin, t.end)), np.int64, 2 * len(y_ids)).reshape(-1, 2).T + 1
                b_spans[0, 0] = 0  # the model's own space
            cuts = token_cuts(a_ends, b_ends, a_spans, b_spans)
            group = np.searchsorted(cuts, ends)
            whole = bool((cuts[np.minimum(group, len(cuts) - 1)] == ends).all())
        if not same or not whole:
            if len(stretches) == 1:
                memo[stretches[0]] = False
                return
            for half in (stretches[: len(stretches) // 2], stretches[len(stretches) // 2 :]):
                look_up(half)
            return
        p, q = np.searchsorted(a_ends, cuts, "right"), np.searchsorted(b_ends, cuts, "right")
        i, j = np.r_[0, p[:-1]], np.r_[0, q[:-1]]
        na, nb = p - i, q - j
        links = na * nb
        large = np.flatnonzero(links > LARGE).tolist()
        links[large] = 0
        upto = np.r_[0, np.cumsum(links)]
        of = np.repeat(np.arange(len(cuts)), links)
        k = np.arange(upto[-1]) - upto[of]
        pairs = a_ids[i[of] + k // nb[of]] << 32 | b_ids[j[of] + k % nb[of]]
        blob, a_text, b_text = pairs.tobytes(), [a_name[i] for i in x_ids], [b_name[i] for i in y_ids]
        listing = [f"{a_text[e]}|{b_text[g]}" if f - e == 1 == h - g else f"{','.join(a_text[e:f])}|{','.join(b_text[g:h])}" for e, f, g, h in zip(i.tolist(), p.tolist(), j.tolist(), q.tolist(), strict=True)]
        upto, a_upto, b_upto, group = (8 * upto).tolist(), np.r_[0, p].tolist(), np.r_[0, q].tolist(), (group + 1).tolist()
        for s, lo, hi in zip(stretches, group, group[1:], strict=False):
            counts = (a_upto[hi] - a_upto[lo]) << 80 | (b_upto[hi] - b_upto[lo]) << 40 | (hi - lo)
            extra = tuple(product_counts(a_ids[i[g] : p[g]], b_ids[j[g] : q[g]]) for g in large if lo <= g < hi) if large else ()
            memo[s] = (once.setdefault(counts, counts), ";".join(listing[lo:hi]), blob[upto[lo] : upto[hi]], extra)

    def stretches_of(text: str) -> list[str]:
        if cut is None:
            return [" " + text]
        if SPACED.search(text):
            return cut.split(" " + text)
        return [" " + w for w in text.split(" ")]

    def read(stretches: Iterable[str]) -> list[str]:
        """Have all of these, which are not in ``memo``, there; returns those that should not stay."""
        ascii_only, together, alone = [], [], []
        for s in dict.fromkeys(stretches):
            if s in old:
                memo[s] = old[s]
            # white space at the end would meet that of the next stretch
            elif len(s) > MEMO_CHARS or s[-1].isspace() or s[0] != " ":
                alone.append(s)
            else:
                (ascii_only if s.isascii() else together).append(s)
        for some in (ascii_only, together):
            for k in range(0, len(some), TOGETHER):
                look_up(some[k : k + TOGETHER])
        for s in alone:
            look_up([s])
        return [s for s in alone if len(s) > MEMO_CHARS]

    def put_together(found: list) -> Aligned:
        if not found or False in found:
            return NOTHING
        counts = sum([f[0] for f in found])
        pairs = np.frombuffer(b"".join([f[2] for f in found]), np.int64)
        if extra := [e for f in found if f[3] for e in f[3]]:
            distinct = summed(np.concatenate([pairs, *(e[0] for e in extra)]), np.concatenate([np.ones(len(pairs), np.int64), *(e[1] for e in extra)]))
        else:
            pairs = np.sort(pairs)
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            distinct = pairs[first], np.diff(np.append(first, len(pairs)))
        low = (1 << 40) - 1
        return counts >> 80, counts >> 40 & low, counts & low, ";".join([f[1] for f in found]), *distinct

    def align(texts: list[str | None]) -> list[Aligned]:
        nonlocal memo, old
        if len(memo) > MEMO:  # what is not met again until the next time goes
            memo, old = {}, memo
            once.clear()
        cuts = [stretches_of(t) if t else [] for t in texts]
        found = [list(map(memo.get, c)) for c in cuts]
        new = [[k for k, x in enumerate(f) if x is None] if None in f else () for f in found]
        long = read(c[k] for c, n in zip(cuts, new, strict=True) for k in n)
        for c, f, n in zip(cuts, found, new, strict=True):
            for k in n:
                f[k] = memo[c[k]]
        for s in long:
            del memo[s]
        return list(map(put_together, found))

    return align


def ready(kept: dict) -> Callable[[list[str | None]], list[Aligned]]:
    """The aligner of ``kept["models"]``, made once; an earlier one that nothing holds any more goes first.

    An aligner's functions refer to one another, so that it outlives its job, words and all, until garbage is collected.
    """
    if "align" not in kept:
        import gc

        gc.collect()
        kept["align"] = aligner(*kept["models"])
    return kept["align"]


# ---------------------------------------------------------------------- on tables

RESULTS = {"n_a": "long", "n_b": "long", "n_groups": "long", "groups": "string", "links": "array<struct<pair: bigint, often: bigint>>"}


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of ``BYTES`` of the texts in the last column (or one row)."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def aligned(docs: DataFrame, text: str = "text", a_path: str = VOCABULARY, b_path: str = PIECE_MODEL) -> DataFrame:
    """``docs`` with its numbers of tokens and groups, ``groups`` (``a1,a2|b1;a3|b2,b3``: ids of A and B) and ``links``.

    ``links`` has each distinct pair of linked ids (A's in the upper 32 bits) and how often it occurs in the text.
    Rows whose texts cannot be aligned have zeros, no groups and no links.
    """
    spark = docs.sparkSession
    # a worker process keeps the broadcast, and with it the aligner and its words, from task to task
    sent = spark.sparkContext.broadcast({"models": [read_small(installed(p)) for p in (a_path, b_path)]})
    last = free_name(docs, "_text")
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS), F.col(f"`{text}`").cast("binary").alias(last))
    schema = StructType(kept.schema.fields[:-1] + StructType.fromDDL(", ".join(f"{n} {t}" for n, t in RESULTS.items())).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = ready(sent.value)
        for whole in batches:
            for b in _bounded(whole):
                texts = [t.as_py().decode("utf-8", "replace") if t.is_valid else None for t in b.column(b.num_columns - 1)]
                na, nb, ng, listing, pairs, often = zip(*align(texts), strict=True)
                inner = pa.StructArray.from_arrays([pa.array(np.concatenate(pairs)), pa.array(np.concatenate(often))], names=["pair", "often"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(na, pa.int64()), pa.array(nb, pa.int64()), pa.array(ng, pa.int64()), pa.array(listing, pa.string()), lists], names=schema.names)

    return kept.mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(pair, count, best)`` of all links: how many rows hold the pair, and whether that is its A id's highest count."""
    counts = rows.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # at most as many rows as B has ids
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(of_a)).alias("best"))


def with_counts(rows: DataFrame, counts: DataFrame, row: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per ``row`` the number of links, of those whose count is their A id's highest, and the sum of their counts."""
    long = rows.select(row, F.explode("links").alias("_l")).select(row, "_l.pair", "_l.often")
    # counts by their number of bits: from how many bits on there are at most hot_pairs pairs
    bits = F.length(F.bin("count"))
    least, room = 0, hot_pairs
    for r in counts.groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).orderBy(F.desc("bits")).collect():  # 63 rows at most
        room -= r["n"]
        if room < 0:
            least = r["bits"]
            break

    def sums(found: DataFrame) -> DataFrame:
        often = F.col("often")
        return found.groupBy(row).agg(F.sum(often).alias("n_links"), F.sum(F.when(F.col("best"), often).otherwise(0)).alias("n_best"), F.sum(often * F.col("count")).alias("count_sum"))

    if not least:
        return sums(long.join(F.broadcast(counts), "pair"))
    hot, rest = counts.filter(bits > least), counts.filter(bits <= least)
    cold = long.join(F.broadcast(hot.select("pair")), "pair", "left_anti")
    both = sums(long.join(F.broadcast(hot), "pair")).unionByName(sums(cold.join(rest.hint("shuffle_hash"), "pair")))
    return both.groupBy(row).agg(*(F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")))


def alignment_summary(docs: DataFrame, text: str = "text", a_path: str = VOCABULARY, b_path: str = PIECE_MODEL, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``docs`` with ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups_sha256``."""
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in names or c == text))
    row = free_name(kept, "_row")
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    rows = aligned(kept, text, a_path, b_path).withColumn("groups_sha256", digest).drop("groups").withColumn(row, F.monotonically_increasing_id())
    rows = materialize(rows, "alignment")
    counts = materialize(pair_counts(rows), "pair-counts")
    sums = with_counts(rows, counts, row, hot_pairs)
    out = rows.drop("links").join(sums, row, "left").drop(row)
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_links", "n_best", "count_sum")})


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment_summary(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
