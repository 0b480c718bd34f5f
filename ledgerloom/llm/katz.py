"""Katz backoff language model: Good-Turing discounted n-gram counts, exactly normalised, evaluated recursively.

With a context ``h`` of ``m - 1`` words seen in training, ``P(w | h) = d_r c(h, w) / c(h)`` for n-grams seen
``r`` times, ``alpha(h) P(w | h')`` for all others, ``h'`` being ``h`` without its first word; a context never
seen is shortened at once. ``alpha(h)`` spreads exactly the mass that the discounts of ``h`` leave over the
words that did not follow it. The order is three unless the caller asks for another. ``P(w)`` is the
Good-Turing discounted unigram; the mass it leaves is shared by the words not yet seen, whose number is
estimated from the words seen once and twice (``n_1^2 / 2 n_2``), so that an unknown word has about the
probability of one seen once and discounted. All counts come from all training documents, single ones included.

A corpus has more n-grams than rows that Spark shuffles well, so that the tables are made of blocks. A
*batch* is some thousand documents as word numbers with their vocabulary (hashes of words); a task keeps one open
for each of the first KINDS values of a column that tells like documents (their language), as fewer batches then
share a context. No score depends on that. For each order it
sends its n-grams, grouped by context, to *parts* of the hash range of contexts, with its own counts and those
that the lower order's probabilities follow from; a part adds up what all batches sent, and returns the totals, and for each
context the number of followers by their count and (to batches that have to back off from it) the lower-order probability
that they cover, from which the weights follow once the order's discounts are known. N-grams of contexts that no other batch has are not
sent; which those are, the exchange of the order below tells. The orders above two are exchanged in rounds, each with
its share of the parts, and a round's shuffle files go when it ends. Parts follow the data: each gets about PART_TOKENS tokens' n-grams. The
n-grams of a context seen more than HOT_TOKENS times are dealt out by their own hash instead; the sums of
these contexts (one for each HOT_TOKENS tokens at most) are added up in Spark and broadcast.

Defined results
---------------
* null or empty text is the one token "end"; the first token follows a start mark, the second the mark and it;
* a null id is trained on and scored, ids may repeat: each row is a document of its own;
* a context with no mass left for backing off gets half a count's worth, taken evenly from its n-grams;
* a corpus without training documents gives every token the probability of the unknown one;
* an empty table gives an empty result; other columns of the input are not read, and that of like documents may hold anything.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import cuts, distinct, grouped, order_of, sorted_in, sorted_out, spread, squeeze, unsqueeze
from .common import add_to, bucket_table, bucketed, table

#: Counts up to this are discounted.
K = 7
ORDER = 3
#: A batch is closed when it holds so many tokens.
BATCH_TOKENS = 1_200_000
#: Batches that a task has open at once, and the tokens in them; beyond these the largest is closed.
KINDS, OPEN_TOKENS = 6, 3_600_000
#: Tokens whose n-grams one part adds up on average at most.
PART_TOKENS = 2_000_000
#: Contexts seen more often are dealt out over all parts.
HOT_TOKENS = 8_000_000
#: Orders above two are exchanged in so many rounds, each with every so many-th part, so that less lies on disk at once.
ROUNDS = 2
START, END = np.uint64(1), np.uint64(2)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

#: What a row of the exchange is: a block of contexts by their own hash, one of hot contexts, sums of hot contexts, counts of counts.
PLAIN, HOT, SUMS, STATS = 0, 1, 2, 3


def held_out(doc_id: Column) -> Column:
    """Documents that the model does not learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of an n-gram, from its context's and its last word's."""
    x = a * _A + b * _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


# ---------------------------------------------------------------- batches

BATCHES = "batch long, docs array<{kind}>, held array<boolean>, n_tokens array<int>, vocabulary binary, tokens binary"


def _batches(docs: DataFrame, text_col: str, id_col: str, like_col: str | None = None) -> DataFrame:
    """One row for each batch of documents; of like ones, as far as ``like_col`` tells."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        number = itertools.count()
        fresh = lambda: (defaultdict(itertools.count().__next__), [], [], [])
        kinds: dict[str | None, int] = {}
        begun, sizes = defaultdict(fresh), defaultdict(int)

        def close(kind: int) -> pa.RecordBatch:
            words, ids, held, tokens = begun.pop(kind)
            del sizes[kind]
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
            hashes = np.concatenate((hashes, [START, END])).astype(np.uint64)
            vocabulary, place = np.unique(hashes, return_inverse=True)
            end = np.full(1, len(words) + 1)
            flat = np.concatenate([x for t in tokens for x in (t, end)])
            columns = [
                pa.array([base + next(number)]),
                pa.array([ids], pa.list_(docs_type)),
                pa.array([held], pa.list_(pa.bool_())),
                pa.array([[len(t) + 1 for t in tokens]], pa.list_(pa.int32())),
                pa.array([sorted_out(vocabulary)], pa.binary()),
                pa.array([squeeze(place[flat].astype(np.uint32))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["batch", "docs", "held", "n_tokens", "vocabulary", "tokens"])

        for b in batches:
            docs_type = b.schema.field(0).type
            for i, h, like, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                kind = kinds.get(like, KINDS - 1)
                if kind == KINDS - 1 > len(kinds):
                    kind = kinds[like] = len(kinds)
                words, ids, held, tokens = begun[kind]
                w = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                ids.append(i)
                held.append(h)
                tokens.append(np.fromiter(map(words.__getitem__, w), np.int32, len(w)))
                sizes[kind] += len(w) + 1
                if sizes[kind] >= BATCH_TOKENS:
                    yield close(kind)
                elif sum(sizes.values()) >= OPEN_TOKENS:
                    yield close(max(sizes, key=sizes.get))
        for kind in list(begun):
            yield close(kind)

    like = F.lit(None).cast("string") if like_col is None else F.col(like_col).cast("string")
    read = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held"), like.alias("like"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, BATCHES.format(kind=kind))


@dataclass
class Level:
    """A batch's n-grams of one order, sorted by context and word; single words by hash.

    ``ctx`` numbers contexts in the order of their hashes, ``low`` the n-grams of the order below in theirs.
    """

    count: np.ndarray  # in the batch's training documents
    of: np.ndarray  # the n-gram that ends at each token; -1 where the document has begun too late
    ctx: np.ndarray
    word: np.ndarray
    low: np.ndarray
    rank: np.ndarray  # place by hash
    keys: np.ndarray  # sorted hashes


class Batch:
    """A batch's tokens and n-grams up to an order."""

    def __init__(self, row: dict, order: int) -> None:
        self.number, self.docs, self.held, self.n_tokens = row["batch"], row["docs"], np.array(row["held"], bool), np.array(row["n_tokens"], np.int64)
        self.words = sorted_in(row["vocabulary"])
        self.tokens = unsqueeze(row["tokens"], np.uint32).astype(np.int64)
        self.first = np.cumsum(self.n_tokens) - self.n_tokens
        self.learn = np.repeat(~self.held, self.n_tokens)
        n = np.bincount(self.tokens[self.learn], minlength=len(self.words))
        start = int(np.searchsorted(self.words, START))
        n[start] = (~self.held).sum()  # how often the start mark is a context
        every = np.arange(len(self.words))
        self.levels = [Level(n, self.tokens, every, every, every, every, self.words)]
        position = np.arange(len(self.tokens)) - np.repeat(self.first, self.n_tokens)
        for m in range(2, order + 1):
            below = self.levels[-1]
            at = np.arange(len(self.tokens)) if m == 2 else np.flatnonzero(position >= m - 2)
            ctx = below.rank[below.of[at - 1]]
            if m == 2:
                ctx[self.first] = start
            grams, one, inverse = distinct(ctx * len(self.words) + self.tokens[at])
            of = np.full(len(self.tokens), -1)
            of[at] = inverse
            ctx, word = np.divmod(grams, max(1, len(self.words)))
            rank = keys = grams[:0]
            if m < order:
                h = _mixed(below.keys[ctx], self.words[word])
                by_hash = order_of(h)
                rank = np.empty(len(h), np.int64)
                rank[by_hash] = np.arange(len(h))
                keys = h[by_hash]
            self.levels.append(Level(np.bincount(inverse[self.learn[at]], minlength=len(grams)), of, ctx, word, below.of[at[one]], rank, keys))


# ---------------------------------------------------------------- the exchange

_FIELDS = {"batch": "long", "level": "int", "part": "int", "kind": "int", "ctx": "binary", "fan": "binary", "word": "binary", "n": "binary", "low": "binary", "base": "binary", "shrink": "binary", "p": "binary", "need": "binary", "stats": "array<bigint>"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "double": pa.float64()}
SENT = ", ".join(f"{k} {v}" for k, v in _FIELDS.items())


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], _ARROW[v]) for k, v in _FIELDS.items()], names=list(_FIELDS))


def _small(a: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(a) or int(a.max()) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + squeeze(a.astype(kind))


def _large(data: bytes) -> np.ndarray:
    return unsqueeze(data[1:], f"u{data[0]}").astype(np.int64)


def _histogram(total: np.ndarray) -> list[int]:
    """Their sum and number, and how many are 0, 1, .. K + 1, and beyond."""
    return [int(total.sum()), int((total > 0).sum()), *map(int, np.bincount(np.minimum(total, K + 2), minlength=K + 3))]


def _counts(batch: Batch, level: Level) -> np.ndarray:
    """What a batch says of its n-grams: twice the training count, and one more if it has to score them in text held out."""
    held = np.zeros(len(level.count), np.int64)
    held[level.of[(level.of >= 0) & ~batch.learn]] = 1
    if level is batch.levels[0]:
        held[np.searchsorted(batch.words, START)] = batch.held.any()  # no token, but a context
    return 2 * level.count + held


def _answers(n: np.ndarray, order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals of groups of n-grams; and what is answered: four times that, with two flags, held out somewhere and sent by several batches."""
    total = np.add.reduceat(n[order] >> 1, starts)
    held = np.maximum.reduceat(n[order] & 1, starts)
    return total, 4 * total + 2 * held + (np.diff(starts, append=len(order)) > 1)


def _of_none(row: dict) -> int:
    """The batch that rows for the driver name: none, and another one for each part, so that no bucket gets them all."""
    return -1 - row["part"]


def _backing_off(ctx: np.ndarray, n: np.ndarray, total: np.ndarray, n_ctx: int) -> np.ndarray:
    """1 for each context behind which a batch has an n-gram of held-out text that nobody has learnt, 0 for others."""
    need = np.zeros(n_ctx, np.int64)
    need[ctx[(n & 1 > 0) & (total == 0)]] = 1
    return need


def _said(n: np.ndarray) -> np.ndarray:
    """The part of an answer that follows from what the batch itself has sent (see :func:`_counts`)."""
    return 4 * (n >> 1) + 2 * (n & 1)


def _send_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                batch = Batch(row, 1)
                n = _counts(batch, batch.levels[0])
                yield _rows([{"batch": batch.number, "level": 1, "part": p, "kind": PLAIN, "ctx": sorted_out(batch.words[i:j]), "n": _small(n[i:j])} for p, i, j in cuts(batch.words, parts)])

    return run


def _add_words(parts: int):
    """Totals of words, and their numbers: place in the part by falling total, times ``parts``, plus the part."""

    def run(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        order, starts, lens = grouped([r["ctx"] for r in rows])
        n = np.concatenate([_large(r["n"]) for r in rows])
        total, answer = _answers(n, order, starts)
        keys = np.concatenate([sorted_in(r["ctx"]) for r in rows])[order][starts]
        # frequent words get small numbers, which take fewer bytes
        number = np.empty(len(total), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(total)) * parts + rows[0]["part"]
        out = [{"batch": _of_none(rows[0]), "level": 1, "part": rows[0]["part"], "kind": STATS, "stats": _histogram(total[keys != START])}]
        back = [np.split(spread(x, order, starts), np.cumsum(lens)[:-1]) for x in (answer, number)]
        said = np.split(_said(n), np.cumsum(lens)[:-1])
        out += [{"batch": r["batch"], "level": 1, "part": r["part"], "kind": PLAIN, "n": _small(a - s), "word": _small(w)} for r, s, a, w in zip(rows, said, *back, strict=True)]
        return pa.Table.from_batches([_rows(out)])

    return run


def _fans(ctx: np.ndarray, total: np.ndarray, p_low: np.ndarray, n_ctx: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each context: how many n-grams were seen 1 .. K times and how often all others were; the lower-order probability they cover."""
    seen = total > 0
    few = seen & (total <= K)
    fan = np.bincount(ctx[few] * (K + 1) + total[few] - 1, minlength=n_ctx * (K + 1))[: n_ctx * (K + 1)].reshape(n_ctx, K + 1).astype(np.int64)
    many = seen & ~few
    fan[:, K] = np.bincount(ctx[many], total[many], n_ctx)[:n_ctx].astype(np.int64)
    return fan, np.bincount(ctx[seen], p_low[seen], n_ctx)[:n_ctx].astype(float)  # of nothing, numpy counts in whole numbers


def _add_grams(m: int, model: Model):
    """What all batches sent of a part's contexts, added up and returned to each in its order."""

    def run(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: (r["kind"], r["batch"]))  # a fixed order, so that reruns add up alike
        about = {"level": m, "part": rows[0]["part"]}
        out, stats = [], np.zeros(K + 5, np.int64)
        for r in rows:
            if r["kind"] == STATS:
                stats += r["stats"]
        for kind in (PLAIN, HOT):
            mine = [r for r in rows if r["kind"] == kind]
            if not mine:
                continue
            keys, fan = zip(*((sorted_in(r["ctx"]), _large(r["fan"])) for r in mine), strict=True)
            words = [_large(r["word"]) for r in mine]
            p = np.concatenate([_low_p(r, w, f, m, model) for r, w, f in zip(mine, words, fan, strict=True)])
            edges, sizes = np.cumsum([len(k) for k in keys])[:-1], np.cumsum([len(w) for w in words])[:-1]
            own, lens = [np.repeat(np.arange(len(f)), f) for f in fan], [len(f) for f in fan]
            keys, fan, word = np.concatenate(keys), np.concatenate(fan), np.concatenate(words)
            n = np.concatenate([_large(r["n"]) for r in mine])
            ctx_of = np.empty(len(keys), np.int64)
            by_key = np.argsort(keys, kind="stable")  # each message's are in order already
            ctx_of[by_key] = np.cumsum(np.diff(keys[by_key], prepend=keys[by_key[:1]]) != 0)
            ctx = np.repeat(ctx_of, fan)
            order = order_of(ctx * (int(word.max()) + 1) + word)
            c, w = ctx[order], word[order]
            starts = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1]))))
            total, answer = _answers(n, order, starts)
            stats += _histogram(total)
            # those who have learnt an n-gram all send one probability, others that or none
            p_low = np.maximum.reduceat(p[order], starts)
            fans, lower = _fans(c[starts], total, p_low, int(ctx_of.max()) + 1)
            answer = spread(answer, order, starts)
            back = np.split(answer - _said(n), sizes)
            need = [_backing_off(*x) for x in zip(own, np.split(n, sizes), np.split(answer >> 2, sizes), lens, strict=True)]
            seen = np.bincount(c[starts], total).astype(np.int64)  # how often each context was
            for r, t, k, needs in zip(mine, back, np.split(ctx_of, edges), need, strict=True):
                row = about | {"batch": r["batch"], "kind": kind, "n": _small(t)}
                if kind == PLAIN:  # contexts in the order of their counts, which batches know, have like fans side by side; how often all others were seen follows
                    row |= {"fan": _small(fans[k[np.argsort(seen[k], kind="stable")], :K].T.reshape(-1)), "p": squeeze(lower[k[needs > 0]])}
                out.append(row)
            if kind == HOT:
                hot = np.unique(keys)
                out.append(about | {"batch": _of_none(about), "kind": SUMS, "ctx": sorted_out(hot), "fan": _small(fans.reshape(-1)), "p": squeeze(lower)})
        out.append(about | {"batch": _of_none(about), "kind": STATS, "stats": stats.tolist()})
        return pa.Table.from_batches([_rows(out)])

    return run


def _low_p(row: dict, word: np.ndarray, fan: np.ndarray, m: int, model: Model) -> np.ndarray:
    """The lower-order probabilities of a message's n-grams, from the counts that were sent (see :meth:`Exchange._message`); 0 where none was."""
    low = _large(row["low"])
    if m == 2:
        return model.words.p(_placed(low, np.argsort(word, kind="stable")))
    base = np.repeat(_large(row["base"]), fan)
    shrink = np.repeat(unsqueeze(row["shrink"], np.float64), fan) if row["shrink"] else 1.0
    return np.where((low > 0) & (base > 0), model.discounts[m - 1].kept(low) * shrink / np.maximum(base, 1), 0.0)


# ---------------------------------------------------------------- the model


class Discounts:
    """Good-Turing discounts of one order, from counts of counts."""

    def __init__(self, stats: list[int]) -> None:
        self.n, self.types, self.of = stats[0], stats[1], stats[2:]
        n, d = self.of, np.ones(K + 2)
        common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        for r in range(1, K + 1):
            if n[r] and common < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                d[r] = x if 0 < x < 1 else 1.0
        self.d = d

    def kept(self, c: np.ndarray) -> np.ndarray:
        return self.d[np.minimum(c, K + 1)] * c


class Words(Discounts):
    """The discounted unigrams, and the probability of each word not seen."""

    def __init__(self, stats: list[int]) -> None:
        super().__init__(stats)
        seen = sum(r * self.of[r] for r in range(1, K + 2))
        mass = self.n - seen + sum(self.d[r] * r * self.of[r] for r in range(1, K + 2))
        left = 1 - mass / self.n if self.n else 1.0
        # at least half a count is left for the unknown
        self.unseen = max(left, 0.5 / (self.n + 0.5 * (self.types + 1)))
        self.scale = (1 - self.unseen) / (1 - left) if left < 1 else 1.0
        others = self.of[1] ** 2 / (2 * self.of[2]) if self.of[2] else self.of[1] * (self.of[1] - 1) / 2
        self.unknown = self.unseen / max(1.0, others)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * self.kept(c) / max(1, self.n), self.unknown)


class Model:
    """Discounts by order, and the sums of hot contexts, as far as they are known."""

    def __init__(self, words: Words, parts: int, hot_tokens: int) -> None:
        self.words, self.parts, self.hot_tokens = words, parts, hot_tokens
        self.discounts: dict[int, Discounts] = {}
        self.hot: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


class Exchange:
    """What a batch sends for one order, given what is known of the n-grams of the order below.

    That is their answers and probabilities, and of their contexts the counts and by what their n-grams are shrunk (none of words).
    """

    def __init__(self, batch: Batch, m: int, below_answer: np.ndarray, below_p: np.ndarray, below_contexts: tuple[np.ndarray, np.ndarray] | None, model: Model) -> None:
        self.level, below = batch.levels[m - 1], batch.levels[m - 2]
        by_hash = lambda x: x if m == 2 else _placed(x, below.rank)
        self.keys, answer = below.keys, by_hash(below_answer)
        self.ctx_total, self.wanted, shared = answer >> 2, (answer & 2) > 0, (answer & 1) > 0
        self.counts = _counts(batch, self.level)
        self.p_low = below_p[self.level.low]
        ctx = self.level.ctx
        self.low, self.base = (below_answer >> 2)[self.level.low], None
        if below_contexts is not None:
            # the lower order's probabilities serve to back off, which only text held out does
            self.low[(self.level.count == 0) | ~self.wanted[ctx]] = 0
            self.base, self.below_ctx = below_contexts, below.ctx
        sent = (shared & (self.ctx_total > 0))[ctx]
        hot = (self.ctx_total > model.hot_tokens)[ctx]
        self.plain, self.hot = np.flatnonzero(sent & ~hot), np.flatnonzero(sent & hot)
        self.own = np.flatnonzero(~sent)
        # contexts that held-out tokens may back off from: an n-gram that the batch has learnt is no reason
        self.need = _backing_off(ctx, self.counts, self.counts >> 1, len(self.keys))
        # hot n-grams go by their own hash
        self.deal = (_mixed(self.keys[ctx[self.hot]], batch.words[self.level.word[self.hot]]) % np.uint64(model.parts)).astype(np.int64)
        order = np.argsort(self.deal, kind="stable")
        self.hot, self.deal = self.hot[order], self.deal[order]

    def contexts(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The contexts of some n-grams in their order, and where each begins."""
        ctx = self.level.ctx[entries]
        begin = np.flatnonzero(np.diff(ctx, prepend=-1))
        return ctx[begin], begin

    def messages(self, batch: Batch, m: int, numbers: np.ndarray, parts: int, turn: int, rounds: int) -> list[dict]:
        """What goes to the parts whose turn it is."""
        out, now = [], lambda part: part % rounds == turn
        ctx, begin = self.contexts(self.plain)
        end = np.append(begin, len(self.plain))
        for part, i, j in (x for x in cuts(self.keys[ctx], parts) if now(x[0])):
            out.append(self._message(self.plain[end[i] : end[j]], numbers) | {"part": part, "kind": PLAIN})
        for i, j in (x for x in _spans(self.deal) if now(self.deal[x[0]])):
            out.append(self._message(self.hot[i:j], numbers) | {"part": int(self.deal[i]), "kind": HOT})
        if now(batch.number % parts):
            out.append({"part": batch.number % parts, "kind": STATS, "stats": _histogram(self.level.count[self.own])})
        return [{"batch": batch.number, "level": m} | x for x in out]

    def _message(self, entries: np.ndarray, numbers: np.ndarray) -> dict:
        """N-grams by context, with what their lower-order probabilities follow from.

        Of pairs these are the words' counts, in the order of the words' numbers, so that equal ones lie side by side. Of longer
        n-grams they are the counts of those one word shorter, and for each context the count and the shrinking of its own end.
        """
        ctx, begin = self.contexts(entries)
        word, low = numbers[self.level.word[entries]], self.low[entries]
        out = {"ctx": sorted_out(self.keys[ctx]), "fan": _small(np.diff(begin, append=len(entries))), "need": _small(self.need[ctx]), "word": _small(word), "n": _small(self.counts[entries])}
        if self.base is None:
            return out | {"low": _small(low[np.argsort(word, kind="stable")])}
        end, wanted = self.below_ctx[self.level.low[entries[begin]]], self.wanted[ctx]
        count, shrink = np.where(wanted, self.base[0][end], 0), np.where(wanted, self.base[1][end], 1.0)
        return out | {"low": _small(low), "base": _small(count), "shrink": squeeze(shrink) if (shrink != 1).any() else b""}

    def answered(self, rows: list[dict], discounts: Discounts, hot: tuple | None) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The answer to each n-gram and its probability, from what the parts returned; the contexts' counts and shrinkings."""
        answer = _said(self.counts)
        for kind, entries in ((PLAIN, self.plain), (HOT, self.hot)):
            mine = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["part"])
            if mine:
                answer[entries] += np.concatenate([_large(r["n"]) for r in mine])
        total = answer >> 2
        # contexts of this batch alone, then those that parts and all parts together answer for
        own = self.own
        fan, lower = _fans(self.level.ctx[own], total[own], self.p_low[own], len(self.keys))
        ctx, _ = self.contexts(self.plain)
        mine = sorted((r for r in rows if r["kind"] == PLAIN), key=lambda r: r["part"])
        if mine:
            few = [_large(r["fan"]).reshape(K, -1).T for r in mine]
            counts = np.split(self.ctx_total[ctx], np.cumsum([len(f) for f in few])[:-1])
            few = np.concatenate([_placed(f, np.argsort(c, kind="stable")) for f, c in zip(few, counts, strict=True)])
            # each occurrence of a context in training has one word behind it
            fan[ctx] = np.column_stack((few, self.ctx_total[ctx] - few @ np.arange(1, K + 1)))
            need = _backing_off(self.level.ctx[self.plain], self.counts[self.plain], total[self.plain], len(self.keys))
            lower[ctx[need[ctx] > 0]] = np.concatenate([unsqueeze(r["p"], np.float64) for r in mine])
        if hot is not None and len(self.hot):
            ctx = np.unique(self.level.ctx[self.hot])
            at = np.searchsorted(hot[0], self.keys[ctx])
            fan[ctx], lower[ctx] = hot[1][at], hot[2][at]
        count = self.ctx_total.astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            used = np.where(count > 0, fan @ np.append(discounts.d[1 : K + 1] * np.arange(1, K + 1), 1.0) / count, 0.0)
            most = 1 - 0.5 / (count + 1)
            shrink = np.where(used > most, most / used, 1.0)
            alpha = np.where(count > 0, (1 - used * shrink) / (1 - lower), 1.0)
            of = self.level.ctx
            p = np.where(total > 0, discounts.kept(total) * shrink[of] / count[of], alpha[of] * self.p_low)
        return answer, p, (self.ctx_total, shrink)


def _placed(x: np.ndarray, rank: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[rank] = x
    return out


def _spans(a: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal neighbours begins and ends."""
    begin = np.flatnonzero(np.diff(a, prepend=-1)).tolist()
    return list(zip(begin, [*begin[1:], len(a)], strict=False))


def resolved(batch: Batch, rows: list[dict], model: Model, upto: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]]]:
    """Word totals and numbers, and of each order up to ``upto`` the answers to the n-grams and their probabilities."""
    of = defaultdict(list)
    for r in rows:
        of[r["level"]].append(r)
    words = sorted(of[1], key=lambda r: r["part"])
    answer, numbers = (np.concatenate([_large(r[c]) for r in words]) for c in ("n", "word"))
    answer += _said(_counts(batch, batch.levels[0]))
    total = answer >> 2
    known = [(answer, model.words.p(total), None)]
    for m in range(2, upto + 1):
        known.append(Exchange(batch, m, *known[-1], model).answered(of[m], model.discounts[m], model.hot.get(m)))
    return total, numbers, known


def _send_grams(m: int, model: Model, turn: int, rounds: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, rows = [], right.to_pylist()
        for row in left.to_pylist():
            batch = Batch(row, m)
            _, numbers, known = resolved(batch, rows, model, m - 1)
            out += Exchange(batch, m, *known[-1], model).messages(batch, m, numbers, model.parts, turn, rounds)
        return pa.Table.from_batches([_rows(out)])

    return run


def _score(model: Model, order: int, kind: pa.DataType):
    schema = [("doc_id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, out = right.to_pylist(), []
        for row in left.to_pylist():
            batch = Batch(row, order)
            words, _, known = resolved(batch, rows, model, order)
            base = np.log10((words + 0.5) / (model.words.n + 0.5 * (model.words.types + 1)))
            logs = np.zeros(len(batch.tokens))
            for level, (_, p, _) in zip(batch.levels, known, strict=True):  # the highest order that a token has
                at = np.flatnonzero(level.of >= 0)
                logs[at] = np.log10(p)[level.of[at]]
            per_doc = lambda x: np.add.reduceat(x, batch.first).tolist()
            n = len(batch.first)
            columns = (batch.docs, batch.held.tolist(), batch.n_tokens.tolist(), per_doc((words > 0)[batch.tokens].astype(np.int64)), [model.words.n] * n, per_doc(base[batch.tokens]), per_doc(logs))
            out.append(pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, schema, strict=True)], names=[x for x, _ in schema]))
        return pa.Table.from_batches(out, pa.schema(schema))

    return run


def _stats(answers: DataFrame) -> list[int]:
    found = answers.filter(F.col("kind") == STATS).select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()  # K + 5 numbers
    n = {r["at"]: r["n"] for r in found}
    return [n.get(k, 0) for k in range(K + 5)]


def _hot_sums(answers: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hot contexts' keys, fans and lower-order probabilities over all parts; one context for each HOT_TOKENS tokens at most."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                keys, fan, lower = sorted_in(r["ctx"]).view(np.int64), _large(r["fan"]).reshape(-1, K + 1), unsqueeze(r["p"], np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(fan[:, k]) for k in range(K + 1)), pa.array(lower)], names=names)

    names = ["key", *(f"f{k}" for k in range(K + 1)), "lower"]
    rows = answers.filter(F.col("kind") == SUMS).select("ctx", "fan", "p").mapInArrow(opened, ", ".join(f"{n} {'double' if n == 'lower' else 'long'}" for n in names))
    found = rows.groupBy("key").agg(*(F.sum(n).alias(n) for n in names[1:])).collect()
    found.sort(key=lambda r: r["key"] % 2**64)
    keys = np.array([r["key"] for r in found], np.int64).view(np.uint64)
    return keys, np.array([[r[n] for n in names[1:-1]] for r in found], np.int64).reshape(len(found), K + 1), np.array([r["lower"] for r in found], np.float64)


def katz_scores(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", order: int = ORDER, hot_tokens: int | None = None, like_col: str | None = None) -> DataFrame:
    """For each row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10).

    Rows that are alike in ``like_col`` are worked on together, which saves shuffling and changes no score.
    """
    if order < 1:
        raise ValueError("order must be positive")
    spark = docs.sparkSession
    batches = bucketed(_batches(docs, text_col, id_col, like_col), "batch", "katz-batches")
    tokens = batches.select(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PART_TOKENS))
    # an answer goes to its batch once, however often the batch reads it
    name = bucket_table("katz-answers")
    keep = lambda df: add_to(name, df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "batch"), "batch")

    def with_answers(upto: int, how, schema: str) -> DataFrame:
        mine = spark.table(name).filter((F.col("batch") >= 0) & (F.col("level") <= upto))
        return batches.groupBy("batch").cogroup(mine.groupBy("batch")).applyInArrow(how, schema)

    answers = keep(batches.mapInArrow(_send_words(parts), SENT).groupBy("part").applyInArrow(_add_words(parts), SENT))
    model = Model(Words(_stats(answers)), parts, HOT_TOKENS if hot_tokens is None else hot_tokens)
    for m in range(2, order + 1):
        rounds = 1 if m == 2 else ROUNDS
        for turn in range(rounds):
            sent = with_answers(m - 1, _send_grams(m, model, turn, rounds), SENT)
            answers = keep(sent.groupBy("part").applyInArrow(_add_grams(m, model), SENT))
        answers = answers.filter(F.col("level") == m)
        model.discounts[m] = Discounts(_stats(answers))
        model.hot[m] = _hot_sums(answers)
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    result = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_answers(order, _score(model, order, to_arrow_type(kind)), result)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return katz_scores(docs, like_col="lang" if "lang" in docs.columns else None)
