"""Byte-level BPE: exact encoding in linear time by backtracking, decoding by an offset table.

A text is cut at special tokens and into the pieces between which the vocabulary never merges. Inside a piece,
BPE's merges leave one sequence of tokens. It is found without merging: an Aho-Corasick automaton gives the
longest token at every place; from the left, the longest one is taken that is compatible with the token before
it, else the next shorter; if none is, the token before is taken back. Two adjacent tokens are compatible if
BPE would leave the border between them, which depends on these two alone; places that lead nowhere are marked,
so that each is left once and the work is linear. A sequence of tokens whose neighbours are all compatible is
what BPE gives, and there is only one. The table of compatible pairs fills while texts are read.

The driver reads the vocabulary file and sends its bytes (checked against ``MAX_VOCABULARY``) to the tasks; texts are
not shuffled. The tables of pieces and of pairs hold ``MEMO`` entries each at most and are then started anew.

Defined results
---------------
* null and empty text have no tokens and decode to the empty text;
* a special token's string in a text is that token, as the vocabulary's library has it;
* bytes that are no UTF-8 (in a damaged column, or in ids that end inside a character) become U+FFFD;
* ids outside the vocabulary and null ids are left out when decoding; a null array decodes to the empty text;
* rows are worked on one by one: repeated rows and ids stay, an empty table gives an empty result, and input
  columns named like a result column are replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name, table

#: A file of the installed vocabularies; any other file of this format may be given by its path.
VOCABULARY = "byte_bpe_50k.json"
#: Bytes of a vocabulary file that are sent to every task at most.
MAX_VOCABULARY = 64 << 20
#: Entries of each table that a task fills while it reads, and the longest entry (in characters).
MEMO, MEMO_CHARS = 500_000, 64
#: Characters or ids that are worked on together.
CHUNK = 500_000

# Fixed values of byte-level vocabularies: the pattern of the pieces, and the bytes that are written as themselves.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A border between pieces wherever it is: before a space that ends a run of white space.
BORDER = re.compile(r" (?=\S)")
#: A space that is not.
NO_BORDER = re.compile(r" (?!\S)")
PRINTED = frozenset([*range(33, 127), *range(161, 173), *range(174, 256)])

#: Stand-ins of each kind of character, none of them in a contraction.
LETTER, NUMBER, OTHER = "ŋ", "²", "¬"


def installed(name: str) -> str:
    """The path of an installed vocabulary file; a name with a folder is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def read_small(path: str, most: int = MAX_VOCABULARY) -> bytes:
    """The bytes of a file that is sent to every task; more than ``most`` are refused."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} has more than {most} bytes")
    return data


# ------------------------------------------------------------------ vocabulary


def _byte_of() -> dict[str, str]:
    """The letter by which vocabularies write each byte, to that byte (as a Latin-1 letter): itself if printed, else one from U+0100 on."""
    rest = (b for b in range(256) if b not in PRINTED)
    return {chr(b): chr(b) for b in PRINTED} | {chr(256 + k): chr(b) for k, b in enumerate(rest)}


def vocabulary(data: bytes) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """Ids of tokens, merges in order, and ids of special tokens; bytes are Latin-1 letters.

    Refuses what would change the pieces or merges: normalizers, prefixes, other cutting, dropout and the like.
    """
    j = json.loads(data)
    model, cut = j["model"], j["pre_tokenizer"] or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    odd += [k for k in ("normalizer", "truncation", "padding") if j.get(k)]
    odd += [t["content"] for t in j["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
    if odd or model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError(f"not a plain byte-level BPE vocabulary: {odd or cut}")
    letters = str.maketrans(_byte_of())
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in j["added_tokens"]}
    ids = {t.translate(letters): i for t, i in model["vocab"].items() if t not in special}
    return ids, [(a.translate(letters), b.translate(letters)) for a, b in merges], special


def tokens_of(ids: dict[str, int], merges: list[tuple[str, str]]) -> tuple[list[str], dict[str, int], list[int], list[int], dict[tuple[int, int], int]]:
    """Tokens numbered by the order in which merges make them (bytes first), the two parts of each, and merges by their parts."""
    tokens = [chr(b) for b in range(256)]
    number = {t: k for k, t in enumerate(tokens)}
    left, right, merged = list(range(256)), list(range(256)), {}
    for a, b in merges:
        if a + b in number:
            raise ValueError("two merges make one token")
        number[a + b] = merged[number[a], number[b]] = len(tokens)
        left.append(number[a])
        right.append(number[b])
        tokens.append(a + b)
    if missing := [t for t in tokens if t not in ids]:
        raise ValueError(f"tokens without an id: {missing[:3]}")
    return tokens, number, left, right, merged


def compatible(a: int, b: int, left: list[int], right: list[int], merged: dict[tuple[int, int], int], before: int | None = None) -> bool:
    """Whether BPE leaves the border between the tokens ``a`` and ``b`` (with ``before``: up to that merge).

    Merges are undone from the last to the first, ``a`` from its right end and ``b`` from its left. What then touches
    the border was there at that moment, so a merge of the two that comes earlier would have crossed it. Of equal
    merges the one further left goes first: one over the border after ``a``'s own, before ``b``'s.
    """
    limit = len(left) if before is None else before
    while True:
        if merged.get((a, b), limit) < limit:
            return False
        if a < 256 and b < 256:
            return True
        if a > b:
            limit, a = a, right[a]
        else:
            limit, b = b + 1, left[b]


# -------------------------------------------------------------------- encoding


def cutter() -> Callable[[str], Iterator[str]]:
    """A function that yields a text's pieces.

    Libraries know different versions of Unicode. Characters that Python's own does not know are asked of the
    vocabulary's library, and stand-ins of that kind take their place while the text is cut.
    """
    import regex

    pattern = regex.compile(PIECES)
    known: set[str] = set()
    kinds: dict[str, str] = {}

    def kind(c: str) -> str:
        from tokenizers import pre_tokenizers

        cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return next((k for k in (LETTER, NUMBER, OTHER) if len(cut.pre_tokenize_str(k + c)) == 1), " ")

    def shadow(text: str) -> str:
        for c in set(text) - known:
            if unicodedata.category(c) == "Cn":
                kinds[c] = kinds.get(c) or kind(c)
            else:
                known.add(c)
        return re.sub(f"[{''.join(map(re.escape, kinds))}]", lambda m: kinds[m[0]], text) if kinds else text

    def pieces(text: str) -> Iterator[str]:
        cut = text if text.isascii() or known.issuperset(text) else shadow(text)
        if cut is text and len(text) < 1 << 24:
            yield from pattern.findall(text)
        else:
            yield from (text[m.start() : m.end()] for m in pattern.finditer(cut))

    return pieces


class _Ids(dict):
    """The ids of texts (as bytes of little-endian numbers), worked out when first asked for."""

    def __init__(self, ids_of: Callable[[str], bytes]) -> None:
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, text: str) -> bytes:
        out = self.ids_of(text)
        if len(text) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[text] = out
        return out


class _Fits(dict):
    """Whether two tokens are compatible, worked out when first asked for."""

    def __init__(self, *tables) -> None:
        super().__init__()
        self.tables = tables

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= MEMO:
            self.clear()
        ok = self[pair] = compatible(*pair, *self.tables)
        return ok


def splitter(ids: dict[str, int], merges: list[tuple[str, str]]) -> Callable[[str], bytes]:
    """A function from a piece to its ids, by backtracking over longest matches."""
    import ahocorasick

    tokens, number, left, right, merged = tokens_of(ids, merges)
    # a token that BPE does not make of its own bytes is never met
    made = [True] * 256
    for t in range(256, len(tokens)):
        made.append(made[left[t]] and made[right[t]] and compatible(left[t], right[t], left, right, merged, t))
    size = [len(t) for t in tokens]
    shorter = [next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in number and made[number[t[:k]]]), -1) for t in tokens]
    forwards, backwards = ahocorasick.Automaton(), ahocorasick.Automaton()
    for k, t in enumerate(tokens):
        if made[k]:
            forwards.add_word(t, k)
            backwards.add_word(t[::-1], k)
    forwards.make_automaton()
    backwards.make_automaton()
    fits = _Fits(left, right, merged)
    code = [int(ids[t]).to_bytes(4, "little") for t in tokens]

    def backtracked(text: str) -> list[int]:
        n = len(text)
        longest = array("i", bytes(4 * n))
        for end, t in backwards.iter(text[::-1]):  # read backwards, matches end where they begin; the longest comes first
            if not longest[n - 1 - end]:
                longest[n - 1 - end] = t + 1
        useless: set[int] = set()
        out: list[int] = []
        at, t = 0, longest[0] - 1
        while True:
            end = at + size[t]
            if end not in useless and (not out or fits[out[-1], t]):
                out.append(t)
                if end == n:
                    return out
                at, t = end, longest[end] - 1
                continue
            t = shorter[t]
            if t < 0:
                useless.add(at)
                t = out.pop()
                at -= size[t]

    def ids_of(piece: str) -> bytes:
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        # the longest match after each one, as is, often is the answer
        found = [t for _, t in forwards.iter_long(text)]
        if sum([size[t] for t in found]) != len(text) or not all([fits[p] for p in pairwise(found)]):
            found = backtracked(text)
        return b"".join([code[t] for t in found])

    return ids_of


def encoder(data: bytes) -> Callable[[str], Iterator[bytes]]:
    """A function from a text to its ids, as bytes of little-endian 32-bit numbers, in parts of bounded size."""
    ids, merges, special = vocabulary(data)
    pieces, piece_ids = cutter(), _Ids(splitter(ids, merges))
    after_space = _Ids(lambda word: b"".join([piece_ids[p] for p in pieces(" " + word)]))
    split = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def plain(text: str) -> Iterator[bytes]:
        at, n = 0, len(text)
        while at < n:
            border = BORDER.search(text, at + CHUNK)
            part = text[at : border.start() if border else n]
            at += len(part)
            first, *rest = BORDER.split(part) if NO_BORDER.search(part) else part.split(" ")
            yield b"".join([piece_ids[p] for p in pieces(first)] + [after_space[w] for w in rest])

    def encode(text: str) -> Iterator[bytes]:
        at = 0
        for m in split.finditer(text) if split else ():
            yield from plain(text[at : m.start()])
            yield special[m[0]].to_bytes(4, "little")
            at = m.end()
        yield from plain(text[at:] if at else text)

    return encode


# -------------------------------------------------------------------- decoding


def decoder(data: bytes) -> Callable[[np.ndarray], str]:
    """A function from ids to their text.

    The bytes of all tokens lie in one array; an offset table says where those of each id begin and end.
    """
    ids, _, special = vocabulary(data)
    named = {i: t.encode("latin-1") for t, i in ids.items()} | {i: t.encode() for t, i in special.items()}
    top = max(named, default=-1) + 1
    offset = np.zeros(top + 1, np.int64)
    offset[1:] = np.cumsum([len(named.get(i, b"")) for i in range(top)])
    blob = np.frombuffer(b"".join(named.get(i, b"") for i in range(top)), np.uint8)

    def decode(numbers: np.ndarray) -> str:
        utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        out = []
        for k in range(0, len(numbers), CHUNK):
            part = numbers[k : k + CHUNK].astype(np.int64)
            part = part[(part >= 0) & (part < top)]
            length = offset[part + 1] - offset[part]
            at = np.repeat(offset[part] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            out.append(utf8.decode(blob[at].tobytes()))
        out.append(utf8.decode(b"", True))
        return "".join(out)

    return decode


# -------------------------------------------------------------------- on tables

Batches = Iterator[pa.RecordBatch]


def _lists(parts: list[bytes], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *(len(p) // 4 for p in parts)])
    large = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.frombuffer(b"".join(parts), np.int32)))
    return large.cast(kind)


def _encode(batches: Batches, data: bytes) -> Batches:
    """Adds ``ids`` for the bytes in the last column, which it drops."""
    encode = encoder(data)
    for b in batches:
        for k in range(0, b.num_rows, 1000):
            part = b.slice(k, 1000)
            texts = part.column(part.num_columns - 1)
            ids = [b"".join(encode(t.as_py().decode("utf-8", "replace"))) if t.is_valid else b"" for t in texts]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], _lists(ids, pa.list_(pa.int32()))], names=[*part.schema.names[:-1], "ids"])


def _decode(batches: Batches, data: bytes) -> Batches:
    """Adds the text of the ids in the last column."""
    decode = decoder(data)
    for b in batches:
        lists = b.column(b.num_columns - 1)
        texts = [decode(v.values.drop_null().to_numpy(zero_copy_only=False)) if v.is_valid else "" for v in lists]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])


def _digest(batches: Batches) -> Batches:
    """The digest columns of ids and decoded texts, the last two columns."""
    for b in batches:
        *rest, lists, texts = b.columns
        ids = [v.values.to_numpy() for v in lists]
        columns = {
            "n_tokens": pa.array([len(v) for v in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(v.astype("<u4").tobytes()).hexdigest() for v in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(t.as_py().encode()).hexdigest() for t in texts], pa.string()),
        }
        yield pa.RecordBatch.from_arrays([*rest, *columns.values()], names=[*b.schema.names[:-2], *columns])


def _sent(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(read_small(installed(path)))


def _map(df: DataFrame, source: str, as_type: str, results: dict[str, str], run: Callable[[Batches], Batches]) -> DataFrame:
    """``df`` with the columns that ``run`` puts in place of a last column: ``source`` in another type."""
    last = free_name(df, "_source")
    keep = [c for c in df.columns if c.lower() not in {r.lower() for r in results}]
    kept = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{source}`").cast(as_type).alias(last))
    schema = StructType([f for f in kept.schema.fields if f.name != last] + StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in results.items())).fields)
    return kept.mapInArrow(run, schema)


def encoded(df: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``df`` with ``ids array<int>``, the tokens of ``text``."""
    sent = _sent(df.sparkSession, path)
    return _map(df, text, "binary", {"ids": "array<int>"}, lambda batches: _encode(batches, sent.value))


def decoded(df: DataFrame, ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``df`` with ``decoded string``, the text of the tokens in ``ids``."""
    sent = _sent(df.sparkSession, path)

    def run(batches: Batches) -> Batches:
        for b in _decode(batches, sent.value):
            yield b.select([c for k, c in enumerate(b.schema.names) if k != b.num_columns - 2])

    return _map(df, ids, "array<int>", {"decoded": "string"}, run)


def round_trip(df: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of ``text`` and the SHA-256 of its ids and of their decoded text.

    Texts, ids and decoded texts pass from one to the next inside a task; only digests leave it.
    """
    sent = _sent(df.sparkSession, path)
    results = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return _map(df, text, "binary", results, lambda batches: _digest(_decode(_encode(batches, sent.value), sent.value)))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
