"""Personal data and secrets: detection and surrogate generation.

Detected entities get a keyed surrogate of the same type and format: digits stay digits, letters
keep their case and script, separators stay, cards keep their check digit valid, names keep their
gender. The surrogate is a function of the key and of the entity's canonical form, so that every
mention in the corpus gets the same one (coreference). Surrogates are checked over the whole
corpus: no two entities share one, and none is itself an entity of the corpus; those that lose a
collision draw again until none is left (distinctness).

Only entities that had to draw again need to be looked up when texts are rewritten. They are few;
up to a checked number they are broadcast, beyond it they are joined to the documents that have them.

Defined results
---------------
* null text stays null, empty text empty; both have no entities;
* detection is per row and does not depend on ids, which may be null or repeated;
* overlapping finds: the first by position, then by the order of PATTERNS;
* names are found after a title; the same words, capitalised, are mentions of them anywhere in the same text;
* input columns named like a result column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name, materialize, table

#: The query's key. Deployments pass their own.
DEFAULT_KEY = "ledgerloom surrogate key"

#: Up to so many entities that drew again are broadcast (some 20 MB).
BROADCAST_REDRAWN = 200_000
MAX_DRAWS = 50

# Titles that introduce a person's name, by gender.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "κυρία")

_TITLES = "|".join(sorted(MALE_TITLES + FEMALE_TITLES, key=len, reverse=True))

PATTERNS = {
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "assigned": r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?(?P<assigned_value>[A-Za-z0-9_\-+/]{8,})",
    "hex_secret": r"(?<![0-9A-Za-z])(?=[0-9a-f]*\d)[0-9a-f]{32,128}(?![0-9A-Za-z])",
    "email": r"[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)*\.\w+",
    "mac": r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "phone": r"(?<![\w.+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w|[.-]\d)",
    "name": rf"(?<!\w)(?P<title>{_TITLES})\.? (?P<person>[^\W\d_]+(?:-[^\W\d_]+)?(?: [^\W\d_a-zà-ÿ][^\W\d_]+)?)",
}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
_CAPITALISED = re.compile(r"(?<!\w)(?=[^\W\d_a-zà-ÿ])[^\W\d_]+(?:-[^\W\d_]+)?(?!\w)")
#: A text without any of these has no entity.
_MAY_HAVE = re.compile(r"[\d@]")
_HINTS = ("AKIA", "ASIA", "assw", "ecret", "oken", *MALE_TITLES, *FEMALE_TITLES)

SYLLABLES = {
    "latin": ("ba", "de", "ka", "lo", "mi", "na", "re", "so", "ti", "va", "ro", "le", "du", "fe", "ga", "ni"),
    "cyrillic": ("ба", "де", "ка", "ло", "ми", "на", "ре", "со", "ти", "ва", "ро", "ле", "ду", "фе", "га", "ни"),
    "greek": ("βα", "δε", "κα", "λο", "μι", "να", "ρε", "σο", "τι", "φα", "ρο", "λε", "δυ", "φε", "γα", "νι"),
}
ENDINGS = {"latin": {"m": "n", "f": "na", "s": "son"}, "cyrillic": {"m": "н", "f": "на", "s": "ко"}, "greek": {"m": "ς", "f": "να", "s": "δης"}}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _only(s: str, keep) -> str:
    return "".join(c for c in s if keep(c))


def _script(s: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", s) else "greek" if re.search("[Ͱ-Ͽ]", s) else "latin"


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, canonical form)`` of the entities in ``text``, in order, without overlaps."""
    if not text or not (_MAY_HAVE.search(text) or any(h in text for h in _HINTS)):
        return []
    out, at, named = [], 0, {}
    while m := _FIND.search(text, at):
        kind = m.lastgroup if m.lastgroup in PATTERNS else next(k for k in PATTERNS if m.group(k) is not None)
        start, end = m.span()
        s = m.group()
        ok, canon = True, s
        if kind == "assigned":
            start, end = m.span("assigned_value")
            canon = s = m.group("assigned_value")
            ok, kind = any(c.isdigit() for c in s), "secret"
        elif kind in ("aws_key", "hex_secret"):
            kind = "secret"
        elif kind == "email":
            s = s.rstrip(".-")
            end, canon = start + len(s), s.lower()
        elif kind in ("mac", "ipv6"):
            canon = s.lower()
        elif kind == "iban":
            ok, canon = _iban_ok(s), s.replace(" ", "")
        elif kind == "card":
            canon = _only(s, str.isdigit)
            ok = _luhn(canon) and len(set(canon)) > 1
        elif kind == "phone":
            canon = ("+" if "+" in s else "") + _only(s, str.isdigit)
            ok = 9 <= len(canon) <= 16
        elif kind == "name":
            gender = "m" if m.group("title") in MALE_TITLES else "f"
            words = m.group("person").split()
            ok = words[0][0].isupper()
            if ok:
                pos = m.start("person")
                for k, w in enumerate(words):
                    role = gender if k == 0 and len(words) > 1 else "s"
                    out.append((pos, pos + len(w), f"name_{role}", w.lower()))
                    pos += len(w) + 1
                    named.setdefault(w.lower(), f"name_{role}")
            at = max(end, m.end("title") + 1) if ok else m.end("title")
            continue
        if ok:
            out.append((start, end, kind, canon))
            at = end
        else:
            # inside a rejected run of digits nothing else may start by accident
            at = m.end() if kind == "card" else m.start() + 1
    return _with_mentions(text, out, named) if named else out


def _with_mentions(text: str, found: list[tuple[int, int, str, str]], named: dict[str, str]) -> list[tuple[int, int, str, str]]:
    """``found`` with the other mentions of the names that a title introduced somewhere in the text: the same words, capitalised, without a title."""
    more = []
    for m in _CAPITALISED.finditer(text):
        s, e = m.span()
        kind = named.get(m.group().lower())
        if kind and not any(a < e and s < b for a, b in _around(found, s)):
            more.append((s, e, kind, m.group().lower()))
    return sorted([*found, *more])


def _around(found: list[tuple[int, int, str, str]], at: int) -> list[tuple[int, int]]:
    """The finds next to a place."""
    k = bisect.bisect(found, (at,))
    return [f[:2] for f in found[max(0, k - 1) : k + 1]]


class _Draw:
    """A stream of numbers below given bounds, from the key and the entity."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int) -> None:
        self.seed, self.block, self.left = (key, f"{kind}\0{canon}\0{attempt}".encode("utf-8", "surrogatepass")), 0, 0

    def below(self, n: int) -> int:
        if self.left < n << 32:
            digest = hmac.new(self.seed[0], self.seed[1] + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block, self.left = self.block + 1, 1 << 256
            self.value = int.from_bytes(digest, "big")
        self.value, out = divmod(self.value, n)
        self.left //= n
        return out


def _reshaped(s: str, draw: _Draw, hexadecimal: bool = False) -> str:
    out = []
    for c in s:
        if hexadecimal and c in "0123456789abcdefABCDEF":
            x = "0123456789abcdef"[draw.below(16)]
            out.append(x.upper() if c.isupper() else x)
        elif c.isdigit() and c.isascii():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            first, n = ("а", 32) if "а" <= c.lower() <= "я" else ("α", 25) if "α" <= c.lower() <= "ω" else ("a", 26)
            x = chr(ord(first) + draw.below(n))
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: str, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical form of the surrogate of an entity's canonical form, in the ``attempt``-th draw."""
    draw = _Draw(key.encode(), kind, canon, attempt)
    if kind.startswith("name_"):
        script, role = _script(canon), kind[-1]
        n = max(2, min(4, len(canon) // 2)) + attempt // 4
        return "".join(SYLLABLES[script][draw.below(16)] for _ in range(n)) + ENDINGS[script][role]
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        labels = domain.split(".")
        site = _Draw(key.encode(), "domain", domain, 0)
        new = [*(_reshaped(x, site) for x in labels[:-2]), _reshaped(labels[-2], site) if len(labels) > 1 else "", "example"]
        local = _reshaped(local, draw) + ("" if attempt < 4 else str(draw.below(10**9)))
        return f"{local}@{'.'.join(x for x in new if x)}"
    if kind == "ipv4":
        first = int(canon.split(".")[0])
        keep = canon.split(".")[:1] if first in (0, 10, 127) else canon.split(".")[:2] if canon.startswith(("192.168.", "169.254.")) else [str(1 + draw.below(223))]
        return ".".join([*keep, *(str(1 + draw.below(254)) for _ in range(4 - len(keep)))])
    if kind == "card":
        body = canon[0] + "".join(str(draw.below(10)) for _ in canon[1:-1])
        return next(body + str(d) for d in range(10) if _luhn(body + str(d)))
    if kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in canon[4:])
        rest = int("".join(str(int(c, 36)) for c in body + canon[:2] + "00")) % 97
        return f"{canon[:2]}{98 - rest:02d}{body}"
    if kind == "phone":
        plus = canon.startswith("+")
        keep = 2 if plus else 0  # the sign and the first digit of the country code
        return canon[:keep] + "".join(str(2 + draw.below(8) if k == 0 else draw.below(10)) for k, _ in enumerate(canon[keep:]))
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}-{1 + draw.below(99):02d}-{1 + draw.below(9999):04d}"
    if kind in ("mac", "ipv6"):
        return _reshaped(canon, draw, hexadecimal=True)
    if canon.startswith(("AKIA", "ASIA")):
        return canon[:4] + _reshaped(canon[4:], draw)
    return _reshaped(canon, draw, hexadecimal=bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", canon)))


def _as_printed(printed: str, kind: str, new: str) -> str:
    """``new`` in the spacing, punctuation and case of the entity as it was printed."""
    if kind in ("card", "iban", "phone"):
        chars = iter(new)
        return "".join(next(chars, "") if c.isalnum() or c == "+" else c for c in printed) + "".join(chars)
    if kind.startswith("name_"):
        return new.upper() if printed.isupper() and len(printed) > 1 else new.capitalize() if printed[0].isupper() else new
    if kind in ("email", "mac", "ipv6") and printed.isupper():
        return new.upper()
    return new


def rewrite(text: str | None, key: str, redrawn: dict[tuple[str, str], int]) -> tuple[str | None, int]:
    """``text`` with its entities replaced, and their number."""
    found = find(text)
    if not found:
        return text, 0
    out, at = [], 0
    for start, end, kind, canon in found:
        new = surrogate(key, kind, canon, redrawn.get((kind, canon), 0))
        out += [text[at:start], _as_printed(text[start:end], kind, new)]
        at = end
    return "".join([*out, text[at:]]), len(found)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct ``(kind, canon)`` of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {(k, c) for t in b.column(0) for _, _, k, c in find(t.as_py())}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string())], names=["kind", "canon"])

    return docs.select(text_col).mapInArrow(run, "kind string, canon string").distinct()


def redrawn_entities(found: DataFrame, key: str, draw=surrogate) -> DataFrame:
    """``(kind, canon, attempt)`` of the entities whose first surrogate is taken or real."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [draw(key, k, c, a) for k, c, a in zip(*(x.to_pylist() for x in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=["kind", "canon", "attempt", "new"])

    real = found.select("kind", F.col("canon").alias("new"))
    open_, settled = found.withColumn("attempt", F.lit(0)), None
    for _ in range(MAX_DRAWS):
        drawn = materialize(open_.mapInArrow(run, "kind string, canon string, attempt int, new string"), "pii-drawn")
        tried = drawn.withColumn("held", F.lit(1))
        if settled is not None:
            tried = tried.unionByName(settled.withColumn("held", F.lit(0)))
        # who drew first keeps a surrogate; of one round, the smallest entity
        owner = tried.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min(F.struct("held", "canon")).alias("owner")).filter("n > 1")
        lost = drawn.join(owner, ["kind", "new"], "left").join(real.withColumn("real", F.lit(True)), ["kind", "new"], "left")
        lost = lost.filter(F.col("real") | ((F.col("owner.held") == 0) | (F.col("owner.canon") != F.col("canon"))))
        lost = materialize(lost.select("kind", "canon", "attempt"), "pii-lost")
        won = drawn.join(lost, ["kind", "canon"], "left_anti")
        settled = won if settled is None else materialize(settled.unionByName(won), "pii-settled")
        if lost.isEmpty():
            return settled.filter("attempt > 0").select("kind", "canon", "attempt")
        open_ = lost.withColumn("attempt", F.col("attempt") + 1)
    raise RuntimeError(f"surrogates still collide after {MAX_DRAWS} draws")


def pseudonymized(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text", broadcast_rows: int = BROADCAST_REDRAWN) -> DataFrame:
    """``docs`` with surrogates in ``text_col``; adds ``n_entities``."""
    found = materialize(entities(docs, text_col), "pii-entities")
    redrawn = materialize(redrawn_entities(found, key), "pii-redrawn")
    kept = [c for c in docs.columns if c != "n_entities"]
    work = docs.select(*kept)
    schema = StructType(list(work.schema.fields)).add("n_entities", "long")
    if redrawn.count() <= broadcast_rows:
        shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["canon"]): r["attempt"] for r in redrawn.collect()})
        return work.mapInArrow(_rewriter(key, kept.index(text_col), shared=shared), schema)
    # too many to broadcast: each document gets those of its own entities
    h1, h2, own = (free_name(docs, x) for x in ("_h1", "_h2", "_redrawn"))
    hashes = {h1: F.xxhash64(text_col), h2: F.xxhash64(F.lit(1), F.col(text_col))}

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(x, y, k, c) for t, x, y in zip(*(v.to_pylist() for v in b.columns), strict=True) for k, c in {(k, c) for _, _, k, c in find(t)}]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["h1", "h2", "kind", "canon"])

    per_doc = docs.select(text_col, F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("h2"))
    per_doc = per_doc.mapInArrow(mentions, "h1 long, h2 long, kind string, canon string").distinct().join(redrawn, ["kind", "canon"])
    per_doc = per_doc.groupBy(F.col("h1").alias(h1), F.col("h2").alias(h2)).agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias(own))
    joined = work.withColumns(hashes).join(per_doc, [h1, h2], "left").select(*kept, own)
    return joined.mapInArrow(_rewriter(key, kept.index(text_col), own=True), schema)


def _rewriter(key: str, at: int, shared=None, own: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            lists = columns.pop().to_pylist() if own else [None] * b.num_rows
            texts, n = [], []
            for t, mine in zip(columns[at], lists, strict=True):
                redrawn = {(x["kind"], x["canon"]): x["attempt"] for x in mine or ()} if own else shared.value
                new, k = rewrite(t.as_py(), key, redrawn)
                texts.append(new)
                n.append(k)
            columns[at] = pa.array(texts, pa.string())
            names = b.schema.names[: len(columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=[*names, "n_entities"])

    return run


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"))
