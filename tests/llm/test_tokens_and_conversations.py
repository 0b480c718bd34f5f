"""Tokenizer operators against the vocabularies' own libraries, conversation repair against all sequences of edits."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import alignment, bpe, conversations

LETTERS = ["a", "b", "the", " ", "  ", "   ", "\n", "\r\n", "é", "😀", "ß", "1", "23", "-", "--", "=", "'s", "'ll", "'", "\t", "\x1c", "\x00", "՘", "Ⅷ", "　", "中国", "한글", "ﷺ", "\U000323b0", "er", "in", "ing", "\x85", "\xa0", "aaaaaaaa", "."]
SPECIAL = ["<|endoftext|>", "<|endoftext", "<s>", "<0x41>", "▁"]


def strange(n, seed, letters):
    rng = random.Random(seed)
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(1, 40))) for _ in range(n // 4)]
    return out + [None, "", " ", "  ", "a ", "\n", "word\n", " \n word", "a" * 5000, "ab" * 3000, "ÃÂ" * 500, "-" * 700, " " * 999, "the cat " * 3000]


def docs(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)


# ------------------------------------------------------------------ 13 byte-level BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.installed(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def data():
    return bpe.read_small(bpe.installed(bpe.VOCABULARY))


def test_encoder_is_the_library(library, data):
    encode = bpe.encoder(data)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeinrstuoh") for _ in range(rng.randrange(1, 60))) for _ in range(1000)]
    for t in strange(2000, 1, LETTERS + SPECIAL) + words:
        assert np.frombuffer(b"".join(encode(t or "")), np.uint32).tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_decoder_is_the_library(library, data):
    decode = bpe.decoder(data)
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randrange(40))]
        assert decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)
    assert decode(np.array([-1, 50_257, 1 << 31], np.int64)) == ""


def test_bpe_on_tables(spark, library):
    texts = strange(60, 2, LETTERS + SPECIAL)
    df = docs(spark, texts).withColumn("IDS", F.lit("mine")).withColumn("_source", F.lit(None))
    rows = {r["doc_id"]: r for r in bpe.decoded(bpe.encoded(df)).collect()}
    sums = {r["doc_id"]: r for r in bpe.round_trip(df).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert rows[k]["decoded"] == text and rows[k]["ids"] == ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (sums[k]["n_tokens"], sums[k]["ids_sha256"], sums[k]["decoded_sha256"]) == want
    assert bpe.round_trip(df.limit(0)).count() == 0
    assert [r["decoded"] for r in bpe.decoded(spark.createDataFrame([([64, None, -5, 99_999],), (None,)], "ids array<int>")).collect()] == ["a", ""]


def test_other_vocabularies_are_refused(data):
    with pytest.raises(ValueError):
        bpe.vocabulary(data.replace(b'"add_prefix_space":false', b'"add_prefix_space":true', 1).replace(b'"add_prefix_space": false', b'"add_prefix_space": true', 1))
    with pytest.raises(ValueError):
        bpe.read_small(bpe.installed(bpe.VOCABULARY), 1000)


# ------------------------------------------------------------------ 11 alignment


@pytest.fixture(scope="module")
def brute(library):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(bpe.installed(bpe.VOCABULARY))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=bpe.installed(alignment.PIECE_MODEL))
    letter = {v: k for k, v in bpe._byte_of().items()}
    back = {v: ord(k) for k, v in letter.items()}

    def a_bytes(i):
        return bytes(back[c] for c in a.id_to_token(i))

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def align(t):
        if not t:
            return 0, 0, 0, "", {}
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t, return_type=int)
        xb, yb = [a_bytes(i) for i in x], [b_bytes(i) for i in y]
        if not b"".join(xb) == b"".join(yb) == (" " + t).encode():
            return 0, 0, 0, "", {}
        xe, ye = (list(itertools.accumulate(map(len, v))) for v in (xb, yb))
        groups, links, low = [], collections.Counter(), 0
        for cut in sorted(set(xe) & set(ye)):
            p, q = ([i for i, e in zip(ids, ends, strict=True) if low < e <= cut] for ids, ends in ((x, xe), (y, ye)))
            low = cut
            groups.append(",".join(map(str, p)) + "|" + ",".join(map(str, q)))
            links.update(itertools.product(p, q))
        return len(x), len(y), len(groups), ";".join(groups), dict(links)

    return align


SHORT = [t for t in strange(400, 5, LETTERS + SPECIAL) if len(t or "") < 8000]


def test_aligner(brute):
    align = alignment.aligner(*(bpe.read_small(bpe.installed(p)) for p in (bpe.VOCABULARY, alignment.PIECE_MODEL)))
    for t, got in zip(SHORT, align(SHORT), strict=True):
        want = brute(t)
        assert got[:4] == want[:4], t
        assert dict(zip(got[4].tolist(), got[5].tolist(), strict=True)) == {a << 32 | b: n for (a, b), n in want[4].items()}


@pytest.mark.parametrize("hot", [0, 20, 1_000_000])
def test_alignment_counts(spark, brute, hot):
    texts = [t for t in SHORT if len(t or "") < 200][:150] + ["the cat", "the cat"]
    df = docs(spark, texts).withColumn("n_a", F.lit("mine"))
    got = {r["doc_id"]: r for r in alignment.alignment_summary(df, hot_pairs=hot).collect()}
    want = [brute(t) for t in texts]
    held = collections.Counter(p for w in want for p in w[4])
    best = {}
    for (a, _), n in held.items():
        best[a] = max(n, best.get(a, 0))
    assert len(got) == len(texts)
    for k, (na, nb, ng, listing, links) in enumerate(want):
        row = got[k]
        digest = hashlib.sha256(listing.encode()).hexdigest() if ng else ""
        n_best = sum(n for p, n in links.items() if held[p] == best[p[0]])
        total = sum(n * held[p] for p, n in links.items())
        assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["n_best"], row["count_sum"], row["groups_sha256"]) == (na, nb, ng, sum(links.values()), n_best, total, digest)


def test_large_groups_are_counted_by_distinct_ids():
    pairs, often = alignment.product_counts(np.array([5, 5, 7]), np.array([1, 1, 1, 2]))
    assert dict(zip(pairs.tolist(), often.tolist(), strict=True)) == {5 << 32 | 1: 6, 5 << 32 | 2: 2, 7 << 32 | 1: 3, 7 << 32 | 2: 1}


def test_alignment_of_an_empty_table(spark):
    assert alignment.alignment_summary(docs(spark, ["x"]).limit(0)).count() == 0


# ------------------------------------------------------------------ 12 conversations

LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.strip(conversations.SPACES)
        if not solid:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Over all places of insertions and edits of rows: (cost, audit, repaired rows), by dynamic programming over prefixes of roles."""
    best = {"": (0, "", [])}  # by state: what may follow depends on the last roles only

    def state(roles):
        return roles[-1:] if roles != "s" else "s"

    def better(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def step(roles, r):
        return {"": "su", "s": "u", "u": "a", "a": "u"}[roles].find(r) >= 0

    def close(table):
        for _ in range(4):
            for s, (c, a, out) in list(table.items()):
                for r in "ua":
                    if step(s, r):
                        better(table, r, (c + 2, a + "I", [*out, ({"u": "user", "a": "assistant"}[r], "")]))
        return table

    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        close(best)
        new = {}
        for s, (c, a, out) in best.items():
            better(new, s, (c + 3, a + "D", out))
            if fault in (None, "truncated"):
                more = fault == "truncated"
                if role[:1] in ("s", "u", "a") and step(s, role[0]):
                    better(new, role[0], (c + more, a + "K", [*out, (role, text)]))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if step(s, r):
                        better(new, r, (c + 2 + more, a + "R", [*out, (name, text)]))
        best = new
    close(best)
    return min(best[s] for s in ("", "a") if s in best)


def exhaustive(rows):
    """All sequences with up to two insertions at each place, for a few rows."""
    found, best = faults(rows), None
    per_row = [[("D", 3, None)] + ([] if f in ("blank", "duplicate") else [("K", f == "truncated", r[1][:1])] * (r[1][:1] in tuple("sua")) + [("R", 2 + (f == "truncated"), x) for x in "ua"]) for r, f in zip(rows, found, strict=True)]
    gaps = [""] + ["u", "a", "ua", "au"]
    for edits in itertools.product(*per_row):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            roles, audit, cost = inserted[0], "I" * len(inserted[0]), 2 * len(inserted[0])
            for (letter, c, r), more in zip(edits, inserted[1:], strict=True):
                roles, audit, cost = roles + (r or "") + more, audit + letter + "I" * len(more), cost + c + 2 * len(more)
            if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def made_up(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        conv = None if c == 3 else c
        for k in range(rng.randrange(1, longest)):
            turn = None if rng.random() < 0.05 else k * rng.choice([1, 1, 1, 2])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire", "User"])
            text = rng.choice(["Hi.", "Yes!", "no end", " \t", "", None, "ok?", "so. \n", "I see.", "well then.", f"text {rng.random()}.", "a.b"])
            out.append((conv, turn, role, text))
    return out


def in_order(rows):
    plain = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows]
    return sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def by_conversation(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return {k: in_order(v) for k, v in out.items()}


def summary(rows):
    kinds = collections.Counter(faults(rows))
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    cost, audit, repaired = cheapest(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials))
    return (gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit), repaired


CONV = "conv_id long, turn long, role string, text string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def test_cheapest_edits_are_the_best_of_all():
    rng = random.Random(8)
    for _ in range(60):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "a."])) for k in range(rng.randrange(1, 4))]
        assert cheapest(rows)[:2] == exhaustive(rows), rows


def test_spans_are_the_full_chart():
    rng = random.Random(9)
    for _ in range(20):
        cells = [conversations.row_cell(rng.choice(["s", "u", "a", ""]), rng.randrange(3)) for _ in range(rng.randrange(1, 10))]
        chart = {(k, k + 1): c for k, c in enumerate(cells)}
        for n in range(2, len(cells) + 1):
            for k in range(len(cells) - n + 1):
                found = [conversations.combine(chart[k, m], chart[m, k + n]) for m in range(k + 1, k + n)]
                assert all(f == found[0] for f in found)
                chart[k, k + n] = found[0]
        assert conversations.span(cells) == chart[0, len(cells)]
        assert conversations.repeated(cells[0], 7) == conversations.span([cells[0]] * 7)


@pytest.mark.parametrize("partitions", [1, 7])
def test_conversations(spark, partitions):
    rows = made_up(1, 80, 14) + made_up(2, 1, 300)
    rows += [(900, 1, "user", "again.")] * 40 + [(901, k, "user", "same.") for k in range(30)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, CONV).withColumn("cost", F.lit("mine")).repartition(3)
        audits = conversations.parsed(df)
        got = {r["conv_id"]: tuple(r[c] for c in COUNTS) for r in audits.collect()}
        fixed = collections.defaultdict(list)
        for r in conversations.repaired(df).orderBy("place").collect():
            fixed[r["conv_id"]].append((r["role"], r["text"]))
        digests = {r["conv_id"]: r["repaired_sha256"] for r in conversations.repair_digests(df, audits).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {k: summary(v) for k, v in by_conversation(rows).items()}
    assert got.keys() == want.keys()
    for k, (counts, repaired) in want.items():
        assert got[k] == counts, k
        assert fixed.get(k, []) == repaired
        assert digests.get(k) == (hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest() if repaired else None)
        assert LEGAL.fullmatch("".join(r[0] for r, _ in repaired))


def test_op12(spark, tmp_path):
    rows = made_up(5, 120, 10)
    spark.createDataFrame(rows, CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[c] for c in (*COUNTS, "repaired_sha256")) for r in conversations.op12_conversations(spark, str(tmp_path)).collect()}
    dealt = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k:
            row = (c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)
            dealt += [row] * (2 if k == 3 else 1)
    left = by_conversation(dealt)
    assert got.keys() == {r[0] for r in rows}
    for k, row in got.items():
        counts, repaired = summary(left[k]) if k in left else ((0, 0, 0, 0, 0, 0, ""), [])
        assert row == (*counts, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())


def test_no_conversations(spark):
    empty = spark.createDataFrame([], CONV)
    assert conversations.parsed(empty).count() == 0 and conversations.repaired(empty).count() == 0


def test_an_earlier_jobs_aligner_goes_before_the_next_is_made():
    """A worker that is given new models (another broadcast) must not hold two aligners with their words."""
    import gc
    import weakref

    models = [alignment.read_small(alignment.installed(p)) for p in (alignment.VOCABULARY, alignment.PIECE_MODEL)]
    gc.disable()
    try:
        kept = {"models": models}
        first = weakref.ref(alignment.ready(kept))
        assert alignment.ready(kept) is first()  # from task to task
        first()(["some words", "some more"])
        del kept
        again = alignment.ready({"models": models})
        assert first() is None
        assert again(["some words"])[0][:3] == alignment.aligner(*models)(["some words"])[0][:3]
    finally:
        gc.enable()


def test_ascii_words_are_aligned_by_ids_alone(monkeypatch, brute):
    """op11: every new word had its spans built as objects by both libraries, where those of ASCII follow from the tokens' bytes."""
    import sentencepiece

    asked, encode = [], sentencepiece.SentencePieceProcessor.encode
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "encode", lambda self, text, **how: asked.append((text, how)) or encode(self, text, **how))
    align = alignment.aligner(*(alignment.read_small(alignment.installed(p)) for p in (alignment.VOCABULARY, alignment.PIECE_MODEL)))
    texts = ["plain words, and \x01 signs <0x41>", "na\xefve words \U0001f600 \x00", "plain na\xefve"]
    for t, got in zip(texts, align(texts), strict=True):
        n_a, n_b, n_groups, groups, links = brute(t)
        assert got[:4] == (n_a, n_b, n_groups, groups)
        assert dict(zip([(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in got[4]], got[5].tolist(), strict=True)) == links
    spans = [text for text, how in asked if how.get("return_type") == "proto"]
    assert spans and all(not w.isascii() for text in spans for w in text.split(" ")[1:]) and len(asked) > len(spans)
