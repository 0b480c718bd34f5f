"""The pipeline on a small corpus against its stages' brute-force versions."""

import collections
import re

import pytest

from ledgerloom.llm import mixing
from test_corpus_operators import awkward, brute_components, brute_fingerprint, brute_stats, lower

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_contaminated(text, items):
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    ws, hit = w(text), set()
    for t in items:
        x = w(t)
        for k in range(max(1, len(x) - 12)) if x else ():
            g = x[k : k + 13]
            for p in range(len(ws) - len(g) + 1):
                if ws[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
    return bool(hit) and 20 * len(hit) >= len(ws)


@pytest.mark.parametrize("extra", [False, True])
def test_run(spark, tmp_path, extra):
    """Exactly the rows that the stages' brute-force versions leave, as often as the mix of those takes them; with repeated rows and more columns, too."""
    rows = awkward(7)
    rows += [(1000 + i, t, lang, s, n) for i, t, lang, s, n in rows[12:20]]
    schema = SCHEMA
    if extra:
        rows = [(*r, f"x{r[0]}", 7) for r in rows]
        rows += rows[14:16]
        schema += ", n_words string, kept int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = [r for r in rows if (s := brute_stats(r[1]))[0] >= 50 and 2 * s[4] <= s[0]]
    stolen = [" ".join(good[2][1].split()[:15]), None, "never seen anywhere"]
    spark.createDataFrame(list(enumerate(stolen)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = sorted({r[:2]: r for r in good}.values())
    comp = brute_components([brute_fingerprint(r[1]) for r in good], lambda a, b: bin(a ^ b).count("1") <= 4)
    single = [r for k, r in enumerate(good) if comp[k] == k]
    clean = [r for r in single if not brute_contaminated(r[1], stolen)]
    assert len(good) > len(single) > len(clean) > 10
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(clean, schema)).collect() if r["copies"]}
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(want)
    of = {r[0]: r for r in rows}
    names = [x.split()[0] for x in schema.split(", ")]
    assert all(tuple(r[c] for c in names) == of[r["doc_id"]] for r in got)
    assert {(r["shard_id"], r["shard_depth"], r["oversized"]) for r in got} == {("", 0, False)}
    assert {r["shard_bytes"] for r in got} == {sum(r["n_bytes"] for r in got)} and {r["shard_docs"] for r in got} == {len(got)}


def test_stages_return_documents(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "decontamination", "mixing", "sharding"]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
