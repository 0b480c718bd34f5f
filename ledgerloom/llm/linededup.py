"""Line dedup over suffixes of line sequences, by distributed prefix doubling.

A document is the sequence of its non-blank lines, a suffix of it starts at one of them. Prefix doubling
names the suffixes' prefixes: a name for 2k lines is made of the suffix's own name for k lines and the
name of the suffix k lines on. Suffixes of equal name share a prefix of that many lines; in the suffix
array they are neighbours, one interval of the longest-common-prefix table. A suffix alone with its name
is settled and leaves; doubling goes on until all are.

The first suffix of an interval, by (document, line), is the copy that stays. Every other one keeps its
deepest interval that has an earlier member, and that first member as its partner. The longest common
prefix of the two is then found from the names, longest first: where both go on with the same name, both
positions move on by its lines. A suffix whose predecessor in the document is paired with the partner's
predecessor continues that run, so that only the others, the heads, need to be looked at: with their
longest common prefixes they are the maximal repeated runs. Those of ``min_lines`` lines or more are
deleted, and shorter ones that hold more than ``long_words`` words.

Defined results
---------------
* lines are split at ``\\n`` and compared whole; blank ones (white space only) are not part of
  runs, stay in the text, and do not break a run;
* null or empty text has no lines and stays as it is;
* the first copy by (document id, line number) stays, also within one document; a null id comes last;
* rows with equal ids are ordered by a hash of their text; rows equal in id and text are one document;
* an empty table gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, free_name, let, materialize, table, words

#: Runs of fewer lines are left alone, unless they are long.
MIN_LINES = 3
#: Runs of more words go, however few lines they have.
LONG_WORDS = 50

#: A line that is part of runs: with a character that is not white space.
SOLID = r"[^\x20\x09-\x0D]"


def _names(*cols: Column) -> list[Column]:
    """A 128-bit name from two hashes of the same input."""
    return [F.xxhash64(*cols).alias("p"), F.xxhash64(F.lit("second"), *cols).alias("q")]


def _row_keys(doc_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(doc_id, text), F.xxhash64(F.lit("row"), doc_id, text)]


def _shared(suffixes: DataFrame) -> DataFrame:
    """The suffixes whose name (p, q) another one has too."""
    several = suffixes.groupBy("p", "q").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    # as a table of its own, so that the join can split the rows of a name that very many lines have
    several = materialize(several, "line-several")
    return suffixes.join(several, ["p", "q"], "left_semi")


def _doubled(suffixes: DataFrame, have: int, want: int) -> DataFrame:
    """Names for ``want`` lines (``have < want <= 2 * have``) from names for ``have`` lines."""
    on = want - have
    # the suffix that starts so many lines on in the same document; a settled one has no name
    later = F.first(F.struct("p", "q")).over(Window.partitionBy("r1", "r2").orderBy("k").rangeBetween(on, on))
    paired = suffixes.withColumn("later", later).filter("later is not null")
    return paired.select("r1", "r2", "doc", "k", *_names(F.col("p"), F.col("q"), F.col("later.p"), F.col("later.q")))


def _paired(suffixes: DataFrame, size: int) -> DataFrame:
    """``(r1, r2, k, size, partner)``: the suffixes whose first ``size`` lines have an earlier copy, and the first one."""
    place = F.struct(F.col("doc").isNull().alias("last"), F.col("doc").alias("doc"), F.col("r1").alias("r1"), F.col("r2").alias("r2"), F.col("k").alias("k"))
    first = materialize(suffixes.groupBy("p", "q").agg(F.min(place).alias("partner")), "line-first")
    paired = suffixes.join(first, ["p", "q"]).filter(place > F.col("partner"))
    return paired.select("r1", "r2", "k", F.lit(size).alias("size"), F.struct("partner.r1", "partner.r2", "partner.k").alias("partner"))


def _heads(pairs: list[DataFrame]) -> DataFrame:
    """Of each suffix the deepest pair, where it does not continue the run of the suffix before it."""
    every = reduce(DataFrame.union, pairs)
    deepest = every.groupBy("r1", "r2", "k").agg(F.max(F.struct("size", "partner")).alias("s")).select("r1", "r2", "k", "s.size", "s.partner")
    before = F.lag(F.struct("k", "size", "partner")).over(Window.partitionBy("r1", "r2").orderBy("k"))
    step = lambda a, b: (a["r1"] == b["r1"]) & (a["r2"] == b["r2"]) & (a["k"] + 1 == b["k"])
    goes_on = (F.col("before.k") + 1 == F.col("k")) & (F.col("before.size") >= F.col("size")) & step(F.col("before.partner"), F.col("partner"))
    return deepest.withColumn("before", before).filter(~F.coalesce(goes_on, F.lit(False))).drop("before")


def _lengthened(heads: DataFrame, names: list[tuple[int, DataFrame]]) -> DataFrame:
    """``(r1, r2, k, n)``: the longest common prefix, in lines, of each head and its partner.

    ``names`` holds the names for each number of lines. A common prefix of less than twice its first
    ``size`` lines is left; each shorter name is tried once.
    """
    out = heads.withColumn("n", F.col("size"))
    for size, named in reversed(names):
        at = lambda who, k, named=named: named.select(F.col("r1").alias(f"{who}1"), F.col("r2").alias(f"{who}2"), F.col("k").alias(k), F.struct("p", "q").alias(f"{who}n"))
        deeper, done = out.filter(F.col("size") > size), out.filter(F.col("size") <= size)
        here = deeper.withColumns({"x": F.col("k") + F.col("n"), "y": F.col("partner.k") + F.col("n")})
        mine = here.join(at("a", "x0"), (F.col("r1") == F.col("a1")) & (F.col("r2") == F.col("a2")) & (F.col("x") == F.col("x0")), "left")
        both = mine.join(at("b", "y0"), (F.col("partner.r1") == F.col("b1")) & (F.col("partner.r2") == F.col("b2")) & (F.col("y") == F.col("y0")), "left")
        longer = F.coalesce((F.col("an.p") == F.col("bn.p")) & (F.col("an.q") == F.col("bn.q")), F.lit(False))
        grown = both.select("r1", "r2", "k", "size", "partner", F.when(longer, F.col("n") + size).otherwise(F.col("n")).alias("n"))
        out = materialize(grown.unionByName(done), "line-lengths")
    return out.select("r1", "r2", "k", "n")


def _long(runs: DataFrame, sizes: DataFrame, long_words: int) -> DataFrame:
    """Those of ``runs``, of few lines each, whose lines hold more than ``long_words`` words."""
    of_run = runs.withColumn("i", F.explode(F.sequence(F.col("k"), F.col("k") + F.col("n") - 1)))
    of_run = of_run.join(sizes, (F.col("r1") == F.col("s1")) & (F.col("r2") == F.col("s2")) & (F.col("i") == F.col("s_k")))
    return of_run.groupBy("r1", "r2", "k", "n").agg(F.sum("words").alias("w")).filter(F.col("w") > long_words).drop("w")


def maximal_runs(docs: DataFrame, min_lines: int = MIN_LINES, text_col: str = "text", id_col: str = "doc_id", long_words: int | None = LONG_WORDS) -> DataFrame:
    """``(r1, r2, k, n)``: the ``n`` lines from ``k`` on repeat an earlier copy and go on no longer."""
    if min_lines < 1:
        raise ValueError("min_lines must be positive")
    r1, r2 = _row_keys(F.col(id_col), F.col(text_col))
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: x.rlike(SOLID))
    rows = docs.select(r1.alias("r1"), r2.alias("r2"), F.col(id_col).alias("doc"), F.posexplode(lines).alias("k", "line"))
    short = min_lines > 1 and long_words is not None
    n = [F.size(words(F.col("line"))).alias("words")] if short else []
    named = materialize(rows.select("r1", "r2", "doc", "k", *_names(F.col("line")), *n), "line-names")
    shared = materialize(_shared(named), "line-suffixes")
    drop(named)
    suffixes, names, pairs, have = shared.drop("words"), [], [], 1
    while True:
        names.append((have, suffixes))
        pairs.append(materialize(_paired(suffixes, have), "line-pairs"))
        # one by one up to min_lines, where the number decides; doubling from there on
        want = have + 1 if have < min_lines else 2 * have
        suffixes = materialize(_shared(_doubled(suffixes, have, want)), "line-suffixes")
        have = want
        if suffixes.isEmpty():
            break
    runs = _lengthened(materialize(_heads(pairs), "line-heads"), names)
    enough = runs.filter(F.col("n") >= min_lines)
    if short:
        # once for each line, though rows may be equal in id and text
        sizes = shared.select(F.col("r1").alias("s1"), F.col("r2").alias("s2"), F.col("k").alias("s_k"), "words").distinct()
        enough = enough.union(_long(runs.filter(F.col("n") < min_lines), sizes, long_words))
    return enough


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, text_col: str = "text", id_col: str = "doc_id", long_words: int | None = LONG_WORDS) -> DataFrame:
    """``(r1, r2, runs)`` for documents with something to delete; ``runs``: sorted (start, end) over their non-blank lines.

    A run of fewer than ``min_lines`` lines counts if it holds more than ``long_words`` words (None: never).
    """
    found = maximal_runs(docs, min_lines, text_col, id_col, long_words).withColumn("e", F.col("k") + F.col("n"))
    of_doc = Window.partitionBy("r1", "r2").orderBy("k", "e")
    before = of_doc.rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.col("k") > F.max("e").over(before), F.lit(True)).cast("int")
    numbered = found.withColumn("begins", begins).withColumn("run", F.sum("begins").over(of_doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("r1", "r2", "run").agg(F.min("k").alias("start"), F.max("e").alias("end"))
    return runs.groupBy("r1", "r2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def line_deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, text_col: str = "text", id_col: str = "doc_id", long_words: int | None = LONG_WORDS) -> DataFrame:
    """``docs`` without later copies of runs; adds ``n_lines`` (non-blank, before), ``n_removed`` and ``n_runs``."""
    r1, r2, runs = (free_name(docs, x) for x in ("_r1", "_r2", "_runs"))
    found = repeated_runs(docs, min_lines, text_col, id_col, long_words).select(F.col("r1").alias(r1), F.col("r2").alias(r2), F.col("runs").alias(runs))
    k1, k2 = _row_keys(F.col(id_col), F.col(text_col))
    out = docs.withColumns({r1: k1, r2: k2}).join(found, [r1, r2], "left")
    numbered = F.transform(F.split(F.col(text_col), "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    solid = lambda a: F.filter(a, lambda s: s["x"].rlike(SOLID))
    blank = lambda a: F.filter(a, lambda s: ~s["x"].rlike(SOLID))
    inside = lambda k: F.exists(runs, lambda r: (k >= r["start"]) & (k < r["end"]))
    kept = lambda a: F.sort_array(F.concat(blank(a), let(solid(a), lambda s: F.filter(s, lambda x, k: ~inside(k)))))
    shorter = F.array_join(F.transform(let(numbered, kept), lambda s: s["x"]), "\n")
    n_lines = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: x.rlike(SOLID)))
    removed = F.aggregate(F.col(runs), F.lit(0), lambda acc, r: acc + r["end"] - r["start"])
    named = {
        "n_lines": n_lines.cast("long"),
        "n_removed": F.coalesce(removed, F.lit(0)).cast("long"),
        "n_runs": F.when(F.col(runs).isNull(), F.lit(0)).otherwise(F.size(runs)).cast("long"),
        text_col: F.when(F.col(runs).isNull(), F.col(text_col)).otherwise(shorter),
    }
    return out.withColumns(named).drop(r1, r2, runs)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: A window of one to MIN_LINES lines goes where an earlier one equals it and it is long enough, in lines or in words.
_WINDOWS = "\n  UNION ALL ".join(
    f"SELECT doc_id, k, {n} AS n, nth FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY {', '.join(f'a{i}' for i in range(n))} ORDER BY doc_id, k) AS nth, {' + '.join(f'w{i}' for i in range(n))} AS words FROM grams WHERE a{n - 1} IS NOT NULL) WHERE nth > 1"
    + (f" AND words > {LONG_WORDS}" if n < MIN_LINES else "")
    for n in range(1, MIN_LINES + 1)
)
_LEADS = ", ".join(f"lead(line, {i}) OVER w AS a{i}, lead(words, {i}) OVER w AS w{i}" for i in range(MIN_LINES))
OP1_SQL = rf"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
solid AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
grams AS (SELECT doc_id, k, {_LEADS} FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
starts AS ({_WINDOWS}),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS k FROM starts),
runs AS (SELECT doc_id, count(*) AS n FROM gone g WHERE NOT EXISTS (SELECT 1 FROM gone b WHERE b.doc_id = g.doc_id AND b.k = g.k - 1) GROUP BY 1),
kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.i) AS text
  FROM raw r LEFT JOIN solid s USING (doc_id, i) LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.k = s.k
  WHERE g.k IS NULL GROUP BY r.doc_id)
SELECT d.doc_id, (SELECT count(*) FROM solid s WHERE s.doc_id = d.doc_id) AS n_lines,
       (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed,
       coalesce(runs.n, 0) AS n_runs,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)
"""
