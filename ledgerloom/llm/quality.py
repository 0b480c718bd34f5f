"""Quality rules: a learned decision list over text statistics.

Sequential covering learns the list from labelled documents: a rule (a conjunction of
threshold conditions) is grown on two thirds of them by FOIL gain, pruned on the rest,
accepted while it is precise there, and its rows are then set aside. The list becomes one
ordered ``CASE WHEN`` expression, which judges all documents in the scan, without a shuffle.

Defined results
---------------
* null and empty texts have no words, so that ``base_failed`` is true;
* a document without words has ratios of 0;
* labels that are null or belong to no document are ignored; a document labelled twice counts twice;
* without labels of both kinds the list is empty, and ``kept`` is ``not base_failed``;
* rows are judged one by one: repeated rows get equal verdicts, an empty table gives an empty result;
* input columns named like a result column are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, let, materialize, table, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: The list is fitted on about so many labelled documents at most, chosen by a hash of the id.
FIT_ROWS = 20_000
THRESHOLDS = 48
MAX_RULES = 8
MAX_CONDITIONS = 3
#: A rule is accepted if so many of the labelled rows it covers, in growing and pruning, are bad.
MIN_PRECISION = 0.9
MIN_COVER = 5

FEATURES = ("n_words", "word_len", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "shout_rate", "digit_rate", "line_words")


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` (or ``<=``)."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the array ``w``.

    Windows are first compared by the leading bits of a hash, packed with their position
    into one long and sorted; those that meet another are then compared as text.
    """
    n = F.size(w)
    shift = F.greatest(F.lit(20), F.ceil(F.log2(n.cast("double"))).cast("int"))

    def gram(i: Column) -> Column:
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def pack(i: Column, s: Column) -> Column:
        return F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), s).bitwiseOR(i.cast("long"))

    def meets(items: Column, same) -> Column:
        return F.filter(items, lambda x, i: F.coalesce(same(x, F.get(items, i + 1)), F.lit(False)) | F.coalesce((i > 0) & same(x, F.get(items, F.greatest(i - 1, F.lit(0)))), F.lit(False)))

    def covered(p: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(p) - 1)
        return F.aggregate(steps, F.lit(0), lambda acc, k: acc + F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - F.get(p, k)), F.lit(3)))

    def exact(p: Column) -> Column:
        grams = F.sort_array(F.transform(p, lambda i: F.struct(gram(i).alias("g"), i.alias("i"))))
        return let(grams, lambda e: let(F.sort_array(F.transform(meets(e, lambda a, b: a["g"] == b["g"]), lambda x: x["i"])), lambda q: F.when(F.size(q) > 0, covered(q)).otherwise(0)))

    def with_shift(s: Column) -> Column:
        packed = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: pack(i, s)))

        def candidates(a: Column) -> Column:
            high = lambda x: F.call_function("shiftright", x, s)
            low = F.call_function("shiftleft", F.lit(1).cast("long"), s) - F.lit(1)
            return F.transform(meets(a, lambda x, y: high(x) == high(y)), lambda x: x.bitwiseAND(low).cast("int"))

        return let(packed, lambda a: let(candidates(a), lambda p: F.when(F.size(p) > 0, exact(p)).otherwise(0)))

    return F.when(n >= 3, let(shift, with_shift)).otherwise(0)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts and the ratios that the rules use."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    s = free_name(docs, "_stats")
    counts = let(
        words(F.col(text_col)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    out = docs.withColumn(s, counts)
    base = {
        "n_words": F.col(s)["n_words"],
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": _dup_lines(text).cast("long"),
        "n_repeat_words": F.col(s)["n_repeat_words"],
    }
    patterns = {"lines": "\n", "upper": r"\p{Lu}", "shout": "!", "digit": "[0-9]"}
    c = {k: free_name(docs, f"_n_{k}") for k in patterns}
    out = out.withColumns(base | {c[k]: F.regexp_count(text, F.lit(p)) for k, p in patterns.items()}).drop(s)
    n_lines = F.col(c["lines"]) + 1
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return out.withColumns(
        {
            "word_len": F.col("word_chars") / n,
            "symbol_rate": F.col("n_symbols") / n,
            "dup_line_rate": F.col("n_dup_lines") / n_lines,
            "repeat_rate": F.col("n_repeat_words") / n,
            "upper_rate": F.col(c["upper"]) / chars,
            "shout_rate": F.col(c["shout"]) / n,
            "digit_rate": F.col(c["digit"]) / chars,
            "line_words": F.col("n_words") / n_lines,
        }
    ).drop(*c.values())


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """FOIL gain of going from (p0, n0) covered bad and good rows to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _candidates(rows: DataFrame, cuts: dict[str, list[float]]) -> list[tuple[Condition, int, int]]:
    """Each condition over ``rows`` with the bad and good rows that it covers: one aggregate by (feature, bin)."""
    def bin_of(f: str) -> Column:
        values = F.array(*(F.lit(float(t)) for t in cuts[f]))
        return F.struct(F.lit(f).alias("f"), F.size(F.filter(values, lambda t: t < F.col(f))).alias("b"))

    bins = rows.select("bad", F.explode(F.array(*(bin_of(f) for f in FEATURES))).alias("x"))
    counted: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in FEATURES}
    for r in bins.groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect():  # at most features x thresholds rows
        counted[r["f"]][r["b"]] = (r["p"], r["n"])
    out = []
    for f in FEATURES:
        all_p, all_n = (sum(v[i] for v in counted[f].values()) for i in (0, 1))
        p = n = 0
        for b, t in enumerate(cuts[f]):  # rows in bins 0..b have feature <= t
            p, n = p + counted[f].get(b, (0, 0))[0], n + counted[f].get(b, (0, 0))[1]
            out += [(Condition(f, False, t), p, n), (Condition(f, True, t), all_p - p, all_n - n)]
    return out


def learn(rows: DataFrame) -> list[list[Condition]]:
    """Sequential covering over those ``rows`` (the features, ``bad`` 0/1, ``prune`` and ``failed`` boolean) that the base rules let pass."""
    # written before it is filtered: the filter would be worked out below the join, for every document
    rows = materialize(rows.select("bad", "prune", "failed", *(F.col(f).cast("double").alias(f) for f in FEATURES)), "quality-fit").filter("not failed")
    grid = [k / THRESHOLDS for k in range(THRESHOLDS + 1)]
    quantiles = rows.groupBy("bad").agg(*(F.percentile_approx(f, grid, 2000).alias(f) for f in FEATURES)).collect()
    cuts = {f: sorted({t for r in quantiles for t in r[f] or []}) for f in FEATURES}
    rules: list[list[Condition]] = []
    left = rows
    for _ in range(MAX_RULES):
        rule: list[Condition] = []
        now = left.filter(~F.col("prune"))
        while len(rule) < MAX_CONDITIONS:
            tried = _candidates(now, cuts)
            p0, n0 = (max((a[i] + b[i] for a, b in zip(tried[::2], tried[1::2], strict=True)), default=0) for i in (1, 2))
            if not p0 or not n0:
                break
            best = max(tried, key=lambda c: (_gain(c[1], c[2], p0, n0), c[1], str(c[0])))
            if _gain(best[1], best[2], p0, n0) <= 0 or best[1] < MIN_COVER:
                break
            rule.append(best[0])
            now = now.filter(best[0].column())
            if not best[2]:
                break
        if not rule:
            break
        prefixes = [_all(rule[: k + 1]) for k in range(len(rule))]
        sums = [F.sum(F.when(q & w, F.col("bad" if bad else "good"))) for q in prefixes for w in (F.col("prune"), F.lit(True)) for bad in (True, False)]
        row = [v or 0 for v in left.withColumn("good", 1 - F.col("bad")).agg(*(x.alias(f"s{i}") for i, x in enumerate(sums))).first()]
        scored = [(row[4 * k], row[4 * k + 1], row[4 * k + 2], row[4 * k + 3]) for k in range(len(rule))]
        # the prefix that does best on the rows held back; the shorter one if two do equally
        best_k = max(range(len(rule)), key=lambda k: ((scored[k][0] - scored[k][1]) / max(1, scored[k][0] + scored[k][1]), -k))
        rule, (_, _, p, n) = rule[: best_k + 1], scored[best_k]
        if p < MIN_COVER or p / (p + n) < MIN_PRECISION:
            break
        rules.append(rule)
        left = left.filter(~_all(rule))
    return rules


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> list[list[Condition]]:
    """Learn the list from about ``fit_rows`` labelled documents at most."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    n = known.count()
    if n > fit_rows:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))
    labelled = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id")
    labelled = statistics(labelled).withColumn("failed", base_failed())
    return learn(labelled.withColumn("prune", F.pmod(F.xxhash64("_id", F.lit("prune")), F.lit(3)) == 0))


def verdict(rules: list[list[Condition]]) -> Column:
    """The ordered conditional expression: false for the first base or learned rule that holds, else true."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(_all(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the statistics, ``base_failed`` and ``kept``."""
    rules = fit(docs, labels, text_col, id_col)
    return statistics(docs, text_col).withColumns({"base_failed": base_failed(), "kept": verdict(rules)})


def quality_filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the base rules and the learned list keep."""
    # whole rows are carried in one column, so that their own columns may have any names
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return judged(rows, labels).filter("kept").select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judged(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
