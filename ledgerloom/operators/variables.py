"""Selection of inputs and the eleven risk variables, for all companies at once.

Every result has ``company, code, value, reason``: a value or, if there is none, why.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR_DAYS = 365.2425
WINDOW_DAYS = 90


# ------------------------------------------------------------------ selection

def latest_observation(rows: DataFrame, keys: list[str], at: str = "observed_at") -> DataFrame:
    """The newest row of each key; two at the newest instant are ambiguous (``ambiguous`` true, one row)."""
    others = [c for c in rows.columns if c not in keys]
    # rows of one instant first, so that the second aggregate sees one row for each
    instants = rows.groupBy(*keys, F.col(at).alias("_at")).agg(F.min(F.struct(*others)).alias("_row"), F.count("*").alias("_n"))
    latest = instants.groupBy(*keys).agg(F.max_by(F.struct("_row", "_n"), "_at").alias("_b"))
    return latest.select(*keys, *(F.col(f"_b._row.{c}").alias(c) for c in others), (F.col("_b._n") > 1).alias("ambiguous")).select(*rows.columns, "ambiguous")


#: Amounts are only put together if these agree, as far as facts have them.
SIGNATURE = ("currency", "unit", "period_type", "period_start", "period_days")


def usable(facts: DataFrame, as_of: Column) -> DataFrame:
    """Facts that may enter a variable, by the columns they have: available, admissible, with a value and a period that ended by ``as_of``."""
    ok = F.col("value").isNotNull() & (F.col("period_end") <= as_of)
    if "availability" in facts.columns:
        ok = ok & (F.col("availability") == "AVAILABLE")
    if "admissible" in facts.columns:
        ok = ok & F.col("admissible")
    for c in ("currency", "unit", "period_type"):
        ok = ok & F.col(c).isNotNull() if c in facts.columns else ok
    return facts.filter(ok)


def selected_periods(facts: DataFrame, needs: dict[str, tuple[str, ...]], periods: dict[str, int] | None = None) -> DataFrame:
    """Per company and each name of ``needs``, a struct ``(periods, ambiguous)``: the newest periods that have every concept once, in one signature.

    ``periods`` (one unless said otherwise) are structs ``(period_end, amounts, signature)``, the newest first; ambiguous if a period as new has all
    concepts, one of them twice. All names are served by two aggregates: by company and period, then by company.
    """
    concepts = sorted({c for n in needs.values() for c in n})
    count, value = {c: f"_n{k}" for k, c in enumerate(concepts)}, {c: f"_v{k}" for k, c in enumerate(concepts)}
    of = lambda c, x: F.when(F.col("concept") == c, x)
    signature = [c for c in SIGNATURE if c in facts.columns]
    sign = F.struct(*signature) if signature else F.lit(0)
    aggregates = [x for c in concepts for x in (F.count(of(c, 1)).alias(count[c]), F.max(of(c, F.col("value"))).alias(value[c]))]
    for k, n in enumerate(needs.values()):
        mine = F.when(F.col("concept").isin(*n), sign)
        aggregates += [F.min(mine).eqNullSafe(F.max(mine)).alias(f"_s{k}"), F.min(mine).alias(f"_g{k}")]
    each = facts.filter(F.col("concept").isin(*concepts)).groupBy("company", "period_end").agg(*aggregates)
    out = []
    for k, (name, n) in enumerate(needs.items()):
        counts = [F.col(count[c]) for c in n]
        once = reduce(Column.__and__, [x == 1 for x in counts]) & F.col(f"_s{k}")
        twice = reduce(Column.__and__, [x >= 1 for x in counts]) & reduce(Column.__or__, [x > 1 for x in counts])
        period = F.when(once, F.struct("period_end", F.array(*(F.col(value[c]) for c in n)).alias("amounts"), F.col(f"_g{k}").alias("signature")))
        wanted = (periods or {}).get(name, 1)
        # a company has few periods; where one is enough, only that one is kept
        chosen = F.array_compact(F.array(F.max(period))) if wanted == 1 else F.slice(F.sort_array(F.collect_list(period), asc=False), 1, wanted)
        out += [chosen.alias(f"_p{k}"), F.max(F.when(twice, F.col("period_end"))).alias(f"_t{k}")]
    flat = each.groupBy("company").agg(*out)
    last = lambda k: F.get(F.col(f"_p{k}"), F.size(f"_p{k}") - 1)["period_end"]
    return flat.select("company", *(F.struct(F.col(f"_p{k}").alias("periods"), F.coalesce(F.col(f"_t{k}") >= last(k), F.lit(False)).alias("ambiguous")).alias(name) for k, name in enumerate(needs)))


def latest_compatible(facts: DataFrame, concepts: tuple[str, ...], periods: int = 1) -> DataFrame:
    """The newest ``periods`` periods that have every concept once, in one signature; ambiguous if a newer one has all of them, one twice."""
    s = selected_periods(facts, {"chosen": concepts}, {"chosen": periods}).select("company", F.explode("chosen.periods").alias("p"), "chosen.ambiguous")
    return s.select("company", F.col("p.period_end").alias("period_end"), *(F.get("p.amounts", F.lit(k)).alias(c) for k, c in enumerate(concepts)), "ambiguous")


def closest(rows: DataFrame, keys: list[str], year: Column, requested: int, n: int = 1, then: list[Column] | None = None) -> DataFrame:
    """The ``n`` rows of each key whose year is closest to ``requested``; of equally close years the newer."""
    far = F.coalesce(F.abs(year - requested), F.lit(10_000))
    w = Window.partitionBy(*keys).orderBy(far, F.coalesce(-year, F.lit(0)), *(then or []))
    return rows.withColumn("choice", F.row_number().over(w)).filter(F.col("choice") <= n)


def not_newest_first(rows: DataFrame, keys: list[str], order: str, day: str) -> DataFrame:
    """Per key whether the listed order is newest first, and how often it is not."""
    w = Window.partitionBy(*keys).orderBy(order)
    wrong = F.col(day) > F.lag(day).over(w)
    return rows.withColumn("_wrong", F.coalesce(wrong, F.lit(False))).groupBy(*keys).agg(F.sum(F.col("_wrong").cast("long")).alias("breaks"))


# ------------------------------------------------------------------ financial

TREND = "F1.2"
# Fixed values of the model.
#: code: numerator, what is taken off it, denominator, reason if the denominator is not usable
RATIOS = {
    "F1.1": ("NET_ASSETS", None, "TOTAL_ASSETS", "NON_POSITIVE_TOTAL_ASSETS"),
    "F2.2": ("CURRENT_ASSETS", None, "CURRENT_LIABILITIES", "NON_POSITIVE_CURRENT_LIABILITIES"),
    "F2.3": ("CURRENT_ASSETS", "INVENTORY", "CURRENT_LIABILITIES", "NON_POSITIVE_CURRENT_LIABILITIES"),
    "F3.1": ("INTEREST_BEARING_DEBT", None, "TOTAL_ASSETS", "NON_POSITIVE_TOTAL_ASSETS"),
}


def financial(companies: DataFrame, facts: DataFrame, codes: tuple[str, ...], mode: str = "strict", as_of: Column | None = None) -> DataFrame:
    """``company, code, value, reason, period_end`` of the balance-sheet variables ``codes``, from one selection of their periods.

    ``mode`` foundation refuses only a denominator of 0. With ``as_of`` only usable facts enter. The two periods of the trend have
    to be in one currency, unit and type of period, as far as facts have these.
    """
    chosen, found = financial_part(facts, codes, mode, as_of)
    row = companies.select("company").join(chosen, "company", "left")
    return row.select("company", F.inline(F.array(*(F.struct(c, v, w, p) for c, v, w, p in found))))


#: What :func:`together` puts side by side: a table with one row a company at most, and (code, value, reason, ...) columns over it.
Part = tuple[DataFrame, list[tuple[Column, ...]]]


def together(companies: DataFrame, *parts: Part) -> DataFrame:
    """``company, code, value, reason`` of all parts, from one row for each company.

    The parts are aggregated by company already: they meet where they lie, and what follows by company needs no shuffle.
    """
    row = companies.select("company")
    for df, _ in parts:
        row = row.join(df, "company", "left")
    return row.select("company", F.inline(F.array(*(F.struct(*c[:3]) for _, found in parts for c in found))))


def financial_part(facts: DataFrame, codes: tuple[str, ...], mode: str = "strict", as_of: Column | None = None) -> Part:
    facts = facts if as_of is None else usable(facts, as_of)
    needs = {c: ("NET_ASSETS",) if c == TREND else tuple(x for x in RATIOS[c][:3] if x) for c in codes}
    chosen = selected_periods(facts, needs, {TREND: 2})
    amount = lambda code, period, k: F.get(F.get(F.col(f"`{code}`.periods"), F.lit(period))["amounts"], F.lit(k))
    found = []
    for code in codes:
        n, ambiguous = F.coalesce(F.size(F.col(f"`{code}`.periods")), F.lit(0)), F.col(f"`{code}`.ambiguous")
        if code == TREND:
            now, before = amount(code, 0, 0), amount(code, 1, 0)
            sign = lambda k: F.get(F.col(f"`{TREND}`.periods"), F.lit(k))["signature"]
            differ = [~sign(0)[c].eqNullSafe(sign(1)[c]) for c in ("currency", "unit", "period_type") if c in facts.columns]
            why = F.when(n < 2, "NON_COMPARABLE_PERIODS").when(ambiguous, "AMBIGUOUS").when(reduce(Column.__or__, differ, F.lit(False)), "INCOMPATIBLE_INPUTS").when(before == 0, "ZERO_PREVIOUS_NET_ASSETS")
            value = (now.cast("double") - before.cast("double")) / F.abs(before.cast("double"))
        else:
            _, less, _, reason = RATIOS[code]
            bottom = amount(code, 0, len(needs[code]) - 1)
            why = F.when(n < 1, "NO_COMPATIBLE_PERIOD").when(ambiguous, "AMBIGUOUS").when(bottom == 0 if mode == "foundation" else bottom <= 0, reason if mode != "foundation" else "ZERO_DENOMINATOR")
            value = (amount(code, 0, 0).cast("double") - (amount(code, 0, 1).cast("double") if less else F.lit(0.0))) / bottom.cast("double")
        period = F.when(n > 0, F.get(F.col(f"`{code}`.periods"), F.lit(0))["period_end"])
        found.append((F.lit(code).alias("code"), F.when(why.isNull(), value).alias("value"), why.alias("reason"), period.alias("period_end")))
    return chosen, found


def ratio(companies: DataFrame, facts: DataFrame, code: str, mode: str = "strict") -> DataFrame:
    """A balance-sheet ratio of the latest compatible period."""
    return financial(companies, facts, (code,), mode)


def net_asset_trend(companies: DataFrame, facts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Change of net assets against the previous comparable period, relative to its size.

    Where facts say whether they are comparable, the others do not enter.
    """
    if "comparability" in facts.columns:
        facts = facts.filter(F.col("comparability") == "COMPARABLE")
    return financial(companies, facts, (TREND,), as_of=as_of)


AUDIT = "company long, inputs array<struct<concept: string, period_end: date, amount: decimal(20,4)>>, trace string, issue string, code string"


def audit_rows(companies: DataFrame, facts: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """One row per company and ratio: the amounts that entered it, the formula they entered, and why there is no value, if so."""
    needs = {c: tuple(x for x in RATIOS[c][:3] if x) for c in codes}
    row = companies.select("company").join(selected_periods(facts, needs), "company", "left")
    values = financial(companies, facts, codes).select("company", "code", F.col("reason").alias("issue"))
    found = []
    for code, concepts in needs.items():
        top, less, bottom, _ = RATIOS[code]
        period = F.get(F.col(f"`{code}`.periods"), F.lit(0))
        inputs = F.array(*(F.struct(F.lit(c).alias("concept"), period["period_end"].alias("period_end"), F.get(period["amounts"], F.lit(k)).alias("amount")) for k, c in enumerate(concepts)))
        none = F.array().cast("array<struct<concept: string, period_end: date, amount: decimal(20,4)>>")
        found.append(F.struct(F.lit(code).alias("code"), F.when(period.isNotNull(), inputs).otherwise(none).alias("inputs"), F.lit(f"({top} - {less}) / {bottom}" if less else f"{top} / {bottom}").alias("trace")))
    return row.select("company", F.inline(F.array(*found))).join(values, ["company", "code"])


def export_audit(rows: DataFrame, folder: str) -> DataFrame:
    """Write audit rows as JSON lines, one folder for each code, and return what the files say."""
    rows.select("company", "inputs", "trace", "issue", "code").write.mode("overwrite").partitionBy("code").json(folder)
    return rows.sparkSession.read.schema(AUDIT).json(folder)


# ----------------------------------------------------------------- governance

def lateness(companies: DataFrame, obligations: DataFrame, kind: str, code: str, as_of: Column, mode: str = "strict") -> DataFrame:
    """Days that the latest obligation of a kind is or was late."""
    return latenesses(companies, obligations, {kind: code}, as_of, mode)


def latenesses(companies: DataFrame, obligations: DataFrame, codes: dict[str, str], as_of: Column, mode: str = "strict") -> DataFrame:
    """The same for several kinds, from one selection of the latest obligations that were observed by ``as_of``.

    An obligation without a due date, and one filed on no known day or after ``as_of``, is unresolved, not 0 days late.
    """
    return together(companies, lateness_part(obligations, codes, as_of, mode))


def lateness_part(obligations: DataFrame, codes: dict[str, str], as_of: Column, mode: str = "strict") -> Part:
    known = obligations.filter(F.col("kind").isin(*codes) & (F.to_date("observed_at") <= as_of))
    latest = latest_observation(known, ["company", "kind"])
    fields = ("state", "filed", "due", "ambiguous")
    wide = latest.groupBy("company").agg(*(F.max(F.when(F.col("kind") == k, F.struct(*fields))).alias(c) for k, c in codes.items()))
    found = []
    for code in codes.values():
        state, filed, due, ambiguous = (F.col(f"`{code}`.{f}") for f in fields)
        end = F.when(state == "FILED", filed).otherwise(as_of)
        why = F.when(state.isNull(), "NO_OBLIGATION").when(ambiguous, "AMBIGUOUS")
        unclear = (state == "UNRESOLVED") | due.isNull() | end.isNull() | (end > as_of)
        why = why.when(unclear, "UNRESOLVED_OBLIGATION" if mode == "strict" else "INCOMPLETE_FILING_HISTORY")
        late = F.greatest(F.datediff(end, due), F.lit(0)).cast("double")
        if mode == "foundation":  # what is not due yet is not late, whatever is known of its filing
            not_due = due > as_of
            late, why = F.when(not_due, 0.0).otherwise(late), F.when(not_due & ~ambiguous, None).otherwise(why)
        found.append((F.lit(code).alias("code"), F.when(why.isNull(), late).alias("value"), why.alias("reason")))
    return wide, found


def active_at(day: Column, just_before: bool = False) -> Column:
    """Appointed by ``day`` and not yet resigned; ``just_before``: at the end of the day before."""
    if just_before:
        return (F.col("appointed") < day) & (F.col("resigned").isNull() | (F.col("resigned") >= day))
    return (F.col("appointed") <= day) & (F.col("resigned").isNull() | (F.col("resigned") > day))


def turnover(companies: DataFrame, directors: DataFrame, as_of: Column, months: int = 24) -> DataFrame:
    """Distinct departures in the window over distinct directors just before it."""
    return together(companies, turnover_part(directors, as_of, months))


def turnover_part(directors: DataFrame, as_of: Column, months: int = 24) -> Part:
    start = F.add_months(as_of, -months)
    left, initial = F.col("resigned").between(start, as_of), active_at(start, True)
    # only those who count, each person once: two distinct counts would double all rows before they are shuffled
    person = directors.filter(F.col("person").isNotNull() & (left | initial)).groupBy("company", "person").agg(F.max(left).alias("left"), F.max(initial).alias("initial"))
    n = person.groupBy("company").agg(F.count_if("left").alias("_left"), F.count_if("initial").alias("_initial"))
    why = F.when(F.coalesce("_initial", F.lit(0)) == 0, "ZERO_DIRECTOR_DENOMINATOR")
    return n, [(F.lit("G2.1").alias("code"), F.when(why.isNull(), F.col("_left") / F.col("_initial")).alias("value"), why.alias("reason"))]


def median_tenure(companies: DataFrame, directors: DataFrame, as_of: Column) -> DataFrame:
    """Median years in office of the active directors; one identity with two starts is ambiguous."""
    return together(companies, tenure_part(directors, as_of))


def tenure_part(directors: DataFrame, as_of: Column) -> Part:
    per_person = directors.filter(active_at(as_of)).groupBy("company", "person").agg(F.min("appointed").alias("appointed"), (F.min("appointed") != F.max("appointed")).alias("two"))
    n = per_person.groupBy("company").agg(F.median(F.datediff(as_of, F.col("appointed"))).alias("_days"), F.bool_or("two").alias("_two"))
    why = F.when(F.col("_days").isNull(), "EMPTY_DIRECTOR_POPULATION").when(F.col("_two"), "AMBIGUOUS_DIRECTOR_IDENTITY")
    return n, [(F.lit("G2.2").alias("code"), F.when(why.isNull(), F.col("_days") / YEAR_DAYS).alias("value"), why.alias("reason"))]


def change_concentration(companies: DataFrame, directors: DataFrame, as_of: Column, months: int = 24, days: int = WINDOW_DAYS) -> DataFrame:
    """The largest share of directors that left within ``days`` days; of equal windows the earliest.

    Windows that can be largest start on a departure or end on one. Each has its own population: the distinct
    directors just before it opens; windows with none do not count. A person counts once in a window, however often
    they leave in it.

    Both counts are sums of steps in time. A person's appointments, joined where they overlap, raise the population the
    day after they start and lower it the day after they end. A departure counts for windows that open up to ``days - 1``
    days before it and after the same person's departure before it. Steps are summed by company and day first, so that a
    sweep over a company meets days, not persons.
    """
    best, [(code, value, reason, window)] = concentration_part(directors, as_of, months, days)
    return companies.select("company").join(best, "company", "left").select("company", code, value, reason, window)


def concentration_part(directors: DataFrame, as_of: Column, months: int = 24, days: int = WINDOW_DAYS) -> Part:
    start = F.add_months(as_of, -months)
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    step = lambda at, present, left: F.struct(at.alias("at"), F.lit(present).alias("present"), F.lit(left).alias("left"))
    # one sort of a company's persons and no aggregate by person: a row knows from its neighbours whether it opens or ends a run
    mine = Window.partitionBy("company", "person").orderBy("appointed", F.col("resigned").asc_nulls_last())
    ever = F.coalesce("resigned", F.lit("9999-12-30").cast("date"))
    known = directors.filter(F.col("person").isNotNull() & F.col("appointed").isNotNull()).select("company", "person", "appointed", "resigned")
    runs = known.withColumns({"_reached": F.max(ever).over(mine.rowsBetween(Window.unboundedPreceding, -1)), "_next": F.lead("appointed").over(mine)})
    to = F.greatest(ever, F.col("_reached"))
    opened = F.when(F.coalesce(F.col("appointed") > F.col("_reached"), F.lit(True)), step(number(F.col("appointed")) + 1, 1, 0))
    ended = F.when(F.coalesce(F.col("_next") > to, F.lit(True)), step(number(to) + 1, -1, 0))
    present = runs.select("company", F.inline(F.array_compact(F.array(opened, ended))))
    departed = directors.filter(F.col("resigned").between(start, as_of)).select("company", "person", F.col("resigned").alias("day"))
    gone = departed.withColumn("_before", F.lag("day").over(Window.partitionBy("company", "person").orderBy("day"))).filter("_before is null or _before < day")
    earliest = F.greatest(number(F.col("day")) - (days - 1), F.coalesce(number(F.col("_before")) + 1, F.lit(-1_000_000)))
    left = gone.select("company", "day", earliest.alias("earliest")).select("company", F.inline(F.array(step(F.col("earliest"), 0, 1), step(number(F.col("day")) + 1, 0, -1))))
    opens = departed.select("company", "day").distinct().select("company", F.explode(F.array(F.col("day"), F.date_sub("day", days - 1))).alias("x")).select("company", F.greatest(start, F.least(F.date_sub(as_of, days - 1), "x")).alias("open")).distinct()
    steps = present.unionByName(left).groupBy("company", "at").agg(F.sum("present").alias("present"), F.sum("left").alias("left"))
    mixed = steps.withColumn("open", F.lit(None).cast("date")).unionByName(opens.select("company", number(F.col("open")).alias("at"), F.lit(0).cast("long").alias("present"), F.lit(0).cast("long").alias("left"), "open"))
    sweep = Window.partitionBy("company").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    counted = mixed.select("company", "open", F.sum("present").over(sweep).alias("initial"), F.sum("left").over(sweep).alias("left")).filter("open is not null and initial > 0")
    best = counted.groupBy("company").agg(F.max(F.struct((F.col("left") / F.col("initial")).alias("share"), (-number(F.col("open"))).alias("neg"), F.col("open"))).alias("_window"))
    why = F.when(F.col("_window").isNull(), "NO_COMPUTABLE_WINDOW")
    return best, [(F.lit("G2.3").alias("code"), F.col("_window.share").alias("value"), why.alias("reason"), F.col("_window.open").alias("window_start"))]


def control_changes(companies: DataFrame, controllers: DataFrame, as_of: Column, months: int = 36) -> DataFrame:
    """Distinct dated exits from control in the window.

    ``controllers`` has a row for each observed controller: ``identity, notified, ceased, cessation`` (the availability of
    ``ceased``) and ``statement`` (the row is a statement, not a controller). Ambiguous are companies with a statement, a
    missing identity or notification, a notification in the window, an end that is neither known nor declared not to
    apply, or one identity with two histories. A company without rows has no exits.
    """
    return together(companies, control_part(controllers, as_of, months))


def control_part(controllers: DataFrame, as_of: Column, months: int = 36) -> Part:
    start = F.add_months(as_of, -months)
    history = F.struct("notified", "ceased")
    unclear = F.coalesce(F.col("statement"), F.lit(False)) | F.col("identity").isNull() | F.col("notified").isNull() | F.col("notified").between(start, as_of)
    unclear = unclear | (F.col("ceased").isNull() & ~F.col("cessation").eqNullSafe(F.lit("NOT_APPLICABLE")))
    per_identity = controllers.groupBy("company", "identity").agg(
        F.bool_or(unclear).alias("unclear"), (~F.min(history).eqNullSafe(F.max(history))).alias("two"), F.count_distinct(F.when(F.col("ceased").between(start, as_of), F.col("ceased"))).alias("exits")
    )
    n = per_identity.groupBy("company").agg(F.bool_or(F.col("unclear") | F.col("two")).alias("_unclear"), F.sum("exits").alias("_exits"))
    why = F.when(F.coalesce("_unclear", F.lit(False)), "AMBIGUOUS")
    return n, [(F.lit("G3.1").alias("code"), F.when(why.isNull(), F.coalesce("_exits", F.lit(0)).cast("double")).alias("value"), why.alias("reason"))]


def role_gate(members: DataFrame, excluded: tuple[str, ...], known: tuple[str, ...]) -> DataFrame:
    """Per company the first failure by subject; excluded roles are dropped first.

    A failure is an unknown role, no identity, no start, or, where members have ``resigned`` and ``resignation`` (its
    availability), an end that is neither known nor declared not to apply.
    """
    m = members.filter(~F.coalesce(F.col("role").isin(*excluded), F.lit(False)))
    failure = F.when(~F.coalesce(F.col("role").isin(*known), F.lit(False)), "UNKNOWN_ROLE").when(F.col("person").isNull(), "MISSING_IDENTITY").when(F.col("appointed").isNull(), "MISSING_APPOINTMENT")
    if "resignation" in members.columns:
        failure = failure.when(F.col("resigned").isNull() & ~F.col("resignation").eqNullSafe(F.lit("NOT_APPLICABLE")), "INCOMPLETE_POPULATION")
    return m.withColumn("failure", failure).groupBy("company").agg(F.count("*").alias("members"), F.min_by("failure", F.when(F.col("failure").isNotNull(), F.col("subject"))).alias("reason"))
