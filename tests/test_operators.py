"""Operators on small tables with known results."""

import datetime as dt
import math
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import beliefs, derivation, documents, evidence, validation, variables
from ledgerloom.plans import model
from ledgerloom.sources import published


def day(s):
    return dt.date.fromisoformat(s)


def one(df, *cols):
    r = df.first()
    return tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]


# ------------------------------------------------------------- beliefs and ER


def combined(spark, rows):
    return beliefs.combine(spark.createDataFrame(rows, "node string, weight double, low double, high double"), ["node"]).first()


def test_golden_six_leaves(spark):
    """Known leaves of one company give the known overall belief."""
    rows = [("G1.1", 0.9702, 0.0), ("G1.2", 0.9702, 0.0), ("G2.2", 0.9702, 0.0), ("F1.1", 0.7155279037, 0.0919720963), ("F2.2", 0.0, 0.8075), ("F2.3", 0.1779672553, 0.6295327447)]
    leaves = spark.createDataFrame([(1, *r) for r in rows], "company int, code string, low double, high double")
    nodes = beliefs.aggregate_tree(leaves, model.hierarchy(spark), 2)
    top = nodes.filter("node = 'OVERALL'").first()
    want = (0.5826512508995443, 0.3201263980510458, 0.0972223510494099)
    assert all(math.isclose(top[c], w, abs_tol=1e-8) for c, w in zip(("low", "high", "unknown"), want, strict=True))
    assert beliefs.belief_violations(nodes).count() == 0


@pytest.mark.parametrize("belief", [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)])
def test_unanimous_is_identity(spark, belief):
    r = combined(spark, [("n", w, *belief) for w in (0.2, 0.3, 0.5)])
    assert (round(r["low"], 12), round(r["high"], 12)) == belief


def test_single_child_is_identity_and_conflict_is_known(spark):
    r = combined(spark, [("n", 1.0, 0.3, 0.3)])
    assert (r["low"], r["high"], round(r["unknown"], 12)) == (0.3, 0.3, 0.4)
    r = combined(spark, [("n", 0.4, 1.0, 0.0), ("n", 0.6, 0.0, 1.0)])
    assert (round(r["low"], 9), round(r["high"], 9)) == (round(4 / 13, 9), round(9 / 13, 9))


def test_order_does_not_matter(spark):
    rows = [("n", 0.2, 0.7, 0.1), ("n", 0.5, 0.1, 0.6), ("n", 0.3, 0.0, 0.0)]
    a, b = combined(spark, rows), combined(spark, rows[::-1])
    assert all(math.isclose(a[c], b[c], rel_tol=1e-12) for c in ("low", "high", "unknown"))


@pytest.mark.parametrize("r, high", [(1.0, 1.0), (0.8, 0.921), (0.5, 0.728), (0.2, 0.381), (0.0, 0.0)])
def test_reliability_stress_of_the_historical_model(spark, r, high):
    leaves = spark.createDataFrame([(1, v[0], 0.0, r) for v in model.VARIABLES], "company int, code string, low double, high double")
    top = beliefs.aggregate_tree(leaves, model.hierarchy(spark, model.HISTORICAL), 3).filter("node = 'OVERALL'").first()
    assert math.isclose(top["high"], high, abs_tol=6e-4) and math.isclose(top["unknown"], 1 - high, abs_tol=6e-4)


@pytest.mark.parametrize(
    "code, value, high", [("G1.1", 45.0, 0.5), ("G1.2", 15.0, 0.5), ("G2.2", 3.0, 0.5), ("G2.2", 9.339, 0.0), ("F1.1", 0.09, 0.1), ("F1.1", -0.1, 1.0), ("F2.2", 1.3, 0.5), ("F2.2", 2.0, 0.0), ("F2.3", 0.85, 0.5)]
)
def test_reference_levels(spark, code, value, high):
    v = spark.createDataFrame([(1, code, value), (2, code, None)], "company int, code string, value double")
    rows = {r["company"]: r for r in beliefs.memberships(v, model.variables(spark)).collect()}
    assert math.isclose(rows[1]["high"], high, abs_tol=1e-9) and math.isclose(rows[1]["low"], 1 - high, abs_tol=1e-9)
    assert (rows[2]["low"], rows[2]["high"], rows[2]["unknown"]) == (0.0, 0.0, 1.0)


def test_discounted_leaf(spark):
    who = spark.createDataFrame([(1,)], "company int")
    values = spark.createDataFrame([(1, "F2.2", 1.3, 0.6)], "company int, code string, value double, r double")
    rows = {r["code"]: r for r in beliefs.leaves(who, values, model.variables(spark)).collect()}
    assert len(rows) == 6 and [round(rows["F2.2"][c], 9) for c in ("low", "high", "unknown")] == [0.3, 0.3, 0.4]
    assert rows["F1.1"]["unknown"] == 1.0


def test_model_config(spark):
    assert model.config_issues(model.variables(spark), model.hierarchy(spark)).count() == 0
    bad = model.config_issues(model.variables(spark, "1"), model.hierarchy(spark))
    assert {r["subject"] for r in bad.collect()} == {"G2.1", "G2.3", "G3.1", "F1.2", "F3.1"}
    with pytest.raises(ValueError):
        model.variables(spark, "9")


# ------------------------------------------------------------------ variables


FACTS = "company int, period_end date, concept string, value decimal(20,4)"


def test_ratios(spark):
    who = spark.createDataFrame([(k,) for k in range(1, 6)], "company int")
    old, new = day("2023-12-31"), day("2024-12-31")
    rows = [(1, new, "CURRENT_ASSETS", 150), (1, new, "CURRENT_LIABILITIES", 100), (1, new, "INVENTORY", 30), (2, new, "CURRENT_ASSETS", 150), (2, new, "CURRENT_LIABILITIES", 0)]
    rows += [(3, new, "CURRENT_ASSETS", 1), (3, old, "CURRENT_ASSETS", 90), (3, old, "CURRENT_LIABILITIES", 45)]
    rows += [(4, new, "CURRENT_ASSETS", 1), (4, new, "CURRENT_ASSETS", 1), (4, new, "CURRENT_LIABILITIES", 1), (4, old, "CURRENT_ASSETS", 90), (4, old, "CURRENT_LIABILITIES", 45)]
    facts = spark.createDataFrame([(a, b, c, Decimal(v)) for a, b, c, v in rows], FACTS)
    got = {r["company"]: (r["value"], r["reason"]) for r in variables.ratio(who, facts, "F2.2").collect()}
    assert got == {1: (1.5, None), 2: (None, "NON_POSITIVE_CURRENT_LIABILITIES"), 3: (2.0, None), 4: (None, "AMBIGUOUS"), 5: (None, "NO_COMPATIBLE_PERIOD")}
    assert one(variables.ratio(who.filter("company = 1"), facts, "F2.3"), "value") == 1.2


def test_net_asset_trend(spark):
    who = spark.createDataFrame([(1,), (2,), (3,), (4,)], "company int")
    d = Decimal
    rows = [(1, day("2024-12-31"), "NET_ASSETS", d(80)), (1, day("2023-12-31"), "NET_ASSETS", d(100)), (2, day("2024-12-31"), "NET_ASSETS", d(-80)), (2, day("2023-12-31"), "NET_ASSETS", d(-100)), (3, day("2024-12-31"), "NET_ASSETS", d(5)), (3, day("2023-12-31"), "NET_ASSETS", d(0)), (4, day("2023-12-31"), "NET_ASSETS", d(1))]
    got = {r["company"]: (None if r["value"] is None else round(r["value"], 9), r["reason"]) for r in variables.net_asset_trend(who, spark.createDataFrame(rows, FACTS)).collect()}
    assert got == {1: (-0.2, None), 2: (0.2, None), 3: (None, "ZERO_PREVIOUS_NET_ASSETS"), 4: (None, "NON_COMPARABLE_PERIODS")}


def test_governance_populations(spark):
    as_of = F.lit("2026-09-30").cast("date")
    who = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "company int")
    rows = [
        (1, "a", day("2020-01-01"), day("2025-01-01")), (1, "b", day("2020-01-01"), day("2025-02-01")),
        (2, "a", day("2021-09-30"), None), (2, "b", day("2023-09-30"), None),
        (3, "a", day("2020-01-01"), day("2025-01-01")), (3, "b", day("2020-01-01"), day("2025-02-01")), (3, "c", day("2020-01-01"), None),
    ]
    people = spark.createDataFrame(rows, "company int, person string, appointed date, resigned date")
    turnover = {r["company"]: (r["value"], r["reason"]) for r in variables.turnover(who, people, as_of).collect()}
    assert turnover[1] == (1.0, None) and turnover[2] == (0.0, None) and turnover[4] == (None, "ZERO_DIRECTOR_DENOMINATOR")
    tenure = {r["company"]: (r["value"], r["reason"]) for r in variables.median_tenure(who, people, as_of).collect()}
    assert math.isclose(tenure[2][0], 4.00008, abs_tol=1e-4) and tenure[1] == (None, "EMPTY_DIRECTOR_POPULATION")
    dense = {r["company"]: (r["value"], r["reason"]) for r in variables.change_concentration(who, people, as_of).collect()}
    assert math.isclose(dense[3][0], 2 / 3) and dense[2] == (None, "NO_COMPUTABLE_WINDOW")


def test_lateness(spark):
    as_of = F.lit("2026-09-30").cast("date")
    t = dt.datetime(2026, 1, 1)
    rows = [(1, "A", 1, day("2026-09-20"), day("2026-09-19"), "FILED", t), (2, "A", 2, day("2026-09-20"), day("2026-09-25"), "FILED", t), (3, "A", 3, day("2026-09-20"), None, "OUTSTANDING", t), (4, "A", 4, day("2027-09-30"), None, "OUTSTANDING", t), (5, "A", 5, day("2026-09-20"), None, "UNRESOLVED", t), (6, "A", 6, day("2026-09-20"), None, "OUTSTANDING", t), (6, "A", 7, day("2026-09-20"), None, "OUTSTANDING", t)]
    o = spark.createDataFrame(rows, "company int, kind string, obligation_id int, due date, filed date, state string, observed_at timestamp")
    who = spark.createDataFrame([(k,) for k in range(1, 8)], "company int")
    got = {r["company"]: (r["value"], r["reason"]) for r in variables.lateness(who, o, "A", "G1.1", as_of).collect()}
    assert got == {1: (0.0, None), 2: (5.0, None), 3: (10.0, None), 4: (0.0, None), 5: (None, "UNRESOLVED_OBLIGATION"), 6: (None, "AMBIGUOUS"), 7: (None, "NO_OBLIGATION")}


# --------------------------------------------------------------------- scalars


def cell(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, unit, value, reason", [("(1,234)", "GBP units", -1234, None), ("(1,234)", "£'000s", -1234000, None), ("(1,234)", "GBP thousands", -1234000, None), ("1,234", "GBP millions", 1234000000, None), ("-", "GBP units", None, "NO_AMOUNT"), ("$5", "GBP units", None, "FOREIGN_CURRENCY"), ("5", "bushels", None, "UNKNOWN_UNIT"), ("1,23", "units", None, "NOT_A_NUMBER"), ("−7", "m", -7000000, None)])
def test_printed_amounts(spark, raw, unit, value, reason):
    x = cell(spark, S.printed_amount(F.lit(raw), F.lit(unit)))
    assert (None if x["value"] is None else int(x["value"]), x["reason"]) == (value, reason)


def test_small_scalars(spark):
    assert [cell(spark, S.company_number(F.lit(v))) for v in (" 12 ", "sc123456", "123456789", "A", None)] == ["00000012", "SC123456", None, None, None]
    assert [cell(spark, S.strict_date(F.lit(v))) for v in ("2024-02-29", "2023-02-29", "2024-1-5", None)] == [day("2024-02-29"), None, None, None]
    assert cell(spark, S.months_before(F.lit("2024-02-29").cast("date"), 24)) == day("2022-02-28")
    assert [cell(spark, S.scope_of_heading(F.lit(v))) for v in ("Company balance sheet", "Group accounts", "Company\nGroup", None)] == ["COMPANY", "GROUP", "UNRESOLVED", "UNRESOLVED"]
    assert cell(spark, S.tagged_amount(F.lit("123.40"), F.lit(3), F.lit("-"), F.lit(False)))["value"] == -123400
    assert [cell(spark, S.two_places(F.lit(v).cast("decimal(10,4)"))) for v in ("1.005", None)] == ["1.01", "Unavailable"]


@pytest.mark.parametrize(
    "token, scale, dash, value, reason",
    [("1,234", -2, False, "12.34", None), ("1,234", 15, False, "1234000000000000000", None), ("1", -18, False, "0.000000000000000001", None), ("99", 18, False, "99000000000000000000", None),
     ("999", 18, False, None, "OUT_OF_RANGE"), ("0.5", -18, False, None, "OUT_OF_RANGE"), ("0", 18, False, "0", None), ("-", 3, True, "0", None), ("-", 3, False, None, "NOT_A_NUMBER"), ("1", 19, False, None, "UNSUPPORTED_SCALE"), (None, 0, False, None, "NOT_A_NUMBER")],
)
def test_tagged_amounts_move_the_point_exactly(spark, token, scale, dash, value, reason):
    x = cell(spark, S.tagged_amount(F.lit(token).cast("string"), F.lit(scale), F.lit(""), F.lit(dash)))
    assert (None if x["value"] is None else x["value"] == Decimal(value), x["reason"]) == (None if value is None else True, reason)


def test_tagged_amounts_match_one_pattern_a_token(spark):
    """The digits are counted; patterns over shifted digits, each worked out again where it is used, took most of the time."""
    rows = spark.range(1).selectExpr("string(id) AS t", "int(id) AS n")
    plan = rows.select(S.tagged_amount(F.col("t"), F.col("n"), F.col("t"), F.col("n") == 1).alias("a"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan
    assert plan.count("rlike") <= 3
    for token, scale, value in (("0" * 60 + "1.5" + "0" * 60, 3, "1500"), ("0.000", 18, "0"), ("12" + "0" * 18, -18, "12"), ("9" * 20 + "." + "9" * 18, 0, "9" * 20 + "." + "9" * 18)):
        assert cell(spark, S.tagged_amount(F.lit(token), F.lit(scale), F.lit(""), F.lit(False)))["value"] == Decimal(value)


def test_ids_keep_their_parts_apart(spark):
    parts = [("a|b", "c"), ("a", "b|c"), ("a", None), ("a", ""), (None, "a"), ('a","b', "c"), ("a", 'b","c')]
    ids = {cell(spark, S.identity(*(F.lit(x).cast("string") for x in p))) for p in parts}
    assert len(ids) == len(parts)


# ------------------------------------------------------------------ validation


@pytest.mark.parametrize("s, e, v, c, r", [(".98", ".99", "0", "0", 0.9702), (".98", ".99", ".3", "0", 0.97914), (".98", ".99", ".3", ".3", 0.685398), (".98", ".99", ".6", "1", 0.0), ("1", "1", ".6", "0", 0.99)])
def test_reliability(spark, s, e, v, c, r):
    x = [F.lit(k).cast("decimal(4,2)") for k in (s, e, v, c)]
    assert float(cell(spark, validation.reliability(*x, F.lit(False)))) == pytest.approx(r, abs=1e-12)
    assert float(cell(spark, validation.reliability(*x, F.lit(True)))) == 0
    assert cell(spark, validation.reliability(F.lit(None).cast("decimal(4,2)"), *x[1:], F.lit(False))) is None


def test_conflicts(spark):
    schema = "k int, observation_id int, period int, unit string, value int"
    chosen = spark.createDataFrame([(k, 1, 2024, "GBP", 5) for k in range(5)], schema)
    rivals = spark.createDataFrame([(1, 2, 2024, "GBP", 5), (2, 2, 2023, "GBP", 9), (3, 2, 2024, "USD", 9), (4, 2, 2024, "GBP", 9), (4, 3, 2023, "GBP", 1)], schema)
    got = {r["k"]: r["conflict"] for r in validation.conflict_class(chosen, rivals, ["k"]).collect()}
    assert got == {0: "NONE", 1: "NONE", 2: "PERIOD_DIFFERENCE", 3: "UNIT_DIFFERENCE", 4: "SERIOUS"}


# -------------------------------------------------------- evidence, derivation


def test_chains_and_reach(spark):
    s = spark.createDataFrame([(1, None, "a"), (2, 1, "a"), (3, 2, "a"), (4, 3, "a"), (7, 8, "a"), (8, 7, "a"), (9, 99, "a"), (10, 9, "a"), (11, 4, "b"), (12, 11, "b"), (13, 13, "a")], "snapshot_id int, reused int, company string")
    got = {r["snapshot_id"]: (r["origin"], r["depth"], r["issue"]) for r in evidence.origin_snapshots(s, ("company",)).collect()}
    assert got == {
        1: (1, 0, None), 2: (1, 1, None), 3: (1, 2, None), 4: (1, 3, None), 7: (None, None, "CYCLE"), 8: (None, None, "CYCLE"), 13: (None, None, "CYCLE"),
        9: (None, None, "MISSING_LINK"), 10: (None, None, "MISSING_LINK"), 11: (None, None, "OTHER_OWNER"), 12: (None, None, "OTHER_OWNER"),
    }
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src int, dst int")
    assert sorted(r["node"] for r in evidence.reachable(edges, spark.createDataFrame([(1,)], "node int")).collect()) == [1, 2, 3]


def test_long_chains_are_followed_to_the_end(spark):
    chain = spark.range(1, 101).selectExpr("id AS snapshot_id", "nullif(id - 1, 0) AS reused")
    got = {r["snapshot_id"]: (r["origin"], r["depth"]) for r in evidence.origin_snapshots(chain).collect()}
    assert got == {k: (1, k - 1) for k in range(1, 101)}
    edges = spark.range(1, 61).selectExpr("id AS src", "id + 1 AS dst")
    assert evidence.reachable(edges, spark.createDataFrame([(1,)], "node long"), hops_a_round=16).count() == 61


def test_reachable_follows_long_chains_in_few_rounds(spark, monkeypatch):
    """A chain of 300 nodes, which ends in a fork and a ring, is followed in log2 of its length."""
    written = []
    real = evidence.materialize
    monkeypatch.setattr(evidence, "materialize", lambda df, label="table": written.append(label) or real(df, label))
    chain = [(k, k + 1) for k in range(300)]
    edges = spark.createDataFrame([*chain, (300, 1000), (300, 2000), (1000, 1001), (2000, 2001), (2001, 2000), (5000, 5), (7000, 7001)], "src long, dst long")
    found = {r["node"] for r in evidence.reachable(edges, spark.createDataFrame([(3,), (9999,)], "node long")).collect()}
    assert found == {*range(3, 301), 1000, 1001, 2000, 2001, 9999}
    assert len(written) < 50  # 4 hops a round would take 150


def test_signatures_and_usable_facts(spark):
    """Amounts in two currencies are never put together; what is not admissible, not available or not over is no input."""
    schema = "company int, period_end date, concept string, value decimal(20,4), currency string, availability string, admissible boolean"
    old, new = day("2023-12-31"), day("2024-12-31")
    rows = [(1, new, "NET_ASSETS", 1, "GBP", "AVAILABLE", True), (1, new, "TOTAL_ASSETS", 4, "EUR", "AVAILABLE", True), (1, old, "NET_ASSETS", 1, "GBP", "AVAILABLE", True), (1, old, "TOTAL_ASSETS", 2, "GBP", "AVAILABLE", True)]
    rows += [(2, new, "NET_ASSETS", 9, "GBP", "AVAILABLE", False), (2, new, "TOTAL_ASSETS", 9, "GBP", "AVAILABLE", True), (2, old, "NET_ASSETS", 3, "GBP", "AVAILABLE", True), (2, old, "TOTAL_ASSETS", 4, "GBP", "AVAILABLE", True)]
    rows += [(3, day("2030-12-31"), c, 5, "GBP", "AVAILABLE", True) for c in ("NET_ASSETS", "TOTAL_ASSETS")] + [(3, old, "NET_ASSETS", 5, None, "AVAILABLE", True), (3, old, "TOTAL_ASSETS", 5, "GBP", "NOT_DISCLOSED", True)]
    facts = variables.usable(spark.createDataFrame([(a, b, c, Decimal(v), *x) for a, b, c, v, *x in rows], schema), F.lit("2026-09-30").cast("date"))
    who = spark.createDataFrame([(k,) for k in (1, 2, 3)], "company int")
    got = {r["company"]: (r["value"], r["reason"]) for r in variables.ratio(who, facts, "F1.1").collect()}
    assert got == {1: (0.5, None), 2: (0.75, None), 3: (None, "NO_COMPATIBLE_PERIOD")}


def test_role_gate_needs_the_end_of_office(spark):
    rows = [(1, 1, "director", "p", day("2020-01-01"), None, "NOT_APPLICABLE"), (2, 1, "director", "p", day("2020-01-01"), None, "NOT_DISCLOSED"), (3, 1, "director", "p", day("2020-01-01"), day("2021-01-01"), "AVAILABLE"), (4, 1, "secretary", None, None, None, None), (4, 2, "director", None, None, None, None)]
    m = spark.createDataFrame(rows, "company int, subject int, role string, person string, appointed date, resigned date, resignation string")
    got = {r["company"]: r["reason"] for r in variables.role_gate(m, ("secretary",), ("director",)).collect()}
    assert got == {1: None, 2: "INCOMPLETE_POPULATION", 3: None, 4: "MISSING_IDENTITY"}


def test_trees_with_missing_leaves(spark):
    """A company that lacks leaves is combined from those it has, level by level, as rows would be."""
    rows = [(1, "G1.1", 0.2, 0.7), (1, "F1.1", 0.5, 0.1), (1, "F2.2", 0.1, 0.1), (2, "F1.1", 0.4, 0.4), (3, "other", 1.0, 0.0)]
    leaves = spark.createDataFrame(rows, "company int, code string, low double, high double")
    h = model.hierarchy(spark)
    got = {(r["company"], r["node"]): (r["low"], r["high"]) for r in beliefs.aggregate_tree(leaves, h, 2).collect()}
    domains = beliefs.combine(leaves.join(h, F.col("code") == F.col("child")).withColumnRenamed("parent", "node"), ["company", "node"])
    top = beliefs.combine(domains.withColumnRenamed("node", "child").join(h, "child").withColumnRenamed("parent", "node"), ["company", "node"])
    want = {(r["company"], r["node"]): (r["low"], r["high"]) for r in domains.unionByName(top).collect()}
    assert set(got) == set(want) and all(math.isclose(a, b, rel_tol=1e-12) for k in got for a, b in zip(got[k], want[k], strict=True))


def test_immutable_append(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (3, "d"), (4, None)], "id int, v string")
    got = {(r["id"], r["v"]): r["verdict"] for r in evidence.immutable_append(store, new, "id").collect()}
    assert got == {(1, "a"): "UNCHANGED", (2, "x"): "CONFLICT", (3, "c"): "NEW", (3, "d"): "CONFLICT", (4, None): "NEW"}


def folded(spark, steps):
    """(value as a fraction, reason) of steps (operation, value)."""
    ops = spark.createDataFrame([([(k, o, None if v is None else Decimal(v)) for k, (o, v) in enumerate(steps)][::-1],)], "ops array<struct<position: int, op: string, value: decimal(20,4)>>")
    r = one(ops.select(derivation.fold(F.col("ops")).alias("r")), "r")
    return (None if r["numerator"] is None else Fraction(int(r["numerator"]), int(r["denominator"]) * 10_000), r["reason"])


@pytest.mark.parametrize(
    "steps, value, reason",
    [
        ([("ADD", "4"), ("MULTIPLY", "3"), ("DIVIDE", "2")], "6", None), ([("ADD", "0.1"), ("ADD", "0.2")], "0.3", None), ([("ADD", "1"), ("DIVIDE", "-8"), ("MULTIPLY", "0.5")], "-1/16", None),
        ([("ADD", "7.5"), ("DIVIDE", "0.03")], "250", None), ([("ADD", "9999999999999999.9999"), ("SUBTRACT", "0.0001")], "9999999999999999.9998", None),
        ([("ADD", "1"), ("DIVIDE", "3")], None, "INEXACT"), ([("ADD", "1"), ("DIVIDE", "3"), ("MULTIPLY", "3")], None, "INEXACT"), ([("ADD", "1"), ("DIVIDE", "0")], None, "DIVISION_BY_ZERO"), ([("SUBTRACT", "1")], None, "INVALID_EXPRESSION"),
        ([], None, "INVALID_EXPRESSION"), ([("ADD", "1"), ("POWER", "2")], None, "INVALID_EXPRESSION"), ([("ADD", "1"), ("ADD", None)], None, "MISSING_OPERAND"), ([("ADD", "1")] * 32, "32", None), ([("ADD", "1")] * 33, None, "INVALID_EXPRESSION"),
        ([("ADD", "9000000000000000")] + [("MULTIPLY", "9000000000000000")] * 2, None, "OVERFLOW"),
    ],
)
def test_exact_expressions(spark, steps, value, reason):
    assert folded(spark, steps) == (None if value is None else Fraction(value), reason)


def test_published_versions(spark, tmp_path):
    schema = "k long, payload string, config string, accounts_run long, control_run long"
    put = lambda rows: published.publish(spark.createDataFrame(rows, schema), str(tmp_path), "k", 8)
    have = lambda: {r["k"]: (r["payload"], r["version"]) for r in published.read(spark, str(tmp_path), "k").collect()}
    rows = [(k, f"p{k}", "c", k, None) for k in range(50)]
    assert have() == {} and put(rows) == 1 and put(rows) == 1  # a repeat changes nothing
    before = published.manifest(spark, str(tmp_path))[1]
    assert put([(3, "new", "c", 3, None), (99, "more", "c", 1, 1), (4, "p4", "c", 4, None)]) == 2
    after = published.manifest(spark, str(tmp_path))[1]
    assert 1 <= sum(before.get(b) != p for b, p in after.items()) <= 2  # only the buckets of the two changed keys
    assert have() == {k: (f"p{k}", 1) for k in range(50)} | {3: ("new", 2), 99: ("more", 2)}
    latest = spark.createDataFrame([(1, 1, None), (2, 7, None), (3, 3, None), (200, 1, 1)], "k long, accounts_run long, control_run long")
    told = {r["k"]: r["status"] for r in published.status(published.read(spark, str(tmp_path), "k"), latest, "k", "c").collect()}
    assert told == {1: "CURRENT", 2: "NEWER_EVIDENCE", 3: "CURRENT", 200: "MISSING"}
    with pytest.raises(Exception, match="null"):
        put([(None, "p", "c", 1, 1)])


def test_greedy(spark):
    pages = spark.createDataFrame([(1, 0, 10, 50), (1, 1, 11, 60), (1, 2, 12, 40), (1, 3, 13, 10)], "k int, rank int, page long, size long")
    assert one(documents.greedy_fit(pages, "k", 100, 4), "used", "pages") == (100, "10,12,13")


def test_lines_are_anchored_on_their_first_word(spark):
    w = spark.createDataFrame([(1, y, float(x), f"w{y:g}") for x, y in enumerate((0.0, 2.0, 4.0, 6.0))], "doc int, y double, x double, word string")
    got = [r["text"] for r in documents.assembled_lines(w, ["doc"]).orderBy("line").collect()]
    assert got == ["w0 w2", "w4 w6"]


def test_streams_of_a_folder_in_any_order(spark, tmp_path, monkeypatch):
    """A table of part files, the latest first and one a batch, gives what the batch read gives."""
    import functools

    from ledgerloom.catalog import streams
    from ledgerloom.streaming import jobs

    monkeypatch.setattr(jobs, "stream", functools.partial(jobs.stream, files_per_batch=1))
    day = lambda k: f"timestamp_ntz '2024-01-01 12:00:00' + interval {k} day"
    rows = [(1, 7, "error", 300, "p"), (2, 7, "error", 1, "p"), (3, 8, "error", 150, "q"), (4, 8, "view", 2, "q"), (5, 7, "error", 299, "p")]
    for k, (event, user, kind, d, props) in enumerate(rows):
        one = spark.sql(f"SELECT {event}L AS event_id, {user}L AS user_id, '{kind}' AS event_type, {day(d)} AS ts, '{props}' AS props")
        one.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    found = {n: q.run(spark, str(tmp_path)).collect() for n, q in streams.queries().items() if n != "ST2_departures_90_days"}
    assert sorted((r["event_type"]) for r in found["ST1_process_once"]) == ["error", "error", "view"]
    assert sum(r["n"] for r in found["ST2_rolling_counts"]) == 4 * 7
    assert sorted((r["user_id"], r["event_id"]) for r in found["ST3_latest_state"]) == [(7, 1), (8, 3)]


def test_streams_go_on_where_they_ended(spark, tmp_path):
    from ledgerloom.streaming import jobs

    schema = "user_id long, ts timestamp, v string"
    put = lambda rows, k: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    t = lambda h: dt.datetime(2024, 1, 1, h)
    put([(1, t(1), "a"), (2, t(1), "b")], 1)
    read = lambda: jobs.stream(spark, f"{tmp_path}/in", "*.parquet", spark.createDataFrame([], schema).schema)
    folder = f"{tmp_path}/state"
    assert {r["v"] for r in jobs.latest_state(read(), ["user_id"], ["ts"], folder).collect()} == {"a", "b"}
    put([(1, t(2), "c"), (2, t(0), "late")], 2)
    assert {r["v"] for r in jobs.latest_state(read(), ["user_id"], ["ts"], folder).collect()} == {"c", "b"}
    # the second run wrote the changed key alone
    log = jobs.state_changes(read(), ["user_id"], ["ts"], folder)
    assert sorted((r["v"], r["batch"]) for r in log.collect()) == [("a", 0), ("b", 0), ("c", 1)]
    put([(2, t(2), "d"), (2, t(2), "e"), (1, t(2), "same")], 3)
    assert {r["v"] for r in jobs.state_changes(read(), ["user_id"], ["ts"], folder).filter("batch = 2").collect()} < {"d", "e"}
    once = jobs.process_once(read(), [F.col("user_id")], "ts", "1 day", f"{tmp_path}/once")
    assert once.count() == 2


def test_sessions_close_once_and_late_rows_are_counted(spark, tmp_path):
    from ledgerloom.streaming import jobs

    schema = "user_id long, ts timestamp"
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    put = lambda rows, k: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    read = lambda: jobs.stream(spark, f"{tmp_path}/in", "*.parquet", spark.createDataFrame([], schema).schema)

    def run():
        found, late = jobs.sessions(read(), ["user_id"], "ts", "2 hours", "1 day", f"{tmp_path}/state")
        return sorted((r["user_id"], r["session_window"]["start"], r["count"]) for r in found.collect()), late

    put([(1, t(1, 1)), (1, t(1, 2)), (1, t(1, 9)), (2, t(5, 1))], 1)
    assert run() == ([(1, t(1, 1), 2), (1, t(1, 9), 1)], 0)
    put([(2, t(5, 2)), (1, t(1, 3)), (1, t(9, 1))], 2)
    assert run() == ([(1, t(1, 1), 2), (1, t(1, 9), 1), (2, t(5, 1), 2)], 1)


def test_component_sums_do_not_multiply_their_rows(spark):
    """Two distinct counts made three rows of each component before the shuffle."""
    rows = [(1, 5, "a", "x", True), (1, 7, "b", "x", False), (2, 5, "a", "x", True), (2, 5, "a", "x", True), (3, 5, "a", "x", True), (3, None, "b", "x", True), (4, 5, "a", "x", True), (4, 5, "b", "y", True), (5, 5, "c", "x", True), (6, 5, "a", None, None), (7, 5, None, "x", True)]
    sums = derivation.component_sum(spark.createDataFrame(rows, "s int, value int, label string, context string, says_complete boolean"), "s", ("a", "b"))
    assert "Expand" not in sums._jdf.queryExecution().optimizedPlan().toString()
    assert {r["s"]: (r["total"], r["reason"]) for r in sums.collect()} == {
        1: (12, None), 2: (None, "REPEATED_LABEL"), 3: (None, "COMPONENT_MISSING"), 4: (None, "OTHER_CONTEXT"), 5: (None, "LABEL_NOT_ALLOWED"), 6: (None, "NOT_COMPLETE"), 7: (None, "REPEATED_LABEL"),
    }


def test_competing_observations_are_shuffled_once(spark, tmp_path):
    from ledgerloom.catalog import registry

    rows = [(1, 1, 5.0), (1, 1, 5.0), (1, 2, 5.0), (1, 2, 6.0), (1, 3, 5.0), (2, 1, None), (2, 1, None), (2, 2, None), (2, 2, 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["J07_competing_observations"].run(spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {(r[0], r[1]): (r["rows"], r["competing"]) for r in got.collect()} == {(1, 1): (2, False), (1, 2): (2, True), (2, 1): (2, False), (2, 2): (2, False)}


def test_concentration_keeps_no_table_of_persons(spark):
    """Runs and departures come from sorted neighbours: aggregates by person held every appointment in a task's memory."""
    rows = [(1, 7, "1990-01-01", "1995-01-01"), (1, 7, "1994-01-01", "2000-06-01"), (1, 7, "1994-06-01", "1994-07-01"), (1, 7, "2000-06-02", None), (1, 8, "1990-01-01", "2000-06-01"), (1, 8, "1990-01-01", "2000-06-01"), (1, 9, "1990-01-01", None), (1, None, "1990-01-01", "1999-12-01"), (2, 5, None, "2000-05-05")]
    d = spark.createDataFrame(rows, "company int, person int, a string, r string").selectExpr("company", "person", "date(a) AS appointed", "date(r) AS resigned")
    who = spark.createDataFrame([(1,), (2,), (3,)], "company int")
    got = variables.change_concentration(who, d, F.lit("2000-12-31").cast("date"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [" in x and "person#" in x.split("]")[0]]
    # persons 7 and 8 leave on one day, out of the three in office
    assert {r["company"]: (None if r["value"] is None else round(r["value"], 6), r["reason"], r["window_start"]) for r in got.collect()} == {1: (0.666667, None, day("2000-03-04")), 2: (None, "NO_COMPUTABLE_WINDOW", None), 3: (None, "NO_COMPUTABLE_WINDOW", None)}
    left = variables.turnover(who, d, F.lit("2000-12-31").cast("date"))
    assert "Expand" not in left._jdf.queryExecution().optimizedPlan().toString()
    assert {r["company"]: r["value"] for r in left.collect()} == {1: 2 / 3, 2: None, 3: None}


def test_statements_are_summed_in_whole_pence(spark, tmp_path):
    from ledgerloom.sources import adapters

    spark.createDataFrame([(1, 7, day("1999-01-01"), 10.5)], "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 0.29, 0.07, 0.01, "R"), (1, 99999999.99, 0.1, 0.08, "N")], "l_orderkey long, l_extendedprice double, l_discount double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, -1.01)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    s = adapters.statements(spark, str(tmp_path))
    assert any("l_extendedprice" in x and "as bigint" in x for x in s._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert one(s, "ta", "ca", "inv", "cl", "na", "debt") == tuple(map(Decimal, ("10.5", "100000000.28", "50000000.0965", "160000000.0420", "-5.05", "0.29")))


def test_a_line_may_end_behind_an_amount_but_not_behind_a_date(spark):
    assert cell(spark, S.tagged_amount(F.lit("1,234.5\n"), F.lit(1), F.lit("-"), F.lit(False)))["value"] == -12345
    assert [cell(spark, S.strict_date(F.lit(x))) for x in ("2024-02-29\n", "2023-02-29", "0000-01-01", "2024-02-29")] == [None, None, None, day("2024-02-29")]


def test_leaves_are_made_in_partitions_that_grow_with_the_lines(spark, monkeypatch):
    """F9-F13: the number of partitions was the session's, so that a task's sorts and aggregates grew with the tables."""
    from ledgerloom.catalog import assessment
    from ledgerloom.sources import adapters, shared

    sf, key = "/root/testdata/sf0.001", "spark.sql.shuffle.partitions"
    kept = spark.conf.get(key)
    rows = lambda: sorted(map(str, assessment.discounted_leaves(spark, sf).select("company", "code", "value", "r", "low", "high").collect()))
    few = rows()
    monkeypatch.setattr(shared, "BUCKET_ROWS", 500)
    n = assessment.leaf_partitions(spark, sf)
    assert n >= adapters.table(spark, sf, "lineitem").count() / 500 > int(kept)
    assert rows() == few
    assert spark.conf.get(key) == kept
    people = shared.bucketed(adapters.directors(spark, sf), "company", n, "directors")
    assert people.count() == adapters.directors(spark, sf).count()
    per_person = people.groupBy("company", "person").count()
    assert per_person.rdd.getNumPartitions() == n
    assert "Exchange" not in per_person._jdf.queryExecution().executedPlan().toString()
