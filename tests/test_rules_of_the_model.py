"""Governance values, conflicts and composed reliability on small tables, against the rules restated in Python."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import beliefs, derivation, documents, evidence, grounding, validation, variables
from ledgerloom.plans import model


def day(s):
    return dt.date.fromisoformat(s)


AS_OF = day("2000-12-31")
START = day("1998-12-31")
PEOPLE = "company int, person string, appointed date, resigned date"


def concentration(rows):
    """(ratio, window) by the rule: every candidate window with its own population, persons counted once."""
    best = None
    gone = [r for r in rows if r[2] is not None and START <= r[2] <= AS_OF]
    for x in {y for r in gone for y in (r[2], r[2] - dt.timedelta(89))}:
        w = max(START, min(AS_OF - dt.timedelta(89), x))
        initial = {p for p, a, e in rows if a < w and (e is None or e >= w)}
        left = {p for p, _, e in rows if e is not None and w <= e <= w + dt.timedelta(89)}
        if initial:
            best = max(best or (-1.0, 0), (len(left) / len(initial), -w.toordinal()))
    return (None, None) if best is None else (best[0], dt.date.fromordinal(-best[1]))


def test_change_concentration_has_a_population_per_window(spark):
    people = {
        1: [("old", day("1990-01-01"), None), ("a", day("1999-02-01"), day("2000-06-01")), ("b", day("1999-02-01"), day("2000-06-20")), ("c", day("1999-02-01"), None)],
        2: [("x", day("1999-05-01"), day("2000-05-01"))],  # formed inside the 24 months
        3: [("y", day("1990-01-01"), day("2000-03-01")), ("y", day("1991-01-01"), day("2000-03-20")), ("z", day("1990-01-01"), None)],  # one person leaves twice
        4: [("q", day("1990-01-01"), None)],
        5: [("r", day("2000-03-01"), day("2000-03-01"))],  # nobody just before any window
    }
    rng = random.Random(4)
    for k in range(6, 40):
        days = [START + dt.timedelta(rng.randrange(-300, 760)) for _ in range(rng.randrange(2, 24))]
        people[k] = [(f"p{rng.randrange(6)}", a, None if rng.random() < 0.2 else a + dt.timedelta(rng.randrange(0, 500))) for a in days]
    df = spark.createDataFrame([(k, *r) for k, v in people.items() for r in v], PEOPLE)
    who = spark.createDataFrame([(k,) for k in [*people, 99]], "company int")
    got = {r["company"]: (r["value"], r["window_start"]) for r in variables.change_concentration(who, df, F.lit(AS_OF)).collect()}
    assert got[1][0] == 0.5 and got[2][0] == 1.0 and got[3][0] == 0.5 and got[4] == got[5] == got[99] == (None, None)
    assert got == {k: concentration(people.get(k, [])) for k in got}
    reasons = {r["company"]: r["reason"] for r in variables.change_concentration(who, df, F.lit(AS_OF)).collect()}
    assert {reasons[k] for k in (4, 5, 99)} == {"NO_COMPUTABLE_WINDOW"} and reasons[1] is None


def test_lateness_needs_dates_and_looks_no_further_than_the_day(spark):
    at = lambda y: dt.datetime(y, 1, 1)
    rows = [
        (1, "OUTSTANDING", None, None, at(2000)), (2, "FILED", day("2000-05-01"), None, at(2000)), (3, "OUTSTANDING", day("2000-12-01"), None, at(2000)), (3, "FILED", day("2000-12-01"), day("2000-12-02"), at(2004)),
        (4, "FILED", day("2000-12-01"), day("2000-12-11"), at(2000)), (5, "FILED", day("2000-12-01"), day("2001-02-01"), at(2000)), (6, "OUTSTANDING", day("2003-01-01"), None, at(2004)),
    ]
    df = spark.createDataFrame([(c, "A", *r) for c, *r in rows], "company int, kind string, state string, due date, filed date, observed_at timestamp")
    who = spark.createDataFrame([(k,) for k in range(1, 8)], "company int")
    got = {r["company"]: (r["value"], r["reason"]) for r in variables.lateness(who, df, "A", "G1.1", F.lit(AS_OF)).collect()}
    unresolved = (None, "UNRESOLVED_OBLIGATION")
    assert got == {1: unresolved, 2: unresolved, 3: (30.0, None), 4: (10.0, None), 5: unresolved, 6: (None, "NO_OBLIGATION"), 7: (None, "NO_OBLIGATION")}
    loose = {r["company"]: (r["value"], r["reason"]) for r in variables.lateness(who, df, "A", "G1.1", F.lit(AS_OF), "foundation").collect()}
    assert loose[1] == loose[2] == (None, "INCOMPLETE_FILING_HISTORY")


def test_control_changes(spark):
    old, inside = day("1990-01-01"), day("2000-06-01")
    rows = [
        (1, "a", old, inside, "AVAILABLE", False), (1, "a", old, inside, "AVAILABLE", False), (1, "b", old, inside, "AVAILABLE", False), (1, "c", old, day("1995-01-01"), "AVAILABLE", False),
        (2, "a", old, None, "NOT_APPLICABLE", True), (3, None, old, None, "NOT_APPLICABLE", False), (4, "a", inside, None, "NOT_APPLICABLE", False), (5, "a", old, None, "NOT_DISCLOSED", False),
        (6, "a", old, None, "NOT_APPLICABLE", False), (6, "a", old, inside, "AVAILABLE", False), (7, "a", None, None, "NOT_APPLICABLE", False), (8, "a", old, None, "NOT_APPLICABLE", False),
    ]
    df = spark.createDataFrame(rows, "company int, identity string, notified date, ceased date, cessation string, statement boolean")
    who = spark.createDataFrame([(k,) for k in range(1, 10)], "company int")
    got = {r["company"]: (r["value"], r["reason"]) for r in variables.control_changes(who, df, F.lit(AS_OF)).collect()}
    assert got == {1: (2.0, None), 8: (0.0, None), 9: (0.0, None)} | {k: (None, "AMBIGUOUS") for k in range(2, 8)}


def staged(chosen, rivals):
    """The conflict of one observation (id, company, concept, period, unit, value) by narrowing its competitors."""
    left = [r for r in rivals if r[0] != chosen[0]]
    for k, why in ((1, "NONE"), (2, "NONE"), (3, "PERIOD_DIFFERENCE"), (4, "UNIT_DIFFERENCE")):
        if left and not (left := [r for r in left if r[k] == chosen[k]]):
            return why
    return "SERIOUS" if any(r[5] is not None and r[5] != chosen[5] for r in left) else "NONE"


def test_conflicts_are_narrowed_in_stages(spark):
    rng = random.Random(6)
    chosen = (1, "me", "A", 2024, "GBP", 5)
    cases = {0: [], 1: [(2, "me", "A", 2024, "GBP", 5), (3, "me", "A", 2024, "USD", 9)], 2: [(2, "me", "A", 2024, "GBP", 5), (3, "me", "A", 2023, "GBP", 9)], 3: [(2, "you", "A", 2024, "GBP", 9)], 4: [(2, "me", "B", 2024, "GBP", 9)], 5: [(2, "me", "A", 2024, "GBP", None)]}
    for k in range(6, 300):
        cases[k] = [(rng.randrange(1, 5), rng.choice(["me", "me", "you"]), rng.choice("AAB"), rng.choice([2024, 2024, 2023, None]), rng.choice(["GBP", "GBP", "USD"]), rng.choice([5, 5, 9, None])) for _ in range(rng.randrange(5))]
    schema = "k int, observation_id int, company string, concept string, period int, unit string, value int"
    mine = spark.createDataFrame([(k, *chosen) for k in cases], schema)
    rivals = spark.createDataFrame([(k, *r) for k, v in cases.items() for r in v], schema)
    got = {r["k"]: r["conflict"] for r in validation.conflict_class(mine, rivals, ["k"]).collect()}
    assert got[1] == got[2] == "NONE" and set(got.values()) == {"NONE", "PERIOD_DIFFERENCE", "UNIT_DIFFERENCE", "SERIOUS"}
    assert got == {k: staged(chosen, v) for k, v in cases.items()}


@pytest.fixture(scope="module")
def assessment(spark):
    inputs = spark.createDataFrame([(1, "API", "STRUCTURED"), (2, "API", "STRUCTURED"), (3, "PDF", "OCR"), (4, "API", "UNSUPPORTED_MODEL"), (5, "RUMOUR", "TAGGED"), (6, "API", "STRUCTURED"), (7, "API", "STRUCTURED"), (8, "API", "STRUCTURED")], "k int, source string, transformation string")
    say = [
        (1, "a", "PASS", "ADMISSION", "NONE", None, None), (1, "s", "PASS", "SUPPORT", "MEANINGFUL", "g", None), (1, "t", "PASS", "SUPPORT", "MEANINGFUL", "h", None), (2, "a", "FAIL", "ADMISSION", "NONE", None, "BAD"),
        (2, "s", "PASS", "SUPPORT", "STRONG", "g", None), (3, "s", "FAIL", "SUPPORT", "STRONG", "g", None), (6, "s", "PASS", "SUPPORT", "STRONG", "g", None), (7, "a", "INCONCLUSIVE", "ADMISSION", "NONE", None, "MISSING_INPUT"),
    ]
    outcomes = spark.createDataFrame(say, "k int, rule_id string, result string, role string, strength string, independence_group string, failure_code string")
    conflicts = spark.createDataFrame([(6, "SERIOUS"), (1, "PERIOD_DIFFERENCE"), (8, "PARTIAL")], "k int, conflict string")
    return {r["k"]: r for r in validation.assessed(inputs, "k", outcomes, conflicts).collect()}


def test_composed_reliability(assessment):
    got = {k: (r["status"], r["failures"], r["support"], r["r"]) for k, r in assessment.items()}
    assert got == {
        1: ("PASS", [], "MEANINGFUL", Decimal("0.97914")), 2: ("FAIL", ["BAD"], "STRONG", 0), 3: ("PASS", [], "NONE", Decimal("0.8075")), 4: ("PASS", ["UNSUPPORTED_LLM_NUMERIC"], "NONE", 0),
        5: ("PASS", [], "NONE", None), 6: ("PASS", ["SERIOUS_UNRESOLVED_CONFLICT"], "STRONG", 0), 7: ("INCONCLUSIVE", ["MISSING_INPUT"], "NONE", 0), 8: ("PASS", [], "NONE", Decimal("0.9702") * Decimal("0.7")),
    }
    assert assessment[1]["groups"] == 2 and assessment[1]["support_reason"] == "MEANINGFUL from 2 groups: V=0.30"
    assert assessment[5]["source_reason"] == "unmapped source" and assessment[6]["conflict_reason"] == "SERIOUS: C=1.00"


def test_quotes_are_found_word_for_word(spark):
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(["a", "b", "c", "rare" if rng.random() < 0.05 else "d"]) for _ in range(n))
    docs = [(k, say(rng.randrange(0, 40)).replace(" b", rng.choice([" b", ", b", " b\n"]))) for k in range(60)] + [(60, None), (61, "a a a a"), (62, "")]
    claims = [(k, say(rng.randrange(1, 6))) for k in range(60)] + [(60, "..."), (61, None), (62, "a a"), (63, "nowhere a"), (64, "a")]
    import re

    split = lambda t: re.findall(r"[^\W_]+", t or "")
    want = {}
    for k, q in claims:
        w = split(q)
        places = [(d, i) for d, t in docs for i in range(len(split(t)) - len(w) + 1) if w and split(t)[i : i + len(w)] == w]
        n = len({d for d, _ in places})
        want[k] = (len(w), n, len(places), "EMPTY" if not w else "ABSENT" if not n else "GROUNDED" if n == 1 else "AMBIGUOUS")
    c, t = spark.createDataFrame(claims, "claim int, quote string"), spark.createDataFrame(docs, "doc_id int, text string")
    got = {r["claim"]: (r["words"], r["documents"], r["places"], r["status"]) for r in grounding.grounded(c, t).collect()}
    assert {w[3] for w in want.values()} == {"EMPTY", "ABSENT", "GROUNDED", "AMBIGUOUS"} and got == want


def test_amounts_are_found_as_printed(spark):
    docs = spark.createDataFrame([(1, "Net assets (1,234) and 5 678.50 in 2024, not 12a or 3.4.5"), (2, None)], "doc_id int, text string")
    claims = [(1, 1, "1234", True), (2, 1, "-1234", True), (3, 1, "5678.5", True), (4, 1, "12", False), (5, 1, "234", False), (6, 2, "1", False), (7, 1, "2024", True)]
    c = spark.createDataFrame([(k, d, Decimal(a)) for k, d, a, _ in claims], "claim int, doc_id int, amount decimal(20,4)")
    assert {r["claim"]: r["present"] for r in grounding.amounts_present(c, docs).collect()} == {k: x for k, _, _, x in claims}


CONTEXTS = """<x:context id="now"><x:entity><x:identifier scheme="s">7</x:identifier></x:entity><x:period><x:instant>2025-12-31</x:instant></x:period></x:context>
<x:context id='then'><x:entity><x:identifier scheme="s"> 7 </x:identifier><x:segment><d:explicitMember dimension="uk:B">uk:y</d:explicitMember><d:explicitMember dimension="uk:A">uk:x</d:explicitMember></x:segment></x:entity>
<x:period><x:startDate>2024-01-01</x:startDate><x:endDate>2024-12-31</x:endDate></x:period></x:context>"""
UNITS = '<x:unit id="GBP"><x:measure> iso4217:GBP </x:measure></x:unit><x:unit id="n"><x:measure>x:shares</x:measure></x:unit><x:unit id="r"><x:divide><x:measure>iso4217:GBP</x:measure><x:measure>x:shares</x:measure></x:divide></x:unit>'


def tag(body, context="now", unit="GBP", more="", end="</ix:nonFraction>"):
    return f'<ix:nonFraction name="uk:Cash" contextRef="{context}" unitRef="{unit}" {more}>{body}{end}'


def test_tagged_facts(spark):
    sound = CONTEXTS + UNITS
    docs = {
        1: sound + tag("<b>123</b>.<i>40</i>", more='scale="3" sign="-"') + tag("200,000", "then") + tag("5", unit="n") + tag("6", unit="r") + tag("", more='xsi:nil="true"') + tag("x") + tag("-", more="format='ixt:zerodash'"),
        2: sound + CONTEXTS.split("\n")[0].replace("2025", "2023") + tag("1"), 3: sound + UNITS + tag("1"), 4: sound + tag("1", "never"), 5: sound + tag("1", unit="EUR"), 6: sound.replace("2024-12-31", "end of 2024") + tag("1"),
        7: sound.replace(">7<", ">8<") + tag("1"), 8: sound.replace("</x:segment>", "<d:typedMember/></x:segment>") + tag("1", "then"), 9: sound + tag("1<ix:exclude>2</ix:exclude>"), 10: sound + tag("1", more='continuedAt="c"'),
        11: sound.replace("2025-12-31", "2025-13-01") + tag("1"), 12: "<p>nothing</p>", 13: None, 14: sound.replace('<x:identifier scheme="s">7</x:identifier>', "") + tag("1"), 15: sound + tag("1", unit="n", context="never"),
    }
    rows = documents.tagged_facts(spark.createDataFrame([(k, 7, v) for k, v in docs.items()], "document_id int, number long, content string")).collect()
    failures = {r["document_id"]: r["failure"] for r in rows if r["failed"]}
    assert failures == {
        2: "DUPLICATE_CONTEXT", 3: "DUPLICATE_UNIT", 4: "UNRESOLVED_REFERENCE", 5: "UNRESOLVED_REFERENCE", 6: "INVALID_PERIOD", 7: "OTHER_ENTITY", 8: "TYPED_DIMENSION", 9: "CONTINUED", 10: "CONTINUED", 11: "INVALID_PERIOD", 14: "MISSING_ENTITY",
        15: "UNRESOLVED_REFERENCE",
    }
    facts = [r for r in rows if not r["failed"]]
    assert {r["document_id"] for r in facts} == {1}
    got = [(r["context"], r["value"], r["reason"], r["availability"], r["period_type"], [tuple(x) for x in r["dimensions"]]) for r in facts]
    assert got == [
        ("now", Decimal(-123400), None, "AVAILABLE", "INSTANT", []), ("then", Decimal(200000), None, "AVAILABLE", "DURATION", [("uk:A", "uk:x"), ("uk:B", "uk:y")]), ("now", None, None, "NOT_DISCLOSED", "INSTANT", []),
        ("now", None, "NOT_A_NUMBER", "AVAILABLE", "INSTANT", []), ("now", Decimal(0), None, "AVAILABLE", "INSTANT", []),
    ]


def test_tagged_facts_read_a_document_once(spark):
    """A filter on sound documents was pushed into the reading, which then ran twice; amounts were worked out inside the array."""
    docs = spark.range(1).selectExpr("id AS document_id", "string(id) AS content")
    plan = documents.tagged_facts(docs).filter("not failed").groupBy("name").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"instant\b") == 1, plan
    pad = "<b>x</b>" * 20_000  # elements between start and end do not deepen the match
    got = documents.tagged_facts(spark.createDataFrame([(1, CONTEXTS + UNITS + tag("1" + pad.replace("x", "")))], "document_id int, content string")).first()
    assert got["value"] == 1


def test_mapping_by_sets_of_dimensions(spark):
    ab, ba, abc = [("d", "1"), ("e", "2")], [("e", "2"), ("d", "1")], [("d", "1"), ("e", "2"), ("f", "3")]
    pairs = "array<struct<dimension: string, member: string>>"
    rules = spark.createDataFrame([("n", ab, "X", -1), ("n", None, "Y", 1), ("m", [], "Z", 1), ("m", [], "W", 1)], f"source_concept string, dimensions {pairs}, concept string, sign int")
    facts = [(1, "n", ba, "INSTANT", "7"), (2, "n", abc, "INSTANT", "7"), (3, "n", [], "INSTANT", "7"), (4, "n", ab, "DURATION", "7"), (5, "n", ab, "INSTANT", "8"), (6, "m", None, "INSTANT", "7"), (7, "n", ab[:1], "INSTANT", "7"), (8, None, None, "INSTANT", "7")]
    df = spark.createDataFrame([(*f, 7, Decimal(5)) for f in facts], f"k int, name string, dimensions {pairs}, period_type string, entity string, number long, value decimal(20,4)")
    for most in (10_000, 0):
        got = {r["k"]: (r["concept"], r["mapping_status"], r["mapped_value"]) for r in evidence.mapped_facts(df, rules, most).collect()}
        assert got == {
            1: ("X", "MAPPED", Decimal(-5)), 2: (None, "UNMAPPED", None), 3: ("Y", "MAPPED", Decimal(5)), 4: (None, "WRONG_PERIOD", None), 5: (None, "OTHER_ENTITY", None), 6: (None, "AMBIGUOUS", None), 7: (None, "UNMAPPED", None), 8: (None, "UNMAPPED", None),
        }


def test_trend_needs_two_periods_of_one_kind(spark):
    rows = []
    for company, old, new in ((1, ("GBP", "COMPARABLE"), ("GBP", "COMPARABLE")), (2, ("EUR", "COMPARABLE"), ("GBP", "COMPARABLE")), (3, ("GBP", "REVIEW_REQUIRED"), ("GBP", "COMPARABLE"))):
        rows += [(company, day("1998-12-31"), Decimal(100), *old), (company, day("1999-12-31"), Decimal(80), *new), (company, day("2003-12-31"), Decimal(1), "GBP", "COMPARABLE")]
    schema = "company int, period_end date, value decimal(20,4), currency string, comparability string"
    facts = spark.createDataFrame(rows, schema).withColumns({"concept": F.lit("NET_ASSETS"), "unit": F.lit("GBP"), "period_type": F.lit("INSTANT")})
    who = spark.createDataFrame([(k,) for k in (1, 2, 3)], "company int")
    got = {r["company"]: (r["value"], r["reason"]) for r in variables.net_asset_trend(who, facts, F.lit(AS_OF)).collect()}
    assert got == {1: (-0.2, None), 2: (None, "INCOMPATIBLE_INPUTS"), 3: (None, "NON_COMPARABLE_PERIODS")}


def test_leaves_are_reproduced_from_their_inputs(spark):
    rows = [(1, "F2.2", 1.3, 0.6, 0.3, 0.3, 0.4), (2, "F2.2", 1.3, 0.7, 0.3, 0.3, 0.4), (3, "F2.2", None, 0.6, 0.0, 0.0, 1.0), (4, "F2.2", None, 0.6, 0.3, 0.3, 0.4), (5, "F9.9", 1.3, 0.6, 0.3, 0.3, 0.4), (6, "F2.2", 1.3, None, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "company int, code string, value double, r double, low double, high double, unknown double")
    assert {r["company"]: r["same"] for r in beliefs.reproduced(df, model.variables(spark)).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True}


def test_checksums_permutations_and_recomputed_amounts(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "")], "k int, content string")
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    known = spark.createDataFrame([(1, sha("a")), (2, sha("x")), (4, sha("d")), (5, sha(""))], "k int, checksum string")
    assert {r["k"]: r["verdict"] for r in evidence.verified(docs, known, "k").collect()} == {1: "VERIFIED", 2: "CHANGED", 3: "UNRECORDED", 4: "MISSING", 5: "VERIFIED"}
    parts = lambda d: spark.createDataFrame([(k, p) for k, v in d.items() for p in v], "k int, part string")
    told = documents.permuted(parts({1: "aab", 2: "ab", 3: "a"}), parts({1: "aba", 2: "abb", 4: "a"}), "k", "part")
    assert {r["k"]: (r["keeps_every_part_once"], r["lost"], r["added"]) for r in told.collect()} == {1: (True, 0, 0), 2: (False, 0, 1), 3: (False, 1, 0), 4: (False, 0, 1)}
    d = Decimal
    derived = spark.createDataFrame([(1, d(5), "x"), (2, d(5), "x"), (3, d(5), "x"), (4, d(5), "x"), (5, d(5), "y"), (6, None, "x")], "k int, value decimal(20,4), context string")
    of = spark.createDataFrame([(1, d(2), "x"), (1, d(3), "x"), (2, d("4.9999"), "x"), (3, None, "x"), (3, d(5), "x"), (5, d(5), "x"), (6, d(1), "x")], "k int, value decimal(20,4), context string")
    assert {r["k"]: r["verdict"] for r in validation.recomputed(derived, of, "k").collect()} == {1: "INTACT", 2: "BROKEN", 3: "COMPONENT_MISSING", 4: "NO_COMPONENTS", 5: "OTHER_CONTEXT", 6: "BROKEN"}


def test_readiness_by_company_and_period(spark):
    a, b = day("1999-12-31"), day("2000-12-31")
    rows = [(1, a, "NET_ASSETS", 1, "AVAILABLE"), (1, a, "TOTAL_ASSETS", 1, "AVAILABLE"), (1, b, "NET_ASSETS", 1, "AVAILABLE"), (1, b, "TOTAL_ASSETS", None, "NOT_DISCLOSED"), (2, b, "OTHER", 1, "AVAILABLE")]
    facts = spark.createDataFrame([(c, p, n, None if v is None else Decimal(v), x) for c, p, n, v, x in rows], "company int, period_end date, concept string, value decimal(20,4), availability string")
    who = spark.createDataFrame([(1,), (2,), (3,)], "company int")
    needs = {"F1.1": ("NET_ASSETS", "TOTAL_ASSETS"), "F1.2": ("NET_ASSETS",)}
    got = {(r["company"], r["period_end"], r["code"]): (r["present"], r["missing"], r["ready"], r["candidates"]) for r in derivation.readiness(who, facts, needs, ("F1.2", "NET_ASSETS")).collect()}
    assert got == {
        (1, None, "F1.1"): (2, "", True, None), (1, None, "F1.2"): (1, "", True, 2), (1, a, "F1.1"): (2, "", True, None), (1, b, "F1.1"): (1, "TOTAL_ASSETS", False, None), (2, None, "F1.1"): (0, "NET_ASSETS,TOTAL_ASSETS", False, None),
        (2, None, "F1.2"): (0, "NET_ASSETS", False, 0), (2, b, "F1.1"): (0, "NET_ASSETS,TOTAL_ASSETS", False, None), (3, None, "F1.1"): (0, "NET_ASSETS,TOTAL_ASSETS", False, None), (3, None, "F1.2"): (0, "NET_ASSETS", False, 0),
    }
