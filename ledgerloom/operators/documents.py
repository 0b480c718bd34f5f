"""Documents as tables: tagged facts, visible text, headings, positioned words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import strict_date, tagged_amount



def _element(name: str, start: str = "") -> str:
    """A pattern of elements ``name`` under any prefix, up to the first end tag; what lies inside is passed from tag to tag."""
    return rf"<(?:\w+:)?{name}\b{start}[^<]*+(?:<(?!/(?:\w+:)?{name}>)[^<]*+)*+</(?:\w+:)?{name}>"


# Attributes are in either quotes.
_TAG = _element("nonFraction", "[^>]*+>") + r"|<(?:\w+:)?nonFraction\b[^>]*/>"
_CONTEXT, _UNIT, _MEMBER = (_element(n) for n in ("context", "unit", "explicitMember"))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute of an element's own start tag; empty if there is none."""
    return F.regexp_extract(tag, rf"""^<[^>]*?[\s:]{name}\s*=\s*["']([^"']*)["']""", 1)


def _inside(element: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(element, rf"(?s)<(?:\w+:)?{name}\b[^>]*>([^<]*)<", 1))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once: a lambda variable is, an expression inside a lambda is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _context(c: Column) -> Column:
    def read(x: Column) -> Column:
        c, instant = x["c"], x["instant"]
        element = F.regexp_extract_all(c, F.lit(_MEMBER), F.lit(0))
        members = F.transform(element, lambda m: F.struct(_attribute(m, "dimension").alias("dimension"), F.trim(F.regexp_extract(m, ">([^<]*)<", 1)).alias("member")))
        # most contexts have no members, and patterns cost more than a look for a word
        members = F.when(F.contains(c, F.lit("explicitMember")), F.array_sort(members)).otherwise(F.array().cast("array<struct<dimension: string, member: string>>"))
        typed = F.contains(c, F.lit("typedMember")) & c.rlike(r"<(?:\w+:)?typedMember\b")
        start = F.when(instant == "", _once(_inside(c, "startDate"), strict_date))
        end = _once(F.when(instant != "", instant).otherwise(_inside(c, "endDate")), strict_date)
        return F.struct(
            _attribute(c, "id").alias("id"), F.when(instant != "", "INSTANT").otherwise("DURATION").alias("period_type"), start.alias("period_start"),
            end.alias("period_end"), _inside(c, "identifier").alias("entity"), members.alias("dimensions"), typed.alias("typed"),
        )

    return _once(F.struct(c.alias("c"), _inside(c, "instant").alias("instant")), read)


def _unit(u: Column) -> Column:
    """The currency of a unit of one measure in it; others (shares, ratios) have none."""
    measures = F.regexp_extract_all(u, F.lit(r"<(?:\w+:)?measure\b[^>]*>\s*([^<]*?)\s*<"), F.lit(1))
    iso = r"^iso4217:([A-Z]{3})$"
    currency = _once(measures, lambda m: F.when((F.size(m) == 1) & F.get(m, F.lit(0)).rlike(iso), F.regexp_extract(F.get(m, F.lit(0)), iso, 1)))
    return F.struct(_attribute(u, "id").alias("id"), currency.alias("currency"))


_ATTRIBUTES = r"""(?:^|[\s:])(\w++)\s*+=\s*+["']([^"']*+)["']"""


def _of(tag: Column, name: str) -> Column:
    """An attribute of what :func:`_tag` read; empty if there is none."""
    return F.coalesce(F.get(tag["values"], (F.array_position(tag["names"], name) - 1).cast("int")), F.lit(""))


def _tag(t: Column) -> Column:
    """A tag with its attributes, all found in two passes over its start, and what its document is judged by."""
    start = F.regexp_extract(t, "^<([^>]*)>", 1)
    found = lambda x, k: F.regexp_extract_all(x, F.lit(_ATTRIBUTES), F.lit(k))

    def read(x: Column) -> Column:
        cut = (F.array_contains(x["names"], "continuedAt") & (_of(x, "continuedAt") != "")) | (F.contains(x["t"], F.lit("exclude")) & x["t"].rlike(r"<(?:\w+:)?exclude\b"))
        return F.struct(x["t"].alias("t"), x["names"].alias("names"), x["values"].alias("values"), _of(x, "contextRef").alias("context"), _of(x, "unitRef").alias("unit"), cut.alias("cut"))

    return _once(start, lambda s: _once(F.struct(t.alias("t"), found(s, 1).alias("names"), found(s, 2).alias("values")), read))


def _repeated(items: Column) -> Column:
    ids = F.transform(items, lambda x: x["id"])
    return (F.size(F.array_distinct(ids)) < F.size(ids)) | F.array_contains(ids, "")


def _failure(d: Column, money: Column) -> Column:
    return (
        F.when(d["contexts"], "DUPLICATE_CONTEXT").when(d["units"], "DUPLICATE_UNIT").when(d["periods"], "INVALID_PERIOD")
        .when(F.exists(d["each"], lambda x: x["c"].isNull() | x["u"].isNull()), "UNRESOLVED_REFERENCE")
        .when(F.exists(money, lambda x: x["c"]["entity"] == ""), "MISSING_ENTITY")
        .when(F.coalesce(F.exists(money, lambda x: x["c"]["entity"] != d["number"]), F.lit(False)), "OTHER_ENTITY")
        .when(F.exists(money, lambda x: x["c"]["typed"]), "TYPED_DIMENSION").when(F.exists(money, lambda x: x["t"]["cut"]), "CONTINUED")
    )


def tagged_facts(documents: DataFrame) -> DataFrame:
    """Monetary tags of inline-tagged XHTML (``document_id, content`` and, if entities are to be checked, ``number``).

    A row per fact: its name, context with entity, period and sorted dimensions, currency, exact value or the reason that there is
    none. Nil facts are NOT_DISCLOSED; tags in other units than currencies are no facts. A document fails as a whole, with one
    row and its ``failure``: repeated or nameless contexts or units, a reference that does not resolve, a period that is no
    date, another entity, typed dimensions, continued or excluded text.

    A document is read in one pass, where it lies: nothing is joined or shuffled.
    """
    elements = lambda pattern, read: F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), read)
    number = F.col("number").cast("string") if "number" in documents.columns else F.lit(None).cast("string")
    read = F.struct(elements(_CONTEXT, _context).alias("contexts"), elements(_UNIT, _unit).alias("units"), elements(_TAG, _tag).alias("tags"), number.alias("number"))

    def resolved(d: Column) -> Column:
        named = lambda items, key: F.get(F.filter(items, lambda x: x["id"] == key), F.lit(0))
        each = F.transform(d["tags"], lambda t: F.struct(t.alias("t"), named(d["contexts"], t["context"]).alias("c"), named(d["units"], t["unit"]).alias("u")))
        return F.struct(d["number"].alias("number"), (_repeated(d["contexts"])).alias("contexts"), (_repeated(d["units"])).alias("units"), F.exists(d["contexts"], lambda c: c["period_end"].isNull() | ((c["period_type"] == "DURATION") & c["period_start"].isNull())).alias("periods"), each.alias("each"))

    def judged(d: Column) -> Column:
        return _once(F.struct(d.alias("d"), F.filter(d["each"], lambda x: x["u"]["currency"].isNotNull()).alias("money")), lambda x: _once(F.struct(_failure(x["d"], x["money"]).alias("failure"), x["money"].alias("money")), facts))

    def facts(d: Column) -> Column:
        each = F.transform(d["money"], lambda x: F.struct(x["t"].alias("tag"), x["u"]["currency"].alias("currency"), x["c"].alias("c")))
        return F.struct(d["failure"].alias("failure"), F.when(d["failure"].isNull(), each).alias("facts"))

    rows = documents.select("document_id", _once(_once(read, resolved), judged).alias("d")).select("document_id", F.col("d.failure").alias("failure"), F.explode_outer("d.facts").alias("f"))
    # a filter on ``failed`` has to stay above the explode: pushed below, it would read the document once more
    # the facts of sound documents are read as rows: inside the array everything would be worked out anew wherever it is used
    tag, c = F.col("f.tag"), F.col("f.c")
    body = F.regexp_extract(tag["t"], r"(?s)^<[^>]*>(.*)</[^>]*>$", 1)
    rows = rows.filter("failure is not null or f is not null").select(
        "document_id", "failure", F.col("f").isNull().alias("failed"), F.when(tag.isNotNull(), _of(tag, "name")).alias("name"), tag["context"].alias("context"), F.col("f.currency").alias("currency"),
        *(c[x].alias(x) for x in ("entity", "dimensions", "period_type", "period_start", "period_end")), F.trim(F.regexp_replace(body, "<[^>]*>", "")).alias("raw"),
        F.when(tag.isNotNull(), _of(tag, "nil").isin("true", "1")).alias("nil"), _of(tag, "scale").alias("scale"), _of(tag, "sign").alias("sign"), _of(tag, "format").rlike("(zerodash|zero-dash|fixed-zero)$").alias("dash"),
    )
    rows = rows.withColumn("amount", F.when(~F.col("nil"), tagged_amount(F.col("raw"), F.when(F.col("scale") == "", 0).otherwise(F.col("scale").try_cast("int")), F.col("sign"), F.col("dash"))))
    nil = F.col("nil")
    return rows.withColumns({
        "value": F.when(~nil, F.col("amount.value")), "reason": F.when(nil & (F.col("raw") != ""), "NIL_WITH_VALUE").when(~nil, F.col("amount.reason")),
        "availability": F.when(nil, "NOT_DISCLOSED").when(~nil, "AVAILABLE"),
    }).drop("amount", "nil", "scale", "sign", "dash")


def visible_text(html: Column) -> Column:
    """Without scripts, styles and tags; white space collapsed."""
    t = F.regexp_replace(html, r"(?s)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def permuted(plan: DataFrame, told: DataFrame, key: str, part: str) -> DataFrame:
    """Per key whether ``told`` has exactly the parts of ``plan``, each as often, in whatever order; how many it lost and added.

    Parts of both are counted by (key, part) before they meet.
    """
    both = plan.select(key, part, F.lit(1).alias("_d")).unionByName(told.select(key, part, F.lit(-1).alias("_d")))
    each = both.groupBy(key, part).agg(F.sum("_d").alias("_d"))
    n = each.groupBy(key).agg(F.sum(F.greatest("_d", F.lit(0))).alias("lost"), F.sum(F.greatest(-F.col("_d"), F.lit(0))).alias("added"))
    return n.select(key, ((F.col("lost") == 0) & (F.col("added") == 0)).alias("keeps_every_part_once"), "lost", "added")


def period_roles(facts: DataFrame) -> DataFrame:
    """CURRENT for the latest period of a document, COMPARATIVE for all before."""
    latest = F.max("period_end").over(Window.partitionBy("document_id"))
    return facts.withColumn("role", F.when(F.col("period_end") == latest, "CURRENT").otherwise("COMPARATIVE"))


def heading_context(lines: DataFrame, keys: list[str], order: str, is_heading: Column) -> DataFrame:
    """Each line with the last heading above it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("heading", F.last(F.when(is_heading, F.col("line")), ignorenulls=True).over(w))


def assembled_lines(words: DataFrame, keys: list[str], tolerance: float = 3.0) -> DataFrame:
    """Positioned words (y, x, word) to lines: a new line starts where y is over ``tolerance`` from that of the line's first word.

    The anchor is the line's first word, not the word before, which no window function can follow; one
    page's words are folded in an array.
    """
    page = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "x", "word"))).alias("words"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"), F.expr("cast(array() as array<struct<line:int,y:double,x:double,word:string>>)").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        new = acc["anchor"].isNull() | (w["y"] - acc["anchor"] > tolerance)
        line = F.when(new, acc["line"] + 1).otherwise(acc["line"])
        row = F.struct(line.alias("line"), w["y"].alias("y"), w["x"].alias("x"), w["word"].alias("word"))
        return F.struct(F.when(new, w["y"]).otherwise(acc["anchor"]).alias("anchor"), line.alias("line"), F.concat(acc["out"], F.array(row)).alias("out"))

    rows = page.select(*keys, F.explode(F.aggregate("words", start, step)["out"]).alias("w"))
    lines = rows.groupBy(*keys, F.col("w.line").alias("line")).agg(F.array_sort(F.collect_list(F.struct("w.x", "w.word"))).alias("ws"))
    return lines.select(*keys, F.col("line").cast("long").alias("line"), F.array_join(F.transform("ws", lambda x: x["word"]), " ").alias("text"))


def banded(words: DataFrame, bands: DataFrame, keys: list[str], share: float = 0.75, slack: float = 18.0) -> DataFrame:
    """Per band (keys, band, right, spacing) the number of words whose right edge lies in it, and the word if it is the only one."""
    j = bands.join(words, keys).filter((F.col("x") > F.col("right") - share * F.col("spacing")) & (F.col("x") <= F.col("right") + slack))
    n = j.groupBy(*keys, "band").agg(F.count("*").alias("n"), F.max("word").alias("word"))
    return bands.select(*keys, "band").join(n, [*keys, "band"], "left").select(*keys, "band", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n") == 1, F.col("word")).alias("word"))


def greedy_fit(pages: DataFrame, key: str, limit: int, most: int) -> DataFrame:
    """Ranked pages (rank, page, size) chosen greedily: at most ``most`` within ``limit`` characters, skipping any that would not fit."""
    ranked = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "page", "size"))).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<bigint>)").alias("pages"))

    def step(acc: Column, p: Column) -> Column:
        fits = (F.size(acc["pages"]) < most) & (acc["used"] + p["size"] <= limit)
        return F.struct(F.when(fits, acc["used"] + p["size"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["pages"], F.array(p["page"]))).otherwise(acc["pages"]).alias("pages"))

    chosen = F.aggregate("p", start, step)
    return ranked.select(key, chosen["used"].alias("used"), F.array_join(chosen["pages"], ",").alias("pages"))


def line_columns(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows of assembled lines: the label's concept with the numbers that follow it, in order."""
    numbers = F.regexp_extract_all("text", F.lit(r"(?:^| )(\(?\d[\d,]*(?:\.\d+)?\)?)(?= |$)"), F.lit(1))
    return lines.join(F.broadcast(labels), F.substring_index("text", " ", 1) == F.col("label")).withColumn("numbers", numbers)


def asset_side(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per segment (kind ITEM or SUBTOTAL, position, amount) whether it is a complete asset side: items known, one subtotal, after them, and equal to their sum."""
    n = rows.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "SUBTOTAL").alias("subtotals"), F.bool_and(F.col("known")).alias("known"), F.sum(F.when(F.col("kind") == "ITEM", F.col("amount"))).alias("total"),
        F.max(F.when(F.col("kind") == "SUBTOTAL", F.col("amount"))).alias("subtotal"), F.max(F.when(F.col("kind") == "ITEM", F.col("position"))).alias("last_item"), F.min(F.when(F.col("kind") == "SUBTOTAL", F.col("position"))).alias("at"),
    )
    why = F.when(F.col("subtotals") != 1, "NO_SINGLE_SUBTOTAL").when(~F.col("known"), "UNKNOWN_ROW").when(F.col("last_item") > F.col("at"), "ROW_AFTER_SUBTOTAL").when(~F.col("total").eqNullSafe(F.col("subtotal")), "SUM_DIFFERS")
    return n.select(*keys, F.coalesce(why, F.lit("COMPLETE")).alias("verdict"))
