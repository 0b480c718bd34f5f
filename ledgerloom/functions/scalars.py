"""Column functions: identifiers, dates, money, normalisation, display. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of ten for the scale words printed next to amounts.
SCALE_WORDS = {"": 0, "units": 0, "000s": 3, "'000": 3, "'000s": 3, "000": 3, "thousand": 3, "thousands": 3, "k": 3, "million": 6, "millions": 6, "m": 6}


def company_number(value: Column) -> Column:
    """Trimmed, upper-case; digits are zero-padded to 8; null unless 8 letters or digits."""
    v = F.upper(F.trim(value))
    v = F.when(v.rlike("^[0-9]{1,8}$"), F.lpad(v, 8, "0")).otherwise(v)
    return F.when(v.rlike("^[A-Z0-9]{8}$"), v)


def strict_date(value: Column) -> Column:
    """Exactly YYYY-MM-DD, else null."""
    return F.when(value.rlike(r"^(?!0000)\d{4}-\d{2}-\d{2}\z"), value.try_cast("date"))


def months_before(day: Column, months: int) -> Column:
    """Calendar subtraction; a day that does not exist becomes the month's last."""
    return F.add_months(day, -months)


def printed_amount(raw: Column, unit: Column) -> Column:
    """A struct ``(value decimal(20,4), reason)`` of a printed amount and its unit label.

    Pound signs, GBP, spaces and commas are stripped; parentheses or a minus sign negate; a dash is
    not zero; other currencies and unknown unit labels are refused with a reason.
    """
    s = F.regexp_replace(F.coalesce(raw, F.lit("")), "[−–]", "-")
    s = F.regexp_replace(s, r"(?i)GBP|£|\s", "")
    negative = s.rlike(r"^\(.*\)$") | s.startswith("-")
    body = F.regexp_replace(s, r"^\(|\)$|^-", "")
    u = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(unit, F.lit("")), "(?i)GBP|£", ""), "[’‘]", "'")))
    scale = F.element_at(F.create_map(*(F.lit(x) for kv in SCALE_WORDS.items() for x in kv)), u)
    plain = body.rlike(r"^(\d{1,3}(,\d{3})+|\d+)(\.\d+)?$")
    foreign = s.rlike(r"[$€¥]|(?i)USD|EUR|JPY") | u.rlike(r"[$€¥]|(?i)usd|eur|jpy")
    number = F.regexp_replace(body, ",", "").try_cast("decimal(20,4)")
    signed = F.when(negative, -number).otherwise(number)
    value = F.when(plain & ~foreign & scale.isNotNull(), (signed * F.pow(F.lit(10.0), scale).cast("decimal(8,0)")).cast("decimal(20,4)"))
    reason = F.when(foreign, "FOREIGN_CURRENCY").when(body.isin("", "-"), "NO_AMOUNT").when(scale.isNull(), "UNKNOWN_UNIT").when(~plain, "NOT_A_NUMBER")
    return F.struct(value.alias("value"), reason.alias("reason"))


def tagged_amount(token: Column, scale: Column, sign: Column, zero_dash: Column) -> Column:
    """A struct ``(value decimal(38,18), reason)``: a strictly grouped number times a power of ten from -18 to 18, exactly.

    A dash is zero only with an explicit format flag. Nothing is rounded: what 20 digits before the point and 18 after it
    cannot hold has a reason instead of a value. Digits are counted, not moved; the power goes into the cast as an exponent.
    """
    t = F.trim(token)
    dash = zero_dash & t.isin("-", "–", "—")
    plain = t.rlike(r"^(\d{1,3}(,\d{3})+|\d+)(\.\d+)?$") | dash
    number = F.when(dash, F.lit("0")).otherwise(F.translate(t, ",\n\r\u0085\u2028\u2029", ""))  # the pattern allows a line to end behind the number
    digits = F.replace(number, F.lit("."), F.lit(""))
    behind = F.when(F.length(digits) == F.length(number), 0).otherwise(F.length(number) - F.instr(number, "."))
    first, last = F.length(F.ltrim(digits, F.lit("0"))), F.length(F.rtrim(digits, F.lit("0")))
    fits = (first == 0) | ((first - behind + scale <= 20) & (behind - scale - F.length(digits) + last <= 18))
    value = F.concat(F.when(sign == "-", "-").otherwise(""), number, F.lit("E"), scale.cast("string")).try_cast("decimal(38,18)")
    reason = F.when(~F.coalesce(plain, F.lit(False)), "NOT_A_NUMBER").when(~F.coalesce(scale.between(-18, 18), F.lit(False)), "UNSUPPORTED_SCALE").when(~fits, "OUT_OF_RANGE")
    return F.struct(F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def displayed_period(displayed: Column, filing_end: Column) -> Column:
    """An ISO date as it is; else the first 19xx or 20xx: the filing's own end if of that year, else 31 December."""
    year = F.regexp_extract(F.coalesce(displayed, F.lit("")), r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)", 1)
    year = F.when(year != "", year.cast("int"))
    by_year = F.when(F.year(filing_end) == year, filing_end).otherwise(F.make_date(year, F.lit(12), F.lit(31)))
    return F.coalesce(strict_date(displayed), F.when(year.isNotNull(), by_year))


def normalized_amount(concept: Column, label: Column, printed: Column, value: Column) -> Column:
    """Signed zero becomes zero; parenthesised creditors positive; net liabilities negative."""
    creditors = concept.isin("CURRENT_LIABILITIES", "NON_CURRENT_LIABILITIES") & printed.rlike(r"^\(.*\)$")
    net_liabilities = (concept == "NET_ASSETS") & F.lower(label).contains("net liabilities")
    return F.when(value == 0, F.lit(0).cast("decimal(20,4)")).when(creditors, F.abs(value)).when(net_liabilities, -F.abs(value)).otherwise(value)


def normalization_rule(before: Column, after: Column, concept: Column) -> Column:
    """One sentence on what normalisation did."""
    return (
        F.when(before.eqNullSafe(after), "unchanged")
        .when(before == 0, "signed zero read as zero")
        .when(concept == "NET_ASSETS", "net liabilities read as negative net assets")
        .otherwise("parenthesised creditors read as a positive liability")
    )


def scope_of_heading(context: Column) -> Column:
    """COMPANY or GROUP if the context is exactly one qualified heading, else UNRESOLVED."""
    lines = F.filter(F.split(F.coalesce(context, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    heading = F.lower(F.get(lines, F.lit(0)))
    group, company = heading.rlike(r"\b(consolidated|group)\b"), heading.rlike(r"\bcompany\b")
    return F.when(F.size(lines) != 1, "UNRESOLVED").when(group & ~company, "GROUP").when(company & ~group, "COMPANY").otherwise("UNRESOLVED")


def identity(*parts: Column) -> Column:
    """A deterministic id of ordered parts: of their JSON array, so that no separator can move and null is not empty."""
    return F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts)), {"ignoreNullFields": "false"}), 256)


def two_places(value: Column) -> Column:
    """Half-up to two decimals, "Unavailable" if missing."""
    return F.coalesce(F.round(value.cast("decimal(24,6)"), 2).cast("decimal(20,2)").cast("string"), F.lit("Unavailable"))


def subject_identity(resource_id: Column, self_link: Column, person: Column, role: Column, anchor: Column) -> Column:
    """The resource's id, else its link, else a hash of person, role and anchor date; never a name."""
    return F.coalesce(resource_id, self_link, F.when(person.isNotNull() & anchor.isNotNull(), identity(person, role, anchor)))


def availability(path: Column, present: Column, ceased_flag: Column, kind: Column) -> Column:
    """The status of a field of a registry item: absent end dates are not applicable unless the item says it ended."""
    return (
        F.when(present, "AVAILABLE")
        .when(path.isin("resigned_on", "ceased_on") & F.coalesce(ceased_flag, F.lit(False)), "NOT_DISCLOSED")
        .when(path.isin("resigned_on", "ceased_on"), "NOT_APPLICABLE")
        .when((path == "identification") & (kind == "individual"), "NOT_APPLICABLE")
        .otherwise("NOT_DISCLOSED")
    )
