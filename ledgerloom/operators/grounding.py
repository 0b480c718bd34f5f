"""Grounding of claims in texts: a quote or label has to stand in a document, word for word; an amount as a printed number.

Texts become a positional index ``(document, place, token)``. A claim is looked for by its rarest word: each place of that word
proposes one place where the claim would begin, and the other words are looked up there by (document, place). Work
is proportional to the places of rarest words, not to claims times texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize

#: What a word is: letters and digits; what stands between does not matter.
WORD = r"[\p{L}\p{N}]+"
#: A printed number: digits, grouped by commas or spaces or not, with a fraction or without.
NUMBER = r"(?<![\w.,])[+-]?(?:\d{1,3}(?:(?:,\s*|[ \x{00a0}])\d{3})+|\d+)(?:\.\d+)?(?![\w.,]\w|\w)"


def tokens(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, place, token`` of every word, counted from 0; null and empty texts have none."""
    return rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("place", "token"))


def occurrences(claims: DataFrame, docs: DataFrame, claim: str = "claim", quote: str = "quote", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``claim, doc, start``: every place (in words) at which a claim's words stand one behind another."""
    words = tokens(claims, claim, quote).withColumnRenamed("place", "offset")
    index = materialize(tokens(docs, doc, text).join(words.select("token").distinct(), "token", "left_semi"), "places")
    often = index.groupBy("token").agg(F.count("*").alias("n"))
    # a word that stands nowhere has no places: its claim is absent
    rarest = words.join(often, "token", "left").groupBy(claim).agg(F.min_by(F.struct("token", "offset"), F.coalesce("n", F.lit(0))).alias("r"), F.count("*").alias("words"))
    begun = rarest.select(claim, "words", F.col("r.token").alias("token"), F.col("r.offset").alias("offset")).join(index, "token").select(claim, "words", doc, (F.col("place") - F.col("offset")).alias("start")).filter("start >= 0")
    looked = begun.join(words, claim).select(claim, "words", doc, "start", (F.col("start") + F.col("offset")).alias("place"), "token")
    met = looked.join(index, [doc, "place", "token"]).groupBy(claim, "words", doc, "start").agg(F.count("*").alias("n"))
    return met.filter("n = words").select(claim, doc, "start")


def verdicts(claims: DataFrame, found: DataFrame, claim: str = "claim", quote: str = "quote", doc: str = "doc_id") -> DataFrame:
    """Per claim its words, the documents and places it stands in, and ``GROUNDED`` (one document), ``AMBIGUOUS``, ``ABSENT`` or ``EMPTY``."""
    n = found.groupBy(claim).agg(F.count_distinct(doc).alias("documents"), F.count("*").alias("places"))
    words = F.coalesce(F.size(F.regexp_extract_all(quote, F.lit(WORD), F.lit(0))), F.lit(0))
    j = claims.select(claim, words.cast("long").alias("words")).join(n, claim, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("documents", "places")})
    status = F.when(F.col("words") <= 0, "EMPTY").when(F.col("documents") == 0, "ABSENT").when(F.col("documents") == 1, "GROUNDED").otherwise("AMBIGUOUS")
    return j.withColumn("status", status)


def grounded(claims: DataFrame, docs: DataFrame, claim: str = "claim", quote: str = "quote", doc: str = "doc_id", text: str = "text") -> DataFrame:
    return verdicts(claims, occurrences(claims, docs, claim, quote, doc, text), claim, quote, doc)


def amounts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, amount``: the distinct sizes of the numbers that are printed in a text."""
    printed = rows.select(key, F.explode(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))).alias("printed"))
    size = F.abs(F.regexp_replace("printed", r"[,\s\x{00a0}+]", "").try_cast("decimal(38,4)"))
    return printed.select(key, size.alias("amount")).filter("amount is not null").distinct()


def amounts_present(claims: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``claims`` (``claim, doc, amount``) with ``present``: the size of the amount is printed in the document that is cited."""
    there = amounts(docs, doc, text).select(doc, "amount", F.lit(True).alias("_there"))
    sized = claims.withColumn("amount", F.abs(F.col("amount").cast("decimal(38,4)")))
    return sized.join(there, [doc, "amount"], "left").withColumn("present", F.coalesce("_there", F.lit(False))).drop("_there")
