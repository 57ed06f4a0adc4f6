"""License scans by lookup of canonical digests.

A whole text is made canonical (lower case, no copyright lines, one spelling of
equivalent words, punctuation and white space as single spaces) and its digest
is looked up among those of known licence texts, treated the same way.

Only DataFrame functions are used; the known digests are joined by hash, and
broadcast by Spark where their size allows it.

Defined results: null or empty text, and a text of punctuation and copyright
lines alone, is canonically empty and matches nothing; a null doc_id is kept;
repeated rows are looked up each; where known licences have equal digests, their
names are sorted and joined by commas; with no known licences nothing matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import KNOWN

# Spellings that count as equal when licences are compared, first the one replaced.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "copyright owner": "copyright holder", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "non-commercial": "noncommercial", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "sub-license": "sublicense", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "wilfull", "willful": "wilfull",
}
#: Lines that only name holders and years, or reserve rights.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n©]*(?:copyright(?:[ \t]*(?:\(c\)|©|[0-9])| by |$)|\(c\)|©|all rights reserved)[^\n]*$"
#: Stands before the query's own copies of the known texts.
PLANTED = "Copyright (c) 2020 The Authors\n\n"
BETWEEN = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
ANY_SPELLING = r"\b(?:" + "|".join(SPELLINGS) + r")\b"


def canonical(text: Column) -> Column:
    lines = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    same = lines
    for old, new in SPELLINGS.items():
        same = F.regexp_replace(same, rf"\b{old}\b", new)
    same = F.when(lines.rlike(ANY_SPELLING), same).otherwise(lines)
    return F.trim(F.regexp_replace(same, BETWEEN, " "))


def digests(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_canonical (code points) and digest (null for an empty canonical text)."""
    made = rows.select(F.col(key).alias(key), canonical(F.col(text)).alias("c"))
    return made.select(key, F.length("c").cast("long").alias("n_canonical"), F.when(F.col("c") != "", F.sha2(F.col("c").cast("binary"), 256)).alias("digest"))


def known_licenses(spark) -> DataFrame:
    """license, text of the licences and notices that come with the library."""
    return spark.createDataFrame(sorted((name, text) for name, texts in KNOWN.items() for text in texts), "license string, text string")


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, n_canonical, digest, license (null: none) of every document."""
    names = digests(known.filter("license is not null"), "license", "text").filter("digest is not null")
    names = names.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("license"))
    of = digests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")
    return of.join(names, "digest", "left").select("doc_id", "n_canonical", "digest", "license")
