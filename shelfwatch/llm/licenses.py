"""License scans by canonical digests: whole texts, and whole lines, looked up among known licences.

Case, punctuation, white space, copyright lines and equivalent spellings don't count. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import sized
from .license_texts import LICENSES, NOTICES

# Spellings that the public matching guidelines for licences hold equivalent.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
#: The same for spellings of two words.
PHRASES = {"copyright owner": "copyright holder", "non commercial": "noncommercial", "per cent": "percent", "sub license": "sublicense"}

# A notice names a year or a holder. Words that make a clause of what begins with 'copyright':
_CLAUSE = (
    r"a|acts?|and|any|applies|as|claims?|conditions?|disclaimers?|doctrines?|for|grants?|holders?|if|in|including|information|infringements?|interests?|is|it|laws?|"
    r"licen[sc]e[sd]?|licensors?|may|materials?|notices?|of|on|or|owners?|owned|patents?|permissions?|protection|registrations?|rights?|shall|status|statements?|terms?|"
    r"that|the|this|to|trademarks?|treat(?:y|ies)|under|with|works?"
)
_GRANT = (
    r"(?:permission\s+is\s+(?:hereby\s+)?granted|permission\s+to\s+use|redistribution\s+and\s+use|this\s+software\s+is\s+provided|everyone\s+is\s+permitted)"
)
_BREAK = r"\n[^\S\n]*\n"
_INSIDE = rf"(?:(?!{_BREAK})[\s\S])"
_SIGN = r"(?:copyright\s*(?::|\(c\)|©|by\b|[<\[]?(?:\d{4}|year|yyyy|19yy))|\(c\)\s*(?:copyright|\d{4})|©)"
_MAYBE = rf"(?:copyright(?![\p{{L}}\p{{N}},;.)\"'“”’])(?!\s+(?:{_CLAUSE})(?![\p{{L}}\p{{N}}]))|\(c\))"
_BLANK = r"copyright\s+(?:\(c\)\s+)?[<\[]?(?:year|yyyy|19yy)[>\]]?,?\s+[<\[]?(?:name\s+of\s+(?:the\s+)?(?:author|copyright\s+(?:owner|holder))|your\s+name)[>\]]?"
#: What doesn't count in a text: blank forms of notices; notices before a grant; paragraphs and lines that are notices.
NOTICE = "|".join((
    _BLANK,
    rf"(?:(?:\A|{_BREAK})\s*)?{_SIGN}{_INSIDE}{{0,400}}?(?={_GRANT})",
    rf"(?:\A|{_BREAK})\s*(?:{_SIGN}|{_MAYBE}){_INSIDE}{{0,200}}(?={_BREAK}|\z)",
    rf"(?m:^){_SIGN}[^\n]*",
    r"all\s+rights\s+reserved(?:\.|(?=[^\p{L}\p{N}\n]*(?m:$)))",
))
#: Comment signs and indents in front of lines.
LEADER = r"(?m)^[^\p{L}\p{N}\n(©<\[]+"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical_words(text: Column) -> Column:
    """The lower-cased and respelled words with one space between; '' for a null text."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")
    variants = F.array(*map(F.lit, SPELLINGS))
    respelled = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    # The words are looked up one by one only where the text has a variant at all.
    found = F.when(F.arrays_overlap(found, variants), F.transform(found, lambda w: F.coalesce(F.element_at(respelled, w), w))).otherwise(found)
    return F.array_join(found, " ")


def canonical(text: Column) -> Column:
    """The words of a text that count: without copyright notices, lower-cased and respelled; '' for a null text.

    A paragraph of up to 200 characters that begins with a notice is one, as is a line; in front of a grant notices are
    known wherever they stand. So the form doesn't depend on how a licence is wrapped.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    told = F.contains(lowered, F.lit("copyright")) | F.contains(lowered, F.lit("(c)")) | F.contains(lowered, F.lit("©")) | F.contains(lowered, F.lit("reserved"))
    found = canonical_words(F.when(told, F.regexp_replace(F.regexp_replace(lowered, LEADER, ""), NOTICE, "\n\n")).otherwise(lowered))
    for phrase, same in PHRASES.items():
        found = F.replace(found, F.lit(phrase), F.lit(same))
    return found


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def line_digest(line: Column) -> Column:
    return F.sha2(canonical_words(line), 256)


def known_digests(spark: SparkSession, texts: dict[str, str] | list[tuple[str, str]], of=digest) -> DataFrame:
    """Named texts -> (digest, license_id); of texts with one digest the first name in order counts."""
    rows = list(texts.items()) if isinstance(texts, dict) else list(texts)
    known = spark.createDataFrame(rows, "license_id string, text string")
    return known.groupBy(of(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame | None = None, notices: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, digest, license_id, notices), a row for each input row.

    license_id names the known licence that the entire text is (null: none). ``notices`` names the licences
    that a whole line of the text grants, sorted and joined by commas ('' if none); rows that share a doc_id
    share their notices, and rows without a doc_id have none. A null or empty text has the digest of no words
    and no licence. Other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    licenses = sized(licenses if licenses is not None else known_digests(spark, LICENSES))
    notices = sized(notices if notices is not None else known_digests(spark, NOTICES, line_digest))
    whole = docs.select("doc_id", digest(F.col("text")).alias("digest")).join(licenses, "digest", "left")
    lines = docs.where("doc_id is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    granted = lines.select("doc_id", line_digest(F.col("line")).alias("digest")).join(notices, "digest")
    granted = granted.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("notices"))
    found = whole.join(granted, "doc_id", "left")
    return found.select("doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))
