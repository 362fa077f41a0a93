"""Text functions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

#: White space with the no-break space and the byte order mark.
SPACE = "[\\s\\u00a0\\ufeff]+"


def clean_text(s: Column, strip_tags: bool = False) -> Column:
    """White space collapsed and trimmed, blank to null; tags turned into spaces if asked."""
    s = F.regexp_replace(s, "<[^>]*>", " ") if strip_tags else s
    s = F.trim(F.regexp_replace(s, SPACE, " "))
    return F.when(s != "", s)


def decode_entities(s: Column, ampersand_first: bool = False) -> Column:
    """The basic entities, in a fixed order: with the ampersand first, `&amp;lt;` becomes `<`."""
    amp = [("&amp;", "&")]
    quotes = [("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")]
    for old, new in [*(amp if ampersand_first else []), *quotes, *([] if ampersand_first else amp), ("&lt;", "<"), ("&gt;", ">")]:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def _decomposed() -> tuple[str, str]:
    """Characters whose full canonical decomposition is a letter or digit of ASCII with marks, what they become, and the marks, which go."""
    letters = {}
    for point in range(0x80, 0x3000):
        bare = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", chr(point))).lower()
        if len(bare) == 1 and bare.isascii() and bare.isalnum():
            letters[chr(point)] = bare
    return "".join(letters) + "".join(map(chr, range(0x300, 0x370))), "".join(letters.values())


#: Worked out from the Unicode tables once: marks, written alone, have nothing that they become and are left out.
DECOMPOSED = _decomposed()


def normalize_for_compare(s: Column) -> Column:
    """Lower-cased, without the marks that letters decompose into, runs of anything but a-z and 0-9 as one space.

    A letter that doesn't decompose (as the Polish l with a stroke) is none of a-z.
    """
    return F.trim(F.regexp_replace(F.translate(F.lower(s), *DECOMPOSED), "[^a-z0-9]+", " "))


def same_name(a: Column, b: Column) -> Column:
    """Whether two names are equal but for case and accents, in whatever script, by Unicode's collation."""
    return F.collate(F.trim(a), "UNICODE_CI_AI") == F.collate(F.trim(b), "UNICODE_CI_AI")


def srcset_urls(s: Column) -> Column:
    """The URLs of a srcset, without their descriptors."""
    first = lambda p: F.regexp_extract(p, r"^\s*(\S+)", 1)
    return F.filter(F.transform(F.split(s, ","), first), lambda u: u != "")


def sanitize_domain(h: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(h), "[^a-z0-9.-]", "-"), "-+", "-")
    s = F.regexp_replace(s, "^[-.]+|[-.]+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "unknown-domain").otherwise(s)


def sanitize_segment(s: Column, fallback: Column | str = "item") -> Column:
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    s = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9_-]+", "-"), "-+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 40)
    return F.when(F.coalesce(s, F.lit("")) == "", fallback).otherwise(s)


def ext_from_content_type(c: Column) -> Column:
    c, found = F.lower(c), None
    for part, ext in (("jpeg", "jpg"), ("jpg", "jpg"), ("png", "png"), ("webp", "webp"), ("gif", "gif"), ("avif", "avif"), ("svg", "svg")):
        found = F.when(c.contains(part), ext) if found is None else found.when(c.contains(part), ext)
    return found.otherwise("jpg")


def run_id(ts: Column, domain: Column, seed: Column) -> Column:
    """``yyyymmddthhmmssz-domain-suffix``; the suffix is a hash of the seed."""
    return F.concat_ws("-", F.date_format(ts, "yyyyMMdd't'HHmmss'z'"), sanitize_domain(domain), F.substring(F.sha2(seed.cast("string"), 256), 1, 8))


def image_label(alt: Column, u: Column, source: Column) -> Column:
    """The alternative text, else the file name without its ending, else the source, as a segment."""
    base = F.regexp_replace(F.regexp_extract(u, r"([^/?#]+)(?:[?#].*)?$", 1), r"\.[A-Za-z0-9]+$", "")
    return F.coalesce(*[F.when(sanitize_segment(x, "") != "", sanitize_segment(x, "")) for x in (alt, base, source)], F.lit("image"))


def redact_credentials(s: Column) -> Column:
    """Mask user and password in URLs inside a text."""
    return F.regexp_replace(s, r"([A-Za-z][A-Za-z0-9+.\-]*://)[^/@\s]+@", "$1***@")


def retry_after_seconds(s: Column, as_of: Column) -> Column:
    """Seconds, or the time from ``as_of`` to an HTTP date, not under 0; null for anything else."""
    trimmed = F.trim(s)
    date = F.try_to_timestamp(F.regexp_extract(trimmed, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    until = F.when(date.isNotNull(), F.greatest(F.lit(0), F.unix_timestamp(date) - F.unix_timestamp(as_of)))
    return F.when(trimmed.rlike(r"^\d{1,9}$"), trimmed.cast("long")).otherwise(until)


def clamp_params(v: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(v, F.lit(default))))


def email_normalize(*candidates: Column) -> Column:
    """The first that isn't null, trimmed and lower-cased."""
    return F.lower(F.trim(F.coalesce(*candidates)))
