"""The functions and the element table for Spark SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.html import page_elements
from . import urlstandard

#: Bodies by name and arguments, as Spark SQL. ``url_resolve`` gives what ``urls.url_resolve`` does, and so on.
FUNCTIONS = {
    "url_standard(u STRING) RETURNS STRING": urlstandard.STANDARD,
    "host_standard(h STRING) RETURNS STRING": urlstandard.HOST,
    "url_resolve(raw STRING, base STRING) RETURNS STRING": f"transform(transform(array(named_struct('raw', raw, 'base', transform(array(base), u -> {urlstandard.STANDARD})[0])), r -> {urlstandard.JOIN}), u -> {urlstandard.STANDARD})[0]",
    "url_host(u STRING) RETURNS STRING": f"regexp_extract(transform(array(u), u -> {urlstandard.STANDARD})[0], '^[a-z]+://(?:[^/@]*@)?(\\\\[[^\\\\]]*\\\\]|[^/:]*)', 1)",
    "hamming(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
}


@udtf(returnType="ord int, last int, parent int, tag string, attrs map<string,string>, text string")
class HtmlElements:
    """``html_elements(html, tags)`` behind LATERAL: the elements of a page whose tags are listed, with commas between."""

    def eval(self, html: str | None, tags: str) -> Iterator[tuple]:
        rows, said = page_elements(html or "", frozenset(t.strip() for t in (tags or "").lower().split(",")))
        for r in rows:
            text = said[r["start"] : r["start"] + r["length"]].decode()
            yield r["ord"], r["last"], r["parent"], r["tag"], dict(r["attrs"]), text


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udtf.register("html_elements", HtmlElements)
