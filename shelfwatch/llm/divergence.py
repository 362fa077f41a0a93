"""How far the sources of a language differ in their words, in exact whole numbers.

Terms are cut once and stored by language. A CountVectorizer for each language, with a least number of documents and no
bound on the vocabulary, finds the terms; put in byte order they give exact sparse vectors of documents, whose indices and
values are summed by group, within a task first. The sums are stored. Terms are numbers until the end. A pair of groups is
evaluated on the terms that one of them has: what both lack is one difference times a number of terms, what one lacks
needs only how often each value occurs in the other, and what both have is joined by term.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_folder
from .common import ascii_lower, cut_lineage, sized

MIN_DOCS = 30
#: The vocabulary's largest possible size: no term is left out.
ANY_SIZE = 2**31 - 1
#: Parts per whole of a share, and what is added to each count.
WHOLE, ADDED = 1_000_000_000, 5
TOP = 50
#: Sums that a task holds before it sends them.
MOST = 4_000_000
_BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _lowered(text: Column) -> Column:
    """A-Z lower-cased; the quicker function where it does the same, because no other letter has a lower case."""
    same = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(r"[\x{80}-\x{10ffff}&&[\p{IsUppercase}\p{Lt}\p{Cn}]]")
    return F.when(same, F.lower(text)).otherwise(ascii_lower(text))


def termed(docs: DataFrame, langs: list[str]) -> DataFrame:
    """(lang, source, text, ...) -> (source, said, part): terms joined by spaces, of documents of ``langs`` that have some, stored by language.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; ``part`` is the place in ``langs``, from 1.
    """
    rows = _read(docs).withColumn("part", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int")).where("part > 0")
    said = F.trim(F.regexp_replace(_lowered(F.coalesce("text", F.lit(""))), _BREAK, " "))
    folder = shared_folder(docs.sparkSession, "terms")
    rows.select("source", said.alias("said"), "part").write.partitionBy("part").option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema("source string, said string, part int").parquet(folder).where("said <> ''")


def _read(docs: DataFrame) -> DataFrame:
    """(lang, source, text), null languages and sources as ''."""
    return docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")


def _fitted(rows: DataFrame, min_docs: int) -> CountVectorizerModel | None:
    """The language's model, its terms in byte order; None where no term is in enough documents."""
    found = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=ANY_SIZE).fit(rows).vocabulary
    return CountVectorizerModel.from_vocabulary(sorted(found, key=str.encode), "terms", "vector") if found else None


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, source, indices, values) -> (part, source, at, n), summed up within the task until there are MOST sums."""
    groups: dict[tuple[int, str], int] = {}
    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)

    def rows() -> pa.RecordBatch:
        names, which = list(groups), pa.array(keys >> 32)
        columns = [pa.array([n[k] for n in names], kind).take(which) for k, kind in enumerate((pa.int32(), pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)], ["part", "source", "at", "n"])

    for batch in batches:
        own = [groups.setdefault(g, len(groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        which = np.repeat(np.array(own, np.int64), batch.column(2).value_lengths().to_numpy())
        new = which << 32 | batch.column(2).flatten().to_numpy()
        keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([sums, batch.column(3).flatten().to_numpy()]), minlength=len(keys)).astype(np.int64)
        if len(keys) > MOST:
            yield rows()
            groups, keys, sums = {}, keys[:0], sums[:0]
    if len(keys):
        yield rows()


def group_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, source, text, ...) -> (part, source, at, n) with n > 0, the terms (part, at, term), and (lang, part, v) with how many a language has.

    Languages are numbered and taken one by one: a table has few of them. The vocabulary passes the driver, as a
    CountVectorizer's does: terms of ``min_docs`` documents at least.
    """
    spark = docs.sparkSession
    langs = [r.lang for r in _read(docs).groupBy("lang").count().where(F.col("count") >= min_docs).orderBy("lang").collect()]
    rows = termed(docs, langs).withColumn("terms", F.split("said", " ")) if langs else None
    found = [(lang, k, _fitted(rows.where(F.col("part") == k), min_docs)) for k, lang in enumerate(langs, 1)]
    models = {k: model for _, k, model in found if model is not None}
    sizes = spark.createDataFrame([(lang, k, len(m.vocabulary)) for lang, k, m in found if m is not None], "lang string, part int, v long")
    if not models:
        return spark.createDataFrame([], "part int, source string, at int, n long"), spark.createDataFrame([], "part int, at int, term string"), sizes
    vectors = [m.transform(rows.where(F.col("part") == k)).select("part", "source", F.unwrap_udt("vector").alias("vector")) for k, m in models.items()]
    sparse = reduce(DataFrame.unionByName, vectors).select("part", "source", "vector.indices", "vector.values")
    sums = sparse.mapInArrow(_summed, "part int, source string, at int, n long")
    sums = sums.groupBy("part", "source", "at").agg(F.sum("n").alias("n"))
    listed = [(k, m.vocabulary) for k, m in models.items()]
    columns = {"part": pa.array(np.concatenate([np.full(len(w), k) for k, w in listed]), pa.int32()), "at": pa.array(np.concatenate([np.arange(len(w)) for _, w in listed]), pa.int32()), "term": pa.array([t for _, words in listed for t in words])}
    return cut_lineage(sums), spark.createDataFrame(pa.table(columns)), sizes


def _share(n: str, of: str, v: str) -> Column:
    """1 + floor(WHOLE * (n + ADDED) / (of + ADDED * v)), in integers of any size."""
    wide = "cast({} as decimal(30, 0))"
    large = f"({wide.format(WHOLE)} * {wide.format(f'{n} + {ADDED}')}) div {wide.format(f'{of} + {ADDED} * {v}')}"
    small = f"({WHOLE}L * ({n} + {ADDED})) div ({of} + {ADDED} * {v})"  # as long as the product fits
    return F.expr(f"1 + CASE WHEN {n} < {2**62 // WHOLE} THEN {small} ELSE {large} END")


def _shares(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The groups (gid, lang, source, part, total, v, has, none), the terms that each has (gid, part, at, n, p, none), both stored, and the terms' names.

    ``none`` is the share of a term that the group lacks.
    """
    counts, terms, sizes = group_counts(docs, min_docs)
    groups = _read(docs).select("lang", "source").distinct()
    totals = counts.groupBy("part", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("has"))
    groups = groups.join(sizes, "lang", "left").join(totals, ["part", "source"], "left").na.fill(0, ["v", "total", "has"])
    none = F.when(F.col("v") > 0, _share("0", "total", "v")).otherwise(F.lit(0).cast("long"))
    groups = cut_lineage(groups.withColumn("none", none).withColumn("gid", F.monotonically_increasing_id()))  # numbers last, as they are stored
    known = sized(groups.select("gid", "part", "source", "total", "v", "none"))
    shares = counts.join(known, ["part", "source"]).select("gid", "part", "at", "n", _share("n", "total", "v").alias("p"), "none")
    return groups, cut_lineage(shares), terms


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(gid, gid2, value): the sum over the language's terms of the differences of shares, for each two groups of it."""
    two = groups.select("lang", "part", F.col("gid").alias("gid2"), F.col("has").alias("has2"), F.col("none").alias("none2"))
    pairs = groups.join(two.drop("part"), "lang").where("gid <> gid2")
    # What a group's terms differ by from a group that has none of them, from how often each share occurs.
    often = shares.groupBy("gid", "part", "p").agg(F.count(F.lit(1)).alias("k"))
    alone = often.join(two.select("part", "gid2", "none2"), "part").where("gid <> gid2")
    alone = cut_lineage(alone.groupBy("gid", "gid2").agg(F.sum(F.col("k") * F.abs(F.col("p") - F.col("none2"))).alias("alone")))
    # What changes where both have a term.
    left = shares.select("part", "at", "gid", "p", "none")
    both = left.join(left.toDF("part", "at", "gid2", "p2", "none2"), ["part", "at"]).where("gid < gid2")
    changed = F.abs(F.col("p") - F.col("p2")) - F.abs(F.col("p") - F.col("none2")) - F.abs(F.col("none") - F.col("p2"))
    both = cut_lineage(both.groupBy("gid", "gid2").agg(F.sum(changed).alias("changed"), F.count(F.lit(1)).alias("common")))
    both = both.unionByName(both.toDF("gid2", "gid", "changed", "common"))
    found = pairs.join(alone, ["gid", "gid2"], "left").join(alone.toDF("gid2", "gid", "alone2"), ["gid", "gid2"], "left").join(both, ["gid", "gid2"], "left")
    found = found.na.fill(0, ["alone", "alone2", "changed", "common"])
    lacking = (F.col("v") - F.col("has") - F.col("has2") + F.col("common")) * F.abs(F.col("none") - F.col("none2"))
    return found.select("gid", "gid2", (F.col("alone") + F.col("alone2") + F.col("changed") + lacking).alias("value"))


def _terms(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(gid, part, at, value): the terms that a group has a larger share of than its language."""
    whole = shares.groupBy("part", "at").agg(F.sum("n").alias("n_all"))
    of = groups.groupBy("part").agg(F.sum("total").alias("total_all"), F.max("v").alias("v"))
    common = whole.join(F.broadcast(of), "part").select("part", "at", _share("n_all", "total_all", "v").alias("q"))
    return shares.join(common, ["part", "at"]).where("p > q").select("gid", "part", "at", (F.col("p") - F.col("q")).alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, text, ...) -> (lang, source, part, item, value, rank int).

    Part ``pair``: every other source of the language with the sum of the differences of their shares over all kept
    terms. Part ``term``: the ``top`` terms whose share in the group is most above the language's. A share is
    1 + floor(10^9 * (count + 5) / (all counts + 5 * kept terms)). Terms are kept that ``min_docs`` documents of the language
    hold. Ranks go by value, then by item in byte order. Null texts, languages and sources are ''; languages without a
    kept term have pairs of value 0; a lone source has no pairs. Repeated rows count each. Other columns are ignored; an empty
    table gives an empty table. Only the vocabulary and the list of languages pass the driver.
    """
    groups, shares, names = _shares(docs, min_docs)
    named = groups.select("gid", "lang", "source")
    ranked = lambda rows, item: rows.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy(F.col("value").desc(), item)))
    pairs = ranked(_pairs(groups, shares).join(named.select(F.col("gid").alias("gid2"), F.col("source").alias("item")), "gid2"), "item")
    terms = ranked(_terms(groups, shares), "at").where(F.col("rank") <= top)  # numbers are in byte order
    terms = terms.join(names.withColumnRenamed("term", "item"), ["part", "at"])
    columns = lambda rows, part: rows.join(named, "gid").select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(terms, "term"))
