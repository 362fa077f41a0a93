"""Benchmark decontamination: MinHash containment search by size, then exact shingle containment.

An item with n distinct shingles of which at least a share t must lie in a document may miss n - ceil(t n) of
them. So of its n - ceil(t n) + 1 least shingle hashes (a bottom-k MinHash whose k follows the item's size) at
least one lies in every document that contains it: the search loses nothing, however long the document is.
Each item is in a size class, the power of two below its size, and a hit counts only in a document that is large enough
for the class: a filter on hits by size; the tables themselves are not dealt by it. Then the shingles themselves are
compared. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage, sized

WORDS, SIMILARITY = 5, 0.8


def words(text: str) -> Column:
    """Lower-cased runs of letters, marks and digits; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def _spans(tokens: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """(keys, words) -> a row for each place where ``width`` words stand in a row: keys, words, size, at."""
    room = F.size("words") - width
    return tokens.where(room >= 0).select(*keys, "words", (room + 1).alias("size"), F.explode(F.sequence(F.lit(0), room)).alias("at"))


def _at(width: int) -> list[Column]:
    return [F.get("words", F.col("at") + k) for k in range(width)]


def item_shingles(benchmark: DataFrame, width: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(item_id, text, ...) -> (item_id, width, shingle, n, need, in_sketch): distinct shingles of distinct items.

    Items with equal words are one item, under their least item_id. An item with fewer words than ``width`` is
    one shingle of all its words; one without words, or without an id, has no rows and matches nothing.
    """
    items = benchmark.where("item_id is not null").select("item_id", words("text").alias("words")).where(F.size("words") > 0)
    items = items.groupBy("words").agg(F.min("item_id").alias("item_id"))
    items = items.withColumn("width", F.least(F.size("words"), F.lit(width)))
    places = items.select("item_id", "width", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("width"))).alias("at"))
    shingles = places.select("item_id", "width", F.array_join(F.slice("words", F.col("at") + 1, F.col("width")), " ").alias("shingle")).distinct()
    of_item = shingles.groupBy("item_id", "width").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("shingle").alias("h"), "shingle"))).alias("all"))
    of_item = of_item.withColumn("n", F.size("all")).withColumn("need", F.ceil(F.col("n") * similarity - 1e-9).cast("int"))
    rows = of_item.select("item_id", "width", "n", "need", F.posexplode("all").alias("rank", "x"))
    return rows.select("item_id", "width", "x.shingle", "n", "need", (F.col("rank") <= F.col("n") - F.col("need")).alias("in_sketch"))


def contained_items(docs: DataFrame, benchmark: DataFrame, width: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text, ...) and (item_id, text, ...) -> (doc_id, item_id, item_shingles, matched).

    A row for each document and item of which the document holds at least ``similarity`` of the distinct
    shingles of ``width`` words. item_id stands for all items with the same words. Null and empty texts hold
    nothing; rows without a doc_id can't be named and are not searched; rows that share a doc_id are one
    document. Other columns are ignored. Empty tables give an empty table.
    """
    items = cut_lineage(item_shingles(benchmark, width, similarity))
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most ``width`` numbers
    tokens = docs.where("doc_id is not null").select("doc_id", words("text").alias("words"))
    sketch = items.where("in_sketch")
    found = None
    for w in widths:
        # The class is the power of two below the item's size: a partition is searched only by documents that can hold its items.
        size_class = F.floor(F.log2("n"))
        least = F.ceil(F.pow(F.lit(2.0), size_class) * similarity - 1e-9)
        own = cut_lineage(sketch.where(F.col("width") == w).select(F.xxhash64("shingle").alias("h"), "item_id", least.alias("floor")))
        hits = _spans(tokens, w, ["doc_id"]).select("doc_id", "size", F.xxhash64(F.concat_ws(" ", *_at(w))).alias("h"))
        hits = hits.join(sized(own), "h").where("size >= floor").select("doc_id", "item_id", F.lit(w).alias("width")).distinct()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        nothing = docs.select("doc_id").where("false").join(items.withColumn("doc_id", F.lit(None)), "doc_id")
        return nothing.select("doc_id", "item_id", F.col("n").alias("item_shingles"), F.lit(0).cast("long").alias("matched"))
    found = cut_lineage(found)
    held = tokens.join(sized(found.select("doc_id").distinct()), "doc_id", "left_semi")
    exact = None
    for w in widths:
        said = _spans(held, w, ["doc_id"]).select("doc_id", F.concat_ws(" ", *_at(w)).alias("shingle"))
        own = said.join(sized(items.where(F.col("width") == w).select("shingle", "item_id", "n", "need")), "shingle")
        exact = own if exact is None else exact.unionByName(own)
    exact = exact.distinct().groupBy("doc_id", "item_id", "n", "need").agg(F.count(F.lit(1)).alias("matched"))
    exact = exact.join(found.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi")
    return exact.where("matched >= need").select("doc_id", "item_id", F.col("n").alias("item_shingles"), "matched")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. Rows without a doc_id stay."""
    bad = cut_lineage(contained_items(docs, benchmark).select("doc_id").distinct())
    return docs.join(sized(bad), "doc_id", "left_anti").select(*docs.columns)
