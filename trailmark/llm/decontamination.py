"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions only.

The corpus is read once: its texts are cut into words, and the positional index is written, a row of words by position for
each document, with its key. The terms of the benchmark are counted over the whole index. Each window of a benchmark item is
looked up by its rarest term, so only postings (document, position) of those terms are taken from the index; a posting
carries the words around it, that is, the offset-adjusted neighbours of the other terms' lists. A posting and an item's
position of the same term are compared outwards word by word, which gives the longest common run around them: a run of a
whole window or more is an exact phrase match of each window in it. One row stands for all windows around one posting, so a
passage gives a few rows, not one a window. Places in items with the same words around them are one place, whatever number
of items has them, and their items are added to the matches.

Tables of benchmark terms and places are broadcast only if their bytes, as counted, are at most `BROADCAST_BYTES`; otherwise
they are joined by a shuffle, with the same result: (key, position, term) rows go to the terms, and what they find goes back
to the words of its document, so no word carries its document along. A frequent term's postings are split by adaptive skew joins.

Defined cases: null or wordless texts have no words and nothing is hit; an item of fewer than `window` words is one
window of its own length; a null item_id marks words but isn't listed; items that share an id count once; of equally rare
terms the first by alphabet is taken; equal rows get equal results; texts and items of any length are read whole; empty
tables give no rows, or documents without hits; further columns, of whatever names, are not looked at, and the stage keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bare, row_key, table, unpacked, with_row, written

WINDOW = 10
SLOP = 5
BROADCAST_BYTES = 8_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What is no part of a word, before A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), GAP, -1), "")


def _fits(terms: DataFrame, *sized: str) -> bool:
    size = sum([F.octet_length(F.array_join(c, " ")) if c.startswith(("before", "after", "words")) else F.octet_length(c) for c in sized], F.lit(32))
    return (terms.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def items_of(benchmark: DataFrame, item_col: str, text: str) -> DataFrame:
    got = bare(benchmark, item_col, text).toDF("item", "t").select("item", words_of(F.col("t")).alias("w")).distinct()
    return got.where(F.size("w") > 0).select("item", "w", F.xxhash64("item", "w").alias("ik"))


def index_of(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, w): the words of each document, by position, written once."""
    rows = bare(docs, id_col, text).toDF("id", "t")
    return written(spark, rows.select("id", row_key(F.col("id"), F.col("t")).alias("key"), words_of(F.col("t")).alias("w")), "positional-index")


def term_counts(spark: SparkSession, index: DataFrame, items: DataFrame) -> DataFrame:
    """(term, n): how often each term of the items stands in all documents."""
    terms = written(spark, items.select(F.explode("w").alias("term")).distinct(), "terms")
    small = F.broadcast(terms) if _fits(terms, "term") else terms
    found = index.select(F.explode("w").alias("term")).join(small, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(written(spark, found, "term-counts"), "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def _before(at: str, near: int) -> Column:
    """The words of w before the 0-based position, the nearest first."""
    return F.reverse(F.slice("w", F.greatest(F.col(at) - near, F.lit(0)) + 1, F.least(F.col(at), F.lit(near))))


def anchors(spark: SparkSession, items: DataFrame, counts: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(term, before, after, need, place): the places in items by which windows are looked up, before reversed; and (place, item)."""
    near = window - 1
    each = items.select("item", "ik", "w", F.size("w").alias("size"), F.posexplode("w").alias("at", "term"))
    each = each.select("item", "ik", "size", "at", "term", _before("at", near).alias("before"), F.slice("w", F.col("at") + 2, near).alias("after"))  # a place carries its surroundings, not its item
    last = F.greatest(F.col("size") - window, F.lit(0))
    starts = F.sequence(F.greatest(F.col("at") - near, F.lit(0)), F.least(F.col("at"), last))
    ranked = each.select("ik", "size", "at", "term").join(counts, "term").select("ik", F.explode(starts).alias("start"), F.struct("n", "term", "at").alias("x"))
    best = ranked.groupBy("ik", "start").agg(F.min("x").alias("x")).select("ik", "x.at").distinct()
    need = F.least("size", F.lit(window))
    places = written(spark, each.join(best, ["ik", "at"], "left_semi").select("item", "term", "before", "after", need.alias("need"), F.xxhash64("term", "before", F.lit(0), "after", need).alias("place")), "places")
    return written(spark, places.drop("item").dropDuplicates(["place"]), "anchors"), written(spark, places.select("place", "item").distinct(), "place-items")


def postings(spark: SparkSession, index: DataFrame, terms: DataFrame, near: int) -> DataFrame:
    """(key, term, pos, dbefore, dafter) of the given terms in all documents."""
    each = index.select("key", "w", F.posexplode("w").alias("pos", "term"))
    if _fits(terms, "term"):
        found = each.join(F.broadcast(terms), "term")
    else:
        found = index.select("key", F.posexplode("w").alias("pos", "term")).join(terms, "term").groupBy("key", "pos").agg(F.first("term").alias("term"))  # equal rows have equal keys
        found = found.join(index.select("key", "w").dropDuplicates(["key"]), "key")
    got = found.select("key", "term", "pos", _before("pos", near).alias("dbefore"), F.slice("w", F.col("pos") + 2, near).alias("dafter"))
    return got


def _run(a: str, b: str) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return (F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1).cast("int")


def phrase_matches(spark: SparkSession, index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, item, first, last): runs of a document's words, by 0-based position, that match whole windows of an item."""
    items = written(spark, items_of(benchmark, item_col, text), "items")
    places, items_at = anchors(spark, items, term_counts(spark, index, items), window)
    found = postings(spark, index, written(spark, places.select("term").distinct(), "anchor-terms"), window - 1)
    met = found.join(F.broadcast(places) if _fits(places, "term", "before", "after") else places, "term")
    met = met.select("key", "place", "pos", "need", _run("dbefore", "before").alias("l"), _run("dafter", "after").alias("r")).where(F.col("l") + 1 + F.col("r") >= F.col("need"))
    return met.join(items_at, "place").select("key", "item", (F.col("pos") - F.col("l")).alias("first"), (F.col("pos") + F.col("r")).alias("last"))


def proximity_matches(spark: SparkSession, index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text: str = "text", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """(key, item, pos): postings of the rarest term of a window of an item around which all the window's words stand within
    window - 1 + slop words to either side, in any order."""
    items = written(spark, items_of(benchmark, item_col, text), "items")
    counts = term_counts(spark, index, items)
    each = items.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("start"))
    each = each.select("item", F.array_sort(F.array_distinct(F.slice("w", F.col("start") + 1, window))).alias("words")).distinct()
    rare = each.select("words").distinct().select("words", F.explode("words").alias("term")).join(counts, "term").groupBy("words").agg(F.min(F.struct("n", "term")).alias("x")).select("words", "x.term")
    keys = written(spark, each.join(rare, "words"), "proximity-anchors")
    found = postings(spark, index, written(spark, keys.select("term").distinct(), "anchor-terms"), window - 1 + slop)
    around = F.concat(F.array("term"), "dbefore", "dafter")
    return found.join(keys, "term").where(F.size(F.array_except("words", around)) == 0).select("key", "item", "pos").distinct()


def hits(matches: DataFrame) -> DataFrame:
    """(key, n_hit, items): the number of words inside any match and the sorted ids, of documents with a match."""
    before = F.max("last").over(Window.partitionBy("key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("last") + 1 - F.greatest(F.col("first"), F.coalesce(before + 1, F.lit(0))))
    return matches.withColumn("new", new).groupBy("key").agg(F.sum("new").cast("long").alias("n_hit"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, table(spark, sf_dir, "documents"))
    found = hits(phrase_matches(spark, index, table(spark, sf_dir, "benchmark")))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return index.select(F.col("id").alias("doc_id"), "key", F.size("w").cast("long").alias("n_words")).join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def proximity_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_places, n_items) of the documents with proximity matches: positions of anchors, and items."""
    index = index_of(spark, table(spark, sf_dir, "documents"))
    found = proximity_matches(spark, index, table(spark, sf_dir, "benchmark")).groupBy("key").agg(F.count_distinct("pos").alias("n_places"), F.count_distinct(F.col("item")).alias("n_items"))
    return index.select(F.col("id").alias("doc_id"), "key").join(found, "key").select("doc_id", "n_places", "n_items")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any benchmark window."""
    bad = phrase_matches(spark, index_of(spark, docs), table(spark, sf_dir, "benchmark")).select("key").distinct()
    keyed = with_row(docs, "doc_id", "text").withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(bad, "key", "left_anti").select(*unpacked(docs))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op9_decontamination": op9_decontamination, "proximity_decontamination": proximity_decontamination}
SQL = {"op9_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS st FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, list_slice(w, st, st + k - 1) AS ww, w[st] AS head, w[st + 1] AS nxt FROM s),
p AS (SELECT rid, unnest(w) AS word, unnest(list_slice(w, 2, len(w))) AS nxt, generate_subscripts(w, 1) AS pos FROM d),
c AS (SELECT p.rid, p.pos, win.k, win.item_id, win.ww FROM p JOIN win ON p.word = win.head AND p.nxt = win.nxt AND win.k > 1),
m AS (SELECT c.rid, c.pos, c.k, c.item_id FROM c JOIN d ON d.rid = c.rid WHERE list_slice(d.w, c.pos, c.pos + c.k - 1) = c.ww UNION ALL SELECT p.rid, p.pos, 1, win.item_id FROM p JOIN win ON p.word = win.head AND win.k = 1),
h AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + k)) AS x FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)
"""}
