"""Phrase collocations by PCY and DHP hashing with Apriori pruning.

Pass k reads the texts and counts the phrases of k words exactly, but only where they can be frequent: both phrases of k - 1
words within are frequent (Apriori) and the phrase's bucket is (PCY). While it does so it counts the buckets of the phrases of
k + 1 words, of those only whose two parts of k words passed, and from the second pass on it writes what the next one has to
read: the runs of k + 1 words or more that phrases which passed make up (DHP's trimming). Between passes the bucket counts of all tasks are added up
by segment, and what is left for the next pass are two bitmaps of `buckets` bits, broadcast: the buckets that reach the least
count, and the bits of the frequent phrases. `buckets` grows with the number of documents up to MOST_BUCKETS, so a bitmap is 2 MB
at most. A bit set by chance costs a count that is thrown away later; no frequent phrase is ever lost, so counts are exact.

Bucket counts are held at the least count, which keeps them in two bytes and doesn't change what reaches it. Within a batch of
8 MB phrases are told apart by hashes of 64 bits, between batches by their words.

Each phrase of two words or more is then cut at every place, its parts are looked up among the frequent phrases (a part is as
frequent as the whole), and a phrase goes if one with a word more, before or behind, is as frequent: a longer one that is as
frequent has all those between in the same number.

Defined cases: a null text or one without words has no phrase; a null language is `und`, joined with a language of that name;
repeated rows count again; texts of any length are read whole; no rows give no rows; further columns, of whatever names, are
not looked at; a phrase of equal score and count ranks by the bytes of its UTF-8 text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bare, bounded_batches, dropped, table, written

#: Words of the longest phrase, least count of a phrase, phrases returned for each language.
MOST_WORDS, LEAST, TOP = 5, 100, 2000
#: Buckets of a document, the least and the most of all.
BUCKETS, LEAST_BUCKETS, MOST_BUCKETS = 16, 1 << 16, 1 << 24
SEGMENT = 4096
#: A piece ends at 0xFF, which is no byte of UTF-8.
_CUT = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_OUT = "lang string, phrase string, c long, segment int, counts binary"
_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Entries of the cache of words and of the counts that a task holds.
_CACHE, _HELD = 500_000, 200_000


def rolled(w: np.ndarray, k: int) -> np.ndarray:
    """The 64-bit hashes of the k consecutive word hashes from each position on."""
    n = max(0, len(w) - k + 1)
    h = w[:n].copy()
    for j in range(1, k):
        h = (h ^ (h >> np.uint64(32))) * _MIX + w[j : j + n]
    return h


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)


def word_hash(word: bytes, lang: str) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang)) | 1


class Hashes(dict):
    """The hash of each word of a language, 0 for the mark between pieces and for words whose bit isn't set."""

    def __init__(self, lang: str, bits: int, set_bits: np.ndarray | None):
        super().__init__({b"\xff": 0})
        self.lang, self.bits, self.set_bits = lang, bits, set_bits

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word, self.lang)
        if self.set_bits is not None and not self.set_bits[bucket(np.array([h], np.uint64), self.bits)[0]]:
            h = 0
        if len(self) > _CACHE:
            self.clear()
            self[b"\xff"] = 0
        self[word] = h
        return h


def tokens(texts: list[bytes]) -> list[bytes]:
    """The words of the texts and a mark wherever a piece or a text ends."""
    return b"\xff".join(texts).translate(_CUT).replace(b"\xff", b" \xff ").split()


class Buckets:
    """Counts of buckets, held at `least`, and those that were touched as rows of SEGMENT counts."""

    def __init__(self, bits: int, least: int):
        self.bits, self.least, self.n = bits, least, np.zeros(1 << bits, np.uint16)

    def add(self, h: np.ndarray) -> None:
        if len(h):
            at, c = np.unique(bucket(h, self.bits), return_counts=True)
            self.n[at] = np.minimum(self.n[at] + c, self.least)

    def rows(self) -> list[tuple[int, bytes]]:
        some = self.n.reshape(-1, SEGMENT)
        return [(int(s), some[s].astype("<u2").tobytes()) for s in np.flatnonzero(some.any(1))]


def runs(toks: list[bytes], passed: np.ndarray, k: int) -> bytes:
    """The stretches of words that phrases of k words from the passed positions on make up, of more than k words, as pieces."""
    edge = np.diff(np.concatenate(([0], passed.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts > 1
    return b"\n".join([b" ".join(toks[a : b + k - 1]) for a, b in zip(starts[long].tolist(), ends[long].tolist())])


def batch_of(rows: list[tuple], counts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    phrase = pa.array([r[1] for r in rows] + [None] * len(counts), pa.binary()).cast(pa.string())
    cols = [pa.array([r[0] for r in rows] + [None] * len(counts), pa.string()), phrase, pa.array([r[2] for r in rows] + [None] * len(counts), pa.int64()),
            pa.array([None] * len(rows) + [s for s, _ in counts], pa.int32()), pa.array([None] * len(rows) + [b for _, b in counts], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["lang", "phrase", "c", "segment", "counts"])


def trimmed(lang: str, text: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([text], pa.binary())], names=["lang", "phrase", "c", "segment", "counts"])


def unpacked_bits(packed: bytes | None) -> np.ndarray | None:
    return None if packed is None else np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)


def counted(spark: SparkSession, docs: DataFrame, k: int, most: int, least: int, bits: int, words: bytes | None, known: bytes | None, full: bytes | None) -> DataFrame:
    """Pass k over docs (lang, t): rows (lang, phrase, c) of a task, rows (segment, counts) of its buckets of phrases of k + 1 words,
    and, for k > 1, rows (lang, counts) with what pass k + 1 reads.

    words, known, full: bits of the frequent words, of the frequent phrases of k - 1 words, and of the full buckets of phrases of k.
    """
    sent = spark.sparkContext.broadcast((words, known, full))  # 2 MB each at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word, is_known, is_full = map(unpacked_bits, sent.value)
        caches: dict[str, Hashes] = {}
        held: dict[str, Counter] = {}
        nexts = Buckets(bits, least) if k < most else None
        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                toks = tokens(texts)
                if lang not in caches:
                    caches[lang] = Hashes(lang, bits, is_word)
                w = np.fromiter(map(caches[lang].__getitem__, toks), np.uint64, len(toks))
                into = held.setdefault(lang, Counter())
                if k == 1:
                    into.update(toks)
                    into.pop(b"\xff", None)
                    passed = w != 0
                else:
                    ok = w != 0
                    if k > 2:
                        part = rolled(w, k - 1)
                        ok = np.lib.stride_tricks.sliding_window_view(ok, k - 1).all(1) & is_known[bucket(part, bits)] if len(part) else ok[:0]
                    passed = ok[:-1] & ok[1:]
                    at = np.flatnonzero(passed)
                    h = rolled(w, k)[at]
                    hit = is_full[bucket(h, bits)]
                    at, h = at[hit], h[hit]
                    passed = np.zeros(len(passed), bool)
                    passed[at] = True
                    _, first, c = np.unique(h, return_index=True, return_counts=True)
                    for i, n in zip(at[first].tolist(), c.tolist()):
                        into[b" ".join(toks[i : i + k])] += n
                if nexts is not None and len(passed) > 1:
                    nexts.add(rolled(w, k + 1)[passed[:-1] & passed[1:]])
                    if k > 1 and (left := runs(toks, passed, k)):
                        yield trimmed(lang, left)
            if sum(map(len, held.values())) > _HELD:
                yield batch_of([(g, p, n) for g, x in held.items() for p, n in x.items()], [])
                held = {}
        yield batch_of([(g, p, n) for g, x in held.items() for p, n in x.items()], [])
        segments = nexts.rows() if nexts is not None else []
        for i in range(0, len(segments), 256):
            yield batch_of([], segments[i : i + 256])

    return written(spark, docs.mapInArrow(run, _OUT), f"phrases{k}")


def gathered(spark: SparkSession, parts: DataFrame, least: int, bits: int) -> bytes:
    """One bit for each bucket whose counts in parts (segment, counts) add up to `least`; a task holds the segments that it is dealt."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(c, "<u2").astype(np.uint32)
                total[s] = np.minimum(total[s] + c, least) if s in total else c
        for s, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(c >= least).tobytes()], pa.binary())], names=["segment", "bits"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = parts.where("segment is not null").select("segment", "counts").repartition(tasks, "segment").mapInArrow(add, "segment int, bits binary")
    out = np.zeros(((1 << bits) // SEGMENT, SEGMENT // 8), np.uint8)
    for r in got.collect():  # a bit a bucket in all: 2 MB at most
        out[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def bits_of(spark: SparkSession, frequent: DataFrame, bits: int) -> bytes:
    """One bit for each bucket that holds a phrase of frequent (lang, phrase)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Buckets(bits, 1)
        for b in batches:
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                w = np.array([word_hash(x, lang) for x in phrase.split(b" ")], np.uint64)
                mine.add(rolled(w, len(w)))
        yield batch_of([], mine.rows())

    return gathered(spark, frequent.select("lang", "phrase").mapInArrow(run, _OUT), 1, bits)


def frequent_phrases(spark: SparkSession, docs: DataFrame, lang: str = "lang", text: str = "text", most: int = MOST_WORDS, least: int = LEAST, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to `most` words that occur `least` times or more, and (lang, n) of all words."""
    bounded_batches(spark)
    d = bare(docs, lang, text).toDF("lang", "t").where("t is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "t")
    size = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, BUCKETS * d.count()))
    bits = max(12, (size - 1).bit_length())
    words = known = full = total = before = None
    found = []
    for k in range(1, most + 1):
        parts = counted(spark, d, k, most, least, bits, words, known, full)
        sums = parts.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("c").alias("f"))
        if k == 1:
            total = written(spark, parts.where("phrase is not null").groupBy("lang").agg(F.sum("c").alias("n")), "words")
        found.append(written(spark, sums.where(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("k"), "f"), "frequent"))
        if k < most:
            full = gathered(spark, parts, least, bits)
            known = bits_of(spark, found[-1], bits)
            words = known if k == 1 else words
        if before is not None:
            dropped(spark, before)
        before = parts
        if k > 1:
            d = parts.where("phrase is null and segment is null").select("lang", F.col("counts").alias("t"))
        if k < most and not any(full):
            break
    dropped(spark, before)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every, total


def scored(every: DataFrame, total: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase of two words or more that no longer one covers."""
    some = every.where("k > 1").withColumn("w", F.split("phrase", " ", -1))
    part = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    cuts = some.select("lang", "phrase", F.col("f").alias("a"), "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cuts = cuts.select("lang", "phrase", "a", "at", part(F.lit(1), F.col("at")).alias("head"), part(F.col("at") + 1, F.col("k") - F.col("at")).alias("rest"))
    side = lambda c, n: every.select("lang", F.col("phrase").alias(c), F.col("f").alias(n))
    met = cuts.join(side("head", "l"), ["lang", "head"]).join(side("rest", "r"), ["lang", "rest"]).join(total, "lang")
    # 18 digits each, so that a product has 36 at most
    score = F.expr("(cast(a * 1000 as decimal(18,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = met.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "at", "l", "r")).alias("x"))
    longer = some.where("k > 2").select("lang", F.col("f").alias("most"), F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    left = best.join(longer, ["lang", "phrase"], "left").where("most is null or most < a")
    return left.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))


def best_phrases(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language with their rank; 64 parts of a language are cut first, so no task sorts all its phrases."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("part")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, total = frequent_phrases(spark, table(spark, sf_dir, "documents"))
    return best_phrases(scored(every, total)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {"op11_phrase_mining": op11_phrase_mining}
#: All phrases of up to five words are counted, whatever they are.
SQL = {
    "op11_phrase_mining": r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w FROM t), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest([w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS g FROM w, range(1, 6) AS r(k)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100), c AS (SELECT lang, g, k, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.g, a, cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[cut + 1:] JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
o AS (SELECT lang, g[i:j] AS g, max(f) AS f FROM f, range(1, 6) AS a(i), range(2, 6) AS b(j) WHERE k > 2 AND j > i AND j <= k AND j - i + 1 < k GROUP BY 1, 2),
z AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE o.f IS NULL OR 100 * o.f < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM z QUALIFY rank <= 2000"""
}
