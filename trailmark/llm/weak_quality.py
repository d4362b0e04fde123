"""Quality classifier by weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each whole document. Documents with the same votes are counted
together (at most 3 ** labellers patterns reach the driver); on these counts, expectation-maximisation estimates how each
labeller votes given the true class, and the share of good documents. Posterior labels then train a linear scorer over
hashed byte 4-grams and hashed measurement buckets, by gradient descent on the `SAMPLE` documents with the least hash,
whose features (`DIM` numbers each) are made on the executors. The scorer reads whole documents; a document is kept if its
score is `KEEP` or more.

Defined cases: a null or wordless text has weak label and score 0, isn't kept and is never sampled; without any document with
words there is no model and every score is 0; ties have the same score; equal rows get equal results; texts of any length
are read whole; no rows give no rows; further columns, of whatever names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, bounded_batches, hash_cut, table

SAMPLE = 3000
DIM = 2048
KEEP = 0.5
STEPS = 300
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_RUNS = (b"###", b"***", b"$$$", b"%%%", b"&&&", b"|||", b"<<<", b">>>", b"!!", b"??")
_BUCKETS = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 2.0, 4.0, 7.0, 12.0, 30.0, 100.0, 1000.0])
MEASURES = ("symbols", "capitals", "shouts", "stops", "repeats", "dup_lines", "words", "word_length", "pipes", "runs", "variety")


def measures(raw: bytes) -> tuple[float, ...] | None:
    """Of a document's UTF-8 bytes; None without words."""
    words = raw.split()
    if not words:
        return None
    n = len(words)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = seen[65:91].sum() + seen[97:123].sum() + seen[195]
    solid = len(raw) - int(seen[[9, 10, 11, 12, 13, 32]].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (seen[_SYMBOLS].sum() / n, seen[65:91].sum() / max(letters, 1), seen[33] / n, (seen[46] + seen[63]) / n, sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / len(lines), float(n), solid / n, seen[124] / n, sum(raw.count(x) for x in _RUNS) / n, np.log(len(set(words))) / np.log(n) if n > 1 else 1.0)


#: (measure, bad if under, bad if over, good from, good to); otherwise a labeller says nothing. Nearly every document looks good to
#: most measures at once, so all but one of them vote against only: votes for good that come together would outweigh any finding.
LABELLERS = (
    ("symbols", None, 0.1, None, None), ("capitals", None, 0.4, None, None), ("shouts", None, 0.1, None, None), ("stops", 0.005, 0.5, 0.02, 0.3),
    ("repeats", None, 0.1, None, None), ("dup_lines", None, 0.5, None, None), ("word_length", 2, 20, None, None), ("pipes", None, 0.1, None, None),
    ("runs", None, 0.05, None, None), ("variety", 0.6, None, None, None),
)


def votes(m: tuple[float, ...]) -> int:
    """The votes as digits of base 3: 0 nothing, 1 good, 2 bad."""
    code = 0
    for name, under, over, lo, hi in LABELLERS:
        x = m[MEASURES.index(name)]
        bad = under is not None and x < under or over is not None and x > over
        code = code * 3 + (2 if bad else 1 if lo is not None and lo <= x <= hi else 0)
    return code


def digits(codes: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return codes[:, None] // 3 ** np.arange(k - 1, -1, -1) % 3


class Labels:
    """Posterior probability of good, by pattern of votes, and accuracies of the labellers."""

    def __init__(self, counts: dict[int, int], rounds: int = 100):
        codes = np.array(sorted(counts), np.int64)
        n = np.array([counts[c] for c in codes], float)
        v = digits(codes)
        good, bad = (v == 1).sum(1), (v == 2).sum(1)
        p = (good + 1) / (good + 9 * bad + 1.2)
        for _ in range(rounds):
            share = np.clip((n * p).sum() / n.sum(), 0.05, 0.95)
            like = np.empty((2, len(LABELLERS), 3))
            for c, q in enumerate((1 - p, p)):
                for d in range(3):
                    like[c, :, d] = ((n * q)[:, None] * (v == d)).sum(0) + (1.0 if d == 0 else 2.0 if (d == 1) == (c == 1) else 0.5)
            like /= like.sum(-1, keepdims=True)
            logs = [np.log(like[c])[np.arange(len(LABELLERS)), v].sum(1) for c in (0, 1)]
            new = 1 / (1 + np.exp(np.clip(np.log(1 - share) + logs[0] - np.log(share) - logs[1], -50, 50)))
            if np.abs(new - p).max() < 1e-9:
                break
            p = new
        self.share, self.like = float(share), like
        self.of = dict(zip(codes.tolist(), p.tolist()))
        self.n, self.p, self.v = n, p, v

    def accuracies(self) -> list[tuple[str, float, float, float, float]]:
        """(name, share of documents with a vote, share of the votes that are right, votes for bad on good and on bad documents) of each labeller."""
        got = []
        for j, (name, *_) in enumerate(LABELLERS):
            v = self.v[:, j]
            cast, right = (self.n * (v > 0)).sum(), (self.n * np.where(v == 1, self.p, np.where(v == 2, 1 - self.p, 0))).sum()
            got.append((name, float(cast / self.n.sum()), float(right / cast) if cast else 0.0, float(self.like[1, j, 2]), float(self.like[0, j, 2])))
        return got


def features(raw: bytes, m: tuple[float, ...], dim: int = DIM) -> np.ndarray:
    """Hashed features of unit length."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.zeros(dim)
    if len(a) >= 4:
        h = a[:-3] * np.uint32(0x9E3779B1) + a[1:-2] * np.uint32(0x85EBCA77) + a[2:-1] * np.uint32(0xC2B2AE3D) + a[3:] * np.uint32(0x27D4EB2F)
        h ^= h >> np.uint32(15)
        out = np.sqrt(np.bincount((h * np.uint32(0x2C1B3C6D) >> np.uint32(16)) % np.uint32(dim), minlength=dim))
        out /= np.linalg.norm(out)
    for i, b in enumerate(np.searchsorted(_BUCKETS, m)):
        out[(i * 97 + int(b) * 13 + 5) * 2654435761 % dim] += 0.5
    return (out / (np.linalg.norm(out) or 1)).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer for soft labels; both classes weigh alike."""
    w, m, v = np.zeros(x.shape[1] + 1), 0.0, 0.0
    weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40)))
        d = (p - y) * weight
        g = np.append(x.T @ d + 1e-5 * w[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def labels_of(docs: DataFrame, text: str = "text") -> Labels | None:
    """The label model of all documents; None without words."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[int, int] = {}
        for b in batches:
            for t in b["t"]:
                m = measures(t.encode("utf-8", "replace")) if t else None
                if m:
                    c = votes(m)
                    got[c] = got.get(c, 0) + 1
        yield pd.DataFrame({"code": list(got), "n": list(got.values())}, columns=["code", "n"]).astype("int64")

    patterns = bare(docs, text).toDF("t").mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # 3 ** 10 rows at most
    return Labels({r["code"]: r["n"] for r in patterns}) if patterns else None


def labellers(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """(labeller, coverage, accuracy, bad_if_good, bad_if_bad): of each labeller the share of documents on which it votes, how often its
    votes are right by the model, and how often it votes bad on good and on bad documents. No rows without words."""
    model = labels_of(docs, text)
    rows = model.accuracies() if model else []
    return spark.createDataFrame(rows, "labeller string, coverage double, accuracy double, bad_if_good double, bad_if_bad double")


def scored(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, weak_label, score, kept) of each row."""
    bounded_batches(spark)
    rows = bare(docs, id_col, text).toDF("id", "t")
    labels = labels_of(docs, text)
    if not labels:
        return rows.select("id", F.lit(0.0).alias("weak_label"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for t in b["t"]:
                raw = t.encode("utf-8", "replace")
                m = measures(raw)
                if m:
                    got.append((votes(m), features(raw, m).tobytes()))
            yield pd.DataFrame(got, columns=["code", "x"])

    some = rows.where(F.rlike("t", F.lit(r"[^\x20\x09-\x0D]")))  # with words
    h = F.xxhash64("id", "t", F.lit(5))
    few = some.select(h.alias("h"), "t").where(F.col("h") <= hash_cut(some, h, SAMPLE)).dropDuplicates(["h"]).select("t")
    taken = few.mapInPandas(vectors, "code long, x binary").collect()  # SAMPLE rows of DIM numbers at most
    w = fit(np.stack([np.frombuffer(r["x"], np.float32) for r in taken]).astype(np.float64), np.array([labels.of[r["code"]] for r in taken]))
    sent = spark.sparkContext.broadcast((labels.of, w))

    @F.pandas_udf("weak_label double, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        of, w = sent.value
        got = np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            raw = t.encode("utf-8", "replace") if t else b""
            m = measures(raw)
            if m:
                got[i] = of.get(votes(m), 0.0), 1 / (1 + np.exp(-np.clip(features(raw, m) @ w[:-1] + w[-1], -40, 40)))
        return pd.DataFrame(got, columns=["weak_label", "score"])

    return rows.select("id", score.asNondeterministic()("t").alias("x")).select("id", "x.*", (F.col("x.score") >= KEEP).alias("kept"))


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def weak_labellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labellers(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op6_weak_quality": op6_weak_quality, "weak_labellers": weak_labellers}
SQL: dict[str, str] = {}
