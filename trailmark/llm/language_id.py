"""Language ID by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a stretch of bytes, one forwards and one backwards; from both states at a byte, a linear
layer gives the probabilities of the languages at that byte. A document's probability of a language is the mean over
its bytes that belong to letters. The network is trained in numpy by backpropagation through time on stretches of
`STRETCH` bytes from a bounded sample of labelled documents; it labels whole texts, cut into stretches without a gap. Both
layers begin each stretch anew, so the labels next to a cut rest on one side's context; the pooled result is what counts.

Learning looks only at text and label of documents whose crc32(id as text) mod 4 isn't 2. The sample is the `SAMPLE`
such documents with the least hash; all of their text is cut into pieces of `PIECE` characters, and the `PIECES` pieces with
the least hash are learned from (all of them, where there are fewer), so PIECES * PIECE characters at most reach the driver,
however large the corpus or a text is. Pieces that are equal are learned once.

The pipeline's stage must also tell texts in none of the languages: its network learns one more class, NONE, from pieces made out of
the learned ones (`alien`): the same words and signs, but their letters exchanged for other letters of the alphabet, or
for letters of a drawn script. A document is rejected if the mean probability of that class over its letters is ALIEN or more.

Defined cases: a null text or one without letters is `und` with score 0; if nothing can be learned from, every text is
`und`; a null id isn't held out and isn't learned from; ties go to the language that sorts first; equal rows get equal
results; a text of any length is read whole, BLOCK stretches at a time; no rows give no rows; input columns named held_out,
lang_pred or score give way to the results; other columns are passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, bounded_batches, dropped, hash_cut, table, unpacked, with_row, written

SAMPLE = 3000
PIECE = 192
PIECES = 9000
STRETCH = 64
HIDDEN = 8
STEPS = 700
BATCH = 160
#: Documents and characters whose stretches are held at once (a longer text by itself), and stretches that the network reads at once.
SLICE, SLICE_CHARS = 500, 500_000
BLOCK = 2048
#: The class of texts in none of the languages, its pieces for each learned piece, pieces with a drawn word for each learned piece, training
#: steps with them, and the score from which the pipeline's stage rejects a document, with the bytes counted against it.
NONE = "und"
ALIENS = 0.5
KEYS = 0.3
STEPS_NONE = 1200
ALIEN = 0.8
DOUBT = 8
LETTER_BYTES = np.array([(65 <= c <= 90) or (97 <= c <= 122) or c >= 128 for c in range(256)])
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letters(text: str | None) -> bool:
    return text is not None and bool(_ASCII_LETTER.search(text) or any(map(str.isalpha, text)))


def stretches(raw: bytes) -> np.ndarray:
    """The bytes, with A-Z as a-z, in rows of STRETCH; the last is filled up with zeros."""
    raw = raw.translate(_LOWER)
    a = np.zeros(-(-len(raw) // STRETCH) * STRETCH, np.uint8)
    a[: len(raw)] = np.frombuffer(raw, np.uint8)
    return a.reshape(-1, STRETCH)


class Network:
    """Weights: W (2, 256, 3H) of the bytes, U (2, H, 3H) of the state, b (2, 3H), O (2H, L), c (L). Gates: update, reset, new."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, n = hidden, len(langs)
        self.langs = langs
        self.w = {"W": rng.normal(0, 0.3, (2, 256, 3 * h)), "U": rng.normal(0, 0.3, (2, h, 3 * h)), "b": np.zeros((2, 3 * h)), "O": rng.normal(0, 0.3, (2 * h, n)), "c": np.zeros(n)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, keep: bool) -> tuple:
        """States of both directions, (T, 2, B, H), each at its own step; with keep, what the way back needs."""
        w, (n, t) = self.w, x.shape
        h = w["U"].shape[1]
        rows = (w["W"] + w["b"][:, None]).reshape(512, 3 * h)
        both = np.stack([x.T, x.T[::-1] + np.int16(256)], 1).astype(np.int16)  # (T, 2, B)
        states, kept, s = np.empty((t, 2, n, h), np.float32), [], np.zeros((2, n, h), np.float32)
        for i in range(t):
            a, r = rows[both[i]], s @ w["U"]
            g = a[..., : 2 * h] + r[..., : 2 * h]
            np.multiply(g, 0.5, g)
            np.tanh(g, g)
            np.multiply(g, 0.5, g)
            np.add(g, 0.5, g)
            z, q = g[..., :h], g[..., h:]
            m = np.tanh(a[..., 2 * h :] + q * r[..., 2 * h :])
            new = m + z * (s - m)
            if keep:
                kept.append((s, z, q, m, r[..., 2 * h :]))
            states[i] = s = new
        return states, kept, both

    def _probs(self, states: np.ndarray) -> np.ndarray:
        """(T, B, L)."""
        h = states.shape[-1]
        o = states[:, 0] @ self.w["O"][:h] + states[::-1, 1] @ self.w["O"][h:] + self.w["c"]
        o -= o.max(-1, keepdims=True)
        np.exp(o, o)
        o /= o.sum(-1, keepdims=True)
        return o

    def label(self, x: np.ndarray) -> np.ndarray:
        """The sum over each stretch's letter bytes of the language probabilities, (rows, L)."""
        out = np.empty((len(x), len(self.langs)), np.float32)
        for i in range(0, len(x), BLOCK):
            part = x[i : i + BLOCK]
            out[i : i + BLOCK] = np.einsum("tbl,tb->bl", self._probs(self._run(part, False)[0]), LETTER_BYTES[part.T].astype(np.float32))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the letter bytes, weighted by stretch, and its gradients."""
        w, (n, t) = self.w, x.shape
        h = w["U"].shape[1]
        states, kept, both = self._run(x, True)
        p = self._probs(states)
        mask = LETTER_BYTES[x.T] * weight
        mask = (mask / max(mask.sum(), 1e-9)).astype(np.float32)
        at = np.arange(n)
        loss = float(-(np.log(p[:, at, y] + 1e-9) * mask).sum())
        p[:, at, y] -= 1
        d = p * mask[..., None]  # (T, B, L)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["c"] = d.sum((0, 1))
        grad["O"][:h] = np.tensordot(states[:, 0], d, ((0, 1), (0, 1)))
        grad["O"][h:] = np.tensordot(states[::-1, 1], d, ((0, 1), (0, 1)))
        ds = np.stack([d @ w["O"][:h].T, (d @ w["O"][h:].T)[::-1]], 1)  # (T, 2, B, H), each direction at its own step
        after, flat = np.zeros((2, n, h), np.float32), grad["W"].reshape(512, 3 * h)
        ut = w["U"].transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            s, z, q, m, rn = kept[i]
            dh = ds[i] + after
            dm = dh * (1 - z) * (1 - m * m)
            dz = dh * (s - m) * z * (1 - z)
            dq = dm * rn * q * (1 - q)
            da = np.concatenate([dz, dq, dm], -1)
            dr = np.concatenate([dz, dq, dm * q], -1)
            after = dh * z + dr @ ut
            grad["U"] += s.transpose(0, 2, 1) @ dr
            grad["b"] += da.sum(1)
            np.add.at(flat, both[i].ravel(), da.reshape(-1, 3 * h))
        return loss, grad


def train(pieces: list[tuple[str, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Network | None:
    """The network learned from (text, language) pairs; None without any."""
    pieces = sorted({(t, k) for t, k in pieces if has_letters(t)})
    if not pieces:
        return None
    net, rng = Network(sorted({k for _, k in pieces}), hidden, seed), np.random.default_rng(seed)
    code = {k: i for i, k in enumerate(net.langs)}
    rows = [stretches(t.encode("utf-8", "replace")) for t, _ in pieces]
    x, y = np.concatenate(rows), np.repeat([code[k] for _, k in pieces], [len(r) for r in rows])
    share = np.bincount(y, minlength=len(net.langs)) ** -0.5  # rare languages weigh more, but not as much as frequent ones together
    m, v = ({k: np.zeros_like(a) for k, a in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x), BATCH)
        _, grad = net.gradients(x[at], y[at], share[y[at]])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.03 * (1 - step / (steps + 1))
        for k, g in grad.items():
            g = g * min(1, 1 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def alien(text: str, rng: np.random.Generator) -> str:
    """The text in a made-up language: each letter, as one and the same each time, as a drawn letter of a-z or of a drawn script."""
    if rng.random() < 0.5:
        to = [chr(97 + i) for i in rng.permutation(26)]
    else:
        first = int(rng.integers(0xA1, 0xD7A0))
        to = [chr(first + i) for i in rng.permutation(26)]
    letters = {x: to[i % 26] for i, x in enumerate(sorted({c for c in text.lower() if c.isalpha()}))}
    return "".join([letters.get(c, c) for c in text.lower()])


def with_key(text: str, rng: np.random.Generator) -> str:
    """A run of the text's words, of 16 to 64 characters in all, with a word of 8 to 24 drawn letters and digits before, in or after it."""
    words, chars = text.split(), int(rng.integers(16, 65))
    run = words[int(rng.integers(len(words))) :] if words else []
    run = run[: max(1, int(np.searchsorted(np.cumsum([len(w) + 1 for w in run]), chars)))]
    key = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), int(rng.integers(8, 25))))
    at = int(rng.integers(len(run) + 1))
    return " ".join([*run[:at], key, *run[at:]])


def with_none(pieces: list[tuple[str, str]], seed: int = 5) -> list[tuple[str, str]]:
    """The pieces and, for a share ALIENS of them, one each in no language, for a share KEYS one each with a drawn word."""
    rng, pieces = np.random.default_rng(seed), sorted(pieces)
    aliens = [(alien(t, rng), NONE) for t, _ in pieces if rng.random() < ALIENS]
    return pieces + aliens + [(with_key(t, rng), k) for t, k in pieces if rng.random() < KEYS]


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(4)) == 2


def sample(docs: DataFrame, id_col: str, text: str, lang: str) -> list[tuple[str, str]]:
    rows = bare(docs, id_col, text, lang).toDF("k", "t", "lang").where(~held_out(F.col("k")) & F.col("lang").isNotNull() & F.col("t").isNotNull())
    h = F.xxhash64("k", "t", "lang", F.lit(11))
    cut = hash_cut(rows, h, SAMPLE)
    if cut is None:
        return []
    pieces = rows.where(h <= cut).select("lang", F.explode(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("p")).distinct()
    pieces = written(docs.sparkSession, pieces, "pieces")
    g = F.xxhash64("p", "lang", F.lit(13))
    cut = hash_cut(pieces, g, PIECES)
    got = pieces.where(g <= cut).collect() if cut is not None else []  # bounded, see the module's text
    dropped(docs.sparkSession, pieces)
    return [(r["p"], r["lang"]) for r in got]


def pooled(net: Network | None, texts: list[str | None], doubt: float = 0) -> list[tuple[str, float]]:
    """(language, score) of each text; the score of NONE is taken with doubt more bytes for which it is 0."""
    got = [("und", 0.0)] * len(texts)
    at = [i for i, t in enumerate(texts) if has_letters(t)] if net else []
    if at:
        rows = [stretches(texts[i].encode("utf-8", "replace")) for i in at]
        starts = np.cumsum([0, *(len(r) for r in rows[:-1])])
        sums = np.add.reduceat(net.label(np.concatenate(rows)).astype(np.float64), starts, axis=0)
        letters = sums.sum(1)
        first = sums.argmax(1)
        none = np.array([k == NONE for k in net.langs])[first]
        score = np.clip(sums.max(1) / (letters + doubt * none), 0, 1)
        for i, k, x in zip(at, first.tolist(), score.tolist()):
            got[i] = net.langs[k], x
    return got


def slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in parts of SLICE texts and SLICE_CHARS characters at most, or of one text."""
    part, chars = [], 0
    for t in texts:
        n = len(t or "")
        if part and (len(part) == SLICE or chars + n > SLICE_CHARS):
            yield part
            part, chars = [], 0
        part.append(t)
        chars += n
    if part:
        yield part


def learned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    return train(sample(docs, id_col, text, lang))


def identified(spark: SparkSession, docs: DataFrame, net: Network | None, id_col: str = "doc_id", text: str = "text", doubt: float = 0) -> DataFrame:
    """docs with the columns held_out, lang_pred and score; doubt as in `pooled`."""
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        got = [x for part in slices(texts.tolist()) for x in pooled(sent.value, part, doubt)]
        return pd.DataFrame(got, columns=["lang_pred", "score"])

    rows = with_row(docs, id_col, text).toDF("__row", "k", "t")
    got = rows.select("__row", F.coalesce(held_out(F.col("k")), F.lit(False)).alias("held"), predict.asNondeterministic()("t").alias("got"))  # so that no plan calls it twice
    return got.select(*unpacked(docs, held_out=F.col("held"), lang_pred=F.col("got.lang_pred"), score=F.col("got.score")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bare(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return identified(spark, docs, learned(docs)).select("doc_id", "held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in one of the languages: without those that have no letter and those that the network holds to be in none."""
    net = train(with_none(sample(docs, "doc_id", "text", "lang")), steps=STEPS_NONE)
    got = identified(spark, with_row(docs, "doc_id", "text"), net, doubt=DOUBT)
    kept = got.where((F.col("lang_pred") != NONE) | ((F.col("score") > 0) & (F.col("score") < ALIEN)))
    return kept.select(*unpacked(docs))


QUERIES = {"op3_language_id": op3_language_id}
SQL: dict[str, str] = {}
