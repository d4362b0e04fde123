"""BPE encoding and decoding by a tokenization automaton.

The token automaton accepts exactly the token sequences that byte-pair encoding gives: its state is the last token. It
begins with one state and an arc for each base symbol; each merge (a, b) -> c, in order of rank, is a gadget: b can no
longer follow a, and c gets the arcs into a and the arcs out of b as they are at that moment. Written out, these arcs are
(tokens x tokens); so a gadget stores only what it copies, as two short chains per token: what the token ends in, and what
it begins with, each with the rank up to which that part stood open to later merges. An arc (u, v) is barred if some merge
joins a part that u ends in with a part that v begins with while both stood open.

Words are read by symbols, so the token automaton is composed with the trie of its labels and made deterministic: a state
is the set of (node of the trie, last token before it) of all tokens that may be under way. Each prefix of a word has
exactly one last token by which it is accepted, so an arc (state, symbol) leads to one state and carries that token. States
and arcs are built when they are first reached and then looked up: one look at the table for each symbol of a word, and the
tokens are read off backwards by their lengths. Decoding emits the labels of the arcs in the tokenizer file's own form.

Words that aren't ASCII are normalized and cut by the library's own normalizer and pre-tokenizer, as the tokenizer file
states them, so that letters, case pairs and combining classes are those of its Unicode tables; ASCII is cut here.

Memory in a Python worker is bounded: STATES and ARCS of the table, kept in two generations, so that what was used lately
survives when one is full; CACHE_BYTES of each cache of encoded words, in which no word of over LONG characters stands.
Most words of a text are met again, the rest are few pieces in many guises (letter case, marks behind them), so words and
their pieces are cached apart, and a piece is encoded once for all its guises.

Defined cases: a null or empty text has no tokens; words have no bound of length; special tokens that stand in a text as
such are matched before normalization; equal rows get equal results; no rows give no rows; further columns, of whatever
names, are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import string
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import bare, bounded_batches, table

TOKENIZER = "word_bpe_49k.json"
STATES = 200_000
ARCS = 600_000
CACHE_BYTES = 96_000_000
LONG = 64
#: Documents whose results are held at once.
SLICE = 1000
#: Bytes of a cache's entry besides its texts.
ENTRY = 200
OPEN = 1 << 60
#: Bits of a symbol and of a token in the table.
SYMBOL, TOKEN = 12, 24
LAST = (1 << TOKEN) - 1
#: ASCII that stands in one piece with its like only, whatever comes before it, unless that is such a mark too.
MARKS = string.punctuation.replace("'", "")
#: White space to str.split() that isn't white space to the tokenizer.
ODD = regex.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class TwoGenerations(dict):
    """A cache of text -> bytes that makes missing entries and holds about `most` bytes; what was used lately survives when it is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old, self.held = make, most // 2, {}, 0

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) > LONG:
            return got
        self.held += ENTRY + 2 * len(key) + len(got)
        if self.held > self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = got
        return got


class Automaton:
    """Compiled from the tokenizer file: base symbols, merges in rank order, the suffix of a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rank: dict[tuple[int, int], int] = {}
        self.ends: dict[int, tuple] = {}
        self.begins: dict[int, tuple] = {}
        made = {}
        merges = list(merges)
        products = {a + b for a, b in merges}
        for s, i in vocab.items():
            if s not in products:  # a base symbol
                self.ends[i] = self.begins[i] = ((i, OPEN),)
                made[s] = i
        for r, (a, b) in enumerate(merges):
            c = a + b
            if c not in vocab:
                raise ValueError(f"merge {r} makes {c!r}, which has no id")
            if c in made:
                raise ValueError(f"merge {r} makes {c!r} a second time")
            if a not in made or b not in made:
                if a in vocab and b in vocab and (a in products or b in products):
                    continue  # its parts never come about, nor does it
                raise ValueError(f"merge {r} joins parts that no earlier merge makes")
            self.gadget(r, made[a], made[b], vocab[c])
            if vocab[c] in self.ends:
                made[c] = vocab[c]
        self.label(made)

    def label(self, made: dict[str, int]) -> None:
        """The trie of the tokens' labels: (node, symbol) -> node. A word's last symbol, with the suffix, is a symbol of its own."""
        self.symbols: dict[str, int] = {}
        self.trie: dict[int, int] = {}
        self.token, self.size = [-1], {}  # of a node; of a token, in symbols
        for s, i in made.items():
            end = bool(self.suffix) and s.endswith(self.suffix) and s != self.suffix
            text = s.removesuffix(self.suffix) if end else s
            read = [*text[:-1], text[-1] + self.suffix] if end else [*text]
            node = 0
            for x in read:
                arc = node << SYMBOL | self.symbols.setdefault(x, len(self.symbols))
                if arc not in self.trie:
                    self.trie[arc] = len(self.token)
                    self.token.append(-1)
                node = self.trie[arc]
            self.token[node], self.size[i] = i, len(read)
        if len(self.symbols) >= 1 << SYMBOL or max(made.values(), default=0) > LAST:
            raise ValueError("too many base symbols or tokens")
        self.last = {x.removesuffix(self.suffix): n for x, n in self.symbols.items() if x.endswith(self.suffix)}
        self.clear()

    def clear(self) -> None:
        """The table with its first state only: a token begins at the root, after none."""
        self.states: list[tuple] = [((0, -1),)]
        self.numbers = {self.states[0]: 0}
        self.table: dict[int, int] = {}
        self.old: tuple[list, dict, dict] = (self.states, {}, {})

    def number(self, state: tuple) -> int:
        """Of a state in this generation of the table."""
        got = self.numbers.get(state)
        if got is None:
            got = self.numbers[state] = len(self.states)
            self.states.append(state)
        return got

    def onward(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """The state that an arc leads to and the token that it carries: as the older generation has it, else made."""
        states, numbers, table = self.old
        to = table.get(numbers.get(state, -1) << SYMBOL | symbol)
        if to is not None:
            return states[to >> SYMBOL + TOKEN], to & LAST
        last, nodes = -1, []
        for node, before in state:
            step = self.trie.get(node << SYMBOL | symbol)
            if step is not None:
                nodes.append((step, before))
                t = self.token[step]
                if t >= 0 and last < 0 and (before < 0 or not self.barred(before, t)):
                    last = t
        if last < 0:
            raise ValueError("a symbol without an id")
        return (*nodes, (0, last)), last

    def gadget(self, r: int, a: int, b: int, c: int) -> None:
        if self.barred(a, b):
            return  # b can't follow a any more: the merge never applies
        self.rank[a, b] = r
        self.ends[c] = ((c, OPEN), *((x, min(o, r)) for x, o in self.ends[b]))
        self.begins[c] = ((c, OPEN), *((x, min(o, r)) for x, o in self.begins[a]))

    def barred(self, u: int, v: int) -> bool:
        for x, shut in self.ends[u]:
            for y, shut_y in self.begins[v]:
                r = self.rank.get((x, y))
                if r is not None and r < shut and r <= shut_y:
                    return True
        return False

    def build(self, state: int, symbol: int) -> int:
        """The arc of a state by a symbol: the next state, zeros for its symbol, the token that it carries. A full generation becomes the older one."""
        start = self.states[state]
        if len(self.states) >= STATES // 2 or len(self.table) >= ARCS // 2:
            kept = self.states, self.numbers, self.table
            self.clear()
            self.old = kept
        to, last = self.onward(start, symbol)
        arc = self.number(start) << SYMBOL | symbol
        self.table[arc] = self.number(to) << SYMBOL + TOKEN | last
        return self.table[arc]

    def encode(self, word: str) -> list[int]:
        """Ids of a word in byte symbols."""
        if not word:
            return []
        read = [*map(self.symbols.get, word[:-1]), self.last.get(word[-1])]
        if None in read:
            raise ValueError("a symbol without an id")
        table, at, came = self.table, 0, []  # at: a state with zeros for its symbol
        for x in read:
            try:
                to = table[at | x]
            except KeyError:
                to = self.build(at >> SYMBOL, x)
                table = self.table
            came.append(to)
            at = to >> TOKEN
        out, i, size = [], len(came), self.size
        while i:
            t = came[i - 1] & LAST
            out.append(t)
            i -= size[t]
        return out[::-1]


class Tokenizer:
    def __init__(self, spec: str):
        """spec: the text of a tokenizer file."""
        s = json.loads(spec)
        m, steps = s["model"], s["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in s["normalizer"]["normalizers"]]
        if m["type"] != "BPE" or m["dropout"] or m["continuing_subword_prefix"] or kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in steps] != ["Split", "ByteLevel"] or s["decoder"]:
            raise ValueError("this kind of tokenizer file isn't supported")
        self.automaton = Automaton(m["vocab"], [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]], m["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in s["added_tokens"]}
        self.labels = {i: t for t, i in (m["vocab"] | self.special).items()}
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"].replace(r"^\s", "^ "))
        cutter = tokenizers.Tokenizer.from_str(json.dumps(s | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.normalizer, self.cutter = cutter.normalizer, cutter.pre_tokenizer
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.parts = TwoGenerations(self._part, CACHE_BYTES // 2)
        self.symbols = TwoGenerations(self._symbols, CACHE_BYTES // 2)
        self.words = TwoGenerations(self._word, CACHE_BYTES)
        self.bytes = byte_symbols()

    def _word(self, word: str) -> bytes:
        """Of a stretch of text without white space."""
        if not word.isascii():
            body = word.rstrip(MARKS)
            if len(body) < len(word) and body[-1] in string.ascii_letters:  # marks never combine with what is before them
                return self.words[body] + self.parts[word[len(body) :]]
            return self._cut(word)
        plain = word.lower()
        if plain.isalpha():  # one piece
            return self.parts[plain]
        body = plain.rstrip(MARKS)
        if body.isalpha():  # two
            return self.parts[body] + self.parts[plain[len(body) :]]
        return b"".join([self.parts[p] for p in self.pieces.findall(plain)])

    def _cut(self, text: str) -> bytes:
        """Of a text cut by the library."""
        return b"".join([self.symbols[p] for p, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(text))])

    def _odd(self, text: str) -> bytes:
        """Of a text with what ODD finds."""
        if not text.isascii():
            return self._cut(text)
        return b"".join([self.parts[p] for p in self.pieces.findall(SPACES.sub(" ", text.lower()))])

    def _part(self, word: str) -> bytes:
        """Of an ASCII piece: its printable characters are their own symbols."""
        return self._symbols(word if word.isalpha() else "".join([self.bytes[b] for b in word.encode()]))

    def _symbols(self, word: str) -> bytes:
        ids = self.automaton.encode(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words, out = self.words, []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif ODD.search(part):
                out.append(self._odd(part))
            else:
                out += [words[w] for w in part.split()]
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(1)
def tokenizer_of(spec: str) -> Tokenizer:
    """Compiled once a Python worker, whose tasks go on with its table and caches; Spark ends workers that are idle."""
    return Tokenizer(spec)


def path_of(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), and with with_ids the ids themselves, of each row.

    The tokenizer file is read by the driver only and sent to the workers, which compile it once.
    """
    bounded_batches(spark)
    with open(path or path_of(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = bare(docs, id_col, text).toDF("id", "t")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer_of(spec.value)
        for b in (whole.iloc[i : i + SLICE] for whole in batches for i in range(0, len(whole), SLICE)):
            n, ids, decoded, lists = [], [], [], []
            for t in b["t"]:
                packed = tok.packed(t)
                got = np.frombuffer(packed, "<u4")
                n.append(len(got))
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(tok.decode(got.tolist()).encode()).hexdigest())
                if with_ids:
                    lists.append(got.astype("int32"))
            yield pd.DataFrame({"id": b["id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded} | ({"ids": lists} if with_ids else {}))

    return rows.mapInPandas(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with their number and checksums."""
    return encoded(spark, docs, with_ids=True).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_bpe_automaton": op7_bpe_automaton}
SQL: dict[str, str] = {}
