"""Phrase mining, MinHash near-dedup and conversation repair against brute force, and their defined cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from trailmark.llm import conversation_repair, minhash_dedup, phrase_mining

DOCS = "doc_id long, text string, lang string, phrase string, __row string"
CHATS = "conv_id long, turn long, role string, text string, present string, id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", "y") for i, t, g in rows], DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# Phrases


def mined(rows, most, least, top):
    f, n = Counter(), Counter()
    for _, t, g in rows:
        g = "und" if g is None else g
        for piece in re.split("[.,;:!?\n-\r]", lower(t or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[g] += len(w)
            f.update((g, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = defaultdict(list)
    for (g, p), a in f.items():
        if len(p) < 2 or any(b >= a and len(q) > len(p) and h == g and any(q[i : i + len(p)] == p for i in range(len(q))) for (h, q), b in f.items()):
            continue
        score, _, l, r = min((1000 * a * n[g] // (f[g, p[:k]] * f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
        out[g].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((g, i + 1, p.decode(), -a, l, r, n[g], -s) for g, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def found(spark, rows, most=5, least=4, top=2000, buckets=None):
    every, total = phrase_mining.frequent_phrases(spark, docs(spark, rows), most=most, least=least, buckets=buckets)
    got = phrase_mining.best_phrases(phrase_mining.scored(every, total), top)
    return sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n=300):
    r = random.Random(seed)
    words = ["a", "b", "c", "The", "the", "é", "A b", "z z", "\x00", "d\te", "new york city hall", "x"]
    text = lambda: r.choice(["", " ", ". "]).join([" ".join(r.choice(words) + r.choice(["", "", "", ",", ".", "\n", "\x0b"]) for _ in range(r.randint(0, 30)))])
    return [(i, text(), r.choice(["en", "en", "de", None, "und", ""])) for i in range(n)]


@pytest.mark.parametrize("most, least, top, buckets", [(5, 4, 2000, None), (5, 4, 7, 1 << 12), (3, 2, 2000, 1 << 12), (2, 5, 50, None)])
def test_phrases_equal_brute_force(spark, most, least, top, buckets):
    rows = corpus(most)
    want = mined(rows, most, least, top)
    assert len(want) > 10 and found(spark, rows, most, least, top, buckets) == want


def test_phrases_of_odd_rows(spark):
    assert found(spark, [(1, None, None), (2, "", "en"), (3, " .,\n", "en")]) == []
    assert found(spark, []) == []
    rows = [(None, "of course " * 50_000, "en"), (1, None, "en"), (1, "of course. Of Course", None), (1, "of course. Of Course", None)]
    assert found(spark, rows) == mined(rows, 5, 4, 2000)


def test_longer_phrases_cover(spark):
    rows = [(i, "alpha beta gamma delta epsilon zeta" if i < 9 else "beta gamma", "en") for i in range(12)]
    got = {r[2] for r in found(spark, rows)}
    assert got == {"alpha beta gamma delta epsilon", "beta gamma delta epsilon zeta", "beta gamma"}


def test_bucket_counts_keep_what_is_frequent(monkeypatch, spark):
    """Flushes, cleared caches and full bitmaps change no count."""
    rows = corpus(9)
    want = mined(rows, 5, 3, 2000)
    monkeypatch.setattr(phrase_mining, "_HELD", 5)
    monkeypatch.setattr(phrase_mining, "_CACHE", 3)
    assert found(spark, rows, least=3, buckets=1 << 12) == want


def test_large_products_are_exact(spark):
    n = 10**15 - 1
    every = spark.createDataFrame([("en", "p", 1, n - 2), ("en", "q", 1, n - 7), ("en", "p q", 2, n // 1000)], "lang string, phrase string, k int, f long")
    got = phrase_mining.scored(every, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert got["score"] == 1000 * (n // 1000) * n // ((n - 2) * (n - 7))


# MinHash


def sets_of(t, k):
    w = re.findall("[^ \t-\r]+", lower(t or ""))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def linked(rows, k=4):
    s = [sets_of(t, k) for _, t, _ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                up[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        ids[find(i)] += [d] if d is not None else []
    # a set without words has its own id
    return sorted(((d, len(s[i]), min(ids[find(i)], default=None) if s[i] else d) for i, (d, _, _) in enumerate(rows)), key=str)


def near(spark, rows, k=4):
    return sorted((tuple(r) for r in minhash_dedup.grouped(spark, docs(spark, rows), shingle=k).select("id", "n_shingles", "component_id").collect()), key=str)


def families(seed, sizes):
    r = random.Random(seed)
    rows, words = [], [f"w{i}" for i in range(400)]
    for size in sizes:
        base = [r.choice(words) for _ in range(r.randint(40, 120))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows), r.choice([" ", "\n", " \t"]).join(x.upper() if r.random() < 0.1 else x for x in w), "en"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [2_000_000, 20_000])
def test_near_copies_equal_all_pairs(monkeypatch, spark, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", block)
    rows = families(4, [1] * 40 + [2] * 10 + [5, 9, 60])
    want = linked(rows)
    assert len({x[2] for x in want}) > 40 and near(spark, rows) == want


def test_near_copies_of_odd_rows(spark):
    rows = [(5, None, "x"), (4, "", "x"), (3, " \n\t", "x"), (9, "One", "x"), (8, "one", "x"), (7, "ONE two", "x"), (7, "one  two", "x"), (None, "one two", "x"), (None, "alone here", "x"), (None, None, "x"), (2, "é É", "x"), (1, "é é", "x"),
            (20, "big " * 100_000, "x"), (21, "Big " * 90_000, "x"), (30, "same row again and again", "x"), (30, "same row again and again", "x"), (30, "quite another text under that number", "x")]
    assert near(spark, rows) == linked(rows)
    assert near(spark, []) == []


def test_every_position_counts_once(spark):
    """Signatures of equal sets agree throughout; unlike sets hardly."""
    a, b = (minhash_dedup.signature(minhash_dedup.shingles([b"%d" % (x + i) for i in range(50)], 4)) for x in (0, 1000))
    assert (a == a).all() and (a == b).sum() < minhash_dedup.LEAST
    assert len(minhash_dedup.keys(a)) == minhash_dedup.BANDS


# Conversations


def harm(rows):
    for c, n, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        kind = crc32(f"{s(c)}:{s(n)}".encode()) % 20
        role, text = s(role), s(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield c, n, role, text


def cheapest(rows):
    """Every edit string by layers; rows are (role, text)."""
    seen, best = set(), {"": (0, "")}  # by the initials so far, shortened to what the grammar has to know

    def short(x):
        return x if len(x) < 3 else x[:1] * (x[0] == "s") + ("u" if (len(x) - (x[0] == "s")) % 2 else "ua")

    def grown(b):
        for _ in range(3):
            for x, (c, e) in list(b.items()):
                for letter in "ua":
                    y = short(x + letter)
                    if re.fullmatch("s?(ua)*u?", x + letter) and (c + 2, e + "I") < b.get(y, (9e9, "")):
                        b[y] = (c + 2, e + "I")
        return b

    best = grown(best)
    for role, text in rows:
        bad = not re.search("[^ \t-\r]", text) or (role, text) in seen
        cut = not re.search(r"[.!?][ \t-\r]*\Z", text)
        seen.add((role, text))
        new = {}
        for x, (c, e) in best.items():
            ways = [(x, c + 3, "D")] + ([] if bad else [(x + role[:1], c + cut, "K"), (x + "u", c + 2 + cut, "R"), (x + "a", c + 2 + cut, "R")])
            for y, d, letter in ways:
                if (letter == "D" or y != x and re.fullmatch("s?(ua)*u?", y)) and (d, e + letter) < new.get(short(y), (9e9, "")):
                    new[short(y)] = (d, e + letter)
        best = grown(new)
    return min(v for k, v in best.items() if re.fullmatch("(s?(ua)+)?", k))


def report(rows):
    by, out = defaultdict(list), []
    for c in {r[0] for r in rows}:
        by[c] = []
    for c, n, role, text in harm(rows):
        by[c].append((n is not None, n or 0, role, text, n))
    for c, x in by.items():
        x.sort(key=lambda y: (y[0], y[1], y[2].encode(), y[3].encode()))
        turns = [y[4] for y in x if y[4] is not None]
        seen, n = set(), Counter()
        for _, _, role, text, _ in x:
            last = re.search(r"[^ \t-\r](?=[ \t-\r]*\Z)", text)
            n["b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else ""] += 1
            seen.add((role, text))
        ini = [y[2][:1] for y in x]
        cost, audit = cheapest([(y[2], y[3]) for y in x])
        lines, at, prev = [], 0, ""
        for e in audit:
            ask = "assistant" if prev == "u" else "user"
            role, text = (x[at][2], x[at][3]) if e != "I" else (ask, "")
            at += e != "I"
            if e != "D":
                lines.append(f"{role if e == 'K' else ask}:{text}")
                prev = lines[-1][0]
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["b"], n["d"], n["t"], sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:])), cost, audit, sha))
    return sorted(out, key=str)


def chats(seed, n=120):
    r, rows = random.Random(seed), []
    for c in [*range(n), None]:
        for t in range(r.randint(0, 14)):
            rows.append((c, r.choice([t, t, t, t + 1, None, -3]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "su"]), r.choice(["Yes.", "no", "", None, " \n", "What?\t", "é!", "ok. then", f"{r.random()}."])))
    return rows


def told(spark, rows):
    df = spark.createDataFrame([(*r, "p", "q") for r in rows], CHATS)
    return sorted((tuple(r) for r in conversation_repair.reports(conversation_repair.damaged(df)).collect()), key=str)


def test_repairs_equal_layers(spark):
    rows = chats(3)
    assert told(spark, rows) == report(rows)
    assert told(spark, []) == []


def test_search_in_blocks(monkeypatch):
    r = random.Random(8)
    for _ in range(1500):
        monkeypatch.setattr(conversation_repair, "BLOCK", r.choice([1, 2, 5, 256]))
        rows = [(r.choice(["user", "assistant", "system", "x", ""]), r.choice(["", "Hi.", "Yes", " ", "b", f"{r.random()}."])) for _ in range(r.randint(0, 25))]
        c = conversation_repair.Conversation(True)
        for i, x in enumerate(rows):
            c.add(i, *x)
        got = c.end()
        assert got[5:7] == cheapest(rows)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[1][:1] for x in c.out)) and hashlib.sha256("\n".join(f"{x[1]}:{x[2]}" for x in c.out).encode()).hexdigest() == got[7]


def test_long_conversation_is_a_stream():
    c, most = conversation_repair.Conversation(False), 0
    for i in range(30_000):
        c.add(i, ("user", "assistant", "system")[i * 7 % 3], "" if i % 5 == 0 else f"{i}.")
        most = max(most, len(c.waiting))
    assert most < 3 * conversation_repair.BLOCK and len(c.end()[6]) >= 30_000


def test_dropped_conversation_and_repaired_rows(spark):
    gone = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    assert told(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    df = spark.createDataFrame([(1, 0, "user", "A?", "", ""), (1, 1, "user", "B?", "", ""), (1, 2, "assistant", "C.", "", ""), (2, 0, "assistant", "D.", "", "")], CHATS)
    got = [tuple(r) for r in conversation_repair.repaired(df).orderBy("conv_id", "position").collect()]
    assert got == [(1, 1, "user", "A?", "K"), (1, 2, "assistant", "", "I"), (1, 3, "user", "B?", "K"), (1, 4, "assistant", "C.", "K"), (2, 1, "user", "", "I"), (2, 2, "assistant", "D.", "K")]


def test_group_of_any_key_type(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi."), (None, 2, "assistant", "Yo.")], "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: r["audit"] for r in conversation_repair.reports(conversation_repair._rows(df)).collect()}
    assert got == {"a": "KI", None: "IK"}
    assert conversation_repair.damaged(df.limit(0)).where(F.col("present")).count() == 0
