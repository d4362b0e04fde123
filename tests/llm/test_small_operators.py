"""Sharding, line dedup, URL filter, quality rules and decontamination: brute force and edge cases."""

import datetime
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from trailmark.llm import decontamination, line_dedup, quality_rules, sharding, url_filter
from trailmark.llm.common import row_key

DOC = "doc_id long, text string, source string, extra string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], DOC)


# sharding


def brute_walk(counts, shards, vnodes, cells):
    """Every row by itself: home rows first, in ring order, then clockwise to the first shard with room."""
    nodes, n = sharding.ring(shards, vnodes, cells), sum(counts.values())
    cap, held, placed, over = sharding.capacities(n, shards, None), [0] * shards, {}, []
    for cell in sorted(counts):
        home = next((i for i, (e, _) in enumerate(nodes) if e >= cell), 0)
        for r in range(counts[cell]):
            s = nodes[home][1]
            if held[s] < cap[s]:
                placed[cell, r] = (s, held[s])
                held[s] += 1
            else:
                over.append((home, cell, r))
    for home, cell, r in over:
        i = home
        while held[s := nodes[i % len(nodes)][1]] >= cap[s]:
            i += 1
        placed[cell, r] = (s, held[s])
        held[s] += 1
    return placed


@pytest.mark.parametrize("seed", range(5))
def test_walk_equals_brute_force(seed):
    rng = random.Random(seed)
    counts = {c: rng.choice([1, 2, 50]) for c in rng.sample(range(256), rng.randint(1, 90))}
    got = {(c, r): (s, at + r - lo) for c, lo, hi, s, at in sharding.walk(counts, 7, 5, 256, None) for r in range(lo, hi)}
    assert got == brute_walk(counts, 7, 5, 256)


def test_shards_are_even_and_slots_gapless(spark):
    rows = [(i, f"t{i % 9}" * (i % 50), "a") for i in range(500)] + [(None, None, "a")] * 3 + [(7, "same", "a")] * 90
    got = sharding.assign(spark, docs(spark, rows), "doc_id", "text", 40).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and len(by) == 40 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    one = next(r for r in got if r["doc_id"] == 44)
    text = "t8" * 44
    assert one["size"] == len(text) + 16 and one["text_crc32"] == zlib.crc32(text.encode())
    assert [r["size"] for r in got if r["doc_id"] is None] == [16] * 3


@pytest.mark.parametrize("load,most", [(1.25, 0.05), (None, 0.08)])
def test_few_rows_move_when_a_shard_is_added(load, most):
    """From 40 to 41 shards, of which 2.4 % must move: about as many at load 1.25, somewhat more at the exact quota that the query uses."""
    counts = {c: 1 for c in range(0, 1 << 14)}
    at = lambda n: {(c, r): s for c, lo, hi, s, _ in sharding.walk(counts, n, 100, 1 << 14, load) for r in range(lo, hi)}
    a, b = at(40), at(41)
    assert sum(a[k] != b[k] for k in a) / len(a) < most


def test_capacities_are_as_stated():
    assert sharding.capacities(1000, 40, 1.25) == [32] * 40 and sharding.capacities(1001, 40, 1.25) == [32] * 40 and sharding.capacities(1000, 40, 1.1) == [28] * 40
    assert sorted(sharding.capacities(1000, 7, None)) == [142] + [143] * 6


def test_hot_keys_are_ranked_in_parts(spark):
    """A third of the rows under null, a third under one id, with different texts, and one row 25,000 times: long ranges are cut."""
    rows = [(None, f"text {i}", "a") for i in range(900)] + [(7, f"other {i}", "a") for i in range(900)] + [(i, "x", "a") for i in range(900)]
    d = docs(spark, rows).unionByName(docs(spark, [(-1, "again", "a")]).select("*", F.explode(F.sequence(F.lit(1), F.lit(25000)))).drop("col"))
    clash = d.withColumnsRenamed({"extra": "shard"}).withColumns({"n": F.lit(1), "cell": F.lit(2), "part": F.lit(3)})
    got = sharding.assign(spark, clash, "doc_id", "text", 40).toPandas()
    assert len(got) == 27700 and got.groupby("shard")["slot"].agg(lambda s: sorted(s) == list(range(len(s)))).all()
    n = got["shard"].value_counts()
    assert len(n) == 40 and n.max() - n.min() <= 1
    want = sorted((i is None, i or 0, zlib.crc32(t.encode())) for i, t, _ in rows + [(-1, "again", "a")] * 25000)
    assert sorted((k != k, 0 if k != k else int(k), int(c)) for k, c in zip(got["doc_id"], got["text_crc32"])) == want


def test_very_long_text_is_measured_whole(spark):
    text = "é" * 3_000_000
    got = sharding.assign(spark, docs(spark, [(1, text, "a")]), "doc_id", "text").first()
    assert got["size"] == 6_000_016 and got["text_crc32"] == zlib.crc32(text.encode())


def test_sharding_no_rows(spark):
    assert sharding.assign(spark, docs(spark, []), "doc_id", "text").count() == 0


# line dedup


def line_rows():
    rows = [(i, f"own line number {i} with some more words\nFooter here\n\nlast {i}", f"s{i % 15}") for i in range(60)]
    rows += [(100 + i, "whole copy line one\nwhole copy line two", f"s{i % 15}") for i in range(30)]
    rows += [(200, None, "s1"), (201, "", "s1"), (202, "Footer here", None), (203, "  Footer here  \nmuch longer line of its own", "s1"), (203, "  Footer here  \nmuch longer line of its own", "s1")]
    return rows + [(204, "Footer here\n" * 50000 + "own", "s2")]


@pytest.mark.parametrize("most", [line_dedup.BROADCAST_LINES, -1])
def test_boilerplate_lines_go_but_copies_stay(spark, monkeypatch, most):
    """Where the row is read and by a join."""
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
    got = {r["doc_id"]: r for r in line_dedup.without_boilerplate(spark, docs(spark, line_rows())).collect()}
    assert got[5]["text"] == "own line number 5 with some more words\n\nlast 5" and got[5]["n_removed"] == 1
    assert got[100]["text"] == "whole copy line one\nwhole copy line two" and got[100]["n_boilerplate"] == 2 and got[100]["n_removed"] == 0
    assert got[200]["text"] is None and got[200]["n_lines"] == 0 and got[201]["text"] == "" and got[202]["text"] == "Footer here" and got[203]["text"] == "much longer line of its own"
    assert got[204]["text"] == "own" and got[204]["n_removed"] == 50000 and got[5]["extra"] == "x"


@pytest.mark.parametrize("most", [line_dedup.BROADCAST_LINES, -1])
def test_clashing_columns_of_lines(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
    d = docs(spark, line_rows()).withColumns({c: F.lit("mine") for c in ("n_lines", "n_boilerplate", "n_removed", "h", "line", "site", "t", "__row", "__got", "__key", "__bad")})
    got = line_dedup.stage(spark, d, "")
    assert got.columns == d.columns and {r["n_lines"] for r in got.collect()} == {"mine"}
    assert line_dedup.without_boilerplate(spark, d).where("doc_id = 5").first()["n_lines"] == 3


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(n * 100 + i, f"line on {n} sites\nfiller text of document {n} {i} that is long", f"s{i}") for n in range(9, 16) for i in range(n)]
    bad = line_dedup.boilerplate(spark, docs(spark, rows))
    want = spark.createDataFrame([(f"line on {n} sites",) for n in range(12, 16)], "l string").select(F.xxhash64("l").alias("h"))
    assert sorted(bad.collect()) == sorted(want.collect())


def test_long_lines_need_fewer_sites(spark):
    """6 sites for 20 characters, 12 for fewer."""
    rows = [(n * 100 + i, f"a footer that stands on {n} sites\nshort {n}\nfiller text of document {n} {i} that is longer than all", f"s{i}") for n in (5, 6, 11, 12) for i in range(n)]
    got = {r["doc_id"]: r["text"].split("\n")[:-1] for r in line_dedup.stage(spark, docs(spark, rows), "").collect()}
    assert {i // 100: v for i, v in got.items()} == {5: ["a footer that stands on 5 sites", "short 5"], 6: ["short 6"], 11: ["short 11"], 12: []}


def test_mostly_boilerplate_is_cut_if_own_lines_remain(spark):
    foot = "the footer of all these sites, far longer than what else stands there"
    rows = [(i, f"own {i}\n{foot}", f"s{i}") for i in range(12)] + [(50, foot, "s1"), (51, f"\n{foot}\n", "s1")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.stage(spark, docs(spark, rows), "").collect()}
    assert got == {i: f"own {i}" for i in range(12)} | {50: foot, 51: f"\n{foot}\n"}


@pytest.mark.parametrize("name", sorted(line_dedup.QUERIES))
def test_line_dedup_equals_sql(spark, name):
    duckdb, d = pytest.importorskip("duckdb"), "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = line_dedup.QUERIES[name](spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({line_dedup.SQL[name]})").fetchall())


def test_line_dedup_no_rows(spark):
    assert line_dedup.without_boilerplate(spark, docs(spark, [])).count() == 0


# url filter


def test_entries_are_active_between_their_dates(spark):
    day = lambda n: datetime.date(2024, 1, n)
    log = [("bad.com", "add", day(5)), ("bad.com", "remove", day(10)), ("bad.com", "add", day(20)), ("www.bad.com", "add", day(8)), ("day.org", "add", day(3)), ("day.org", "remove", day(3)), (None, "add", day(1)), ("x.y", "add", None), ("x.y", "drop", day(1))]
    entries = spark.createDataFrame(log, "pattern string, action string, date date")
    urls = [("http://www.BAD.com/a", d) for d in (4, 5, 9, 10, 20)] + [("https://u:p@bad.com:80?x", 9), ("https://notbad.com/", 9), ("bad.com", 9), (None, 9), ("http://day.org", 4), ("http://x.y/", 4)]
    caps = spark.createDataFrame([(i, u, day(d), "x") for i, (u, d) in enumerate(urls)] + [(99, "http://bad.com", None, "x")], "id int, url string, at date, pattern string")
    got = {r["id"]: (r["blocked"], r["pattern"]) for r in url_filter.evaluated(spark, caps, entries, "id", "url", "at").collect()}
    no, www = (False, None), (True, "www.bad.com")
    assert got == {0: no, 1: (True, "bad.com"), 2: www, 3: www, 4: www, 5: (True, "bad.com"), 6: no, 7: no, 8: no, 9: no, 10: no, 99: no}


def test_url_filter_empty_tables(spark):
    e = spark.createDataFrame([], "pattern string, action string, date date")
    caps = spark.createDataFrame([(1, "http://a.b/", datetime.date(2024, 1, 1))], "id int, url string, at date")
    assert [r["blocked"] for r in url_filter.evaluated(spark, caps, e, "id", "url", "at").collect()] == [False]
    assert url_filter.evaluated(spark, caps.limit(0), e, "id", "url", "at").count() == 0


def test_url_filter_repeats_ties_and_long_urls(spark):
    day = datetime.date(2024, 1, 1)
    e = spark.createDataFrame([("a.b", "add", day)] * 3 + [("x.a.b", "add", day)], "pattern string, action string, date date")
    long = "http://" + "x." * 300 + "a.b/" + "p" * 500_000
    caps = spark.createDataFrame([(1, "http://a.b/", day)] * 4 + [(2, long, day)], "id int, url string, at date")
    got = sorted((r["id"], r["pattern"]) for r in url_filter.evaluated(spark, caps, e, "id", "url", "at").collect())
    assert got == [(1, "a.b")] * 4 + [(2, "x.a.b")]


# quality rules


def measured(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def quality_texts():
    rng = random.Random(1)
    got = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a", "x y\nx y\n\nx y ", "é # ü $$ 𝒳 <b>", "  a b  "]
    return got + [" ".join(rng.choice("abcd" if i % 2 else "abcdefghijklmnop") for _ in range(rng.randint(0, 90))) for i in range(60)] + ["w " * 30000, " ".join(map(str, range(20000)))]


def test_measurements_equal_brute_force(spark):
    texts = quality_texts()
    got = {r["id"]: tuple(r)[1:6] for r in quality_rules.measured(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert got == {i: measured(t) for i, t in enumerate(texts)}


def test_ledger_and_policies(spark):
    texts = quality_texts()
    d = docs(spark, [(i, t, None) for i, t in enumerate(texts)]).withColumns({c: F.lit("mine") for c in ("id", "t", "w", "s", "r", "lines", "fails", "n_words")})
    entries = quality_rules.stored(spark, d)
    got = {r["id"]: r for r in quality_rules.judged(entries).collect()}
    assert {i: tuple(r)[1:6] for i, r in got.items()} == {i: measured(t) for i, t in enumerate(texts)}
    for i, r in got.items():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) == bool(r["fails"] & 3) and r["kept"] == (r["fails"] == 0) and r["policy"] == "v3-all"
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.judged(entries, "v1-base").collect())
    none = quality_rules.stored(spark, d.limit(0))
    assert none.count() == 0 and {(r["n_failed"], r["n_only"]) for r in quality_rules.ablations(none).collect()} == {(0, 0)}


def test_windows_whose_hashes_collide(spark):
    """Two windows of one 44-bit hash prefix that lie alternately: the repeats of both count."""
    text = "a9979724 b c X1 a13218611 b c X2 a9979724 b c"
    assert quality_rules.measured(docs(spark, [(1, text, None)])).first()["n_repeat_words"] == measured(text)[4] == 6


def test_ablations(spark):
    e = spark.createDataFrame([(0b001,), (0b001,), (0b011,), (0b100,), (0,)], "fails long")
    rules = [("a", ""), ("b", ""), ("c", "")]
    got = {(r["policy"], r["rule"]): (r["n_failed"], r["n_only"]) for r in quality_rules.ablations(e, {"p": 0b011, "q": 0b100}, rules).collect()}
    assert got == {("p", "a"): (3, 2), ("p", "b"): (1, 0), ("q", "c"): (1, 1)}


# decontamination


def hit_words(text, items, window=10):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w, hit, found = re.findall(word, low(text)), set(), set()
    for name, t in items:
        x = re.findall(word, low(t))
        n = min(window, len(x))
        for s in range(max(len(x) - window, 0) + 1) if x else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[s : s + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(name))
    return len(hit), sorted(found - {"None"})


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "of", "and", "É", "x1"] + [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 9, 10, 11, 25])))) for i in range(12)] + [(50, None), (51, "..."), (52, "Of the"), (52, "x1 x1 x1"), (None, "w1 w2 w3 w4"), (53, "the " * 14)]
    rows = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            t[5:5] = rng.choice(items[:12])[1].upper().split()
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(t), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, "the " * 40, "s"), (903, rows[0][1], "s"), (0, rows[0][1], "s"), (None, rows[3][1], "s")]
    bench = spark.createDataFrame([(a, b, "z") for a, b in items], "item_id long, text string, doc_id string")
    found = {r["key"]: (r["n_hit"], r["items"]) for r in decontamination.hits(decontamination.phrase_matches(spark, decontamination.index_of(spark, docs(spark, rows)), bench)).collect()}
    keys = {(r["doc_id"], r["text"]): r["k"] for r in docs(spark, rows).select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("k")).collect()}
    for i, t, _ in rows:
        assert found.get(keys[i, t], (0, [])) == hit_words(t, items), (i, t)


def matches(spark, d, bench):
    return decontamination.phrase_matches(spark, decontamination.index_of(spark, d), bench)


def test_decontamination_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert matches(spark, docs(spark, [(1, "a b", "s")]), bench).count() == 0
    assert matches(spark, docs(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    clash = docs(spark, [(1, "a b", "s"), (2, "c", "s"), (3, None, "s")]).withColumns({c: F.lit("mine") for c in ("key", "term", "w", "id", "t", "__row", "__key")})
    kept = decontamination.stage
    import tempfile
    with tempfile.TemporaryDirectory() as at:
        spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = kept(spark, clash, at)
        assert got.columns == clash.columns and sorted(r["doc_id"] for r in got.collect()) == [2, 3]


def test_very_long_texts_and_items(spark):
    """An item and a text of 20,000 words with a common passage, and terms of equal rarity."""
    words = [f"v{i}" for i in range(20000)]
    item = [f"u{i}" for i in range(19000)] + words[500:530]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontamination.hits(matches(spark, docs(spark, [(1, " ".join(words), "s")] * 2 + [(2, "v500 " * 30000, "s")]), bench)).collect()
    assert [(r["n_hit"], r["items"]) for r in got] == [(30, ["1"])]


def near_places(text, items, window=10, slop=5):
    """By the definition: for each item the 0-based positions of the window's rarest term (counted over all texts) with all its words around."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    got = set()
    for name, words, term in items:
        for p, x in enumerate(w):
            if x == term and set(words) <= set(w[max(0, p - window + 1 - slop) : p + window + slop]):
                got.add((name, p))
    return got


def test_proximity_equals_brute_force(spark):
    rng, words = random.Random(9), [f"w{i}" for i in range(14)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 3, 10, 12])))) for i in range(8)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 50))), "s") for i in range(50)] + [(90, None, "s")]
    seen = {}
    for _, t, _ in rows:
        for x in (t or "").split():
            seen[x] = seen.get(x, 0) + 1
    windows = []
    for i, t in items:
        x = t.split()
        for at in range(max(len(x) - 10, 0) + 1):
            part = set(x[at : at + 10])
            windows.append((i, part, min(part, key=lambda y: (seen.get(y, 0), y))))
    d = docs(spark, rows)
    got = decontamination.proximity_matches(spark, decontamination.index_of(spark, d), spark.createDataFrame(items, "item_id long, text string")).collect()
    key = {r["k"]: r["text"] for r in d.select("text", row_key(F.col("doc_id"), F.col("text")).alias("k")).collect()}
    assert sorted((key[r["key"]], r["item"], r["pos"]) for r in got) == sorted((t, n, p) for _, t, _ in rows if t for n, p in near_places(t, windows)) and len(got) > 20


def test_without_broadcasts_the_results_are_the_same(spark, monkeypatch):
    d = docs(spark, [(i, f"x {i} the rare{i % 5} words of one item here now then end", "s") for i in range(40)])
    bench = spark.createDataFrame([(j, f"the rare{j} words of one item here now then end") for j in range(5)], "item_id long, text string")
    run = lambda: sorted(map(str, matches(spark, d, bench).collect()))
    entries = spark.createDataFrame([("a.b", "add", datetime.date(2024, 1, 1))], "pattern string, action string, date date")
    caps = spark.createDataFrame([(i, f"http://{'x.' * (i % 2)}a.b/", datetime.date(2024, 1, 1 + i)) for i in range(9)], "id int, url string, at date")
    urls = lambda: sorted(map(str, url_filter.evaluated(spark, caps, entries, "id", "url", "at").collect()))
    before = run(), urls()
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", -1)
    assert (run(), urls()) == before and len(before[0]) >= 40


def test_repeats_of_a_very_long_text_are_all_found(spark):
    """Over a million words: 150,000 windows that stand there twice, apart, are 900,000 words."""
    text = " ".join(f"a{i % 150000} b{i % 150000} c{i % 150000} u{i}" for i in range(300000))
    got = quality_rules.measured(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["n_words"] == 1200000 and got["n_repeat_words"] == 900000
