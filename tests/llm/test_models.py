"""SimHash, BPE, language ID, HTML extraction, weak labels: brute force, the tokenizer library, held-out accuracy."""

import os
import random
import re
import unicodedata

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trailmark.llm import bpe_automaton, html_extract, language_id, simhash_dedup, weak_quality

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
DOC = "doc_id long, text string, fp string"


# simhash


def brute_print(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)] * bool(w))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints, bits=3):
    """Of each node the least node reachable."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(root)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= bits and (ra := find(a)) != (rb := find(b)):
                root[max(ra, rb)] = min(ra, rb)
    return {p: find(p) for p in nodes}


def near_texts():
    rng, texts = random.Random(2), [None, "", "  ", "One", "one two", "ONE two\tthree", "É é"]
    base = [f"word{rng.randint(0, 99)}" for _ in range(300)]
    for i in range(40):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(300)] = f"x{rng.randint(0, 9)}"
        texts.append(" ".join(w))
    return texts + [" ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 60))) for _ in range(60)] + [texts[9]] * 5


def test_fingerprints_and_components_equal_brute_force(spark):
    texts = near_texts()
    rows = [(1000 - i, t, "z") for i, t in enumerate(texts)] + [(None, texts[9], "z"), (1000, texts[0], "z")]
    got = simhash_dedup.grouped(spark, spark.createDataFrame(rows, DOC)).collect()
    prints = {(i, t): brute_print(t) for i, t, _ in rows}
    comp = brute_components(set(prints.values()))
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    want = sorted((p if p < 1 << 63 else p - (1 << 64), least[comp[p]], i or -1) for (i, t, _), p in ((r, prints[r[0], r[1]]) for r in rows))
    assert sorted((r["fp"], r["component_id"], r["id"] or -1) for r in got) == want


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links_equal_all_pairs(spark, bits):
    rng = random.Random(bits)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), k)) for s in seeds for k in (0, 1, 1, 2, 2, 3, 3, 4) for _ in range(3)} | {0, (1 << 64) - 1, 7}
    signed = {p if p < 1 << 63 else p - (1 << 64): p for p in prints}
    got = simhash_dedup.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bits).collect()
    want = {(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= bits}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_the_tally_drops_candidates(spark):
    """Pairs that share 4 bytes have 1 list in common, those within 3 bits 5 or more: the count decides before any bit is compared."""
    rng = random.Random(3)
    near = [rng.getrandbits(64) for _ in range(20)]
    prints = [p ^ (((1 << 32) - 1 & rng.getrandbits(32) | 0x01010101) << 32) for p in near] + [p ^ 7 for p in near] + near  # four bytes differ; one byte
    frame = spark.createDataFrame([(p if p < 1 << 63 else p - (1 << 64),) for p in prints], "fp long")
    n = [r["n"] for r in simhash_dedup.tallied(frame).collect()]
    assert n.count(1) == 20 and n.count(35) == 20 and len(n) == 40 and simhash_dedup.links(frame).count() == 20


def test_postings_are_never_broadcast(spark):
    """Spark takes them for as small as the table of fingerprints, of which each makes 70."""
    prints = simhash_dedup.written(spark, spark.range(1000).select(F.xxhash64("id").alias("fp")), "prints")
    plan = simhash_dedup.tallied(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_bands_are_never_broadcast(spark):
    from trailmark.llm import minhash_dedup
    nodes = simhash_dedup.written(spark, spark.range(6).select(F.col("id").alias("node"), F.array(F.lit(7), F.col("id") % 2 + 10, F.col("id") + 20).alias("bands")), "nodes")
    met = minhash_dedup.shared_bands(nodes)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, met.select("h", "node", "k", "rep", "c").collect())) == sorted([(7, i, 0, 0, 6) for i in range(6)] + [(10 + i % 2, i, 1, i % 2, 3) for i in range(6)])


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash_dedup.components(spark, edges).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1001] == 1000


def brute_shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_stage_links_all_texts_of_similarity_eight_tenths(spark):
    """Short near copies lie over 3 bits apart; chains join over their middle."""
    rng = random.Random(4)
    make = lambda k: [f"w{rng.randint(0, 9999)}" for _ in range(k)]
    texts = []
    for k in (30, 60, 90, 120, 200) * 6:
        w = make(k)
        texts += [" ".join(w), " ".join(w[:-1] + ["end"]), " ".join(w + make(k // 12)), " ".join(make(k // 5) + w), " ".join(w[: k // 2] + ["mid"] + w[k // 2 + 1 :])]
    sets = [brute_shingles(t) for t in texts]
    links = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    prints = [brute_print(t) for t in texts]
    assert sum((prints[i] ^ prints[j]).bit_count() > 3 for i, j in links) > 20
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    stage = dict(pytest.importorskip("corpus_pipeline").STAGES)["simhash_near_dedup"]
    got = stage(spark, spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], DOC), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root))


def test_blocks_of_large_families_lose_no_link(spark, monkeypatch):
    """A family whose members lie around 0.8 of each other, in one block and in several."""
    from trailmark.llm import minhash_dedup, shingle_links
    rng, base = random.Random(6), [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(120):
        w = list(base)
        for i in rng.sample(range(150), rng.randint(1, 5)):
            w[i] = f"x{rng.randint(0, 9999)}"
        texts.append(" ".join(w))
    texts += [None, "", " ", "one two", "One  two", "x " * 200_000]
    sets, root = [brute_shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], DOC).withColumns({c: F.lit("mine") for c in ("k", "node", "x", "__row", "sig")})
    for size in (minhash_dedup.BLOCK_BYTES, 60_000):
        monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", size)
        got = shingle_links.stage(spark, docs, "")
        assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted({find(i) for i in range(len(texts))})
    assert shingle_links.stage(spark, docs.limit(0), "").count() == 0


# bpe


@pytest.fixture(scope="module")
def tok():
    with open(bpe_automaton.path_of(), encoding="utf-8") as f:
        return bpe_automaton.Tokenizer(f.read())


def hard_texts(tok):
    rng, labels = random.Random(0), list(tok.labels.values())
    own = ["", "it's I'VE they'll don'T", "İstanbul ΣΑΣ ǅ", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "\x1c\x1d a\x85b c", "é 日本語 ½ ٣ Ⅷ 😀😀", "aaaaaaaaaaaaaaaaa", "ha" * 200, "!!!!!???", "x" * 3000, "a‍b ﻿ _y_", "é ́"]
    return own + ["".join(rng.choice(labels).replace("</w>", "") for _ in range(30)) for _ in range(300)] + ["".join(rng.choice("etaoin shrdlu'") for _ in range(120)) for _ in range(300)]


def test_ids_and_decoding_equal_the_library(tok):
    from tokenizers import Tokenizer
    lib, texts = Tokenizer.from_file(bpe_automaton.path_of()), hard_texts(tok)
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert tok.encode(t) == e.ids, t
        assert tok.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False)
    assert tok.encode(None) == []


def test_every_code_point_equals_the_library(tok):
    """Letters, case pairs and combining classes are the library's, whatever Unicode version Python has."""
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(bpe_automaton.path_of())
    points = [c for plane in (0, 1, 2, 3, 14) for c in range(plane << 16, plane + 1 << 16) if not 0xD800 <= c < 0xE000] + list(range(0x40000, 0x10FFFF, 997))
    for i in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}B" for c in points[i : i + 20_000]]
        for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
            assert tok.packed(t) == np.array(e.ids, "<u4").tobytes(), ascii(t)


def test_orders_of_marks_and_odd_white_space_equal_the_library(tok):
    from tokenizers import Tokenizer
    lib, rng = Tokenizer.from_file(bpe_automaton.path_of()), random.Random(3)
    marks = [chr(c) for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))] + list("\u1ac3\u1abf\u08fd\ua8e4\u0eba")
    others = list("aEİßſKΣ'1 \n\t\x1c\x1f\x85\xa0\u1680\u180e\u2028\u3000\ufeff가한각é") + ["\U00010d50", "\u1100\u1161\u11a8"]
    texts = ["a\u1ac3\u0eba", "\ua8e4\u1abf", "\u08fd\u1ac3\u0119", *("".join(rng.choice(rng.choice((marks, others))) for _ in range(rng.randint(2, 9))) for _ in range(30_000))]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert tok.packed(t) == np.array(e.ids, "<u4").tobytes(), ascii(t)
        assert tok.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_a_full_table_keeps_what_was_used_lately(tok, monkeypatch):
    """Arcs that the older generation has are moved, not made again."""
    a, words = tok.automaton, ["the", "then", "there", "other", "another"]
    want, asked = [a.encode(w[:-1] + w[-1]) for w in words], []
    monkeypatch.setattr(bpe_automaton, "ARCS", 2 * len({w[:i] for w in words for i in range(len(w) + 1)}))
    a.clear()
    for _ in range(3):
        assert [a.encode(w) for w in words] == want
    barred = a.barred
    monkeypatch.setattr(a, "barred", lambda u, v: asked.append(1) or barred(u, v))
    a.old, (a.states, a.numbers, a.table) = (a.states, a.numbers, a.table), ([((0, -1),)], {((0, -1),): 0}, {})
    assert [a.encode(w) for w in words] == want and not asked
    monkeypatch.undo()
    a.clear()


def merged_by_rank(word, merges):
    """Byte-pair encoding by its definition: the first of the best-ranked pairs is merged, again and again."""
    rank, w = {m: i for i, m in enumerate(merges)}, list(word)
    while (best := min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(w, w[1:])))[0] if len(w) > 1 else 1 << 30) < 1 << 30:
        i = next(i for i, p in enumerate(zip(w, w[1:])) if rank.get(p) == best)
        w[i : i + 2] = [w[i] + w[i + 1]]
    return w


@pytest.mark.parametrize("seed", range(8))
def test_automaton_on_random_merges(seed):
    rng, parts, merges = random.Random(seed), list("abc"), []
    while len(merges) < 25:
        m = (rng.choice(parts), rng.choice(parts))
        if m[0] + m[1] not in parts:
            parts.append(m[0] + m[1])
            merges.append(m)
    vocab = {p: i for i, p in enumerate(parts)}
    auto = bpe_automaton.Automaton(vocab, merges)
    for _ in range(400):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 24)))
        assert [parts[i] for i in auto.encode(word)] == merged_by_rank(word, merges), word


def test_caches_stay_bounded_in_bytes():
    made = []
    c = bpe_automaton.TwoGenerations(lambda k: made.append(k) or k.encode(), 10_000)
    assert [c[f"w{i % 7}"] for i in range(100)] == [b"w%d" % (i % 7) for i in range(100)] and len(made) == 7
    for i in range(3000):
        c[f"word{i}"], c["x" * 1000 + str(i)]
    assert len(c) + len(c.old) < 60 and max(map(len, [*c, *c.old])) < 20


def test_long_words_and_a_small_table(tok, monkeypatch):
    """The table is built anew again and again within words, with the same ids; long words leave nothing behind."""
    from tokenizers import Tokenizer
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh0+/Aé") for _ in range(n)) for n in (70, 5000, 60000)] + [" ".join("".join(rng.choice("etaoinshr") for _ in range(9)) for _ in range(300))]
    monkeypatch.setattr(bpe_automaton, "STATES", 50)
    lib = Tokenizer.from_file(bpe_automaton.path_of())
    for t in texts:
        assert tok.encode(t) == lib.encode(t, add_special_tokens=False).ids
    assert len(tok.automaton.states) <= 51 and not any(len(w) > bpe_automaton.LONG for w in [*tok.words, *tok.words.old, *tok.parts, *tok.parts.old])
    monkeypatch.undo()
    tok.automaton.clear()
    assert tok.encode(texts[1]) == lib.encode(texts[1], add_special_tokens=False).ids


def test_guises_of_a_piece_are_encoded_once(monkeypatch):
    with open(bpe_automaton.path_of(), encoding="utf-8") as f:
        spec = f.read()
    tok, asked = bpe_automaton.Tokenizer(spec), []
    encode = tok.automaton.encode
    monkeypatch.setattr(tok.automaton, "encode", lambda w: asked.append(w) or encode(w))
    tok.packed("inwher Inwher INWHER inwher### Inwher, inwher,### Inwher### réinwher réinwher### réinwher, it's###")
    assert len(asked) == len(set(asked)) == 7


def test_marks_behind_words_equal_the_library(tok):
    from tokenizers import Tokenizer
    lib, rng = Tokenizer.from_file(bpe_automaton.path_of()), random.Random(8)
    ends = [*map(chr, range(33, 127)), *"éßİ\u0301\u0338。日²Ⅷ\x01\x7f\xad\u200d"]
    for _ in range(20_000):
        t = "".join(rng.choice(ends) for _ in range(rng.randint(0, 4))) + rng.choice(["", "a", "É", "'s", "e\u0301Z"]) + "".join(rng.choice(ends[:15] + ends[-9:]) for _ in range(rng.randint(0, 4)))
        assert tok.encode(t) == lib.encode(t, add_special_tokens=False).ids, ascii(t)


def test_a_worker_keeps_its_tokenizer_between_tasks(spark):
    rows = spark.createDataFrame([(i, f"word{i}", "f") for i in range(8)], DOC)
    bpe_automaton.encoded(spark, rows).collect()

    def kept(batches):
        from trailmark.llm import bpe_automaton as here

        for b in batches:
            yield b.assign(id=here.tokenizer_of.cache_info().currsize)

    assert max(r["id"] for r in spark.range(0, 8, 1, 4).mapInPandas(kept, "id long").collect()) == 1


def test_encoded_rows(spark, tok):
    rows = spark.createDataFrame([(1, None, "f"), (2, "the the", "f"), (2, "the the", "f"), (3, "word " * 400_000, "f")], DOC).withColumns({c: F.lit("mine") for c in ("id", "t", "n_tokens", "ids")})
    got = {r["id"]: r for r in bpe_automaton.encoded(spark, rows, with_ids=True).collect()}
    assert got[1]["n_tokens"] == 0 and list(got[1]["ids"]) == [] and list(got[2]["ids"]) == tok.encode("the the") and got[3]["n_tokens"] == 400_000
    assert bpe_automaton.encoded(spark, rows.limit(0)).count() == 0


# language


def numeric(net, x, y, w, k, at, eps=1e-3):
    got = []
    for d in (eps, -eps):
        net.w[k][at] += d
        got.append(net.gradients(x, y, w)[0])
        net.w[k][at] -= d
    return (got[0] - got[1]) / (2 * eps)


@pytest.mark.parametrize("k,at", [("U", (1, 2, 3)), ("U", (0, 1, 9)), ("W", (0, 70, 5)), ("W", (1, 80, 9)), ("O", (1, 1)), ("b", (0, 2)), ("c", (0,))])
def test_backpropagation(k, at):
    net = language_id.Network(["a", "b"], 4)
    net.w = {n: v.astype(np.float64) for n, v in net.w.items()}
    x, y, w = np.random.default_rng(0).integers(60, 120, (3, 16)).astype(np.uint8), np.array([0, 1, 1]), np.ones(3)
    assert abs(net.gradients(x, y, w)[1][k][at] - numeric(net, x, y, w, k, at)) < 1e-4


@tables
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identified(spark, docs.withColumns({"score": F.lit("mine"), "k": F.lit(1)}), language_id.learned(docs)).where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.98 and 0 <= got[1] and got[2] <= 1


def test_language_edges(spark, monkeypatch):
    one = "doc_id long, text string, lang string, source string"
    rng = random.Random(1)
    en, de = ("the of and that with for this".split(), "der die und nicht mit auf für".split())
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(20)), "en" if i % 2 else "de", "s") for i in range(80)]
    odd = [(500, None, "en", "s"), (501, "12 ... 3", "en", "s"), (502, "", None, "s"), (None, "the of and", None, "s"), (503, "日本", None, "s")]
    net, learned = language_id.learned(spark.createDataFrame(rows + odd, one)), language_id.learned
    of = lambda d: language_id.identified(spark, d, net)
    got = {(r["doc_id"], r["text"]): r for r in of(spark.createDataFrame(rows + odd, one)).collect()}
    assert all((got[i, t]["lang_pred"], got[i, t]["score"]) == ("und", 0.0) for i, t, _, _ in odd[:3]) and got[503, "日本"]["lang_pred"] in ("de", "en")
    assert got[None, "the of and"]["held_out"] is False and sum(r["lang_pred"] == r["lang"] for r in got.values()) >= 79
    clash = spark.createDataFrame(rows + odd, one).withColumns({c: F.lit("mine") for c in ("held_out", "lang_pred", "score", "k", "t", "got", "__row")})
    monkeypatch.setattr(language_id, "learned", lambda d: net)
    kept = language_id.stage(spark, clash, "")
    assert kept.columns == clash.columns and kept.where("doc_id in (500, 501, 502)").count() == 0 and kept.where("doc_id < 80").count() == 80
    assert of(clash).where("lang_pred = 'mine'").count() == 0
    assert of(spark.createDataFrame([], one)).count() == 0
    assert learned(spark.createDataFrame(odd[:1], one)) is None and learned(clash.limit(0)) is None
    assert language_id.identified(spark, clash, None).where("lang_pred <> 'und' or score > 0").count() == 0


def test_inference_runs_once_in_the_stage(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the of and that", "en", "s") for i in range(9)], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(language_id, "learned", lambda d: language_id.Network(["de", "en"]))
    plan = language_id.stage(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def slow_probabilities(net, text):
    """Byte by byte, with plain loops: the mean over letter bytes of the language probabilities."""
    w, raw = net.w, bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    h, sums = w["U"].shape[1], np.zeros(len(net.langs))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for i in range(0, len(raw), language_id.STRETCH):
        part = raw[i : i + language_id.STRETCH].ljust(language_id.STRETCH, b"\0")
        states = []
        for d, order in ((0, part), (1, part[::-1])):
            s, seen = np.zeros(h), []
            for c in order:
                a, r = w["W"][d][c] + w["b"][d], s @ w["U"][d]
                z, q = sigmoid(a[:h] + r[:h]), sigmoid(a[h : 2 * h] + r[h : 2 * h])
                s = (1 - z) * np.tanh(a[2 * h :] + q * r[2 * h :]) + z * s
                seen.append(s)
            states.append(seen if d == 0 else seen[::-1])
        for c, f, b in zip(part, *states):
            if chr(c).isalpha() and c < 128 or c >= 128:
                o = np.exp(np.concatenate([f, b]) @ w["O"] + w["c"])
                sums += o / o.sum()
    return sums / sums.sum()


@tables
def test_stage_rejects_texts_in_no_learned_language(spark):
    """Texts in scripts and languages that the labels lack go; every document of the tables stays, but for those without a letter."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    foreign = ["Это текст на русском языке, который никто не видел раньше.", "这是一个中文文本，没有人见过它。", "これは日本語のテキストです。", "Αυτό είναι ένα ελληνικό κείμενο.", "هذا نص باللغة العربية", "Wczoraj poszedłem do sklepu, żeby kupić chleb i mleko."]
    rows = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate([*foreign, *(t * 200 for t in foreign), "12 + 34", ""])], docs.schema)
    kept = {r[0] for r in language_id.stage(spark, docs.unionByName(rows), "").select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if language_id.has_letters(r["text"])}


@tables
def test_stage_keeps_short_texts_with_keys_and_doubts_few_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    net = language_id.train(language_id.with_none(language_id.sample(docs, "doc_id", "text", "lang")), steps=language_id.STEPS_NONE)
    rng, texts = np.random.default_rng(77), [r["text"] for r in docs.where("length(text) > 200").limit(300).collect()]
    keyed = [language_id.with_key(t, rng) for t in texts]
    keyed += [k.replace(max(k.split(), key=len), "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16))) for k in keyed]
    got = language_id.pooled(net, keyed, language_id.DOUBT)
    assert sum(k == language_id.NONE and x >= language_id.ALIEN for k, x in got) <= 1
    few, many = language_id.pooled(net, ["Привет", "Это текст на русском языке, который никто не видел раньше."], language_id.DOUBT)
    assert few[1] < language_id.ALIEN <= many[1] and few[0] == many[0] == language_id.NONE
    sure = language_id.pooled(net, ["Привет"])[0]
    assert few[1] == pytest.approx(sure[1] * 12 / (12 + language_id.DOUBT))


def test_a_drawn_word_stands_among_whole_words():
    rng = np.random.default_rng(2)
    for text in ["", "one", "some words of a text " * 9]:
        for _ in range(30):
            got = language_id.with_key(text, rng).split()
            drawn = [w for w in got if w not in text.split()]
            assert len(drawn) == 1 and 8 <= len(drawn[0]) <= 24 and drawn[0].isalnum()
            assert " ".join(w for w in got if w in text.split()) in text


def test_alien_texts_keep_signs_and_words():
    rng = np.random.default_rng(1)
    for _ in range(50):
        got = language_id.alien("Abba, 12 ça!", rng)
        assert len(got) == 12 and got[0] == got[3] and got[1] == got[2] != got[0] and got[4:9] == ", 12 " and got[10] == got[0] and got[11] == "!"
    assert language_id.with_none([]) == [] and language_id.train(language_id.with_none([])) is None


def test_pooled_probabilities_equal_a_plain_loop():
    net = language_id.Network(["a", "b", "c"], 5, seed=3)
    texts = ["Hello, World 12!", "é" * 100, "x", "ABC def " * 60, None, "123", "the " * 30000]
    got = language_id.pooled(net, texts)
    for t, (lang, score) in zip(texts[:4], got):
        p = slow_probabilities(net, t)
        assert lang == net.langs[p.argmax()] and abs(score - p.max()) < 1e-4
    assert got[4:6] == [("und", 0.0)] * 2 and abs(got[6][1] - slow_probabilities(net, "the " * 16).max()) < 1e-4


def test_pieces_come_from_whole_texts(spark):
    """The one labelled document is long; what is learned from reaches to its end, and its number is bounded."""
    text = " ".join(f"w{i}" for i in range(400_000))
    docs = spark.createDataFrame([(i, text, "en") for i in (1, 2, 3, 4)], "doc_id long, text string, lang string")
    got = language_id.sample(docs, "doc_id", "text", "lang")
    assert 8000 < len(got) <= language_id.PIECES and {k for _, k in got} == {"en"} and max(int(x[1:]) for t, _ in got for x in t.split() if x[1:].isdigit()) > 390_000


# html


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1><nav><a href=x>Home</a> <a>About</a></nav></header><div class="cookie-notice">We use cookies to improve.</div>
<div id="content"><h2>My  story</h2><p>First para with &eacute; words&nbsp;here &lt;b&gt;.</p><div class="ad-box">Buy now this great product please</div><p>Second <a href=y>link text</a> para.<br>next
line<ul><li>one thing<li>two things</ul><form><input><label>Email</label></form><script>if (a < b) {}</script></div><aside><p>Side words one two</p></aside><section id="comments"><p>I like this.</p></section><footer>(c)</footer></body></html>"""


@pytest.mark.parametrize("page,want", [(PAGE, "My story\nFirst para with é words here <b>.\nSecond link text para.\nnext line\none thing\ntwo things"), (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a &lt; b<p>c <!-- x", "a < b\nc"), ("<nav>only menu</nav>", ""), ("<div hidden>no</div><p>yes", "yes"), ("<p>unfinished <span", "unfinished"), ("<p>x</p><style>p{}", "x")])
def test_pages(page, want):
    assert html_extract.extract(page, html_extract.Weights({})) == want


ARTICLE = "<article><h1>Head</h1><p class='related-work'>Some words of the story.</p><p>More words.</p></article>"


@pytest.mark.parametrize("name", ["page no-sidebar", "has-search content", "content-share-ready", "main-with-menu", "sidebar", "post-comments", "ad"])
def test_names_around_the_article_dont_matter(name):
    page = f"<body><nav><a href=x>Home</a></nav><div class='{name}'>{ARTICLE}</div><div class='sidebar'><p>Side words</p></div></body>"
    assert html_extract.extract(page, html_extract.Weights({})) == "Head\nSome words of the story.\nMore words."


@pytest.mark.parametrize("name,out", [("cookie-notice", True), ("ad-box", True), ("post-comments", True), ("siteFooter", True), ("sidebar-left", True), ("ad-300", True), ("no-sidebar", False), ("has-search", False), ("main-with-menu", False), ("content-share-ready", False), ("related-work", False), ("sidebar-page", False), ("adventure", False)])
def test_names(name, out):
    assert html_extract.named(name) is out


COMMENTS = """<main><div class="entry"><p>Body of the story goes here.</p></div><section id="comments"><article class="comment"><p>I like this.</p>
<section class="replies"><article><p>Me too, and much more than the whole story has.</p></article></section></article></section></main>"""
FORM = """<form id="aspnet"><div class="wrap"><p>Long text of the page that stands within the form.</p><input></div></form><footer>x</footer>"""
TEASER = """<aside><article class="teaser"><p>Teaser a b c d e f g h i j k l m n o p.</p></article></aside><main><p>Main text it is.</p></main>"""


@pytest.mark.parametrize("page,want", [(COMMENTS, "Body of the story goes here."), (FORM, "Long text of the page that stands within the form."), (TEASER, "Main text it is.")])
def test_nested_comments_forms_and_teasers(page, want):
    assert html_extract.extract(page, html_extract.Weights({})) == want


def test_only_the_scan_decides():
    """Nothing is marked or named: link lists and a foot line around paragraphs."""
    menu = "<div><ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(8)) + "</ul></div>"
    body = [f"Paragraph {i} with a good number of plain words in it, so that it reads as text." for i in range(4)]
    foot = "<div><span>Imprint</span><br><span>Terms</span><br><a href=x>All rights reserved</a></div>"
    page = f"<body>{menu}<div>{''.join(f'<p>{x}</p>' for x in body)}</div>{menu}{foot}</body>"
    assert html_extract.extract(page, html_extract.Weights({})) == "\n".join(body)
    every = "\n".join(t for _, t, *_ in html_extract.parse(page))
    assert "Link 3" in every and "Imprint" in every


def test_unclosed_tags_take_linear_time():
    import time
    n, began = 100_000, time.time()
    for page in ("<p>x" + "<b>" * n + "</i>" * n + "text", "<li>" * n + "<td>" * n + "text"):
        assert html_extract.extract(page, html_extract.Weights({}))
    assert time.time() - began < 40


@pytest.mark.parametrize("seed", range(4))
def test_region_equals_all_regions(seed):
    rng = random.Random(seed)
    for _ in range(200):
        s = [rng.choice([-2.0, -1.0, 0.0, 1.0, 3.0]) for _ in range(rng.randint(0, 12))]
        best = max([0.0] + [sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)])
        a, b = html_extract.best_region(s)
        assert sum(s[a:b]) == best


@tables
def test_articles_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(spark, pages, ["page_id", "url"]).collect()}
    import html
    for p in pages.collect():
        a = p["html"].split("<article>")[1].split("</article>")[0]
        a = re.sub(r"<[^>]*>?", lambda m: "" if m[0] in ("<b>", "</b>") else "\n", a)
        assert got[p["page_id"]] == "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in a.split("\n")) if x)


def test_pages_edges(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (2, "v", "<p>a", "x")], "page_id long, url string, html string, text string")
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extracted(spark, rows, ["page_id", "url"]).collect()} == {1: ("", 0), 2: ("a", 1)}
    assert html_extract.extracted(spark, rows.limit(0), ["page_id"]).count() == 0
    again = spark.createDataFrame([(1, "u", "<p>a b</p>" * 30000, "x")] * 2, "page_id long, url string, html string, n_chars string")
    assert [(len(r["text"]), r["n_chars"]) for r in html_extract.extracted(spark, again, ["page_id", "url"]).collect()] == [(119_999, 119_999)] * 2


# weak labels


@tables
def test_weak_scores_find_low_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = weak_quality.scored(spark, docs).join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    good, bad = ([r["kept"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_em_learns_which_labellers_matter():
    rng, counts = random.Random(0), {}
    n = len(weak_quality.LABELLERS)
    for _ in range(4000):
        bad = rng.random() < 0.2
        v = [2 if rng.random() < (0.8 if bad and j < 3 else 0.02) else 0 for j in range(n)]
        code = sum(d * 3 ** (n - 1 - j) for j, d in enumerate(v))
        counts[code] = counts.get(code, 0) + 1
    m = weak_quality.Labels(counts)
    assert 0.72 < m.share < 0.88 and m.of[0] > 0.95 and all(m.like[0, j, 2] > 0.6 for j in range(3)) and all(m.like[0, j, 2] < 0.2 for j in range(3, n))


def test_weak_edges(spark):
    rows = spark.createDataFrame([(1, None, "f"), (2, " \n", "f"), (3, "A sentence with some words. And more of it.", "f")], DOC)
    got = {r["id"]: r for r in weak_quality.scored(spark, rows).collect()}
    assert not got[1]["kept"] and got[2]["score"] == 0 and got[3]["score"] > 0
    assert weak_quality.scored(spark, rows.limit(0)).count() == 0 and [r["score"] for r in weak_quality.scored(spark, rows.limit(2)).collect()] == [0.0, 0.0]


def test_em_equals_a_plain_loop():
    """Over documents one by one, by the formulas: accuracies from posteriors, posteriors by Bayes' rule."""
    rng, k = random.Random(2), len(weak_quality.LABELLERS)
    rows = [[rng.choices([0, 1, 2], [6, 1 if j == 3 else 0, 2 + j % 3])[0] for j in range(k)] for _ in range(120)]
    counts = {}
    for v in rows:
        code = sum(d * 3 ** (k - 1 - j) for j, d in enumerate(v))
        counts[code] = counts.get(code, 0) + 1
    model = weak_quality.Labels(counts, rounds=6)
    p = [(v.count(1) + 1) / (v.count(1) + 9 * v.count(2) + 1.2) for v in rows]
    for _ in range(6):
        share = min(max(sum(p) / len(p), 0.05), 0.95)
        like = []
        for good in (False, True):
            q = [x if good else 1 - x for x in p]
            table = []
            for j in range(k):
                n = [sum(w for w, v in zip(q, rows) if v[j] == d) + (1.0 if d == 0 else 2.0 if (d == 1) == good else 0.5) for d in range(3)]
                table.append([x / sum(n) for x in n])
            like.append(table)
        p = []
        for v in rows:
            good, bad = share, 1 - share
            for j, d in enumerate(v):
                good, bad = good * like[1][j][d], bad * like[0][j][d]
            p.append(good / (good + bad))
    for v, x in zip(rows, p):
        assert abs(model.of[sum(d * 3 ** (k - 1 - j) for j, d in enumerate(v))] - x) < 1e-6


def test_scores_equal_a_plain_version(spark):
    """Few documents, all of them sampled: features, fit and scores again, one by one."""
    rng = random.Random(3)
    words = "the of and that with for this is at on by a report city river".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) + "." for _ in range(60)] + ["BUY NOW!!! $$$ ### BUY NOW!!! $$$ " * rng.randint(2, 9) for _ in range(15)] + [None, " ", "x"]
    rows = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], DOC).withColumns({c: F.lit("mine") for c in ("id", "t", "score", "code", "h")})
    got = {r["id"]: r for r in weak_quality.scored(spark, rows).collect()}
    raws = [(t or "").encode() for t in texts]
    ms = [weak_quality.measures(r) for r in raws]
    counts = {}
    for m in ms:
        if m:
            counts[weak_quality.votes(m)] = counts.get(weak_quality.votes(m), 0) + 1
    labels = weak_quality.Labels(counts)
    x = np.stack([weak_quality.features(r, m) for r, m in zip(raws, ms) if m]).astype(float)
    y = np.array([labels.of[weak_quality.votes(m)] for m in ms if m])
    w, mean, var = np.zeros(x.shape[1] + 1), 0.0, 0.0
    for t in range(1, weak_quality.STEPS + 1):
        g = np.zeros_like(w)
        for row, target in zip(x, y):
            p = 1 / (1 + np.exp(-np.clip(row @ w[:-1] + w[-1], -40, 40)))
            d = (p - target) * (target / y.sum() + (1 - target) / (1 - y).sum())
            g[:-1] += d * row
            g[-1] += d
        g[:-1] += 1e-5 * w[:-1]
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        w -= 0.3 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
    for i, (r, m) in enumerate(zip(raws, ms)):
        want = 1 / (1 + np.exp(-(weak_quality.features(r, m) @ w[:-1] + w[-1]))) if m else 0.0
        assert abs(got[i]["score"] - want) < 1e-3 and got[i]["kept"] == (got[i]["score"] >= 0.5)


def test_wordless_rows_are_never_sampled(spark):
    """200,000 rows, one with words; repeated and very long rows."""
    many = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit(" \n").alias("text"))
    got = weak_quality.scored(spark, many.unionByName(spark.createDataFrame([(-1, "Some words here.")], "doc_id long, text string")))
    assert got.where("score > 0").count() == 1 and got.count() == 200_001
    long = spark.createDataFrame([(1, "A word of it. " * 100_000), (2, "again and again"), (2, "again and again")], "doc_id long, text string")
    assert len({r["score"] for r in weak_quality.scored(spark, long).where("id = 2").collect()}) == 1


@tables
def test_accuracies_of_the_labellers(spark):
    """The model's votes for bad agree with the labels: what it says of a labeller on bad documents is about what the labels say."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["labeller"]: r for r in weak_quality.labellers(spark, docs).collect()}
    assert set(got) == {x[0] for x in weak_quality.LABELLERS} and all(0 <= r["coverage"] <= 1 and 0 <= r["accuracy"] <= 1 for r in got.values())
    known = [(weak_quality.votes(m), r["quality"]) for r in docs.join(labels, "doc_id").collect() if (m := weak_quality.measures((r["text"] or "").encode()))]
    v = weak_quality.digits(np.array([c for c, _ in known]))
    bad = np.array([q == 0 for _, q in known])
    for j, (name, *_) in enumerate(weak_quality.LABELLERS):
        if (v[:, j] == 2).sum() >= 10:
            assert abs(got[name]["bad_if_bad"] - (v[bad, j] == 2).mean()) < 0.3, name
    assert weak_quality.labellers(spark, docs.limit(0)).count() == 0
