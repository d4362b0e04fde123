"""Affix forms, ladders, the inverted-file index and captured trees against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import settlement, similarity
from trailmark.sources import files, tree


def forms(words, rules):
    """rules: (kind, flag, merge, strip, add, condition)."""
    def split(condition):
        return re.match(r"(\[\^\S+\])?(\S+)?", "" if condition == "." else condition).groups()

    def suffixed(w, strip, add):
        return w[: len(w) - len(strip)] + add if w.endswith(strip) else None

    out, prefixed = {w for w, _ in words}, set()
    for w, flags in words:
        for kind, flag, _, strip, add, condition in rules:
            no, yes = split(condition)
            if flag not in flags or no and any(w.endswith(c) for c in no) or yes and not w.endswith(yes):
                continue
            if kind == "SFX":
                out |= {suffixed(w, strip, add)} - {None}
            elif w.startswith(strip):
                prefixed.add((w[len(strip) :] + add if strip else add + w, flags))
    for w, flags in prefixed:
        out.add(w)
        for kind, flag, merge, strip, add, condition in rules:
            no, yes = split(condition)
            if kind == "SFX" and merge and flag in flags and not (no and w.endswith(no)) and not (yes and not w.endswith(yes)):
                out |= {suffixed(w, strip, add)} - {None}
    return out


def test_forms_equal_a_loop(spark):
    r = random.Random(3)
    rules = [("PFX", "A", True, "", "re", "."), ("PFX", "B", True, "b", "xo", "."), ("PFX", "C", False, "", "un", "[^e]"), ("SFX", "S", True, "", "s", "[^sy]"), ("SFX", "S", True, "y", "ies", "y"), ("SFX", "D", False, "e", "ed", "e"), ("SFX", "G", True, "", "ing", "[^aeiou]d"),
             ("SFX", "H", True, "e", "al", "."), ("SFX", "H", True, "ve", "z", "e"), ("SFX", "H", True, "e", "q", "ve"), ("SFX", "K", True, "a", "k", "b")]
    words = [("".join(r.choice("abdeyvs") for _ in range(r.randint(1, 6))), "".join(r.sample("ABCSDGHK", r.randint(0, 8)))) for _ in range(150)] + [("a", "S"), ("e", "D"), ("ve", "H")]
    lines = [f"{k} {f} {'Y' if m else 'N'} {s or '0'}   {a}  {c}" for k, f, m, s, a, c in rules]
    rule = files.affixes(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(tuple(x) for x in rule.collect()) == sorted((k, f, m, s, a, c) for k, f, m, s, a, c in rules)
    got = [x["form"] for x in files.dictionary_words(spark.createDataFrame(words, "w string, flags string"), rule, "w", "flags").collect()]
    assert len(got) == len(set(got)) and set(got) == forms(words, rules)
    headed = files.affixes(spark.createDataFrame([("SFX S Y 2",), ("SFX S 0 s .",), ("SFX T N 1",), ("SFX T 0 t/X [^e]",), ("PFX R 0 re .",)], "value string"))
    assert sorted((x["flag"], x["merge"], x["add"]) for x in headed.collect()) == [("R", False, "re"), ("S", True, "s"), ("T", False, "t")]


@pytest.mark.parametrize("least, most", [(1, 1), (2, 5), (0, 3)])
def test_ladders_of_any_range(spark, least, most):
    r = random.Random(6)
    words = sorted({"".join(r.choice("abc") for _ in range(n)) for n in (2, 3, 4) for _ in range(25)})
    near = {a: sorted(b for b in words if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) for a in words}
    want = set()
    for a in words:
        level, seen = {a: (a,)}, {a}
        for h in range(1, most + 1):
            new = {}
            for x, p in level.items():
                for y in near[x]:
                    if y not in seen:
                        new[y] = min(new.get(y, ("~",)), (*p, y))
            seen, level = seen | set(new), new
            want |= {(a, b, h, p) for b, p in new.items() if h >= max(least, 1)}
    w = spark.createDataFrame([(x,) for x in words], "w string")
    got = settlement.ladders(settlement.neighbours(w, "w"), w.select(F.col("w").alias("source")), least, most)
    assert {(x["source"], x["target"], x["hops"], tuple(x["path"])) for x in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # every step is a written table


def test_ladders_shuffle_no_candidates(spark):
    """All words of two letters of 16: each step meets every word from each of 30 others, but only lists and reached words are shuffled."""
    w = spark.createDataFrame([(a + b,) for a in "0123456789abcdef" for b in "0123456789abcdef"], "w string")
    edges = settlement.kept(settlement.neighbours(w, "w"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ladders", "")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of any size
    try:
        got = settlement.ladders(edges, w.select(F.col("w").alias("source")), 2, 3)
        assert got.count() == 256 * 225 and got.where("hops = 3").count() == 0
        stages = {s for j in tracker.getJobIdsForGroup("ladders") for s in tracker.getJobInfo(j).stageIds}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    store = spark.sparkContext._jsc.sc().statusStore()
    rows = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert rows < 250_000, rows  # the last step's candidates alone are 256 * 225 * 30


def generated(spark, since):
    """Rows that explodes made in the SQL executions after `since`."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    all_of = lambda seq: [seq.apply(i) for i in range(seq.size())]
    rows = 0
    for k in (e.executionId() for e in all_of(store.executionsList()) if e.executionId() > since):
        metrics = store.executionMetrics(k)
        for node in all_of(store.planGraph(k).allNodes().toSeq()):
            if node.name() == "Generate":
                rows += sum(int(metrics.apply(m.accumulatorId()).replace(",", "")) for m in all_of(node.metrics().toSeq()) if m.name() == "number of output rows" and metrics.contains(m.accumulatorId()))
    return rows


def test_far_ladders_make_few_rows(spark, tmp_path):
    """1,593 words of three letters: what a step reaches has few keys that are new, but many neighbours, nearly all known."""
    from trailmark.plans import registry
    spark.range(0, 6_000, 3).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = spark._jsparkSession.sharedState().statusStore().executionsList()
    last = max(before.apply(i).executionId() for i in range(before.size()))
    got = registry.queries()["GME_25_word_ladder_far"](spark, str(tmp_path)).count()
    rows = generated(spark, last)
    assert got > 2_000_000 and 0 < rows < 8 * got, (got, rows)


@pytest.mark.parametrize("least, most", [(1, 1), (2, 5), (0, 3), (3, 2)])
def test_word_ladders_equal_those_over_neighbours(spark, least, most):
    r = random.Random(8)
    words = {"".join(r.choice(a) for _ in range(n)) for a, n in (("abc", 2), ("abc", 4), ("aé\uffff𝔸", 3), ("*ab", 3)) for _ in range(30)}
    long = "xy" * 70
    words |= {long[:i] + c + long[i + 1 :] for i in (0, 62, 63, 64, 126, 139) for c in "pq"} | {"p" + long[1:63] + "q" + long[64:], "pp" + long[2:126] + "p" + long[127:]}
    near = {a: sorted(b for b in words if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) for a in words}
    want = set()
    for a in words:
        level, seen = {a: (a,)}, {a}
        for h in range(1, most + 1):
            new = {}
            for x, p in level.items():
                for y in near[x]:
                    if y not in seen:
                        new[y] = min(new.get(y, (chr(0x10FFFF),)), (*p, y))
            seen, level = seen | set(new), new
            want |= {(a, b, h, p) for b, p in new.items() if h >= max(least, 1)}
    w = spark.createDataFrame([(x,) for x in [*words, *words, "", None]], "w string")
    got = [(x["source"], x["target"], x["hops"], tuple(x["path"])) for x in settlement.word_ladders(w, "w", least, most).collect()]
    assert len(got) == len(want) and set(got) == want


def vectors(n, seed, groups=0):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 16)) + (g.normal(size=(groups, 16)) * 6)[g.integers(0, groups, n)] if groups else g.normal(size=(n, 16))
    return x


def recall(spark, x, **how):
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")
    q = df.where("id % 20 = 0")
    key = lambda r: (r["q"], r["id"])
    want, got = ({key(r) for r in f.collect()} for f in (similarity.nearest(q, df, "id", "v", 5), similarity.indexed(q, df, "id", "v", 5, **how)))
    assert {a for a, _ in got} == {a for a, _ in want}
    return len(want & got) / len(want)


def test_index_finds_nearly_all(spark):
    assert recall(spark, vectors(1500, 1)) >= 0.9  # without any structure
    assert recall(spark, vectors(1500, 2, 30), lists=30, probes=4, size=40) >= 0.95
    assert recall(spark, vectors(300, 3), lists=5, probes=5, sample=50, size=7) == 1.0  # all lists: exact


def test_index_of_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.1]), (5, [-1.0, 0.0])], "id long, v array<double>")
    got = similarity.indexed(df, df, "id", "v", 2).collect()
    assert {(r["q"], r["id"]) for r in got} == {(1, 4), (1, 5), (4, 1), (4, 5), (5, 1), (5, 4)}
    assert similarity.indexed(df.limit(0), df.limit(0), "id", "v", 2).count() == 0


def test_trees_are_read_by_run(spark, tmp_path):
    root = str(tmp_path / "captures")
    rows = [(f"r{i}", f, n, v) for i in range(4) for f, n, v in [("", "top", str(i)), ("a/b", "name", "package-0\n"), ("a/b", "energy_uj", f"{10 * i}\n"), ("a/c", "name", "dram"), ("a/c", "energy_uj", "x"), ("cpu/cpu0/cpuidle/state1", "time", "7")]]
    tree.write_tree(spark.createDataFrame(rows, tree.SCHEMA), root)
    (tmp_path / "captures" / "r3" / "bad").write_bytes(b"\xff\xfe")
    whole = tree.tree(spark, root)
    assert sorted(map(tuple, whole.collect())) == sorted(rows)
    assert sorted((r["run"], r["package"], r["dram"]) for r in tree.energy(whole).collect()) == [(f"r{i}", 10 * i, None) for i in range(4)]
    assert [tuple(r) for r in tree.idle_states(whole.where("run = 'r2'")).collect()] == [("r2", "cpu0", "state1", 7)]
    one = whole.where("run = 'r1'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 6 and whole.where("run in ('r1', 'none')").count() == 6
    assert tree.tree(spark, str(tmp_path / "nothing")).count() == 0


def test_trees_stream_new_runs(spark, tmp_path):
    root, out, check = (str(tmp_path / x) for x in ("captures", "out", "check"))
    spark.dataSource.register(tree.Tree)
    for i in range(2):
        tree.write_tree(spark.createDataFrame([(f"r{i}", "", "f", str(i)), (f"r{i}", "x", "g", "")], tree.SCHEMA), root)
        spark.readStream.format("tree").load(root).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(once=True).start().awaitTermination()
        assert sorted((r["run"], r["folder"]) for r in spark.read.parquet(out).collect()) == sorted((f"r{j}", x) for j in range(i + 1) for x in ("", "x"))
