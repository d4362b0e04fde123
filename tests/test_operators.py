"""Operators against plain loops, and edge cases."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from trailmark.functions import text as fn
from trailmark.functions import udfs
from trailmark.operators import calls, docdb, intervals, replay, scoring, settlement, windows
from trailmark.sources import files, sinks
from trailmark.streaming import loop

STEP = "run_id long, step long, move string, t double, w long, guesses array<string>, g double, gw long, scores array<double>"


def replayed(s, target):
    """The replay of one trajectory, step by step."""
    n = min(target, len(s))
    reg_t = spec_t = 0.0
    reg_w = spec_w = match = won = seen = 0
    was = False
    for i in range(n - 1):
        t, w, k = s[i]["t"], s[i]["w"], len(s[i]["guesses"])
        m = s[i]["move"] in s[i]["guesses"]
        reg_t += t; reg_w += w; spec_w += w  # noqa: E702
        if was:
            match += m
            was = False
        elif m:
            gain, both = s[i]["g"] + s[i + 1]["t"], s[i]["gw"] + s[i + 1]["w"]
            if gain < t:
                spec_t += t; spec_w += k * both  # noqa: E702
            else:
                spec_t += gain; spec_w += (k - 1) * w + both  # noqa: E702
            match += 1; won += 1; seen += 1; was = True  # noqa: E702
        else:
            spec_t += t; spec_w += k * w; seen += 1  # noqa: E702
    t, w = s[n - 1]["t"], s[n - 1]["w"]
    reg_t += t; reg_w += w; spec_w += w  # noqa: E702
    if not was:
        spec_t += t; spec_w += w  # noqa: E702
    return round(reg_t, 4), round(spec_t, 4), reg_w, spec_w, match, won, seen


def trajectories(n=40):
    rng, runs = random.Random(3), []
    for r in range(n):
        pattern = ["TTTT", "TFTT", "FFF", "T"][r] if r < 4 else "".join(rng.choice("TF") for _ in range(rng.randint(1, 30)))
        runs.append([{"run_id": r, "step": i, "move": "a", "t": float(rng.randint(1, 40)), "w": rng.randint(0, 50), "guesses": (["b", "a"] if c == "T" else ["b"] * rng.randint(0, 3)), "g": float(rng.randint(0, 9)), "gw": rng.randint(0, 9), "scores": [60.0, 40.0]} for i, c in enumerate(pattern)])
    return runs


@pytest.mark.parametrize("target", [-2, 0, 1, 3, 1000])
def test_replay_equals_the_loop(spark, target):
    runs = trajectories()
    got = replay.replay(spark.createDataFrame([r for s in runs for r in s], STEP), [target]).collect()
    have = {r["run_id"]: (r["reg_t"], r["spec_t"], r["reg_w"], r["spec_w"], r["matches"], r["window_matches"], r["windows"]) for r in got}
    assert have == {s[0]["run_id"]: replayed(s, target) if target > 0 else (0.0, 0.0, 0, 0, 0, 0, 0) for s in runs}
    if target <= 0:
        assert all(set(r[2:]) == {0} for r in got)


def test_replay_of_nothing(spark):
    assert replay.replay(spark.createDataFrame([], STEP), [5]).count() == 0


@pytest.mark.parametrize("guesses,scores,want", [(["a", "b"], [50.0, 51.0], ["b"]), (["a", "b"], [60.0, 70.0, 99.0], ["a", "b"]), (["a", "b", "c"], [60.0], ["a"]), (["a"], [1.0], ["a"]), (["a", "b"], [], ["a", "b"]), (["a", "b"], [1.0, 2.0], [])])
def test_confidence_filter(spark, guesses, scores, want):
    df = spark.createDataFrame([(guesses, scores)], "guesses array<string>, scores array<double>")
    assert df.select(replay.confident()).first()[0] == want


@pytest.mark.parametrize("df,q", [(1, 12.7062), (2, 4.3027), (5, 2.5706), (10, 2.2281), (30, 2.0423)])
def test_t_quantiles(df, q):
    assert abs(intervals.t_quantile(df) - q) < 2e-4


def test_single_group_has_no_width(spark):
    r = intervals.student(spark.createDataFrame([("a", 2.0)], "k string, v double"), ["k"], "v").first()
    assert (r["mean"], r["std"], r["n"], r["half_width"]) == (2.0, 0.0, 1, 0.0)


def test_pass_hat_beyond_factorials(spark):
    """25 trials in the run; task 4 has only 5 of them, and still C(c, k) is taken of 25."""
    t = spark.createDataFrame([(1, i, i < 20) for i in range(25)] + [(2, i, False) for i in range(25)] + [(3, i, True) for i in range(25)] + [(4, i, True) for i in range(5)], "task int, trial int, ok boolean")
    rows = scoring.pass_hat(t, "task", "trial", F.col("ok")).collect()
    got = {r["k"]: r["pass_hat"] for r in rows}
    assert sorted(got) == list(range(1, 26)) and all(abs(r["avg_reward"] - 50 / 80) < 1e-12 for r in rows)
    for k in range(1, 26):
        assert abs(got[k] - (math.comb(20, k) / math.comb(25, k) + 0 + 1 + math.comb(5, k) / math.comb(25, k)) / 4) < 1e-9
    assert scoring.pass_hat(t.limit(0), "task", "trial", F.col("ok")).count() == 0


def f1(p, g):
    import re
    import string
    norm = lambda s: " ".join(re.sub(r"\b(a|an|the)\b", " ", "".join(c for c in s.lower() if c not in string.punctuation)).split())
    p, g = norm(p), norm(g)
    if p != g and {p, g} & {"yes", "no", "noanswer"}:
        return 0.0
    c = sum((Counter(p.split()) & Counter(g.split())).values())
    return 2 * c / (len(p.split()) + len(g.split())) if c else 0.0


def test_token_f1(spark):
    pairs = [("yes", "no"), ("yes", "yes"), ("The", "a"), ("a a b b", "b b b"), ("!!", "x"), ("Red house.", "the red big house"), ("no", "no way"), ("", "")]
    got = {r["key"]: r["f1"] for r in scoring.token_f1(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, p string, g string"), "k", "p", "g").collect()}
    assert all(abs(got[i] - f1(*p)) < 1e-9 for i, p in enumerate(pairs))


def test_token_f1_of_equal_keys_and_long_texts(spark):
    """Rows are told apart even if they share a key; tokens are counted as multisets."""
    rng = random.Random(4)
    pairs = [(" ".join(rng.choice("pqrs") for _ in range(rng.randint(0, 9))), " ".join(rng.choice("pqrs") for _ in range(rng.randint(0, 9)))) for _ in range(80)] + [("x y " * 20000, "y z " * 20000)]
    got = scoring.token_f1(spark.createDataFrame([(1, *p) for p in pairs], "k int, p string, g string"), "k", "p", "g").collect()
    assert sorted(round(r["f1"], 9) for r in got) == sorted(round(f1(*p), 9) for p in pairs)


def test_missing_action_counts_as_zero(spark):
    m = spark.createDataFrame([(1, "general", 1.0), (1, "Look", 0.5), (2, "general", 0.0)], "sample int, action string, accuracy double")
    assert {r["action"]: r["accuracy"] for r in scoring.over_samples(m, m).collect()} == {"general": 0.5, "Look": 0.25}


def test_samples_without_a_pair_stay_in_the_mean(spark):
    pairs = spark.createDataFrame([(1, 0, "A[x]", ["a[x]"]), (1, 1, "A[x]", ["a[x]"]), (2, 0, "A[x]", ["a[x]"]), (3, 0, "A[x]", ["a[x]"]), (3, 1, "B[y]", ["b[z]"])], "sample int, pos int, action string, cand array<string>")
    got = scoring.over_samples(scoring.action_metrics(pairs, "sample", "pos", "action", "cand", 1), pairs).collect()
    assert {r["action"]: round(r["accuracy"], 9) for r in got} == {"general": round(1 / 3, 9), "A": round(1 / 3, 9), "B": 0.0}


def test_golden_metrics_shape(spark, tmp_path):
    for agent, guess, sample, body in (("a1", "g1", "1", '{"general": 1.0, "Search": 0.5}'), ("a1", "g1", "2", '{"general": 0.5}')):
        p = tmp_path / agent / guess / sample
        p.mkdir(parents=True)
        (p / "metrics.json").write_text(body)
    got = files.metrics(spark, str(tmp_path))
    assert got.count() == 3 and got.where("guess_dir = 'g1' and agent_dir = 'a1'").count() == 3


def test_majority_ties_go_to_the_first_seen(spark):
    v = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "y"), (1, 3, "x")], "k int, i int, v string")
    assert scoring.majority(v, ["k"], "v", ["i"]).first()["v"] == "x"


def test_jury_without_valid_votes(spark):
    v = spark.createDataFrame([("?",), ("",)], "v string")
    assert {r["option"]: r["share"] for r in scoring.jury_share(v, "v", ["a", "b"], []).collect()} == {"a": 0.0, "b": 0.0}


def test_hit_rate_counts_pairs_and_handles_no_calls(spark):
    s = "task int, turn int, name string, args string"
    real = spark.createDataFrame([(1, 2, "f", "{}"), (1, 2, "f", "{}")], s)
    pred = spark.createDataFrame([(1, 1, "f", "{}"), (1, 1, "f", "{}"), (2, 1, "g", "1")], s)
    got = {r["task"]: r["rate"] for r in calls.hit_rate(real, pred, pred).collect()}
    assert got == {1: 2.0, 2: 1.0}


def test_as_of_takes_equal_times_and_the_default(spark):
    left = spark.createDataFrame([("r", 1.0), ("r", 2.0), ("r", 0.5), ("s", 9.0)], "k string, t double")
    right = spark.createDataFrame([("r", 1.0, 10), ("r", 1.5, 20)], "k string, t double, v int")
    got = {(r["k"], r["t"]): r["as_of_v"] for r in windows.as_of(left, right, ["k"], "t", "t", "v", F.lit(-1)).collect()}
    assert got == {("r", 0.5): -1, ("r", 1.0): 10, ("r", 2.0): 20, ("s", 9.0): -1}


@pytest.mark.parametrize("n,chunks", [(12, 0), (13, 2), (20, 2)])
def test_chunks(spark, n, chunks):
    df = spark.createDataFrame([("r", i, 5.0) for i in range(n)], "k string, i int, p double")
    got = windows.chunks(df, ["k"], "i", "p").orderBy("chunk").collect()
    assert len(got) == chunks and all(r["best_at"] == 10 * r["chunk"] for r in got)


def test_counters(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (10, 20, 1.0), (-5, 1, 1.0)], "total int, idle int, s double")
    assert [r[0] for r in df.select(windows.utilization("total", "idle")).collect()] == [None, 0.0, None]
    assert [r[0] for r in df.select(windows.power("total", "s")).collect()] == [0.0, 1e-05, None]


@pytest.mark.parametrize("x,want", [(2.675, 2.67), (1.005, 1.0), (0.125, 0.12)])
def test_python_rounding(x, want):
    assert udfs.python_round(x) == want


@pytest.mark.parametrize("e,want", [("1 + 2 * 3", "7.0"), ("(1", "Error: '(' was never closed (<string>, line 1)"), ("__import__", udfs.INVALID), ("1/0", "Error: division by zero"), ("2**3", "8.0"), ("9" * 400, "Error: int too large to convert to float"), ("9" * 5000, None), ("1" + "*9" * 400 + " / 3", None)])
def test_calculate(e, want):
    assert udfs.calculate(e) == want if want else udfs.calculate(e).startswith("Error")


@pytest.mark.parametrize("text,want", [
    ("well:\n{\"a\":\n 1}\nbye", '{"a": 1}'), ("{\"a\": {\n}\n}\n}", '{"a": {}}'), ("x\n [{\n}\n, 2]}", None), ("{\n{\"b\": 2}  \nend }", '{"b": 2}'), ("{\"a\": 1} tail\n{\"c\": 3}", '{"c": 3}'), ("no", None), ("\"{}\" x", None)])
def test_lenient_json(text, want):
    assert udfs.lenient_json(text) == want


def test_lenient_json_reads_each_start_once():
    import time
    began = time.time()
    assert udfs.lenient_json("x\n" + "{\"a\":\n" * 3000) is None and udfs.lenient_json("x\n" + "{\n" * 30000 + "}\n" * 30000 + "{\"z\": 1}") == "{}"
    assert time.time() - began < 20


def test_all_failed_raises_the_first(spark):
    bad = spark.createDataFrame([(1, "late"), (0, "first")], "i int, e string")
    with pytest.raises(Exception, match="first"):
        udfs.without_errors(bad, "e", "i").collect()


def hand_value(cards):
    ranks, suits = sorted((r for r, _ in cards), reverse=True), {s for _, s in cards}
    by = sorted(Counter(ranks).items(), key=lambda x: (-x[1], -x[0]))
    order, shape = [r for r, _ in by], [n for _, n in by]
    flush = len(suits) == 1
    straight = ranks[0] if len(order) == 5 and ranks[0] - ranks[4] == 4 else 5 if ranks == [14, 5, 4, 3, 2] else 0
    if flush and straight:
        return 8, [straight]
    if shape[0] == 4:
        return 7, order
    if shape[:2] == [3, 2]:
        return 6, order
    if flush:
        return 5, ranks
    if straight:
        return 4, [straight]
    return {3: 3, 2: 2 if shape[:2] == [2, 2] else 1, 1: 0}[shape[0]], order


def test_poker_against_all_subsets(spark):
    rng, deck = random.Random(5), [(r, s) for r in range(2, 15) for s in "cdhs"]
    hands = [rng.sample(deck, 7) for _ in range(150)]
    hands += [[(14, "c"), (2, "c"), (3, "c"), (4, "c"), (5, "c"), (9, "d"), (9, "h")], [(7, "c"), (7, "d"), (7, "h"), (9, "c"), (9, "d"), (9, "h"), (2, "s")], [(2, "c"), (2, "d"), (3, "c"), (3, "d"), (4, "c"), (4, "d"), (9, "s")]]
    df = spark.createDataFrame([(i, r, s) for i, h in enumerate(hands) for r, s in h], "hand int, rank int, suit string")
    got = {r["hand"]: (r["category"], r["kickers"]) for r in settlement.poker(df, ["hand"], "rank", "suit").collect()}
    for i, h in enumerate(hands):
        assert got[i] == max(hand_value(c) for c in combinations(h, 5)), h


def test_auction_ties_and_zero_bids(spark):
    b = spark.createDataFrame([("x", 1, 5), ("x", 2, 5), ("x", 3, 4), ("y", 1, 0), ("y", 2, 0), ("z", 1, 0), ("z", 2, 3)], "item string, who int, bid int")
    assert [tuple(r) for r in settlement.auction(b, "item", "who", "bid").collect()] == [("z", 2, 3)]


def test_wordle(spark):
    df = spark.createDataFrame([("speed", "abide"), ("erase", "speed"), ("aabb", "abab")], "g string, s string")
    assert [r[0] for r in df.select(fn.wordle_feedback(F.col("g"), F.col("s"))).collect()] == ["XXYXY", "YXXYY", "GYYG"]


RES = "reservation_id string, user_id string, cabin string, legs array<struct<flight:string,date:string,price:double>>, n_passengers int, passengers array<string>, payments array<struct<method:string,amount:double>>, nonfree_bags int"
USERS = "user_id string, methods map<string,struct<source:string,balance:double>>"
FLIGHTS = "flight string, date string, status string, seats map<string,int>, prices map<string,double>"


@pytest.fixture(scope="module")
def airline(spark):
    users = spark.createDataFrame([("u", {"gift_card_1": ("gift_card", 300.0), "certificate_1": ("certificate", 100.0), "card": ("credit_card", 0.0)})], USERS)
    flights = spark.createDataFrame([("F1", "d1", "available", {"eco": 2}, {"eco": 100.0}), ("F2", "d1", "delayed", {"eco": 9}, {"eco": 50.0}), ("F3", "d1", "available", {"eco": 9}, {"eco": 80.0})], FLIGHTS)
    res = spark.createDataFrame([("R", "u", "eco", [("F1", "d1", 90.0)], 1, ["p"], [("card", 90.0)], 0)], RES)
    return users, flights, res


BOOK = "request_id int, user_id string, cabin string, legs array<struct<flight:string,date:string>>, n_passengers int, insured boolean, nonfree_bags int, pay array<struct<method:string,amount:double>>"


@pytest.mark.parametrize("user,legs,n,pay,want", [
    ("u", [("F1", "d1"), ("F3", "d1")], 1, [("gift_card_1", 160.0), ("certificate_1", 100.0)], None), ("x", [("F1", "d1")], 1, [], "Error: user not found"), ("u", [("F9", "d1")], 1, [], "Error: flight F9 not found"),
    ("u", [("F1", "d2")], 1, [], "Error: flight F1 not found on date d2"), ("u", [("F2", "d1")], 1, [], "Error: flight F2 not available on date d1"), ("u", [("F1", "d1")], 3, [], "Error: not enough seats on flight F1"),
    ("u", [("F1", "d1")], 1, [("no", 1.0)], "Error: payment method no not found"), ("u", [("F1", "d1")], 1, [("gift_card_1", 301.0)], "Error: not enough balance in payment method gift_card_1"), ("u", [("F1", "d1")], 1, [("card", 1.0)], "Error: payment amount does not add up, total price is 180.0, but paid 1.0")])
def test_booking(spark, airline, user, legs, n, pay, want):
    users, flights, _ = airline
    r = docdb.book(spark.createDataFrame([(1, user, "eco", legs, n, True, 1, pay)], BOOK), users, flights).first()
    if want is None:
        assert r["error"] is None and r["total"] == 260.0 and r["methods"]["gift_card_1"]["balance"] == 140.0 and "certificate_1" not in r["methods"]
    else:
        assert r["error"] == want


def test_reservations(spark, airline):
    users, flights, res = airline
    one = lambda schema, *v: spark.createDataFrame([v], schema)
    c = docdb.cancel_reservations(one("reservation_id string", "R"), res).first()
    assert c["status"] == "cancelled" and [p["amount"] for p in c["payments"]] == [90.0, -90.0]
    assert docdb.cancel_reservations(one("reservation_id string", "Q"), res).first()["error"] == "Error: reservation not found"
    bags = "reservation_id string, total_bags int, nonfree_bags int, method string"
    assert docdb.change_bags(one(bags, "R", 2, 2, "card"), res, users).first()["payments"][-1]["amount"] == 100.0
    assert docdb.change_bags(one(bags, "R", 2, 2, "certificate_1"), res, users).first()["error"] == docdb.ERRORS["certificate"]
    assert docdb.change_bags(one(bags, "R", 9, 9, "gift_card_1"), res, users).first()["error"] == docdb.ERRORS["gift_balance"]
    legs = "reservation_id string, cabin string, legs array<struct<flight:string,date:string>>, method string"
    assert docdb.change_legs(one(legs, "R", "eco", [("F1", "d1"), ("F3", "d1")], "card"), res, users, flights).first()["due"] == 80.0
    assert docdb.change_legs(one(legs, "R", "eco", [("F2", "d1")], "card"), res, users, flights).first()["error"] == "Error: flight F2 not available on date d1"
    assert docdb.change_passengers(one("reservation_id string, passengers array<string>", "R", ["a", "b"]), res).first()["error"] == docdb.ERRORS["passengers"]
    sent = docdb.send_certificates(one("user_id string, amount int", "u", 50), users, ["certificate_1", "certificate_2"]).first()
    assert sent["id"] == "certificate_2" and sent["methods"]["certificate_2"]["balance"] == 50.0


def test_gift_card_one_cent_short(spark):
    orders = spark.createDataFrame([(1, "u", "pending", [("payment", 10.0, "card")])], "order_id int, user_id string, status string, payments array<struct<type:string,amount:double,method:string>>")
    users = spark.createDataFrame([("u", {"gift_card_1": ("gift_card", 9.99), "card": ("credit_card", 0.0)})], USERS)
    assert docdb.change_payment(spark.createDataFrame([(1, "gift_card_1")], "order_id int, method string"), orders, users).first()["error"] == docdb.ERRORS["order_balance"]


def test_fingerprint_and_merge(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    digest = lambda t: docdb.fingerprint(t).first()["digest"]
    assert digest(a) == digest(a.orderBy(F.desc("k")).select("v", "k")) and digest(a) != digest(a.distinct())
    assert sorted(map(tuple, docdb.merged(a, "k", spark.createDataFrame([(1, "y")], "k int, v string")).collect()), key=str) == sorted([(1, "y"), (2, None), (2, None)], key=str)


def test_routing_and_latest(spark):
    models = spark.createDataFrame([("large", 45, 0), ("small", 10, 1), ("middle", 30, 2), ("other", 30, 3)], "model string, capability int, seq int")
    asked = spark.createDataFrame([(1, 5), (2, 30), (3, 31), (4, 99), (5, 5)], "id int, need int")
    assert {r["id"]: r["model"] for r in udfs.routed(models, asked).collect()} == {1: "small", 2: "middle", 3: "large", 4: None, 5: "small"}
    t = spark.createDataFrame([(1, 5, {"a": 1}), (1, 7, {"b": 2}), (2, None, {"c": 3})], "k int, at int, m map<string,int>")
    assert sorted((r["k"], r["at"], r["m"]) for r in files.latest_rows(t, ["k"], "at").collect()) == [(1, 7, {"b": 2}), (2, None, {"c": 3})]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_least_from_equals_a_loop_over_any_ranges(spark, parts):
    rng = random.Random(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for _ in range(3):
            have = {rng.randrange(400): rng.choice(["a", "b", None]) for _ in range(30)}
            asked = set(rng.sample(range(-20, 420), 200))
            h = spark.createDataFrame([*have.items(), (None, "never")], "v int, m string")
            got = {r["v"]: r["m"] for r in windows.least_from(h, spark.createDataFrame([(v,) for v in asked], "v long"), "v", "m").collect()}
            assert got == {v: have[min(up)] if (up := [x for x in have if x >= v]) else None for v in asked}
        empty = windows.least_from(h.limit(0), spark.createDataFrame([(3,)], "v long"), "v", "m")
        assert [tuple(r) for r in empty.collect()] == [(3, None)] and windows.least_from(h, h.select("v").limit(0), "v", "m").count() == 0
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_nearest_equals_all_pairs(spark):
    from trailmark.operators import similarity
    rng = random.Random(1)
    v = {i: [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)] for i in range(120)} | {500: [0.0] * 4, 501: None}
    frame = spark.createDataFrame(list(v.items()), "id int, e array<double>")
    got = {}
    small = lambda df, key, vec: similarity.blocks(df, key, vec, 16)
    assert small(frame, "id", "e").count() > 3
    for r in similarity.nearest(frame.where("id % 20 = 0"), frame, "id", "e", 5, 16).collect():
        got.setdefault(r["q"], []).append((-r["s"], r["id"]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b)) / (dot0(a) * dot0(b)) ** 0.5
    dot0 = lambda a: sum(x * x for x in a)
    for q in range(0, 120, 20):
        want = sorted((-round(dot(v[q], v[i]), 6), i) for i in v if i not in (q, 500, 501))[:5]
        assert [(round(s, 6), i) for s, i in sorted(got[q])] == want
    assert set(got) == set(range(0, 120, 20))


def test_gate_looks_at_all_earlier_user_messages(spark):
    from trailmark.operators import similarity
    rows = [(1, 0, "guess", [1.0, 0.0]), (1, 1, "user", [1.0, 0.0]), (1, 2, "user", [0.0, 1.0]), (1, 3, "guess", [0.9, 0.1]), (1, 4, "guess", [-1.0, -1.0]), (2, 0, "assistant", [1.0, 0.0]), (2, 1, "guess", [1.0, 0.0])]
    got = similarity.gate(spark.createDataFrame(rows, "c int, n int, role string, v array<double>"), "c", "n", "role", "v")
    assert {(r["c"], r["n"]): r["accepted"] for r in got.collect()} == {(1, 0): False, (1, 3): True, (1, 4): False, (2, 1): False}


def test_paragraphs_with_attributes_and_inline_tags(spark):
    from trailmark.functions.text import html_blocks
    page = "<div><p class='x'>One <b>two</b> three<p>A &amp; B<br>c</p>tail</div><P>end</P><pre>no</pre><ul id=u><li>x</li> <li>y z</li></ul>after"
    got = spark.createDataFrame([(page,), ("",)], "h string").select(html_blocks(F.col("h"), "p").alias("p"), html_blocks(F.col("h"), "ul").alias("u")).collect()
    assert [(r["p"], r["u"]) for r in got] == [(["One two three", "A & Bc", "end"], ["x y z"]), ([], [])]


def test_ladders_by_breadth_first_search(spark):
    from trailmark.operators import settlement
    words = ["cat", "cot", "cog", "dog", "dot", "bat", "xyz"]
    w = spark.createDataFrame([(x,) for x in words], "w string")
    near = {a: sorted(b for b in words if sum(x != y for x, y in zip(a, b)) == 1) for a in words}
    want = set()
    for a in words:
        paths, queue = {a: [a]}, [a]
        for x in queue:
            for y in near[x]:
                if y not in paths and len(paths[x]) < 4:
                    paths[y] = paths[x] + [y]
                    queue.append(y)
        want |= {(a, b, len(p) - 1, tuple(p)) for b, p in paths.items() if 2 <= len(p) - 1 <= 3}
    got = settlement.ladders(settlement.neighbours(w, "w"), w.select(F.col("w").alias("source")), 2, 3).collect()
    assert {(r["source"], r["target"], r["hops"], tuple(r["path"])) for r in got} == want and len(got) == len(want)


def test_steps_and_union_typed_actions(spark, tmp_path):
    (tmp_path / "steps_info_guess_7.json").write_text('{"10": {"current_move": "b"}, "2": {"current_move": "a", "guessed_moves": ["a", "c"]}}')
    got = files.steps(spark, str(tmp_path / "steps*_guess_*.json")).orderBy("step").select("step", "current_move", files.key_of_file(F.col("file")).alias("k")).collect()
    assert [tuple(r) for r in got] == [(2, "a", "7"), (10, "b", "7")]
    (tmp_path / "obs.json").write_text('{"prompt": "p", "actions": ["Search[x]", ["a", "b"]]}')
    assert files.trajectories(spark, str(tmp_path / "obs.json")).first()["actions"] == [["Search[x]"], ["a", "b"]]


def test_remaining(spark):
    todo, done = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (2,)], "k int")
    assert [r["k"] for r in sinks.remaining(todo, done, ["k"]).collect()] == [1]


def test_config():
    from trailmark.sources import config
    c = config.parse('{"mode": "dual", "run_duration_s": 20, "results_dir": "x", "min_granularity_range_ns": [1, 5]}')
    assert c.iterations == 20 and c.further == {"results_dir": "x"} and c.min_granularity_range_ns == (1, 5)
    for bad in ('{"mode": "none"}', '{"mode": "dual", "run_duration_s": 7, "window_duration_s": 2}', '{"mode": "dual", "min_granularity_range_ns": [5, 1]}'):
        with pytest.raises(ValueError):
            config.parse(bad)
    y = config.parse("# run\nmode: 'dual'  # both\nrun_duration_s: 20\nmin_granularity_range_ns: [1, 5]\nverbose: true\n")
    assert y.iterations == 20 and y.min_granularity_range_ns == (1, 5) and y.further == {"verbose": True}
