"""Tool calls by components against a sequential loop, fingerprints that follow changes, and the calculator."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trailmark.functions import udfs
from trailmark.operators import dispatch, docdb
from trailmark.operators.graph import components

ORDERS = "order_id string, user_id string, status string, address string, payments array<struct<type:string,amount:double,method:string>>"
USERS = "user_id string, address string, methods map<string,struct<source:string,balance:double>>"


def tables(spark, n=30):
    r = random.Random(n)
    orders = [(f"o{i}", f"u{r.randrange(8)}", r.choice(["pending", "delivered", "pending"]), "here", [("payment", round(r.uniform(1, 50), 2), r.choice(["gift_card_1", "card_1"]))]) for i in range(n)]
    users = [(f"u{i}", "home", {"gift_card_1": ("gift_card", 20.0), "card_1": ("credit_card", 0.0)}) for i in range(8)]
    o, u = spark.createDataFrame(orders, ORDERS), spark.createDataFrame(users, USERS)
    return {"orders": dispatch.Table(o, "order_id", {"user_id": "users"}), "users": dispatch.Table(u, "user_id")}


def boom(state, user_id):
    raise ValueError("boom")


TOOLS = dispatch.RETAIL | {"boom": dispatch.Tool(boom, (("users", "user_id"),))}


def calls(n, seed, episodes=()):
    r, out = random.Random(seed), []
    for seq in range(n):
        order, user = f"o{r.randrange(34)}", f"u{r.randrange(10)}"
        args = r.choice([("cancel_pending_order", {"order_id": order, "reason": r.choice(["no longer needed", "bored"])}), ("modify_pending_order_address", {"order_id": order, "address": f"a{seq}"}), ("modify_pending_order_payment", {"order_id": order, "method": r.choice(["gift_card_1", "card_1", "other"])}),
                         ("modify_user_address", {"user_id": user, "address": f"b{seq}"}), ("get_user_details", {"user_id": user}), ("get_order_details", {"order_id": order}), ("think", {"thought": "x"}), ("transfer_to_human_agents", {"summary": ""}), ("boom", {"user_id": user}), ("nothing", {"x": 1}), ("cancel_pending_order", {"order_id": order}), (None, None)])
        out.append((seq, args[0], json.dumps(args[1]) if args[1] is not None else None, r.choice(episodes) if episodes else None))
    r.shuffle(out)
    return out


def looped(rows, t):
    """All calls in order over whole copies of both tables, one copy an episode."""
    first = {name: {str(json.loads(d["j"])[x.key]): json.loads(d["j"]) for d in x.docs.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()} for name, x in t.items()}
    states, answers = {}, {}
    for seq, name, args, episode in sorted(rows, key=lambda r: r[0]):
        state = states.setdefault(episode, json.loads(json.dumps(first)))
        tool = TOOLS.get(name)
        try:
            answers[seq] = f"Unknown action {name}" if tool is None else tool.run(state, **json.loads(args or "{}"))
        except Exception as e:
            answers[seq] = f"Error: {e}"
    return answers, states, first


@pytest.mark.parametrize("episodes", [(), ("e1", "e2", "e3")])
def test_dispatch_equals_a_loop(spark, episodes):
    t, rows = tables(spark), calls(250, 5, episodes)
    want, states, first = looped(rows, t)
    answers, changed = dispatch.dispatch(spark.createDataFrame(rows, "seq long, tool string, args string, ep string"), t, TOOLS, "ep" if episodes else None)
    got = {r["seq"]: (r["answer"], r["done"]) for r in answers.collect()}
    assert {k: v[0] for k, v in got.items()} == want and len(got) == len(rows)
    assert {k for k, v in got.items() if v[1]} == {r[0] for r in rows if r[1] == "transfer_to_human_agents"}
    assert any(x.startswith("Error: boom") for x in want.values()) and any("cancelled" in x for x in want.values())
    for name, x in t.items():
        now = {(d["ep"] if episodes else None, d[x.key]): json.loads(d["j"]) for d in changed[name].withColumn("j", F.to_json(F.struct(*x.docs.columns), {"ignoreNullFields": "false"})).collect()}
        assert now == {(e, k): v for e, s in states.items() for k, v in s[name].items() if v != first[name][k]}


def test_dispatch_without_calls_or_documents(spark):
    t = tables(spark)
    none = spark.createDataFrame([], "seq long, tool string, args string")
    answers, changed = dispatch.dispatch(none, t, TOOLS)
    assert answers.count() == 0 and changed["orders"].count() == 0
    empty = {n: dispatch.Table(x.docs.limit(0), x.key, x.refers) for n, x in t.items()}
    answers, _ = dispatch.dispatch(spark.createDataFrame([(1, "get_order_details", '{"order_id": "o1"}')], none.schema), empty, TOOLS)
    assert answers.first()["answer"] == docdb.ERRORS["order"]


def test_many_small_components_share_a_group(spark):
    """A thousand users of two orders each: no rounds of components, one group, and each component sees its own documents only."""
    orders = [(f"o{i}", f"u{i // 2}", "pending", "here", [("payment", 5.0, "gift_card_1")]) for i in range(2000)]
    users = [(f"u{i}", "home", {"gift_card_1": ("gift_card", float(i))}) for i in range(1000)]
    t = {"orders": dispatch.Table(spark.createDataFrame(orders, ORDERS), "order_id", {"user_id": "users"}), "users": dispatch.Table(spark.createDataFrame(users, USERS), "user_id")}
    seen = {"seen": dispatch.Tool(lambda state, order_id: ",".join(f"{tab}:{len(docs)}" for tab, docs in sorted(state.items())), (("orders", "order_id"),))}
    c = spark.createDataFrame([(i, "seen", json.dumps({"order_id": f"o{i}"})) for i in range(2000)], "seq long, tool string, args string")
    placed, docs = dispatch.placed(c, t, seen)
    assert placed.select("root").distinct().count() == 1000 and placed.select("block").distinct().count() == 1 and docs.count() == 3000
    assert {r["answer"] for r in dispatch.answers(dispatch.played(c, t, seen, what="answers")).collect()} == {"orders:2,users:1"}


def test_documents_that_refer_to_each_other_are_one_component(spark):
    """Chains and rings of references, and calls about two documents, are linked by rounds."""
    refer = {"a": "b", "b": "c", "c": None, "d": "e", "e": "d", "f": None, "g": None, "h": "x"}
    t = {"things": dispatch.Table(spark.createDataFrame(list(refer.items()), "k string, other string"), "k", {"other": "things"})}
    tools = {"one": dispatch.Tool(lambda state, a: "".join(sorted(state["things"])), (("things", "a"),)), "two": dispatch.Tool(lambda state, a, b: "".join(sorted(state["things"])), (("things", "a"), ("things", "b")))}
    rows = [(i, "one", json.dumps({"a": k})) for i, k in enumerate("abcdegh")] + [(9, "two", json.dumps({"a": "f", "b": "e"})), (10, "two", json.dumps({"a": "g", "b": "g"}))]
    got = {r["seq"]: r["answer"] for r in dispatch.dispatch(spark.createDataFrame(rows, "seq long, tool string, args string"), t, tools)[0].collect()}
    assert got == {0: "abc", 1: "abc", 2: "abc", 3: "def", 4: "def", 5: "g", 6: "h", 9: "def", 10: "g"}


def test_components_of_random_links(spark):
    r = random.Random(2)
    links = [(f"{r.randrange(300):03}", f"{r.randrange(300):03}") for _ in range(220)] + [("000", f"{i}") for i in range(400, 460)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()}
    assert got == {x: find(x) for x in up}


def test_fingerprint_follows_changes(spark):
    kind = "k int, v string"
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None), (3, "y")], kind)
    out, into = spark.createDataFrame([(2, None), (3, "y")], kind), spark.createDataFrame([("z", 3), ("z", 3)], "v string, k int")
    now = spark.createDataFrame([(1, "x"), (2, None), (3, "z"), (3, "z")], kind)
    kept = lambda x, y: docdb.digest_of(docdb.parts_changed(docdb.fingerprint_parts(a), x, y)).first()
    assert kept(out, into) == docdb.fingerprint(now).first() and kept(out.limit(0), into.limit(0)) == docdb.fingerprint(a).first() != docdb.fingerprint(now).first()
    assert kept(a, a.limit(0)) == docdb.fingerprint(a.limit(0)).first()


def test_calculator_equals_evaluation():
    import warnings
    r = random.Random(7)
    texts = ["2**10", "7//2", "1/0", "1//0", "7 % 2", "(1", "", "()", "...", "2(3)", "(-8)**.5", "010", "-(2)**2", "2 ** -1", "1.5**5000", "9"*400, "()+()", "1 2", " 1", "0**0", "0**-1", "(2)(3)", "1./3", ".", "+-+1"]
    texts += ["".join(r.choice("0123456789+-*/(). ") for _ in range(r.randint(1, 7))) for _ in range(3000)]
    for t in texts:
        if "**" in t and len(t) > 5 and t not in ("(-8)**.5", "-(2)**2", "2 ** -1", "1.5**5000"):
            continue
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                want = str(round(float(eval(t, {"__builtins__": None}, {})), 2)) if set(t) <= set("0123456789+-*/(). ") else udfs.INVALID
        except Exception as e:
            want = f"Error: {e}"
        assert udfs.calculate(t) == want, t
    assert udfs.calculate("9**9**9") == "Error: int too large to convert to float" and udfs.calculate(None) is None
