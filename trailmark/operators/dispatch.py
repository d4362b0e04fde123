"""Dispatch of tool calls against document tables.

Calls come in the order of their numbers, and each sees what those before it have changed. Only calls that share a document
have to wait for each other, so a call links the documents that it names, and a document those that it refers to (an order its
user). The connected components of these links are independent: each is folded over its own calls and documents, and sees no
document outside. A component is as long as its chain of calls, which is sequential by what it means; it stays within one task.
Most components are a few calls, so many of them share a group of about BLOCK calls, each with a state of its own: a grouped
pass for each would cost more than its calls.

Documents are numbered by a 64-bit hash; if two have the same, their components are folded together, which changes no answer.
A document that refers to others stands for them by the least of these from the start, so links to a common document
(orders to their user) need no rounds; only what is left is settled by rounds of components.

With an episode column each episode works on its own copy of the documents, from their first state; without, all share them.

Answers: what a tool returns; `Error: ` and the exception's text if it raises; `Unknown action ` and the name for a name that
no tool has. Calls without a document depend on nothing and are dealt by their
numbers, a thousand at a time. Nulls: a null name is unknown, null arguments are none; a
document that isn't there is linked all the same, and its tool says so.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .docdb import ERRORS, REASONS
from .graph import components

State = dict[str, dict[str, dict]]


@dataclass(frozen=True)
class Tool:
    """run(state, **arguments) gives the answer and may change the documents of state[table][key]. touches: (table, argument)."""

    run: Callable[..., str]
    touches: tuple[tuple[str, str], ...] = ()
    ends: bool = False


@dataclass(frozen=True)
class Table:
    """Documents with their key, and the columns that refer to documents of other tables."""

    docs: DataFrame
    key: str
    refers: dict[str, str] = field(default_factory=dict)


#: Calls that share a group, unless a component is longer.
BLOCK = 20_000
_encode = json.JSONEncoder(sort_keys=True).encode


def _play(calls: pd.DataFrame, docs: pd.DataFrame, tools: dict[str, Tool], what: str = "both") -> list[tuple]:
    """Rows of the answers and of the changed documents, or of one of them. Each (root, episode) has a state of its own."""
    states: dict[tuple, State] = {}
    first = []  # what each document was
    for r in docs.itertuples():
        doc = json.loads(r.doc)
        states.setdefault((r.root, r.episode), {}).setdefault(r.tab, {})[r.key] = doc
        first.append(repr(doc) if what != "answers" else None)
    out = []
    for c in calls.sort_values("seq", kind="stable").itertuples():
        tool = tools.get(c.tool)
        try:
            answer = f"Unknown action {c.tool}" if tool is None else tool.run(states.setdefault((c.root, c.episode), {}), **json.loads(c.args or "{}"))
        except Exception as e:  # whatever a tool raises is its answer
            answer = f"Error: {e}"
        if what != "changes":
            out.append((c.seq, answer, bool(tool and tool.ends), None, None, None, c.episode))
    for r, was in zip(docs.itertuples(), first) if what != "answers" else ():
        doc = states[r.root, r.episode][r.tab][r.key]
        if repr(doc) != was and (now := _encode(doc)) != _encode(json.loads(r.doc)):
            out.append((None, None, None, r.tab, r.key, now, r.episode))
    return out


def _id(episode: Column, tab: Column, key: Column) -> Column:
    """The number of a document: odd, so that it is never that of calls without one."""
    return F.xxhash64(episode, tab, key).bitwiseOR(F.lit(1))


def placed(calls: DataFrame, tables: dict[str, Table], tools: dict[str, Tool], episode: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(seq, tool, args, episode, root, block) of the calls, and (episode, tab, key, doc, root, block) of the documents that they need."""
    where = F.col(episode).cast("string") if episode else F.lit("")
    c = calls.select(F.col("seq").cast("long").alias("seq"), F.col("tool").cast("string").alias("tool"), F.col("args").cast("string").alias("args"), F.coalesce(where, F.lit("")).alias("episode"))
    named = {}
    for name, t in tools.items():
        for touch in t.touches:
            named.setdefault(touch, []).append(name)

    # Each argument is taken from the text once, in a projection of its own.
    c = c.select("*", *[F.when(F.col("tool").isin(*names), F.get_json_object("args", f"$.{arg}")).alias(f"__k{i}") for i, ((_, arg), names) in enumerate(named.items())])
    found = [F.when(F.col(f"__k{i}").isNotNull(), F.struct(_id(F.col("episode"), F.lit(tab), F.col(f"__k{i}")).alias("id"), F.lit(tab).alias("tab"), F.col(f"__k{i}").alias("key"))) for i, (tab, _) in enumerate(named)]
    none = F.array().cast("array<struct<id:long,tab:string,key:string>>")
    c = kept(c.select("seq", "tool", "args", "episode", (F.array_distinct(F.array_compact(F.array(*found))) if found else none).alias("nodes")))
    nodes = c.select("episode", F.explode("nodes").alias("n")).select("episode", "n.*").distinct()

    # (id, tab, key, episode, others): the documents that each refers to
    parts = []
    for tab in sorted({tab for tab, _ in named}):
        mine, t = nodes.where(F.col("tab") == tab), tables.get(tab)
        if not t or not t.refers:
            parts.append(mine.withColumn("others", none))
            continue
        refs = t.docs.select(F.col(t.key).cast("string").alias("key"), F.array(*[F.struct(F.lit(other).alias("tab"), F.col(x).cast("string").alias("key")) for x, other in t.refers.items()]).alias("refs"))
        refs = refs.groupBy("key").agg(F.flatten(F.collect_set("refs")).alias("refs"))  # a key has one document, as a rule
        got = F.transform(F.filter(F.coalesce("refs", F.array()), lambda x: x["key"].isNotNull()), lambda x: F.struct(_id(F.col("episode"), x["tab"], x["key"]).alias("id"), x["tab"].alias("tab"), x["key"].alias("key")))
        parts.append(mine.join(refs, "key", "left").select("id", "tab", "key", "episode", got.alias("others")))
    cols = ["id", "tab", "key", "episode", "others"]
    every = nodes.limit(0).withColumn("others", none).select(*cols)
    for x in parts:
        every = every.unionByName(x.select(*cols))
    every = kept(every.withColumn("label", F.coalesce(F.array_min(F.transform("others", lambda x: x["id"])), F.col("id"))))

    # What is left to link: a document's label with those that it refers to, and the documents of one call.
    refer = every.select(F.col("label").alias("a"), F.explode("others").alias("o")).select("a", F.col("o.id").alias("o"), F.col("o.tab").alias("tab")).distinct()
    own_label = ~F.col("tab").isin([x for x, t in tables.items() if t.refers])
    refer = kept(refer.where(~(own_label & (F.col("a") == F.col("o")))).select("a", "o"))
    together = kept(c.where(F.size("nodes") > 1).select(F.get("nodes", F.lit(0))["id"].alias("x"), F.explode("nodes").alias("n")).select("x", F.col("n.id").alias("o")).where("x <> o").distinct())
    if refer.isEmpty() and together.isEmpty():
        rooted = every.withColumn("root", F.col("label"))
    else:
        label = every.groupBy("id").agg(F.min("label").alias("label"))
        links = refer.unionByName(together.join(label, F.col("x") == F.col("id")).select(F.col("label").alias("a"), "o"))
        links = links.join(label, F.col("o") == F.col("id"), "left").select("a", F.coalesce("label", "o").alias("b")).where("a <> b")
        roots = kept(components(links, "a", "b"))
        rooted = every.join(roots, F.col("label") == F.col("node"), "left").withColumn("root", F.coalesce("root", "label"))

    block = F.pmod("root", F.lit(max(1, -(-c.count() // BLOCK)))).alias("block")
    alone = F.xxhash64("episode", F.floor(F.col("seq") / 1000)).bitwiseAND(F.lit(-2))
    first = c.withColumn("id", F.get("nodes", F.lit(0))["id"])
    some = first.where("id is not null").join(rooted.groupBy("id").agg(F.min("root").alias("root")), "id")
    own = ["seq", "tool", "args", "episode", "root"]
    every_call = some.select(*own).unionByName(first.where("id is null").withColumn("root", alone).select(*own)).select(*own, block)
    needed = rooted.select("root", "episode", F.explode(F.concat(F.array(F.struct("id", "tab", "key")), "others")).alias("n")).select("root", "episode", "n.tab", "n.key").distinct()
    docs = None
    for name, t in tables.items():
        doc = t.docs.select(F.col(t.key).cast("string").alias("key"), F.to_json(F.struct(*[F.col(f"`{x}`") for x in t.docs.columns]), {"ignoreNullFields": "false"}).alias("doc"))
        got = needed.where(F.col("tab") == name).join(doc, "key").select("root", "episode", "tab", "key", "doc", block)
        docs = got if docs is None else docs.unionByName(got)
    return every_call, docs


def played(calls: DataFrame, tables: dict[str, Table], tools: dict[str, Tool], episode: str | None = None, what: str = "both") -> DataFrame:
    """All calls folded, as rows of `answers` and `changes`; what: both, answers or changes, for plans that need one of them only. Not
    written: whoever reads it more than once keeps it."""

    def run(calls: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_play(calls, docs, tools, what), columns=["seq", "answer", "done", "tab", "key", "doc", "episode"]).astype({"seq": "Int64", "done": "boolean"})

    every_call, docs = placed(calls, tables, tools, episode)
    schema = "seq long, answer string, done boolean, tab string, key string, doc string, episode string"
    return every_call.groupBy("block").cogroup(docs.groupBy("block")).applyInPandas(run, schema)


def answers(out: DataFrame, episode: str | None = None) -> DataFrame:
    """(seq, answer, done[, episode]) of what `played` gave."""
    return out.where("seq is not null").select("seq", "answer", "done", *([F.col("episode").alias(episode)] if episode else []))


def changes(out: DataFrame, tables: dict[str, Table], episode: str | None = None) -> dict[str, DataFrame]:
    """Each table's changed documents of what `played` gave, for `docdb.merged`."""
    changed = {}
    for name, t in tables.items():
        rows = out.where(F.col("seq").isNull() & (F.col("tab") == name)).select(*([F.col("episode").alias(episode)] if episode else []), F.from_json("doc", t.docs.schema).alias("__d"))
        changed[name] = rows.select(*([episode] if episode else []), "__d.*")
    return changed


def dispatch(calls: DataFrame, tables: dict[str, Table], tools: dict[str, Tool], episode: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """calls (seq, tool, args as JSON[, episode]): the answers (seq, answer, done[, episode]), and each table's changed documents, for `docdb.merged`."""
    out = kept(played(calls, tables, tools, episode))
    return answers(out, episode), changes(out, tables, episode)


def _gift(method: str) -> bool:
    return "gift_card" in method


def _found(state: State, tab: str, key: object, what: str) -> dict | str:
    return state.get(tab, {}).get(str(key), ERRORS[what])


def _text(doc: dict) -> str:
    return _encode(doc)


def cancel_order(state: State, order_id: object, reason: str) -> str:
    order = _found(state, "orders", order_id, "order")
    if isinstance(order, str):
        return order
    if order["status"] != "pending":
        return ERRORS["cancel_status"]
    if reason not in REASONS:
        return ERRORS["reason"]
    back = [{"type": "refund", "amount": p["amount"], "method": p["method"]} for p in order["payments"]]
    for p in back:
        if _gift(p["method"]):
            m = state["users"][str(order["user_id"])]["methods"][p["method"]]
            m["balance"] = round(m["balance"] + p["amount"], 2)
    order["status"], order["payments"] = "cancelled", order["payments"] + back
    return _text(order)


def order_address(state: State, order_id: object, address: str) -> str:
    order = _found(state, "orders", order_id, "order")
    if isinstance(order, str):
        return order
    if order["status"] != "pending":
        return ERRORS["modify_status"]
    order["address"] = address
    return _text(order)


def user_address(state: State, user_id: object, address: str) -> str:
    user = _found(state, "users", user_id, "user")
    if isinstance(user, str):
        return user
    user["address"] = address
    return _text(user)


def order_payment(state: State, order_id: object, method: str) -> str:
    order = _found(state, "orders", order_id, "order")
    if isinstance(order, str):
        return order
    if order["status"] != "pending":
        return ERRORS["modify_status"]
    methods = state["users"][str(order["user_id"])]["methods"]
    if method not in methods:
        return ERRORS["payment"]
    first = order["payments"][0]
    if len(order["payments"]) > 1 or first["type"] != "payment":
        return ERRORS["one_payment"]
    if first["method"] == method:
        return ERRORS["same_payment"]
    if _gift(method) and methods[method]["balance"] < first["amount"]:
        return ERRORS["order_balance"]
    order["payments"] = order["payments"] + [{"type": "payment", "amount": first["amount"], "method": method}, {"type": "refund", "amount": first["amount"], "method": first["method"]}]
    for m, sign in ((method, -1), (first["method"], 1)):
        if _gift(m):
            methods[m]["balance"] = round(methods[m]["balance"] + sign * first["amount"], 2)
    return _text(order)


#: The names under which the tools are called, and those that end an episode.
RETAIL = {
    "cancel_pending_order": Tool(cancel_order, (("orders", "order_id"),)),
    "modify_pending_order_address": Tool(order_address, (("orders", "order_id"),)),
    "modify_pending_order_payment": Tool(order_payment, (("orders", "order_id"),)),
    "modify_user_address": Tool(user_address, (("users", "user_id"),)),
    "get_order_details": Tool(lambda state, order_id: x if isinstance(x := _found(state, "orders", order_id, "order"), str) else _text(x), (("orders", "order_id"),)),
    "get_user_details": Tool(lambda state, user_id: x if isinstance(x := _found(state, "users", user_id, "user"), str) else _text(x), (("users", "user_id"),)),
    "think": Tool(lambda state, thought: ""),
    "transfer_to_human_agents": Tool(lambda state, summary: "Transfer successful", ends=True),
}
