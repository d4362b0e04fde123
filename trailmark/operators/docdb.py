"""Tools over nested document tables: reads as joins, writes as copies.

A tool gets a table of requests, one row per request, joins the documents it needs by key, evaluates its guards in order
(the first that fails gives the error) and returns the requests with `error` and the new values; `merged` then puts
changed documents beside the untouched ones. Nothing is changed where there is an error. Requests of one call act on
different documents; `in_order` deals a sequence of calls on the same documents into such calls, and dispatch.py plays mixed calls in
their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The texts of errors.
ERRORS = {
    "order": "Error: order not found", "user": "Error: user not found", "product": "Error: product not found", "reservation": "Error: reservation not found",
    "cancel_status": "Error: non-pending order cannot be cancelled", "reason": "Error: invalid reason", "return_status": "Error: non-delivered order cannot be returned",
    "exchange_status": "Error: non-delivered order cannot be exchanged", "modify_status": "Error: non-pending order cannot be modified", "payment": "Error: payment method not found",
    "original": "Error: payment method should be either the original payment method or a gift card", "some_item": "Error: some item not found",
    "match": "Error: the number of items to be exchanged should match", "diff_balance": "Error: insufficient gift card balance to pay for the price difference",
    "new_balance": "Error: insufficient gift card balance to pay for the new item", "one_payment": "Error: there should be exactly one payment for a pending order",
    "same_payment": "Error: the new payment method should be different from the current one", "order_balance": "Error: insufficient gift card balance to pay for the order",
    "certificate": "Error: certificate cannot be used to update reservation", "gift_balance": "Error: gift card balance is not enough", "passengers": "Error: number of passengers does not match",
}
#: Reasons for which an order may be cancelled.
REASONS = ("no longer needed", "ordered by mistake")


def guard(*checks: tuple[Column, str | Column]) -> Column:
    """The message of the first check that is true, else null."""
    got = F.lit(None).cast("string")
    for fails, message in reversed(checks):
        got = F.when(F.coalesce(fails, F.lit(False)), F.lit(ERRORS.get(message, message)) if isinstance(message, str) else message).otherwise(got)
    return got


def merged(table: DataFrame, key: str, changed: DataFrame) -> DataFrame:
    """The table with the changed documents in place of their old versions."""
    return table.join(changed.select(key), key, "left_anti").unionByName(changed.select(table.columns))


def looked_up(requests: DataFrame, table: DataFrame, key: str, what: str) -> DataFrame:
    """requests with the document of their key as JSON, or the error."""
    doc = table.select(F.col(key).alias("__key"), F.to_json(F.struct(*table.columns)).alias("__doc"))
    return requests.join(doc, requests[key] == F.col("__key"), "left").select(*requests.columns, F.coalesce("__doc", F.lit(ERRORS[what])).alias("answer"))


def first_match(table: DataFrame, where: Column, order: list[str], value: str) -> DataFrame:
    """The value of the first matching row: an aggregation, so nothing is sorted."""
    return table.where(where).agg(F.min(F.struct(*order, value)).alias("x")).select(F.coalesce(F.col(f"x.{value}").cast("string"), F.lit(ERRORS["user"])).alias("answer"))


def more_than_held(wanted: Column, held: Column) -> Column:
    """Whether some value stands in `wanted` more often than in `held`."""
    n = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    return F.exists(wanted, lambda x: n(wanted, x) > n(held, x))


def is_gift(method: Column) -> Column:
    return F.contains(method, F.lit("gift_card"))


def with_order(requests: DataFrame, orders: DataFrame) -> DataFrame:
    o = orders.select(F.col("order_id").alias("__o"), *[c for c in orders.columns if c != "order_id"])
    return requests.join(o, requests["order_id"] == F.col("__o"), "left")


def with_methods(df: DataFrame, users: DataFrame) -> DataFrame:
    return df.join(users.select(F.col("user_id").alias("__u"), "methods"), F.col("user_id") == F.col("__u"), "left")


def cancel_orders(requests: DataFrame, orders: DataFrame) -> DataFrame:
    """requests(order_id, reason): error, status, payments with a refund for each payment, and what goes back to gift cards."""
    r = with_order(requests, orders)
    r = r.withColumn("error", guard((F.col("__o").isNull(), "order"), (F.col("status") != "pending", "cancel_status"), (~F.col("reason").isin(*REASONS), "reason")))
    ok = F.col("error").isNull()
    refunds = F.transform("payments", lambda p: F.struct(F.lit("refund").alias("type"), p["amount"].alias("amount"), p["method"].alias("method")))
    credit = F.aggregate(F.filter("payments", lambda p: is_gift(p["method"])), F.lit(0.0), lambda a, p: a + p["amount"])
    return r.select("order_id", "user_id", "error", F.when(ok, "cancelled").otherwise(F.col("status")).alias("status"), F.when(ok, F.concat("payments", refunds)).otherwise(F.col("payments")).alias("payments"), F.when(ok, F.round(credit, 2)).otherwise(0.0).alias("credit"))


def return_items(requests: DataFrame, orders: DataFrame, users: DataFrame) -> DataFrame:
    """requests(order_id, item_ids, method)."""
    r = with_methods(with_order(requests, orders), users)
    held = F.transform("items", lambda i: i["item_id"])
    method = F.col("method")
    error = guard((F.col("__o").isNull(), "order"), (F.col("status") != "delivered", "return_status"), (~F.map_contains_key("methods", method), "payment"),
                  (~is_gift(method) & (method != F.get("payments", F.lit(0))["method"]), "original"), (more_than_held(F.col("item_ids"), held), "some_item"))
    r = r.withColumn("error", error)
    ok = F.col("error").isNull()
    return r.select("order_id", "error", F.when(ok, "return requested").otherwise(F.col("status")).alias("status"), F.when(ok, F.array_sort("item_ids")).alias("return_items"))


def swap_items(requests: DataFrame, orders: DataFrame, users: DataFrame, variants: DataFrame, pending: bool) -> DataFrame:
    """Exchange of a delivered or change of a pending order's items: requests(order_id, item_ids, new_item_ids, method). A new
    item must be an available variant of the same product; a gift card must cover what is to pay more."""
    r = with_methods(with_order(requests, orders), users)
    held = F.transform("items", lambda i: i["item_id"])
    missing = F.get(F.filter("item_ids", lambda x: F.size(F.filter("item_ids", lambda y: y == x)) > F.size(F.filter(held, lambda y: y == x))), F.lit(0))
    product = lambda item: F.get(F.filter("items", lambda i: i["item_id"] == item), F.lit(0))
    r = r.withColumn("__missing", missing).withColumn("__pairs", F.when(F.size("item_ids") == F.size("new_item_ids"), F.transform("item_ids", lambda x, i: F.struct(i.alias("i"), F.get("new_item_ids", i).alias("new"), product(x)["product_id"].alias("product_id"), product(x)["price"].alias("price")))))
    # the variants wanted: one row a pair, met by key, and gathered again by request
    v = variants.select(F.col("item_id").alias("__v"), F.col("product_id").alias("__vp"), "available", F.col("price").alias("__vprice"))
    pairs = r.select(F.col("order_id").alias("__r"), F.explode("__pairs").alias("p")).join(v, F.col("p.new") == F.col("__v"), "left")
    bad = F.coalesce(~F.col("available") | (F.col("__vp") != F.col("p.product_id")), F.lit(True))
    priced = pairs.groupBy("__r").agg(F.min(F.when(bad, F.struct(F.col("p.i").alias("i"), F.col("p.new").alias("new")))).alias("__bad"), F.sum(F.when(~bad, F.col("__vprice") - F.col("p.price"))).alias("__diff"))
    r = r.join(priced, F.col("order_id") == F.col("__r"), "left").withColumn("__diff", F.round("__diff", 2))
    balance = F.element_at("methods", F.col("method"))["balance"]
    error = guard(
        (F.col("__o").isNull(), "order"), (F.col("status") != ("pending" if pending else "delivered"), "modify_status" if pending else "exchange_status"),
        (F.col("__missing").isNotNull(), F.concat(F.lit("Error: "), F.col("__missing").cast("string"), F.lit(" not found"))), (F.size("item_ids") != F.size("new_item_ids"), "match"),
        (F.col("__bad").isNotNull(), F.concat(F.lit("Error: new item "), F.col("__bad.new").cast("string"), F.lit(" not found or available"))), (~F.map_contains_key("methods", F.col("method")), "payment"),
        (is_gift(F.col("method")) & (balance < F.col("__diff")), "new_balance" if pending else "diff_balance"))
    r = r.withColumn("error", error)
    ok = F.col("error").isNull()
    new = "pending (item modified)" if pending else "exchange requested"
    return r.select("order_id", "user_id", "error", F.when(ok, new).otherwise(F.col("status")).alias("status"), F.when(ok, F.array_sort("item_ids")).alias("old_items"), F.when(ok, F.array_sort("new_item_ids")).alias("new_items"), F.when(ok, F.col("__diff")).alias("difference"))


def change_payment(requests: DataFrame, orders: DataFrame, users: DataFrame) -> DataFrame:
    """requests(order_id, method): a pending order is paid by another method, the first payment goes back."""
    r = with_methods(with_order(requests, orders), users)
    first = F.get("payments", F.lit(0))
    m = F.col("method")
    error = guard((F.col("__o").isNull(), "order"), (F.col("status") != "pending", "modify_status"), (~F.map_contains_key("methods", m), "payment"), ((F.size("payments") > 1) | (first["type"] != "payment"), "one_payment"),
                  (first["method"] == m, "same_payment"), (is_gift(m) & (F.element_at("methods", m)["balance"] < first["amount"]), "order_balance"))
    r = r.withColumn("error", error)
    ok = F.col("error").isNull()
    added = F.array(F.struct(F.lit("payment").alias("type"), first["amount"].alias("amount"), m.alias("method")), F.struct(F.lit("refund").alias("type"), first["amount"].alias("amount"), first["method"].alias("method")))
    gift = F.when(ok & is_gift(m), -first["amount"]).when(ok & is_gift(first["method"]), first["amount"]).otherwise(0.0)
    return r.select("order_id", "user_id", "error", F.when(ok, F.concat("payments", added)).otherwise(F.col("payments")).alias("payments"), gift.alias("credit"))


def change_address(requests: DataFrame, docs: DataFrame, key: str, status: str | None, what: str) -> DataFrame:
    """requests(key, new_address): of a pending order, or of a user (status None)."""
    d = docs.select(F.col(key).alias("__k"), *[c for c in docs.columns if c != key])
    r = requests.join(d, requests[key] == F.col("__k"), "left")
    checks = [(F.col("__k").isNull(), what)] + ([(F.col("status") != status, "modify_status")] if status else [])
    r = r.withColumn("error", guard(*checks))
    return r.select(key, "error", F.when(F.col("error").isNull(), F.col("new_address")).otherwise(F.col("address")).alias("address"))


def credited(users: DataFrame, results: DataFrame) -> DataFrame:
    """users with what results(user_id, credit) give to or take from their gift cards."""
    c = results.where("error is null and credit <> 0").groupBy("user_id").agg(F.sum("credit").alias("__c"))
    put = F.transform_values("methods", lambda k, v: F.struct(v["source"].alias("source"), F.when(is_gift(k), F.round(v["balance"] + F.coalesce("__c", F.lit(0.0)), 2)).otherwise(v["balance"]).alias("balance")))
    return users.join(c, "user_id", "left").withColumn("methods", put).select(users.columns)


def direct_flights(flights: DataFrame, searches: DataFrame) -> DataFrame:
    """searches(origin, destination, date): the flights that are available then."""
    return searches.join(flights.where("status = 'available'"), ["origin", "destination", "date"])


def onestop_flights(flights: DataFrame, searches: DataFrame) -> DataFrame:
    """Two legs through one hub; the second doesn't leave before the first lands, by comparison of the time texts. The
    second leg's date is the next day if the first lands with +1."""
    ok = flights.where("status = 'available'")
    a = searches.join(ok, ["origin", "date"]).where("destination <> goal").select("search_id", "goal", "date", F.col("destination").alias("hub"), F.col("flight").alias("first"), "arrives", F.when(F.contains("arrives", F.lit("+1")), F.date_add("date", 1)).otherwise(F.col("date")).alias("date2"))
    b = ok.select(F.col("origin").alias("hub"), F.col("destination").alias("goal"), F.col("date").alias("date2"), F.col("flight").alias("second"), "departs")
    return a.join(b, ["hub", "goal", "date2"]).where("not arrives > departs").select("search_id", "hub", "first", "second", "date", "date2")


def book(requests: DataFrame, users: DataFrame, flights: DataFrame) -> DataFrame:
    """requests(request_id, user_id, cabin, legs array<struct<flight,date>>, n_passengers, insured, nonfree_bags, pay array<struct<method,amount>>):
    error, total price and the user's methods after it; gift cards are charged, certificates are used up.

    flights(flight, date, status, seats map, prices map). Legs are met by key and gathered by request.
    """
    leg = requests.select("request_id", "cabin", "n_passengers", F.posexplode("legs").alias("i", "leg")).select("*", "leg.*").drop("leg")
    known = flights.select(F.col("flight").alias("__f")).distinct()
    leg = leg.join(known, F.col("flight") == F.col("__f"), "left").join(flights, ["flight", "date"], "left")
    no = F.col("flight").cast("string")
    bad = F.when(F.col("__f").isNull(), F.concat(F.lit("Error: flight "), no, F.lit(" not found"))).when(F.col("status").isNull(), F.concat(F.lit("Error: flight "), no, F.lit(" not found on date "), F.col("date").cast("string")))
    bad = bad.when(F.col("status") != "available", F.concat(F.lit("Error: flight "), no, F.lit(" not available on date "), F.col("date").cast("string"))).when(F.element_at("seats", F.col("cabin")) < F.col("n_passengers"), F.concat(F.lit("Error: not enough seats on flight "), no))
    legs = leg.groupBy("request_id").agg(F.min(F.when(bad.isNotNull(), F.struct("i", bad.alias("m")))).alias("__bad"), F.sum(F.element_at("prices", F.col("cabin"))).alias("__price"))
    r = requests.join(legs, "request_id", "left").join(users.select(F.col("user_id").alias("__u"), "methods"), F.col("user_id") == F.col("__u"), "left")
    total = F.round(F.col("n_passengers") * (F.col("__price") + F.when(F.col("insured"), 30).otherwise(0)) + 50 * F.col("nonfree_bags"), 2)
    limited = lambda m: F.element_at("methods", m)["source"].isin("gift_card", "certificate")
    unpaid = F.get(F.filter(F.transform("pay", lambda p: F.when(~F.map_contains_key("methods", p["method"]), F.concat(F.lit("Error: payment method "), p["method"], F.lit(" not found")))
                                          .when(limited(p["method"]) & (F.element_at("methods", p["method"])["balance"] < p["amount"]), F.concat(F.lit("Error: not enough balance in payment method "), p["method"]))), lambda x: x.isNotNull()), F.lit(0))
    paid = F.aggregate("pay", F.lit(0.0), lambda a, p: a + p["amount"])
    r = r.withColumn("total", total).withColumn("error", guard((F.col("__u").isNull(), "user"), (F.col("__bad").isNotNull(), F.col("__bad.m")), (unpaid.isNotNull(), unpaid),
                                                              (F.round(paid, 2) != F.col("total"), F.concat(F.lit("Error: payment amount does not add up, total price is "), F.col("total").cast("string"), F.lit(", but paid "), paid.cast("string")))))
    spent = lambda k: F.aggregate(F.filter("pay", lambda p: p["method"] == k), F.lit(0.0), lambda a, p: a + p["amount"])
    left = F.map_filter("methods", lambda k, v: ~((v["source"] == "certificate") & F.exists("pay", lambda p: p["method"] == k)))
    left = F.transform_values(left, lambda k, v: F.struct(v["source"].alias("source"), F.when(v["source"] == "gift_card", v["balance"] - spent(k)).otherwise(v["balance"]).alias("balance")))
    return r.select("request_id", "user_id", "error", F.when(F.col("error").isNull(), F.col("total")).alias("total"), F.when(F.col("error").isNull(), left).otherwise(F.col("methods")).alias("methods"))


def cancel_reservations(requests: DataFrame, reservations: DataFrame) -> DataFrame:
    """requests(reservation_id): payments with each negated, status cancelled; no balance changes."""
    d = reservations.select(F.col("reservation_id").alias("__k"), "payments")
    r = requests.join(d, requests["reservation_id"] == F.col("__k"), "left").withColumn("error", guard((F.col("__k").isNull(), "reservation")))
    back = F.transform("payments", lambda p: F.struct(p["method"].alias("method"), (-p["amount"]).alias("amount")))
    return r.select("reservation_id", "error", F.when(F.col("error").isNull(), F.concat("payments", back)).alias("payments"), F.when(F.col("error").isNull(), "cancelled").alias("status"))


def _payable(method: str, amount: Column) -> list[tuple[Column, str]]:
    m = F.element_at("methods", F.col(method))
    return [(~F.map_contains_key("methods", F.col(method)), "payment"), (m["source"] == "certificate", "certificate"), ((m["source"] == "gift_card") & (m["balance"] < amount), "gift_balance")]


def change_bags(requests: DataFrame, reservations: DataFrame, users: DataFrame) -> DataFrame:
    """requests(reservation_id, total_bags, nonfree_bags, method): 50 for each further bag that isn't free."""
    d = reservations.select(F.col("reservation_id").alias("__k"), "user_id", F.col("nonfree_bags").alias("__had"), "payments")
    r = with_methods(requests.join(d, requests["reservation_id"] == F.col("__k"), "left"), users)
    price = 50 * F.greatest(F.lit(0), F.col("nonfree_bags") - F.col("__had"))
    r = r.withColumn("price", price).withColumn("error", guard((F.col("__k").isNull(), "reservation"), *_payable("method", F.col("price"))))
    added = F.when(F.col("price") != 0, F.array(F.struct(F.col("method").alias("method"), F.col("price").cast("double").alias("amount")))).otherwise(F.array().cast("array<struct<method:string,amount:double>>"))
    return r.select("reservation_id", "error", F.when(F.col("error").isNull(), F.concat("payments", added)).otherwise(F.col("payments")).alias("payments"), F.when(F.col("error").isNull(), F.col("nonfree_bags")).otherwise(F.col("__had")).alias("nonfree_bags"))


def change_legs(requests: DataFrame, reservations: DataFrame, users: DataFrame, flights: DataFrame) -> DataFrame:
    """requests(reservation_id, cabin, legs, method): a leg of the old reservation keeps its price if the cabin stays; error and
    what is to pay beyond the old price. reservations.legs: array<struct<flight,date,price>>."""
    d = reservations.select(F.col("reservation_id").alias("__k"), "user_id", F.col("cabin").alias("__cabin"), F.col("legs").alias("__legs"), "n_passengers")
    r = with_methods(requests.join(d, requests["reservation_id"] == F.col("__k"), "left"), users)
    leg = r.select("reservation_id", "cabin", "__cabin", "__legs", "n_passengers", F.posexplode("legs").alias("i", "leg")).select("*", "leg.flight", "leg.date")
    kept = F.get(F.filter("__legs", lambda x: (x["flight"] == F.col("flight")) & (x["date"] == F.col("date")) & (F.col("cabin") == F.col("__cabin"))), F.lit(0))["price"]
    known = flights.select(F.col("flight").alias("__f")).distinct()
    leg = leg.withColumn("kept", kept).join(known, F.col("flight") == F.col("__f"), "left").join(flights, ["flight", "date"], "left")
    no = F.col("flight").cast("string")
    bad = F.when(F.col("kept").isNotNull(), F.lit(None).cast("string")).when(F.col("__f").isNull(), F.concat(F.lit("Error: flight "), no, F.lit(" not found"))).when(F.col("status").isNull(), F.concat(F.lit("Error: flight "), no, F.lit(" not found on date "), F.col("date").cast("string")))
    bad = bad.when(F.col("status") != "available", F.concat(F.lit("Error: flight "), no, F.lit(" not available on date "), F.col("date").cast("string"))).when(F.element_at("seats", F.col("cabin")) < F.col("n_passengers"), F.concat(F.lit("Error: not enough seats on flight "), no))
    price = F.coalesce("kept", F.element_at("prices", F.col("cabin")))
    legs = leg.groupBy("reservation_id").agg(F.min(F.when(bad.isNotNull(), F.struct("i", bad.alias("m")))).alias("__bad"), F.sum(price).alias("__price"))
    r = r.join(legs, "reservation_id", "left")
    due = F.round(F.col("n_passengers") * (F.col("__price") - F.aggregate("__legs", F.lit(0.0), lambda a, x: a + x["price"])), 2)
    r = r.withColumn("due", due).withColumn("error", guard((F.col("__k").isNull(), "reservation"), (F.col("__bad").isNotNull(), F.col("__bad.m")), *_payable("method", F.col("due"))))
    return r.select("reservation_id", "error", F.when(F.col("error").isNull(), F.col("due")).alias("due"))


def change_passengers(requests: DataFrame, reservations: DataFrame) -> DataFrame:
    d = reservations.select(F.col("reservation_id").alias("__k"), F.col("passengers").alias("__p"))
    r = requests.join(d, requests["reservation_id"] == F.col("__k"), "left").withColumn("error", guard((F.col("__k").isNull(), "reservation"), (F.size("passengers") != F.size("__p"), "passengers")))
    return r.select("reservation_id", "error", F.when(F.col("error").isNull(), F.col("passengers")).otherwise(F.col("__p")).alias("passengers"))


def send_certificates(requests: DataFrame, users: DataFrame, ids: list[str]) -> DataFrame:
    """requests(user_id, amount): the user's methods with a certificate under the first free id; no free id: no answer."""
    r = with_methods(requests, users)
    free = F.get(F.filter(F.array(*map(F.lit, ids)), lambda i: ~F.map_contains_key("methods", i)), F.lit(0))
    r = r.withColumn("id", free).withColumn("error", guard((F.col("__u").isNull(), "user")))
    new = F.map_concat("methods", F.create_map(F.coalesce("id", F.lit("")), F.struct(F.lit("certificate").alias("source"), F.col("amount").cast("double").alias("balance"))))
    return r.select("user_id", "error", F.when(F.col("error").isNull(), F.col("id")).alias("id"), F.when(F.col("error").isNull() & F.col("id").isNotNull(), new).otherwise(F.col("methods")).alias("methods"))


#: Digits of a row's digest in each of the three sums.
_DIGITS = 12


def fingerprint_parts(table: DataFrame) -> DataFrame:
    """(n, a, b, c) of a table's content, one row: the number of its rows and the sums of three parts of their digests, whatever
    their order. No task sees all rows, and parts of tables can be added up or taken away."""
    h = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring("h", 1 + _DIGITS * i, _DIGITS), 16, 10).cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)")
    return table.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), part(0).alias("a"), part(1).alias("b"), part(2).alias("c"))


def parts_changed(parts: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The parts of a table from which the rows `removed` went and to which `added` came, repeated rows as often as they stand there.
    Only those rows are read; both have the table's columns."""
    out, into = (fingerprint_parts(x.select(*sorted(x.columns))) for x in (removed, added))
    signed = lambda df, sign: df.select(*[(F.col(x) * sign).cast("decimal(38,0)").alias(x) for x in ("n", "a", "b", "c")])
    every = signed(parts, 1).unionByName(signed(out, -1)).unionByName(signed(into, 1))
    return every.agg(F.sum("n").cast("long").alias("n"), *[F.sum(x).alias(x) for x in ("a", "b", "c")])


def digest_of(parts: DataFrame) -> DataFrame:
    return parts.select("n", F.sha2(F.concat_ws("/", *[F.col(x).cast("string") for x in ("n", "a", "b", "c")]), 256).alias("digest"))


def fingerprint(table: DataFrame) -> DataFrame:
    """(n, digest) of a table's content, whatever the order of its rows: equal tables have equal fingerprints."""
    return digest_of(fingerprint_parts(table))


def outputs_found(outputs: Column, texts: Column) -> Column:
    """Every output stands in some text; case and the texts' commas don't count."""
    return F.forall(outputs, lambda o: F.exists(texts, lambda t: F.contains(F.replace(F.lower(t), F.lit(","), F.lit("")), F.lower(o))))


def in_order(calls: DataFrame, key: str, seq: str) -> DataFrame:
    """calls with `round`: the nth call of each document goes to round n, so that a round holds one call a document."""
    return calls.withColumn("round", F.row_number().over(Window.partitionBy(key).orderBy(seq)).cast("long"))


#: Tools whose answer doesn't depend on data (fixed values): name, answer, whether the episode ends.
CONSTANT = (("think", "", False), ("transfer_to_human_agents", "Transfer successful", True))


def constant_tools(calls: DataFrame, tool: str) -> DataFrame:
    """calls with `answer` and `ends`."""
    name, answer, ends = F.col(tool), F.lit("Error: unknown tool"), F.lit(False)
    for n, a, e in CONSTANT:
        answer, ends = F.when(name == n, a).otherwise(answer), F.when(name == n, e).otherwise(ends)
    return calls.withColumns({"answer": answer, "ends": ends})


class Tools:
    """A registry of tools by name: invoke gives a tool's result, or the error of an unknown name."""

    def __init__(self):
        self.tools: dict[str, tuple[Callable[..., DataFrame], dict]] = {}

    def add(self, name: str, tool: Callable[..., DataFrame], **info) -> None:
        self.tools[name] = (tool, info)

    def info(self) -> list[dict]:
        return [{"name": n, **i} for n, (_, i) in sorted(self.tools.items())]

    def invoke(self, name: str, *args, **kwargs) -> DataFrame:
        if name not in self.tools:
            raise KeyError(f"unknown tool {name}")
        return self.tools[name][0](*args, **kwargs)
