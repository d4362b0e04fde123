"""Observation logs, votes, auctions and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept


def fan_out(messages: DataFrame, players: DataFrame, game: str, to: str) -> DataFrame:
    """A message to -1 goes to every player of its game."""
    return messages.join(players, game).where((F.col(to) == -1) | (F.col(to) == F.col("player")))


def drained(messages: DataFrame, game: str, seq: str, read: Column) -> DataFrame:
    """messages with the number of the read that takes them: the next read at or after them."""
    w = Window.partitionBy(game).orderBy(seq)
    nth = F.sum(F.when(read, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return messages.withColumn("read_no", F.coalesce(nth, F.lit(0)))


def first_and_last(messages: DataFrame, game: str, seq: str, text: str) -> DataFrame:
    return messages.groupBy(game).agg(F.min(F.struct(seq, text)).alias("a"), F.max(F.struct(seq, text)).alias("b")).select(game, F.col(f"a.{text}").alias("first"), F.col(f"b.{text}").alias("last"))


def prompt_and_board(messages: DataFrame, game: str, seq: str, kind: str, text: str, last_prompt: bool = False) -> DataFrame:
    x = F.struct(seq, text)
    prompt = F.when(F.col(kind) == "PROMPT", x)
    return messages.groupBy(game).agg((F.max(prompt) if last_prompt else F.min(prompt)).alias("p"), F.max(F.when(F.col(kind) == "BOARD", x)).alias("b")).select(game, F.col(f"p.{text}").alias("prompt"), F.col(f"b.{text}").alias("board"))


def last_board_only(messages: DataFrame, game: str, seq: str, kind: str) -> DataFrame:
    last = F.max(F.when(F.col(kind) == "BOARD", F.col(seq))).over(Window.partitionBy(game))
    return messages.withColumn("__last", last).where((F.col(kind) != "BOARD") | (F.col(seq) == F.col("__last"))).drop("__last")


def history(messages: DataFrame, game: str, seq: str, line: Column) -> DataFrame:
    """All lines of a game in order, one text a game."""
    return messages.groupBy(game).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), line.alias("x")))).alias("a")).select(game, F.array_join(F.transform("a", lambda x: x["x"]), "\n").alias("history"))


def auction(bids: DataFrame, item: str, bidder: str, bid: str) -> DataFrame:
    """Per item the unique highest bid above 0; a tie at the top sells to nobody."""
    top = bids.groupBy(item).agg(F.max(bid).alias("top"))
    w = bids.join(top, item).where((F.col(bid) == F.col("top")) & (F.col("top") > 0))
    return w.groupBy(item, "top").agg(F.count(F.lit(1)).alias("n"), F.min(bidder).alias("winner")).where("n = 1").select(item, "winner", F.col("top").alias("price"))


def argmax_or_draw(scores: DataFrame, keys: list[str], player: str, score: str) -> DataFrame:
    """The player with the highest score, null if it is shared."""
    top = scores.groupBy(*keys).agg(F.max(score).alias("top"))
    w = scores.join(top, keys).where(F.col(score) == F.col("top"))
    return w.groupBy(*keys, "top").agg(F.count(F.lit(1)).alias("n"), F.min(player).alias("p")).select(*keys, "top", F.when(F.col("n") == 1, F.col("p")).alias("winner"))


def rank_rewards(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """-1 to 1 by distinct rank; all 0 if there is one rank only."""
    w = Window.partitionBy(*keys)
    r = scores.withColumn("__r", F.dense_rank().over(w.orderBy(score)))
    n = F.max("__r").over(w)
    return r.withColumn("__n", n).select(*scores.columns, F.when(F.col("__n") > 1, -1 + 2 * (F.col("__r") - 1) / (F.col("__n") - 1)).otherwise(0.0).alias("reward"))


def carry_over(rounds: DataFrame, game: str, order: str, prize: str, won: Column) -> DataFrame:
    """What each won round pays: its prize and those of the undecided rounds before it."""
    w = Window.partitionBy(game).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    r = rounds.withColumn("__won", won).withColumn("__island", F.coalesce(F.sum(F.when(won, 1).otherwise(0)).over(w), F.lit(0)))
    g = r.groupBy(game, "__island").agg(F.sum(prize).alias("pot"), F.max(F.when(F.col("__won"), F.col(order))).alias(order)).where(F.col(order).isNotNull())
    return g.select(game, order, "pot")


def public_goods(moves: DataFrame, keys: list[str], given: str, endowment: float, factor: float) -> DataFrame:
    w = Window.partitionBy(*keys)
    share = factor * F.sum(given).over(w) / F.count(F.lit(1)).over(w)
    return moves.withColumn("payoff", endowment - F.col(given) + share)


def market_entry(moves: DataFrame, keys: list[str], enters: Column, capacity: int, win: float, lose: float, out: float) -> DataFrame:
    n = F.sum(F.when(enters, 1).otherwise(0)).over(Window.partitionBy(*keys))
    return moves.withColumn("entrants", n).withColumn("payoff", F.when(~enters, out).when(F.col("entrants") <= capacity, win).otherwise(lose))


def plurality(votes: DataFrame, keys: list[str], vote: str, seed: int) -> DataFrame:
    """The option with most votes; ties by a hash of seed and option."""
    c = votes.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.md5(F.concat(F.lit(f"{seed}/"), F.col(vote).cast("string"))).alias("h"), F.col(vote).alias("v"))).alias("x")).select(*keys, F.col("x.v").alias("chosen"))


def quorum(votes: DataFrame, keys: list[str], accepts: Column, veto: Column, required: int | None = None) -> DataFrame:
    """Passed if all with a veto accept and n - 1 do (or `required`); without a veto role a simple majority decides."""
    g = votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(accepts).alias("yes"), F.bool_and(F.when(veto, accepts).otherwise(True)).alias("no_veto"), F.bool_or(veto).alias("has_veto"))
    need = F.lit(required) if required is not None else F.col("n") - 1
    return g.select(*keys, F.when(F.col("has_veto"), F.col("no_veto") & (F.col("yes") >= need)).otherwise(2 * F.col("yes") > F.col("n")).alias("passed"), "yes", "n")


def deal_scores(chosen: DataFrame, keys: list[str], player: str, score: str, most: Column, threshold: Column, unanimous: Column) -> DataFrame:
    """Sum of the options' scores, 10 more if all agreed; the reward is 0 below the threshold, else 0 to 100 without fraction."""
    g = chosen.groupBy(*keys, player).agg(F.sum(score).alias("total"), F.max(most).alias("most"), F.max(threshold).alias("threshold"), F.bool_and(unanimous).alias("all"))
    total = F.col("total") + F.when(F.col("all"), 10).otherwise(0)
    return g.select(*keys, player, total.alias("total"), F.when(total >= F.col("threshold"), F.floor(F.least(F.lit(1.0), total / F.col("most")) * 100)).otherwise(0).alias("reward"))


def field_majority(fields: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Fields won by each side; a side with more than half of all has won early."""
    g = fields.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) > F.col(b)).alias("a_wins"), F.count_if(F.col(b) > F.col(a)).alias("b_wins"))
    need = F.floor(F.col("n") / 2) + 1
    return g.select(*keys, "a_wins", "b_wins", F.when(F.col("a_wins") >= need, "a").when(F.col("b_wins") >= need, "b").alias("early"), F.when(F.col("a_wins") > F.col("b_wins"), "a").when(F.col("b_wins") > F.col("a_wins"), "b").alias("winner"))


def two_thirds(guesses: DataFrame, keys: list[str], player: str, guess: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    g = guesses.withColumn("target", F.avg(guess).over(w) * 2 / 3)
    return g.groupBy(*keys).agg(F.min(F.struct(F.round(F.abs(F.col(guess) - F.col("target")), 9).alias("d"), F.col(player).alias("p"))).alias("x"), F.round(F.max("target"), 6).alias("target")).select(*keys, "target", F.col("x.p").alias("winner"))


def trick(cards: DataFrame, keys: list[str], player: str, suit: str, power: str, trump: str, lead: str) -> DataFrame:
    """The highest trump, else the highest card of the suit that was led."""
    best = F.max(F.struct((F.col(suit) == F.col(trump)).alias("t"), (F.col(suit) == F.col(lead)).alias("l"), F.col(power).alias("p"), F.col(player).alias("who")))
    return cards.groupBy(*keys).agg(best.alias("x")).select(*keys, F.col("x.who").alias("winner"))


def golf(cards: DataFrame, keys: list[str], column: str, value: str) -> DataFrame:
    """Sum of the cards; a column of equal cards counts 0."""
    c = cards.groupBy(*keys, column).agg(F.when((F.min(value) == F.max(value)) & (F.count(F.lit(1)) > 1), 0).otherwise(F.sum(value)).alias("s"))
    return c.groupBy(*keys).agg(F.sum("s").alias("score"))


RANKS = ("high card", "pair", "two pair", "three", "straight", "flush", "full house", "four", "straight flush")


def poker(cards: DataFrame, keys: list[str], rank: str, suit: str) -> DataFrame:
    """(category, kickers) of the best five of each hand's cards; ranks 2 to 14, an ace also counts as 1 in a straight.

    Counts by rank, the longest run of ranks and the fullest suit decide; no subset of cards is enumerated.
    """
    g = cards.groupBy(*keys).agg(F.collect_list(F.struct(F.col(rank).cast("int").alias("r"), F.col(suit).alias("s"))).alias("c"))  # a hand: seven cards

    def straight(ranks: Column) -> Column:
        have = lambda x: F.array_contains(ranks, x) | ((x == 1) & F.array_contains(ranks, 14))
        return F.array_max(F.filter(F.sequence(F.lit(5), F.lit(14)), lambda t: F.forall(F.sequence(t - 4, t), have)))

    ranks = F.array_distinct(F.transform("c", lambda x: x["r"]))
    suits = F.array_distinct(F.transform("c", lambda x: x["s"]))
    g = g.withColumn("ranks", ranks).withColumn("fs", F.get(F.filter(suits, lambda s: F.size(F.filter("c", lambda x: x["s"] == s)) >= 5), F.lit(0)))
    g = g.withColumn("fr", F.when(F.col("fs").isNotNull(), F.reverse(F.array_sort(F.transform(F.filter("c", lambda x: x["s"] == F.col("fs")), lambda x: x["r"])))))
    g = g.withColumn("by", F.reverse(F.array_sort(F.transform("ranks", lambda r: F.struct(F.size(F.filter("c", lambda x: x["r"] == r)).alias("n"), r.alias("r"))))))
    n = lambda i: F.coalesce(F.get("by", F.lit(i))["n"], F.lit(0))
    r = lambda i: F.get("by", F.lit(i))["r"]
    rest = lambda skip, k: F.slice(F.reverse(F.array_sort(F.array_except("ranks", skip))), 1, k)
    sf, st = straight(F.coalesce("fr", F.array().cast("array<int>"))), straight(F.col("ranks"))
    pair = F.array_max(F.transform(F.filter("by", lambda x: (x["n"] >= 2) & (x["r"] != r(0))), lambda x: x["r"]))
    none = F.array().cast("array<int>")
    made = lambda k, cards: F.struct(F.lit(k).alias("category"), cards.alias("kickers"))
    one, two = F.array(r(0)), F.array(r(0), r(1))
    best = (
        F.when(sf.isNotNull(), made(8, F.array(sf)))
        .when(n(0) == 4, made(7, F.concat(one, rest(one, 1))))
        .when((n(0) == 3) & (n(1) >= 2), made(6, F.array(r(0), pair)))
        .when(F.col("fr").isNotNull(), made(5, F.slice("fr", 1, 5)))
        .when(st.isNotNull(), made(4, F.array(st)))
        .when(n(0) == 3, made(3, F.concat(one, rest(one, 2))))
        .when((n(0) == 2) & (n(1) == 2), made(2, F.concat(two, rest(two, 1))))
        .when(n(0) == 2, made(1, F.concat(one, rest(one, 3))))
        .otherwise(made(0, rest(none, 5)))
    )
    return g.select(*keys, best.alias("x")).select(*keys, "x.*")


def neighbours(words: DataFrame, word: str) -> DataFrame:
    """(a, b): words that differ in one letter, met by wildcard keys."""
    w = words.select(F.col(word).alias("w")).distinct()
    keyed = w.select("w", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substring("w", F.lit(1), i - 1), F.lit("*"), F.substring("w", i + 1, F.length("w"))))).alias("key"))
    return keyed.alias("a").join(keyed.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.w") != F.col("b.w"))).select(F.col("a.w").alias("a"), F.col("b.w").alias("b")).distinct()


#: Rows of words last reached that one task takes on by a step.
FRONT = 50_000


def ladders(edges: DataFrame, start: DataFrame, least: int, most: int) -> DataFrame:
    """(source, target, hops, path): the shortest path, of equals the first by alphabet, to each word that lies between least and most
    steps from a source. A step is one join of the words last reached with their lists of neighbours, and a written table, so the
    plan of a step grows by one scan. Lists are dealt by source as they are, with the words reached before, and taken apart only
    there: what a step might reach, many times what it does reach, is neither shuffled nor joined."""
    links = kept(edges.groupBy("a").agg(F.collect_set("b").alias("next")))
    front = kept(start.select("source", F.col("source").alias("target"), F.lit(0).alias("hops"), F.array("source").alias("path")))
    seen, out = front.select("source", "target"), front.limit(0)
    for h in range(1, most + 1):
        tasks = max(int(front.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-front.count() // FRONT))
        on = front.join(links, front["target"] == links["a"]).select("source", "path", "next", F.lit(False).alias("known"))
        known = seen.select("source", F.lit(None).cast(front.schema["path"].dataType).alias("path"), F.array("target").alias("next"), F.lit(True).alias("known"))
        dealt = on.unionByName(known).repartition(tasks, "source").select("source", "path", "known", F.explode("next").alias("target"))
        new = dealt.groupBy("source", "target").agg(F.min("path").alias("path"), F.bool_or("known").alias("known")).where("not known")
        front = kept(new.select("source", "target", F.lit(h).alias("hops"), F.array_append("path", F.col("target")).alias("path")))
        seen = seen.unionByName(front.select("source", "target"))
        out = out.unionByName(front) if h >= max(least, 1) else out
    return out


#: Words last reached, with keys that are new, that one task takes on by a step; each key brings all of its words.
KEYED = 15_000


def word_ladders(words: DataFrame, word: str, least: int, most: int) -> DataFrame:
    """(source, target, hops, path) from every word, as `ladders` over `neighbours`. Words meet at wildcard keys here too, so a source takes
    a key's words up together, and only once: a key through which a word was reached has no word left that is new. A step thus
    makes about as many rows as keys hold what it reaches, not as many as that has neighbours. Of the words reached before, a key that is
    new to a source can hold only those of the last step. All words of a ladder are equally long, so paths are compared run together."""
    at = F.explode(F.sequence(F.lit(0), F.length("target") - 1)).alias("at")
    key = F.overlay("target", F.lit("*"), F.col("at") + 1, F.lit(1)).alias("key")
    w = kept(words.select(F.col(word).alias("target")).where("length(target) > 0").distinct())
    longest = w.agg(F.max(F.length("target"))).first()[0] or 1
    bits = range(-(-longest // 63))  # 63 places of a word in a number
    groups = kept(w.select("target", at).groupBy("at", key).agg(F.collect_list("target").alias("next")).where("size(next) > 1"))
    front = kept(w.select(F.col("target").alias("source"), "target", F.lit(0).alias("hops"), F.col("target").alias("path"), F.array(*[F.lit(0).cast("long") for _ in bits]).alias("met")))
    out = front.select("source", "target", "hops", F.array("path").alias("path")).limit(0)
    for h in range(1, most + 1):
        still = front.where(" + ".join(f"bit_count(met[{i}])" for i in bits) + " < length(target)")
        tasks = max(int(w.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-still.count() // KEYED))
        keys = still.select("source", "target", "path", "met", at).where("getbit(met[at div 63], cast(at % 63 AS int)) = 0").groupBy("source", "at", key).agg(F.min("path").alias("path"))
        on = keys.join(groups, ["at", "key"]).select("source", "path", "at", "next")
        known = still.select("source", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("at"), F.array("target").alias("next"))
        dealt = on.unionByName(known).repartition(tasks, "source").select("source", "path", "at", F.explode("next").alias("target"))
        met = [F.bit_or(F.expr(f"CASE WHEN at div 63 = {i} THEN shiftleft(1L, cast(at % 63 AS int)) ELSE 0L END")).alias(f"met{i}") for i in bits]
        new = dealt.groupBy("source", "target").agg(F.min("path").alias("path"), F.bool_or(F.col("at").isNull()).alias("known"), *met).where("not known")
        front = kept(new.select("source", "target", F.lit(h).alias("hops"), F.concat("path", "target").alias("path"), F.array(*[f"met{i}" for i in bits]).alias("met")))
        if h >= least:
            path = F.array(*[F.substring("path", i * F.length("target") + 1, F.length("target")) for i in range(h + 1)])
            out = out.unionByName(front.select("source", "target", "hops", path.alias("path")))
    return out


def reached(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(source, node, hops): nodes within some hops, by their least number; one join a hop."""
    seen = start.select(F.col("source"), F.col("source").alias("node"), F.lit(0).alias("hops"))
    front = seen
    for h in range(1, hops + 1):
        new = front.join(edges, front["node"] == edges["a"]).select("source", F.col("b").alias("node")).distinct().join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(h))
        seen, front = seen.unionByName(new), new
    return seen
