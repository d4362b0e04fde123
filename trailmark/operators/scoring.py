"""Scores of predictions against what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import action_name, normalize_answer


def hit(action: str, candidates: str, k: int, sparse: bool = False) -> Column:
    """k = 1: the first candidate; any other k: any candidate. sparse: compare the kinds of action only, two without a kind are equal."""
    if sparse:
        same = lambda x: action_name(x).eqNullSafe(action_name(F.col(action)))
    else:
        same = lambda x: F.lower(x) == F.lower(F.col(action))
    if k == 1:
        return F.coalesce(F.when(F.size(candidates) > 0, same(F.get(candidates, F.lit(0)))), F.lit(False)).cast("int")
    return F.coalesce(F.exists(candidates, same), F.lit(False)).cast("int")


def action_metrics(pairs: DataFrame, sample: str, pos: str, action: str, candidates: str, k: int, sparse: bool = False) -> DataFrame:
    """(sample, action, accuracy): of all pairs but the first as `general`, and of each kind of action."""
    p = pairs.where(F.col(pos) > 0).select(F.col(sample).alias("sample"), action_name(F.col(action)).alias("kind"), hit(action, candidates, k, sparse).alias("h"))
    both = p.select("sample", F.explode(F.array_compact(F.array(F.lit("general"), "kind"))).alias("action"), "h")
    return both.groupBy("sample", "action").agg(F.avg("h").alias("accuracy"))


def over_samples(metrics: DataFrame, samples: DataFrame, missing_as_zero: bool = True) -> DataFrame:
    """Mean of each action over all samples (sample); one without the action, or without any scored pair, counts as 0."""
    if not missing_as_zero:
        return metrics.groupBy("action").agg(F.avg("accuracy").alias("accuracy"))
    n = samples.agg(F.count_distinct("sample").alias("n"))  # one row
    return metrics.groupBy("action").agg(F.sum("accuracy").alias("s")).crossJoin(F.broadcast(n)).select("action", (F.col("s") / F.col("n")).alias("accuracy"))


def pass_hat(trials: DataFrame, task: str, trial: str, success: Column, reward: Column | None = None) -> DataFrame:
    """(k, pass_hat, avg_reward): the mean over tasks of C(c, k) / C(n, k), n being the number of trials of the whole run, and
    the mean reward. Tasks are counted by c first, so the products are made once for each c, not for each task."""
    each = trials.select(F.col(task).alias("task"), F.col(trial).alias("trial"), success.cast("int").alias("ok"), (success.cast("double") if reward is None else reward.cast("double")).alias("reward"))
    run = each.agg(F.count_distinct("trial").alias("n"), F.avg("reward").alias("avg_reward"))  # one row
    by_c = each.groupBy("task").agg(F.sum("ok").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("tasks"))
    t = by_c.crossJoin(F.broadcast(run)).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    ratio = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), F.lit(1.0), lambda a, i: a * F.greatest(F.col("c") - i, F.lit(0)) / (F.col("n") - i))
    return t.groupBy("k").agg((F.sum(ratio * F.col("tasks")) / F.sum("tasks")).alias("pass_hat"), F.first("avg_reward").alias("avg_reward"))


def common_tokens(p: Column, g: Column) -> Column:
    """How many elements two arrays have in common, as multisets: both are sorted together and read once."""
    both = F.array_sort(F.concat(F.transform(p, lambda x: F.struct(x.alias("x"), F.lit(0).alias("of"))), F.transform(g, lambda x: F.struct(x.alias("x"), F.lit(1).alias("of")))))
    state = lambda x, a, b, c: F.struct(x.alias("x"), a.alias("a"), b.alias("b"), c.alias("c"))

    def step(s: Column, e: Column) -> Column:
        same = s["x"] == e["x"]
        a0, b0 = F.when(same, s["a"]).otherwise(0), F.when(same, s["b"]).otherwise(0)
        a, b = a0 + (1 - e["of"]), b0 + e["of"]
        return state(e["x"], a, b, s["c"] + F.least(a, b) - F.least(a0, b0))

    zero = F.lit(0)
    return F.aggregate(both, state(F.lit(""), zero, zero, zero), step, lambda s: s["c"])


def token_f1(pairs: DataFrame, key: str, pred: str, truth: str) -> DataFrame:
    """(key, f1, precision, recall) by common tokens after normalization, as multisets; yes, no and noanswer only equal
    themselves. All of it within the row."""
    tokens = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    s = pairs.select(F.col(key).alias("key"), normalize_answer(F.col(pred)).alias("p"), normalize_answer(F.col(truth)).alias("g"))
    short = F.array(F.lit("yes"), F.lit("no"), F.lit("noanswer"))
    bare = (F.array_contains(short, F.col("p")) | F.array_contains(short, F.col("g"))) & (F.col("p") != F.col("g"))
    s = s.select("key", bare.alias("bare"), tokens(F.col("p")).alias("pt"), tokens(F.col("g")).alias("gt"))
    s = s.select("key", F.size("pt").alias("np"), F.size("gt").alias("ng"), F.when(F.col("bare"), 0).otherwise(F.coalesce(common_tokens(F.col("pt"), F.col("gt")), F.lit(0))).alias("c"))
    share = lambda a, b: F.when(F.col("c") > 0, a / b).otherwise(0.0)
    c, n, m = F.col("c"), F.col("np"), F.col("ng")
    return s.select("key", share(2 * c, n + m).alias("f1"), share(c, n).alias("precision"), share(c, m).alias("recall"))


def majority(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The most frequent value of each key; of equals the one seen first."""
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    return c.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", F.col(value).alias("v"))).alias("x")).select(*keys, F.col("x.v").alias(value), (-F.col("x.m")).alias("votes"))


def unanimous(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.count_distinct(value) == 1).alias("unanimous"), F.min(value).alias("value"))


def jury_share(votes: DataFrame, vote: str, options: list[str], keys: list[str]) -> DataFrame:
    """Share of valid votes of each option; the first option that a vote contains counts; without valid votes all are 0."""
    spark = votes.sparkSession
    domain = F.broadcast(spark.createDataFrame([(o,) for o in options], "option string"))  # one row an option
    chosen = F.coalesce(*[F.when(F.contains(F.lower(F.col(vote)), F.lit(o.lower())), o) for o in options])
    c = votes.select(*keys, chosen.alias("option")).where("option is not null").groupBy(*keys, "option").agg(F.count(F.lit(1)).alias("n"))
    full = votes.select(*keys).distinct().crossJoin(domain).join(c, [*keys, "option"], "left") if keys else domain.join(c, "option", "left")
    w = Window.partitionBy(*keys)
    total = F.sum(F.coalesce("n", F.lit(0))).over(w)
    return full.select(*keys, "option", F.when(total > 0, F.coalesce("n", F.lit(0)) / total).otherwise(0.0).alias("share"))


def sampled(samples: DataFrame, keys: list[str], value: str, error: str, attempt: str, strategy: str) -> DataFrame:
    """The answer that a sampling strategy takes from recorded attempts: single, retry, majority or unanimous."""
    ok = samples.where(F.col(error).isNull())
    if strategy == "single":
        return samples.where(F.col(attempt) == 0).where(F.col(error).isNull()).select(*keys, value)
    if strategy in ("retry", "redundant"):
        return ok.groupBy(*keys).agg(F.min(F.struct(attempt, value)).alias("x")).select(*keys, f"x.{value}")
    if strategy in ("majority", "ensemble"):
        return majority(ok, keys, value, [attempt]).select(*keys, value)
    if strategy == "unanimous":
        return ok.groupBy(*keys).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").select(*keys, value)
    raise ValueError(strategy)


def distribution(df: DataFrame, category: str, domain: list[str]) -> DataFrame:
    """Count and percent of every category of the domain, those without rows too."""
    d = F.broadcast(df.sparkSession.createDataFrame([(x,) for x in domain], f"{category} string"))  # one row a category
    c = d.join(df.groupBy(category).agg(F.count(F.lit(1)).alias("n")), category, "left").select(category, F.coalesce("n", F.lit(0)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select(category, "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("percent"))
