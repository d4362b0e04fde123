"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document. The ledger is a written table of the measurements and one long of failure bits;
policies are named, versioned masks over these bits, so a new policy or an ablation reads the ledger, not the texts. Ablations
count documents per distinct mask and work on those counts by bitwise operations.

Words covered by repeated 3-word windows are found within a row: each window is sorted by its full hash, its words and
its position, so equal windows are always neighbours, and neighbours with equal words are repeats. So the work is n log n in
a document's length, and no document's windows leave its row. That is one path for every length.

Defined cases: a null or wordless text has zero in every count and fails the base; equal rows get equal results; texts of
any length are read whole; no rows give no rows; further columns, of whatever names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, table, written

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
UPPERCASE = r"\p{Lu}"
SHOUT = r"!!"

#: Rules by bit. A rule says when a document fails; the bits stay as they are from version to version.
RULES: list[tuple[str, str]] = [
    ("short", "n_words < 50"),
    ("repeats", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
    ("dup_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("capitals", "100 * n_upper > 40 * word_chars"),
    ("shouting", "10 * n_shouts > n_words"),
]
BASE = 0b0000011
#: Policies: version -> mask of the rules that reject.
POLICIES = {"v1-base": BASE, "v2-symbols": 0b0000111, "v3-all": 0b1111111}
POLICY = "v3-all"


def _neighbours() -> tuple:
    """The position that an entry of the column s holds, and whether two entries hold equal windows."""
    at = lambda j: F.get("s", j)["i"]

    def equal(i: Column, j: Column) -> Column:
        word = lambda k: F.get("s", i)[k] == F.get("s", j)[k]
        return word("a") & word("b") & word("c")

    return at, equal


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and the measurements of each row."""
    t, count = F.col("t"), lambda p: F.regexp_count("t", F.lit(p)).cast("long")
    rows = bare(docs, id_col, text).toDF("id", "t").select("id", F.coalesce("t", F.lit("")).alias("t"))
    rows = rows.select("id", "t", F.array_remove(F.split("t", SPACE + "+", -1), "").alias("w"), F.filter(F.split("t", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"))
    at, equal = _neighbours()
    windows = lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), F.get("w", i).alias("a"), F.get("w", i + 1).alias("b"), F.get("w", i + 2).alias("c"), i.alias("i"))
    starts = F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("s", F.sort_array(F.transform(starts, windows)))
    both = F.when(F.size("s") >= 2, F.sequence(F.lit(0), F.size("s") - 1)).otherwise(F.array().cast("array<int>"))
    again = F.filter(both, lambda j: ((j > 0) & equal(j, j - 1)) | ((j < F.size("s") - 1) & equal(j, j + 1)))
    rows = rows.withColumn("r", F.sort_array(F.transform(again, at)))
    covered = F.aggregate(F.transform("r", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("r", k + 1), p + 3) - p)), F.lit(0), lambda a, x: a + x)
    return rows.select(
        "id", F.size("w").cast("long").alias("n_words"), (F.length(t) - F.regexp_count("t", F.lit(SPACE))).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), count(UPPERCASE).alias("n_upper"), count(SHOUT).alias("n_shouts"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """The measurements and the column `fails`, in which bit k is set if the k-th rule fails."""
    fails = F.lit(0).cast("long")
    for k, (_, rule) in enumerate(rules):
        fails = fails.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, id_col, text).withColumn("fails", fails)


def passes(mask: int) -> Column:
    return F.col("fails").bitwiseAND(F.lit(mask).cast("long")) == 0


def ablations(entries: DataFrame, policies: dict[str, int] = POLICIES, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(policy, rule, n_failed, n_only): under each policy, documents that fail the rule, and those that only it rejects."""
    spark = entries.sparkSession
    masks = entries.groupBy("fails").agg(F.count(F.lit(1)).alias("n"))  # at most 2 ** len(rules) rows
    plan = spark.createDataFrame([(p, m, name, 1 << k) for p, m in policies.items() for k, (name, _) in enumerate(rules) if m >> k & 1], "policy string, mask long, rule string, bit long")
    hit = F.col("fails").bitwiseAND(F.col("bit")) != 0
    only = F.col("fails").bitwiseAND(F.col("mask")) == F.col("bit")
    some = masks.join(F.broadcast(plan), hit)  # the plan has len(policies) * len(rules) rows
    got = some.groupBy("policy", "rule").agg(F.sum("n").alias("n_failed"), F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_only"))
    return plan.select("policy", "rule").join(got, ["policy", "rule"], "left").na.fill(0, ["n_failed", "n_only"])


def stored(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger as a table in the shared folder."""
    return written(spark, ledger(docs, id_col, text), "quality-ledger")


def judged(entries: DataFrame, version: str = POLICY) -> DataFrame:
    """The ledger with the policy's version and its verdict; the base rules reject under every policy."""
    return entries.select("*", F.lit(version).alias("policy"), (~passes(BASE)).alias("base_failed"), passes(POLICIES[version] | BASE).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judged(stored(spark, table(spark, sf_dir, "documents")))
    return got.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fails", "policy")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under each policy, documents that each of its rules fails, and those that only this rule rejects."""
    return ablations(stored(spark, table(spark, sf_dir, "documents")))


_FAILED = " OR ".join(f"({rule})" for _, rule in RULES)
QUERIES = {"op8_quality_rules": op8_quality_rules, "quality_ablations": quality_ablations}
_FAILS = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(RULES))
_MEASURED = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS st FROM d WHERE len(w) >= 3),
x AS (SELECT rid, st, list_slice(w, st, st + 2) AS tri FROM g),
r AS (SELECT rid, st, count(*) OVER (PARTITION BY rid, tri) AS n FROM x),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([st, st + 1, st + 2]) AS p FROM r WHERE n >= 2) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '!!')) AS n_shouts
      FROM d LEFT JOIN c USING (rid))
"""
_PLAN = ", ".join(f"('{p}', '{name}', {m}, {1 << k})" for p, m in POLICIES.items() for k, (name, _) in enumerate(RULES) if m >> k & 1)
SQL = {
    "op8_quality_rules": f"""{_MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT ({_FAILED}) AS kept,
       CAST({_FAILS} AS BIGINT) AS fails, '{POLICY}' AS policy FROM m
""",
    "quality_ablations": f"""{_MEASURED}, f AS (SELECT CAST({_FAILS} AS BIGINT) AS fails FROM m)
SELECT p.policy, p.rule, CAST(count(*) FILTER (WHERE fails & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (WHERE fails & mask = bit) AS BIGINT) AS n_only
FROM (VALUES {_PLAN}) p(policy, rule, mask, bit) LEFT JOIN f ON true GROUP BY ALL
""",
}
