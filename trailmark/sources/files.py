"""Readers of logs in files. All take a Spark path or glob, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A recorded step: scalars, and one array entry a guess.
STEP = "current_move string, guessed_moves array<string>, confidence_scores array<double>, time_taken_current_agent double, total_tokens_current_agent long, guess_prediction_time double, guess_total_tokens long"
#: A question's trajectory; actions are texts or lists of texts, and read as texts.
TRAJECTORY = "prompt string, observations array<string>, thoughts array<string>, actions array<string>, time_taken array<double>"
METRICS = "map<string,double>"


def json_map(spark: SparkSession, path: str, value: str, key: str = "step") -> DataFrame:
    """Files whose top level is a map: a row an entry, in the order of the numeric key."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"map<string,{value}>").alias("m"))
    rows = whole.select("file", F.explode("m").alias(key, "__v"))
    return rows.select("file", F.col(key).cast("int").alias(key), "__v.*") if value.startswith("struct") else rows.select("file", key, F.col("__v").alias("value"))


def steps(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark, path, f"struct<{', '.join(x.strip().replace(' ', ':', 1) for x in STEP.split(', '))}>")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def found(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files below a folder, at any depth, whose name fits."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")


def key_of_file(path: Column) -> Column:
    """The text after the file name's last _ and before its first dot."""
    return F.regexp_extract(path, r"_([^_./]+)\.[^/]*$", 1)


def folder_of(path: Column, up: int = 1) -> Column:
    return F.element_at(F.split(path, "/"), -1 - up)


def newest(files: DataFrame) -> DataFrame:
    """The file changed last in each folder; of equals the one that sorts last."""
    f = files.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    return f.groupBy("folder").agg(F.max(F.struct("modificationTime", "path")).alias("x")).select("folder", "x.path")


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """With the list-or-text actions as lists."""
    t = spark.read.json(path, TRAJECTORY, multiLine=True).select("*", F.col("_metadata.file_path").alias("file"))
    as_list = lambda a: F.coalesce(F.when(F.startswith(F.ltrim(a), F.lit("[")), F.from_json(a, "array<string>")), F.array(a))
    return t.withColumn("actions", F.transform("actions", as_list))


def metrics(spark: SparkSession, root: str, name: str = "metrics.json") -> DataFrame:
    """(agent_dir, guess_dir, sample, action, accuracy) of the metrics files below a folder."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("f"), F.explode(F.from_json("value", METRICS)).alias("action", "accuracy"))
    return rows.select(folder_of(F.col("f"), 3).alias("agent_dir"), folder_of(F.col("f"), 2).alias("guess_dir"), folder_of(F.col("f"), 1).alias("sample"), "action", "accuracy")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema)


def document_table(spark: SparkSession, path: str, doc: str, key: str) -> DataFrame:
    """A file that maps ids to documents, as a table with the id as a column."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<{doc}>>")).alias(key, "__d"))
    return whole.select(key, "__d.*") if key not in doc.split(":")[0] else whole.select("__d.*")


def optional(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame | None:
    """None if there is no such file, by the file system that Spark uses for the path."""
    from pyspark.errors import AnalysisException
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return spark.read.schema(schema).format(fmt).load(path)


def proc_stat(lines: DataFrame, text: str = "value") -> DataFrame:
    """(label, counters) of the cpu lines of a captured /proc/stat."""
    parts = F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda x: x != "")
    return lines.select(F.get(parts, F.lit(0)).alias("label"), F.transform(F.slice(parts, 2, 100), lambda x: x.try_cast("long")).alias("counters")).where(F.startswith("label", F.lit("cpu")))


def state_residency(captured: DataFrame, name: str, value: str, keys: list[str]) -> DataFrame:
    return captured.groupBy(*keys, name).agg(F.sum(value).alias(value))


def affix_rules(lines: DataFrame, text: str = "value") -> DataFrame:
    """(kind, flag, strip, add, condition) of the rule lines of an affix file."""
    r = r"^(PFX|SFX)\s+(\S+)\s+(\S+)\s+([^\s/]+)(?:/\S*)?\s+(\S+)"
    got = lines.select(*[F.regexp_extract(text, r, i).alias(n) for i, n in enumerate(("kind", "flag", "strip", "add", "condition"), 1)]).where("kind <> ''")
    zero = lambda c: F.when(F.col(c) == "0", "").otherwise(F.col(c)).alias(c)
    return got.select("kind", "flag", zero("strip"), zero("add"), "condition")


def affixes(lines: DataFrame, text: str = "value") -> DataFrame:
    """(kind, flag, merge, strip, add, condition) of an affix file. Whether suffixes may follow a prefix stands on the rule's own
    line (`SFX S Y 0 s .`) or on the header of its flag (`SFX S Y 4`)."""
    own = r"^(PFX|SFX)\s+(\S+)\s+(?:(Y|N)\s+)?(\S+)\s+([^\s/]+)(?:/\S*)?\s+(\S+)\s*$"
    t = F.trim(F.col(text))
    part = lambda n, i: F.regexp_extract(t, own, i).alias(n)
    rules = lines.select(part("kind", 1), part("flag", 2), part("own", 3), part("strip", 4), part("add", 5), part("condition", 6)).where("kind <> ''")
    head = r"^(PFX|SFX)\s+(\S+)\s+(Y|N)\s+\d+$"
    heads = lines.select(*[F.regexp_extract(t, head, i).alias(n) for i, n in ((1, "kind"), (2, "flag"), (3, "all"))]).where("kind <> ''").dropDuplicates(["kind", "flag"])
    zero = lambda c: F.when(F.col(c) == "0", "").otherwise(F.col(c)).alias(c)
    got = rules.join(heads, ["kind", "flag"], "left")
    return got.select("kind", "flag", (F.coalesce(F.when(F.col("own") != "", F.col("own")), "all", F.lit("N")) == "Y").alias("merge"), zero("strip"), zero("add"), "condition")


def _formed(words: DataFrame, rules: DataFrame, longest: int, merged: bool) -> DataFrame:
    """(form, flags, kind) that the rules make of words (w, flags). Words meet rules by flag and ending: a suffix rule's is what its
    condition asks for or what it strips, whichever is longer, so no pattern is tried on a pair. Of an excluding list the last
    letter may be none; behind a prefix the list counts as a whole, which is how the source of this table applies it."""
    ends = F.transform(F.sequence(F.lit(0), F.least(F.length("w"), F.lit(longest))), lambda n: F.when(n == 0, "").otherwise(F.substring("w", -n, n)))
    each = words.withColumn("ending", F.explode(ends)).withColumn("flag", F.explode(F.array_distinct(F.filter(F.split("flags", ""), lambda f: f != ""))))
    met = each.join(rules, ["flag", "ending"])
    free = F.col("exclude") == ""
    ok = free | (~F.endswith("w", F.col("exclude")) if merged else ~F.contains("exclude", F.substring("w", -1, 1)))
    strip = F.length("strip")
    behind = F.concat(F.expr("left(w, length(w) - length(strip))"), F.col("add"))
    before = F.when(strip == 0, F.concat("add", "w")).otherwise(F.concat(F.expr("substring(w, length(strip) + 1)"), F.col("add")))
    met = met.where(ok & ((F.col("kind") == "SFX") | F.startswith("w", F.col("strip"))))
    return met.select(F.when(F.col("kind") == "SFX", behind).otherwise(before).alias("form"), "flags", "kind")


def dictionary_words(words: DataFrame, rules: DataFrame, word: str, flags: str) -> DataFrame:
    """All forms: the words, what the rules of each of their flags make of them, and of the forms with a prefix what the rules of
    mergeable suffixes make of those. A prefix rule that strips puts its affix at the end, and its condition looks at the end too,
    as the source of this table does. rules: (kind, flag, strip, add, condition) and, if any, merge."""
    r = rules if "merge" in rules.columns else rules.withColumn("merge", F.lit(False))
    part = lambda i: F.when(F.col("condition") == ".", "").otherwise(F.regexp_extract("condition", r"^(\[\^\S+\])?(\S+)?", i))
    r = r.withColumns({"exclude": part(1), "include": part(2)})
    longer = F.when(F.length("include") >= F.length("strip"), F.col("include")).otherwise(F.col("strip"))
    fits = (F.col("kind") == "PFX") | (F.endswith(longer, F.col("include")) & F.endswith(longer, F.col("strip")))
    r = r.where(fits).withColumn("ending", F.when(F.col("kind") == "PFX", F.col("include")).otherwise(longer))
    longest = r.agg(F.coalesce(F.max(F.length("ending")), F.lit(0))).first()[0]
    base = words.select(F.col(word).alias("w"), F.coalesce(F.col(flags), F.lit("")).alias("flags"))
    first = _formed(base, r, longest, False)
    prefixed = first.where("kind = 'PFX'").select(F.col("form").alias("w"), "flags").distinct()
    second = _formed(prefixed, r.where("kind = 'SFX' and merge"), longest, True)
    return base.select(F.col("w").alias("form")).unionByName(first.select("form")).unionByName(second.select("form")).distinct()


def score_table(text: DataFrame, column: str) -> DataFrame:
    """(issue, option, score) of description lines `Issue: option=score, option=score`."""
    line = text.select(F.explode(F.split(column, "\n")).alias("l")).where(F.contains("l", F.lit(":")))
    opt = line.select(F.trim(F.substring_index("l", ":", 1)).alias("issue"), F.explode(F.split(F.substring_index("l", ":", -1), ",")).alias("o"))
    return opt.select("issue", F.trim(F.substring_index("o", "=", 1)).alias("option"), F.trim(F.substring_index("o", "=", -1)).try_cast("int").alias("score"))


def latest_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes last; carried by one aggregation, so a hot key needs no sorting."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order))).alias("__x")).select(*[c if c in keys else F.col(f"__x.`{c}`") for c in df.columns])
