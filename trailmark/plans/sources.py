"""Source and sink queries: what is written from a table is read again, in the shared folder."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import REFERENCES, html_blocks, page_text
from ..sources import config, files, sinks
from ..sources.scratch import scratch
from .registry import query
from .views import table


@query("SRC_01_SRC_02_SRC_04_SRC_06_SRC_07_PRJ_01_step_files", "SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS step, event_type AS current_move FROM events")
def src_01(spark, d):
    """Step files written as maps from step to record, found by glob, with the run from the file name: one file a user, so that
    no file holds a share of the whole table."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), "event_id", "event_type")
    e = e.withColumn("step", (F.row_number().over(Window.partitionBy("run").orderBy("event_id")) - 1).cast("string"))
    one = e.groupBy("run").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("step", F.struct(F.col("event_type").alias("current_move")))))).alias("value"))
    path = scratch(spark)
    one.select("value", F.concat(F.lit("steps_"), F.col("run").cast("string")).alias("name")).write.partitionBy("name").text(path)
    got = files.steps(spark, f"{path}/name=steps_*/part-*")
    return got.select(F.regexp_extract("file", r"steps_(\d+)", 1).cast("long").alias("run"), "step", "current_move")


@query("SRC_03_SRC_05_text_files", "SELECT n_name AS text FROM nation")
def src_03(spark, d):
    path = scratch(spark)
    table(spark, d, "nation").select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(path)
    return files.text_files(spark, f"{path}/*/part-*").select(F.trim(F.replace("text", F.lit("\n"), F.lit(""))).alias("text"))


@query("SRC_08_partition_path", "SELECT n_name, n_regionkey AS agent FROM nation")
def src_08(spark, d):
    path = scratch(spark)
    table(spark, d, "nation").select("n_name", F.col("n_regionkey").alias("agent")).write.partitionBy("agent").parquet(path)
    return spark.read.parquet(path)


@query("SRC_09_SRC_10_SNK_02_SNK_03_csv", "SELECT p_partkey, p_name, p_retailprice FROM part")
def src_09(spark, d):
    path = scratch(spark)
    sinks.save_csv(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    return files.csv(spark, path, "p_partkey long, p_name string, p_retailprice double")


@query("SRC_13_document_table", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def src_13(spark, d):
    path = scratch(spark)
    table(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.struct(F.col("n_name").alias("name")))))).alias("value")).write.text(path)
    return files.document_table(spark, path, "name:string", "id")


@query("SRC_14_SRC_15_SRC_16_SRC_17_SNK_01_json", "SELECT item_id, text FROM benchmark")
def src_14(spark, d):
    path = scratch(spark)
    sinks.save_json(table(spark, d, "benchmark"), path)
    return files.json_lines(spark, path, "item_id long, text string")


@query("SRC_18_optional", "SELECT r_regionkey AS k, r_regionkey % 2 = 1 AS missing FROM region")
def src_18(spark, d):
    """A file for each even region; the others have none."""
    path, keys = scratch(spark), range(table(spark, d, "region").count())  # five
    table(spark, d, "region").where("r_regionkey % 2 = 0").withColumn("k", F.col("r_regionkey")).write.partitionBy("k").json(path)
    return spark.createDataFrame([(k, files.optional(spark, f"{path}/k={k}", "r_name string") is None) for k in keys], "k int, missing boolean")


@query("SRC_19_newest_file", "SELECT n_regionkey AS k, n_name AS name FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) = 1")
def src_19(spark, d):
    """A folder a region, with a file for each nation, written one after the other; the newest of each folder is read."""
    import time
    path = scratch(spark)
    n = table(spark, d, "nation").withColumn("k", F.col("n_regionkey"))
    for nth in range(n.groupBy("k").count().agg(F.max("count")).first()[0]):  # five
        w = Window.partitionBy("k").orderBy("n_nationkey")
        n.withColumn("nth", F.row_number().over(w)).where(F.col("nth") == nth + 1).drop("nth").coalesce(1).write.mode("append").partitionBy("k").json(path)
        time.sleep(0.05)
    paths = [r["path"] for r in files.newest(files.found(spark, path, "*.json")).collect()]  # one a folder
    return spark.read.option("basePath", path).schema("n_name string, k long").json(paths).select("k", F.col("n_name").alias("name"))


@query("SRC_20_proc_stat", "SELECT 'cpu' || n_nationkey AS label, CAST(n_nationkey * 3 AS BIGINT) AS total FROM nation")
def src_20(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("cpu"), F.col("n_nationkey").cast("string"), F.lit("  "), F.col("n_nationkey").cast("string"), F.lit(" "), (F.col("n_nationkey") * 2).cast("string")).alias("value"))
    return files.proc_stat(n).select("label", F.aggregate("counters", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SRC_21_state_residency", "SELECT p_type, CAST(sum(p_size) AS BIGINT) AS p_size FROM part GROUP BY 1")
def src_21(spark, d):
    return files.state_residency(table(spark, d, "part"), "p_type", "p_size", [])


def captured_tree(spark, d):
    """A capture a supplier's nation: two zones of energy, and an idle state a part size below 5 of each of two cores."""
    from ..sources import tree
    path = scratch(spark)
    s = table(spark, d, "supplier").groupBy(F.concat(F.lit("run"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("run")).agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("total"))
    one = lambda folder, name, value: F.struct(F.lit(folder).alias("folder"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    rows = [one("powercap/intel-rapl:0", "name", F.lit("package-0")), one("powercap/intel-rapl:0", "energy_uj", F.col("total")), one("powercap/intel-rapl:0/intel-rapl:0:0", "name", F.lit("DRAM")), one("powercap/intel-rapl:0/intel-rapl:0:0", "energy_uj", F.col("n"))]
    for cpu in range(2):
        for state in range(3):
            at = f"cpu/cpu{cpu}/cpuidle/state{state}"
            rows += [one(at, "name", F.lit(f"C{state}")), one(at, "time", F.col("total") * (cpu + 1) + state)]
    tree.write_tree(s.select("run", F.explode(F.array(*rows)).alias("x")).select("run", "x.*"), path)
    return tree.tree(spark, path)


_RUNS = "r AS (SELECT 'run' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS run, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS total FROM supplier GROUP BY 1)"


@query("SRC_21_energy_tree", f"WITH {_RUNS} SELECT run, total AS package, n AS dram FROM r")
def src_21_energy(spark, d):
    from ..sources import tree
    return tree.energy(captured_tree(spark, d))


@query("SRC_21_idle_tree", f"WITH {_RUNS} SELECT run, 'cpu' || cpu AS cpu, 'C' || state AS state, CAST(total * (cpu + 1) + state AS BIGINT) AS time FROM r, range(2) a(cpu), range(3) b(state) WHERE run IN ('run01', 'run07')")
def src_21_idle(spark, d):
    """Of two runs; no other run's folder is listed."""
    from ..sources import tree
    return tree.idle_states(captured_tree(spark, d).where(F.col("run").isin("run01", "run07")))


def _blocks_sql(tag: str) -> str:
    out = f"list_transform(string_split_regex(html, '(?i)<{tag}(?:\\s[^>]*)?>')[2:], lambda x: regexp_replace(regexp_replace(x, '(?is)</(?:{tag}|div|article|section|main|body|td)>.*', ''), '<[^>]*>?', '', 'g'))"
    for a, b in REFERENCES:
        out = f"list_transform({out}, lambda x: replace(x, '{a}', '{b.replace(chr(39), chr(39) * 2)}'))".replace("'&#39;'", "'&#39;'")
    return f"list_transform({out}, lambda x: regexp_replace(x, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'))"


@query("SRC_22_page_paragraphs", f"""WITH p AS (SELECT page_id, list_concat({_blocks_sql("p")}, {_blocks_sql("ul")}) AS ps FROM pages), k AS (SELECT page_id, ps, list_filter(ps, lambda x: len(string_split(x, ' ')) > 2) AS kept FROM p)
SELECT page_id, CAST(len(ps) AS BIGINT) AS n_blocks, CAST(len(kept) AS BIGINT) AS n_kept, md5(array_to_string(kept, chr(10))) AS text_md5 FROM k""")
def src_22(spark, d):
    """The page as an agent sees it: its paragraphs, then its lists, with inline tags and attributes read over; those of over two words."""
    p = table(spark, d, "pages").select("page_id", F.concat(html_blocks(F.col("html"), "p"), html_blocks(F.col("html"), "ul")).alias("ps"))
    kept = F.filter("ps", lambda x: F.size(F.split(x, " ")) > 2)
    return p.select("page_id", F.size("ps").cast("long").alias("n_blocks"), F.size(kept).cast("long").alias("n_kept"), F.md5(page_text(F.col("ps"))).alias("text_md5"))


@query("SRC_23_JON_14_SET_05_dictionary", """WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM part), f AS (SELECT w FROM w UNION SELECT w || 's' FROM w WHERE NOT w ENDS WITH 's' UNION SELECT 're' || w FROM w UNION SELECT left(w, len(w) - 1) || 'ies' FROM w WHERE w LIKE '%y') SELECT w AS form FROM f""".replace("NOT w ENDS WITH 's'", "w NOT LIKE '%s'"))
def src_23(spark, d):
    """Forms of words by affix rules, read from text."""
    rules = spark.createDataFrame([("SFX S 0 s [^s]",), ("PFX R 0 re .",), ("SFX S y ies y",), ("SFX S Y 1",)], "value string")
    words = table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w")).distinct().withColumn("flags", F.lit("SR"))
    return files.dictionary_words(words, files.affix_rules(rules), "w", "flags")


@query("SRC_23_JON_14_merged_forms", """WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM part) SELECT w AS form FROM w UNION SELECT w || 's' FROM w WHERE right(w, 1) NOT IN ('s', 'y') UNION SELECT left(w, len(w) - 1) || 'ies' FROM w WHERE w LIKE '%y'
UNION SELECT w || 'ed' FROM w WHERE right(w, 1) <> 'e' UNION SELECT 're' || w FROM w UNION SELECT 're' || w || 's' FROM w UNION SELECT 're' || left(w, len(w) - 1) || 'ies' FROM w WHERE w LIKE '%y'""")
def src_23_merged(spark, d):
    """Forms with a prefix and a mergeable suffix as well; the past tense doesn't merge."""
    rules = spark.createDataFrame([("SFX S Y 2",), ("SFX S 0 s [^sy]",), ("SFX S y ies y",), ("PFX R Y 0 re .",), ("SFX D N 0 ed [^e]",)], "value string")
    words = table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w")).distinct().withColumn("flags", F.lit("SRD"))
    return files.dictionary_words(words, files.affixes(rules), "w", "flags")


@query("SRC_24_score_table", "SELECT p_brand AS issue, p_type AS option, p_size AS score FROM part")
def src_24(spark, d):
    t = table(spark, d, "part").select(F.concat(F.col("p_brand"), F.lit(": "), F.col("p_type"), F.lit("="), F.col("p_size").cast("string")).alias("t"))
    return files.score_table(t, "t")


@query("SNK_04_SNK_05_SNK_07_SNK_08_append", "SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 1")
def snk_04(spark, d):
    path = scratch(spark)
    n = table(spark, d, "nation").select("n_name", "n_regionkey")
    sinks.append(n, path)
    sinks.append(n.where("n_regionkey = 1"), path)
    return files.json_lines(spark, path, "n_name string")


@query("SNK_06_history", "SELECT n_regionkey AS run, count(*) AS windows, (SELECT count(*) FROM supplier WHERE s_nationkey % 5 = n_regionkey) AS requests FROM nation GROUP BY 1")
def snk_06(spark, d):
    """Nations are the windows of their region's run, suppliers its requests."""
    path = scratch(spark)
    sinks.save_history(table(spark, d, "nation").withColumn("run", F.col("n_regionkey").cast("long")), table(spark, d, "supplier").withColumn("run", (F.col("s_nationkey") % 5).cast("long")), path, "run")
    w, r = (spark.read.parquet(f"{path}/{n}").groupBy("run").agg(F.count(F.lit(1)).alias(n)) for n in ("windows", "requests"))
    return w.join(r, "run", "left").select("run", "windows", F.coalesce("requests", F.lit(0).cast("long")).alias("requests"))


@query("SRC_11_SRC_12_run_settings", """SELECT n_nationkey AS run, CASE WHEN n_regionkey < 3 AND n_nationkey % 4 > 0 AND (n_nationkey + 10) % (n_nationkey % 4) = 0 THEN (n_nationkey + 10) // (n_nationkey % 4) END AS iterations,
concat_ws('; ', CASE WHEN n_regionkey >= 3 THEN 'mode isn''t among (''actor_only'', ''speculator_only'', ''dual'')' END, CASE WHEN n_nationkey % 4 = 0 THEN 'window_duration_s isn''t above zero' END,
CASE WHEN n_nationkey % 4 > 0 AND (n_nationkey + 10) % (n_nationkey % 4) <> 0 THEN 'whole windows must fill run_duration_s' END) AS problems FROM nation""")
def src_11(spark, d):
    """Settings files, one a run, in JSON or as flat YAML, read and checked; a faulty one has its problems listed."""
    mode = F.element_at(F.array(*map(F.lit, (*config.MODES, "none", "other"))), (F.col("n_regionkey") + 1).cast("int"))
    n = table(spark, d, "nation").select("n_nationkey", mode.alias("mode"), (F.col("n_nationkey") + 10).cast("string").alias("run"), (F.col("n_nationkey") % 4).cast("string").alias("window"))
    as_json = F.concat(F.lit('{"mode": "'), "mode", F.lit('", "run_duration_s": '), "run", F.lit(', "window_duration_s": '), "window", F.lit("}"))
    as_yaml = F.concat(F.lit("# settings\nmode: '"), "mode", F.lit("'\nrun_duration_s: "), "run", F.lit("  # seconds\nwindow_duration_s: "), "window", F.lit("\n"))
    t = n.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, as_json).otherwise(as_yaml).alias("t"))
    return config.checked(t, "n_nationkey", "t").withColumnRenamed("n_nationkey", "run")


@query("SNK_09_JON_17_manifest", "SELECT r_name AS section, 'a' AS mode, 'x/' || r_regionkey AS path FROM region")
def snk_09(spark, d):
    m = table(spark, d, "region").select(F.create_map("r_name", F.create_map(F.lit("a"), F.concat(F.lit("x/"), F.col("r_regionkey").cast("string")))).alias("m"))
    return sinks.manifest_rows(m, "m")


@query("SNK_10_plot_table", "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def snk_10(spark, d):
    return sinks.plot_table(table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean")), ["event_type"], ["mean"])


@query("SNK_11_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def snk_11(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.remaining(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("FLT_21_dirty_folders", "SELECT l_orderkey, len(list_distinct(list(l_returnflag))) < 3 AS dirty FROM lineitem GROUP BY 1")
def flt_21(spark, d):
    """A folder is dirty if one of the files it needs is missing."""
    need = F.array(*map(F.lit, ("A", "N", "R")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f")).select("l_orderkey", (F.size(F.array_except(need, "f")) > 0).alias("dirty"))
