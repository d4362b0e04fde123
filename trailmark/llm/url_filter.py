"""URL filters by a temporal list join, with DataFrame functions only.

A block list is a log of dated entries (pattern, action, date), action `add` or `remove`; a pattern is a host or a parent
domain. Entries become validity intervals [since, until) by the next entry of the same pattern. Captures are evaluated
as of their fetch time: each distinct host is expanded to its parent domains once and gets the intervals of all its
patterns, sorted; a capture then looks up the entries active at its fetch time, and the longest pattern wins.

The table of hosts that have entries is broadcast only if its bytes, as counted, are at most `BROADCAST_BYTES`; beyond that
it is joined by a shuffle, in which a host with very many captures is split over tasks (adaptive skew join, the lists being
the small side). A list holds what stands on a host and its parents, a few intervals; a parent with many hosts is copied to
each of them once, not to each capture.

Defined cases: a null or malformed url has no host and isn't blocked; a null fetch time matches no interval; entries with a
null pattern or date are left out; of entries of one pattern and date `add` comes before `remove`, so the pattern isn't
active from then on; repeated entries count once; equal rows get equal results; urls of any length are read
whole; empty tables give no rows, or captures that aren't blocked; further columns, of whatever names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bare, table, written

BROADCAST_BYTES = 8_000_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The lower-case host, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until): until is null while the entry stands."""
    log = bare(entries, "pattern", "action", "date").where("pattern is not null and date is not null and action in ('add', 'remove')").select(F.lower("pattern").alias("pattern"), "action", "date").distinct()
    after = F.lead("date").over(Window.partitionBy("pattern").orderBy("date", "action"))
    return log.withColumn("until", after).where("action = 'add' and (until is null or until > date)").select("pattern", F.col("date").alias("since"), "until")


def host_lists(spark: SparkSession, hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, entries): the sorted intervals of a host and its parent domains, of hosts that have any."""
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    patterns = hosts.select("host", F.explode(F.array_distinct(parents)).alias("pattern"))
    met = patterns.join(intervals(entries), "pattern")
    return written(spark, met.groupBy("host").agg(F.sort_array(F.collect_set(F.struct("since", "until", "pattern"))).alias("entries")), "host-lists")


def evaluated(spark: SparkSession, captures: DataFrame, entries: DataFrame, id_col: str, url: str, fetched: str) -> DataFrame:
    """(id, url, host, fetched, blocked, pattern, since) of each capture; pattern and since of the longest active pattern."""
    rows = bare(captures, id_col, url, fetched).toDF("id", "url", "fetched").select("id", "url", host_of(F.col("url")).alias("host"), "fetched")
    hosts = rows.where("host is not null").select("host").distinct()
    lists = host_lists(spark, hosts, entries)
    size = F.octet_length("host") + 64 + F.aggregate("entries", F.lit(0), lambda a, e: a + F.octet_length(e["pattern"]) + 48)
    lists = F.broadcast(lists) if (lists.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else lists
    active = F.filter("entries", lambda e: (e["since"] <= F.col("fetched")) & (e["until"].isNull() | (F.col("fetched") < e["until"])))
    got = rows.join(lists, "host", "left").withColumn("active", active)
    best = F.array_max(F.transform("active", lambda e: F.struct(F.length(e["pattern"]).alias("n"), e["since"].alias("since"), e["pattern"].alias("pattern"))))
    return got.select("id", "url", "host", "fetched", F.coalesce(F.size("active") > 0, F.lit(False)).alias("blocked"), best["pattern"].alias("pattern"), best["since"].alias("since"))


def _digit(k: int, of: str = "pattern") -> str:
    return f"(instr('0123456789abcdef', substr(md5({of}), {k}, 1)) - 1)"


#: The list that the query uses: its entries follow from the patterns by this rule.
ENTRIES_SQL = f"""
SELECT pattern, 'add' AS action, date_add(DATE '2024-01-01', CAST(18 * {_digit(2)} AS INT)) AS date FROM patterns WHERE {_digit(1)} < 6
UNION ALL SELECT pattern, 'remove', date_add(DATE '2024-01-01', CAST(18 * {_digit(2)} + 1 + 9 * {_digit(3)} AS INT)) FROM patterns WHERE {_digit(1)} < 6 AND {_digit(4)} < 10
UNION ALL SELECT pattern, 'add', date_add(DATE '2024-01-01', CAST(18 * {_digit(2)} + 160 AS INT)) FROM patterns WHERE {_digit(1)} < 6 AND {_digit(5)} < 5
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures: the pages, fetched on day page_id mod 366 of 2024. List: by ENTRIES_SQL, over all hosts and their parent domains of two labels or more."""
    pages = bare(table(spark, sf_dir, "pages"), "page_id", "url")
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    patterns = hosts.select(F.explode(parents).alias("pattern")).distinct()
    entries = spark.sql(ENTRIES_SQL.replace("FROM patterns", "FROM {patterns}"), patterns=patterns)
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))
    got = evaluated(spark, captures, entries, "page_id", "url", "fetched")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return got.select(F.col("id").alias("page_id"), "url", "host", day("fetched"), "blocked", "pattern", day("since"))


QUERIES = {"op4_url_filter": op4_url_filter}
SQL = {"op4_url_filter": f"""
WITH c AS (SELECT page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
                  DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS fetched FROM pages),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS ls FROM c WHERE host IS NOT NULL),
hp AS (SELECT host, array_to_string(list_slice(ls, k, len(ls)), '.') AS pattern, k, len(ls) AS n FROM (SELECT host, ls, unnest(range(1, len(ls) + 1)) AS k FROM hosts)),
patterns AS (SELECT DISTINCT pattern FROM hp WHERE k <= greatest(n - 1, 1)),
entries AS ({ENTRIES_SQL.replace("date_add(DATE '2024-01-01', ", "(DATE '2024-01-01' + ")}),
seen AS (SELECT pattern, action, date AS since, lead(date) OVER (PARTITION BY pattern ORDER BY date, action) AS until FROM (SELECT DISTINCT * FROM entries)),
act AS (SELECT c.page_id, c.url, hp.pattern, s.since, row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY length(hp.pattern) DESC, s.since DESC) AS r
        FROM c JOIN hp USING (host) JOIN seen s ON s.pattern = hp.pattern AND s.action = 'add' AND s.since <= c.fetched AND (s.until IS NULL OR c.fetched < s.until))
SELECT c.page_id, c.url, c.host, strftime(c.fetched, '%Y-%m-%d') AS fetched, act.page_id IS NOT NULL AS blocked, act.pattern, strftime(act.since, '%Y-%m-%d') AS since
FROM c LEFT JOIN act ON act.r = 1 AND act.page_id = c.page_id AND act.url = c.url
"""}
