"""Text function queries: each is one expression over one table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators.similarity import gate
from .registry import query
from .views import table

DOCS, CONV, EV, PART = ("documents", ["doc_id"]), ("conversations", ["conv_id", "turn"]), ("events", ["event_id"]), ("part", ["p_partkey"])
T = lambda: F.col("text")
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
K = lambda: F.get_json_object("props", "$.k").cast("long")

#: A text with actions, built from each event in both engines.
_ACT = f"'Thought ' || {_K} || ': look.' || chr(10) || 'Action ' || {_K} % 5 || ': ' || CASE {_K} % 4 WHEN 0 THEN 'Lookup[' || event_type || '] Search[x' || {_K} || ']' WHEN 1 THEN 'Finish[yes]' WHEN 2 THEN 'Search[' || event_type || '] Search[b]' ELSE 'none' END"
ACT = lambda: F.expr("concat('Thought ', cast(get_json_object(props, '$.k') as long), ': look.\\n', 'Action ', cast(get_json_object(props, '$.k') as long) % 5, ': ', case cast(get_json_object(props, '$.k') as long) % 4 when 0 then concat('Lookup[', event_type, '] Search[x', cast(get_json_object(props, '$.k') as long), ']') when 1 then 'Finish[yes]' when 2 then concat('Search[', event_type, '] Search[b]') else 'none' end)")
_FIRST = "coalesce(nullif(regexp_extract({0}, '(Search\\[[^\\]]*\\])', 1), ''), nullif(regexp_extract({0}, '(Lookup\\[[^\\]]*\\])', 1), ''), nullif(regexp_extract({0}, '(Finish\\[[^\\]]*\\])', 1), ''))"
_SENT = "list_transform(list_filter(flatten(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)), lambda p: p <> ''), lambda p: string_split(p, '. '))), lambda s: trim(s) <> ''), lambda s: trim(s) || '.')"
_REPORT = f"'events per second: ' || {_K} * 10 || '.5' || chr(10) || 'total number of events: 1,' || lpad(CAST({_K} AS VARCHAR), 3, '0') || chr(10) || 'total time: 1.00' || {_K} || 's' || chr(10) || 'avg: ' || value || chr(10) || '95th percentile: ' || value * 2"
REPORT = lambda: F.concat(F.lit("events per second: "), (K() * 10).cast("string"), F.lit(".5\ntotal number of events: 1,"), F.lpad(K().cast("string"), 3, "0"), F.lit("\ntotal time: 1.00"), K().cast("string"), F.lit("s\navg: "), F.col("value").cast("string"), F.lit("\n95th percentile: "), (F.col("value") * 2).cast("string"))
_REPLY = f"CASE {_K} % 3 WHEN 0 THEN 'Analysis: fine.' || chr(10) || 'Config: {{ “min granularity ns”: ' || {_K} * 5000 || ' }}' WHEN 1 THEN 'min_granularity_ns = ' || {_K} * 7000 ELSE 'no value' END"
REPLY = lambda: F.when(K() % 3 == 0, F.concat(F.lit("Analysis: fine.\nConfig: { “min granularity ns”: "), (K() * 5000).cast("string"), F.lit(" }"))).when(K() % 3 == 1, F.concat(F.lit("min_granularity_ns = "), (K() * 7000).cast("string"))).otherwise("no value")
_JSON = "'{\"b\": \"' || p_brand || '\", \"a\": ' || p_size || '}'"
JSON = lambda: F.concat(F.lit('{"b": "'), F.col("p_brand"), F.lit('", "a": '), F.col("p_size").cast("string"), F.lit("}"))
_CANON = "'{\"a\":\"' || p_size || '\",\"b\":\"' || p_brand || '\"}'"
_FENCED = f"CASE p_partkey % 3 WHEN 0 THEN {_JSON} WHEN 1 THEN 'Here:' || chr(10) || '```json' || chr(10) || {_JSON} || chr(10) || '```' ELSE 'sorry' END"
FENCED = lambda: F.when(F.col("p_partkey") % 3 == 0, JSON()).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), JSON(), F.lit("\n```"))).otherwise("sorry")
_MOVES = f"'I play [ ' || chr(CAST(97 + {_K} % 8 AS INT)) || '2' || chr(CAST(97 + {_K} % 8 AS INT)) || '4 ] or [e7 e8q]'"
MOVES = lambda: F.concat(F.lit("I play [ "), F.char(97 + K() % 8), F.lit("2"), F.char(97 + K() % 8), F.lit("4 ] or [e7 e8q]"))
_CONF = f"CASE {_K} % 3 WHEN 0 THEN '[' || {_K} || ', 12.5]' WHEN 1 THEN 'about ' || {_K} || ' and 7' ELSE '[x, 1]' END"
CONF = lambda: F.when(K() % 3 == 0, F.concat(F.lit("["), K().cast("string"), F.lit(", 12.5]"))).when(K() % 3 == 1, F.concat(F.lit("about "), K().cast("string"), F.lit(" and 7"))).otherwise("[x, 1]")
_REACT = f"CASE {_K} % 2 WHEN 0 THEN 'Thought: go' || chr(10) || 'Action: {{\"name\": \"' || event_type || '\", \"arguments\": {{\"k\": \"' || {_K} || '\"}}}}' ELSE 'Action: hello' END"
REACT = lambda: F.when(K() % 2 == 0, F.concat(F.lit('Thought: go\nAction: {"name": "'), F.col("event_type"), F.lit('", "arguments": {"k": "'), K().cast("string"), F.lit('"}}'))).otherwise("Action: hello")
_USER = f"CASE {_K} % 4 WHEN 0 THEN 'ok ###STOP###' WHEN 1 THEN 'Thought: a' || chr(10) || 'User Response: ' || event_type WHEN 2 THEN 'Thought: b' ELSE event_type END"
USER = lambda: F.when(K() % 4 == 0, "ok ###STOP###").when(K() % 4 == 1, F.concat(F.lit("Thought: a\nUser Response: "), F.col("event_type"))).when(K() % 4 == 2, "Thought: b").otherwise(F.col("event_type"))
OTHERS = lambda: F.when(F.col("p_size") % 3 == 0, F.array("p_type", "p_brand", "p_type")).when(F.col("p_size") % 3 == 1, F.array("p_type", "p_name")).otherwise(F.array("p_brand", "p_type"))
join = lambda c: F.array_join(c.cast("array<string>"), "|")

#: Name, (table, key columns), what makes the Spark expression (there may be no session yet), DuckDB expression.
TABLE = [
    ("FN_05_extract_action", EV, lambda: fn.extract_action(ACT()), _FIRST.format(_ACT)),
    ("FN_06_extract_actions", EV, lambda: join(fn.extract_actions(ACT())), f"array_to_string(list_concat(list_concat(regexp_extract_all({_ACT}, 'Search\\[[^\\]]*\\]'), regexp_extract_all({_ACT}, 'Lookup\\[[^\\]]*\\]')), regexp_extract_all({_ACT}, 'Finish\\[[^\\]]*\\]')), '|')"),
    ("FN_07_lower_verb", EV, lambda: fn.lower_verb(fn.extract_action(ACT())), f"CASE WHEN strpos({_FIRST.format(_ACT)}, '[') > 0 THEN lower(split_part({_FIRST.format(_ACT)}, '[', 1)) || substr({_FIRST.format(_ACT)}, strpos({_FIRST.format(_ACT)}, '[')) END"),
    ("FN_08_FN_13_thought", EV, lambda: fn.thought_and_action(ACT())["thought"], f"'Thought ' || {_K} || ': look.'"),
    ("FN_08_FN_13_action", EV, lambda: fn.thought_and_action(ACT())["action"], f"trim(regexp_replace(split_part({_ACT}, chr(10), 2), '^Action[^:]*:', ''))"),
    ("FN_09_action_name", EV, lambda: fn.action_name(fn.extract_action(ACT())), f"CASE WHEN {_FIRST.format(_ACT)} IS NOT NULL THEN split_part({_FIRST.format(_ACT)}, '[', 1) END"),
    ("FN_10_uci_moves", EV, lambda: join(fn.uci_moves(MOVES())), f"chr(CAST(97 + {_K} % 8 AS INT)) || '2' || chr(CAST(97 + {_K} % 8 AS INT)) || '4|e7e8q'"),
    ("FN_12_confidences", EV, lambda: join(fn.confidences(CONF())), f"CASE {_K} % 3 WHEN 0 THEN {_K} || '.0|12.5' WHEN 1 THEN {_K} || '.0|7.0' ELSE '' END"),
    ("FN_15_SRT_09_sentences", DOCS, lambda: join(F.slice(fn.sentences(T()), 1, 5)), f"array_to_string(list_slice({_SENT}, 1, 5), '|')"),
    ("FN_16_keyword_hits", DOCS, lambda: F.size(fn.keyword_hits(T(), F.lit("TION"))).cast("long"), f"len(list_filter({_SENT}, lambda s: contains(lower(s), 'tion')))"),
    ("FN_17_page_text", DOCS, lambda: F.md5(fn.page_text(F.split(T(), "\n"))), "md5(array_to_string(list_filter(string_split(text, chr(10)), lambda p: len(string_split(p, ' ')) > 2), chr(10)))"),
    ("FN_18_disambiguation", DOCS, lambda: fn.is_disambiguation(F.split(F.when(F.col("doc_id") % 3 == 0, F.concat(T(), F.lit("\nIt may refer to: x"))).otherwise(T()), "\n")), "doc_id % 3 = 0 OR contains(text, 'may refer to:')"),
    ("FN_20_strip_role", CONV, lambda: F.md5(fn.strip_role(F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("role"), F.lit(":"), T()), F.col("role"))), "md5(' ' || text)"),
    ("FN_21_bracketed", EV, lambda: fn.bracketed(F.when(K() % 2 == 0, F.concat(F.lit("["), F.col("event_type"), F.lit("]"))).otherwise(F.col("event_type"))), "'[' || event_type || ']'"),
    ("FN_21_last_line", CONV, lambda: fn.last_line(F.concat(T(), F.lit("\n go "), F.col("turn").cast("string"), F.lit(" "))), "'[go ' || turn || ']'"),
    ("FN_22_clip_words", CONV, lambda: fn.clip_words(T(), 7), "array_to_string(list_slice(string_split(text, ' '), 1, 7), ' ')"),
    ("FN_22_clip_chars", CONV, lambda: fn.clip_chars(T(), 25), "right(text, 25)"),
    ("FN_23_sysbench_throughput", EV, lambda: fn.sysbench(REPORT())["throughput"], f"CAST({_K} * 10 || '.5' AS DOUBLE)"),
    ("FN_23_sysbench_events", EV, lambda: fn.sysbench(REPORT())["events"], f"CAST(1000 + {_K} AS DOUBLE)"),
    ("FN_23_sysbench_p95", EV, lambda: F.round(fn.sysbench(REPORT())["p95"], 4), "round(value * 2, 4)"),
    ("FN_23_sysbench_p99", EV, lambda: fn.sysbench(REPORT())["p99"], "CAST(NULL AS DOUBLE)"),
    ("FN_24_tuner_value", EV, lambda: fn.tuner_value(REPLY(), "min_granularity_ns", 100_000, 400_000), f"CASE {_K} % 3 WHEN 0 THEN greatest(100000, least(400000, {_K} * 5000)) WHEN 1 THEN greatest(100000, least(400000, {_K} * 7000)) END"),
    ("FN_26_lenient_json", PART, lambda: fn.fenced_json(FENCED()), f"CASE WHEN p_partkey % 3 < 2 THEN {_JSON} END"),
    ("FN_27_loosely_equal", PART, lambda: fn.loosely_equal(F.col("p_name"), F.concat(F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))), F.when(F.col("p_size") % 3 == 0, "x").otherwise("!"))), "p_size % 3 <> 0"),
    ("FN_28_value_hash", PART, lambda: F.sha2(fn.canonical_json(JSON()), 256), f"sha256({_CANON})"),
    ("FN_29_longest_prefix", PART, lambda: fn.longest_prefix(F.col("p_name"), ["s", "small", "re", "red", "blue b"]), "CASE WHEN p_name LIKE 'small%' THEN 'small' WHEN p_name LIKE 's%' THEN 's' WHEN p_name LIKE 'red%' THEN 'red' WHEN p_name LIKE 're%' THEN 're' WHEN p_name LIKE 'blue b%' THEN 'blue b' END"),
    ("FN_30_choice_label", PART, lambda: fn.choice_label(F.col("p_size") % 26), "chr(65 + p_size % 26)"),
    ("FN_31_approx_tokens", DOCS, lambda: fn.approx_tokens(T()), "length(text) // 4"),
    ("FN_32_strip_keys", PART, lambda: fn.canonical_map(fn.strip_keys(F.create_map(F.lit(" a "), F.col("p_name")))), "'{\"a\":\"' || p_name || '\"}'"),
    ("FN_33_react_action", EV, lambda: fn.react_action(REACT())["name"], f"CASE WHEN {_K} % 2 = 0 THEN event_type ELSE 'respond' END"),
    ("FN_33_react_arguments", EV, lambda: fn.react_action(REACT())["arguments"], f"CASE WHEN {_K} % 2 = 0 THEN '{{\"k\":\"' || {_K} || '\"}}' ELSE 'hello' END"),
    ("FN_34_user_reply", EV, lambda: fn.user_reply(USER()), f"CASE {_K} % 4 WHEN 0 THEN '###STOP###' WHEN 2 THEN 'b' ELSE event_type END"),
    ("FN_36_after_token", EV, lambda: fn.after_token(ACT(), "Search"), f"trim(list_extract(string_split({_ACT}, 'Search'), -1))"),
    ("FN_37_model_family", PART, lambda: fn.model_family(F.when(F.col("p_size") % 3 == 0, "gpt-4").when(F.col("p_size") % 3 == 1, "org/model").otherwise("x")), "CASE p_size % 3 WHEN 0 THEN 'gpt' WHEN 1 THEN 'hosted' ELSE 'other' END"),
    ("FN_38_safe_name", DOCS, lambda: fn.safe_name(F.concat(F.col("source"), F.lit("-a/b"))), "source || '_a_b'"),
    ("FN_39_pretty_ns", EV, lambda: fn.pretty_ns(K() * 12345), f"format('{{:,}}', {_K} * 12345) || ' ns'"),
    ("FN_40_wordle_feedback", EV, lambda: fn.wordle_feedback(F.substring("event_type", 1, 4), F.lit("vice")), "CASE event_type WHEN 'view' THEN 'GGYX' WHEN 'click' THEN 'YXYX' WHEN 'error' THEN 'YXXX' WHEN 'signup' THEN 'XGXX' ELSE 'XXXY' END"),
    ("PRJ_19_core_list", PART, lambda: join(fn.core_list(F.concat(F.lit("0-"), (F.col("p_size") % 4).cast("string"), F.lit(",8,2"))))
     , "array_to_string(list_sort(list_distinct(list_concat(range(0, p_size % 4 + 1), [8, 2]))), '|')"),
    ("PRJ_10_pairs_text", PART, lambda: F.array_join(F.transform(F.map_entries(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | "), "'brand: ' || p_brand || ' | type: ' || p_type"),
    ("PRJ_16_repeat_scalar", EV, lambda: join(F.array_repeat(K(), 3)), f"{_K} || '|' || {_K} || '|' || {_K}"),
    ("PRJ_17_array_sum", EV, lambda: join(F.zip_with(F.array(K(), K() + 1), F.array(K(), K() * 2), lambda a, b: a + b)), f"{_K} * 2 || '|' || {_K} * 3 + 1"),
    ("PRJ_18_append_truth", EV, lambda: join(F.array_append(F.array(F.lit("a")), F.col("event_type"))), "'a|' || event_type"),
    ("PRJ_13_slice_from_match", EV, lambda: join(F.slice(F.array(F.lit("click"), F.lit("view"), F.lit("error")), F.array_position(F.array(F.lit("click"), F.lit("view"), F.lit("error")), F.when(F.col("event_type").isin("view", "error"), F.col("event_type")).otherwise("click")).cast("int"), 3)), "CASE event_type WHEN 'view' THEN 'view|error' WHEN 'error' THEN 'error' ELSE 'click|view|error' END"),
    ("FN_11_last_board", EV, lambda: F.md5(fn.last_board(F.concat(F.lit("[GAME] You are playing\nGo.\nCurrent board:\nold\n a b c d e f g h\n"), F.when(K() % 3 == 0, "Current board:\n").when(K() % 3 == 1, "Current board:\nnew\n a b c d e f g h\nx\nValid moves: [e2e4]").otherwise("")))),
     f"CASE {_K} % 3 WHEN 0 THEN md5('Could not find end of board') WHEN 1 THEN md5('[GAME] You are playing' || chr(10) || 'Go.' || chr(10) || 'Current board:' || chr(10) || 'new' || chr(10) || ' a b c d e f g h' || chr(10) || 'Valid moves: [e2e4]') ELSE md5('[GAME] You are playing' || chr(10) || 'Go.' || chr(10) || 'Current board:' || chr(10) || 'old' || chr(10) || ' a b c d e f g h') END"),
    ("SET_06_concat_lists", DOCS, lambda: F.size(F.concat(F.split(T(), "\n"), F.split(T(), " "))).cast("long"), "len(string_split(text, chr(10))) + len(string_split(text, ' '))"),
    ("SET_07_set_equality", PART, lambda: (F.size(F.array_except(F.array("p_brand", "p_type"), OTHERS())) == 0) & (F.size(F.array_except(OTHERS(), F.array("p_brand", "p_type"))) == 0), "p_size % 3 <> 1"),
]


def _put(name, source, expr, sql):
    tab, keys = source

    @query(name, f"SELECT {', '.join(keys)}, {sql} AS out FROM {tab}")
    def run(spark, d):
        return table(spark, d, tab).select(*keys, expr().alias("out"))


for _row in TABLE:
    _put(*_row)


@query("FN_14_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1 AND b.label = a.label")
def fn_14(spark, d):
    """Similarity of each vector with the one before it, within a label."""
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"), "label")
    return e.join(b, ["vec_id", "label"]).select("vec_id", F.round(fn.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


_TALK = "t AS (SELECT vec_id, embedding::DOUBLE[] AS e, label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS n FROM embeddings)"


@query("STM_11_similarity_gate", f"""WITH {_TALK}, m AS (SELECT vec_id, e, label || '/' || n // 8 AS conv, n % 2 = 1 AS guess FROM t),
g AS (SELECT a.vec_id, max(list_cosine_similarity(a.e, b.e)) AS likeness FROM m a LEFT JOIN m b ON b.conv = a.conv AND b.vec_id < a.vec_id AND NOT b.guess WHERE a.guess GROUP BY 1)
SELECT vec_id, round(likeness, 6) AS likeness, coalesce(likeness > 0.6, false) AS accepted FROM g""")
def stm_11(spark, d):
    """Conversations of eight vectors of a label, user messages and guesses in turn: a guess is accepted if it is like any earlier user message."""
    from pyspark.sql import Window
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    m = table(spark, d, "embeddings").withColumn("n", n).select("vec_id", "embedding", F.concat_ws("/", "label", F.floor(F.col("n") / 8)).alias("conv"), F.when(F.col("n") % 2 == 1, "guess").otherwise("user").alias("role"))
    return gate(m, "conv", "vec_id", "role", "embedding").select("vec_id", F.round("likeness", 6).alias("likeness"), "accepted")
