"""Text functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single spaces."""
    plain = F.regexp_replace(F.lower(c), r"\p{Punct}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def exact_match(pred: Column, truth: Column) -> Column:
    """1 if equal after normalization; an unanswered question scores 0."""
    return F.coalesce((normalize_answer(pred) == normalize_answer(truth)).cast("int"), F.lit(0))


def action_name(c: Column) -> Column:
    """Text before the first [, null without one."""
    return F.when(F.instr(c, "[") > 0, F.substring_index(F.trim(c), "[", 1))


ACTIONS = ("Search", "Lookup", "Finish")


def extract_action(c: Column) -> Column:
    """The first action in order of priority, not of place."""
    found = [F.regexp_extract(c, rf"({a}\[[^\]]*\])", 1) for a in ACTIONS]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def extract_actions(c: Column) -> Column:
    return F.concat(*[F.regexp_extract_all(c, F.lit(rf"({a}\[[^\]]*\])"), 1) for a in ACTIONS])


def lower_verb(c: Column) -> Column:
    return F.when(F.instr(c, "[") > 0, F.concat(F.lower(F.substring_index(c, "[", 1)), F.lit("["), F.substring(c, F.instr(c, "[") + 1, F.length(c)))).otherwise(F.lower(c))


def thought_and_action(c: Column) -> Column:
    """Split at the first line that begins with Action."""
    at = F.instr(c, "\nAction")
    return F.struct(F.trim(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)).alias("thought"), F.when(at > 0, F.trim(F.regexp_replace(F.substring(c, at + 1, F.length(c)), r"^Action[^:]*:", ""))).alias("action"))


def uci_moves(c: Column) -> Column:
    """All moves in brackets, inner white space dropped."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[\s*([a-h][1-8]\s*[a-h][1-8]\s*[qrbn]?)\s*\]"), 1), lambda x: F.regexp_replace(x, r"\s+", ""))


def confidences(c: Column) -> Column:
    """Doubles in the first brackets; without brackets all integers; none or a bad number: empty."""
    inner = F.regexp_extract(c, r"\[([^\]]*)\]", 1)
    parsed = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("double"))
    ints = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1), lambda x: x.cast("double"))
    empty = F.array().cast("array<double>")
    got = F.when(F.contains(c, F.lit("[")), F.when(F.exists(parsed, lambda x: x.isNull()), empty).otherwise(parsed)).otherwise(ints)
    return F.coalesce(got, empty)


def cosine(a: Column, b: Column) -> Column:
    d = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return d(a, b) / F.sqrt(d(a, a) * d(b, b))


def sentences(c: Column) -> Column:
    """Sentences of the paragraphs, with their full stop."""
    paragraphs = F.filter(F.transform(F.split(c, "\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(F.filter(F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"\. "))), lambda s: F.trim(s) != ""), lambda s: F.concat(F.trim(s), F.lit(".")))


def keyword_hits(c: Column, keyword: Column) -> Column:
    return F.filter(sentences(c), lambda s: F.contains(F.lower(s), F.lower(keyword)))


#: Character references that are decoded, the ampersand last (fixed values).
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_blocks(html: Column, tag: str) -> Column:
    """The texts of all elements of a kind, with or without attributes: up to their end, the next of their kind or the end of the
    block around them, without the tags inside of them."""
    parts = F.split(html, rf"(?i)<{tag}(?:\s[^>]*)?>", -1)
    bare = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: F.regexp_replace(F.regexp_replace(x, rf"(?is)</(?:{tag}|div|article|section|main|body|td)>.*", ""), r"<[^>]*>?", ""))

    def decoded(x: Column) -> Column:
        for name, char in REFERENCES:
            x = F.replace(x, F.lit(name), F.lit(char))
        return F.regexp_replace(x, r"^[ \t\r\n]+|[ \t\r\n]+$", "")

    return F.transform(bare, decoded)


def page_text(paragraphs: Column) -> Column:
    """Paragraphs with more than two words, one a line."""
    return F.array_join(F.filter(paragraphs, lambda p: F.size(F.split(p, " ")) > 2), "\n")


def is_disambiguation(paragraphs: Column) -> Column:
    return F.exists(paragraphs, lambda p: F.contains(p, F.lit("may refer to:")))


def strip_role(c: Column, role: Column) -> Column:
    return F.replace(F.replace(c, F.concat(F.lit("["), role, F.lit("]")), F.lit("")), F.concat(role, F.lit(":")), F.lit(""))


def bracketed(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("[")) & F.contains(c, F.lit("]")), c).otherwise(F.concat(F.lit("["), F.trim(c), F.lit("]")))


def last_line(c: Column) -> Column:
    return bracketed(F.trim(F.element_at(F.split(F.rtrim(c), "\n"), -1)))


def clip_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(c, " "), 1, n), " ")


def clip_chars(c: Column, n: int) -> Column:
    """The last n characters."""
    return F.right(c, F.lit(n))


def longest_prefix(c: Column, options: list[str]) -> Column:
    """The longest option that the text begins with; of equals the first."""
    got = F.filter(F.array(*map(F.lit, options)), lambda o: F.startswith(c, o))
    return F.aggregate(got, F.lit(None).cast("string"), lambda a, o: F.when(a.isNull() | (F.length(o) > F.length(a)), o).otherwise(a))


def choice_label(c: Column) -> Column:
    return F.char((F.lit(65) + c).cast("long"))


def approx_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def react_action(c: Column) -> Column:
    """(name, arguments) of the JSON after the last Action:, else a respond with the text."""
    tail = F.trim(F.substring_index(c, "Action:", -1))
    parsed = F.from_json(tail, "name string, arguments map<string,string>")
    ok = parsed.isNotNull() & parsed["name"].isNotNull()
    return F.struct(F.when(ok, parsed["name"]).otherwise(F.lit("respond")).alias("name"), F.when(ok, F.to_json(parsed["arguments"])).otherwise(tail).alias("arguments"))


def user_reply(c: Column) -> Column:
    stop = F.contains(c, F.lit("###STOP###"))
    return F.when(stop, F.lit("###STOP###")).when(F.contains(c, F.lit("User Response:")), F.trim(F.substring_index(c, "User Response:", -1))).when(F.contains(c, F.lit("Thought:")), F.trim(F.substring_index(c, "Thought:", -1))).otherwise(c)


def after_token(c: Column, token: str) -> Column:
    return F.trim(F.substring_index(c, token, -1))


def model_family(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("gpt")), "gpt").when(F.contains(c, F.lit("/")), "hosted").otherwise("other")


def safe_name(c: Column) -> Column:
    return F.translate(c, "-/", "__")


def pretty_ns(c: Column) -> Column:
    return F.concat(F.format_number(c, 0), F.lit(" ns"))


def sysbench(c: Column) -> Column:
    """Throughput, events, total time and latencies of a benchmark report; p99 may be missing, the others are then 0."""
    num = lambda p: F.regexp_replace(F.nullif(F.regexp_extract(c, p, 1), F.lit("")), ",", "").cast("double")
    zero = lambda p: F.coalesce(num(p), F.lit(0.0))
    return F.struct(
        zero(r"events per second:\s*([\d.,]+)").alias("throughput"), zero(r"total number of events:\s*([\d,]+)").alias("events"), zero(r"total time:\s*([\d.]+)s").alias("total_time"),
        zero(r"avg:\s*([\d.]+)").alias("avg"), zero(r"95th percentile:\s*([\d.]+)").alias("p95"), num(r"99th percentile:\s*([\d.]+)").alias("p99"))


def tuner_value(c: Column, key: str, low: int, high: int) -> Column:
    """A number from a model's reply: `Config: {...}` with typographic quotes and loose keys; clamped to its range."""
    plain = F.translate(c, "“”’", "\"\"'")
    loose = key.replace("_", "[ _-]")
    raw = F.regexp_extract(plain, rf"(?is)config:.*?\"?{loose}\"?\s*:\s*\"?(-?\d+)", 1)
    raw = F.coalesce(F.nullif(raw, F.lit("")), F.nullif(F.regexp_extract(plain, rf"(?is)\"?{loose}\"?\s*[:=]\s*\"?(-?\d+)", 1), F.lit("")))
    return F.when(raw.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), raw.cast("long"))))


def canonical_map(m: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def canonical_json(c: Column) -> Column:
    """A flat JSON object with sorted keys and values as strings; null if malformed."""
    return canonical_map(F.from_json(c, "map<string,string>"))


def loosely_equal(a: Column, b: Column) -> Column:
    """Equality of strings by letters and digits only."""
    return F.lower(F.regexp_replace(a, "[^A-Za-z0-9]", "")) == F.lower(F.regexp_replace(b, "[^A-Za-z0-9]", ""))


def strip_keys(m: Column) -> Column:
    return F.transform_keys(m, lambda k, v: F.trim(k))


def fenced_json(c: Column) -> Column:
    """The JSON text of a reply: itself, or the inside of a ```json or other fence; null if none parses."""
    tries = [c, F.regexp_extract(c, r"(?s)```json\s*(.*?)```", 1), F.regexp_extract(c, r"(?s)```\w*\s*(.*?)```", 1), F.regexp_extract(c, r"(?s)(\{.*\})", 1)]
    ok = lambda x: F.when(F.from_json(F.when(F.startswith(F.ltrim(x), F.lit("{")), x), "map<string,string>").isNotNull(), F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.coalesce(*[ok(x) for x in tries])


def core_list(c: Column) -> Column:
    """"0-3,8" as [0, 1, 2, 3, 8]."""
    part = lambda p: F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(F.split(c, ","), lambda p: F.trim(p) != ""), lambda p: part(F.trim(p))))))


def typing_seconds(c: Column, words_per_minute: int = 40) -> Column:
    return F.size(F.split(c, " ", -1)) / words_per_minute * 60


def wordle_feedback(guess: Column, secret: Column) -> Column:
    """G, Y or X per letter: greens first; a yellow uses up one of the secret's other letters."""
    g, s = F.split(guess, ""), F.split(secret, "")
    rest = F.transform(F.filter(F.arrays_zip(g.alias("g"), s.alias("s")), lambda x: x["g"] != x["s"]), lambda x: x["s"])
    green = lambda i: F.get(g, i) == F.get(s, i)
    used = lambda x, i: F.size(F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda j: (j < i) & (F.get(g, j) == x) & ~green(j)))
    there = lambda x: F.size(F.filter(rest, lambda y: y == x))
    return F.array_join(F.transform(g, lambda x, i: F.when(green(i), "G").when(used(x, i) < there(x), "Y").otherwise("X")), "")


#: What an observation without a whole board gives.
NO_BOARD, NO_END = "No board found in observation", "Could not find end of board"


def last_board(c: Column) -> Column:
    """The last board of an observation with the valid moves after it, and the opening lines if the text begins a game."""
    lines = F.split(F.trim(c), "\n")
    at = lambda test, after: F.array_position(F.transform(lines, lambda x, i: F.coalesce(test(x) & (i > after), F.lit(False))), True) - 1
    has = lambda s: lambda x: F.contains(x, F.lit(s))
    start = F.coalesce(F.array_max(F.transform(lines, lambda x, i: F.when(F.contains(x, F.lit("Current board:")), i))), F.lit(-1))
    end = at(has("a b c d e f g h"), start)
    moves = F.get(F.filter(lines, lambda x, i: (i > end) & F.contains(x, F.lit("Valid moves:"))), F.lit(0))
    opening = F.when(F.startswith(F.get(lines, F.lit(0)), F.lit("[GAME] You are playing")), F.slice(lines, 1, 2)).otherwise(F.array().cast("array<string>"))
    kept = F.concat(opening, F.slice(lines, start + 1, (end - start + 1).cast("int")), F.array_compact(F.array(moves)))
    return F.when(start < 0, NO_BOARD).when(end < 0, NO_END).otherwise(F.array_join(kept, "\n"))
