"""Conversation structure repair: Dijkstra on the implicit lattice of (row, grammar state).

A conversation's roles should be a system turn or none, then pairs of user and assistant turns, or nothing at all. In a state
of that grammar a row is kept, given the role that the state asks for, or deleted, and turns without text are inserted; the
cheapest edits win, of equally cheap ones those whose initials come first in ASCII. Nodes are popped by (cost, edits so far),
and the search stops at the first accepting node behind the last row. Edits so far can serve as the second key: two ways to
one node that cost the same have as many inserted turns, so neither is a prefix of the other, and their order stays.

Spark deals rows by conversation and sorts them; a task reads its rows as a stream, whatever the length of a conversation. The
lattice is searched in blocks of BLOCK rows. Behind a block at most four states are left, less those that another state beats
by more than it can cost to change over; the edits that they have in common are settled, and their rows are let go. What a
task holds is a block, the rows on which the cheapest ways still differ, and 16 bytes for each different message of the
conversation, to know repetitions. A conversation's hash is one chain by its definition, so it isn't split over tasks.

Defined cases: a null conversation is one of its own; a null role or text is one space, so such a text is blank; null turns
come first and count in no gap; rows of one turn are ordered by role and text, by their bytes; equal rows are repetitions of
each other; a role without a letter of the grammar's is kept nowhere; a conversation without rows has zeros, no edits and the
hash of the empty text; no rows give no rows; further columns, of whatever names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, bounded_batches, table

#: Rows of the lattice that are searched at once.
BLOCK = 256
#: Costs of the edits; a truncated row that stays costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: 0 nothing yet, 1 behind the system turn, 2 behind a user turn, 3 behind an assistant turn.
ACCEPTING = (0, 3)
#: What a state asks for: the role's name and the state behind it.
ASKS = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: By how much at most the first state's way to the end costs more than the second's: a state may change over by one inserted
#: turn, and a system turn kept in state 0 can be deleted in the others.
_CHANGE = {(3, 0): 3, (3, 1): 0, (3, 2): 2, (2, 3): 2, (2, 0): 5, (2, 1): 2}
LEGAL = ("su", "ua", "au")
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
_SPACE = " \t\n\x0b\x0c\r"


def fault(role: str, text: str, seen: set[bytes]) -> str:
    """The row's first fault, or nothing. seen: digests of the rows before it in the conversation."""
    digest = xxhash.xxh128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))
    again = digest in seen
    seen.add(digest)
    last = text.rstrip(_SPACE)[-1:]
    return BLANK if not last else DUPLICATE if again else CUT if last not in ".!?" else ""


def after(state: int, initial: str) -> int | None:
    """The state behind a row that is kept, None where the grammar doesn't take it."""
    if state == 0 and initial == "s":
        return 1
    role, then = ASKS[state]
    return then if initial == role[0] else None


def search(starts: dict[int, tuple[int, str]], rows: list[tuple[str, str]], last: bool) -> dict[int, tuple[int, str]]:
    """The cheapest (cost, edits) of each state behind the rows (initial, fault), or, at the last block, of the best accepting one."""
    heap = [(cost, edits, 0, state) for state, (cost, edits) in starts.items()]
    heap.sort()
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    n = len(rows)
    while heap:
        cost, edits, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if last and state in ACCEPTING:
                return {state: (cost, edits)}
            found[state] = (cost, edits)
        else:
            initial, wrong = rows[i]
            heappush(heap, (cost + DELETE, edits + "D", i + 1, state))
            if wrong not in (BLANK, DUPLICATE):
                more = TRUNCATED if wrong == CUT else 0
                kept = after(state, initial)
                if kept is not None:
                    heappush(heap, (cost + more, edits + "K", i + 1, kept))
                heappush(heap, (cost + REROLE + more, edits + "R", i + 1, ASKS[state][1]))
        heappush(heap, (cost + INSERT, edits + "I", i, ASKS[state][1]))
    return {s: x for s, x in found.items() if not any(y in found and found[y][0] + most < x[0] for (y, z), most in _CHANGE.items() if z == s)}


class Conversation:
    """One conversation, row by row; `out` holds its repaired rows (role, text, edit) as far as they are settled."""

    def __init__(self, rows_wanted: bool):
        self.fronts: dict[int, tuple[int, str]] = {0: (0, "")}
        self.state, self.cost, self.rows_wanted = 0, 0, rows_wanted
        self.block: list[tuple[str, str]] = []
        self.waiting: list[tuple[str, str]] = []
        self.seen: set[bytes] = set()
        self.counts = dict.fromkeys((BLANK, DUPLICATE, CUT), 0)
        self.illegal = self.turns = 0
        self.before = self.first = self.turn = None
        self.audit: list[str] = []
        self.hash, self.lines, self.out = hashlib.sha256(), 0, []

    def add(self, turn: int | None, role: str, text: str) -> None:
        initial, wrong = role[:1], fault(role, text, self.seen)
        if wrong:
            self.counts[wrong] += 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None:
            self.turns += turn != self.turn
            self.first, self.turn = turn if self.first is None else self.first, turn
        self.block.append((initial, wrong))
        self.waiting.append((role, text))
        if len(self.block) == BLOCK:
            self._search(False)

    def _search(self, last: bool) -> None:
        self.fronts, self.block = search(self.fronts, self.block, last), []
        same = commonprefix([e for _, e in self.fronts.values()])
        self.fronts = {s: (c, e[len(same) :]) for s, (c, e) in self.fronts.items()}
        self._settle(same)

    def _settle(self, edits: str) -> None:
        self.audit.append(edits)
        taken = 0
        for e in edits:
            role, text = ASKS[self.state][0], ""
            if e != "I":
                own, text = self.waiting[taken]
                taken += 1
                if e == "D":
                    continue
                role = own if e == "K" else role
            self.state = after(self.state, role[:1])
            self.hash.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.lines += 1
            if self.rows_wanted:
                self.out.append((self.lines, role, text, e))
        del self.waiting[:taken]

    def end(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
        self._search(True)
        self.cost = next(iter(self.fronts.values()))[0]
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _streamed(rows: DataFrame, rows_wanted: bool, schema: str, ids: pa.DataType | None = None) -> DataFrame:
    """rows (id, turn, role, text, present) by conversation through Conversation; rows that aren't present only name theirs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, got, kind = None, None, [], None

        def batch() -> pa.RecordBatch:
            cols = list(zip(*got)) if got else [()] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, kind if n == "id" else None) if c else pa.array([], kind if n == "id" else types[n]) for n, c in zip(names, cols)], names=names)
            got.clear()
            return out

        def ended() -> None:
            got.extend((key, *x) for x in now.out) if rows_wanted else got.append((key, *now_end))

        for b in batches:
            kind = b.column(0).type
            for i, turn, role, text, present in zip(*[c.to_pylist() for c in b.columns]):
                if now is None or i != key:
                    if now is not None:
                        now_end = now.end()
                        ended()
                    now, key = Conversation(rows_wanted), i
                if present:
                    now.add(turn, role, text)
                if rows_wanted and len(now.out) > 1000:
                    got.extend((key, *x) for x in now.out)
                    now.out.clear()
                if len(got) > 1000:
                    yield batch()
        if now is not None:
            now_end = now.end()
            ended()
        if got:
            yield batch()

    names = [c.split()[0] for c in schema.split(", ")]
    types = {n: pa.string() for n in names}
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.repartition("id").sortWithinPartitions("id", F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(run, schema.replace("id any", f"id {kind}"))


def _rows(conversations: DataFrame) -> DataFrame:
    """(id, turn, role, text, present) of a table with conv_id, turn, role and text."""
    bounded_batches(conversations.sparkSession)
    c = bare(conversations, "conv_id", "turn", "role", "text").toDF("id", "turn", "role", "text")
    blank = lambda n: F.coalesce(F.col(n), F.lit(" ")).alias(n)
    return c.select("id", "turn", blank("role"), blank("text"), F.lit(True).alias("present"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the stated damage by a checksum of conversation and turn; a dropped row stays as one that isn't present."""
    r = _rows(conversations)
    word = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("id"), F.lit(":"), word("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(kind != 0))
    return r.select("id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("present"))


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit): the rows of each repaired conversation, from 1, and how each came about."""
    got = _streamed(_rows(conversations), True, "id any, position long, role string, text string, edit string")
    return got.withColumnRenamed("id", "conv_id")


def reports(rows: DataFrame) -> DataFrame:
    """What each conversation of rows (id, turn, role, text, present) had wrong, what its cheapest repair costs, and which edits it takes."""
    got = _streamed(rows, False, "id any, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return got.withColumnRenamed("id", "conv_id")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
#: Layer by layer instead of node by node: the best (cost, edits) of the four states behind each row, then the edits are played.
_CRC = "list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(k, '')]), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))"


def _way(state: str, cost: str, edit: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}}"


def _ways(to: str, initial: str, *states: str) -> str:
    """The least of what the named state had and of the ways that keep or change a row from the given ones."""
    own = [_way(s, f"t + CASE WHEN ok AND r = '{initial}' THEN 0 ELSE 1000000000 END", "K") for s in states]
    new = [_way(s, "2 + t + CASE WHEN ok THEN 0 ELSE 1000000000 END", "R") for s in states] if initial != "s" else []
    return f"list_min([{', '.join([_way(to, '3', 'D'), *own, *new])}])"


SQL = {
    "op13_conversation_repair": rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, xor({_CRC}, 4294967295) % 20 AS d FROM k), g AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM g),
f AS (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN NOT regexp_matches(text, '[^ \t-\r]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ \t-\r]*\z') THEN 't' ELSE '' END AS f FROM o),
x AS (SELECT *, f NOT IN ('b', 'd') AS ok, CAST(f = 't' AS BIGINT) AS t FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, CAST(count_if(f = 'b') AS BIGINT) AS blank, CAST(count_if(f = 'd') AS BIGINT) AS duplicate, CAST(count_if(f = 't') AS BIGINT) AS truncated, CAST(count_if(before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS BIGINT) AS illegal FROM x GROUP BY 1),
p AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, {{'c': 1000000000::BIGINT, 'a': ''}} AS s1, {{'c': 2::BIGINT, 'a': 'I'}} AS s2, {{'c': 4::BIGINT, 'a': 'II'}} AS s3 FROM x
UNION ALL SELECT conv_id, i, b0, b1, list_min([b2, {_way('b0', '2', 'I')}, {_way('b1', '2', 'I')}, {_way('b3', '2', 'I')}]), list_min([b3, {_way('b2', '2', 'I')}, {_way('b0', '4', 'II')}, {_way('b1', '4', 'II')}])
FROM (SELECT p.conv_id, x.i, {_way('s0', '3', 'D')} AS b0, {_ways('s1', 's', 's0')} AS b1, {_ways('s2', 'u', 's0', 's1', 's3')} AS b2, {_ways('s3', 'a', 's2')} AS b3 FROM p JOIN x ON x.conv_id IS NOT DISTINCT FROM p.conv_id AND x.i = p.i + 1)),
e AS (SELECT p.conv_id, list_min([s0, s3]) AS e FROM p JOIN (SELECT DISTINCT conv_id, n FROM x) y ON y.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = y.n),
w AS (SELECT conv_id, e.a AS a, 0 AS j, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(NULL AS VARCHAR) AS out FROM e
UNION ALL SELECT w.conv_id, a, j + 1, w.i + CAST(a[j + 1] <> 'I' AS BIGINT), CASE a[j + 1] WHEN 'D' THEN s WHEN 'K' THEN CASE r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE s WHEN 2 THEN 3 ELSE 2 END END,
CASE a[j + 1] WHEN 'D' THEN out ELSE coalesce(out || chr(10), '') || CASE WHEN a[j + 1] = 'K' THEN role WHEN s = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE a[j + 1] WHEN 'I' THEN '' ELSE text END END
FROM w LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1 WHERE j < length(a))
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.e.c, 0) AS cost, coalesce(e.e.a, '') AS audit, sha256(coalesce(out, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM v.conv_id AND j = length(w.a)"""
}
