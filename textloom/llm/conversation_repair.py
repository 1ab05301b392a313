"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and then pairs of user and assistant.

Rows are layers of a graph, states of the pattern its nodes, edits its arcs: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert
(an empty user or assistant turn, anywhere) 2, and a truncated row that isn't deleted 1 more. Blank rows and those whose role and text came
before must be deleted. Minimum costs forward and backward tell all arcs of cheapest paths: those where cost before, own cost and cost behind
add up to the minimum. A walk over sets of nodes that one string of edits reaches then takes the least letter at each step, so that of
all cheapest edits the least string is found, without listing paths. A string says which turns come out, too: as roles alternate, their number
tells each one's role.

Two passes, each sorted by conversation and turn and read as a stream. The first has a byte a row (its role's initial and fault) and gives the
edits; the second brings the texts to them. A conversation's edits are one value, a letter a row, and its bytes are gathered in a task, which
has 32 more a row while it solves it; its texts are never. Which rows repeat is told before by grouped counts, joined back with groups of many rows dealt over tasks.

Results: nulls in any column count as one space, though a null turn comes first and takes no part in gaps. Rows of one turn go by
role, then by a digest of the text; equal ones are alike. A null conv_id is a conversation too. A conversation of no rows has no edits. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import hot_join, small_batches, written

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Initials of roles, and what each leads to from the states: nothing yet, system, user, assistant (or nothing: -1). Others have the last place.
INITIALS, NEXT = "sua", ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
STATES, ACCEPTED, ROLES = range(4), (0, 3), {"u": "user", "a": "assistant"}
#: What is added to a row's place in INITIALS if it must be deleted or is cut short; a row that is dropped beforehand has ABSENT.
MUST, SHORT, ABSENT = 4, 8, 255
_NEVER = 1 << 30
_SPACE = r"\x20\x09-\x0D"

_inserts = [(p, NEXT[p][c]) for p in STATES for c in (1, 2) if NEXT[p][c] >= 0]


@lru_cache(maxsize=16)
def _arcs(code: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letter) of the edits of a row."""
    out = [(p, p, DELETE, "D") for p in STATES]
    if not code & MUST:
        more = CUT if code & SHORT else 0
        for p in STATES:
            for c, cost, letter in ((code & 3, KEEP, "K"), (1, REROLE, "R"), (2, REROLE, "R")):
                if NEXT[p][c] >= 0:
                    out.append((p, NEXT[p][c], cost + more, letter))
    return out


def _solve(codes: bytes) -> tuple[int, str]:
    n = len(codes)
    # costs of all states, layer after layer: four numbers of four bytes a row, before it and behind it
    before, behind = array("i", [0, _NEVER, _NEVER, _NEVER] * (n + 1)), array("i", [_NEVER] * 4 * (n + 1))

    def layer(costs: array, i: int, own: list[int], arcs: list[tuple[int, int]]) -> None:
        for _ in range(2):  # a state is at most two inserts from any other on a cheapest path
            for p, q in arcs:
                own[q] = min(own[q], own[p] + INSERT)
        costs[4 * i : 4 * i + 4] = array("i", own)

    layer(before, 0, [0, _NEVER, _NEVER, _NEVER], _inserts)
    layer(behind, n, [0 if q in ACCEPTED else _NEVER for q in STATES], back := [(q, p) for p, q in _inserts])
    for i, code in enumerate(codes):
        own, last = [_NEVER] * 4, before[4 * i : 4 * i + 4]
        for p, q, cost, _ in _arcs(code):
            own[q] = min(own[q], last[p] + cost)
        layer(before, i + 1, own, _inserts)
    for i in range(n - 1, -1, -1):
        own, next_ = [_NEVER] * 4, behind[4 * i + 4 : 4 * i + 8]
        for p, q, cost, _ in _arcs(codes[i]):
            own[p] = min(own[p], next_[q] + cost)
        layer(behind, i, own, back)
    best = behind[0]
    letters, i, front = bytearray(), 0, {0}
    while not (i == n and any(q in ACCEPTED and before[4 * n + q] == best for q in front)):
        tight = [("I", q) for p, q in _inserts if p in front and before[4 * i + p] + INSERT + behind[4 * i + q] == best]
        if i < n:
            tight += [(letter, q) for p, q, cost, letter in _arcs(codes[i]) if p in front and before[4 * i + p] + cost + behind[4 * i + 4 + q] == best]
        least = min(letter for letter, _ in tight)
        front = {q for letter, q in tight if letter == least}
        letters += least.encode()
        i += least != "I"
    return best, letters.decode()


_solve_short = lru_cache(maxsize=50_000)(_solve)


def cheapest(codes: bytes) -> tuple[int, str]:
    """The minimum cost and the least string of edits for rows of these codes."""
    return _solve_short(codes) if len(codes) <= 64 else _solve(codes)


def turns(edits: str) -> Iterator[tuple[str, str]]:
    """(edit, role's initial) of each edit; a deleted row has no role."""
    n = len(edits) - edits.count("D")
    place = -(n % 2)  # of an odd number the first one is the system's
    for e in edits:
        yield e, "" if e == "D" else "s" if place < 0 else "ua"[place % 2]
        place += e != "D"


def damaged(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with the contract's damage: by the checksum of `conv_id:turn`, rows are dropped (times 0), emptied,
    stripped of stops, repeated (times 2) or given to the user."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    h = F.crc32(F.encode(named, "UTF-8")) % 20
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    return _plain(rows).withColumn("h", h).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1).alias("times"))


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def _coded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows(conv_id, turn, role, text, times), one for each time (or an absent one): with texts, and with codes."""
    every = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("times", F.lit(1)))))
    every = every.withColumn("digest", F.sha2(F.encode(F.concat("role", F.lit("\n"), "text"), "UTF-8"), 256)).withColumn("row", F.monotonically_increasing_id())
    # row numbers hold from here on, as rows are read back
    every = written(every.select("conv_id", "turn", "role", "text", "digest", "row", (F.col("times") == 0).alias("absent")), "turns")
    there = every.where("not absent")
    key = F.struct("conv_id", "digest")
    first = there.groupBy(key.alias("key")).agg(F.min(F.struct("turn", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = written(first.select("key", F.col("first.row").alias("first"), "n"), "repeated")
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    short = ~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    narrow = there.select(key.alias("key"), "conv_id", "turn", "role", "digest", "row", blank.alias("blank"), short.alias("short"))
    # a key without nulls, so that conversations without an id join as well
    plain = F.struct(F.coalesce(F.col("key.conv_id").cast("string"), F.lit("")), "key.digest")
    marked = hot_join(narrow.withColumn("key", plain), first.withColumn("key", plain), "key", "n", F.xxhash64("row"), how="left")
    again = F.coalesce(F.col("row") != F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), MUST).when(again, MUST).when(F.col("short"), SHORT).otherwise(0)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    names = ["conv_id", "turn", "role", "digest", "row"]
    coded = marked.select(*names, (place + fault).cast("int").alias("code"), F.col("blank"), (again & ~F.col("blank")).alias("again"))
    absent = every.where("absent").select(*names, F.lit(ABSENT).alias("code"), F.lit(False).alias("blank"), F.lit(False).alias("again"))
    return every, coded.unionByName(absent)


#: Rows of a conversation; a null turn comes first.
_ORDER = ["turn", "role", "digest", "row"]

_STATS = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string()}
_STATS_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """What the first pass gathers of a conversation: a byte a row, and counts."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.low, self.turn, self.distinct = conv_id, bytearray(), None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, code: int, blank: bool, again: bool) -> None:
        if code == ABSENT:
            return
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn, self.distinct = turn, self.distinct + 1
        if self.codes:
            pair = (self.codes[-1] & 3, code & 3)
            self.illegal += pair not in ((0, 1), (1, 2), (2, 1))
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + bool(code & SHORT)
        self.codes.append(code)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.distinct
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest(bytes(self.codes)))


def _edits(coded: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, counts of faults, cost and audit."""
    names = ["conv_id", *_STATS]

    def made(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate([pa.int64(), *_STATS.values()])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv_id, *row in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "code", "blank", "again")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now:
                        done.append(now.result())
                    now = _Conversation(conv_id)
                now.add(*row)
            if done:
                yield made(done)
                done = []
        if now:
            yield made([now.result()])

    rows = coded.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)
    return rows.select("conv_id", "turn", "code", "blank", "again").mapInArrow(run, _STATS_SCHEMA)


_OUT_SCHEMA = f"{_STATS_SCHEMA}, place long, edit string, role string, text string"


def _replayed(every: DataFrame, edits: DataFrame) -> DataFrame:
    """Of each conversation, one after another in a partition, a row with its figures (place 0), and its repaired turns in order, with audit null."""
    kinds = [pa.int64(), *_STATS.values(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["conv_id", *_STATS, "place", "edit", "role", "text"]
    none = (None,) * len(_STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, place, todo = None, 0, iter(())

        def rest(out: list, row: tuple | None) -> None:
            """The edits up to the one that takes this row, or all that are left."""
            nonlocal place
            for edit, initial in todo:
                if edit != "D":
                    place += 1
                    role, text = (ROLES[initial], "") if edit == "I" else (row[0] if edit == "K" else ROLES[initial], row[1])
                    out.append((conv_id, *none, place, edit, role, text))
                if edit != "I":
                    return

        for batch in batches:
            out = []
            for r in zip(*(batch[c].to_pylist() for c in ("conv_id", *_STATS, "role", "text")), strict=True):
                if r[len(_STATS)] is not None:
                    rest(out, None)
                    conv_id, place, todo = r[0], 0, turns(r[len(_STATS)])
                    out.append((*r[: len(_STATS) + 1], 0, None, None, None))
                else:
                    rest(out, r[-2:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out = []
        rest(out, None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    rows = every.where("not absent").drop("absent").withColumn("kind", F.lit(1))
    both = edits.withColumn("kind", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER)
    return dealt.select("conv_id", *_STATS, "role", "text").mapInArrow(run, _OUT_SCHEMA)


def _all(rows: DataFrame) -> DataFrame:
    small_batches(rows.sparkSession)
    every, coded = _coded(rows)
    return _replayed(every, written(_edits(coded), "edits"))


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns of conversations(conv_id, turn, role, text): conv_id, place (from 1), edit (Keep, Rerole or Insert, by initial), role, text."""
    return _all(_plain(rows).withColumn("times", F.lit(1))).where("place > 0").select("conv_id", "place", "edit", "role", "text")


def op13(rows: DataFrame) -> DataFrame:
    """The contract's damage, repaired: a row per conversation with its figures, the edits and the digest of its turns."""
    names = ["conv_id", *_STATS, "repaired_sha256"]
    kinds = [pa.int64(), *_STATS.values(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for r in zip(*(batch[c].to_pylist() for c in ("conv_id", *_STATS, "place", "role", "text")), strict=True):
                *head, place, role, text = r
                if place == 0:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = head, hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, digest.hexdigest()), kinds, strict=True)], names=names)

    # no shuffle between: turns come as they were replayed
    return _all(damaged(rows)).select("conv_id", *_STATS, "place", "role", "text").mapInArrow(run, f"{_STATS_SCHEMA}, repaired_sha256 string")


def oracle_sql() -> str:
    """`op13` in DuckDB's SQL, for conversations of some turns. From each row on and for each state the cheapest edits are a text: their cost in six digits and
    their letters, so that the least text is the cheapest one of the least letters."""
    checksum = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda x: unicode(x)::BIGINT)), lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::BIGINT FOR i IN range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"
    more = lambda key, cost, letter: f"(lpad((substr({key}, 1, 6)::INT + {cost})::VARCHAR, 6, '0') || '{letter}' || substr({key}, 7))"
    never = "'900000'"

    def inserted(keys: list[str]) -> list[str]:
        """Each state's text or one that inserts first: from nothing, a system turn or an assistant a user, from a user an assistant."""
        return [f"least({keys[p]}, {more(keys[q], INSERT, 'I')})" for p, q in ((0, 2), (1, 2), (2, 3), (3, 2))]

    def step(p: int) -> str:
        ways = [more(f"k{p}", DELETE, "D")]
        for c, q in enumerate(NEXT[p]):
            if q >= 0:
                ways.append(f"CASE WHEN must OR initial <> '{INITIALS[c]}' THEN {never} ELSE {more(f'k{q}', 'short', 'K')} END")
                if c:
                    ways.append(f"CASE WHEN must THEN {never} ELSE {more(f'k{q}', f'{REROLE} + short', 'R')} END")
        return f"least({', '.join(ways)})"

    def closed(source: str, row: str) -> str:
        """Two rounds of inserts are all that a cheapest path has in one place."""
        once = ", ".join(f"{x} AS k{i}" for i, x in enumerate(inserted([f"k{i}" for i in range(4)])))
        return f"SELECT conv, {row}, {once} FROM (SELECT conv, {row}, {once} FROM ({source}))"

    last = ", ".join(f"{repr('000000') if q in ACCEPTED else never} AS k{q}" for q in STATES)
    steps = ", ".join(f"{step(p)} AS k{p}" for p in STATES)
    space = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH RECURSIVE named AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {checksum.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations
), after AS (
  SELECT conv, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM named, range(2) c(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(role || chr(10) || text), copy) AS i FROM after
), faults AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '{space}') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again, right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) NOT IN ('.', '!', '?') AS unended,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) || substr(role, 1, 1) AS pair FROM placed
), rows AS (
  SELECT *, blank OR again AS must, (NOT blank AND NOT again AND unended)::INT AS short FROM faults
), figures AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum((again AND NOT blank)::INT) AS duplicate, sum(short) AS truncated, sum((pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM rows GROUP BY conv
), paths(conv, upto, k0, k1, k2, k3) AS (
  {closed(f"SELECT conv, n AS upto, {last} FROM figures", "upto")}
  UNION ALL
  {closed(f"SELECT p.conv, upto - 1 AS upto, {steps} FROM paths p JOIN rows r ON r.conv = p.conv AND r.i = p.upto WHERE upto > 0", "upto")}
), audits AS (
  SELECT conv, substr(k0, 1, 6)::BIGINT AS cost, substr(k0, 7) AS audit FROM paths WHERE upto = 0
), letters AS (
  SELECT conv, pos, letter, length(replace(audit, 'D', '')) AS kept, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS place
  FROM (SELECT conv, audit, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS pos FROM audits WHERE audit <> '') WINDOW w AS (PARTITION BY conv ORDER BY pos)
), repaired AS (
  SELECT l.conv, string_agg(CASE WHEN letter = 'K' THEN r.role WHEN (place - kept % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY pos) AS turns
  FROM letters l LEFT JOIN rows r ON r.conv = l.conv AND r.i = l.i WHERE letter <> 'D' GROUP BY l.conv
)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(turns, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM named) d LEFT JOIN figures USING (conv) LEFT JOIN audits USING (conv) LEFT JOIN repaired USING (conv)
"""
