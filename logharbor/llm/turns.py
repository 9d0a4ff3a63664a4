"""Conversation structure repair by a survivor-coalescence Viterbi search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import save, table

#: States of the grammar ``(s?(ua)+)?``: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

_SPACES = " \t\n\x0b\x0c\r"
#: Where a turn of an initial can stay, and where a user or an assistant can stand.
_KEEP = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
_PLACES = [(START, USER, "user"), (SYSTEM, USER, "user"), (ASSISTANT, USER, "user"), (USER, ASSISTANT, "assistant")]
_LEGAL = {"su", "ua", "au"}


class _Step:
    """An edit in the backpointer tree, ``times`` over; ``held`` survivors end here, ``kids`` go on."""

    __slots__ = ("up", "edit", "times", "turn", "kids", "held", "depth")

    def __init__(self, up: _Step | None, edit: str, times: int, turn: tuple | None):
        self.up, self.edit, self.times, self.turn = up, edit, times, turn
        self.kids, self.held, self.depth = [], 0, up.depth + 1 if up else 0
        if up:
            up.kids.append(self)


def _runs_less(x: list[tuple[str, int]], y: list[tuple[str, int]]) -> bool:
    """Whether a string given as runs, last run first, sorts before another."""
    a = b = ""
    m = n = 0
    while True:
        if not m:
            if not x:
                return bool(n or y)
            a, m = x.pop()
        if not n:
            if not y:
                return False
            b, n = y.pop()
        if a != b:
            return a < b
        m, n = m - min(m, n), n - min(m, n)


class Survivors:
    """The cheapest edits up to here for every state, equal costs by the smaller string of edits.

    Survivors share a tree of edits.  A step that no survivor needs is dropped, and
    as soon as all of them descend from one step, the edits up to it are handed to
    ``emit(edits, turn)`` and forgotten; only unresolved edits are held, deletions in
    a row as one step.  A state that costs more than the way over a later state is
    given up: what follows system can follow assistant, and what follows nothing
    can too when one kept system turn is deleted.
    """

    def __init__(self, emit: Callable[[str, tuple | None], None]):
        self.emit, self.root = emit, _Step(None, "", 0, None)
        self.cost: list[int | None] = [0, None, None, None]
        self.node: list[_Step | None] = [self.root, None, None, None]
        self.root.held = 1
        self._insert()

    @staticmethod
    def _less(x: _Step, x_edit: str, y: _Step, y_edit: str) -> bool:
        """Whether the whole unresolved edits of one path sort before those of the other."""
        left, right = [(x_edit, 1)] if x_edit else [], [(y_edit, 1)] if y_edit else []
        while x is not y:
            if x.depth >= y.depth:
                left.append((x.edit, x.times))
                x = x.up
            else:
                right.append((y.edit, y.times))
                y = y.up
        return _runs_less(left, right)

    def _free(self, step: _Step) -> None:
        while step is not self.root and not step.held and not step.kids:
            step.up.kids.remove(step)
            step = step.up

    def _release(self, step: _Step) -> None:
        step.held -= 1
        self._free(step)

    def feed(self, moves: list[tuple]) -> None:
        """Take a turn: ``moves`` are ``(from state, to state, cost, edits, repaired turn)``."""
        best: list[tuple | None] = [None] * 4
        for source, target, cost, edit, turn in moves:
            node = self.node[source]
            if node is None:
                continue
            cost += self.cost[source]
            have = best[target]
            if have is None or cost < have[0] or (cost == have[0] and self._less(node, edit, have[1], have[2])):
                best[target] = (cost, node, edit, turn)
        old = [n for n in self.node if n]
        for state, b in enumerate(best):
            self.cost[state] = self.node[state] = None
            if b:
                cost, node, edit, turn = b
                self.cost[state], self.node[state] = cost, _Step(node, edit, 1, turn)
                self.node[state].held += 1
        self._settle(old)

    def delete(self, times: int) -> None:
        """Take rows that can't stay: every state deletes them."""
        old = [n for n in self.node if n]
        for state, node in enumerate(self.node):
            if node:
                self.cost[state] += DELETE * times
                self.node[state] = _Step(node, "D", times, None)
                self.node[state].held += 1
        self._settle(old)

    def _settle(self, old: list[_Step]) -> None:
        for node in old:
            self._release(node)
        self._insert()
        for state, limit in ((START, DELETE), (SYSTEM, 0)):
            if self.node[state] and self.cost[state] > self.cost[ASSISTANT] + limit:
                self._release(self.node[state])
                self.cost[state] = self.node[state] = None
        for node in self.node:
            if node:
                self._join_deletions(node)
        self._emit()

    def _join_deletions(self, step: _Step) -> None:
        """A run of deletions with nothing between its steps is one step."""
        step = step.up if step.edit != "D" and step.up else step
        up = step.up
        if step.edit == "D" and up and up is not self.root and up.edit == "D" and not up.held and len(up.kids) == 1:
            step.times += up.times
            step.up = up.up
            step.up.kids[step.up.kids.index(up)] = step

    def _insert(self) -> None:
        """Empty turns inserted here, as long as one betters a state."""
        changed = True
        while changed:
            changed = False
            for source, target, role in _PLACES:
                node, have = self.node[source], self.node[target]
                if node is None:
                    continue
                cost = self.cost[source] + INSERT
                if have is None or cost < self.cost[target] or (cost == self.cost[target] and self._less(node, "I", have, "")):
                    step = _Step(node, "I", 1, (role, ""))
                    step.held += 1
                    self.cost[target], self.node[target] = cost, step
                    if have:
                        self._release(have)
                    changed = True

    def _emit(self) -> None:
        while not self.root.held and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.up = None
            self.emit(self.root.edit * self.root.times, self.root.turn)

    def finish(self) -> int:
        """Emit the rest of the cheapest edits and return their cost."""
        ends = [s for s in (START, ASSISTANT) if self.node[s]]
        best = ends[0]
        for state in ends[1:]:
            if self.cost[state] < self.cost[best] or (
                    self.cost[state] == self.cost[best] and self._less(self.node[state], "", self.node[best], "")):
                best = state
        rest, step = [], self.node[best]
        while step is not self.root:
            rest.append(step)
            step = step.up
        for step in reversed(rest):
            self.emit(step.edit * step.times, step.turn)
        return self.cost[best]

    def unresolved(self) -> int:
        """Steps of the tree, for tests of the bound."""
        todo, n = [self.root], 0
        while todo:
            step = todo.pop()
            n += 1
            todo += step.kids
        return n


class _Conversation:
    """One conversation as its turns stream by: faults, gaps and edits."""

    def __init__(self, conv_id: int | None, emit: Callable[[str, tuple | None], None]):
        self.conv_id, self.search = conv_id, Survivors(emit)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.initial = None

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool) -> None:
        """``copies`` equal adjacent rows; ``first`` unless an earlier turn has the same role and text."""
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.illegal += 1
        self.initial = initial
        self.illegal += (copies - 1) * (initial + initial not in _LEGAL)
        words = text.rstrip(_SPACES)
        if not words:
            self.blank += copies
            gone = copies
        else:
            gone = copies - 1 if first else copies
            self.duplicate += gone
            if first:
                cut = words[-1] not in ".!?"
                self.truncated += cut
                cost = TRUNCATED * cut
                moves = [(s, s, DELETE, "D", None) for s in range(4)]
                moves += [(s, t, cost, "K", (role, text)) for s, t in _KEEP.get(initial, ())]
                moves += [(s, t, REROLE + cost, "R", (new, text)) for s, t, new in _PLACES if initial != new[0]]
                self.search.feed(moves)
        if gone:
            self.search.delete(gone)

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


_AUDIT = [("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
          ("audit", pa.string()), ("repaired_sha256", pa.string())]
_TURNS = [("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
#: Rows of a result batch.
_BATCH = 4096


def _stream(batches: Iterator[pa.RecordBatch], emitter: Callable) -> Iterator[_Conversation]:
    """Conversations of a task's sorted rows, each after its last turn; one is held at a time."""
    at = None
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "copies", "first"))
        for conv_id, turn, role, text, copies, first in zip(*columns, strict=True):
            if at is None or at.conv_id != conv_id:
                if at is not None:
                    yield at
                at = _Conversation(conv_id, emitter(conv_id))
            if copies:
                at.add(turn, role, text, copies, first)
    if at is not None:
        yield at


def _audit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edits: list[str] = []
    digest = hashlib.sha256()
    fresh = True

    def emitter(_):
        nonlocal edits, digest, fresh
        edits, digest, fresh = [], hashlib.sha256(), True

        def emit(edit: str, turn: tuple | None) -> None:
            nonlocal fresh
            edits.append(edit)
            if turn:
                digest.update(f"{'' if fresh else chr(10)}{turn[0]}:{turn[1]}".encode())
                fresh = False
        return emit

    rows: list[tuple] = []
    for c in _stream(batches, emitter):
        cost = c.search.finish()
        rows.append((c.conv_id, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, cost, "".join(edits), digest.hexdigest()))
        if len(rows) >= _BATCH:
            yield _batch(rows, _AUDIT)
            rows = []
    if rows:
        yield _batch(rows, _AUDIT)


def _turns_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def emitter(conv_id):
        place = 0

        def emit(edits: str, turn: tuple | None) -> None:
            nonlocal place
            if turn:
                rows.append((conv_id, place, edits, *turn))
                place += 1
        return emit

    for c in _stream(batches, emitter):
        c.search.finish()
        while len(rows) >= _BATCH:
            yield _batch(rows[:_BATCH], _TURNS)
            del rows[:_BATCH]
    if rows:
        yield _batch(rows, _TURNS)


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _in_order(turns: DataFrame, copies: Column | None) -> DataFrame:
    """Equal rows as one with their number, first ones marked, each conversation's rows in order in one task."""
    blank = F.lit(" ")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    # rows that do not stand only name their conversation
    gone = F.col("copies") == 0
    rows = rows.select("conv_id", *(F.when(~gone, F.col(c)).alias(c) for c in ("turn", "role", "text")), "copies")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = save(rows.withColumn("key", F.sha2("text", 256)), "turns")
    # the first turn of a role and text, combined before the shuffle; the join can be split at hot keys
    firsts = rows.filter("copies > 0").groupBy("conv_id", "role", "key").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("low"))
    firsts = firsts.select(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("key").alias("f_key"), F.col("low.turn").alias("f_turn"))
    joined = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("key") == F.col("f_key")), "left")
    joined = joined.select("conv_id", "turn", "role", "text", "copies", F.col("turn").eqNullSafe(F.col("f_turn")).alias("first"))
    return joined.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def repaired_turns(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """``conv_id``, ``place``, ``edit`` (K, R or I), ``role``, ``text``: the turns of every repaired conversation.

    See ``repair_audit``; deleted turns are not listed.
    """
    return _in_order(turns, copies).mapInArrow(_turns_task, "conv_id bigint, place bigint, edit string, role string, text string")


def repair_audit(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired text of every conversation.

    Turns are taken by ``turn``, nulls first, ties by role and text.  The first
    fault of a turn counts: blank, duplicate (role and text stood before) or
    truncated (the last character that is no space is not one of ``.!?``).  The
    cheapest edits make the initials of the roles match ``(s?(ua)+)?``; of equal
    costs the string of edits that sorts first is taken.

    A conversation's rows stream through one task in order, as the digest is one
    hash over all of them; the task holds the string of edits and the turns whose
    edits are unresolved, which are few unless a long stretch of one role makes the
    choice depend on its last turn.  Equal rows are counted before they are shuffled.

    ``copies`` gives the number of adjacent copies of a row, by default one; rows
    of zero copies only name their conversation, which is returned with zeros, no
    edits and the hash of the empty string.  Null roles and texts count as one
    space, null conversation ids as one conversation; a role is told by its first
    character, lower case.  Other columns are ignored, and an empty table gives
    no rows.
    """
    return _in_order(turns, copies).mapInArrow(
        _audit_task, "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
        "audit string, repaired_sha256 string")


def damage(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Turns damaged by the check sum of their place, and the number of copies of each."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    rows = conversations.select(
        "conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"),
        (F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"])) % 20).alias("damage"))
    kind = F.col("damage")
    rows = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), "damage")
    return rows, F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_audit(*damage(table(spark, sf_dir, "conversations")))


def _crc32_sql(text: str) -> str:
    """The public CRC-32 of an ASCII text, bit by bit."""
    bit = "CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END"
    byte = f"list_reduce([xor(x, y)] || [0,0,0,0,0,0,0,0]::BIGINT[], lambda a, z: {bit})"
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda x, y: {byte}))"


def _sql() -> str:
    """The same search with a fold over each conversation's turns: state, then cost, edits and repaired text."""
    def add(state: str, cost: str, edit: str, role: str | None, text: str = "''") -> str:
        joined = f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {role} || ':' || {text}" if role else f"{state}.t"
        return f"{{'c': {state}.c + {cost}, 'e': {state}.e || '{edit}', 't': {joined}}}"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def when(test: str, value: str) -> str:
        return f"CASE WHEN {test} THEN {value} END"

    def inserted(s: str, a: str, u: str, n: str) -> str:
        user = least(u, add(n, "2", "I", "'user'"), add(s, "2", "I", "'user'"), add(a, "2", "I", "'user'"))
        return user

    live, cut = "NOT r.gone", "r.cut"
    kept_s = when(f"{live} AND r.i = 's'", add("p.n", cut, "K", "r.role", "r.text"))

    def user(state: str) -> list[str]:
        return [when(f"{live} AND r.i = 'u'", add(state, cut, "K", "r.role", "r.text")),
                when(live, add(state, f"2 + {cut}", "R", "'user'", "r.text"))]

    new = {
        "n": add("p.n", "3", "D", None),
        "s": least(add("p.s", "3", "D", None), kept_s),
        "u": least(add("p.u", "3", "D", None), *user("p.n"), *user("p.s"), *user("p.a")),
        "a": least(add("p.a", "3", "D", None), when(f"{live} AND r.i = 'a'", add("p.u", cut, "K", "r.role", "r.text")),
                   when(live, add("p.u", f"2 + {cut}", "R", "'assistant'", "r.text"))),
    }
    crc = _crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    first = "{'c': 0, 'e': '', 't': ''}"
    none = "{'c': 1000000000, 'e': '', 't': ''}"
    return f"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, ({crc} % 20) AS kind FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM coded WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER w AS nr, lag(role[1]) OVER w AS prev,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS words
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faults AS (
  SELECT *, role[1] AS i, words = '' AS blank, words <> '' AND nth > 1 AS duplicate,
    words <> '' AND nth = 1 AND right(words, 1) NOT IN ('.', '!', '?') AS truncated FROM placed),
turned AS (SELECT conv_id, nr, role, text, i, blank OR duplicate AS gone, truncated::INT AS cut FROM faults),
walk AS (
  SELECT conv_id, 0::BIGINT AS nr, {first} AS n, {none} AS s,
    {{'c': 2, 'e': 'I', 't': 'user:'}} AS u, {{'c': 4, 'e': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, nr, n, s, u, {least("a", add("u", "2", "I", "'assistant'"))} AS a FROM (
    SELECT conv_id, nr, n, s, {inserted("s", "a", "u", "n")} AS u, a FROM (
      SELECT p.conv_id, r.nr, {new["n"]} AS n, {new["s"]} AS s, {new["u"]} AS u, {new["a"]} AS a
      FROM walk p JOIN turned r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.nr = p.nr + 1))),
ended AS (SELECT conv_id, list_min([n, a]) AS best FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY nr DESC) = 1)),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (prev IS NOT NULL AND (prev || i) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.e AS audit,
  sha256(best.t) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


OP11_SQL = _sql()
