from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from check import compare, connect
from logharbor.llm import turns

DIR = "/root/testdata/sf0.01"
SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
    # names that the operator uses inside
    T.StructField("copies", T.StringType()), T.StructField("key", T.LongType()), T.StructField("first", T.StringType()),
    T.StructField("damage", T.IntegerType())])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 7, "f", 3) for r in rows], SCHEMA)


def faults(rows):
    """Plain version: the rows in order with their first fault."""
    rows = sorted((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for _, t, r, x in rows)
    seen, out = set(), []
    for has, turn, role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn if has else None, role, text, fault))
    return out


def plain(rows):
    """All edits of a conversation by exhaustive search over rows and grammar states, cheapest and smallest first."""
    todo = {0: (0, "", ())}

    def better(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value

    def inserted(states):
        for _ in range(6):
            for state, (cost, edits, kept) in list(states.items()):
                role = "assistant" if state == 2 else "user"
                better(states, 3 if state == 2 else 2, (cost + 2, edits + "I", (*kept, f"{role}:")))
        return states

    todo = inserted(todo)
    for _, role, text, fault in faults(rows):
        new = {}
        for state, (cost, edits, kept) in todo.items():
            better(new, state, (cost + 3, edits + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            extra = int(fault == "truncated")
            to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(state)
            if to is not None:
                better(new, to, (cost + extra, edits + "K", (*kept, f"{role}:{text}")))
            name = "assistant" if state == 2 else "user"
            better(new, 3 if state == 2 else 2, (cost + 2 + extra, edits + "R", (*kept, f"{name}:{text}")))
        todo = inserted(new)
    return min((todo[s] for s in (0, 3) if s in todo), key=lambda v: v[:2])


def audit(rows):
    found = faults(rows)
    cost, edits, kept = plain(rows)
    times = {t for t, *_ in found if t is not None}
    initials = [r[:1] for _, r, _, _ in found]
    return {
        "gaps": max(times) - min(times) + 1 - len(times) if times else 0,
        **{k: sum(f == k for *_, f in found) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        "cost": cost, "audit": edits, "repaired_sha256": hashlib.sha256("\n".join(kept).encode()).hexdigest()}


@pytest.fixture(scope="module")
def random_rows():
    rnd = random.Random(5)
    texts = ["Hi.", "Hi", "No?", "", " \t", "Yes!\n", None, "é a", "x."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "Ä"]
    return [(c, rnd.choice([None, *range(9), 2, 2]), rnd.choice(roles[: 3 if c % 2 else 9]), rnd.choice(texts[: 3 if c % 3 else 9]))
            for c in range(400) for _ in range(rnd.randint(1, 14))]


def test_edits_against_plain_search(spark, random_rows):
    got = {r.conv_id: r.asDict() for r in turns.repair_audit(frame(spark, random_rows)).collect()}
    for conv_id, rows in itertools.groupby(sorted(random_rows, key=lambda r: r[0]), key=lambda r: r[0]):
        rows = list(rows)
        assert got[conv_id] == {"conv_id": conv_id, **audit(rows)}, rows


def test_turns_are_those_of_the_digest(spark, random_rows):
    kept = {}
    for r in turns.repaired_turns(frame(spark, random_rows)).orderBy("conv_id", "place").collect():
        kept.setdefault(r.conv_id, []).append(r)
    for r in turns.repair_audit(frame(spark, random_rows)).collect():
        mine = kept.get(r.conv_id, [])
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in mine).encode()).hexdigest() == r.repaired_sha256
        assert "".join(t.edit for t in mine) == r.audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in mine))


def test_tree_stays_small():
    rnd = random.Random(3)
    # turns of one role only stay unresolved: the last one decides which are changed
    for roles in ("ua", "suax", "uuua", "uax"):
        search, most = turns.Survivors(lambda *_: None), 0
        for i in range(3000):
            role = rnd.choice(roles)
            if i % 7 == 0:
                search.delete(1 + i % 3)
            else:
                search.feed([(s, s, 3, "D", None) for s in range(4)] + [(s, t, 0, "K", None) for s, t in turns._KEEP.get(role, ())]
                            + [(s, t, 2, "R", None) for s, t, _ in turns._PLACES])
            most = max(most, search.unresolved())
        assert most < 200, roles
    search = turns.Survivors(lambda *_: None)
    for _ in range(3000):
        search.delete(2)
    assert search.unresolved() < 30


def test_damage_is_the_check_sum(spark):
    rows = [(c, t, "assistant", "One. Two! Three") for c in (None, 1, 2) for t in (None, *range(30))]
    got, copies = turns.damage(frame(spark, rows))
    got = {(r.conv_id, r.turn): r for r in got.withColumn("n", copies).collect()}
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind, r = zlib.crc32(key.encode()) % 20, got[c, t]
        assert r.n == {0: 0, 3: 2}.get(kind, 1)
        assert r.role == ("user" if kind == 4 else role)
        assert r.text == {1: "", 2: "One Two Three"}.get(kind, text)


def test_odd_conversations(spark):
    long = "word " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "."), (None, None, None, None), (None, 3, "user", "Hi."),
            (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (3, None, "assistant", "A."), (3, 0, "user", "B.")]
    got = {r.conv_id: r for r in turns.repair_audit(frame(spark, rows)).collect()}
    assert (got[1].audit, got[1].cost, got[1].truncated) == ("KK", 1, 1)
    assert (got[None].audit, got[None].blank, got[None].gaps) == ("DKI", 1, 0)
    assert (got[2].audit, got[2].duplicate, got[2].illegal, got[2].cost) == ("KDDI", 2, 2, 8)
    assert (got[3].audit, got[3].cost, got[3].gaps) == ("IKKI", 4, 0)
    empty = frame(spark, rows).limit(0)
    assert turns.repair_audit(empty).count() == 0 and turns.repaired_turns(empty).count() == 0
    from pyspark.sql import functions as F
    gone = turns.repair_audit(frame(spark, rows[:2]), F.lit(0)).first()
    assert (gone.cost, gone.audit, gone.gaps, gone.repaired_sha256) == (0, "", 0, hashlib.sha256(b"").hexdigest())


def test_query_against_sql(spark):
    got = turns.op11_conversation_repair(spark, DIR).toArrow()
    assert compare(got, connect(DIR).sql(turns.OP11_SQL).to_arrow_table()) is None
