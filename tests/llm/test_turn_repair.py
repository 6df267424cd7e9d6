import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb

from paperloom.llm.queries import OP13_SQL
from paperloom.llm.turn_repair import damage, edits, report

TURNS = "conv_id long, turn long, role string, text string"
STATES = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_report(conv, rows):
    """By search over every edit at every turn and state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, marks = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        marks.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        options = []
        if inserts < 3:
            options += [("I", 2, i, x, inserts + 1, ({"u": "user", "a": "assistant"}[x], "")) for x in STATES[state] if x != "s"]
        if i < len(rows):
            options.append(("D", 3, i + 1, state, 0, None))
            if marks[i] not in ("blank", "duplicate"):
                extra = marks[i] == "truncated"
                for x in STATES[state]:
                    if rows[i][2][:1] == x:
                        options.append(("K", extra, i + 1, x, 0, rows[i][2:]))
                    if x != "s":
                        options.append(("R", 2 + extra, i + 1, x, 0, ({"u": "user", "a": "assistant"}[x], rows[i][3])))
        for letter, price, *to, said in options:
            if (rest := best(*to)) is not None:
                found.append((rest[0] + price, letter + rest[1], ((said,) if said else ()) + rest[2]))
        return min(found) if found else None

    cost, audit, said = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    first = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    body = "\n".join(f"{role}:{text}" for role, text in said)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], [])
    for r in plain_damage(rows):
        by[r[0]].append(r)
    return sorted((plain_report(c, r) for c, r in by.items()), key=repr)


def hostile(seed=3):
    rng = random.Random(seed)
    texts = ["Good.", "Well!", "cut", "", " \n", None, "Why?", "é😀.", "a.\t", "Good.", "x" * 40]
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "usher", "Assistant", " "]
    rows = []
    for conv in [None, *range(120)]:
        n = rng.choice([1, 2, 3, 5, 9, 14])
        rows += [(conv, rng.choice([None, k, k, k, k + 1, -k]), rng.choice(roles), rng.choice(texts)) for k in range(n)]
    return rows + [(5000, 1, "user", "Twice."), (5000, 1, "user", "Twice.")]


def test_cheapest_edits_equal_a_search_of_all(spark):
    rows = hostile()
    got = report(edits(damage(spark.createDataFrame(rows, TURNS).repartition(7)))).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_sql_says_the_same(spark):
    rows = hostile(4)
    got = sorted(map(tuple, report(edits(damage(spark.createDataFrame(rows, TURNS)))).collect()), key=repr)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(con.execute(OP13_SQL).fetchall(), key=repr) == got


def test_edits_are_whole_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Yes."), (1, 2, "user", "And?"), (1, 3, "user", "And?"), (2, 0, "user", "Hi.")]
    turns = spark.createDataFrame([(*r, None, "x") for r in rows], TURNS + ", gone boolean, fault string")
    got = [(r.conv_id, r.step, r.edit, r.role, r.text) for r in edits(turns).collect()]
    one = [g[2:] for g in sorted(got) if g[0] == 1]
    assert one == [("K", "system", "Be kind."), ("I", "user", ""), ("K", "assistant", "Yes."), ("K", "user", "And?"), ("D", "user", "And?"), ("I", "assistant", "")]
    assert [g[2:] for g in sorted(got) if g[0] == 2] == [("K", "user", "Hi."), ("I", "assistant", "")]


def test_long_conversation_and_empty_table(spark):
    rows = [(1, k, ("user", "assistant")[k % 3 == 1], f"Turn {k}{'.' * (k % 7 > 0)}") for k in range(30_000)] + [(2, 0, "user", "Hi.")]
    got = {r.conv_id: r for r in report(edits(damage(spark.createDataFrame(rows, TURNS)))).collect()}
    audit = got[1].audit
    live = len([r for r in plain_damage(rows) if r[0] == 1])
    assert len(audit.replace("I", "")) == live and (live - audit.count("D") + audit.count("I")) % 2 == 0
    assert report(edits(damage(spark.createDataFrame([], TURNS)))).collect() == []
