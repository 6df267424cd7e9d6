"""Repair of damaged conversations by a dynamic programme over the turns that stay.

The repaired roles are empty, or an optional system turn and then user and assistant in turns.  A turn is kept, given
another role or deleted, and empty turns may be inserted.  What follows a kept turn depends on its role alone: the next
turn that stays, priced by the deletions between the two (differences of running sums), the inserts that their pair of roles
asks for, and that turn's own price.  Read from the end, a running minimum for each role holds the best next
turn; of equally cheap ones the farthest, then the one with more inserts, then a kept one, which makes the edits' letters
the least in ASCII order.  Every turn gets the next one for each role that it may have; a walk from the start follows them.
Both passes stream over a conversation's sorted turns and hold a few numbers, however many turns it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import small_batches

BLANKS = " \t\n\x0b\f\r"
#: Prices of the edits, and of a turn that stays truncated.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Roles, and states: before the first turn, after a turn of each role.
SYSTEM, USER, ASSISTANT, END = range(4)
START = 3
NAMES = ("system", "user", "assistant")
#: Inserts between a state (system, user, assistant, start) and the next role or the end; None where the pair can't be.
GAPS = ((None, 0, 1, 2), (None, 1, 0, 1), (None, 0, 1, 0), (0, 0, 1, 0))


def faults(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, gone), all of a conversation in one partition, with ``nth`` (of equal role and text) and
    ``fault``: blank, duplicate or truncated, the first that holds, else null."""
    same = Window.partitionBy("conv_id", "gone", "role", F.md5(F.col("text").cast("binary"))).orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    return turns.withColumn("nth", F.row_number().over(same)).withColumn("fault", F.when(~F.col("gone"), fault))


def _next(state: int, gap: int, best: list) -> tuple[int, int]:
    """Price from ``state`` to the end, with ``gap`` to delete all turns to come, and the next turn that stays as 4 (k + 1) + role."""
    key, to = (gap + INSERT * GAPS[state][END], -1, 0, 0), END
    for role in (SYSTEM, USER, ASSISTANT):
        inserts = GAPS[state][role]
        if inserts is not None and best[role] is not None:
            price, k, reroled = best[role]
            found = (price + gap + INSERT * inserts, k, -inserts, reroled)
            if found < key:
                key, to = found, role
    return key[0], 4 * (key[1] + 1) + to


def _from_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns from last to first: ``k`` counts from the end; ``system``, ``user``, ``assistant``, ``start`` say what stays next."""
    last, k, gap, best = object(), 0, 0, [None] * 3
    for batch in batches:
        out: list[list[int]] = [[] for _ in range(5)]
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "gone", "initial", "fault"))
        for conv, gone, initial, fault in zip(*columns, strict=True):
            if conv != last:
                last, k, gap, best = conv, 0, 0, [None] * 3
            if gone:
                for column in out:
                    column.append(-1)
                continue
            after = [_next(state, gap, best) for state in (SYSTEM, USER, ASSISTANT)]
            gap += DELETE
            if fault not in ("blank", "duplicate"):
                for role in (SYSTEM, USER, ASSISTANT):
                    kept = initial == NAMES[role][0]
                    if kept or role != SYSTEM:
                        price = (KEEP if kept else REROLE) + (TRUNCATED if fault else 0) + after[role][0] - gap
                        if best[role] is None or price < best[role][0]:
                            best[role] = (price, k, not kept)
            for column, value in zip(out, (k, *(to for _, to in after), _next(START, gap, best)[1]), strict=True):
                column.append(value)
            k += 1
        names = [*batch.schema.names, "k", *NAMES, "start"]
        yield pa.record_batch([*batch.columns, *(pa.array(c, pa.int64()) for c in out)], names)


def _from_the_start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns from first to last, as edits."""
    last, begun, live, state, to, step = None, False, False, START, 0, 0
    for batch in batches:
        convs = batch.column("conv_id").to_pylist()
        keys = [batch.column(n).to_pylist() for n in ("gone", "k", "initial", "fault", *NAMES, "start")]
        at, ids, steps, letters, roles, prices = [], [], [], [], [], []

        def add(conv, row, letter, role, price):
            nonlocal step
            for column, value in zip((at, ids, steps, letters, roles, prices), (row, conv, step, letter, role, price), strict=True):
                column.append(value)
            step += 1

        def insert(conv, role):
            nonlocal state
            for _ in range(GAPS[state][role]):
                state = ASSISTANT if state == USER else USER
                add(conv, None, "I", NAMES[state], INSERT)

        for row, (conv, gone, k, initial, fault, *ways, start) in enumerate(zip(convs, *keys, strict=True)):
            if not begun or conv != last:
                if begun and not live:
                    add(last, None, None, None, None)
                last, begun, live, state, step = conv, True, False, START, 0
            if gone:
                continue
            if not live:
                live, to = True, start
            if to == 4 * (k + 1) + (role := to % 4) and role != END:
                insert(conv, role)
                kept = initial == NAMES[role][0]
                add(conv, row, "K" if kept else "R", None if kept else NAMES[role], (KEEP if kept else REROLE) + (TRUNCATED if fault else 0))
                state, to = role, ways[role]
            else:
                add(conv, row, "D", None, DELETE)
            if k == 0:
                insert(conv, END)
        yield _edits(batch, at, ids, steps, letters, roles, prices)
    if begun and not live:
        yield _edits(batch, [None], [last], [0], [None], [None], [None])


def _edits(batch, at, ids, steps, letters, roles, prices) -> pa.RecordBatch:
    rows = pa.array(at, pa.int64())
    was, letter = batch.column("role").take(rows), pa.array(letters, pa.string())
    role = pa.compute.coalesce(pa.array(roles, pa.string()), was)
    text = batch.column("text").take(rows)
    text = pa.compute.if_else(pa.compute.equal(letter, "I"), "", text)
    columns = [pa.array(ids, batch.schema.field("conv_id").type), pa.array(steps, pa.int64()), letter, batch.column("turn").take(rows), was, role, text]
    return pa.record_batch([*columns, batch.column("fault").take(rows), pa.array(prices, pa.int64())], ["conv_id", "step", "edit", "turn", "was", "role", "text", "fault", "cost"])


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20: (conv_id, turn, role, text, gone); a dropped turn stays as
    a mark without role and text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    gone = F.col("kind") == 0
    once = rows.select("conv_id", "turn", F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), gone.alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return once.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "time")


def edits(turns: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation of ``turns`` (conv_id, turn, role, text, and if there is one ``gone``, true for marks of lost turns), in
    order: conv_id, step, edit (K, R, D, I), turn, was (the role before), role, text, fault, cost.  Dropping the rows with edit D
    leaves the repaired conversation.

    Turns stand by ``turn`` (nulls first), then role and text; repeated rows are turns of their own, the second a duplicate.  Null
    roles and texts count as one space; a null conv_id is a conversation; one without turns but marks gives a single row
    without edit; further columns are left out; an empty table gives an empty result."""
    small_batches(turns.sparkSession)
    gone = F.coalesce("gone", F.lit(False)) if "gone" in turns.columns else F.lit(False)
    said = [F.when(~gone, F.coalesce(F.col(c), F.lit(" "))).alias(c) for c in ("role", "text")]
    # one exchange: a conversation's edits and their digest are one sequence each
    rows = faults(turns.select("conv_id", "turn", *said, gone.alias("gone")).repartition("conv_id")).withColumn("initial", F.substring("role", 1, 1))
    order = [F.col("conv_id").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in ("turn", "role", "text", "nth")]]
    back = [F.col("conv_id").asc_nulls_first(), *[F.col(c).desc_nulls_last() for c in ("turn", "role", "text", "nth")]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", k long, system long, user long, assistant long, start long"
    priced = rows.sortWithinPartitions(*back).mapInArrow(_from_the_end, schema)
    kind = dict(turns.dtypes)
    made = f"conv_id {kind['conv_id']}, step long, edit string, turn {kind['turn']}, was string, role string, text string, fault string, cost long"
    return priced.sortWithinPartitions(*order).mapInArrow(_from_the_start, made)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    state, last = None, None

    def row():
        counts, turns, audit, sha = state["counts"], state["turns"], state["audit"], state["sha"]
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        return (last, gaps, counts["blank"], counts["duplicate"], counts["truncated"], state["illegal"], state["cost"], audit.decode(), sha.hexdigest())

    def batch_of(done, kind):
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.record_batch([pa.array([r[c] for r in done], kinds[c]) for c in range(len(schema))], schema)

    kind = None
    for batch in batches:
        done, kind = [], batch.schema.field("conv_id").type
        for r in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "edit", "turn", "was", "role", "text", "fault", "cost")), strict=True):
            conv, edit, turn, was, role, text, fault, cost = r
            if state is None or conv != last:
                if state is not None:
                    done.append(row())
                state, last = {"counts": {"blank": 0, "duplicate": 0, "truncated": 0}, "turns": None, "audit": bytearray(), "sha": hashlib.sha256(), "illegal": 0, "cost": 0, "initial": None, "written": False}, conv
            if edit is None:
                continue
            state["audit"] += edit.encode()
            state["cost"] += cost
            if edit != "I":
                if fault:
                    state["counts"][fault] += 1
                if turn is not None:
                    seen = state["turns"]  # (least, latest, distinct): turns ascend
                    state["turns"] = (turn, turn, 1) if seen is None else (seen[0], turn, seen[2] + (turn != seen[1]))
                if state["initial"] is not None and state["initial"] + was[:1] not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["initial"] = was[:1]
            if edit != "D":
                state["sha"].update(("\n" if state["written"] else "").encode() + f"{role}:{text}".encode())
                state["written"] = True
        yield batch_of(done, kind)
    if state is not None:
        yield batch_of([row()], kind)


def report(made: DataFrame) -> DataFrame:
    """A row for each conversation of :func:`edits`, whose rows are read in their own order: gaps in the turns, faults, pairs of
    roles that may not meet, the edits' price and letters, and a hash of the repaired conversation."""
    kind = dict(made.dtypes)["conv_id"]
    return made.mapInArrow(_digest, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
