"""Cheapest edits that give a conversation a proper sequence of roles, by a min-plus product of matrices over its turns."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideloom.llm.common import BLANKS, shuffle_partitions, stage, table

#: Roles that follow the optional first one, and what a state goes to on a role's initial: states are nothing yet, after s, after u, after a.
ROLES = {"u": "user", "a": "assistant"}
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
STATES, ENDS = 4, (0, 3)
#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Turns of a run that one task multiplies before it hands the product on, products that one task joins, symbols whose product is remembered.
RUN, FAN, WORD = 4096, 32, 16
#: Repaired turns that are handed on at once.
TEXTS = 1024
LAWFUL = ("su", "ua", "au")

Matrix = tuple  # rows by columns of (cost, audit), or None where there is no way


def times(x: Matrix, y: Matrix) -> Matrix:
    """The min-plus product: the least (cost, audit) over the state between.

    A letter fixes the cost of its edit, so of two audits of a cell at equal cost none is the start of the other: the order of
    audits outlives what is put before or behind them, and the product is associative.
    """
    out = []
    for row in x:
        cells = []
        for j in range(STATES):
            ways = [(a[0] + y[k][j][0], a[1] + y[k][j][1]) for k, a in enumerate(row) if a is not None and y[k][j] is not None]
            cells.append(min(ways) if ways else None)
        out.append(tuple(cells))
    return tuple(out)


def plus(x: Matrix, y: Matrix) -> Matrix:
    return tuple(tuple(min((c for c in pair if c is not None), default=None) for pair in zip(*rows)) for rows in zip(x, y))


def edges(moves: dict[int, int], cost: int, letter: str) -> Matrix:
    return tuple(tuple((cost, letter) if moves.get(i) == j else None for j in range(STATES)) for i in range(STATES))


ONE = edges({i: i for i in range(STATES)}, 0, "")


def inserts() -> Matrix:
    """Any number of inserted turns: the closure, which STATES steps reach."""
    step = plus(ONE, plus(edges(NEXT["u"], INSERT, "I"), edges(NEXT["a"], INSERT, "I")))
    out = ONE
    for _ in range(STATES):
        out = times(out, step)
    return out


@lru_cache(None)
def turn(symbol: str) -> Matrix:
    """Inserts, then one turn. Symbols: x, to be deleted; an initial s, u or a, or o for others; in capitals if the turn is truncated."""
    own = edges({i: i for i in range(STATES)}, DELETE, "D")
    if symbol != "x":
        cut = CUT * symbol.isupper()
        own = plus(own, edges(NEXT.get(symbol.lower(), {}), cut, "K"))
        for k in ROLES:
            own = plus(own, edges(NEXT[k], REROLE + cut, "R"))
    return times(inserts(), own)


def product(symbols: str) -> Matrix:
    """Of a run of turns, as a balanced tree; products of short runs are remembered."""
    return _word(symbols) if len(symbols) <= WORD else times(product(symbols[: len(symbols) // 2]), product(symbols[len(symbols) // 2 :]))


@lru_cache(20_000)
def _word(symbols: str) -> Matrix:
    if len(symbols) < 2:
        return turn(symbols) if symbols else ONE
    return times(_word(symbols[: len(symbols) // 2]), _word(symbols[len(symbols) // 2 :]))


def best(whole: Matrix) -> tuple[int, str]:
    """Cost and audit of a conversation whose turns' product is ``whole``."""
    row = times(whole, inserts())[0]
    return min(row[j] for j in ENDS if row[j] is not None)


def joined(a: dict, b: dict) -> dict:
    """Two neighbouring runs of a conversation as one: counts add up, what lies between them is seen now."""
    out = {c: a[c] + b[c] for c in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += a["last"] + b["first"] not in LAWFUL
    seen = a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out |= {"turns": a["turns"] + b["turns"] - seen, "first": a["first"], "last": b["last"]}
    out |= {"first_turn": b["first_turn"] if a["first_turn"] is None else a["first_turn"], "last_turn": a["last_turn"] if b["last_turn"] is None else b["last_turn"]}
    return out | {"cells": pack(times(unpack(a["cells"]), unpack(b["cells"])))}


def pack(m: Matrix) -> list[dict | None]:
    return [None if c is None else {"cost": c[0], "audit": c[1]} for row in m for c in row]


def unpack(cells: list[dict | None]) -> Matrix:
    flat = [None if c is None else (c["cost"], c["audit"]) for c in cells]
    return tuple(tuple(flat[i * STATES : (i + 1) * STATES]) for i in range(STATES))


RUNS = ("at long, blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, first_turn long, last_turn long, "
        "cells array<struct<cost:long,audit:string>>")
ORDER = ["turn", "role", "text"]


def marked(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) as (conv_id, turn, role, text, n, blank, cut, fresh): a row for each distinct turn, n as often as it is there.

    ``fresh``: no earlier turn of the conversation has its role and text. Rows alike are counted before they move, and the
    first place of a role and text is a partial aggregate joined back by that place, so a hot conversation or text does not meet in a task.
    """
    t = rows.groupBy("conv_id", *ORDER).agg(F.count(F.lit(1)).alias("n"))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    t = t.select("*", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(*".!?")).alias("cut"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    t = stage(t, "turns")
    same = ["conv_id", "role", "h1", "h2"]
    first = t.groupBy(*same).agg(F.when(F.count(F.lit(1)) == F.count("turn"), F.min("turn")).alias("turn"))  # null, if there, is first
    first = first.select(*(F.col(c).alias(f"_{c}") for c in [*same, "turn"]))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*same, "turn"]]
    return t.join(first, on, "left").select("conv_id", *ORDER, "n", "blank", "cut", F.col("_h1").isNotNull().alias("fresh"))


def symbol() -> Column:
    first = F.substring("role", 1, 1)
    kind = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    return F.when(F.col("blank") | ~F.col("fresh"), "x").when(F.col("cut"), F.upper(kind)).otherwise(kind)


def _schema(conv: pa.DataType) -> pa.Schema:
    cells = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
    longs = [(c, pa.int64()) for c in ("at", "blank", "duplicate", "truncated", "illegal", "turns")]
    return pa.schema([("conv_id", conv), *longs, ("first", pa.string()), ("last", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("cells", cells)])


def _run(turns: list[tuple]) -> dict:
    """A run of turns (turn, initial, symbol, blank, fresh, cut), in their order, as one row."""
    out = {"blank": sum(t[3] for t in turns), "duplicate": sum(not t[3] and not t[4] for t in turns), "truncated": sum(not t[3] and t[4] and t[5] for t in turns),
           "illegal": sum(a[1] + b[1] not in LAWFUL for a, b in zip(turns, turns[1:])), "first": turns[0][1], "last": turns[-1][1]}
    numbers = [t[0] for t in turns if t[0] is not None]
    out |= {"turns": len(set(numbers)), "first_turn": numbers[0] if numbers else None, "last_turn": numbers[-1] if numbers else None}
    return out | {"cells": pack(product("".join(t[2] for t in turns)))}


def _runs(batches):
    """Sorted turns of one range to runs of at most RUN turns of one conversation each, numbered in their order."""
    conv, held, done, schema, place = None, [], [], None, 0

    def end():
        nonlocal held, place
        done.append(_run(held) | {"conv_id": conv, "at": place})
        held, place = [], place + 1

    for b in batches:
        schema = schema or _schema(b.schema.field("conv_id").type)
        for c, t, initial, sym, blank, fresh, cut, n, part in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "symbol", "blank", "fresh", "cut", "n", "part"))):
            if held and c != conv:
                end()
            conv, place = c, max(place, part << 32)
            for i in range(n):  # copies after the first are duplicates
                held.append((t, initial, "x" if i else sym, blank, fresh and not i, cut))
                if len(held) == RUN:
                    end()
        yield pa.RecordBatch.from_pylist(done, schema)
        done.clear()
    if held:
        end()
        yield pa.RecordBatch.from_pylist(done, schema)


def _join_runs(t: pa.Table) -> pa.Table:
    """FAN neighbouring runs of one conversation, or fewer, as one."""
    runs = sorted(t.to_pylist(), key=lambda r: r["at"])
    while len(runs) > 1:
        runs = [runs[i] if i + 1 == len(runs) else runs[i] | joined(runs[i], runs[i + 1]) for i in range(0, len(runs), 2)]
    return pa.Table.from_pylist([runs[0] | {"at": runs[0]["at"] // FAN}], _schema(t.schema.field("conv_id").type))


def _solved(batches):
    """Products of whole conversations to cost and audit."""
    for b in batches:
        ways = [best(unpack(c)) for c in b.column("cells").to_pylist()]
        own = b.drop_columns(["cells"])
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array([w[0] for w in ways], pa.int64()), pa.array([w[1] for w in ways], pa.string())], [*own.schema.names, "cost", "audit"])


def reduced(turns: DataFrame) -> DataFrame:
    """marked turns to a row for each conversation: conv_id and the columns of RUNS.

    Turns are sorted by range, so that a long conversation lies in many tasks; each task makes products of runs of its own, and rounds that
    join up to FAN neighbours follow for the conversations that have several, until each has one.
    """
    kind = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {RUNS}"
    order = [F.col("conv_id"), *(F.col(c) for c in ORDER)]
    t = turns.withColumns({"initial": F.substring("role", 1, 1), "symbol": symbol()})
    t = t.repartitionByRange(shuffle_partitions(t.sparkSession), *order).sortWithinPartitions(*order)
    t = t.select("conv_id", "turn", "initial", "symbol", "blank", "fresh", "cut", "n", F.spark_partition_id().cast("long").alias("part"))
    runs = stage(t.mapInArrow(_runs, kind), "runs")
    several = runs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    alone = runs.join(several, same(runs, several), "left_anti")
    # places from 0 within a conversation: a row for each RUN turns, without its audits
    places = runs.join(several, same(runs, several), "left_semi").select(F.col("conv_id").alias("_conv"), F.col("at").alias("_at"))
    places = places.withColumn("place", (F.row_number().over(Window.partitionBy("_conv").orderBy("_at")) - 1).cast("long"))
    many = runs.join(places, runs["conv_id"].eqNullSafe(places["_conv"]) & (runs["at"] == places["_at"])).withColumn("at", F.col("place")).select(*runs.columns)
    many = stage(many, "many")
    while (last := many.agg(F.max("at")).first()[0]) is not None and last > 0:
        many = stage(many.groupBy("conv_id", F.floor(F.col("at") / FAN)).applyInArrow(_join_runs, kind), "many")
    return alone.unionByName(many)


def _repaired(batches):
    """Turns sorted by conversation, each conversation's audit before them, to the turns after the edits: (conv_id, place, role, text)."""
    out: list[tuple] = []
    conv = audit = None
    at, state, place = 0, 0, 0

    def edit(letter, role=None, text=""):
        nonlocal state, place
        if letter == "D":
            return
        if letter != "K":  # one role alone is lawful in each state
            role = ROLES["a" if state == 2 else "u"]
        state = NEXT[role[0]][state]
        out.append((conv, place, role, text))
        place += 1

    def added():
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            edit("I")

    for b in batches:
        names, kind = ["conv_id", "place", "role", "text"], b.schema.field("conv_id").type
        schema = pa.schema(list(zip(names, (kind, pa.int64(), pa.string(), pa.string()))))
        for c, given, role, text, n in zip(*(b.column(x).to_pylist() for x in ("conv_id", "audit", "role", "text", "n"))):
            if given is not None:
                if audit is not None:
                    added()
                conv, audit, at, state, place = c, given, 0, 0, 0
                continue
            for _ in range(n):
                added()
                edit(audit[at], role, text)
                at += 1
            if len(out) >= TEXTS:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), schema.types)], schema=schema)
                out.clear()
    if audit is not None:
        added()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), schema.types)], schema=schema)


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of every conversation after the edits of ``audits`` (conv_id, audit); turns as marked gives them.

    A conversation's rows pass one task in order, as a digest of them must see them, but as a stream: what is held is its audit.
    """
    one = audits.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"))
    rows = one.unionByName(turns.select("conv_id", F.lit(None).cast("string").alias("audit"), *ORDER, "n"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *ORDER)
    return rows.mapInArrow(_repaired, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, place long, role string, text string")


def _digested(batches):
    """SHA-256 of role:text, joined by newlines, of each conversation; its rows follow each other."""
    conv, digest, schema = None, None, None
    for b in batches:
        schema = pa.schema([("conv_id", b.schema.field("conv_id").type), ("repaired_sha256", pa.string())])
        done = []
        for c, place, role, text in zip(*(x.to_pylist() for x in b.columns)):
            if place == 0:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), schema.types)], schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], schema.types[0]), pa.array([digest.hexdigest()])], schema=schema)


def repaired(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each of ``convs`` (conv_id): its turns' faults among ``rows`` (conv_id, turn, role, text), the cheapest repair and its digest.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. Turns go by number, nulls first, then by role
    and text; rows alike are adjacent. Null role or text count as one space, null ids are a conversation; an initial is the first character of
    a role, whatever follows. A conversation without rows has zeros, an empty audit and the digest of nothing; no conversations give no rows.
    Other columns do not matter.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    turns = stage(marked(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))), "marked")
    runs = reduced(turns)
    t = stage(runs.mapInArrow(_solved, f"conv_id {kind}, {RUNS.split(', cells')[0]}, cost long, audit string"), "repairs")
    digests = repaired_turns(turns, t.select("conv_id", "audit")).mapInArrow(_digested, f"conv_id {kind}, repaired_sha256 string")
    id_ = F.col("conv_id")
    for name, right in (("_t", t), ("_d", digests)):
        right = right.withColumnRenamed("conv_id", name)
        convs = convs.select("conv_id").distinct() if name == "_t" else convs
        convs = convs.join(right, id_.eqNullSafe(F.col(name)), "left").drop(name)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return convs.select(
        "conv_id", zero(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).alias("gaps"),
        *(zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of conv_id:turn modulo 20: a row dropped, emptied, without its .!?, repeated, or said by the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    t = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("_fate")).filter("_fate <> 0")
    t = t.withColumns({"text": F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
                       "role": F.when(F.col("_fate") == 4, "user").otherwise(F.col("role"))})
    return t.withColumn("_copy", F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_fate", "_copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repaired(damaged(rows), rows.select("conv_id"))
