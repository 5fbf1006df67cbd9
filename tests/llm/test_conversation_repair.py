"""Conversation repair against a search over all edits, turn by turn."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from strideloom.llm import conversation_repair as repair

KIND = "conv_id long, turn long, role string, text string, audit string, n string"
BLANK = "[\x20\x09-\x0D]"
#: States of (s?(ua)+)? by what may come next.
STEP = {("start", "s"): "opened", ("start", "u"): "asked", ("opened", "u"): "asked", ("done", "u"): "asked", ("asked", "a"): "done"}


def damage(rows):
    out = []
    for c, t, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(c, t, role, text)] * (fate > 0) * (1 + (fate == 3))
    return out


def solve(rows):
    """Of one conversation's rows after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = re.sub(BLANK, "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]

    @lru_cache(None)
    def cheapest(i, state, added):
        """Best (cost, letters, roles) from row i on; at most two turns are inserted at one place."""
        ways = [(0, "", ())] if i == len(rows) and state in ("start", "done") else []

        def via(cost, letter, role, j, more):
            to = STEP.get((state, role[:1])) if role is not None else state
            rest = to and cheapest(j, to, more)
            if rest:
                ways.append((cost + rest[0], letter + rest[1], (role, *rest[2])))

        if added < 2:
            for role in ("user", "assistant"):
                via(2, "I", role, i, added + 1)
        if i < len(rows):
            via(3, "D", None, i + 1, 0)
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                via(more, "K", rows[i][2], i + 1, 0)
                for role in ("user", "assistant"):
                    via(2 + more, "R", role, i + 1, 0)
        return min(ways, key=lambda w: w[:2]) if ways else None

    cost, audit, roles = cheapest(0, "start", 0)
    lines, i = [], 0
    for letter, role in zip(audit, roles):
        if letter != "D":
            lines.append(f"{role}:{'' if letter == 'I' else rows[i][3]}")
        i += letter != "I"
    turns = {r[1] for r in rows if r[1] is not None}
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows):
    after = damage(rows)
    return {c: solve([r for r in after if r[0] == c]) for c in {r[0] for r in rows}}


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def run(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    return found(repair.repaired(repair.damaged(df), df.select("conv_id")))


def made(rng, convs, most):
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice([None, "", " \t", "Yes.", "No", "What? ", "x" * 3, f"Turn {t}!", f"é {c}.\n"])
            rows.append((c if c else None, rng.choice([t, t, t + 1, None]), role, text, "a", "n"))
    return rows


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(repair.op12_conversation_repair(spark, "/root/testdata/sf0.001")) == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    """Null ids, turns, roles and texts, other roles, ties of turns, repeated rows, other columns."""
    rows = made(random.Random(seed), 60, 9)
    assert run(spark, rows + rows[:20]) == brute(rows + rows[:20])


def test_long_conversations_over_many_tasks(spark, monkeypatch):
    """One conversation of most rows, cut into runs and joined in rounds, and one row repeated very often."""
    monkeypatch.setattr(repair, "RUN", 7)
    monkeypatch.setattr(repair, "FAN", 3)
    rng = random.Random(5)
    sys.setrecursionlimit(20_000)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Fine.", f"No {t}", f"Yes {t}."]), "a", "n") for t in range(400)]
    rows += [(2, 5, "user", "Again.", "a", "n")] * 300 + [(3, 1, "user", "x" * 100_000, "a", "n"), (3, 2, "assistant", "y." * 50_000, "a", "n")]
    assert run(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == {}
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    assert run(spark, [(gone, 1, "user", "Hi.", "a", "n")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_product_is_associative():
    rng = random.Random(1)
    for _ in range(50):
        a, b, c = ("".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(1, 6))) for _ in range(3))
        x, y, z = map(repair.product, (a, b, c))
        assert repair.times(repair.times(x, y), z) == repair.times(x, repair.times(y, z)) == repair.product(a + b + c)
