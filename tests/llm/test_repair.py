"""Conversation repair against a search through all edits, and end to end against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelloom.llm import repair


def best(turns):
    """(cost, audit, output) by cost, then audit, over every edit: turns are (role, text, fault)."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, roles, out = heapq.heappop(queue)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(out)
        if (i, roles) in done or not re.fullmatch("s?(ua)*u?", roles) or len(roles) > 2 * len(turns) + 2:
            continue
        done.add((i, roles))
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 3, audit + "I", i, roles + role[0], (*out, f"{role}:")))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                heapq.heappush(queue, (cost + extra, audit + "K", i + 1, roles + (role[:1] or "?"), (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 3 + extra, audit + "R", i + 1, roles + new[0], (*out, f"{new}:{text}")))


def symbol(role, fault):
    return {"u": 0, "a": 1, "s": 2}.get(role[:1], 3) + 4 * ["", "blank", "duplicate", "truncated"].index(fault)


@pytest.mark.parametrize("seed", range(6))
def test_cheapest_equals_a_search_through_all_edits(seed):
    rng = random.Random(seed)
    for _ in range(250):
        turns = [(rng.choice(["user", "assistant"] * 4 + ["system", "tool", ""]), "t", rng.choice([""] * 4 + ["blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 7))]
        symbols = bytes(symbol(r, f) for r, _, f in turns)
        cost, audit, _ = best(turns)
        assert repair.cheapest(symbols) == (cost, audit)
        bounds = repair.suffix_bounds(symbols)
        assert bounds[0][0] <= cost


def test_long_conversations_stay_linear():
    rng = random.Random(1)
    turns = bytes(rng.choice([0, 1, 0, 1, 2, 3, 4, 9, 12, 13]) for _ in range(20_000))
    cost, audit = repair.cheapest(turns)
    assert sum(c in "DKR" for c in audit) == len(turns) and cost > 0
    assert repair.cheapest(b"") == (0, "") and repair.cheapest(bytes([2])) == (4, "D")
    assert repair.cheapest(bytes([2, 0, 1])) == (0, "KKK") and repair.cheapest(bytes([0])) == (3, "KI")


def plain(rows):
    """{conv_id: line} straight from the rules."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = convs.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), k, text) for k in range(1 + (kind == 3))]
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: r[:5])
        seen, turns = set(), []
        for _, _, role, _, _, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = {r[1] for r in own if r[0]}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        faults = [f for _, _, f in turns]
        initials = [r[:1] for r, _, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = best(turns)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, position int, audit string, digest string"


def odd_rows():
    rng = random.Random(3)
    texts = ["Yes.", "no", "Why?\n", " ", "", None, " ", "same text.", "same text.", "é!", "long " * 100_000 + "."]
    roles = ["user", "assistant"] * 5 + ["system", "tool", None, "", "User"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 1]), rng.choice(roles), rng.choice(texts[:10])))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello."), (77, 0, "user", texts[-1]), (77, 1, "assistant", texts[-1])]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "I go.")] + rows[:5]


def test_whole_operator_equals_the_rules(spark):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)
    found, ordered = repair.repair(repair.damaged(frame))
    got = {r[0]: tuple(r[1:]) for r in repair.with_digests(found, ordered).collect()}
    want = plain(rows)
    assert got == want and sum(line[-2] == "" for line in want.values()) >= 1
    kept = ordered.filter(F.col("edit") == "I").select("text").distinct().collect()
    assert [r["text"] for r in kept] == [""]


def test_conversations_over_many_batches(spark):
    """Arrow batches of a few rows: conversations go on from one to the next."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for c in range(12) for t in range(25)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        frame = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string")
        got = {r[0]: tuple(r[1:]) for r in repair.with_digests(*repair.repair(repair.damaged(frame))).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {conv: line for conv, line in plain_long(rows).items()}


def plain_long(rows):
    """As `plain`, with the library's search: conversations are too long for the other."""
    global best
    slow = best

    def fast(turns):
        cost, audit = repair.cheapest(bytes(symbol(r, f) for r, _, f in turns))
        lines, at, last = [], 0, "a"
        for letter in audit:
            due = "assistant" if last == "u" else "user"
            if letter == "I":
                lines.append(f"{due}:")
            else:
                role, text, _ = turns[at]
                at += 1
                if letter == "D":
                    continue
                due = role if letter == "K" else due
                lines.append(f"{due}:{text}")
            last = "u" if due[0] == "u" else "a"
        return cost, audit, lines

    best = fast
    try:
        return plain(rows)
    finally:
        best = slow


def test_no_rows(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.with_digests(*repair.repair(repair.damaged(frame))).count() == 0
