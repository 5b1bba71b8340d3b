"""Conversation repair against a search over all edits, conversations of many segments included."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib

import pytest

from graphloom.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, CONV_ID string, segment int, audit string"


def rows_of(n_conv: int, longest: int, seed: int = 1) -> list[tuple]:
    rng, out = random.Random(seed), []
    for c in range(n_conv):
        n = rng.randrange(longest + 1) if c else longest
        said = ["Yes.", "No?", "why not", "", " \t", "Go on!", "a. b", None] + [f"line {k}." for k in range(6)]
        for t in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if rng.random() < 0.35 else ("user", "assistant")[t % 2]
            turn = None if rng.random() < 0.05 else t + rng.choice([0, 0, 0, 0, 3])
            out.append((c if c != 3 else None, turn, role, rng.choice(said), "x", 7, "y"))
    return out + out[:2]


def plain_damage(rows):
    out = {}
    for c, t, role, text, *_ in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (c, t))
        fault = zlib.crc32(key.encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(ch for ch in text if ch not in ".!?")
        if fault == 4:
            role = "user"
        held = out.setdefault(c, [])
        held += [(t, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for c, held in out.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    return out


def cheapest(rows):
    """Least (cost, audit) by a best-first search over all edits: (cost, audit) grow along every path."""
    after = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    queue, done = [(0, "", 0, "E", ())], set()
    while queue:
        cost, audit, i, state, out = heapq.heappop(queue)
        if i == len(rows) and state in "EA":
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if (to := after.get((state, role[0]))) and len(out) <= 2 * len(rows) + 2:
                heapq.heappush(queue, (cost + 2, audit + "I", i, to, (*out, (role, ""))))
        if i == len(rows):
            continue
        role, text, must, cut = rows[i]
        heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state, out))
        if must:
            continue
        if to := after.get((state, role[:1])):
            heapq.heappush(queue, (cost + cut, audit + "K", i + 1, to, (*out, (role, text))))
        for new in ("user", "assistant"):
            if to := after.get((state, new[0])):
                heapq.heappush(queue, (cost + 2 + cut, audit + "R", i + 1, to, (*out, (new, text))))


def plain(rows):
    report = {}
    for c, held in plain_damage(rows).items():
        seen, counts, judged = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in held:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t for t, *_ in held if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        cost, audit, out = cheapest(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        report[c] = (gaps, *counts.values(), illegal, cost, audit, digest)
    return report


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize(("n", "longest", "partitions"), [(120, 9, 3), (6, 70, 5)])
def test_repair_equals_search_over_all_edits(spark, n, longest, partitions):
    rows = rows_of(n, longest)
    frame = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = turns.repair_damaged(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = plain(rows)
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.conv_id], r


def test_lost_conversations_and_empty_tables(spark):
    gone = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.", "x", 1, "y")], SCHEMA)
    (r,) = turns.repair_damaged(frame).collect()
    assert (r.cost, r.audit, r.gaps, r.repaired_sha256) == (0, "", 0, hashlib.sha256().hexdigest())
    assert turns.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "word. " * 300_000
    frame = spark.createDataFrame([(1, 1, "user", long, "x", 1, "y"), (1, 2, "assistant", "Yes.", "x", 1, "y")], SCHEMA)
    (r,) = turns.audits(frame).collect()
    assert (r.audit, r.cost) == ("KK", 0)
    assert r.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:Yes.".encode()).hexdigest()


def test_repaired_turns_follow_the_grammar(spark):
    frame = turns.damage(spark.createDataFrame(rows_of(12, 40, 5), SCHEMA))
    made = {}
    for r in turns.repaired_turns(frame).orderBy("conv_id", "place").collect():
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    hashes = {r.conv_id: r.repaired_sha256 for r in turns.audits(frame).collect()}
    for c, held in made.items():
        initials = "".join(role[0] for role, _ in held)
        assert initials.removeprefix("s") == "ua" * (len(initials) // 2)
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in held).encode()).hexdigest() == hashes[c]
