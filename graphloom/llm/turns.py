"""Conversation repair: turns aligned to every feasible length of an alternating grammar, whole audits compared.

A repaired conversation has role initials ``(s?(ua)+)?``. Rows are kept (K), given another role (R), deleted (D)
or joined by inserted empty turns (I). For each target string the grammar allows, a Wagner-Fischer table is
filled inside an Ukkonen band that the best cost known so far leaves open; its audit is read off in order of
letters, and the cheapest, then least, audit of all targets wins.

A conversation of any size is cut into short segments. A segment is aligned between all states that the grammar
can be in at its ends, and insertions after its last row belong to the next segment. No audit of a segment
is then the beginning of another, so the least audits of segments put together are the least of the whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import select, stored

#: Costs of the edits; a row kept or given another role costs one more if it is truncated.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Rows that are aligned at once; longer conversations are put together from such segments.
SEGMENT_ROWS = 16
#: States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_NAMES = {"u": "user", "a": "assistant"}
_BLANKS = "".join(map(chr, [32, 9, 10, 11, 12, 13]))
_FAR = 1 << 60


# ------------------------------------------------------------------ damage


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that crc32(``conv_id:turn``) % 20 calls for.

    0 drops a row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats it, 4 makes its role user. Nulls of
    role and text, and of the ids inside the hashed key, count as one space. Other columns are left out.
    """
    rows = select(conversations, "conv_id", "turn", "role", "text")
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


# ------------------------------------------------------------------ alignment


def _shift(d: int) -> int:
    """Least cost of a target ``d`` turns longer than its rows."""
    return INSERT * d if d >= 0 else -DELETE * d


@lru_cache(maxsize=4096)
def _targets(start: int, length: int) -> tuple[tuple[str, int], ...]:
    """The target strings of a length that the grammar allows from a state, and the states they end in."""
    out = []
    for system in (False, True) if start == EMPTY and length else (False,):
        turns = length - system
        first = "a" if start == USER else "u"
        other = "u" if first == "a" else "a"
        body = ((first + other) * (turns // 2 + 1))[:turns]
        if turns:
            end = USER if body[-1] == "u" else ASSISTANT
        else:
            end = SYSTEM if system else start
        out.append(("s" * system + body, end))
    return tuple(out)


def align(rows: list[tuple[str, bool, bool]], target: str, limit: int, inserts_last: bool = True) -> tuple[int, str] | None:
    """Cost and least audit of rows (initial, must go, truncated) against one target, or None above ``limit``.

    Cells farther off the diagonal than ``limit`` can pay for are not filled.
    """
    n, m = len(rows), len(target)
    if _shift(m - n) > limit:
        return None
    low = high = m - n if m < n else 0
    while _shift(low - 1) + _shift(m - n - low + 1) <= limit and low > -n:
        low -= 1
    high = max(0, m - n)
    while _shift(high + 1) + _shift(m - n - high - 1) <= limit and high < m:
        high += 1
    cost = [[_FAR] * (m + 2) for _ in range(n + 1)]
    end = cost[n]
    end[m] = 0
    if inserts_last:
        for j in range(m - 1, max(0, n + low) - 1, -1):
            if target[j] == "s":
                break
            end[j] = end[j + 1] + INSERT
    for i in range(n - 1, -1, -1):
        initial, goes, cut = rows[i]
        here, below = cost[i], cost[i + 1]
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            best = below[j] + DELETE
            if j < m:
                t = target[j]
                if t != "s" and here[j + 1] + INSERT < best:
                    best = here[j + 1] + INSERT
                if not goes and (t == initial or t != "s"):
                    taken = below[j + 1] + (0 if t == initial else REROLE) + (TRUNCATED if cut else 0)
                    if taken < best:
                        best = taken
            here[j] = best
    if cost[0][0] > limit:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        c = cost[i][j]
        t = target[j] if j < m else ""
        if i < n and cost[i + 1][j] + DELETE == c:
            audit.append("D")
            i += 1
        elif t in ("u", "a") and t and cost[i][j + 1] + INSERT == c:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if rows[i][0] == t else "R")
            i, j = i + 1, j + 1
    return cost[0][0], "".join(audit)


def solve(rows: list[tuple[str, bool, bool]], start: int, ends: tuple[int, ...], inserts_last: bool = True) -> tuple[int, str]:
    """Cheapest, then least, audit from a state to any of the end states.

    Targets are tried by the least they can cost, which follows from their length; once that is above the best
    cost known, no other is aligned. Deleting all rows and inserting two turns at most is always possible, so
    no longer target than that pays for is listed.
    """
    n = len(rows)
    stay = n - sum(goes for _, goes, _ in rows)
    listed = []
    for length in range(5 * n // 2 + 3):
        bound = DELETE * (n - stay) + _shift(length - stay)
        listed += [(bound, target) for target, end in _targets(start, length) if end in ends]
    found: tuple[int, str] | None = None
    for bound, target in sorted(listed):
        if found is not None and bound > found[0]:
            break
        one = align(rows, target, found[0] if found else DELETE * n + INSERT * len(target), inserts_last)
        if one is not None and (found is None or one < found):
            found = one
    return found or (_FAR, "")


def best(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return solve(rows, EMPTY, (EMPTY, ASSISTANT))


def repaired(rows: list[tuple[str, str]], audit: str, state: int = EMPTY) -> tuple[list[tuple[str, str]], int]:
    """Turns (role, text) that an audit makes of rows (role, text) from a state on, and the state after them."""
    out, at = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            state = SYSTEM
        else:
            wanted = "a" if state == USER else "u"
            state = USER if wanted == "u" else ASSISTANT
            role = role if edit == "K" else _NAMES[wanted]
        out.append((role, text))
    return out, state


# ------------------------------------------------------------------ segments

_COUNTS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns")
_SEGMENT = (
    "segment string, first boolean, last boolean, role0 string, key0 string, turn0 long, seq long, "
    + ", ".join(f"{c} long" for c in _COUNTS)
    + ", low long, high long, head string, tail string, ways array<struct<start:int,end:int,final:boolean,cost:long,audit:string>>, "
    "roles array<string>, texts array<string>"
)


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with their faults, cut by ranges of (conv_id, turn, role, text): a large conversation is in many partitions."""
    trimmed = F.rtrim("text", F.lit(_BLANKS))
    keyed = select(rows, "conv_id", "turn", "role", "text").select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    keyed = keyed.withColumns({
        "key": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")),
        "blank": trimmed == "",
        "cut": ~F.substring(trimmed, -1, 1).isin(".", "!", "?"),
    })
    # Turns at which a role and text of a conversation was first said, where it was said more than once.
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = (
        keyed.filter(~F.col("blank")).groupBy("conv_id", "key").agg(F.min(order).alias("said"), F.count(F.lit(1)).alias("times"))
        .filter("times > 1").select(F.col("conv_id").alias("conv"), F.col("key").alias("same"), "said")
    )
    told = keyed.join(again, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("key") == F.col("same")), "left")
    told = told.withColumn("seen", F.coalesce(order > F.col("said"), F.lit(False))).drop("conv", "same", "said")
    order_by = ["conv_id", "turn", "role", "key"]
    return told.repartitionByRange(*order_by).sortWithinPartitions(*order_by)


def _segment(rows: list[dict], seq: int, first: bool | None, last: bool | None) -> dict:
    """One segment's faults and ways through it. ``first`` and ``last``: whether it begins and ends its conversation (None: not known)."""
    initials = [r["role"][:1] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    plain = [(i, r["blank"] or r["seen"], r["cut"]) for i, r in zip(initials, rows)]
    ways = []
    for final in (False, True):
        if (final and last is False) or (not final and last):
            continue
        for start in (EMPTY,) if first else range(4):
            ends = (EMPTY, ASSISTANT) if final else range(4)
            ends = [e for e in ends if e >= USER or e == start or (start == EMPTY and e == SYSTEM)]
            # Nothing but the cheaper end counts where the whole conversation is here.
            for group in [tuple(ends)] if first and last else [(e,) for e in ends]:
                cost, audit = solve(plain, start, group, final)
                if cost < _FAR:
                    ways.append({"start": start, "end": group[0], "final": final, "cost": cost, "audit": audit})
    return {
        "segment": uuid.uuid4().hex, "first": first, "last": last,
        "role0": rows[0]["role"], "key0": rows[0]["key"], "turn0": rows[0]["turn"], "seq": seq, "n_rows": len(rows),
        "blank": sum(r["blank"] for r in rows),
        "duplicate": sum(r["seen"] and not r["blank"] for r in rows),
        "truncated": sum(r["cut"] and not r["blank"] and not r["seen"] for r in rows),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None),
        "head": initials[0], "tail": initials[-1], "ways": ways,
        "roles": [r["role"] for r in rows], "texts": [r["text"] for r in rows],
    }


def segments(rows: DataFrame) -> DataFrame:
    """One row per segment with its faults, its rows and the ways through it, stored.

    A conversation that lies inside one partition and has at most ``SEGMENT_ROWS`` rows is one segment with
    ``first`` and ``last`` both true and a single way for each end.
    """
    ordered = _ordered(rows)
    kind = ordered.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, seq, seen_any, before = None, [], 0, False, None
        opened: bool | None = None  # None: the partition may begin inside this conversation
        out, schema = [], None

        def close(last: bool | None) -> None:
            nonlocal held, seq, opened
            out.append({"conv_id": conv, **_segment(held, seq, opened, last)})
            held, seq, opened = [], seq + 1, False

        def ready() -> pa.RecordBatch:
            nonlocal out
            batch, out = pa.RecordBatch.from_pylist(out, schema=schema), []
            return batch

        for batch in batches:
            if schema is None:
                schema = _arrow(batch.schema.field("conv_id").type)
            for low in range(0, batch.num_rows, 256):
                for r in batch.slice(low, 256).to_pylist():
                    if not seen_any or r["conv_id"] != conv:
                        if held:
                            close(True)
                        opened, conv, before = (True if seen_any else None), r["conv_id"], None
                        seen_any = True
                    elif len(held) >= SEGMENT_ROWS:
                        close(False)
                    # Equal rows of one turn stand side by side and in one partition.
                    r["seen"] = r["seen"] or (not r["blank"] and before == (r["turn"], r["key"]))
                    before = (r["turn"], r["key"])
                    held.append(r)
                if out:
                    yield ready()
        if held:
            close(None)  # the next partition may go on with this conversation
            yield ready()

    return stored(ordered.mapInArrow(run, f"conv_id {kind.simpleString()}, {_SEGMENT}"), "segments")


def _arrow(conv_id: pa.DataType) -> pa.Schema:
    way = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("final", pa.bool_()), ("cost", pa.int64()), ("audit", pa.string())])
    counts = [(c, pa.int64()) for c in _COUNTS]
    return pa.schema([
        ("conv_id", conv_id), ("segment", pa.string()), ("first", pa.bool_()), ("last", pa.bool_()),
        ("role0", pa.string()), ("key0", pa.string()), ("turn0", pa.int64()), ("seq", pa.int64()), *counts,
        ("low", pa.int64()), ("high", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
        ("ways", pa.list_(way)), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ])


_PLACE = ("turn0", "role0", "key0", "seq")
_WHOLE = (
    "blank long, duplicate long, truncated long, illegal long, n_rows long, gaps long, cost long, audit string, "
    "shares array<struct<segment:string,share:string,start:int>>"
)


def _composed(parts: DataFrame) -> DataFrame:
    """Per segment its share of the least audit (``share``, ``start``), beside the totals of its conversation.

    What is gathered for a conversation is its ways, some twenty times its audit, which is one cell of the result anyway.
    """

    @F.udf(_WHOLE)
    def compose(pieces):
        pieces = sorted(pieces, key=lambda p: (p.turn0 is not None, p.turn0 or 0, p.role0, p.key0, p.seq))
        totals = {c: sum(p[c] for p in pieces) for c in _COUNTS}
        known = [p for p in pieces if p.low is not None]
        for a, b in zip(pieces, pieces[1:]):
            totals["illegal"] += a.tail + b.head not in ("su", "ua", "au")
        for a, b in zip(known, known[1:]):
            totals["turns"] -= a.high == b.low
        gaps = known[-1].high - known[0].low + 1 - totals["turns"] if known else 0
        # From the last segment to the first: the best way on from each state, its audit kept as a chain of shares.
        rest = {EMPTY: (0, "", None), ASSISTANT: (0, "", None)}
        for k in range(len(pieces) - 1, -1, -1):
            p, final, ahead = pieces[k], k == len(pieces) - 1, {}
            for w in p.ways:
                if w.final != final or w.end not in rest or (k == 0 and w.start != EMPTY):
                    continue
                cost, audit, chain = rest[w.end]
                one = (w.cost + cost, w.audit + audit)
                if w.start not in ahead or one < ahead[w.start][:2]:
                    ahead[w.start] = (*one, ((p.segment, w.audit, w.start), chain))
            rest = ahead
        cost, audit, chain = rest[EMPTY]
        shares = []
        while chain is not None:
            shares.append(chain[0])
            chain = chain[1]
        return (totals["blank"], totals["duplicate"], totals["truncated"], totals["illegal"], totals["n_rows"], gaps, cost, audit, shares)

    light = F.struct("segment", *_PLACE, *_COUNTS, "low", "high", "head", "tail", "ways")
    gathered = parts.groupBy("conv_id").agg(F.collect_list(light).alias("pieces"))
    return gathered.select("conv_id", compose("pieces").alias("whole")).select("conv_id", "whole.*")


def _hashes(parts: DataFrame, shares: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its repaired turns, read segment by segment in order: no conversation is held whole."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    rows = parts.select("conv_id", "segment", *_PLACE, "roles", "texts").join(shares, "segment")
    laid = rows.repartition("conv_id").sortWithinPartitions("conv_id", *_PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, begun, names = None, None, False, ["conv_id", "repaired_sha256"]
        kind_of = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], kind_of), pa.array([digest.hexdigest()])], names=names)

        for batch in batches:
            kind_of = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if digest is None or r["conv_id"] != conv:
                    if digest is not None:
                        yield out()
                    conv, digest, begun = r["conv_id"], hashlib.sha256(), False
                for role, text in repaired(list(zip(r["roles"], r["texts"])), r["share"], r["start"])[0]:
                    digest.update((("\n" if begun else "") + f"{role}:{text}").encode())
                    begun = True
        if digest is not None:
            yield out()

    return laid.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def audits(rows: DataFrame) -> DataFrame:
    """Faults, cheapest audit and hash of the repaired turns of each conversation that has rows (conv_id, turn, role, text).

    Rows of a conversation are read by turn, nulls first; rows of one turn by role, then by hash of role and text.
    Null roles and texts count as one space; a null conv_id is a conversation like others; repeated rows are
    duplicates. Columns of other names are left out. Without rows the result is empty.
    """
    parts = segments(rows)
    whole = F.coalesce(F.col("first") & F.col("last"), F.lit(False))
    result = "blank long, duplicate long, truncated long, illegal long, n_rows long, gaps long, cost long, audit string, repaired_sha256 string"
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {c: [] for c in ("gaps", "cost", "audit", "repaired_sha256")}
            for r in batch.select(["low", "high", "turns", "ways", "roles", "texts"]).to_pylist():
                cost, audit = min((w["cost"], w["audit"]) for w in r["ways"])
                turns = repaired(list(zip(r["roles"], r["texts"])), audit)[0]
                got["gaps"].append(0 if r["low"] is None else r["high"] - r["low"] + 1 - r["turns"])
                got["cost"].append(cost)
                got["audit"].append(audit)
                got["repaired_sha256"].append(hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest())
            kept = ["conv_id", "blank", "duplicate", "truncated", "illegal", "n_rows"]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays += [pa.array(v, pa.int64() if c in ("gaps", "cost") else pa.string()) for c, v in got.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *got])

    short = parts.filter(whole).mapInArrow(run, f"conv_id {kind}, {result}")
    pieces = parts.filter(~whole)
    composed = stored(_composed(pieces), "composed")
    shares = composed.select(F.explode("shares").alias("s")).select("s.*")
    hashes = _hashes(pieces, shares).withColumnRenamed("conv_id", "conv")
    long = composed.drop("shares").join(hashes, F.col("conv_id").eqNullSafe(F.col("conv"))).select(*short.columns)
    return short.unionByName(long)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text. Defined like ``audits``."""
    parts = segments(rows)
    shares = _composed(parts).select(F.explode("shares").alias("s")).select("s.*")
    joined = parts.select("conv_id", "segment", *_PLACE, "roles", "texts").join(shares, "segment")
    turn = "array<struct<role:string,text:string>>"
    made = F.udf(lambda roles, texts, share, start: repaired(list(zip(roles, texts)), share, start)[0], turn)
    kept = joined.withColumn("turns", made("roles", "texts", "share", "start"))
    before = Window.partitionBy("conv_id").orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumn("place0", F.coalesce(F.sum(F.size("turns")).over(before), F.lit(0)))
    flat = placed.select("conv_id", "place0", F.posexplode("turns").alias("i", "t"))
    return flat.select("conv_id", (F.col("place0") + F.col("i")).alias("place"), "t.role", "t.text")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The report of ``audits`` on damaged rows, one row for every conversation of the table.

    Conversations that lost all rows have zeros, an empty audit and the hash of the empty string.
    """
    made = audits(damage(conversations)).withColumnRenamed("conv_id", "conv")
    ids = select(conversations, "conv_id").groupBy("conv_id").count().drop("count")
    joined = ids.join(made, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "n_rows"]
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
