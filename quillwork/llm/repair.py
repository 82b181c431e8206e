"""Structure repair of conversations: the cheapest edits that make the roles alternate, by Dijkstra on a lattice never built.

A node is (row, state): the rows before it are edited, and state says which role may follow. Nodes are taken in the order of (cost,
audit), where audit holds the initials of the edits so far, so that the first accepting end node popped is the cheapest, and of the
cheapest the one whose audit is the least in ASCII.

A conversation of more than PIECE rows is searched in pieces, from each state to each: between two nodes of equal cost every path
edits the same rows, so that no audit is a prefix of the other and the least of a piece is part of the least of the whole. Pieces
are joined FAN at a time until one is left; no task holds more rows than that, whatever a conversation's length.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, trimmed
from .prefix import running

KEEP, REROLE, DELETE, INSERT, UNENDED = 0, 2, 3, 2, 1
PIECE, FAN = 256, 16
AHEAD = 64
#: States: nothing yet; a system turn; a user turn; an assistant turn. What each initial leads to, and whether one may end there.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ACCEPTING = (START, ASSISTANT)
#: The one role of user and assistant that may follow each state.
TURN = tuple(USER if "u" in f else ASSISTANT for f in FOLLOWS)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")

_SPACE = "\t\n\x0b\x0c\r "
_PATHS = "array<struct<entry:int,exit:int,cost:long,audit:string>>"
_SUMMARY = f"key string, piece long, first string, last string, illegal long, paths {_PATHS}"


def ends(rows: list[tuple[str, bool, int]], entry: int):
    """(state, cost, audit) of each end node that (0, entry) reaches, in the order popped. rows: the initial of the role, whether the
    row must go, and what it costs more unless it goes."""
    heap, done = [(0, "", 0, entry)], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        heapq.heappush(heap, (cost + INSERT, audit + "I", at, TURN[state]))
        if at == len(rows):
            yield state, cost, audit
            continue
        initial, must_go, extra = rows[at]
        heapq.heappush(heap, (cost + DELETE, audit + "D", at + 1, state))
        if not must_go:
            heapq.heappush(heap, (cost + REROLE + extra, audit + "R", at + 1, TURN[state]))
            if initial in FOLLOWS[state]:
                heapq.heappush(heap, (cost + KEEP + extra, audit + "K", at + 1, FOLLOWS[state][initial]))


def _paths(rows: list, first: bool, last: bool) -> list[dict]:
    """The best path from each entry to each exit of a piece; of the last piece, to the first accepting end node popped."""
    out = []
    for entry in (START,) if first else range(4):
        for state, cost, audit in ends(rows, entry):
            if not last:
                out.append({"entry": entry, "exit": state, "cost": cost, "audit": audit})
            elif state in ACCEPTING:
                out.append({"entry": entry, "exit": state, "cost": cost, "audit": audit})
                break
    return out


def _joined(left: list[dict], right: list[dict]) -> list[dict]:
    """The best paths through both of two neighbouring pieces."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for p in left:
        for q in right:
            if p["exit"] == q["entry"]:
                ends_, own = (p["entry"], q["exit"]), (p["cost"] + q["cost"], p["audit"] + q["audit"])
                if ends_ not in best or own < best[ends_]:
                    best[ends_] = own
    return [{"entry": e, "exit": x, "cost": c, "audit": a} for (e, x), (c, a) in best.items()]


def _batch(keys: pa.Array, pieces: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    first, last, illegal, paths = zip(*rows) if rows else ((), (), (), ())
    kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    return pa.RecordBatch.from_arrays([keys, pieces, pa.array(first, pa.string()), pa.array(last, pa.string()), pa.array(illegal, pa.int64()), pa.array(paths, kind)], ["key", "piece", "first", "last", "illegal", "paths"])


def _searched(batches):
    for batch in batches:
        out = []
        for piece, turns in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            initials = [t["initial"] for t in turns]
            rows = [(t["initial"], t["fault"] in ("blank", "duplicate"), UNENDED if t["fault"] == "truncated" else 0) for t in turns]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            out.append((initials[0], initials[-1], illegal, _paths(rows, piece == 0, len(rows) < PIECE)))
        yield _batch(batch.column(0), batch.column(1), out)


def _merged(batches):
    for batch in batches:
        out = []
        for parts in batch.column(2).to_pylist():
            paths, illegal = parts[0]["paths"], parts[0]["illegal"]
            for before, part in zip(parts, parts[1:]):
                paths = _joined(paths, part["paths"])
                illegal += part["illegal"] + (before["last"] + part["first"] not in LEGAL)
            out.append((parts[0]["first"], parts[-1]["last"], illegal, paths))
        yield _batch(batch.column(0), batch.column(1), out)


def _edited(batches):
    """The repaired turns, row by row. Rows come by (key, pos), before those of each key one of pos -1 whose text is the audit; it alone
    is held. key, nth, role, text, edit."""
    key, audit, at, state, nth, out = None, "", 0, START, 0, []

    def put(role: str, text: str, edit: str) -> None:
        nonlocal nth
        out.append((key, nth, role, text, edit))
        nth += 1

    def inserted() -> None:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            state, at = TURN[state], at + 1
            put(NAMES[state], "", "I")

    for batch in batches:
        for k, pos, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if pos < 0:
                inserted()
                key, audit, at, state, nth = k, text, 0, START, 0
                continue
            inserted()
            edit = audit[at]
            at += 1
            if edit == "R":
                state = TURN[state]
                put(NAMES[state], text, edit)
            elif edit == "K":
                state = FOLLOWS[state][role[:1]]
                put(role, text, edit)
        yield _turns(out)
        out = []
    inserted()
    yield _turns(out)


def _turns(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "nth", "role", "text", "edit"])


def _hashed(batches):
    """SHA-256 of `role:text`, newline-joined, of each key, whose rows come one after another."""
    key, sha, keys, found = None, None, [], []
    for batch in batches:
        for k, nth, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if nth == 0:
                if sha is not None:
                    keys.append(key)
                    found.append(sha.hexdigest())
                key, sha = k, hashlib.sha256()
            sha.update(f"{chr(10) if nth else ''}{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], ["key", "sha"])
        keys, found = [], []
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([sha.hexdigest()], pa.string())], ["key", "sha"])


def _key() -> Column:
    """The conversation as text; null is one space, which no number is."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))


def turns(conversations: DataFrame) -> DataFrame:
    """key, turn, role, text of the rows; null roles and texts are one space."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(_key().alias("key"), F.col("turn").cast("long").alias("turn"), *filled)


def damaged(own: DataFrame) -> DataFrame:
    """Turns with faults put in by the CRC-32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 takes its `[.!?]` away,
    3 repeats it, 4 makes it the user's."""
    way = F.crc32(F.concat("key", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = own.withColumn("way", way).where("way <> 0").withColumn("copy", F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("key", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def placed(own: DataFrame) -> DataFrame:
    """key, pos, turn, role, text, fault of turns, written: pos grows through a conversation, by turn (null first), role and text.

    Rows are dealt by ranges of (conversation, turn, role, first AHEAD characters), so that a long conversation is many tasks. fault is the
    row's first: blank, duplicate (role and text stood earlier), truncated (the last character that is not a space isn't one of
    .!?), or null.
    """
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role")]
    rows = own.repartitionByRange(*order, F.left("text", F.lit(AHEAD))).sortWithinPartitions(*order, "text")
    last = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    rows = rows.select("key", F.monotonically_increasing_id().alias("pos"), "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"), last.alias("last"))
    rows = materialize(rows, "repair-rows")
    full = rows.where("last <> ''").select("key", "role", "digest", "pos")
    seen = full.groupBy("key", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "role", "digest", "first")
    again = full.join(seen, ["key", "role", "digest"]).where("pos > first").select("pos", F.lit(True).alias("again"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("again"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    out = materialize(rows.join(again, "pos", "left").select("key", "pos", "turn", "role", "text", fault.alias("fault")), "repair-turns")
    discard(rows)
    return out


def searched(rows: DataFrame) -> DataFrame:
    """key, cost, audit, illegal (neighbours whose initials are none of LEGAL) for each conversation of rows (see placed())."""
    codes = rows.select("key", "pos", F.substring("role", 1, 1).alias("initial"), F.coalesce("fault", F.lit("")).alias("fault"), F.shiftright("pos", 33).alias("bucket"))
    ranked = running(codes, "key", "bucket", [F.col("pos")], F.lit(1), "n").withColumn("piece", F.floor((F.col("n") - 1) / PIECE))
    lists = ranked.groupBy("key", "piece").agg(F.sort_array(F.collect_list(F.struct("pos", "initial", "fault"))).alias("turns"))  # at most PIECE each
    now = materialize(small_batches(lists).mapInArrow(trimmed(_searched), _SUMMARY), "repair-pieces")
    one = now.where("piece = 0")
    best = F.array_min(F.transform(F.filter("paths", lambda p: p["exit"].isin(*ACCEPTING)), lambda p: F.struct(p["cost"].alias("cost"), p["audit"].alias("audit"))))
    while now.where("piece > 0").limit(1).count():
        lists = now.groupBy("key", F.floor(F.col("piece") / FAN).alias("p")).agg(F.sort_array(F.collect_list(F.struct("piece", "first", "last", "illegal", "paths"))).alias("parts"))  # at most FAN each
        then = materialize(small_batches(lists.select("key", F.col("p").alias("piece"), "parts")).mapInArrow(trimmed(_merged), _SUMMARY), "repair-pieces")
        discard(now)
        now = then
        one = now
    return one.select("key", best.alias("b"), "illegal").select("key", "b.cost", "b.audit", "illegal")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """key, nth, role, text, edit: the turns that stay or come in, by nth from 0; edit is K, R or I. rows: placed(), found: searched().

    Rows stream through a task in order, and nothing but a conversation's audit is held.
    """
    audits = found.select("key", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = audits.unionByName(rows.select("key", "pos", "role", "text")).repartition("key").sortWithinPartitions("key", "pos")
    return small_batches(both).mapInArrow(trimmed(_edited), "key string, nth long, role string, text string, edit string")


def report(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conv_id of conversations (conv_id,
    turn, role, text), null being one.

    damage puts faults in first (damaged()). gaps: turns missing between the smallest and the largest, null turns left out. Null
    roles and texts are one space; rows of equal turns stand by role, then by text; an empty role has no initial and is never kept;
    repeated rows are duplicates; very long texts are rows like others; other columns, whatever their names, aren't looked at; an
    empty table gives an empty result. A hash of a whole conversation has no parts, so its repaired turns pass through one task, as
    a stream.
    """
    own = turns(conversations)
    rows = placed(damaged(own) if damage else own)
    found = materialize(searched(rows), "repair-audits")
    hashed = repaired(rows, found).mapInArrow(trimmed(_hashed), "key string, sha string")
    turn = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = rows.groupBy("key").agg(F.coalesce(turn, F.lit(0)).alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    every = conversations.select("conv_id").distinct().withColumn("key", _key())
    of = every.join(counts, "key", "left").join(found, "key", "left").join(hashed, "key", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    out = materialize(of.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), sha), "repair-report")
    discard(rows)
    discard(found)
    return out
