"""Repair of conversation structure with Four-Russians block tables.

A conversation is a string of symbols, one per row: the role's initial (s, u, a, or o for any other), in capitals if the text
is cut off, X for a row that has to go. Edits (Keep, Rerole, Delete, Insert) must leave role initials ``(s?(ua)+)?``. The cost
of repairing what is left of a conversation depends only on where in that pattern the output stands, so a vector of four
costs describes every suffix; less its smallest entry, few such vectors exist. For all of them and all blocks of ``_BLOCK``
symbols the vector before the block is tabulated. A conversation is read block by block from its end, one look-up each; then
every block is expanded backward, row by row, and the cheapest edits are read off forward, the ASCII-least of equal ones first.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.session import staged

REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
_BLOCK = 3
_SYMBOLS = "XsuaoSUAO"
#: Places in the pattern: nothing yet, after s, after u, after a; the initial that edits can put next, and where it leads.
_NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
_END = (0, 2 * INSERT, INSERT, 0)
_PIECE = 1 << 16  # symbols
_FULL = {"u": "user", "a": "assistant"}


def _edits(symbol: str, place: int, after: tuple) -> list[tuple[int, str, int | None]]:
    """(cost, edit, next place) for a row with ``symbol``; ``after`` holds the costs of all that follows the row."""
    found = [(DELETE + after[place], "D", place)]
    if symbol != "X":
        more = CUT_OFF * symbol.isupper()
        role, there = _NEXT[place]
        if symbol.lower() == role:
            found.append((more + after[there], "K", there))
        elif symbol.lower() == "s" and place == 0:
            found.append((more + after[1], "K", 1))
        found.append((REROLE + more + after[there], "R", there))
    return found


def _before(symbol: str, after: tuple) -> tuple:
    """Costs before a row: of the row's own edits, or of rows inserted first."""
    cost = [min(e[0] for e in _edits(symbol, place, after)) for place in range(4)]
    for _ in range(3):  # s, u, a: no more than three insertions in a row can pay
        cost = [min(cost[place], INSERT + cost[_NEXT[place][1]]) for place in range(4)]
    return tuple(cost)


@lru_cache(maxsize=1)
def tables() -> tuple[dict, dict, dict]:
    """One symbol, one block: (vector, symbols) to (vector before them, cost taken off); choices: (vector after, symbol, place) to
    (edits, next place). Vectors are normalised."""
    single, choices, todo = {}, {}, [_END]
    while todo:
        after = todo.pop()
        if (after, "X") in single:
            continue
        for symbol in _SYMBOLS:
            cost = _before(symbol, after)
            least = min(cost)
            single[after, symbol] = (tuple(c - least for c in cost), least)
            todo.append(single[after, symbol][0])
            for place in range(4):
                edits, at = "", place
                while True:
                    options = [(c, e, t) for c, e, t in _edits(symbol, at, after)] + [(INSERT + cost[_NEXT[at][1]], "I", _NEXT[at][1])]
                    _, edit, there = min((o for o in options if o[0] == cost[at]), key=lambda o: o[1])
                    edits, at = edits + edit, there
                    if edit != "I":
                        break
                choices[after, symbol, place] = (edits, at)
    blocks = {}
    for vector in {v for v, _ in single}:
        for block in itertools.product(_SYMBOLS, repeat=_BLOCK):
            at, cost = vector, 0
            for symbol in reversed(block):
                at, more = single[at, symbol]
                cost += more
            blocks[vector, "".join(block)] = (at, cost)
    return single, blocks, choices


def cheapest_edits(symbols: str) -> tuple[int, str]:
    """Cost and edits of one conversation."""
    single, blocks, choices = tables()
    head = len(symbols) % _BLOCK
    vector, cost, ends = _END, 0, []
    for lo in range(len(symbols) - _BLOCK, head - 1, -_BLOCK):
        ends.append(vector)
        vector, more = blocks[vector, symbols[lo:lo + _BLOCK]]
        cost += more
    first = vector
    for symbol in reversed(symbols[:head]):
        vector, more = single[vector, symbol]
        cost += more
    cost += vector[0]
    out, place = [], 0
    for lo, hi, after in [(0, head, first), *((head + _BLOCK * k, head + _BLOCK * (k + 1), v) for k, v in enumerate(reversed(ends)))]:
        follows = []
        for symbol in reversed(symbols[lo:hi]):
            follows.append(after)
            after, _ = single[after, symbol]
        for symbol, after in zip(symbols[lo:hi], reversed(follows)):
            edits, place = choices[after, symbol, place]
            out.append(edits)
    while place in (1, 2):
        out.append("I")
        place = _NEXT[place][1]
    return cost, "".join(out)


def _marked(turns: DataFrame) -> DataFrame:
    """Nulls in role and text as one space, and a digest of both."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.withColumn("mark", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal rows, in order, as pieces of conversations: their symbols and what the counts of neighbours need."""
    names = ["conv_id", "part", "symbols", "blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "low", "high"]
    part, done, open_ = TaskContext.get().partitionId(), [], None

    def flush(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    serial = part << 32
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "symbols", "n", "blank", "duplicate", "truncated"))):
            conv, turn, initial, symbols, n, blank, duplicate, truncated = row
            if open_ and (open_[0] != conv or open_[12] >= _PIECE):
                done.append((*open_[:2], "".join(open_[2]), *open_[3:12]))
                open_ = None
            if open_ is None:
                open_ = [conv, serial, [], 0, 0, 0, 0, initial, initial, 0, None, None, 0]
                serial += 1
            else:
                open_[6] += open_[8] + initial not in ("su", "ua", "au")
            open_[6] += n - 1
            open_[2].append(symbols)
            open_[12] += n
            open_[3] += blank
            open_[4] += duplicate
            open_[5] += truncated
            open_[8] = initial
            if turn is not None and turn != open_[11]:
                open_[9] += 1
                open_[10], open_[11] = turn if open_[10] is None else open_[10], turn
        if len(done) >= 4096:
            yield flush(done)
            done = []
    if open_:
        done.append((*open_[:2], "".join(open_[2]), *open_[3:12]))
    if done:
        yield flush(done)


_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, in order, to one row per conversation."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds = [*[pa.int64()] * 7, pa.string()]
    held: list = []

    def close() -> tuple:
        illegal = sum(p[6] for p in held) + sum(a[8] + b[7] not in ("su", "ua", "au") for a, b in itertools.pairwise(held))
        dated = [p for p in held if p[10] is not None]
        turns = sum(p[9] for p in dated) - sum(a[11] == b[10] for a, b in itertools.pairwise(dated))
        gaps = dated[-1][11] - dated[0][10] + 1 - turns if dated else 0
        cost, audit = cheapest_edits("".join(p[2] for p in held))
        return (held[0][0], gaps, *(sum(p[i] for p in held) for i in (3, 4, 5)), illegal, cost, audit)

    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                out.append(close())
                held = []
            held.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(close(), kinds)], names=names)


def audit_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row per conv_id of ``turns``.

    ``turns`` has conv_id, turn, role, text; other columns are ignored, whatever their names. Rows without a conv_id are one
    conversation. Rows go by turn, nulls first; rows of one turn by role, then by a digest, so that equal rows are neighbours.
    Null roles and texts are one space. A row's first fault counts: blank (nothing but blanks), duplicate (role and text of an
    earlier row) or truncated (the last character that is no blank is none of ``.!?``). ``gaps`` counts turn numbers missing
    between the smallest and the largest. ``illegal`` counts neighbours whose role initials are not su, ua or au. ``audit``
    spells the cheapest edits. An empty table gives no rows.

    Rows are sorted by range, so a long conversation is spread over tasks; what meets in one task is a symbol per row, no more
    than the audit that is asked for.
    """
    rows = _marked(turns)
    last = F.substring(F.rtrim("text", F.lit("\x20\x09\x0A\x0B\x0C\x0D")), -1, 1)
    runs = rows.select("conv_id", "turn", "role", "mark", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    runs = staged(runs.groupBy("conv_id", "turn", "role", "mark", "blank", "cut").agg(F.count("*").alias("n")), "runs")
    again = runs.groupBy("conv_id", "mark").agg(F.min("turn").alias("turn0"), F.max(F.col("turn").isNull()).alias("undated"),
                                                F.count("*").alias("times")).where("times > 1")
    again = again.select(F.col("conv_id").alias("conv0"), F.col("mark").alias("mark0"), "turn0", "undated")
    runs = runs.join(again, runs["conv_id"].eqNullSafe(again["conv0"]) & (runs["mark"] == again["mark0"]), "left")
    first = F.col("undated").isNull() | F.when(F.col("undated"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("turn0"))
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    symbol = F.when(F.col("cut"), F.upper(symbol)).otherwise(symbol)
    new = first & ~F.col("blank")
    n = F.col("n").cast("int")
    runs = runs.select(
        "conv_id", "turn", "role", "mark", initial.alias("initial"), "n",
        F.when(new, F.concat(symbol, F.repeat(F.lit("X"), n - 1))).otherwise(F.repeat(F.lit("X"), n)).alias("symbols"),
        F.when(F.col("blank"), F.col("n")).otherwise(0).alias("blank"),
        F.when(F.col("blank"), 0).otherwise(F.col("n") - first.cast("int")).alias("duplicate"),
        (new & F.col("cut")).cast("long").alias("truncated"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("mark")]
    pieces = runs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pieces, "conv_id long, part long, symbols string, blank long, duplicate long, truncated long, illegal long, "
                 "first string, last string, turns long, low long, high long")
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_audit, _AUDIT)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit, then its rows in order, to the rows after repair."""
    names = ["conv_id", "position", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    conv, audit, at, place, position, out = None, "", 0, 0, 0, []

    def insertions() -> None:
        nonlocal at, place, position
        while audit[at:at + 1] == "I":
            role, place = _NEXT[place]
            out.append((conv, position, _FULL[role], ""))
            at, position = at + 1, position + 1

    for batch in batches:
        for c, edits, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "audit", "role", "text"))):
            if edits is not None:
                insertions()  # behind the last row of the conversation before
                conv, audit, at, place, position = c, edits, 0, 0, 0
                continue
            insertions()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "K" and place == 0 and role[:1] == "s":
                place = 1
            else:
                initial, place = _NEXT[place]
                role = role if edit == "K" else _FULL[initial]
            out.append((c, position, role, text))
            position += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)
            out = []
    insertions()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the rows of ``turns`` after the edits of ``audits``, each conversation's in order.

    Conversations are streams in their tasks, of which a batch is held at a time; every partition holds whole conversations,
    sorted by position.
    """
    rows = _marked(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "mark", "text", F.lit(None).cast("string").alias("audit"))
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                          F.lit(None).cast("binary").alias("mark"), F.lit("").alias("text"), "audit")
    return (rows.unionByName(heads).repartition("conv_id")
            .sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "mark")
            .mapInArrow(_apply, "conv_id long, position long, role string, text string"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state, done = None, None, []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())],
                                          names=["conv_id", "repaired_sha256"])

    for batch in batches:
        for c, position, role, text in zip(*(x.to_pylist() for x in batch.columns)):
            if position == 0:
                if state:
                    done.append((conv, state.hexdigest()))
                conv, state = c, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if len(done) >= 4096:
            yield flush()
            done = []
    if state:
        done.append((conv, state.hexdigest()))
    if done:
        yield flush()


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of each conversation's ``role:text`` lines, of the result of ``repaired_turns`` as it is.

    SHA-256 reads its input from the first byte to the last, so one conversation is one stream in one task.
    """
    return repaired.mapInArrow(_digest, "conv_id long, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults of known kinds, by crc32 of ``conv_id:turn`` mod 20: 0 drops a row, 1 empties its text,
    2 removes its ``.!?``, 3 repeats it, 4 sets role user. Nulls are one space, in that key as well."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
                        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                        kind.alias("kind")).where("kind != 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
                       .alias("copy")).drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage, audit and repair of ``conversations``: one row per conv_id of it, also of those of which no row is left."""
    turns = damage(conversations)
    audits = staged(audit_conversations(turns), "audits")
    hashes = digests(repaired_turns(turns, audits)).select(F.col("conv_id").alias("conv0"), "repaired_sha256")
    ids = conversations.select("conv_id").distinct()
    found = audits.select(F.col("conv_id").alias("conv1"), *audits.columns[1:])
    joined = (ids.join(found, ids["conv_id"].eqNullSafe(found["conv1"]), "left")
              .join(hashes, ids["conv_id"].eqNullSafe(hashes["conv0"]), "left"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
