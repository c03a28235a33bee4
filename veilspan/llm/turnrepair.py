"""Repair of conversations to the shape (system? (user assistant)+)? at the least cost, by Four-Russians blocks.

A turn is kept (0), given the role that its place asks for (1), deleted (2) or preceded by inserted turns with empty
text (5 each). Blank and duplicate turns must be deleted; a truncated turn that stays costs 5. What is left to pay
after a turn depends on four states only: nothing kept yet, after the system turn, after a user, after an assistant.
Less its minimum that cost vector is one of a few dozen, so its change by every block of `BLOCK` turns is computed
beforehand for every vector: a conversation is read from its end to its start by one lookup a block. The edits are
then traced from start to end: each block is expanded again from the vector behind it, and where several edits are
cheapest the one whose initial is least in ASCII is taken (D, I, K, R; each leads to one state only, so this gives the
least string of all).

Conversations of any length: narrow rows (no texts) are sorted by range and cut where a sorted part ends. Every piece
of a conversation that crosses such a border gives the change that it makes to every vector; composing these (one row
for each part) gives each piece the vector behind it. The last pass sorts the texts of a conversation behind its
pieces and writes the edits as it reads; it holds one byte for each turn of one piece, never a conversation.

Order: by turn, NULL first, then role and digest of role and text, so repeated rows are neighbours. NULL roles and
texts count as one blank. A NULL conv_id is a conversation of its own; an empty table gives no rows. Other columns of
the input are left behind.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import column, written

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
BLOCK, SYMBOLS, GONE = 4, 9, 8
FAR = 1 << 20

# --- costs ---------------------------------------------------------------------------------------


def wanted(state: int) -> int:
    """The state after a user or assistant turn that the shape allows next."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: int) -> int | None:
    """The state after keeping a turn whose role begins with s, u, a (0, 1, 2) or else (3)."""
    if initial == 0:
        return SYSTEM if state == START else None
    return wanted(state) if initial < 3 and wanted(state) == initial + 1 else None


def with_inserts(v: tuple[int, ...]) -> tuple[int, ...]:
    """Cost to go when turns may also be inserted first; two inserts reach every state."""
    for _ in range(2):
        v = tuple(min(v[s], INSERT + v[wanted(s)]) for s in range(4))
    return v


def before(symbol: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """Cost to go before a turn, from the cost to go behind it."""
    out = []
    for s in range(4):
        least = DELETE + v[s]
        if symbol != GONE:
            initial, cut = symbol // 2, CUT * (symbol % 2)
            stay = kept(s, initial)
            least = min(least, REROLE + cut + v[wanted(s)], FAR if stay is None else KEEP + cut + v[stay])
        out.append(least)
    return with_inserts(tuple(out))


END = with_inserts((0, FAR, FAR, 0))


class Tables:
    """Every normalised cost vector that can occur, and what a turn or a block of turns makes of it."""

    def __init__(self):
        known, todo = {END: 0}, [END]
        step: list[list[tuple[int, int]]] = []
        for v in todo:
            row = []
            for symbol in range(SYMBOLS):
                w = before(symbol, v)
                low = min(w)
                w = tuple(x - low for x in w)
                if w not in known:
                    known[w] = len(known)
                    todo.append(w)
                row.append((known[w], low))
            step.append(row)
        self.vectors = todo
        self.next, self.low = (np.array([[c[k] for c in row] for row in step], np.int64) for k in (0, 1))
        # a block is read from its last turn to its first; block number: first turn is the leading digit
        self.block_next, self.block_low = self.next, self.low
        for _ in range(BLOCK - 1):
            at = np.repeat(np.arange(SYMBOLS), self.block_next.shape[1])  # the turn put in front
            inner_next, inner_low = np.tile(self.block_next, SYMBOLS), np.tile(self.block_low, SYMBOLS)
            self.block_next, self.block_low = self.next[inner_next, at[None, :]], inner_low + self.low[inner_next, at[None, :]]


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def blocks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block numbers of all whole blocks counted from the end, and the turns left over at the start."""
    rest = len(symbols) % BLOCK
    powers = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
    return symbols[rest:].astype(np.int64).reshape(-1, BLOCK) @ powers, symbols[:rest]


def change(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every vector behind these turns: the vector before them, and what it is lower by."""
    t = tables()
    v, low = np.arange(len(t.vectors)), np.zeros(len(t.vectors), np.int64)
    whole, rest = blocks(symbols)
    for b in whole[::-1]:
        low, v = low + t.block_low[v, b], t.block_next[v, b]
    for s in rest[::-1]:
        low, v = low + t.low[v, s], t.next[v, s]
    return v, low


def trace(symbols: np.ndarray, behind: int, state: int) -> tuple[list[str], int, int]:
    """The edits of each turn (its inserts, then its own letter), the state after them and their cost."""
    t = tables()
    whole, rest = blocks(symbols)
    at, v = [behind], behind
    for b in whole[::-1].tolist():
        v = int(t.block_next[v, b])
        at.append(v)
    at.reverse()  # at[k]: the vector before the k-th whole block; the last one is `behind`
    out, cost = [], 0
    pieces = [(rest.tolist(), at[0])] + [(symbols[len(rest) + k * BLOCK :][:BLOCK].tolist(), at[k + 1]) for k in range(len(whole))]
    for turns, after in pieces:
        inner = [after]
        for s in reversed(turns):
            inner.append(int(t.next[inner[-1], s]))
        inner.reverse()
        for k, symbol in enumerate(turns):
            letters, state, paid = edits(symbol, t.vectors[inner[k]], t.vectors[inner[k + 1]], int(t.low[inner[k + 1], symbol]), state)
            out.append(letters)
            cost += paid
    return out, state, cost


def edits(symbol: int, now: tuple[int, ...], then: tuple[int, ...], low: int, state: int) -> tuple[str, int, int]:
    """One turn: ASCII-least among the cheapest. `now` + `low` is the cost before it, `then` the cost behind it."""
    letters, cost = "", 0
    while True:
        due = now[state] + low
        if due == DELETE + then[state]:
            return letters + "D", state, cost + DELETE
        if now[state] == INSERT + now[wanted(state)]:
            letters, state, cost = letters + "I", wanted(state), cost + INSERT
            continue
        initial, cut = symbol // 2, CUT * (symbol % 2)
        stay = kept(state, initial)
        if stay is not None and due == KEEP + cut + then[stay]:
            return letters + "K", stay, cost + KEEP + cut
        return letters + "R", wanted(state), cost + REROLE + cut


def closing(state: int) -> tuple[str, int, int]:
    """What is inserted after the last turn."""
    letters, cost = "", 0
    while END[state]:
        letters, state, cost = letters + "I", wanted(state), cost + INSERT
    return letters, state, cost


# --- rows ----------------------------------------------------------------------------------------


def blank_for_null(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with NULL roles and texts as one blank."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank_for_null(F.col("role")).alias("role"), blank_for_null(F.col("text")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns harmed by crc32(conv_id:turn) mod 20: 0 drops one, 1 empties its text, 2 takes its `.`, `!`, `?`, 3 repeats it,
    4 makes its role user."""
    kind = F.crc32(F.concat(blank_for_null(F.col("conv_id")), F.lit(":"), blank_for_null(F.col("turn"))).cast("binary")) % 20
    rows = turns(conversations).withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def digest() -> Column:
    return F.unhex(F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256))


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, code): distinct turns, how often each is there, and a byte 4 · initial + fault of
    its first copy. A turn is a duplicate if an equal role and text comes before it in the conversation."""
    end = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    look = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    narrow = rows.select("conv_id", "turn", "role", digest().alias("digest"), look.alias("look"), initial.alias("initial"))
    each = written(narrow.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.first("look").alias("look"), F.first("initial").alias("initial")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    lead = each.groupBy(F.col("conv_id").alias("l_conv"), F.col("digest").alias("l_digest")).agg(F.min(place).alias("l_at"))
    # by the first place as well as by the text, so both sides hold every key once
    same = F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("digest") == F.col("l_digest")) & F.col("turn").eqNullSafe(F.col("l_at.turn"))
    fault = F.when(F.col("look") == BLANK, BLANK).when(F.col("l_digest").isNull(), DUPLICATE).otherwise(F.col("look"))
    return each.join(lead, same, "left").select("conv_id", "turn", "role", "digest", "n", (F.col("initial") * 4 + fault).cast("int").alias("code"))


ORDER = ("conv_id", "turn", "role", "digest")
SYMBOL = np.array([GONE if c % 4 in (BLANK, DUPLICATE) else c // 4 * 2 + (c % 4 == TRUNCATED) for c in range(16)], np.int64)


def pieces(narrow: DataFrame) -> DataFrame:
    """One row for each conversation in each sorted part: its first turn's place, the codes of its turns, and, where the
    conversation may go on in another part, what the piece makes of every cost vector."""
    conv = narrow.schema["conv_id"].dataType.simpleString()

    def run(batches):
        part, now, codes, head, edge = TaskContext.get().partitionId(), None, bytearray(), None, True

        def piece(edge):
            vectors = np.stack(change(SYMBOL[np.frombuffer(codes, np.uint8)])).astype("<i8").tobytes() if edge else None
            return (now, part, *head, bytes(codes), vectors)

        for b in batches:
            out = []
            for conv_id, turn, role, dig, n, code in zip(*(column(b, c) for c in (*ORDER, "n", "code"))):
                if head is None or conv_id != now:
                    if head is not None:
                        out.append(piece(edge))
                        edge = False
                    now, codes, head = conv_id, bytearray(), (turn, role, dig)
                codes.append(code)
                if n > 1:
                    codes += bytes([code - code % 4 + (BLANK if code % 4 == BLANK else DUPLICATE)]) * (n - 1)
            if out:
                yield as_batch(out, schema)
        if head is not None:
            yield as_batch([piece(True)], schema)

    schema = f"conv_id {conv}, part int, turn long, role string, digest binary, codes binary, vectors binary"
    n = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return narrow.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(run, schema)


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    types = [ARROW[f.split()[1]] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)


ARROW = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def vectors_behind(parts: DataFrame) -> DataFrame:
    """(conv_id, part, behind): the number of the cost vector behind each piece that may have another after it."""
    conv = parts.schema["conv_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("part").to_pylist(), t.column("vectors").to_pylist()), reverse=True)
        v, out = 0, []
        for part, vectors in rows:
            out.append(v)
            v = int(np.frombuffer(vectors, "<i8").reshape(2, -1)[0, v])
        return pa.table({"conv_id": pa.array(t.column("conv_id").to_pylist(), ARROW[conv]), "part": pa.array([p for p, _ in rows], pa.int32()), "behind": pa.array(out, pa.int32())})

    # one row for each sorted part at most, so a group stays small however long its conversation is
    edges = parts.where("vectors is not null").select("conv_id", "part", "vectors")
    return edges.groupBy("conv_id").applyInArrow(run, f"conv_id {conv}, part int, behind int")


class Reader:
    """One conversation, turn by turn: its edits and its counts."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.cost, self.place, self.queue, self.at = conv_id, START, 0, 0, [], 0
        self.seen, self.illegal, self.initial = np.zeros(4, np.int64), 0, None
        self.low = self.high = None
        self.distinct = 0

    def piece(self, codes: bytes, behind: int) -> None:
        c = np.frombuffer(codes, np.uint8)
        self.seen += np.bincount(c % 4, minlength=4)
        roles = c // 4 if self.initial is None else np.concatenate([[self.initial], c // 4])
        pairs = roles[:-1].astype(np.int64) * 4 + roles[1:]
        self.illegal += int((~np.isin(pairs, (1, 6, 9))).sum())  # su, ua, au
        self.initial = int(roles[-1])
        self.queue, state, cost = trace(SYMBOL[c], behind, self.state)
        self.at, self.cost = 0, self.cost + cost

    def turn(self, turn, role, text) -> Iterator[tuple]:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.distinct = turn, self.distinct + 1
        letters, self.at = self.queue[self.at], self.at + 1
        for edit in letters:
            if edit == "I":
                self.state = wanted(self.state)
                yield self.row(edit, None, NAMES[self.state], "")
            elif edit == "R":
                self.state = wanted(self.state)
                yield self.row(edit, turn, NAMES[self.state], text)
            elif edit == "K":
                self.state = SYSTEM if role[0] == "s" else wanted(self.state)
                yield self.row(edit, turn, role, text)
            else:
                yield self.row(edit, turn, role, text)

    def row(self, edit, turn, role, text) -> tuple:
        self.place += 1
        return (self.conv_id, self.place - 1, edit, turn, role, text, *[None] * 6)

    def close(self) -> Iterator[tuple]:
        letters, _, cost = closing(self.state)
        for _ in letters:
            self.state = wanted(self.state)
            yield self.row("I", None, NAMES[self.state], "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        faults = [int(self.seen[k]) for k in (BLANK, DUPLICATE, TRUNCATED)]
        yield (self.conv_id, None, None, None, None, None, gaps, *faults, self.illegal, self.cost + cost)


def edited(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (turns, perhaps harmed, of `conversations`) with the edits that repair them: conv_id, place, edit (its
    initial), turn, role, text, and behind the last edit of every conversation one row with place NULL and its gaps, blank,
    duplicate, truncated, illegal and cost. Rows of a conversation lie together and in order, in one partition."""
    conv = conversations.schema["conv_id"].dataType.simpleString()
    parts = written(pieces(written(coded(rows), "turn-codes")), "turn-pieces")
    after = vectors_behind(parts).withColumnsRenamed({"conv_id": "a_conv", "part": "a_part"})
    same = F.col("conv_id").eqNullSafe(F.col("a_conv")) & (F.col("part") == F.col("a_part"))
    heads = parts.join(after, same, "left").select(*ORDER, "codes", F.coalesce("behind", F.lit(0)).alias("behind"), F.lit(1).alias("kind"))
    texts = rows.select("conv_id", "turn", "role", digest().alias("digest"), "text", F.lit(2).alias("kind"))
    names = conversations.select("conv_id").distinct().withColumn("kind", F.lit(0))
    both = names.unionByName(heads, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    both = both.withColumn("named", F.col("kind") == 0).select("conv_id", "named", "turn", "role", "digest", "kind", "codes", "behind", "text")
    lined_up = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("named").desc(), "turn", "role", "digest", "kind")
    schema = f"conv_id {conv}, place long, edit string, turn long, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"

    def run(batches):
        reader = None
        for b in batches:
            out, size = [], 0
            for conv_id, kind, turn, role, codes, behind, text in zip(*(column(b, c) for c in ("conv_id", "kind", "turn", "role", "codes", "behind", "text"))):
                if kind == 0:
                    if reader is not None:
                        out += reader.close()
                    reader = Reader(conv_id)
                elif kind == 1:
                    reader.piece(codes, behind)
                else:
                    out += reader.turn(turn, role, text)
                    size += len(text)
                if size > 1 << 22:
                    yield as_batch(out, schema)
                    out, size = [], 0
            if out:
                yield as_batch(out, schema)
        if reader is not None:
            yield as_batch(list(reader.close()), schema)

    return lined_up.mapInArrow(run, schema)


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, place, edit, turn, role, text); inserted ones have no turn."""
    return edited(conversations, turns(conversations)).where("edit in ('K', 'R', 'I')")


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Every conv_id of `conversations`, its turns harmed by `damaged` and repaired: gaps (turn numbers missing between the
    least and the greatest), blank, duplicate, truncated (first fault of a turn), illegal (neighbours whose role initials
    are not su, ua or au), cost, audit (the initials of all edits in order) and repaired_sha256 (of the repaired
    `role:text`, joined by line ends)."""
    rows = edited(conversations, damaged(conversations))
    conv = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches):
        audit, sha, joined = [], hashlib.sha256(), False
        for b in batches:
            out = []
            names = ("conv_id", "edit", "role", "text", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
            for conv_id, edit, role, text, *counts in zip(*(column(b, c) for c in names)):
                if edit is None:
                    out.append((conv_id, *counts, "".join(audit), sha.hexdigest()))
                    audit, sha, joined = [], hashlib.sha256(), False
                    continue
                audit.append(edit)
                if edit != "D":
                    sha.update((("\n" if joined else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    joined = True
            if out:
                yield as_batch(out, schema)

    return rows.mapInArrow(run, schema)
