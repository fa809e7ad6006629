"""Repair of conversation structure by Viterbi decoding with survivor coalescence.

The rows of a conversation, in order of turn, are edited as cheaply as possible so that the initials
of their roles read ``(s?(ua)+)?``: keep, change the role, delete, insert.  Four states say how
far the pattern has come; every state has one survivor, a node of a backpointer tree whose nodes
count who refers to them.  As soon as all survivors descend from one node, the edits down to it are
decided and leave the tree, so that only the undecided end of a conversation is held.  Equal costs
are settled by the whole undecided ends of both paths: the ASCII-least sequence of edits wins.

Spark brings a conversation's rows together and in order by one shuffle and sort; the decoder reads
them as a stream, across batches, and never holds a conversation.  Faults that need earlier rows
(duplicates) are found by a window before it, over the same partitioning.  A conversation's rows
go through one task, as its SHA-256 is sequential by definition; they are not gathered there.

Defined results: null roles and texts count as one space; rows with a null id are one conversation;
rows of equal turn are taken by role, then text (byte order); repeated rows are duplicates;
a conversation without rows has no edits; extra columns may have any name and are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What the edits cost, what a kept truncated row costs besides, and the legal neighbours.
KEEP, REROLE, DELETE, INSERT, TRUNCATED_KEPT = 0, 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
BLANK_TEXT = r"\A[\x20\x09-\x0D]*\z"
WHOLE_TEXT = r"[.!?][\x20\x09-\x0D]*\z"

#: States of the pattern: nothing yet, after s, after u, after a.
START, S, U, A = range(4)
#: (from, initial) -> to
STEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
ROLE = {U: "user", A: "assistant"}
#: Ways into a state by insertions alone: to each state, (from, initials).
INSERTIONS = {
    START: [(START, "")],
    S: [(S, "")],
    U: [(U, ""), (START, "u"), (S, "u"), (A, "u")],
    A: [(A, ""), (U, "a"), (START, "ua"), (S, "ua")],
}
#: SPARE[x][y]: whatever follows a survivor in x can follow one in y for at most so much more (an insertion
#: or two to get there, or the deletion of an s).  A survivor that is worse by more than that has no future.
SPARE = [[0, 6, 7, 4], [0, 0, 3, 0], [3, 3, 0, 3], [6, 6, 3, 0]]


class Node:
    """One edit of a path; ``refs`` counts the children and survivors that hold on to it."""

    __slots__ = ("parent", "letter", "role", "row", "refs", "depth")

    def __init__(self, parent: "Node | None", letter: str, role: str | None, row: tuple | None):
        self.parent, self.letter, self.role, self.row, self.refs = parent, letter, role, row, 0
        self.depth = 0 if parent is None else parent.depth + 1
        if parent is not None:
            parent.refs += 1


def release(node: Node | None) -> None:
    """One reference less; edits that nobody refers to leave the tree."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        node = node.parent


def earlier(a: tuple[Node, str], b: tuple[Node, str]) -> bool:
    """Is path ``a`` ASCII-less than ``b``?  A path is a node and letters that would follow it; both are
    compared from their common ancestor on."""
    (x, tail_x), (y, tail_y) = a, b
    ends_x, ends_y = [], []
    while x is not y:
        if x.depth >= y.depth:
            ends_x.append(x.letter)
            x = x.parent
        else:
            ends_y.append(y.letter)
            y = y.parent
    return "".join(reversed(ends_x)) + tail_x < "".join(reversed(ends_y)) + tail_y


def cheapest(ways: list[tuple]) -> tuple | None:
    """The way of least cost, and of those the ASCII-least.  A way is (cost, node, letters to follow, ...)."""
    best = None
    for way in ways:
        if best is None or way[0] < best[0] or (way[0] == best[0] and earlier(way[1:3], best[1:3])):
            best = way
    return best


class Decoder:
    """Edits of one conversation.  ``push`` takes a row and gives the edits decided by it, ``finish`` the rest.

    A row is (fault, role, ...); an edit is (letter, role, row), row null for insertions.
    """

    def __init__(self):
        self.root = Node(None, "", None, None)
        self.root.refs = 1                      # the root is held by the decoder itself
        self.costs: list[int | None] = [0, None, None, None]
        self.tips: list[Node | None] = [self.root, None, None, None]
        self.root.refs += 1
        self.held = 0                           # most undecided edits so far

    def _inserted(self, state: int, letter: str, extra: int) -> list[tuple[int, Node, str, str]]:
        """Ways to be in ``state`` right before ``letter``: cost, tip, letters from there on, initials to insert."""
        return [(self.costs[f] + INSERT * len(ins) + extra, self.tips[f], "I" * len(ins) + letter, ins)
                for f, ins in INSERTIONS[state] if self.costs[f] is not None]

    def push(self, row: tuple) -> list[tuple]:
        fault, role = row[0], row[1]
        forced = fault in ("blank", "duplicate")
        extra = TRUNCATED_KEPT if fault == "truncated" else 0
        costs, tips = [None] * 4, [None] * 4
        for to in range(4):
            ways = []                           # cost, tip, letters, initials inserted before, role after
            if self.costs[to] is not None:
                ways.append((self.costs[to] + DELETE, self.tips[to], "D", "", None))
            if not forced:
                for (f, initial), t in STEP.items():
                    if t == to:
                        if role[:1] == initial:
                            ways += [(*w, role) for w in self._inserted(f, "K", KEEP + extra)]
                        if to in ROLE:
                            ways += [(*w, ROLE[to]) for w in self._inserted(f, "R", REROLE + extra)]
            best = cheapest(ways)
            if best is not None:
                costs[to] = best[0]
                tips[to] = self._grow(best[1], best[3], best[2][-1], best[4], row)
        for x in range(4):                      # survivors without a future
            if costs[x] is not None and any(c is not None and costs[x] > c + SPARE[x][y] for y, c in enumerate(costs)):
                release(tips[x])
                costs[x] = tips[x] = None
        self._move(costs, tips)
        return self._decided()

    def _grow(self, node: Node, inserted: str, letter: str, role: str | None, row: tuple | None) -> Node:
        """A held tip: insertions, then the edit of the row."""
        for i in inserted:
            node = Node(node, "I", "user" if i == "u" else "assistant", None)
        if letter:
            node = Node(node, letter, role, row)
        node.refs += 1
        return node

    def _move(self, costs: list, tips: list) -> None:
        old, self.costs, self.tips = self.tips, costs, tips
        for t in old:
            release(t)

    def _decided(self) -> list[tuple]:
        """Edits from the root down to where the survivors part; they leave the tree."""
        tip = next(t for t in self.tips if t is not None)
        self.held = max(self.held, tip.depth - self.root.depth)
        if self.root.refs > 2 or tip is self.root:      # the decoder and one child
            return []
        chain = []
        while tip is not self.root:
            chain.append(tip)
            tip = tip.parent
        out = []
        while chain and self.root.refs == 2 and not any(t is self.root for t in self.tips):
            child = chain.pop()
            out.append((child.letter, child.role, child.row))
            child.parent = None
            child.refs += 1
            self.root = child
        return out

    def finish(self) -> list[tuple]:
        best = cheapest(self._inserted(START, "", 0) + self._inserted(A, "", 0))
        tip = self._grow(best[1], best[3], "", None, None)
        chain = []
        while tip is not self.root:
            chain.append(tip)
            tip = tip.parent
        return [(n.letter, n.role, n.row) for n in reversed(chain)]


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Planted faults by crc32(``id:turn``) % 20: 0 drops the row (``lost``), 1 empties its text, 2 takes its
    ``.!?`` out, 3 repeats it, 4 makes it the user's.  Returns id, turn, role, text, lost."""
    blank = F.lit(" ")
    rows = conversations.select(
        F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col("role"), blank).alias("role"), F.coalesce(F.col("text"), blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = (F.crc32(key) % 20).cast("int")
    gone = F.col("kind") == 0
    return (rows.withColumn("kind", kind)
            .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn",
                    F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    gone.alias("lost")))


#: Rows are returned some thousands or so many characters at a time.
FLUSH_CHARS = 4 << 20
EDITS = "conv_id {key}, turn {turn}, was_role string, fault string, edit string, role string, text string"


def repair(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """The cheapest edits of every conversation, in order, one row each.

    Takes conv_id, turn, role, text and, if there, ``lost`` (true: the row is gone, but its conversation is
    known).  Returns conv_id, turn, was_role, fault, edit (K, R, D, I), role and text after the edit (null
    if deleted).  A conversation without rows has one row with a null edit.  Rows of a conversation
    lie together and in order in one partition.
    """
    blank = F.lit(" ")
    lost = F.col("lost") if "lost" in conversations.columns else F.lit(False)
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role"), blank).alias("role"),
                                F.coalesce(F.col("text"), blank).alias("text"), lost.alias("lost"))
    rows = rows.repartition(partitions, "conv_id") if partitions else rows.repartition("conv_id")
    rows = rows.withColumn("digest", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = F.row_number().over(Window.partitionBy("conv_id", "lost", "digest").orderBy(F.col("turn").asc_nulls_first()))
    rows = rows.withColumn("fault", F.when(F.col("lost"), None)
                           .when(F.col("text").rlike(BLANK_TEXT), "blank").when(first > 1, "duplicate")
                           .when(~F.col("text").rlike(WHOLE_TEXT), "truncated"))
    rows = rows.select("conv_id", "lost", "turn", "role", "text", "fault").sortWithinPartitions(
        F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text", F.coalesce(F.col("fault") == "duplicate", F.lit(False)))
    types = dict(rows.dtypes)
    out_schema = EDITS.format(key=types["conv_id"], turn=types["turn"])
    return rows.mapInArrow(_repair_stream, out_schema)


def _repair_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    schema = None
    decoder, key, any_row, chars = None, None, False, 0

    def edits(found: list[tuple]) -> None:
        nonlocal chars
        for letter, role, row in found:
            chars += len(row[3] or "") if row else 0
            if row is None:
                out.append((key, None, None, None, letter, role, ""))
            else:
                out.append((key, row[2], row[1], row[0], letter, role, None if letter == "D" else row[3]))

    def close() -> None:
        if any_row:
            edits(decoder.finish())
        else:
            out.append((key, None, None, None, None, None, None))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * 7
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        if schema is None:
            key_type, turn_type = batch.schema.field(0).type, batch.schema.field(2).type
            text = pa.string()
            schema = pa.schema([("conv_id", key_type), ("turn", turn_type), ("was_role", text), ("fault", text),
                                ("edit", text), ("role", text), ("text", text)])
        ids, lost, turns, roles, texts, faults = (batch.column(i).to_pylist() for i in range(6))
        for i, k in enumerate(ids):
            if decoder is None or k != key:
                if decoder is not None:
                    close()
                decoder, key, any_row = Decoder(), k, False
            if not lost[i]:
                any_row = True
                fault = faults[i]
                # a row that can only be deleted is held without its text
                edits(decoder.push((fault, roles[i], turns[i], None if fault in ("blank", "duplicate") else texts[i])))
            if len(out) >= 4096 or chars >= FLUSH_CHARS:
                yield flush()
                chars = 0
    if decoder is not None:
        close()
    if out:
        yield flush()


SUMMARY = ("conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string")


def summaries(repaired: DataFrame) -> DataFrame:
    """One row per conversation out of ``repair``'s rows as they lie: gaps, faults, illegal neighbours, cost of
    the edits, their initials, SHA-256 of the repaired ``role:text`` lines.  A stream without a shuffle."""
    types = dict(repaired.dtypes)
    return (repaired.select("conv_id", "turn", "was_role", "fault", "edit", "role", "text")
            .mapInArrow(_summary_stream, SUMMARY.format(key=types["conv_id"])))


class Summary:
    def __init__(self, key):
        self.key, self.low, self.high, self.turns, self.last_turn = key, None, None, 0, None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = 0
        self.initial, self.audit, self.lines, self.hash = None, [], 0, hashlib.sha256()

    def add(self, turn, was_role, fault, edit, role, text) -> None:
        if edit is None:
            return
        self.audit.append(edit)
        if edit != "I":
            if turn is not None:
                if self.low is None:
                    self.low = turn
                if turn != self.high:           # rows come by turn
                    self.turns += 1
                self.high = turn
            initial = was_role[:1]
            if self.initial is not None and self.initial + initial not in LEGAL:
                self.illegal += 1
            self.initial = initial
            if fault is not None:
                self.faults[fault] += 1
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "D":
            if fault == "truncated":
                self.cost += TRUNCATED_KEPT
            self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "replace"))
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _summary_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, schema, out = None, None, []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        if schema is None:
            names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
            schema = pa.schema([("conv_id", batch.schema.field(0).type), *[(n, pa.int64()) for n in names],
                                ("audit", pa.string()), ("repaired_sha256", pa.string())])
        columns = [batch.column(i).to_pylist() for i in range(7)]
        for key, *rest in zip(*columns):
            if current is None or key != current.key:
                if current is not None:
                    out.append(current.row())
                current = Summary(key)
            current.add(*rest)
        if len(out) >= 4096:
            yield flush()
    if current is not None:
        out.append(current.row())
    if out:
        yield flush()
