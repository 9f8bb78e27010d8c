"""Repair of conversations to an optional system turn and pairs of user and assistant, at least cost.

A Viterbi search over four states (nothing yet, after system, after user, after assistant) runs along
the turns of a conversation. Its survivors, one cheapest path for each state, are leaves of a tree of
backpointers whose nodes count their references. What loses all references is freed; what all survivors
share is emitted at once and freed as well, so a task holds the unresolved stretch only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an edit costs, and the letters of the edits.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
SPACE = r"\x20\x09-\x0D"

# States: nothing yet, after system, after user, after assistant. Dialogues may end in the first and last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
LEGAL_PAIRS = ("su", "ua", "au")

EDITS = "conv_id {key}, place bigint, edit string, turn {turn}, role string, text string, fault string, illegal boolean, cost bigint"


class Node:
    """An edit at the end of a path. `refs` counts the nodes that go on from it, listed in `next`, and
    one more while a survivor ends here."""

    __slots__ = ("parent", "jump", "depth", "edit", "role", "row", "refs", "next")

    def __init__(self, parent: Node | None, edit: str, role: str | None = None, row: tuple | None = None):
        self.parent, self.edit, self.role, self.row = parent, edit, role, row
        self.refs, self.next = 0, []
        if parent is None:
            self.depth, self.jump = 0, self
            return
        # An ancestor further up: as far as two jumps of the parent if those are of one length.
        far = parent.jump
        self.depth = parent.depth + 1
        self.jump = far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent

    def hold(self) -> None:
        """A survivor ends here. Nodes that get their first reference count in their parents."""
        node = self
        node.refs += 1
        while node.refs == 1 and node.parent is not None:
            node.parent.next.append(node)
            node = node.parent
            node.refs += 1

    def release(self) -> None:
        """No survivor ends here any more. Nodes without references are cut off."""
        node = self
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            parent, node.parent = node.parent, None
            parent.next.remove(node)
            node = parent
            node.refs -= 1


def _up_to(node: Node, depth: int) -> Node:
    while node.depth > depth:
        node = node.jump if node.jump.depth >= depth else node.parent
    return node


def _less(a: Node, b: Node) -> bool:
    """Whether the edits that lead to `a` come before those that lead to `b`: decided by the first edits
    behind the node where both paths part, which is at the root of the tree at the latest. Jumps
    skip what lies behind, so long open stretches cost little more than short ones."""
    depth = min(a.depth, b.depth)
    shorter = a.depth < b.depth
    a, b = _up_to(a, depth), _up_to(b, depth)
    if a is b:
        return shorter
    while a.parent is not b.parent:
        a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.parent, b.parent)
    return a.edit < b.edit


class Survivors:
    """The cheapest path to each state after the rows so far; equal costs go to the ASCII-least edits."""

    def __init__(self):
        self.root = Node(None, "")
        self.nodes: list[Node | None] = [self.root, None, None, None]
        self.costs: list[int | None] = [0, None, None, None]
        self._insert(self.nodes, self.costs)
        for node in filter(None, self.nodes):
            node.hold()

    @staticmethod
    def _offer(nodes: list, costs: list, state: int, cost: int, node: Node) -> None:
        if costs[state] is None or cost < costs[state] or (cost == costs[state] and _less(node, nodes[state])):
            nodes[state], costs[state] = node, cost

    def _insert(self, nodes: list, costs: list) -> None:
        """Empty turns: of the user after every other state, then of the assistant after the user."""
        for before in (NOTHING, SYSTEM, ASSISTANT):
            if nodes[before] is not None:
                self._offer(nodes, costs, USER, costs[before] + COST[INSERT], Node(nodes[before], INSERT, "user"))
        self._offer(nodes, costs, ASSISTANT, costs[USER] + COST[INSERT], Node(nodes[USER], INSERT, "assistant"))

    def step(self, role: str, fault: str | None, row: tuple) -> None:
        """One row more; `row` goes along with the edit of it."""
        old, old_costs = self.nodes, self.costs
        nodes, costs = [None] * 4, [None] * 4
        extra = TRUNCATED_COST if fault == "truncated" else 0
        for state, node in enumerate(old):
            if node is None:
                continue
            cost = old_costs[state]
            self._offer(nodes, costs, state, cost + COST[DELETE], Node(node, DELETE, row=row))
            if fault in ("blank", "duplicate"):
                continue
            goes_to, new_role = (ASSISTANT, "assistant") if state == USER else (USER, "user")
            self._offer(nodes, costs, goes_to, cost + COST[REROLE] + extra, Node(node, REROLE, new_role, row))
            if role[:1] == new_role[0]:
                self._offer(nodes, costs, goes_to, cost + extra, Node(node, KEEP, role, row))
            elif role[:1] == "s" and state == NOTHING:
                self._offer(nodes, costs, SYSTEM, cost + extra, Node(node, KEEP, role, row))
        self._insert(nodes, costs)
        # After the assistant everything is open that is open after the system turn; from nothing, the
        # only further choice is to keep a system turn, in place of deleting it. A path that is dearer
        # by more than that can never be the cheapest.
        if costs[SYSTEM] is not None and costs[SYSTEM] > costs[ASSISTANT]:
            nodes[SYSTEM] = costs[SYSTEM] = None
        if costs[NOTHING] is not None and costs[NOTHING] > costs[ASSISTANT] + COST[DELETE]:
            nodes[NOTHING] = costs[NOTHING] = None
        for node in filter(None, nodes):
            node.hold()
        for node in filter(None, old):
            node.release()
        self.nodes, self.costs = nodes, costs

    def resolved(self) -> Iterator[Node]:
        """The edits that all survivors share and that were not given before, in order."""
        while self.root.refs == 1 and self.root.next:
            self.root = self.root.next[0]
            self.root.parent = None
            yield self.root
            self.root.row = None

    def rest(self) -> Iterator[Node]:
        """The edits that are still open, on the cheapest path that may end here."""
        costs, nodes = list(self.costs), list(self.nodes)
        best = ASSISTANT
        if costs[NOTHING] is not None:
            if costs[NOTHING] < costs[best] or (costs[NOTHING] == costs[best] and _less(nodes[NOTHING], nodes[best])):
                best = NOTHING
        path, node = [], nodes[best]
        while node is not self.root:
            path.append(node)
            node = node.parent
        yield from reversed(path)


def _faults(last: str | None, seen: bool) -> str | None:
    if not last:
        return "blank"
    if seen:
        return "duplicate"
    return None if last in ".!?" else "truncated"


class _Out:
    """Arrow batches from rows, cut by their bytes of text."""

    def __init__(self, schema: pa.Schema, max_bytes: int = 8 << 20):
        self.schema, self.max_bytes = schema, max_bytes
        self.rows, self.held = [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size + 64
        if self.held >= self.max_bytes:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema
            )
        self.rows, self.held = [], 0


def _repaired(rows: Iterator[tuple], out: _Out) -> Iterator[pa.RecordBatch]:
    """Edits of the conversations in `rows` (id, turn, role, text, last visible sign, seen), in order."""
    current, survivors, place, before = None, None, 0, None

    def emit(nodes: Iterator[Node]) -> Iterator[pa.RecordBatch]:
        nonlocal place
        for node in nodes:
            turn, role, text, fault, illegal = node.row or (None, None, None, None, None)
            cost = COST[node.edit] + (TRUNCATED_COST if fault == "truncated" and node.edit != DELETE else 0)
            if node.edit == INSERT:
                text, fault, illegal = "", None, False
            place += 1
            # A deleted row keeps its own role and text; the others have those of the repaired turn.
            role = role if node.edit == DELETE else node.role
            yield from out.add((current[0], place, node.edit, turn, role, text, fault, illegal, cost), len(text.encode()))

    for key, turn, role, text, last, seen in rows:
        if current is None or current[0] != key:
            if survivors is not None:
                yield from emit(survivors.rest())
            current, survivors, place, before = (key,), Survivors(), 0, None
        # Equal rows of one turn are next to each other; the first of them is the one seen first.
        again = seen or (before is not None and before == (turn, role, text))
        illegal = before is not None and before[1][:1] + role[:1] not in LEGAL_PAIRS
        before = (turn, role, text)
        fault = _faults(last, again)
        survivors.step(role, fault, (turn, role, text, fault, illegal))
        yield from emit(survivors.resolved())
    if survivors is not None:
        yield from emit(survivors.rest())
    yield from out.flush()


def last_visible(text: Column) -> Column:
    """The last character that is not white space; empty if there is none."""
    return F.right(F.regexp_replace(text, rf"[{SPACE}]+$", ""), F.lit(1))


def repair(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row for every edit: id, place (from 1), edit, turn, role, text, fault, illegal, cost.

    Edits are K (keep, 0), R (give the role user or assistant, 2), D (delete, 3, required for blank
    and duplicate rows) and I (insert an empty turn, 2); a truncated row that stays costs 1 more. The
    cheapest edits after which the roles' first letters read `(s?(ua)+)?` are chosen, of equal ones the
    ASCII-least. `role` and `text` are those of the repaired turn, of a deleted row its own. `fault` is
    the row's first of blank (white space only), duplicate (role and text came before) and truncated
    (does not end in . ! or ?), and `illegal` says that it does not go with the row before it.

    Rows are taken by turn, missing turns first, then by role and text, which decide on rows of one
    turn; missing roles and texts are one space, and a missing id is a conversation of its own.
    Repeated rows are duplicates. An empty table gives no rows; other columns, whatever their names,
    are left behind.

    Whether a row came before is decided by a grouped minimum of turns with partial sums before the
    shuffle, so a very frequent turn is no hot group. One conversation is one chain of decisions: its rows
    pass through one task, in order, as a stream. The task holds the stretch that is still open, which
    is a few rows in dialogues; while every row in a row needs another role, none can be closed. Edits of one
    conversation stay in one partition, in order.
    """
    named = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
    )
    told = F.concat_ws(":", F.length("role").cast("string"), "role", "text")
    named = named.withColumn("said", F.sha2(told, 256)).withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    said = named.groupBy("conv_id", "said").agg(F.count("*").alias("times"), F.min("at").alias("first"))
    said = said.where("times > 1").select(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"), "first")
    met = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said"))
    rows = named.join(said, met, "left").select(
        "conv_id",
        "turn",
        "role",
        "text",
        last_visible(F.col("text")).alias("last"),
        F.coalesce(F.col("first") < F.col("at"), F.lit(False)).alias("seen"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    kinds = dict(rows.dtypes)
    schema = EDITS.format(key=kinds["conv_id"], turn=kinds["turn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        out = _Out(
            pa.schema(
                [
                    ("conv_id", first.schema.field("conv_id").type),
                    ("place", pa.int64()),
                    ("edit", pa.string()),
                    ("turn", first.schema.field("turn").type),
                    ("role", pa.string()),
                    ("text", pa.string()),
                    ("fault", pa.string()),
                    ("illegal", pa.bool_()),
                    ("cost", pa.int64()),
                ]
            )
        )

        def stream() -> Iterator[tuple]:
            batch = first
            while batch is not None:
                yield from zip(*(c.to_pylist() for c in batch.columns))
                batch = next(batches, None)

        yield from _repaired(stream(), out)

    return rows.mapInArrow(run, schema)


def report(edits: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for every conversation of `edits`, just as :func:`repair` gives them: each conversation in
    one partition, in order. Columns: id, gaps (turns missing between the least and the greatest),
    blank, duplicate, truncated, illegal, cost, audit (the edits' letters) and repaired_sha256 (of the
    repaired `role:text` lines). The texts are hashed as they pass and not gathered.
    """
    schema = (
        f"{id_col} {dict(edits.dtypes)['conv_id']}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
        "illegal bigint, cost bigint, audit string, repaired_sha256 string"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    slim = edits.select("conv_id", "edit", "turn", "role", "text", "fault", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None

        def closed() -> tuple:
            gaps = greatest - least + 1 - distinct if distinct else 0
            counted = (faults.get(f, 0) for f in ("blank", "duplicate", "truncated"))
            return (current[0], gaps, *counted, illegals, cost, audit.decode(), digest.hexdigest())

        for batch in batches:
            done = []
            for key, edit, turn, role, text, fault, illegal, price in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current[0] != key:
                    if current is not None:
                        done.append(closed())
                    current, faults, illegals, cost, audit = (key,), {}, 0, 0, bytearray()
                    digest, lines, least, greatest, distinct = hashlib.sha256(), 0, None, None, 0
                audit += edit.encode()
                cost += price
                illegals += bool(illegal)
                faults[fault] = faults.get(fault, 0) + 1
                if turn is not None and turn != greatest:
                    least = turn if least is None else least
                    greatest, distinct = turn, distinct + 1
                if edit != DELETE:
                    digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                    lines += 1
            if done:
                yield _report_batch(done, batch.schema.field("conv_id").type, names)
        if current is not None:
            yield _report_batch([closed()], batch.schema.field("conv_id").type, names)

    return slim.mapInArrow(run, schema)


def _report_batch(rows: list[tuple], key_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [key_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def damaged(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The turns with faults put in, which follow from crc32(`id:turn`) modulo 20: 0 drops the row, 1
    empties its text, 2 takes . ! and ? out of it, 3 repeats the row, 4 gives it the role user. Missing
    values are one space, in that key too; id and turn themselves stay as they are."""
    space = F.lit(" ")
    key = [F.coalesce(F.col(c).cast("string"), space) for c in (id_col, turn_col)]
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in (role_col, text_col))
    fault = F.crc32(F.concat(key[0], F.lit(":"), key[1]).cast("binary")) % 20
    rows = turns.select(F.col(id_col), F.col(turn_col), role.alias("_role"), text.alias("_text"), fault.alias("_fault"))
    rows = rows.where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("_role"))
    times = F.when(F.col("_fault") == 3, 2).otherwise(1)
    rows = rows.select(id_col, turn_col, role.alias(role_col), text.alias(text_col), F.explode(F.sequence(F.lit(1), times)).alias("_time"))
    return rows.drop("_time")
