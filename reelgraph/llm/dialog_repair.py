"""Conversation structure repair: the cheapest edits that turn a conversation's roles into ``(s?(ua)+)?``, with their audit trail.

A row's first fault counts: *blank* (no character but space, tab, LF, VT, FF, CR), *duplicate* (role and text seen earlier in the
conversation), *truncated* (last such character not ``.``, ``!`` or ``?``).  Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the
only edit of a blank or duplicate row), Insert an empty user or assistant turn anywhere 2; a truncated row that stays adds 1.  Of all
edit sequences of least cost, whose letters K, R, D, I in order are the *audit*, the one that is least in ASCII order is taken.

Method, a dynamic program over the four states of the pattern (nothing yet, after ``s``, after ``u``, after ``a``):

* The audit of a state is a node linked to its prefix, so prefixes are shared and an edit costs one node (``Audits``).
* Every node keeps the ancestors 1, 2, 4, ... edits back and a rolling hash of its text.  Audits of equal cost are compared at their
  longest common prefix, found by lifting both nodes while the hashes differ.  The prefix is then verified by walking both nodes to
  their meeting point (mostly none to walk), and a collision falls back to the texts.
* Two audits of one row, state and cost never are prefixes of each other (they hold as many letters other than I, and each I costs 2),
  so the least prefix stays the least when more letters follow.

Plan: one shuffle by conversation, an external sort, and an Arrow pass that reads the sorted rows as a stream.  A task never holds a
conversation's texts: each live state carries the digest of the lines it would write.  Every ``SETTLE`` rows the letters that all live
states share are final and put away as text, and states that can't lead to a least cost any more are dropped.  A conversation of any length
is one stream because the digest of its repaired text is sequential.  The letters it still holds are at most those of its audit, which is
one value of the result.

Nulls and edges: a null role or text is one space; ``turn`` orders null first, then ties by role and text; a null ``conv_id`` is a
conversation of its own.  A role whose first character is none of s, u, a can't be kept; an empty role has no initial and can't be kept
either.  A conversation without rows has zeros, an empty audit and an empty text.  Repeated rows are duplicates.  Columns other than
conv_id, turn, role, text (and ``present``) are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SETTLE = 4_096
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "", "user", "assistant")
NEVER = 1 << 60

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "line long, edit string, role string, text string"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): the rows with seeded faults, for measuring a repair.

    crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row (it stays with ``present`` false, to name its conversation), 1 empties
    the text, 2 removes its ``.!?``, 3 repeats the row, 4 sets the role user.  Nulls are one space in every text.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"])) % 20
    rows = rows.select("conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), fate.alias("fate"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fate") != 0).alias("present"),
    )


class Audits:
    """Edit sequences as linked nodes; node 0 is the empty one.  ``bits`` is the size of the rolling hash."""

    def __init__(self, bits: int = 61):
        self.mod = (1 << bits) - 1
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[]]  # ancestors 1, 2, 4, ... edits back

    def add(self, parent: int, letter: str) -> int:
        up = [parent]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * 1_000_003 + ord(letter)) % self.mod)
        self.up.append(up)
        return len(self.letter) - 1

    def at(self, node: int, depth: int) -> int:
        """The ancestor with so many edits."""
        back = self.depth[node] - depth
        while back:
            k = back.bit_length() - 1
            node = self.up[node][k]
            back -= 1 << k
        return node

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(letters))

    def _same(self, a: int, b: int) -> bool:
        """Whether two nodes of equal depth have equal texts, letter by letter up to where they meet."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` comes before that of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.at(a, depth), self.at(b, depth)
        if self.hash[x] == self.hash[y]:
            return self.depth[a] < self.depth[b] if self._same(x, y) else self.text(a) < self.text(b)
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if not self._same(self.up[x][0], self.up[y][0]):
            return self.text(a) < self.text(b)
        return self.letter[x] < self.letter[y]


class Repair:
    """One conversation, row by row: its faults and the live states of the program.

    Each live state carries the digest of the lines it would write, so no text waits for a decision.  With ``emit``, which takes
    (line, edit, role, text), the rows wait until their edits are settled.
    """

    def __init__(self, emit=None, settle: int = SETTLE, bits: int = 61):
        self.emit, self.settle, self.bits = emit, settle, bits
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.rows = self.illegal = self.distinct = self.line = 0
        self.least = self.most = self.last_turn = None
        self.last_initial: str | None = None
        self.audits = Audits(bits)
        self.cost, self.node = [0, NEVER, NEVER, NEVER], [0, 0, 0, 0]
        self.digest = [hashlib.sha256()] * 4
        self._inserts()
        self.waiting: list[tuple[str, str]] = []
        self.trail: list[str] = []
        self.state = START

    def _offer(self, best: list, state: int, source: int, cost: int, letter: str) -> None:
        """Keep the cheaper way into ``state``, of equal ones the least audit."""
        cost += self.cost[source]
        old = best[state]
        if old is None or cost < old[0]:
            best[state] = (cost, source, letter, None)
        elif cost == old[0]:
            was = old[3] if old[3] is not None else self.audits.add(self.node[old[1]], old[2])
            now = self.audits.add(self.node[source], letter)
            best[state] = (cost, source, letter, now) if self.audits.less(now, was) else (*old[:3], was)

    def _line(self, source: int, role: str, text: str):
        """The digest of a state with one line more; nothing is written before the first state is left."""
        digest = self.digest[source].copy()
        digest.update(f"{chr(10) if source != START else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        return digest

    def _take(self, best: list, role: str, text: str) -> None:
        cost, node, digest = [NEVER] * 4, [0] * 4, list(self.digest)
        for s, way in enumerate(best):
            if way is not None:
                cost[s], source, letter, made = way
                node[s] = made if made is not None else self.audits.add(self.node[source], letter)
                digest[s] = self.digest[source]
                if letter != "D":
                    digest[s] = self._line(source, NAMES[s] if letter == "R" else role, text)
        self.cost, self.node, self.digest = cost, node, digest

    def _inserts(self) -> None:
        """Ways by one inserted turn more.  Twice around costs 4 and leads back, so one pass is enough."""
        for target, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            for s in sources:
                cost = self.cost[s] + INSERT
                if cost <= self.cost[target] and self.cost[s] < NEVER:
                    node = self.audits.add(self.node[s], "I")
                    if cost < self.cost[target] or self.audits.less(node, self.node[target]):
                        self.cost[target], self.node[target], self.digest[target] = cost, node, self._line(s, NAMES[target], "")

    def _drop(self) -> None:
        """Forget states that stay dearer than ``after a`` whatever follows: it can do all they can for 3, 0 or 2 more."""
        for s, more in ((START, 3), (SYSTEM, 0), (USER, 2)):
            if self.cost[s] > self.cost[ASSISTANT] + more:
                self.cost[s] = NEVER

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        body = text.rstrip(BLANK)
        blank, cut = not body, False
        if blank:
            self.faults["blank"] += 1
        elif repeated:
            self.faults["duplicate"] += 1
        elif body[-1] not in ".!?":
            self.faults["truncated"] += 1
            cut = True
        if turn is not None:
            if self.last_turn is None or turn != self.last_turn:
                self.distinct += 1
            self.least = turn if self.least is None else self.least
            self.most = self.last_turn = turn
        initial = role[:1]
        if self.rows and self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial

        best: list = [None] * 4
        extra = TRUNCATED if cut else 0
        for s in range(4):
            if self.cost[s] >= NEVER:
                continue
            self._offer(best, s, s, DELETE, "D")
            if blank or repeated:
                continue
            target, wanted = (ASSISTANT, "a") if s == USER else (USER, "u")
            if initial == wanted:
                self._offer(best, target, s, KEEP + extra, "K")
            elif s == START and initial == "s":
                self._offer(best, SYSTEM, s, KEEP + extra, "K")
            self._offer(best, target, s, REROLE + extra, "R")
        self._take(best, role, text)
        self._inserts()
        self._drop()
        self.rows += 1
        if self.emit is not None:
            self.waiting.append((role, text))
        if self.rows % self.settle == 0:
            self._settle()

    def _settle(self) -> None:
        """Put away what all live states share and keep the rest in a new, small store."""
        live = [s for s in range(4) if self.cost[s] < NEVER]
        texts = {s: self.audits.text(self.node[s]) for s in live}
        shared = os.path.commonprefix(list(texts.values()))
        self._write(shared)
        self.audits, known = Audits(self.bits), {}
        for s in live:
            node = 0
            for letter in texts[s][len(shared):]:
                if (node, letter) not in known:
                    known[node, letter] = self.audits.add(node, letter)
                node = known[node, letter]
            self.node[s] = node

    def _write(self, letters: str) -> None:
        """Note settled edits, and emit the rows they make.  The letters alone give the roles: the pattern leaves one choice."""
        self.trail.append(letters)
        if self.emit is None:
            return
        rows = iter(self.waiting)
        used = 0
        for letter in letters:
            role, text = "", ""
            if letter != "I":
                role, text = next(rows)
                used += 1
            if letter == "D":
                continue
            if letter == "K" and self.state == START and role[:1] == "s":
                self.state = SYSTEM
            else:
                self.state = ASSISTANT if self.state == USER else USER
                role = role if letter == "K" else NAMES[self.state]
            self.emit(self.line, letter, role, text)
            self.line += 1
        del self.waiting[:used]

    def result(self) -> tuple:
        """The report's values after the last row."""
        if not self.rows:
            return 0, 0, 0, 0, 0, 0, "", self.digest[START].hexdigest()
        end = START if self.cost[START] < self.cost[ASSISTANT] else ASSISTANT
        if self.cost[START] == self.cost[ASSISTANT] and self.audits.less(self.node[START], self.node[ASSISTANT]):
            end = START
        self._write(self.audits.text(self.node[end]))
        gaps = self.most - self.least + 1 - self.distinct if self.distinct else 0
        return gaps, *self.faults.values(), self.illegal, self.cost[end], "".join(self.trail), self.digest[end].hexdigest()


def _ordered(rows: DataFrame) -> DataFrame:
    """Each conversation's rows together and in order, with ``repeated`` on those whose role and text came earlier."""
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")}
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text["role"], text["text"], present.alias("present"))
    turn = F.col("turn").asc_nulls_first()
    earlier = Window.partitionBy("conv_id", "role", "text", "present").orderBy(turn)
    rows = rows.repartition("conv_id").withColumn("repeated", F.row_number().over(earlier) > 1)
    return rows.sortWithinPartitions("conv_id", turn, "role", "text", "repeated")


def _streamed(rows: DataFrame, turns: bool) -> DataFrame:
    fields = T.StructType.fromDDL(TURNS if turns else REPORT).fields
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *fields])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        ids: list = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(ids, id_type), *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True))]
            out = pa.RecordBatch.from_arrays(columns, names=names)
            made.clear()
            ids.clear()
            return out

        types = [pa.string() if f.dataType == T.StringType() else pa.int64() for f in schema.fields[1:]]
        names = schema.names
        current, repair, id_type = None, None, None

        def emit(*turn) -> None:
            ids.append(current)
            made.append(turn)

        def close() -> None:
            values = repair.result()
            if not turns:
                ids.append(current)
                made.append(values)

        for table in tables:
            id_type = table.column(0).type
            for conv, turn, role, text, present, repeated in zip(*(c.to_pylist() for c in table.columns), strict=True):
                if repair is None or conv != current:
                    if repair is not None:
                        close()
                    current, repair = conv, Repair(emit if turns else None)
                if present:
                    repair.add(turn, role, text, repeated)
                if len(made) >= 2_000:
                    yield batch()
        if repair is not None:
            close()
        if made:
            yield batch()

    return _ordered(rows).mapInArrow(run, schema)


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    ``gaps`` are turn numbers missing between the first and the last, ``illegal`` neighbours whose initials are not su, ua or au, the
    digest is that of the repaired ``role:text`` lines.  A row with ``present`` false only names its conversation.
    """
    return _streamed(rows, turns=False)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, line, edit, role, text), lines from 0 in order."""
    return _streamed(rows, turns=True)
