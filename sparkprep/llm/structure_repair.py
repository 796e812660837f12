"""Conversation repair: the cheapest edits that make the roles of a conversation follow each other.

The roles' initials must read ``(s?(ua)+)?``: an optional system turn, then user and
assistant in turn. A row is kept (0), given the role user or assistant (2) or deleted
(3, the only choice for blank and duplicate rows); an empty user or assistant turn may
be inserted anywhere (2); a truncated row that stays costs 1 more. Of equally cheap
repairs the one whose edit initials (D, I, K, R) sort first is taken.

Each conversation passes once, in order, through a Viterbi search over four states
(nothing yet, after system, after user, after assistant). The best path into every
state is a leaf of a tree of backpointers whose nodes count their references: a path
that no state continues is freed at once, and when all survivors share an ancestor,
the edits up to it are settled and leave the task. Only the unresolved tails are
held. Ties are decided by the tails as a whole; every pair of survivors carries how
its strings compare, so that no tail is read again. A state that can no longer win,
because another one can imitate whatever it does at a lower total, is given up, so
that deleting everything so far is not kept alive as a possibility for ever. Where
the first edits truly hang on the last row (of user rows alone, an odd number wants
its one inserted turn first, an even number none), the tail is the whole conversation.

Defined results: a null role or text is one space; null turns come first; rows of one
turn follow their role, then their text; other roles' initials match nothing, so
their rows are renamed or deleted; a role that is the empty string has no initial.
Null conversation ids form one conversation. An empty table gives an empty table.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.llm.ordered import batched, grouped, streamed

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
RENAMED, DELETED, INSERTED, CUT_SHORT = 2, 3, 2, 1

# States: nothing yet, after a system, user, assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
# The state after a kept row, by state and role initial; and what a new or renamed turn is.
KEPT = {
    (NOTHING, "s"): SYSTEM,
    (NOTHING, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
MADE = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ENDS = (NOTHING, ASSISTANT)
# What it costs at most to go on from the first state (row) as one would from the second (column):
# inserted turns lead to it, and a system turn that only an unbegun conversation can keep is deleted.
IMITATES = (
    (0, 0, INSERTED, 0),
    (2 * INSERTED, 0, INSERTED, 2 * INSERTED),
    (INSERTED + DELETED, INSERTED, 0, INSERTED),
    (DELETED, 0, INSERTED, 0),
)
LEGAL = ("su", "ua", "au")

SPACE = " \t\n\v\f\r"
SOLID = re.compile(r"[^\x20\x09-\x0D]")

Edit = tuple[str, str, str]  # edit initial, role, text; a deleted row's role and text are what was deleted


class _Node:
    """One edit of a path; ``held`` counts the paths and survivors that go on from here."""

    __slots__ = ("before", "edit", "held")

    def __init__(self, before: _Node | None, edit: Edit | None) -> None:
        self.before, self.edit, self.held = before, edit, 0
        if before is not None:
            before.held += 1


_Path = tuple[int, int, tuple[Edit, ...]]  # cost, survivor that it goes on from, edits after it


def _release(node: _Node | None) -> None:
    while node is not None and node.held == 0:
        node, freed = node.before, node
        if node is not None:
            node.held -= 1
        freed.before = None


# How the edit strings of two paths compare: -1 or 1 once they differ; while one still begins
# with the other, 0 and what each has beyond the common part.
_Order = tuple[int, str, str]


def _compared(so_far: _Order, left: str, right: str) -> _Order:
    """The comparison after both paths went on."""
    sign, a, b = so_far
    if sign:
        return so_far
    a, b = a + left, b + right
    common = 0
    while common < min(len(a), len(b)) and a[common] == b[common]:
        common += 1
    a, b = a[common:], b[common:]
    return ((-1 if a < b else 1), "", "") if a and b else (0, a, b)


def _letters(edits: tuple[Edit, ...]) -> str:
    return "".join(e[0] for e in edits)


class Viterbi:
    """The search over one conversation: ``push`` takes its rows in order and returns the edits that are settled by then."""

    def __init__(self) -> None:
        self.root = _Node(None, None)
        self.root.held = 1
        self.best: dict[int, tuple[int, _Node]] = {NOTHING: (0, self.root)}
        # every pair of survivors, compared by their whole edit strings
        self.order: dict[tuple[int, int], _Order] = {(NOTHING, NOTHING): (0, "", "")}
        self._survive({NOTHING: (0, NOTHING, ())})

    def push(self, role: str, text: str, fault: str | None) -> Iterator[Edit]:
        paths: dict[int, _Path] = {}
        late = CUT_SHORT if fault == TRUNCATED else 0
        for state, (cost, _) in self.best.items():
            self._offer(paths, state, cost + DELETED, state, ((DELETE, role, text),))
            if fault in (BLANK, DUPLICATE):
                continue
            made, to = MADE[state]
            self._offer(paths, to, cost + RENAMED + late, state, ((REROLE, made, text),))
            kept = KEPT.get((state, role[:1]))
            if kept is not None:
                self._offer(paths, kept, cost + late, state, ((KEEP, role, text),))
        self._survive(paths)
        return self._settled()

    def finish(self) -> tuple[int, Iterator[Edit]]:
        """Cost of the best repair, and its edits that were not settled before."""
        last: dict[int, _Path] = {}
        for state in ENDS:
            if state in self.best:
                self._offer(last, NOTHING, self.best[state][0], state, ())
        cost, state, _ = last[NOTHING]
        return cost, (n.edit for n in self._path(self.best[state][1]))

    def _offer(self, paths: dict[int, _Path], state: int, cost: int, origin: int, edits: tuple[Edit, ...]) -> None:
        """Take a path into a state if it is cheaper than the one there, or as cheap and first in order."""
        there = paths.get(state)
        if there is not None:
            if cost > there[0]:
                return
            if cost == there[0]:
                sign, mine, _ = _compared(self.order[origin, there[1]], _letters(edits), _letters(there[2]))
                if sign > 0 or (sign == 0 and mine):
                    return
        paths[state] = (cost, origin, edits)

    def _survive(self, paths: dict[int, _Path]) -> None:
        """The paths, and those with turns inserted after them, become the survivors; states that cannot win go."""
        for _ in range(2):  # a third inserted turn never pays
            for state, (cost, origin, edits) in list(paths.items()):
                made, to = MADE[state]
                self._offer(paths, to, cost + INSERTED, origin, edits + ((INSERT, made, ""),))
        costs = {state: path[0] for state, path in paths.items()}
        paths = {s: p for s, p in paths.items() if all(c + IMITATES[other][s] >= p[0] for other, c in costs.items())}
        order = {
            (a, b): _compared(self.order[p[1], q[1]], _letters(p[2]), _letters(q[2])) for a, p in paths.items() for b, q in paths.items()
        }
        best, shared = {}, {}
        for state, (cost, origin, edits) in paths.items():
            node, letters = self.best[origin][1], ""
            for edit in edits:
                letters += edit[0]
                if (origin, letters) not in shared:
                    shared[origin, letters] = _Node(node, edit)
                node = shared[origin, letters]
            node.held += 1
            best[state] = (cost, node)
        old, self.best, self.order = self.best, best, order
        for _, node in old.values():
            node.held -= 1
            _release(node)

    def _path(self, node: _Node) -> list[_Node]:
        path = []
        while node is not self.root:
            path.append(node)
            node = node.before
        return path[::-1]

    def _settled(self) -> Iterator[Edit]:
        """The edits that all survivors share; their common end becomes the root."""
        if self.root.held > 1:
            return
        for node in self._path(next(iter(self.best.values()))[1]):
            if self.root.held > 1:
                break
            self.root = node
            node.before = None
            yield node.edit


def _fault(text: str, seen: bool) -> str | None:
    if not SOLID.search(text):
        return BLANK
    if seen:
        return DUPLICATE
    return None if text.rstrip(SPACE)[-1] in ".!?" else TRUNCATED


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Edits of one conversation: place, edit, turn, fault, role before, role and text after (null where deleted)."""
    search = Viterbi()
    waiting: deque[tuple] = deque()
    before = None
    place = 0

    def told(edits: Iterator[Edit]) -> Iterator[tuple]:
        nonlocal place
        for edit, role, text in edits:
            turn, fault, was = (None, None, None) if edit == INSERT else waiting.popleft()
            yield (place, edit, turn, fault, was, *((None, None) if edit == DELETE else (role, text)))
            place += 1

    for _, turn, role, text, seen in rows:
        fault = _fault(text, seen or (turn, role, text) == before)
        before = (turn, role, text)
        waiting.append((turn, fault, role))
        yield from told(search.push(role, text, fault))
    yield from told(search.finish()[1])


def _edits_schema(rows: DataFrame) -> T.StructType:
    schema = T.StructType([rows.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), rows.schema["turn"]])
    for name in ("fault", "was", "role", "text"):
        schema = schema.add(name, T.StringType())
    return schema


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation: ``conv_id, place`` (from 0), ``edit, turn, fault, was, role, text``.

    ``role`` and ``text`` are the repaired turn, null where it is deleted; ``was`` is
    the row's role before, null for inserted turns. The repaired conversation is the
    rows whose edit is not D, by ``place``. A task returns a conversation's edits one
    after another and in order.
    """
    space = F.lit(" ")
    given = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    keyed = given.withColumns({"t1": F.xxhash64("role", "text"), "t2": F.xxhash64(F.lit("second"), "text", "role")})
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # contents that come back at a later turn; those of one turn stand side by side when sorted
    repeated = keyed.groupBy("conv_id", "t1", "t2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last")
    repeated = repeated.select(F.col("conv_id").alias("r_conv"), F.col("t1").alias("r1"), F.col("t2").alias("r2"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2"))
    marked = keyed.join(repeated, same, "left")
    marked = marked.select("conv_id", "turn", "role", "text", F.coalesce(at > F.col("first"), F.lit(False)).alias("seen"))
    schema = _edits_schema(rows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((key + edit for key, found in grouped(batches, 1) for edit in _repaired(found)), schema)

    return streamed(marked, ["conv_id"], ["turn", "role", "text"]).mapInArrow(search, schema)


def summary(edits: DataFrame) -> DataFrame:
    """One row per conversation: its faults, its repair's cost and edits, and a digest of the repaired turns.

    Reads the edits as ``repair`` returns them, each conversation whole and in order.
    ``illegal`` counts neighbouring rows, before the repair, whose role initials do not
    follow each other; ``gaps`` the turn numbers missing between the least and the
    greatest.
    """
    counts = ["gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost"]
    schema = T.StructType([edits.schema["conv_id"]] + [T.StructField(c, T.LongType()) for c in counts])
    schema = schema.add("audit", T.StringType()).add("repaired_sha256", T.StringType())

    def digest(key: tuple, rows: Iterator[tuple]) -> tuple:
        n = dict.fromkeys(counts, 0)
        audit, text, initial = io.StringIO(), hashlib.sha256(), None
        low = high = None
        distinct = kept = 0
        for _, edit, turn, fault, was, role, said in rows:
            audit.write(edit)
            n["cost"] += {KEEP: 0, REROLE: RENAMED, DELETE: DELETED, INSERT: INSERTED}[edit]
            if edit != DELETE:
                text.update((("\n" if kept else "") + f"{role}:{said}").encode())
                kept += 1
                n["cost"] += CUT_SHORT if fault == TRUNCATED else 0
            if edit == INSERT:
                continue
            if fault is not None:
                n[fault] += 1
            if initial is not None and initial + was[:1] not in LEGAL:
                n["illegal"] += 1
            initial = was[:1]
            if turn is not None:
                distinct += turn != high
                low, high = turn if low is None else low, turn
        n["gaps"] = 0 if low is None else high - low + 1 - distinct
        return key + tuple(n.values()) + (audit.getvalue(), text.hexdigest())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((digest(key, (r[1:] for r in rows)) for key, rows in grouped(batches, 1)), schema)

    return edits.mapInArrow(read, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by a hash of conversation and turn: dropped, emptied, unpunctuated, repeated, renamed."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(c, space) for c in ("role", "text"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("planted")).where("planted <> 0")
    text = F.when(F.col("planted") == 1, "").when(F.col("planted") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("planted") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("planted") == 3, 2).otherwise(1))).alias("copy")
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")
