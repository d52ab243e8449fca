"""Operator 11: conversation repair by generalised LR parsing over the grammar of roles.

The grammar's LR(0) tables are built here from its productions. Rows of a conversation are the input. The graph-structured stack has
one vertex for each LR state that ends some stack after the rows so far; a vertex points to the one below. Of stacks with equal
tops the least (cost, audit) stays: under each top of this grammar the same continuations are accepted (a test checks it), so
the others can't win. A row is kept, given another role, or deleted; a role may be inserted before, between and after the rows.
Reductions follow each shift at once, but the one that ends the parse. A stack carries its cost, the edits' initials and a running
SHA-256 of its repaired rows, so a conversation is one pass that holds neither its rows nor its texts: memory is a few bytes of audit a row.
Stacks dearer than the cheapest by more than one insertion and one deletion go, as the cheapest can do what they can for less.

Faults of rows are column expressions before that: a row is a duplicate if an earlier one has its role and text,
which a window over (conversation, hashes of role and text) tells, so that a conversation with a third of all rows is dealt over tasks
there. The last pass of such a conversation is one task's stream over sorted rows, as the digest of its text in order demands.

Defined results: a null conv_id or turn stands as one blank in the key that chooses the damage, and a null role or text becomes one
blank; rows of a null conv_id are one conversation, returned with a null conv_id. Rows are ordered by turn (null first), then role and text;
repeated rows are rows and thus duplicates. A role that starts with none of s, u, a, or is empty, can't be kept. Empty and blank texts are
blank; very long texts are hashed as they pass. A conversation with no rows left has zeros, an empty audit and the hash of nothing. An
empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Role initials of a sound conversation: nothing, or an optional s and then pairs of u and a. The first production starts.
GRAMMAR = (("C", ""), ("C", "P"), ("P", "T"), ("P", "sT"), ("P", "PT"), ("T", "ua"))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What any stack can do at most costs any other that much more: one insertion and one deletion. Dearer stacks can't win.
DETOUR = INSERT + DELETE
BLANK, DUPLICATE, CUT = 1, 2, 3
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Tables:
    """LR(0) states of a grammar: ``go[state][symbol]``; ``ready[state]``: productions complete there; ``only[state]``: whether that is all."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar, heads = grammar, {h for h, _ in grammar}
        start = self._closed({(k, 0) for k, (h, _) in enumerate(grammar) if h == grammar[0][0]}, heads)
        states, self.go, self.ready, self.only = [start], [], [], []
        for items in states:
            then: dict[str, set] = {}
            for k, dot in items:
                if dot < len(grammar[k][1]):
                    then.setdefault(grammar[k][1][dot], set()).add((k, dot + 1))
            row = {}
            for symbol in sorted(then):
                target = self._closed(then[symbol], heads)
                if target not in states:
                    states.append(target)
                row[symbol] = states.index(target)
            self.go.append(row)
            self.ready.append(sorted(k for k, dot in items if dot == len(grammar[k][1])))
            self.only.append(len(self.ready[-1]) == 1 and not row)

    def _closed(self, items: set, heads: set) -> frozenset:
        todo = list(items)
        for k, dot in todo:
            symbol = self.grammar[k][1][dot : dot + 1]
            for new in [(j, 0) for j, (h, _) in enumerate(self.grammar) if symbol in heads and h == symbol]:
                if new not in items:
                    items.add(new)
                    todo.append(new)
        return frozenset(items)

    def reduced(self, stack: tuple, k: int) -> tuple:
        """The stack after production k; a stack is (state, stack below)."""
        head, body = self.grammar[k]
        for _ in body:
            stack = stack[1]
        return (self.go[stack[0]][head], stack)

    def shifted(self, stack: tuple, symbol: str) -> tuple | None:
        """The stack after a terminal and the reductions that must follow."""
        target = self.go[stack[0]].get(symbol) if symbol else None
        if target is None:
            return None
        stack = (target, stack)
        while self.only[stack[0]] and self.grammar[self.ready[stack[0]][0]][0] != self.grammar[0][0]:
            stack = self.reduced(stack, self.ready[stack[0]][0])
        return stack

    def ends(self, state: int) -> bool:
        """Whether the input may end there: the start symbol is reached by a reduction."""
        return any(self.grammar[k][0] == self.grammar[0][0] for k in self.ready[state])


TABLES = Tables()


class Branch:
    """A stack with its cost and audit: settled pieces (linked), a tail, and ``pending`` insertions after the last row.

    ``rank`` orders the audits up to the last row: none of these goes on another, as all end with a row's edit, so ranks
    and what comes after them order longer audits without the strings.
    """

    __slots__ = ("stack", "cost", "rank", "pending", "pieces", "tail", "digest", "filled")

    def __init__(self, stack, cost=0, rank=0, pending=0, pieces=None, tail="", digest=None, filled=False):
        self.stack, self.cost, self.rank, self.pending, self.pieces, self.tail = stack, cost, rank, pending, pieces, tail
        self.digest, self.filled = digest or hashlib.sha256(), filled

    def after(self, lines: tuple[str, ...] | None) -> tuple:
        """The digest, and whether it holds a row, after one more repaired row (None: no more)."""
        if lines is None:
            return self.digest, self.filled
        digest = self.digest.copy()
        if self.filled:
            digest.update(b"\n")
        for part in lines:
            digest.update(part.encode())
        return digest, True


class Repair:
    """The stacks of one conversation after the rows so far, by their tops, closed under insertions."""

    def __init__(self):
        self.tops = self._inserted({0: Branch((0, None))})

    @staticmethod
    def _inserted(tops: dict[int, Branch]) -> dict[int, Branch]:
        todo = sorted(tops, key=lambda s: (tops[s].cost, tops[s].rank, tops[s].pending))
        while todo:
            was = tops[todo.pop(0)]
            for initial, role in ROLES.items():
                stack = TABLES.shifted(was.stack, initial)
                if stack is None:
                    continue
                old, new = tops.get(stack[0]), (was.cost + INSERT, was.rank, was.pending + 1)
                if old is None or new < (old.cost, old.rank, old.pending):
                    tops[stack[0]] = Branch(stack, *new, was.pieces, was.tail, *was.after((role, ":")))
                    todo.append(stack[0])
        least = min(x.cost for x in tops.values())
        return {s: x for s, x in tops.items() if x.cost <= least + DETOUR}

    def row(self, role: str, text: str, fault: int) -> None:
        late = TRUNCATED if fault == CUT else 0
        best: dict[int, tuple] = {}
        for was in self.tops.values():
            edits = [("D", was.stack, DELETE, None)]
            if fault not in (BLANK, DUPLICATE):
                edits.append(("K", TABLES.shifted(was.stack, role[:1]), late, (role, ":", text)))
                edits += [("R", TABLES.shifted(was.stack, i), REROLE + late, (other, ":", text)) for i, other in ROLES.items() if i != role[:1]]
            for letter, stack, cost, lines in edits:
                if stack is not None:
                    key = (was.cost + cost, was.rank, "I" * was.pending + letter)
                    if stack[0] not in best or key < best[stack[0]][0]:
                        best[stack[0]] = key, was, stack, lines
        order = {k: n for n, k in enumerate(sorted({key[1:] for key, *_ in best.values()}))}
        tops = {}
        for top, (key, was, stack, lines) in best.items():
            pieces, tail = was.pieces, was.tail + key[2]
            if len(tail) > 256:
                pieces, tail = (pieces, tail), ""
            tops[top] = Branch(stack, key[0], order[key[1:]], 0, pieces, tail, *was.after(lines))
        self.tops = self._inserted(tops)

    def result(self) -> tuple[int, str, str]:
        """Cost, audit, and the digest of the repaired rows."""
        won = min((x for s, x in self.tops.items() if TABLES.ends(s)), key=lambda x: (x.cost, x.rank, x.pending))
        parts, pieces = [won.tail + "I" * won.pending], won.pieces
        while pieces:
            pieces, part = pieces
            parts.append(part)
        return won.cost, "".join(reversed(parts)), won.digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: a fifth of the rows dropped, emptied, cut, repeated or given to the user, by their keys' checksum."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role").alias("role"), blank("text").alias("text"))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("again"))
    return rows.drop("again")


def ending(text: Column) -> Column:
    """The text without blanks at its end."""
    return F.rtrim(text, F.lit(" \t\n\x0b\f\r"))


def faults(rows: DataFrame) -> DataFrame:
    """The rows with ``fault``: 0, BLANK, DUPLICATE or CUT."""
    hashes = [F.xxhash64(F.lit(seed), "role", "text").alias(f"h{seed}") for seed in (1, 2)]
    rows = rows.select("*", *hashes)
    nth = F.row_number().over(Window.partitionBy("conv_id", "h1", "h2").orderBy("turn"))
    solid = ending(F.col("text"))
    fault = F.when(solid == "", BLANK).when(nth > 1, DUPLICATE).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), CUT).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault"))


class Conversation:
    """What one pass over a conversation's rows in order gathers."""

    def __init__(self, conv):
        self.conv, self.repair = conv, Repair()
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.role: str | None = None
        self.counts = {BLANK: 0, DUPLICATE: 0, CUT: 0}

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        self.illegal += self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au")
        self.role = role
        if fault:
            self.counts[fault] += 1
        self.repair.row(role, text, fault)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, *self.counts.values(), self.illegal, *self.repair.result())


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place; one row out as each conversation ends."""
    now, out = None, []
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=REPAIRED.replace(" long", "").replace(" string", "").split(", "))

    for batch in batches:
        ids, turns, roles, faults_ = (batch.column(c).to_pylist() for c in (0, 1, 2, 4))
        for k in range(batch.num_rows):
            if now is None or ids[k] != now.conv:
                if now is not None:
                    out.append(now.result())
                now = Conversation(ids[k])
            now.row(turns[k], roles[k], batch.column(3)[k].as_py(), faults_[k])
        if len(out) > 2000:
            yield rows()
            out = []
    if now is not None:
        out.append(now.result())
    if out:
        yield rows()


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of rows with faults."""
    spread = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", F.col("fault") == DUPLICATE)
    return spread.select("conv_id", "turn", "role", "text", "fault").mapInArrow(_streamed, REPAIRED)


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Every conv_id of ``conversations`` with the counts and the repair of ``rows``, which have faults."""
    found = repaired(rows).withColumnRenamed("conv_id", "_conv")
    ids = conversations.select(F.col("conv_id").cast("long")).distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
