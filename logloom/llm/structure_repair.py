r"""Repair of the structure of conversations: the cheapest edits after which turns alternate, and an audit of them.

A conversation is legal if its roles' initials read ``(s?(ua)+)?``.  A row is kept (0), given the role user or assistant (1), or deleted (2, which
blank and repeated rows have to be); an empty turn of a user or an assistant costs 5, and so does a truncated row that isn't deleted.  The
audit is the edits' initials (K, R, D, I) in order; of audits of one cost the least by its characters stands.

The edits are a shortest path: after each row one of four states (nothing yet, s, u, a), each with its cost and its audit.  Audits
are *persistent*: an edit is a node behind its prefix, which other audits share, with a rolling hash and its ancestors at distances of powers of
two.  Two audits of one cost are compared by a binary search for their longest common prefix; where hashes agree, the prefixes are compared.
Insertions are written before the edit that follows them, so audits of the same rows are never prefixes of each other, and the first difference decides.

A conversation of any length is cut into blocks of rows, which are solved apart from each other, from every state in which one may begin; the
best audits of a block are only ranked, and a second path over blocks (numbers, no texts) picks one of each.  So a conversation that holds a
third of all rows is many tasks' work.  What is one value for each conversation, the audit and the hash of its repaired text, is
put together in one task, the hash as a stream of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, table

#: Rows and bytes of texts of a block; step strings that a worker remembers, and the length of the longest.
ROWS, BYTES, KNOWN, SHORT = 2048, 1_000_000, 20_000, 64
SPACE = r"\x20\x09-\x0D"
LEGAL = ("su", "ua", "au")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Insertions from each state: cost, what the audit says, and the state behind them.
INSERTED = (
    ((0, "", NOTHING), (5, "I", USER), (10, "II", ASSISTANT)),
    ((0, "", SYSTEM), (5, "I", USER), (10, "II", ASSISTANT)),
    ((0, "", USER), (5, "I", ASSISTANT)),
    ((0, "", ASSISTANT), (5, "I", USER)),
)
#: What ends a conversation from each state.
ENDS = ((0, ""), (10, "II"), (5, "I"), (0, ""))


def _edits(kind: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Edit, cost and next state of a row: X must be deleted, s, u, a and o (other) are roles, upper case is truncated."""
    yield "D", 2, state
    if kind == "X":
        return
    extra, to = 5 * kind.isupper(), ASSISTANT if state == USER else USER
    role = kind.lower()
    if role == "s" and state == NOTHING:
        yield "K", extra, SYSTEM
    if role == {USER: "u", ASSISTANT: "a"}[to]:
        yield "K", extra, to
    yield "R", 1 + extra, to


def _steps(kind: str) -> list[tuple[int, int, int, str]]:
    """State, next state, cost and what the audit says: the best of each pair of states."""
    best = {}
    for state in range(4):
        for cost, before, at in INSERTED[state]:
            for edit, more, to in _edits(kind, at):
                found = (cost + more, before + edit)
                best[state, to] = min(best.get((state, to), found), found)
    return [(a, b, *found) for (a, b), found in best.items()]


STEPS = {kind: _steps(kind) for kind in "XsuaoSUAO"}


class Linked:
    """Nodes behind their parents, with the ancestors at distances of powers of two."""

    def __init__(self):
        self.depth, self.up = [0], [()]

    def link(self, parent: int) -> int:
        jumps, k = [parent], 0
        while k < len(self.up[jumps[k]]):
            jumps.append(self.up[jumps[k]][k])
            k += 1
        self.depth.append(self.depth[parent] + 1)
        self.up.append(jumps)
        return len(self.up) - 1

    def ancestor(self, node: int, depth: int) -> int:
        over = self.depth[node] - depth
        while over:
            k = over.bit_length() - 1
            node = self.up[node][k]
            over -= 1 << k
        return node

    def parted(self, a: int, b: int, same) -> tuple[int, int]:
        """Where two nodes of one depth part: the first ancestors that aren't the same, of parents that are."""
        for k in reversed(range(len(self.up[a]))):
            if k < len(self.up[a]) and not same(self.up[a][k], self.up[b][k]):
                a, b = self.up[a][k], self.up[b][k]
        return a, b


class Audits(Linked):
    """Persistent audits: node 0 is the empty one."""

    BASE, PRIME = 911_382_323, (1 << 61) - 1

    def __init__(self):
        super().__init__()
        self.char, self.hash, self.verified = [""], [0], set()

    def add(self, node: int, text: str) -> int:
        for c in text:
            parent, node = node, self.link(node)
            self.char.append(c)
            self.hash.append((self.hash[parent] * self.BASE + ord(c)) % self.PRIME)
        return node

    def equal(self, a: int, b: int) -> bool:
        """Whether two audits of one length agree: if their hashes do, they are walked up to what is known to agree."""
        if self.hash[a] != self.hash[b]:
            return False
        x, y = a, b
        while x != y and (x, y) not in self.verified:
            if self.char[x] != self.char[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        self.verified.add((a, b))
        return True

    def less(self, a: int, b: int) -> bool:
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.equal(x, y):
            return self.depth[a] < self.depth[b]
        x, y = self.parted(x, y, self.equal)
        return self.char[x] < self.char[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.char[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def solve(kinds: str, entry: int) -> dict[int, tuple[int, str]]:
    """Of each state behind the rows the least cost and the least audit of that cost, from the state ``entry``."""
    audits, cells = Audits(), {entry: (0, 0)}
    for kind in kinds:
        found = {}  # cost, node before, what is added, node if it was made already
        for state, to, cost, added in STEPS[kind]:
            if state not in cells:
                continue
            before = cells[state]
            new, old = [before[0] + cost, before[1], added, None], found.get(to)
            if old and new[0] == old[0]:
                for one in (old, new):
                    one[3] = one[3] or audits.add(one[1], one[2])
                if audits.less(new[3], old[3]):
                    found[to] = new
            elif not old or new[0] < old[0]:
                found[to] = new
        cells = {to: (cost, made or audits.add(node, added)) for to, (cost, node, added, made) in found.items()}
    return {state: (cost, audits.text(node)) for state, (cost, node) in cells.items()}


_solved: dict[tuple[str, int], dict[int, tuple[int, str]]] = {}


def _solve(kinds: str, entry: int) -> dict[int, tuple[int, str]]:
    if len(kinds) > SHORT:
        return solve(kinds, entry)
    if len(_solved) > KNOWN:
        _solved.clear()
    if (kinds, entry) not in _solved:
        _solved[kinds, entry] = solve(kinds, entry)
    return _solved[kinds, entry]


class Picks(Linked):
    """A path over blocks: a node is the audit that was taken in a block, its depth the block's number."""

    def __init__(self):
        super().__init__()
        self.state, self.ranks = [NOTHING], [None]

    def less(self, a: int, b: int) -> bool:
        a, b = self.parted(a, b, lambda x, y: x == y)
        ranks = self.ranks[self.depth[a]]
        return ranks[4 * self.state[self.up[a][0]] + self.state[a]] < ranks[4 * self.state[self.up[b][0]] + self.state[b]]

    def block(self, cells: dict, costs: list, ranks: list) -> dict:
        self.ranks.append(ranks)
        found = {}
        for state, (cost, node) in cells.items():
            for to in range(4):
                if costs[4 * state + to] is None:
                    continue
                total = cost + costs[4 * state + to]
                if to in found and found[to][0] < total:
                    continue
                new = self.link(node)
                self.state.append(to)
                if to not in found or total < found[to][0] or self.less(new, found[to][1]):
                    found[to] = (total, new)
        return found

    def end(self, cells: dict) -> tuple[int, int, str]:
        """Cost and node of the best legal end, and what is inserted last."""
        best = None
        for state, (cost, node) in sorted(cells.items()):
            total = cost + ENDS[state][0]
            if best is None or total < best[0] or total == best[0] and node and self.less(node, best[1]):
                best = (total, node, ENDS[state][1])
        return best


def damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of conversations with faults: nulls are one space, and the remainder of
    crc32("conv_id:turn") by 20 drops a row (0), empties its text (1), takes its ends of sentences (2), repeats it (3), or makes it the user's (4)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = df.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("h")).filter("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("h") == 3, 2).otherwise(1).alias("copies"))


def _rows(df: DataFrame) -> DataFrame:
    """The columns that count, without nulls but in conv_id and turn, and the digest of the text."""
    copies = F.col("copies").cast("long") if "copies" in df.columns else F.lit(1).cast("long")
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _same(names: list[str], left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A join on columns that may be null; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in names else F.col(c) for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names]
    return left.join(renamed, on, how).drop(*[f"__{c}" for c in names])


def _place(batches: Iterator[pa.RecordBatch], most: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that come sorted: part, blk, at (in the block), and whether the conversation surely begins in this partition."""
    part, blk, at, size = TaskContext.get().partitionId(), -1, 0, 0
    last, first = object(), object()  # the conversation before, and the partition's first one
    for batch in batches:
        columns = ([], [], [])
        for conv, more in zip(batch.column("conv_id").to_pylist(), batch.column("size").to_pylist(), strict=True):
            if type(last) is object:
                first = conv
            if type(last) is object or conv != last or at == most or size + more > most_bytes:
                # the first block of a conversation that isn't the partition's first
                begins = type(last) is not object and conv != last and conv != first
                blk, at, size, last = blk + 1, 0, 0, conv
            columns[0].append(blk)
            columns[1].append(at)
            columns[2].append(begins)
            at, size = at + 1, size + more
        names = [*batch.schema.names, "part", "blk", "at", "begins"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.bool_()), strict=True)]], names)


def _adjacent(initials: list[str], copies: list[int]) -> int:
    """Neighbours that may not be: rows that are repeated never may stand side by side."""
    return sum(n - 1 for n in copies) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _solutions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the audits from state to state (16), their costs and ranks."""
    for batch in batches:
        out = {"audits": [], "costs": [], "ranks": [], "illegal": []}
        for kinds, initials, copies, begins in zip(*[batch.column(c).to_pylist() for c in ("kinds", "initials", "copies", "begins")], strict=True):
            audits, costs, ranks = [None] * 16, [None] * 16, [None] * 16
            steps = "".join([k + "X" * (n > 1) for k, n in zip(kinds, copies, strict=True)])
            more = 2 * sum(n - 2 for n in copies if n > 2)  # a run of copies is one step
            for entry in (NOTHING,) if begins else range(4):
                found = _solve(steps, entry)
                order = sorted(found, key=lambda s: found[s][1])
                for state, (cost, audit) in found.items():
                    i = 4 * entry + state
                    audits[i], costs[i], ranks[i] = audit, cost + more, order.index(state)
            for name, value in zip(out, (audits, costs, ranks, _adjacent(initials, copies)), strict=True):
                out[name].append(value)
        types = {"audits": pa.list_(pa.string()), "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int32()), "illegal": pa.int64()}
        names = ["conv_id", "part", "blk", "first", "last", "kinds", "copies"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(out[c], types[c]) for c in out]], [*names, *out])


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's blocks come in order: which of its audits each takes.  Of a block a few numbers are held until its conversation ends."""

    def closed(conv, blocks):
        picks, cells, illegal = Picks(), {NOTHING: (0, 0)}, 0
        for i, (_, _, first, _, costs, ranks, own) in enumerate(blocks):
            cells = picks.block(cells, costs, ranks)
            illegal += own + (i > 0 and blocks[i - 1][3] + first not in LEGAL)
        cost, node, tail = picks.end(cells)
        taken = []
        while node:
            before = picks.up[node][0]
            taken.append(4 * picks.state[before] + picks.state[node])
            node = before
        for i, (pick, (part, blk, *_)) in enumerate(zip(reversed(taken), blocks, strict=True)):
            yield conv, part, blk, i, len(blocks), pick, cost, illegal, tail

    def made(rows, kind):
        types = (kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        names = ("conv_id", "part", "blk", "number", "blocks", "pick", "cost", "illegal", "tail")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    conv, held, out, kind = None, [], [], None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for one, *row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "blk", "first", "last", "costs", "ranks", "illegal")], strict=True):
            if held and one != conv:
                out += closed(conv, held)
                held = []
                if len(out) > 5_000:
                    yield made(out, kind)
                    out = []
            conv = one
            held.append(row)
    if held:
        out += closed(conv, held)
    if out:
        yield made(out, kind)


def _applied(audit: str, kinds: list[str], copies: list[int], state: int) -> tuple[str, list[str], list[str], list[str]]:
    """The audit with its runs of deletions at full length, and of each row the turns before, its edit (K, D, U, A) and the turns behind."""
    at, whole, rows = 0, [], ([], [], [])

    def inserted() -> str:
        nonlocal at, state
        turns = []
        while audit[at] == "I":
            state = ASSISTANT if state == USER else USER
            turns.append("user" if state == USER else "assistant")
            whole.append("I")
            at += 1
        return ",".join(turns)

    for kind, n in zip(kinds, copies, strict=True):
        before = inserted()
        edit, at = audit[at], at + 1
        whole.append(edit)
        if edit == "R":
            state = ASSISTANT if state == USER else USER
            edit = "U" if state == USER else "A"
        elif edit == "K":
            state = SYSTEM if kind in "sS" else ASSISTANT if state == USER else USER
        behind = ""
        if n > 1:
            behind = inserted()
            whole.append("D" * (n - 1))
            at += 1
        for one, value in zip(rows, (before, edit, behind), strict=True):
            one.append(value)
    return "".join(whole), *rows


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_applied(audit, kinds, copies, pick // 4) for audit, kinds, copies, pick in zip(*[batch.column(c).to_pylist() for c in ("audit", "kinds", "copies", "pick")], strict=True)]
        names = ["conv_id", "part", "blk", "number", "blocks", "cost", "illegal", "tail"]
        more = [pa.array([f[0] for f in found], pa.string()), *[pa.array([f[i] for f in found], pa.list_(pa.string())) for i in (1, 2, 3)]]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *more], [*names, "audit", "before", "edit", "behind"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of conversations of several blocks, whose texts come in order: one block is held at a time."""
    conv, digest, tail, kind, out = None, None, None, None, []

    def closed():
        if tail:
            digest.update(b"\n" + tail.encode())
        return conv, digest.hexdigest()

    for batch in batches:
        kind = batch.schema.field(0).type
        for one, end, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "tail", "text")], strict=True):
            if digest is None or one != conv:
                if digest is not None:
                    out.append(closed())
                conv, tail, digest = one, end, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(text.encode())
    if digest is not None:
        out.append(closed())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], kind), pa.array([x for _, x in out], pa.string())], ["conv_id", "sha256"])


class Repair(NamedTuple):
    """``report``: a row for each conversation with rows; ``edits``: what becomes of each different row that isn't just deleted."""

    report: DataFrame
    edits: DataFrame


def plan(df: DataFrame, block_rows: int = ROWS, block_bytes: int = BYTES) -> Repair:
    """Find the edits of conversations (conv_id, turn, role, text, and copies if rows stand for several).

    A conversation's rows stand in the order of their turns, null first; those of one turn by role, then by the SHA-256 of their text, rows
    that agree side by side.  Null roles and texts are one space; a null conversation is one like others.  Texts are read here but not shuffled.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    kind = dict(df.dtypes)["conv_id"]
    rows, key = _rows(df), ["conv_id", "turn", "role", "digest"]
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    thin = rows.select(*key, "copies", blank.alias("blank"), cut.alias("cut"), F.octet_length("text").cast("long").alias("size"))
    once = materialise(thin.groupBy(*key).agg(F.sum("copies").alias("copies"), *[F.first(c).alias(c) for c in ("blank", "cut", "size")]))
    again = once.filter("NOT blank").groupBy("conv_id", "role", "digest").agg(F.count("*").alias("__n"), F.min(F.struct("turn")).alias("__first")).filter("__n > 1").drop("__n")
    known = _same(["conv_id", "role", "digest"], once, again, "left")
    known = known.withColumn("own", F.col("__first").isNull() | F.col("__first.turn").eqNullSafe(F.col("turn"))).drop("__first")
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    lead = F.when(F.col("blank") | ~F.col("own"), "X").when(F.col("cut"), F.upper(role)).otherwise(role)
    known = known.withColumns({"kind": lead, "initial": initial})
    dealt = known.repartitionByRange(n, *key).sortWithinPartitions(*key)
    schema = f"conv_id {kind}, turn long, role string, digest binary, copies long, blank boolean, cut boolean, size long, own boolean, kind string, initial string, part int, blk long, at int, begins boolean"
    placed = materialise(dealt.select(*key, "copies", "blank", "cut", "size", "own", "kind", "initial").mapInArrow(lambda batches: _place(batches, block_rows, block_bytes), schema))

    ordered = F.sort_array(F.collect_list(F.struct("at", "kind", "initial", "copies")))
    blocks = placed.groupBy("conv_id", "part", "blk").agg(ordered.alias("r"), F.first("begins").alias("begins"))
    blocks = blocks.select("conv_id", "part", "blk", "begins", F.col("r.kind").alias("kinds"), F.col("r.initial").alias("initials"), F.col("r.copies").alias("copies"), F.get("r.initial", F.lit(0)).alias("first"), F.element_at("r.initial", -1).alias("last"))
    solved = materialise(blocks.mapInArrow(_solutions, f"conv_id {kind}, part int, blk long, first string, last string, kinds array<string>, copies array<long>, audits array<string>, costs array<long>, ranks array<int>, illegal long"))
    numbers = solved.select("conv_id", "part", "blk", "first", "last", "costs", "ranks", "illegal").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "blk")
    picked = numbers.mapInArrow(_picked, f"conv_id {kind}, part int, blk long, number long, blocks long, pick int, cost long, illegal long, tail string")
    taken = picked.drop("conv_id").join(solved.select("conv_id", "part", "blk", "kinds", "copies", "audits"), ["part", "blk"])
    taken = taken.select("conv_id", "part", "blk", "number", "blocks", "cost", "illegal", "tail", "pick", "kinds", "copies", F.get("audits", "pick").alias("audit"))
    spelled = materialise(taken.mapInArrow(_spelled, f"conv_id {kind}, part int, blk long, number long, blocks long, cost long, illegal long, tail string, audit string, before array<string>, edit array<string>, behind array<string>"))

    pieces = F.transform(F.sort_array(F.collect_list(F.struct("number", "audit"))), lambda x: x["audit"])
    audits = spelled.groupBy("conv_id").agg(F.concat(F.array_join(pieces, ""), F.first("tail")).alias("audit"), F.first("cost").alias("cost"), F.first("illegal").alias("illegal"))
    copies, zero = F.col("copies"), F.lit(0).cast("long")
    faults = [
        F.sum(F.when(F.col("blank"), copies).otherwise(zero)).alias("blank"),
        F.sum(F.when(F.col("blank"), zero).when(F.col("own"), copies - 1).otherwise(copies)).alias("duplicate"),
        F.count_if(~F.col("blank") & F.col("own") & F.col("cut")).alias("truncated"),
    ]
    by_turn = placed.groupBy("conv_id", "turn").agg(*faults)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), zero)
    stats = by_turn.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    report = _same(["conv_id"], stats, audits, "inner")

    row = [F.get(c, F.col("at")).alias(c) for c in ("before", "edit", "behind")]
    edits = placed.select(*key, "part", "blk", "at").join(spelled.select("part", "blk", "number", "blocks", "tail", "before", "edit", "behind"), ["part", "blk"])
    edits = edits.select(*key, "number", "blocks", "tail", "at", *row).filter("edit <> 'D' OR before <> '' OR behind <> ''")
    return Repair(report, edits)


NO_TURNS = "array<struct<role:string,text:string>>"


def _turns(names: Column) -> Column:
    """Inserted turns: empty texts."""
    return F.when(names == "", F.array().cast(NO_TURNS)).otherwise(F.transform(F.split(names, ","), lambda r: F.struct(r.alias("role"), F.lit("").alias("text"))))


def repaired(df: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, number and at (the order), turns (array of role and text), blocks and tail of the rows that stay, with what is inserted around them."""
    both = _same(["conv_id", "turn", "role", "digest"], _rows(df).drop("copies"), edits, "inner")
    role = F.when(F.col("edit") == "U", "user").when(F.col("edit") == "A", "assistant").otherwise(F.col("role"))
    own = F.when(F.col("edit") == "D", F.array().cast(NO_TURNS)).otherwise(F.array(F.struct(role.alias("role"), "text")))
    return both.select("conv_id", "number", "at", F.concat(_turns(F.col("before")), own, _turns(F.col("behind"))).alias("turns"), "blocks", "tail")


def repair_report(df: DataFrame, block_rows: int = ROWS, block_bytes: int = BYTES) -> DataFrame:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation that has rows."""
    spark = df.sparkSession
    found = plan(df, block_rows, block_bytes)
    kind = dict(df.dtypes)["conv_id"]
    edits = materialise(found.edits)
    tail = F.when(F.col("tail") == "I", "assistant:").when(F.col("tail") == "II", "user:\nassistant:").otherwise("")
    lines = repaired(df, edits).select("conv_id", "number", "blocks", tail.alias("tail"), "at", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").alias("line"))
    # rows that agree are one: a set, so that a row that comes very often is sent once by each task
    text = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    texts = lines.groupBy("conv_id", "number").agg(text.alias("text"), F.first("blocks").alias("blocks"), F.first("tail").alias("tail"))
    whole = F.when(F.col("tail") == "", F.col("text")).otherwise(F.concat("text", F.lit("\n"), "tail"))
    texts = materialise(texts.select("conv_id", "number", "blocks", "tail", F.when(F.col("blocks") > 1, F.col("text")).alias("text"), F.when(F.col("blocks") == 1, F.sha2(whole.cast("binary"), 256)).alias("sha256")))
    hashes = texts.filter("blocks = 1").select("conv_id", "sha256")
    long = texts.filter("blocks > 1")
    if not long.isEmpty():
        ordered = long.select("conv_id", "number", "tail", "text").repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "number").select("conv_id", "tail", "text")
        hashes = hashes.unionByName(ordered.mapInArrow(_hashed, f"conv_id {kind}, sha256 string"))
    out = _same(["conv_id"], found.report, hashes, "left")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def repaired_damage(conversations: DataFrame, block_rows: int = ROWS, block_bytes: int = BYTES) -> DataFrame:
    """Damage conversations and report on their repair: a row for every conversation, also if it has no rows left."""
    report = repair_report(damage(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")), block_rows, block_bytes)
    all_ = _same(["conv_id"], conversations.select("conv_id").distinct(), report, "left")
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_damage(table(spark, sf_dir, "conversations"))


#: CRC-32 of an ASCII text by its polynomial, bit by bit; DuckDB has no function for it.
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::UBIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), [n::UBIGINT for n in range(8)]), lambda x, n: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"
_KEY = "(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))"

SQL = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(_KEY)} % 20 AS h FROM conversations),
d AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '-') AS c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE h <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS rn, left(role, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM d),
f AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY c, role, text ORDER BY rn) > 1 AS dup, lag(i) OVER (PARTITION BY c ORDER BY rn) AS before FROM r),
g AS (SELECT *, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM f),
ins(q, a, q2, price, turns) AS (VALUES ('E', '', 'E', 0, []::VARCHAR[]), ('E', 'I', 'U', 5, ['user:']), ('E', 'II', 'A', 10, ['user:', 'assistant:']), ('S', '', 'S', 0, []), ('S', 'I', 'U', 5, ['user:']), ('S', 'II', 'A', 10, ['user:', 'assistant:']), ('U', '', 'U', 0, []), ('U', 'I', 'A', 5, ['assistant:']), ('A', '', 'A', 0, []), ('A', 'I', 'U', 5, ['user:'])),
eds(q2, e, i, q3, cost) AS (VALUES ('E', 'K', 's', 'S', 0), ('E', 'K', 'u', 'U', 0), ('S', 'K', 'u', 'U', 0), ('A', 'K', 'u', 'U', 0), ('U', 'K', 'a', 'A', 0), ('E', 'R', NULL, 'U', 1), ('S', 'R', NULL, 'U', 1), ('A', 'R', NULL, 'U', 1), ('U', 'R', NULL, 'A', 1), ('E', 'D', NULL, 'E', 2), ('S', 'D', NULL, 'S', 2), ('U', 'D', NULL, 'U', 2), ('A', 'D', NULL, 'A', 2)),
p AS (SELECT DISTINCT c, 0::BIGINT AS rn, 'E' AS q, {{'cost': 0::BIGINT, 'audit': '', 'turns': []::VARCHAR[]}} AS x FROM g UNION ALL
  SELECT p.c, g.rn, q3, min({{'cost': x.cost + price + eds.cost + CASE WHEN cut AND e <> 'D' THEN 5 ELSE 0 END, 'audit': x.audit || a || e, 'turns': x.turns || ins.turns || CASE e WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [CASE q3 WHEN 'U' THEN 'user:' ELSE 'assistant:' END || text] END}})
  FROM p JOIN g ON p.c = g.c AND g.rn = p.rn + 1 JOIN ins ON p.q = ins.q JOIN eds ON ins.q2 = eds.q2 AND (eds.i IS NULL OR eds.i = g.i) AND (e = 'D' OR NOT (blank OR dup)) GROUP BY p.c, g.rn, q3),
ends AS (SELECT p.c, min({{'cost': x.cost + price, 'audit': x.audit || a, 'turns': x.turns || ins.turns}}) AS x FROM p JOIN ins ON p.q = ins.q AND q2 IN ('E', 'A') WHERE rn = (SELECT max(rn) FROM g WHERE g.c = p.c) GROUP BY p.c),
s AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, count_if(cut) AS truncated, count_if(before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY c)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(x.cost, 0) AS BIGINT) AS cost, coalesce(x.audit, '') AS audit, sha256(coalesce(array_to_string(x.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN s ON coalesce(CAST(o.conv_id AS VARCHAR), '-') = s.c LEFT JOIN ends ON s.c = ends.c
"""
