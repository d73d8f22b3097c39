"""Repair of damaged conversations by Hirschberg's divide and conquer.

A conversation's rows become turns ``(s?(ua)+)?`` (system, user, assistant by the roles'
first letters) by keeping, rewriting the role of, deleting and inserting turns at least
cost. Four states say how a repaired prefix ends: empty, after the system turn, after a
user turn, after an assistant turn. A row is a 4 x 4 table of costs from state to state,
inserted turns before it included, with the order of the edits that lead to each state.
Forward costs, with that order, and backward costs meet in the middle of the rows; of the
cheapest crossings the one with the ASCII-least edits is taken, and both halves are solved
the same way. No table of all rows times states is kept.

Tables compose, so the same recursion works on blocks of rows. Rows are range-sorted, which
divides a conversation of any length among tasks, and folded into blocks of at most
``BLOCK`` rows that carry one table each. The tables of a conversation's blocks (1/4096 of
its rows) meet in one task, which fixes the states between blocks; each block is then
solved where it lies. Only keys and digests travel for this. Texts are sorted once, with
the edits as rows of the same sort keys in front of them, and come out as chunks of
repaired turns.

Defined results: a null role or text is one space, and so is a null key in the damage; null
turns come first; rows of one turn are in order of role and SHA-256 of the text, and rows
equal in all three are interchangeable; rows with a null conv_id are one conversation; a
role's first letter counts whatever follows; a conversation without rows is empty and costs
nothing; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelwright.llm.common import BLANK
from labelwright.session import spool

BLOCK = 4096
CHUNK_BYTES = 4 << 20
NEVER = 1 << 60
STATES = range(4)
EMPTY, SYSTEM, USER, ASSISTANT = STATES
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEPS, CUT, GOES = 0, 1, 2
INITIALS = "sua"

# -- the tables of single rows -------------------------------------------------------


def _inserted(state: int) -> list[tuple[int, str, int]]:
    """(cost, edits, state) that turns inserted at ``state`` lead to, none included."""
    user = [(0, "", state)] if state == USER else [(INSERT, "I", USER)]
    answer = [(0, "", state)] if state == ASSISTANT else [(user[0][0] + INSERT, user[0][1] + "I", ASSISTANT)]
    return [(0, "", state)] + [way for way in user + answer if way[2] != state]


def _edited(initial: str, fault: int, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, edit, state) of one row."""
    yield DELETE, "D", state
    if fault == GOES:
        return
    before = {"s": (EMPTY,), "u": (EMPTY, SYSTEM, ASSISTANT), "a": (USER,)}.get(initial, ())
    after = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
    if state in before:
        yield TRUNCATED * fault, "K", after[initial]
    yield REROLE + TRUNCATED * fault, "R", ASSISTANT if state == USER else USER


def _row(code: int) -> tuple:
    """(costs, ranks, edits), each by state before and state after, of rows with this code."""
    initial, fault = "sua-"[code // 3], code % 3
    costs, ranks, edits = [], [], []
    for state in STATES:
        best: dict[int, tuple[int, str]] = {}
        for paid, inserts, between in _inserted(state):
            for cost, edit, after in _edited(initial, fault, between):
                way = (paid + cost, inserts + edit)
                best[after] = min(best.get(after, way), way)
        order = sorted(best, key=lambda after: best[after][1])
        costs.append([best[after][0] if after in best else NEVER for after in STATES])
        ranks.append([order.index(after) if after in best else 0 for after in STATES])
        edits.append([best[after][1] if after in best else "" for after in STATES])
    return costs, ranks, edits


ROWS = [_row(code) for code in range(12)]
#: Cost and edits from each state to an accepted end.
ENDS = [min((cost, edits) for cost, edits, after in _inserted(state) if after in (EMPTY, ASSISTANT)) for state in STATES]
END_COSTS = [cost for cost, _ in ENDS]

# -- divide and conquer --------------------------------------------------------------


def forward(tables: list, start: int) -> tuple[list[int], list[int]]:
    """Costs of reaching each state from ``start``, and the order of the edits that do.

    Two such edits hold equally many rows and end with one, so none continues another and
    their order is that of their first parts, or of their last rows where those are equal.
    """
    costs, ranks = [NEVER] * 4, [0] * 4
    costs[start] = 0
    for table in tables:
        ways = []
        for after in STATES:
            way = min((costs[s] + table[0][s][after], ranks[s], table[1][s][after]) for s in STATES)
            ways.append(way)
        order = sorted({way[1:] for way in ways if way[0] < NEVER})
        costs = [min(way[0], NEVER) for way in ways]
        ranks = [order.index(way[1:]) if way[0] < NEVER else 0 for way in ways]
    return costs, ranks


def backward(tables: list, ends: list[int]) -> list[int]:
    """Costs from each state to the ends, which have costs of their own."""
    for table in reversed(tables):
        ends = [min(NEVER, *(table[0][s][after] + ends[after] for after in STATES)) for s in STATES]
    return ends


def compose(tables: list) -> tuple[list, list]:
    """(costs, ranks) of several tables in a row."""
    found = [forward(tables, start) for start in STATES]
    return [costs for costs, _ in found], [ranks for _, ranks in found]


def crossings(tables: list, start: int, ends: list[int]) -> list[int]:
    """The states before each of ``tables`` and after the last, on the least of the cheapest ways."""
    if len(tables) < 2:
        after = [
            min(STATES, key=lambda s: (table[0][start][s] + ends[s], table[1][start][s])) for table in tables
        ]
        return [start, *after]
    middle = len(tables) // 2
    costs, ranks = forward(tables[:middle], start)
    rest = backward(tables[middle:], ends)
    met = min(STATES, key=lambda s: (costs[s] + rest[s], ranks[s]))
    left = crossings(tables[:middle], start, [0 if s == met else NEVER for s in STATES])
    return left + crossings(tables[middle:], met, ends)[1:]


def _solved(codes: bytes, start: int, end: int) -> tuple[tuple[int, ...], tuple[str, ...], int]:
    """(state before each row, its edits, cost) of a block; ``end`` below 0: of a whole conversation."""
    tables = [ROWS[code] for code in codes]
    ends = END_COSTS if end < 0 else [0 if s == end else NEVER for s in STATES]
    states = crossings(tables, start, ends)
    edits = [table[2][a][b] for table, a, b in zip(tables, states, states[1:])]
    cost = sum(table[0][a][b] for table, a, b in zip(tables, states, states[1:]))
    if end < 0:
        cost += END_COSTS[states[-1]]
        if edits:
            edits[-1] += ENDS[states[-1]][1]
    return tuple(states[:-1]), tuple(edits), cost


# -- rows ----------------------------------------------------------------------------


def damaged(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv, turn, role, text) after the damage that the rows' keys ask for."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space(text_col), "[.!?]", "")).otherwise(space(text_col))
    return turns.where(kind != 0).select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.when(kind == 4, "user").otherwise(space(role_col)).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


SORT = ["conv", "turn", "role", "digest"]


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _sorted(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of both, ranges of the sort keys in each task, a key's marks before its rows."""
    both = marks.withColumn("is_row", F.lit(False)).unionByName(
        rows.withColumn("is_row", F.lit(True)), allowMissingColumns=True
    )
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartitionByRange(tasks, *SORT).sortWithinPartitions(*SORT, "is_row")


BLOCKS = (
    "conv {conv}, part int, at int, alone boolean, codes binary, turns array<{turn}>, roles array<string>, "
    "digests array<binary>, costs array<long>, ranks array<int>, n_blank long, n_duplicate long, n_truncated long, "
    "n_illegal long, n_turns long, low {turn}, high {turn}, first_initial string, last_initial string"
)
#: Pairs of neighbours' first letters that are no fault.
LEGAL = ("su", "ua", "au")


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted marks and rows to blocks. A row is new where the mark of its first place precedes it."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    conv, at, held, ready, mark = None, 0, [], [], None
    begins, first_conv = True, True

    def block(alone: bool) -> dict:
        codes = bytearray()
        out = dict.fromkeys(("n_blank", "n_duplicate", "n_truncated", "n_illegal", "n_turns"), 0)
        before, turn_before = None, None
        for turn, role, _, fault in held:
            initial = role[:1]
            codes.append(3 * ("sua".find(initial) if initial and initial in INITIALS else 3)
                         + (GOES if fault in (1, 2) else CUT if fault == 3 else KEEPS))
            for number, name in ((1, "n_blank"), (2, "n_duplicate"), (3, "n_truncated")):
                out[name] += fault == number
            out["n_illegal"] += before is not None and before + initial not in LEGAL
            out["n_turns"] += turn is not None and turn != turn_before
            before, turn_before = initial, turn
        known = [row[0] for row in held if row[0] is not None]
        costs, ranks = compose([ROWS[code] for code in codes]) if not alone else ([], [])
        return out | {
            "conv": conv, "part": part, "at": at, "alone": alone, "codes": bytes(codes),
            "turns": [row[0] for row in held], "roles": [row[1] for row in held], "digests": [row[2] for row in held],
            "costs": sum(costs, []), "ranks": sum(ranks, []),
            "low": known[0] if known else None, "high": known[-1] if known else None,
            "first_initial": held[0][1][:1], "last_initial": held[-1][1][:1],
        }

    for batch in batches:
        for row in zip(*(batch.column(name).to_pylist() for name in (*SORT, "is_row", "blank", "cut"))):
            key, (is_row, blank, cut) = row[:4], row[4:]
            if not is_row:
                mark = key
                continue
            if held and (conv != key[0] or len(held) == BLOCK):
                ends = conv != key[0]
                # The first conversation of a task may have begun in another.
                ready.append(block(ends and begins and not first_conv))
                held, at, begins = [], at + 1, ends
                first_conv = first_conv and not ends
            conv = key[0]
            fault = 1 if blank else 2 if mark != key else 3 if cut else 0
            mark = None
            held.append((*key[1:], fault))
            if len(ready) >= 512:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready = []
    if held:
        ready.append(block(False))
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema)


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows with their tables and counts; a whole conversation inside a task is ``alone``."""
    kinds = dict(rows.dtypes)
    last = F.right(F.regexp_replace("text", f"[{BLANK}]+$", ""), F.lit(1))
    narrow = rows.select(
        "conv", "turn", "role", _digest(F.col("text")).alias("digest"),
        (~F.col("text").rlike(f"[^{BLANK}]")).alias("blank"), (~last.rlike("[.!?]")).alias("cut"),
    )
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")
    firsts = narrow.groupBy("conv", "role", "digest").agg(first).select(
        "conv", F.col("first.turn").alias("turn"), "role", "digest"
    )
    ddl = BLOCKS.format(conv=kinds["conv"], turn=kinds["turn"])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return _sorted(narrow, firsts).mapInArrow(lambda batches: _fold(batches, schema), ddl)


def _joined_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States before and after each block of the conversations that have several; blocks come in order."""
    held: list[tuple] = []

    def solved() -> pa.RecordBatch:
        tables = [
            tuple([list(flat[4 * s:4 * s + 4]) for s in STATES] for flat in (costs, ranks))
            for _, _, _, costs, ranks in held
        ]
        states = crossings(tables, EMPTY, END_COSTS)
        last = len(held) - 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([row[1] for row in held], pa.int32()), pa.array([row[2] for row in held], pa.int32()),
                pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32()),
                pa.array([i == last for i in range(len(held))]),
            ],
            ["part", "at", "start", "end", "is_last"],
        )

    for batch in batches:
        for row in zip(*(batch.column(name).to_pylist() for name in ("conv", "part", "at", "costs", "ranks"))):
            if held and held[0][0] != row[0]:
                yield solved()
                held = []
            held.append(row)
    if held:
        yield solved()


MARKS = "conv {conv}, part int, at int, edits string, cost long, marks array<struct<turn:{turn},role:string,digest:binary,mark:string>>"


def _edits(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, tuple] = {}

    def solve(codes: bytes, start: int, end: int) -> tuple:
        """Short conversations are much alike: they are solved once."""
        if len(codes) > 16:
            return _solved(codes, start, end)
        key = (codes, start, end)
        if key not in known:
            if len(known) >= 1 << 14:
                known.clear()
            known[key] = _solved(codes, start, end)
        return known[key]

    for batch in batches:
        out = []
        for block in batch.to_pylist():
            codes = block["codes"]
            if block["start"] is None:
                states, edits, cost = solve(codes, EMPTY, -1)
            else:
                states, edits, cost = solve(codes, block["start"], block["end"])
                if block["is_last"]:
                    more = ENDS[block["end"]]
                    edits, cost = (*edits[:-1], edits[-1] + more[1]), cost + more[0]
            out.append({
                "conv": block["conv"], "part": block["part"], "at": block["at"], "edits": "".join(edits), "cost": cost,
                "marks": [
                    {"turn": turn, "role": role, "digest": digest, "mark": f"{state}{edit}"}
                    for turn, role, digest, state, edit in zip(
                        block["turns"], block["roles"], block["digests"], states, edits)
                ],
            })
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


def _chunks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted marks and rows to chunks of repaired turns; each row takes one mark of its key."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    conv, at, lines, size, ready, marks = None, 0, [], 0, [], []
    first_conv, begun, ready_size = True, False, 0

    def chunk(alone: bool) -> dict:
        return {"conv": conv, "part": part, "at": at, "alone": alone, "lines": lines}

    for batch in batches:
        for row in zip(*(batch.column(name).to_pylist() for name in (*SORT, "is_row", "text", "mark"))):
            key, (is_row, text, mark) = row[:4], row[4:]
            if begun and (conv != key[0] or size >= CHUNK_BYTES):
                ends = conv != key[0]
                ready.append(chunk(ends and at == 0 and not first_conv))
                ready_size += size
                lines, size, at = [], 0, 0 if ends else at + 1
                first_conv = first_conv and not ends
                if len(ready) >= 512 or ready_size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready, ready_size = [], 0
            conv, begun = key[0], True
            if not is_row:
                if marks and marks[0][0] != key:
                    raise AssertionError("a row is missing after its edits")
                marks.append((key, mark))
                continue
            place, mark = marks.pop(0)
            if place != key:
                raise AssertionError("edits are missing before a row")
            state = int(mark[0])
            for edit in mark[1:]:
                if edit == "D":
                    continue
                if edit == "K":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[key[2][0]]
                    lines.append({"role": key[2], "text": text, "edit": edit})
                else:
                    state = ASSISTANT if state == USER else USER
                    lines.append({"role": ROLES[state], "text": text if edit == "R" else "", "edit": edit})
                size += len(lines[-1]["text"]) + 64
    if begun:
        ready.append(chunk(False))
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, chunks) of conversations given as rows (conv, turn, role, text).

    Summary, a row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit. Chunks: conv, part, at (their order in a conversation), alone (no other chunk), and
    lines, the repaired turns as (role, text, edit).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = dict(rows.dtypes)
    blocks = spool(_blocks(rows), "blocks")
    states = (
        blocks.where("NOT alone").select("conv", "part", "at", "costs", "ranks")
        .repartition("conv").sortWithinPartitions("conv", "part", "at")
        .mapInArrow(_joined_states, "part int, at int, start int, end int, is_last boolean")
    )
    ddl = MARKS.format(conv=kinds["conv"], turn=kinds["turn"])
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    needed = ["conv", "part", "at", "codes", "turns", "roles", "digests"]
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("start", "int"), ("end", "int"), ("is_last", "boolean"))]
    solved = spool(
        blocks.where("alone").select(*needed, *none).unionByName(
            blocks.where("NOT alone").select(*needed).join(states, ["part", "at"]).select(*needed, "start", "end", "is_last")
        ).mapInArrow(lambda batches: _edits(batches, schema), ddl),
        "edits",
    )
    in_order = Window.partitionBy("conv").orderBy("part", "at")
    known = Window.partitionBy("conv").orderBy("part", "at").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.drop("codes", "turns", "roles", "digests", "costs", "ranks").withColumns({
        "across": F.concat(F.lag("last_initial").over(in_order), F.col("first_initial")),
        "again": F.col("low") == F.last("high", ignorenulls=True).over(known),
    })
    one = lambda condition: F.coalesce(F.sum(condition.cast("long")), F.lit(0))
    distinct = F.sum("n_turns") - one(F.col("again"))
    counts = counts.groupBy("conv").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - distinct, F.lit(0)).alias("gaps"),
        F.sum("n_blank").alias("blank"), F.sum("n_duplicate").alias("duplicate"), F.sum("n_truncated").alias("truncated"),
        (F.sum("n_illegal") + one(F.col("across").isNotNull() & ~F.col("across").isin(*LEGAL))).alias("illegal"),
    )
    # A conversation's edits are one string of the result, so they meet in one row.
    audits = solved.groupBy("conv").agg(
        F.sum("cost").alias("cost"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("part", "at", "edits"))), lambda x: x.edits), ""
        ).alias("audit"),
    )
    summary = counts.alias("c").join(audits.alias("a"), F.col("c.conv").eqNullSafe(F.col("a.conv"))).select(
        "c.*", "a.cost", "a.audit"
    )
    marks = solved.select("conv", F.inline("marks"))
    wide = rows.withColumn("digest", _digest(F.col("text")))
    chunk_ddl = f"conv {kinds['conv']}, part int, at int, alone boolean, lines array<struct<role:string,text:string,edit:string>>"
    chunk_schema = to_arrow_schema(StructType.fromDDL(chunk_ddl))
    chunks = _sorted(wide, marks).mapInArrow(lambda batches: _chunks(batches, chunk_schema), chunk_ddl)
    return summary, chunks


def _written(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(x.role, F.lit(":"), x.text)), "\n")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose chunks come in order; only one chunk is held."""
    conv, digest, lines, begun, out = None, None, 0, False, []
    schema = None

    def row():
        return {"conv": conv, "sha256": digest.hexdigest()}

    for batch in batches:
        schema = pa.schema([batch.schema.field("conv"), pa.field("sha256", pa.string())])
        for name, text, n in zip(*(batch.column(name).to_pylist() for name in ("conv", "text", "n"))):
            if not begun or name != conv:
                if begun:
                    out.append(row())
                conv, digest, lines, begun = name, hashlib.sha256(), 0, True
            if n:
                digest.update((b"\n" if lines else b"") + text.encode())
                lines += n
    if begun:
        out.append(row())
        yield pa.RecordBatch.from_pylist(out, schema)


def digests(chunks: DataFrame) -> DataFrame:
    """(conv, sha256) of the repaired ``role:text`` lines.

    A chunk that is a whole conversation is digested where it lies; the others pass
    through a task in order, which SHA-256 asks for.
    """
    kind = dict(chunks.dtypes)["conv"]
    alone = chunks.where("alone").select("conv", F.sha2(_written(F.col("lines")), 256).alias("sha256"))
    divided = (
        chunks.where("NOT alone").select("conv", "part", "at", _written(F.col("lines")).alias("text"), F.size("lines").alias("n"))
        .repartition("conv").sortWithinPartitions("conv", "part", "at").select("conv", "text", "n")
        .mapInArrow(_streamed, f"conv {kind}, sha256 string")
    )
    return alone.unionByName(divided)


def report(turns: DataFrame, rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of ``turns``: the summary of ``rows``, which are what is left of it, and sha256."""
    summary, chunks = repair(rows)
    chunks = spool(chunks, "chunks")
    digest = digests(chunks)
    every = turns.select(F.col(conv_col).alias("every")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        every.join(summary.alias("s"), F.col("every").eqNullSafe(F.col("s.conv")), "left")
        .join(digest.alias("d"), F.col("every").eqNullSafe(F.col("d.conv")), "left")
        .select(
            F.col("every").alias(conv_col),
            *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in numbers],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )
