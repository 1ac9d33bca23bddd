"""Chat formatting by minimum-cost role repair.

A legal-turn automaton says which role may follow which. For every turn the repair chooses
to keep its role, to relabel it, to merge it into the message before it, or to insert an
empty turn in front of it, so that the whole conversation is legal at the least cost; then
the repaired turns are rendered.

The choice is a shortest path through four states, and shortest paths of stretches of turns
combine like matrix products (least sum instead of sum of products). So turns are dealt to
ranges of their order, whatever their conversation, and cut into blocks of 64 at most:

* a matrix for each block, and one for each conversation's part of a range, all in parallel;
* a backward and a forward pass over the parts of a conversation, of which there are no more
  than ranges, and over the blocks within each part;
* the choice within each block in parallel again.

No task holds a conversation, however long it is or whatever its turn numbers are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import materialise, ship_package

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the message before. What may follow which:
START = 0
FOLLOWS = {START: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
STATES = 4
#: Costs of a merge, of another role, of a role for an unknown one, and of an empty turn.
MERGE, RELABEL, NAME, INSERT = 1, 2, 1, 3
#: Turns of a block are 1 << BLOCK_BITS at most, and ROW_BITS hold a row's place in its range.
BLOCK_BITS, ROW_BITS = 6, 33
FAR = 1 << 40
KEEP = "keep"


def moves(role: str | None) -> list[tuple[int, int, int, str, int]]:
    """(state, next state, cost, action, inserted role or 0) that a turn of this role allows, best kept first."""
    given = ROLES.index(role) + 1 if role in ROLES else 0

    def named(to: int) -> tuple[int, str]:
        return (0, KEEP) if to == given else (RELABEL if given else NAME, "relabel")

    found = []
    for state in range(STATES):
        for to in FOLLOWS[state]:
            cost, action = named(to)
            found.append((state, to, cost, action, 0))
            for last in FOLLOWS[to]:
                cost, action = named(last)
                found.append((state, last, cost + INSERT, f"insert+{action}", to))
        if state != START:
            cost, action = named(state)
            found.append((state, state, cost + MERGE, "merge" if action == KEEP else "relabel+merge", 0))
    return found


MOVES = {role: moves(role) for role in (*ROLES, None)}
STEP = {
    role: [[min((c for s, t, c, *_ in found if (s, t) == (a, b)), default=FAR) for b in range(STATES)] for a in range(STATES)]
    for role, found in MOVES.items()
}


def known(role: str | None) -> str | None:
    return role if role in ROLES else None


def combine(one: list[list[int]], other: list[list[int]]) -> list[list[int]]:
    """Least costs of one stretch of turns after another."""
    span = range(STATES)
    return [[min(FAR, min(one[a][k] + other[k][b] for k in span)) for b in span] for a in span]


def dealt_turns(conversations: DataFrame) -> DataFrame:
    """Turns in order, by conversation, number (null last), role and text: ``at`` grows with it, blocks and parts are cut from it.

    Equal rows are told apart by their place in the scan, so any number of them is dealt out, too.
    The result is written to the checkpoint folder, for ranges are sampled anew on every run.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.lower(F.trim("role")).alias("role"),
        F.col("role").alias("given_role"),
        "text",
        F.xxhash64("role", "text").alias("tie"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("tie"), F.col("row_no")]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "row_no")
    placed = materialise(ordered.withColumn("at", F.monotonically_increasing_id()))
    return placed.withColumns({"block": F.shiftright("at", BLOCK_BITS), "part": F.shiftright("at", ROW_BITS)})


def groups_of(batches, keys: list[str]):
    """(key, rows) of consecutive equal keys over Arrow batches; a group may span batches."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != current and rows:
                yield current, rows
                rows = []
            current = key
            rows.append(row)
    if rows:
        yield current, rows


def flush(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def in_batches(found, schema: pa.Schema, size: int = 2000):
    rows = []
    for row in found:
        rows.append(row)
        if len(rows) >= size:
            yield flush(rows, schema)
            rows = []
    if rows:
        yield flush(rows, schema)


MATRIX = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))])
ENDS = [("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_())]
SUFFIX = pa.schema([*MATRIX, *ENDS, ("after", pa.list_(pa.int64()))])
ENTRY = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), *ENDS])
MATRIX_SQL = "conv_id long, part long, block long, costs array<long>"
ENDS_SQL = "entry int, leave int, last boolean"
#: In place of the state that a stretch must end in.
ANY = -1


def square(costs: list[int]) -> list[list[int]]:
    return [costs[i : i + STATES] for i in range(0, STATES * STATES, STATES)]


def ending(leave: int) -> list[int]:
    """Costs after the end of a stretch that must end in a state, or may in any."""
    return [0 if leave in (ANY, state) else FAR for state in range(STATES)]


def products(rows):
    """((conv, part, block), matrix) rows in order to one row for each key, with the product of its matrices."""
    current, matrix = None, None
    for key, one in rows:
        if key != current:
            if current:
                yield (*current, sum(matrix, []))
            current, matrix = key, one
        else:
            matrix = combine(matrix, one)
    if current:
        yield (*current, sum(matrix, []))


def block_matrices(turns: DataFrame) -> DataFrame:
    """(conv_id, part, block, costs): least cost of each block from each state to each. Turns come in order."""

    def run(batches):
        steps = (((c, p, b), STEP[known(r)]) for batch in batches for c, p, b, r in zip(*(x.to_pylist() for x in batch.columns), strict=True))
        yield from in_batches(products(steps), MATRIX)

    return turns.select("conv_id", "part", "block", "role").mapInArrow(run, MATRIX_SQL)


def part_matrices(matrices: DataFrame) -> DataFrame:
    """The same for each conversation's part of a range; ``block`` is null."""

    def run(batches):
        steps = (((c, p, None), square(m)) for batch in batches for c, p, _, m in zip(*(x.to_pylist() for x in batch.columns), strict=True))
        yield from in_batches(products(steps), MATRIX)

    return matrices.mapInArrow(run, MATRIX_SQL)


def entries(stretches: DataFrame, by: list[str], at: str) -> DataFrame:
    """(conv_id, part, block, entry, leave, last): the states that each stretch starts and ends in, and if it ends all.

    ``stretches`` have, beside their matrices, the same three of the whole group ``by``, whose
    stretches are in the order of ``at``. Both passes read a group in order and hold one stretch.
    """
    key = lambda row: tuple(row[c] for c in by)

    def backward(batches):
        def found():
            current, after = None, None
            for batch in batches:
                for row in batch.to_pylist():
                    if key(row) != current:
                        current, after = key(row), ending(row["leave"])
                    yield *(row[name] for name in SUFFIX.names[:-1]), after
                    matrix = square(row["costs"])
                    after = [min(matrix[a][b] + after[b] for b in range(STATES)) for a in range(STATES)]

        yield from in_batches(found(), SUFFIX)

    def forward(batches):
        def found():
            held, current, state = None, None, START
            for batch in batches:
                for row in batch.to_pylist():
                    begins = key(row) != current
                    if held:
                        yield *held[:-1], held[-1] and begins
                    if begins:
                        current, state = key(row), row["entry"]
                    before, costs, after = state, square(row["costs"])[state], row["after"]
                    state = min(range(STATES), key=lambda b: (costs[b] + after[b], b))
                    held = (row["conv_id"], row["part"], row["block"], before, state, row["last"])
            if held:
                yield held

        yield from in_batches(found(), ENTRY)

    order = [*by, at]
    backwards = stretches.select(*MATRIX.names, "entry", "leave", "last").repartition(*by).sortWithinPartitions(*by, F.desc(at))
    backwards = backwards.mapInArrow(backward, f"{MATRIX_SQL}, {ENDS_SQL}, after array<long>")
    return backwards.sortWithinPartitions(*order).mapInArrow(forward, f"conv_id long, part long, block long, {ENDS_SQL}")


def block_entries(matrices: DataFrame) -> DataFrame:
    """The entries of all blocks: first those of each conversation's parts, then those of the blocks within them."""
    whole = {"entry": F.lit(START), "leave": F.lit(ANY), "last": F.lit(True)}
    parts = materialise(entries(part_matrices(matrices).withColumns(whole), ["conv_id"], "part"))
    parts = parts.drop("block").withColumnsRenamed({"conv_id": "p_conv", "part": "p_part"})
    mine = F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("part") == F.col("p_part"))
    return entries(matrices.join(parts, mine), ["conv_id", "part"], "block")


def choose(roles: list[str | None], entry: int, leave: int) -> list[tuple[int, int, int, str, int]]:
    """The moves of a block at the least cost, given the states it starts and ends in."""
    best = [ending(leave)]
    for role in reversed(roles):
        nxt = best[-1]
        best.append([min((c + nxt[t] for s, t, c, *_ in MOVES[known(role)] if s == a), default=FAR) for a in range(STATES)])
    best.reverse()
    state, chosen = entry, []
    for i, role in enumerate(roles):
        options = [m for m in MOVES[known(role)] if m[0] == state]
        move = min(options, key=lambda m: (m[2] + best[i + 1][m[1]], m[1]))
        chosen.append(move)
        state = move[1]
    return chosen


def render(text: str | None, move: tuple, first: bool, last: bool) -> str:
    """A turn's part of the rendered conversation; all parts together are the whole."""
    state, to, _, action, inserted = move
    before = "" if first else "<|end|>\n"
    if action.endswith("merge"):
        before = "\n"
    else:
        if inserted:
            before += f"<|{ROLES[inserted - 1]}|>\n<|end|>\n"
        before += f"<|{ROLES[to - 1]}|>\n"
    return before + (text or "") + ("<|end|>\n" if last else "")


def repair_chats(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, given_role, role, action, inserted, cost, rendered.

    Roles are compared in lower case without outer spaces; any other one, null included, is
    unknown and gets the cheapest legal name. Null texts render as empty. Turns are ordered by
    number (null last), then role and text, so repeated rows are repeated turns and merge. A null
    conv_id is a conversation. Equal costs go to the first role of system, user, assistant.
    Concatenated in order of ``place``, ``rendered`` of a conversation is its whole repaired text;
    texts of any length are rendered whole. An empty table gives no rows. Other columns are not
    read, whatever their names.
    """
    ship_package(conversations.sparkSession)
    turns = dealt_turns(conversations)
    starts = materialise(block_entries(materialise(block_matrices(turns)))).drop("part")
    mine = turns.join(
        starts.withColumnsRenamed({"conv_id": "e_conv", "block": "e_block"}),
        F.col("conv_id").eqNullSafe(F.col("e_conv")) & (F.col("block") == F.col("e_block")),
    )
    schema = "conv_id long, turn long, place long, given_role string, role string, action string, inserted string, cost int, rendered string"
    shown = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int64()), ("given_role", pa.string()), ("role", pa.string()),
         ("action", pa.string()), ("inserted", pa.string()), ("cost", pa.int32()), ("rendered", pa.string())]
    )

    def run(batches):
        def found():
            for (conv, _), rows in groups_of(batches, ["conv_id", "block"]):
                picked = choose([r["role"] for r in rows], rows[0]["entry"], rows[0]["leave"])
                for i, (row, move) in enumerate(zip(rows, picked, strict=True)):
                    state, to, cost, action, inserted = move
                    text = render(row["text"], move, state == START, row["last"] and i == len(rows) - 1)
                    name = ROLES[inserted - 1] if inserted else None
                    yield conv, row["turn"], row["at"], row["given_role"], ROLES[to - 1], action, name, cost, text

        yield from in_batches(found(), shown)

    together = mine.select("conv_id", "block", "at", "turn", "role", "given_role", "text", "entry", "leave", "last")
    return together.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at").mapInArrow(run, schema)
