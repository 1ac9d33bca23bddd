"""Conversation structure repair by a dynamic program over the turns that are retained.

A repaired conversation has roles ``(s?(ua)+)?`` (system, user, assistant). Each turn is kept,
reroled or deleted, and empty turns are inserted. The program chooses which turns to retain and
as what, from the last to the first:

* deletions have prefix sums, so what lies between two retained turns costs a difference of two;
* for each role the least of (cost from a turn on, plus the deletions before it) is a running
  minimum, so all gaps after a turn are priced at once;
* the pair of roles at both ends of a gap says how many empty turns stand in it;
* of choices of equal cost the audit (the initials of the edits) that is least in ASCII wins. Of
  two choices the one that deletes further on is less (D comes first), then the one that inserts,
  then the one that keeps; so ties are broken where they arise and no audits are compared.

Turns are dealt to ranges of their order, whatever their conversation. Only the first and the
last conversation of a range may go on in another one: there are two parts a range at most that
do. For them a matrix says what it costs to pass the part from one state to another; from these the
cost of all that follows each part, then the state that each part starts in. All else is done
where the turns are, in parallel, for a conversation of any number of turns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import materialise, ship_package

RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing retained yet, or the role retained last.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: What may be retained after each state, and the role of the empty turn that has to stand between (0: none).
NEXT = {
    START: ((SYSTEM, 0), (USER, 0), (ASSISTANT, USER)),
    SYSTEM: ((USER, 0), (ASSISTANT, USER)),
    USER: ((ASSISTANT, 0), (USER, ASSISTANT)),
    ASSISTANT: ((USER, 0), (ASSISTANT, USER)),
}
#: The empty turns that end a conversation, from each state.
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
CLOSING = [INSERT * len(ENDING[state]) for state in range(4)]
FAR = 1 << 40
#: Duplicate texts up to this number of rows go to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A range holds so many rows at most in Spark's numbering, which gives the range in the bits above.
ROW_BITS = 33
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


class Plan:
    """The cheapest edits of a stretch of turns, given what each state costs after it."""

    def __init__(self, initials: list[str], faults: list[str], after: list[int]):
        self.initials, self.size = initials, len(initials)
        #: (least cost of retaining a turn as this role, plus the deletions before it; that turn), of the turns seen.
        least = [(FAR, -1)] * 4
        self.picks: list[list[tuple[int, int] | None]] = [[]] * self.size
        for at in range(self.size - 1, -1, -1):
            self.picks[at] = [None] * 4
            if faults[at] in ("blank", "duplicate"):
                continue
            fixed = DELETE * at + (TRUNCATED if faults[at] == "truncated" else 0) - DELETE * (at + 1)
            given, found = INITIALS.get(initials[at], 0), {}
            for role in (SYSTEM, USER, ASSISTANT) if given == SYSTEM else (USER, ASSISTANT):
                cost, pick = self.choose(role, least, after)
                self.picks[at][role] = pick
                found[role] = cost + fixed + (0 if given == role else RETYPE)
            for role, cost in found.items():
                if cost < least[role][0]:
                    least[role] = (cost, at)
        self.entries = [self.choose(state, least, after) for state in range(4)]

    def choose(self, state: int, least: list[tuple[int, int]], after: list[int]) -> tuple[int, tuple[int, int]]:
        """(cost plus deletions before, (turn, role)) of what is retained next; the turn after the last: nothing more."""
        best, order, pick = after[state] + DELETE * self.size, (-self.size,), (self.size, state)
        for role, inserted in NEXT[state]:
            cost, at = least[role]
            cost += INSERT if inserted else 0
            if cost < FAR and cost <= best:
                rank = (-at, 0 if inserted else 1 if INITIALS.get(self.initials[at]) == role else 2)
                if cost < best or rank < order:
                    best, order, pick = cost, rank, (at, role)
        return best, pick

    def cost(self, entry: int) -> int:
        return min(FAR, self.entries[entry][0])

    def path(self, entry: int) -> list[tuple[int, int]]:
        """(turn, role) of all that is retained, from a state on."""
        at, role = self.entries[entry][1]
        found = []
        while at < self.size:
            found.append((at, role))
            at, role = self.picks[at][role]
        return found

    def leave(self, entry: int) -> int:
        path = self.path(entry)
        return path[-1][1] if path else entry


def transitions(initials: list[str], faults: list[str]) -> list[int]:
    """Least cost of a stretch from each state to each."""
    plans = [Plan(initials, faults, [0 if state == leave else FAR for state in range(4)]) for leave in range(4)]
    return [plans[leave].cost(entry) for entry in range(4) for leave in range(4)]


def edits(plan: Plan, entry: int, last: bool):
    """(turn or None, initial of the edit, role or None) in order; ``last`` ends the conversation."""
    state, at = entry, 0
    for turn, role in plan.path(entry):
        for gone in range(at, turn):
            yield gone, "D", None
        inserted = dict(NEXT[state])[role]
        if inserted:
            yield None, "I", NAMES[inserted]
        kept = INITIALS.get(plan.initials[turn]) == role
        yield turn, "K" if kept else "R", None if kept else NAMES[role]
        state, at = role, turn + 1
    for gone in range(at, plan.size):
        yield gone, "D", None
    for role in ENDING[state] if last else ():
        yield None, "I", NAMES[role]


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Turns by conversation, number (nulls first), role and hash of the text, with their place and their fault.

    The order is written to the checkpoint folder, for ranges are sampled anew on every run.
    Faults: blank, else duplicate (role and text of an earlier turn), else truncated, else empty.
    """
    given = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = given.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(dealt.withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("range", F.shiftright("place", ROW_BITS))
    ends = F.rtrim("text", F.lit(WHITE))
    placed = placed.withColumns({"ends": F.right(ends, F.lit(1)), "initial": F.substring("role", 1, 1)})
    said = placed.filter("ends <> ''").groupBy("conv_id", "role", "digest")
    again = materialise(
        said.agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("conv_id").alias("d_conv"), F.col("role").alias("d_role"), F.col("digest").alias("d_digest"), "first")
    )
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = F.col("conv_id").eqNullSafe(F.col("d_conv")) & (F.col("role") == F.col("d_role")) & (F.col("digest") == F.col("d_digest"))
    marked = placed.join(F.broadcast(again) if few else again, same, "left")
    fault = (
        F.when(F.col("ends") == "", "blank")
        .when(F.col("place") > F.col("first"), "duplicate")
        .when(~F.col("ends").isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    marked = marked.select("conv_id", "range", "place", "turn", "role", "initial", "text", fault.alias("fault"))
    #  written, too: a sort below a later join would be optimised away
    return marked if few else materialise(marked.repartition("range").sortWithinPartitions("place"))


def portions(batches, names: list[str]):
    """((conversation, range), rows) of consecutive rows of an ordered stream; a portion may span batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "range", *names)), strict=True):
            if row[:2] != key and rows:
                yield key, rows
                rows = []
            key = row[:2]
            rows.append(row[2:])
    if rows:
        yield key, rows


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], field.type) for i, field in enumerate(schema)], schema=schema)


def in_batches(rows, schema: pa.Schema, size: int = 2000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield table_of(held, schema)
            held = []
    if held:
        yield table_of(held, schema)


EDGE = pa.schema([("conv_id", pa.int64()), ("range", pa.int64()), ("costs", pa.list_(pa.int64()))])
PASSAGE = pa.schema([("conv_id", pa.int64()), ("range", pa.int64()), ("leaves", pa.list_(pa.int64()))])


def outer_parts(batches):
    """Costs of the first and of the last portion of each range, the only ones that may go on elsewhere."""

    def found():
        held = None
        for key, rows in portions(batches, ["initial", "fault"]):
            fresh = held is None or held[0][1] != key[1]
            if held and (held[2] or fresh):
                yield *held[0], transitions(*zip(*held[1], strict=True))
            held = (key, rows, fresh)
        if held:
            yield *held[0], transitions(*zip(*held[1], strict=True))

    return in_batches(found(), EDGE)


def passages(batches):
    """The state that each split portion is left in, from each state and given what follows."""

    def found():
        for key, rows in portions(batches, ["initial", "fault", "after"]):
            plan = Plan([r[0] for r in rows], [r[1] for r in rows], rows[0][2])
            yield *key, [plan.leave(entry) for entry in range(4)]

    return in_batches(found(), PASSAGE)


def split_portions(turns: DataFrame) -> DataFrame:
    """(s_conv, s_range, entry, after, opens, closes) of the portions whose conversation is in several ranges.

    There are two a range at most, so each chain is no longer than the number of ranges.
    """
    edges = materialise(turns.select("conv_id", "range", "initial", "fault").mapInArrow(outer_parts, "conv_id long, range long, costs array<long>"))

    def backwards(group):
        group = group.sort_values("range", ascending=False)
        after, rows = CLOSING, []
        for number, costs in zip(group["range"], group["costs"], strict=True):
            rows.append((int(number), list(after)))
            after = [min(FAR, min(int(costs[4 * a + b]) + after[b] for b in range(4))) for a in range(4)]
        return group.assign(after=[after for _, after in rows])[["conv_id", "range", "after"]].iloc[: len(rows) if len(rows) > 1 else 0]

    def forwards(group):
        group = group.sort_values("range")
        state, entries = START, []
        for leaves in group["leaves"]:
            entries.append(state)
            state = int(leaves[state])
        return group.assign(entry=entries, opens=group["range"] == group["range"].min(), closes=group["range"] == group["range"].max())[
            ["conv_id", "range", "entry", "after", "opens", "closes"]
        ]

    chained = materialise(edges.groupBy("conv_id").applyInPandas(backwards, "conv_id long, range long, after array<long>"))
    named = chained.withColumnsRenamed({"conv_id": "s_conv", "range": "s_range"})
    mine = F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("range") == F.col("s_range"))
    parts = turns.select("conv_id", "range", "initial", "fault").join(F.broadcast(named), mine).drop("s_conv", "s_range")
    left = parts.mapInArrow(passages, "conv_id long, range long, leaves array<long>")
    met = left.join(F.broadcast(named), mine).drop("s_conv", "s_range")
    schema = "conv_id long, range long, entry int, after array<long>, opens boolean, closes boolean"
    return materialise(met.groupBy("conv_id").applyInPandas(forwards, schema)).withColumnsRenamed({"conv_id": "s_conv", "range": "s_range"})


EDIT = pa.schema([
    ("conv_id", pa.int64()), ("range", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("given_role", pa.string()), ("fault", pa.string()),
    ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("cost", pa.int64()), ("whole", pa.bool_()),
])
EDIT_SQL = "conv_id long, range long, place long, turn long, given_role string, fault string, edit string, role string, text string, cost long, whole boolean"
COSTS = {"K": 0, "R": RETYPE, "D": DELETE, "I": INSERT}


def edited(turns: DataFrame) -> DataFrame:
    """All edits in order within partitions; ``whole`` tells conversations that lie in one range."""
    ordered = ordered_turns(turns)
    split = split_portions(ordered)
    mine = F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("range") == F.col("s_range"))
    met = ordered.join(F.broadcast(split), mine, "left").drop("s_conv", "s_range")

    def run(batches):
        def found():
            names = ["place", "turn", "role", "initial", "fault", "text", "entry", "after", "opens", "closes"]
            for (conv, part), rows in portions(batches, names):
                whole = rows[0][6] is None
                entry, after, closes = (START, CLOSING, True) if whole else (rows[0][6], rows[0][7], rows[0][9])
                plan = Plan([r[3] for r in rows], [r[4] for r in rows], after)
                at = rows[0][0]
                for turn, edit, role in edits(plan, entry, closes):
                    if turn is None:
                        yield conv, part, at, None, None, None, edit, role, "", INSERT, whole
                        continue
                    at, number, given, _, fault, text = rows[turn][:6]
                    cost = COSTS[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                    kept = None if edit == "D" else role or given
                    yield conv, part, at, number, given, fault, edit, kept, None if edit == "D" else text, cost, whole

        yield from in_batches(found(), EDIT)

    return met.mapInArrow(run, EDIT_SQL)


def repair_turns(turns: DataFrame) -> DataFrame:
    """One row per edit: conv_id, place, turn, given_role, fault, edit (K, R, D or I), role, text, cost.

    The cheapest edits that make the initials of all roles read ``(s?(ua)+)?``: keep, rerole to user or
    assistant (1), delete (2; what is blank or a duplicate has to go), insert an empty turn (5); a
    truncated turn that stays costs 5 more. Of equal costs the edits whose initials are least in ASCII.
    Rows of a conversation come by ``place``; an inserted turn has the place of the row before it in
    the edits (its own conversation's first for none) and stands after it, or before it if it opens the
    conversation, so the order within a place is that of the rows. Deleted turns have no role and text.

    Turns are ordered by number (null first), role and the hash of the text, so repeated rows are
    neighbours. Null roles and texts are one space. A null conv_id is a conversation. Roles count by
    their first letter; other ones may be reroled or deleted. Texts of any length are kept whole; a
    task holds the turns that one conversation has in one range. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    ship_package(turns.sparkSession)
    return edited(turns).drop("range", "whole")


PIECE = pa.schema([
    ("conv_id", pa.int64()), ("range", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.binary()), ("sha256", pa.string()),
    ("first_initial", pa.string()), ("last_initial", pa.string()), ("min_turn", pa.int64()), ("max_turn", pa.int64()), ("turns", pa.int64()),
])
PIECE_SQL = (
    "conv_id long, range long, piece long, whole boolean, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
    " repaired binary, sha256 string, first_initial string, last_initial string, min_turn long, max_turn long, turns long"
)
LEGAL = frozenset({"su", "ua", "au"})
#: Bytes of repaired text that are hashed, or leave a task, at a time.
PIECE_BYTES = 1 << 20


class Tally:
    """Counts over consecutive edits of a conversation, or over consecutive pieces of such counts."""

    def __init__(self):
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = self.turns = 0
        self.audit: list[str] = []
        self.first = self.last = self.low = self.high = None

    def pair(self, first: str | None, last: str | None) -> None:
        if first is None:
            return
        self.illegal += self.last is not None and self.last + first not in LEGAL
        self.first = first if self.first is None else self.first
        self.last = last

    def numbers(self, low: int | None, high: int | None, count: int) -> None:
        """Turn numbers come in order, so only neighbours may be equal."""
        if low is None:
            return
        self.turns += count - (self.high == low)
        self.low = low if self.low is None else self.low
        self.high = high

    def row(self, conv, part, piece, whole, repaired, digest):
        return (
            conv, part, piece, whole, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), repaired, digest,
            self.first, self.last, self.low, self.high, self.turns,
        )


def pieces(batches):
    """One row for each whole conversation, with its hash; pieces of up to 1 MB of text of the others."""

    def found():
        key = tally = sha = None
        piece, held, size = 0, [], 0
        columns = ["conv_id", "range", "turn", "given_role", "fault", "edit", "role", "text", "cost", "whole"]

        def done(whole):
            nonlocal held, size
            text, held, size = b"".join(held), [], 0
            if not whole:
                return tally.row(*key, piece, False, text, None)
            sha.update(text)
            return tally.row(*key, piece, True, None, sha.hexdigest())

        for batch in batches:
            for conv, part, turn, given, fault, edit, role, text, cost, whole in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in columns), strict=True):
                if (conv, part) != key:
                    if key:
                        yield done(was_whole)
                    key, tally, sha, piece, was_whole, first = (conv, part), Tally(), hashlib.sha256(), 0, whole, True
                if edit != "I":
                    tally.pair(given[:1], given[:1])
                    tally.numbers(turn, turn, 1)
                    if fault:
                        tally.faults[fault] += 1
                tally.cost += cost
                tally.audit.append(edit)
                if edit != "D":
                    line = f"{role}:{text}".encode()
                    held.append(line if whole and first else b"\n" + line)  # a split one loses its first line end when all pieces are there
                    first, size = False, size + len(line)
                    if size >= PIECE_BYTES:
                        if whole:
                            sha.update(b"".join(held))
                            held, size = [], 0
                        else:
                            yield done(False)
                            tally, piece = Tally(), piece + 1
        if key:
            yield done(was_whole)

    return in_batches(found(), PIECE, 500)


def joined_pieces(batches):
    """Pieces in order of conversation, range and number to one row for each conversation."""

    def found():
        current = tally = sha = None
        begun = False
        for batch in batches:
            for row in batch.to_pylist():
                if tally is None or row["conv_id"] != current:
                    if tally:
                        yield tally.row(current, None, None, True, None, sha.hexdigest())
                    current, tally, sha, begun = row["conv_id"], Tally(), hashlib.sha256(), False
                for fault in tally.faults:
                    tally.faults[fault] += row[fault]
                tally.illegal += row["illegal"]
                tally.cost += row["cost"]
                tally.audit.append(row["audit"])
                tally.pair(row["first_initial"], row["last_initial"])
                tally.numbers(row["min_turn"], row["max_turn"], row["turns"])
                text = row["repaired"]
                sha.update(text if begun else text[1:])
                begun = begun or bool(text)
        if tally:
            yield tally.row(current, None, None, True, None, sha.hexdigest())

    return in_batches(found(), PIECE, 500)


def repair_digests(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``, for the edits of :func:`repair_turns` on ``turns``.

    gaps, counts of faults, illegal pairs of neighbours, cost, audit and the SHA-256 of the repaired
    ``role:text`` lines. A hash reads its text in order, so a conversation that lies in several ranges
    comes together in one task, as a stream of pieces of which one is held at a time; its audit is a
    value of the result.
    """
    ship_package(turns.sparkSession)
    parts = materialise(edited(turns).mapInArrow(pieces, PIECE_SQL))
    split = parts.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "range", "piece")
    told = parts.filter("whole").unionByName(split.mapInArrow(joined_pieces, PIECE_SQL)).withColumnRenamed("conv_id", "r_conv")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    met = every.join(told, F.col("conv_id").eqNullSafe(F.col("r_conv")), "left")
    nought = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return met.select(
        "conv_id",
        F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"),
        *(nought(name) for name in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults, by the hash of their conversation and number (nulls: one space).

    crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3
    repeats it, 4 makes its role user.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("long").cast("string"), blank), F.coalesce(F.col("turn").cast("long").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1)))
    return rows.filter("damage <> 0").select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")
    )


def repair_sql() -> str:
    """DuckDB SQL for the same rows: every edit of every turn from every state, in order, with audits and texts compared whole."""
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def add(state: str, cost: str, letters: str, lines: str) -> str:
        return f"{{'c': {state}.c + {cost}, 't': {state}.t || {letters}, 'r': {state}.r || {lines}}}"

    gone = lambda state: f"{{'c': {state}.c + 2, 't': {state}.t || 'D', 'r': {state}.r}}"

    def retained(name: str, initial: str, plain: str, inserting: str, filler: str) -> str:
        cost = f"CASE WHEN initial = '{initial}' THEN 0 ELSE 1 END + late"
        letter = f"CASE WHEN initial = '{initial}' THEN 'K' ELSE 'R' END"
        line = f"CASE WHEN initial = '{initial}' THEN role ELSE '{name}' END || ':' || text"
        found = [add(state, cost, letter, f"[{line}]") for state in plain]
        found += [add(state, f"5 + {cost}", f"'I' || {letter}", f"['{filler}:', {line}]") for state in inserting]
        own = gone(initial)
        return f"CASE WHEN fixed THEN {own} ELSE list_min([{own}, {', '.join(found)}]) END"

    far = "{'c': 1000000000000, 't': '', 'r': []::VARCHAR[]}"
    none = "{'c': 0, 't': '', 'r': []::VARCHAR[]}"
    final = f"list_min([z, a, {add('u', '5', chr(39) + 'I' + chr(39), '[' + chr(39) + 'assistant:' + chr(39) + ']')}, {add('s', '10', chr(39) + 'II' + chr(39), '[' + chr(39) + 'user:' + chr(39) + ', ' + chr(39) + 'assistant:' + chr(39) + ']')}])"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda i: ord(k[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)
  ), 4294967295) % 20 AS h FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE h <> 0),
placed AS (
  SELECT *, left(role, 1) AS initial, right(rtrim(text, {white}), 1) AS ends,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
judged AS (
  SELECT *, CASE WHEN ends = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN ends NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal,
         count(*) OVER (PARTITION BY conv_id) AS n FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (illegal) AS illegal FROM judged GROUP BY conv_id),
row_of AS (SELECT *, fault IN ('blank', 'duplicate') AS fixed, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late FROM judged),
walk AS (
  SELECT conv_id, 0::BIGINT AS past, n, {none} AS z, {far} AS s, {far} AS u, {far} AS a FROM (SELECT DISTINCT conv_id, n FROM judged)
  UNION ALL
  SELECT w.conv_id, r.i, w.n, {gone("z")},
         CASE WHEN fixed OR initial <> 's' THEN {gone("s")} ELSE list_min([{gone("s")}, {add("z", "late", "'K'", "[role || ':' || text]")}]) END,
         {retained("user", "u", "zsa", "u", "assistant")},
         {retained("assistant", "a", "u", "zsa", "user")}
  FROM walk w JOIN row_of r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.past + 1),
ended AS (SELECT conv_id, {final} AS best FROM walk WHERE past = n),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.t, '') AS audit,
       sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM every e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended d ON e.conv_id IS NOT DISTINCT FROM d.conv_id
"""
