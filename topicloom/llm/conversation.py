"""Repair of conversations by the cheapest edits, a dynamic programme with square-root checkpoints.

The roles of a repaired conversation match ``(s?(ua)+)?``: nothing, or user and assistant in turn, maybe
after a system row. Rows are kept (0), given the role that fits (1) or deleted (2); blank rows and
repeated ones must go; a row that breaks off and stays costs 5 more; an empty row of the role that
fits can be inserted anywhere (5). Of the cheapest ways the one with the ASCII-least letters D, I, K, R wins.

1. Rows are numbered within their conversation, across tasks, and get a code: initial and first fault.
2. The codes of a conversation of ``n`` rows are cut into blocks of about the square root of ``n`` (at
   least ``BLOCK``). For a conversation of several blocks, each block first gives the cost from every
   state before it to every state after it; from these the cost vectors at the ends of blocks follow,
   last block first. Only these checkpoints are stored.
3. A block recomputes the vectors inside it from the checkpoint at its end and walks forward, from each
   state; the states in which the blocks begin follow, and each block emits its letters.
4. Rows meet the letters of their block and give the repaired rows.

So no task holds more than a block of rows, or one vector for each block of a conversation.

Rows of one turn stand in the order of role, then of the text's SHA-256; a null turn comes first. Null
roles and texts are one space. A null ``conv_id`` is a conversation of its own. Repeated rows are
duplicates and go. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, by_rows, stored
from .order import positions

BLOCK = 512
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
NEVER = 1 << 40
# states: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
FITS = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: where a row of the role that fits (never system) leads
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
TAIL = (0, 2 * INSERT, INSERT, 0)  # cost of the inserts that end a conversation
TAIL_LETTERS = ("", "II", "I", "")
INITIALS = "sua"  # and anything else
FAULTS = ("none", "truncated", "blank", "duplicate")
CODES = "0123456789abcdef"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with every twentieth row or so dropped, emptied, cut, repeated or given a wrong role."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), text("role").alias("role"), text("text").alias("text"), draw.alias("__draw"))
    changed = F.when(F.col("__draw") == 1, F.lit("")).when(F.col("__draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("__draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("__draw <> 0").select(
        "conv_id", "turn", F.when(F.col("__draw") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"),
        F.explode(times).alias("__copy"),
    ).drop("__copy")


class Steps(dict):
    """For a cost vector after a row and the row's code: the vector before it less its least entry, that
    entry, and for each state the letters and the state they lead to. Vectors less their least entry are few."""

    def __missing__(self, key: tuple):
        after, code = key
        initial, fault = INITIALS[code % 4: code % 4 + 1], FAULTS[code // 4]
        least: list[int] = []
        for s in range(4):
            ways = [DELETE + after[s]]
            if fault in ("none", "truncated"):
                extra = BROKEN if fault == "truncated" else 0
                ways.append(REROLE + extra + after[NEXT[s]])
                if initial and initial in FITS[s]:
                    ways.append(KEEP + extra + after[AFTER[initial]])
            least.append(min(ways))
        cost = [min(NEVER, least[s], INSERT + least[NEXT[s]], 2 * INSERT + least[NEXT[NEXT[s]]]) for s in range(4)]
        moves = []
        for s in range(4):
            letters = ""
            while cost[s] < NEVER and DELETE + after[s] != cost[s] and INSERT + cost[NEXT[s]] == cost[s]:
                letters, s = letters + "I", NEXT[s]
            extra = BROKEN if fault == "truncated" else 0
            if cost[s] >= NEVER or DELETE + after[s] == cost[s]:
                letters += "D"
            elif initial and initial in FITS[s] and KEEP + extra + after[AFTER[initial]] == cost[s]:
                letters, s = letters + "K", AFTER[initial]
            else:
                letters, s = letters + "R", NEXT[s]
            moves.append((letters, s))
        base = min(cost)
        found = self[key] = tuple(c - base if c < NEVER else NEVER for c in cost), base, moves
        return found


STEPS = Steps()


def backward(codes: str, after: tuple[int, ...]) -> tuple[list, tuple[int, ...]]:
    """Moves for each row, first row first, and the cost vector before the first."""
    base = min(after)
    vector = tuple(c - base if c < NEVER else NEVER for c in after)
    moves = []
    for code in reversed(codes):
        vector, more, move = STEPS[vector, int(code, 16)]
        base += more
        moves.append(move)
    return moves[::-1], tuple(c + base if c < NEVER else NEVER for c in vector)


def forward(moves: list, state: int) -> tuple[str, int]:
    """Letters of a block entered in ``state``, and the state after it."""
    out = []
    for move in moves:
        letters, state = move[state]
        out.append(letters)
    return "".join(out), state


def crossing(codes: str) -> list[list[int]]:
    """Least cost from every state before a block to every state after it."""
    columns = [backward(codes, tuple(0 if s == x else NEVER for s in range(4)))[1] for x in range(4)]
    return [[columns[x][s] for x in range(4)] for s in range(4)]


def _mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """One row out of each row in: ``fn`` gets the columns' values."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(shape)

    def run(batches):
        for part in by_rows(batches):
            rows = [fn(*values) for values in zip(*[c.to_pylist() for c in part.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, shape)


def _checkpoints(rank: int, blocks: list) -> tuple:
    """Cost vectors at the ends of the blocks of a conversation, from their crossing costs."""
    ends, vector = [], list(TAIL)
    for crossing_ in reversed(blocks):
        ends.append(vector)
        vector = [min(NEVER, *(c + v for c, v in zip(row, vector, strict=True))) for row in crossing_["crossing"]]
    return rank, ends[::-1]


def _entries(rank: int, blocks: list) -> tuple:
    """States in which the blocks of a conversation begin."""
    entries, state = [], START
    for b in blocks:
        entries.append(state)
        state = b["leads"][state]
    return rank, entries


def _letters(rank, block, n, codes, after, entry, last):
    moves, before = backward(codes[block > 0:], tuple(after))
    letters, state = forward(moves, entry)
    roles = [INITIALS[int(c, 16) % 4: int(c, 16) % 4 + 1] for c in codes]
    illegal = sum(pair not in LEGAL for pair in zip(roles, roles[1:]))
    return rank, block, entry, letters + (TAIL_LETTERS[state] if last else ""), before[entry], illegal


def _by_block(values: DataFrame, name: str, kind: str) -> DataFrame:
    """One row for each block out of one array for each conversation."""
    return values.select(F.col("rank").alias("__rank"), F.posexplode(name).alias("__block", name)).withColumn(name, F.col(name).cast(kind))


def edits(coded: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(rank, block, entry, letters, cost, illegal)`` for each block of rows ``(rank, n, pos, code)``:
    the state in which it begins, its edits, the cost from there on, and its illegal neighbours.

    A block's rows are those from ``block * size`` on, of :func:`block_size` rows each.
    """
    size = block_size(block)
    home = F.floor(F.col("pos") / size)
    # the last row of a block also stands before the next one, for their neighbours
    both = F.when(((F.col("pos") + 1) % size == 0) & (F.col("pos") + 1 < F.col("n")), F.array(home, home + 1)).otherwise(F.array(home))
    held = coded.select("rank", "n", "pos", "code", F.explode(both).alias("block"))
    letter = F.substring(F.lit(CODES), F.col("code") + 1, F.lit(1))
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", letter.alias("c")))), lambda x: x["c"]), "")
    blocks = stored(held.groupBy("rank", "block").agg(F.max("n").alias("n"), codes.alias("codes")), "code-blocks")
    single = F.col("n") <= size
    one = blocks.where(single).select("rank", "block", "n", "codes", F.array(*[F.lit(c).cast("bigint") for c in TAIL]).alias("after"), F.lit(START).alias("entry"))

    many = blocks.where(~single)
    crossed = _mapped(
        many.select("rank", "block", "codes"), lambda r, b, c: (r, b, crossing(c[b > 0:])), "rank bigint, block bigint, crossing array<array<bigint>>"
    )
    lists = crossed.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("block", "crossing"))).alias("blocks"))
    ends = _by_block(_mapped(lists, _checkpoints, "rank bigint, after array<array<bigint>>"), "after", "array<bigint>")
    at = (F.col("rank") == F.col("__rank")) & (F.col("block") == F.col("__block"))
    held = stored(many.join(ends, at).select("rank", "block", "n", "codes", "after"), "checkpoints")

    def leads(r, b, codes, after):
        moves, _ = backward(codes[b > 0:], tuple(after))
        return r, b, [forward(moves, s)[1] for s in range(4)]

    led = _mapped(held.select("rank", "block", "codes", "after"), leads, "rank bigint, block bigint, leads array<int>")
    lists = led.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("block", "leads"))).alias("blocks"))
    begun = _by_block(_mapped(lists, _entries, "rank bigint, entry array<int>"), "entry", "int")
    whole = one.unionByName(held.join(begun, at).select(*one.columns))
    last = (F.col("block") + 1) * size >= F.col("n")
    return _mapped(
        whole.select("rank", "block", "n", "codes", "after", "entry", last.alias("last")), _letters,
        "rank bigint, block bigint, entry int, letters string, cost bigint, illegal bigint",
    )


def block_size(block: int = BLOCK) -> Column:
    return F.greatest(F.lit(block), F.ceil(F.sqrt("n"))).cast("bigint")


def coded_rows(rows: DataFrame) -> DataFrame:
    """``(rank, conv_id, n, pos, turn, code)`` for numbered rows: initial of the role plus four times the first fault."""
    trimmed = F.btrim("text", F.lit(SPACES))
    blank = trimmed == ""
    firsts = rows.groupBy("rank", "role", "mark").agg(F.min("pos").alias("__first")).select(F.col("rank").alias("__rank"), "__first")
    first = F.col("__first").isNotNull()
    narrow = rows.select("rank", "conv_id", "n", "pos", "turn", F.left("role", F.lit(1)).alias("initial"), blank.alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    met = narrow.join(firsts, (F.col("rank") == F.col("__rank")) & (F.col("pos") == F.col("__first")), "left")
    fault = F.when(F.col("blank"), 2).when(~first, 3).when(F.col("cut"), 1).otherwise(0)
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    return met.select("rank", "conv_id", "n", "pos", "turn", (fault * 4 + initial).alias("code"))


def _repair(batches):
    """Repaired rows from sorted rows: each block's letters, then its rows."""
    def end(out):
        if pending[0]:  # inserts after the last row of the block
            insert(out, pending[0])
        pending[0] = ""

    def insert(out, letters):
        for _ in letters:
            state[0] = NEXT[state[0]]
            emit(out, ROLE[state[0]], "", None, "I")

    def emit(out, role, text, turn, letter):
        out.append((conv[0], rank[0], block[0], place[0], turn, role, text, letter))
        place[0] += 1

    names = ["conv_id", "rank", "block", "place", "turn", "role", "text", "edit"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    pending, state, place, conv, rank, block = [""], [0], [0], [None], [0], [0]
    for part in by_rows(batches):
        out: list[tuple] = []
        for row in part.to_pylist():
            if row["letters"] is not None:
                end(out)
                pending[0], state[0], place[0] = row["letters"], row["entry"], 0
                rank[0], block[0], conv[0] = row["rank"], row["block"], row["conv_id"]
                continue
            rest = pending[0].lstrip("I")
            insert(out, pending[0][: len(pending[0]) - len(rest)])
            letter, pending[0] = rest[0], rest[1:]
            if letter == "K":
                state[0] = AFTER[row["role"][0]]
                emit(out, row["role"], row["text"], row["turn"], "K")
            elif letter == "R":
                state[0] = NEXT[state[0]]
                emit(out, ROLE[state[0]], row["text"], row["turn"], "R")
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)
    out = []
    end(out)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


REPAIRED = "conv_id bigint, rank bigint, block bigint, place bigint, turn bigint, role string, text string, edit string"


def repaired_rows(rows: DataFrame, letters: DataFrame, block: int = BLOCK, whole: bool = False) -> DataFrame:
    """The rows after repair, ordered by ``(rank, block, place)``; inserted ones have no turn.

    ``whole`` deals them out by conversation and not by block, for what must read a conversation in order.
    """
    home = F.floor(F.col("pos") / block_size(block))
    none = {"letters": "string", "entry": "int"}
    texts = rows.select("rank", home.alias("block"), "pos", "conv_id", "turn", "role", "text", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    empty = {"turn": "bigint", "role": "string", "text": "string"}
    heads = letters.select("rank", "block", F.lit(-1).cast("bigint").alias("pos"), "conv_id", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], *none)
    met = texts.unionByName(heads)
    met = (met.repartition("rank") if whole else met.repartition("rank", "block")).sortWithinPartitions("rank", "block", "pos")
    return met.mapInArrow(_repair, REPAIRED)


def _digests(batches):
    """SHA-256 of each conversation's ``role:text`` lines; rows come conversation by conversation, in order."""
    names = ["conv_id", "rank", "repaired_sha256"]
    types = [pa.int64(), pa.int64(), pa.string()]
    now, conv, sha = None, None, None
    for part in by_rows(batches):
        done = []
        for c, r, role, text in zip(*[part.column(k).to_pylist() for k in ("conv_id", "rank", "role", "text")], strict=True):
            if r != now:
                if sha is not None:
                    done.append((conv, now, sha.hexdigest()))
                now, conv, sha = r, c, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names=names)
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((conv, now, sha.hexdigest()), types)], names=names)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` with their place ``pos`` in a conversation of ``n`` rows."""
    clean = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    clean = clean.withColumn("mark", F.unhex(F.sha2("text", 256)))
    return positions(clean, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("mark").asc()], "turns")


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired rows of conversations ``(conv_id, turn, role, text)``: ``(conv_id, rank, block, place, turn, role, text, edit)``."""
    placed = numbered(rows)
    coded = stored(coded_rows(placed), "codes")
    return repaired_rows(placed, _with_id(edits(coded, block), coded), block)


def _with_id(letters: DataFrame, coded: DataFrame) -> DataFrame:
    ids = coded.where("pos = 0").select(F.col("rank").alias("__r"), "conv_id")
    return letters.join(ids, F.col("rank") == F.col("__r")).drop("__r")


def report(rows: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each ``conv_id`` of ``ids``: ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``."""
    placed = numbered(rows)
    coded = stored(coded_rows(placed), "codes")
    letters = stored(_with_id(edits(coded, block), coded), "letters")
    fault = F.floor(F.col("code") / 4)
    # one row per turn first, so that a long conversation is counted in many tasks
    turns = coded.groupBy("rank", "turn").agg(*[F.count(F.when(fault == k, 1)).alias(FAULTS[k]) for k in (1, 2, 3)])
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = turns.groupBy("rank").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(FAULTS[k]).alias(FAULTS[k]) for k in (2, 3, 1)])
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "letters"))), lambda x: x["letters"]), "")
    totals = letters.groupBy(F.col("rank").alias("__rank"), "conv_id").agg(
        F.sum("illegal").alias("illegal"), F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"), audit.alias("audit")
    )
    digests = repaired_rows(placed, letters, block, whole=True).mapInArrow(_digests, "conv_id bigint, rank bigint, repaired_sha256 string")
    digests = digests.select(F.col("rank").alias("__of"), "repaired_sha256")
    whole = counts.join(totals, F.col("rank") == F.col("__rank")).join(digests, F.col("rank") == F.col("__of"), "left")
    every = ids.select(F.col("conv_id").cast("bigint").alias("__id")).distinct()
    out = every.join(whole, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        F.col("__id").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
