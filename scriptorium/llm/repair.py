"""Repair of conversations: the cheapest edits that make their roles alternate.

Turns are kept, given another role, deleted, or empty ones inserted, until the initials
of the roles read ``(s?(ua)+)?``. Edits are found by A* over the lattice of (turns read,
last role written). What is left to pay is at least the suffix sum of deletions that are
required and of what a truncated turn costs whether it stays or goes; nodes leave the
queue by (cost + that sum, edits so far), so the first way out is the cheapest and, of
those, the ASCII-least.

Conversations lie in ranges of (conversation, turn). One that is whole inside a range and
of at most SIZE turns is repaired while it streams past. The rest is cut into blocks of
SIZE turns: A* finds each block's cheapest edits from every state to every state, and
the blocks of a conversation, a row each, are joined by what each state costs to the end.
An edit sequence is cut uniquely: insertions belong to the turn they precede.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.plans.store import materialise, scoped

SIZE = 256
#: What edits cost, and what an undeleted truncated turn costs besides.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that a given or inserted turn gets in each state.
NEXT = ("user", "user", "assistant", "user")
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"
NEVER = 1 << 60


def search(turns: list[tuple[str, str]], entry: int = START, whole: bool = True) -> dict[int, tuple[int, str]]:
    """exit state -> (cost, edits) of ``turns`` (role's initial, fault: ``b`` blank, ``d``
    duplicate, ``t`` truncated, ``o`` none), from ``entry``. ``whole`` turns end the
    conversation: insertions may follow them, and only the best accepted way is given."""
    n = len(turns)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if turns[i][1] in "bd" else min(DELETE, TRUNCATED) if turns[i][1] == "t" else 0)
    queue, closed, out = [(rest[0], "", 0, entry)], set(), {}
    while queue:
        f, audit, i, q = heappop(queue)
        if (i, q) in closed:
            continue
        closed.add((i, q))
        if i == n and (not whole or q in (START, ASSISTANT)):
            out[q] = (f, audit)
            if whole:
                break
            continue
        g, given = f - rest[i], STEP[q][NEXT[q][0]]
        if i < n:
            initial, fault = turns[i]
            heappush(queue, (g + DELETE + rest[i + 1], audit + "D", i + 1, q))
            if fault not in "bd":
                stays = g + (TRUNCATED if fault == "t" else 0) + rest[i + 1]
                if initial in STEP[q]:
                    heappush(queue, (stays, audit + "K", i + 1, STEP[q][initial]))
                heappush(queue, (stays + REROLE, audit + "R", i + 1, given))
        heappush(queue, (g + INSERT + rest[i], audit + "I", i, given))
    return out


def applied(audit: str, turns: list[tuple[str, str]], state: int = START) -> list[tuple[str, str]]:
    """The (role, text) turns that the edits leave."""
    out, i = [], 0
    for letter in audit:
        if letter != "D":
            role = turns[i][0] if letter == "K" else NEXT[state]
            out.append((role, "" if letter == "I" else turns[i][1]))
            state = STEP[state][role[0]]
        i += letter != "I"
    return out


def lines(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) as a faulty log would hold them, by
    crc32(conv_id:turn) mod 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3
    repeats it, 4 makes its role user. Nulls of role and text, and of ids in the digest,
    are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.where("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _kind() -> Column:
    """A turn's fault, but for being a duplicate, which depends on the turns before."""
    seen = F.rtrim("text", F.lit(BLANKS))
    return F.when(seen == "", "b").when(F.right(seen, F.lit(1)).isin(".", "!", "?"), "o").otherwise("t")


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_FIRST = pa.schema(
    [("conv", pa.string()), ("done", pa.bool_())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("turns", pa.list_(_TURN)), ("part", pa.int32()), ("seq", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("kind", pa.string())]
)
FIRST = "conv string, done boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, turns array<struct<role:string,text:string>>, part int, seq long, turn long, role string, text string, kind string"


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def repaired(rows: list[dict], with_turns: bool) -> dict:
    """The result for all turns of one conversation, in order."""
    faults, seen = [], set()
    for r in rows:
        own = (r["role"], r["text"])
        faults.append("b" if r["kind"] == "b" else "d" if own in seen else r["kind"])
        seen.add(own)
    turns = [(r["role"], r["text"]) for r in rows]
    initials = [role[:1] for role, _ in turns]
    ((cost, audit),) = search(list(zip(initials, faults))).values()
    left, at = applied(audit, turns), {r["turn"] for r in rows} - {None}
    gaps = min(max(at) - min(at) + 1 - len(at), 2**63 - 1) if at else 0
    counts = {"gaps": gaps, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"), "illegal": illegal_pairs(initials)}
    told = {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(lines(left).encode()).hexdigest()}
    return {"conv": rows[0]["conv"], "done": True, **counts, **told, "turns": [{"role": a, "text": b} for a, b in left] if with_turns else None}


def batched(rows: Iterator[dict], schema: pa.Schema, step: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows; missing fields are null."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == step:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _streamed(with_turns: bool):
    """Over one sorted range: results of conversations that are whole in it and not long, and
    the rows of the others. The first and the last of a range may go on in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows_on(rows: list[dict], seq: int) -> Iterator[dict]:
            for r in rows:
                yield {**r, "done": False, "part": part, "seq": seq}
                seq += 1

        def results() -> Iterator[dict]:
            held: list[dict] = []
            conv, sent, first = None, 0, True  # sent: rows of this conversation that went on
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    for r in batch.slice(at, 500).to_pylist():
                        if r["conv"] != conv and conv is not None:
                            if sent or first:
                                yield from rows_on(held, sent)
                            else:
                                yield repaired(held, with_turns)
                            held, sent, first = [], 0, False
                        conv = r["conv"]
                        held.append(r)
                        if len(held) > SIZE:
                            yield from rows_on(held, sent)
                            sent += len(held)
                            held = []
            yield from rows_on(held, sent)

        yield from batched(results(), _FIRST)

    return run


_BLOCK = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("sub", pa.int64()), ("costs", pa.list_(pa.int64())), ("pieces", pa.list_(pa.string())), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string())])
BLOCK = "conv string, part int, sub long, costs array<long>, pieces array<string>, illegal long, head string, tail string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the cost and edits from state s to state t, at 4 * s + t."""

    def results() -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                turns = [(x["initial"], x["fault"]) for x in r["held"]]
                costs, pieces = [NEVER] * 16, [""] * 16
                for s in range(4):
                    for t, (cost, audit) in search(turns, s, whole=False).items():
                        costs[4 * s + t], pieces[4 * s + t] = cost, audit
                initials = [a for a, _ in turns]
                yield {"conv": r["conv"], "part": r["part"], "sub": r["sub"], "costs": costs, "pieces": pieces, "illegal": illegal_pairs(initials), "head": initials[0], "tail": initials[-1]}

    yield from batched(results(), _BLOCK)


#: What each state costs at the end, and the insertions that pay for.
ENDS = (0, 2 * INSERT, INSERT, 0)
END_EDITS = ("", "II", "I", "")
_BACK = pa.schema([*_BLOCK, pa.field("after", pa.list_(pa.int64())), pa.field("last", pa.bool_())])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation, last first, with what each state costs after them."""

    def results() -> Iterator[dict]:
        conv, ahead = None, list(ENDS)
        for batch in batches:
            for r in batch.to_pylist():
                last = r["conv"] != conv
                if last:
                    conv, ahead = r["conv"], list(ENDS)
                yield {**r, "after": ahead, "last": last}
                ahead = [min(min(r["costs"][4 * s + t] + ahead[t] for t in range(4)), NEVER) for s in range(4)]

    yield from batched(results(), _BACK)


_CHOSEN = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("sub", pa.int64()), ("entry", pa.int32()), ("piece", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])
CHOSEN = "conv string, part int, sub long, entry int, piece string, cost long, illegal long"


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order with the edits of the cheapest way, ties by the edits: of two ways
    through a block neither's edits begin the other's, so the least are the least on."""

    def results() -> Iterator[dict]:
        conv, state, tail = None, START, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["conv"] != conv:
                    conv, state, tail = r["conv"], START, None
                _, piece, t = min((r["costs"][4 * state + t] + r["after"][t], r["pieces"][4 * state + t], t) for t in range(4))
                cost, illegal = r["costs"][4 * state + t], r["illegal"] + (tail is not None and tail + r["head"] not in LEGAL)
                if r["last"]:
                    cost, piece = cost + ENDS[t], piece + END_EDITS[t]
                yield {"conv": conv, "part": r["part"], "sub": r["sub"], "entry": state, "piece": piece, "cost": cost, "illegal": illegal}
                state, tail = t, r["tail"]

    yield from batched(results(), _CHOSEN)


_PART = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("sub", pa.int64()), ("piece", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("body", pa.string()), ("turns", pa.list_(_TURN))])
PART = "conv string, part int, sub long, piece string, cost long, illegal long, body string, turns array<struct<role:string,text:string>>"


def _rewritten(with_turns: bool):
    """A row a block: its repaired lines, null where there are none; rows come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[dict]) -> dict:
            r = held[0]
            left = applied(r["piece"], [(x["role"], x["text"]) for x in held], r["entry"])
            return {**{c: r[c] for c in ("conv", "part", "sub", "piece", "cost", "illegal")}, "body": lines(left) if left else None, "turns": [{"role": a, "text": b} for a, b in left] if with_turns else None}

        def results() -> Iterator[dict]:
            held: list[dict] = []
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    for r in batch.slice(at, 500).to_pylist():
                        if held and (r["conv"], r["part"], r["sub"]) != (held[0]["conv"], held[0]["part"], held[0]["sub"]):
                            yield told(held)
                            held = []
                        held.append(r)
            if held:
                yield told(held)

        yield from batched(results(), _PART, 20)

    return run


_WHOLE = pa.schema([("conv", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their blocks in order. The digest runs on from block to block."""

    def results() -> Iterator[dict]:
        conv, now, digest, any_line, audit = None, None, None, False, []
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                for r in batch.slice(at, 50).to_pylist():
                    if r["conv"] != conv:
                        if now:
                            yield {**now, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                        conv, digest, any_line, audit = r["conv"], hashlib.sha256(), False, []
                        now = {"conv": conv, "illegal": 0, "cost": 0}
                    if r["body"] is not None:
                        digest.update((b"\n" if any_line else b"") + r["body"].encode())
                        any_line = True
                    audit.append(r["piece"])
                    now["illegal"] += r["illegal"]
                    now["cost"] += r["cost"]
        if now:
            yield {**now, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    yield from batched(results(), _WHOLE, 100)


RESULT = ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _long(rows: DataFrame, with_turns: bool) -> tuple[DataFrame, DataFrame]:
    """(results, blocks) of conversations that were not whole in a range, or are long;
    ``rows`` have conv, part, seq, turn, role, text, kind."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("sub", F.expr(f"seq div {SIZE}"))
    firsts = materialise(rows.where("kind <> 'b'").groupBy("conv", "role", "digest").agg(F.min(F.struct("part", "seq")).alias("first")), "repair-firsts")
    again = F.col("first.part") != F.col("part")
    fault = F.when(F.col("kind") == "b", "b").when(again | (F.col("first.seq") != F.col("seq")), "d").otherwise(F.col("kind"))
    judged = rows.join(firsts.hint("merge"), ["conv", "role", "digest"], "left").withColumn("fault", fault)
    judged = materialise(judged.select("conv", "part", "sub", "seq", "turn", "role", "text", "fault"), "repair-judged")
    held = judged.groupBy("conv", "part", "sub").agg(F.array_sort(F.collect_list(F.struct("seq", F.substring("role", 1, 1).alias("initial"), "fault"))).alias("held"))  # SIZE turns at most
    blocks = materialise(held.mapInArrow(_blocks, BLOCK), "repair-blocks")
    # From here on a conversation is a row a block.
    order = [F.col("part"), F.col("sub")]
    back = blocks.repartition(parts, "conv").sortWithinPartitions("conv", *[c.desc() for c in order]).mapInArrow(_backward, BLOCK + ", after array<long>, last boolean")
    chosen = materialise(materialise(back, "repair-back").repartition(parts, "conv").sortWithinPartitions("conv", *order).mapInArrow(_forward, CHOSEN), "repair-chosen")
    keys = ["conv", "part", "sub"]
    # Written first: Spark would leave out the exchange after a join on its keys, and may split the join's partitions.
    edited = materialise(judged.select(*keys, "seq", "role", "text").join(chosen, keys), "repair-edited").repartition(parts, *keys).sortWithinPartitions(*keys, "seq")
    bodies = materialise(edited.mapInArrow(_rewritten(with_turns), PART), "repair-bodies")
    whole = bodies.select(*keys, "piece", "cost", "illegal", "body").repartition(parts, "conv").sortWithinPartitions(*keys)
    whole = whole.mapInArrow(_joined, "conv string, illegal long, cost long, audit string, repaired_sha256 string")
    count = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias({"b": "blank", "d": "duplicate", "t": "truncated"}[f])
    span = (F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1).alias("span")
    counts = judged.groupBy("conv").agg(span, count("b"), count("d"), count("t"))
    turns = judged.where("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("n"))
    gaps = F.coalesce(F.least(F.col("span") - F.col("n"), F.lit(2**63 - 1)).cast("long"), F.lit(0))
    return materialise(whole.join(counts, "conv").join(turns, "conv", "left").withColumn("gaps", gaps).select(*RESULT), "repair-long"), bodies.select("conv", "part", "sub", "turns")


def _run(conversations: DataFrame, with_turns: bool) -> tuple[DataFrame, DataFrame]:
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("-")).alias("conv"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    rows = rows.withColumn("kind", _kind()).withColumn("tie", F.md5(F.col("text").cast("binary"))).withColumn("row", F.monotonically_increasing_id())
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "tie", "row"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie", "row")
    first = materialise(ordered.mapInArrow(_streamed(with_turns), FIRST), "repair-first")
    done = first.where("done")
    long, blocks = _long(first.where("not done").select("conv", "part", "seq", "turn", "role", "text", "kind"), with_turns)
    turns = done.select("conv", F.lit(0).alias("part"), F.lit(0).cast("long").alias("sub"), "turns").unionByName(blocks)
    return done.select(*RESULT).unionByName(long), turns


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("conv_id", F.when(F.col("conv") != "-", F.col("conv")).cast("long"))


@scoped
def repair(conversations: DataFrame) -> DataFrame:
    """A row per conversation of ``conversations`` (conv_id, turn, role, text): conv_id, gaps
    (turn numbers missing between the least and the greatest), blank, duplicate and
    truncated (turns by their first fault), illegal (neighbours whose initials are not su,
    ua or au), cost and audit (the cheapest edits' initials: Keep, Rerole, Delete, Insert),
    repaired_sha256 (of ``role:text`` lines).

    Turns go by number, nulls first, equal numbers by role and the text's MD5; repeated
    rows are duplicates. Null roles and texts are one space, so such a text is blank. A
    null conv_id is a conversation; an empty role has an empty initial. Texts of any
    length are whole; an empty table gives no rows; other columns are ignored. Only the
    digest and the edits of one conversation need a task of their own, which streams."""
    return _named(_run(conversations, False)[0]).select("conv_id", *RESULT[1:])


@scoped
def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns that :func:`repair` leaves; ``place`` ascends
    within a conversation, with gaps where it was long."""
    turns = _named(_run(conversations, True)[1])
    place = F.col("part").cast("long") * 2**40 + F.col("sub") * (4 * SIZE) + F.col("at")
    return turns.select("conv_id", "part", "sub", F.posexplode("turns").alias("at", "turn")).select("conv_id", place.alias("place"), "turn.role", "turn.text")


@scoped
def repaired_log(conversations: DataFrame) -> DataFrame:
    """:func:`repair` of the damaged ``conversations``, a row for every conv_id there was; one
    without a row after damage has zeros, no edits and the digest of the empty text."""
    told = repair(damage(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("known")).distinct()
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in RESULT[1:7]]
    empty = hashlib.sha256(b"").hexdigest()
    full = every.join(told, F.col("known").eqNullSafe(F.col("conv_id")), "left")
    return full.select(F.col("known").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
