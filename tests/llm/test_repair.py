"""Repair of conversations against brute force over all cheap edit sequences."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import parity
from pyspark.sql import functions as F

from scriptorium.llm import queries as llm
from scriptorium.llm import repair

TABLE = "conv_id long, turn long, role string, text string"
GOOD = re.compile("(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """(cost, edits, turns left): every edit sequence with at most two insertions before a turn
    and at the end, written out, the best of those whose roles are good."""
    ways = {("", ()): (0, "")}

    def put(into, key, value):
        if key not in into or value < into[key]:
            into[key] = value

    def inserted(ways):
        for _ in range(2):
            more = dict(ways)
            for (initials, left), (cost, audit) in ways.items():
                for role in ("user", "assistant"):
                    put(more, (initials + role[0], (*left, (role, ""))), (cost + 5, audit + "I"))
            ways = more
        return ways

    def alive(initials):
        return re.fullmatch("(s?(ua)*u?)?", initials)

    for role, text, fault in turns:
        new = {}
        for (initials, left), (cost, audit) in inserted(ways).items():
            if not alive(initials):
                continue
            put(new, (initials, left), (cost + 2, audit + "D"))
            if fault in "bd":
                continue
            own = cost + (5 if fault == "t" else 0)
            put(new, (initials + role[:1], (*left, (role, text))) if role else (initials + "-", left), (own, audit + "K"))
            for given in ("user", "assistant"):
                put(new, (initials + given[0], (*left, (given, text))), (own + 1, audit + "R"))
        ways = {k: v for k, v in new.items() if alive(k[0])}
        # Ways of one last letter go on alike: the best of each is enough.
        kept = {}
        for (initials, left), value in ways.items():
            state = initials[-1:]
            if state not in kept or value < kept[state][0]:
                kept[state] = (value, initials, left)
        ways = {(i, left): v for v, i, left in kept.values()}
    done = [(cost, audit, left) for (initials, left), (cost, audit) in inserted(ways).items() if GOOD.fullmatch(initials)]
    return min(done)


def judged(rows):
    """(turns with faults, counts) of one conversation's damaged rows, in order."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(BLANK)
        fault = "b" if not bare else "d" if (role, text) in seen else "o" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
        out.append((role, text, fault))
    turns = {r[1] for r in rows} - {None}
    initials = [role[:1] for role, _, _ in out]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    faults = [f for _, _, f in out]
    return out, (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal)


def expected(rows):
    groups = defaultdict(list)
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = []
    for conv in {r[0] for r in rows}:
        turns, counts = judged(groups[conv])
        cost, audit, left = cheapest(turns)
        text = "\n".join(f"{a}:{b}" for a, b in left)
        out.append((conv, *counts, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def told(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def made(rng, convs, most):
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "ue"])
            text = rng.choice(["Yes.", "No!", "Why?", "well", "", " \n", None, "Yes. ", "a long answer, cut", "\U0001f600.", f"text {rng.randrange(99)}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), role, text))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = made(rng, [*range(60), None, 2**60 + 1, 2**60 + 3, -5], 9)
    rows += rows[:9] + [(900, 3, "user", "long text. " * 20_000), (901, 0, None, None)]
    df = spark.createDataFrame(rows, TABLE).repartition(3)
    for c in ("conv", "kind", "part", "seq", "row", "known", "fault", "copy"):
        df = df.withColumn(c, F.lit("x"))
    assert told(repair.repaired_log(df)) == expected(rows)


def test_one_conversation_over_many_blocks(spark):
    """Half of the rows are one conversation; blocks of 7 turns give what one search gives."""
    rng = random.Random(9)
    rows = made(rng, range(40), 9) + [(77, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "cut", "", f"own {t}!"])) for t in range(300)]
    rows += [(77, 5, "user", "same row.")] * 40
    before = repair.SIZE
    try:
        repair.SIZE = 7
        got = told(repair.repaired_log(spark.createDataFrame(rows, TABLE).repartition(4)))
    finally:
        repair.SIZE = before
    assert got == expected(rows)


def test_split_joins_leave_blocks_whole(spark):
    """With joins whose skewed partitions are split wherever Spark may."""
    confs = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    rng = random.Random(15)
    rows = [(3, t, rng.choice(["user", "assistant"]), f"{t} " * 200 + rng.choice([".", ""])) for t in range(1500)] + made(rng, range(100, 300), 9)
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        got = told(repair.repaired_log(spark.createDataFrame(rows, TABLE).repartition(8)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == expected(rows)


def test_search_over_blocks_is_search_over_all():
    rng = random.Random(10)
    for _ in range(300):
        turns = [(rng.choice("suaxu"), rng.choice("ooootbd")) for _ in range(rng.randrange(0, 9))]
        roles = {"s": "system", "u": "user", "a": "assistant", "x": "x"}
        ((cost, audit),) = repair.search(turns).values()
        assert (cost, audit) == cheapest([(roles[r], "t", f) for r, f in turns])[:2]
        left = repair.applied(audit, [(roles[r], "t") for r, _ in turns])
        assert GOOD.fullmatch("".join(r[0] for r, _ in left))


def test_turns_are_what_the_digest_says(spark):
    rows = [r for r in damaged(made(random.Random(3), range(50), 9))]
    df = spark.createDataFrame(rows, TABLE)
    by = defaultdict(list)
    for r in sorted(repair.repaired_turns(df).collect(), key=lambda r: r.place):
        by[r.conv_id].append(f"{r.role}:{r.text}")
    for r in repair.repair(df).collect():
        assert hashlib.sha256("\n".join(by[r.conv_id]).encode()).hexdigest() == r.repaired_sha256


def test_nothing(spark):
    assert told(repair.repaired_log(spark.createDataFrame([], TABLE))) == []


def test_sql_means_the_same(spark):
    assert parity.same(spark, llm.queries()["op13_conversation_repair"], llm.oracle_sql()["op13_conversation_repair"]) > 0
