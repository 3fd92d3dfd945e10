"""The Merkle manifest against brute force: groups and runs of every size, nulls, ties."""

import hashlib
import random
import zlib

import parity
import pytest
from pyspark.sql import functions as F

from scriptorium.functions.urls import LOWER, UPPER
from scriptorium.llm import merkle
from scriptorium.llm import queries as llm

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes):
    """(root, the siblings (left, right) of every node, level by level)"""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for leaf, i in enumerate(at):
            run = runs[i // 16]
            steps[leaf].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        nodes, at = [digest(*run) for run in runs], [i // 16 for i in at]
    return nodes[0], steps


def brute(rows, lowered):
    """Rows of the query from (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r, text: digest(*map(field, (r[0], r[3], r[2], r[4], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, lowered(r)), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    sub = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        sub[s] = climb([x[2] for x in groups[s]])
    root, above = climb([sub[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for x, own in zip(groups[s], sub[s][1]):
            folded = x[3]
            for left, right in own + up:
                folded = digest(left, folded, right)
            out.append((x[4][0], x[2], sub[s][0], root, digest(*[a + b for a, b in own + up]), folded, folded == root))
    return sorted(out, key=repr)


def lowered(r):
    return r[1].translate({c: c + 32 for c in range(65, 91)}) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1]


def told(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def found():
    pick = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return {"text": F.when(pick, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))}


@pytest.fixture(scope="module")
def rows():
    """Groups of 1, 2, 16, 17, 256, 257 and 700 rows, a null one, and names to be ordered."""
    rng, out, at = random.Random(4), [], 2**60
    for name, n in (("one", 1), ("b", 2), ("B", 16), ("é", 17), ("", 256), ("\U0001f600", 257), ("\uffee", 3), ("hot", 700), (None, 5), ("-", 2), ("s", 4)):
        for _ in range(n):
            at += rng.randrange(1, 5)
            out.append((at, rng.choice(["Some Text", "plain", "", None, "L'Été\n", "Long " * 50_000 if at % 97 == 0 else "X"]), rng.choice(["en", None]), name, rng.choice([None, 9, 0])))
    out += [out[5], out[5], (None, "Null", "en", "hot", 4), (None, "Null", "en", "hot", 4), (None, "Else", None, "hot", 4), (None, None, None, None, None)] + [(7, "Same", "en", "hot", 4)] * 40
    rng.shuffle(out)
    return out


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    for c in ("grp", "place", "block", "n", "h", "found", "row", "leaf", "root"):
        docs = docs.withColumn(c, F.lit("x"))
    got, expected = told(merkle.verify(docs, found())), brute(rows, lowered)
    assert got == expected
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_more_groups_than_a_block_holds(spark):
    rows = [(i, f"Text {i}", "en", f"g{i % 300}", 1) for i in range(900)]
    assert told(merkle.verify(spark.createDataFrame(rows, DOCS), found())) == brute(rows, lowered)


def test_proofs_lead_to_the_root(spark, rows):
    for r in merkle.verify(spark.createDataFrame(rows[:400], DOCS), proofs=True).collect():
        folded = r.leaf
        for left, right in r.proof:
            folded = digest(left, folded, right)
        assert folded == r.root == r.folded_root and r.verified
        assert digest(*[left + right for left, right in r.proof]) == r.proof_sha256


def test_one_row_and_none(spark):
    one = [(1, "Only", "en", "s", 4)]
    assert told(merkle.verify(spark.createDataFrame(one, DOCS))) == brute(one, lambda r: r[1])
    assert told(merkle.verify(spark.createDataFrame([], DOCS))) == []


def test_sql_means_the_same(spark):
    assert parity.same(spark, llm.queries()["op11_merkle_manifest"], llm.oracle_sql()["op11_merkle_manifest"]) > 0
