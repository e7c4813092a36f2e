"""Conversation repair against a search of all edits: faults, ties, nulls, repeats, segments of any size."""

import random

import pytest

from tallymark.llm import conversation, queries

from . import brute

ROWS = "conv_id long, turn long, role string, text string, conv string, pos int, seg string, cost string, sig string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", "s") for r in rows], ROWS)


def corpus(n, seed, length=9):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(0, length)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "User"]) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!\n ", "Why?", "cut", "cut", "", " \t", None, "é…", "a.b", "long. " * 500]) if rng.random() < 0.7 else f"Said {rng.random()}?"
            rows.append((conv, rng.choice([turn, turn, 2 * turn, None]), role, text))
    return rows


def plain(rows):
    return {conv: brute.mend(kept) for conv, kept in brute.damage(rows).items()}


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("segment", [4096, 3, 1])
def test_against_a_search(spark, segment):
    rows = corpus(150, 5)
    rows += [(None, None, None, None), (None, 3, "user", "Yes."), (-7, -5, "system", "S."), (-7, 9, "user", "U."), *[(900, 1, "user", "Same.")] * 3, (901, 1, "assistant", "Only."), (902, 1, "system", "Only.")]
    assert found(conversation.damage_and_repair(frame(spark, rows), segment)) == plain(rows)


def test_empty_table(spark):
    assert conversation.damage_and_repair(frame(spark, [(1, 1, "user", "x")]).where("turn > 1")).count() == 0


def test_long_conversation(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice([f"{t}.", f"{t}", "", "again."])) for t in range(400)] + [(2, 2**63 - 1, "user", "a."), (2, -(2**63), "assistant", "b.")]
    got = found(conversation.damage_and_repair(frame(spark, rows), 64))
    assert got[1] == plain(rows[:400])[1] and got[2][0] in (0, 2**63 - 1)


def test_query(spark, tmp_path):
    rows = corpus(40, 11)
    frame(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert found(got) == plain(rows)


def test_suffixes_are_shared():
    nodes = conversation.Suffixes()
    nodes.solve(conversation.FINAL, "uua")
    shared = list(nodes.nodes)
    assert nodes.solve(conversation.FINAL, "sua") == ([0, 4, 3, 4], [3, 3, 3, 3], ["KKK", "DKK", "RKK", "DKK"])
    assert all(a is b for a, b in zip(nodes.nodes[:3], shared[:3], strict=True)) and nodes.nodes[3] is not shared[3]
