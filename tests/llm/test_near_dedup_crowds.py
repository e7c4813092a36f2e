"""Crowded buckets: a large group of near copies of one text, of which few are linked, is whole and takes rows by its size."""

import random

import pytest

from tallymark.llm import near_dedup

from . import brute
from .test_operators import frame


def crowd(n: int, seed: int = 5, changes: tuple[int, int] = (0, 9), base: list[str] | None = None, first: int = 0) -> list[tuple[int, str]]:
    """Copies of a text of 120 words with words replaced, dropped and put in; every fifth one is a copy of an earlier copy."""
    rng = random.Random(seed)
    base = base or [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = list(rows[rng.randrange(i)][1].split()) if i % 5 == 4 else list(base)
        for _ in range(rng.randint(*changes)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[f"x{rng.randrange(40)}"], [], [words[at], f"y{rng.randrange(10**6)}"]])
        rows.append((first + i, " ".join(words)))
    return rows


def counted(monkeypatch, spark, rows, **settings) -> tuple[dict, int]:
    """Results, and the rows that the second round's first pass made."""
    made = []
    write = near_dedup.materialize

    def materialize(df, name):
        out = write(df, name)
        made.append(out.count() if name == "involved" else 0)
        return out

    with monkeypatch.context() as m:
        m.setattr(near_dedup, "materialize", materialize)
        for name, value in settings.items():
            m.setattr(near_dedup, name, value)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(frame(spark, rows)).collect()}
    return got, sum(made)


@pytest.mark.parametrize("changes", [(0, 9), (3, 6), (0, 2)])
def test_crowds_lose_no_link(spark, monkeypatch, changes):
    """Also where the centre is no better than others, and where two crowds share keys."""
    rows = crowd(160, 7, changes)
    other = [w if i % 40 else f"o{i}" for i, w in enumerate(f"w{i}" for i in range(120))]
    rows += crowd(60, 8, changes, other, 1000)
    got, _ = counted(monkeypatch, spark, rows, BLOCK=16)
    assert got == brute.components(rows)


def test_rows_grow_with_the_crowd(spark, monkeypatch):
    """Many copies of one text, hardly any linked: a member has rows by its own differences, not by the others' number."""
    rows = crowd(600, 11, (6, 9))
    got, made = counted(monkeypatch, spark, rows, BLOCK=16)
    assert got == brute.components(rows)
    assert made < 50 * len(rows), made
