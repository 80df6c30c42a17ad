"""Operator 11: tries and automata against comparison of all pairs."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.llm import spelling
from wordloom.llm.spelling import code_points, neighbours, packed, spelling_variants, unpacked


def near(a: str, b: str) -> bool:
    """Whether exactly one insertion, deletion or replacement parts two words."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def met(words: list[str], queries: list[str], block: int = 1 << 18) -> set[tuple[str, str]]:
    trie = unpacked(packed(pa.array(words, pa.string()), np.arange(len(words))))
    a, b = neighbours(trie, *code_points(pa.array(queries, pa.string())), block=block)
    pairs = list(zip([queries[i] for i in a], [words[i] for i in b], strict=True))
    assert len(set(pairs)) == len(pairs)  # none twice
    return set(pairs)


@settings(deadline=None, max_examples=150)
@given(st.sets(st.text("abé", max_size=6), max_size=30), st.sets(st.text("abé", max_size=6), max_size=10), st.sampled_from([1, 3, 1 << 18]))
def test_neighbours_are_those_of_all_pairs(words, queries, block):
    words, queries = sorted(words), sorted(queries)
    assert met(words, queries, block) == {(q, w) for q in queries for w in words if near(q, w)}


def test_long_words():
    long = "ab" * 2000
    assert met(sorted([long, long[:-1], "b" + long[1:], "x"]), [long]) == {(long, long[:-1]), (long, "b" + long[1:])}


def expected(rows: list[tuple]) -> dict[str, tuple]:
    n: Counter = Counter()
    for id_, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 7:
                    n[run] += 1
            run = ""
    n = Counter({w: k for w, k in n.items() if k >= 2})
    partners: dict[str, list[str]] = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if near(a, b):
            partners[a].append(b)
            partners[b].append(a)
    form = {}
    for w, others in partners.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w: str) -> str:
        return w if form[w] is None else root(form[w])

    return {w: (n[w], len(partners[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


ROWS = [
    (1, "separate " * 900 + "Separate seperate seperate " + "sepErate " * 60),
    (2, "seperat seperat, seperate; sepérate sepérate"),
    (3, None), (4, ""), (None, "separate separatee separatee"), (2, "seperat seperat, seperate; sepérate sepérate"),
    (7, "größeren größeren größerer größerer ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ àéîõüßÿ"), (8, "İstanbul İstanbul dog dog " + "x" * 9000 + " " + "x" * 9000),
    (9, " ".join(f"begin{c}ing" for c in "nnnnnnnnnnnnnnnnnnnnnnnmm")),
]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def result(df) -> dict[str, tuple]:
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 2, "wave_bytes": 1, "batch": 2}, {"shard_bytes": 600, "wave_bytes": 2000}])
def test_variants_as_by_all_pairs(spark, sizes):
    found = result(spelling_variants(table(spark, ROWS).withColumnRenamed("doc_id", "word").withColumnRenamed("text", "form"), "word", "form", **sizes))
    assert found == expected(ROWS)
    assert found["seperat"][2] == "seperate" and found["seperat"][4] == "separate"  # a chain of two


def test_blocks_of_counts_change_nothing(spark):
    df = table(spark, ROWS)
    assert sorted(spelling.word_counts(df, held=1).collect()) == sorted(spelling.word_counts(df).collect())


def test_empty_table(spark):
    assert result(spelling_variants(table(spark, []))) == {}
    assert result(spelling_variants(table(spark, [(1, "short words only")]))) == {}
