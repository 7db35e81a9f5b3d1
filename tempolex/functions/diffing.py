"""Word-level difference of two versions, with bounded precise work.

Sentences that both texts share anchor the comparison; only the stretches between them are compared word by word,
from a common budget. A stretch the budget does not cover is compared coarsely, without its frequent words as
anchors, and each of its rows is marked approximate. The whole texts are compared and every change is given in full;
bounds on what is shown belong to a report of these rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Comparisons of one difference, words of an unchanged run that anchors.
WORK, ANCHOR = 250_000, 4

_END = regex.compile(r"(?<=[.;:])\s+")


def _stretches(before: list[str], after: list[str]) -> Iterator[tuple[list[str], list[str]]]:
    """Pairs of word lists between the sentences both texts share in order."""
    a, b = ([s for s in _END.split(" ".join(t)) if s] for t in (before, after))
    left = right = 0
    # sentences that repeat throughout a long text anchor nothing: comparing all their places is far worse than quadratic
    for i, j, n in SequenceMatcher(None, a, b, autojunk=len(a) * len(b) > WORK).get_matching_blocks():
        if n and sum(len(s.split()) for s in a[i : i + n]) < ANCHOR:
            continue
        x, y = (list(chain.from_iterable(s.split() for s in t)) for t in (a[left:i], b[right:j]))
        if x or y:
            yield x, y
        left, right = i + n, j + n


def word_diff(before: str | None, after: str | None) -> list[tuple[str, str, str]]:
    """(change, before, after) rows; change is added, removed, replaced or approximate. Equal texts give none."""
    a, b = (before or "").split(), (after or "").split()
    out: list[tuple[str, str, str]] = []
    budget = WORK
    for x, y in _stretches(a, b) if a != b else ():
        head = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        x, y = x[head:], y[head:]
        tail = next((k for k, (p, q) in enumerate(zip(reversed(x), reversed(y))) if p != q), min(len(x), len(y)))
        x, y = x[: len(x) - tail], y[: len(y) - tail]
        coarse = len(x) * len(y) > budget
        if not coarse:
            budget -= len(x) * len(y)
        for kind, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=coarse).get_opcodes():
            if kind != "equal":
                change = "approximate" if coarse else {"insert": "added", "delete": "removed", "replace": "replaced"}[kind]
                out.append((change, " ".join(x[i1:i2]), " ".join(y[j1:j2])))
    return out


def diff_rows(pairs: DataFrame, pair_id: str, before: str, after: str) -> DataFrame:
    """(pair_id, seq, change, before, after) of every pair of texts; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, olds, news = (c.to_pylist() for c in batch.columns)
            rows = [(i, n, *r) for i, x, y in zip(ids, olds, news) for n, r in enumerate(word_diff(x, y), 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=[pair_id, "seq", "change", "before", "after"])

    return pairs.selectExpr(f"cast(`{pair_id}` as bigint) `{pair_id}`", f"`{before}`", f"`{after}`").mapInArrow(run, f"{pair_id} bigint, seq int, change string, before string, after string")
