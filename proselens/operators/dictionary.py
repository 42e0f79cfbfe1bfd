"""Tokens by a dictionary folder: the cheapest path through the lattice of its words.

A folder holds `columns.txt` (a feature's name a line), `*.csv` (surface, left id, right id, cost, features) and `matrix.def`
(sizes, then right id, left id, cost). It is sent to every worker as files and loaded there once; what is pickled is its name.
What no word covers becomes runs of one script at UNKNOWN_COST.
"""

from __future__ import annotations

import csv
import glob
import os

from proselens.operators.lexicon import UNKNOWN, from_dictionary, join_letters

# The features that tokens are made of: lemma (the basic written form), parts of speech, conjugation, origin.
COLUMNS = ("orthBase", "pos1", "pos2", "pos3", "cType", "cForm", "goshu")
UNKNOWN_COST = 10_000
_LOADED: dict[str, tuple] = {}


class MissingColumn(ValueError):
    pass


def load(folder: str) -> tuple[dict, dict, int]:
    """Words by surface as (left, right, cost, labels), connection costs, and the longest surface."""
    with open(os.path.join(folder, "columns.txt"), encoding="utf-8") as f:
        names = f.read().split()
    for c in COLUMNS:
        if c not in names:
            raise MissingColumn(f"{folder}: the dictionary has no column {c}")
    at = [4 + names.index(c) for c in COLUMNS]
    words: dict[str, list[tuple]] = {}
    for path in sorted(glob.glob(os.path.join(folder, "*.csv"))):
        with open(path, encoding="utf-8", newline="") as f:
            for row in csv.reader(f):
                words.setdefault(row[0], []).append((int(row[1]), int(row[2]), int(row[3]), tuple(row[k] if k < len(row) else None for k in at)))
    matrix: dict[tuple[int, int], int] = {}
    with open(os.path.join(folder, "matrix.def"), encoding="utf-8") as f:
        next(f)
        for line in f:
            if line.strip():
                right, left, cost = map(int, line.split())
                matrix[right, left] = cost
    return words, matrix, max(map(len, words), default=1)


def segment(text: str, words: dict, matrix: dict, longest: int) -> list[tuple[int, int, tuple | None]]:
    """(begin, end, labels) of the cheapest path; None for what the dictionary does not know. Of paths that cost the same, the first found."""
    best: list[dict[int, tuple]] = [{} for _ in range(len(text) + 1)]  # by right id: cost, where from, its right id, labels
    best[0][0] = (0, -1, 0, None)
    for a in range(len(text)):
        if not best[a]:
            continue
        if text[a].isspace():
            for right, x in best[a].items():
                if right not in best[a + 1] or x[0] < best[a + 1][right][0]:
                    best[a + 1][right] = (x[0], a, right, "space")
            continue
        found = [(a + n, *w) for n in range(1, min(longest, len(text) - a) + 1) for w in words.get(text[a : a + n], ())]
        found.append((UNKNOWN.match(text, a).end(), 0, 0, UNKNOWN_COST, None))
        for b, left, right, cost, labels in found:
            for before, x in best[a].items():
                total = x[0] + matrix.get((before, left), 0) + cost
                if right not in best[b] or total < best[b][right][0]:
                    best[b][right] = (total, a, before, labels)
    at, out = len(text), []
    right = min(best[at], key=lambda r: (best[at][r][0] + matrix.get((r, 0), 0), r))
    while at:
        _, a, before, labels = best[at][right]
        if labels != "space":
            out.append((a, at, labels))
        at, right = a, before
    return out[::-1]


class Dictionary:
    """A token backend over a folder; `shipped` ones are found among the files that Spark has sent."""

    def __init__(self, folder: str, shipped: bool = False):
        self.folder, self.is_shipped = folder, shipped
        if not shipped:
            self._tables()  # a bad dictionary is an error here and not in a task

    @classmethod
    def shipped(cls, spark, folder: str) -> Dictionary:
        cls(folder)
        spark.sparkContext.addFile(os.path.abspath(folder), recursive=True)
        return cls(os.path.basename(os.path.abspath(folder)), True)

    def _tables(self) -> tuple:
        key = f"{self.is_shipped}:{self.folder}"
        if key not in _LOADED:
            if self.is_shipped:
                from pyspark import SparkFiles

                _LOADED[key] = load(SparkFiles.get(self.folder))
            else:
                _LOADED[key] = load(self.folder)
        return _LOADED[key]

    def __call__(self, text: str) -> list[dict]:
        out = []
        for b, e, labels in segment(text, *self._tables()):
            run = text[b:e]
            if labels is None:
                letters = run.isascii() and run.isalpha()
                labels = (None, "記号", "文字", None, None, None, "記号") if letters else (None, "名詞", "普通名詞", "一般", None, None, None)
            out.append(from_dictionary(run, labels, b))
        return join_letters(out)
