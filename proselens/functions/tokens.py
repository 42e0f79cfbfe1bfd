"""Predicates over one token column, and access to a sentence's tokens by place."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "struct<surface:string,lemma:string,pos1:string,pos2:string,pos3:string,ctype:string,cform:string,goshu:string,b:int,e:int>"
TOKENS = f"array<{TOKEN}>"


def true(c: Column) -> Column:
    """A missing token satisfies nothing."""
    return F.coalesce(c, F.lit(False))


def among(c: Column, words: Iterable[str]) -> Column:
    words = list(words)
    return c.isin(*words) if words else F.lit(False)


def pos(t: Column, *kinds: str) -> Column:
    return true(t["pos1"].isin(*kinds))


def lemma(t: Column, kind: str, *lemmas: str) -> Column:
    return pos(t, kind) & true(t["lemma"].isin(*lemmas))


def particle(t: Column, surface: str) -> Column:
    return pos(t, "particle") & true(t["surface"] == surface)


def case_particle(t: Column, surface: str) -> Column:
    return particle(t, surface) & true(t["pos2"] == "格助詞")


def conjunctive(t: Column) -> Column:
    return pos(t, "particle") & true(t["pos2"] == "接続助詞")


def comma(t: Column) -> Column:
    return true(t["pos2"] == "読点")


def sahen(t: Column) -> Column:
    return true(t["pos3"] == "サ変可能")


def predicate(t: Column) -> Column:
    return pos(t, "verb", "adjective", "adjectival_noun") | lemma(t, "aux_verb", "だ", "です")


class Tokens:
    """A token array: at(i) is null beyond its ends."""

    def __init__(self, column: Column):
        self.column = column
        self.n = F.size(column)

    def at(self, i) -> Column:
        return F.get(self.column, F.lit(i) if isinstance(i, int) else i)

    def places(self) -> Column:
        return F.when(self.n > 0, F.sequence(F.lit(0), self.n - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def where(self, test: Callable[[Column], Column]) -> Column:
        """Places at which the test of the place holds."""
        return F.filter(self.places(), test)

    def between(self, first: Column, last: Column) -> Column:
        """Places from first to last, both within the array."""
        last = F.least(last, self.n - 1)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<int>)"))

    def any(self, test: Callable[[Column], Column]) -> Column:
        return F.exists(self.column, test)

    def count(self, test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(self.column, test))
