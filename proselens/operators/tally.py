"""Measures and the number of findings of every rule, a row a document, from one pass over the sentences.

One projection computes each sentence's facts and counts; no excerpt is built. The rows meet by document once: the runs of
S06 and D01 are told by the flags of the sentences just before, in the window that the sums then use too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselens.functions import text as T
from proselens.functions import tokens as K
from proselens.operators import measures as M
from proselens.operators import rules as R
from proselens.rulesdata import DOCUMENT_RULES, FLOOR, GATED_LAYERS, LISTS, RULE_ORDER, SENTENCE_RULES

COUNTS = tuple(f"n_{r}" for r in RULE_ORDER)


def _count(made: Column) -> Column:
    return T.let(made, lambda m: F.when(F.size(m) <= 1, F.size(m)).otherwise(F.size(T.disjoint(m))))


def analysed(sentences: DataFrame, *keep: str, lists: R.Lists = LISTS) -> DataFrame:
    """A sentence's analysis with the counts of the sentence rules and the flags of runs; it depends on text, seg_text and tokens alone, so
    that a table of different sentences can be analysed once and joined to the places where they stand."""
    def made() -> dict[str, Column]:
        text, tk = F.col("text"), K.Tokens(F.col("tokens"))
        counted = {f"n_{r}": _count(R.RULES[r](text, tk, lists, F.col("seg_text")) if r == "F02" else R.RULES[r](text, tk, lists)) for r in SENTENCE_RULES}
        heads = R.conjunction(text, tk, lists["S06"]["conjunctions"]).isNotNull()
        short = T.is_terminated(text) & (T.ja_chars(text) <= R.SHORT)
        return counted | {"_S06": K.true(heads), "_D01": K.true(short)}

    return M.sentence_analysis(sentences, *keep, also=T.kept("counts", lists, made))


def tallies(sentences: DataFrame, lists: R.Lists = LISTS, floor: int = FLOOR) -> DataFrame:
    """document_measures' row of each document with n_<rule> of the twenty rules, gated as findings are."""
    return tallied(analysed(sentences, "doc_id", "sent_id", "seg_id", "kind", "newline_before", lists=lists), floor)


def tallied(rows: DataFrame, floor: int = FLOOR) -> DataFrame:
    """tallies of analysed sentences in their places: doc_id, sent_id, seg_id, kind, newline_before."""
    facts = M.placed(rows)
    before = Window.partitionBy("doc_id").orderBy("sent_id")
    own = K.true((F.lag("seg_id").over(before) == F.col("seg_id")) & ~F.col("newline_before"))
    rows = facts.withColumns({f"_on_{r}": F.col(f"_{r}") & K.true(F.lag(f"_{r}").over(before)) & own for r in ("S06", "D01")})
    third = lambda r: F.col(f"_on_{r}") & K.true(F.lag(f"_on_{r}").over(before)) & ~K.true(F.lag(f"_on_{r}", 2).over(before))  # noqa: E731  a run counts at its third sentence
    rows = rows.withColumns({f"n_{r}": third(r).cast("int") for r in ("S06", "D01")})
    made = M.document_measures(rows, (*(f"n_{r}" for r in SENTENCE_RULES), "n_S06", "n_D01"))
    made = made.withColumns({f"n_{r}": K.true(ok).cast("long") for r, ok in (("D03", R._lacks_phrases()[0]), ("R03", R._mixes()[0]), ("G01", R._ends_native()))})
    low = (F.col("ja_chars") == 0) | (F.col("ja_chars") < floor)
    gates = {f"n_{r}": F.when(low, F.lit(0)).otherwise(F.col(f"n_{r}")).cast("long") for r in DOCUMENT_RULES if r[0] in GATED_LAYERS}
    return made.withColumns(gates | {"n_R01": F.when(K.true(F.col("polite_ratio") >= 0.5), F.col("n_R01")).otherwise(F.lit(0)).cast("long")})


def added(rows: DataFrame, *key: str) -> DataFrame:
    """Tallies of documents (with key) to ja_chars, sentences and counts of each key."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ja_chars", "sentences", *COUNTS)]
    return rows.groupBy(*key).agg(*sums) if key else rows.agg(*sums)
