"""Findings of a stream of documents.

Sentence rules are array expressions over one row, so they run on a stream as they are. What needs a whole
document (the polite gate of R01 and the document rules) is left to batches: windows over a stream's rows would need state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.operators.lexicon import with_tokens
from proselens.operators.rules import sentence_findings
from proselens.operators.split import split_sentences
from proselens.rulesdata import SENTENCE_RULES


def stream_findings(documents: DataFrame, rules: tuple[str, ...] = tuple(r for r in SENTENCE_RULES if r != "R01")) -> DataFrame:
    """documents (doc_id, text), streaming or not, to doc_id, sent_id (in its document), rule, span_ord, excerpt."""
    segments = documents.select("doc_id", F.lit(0).alias("seg_id"), F.lit("prose").alias("kind"), "text")
    sentences = with_tokens(split_sentences(segments)).withColumnRenamed("in_seg", "sent_id")
    return sentence_findings(sentences, rules=rules)
