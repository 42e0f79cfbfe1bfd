"""Per-document measures: one aggregate over the sentences, and a second one for the lemmas of final predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.functions import text as T
from proselens.functions import tokens as K


def is_polite(tk: K.Tokens) -> Column:
    """What stands before trailing particles and symbols: a polite request verb, or a run of auxiliaries with です or ます."""
    trailing = lambda t: K.pos(t, "particle", "supplementary_symbol", "symbol")
    def judged(last: Column) -> Column:
        run_start = F.coalesce(F.array_max(tk.where(lambda i: (i <= last) & ~K.pos(tk.at(i), "aux_verb"))), F.lit(-1))
        marks = T.let(run_start, lambda s: F.exists(tk.places(), lambda i: (i > s) & (i <= last) & K.true(tk.at(i)["lemma"].isin("です", "ます"))))
        return K.lemma(tk.at(last), "verb", "くださる", "下さる") | marks

    return K.true(T.let(F.array_max(tk.where(lambda i: ~trailing(tk.at(i)))), judged))


def is_sahen_verb(tk: K.Tokens, i: Column) -> Column:
    return K.sahen(tk.at(i)) & K.lemma(tk.at(i + 1), "verb", "する", "できる")


def final_predicate(tk: K.Tokens) -> Column:
    """The place of the last token that is no auxiliary, particle, symbol or dependent word."""
    skipped = lambda t: K.pos(t, "aux_verb", "particle", "supplementary_symbol", "symbol") | K.true(t["pos2"] == "非自立可能")
    return F.array_max(tk.where(lambda i: ~skipped(tk.at(i))))


def common_phrases(tk: K.Tokens) -> Column:
    """How often the nine phrases of plain explanation occur; a place can count for several."""

    def at(i: Column) -> Column:
        a, b, c = tk.at(i), tk.at(i + 1), tk.at(i + 2)
        third = i + 2 < tk.n
        patterns = [
            K.lemma(a, "adjectival_noun", "よう", "様") & K.true(b["surface"] == "に") & K.lemma(c, "verb", "なる"),
            K.conjunctive(a) & K.true(a["surface"].isin("て", "で")) & K.true(b["lemma"].isin("いく", "行く")) & K.true(b["pos2"] == "非自立可能"),
            third & K.particle(a, "に") & K.true(b["lemma"].isin("つく", "就く")) & K.true(b["surface"].isin("つい", "就い")) & K.true(c["surface"] == "て"),
            K.true(a["lemma"].isin("例えば", "たとえば")),
            K.case_particle(a, "と") & K.true(b["lemma"] == "呼ぶ"),
            K.lemma(a, "conjunction", "しかし"),
            K.lemma(a, "adverb", "よく", "良く"),
            K.lemma(a, "adjective", "難しい", "むずかしい") | K.lemma(a, "adjectival_noun", "簡単", "かんたん"),
            K.lemma(a, "noun", "際"),
        ]
        total = patterns[0].cast("int")
        for p in patterns[1:]:
            total = total + p.cast("int")
        return total

    return F.aggregate(F.transform(tk.places(), at), F.lit(0), lambda a, x: a + x)


#: Columns of a sentence analysis.
ANALYSED = ("ja", "ended", "polite", "plain", "nouns", "wago_nouns", "wago_verbs", "sahen_verbs", "ga", "final_wago", "final_sahen", "final_lemma", "phrases")


def sentence_analysis(sentences: DataFrame, *keep: str, also: dict[str, Column] | None = None) -> DataFrame:
    """What a sentence's text and tokens say, wherever it stands: ANALYSED, the columns of `keep`, and what `also` makes of its own columns."""
    also = also or {}
    first, last = T.kept("analysis", None, _analysis)
    return sentences.select(*keep, "text", "tokens", *first, *(c.alias(k) for k, c in also.items())).select(*keep, *last, *also)


def _analysis() -> tuple[list[Column], list[Column]]:
    """What is computed first, and from it ANALYSED."""
    tk, text = K.Tokens(F.col("tokens")), F.col("text")
    first = [T.is_terminated(text).alias("_ended"), is_polite(tk).alias("_polite"), final_predicate(tk).alias("_final"), T.ja_chars(text).alias("_ja")]
    ended, polite, final = F.col("_ended"), F.col("_polite"), F.col("_final")
    wago_verb = lambda t: K.pos(t, "verb") & K.true(t["pos2"] == "一般") & K.true(t["goshu"] == "wago")
    noun = lambda t: K.pos(t, "noun") & K.true(t["pos2"] == "普通名詞")
    final_wago = ended & K.pos(tk.at(final), "verb") & K.true(tk.at(final)["goshu"] == "wago")
    final_sahen = ended & ~K.pos(tk.at(final), "verb") & is_sahen_verb(tk, final)
    return first, [
        F.col("_ja").alias("ja"),
        ended.cast("int").alias("ended"),
        (ended & polite).cast("int").alias("polite"),
        (ended & ~polite & tk.any(K.predicate)).cast("int").alias("plain"),
        tk.count(noun).alias("nouns"),
        tk.count(lambda t: noun(t) & K.true(t["goshu"] == "wago")).alias("wago_nouns"),
        tk.count(wago_verb).alias("wago_verbs"),
        F.size(tk.where(lambda i: ~wago_verb(tk.at(i)) & is_sahen_verb(tk, i))).alias("sahen_verbs"),
        tk.count(lambda t: K.case_particle(t, "が")).alias("ga"),
        final_wago.cast("int").alias("final_wago"),
        F.coalesce(final_sahen, F.lit(False)).cast("int").alias("final_sahen"),
        F.when(final_wago, tk.at(final)["lemma"]).alias("final_lemma"),
        common_phrases(tk).alias("phrases"),
    ]


def placed(rows: DataFrame) -> DataFrame:
    """Analysed sentences with what their kind and place add: characters, phrases and number of a prose sentence."""
    prose = F.col("kind").isin("prose", "table_cell")
    return rows.withColumns({"prose_chars": F.when(prose, F.col("ja")).otherwise(0), "common_phrases": F.when(prose, F.col("phrases")).otherwise(0), "prose_sent": F.when(prose, F.col("sent_id"))})


def sentence_facts(sentences: DataFrame) -> DataFrame:
    """What each sentence adds to its document's measures, as plain columns."""
    return placed(sentence_analysis(sentences, "doc_id", "sent_id", "kind"))


def document_measures(facts: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """A row a document: counts, and the six ratios, null where nothing is counted; and the sums of `also`."""
    sums = ["ended", "polite", "plain", "nouns", "wago_nouns", "wago_verbs", "sahen_verbs", "ga", "final_wago", "final_sahen", "prose_chars", "common_phrases", *also]
    totals = facts.groupBy("doc_id").agg(
        F.sum("ja").alias("ja_chars"),
        F.count(F.lit(1)).alias("sentences"),
        F.min("sent_id").alias("first_sentence"),
        F.min("prose_sent").alias("first_prose"),
        *(F.sum(c).alias(c) for c in sums),
    )
    ratio = lambda a, b: F.try_divide(a.cast("double"), b)
    c = F.col
    return totals.withColumns(
        {
            "polite_ratio": ratio(c("polite"), c("ended")),
            "plain_ratio": ratio(c("plain"), c("ended")),
            "wago_noun_ratio": ratio(c("wago_nouns"), c("nouns")),
            "wago_verb_ratio": ratio(c("wago_verbs"), c("wago_verbs") + c("sahen_verbs")),
            "final_wago_ratio": ratio(c("final_wago"), c("final_wago") + c("final_sahen")),
            "ga_per_sentence": ratio(c("ga"), c("sentences")),
        }
    )


def final_words(facts: DataFrame) -> DataFrame:
    """doc_id, lemma, n of final predicates of native origin."""
    return facts.filter("final_lemma is not null").groupBy("doc_id", F.col("final_lemma").alias("lemma")).agg(F.count(F.lit(1)).alias("n"))
