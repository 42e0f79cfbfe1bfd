"""The sentence rules as array expressions over a row per sentence, the document rules as aggregates and windows.

A sentence row has doc_id, sent_id, seg_id, kind, seg_text, text, newline_before and tokens. Its findings
come from one narrow projection; nothing moves before findings exist. Document-wide conditions (polite texts, the
floor) are joined to the findings, which are few, and not to the sentences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselens.functions import text as T
from proselens.functions import tokens as K
from proselens.operators.split import bold_spans
from proselens.rulesdata import DOCUMENT_RULES, GATED_LAYERS, HINTS, LAYERS, LISTS, RULE_ORDER, SENTENCE_RULES

GAP = 6
SHORT, FRAGMENT, RUN = 15, 7, 3
AROUND = 10
PHRASE_RATE, PHRASE_CHARS = 1.00, 1000
MIXED = 0.2
FINAL_RATIO, FINAL_LEAST, FINAL_WORDS = 0.70, 10, 10

Lists = dict[str, dict[str, list[str]]]


def _suru(t: Column) -> Column:
    return K.lemma(t, "verb", "する")


def inanimate_speaker(text: Column, tk: K.Tokens, lists: Lists) -> Column:
    """S01: a subject that names no person, and a speech verb within reach that is neither passive nor a quotation."""
    words = lists["S01"]
    part = lambda t: K.pos(t, "noun", "prefix", "suffix")
    person = lambda t: (K.pos(t, "noun") & K.true(t["pos3"] == "人名")) | K.true(K.among(t["lemma"], words["person"]))
    named = lambda t: K.pos(t, "noun") & K.true(t["pos2"].isin("普通名詞", "固有名詞"))
    verb_end = lambda j: F.when(_suru(tk.at(j + 1)), j + 1).otherwise(j)

    def speaks(j: Column) -> Column:
        t, after = tk.at(j), tk.at(verb_end(j) + 1)
        kind = K.pos(t, "verb") | (K.pos(t, "noun") & K.sahen(t) & _suru(tk.at(j + 1)))
        return K.true(K.among(t["lemma"], words["speech"])) & kind & ~K.lemma(after, "aux_verb", "れる", "られる") & ~K.case_particle(after, "と")

    def found(i: Column) -> Column:
        start = F.coalesce(F.array_max(F.filter(tk.places(), lambda j: (j < i) & ~part(tk.at(j)))), F.lit(-1)) + 1
        reach = tk.between(i + 1, i + 1 + GAP)
        stop = F.array_min(F.filter(reach, lambda j: K.comma(tk.at(j))))
        bound = F.struct(start.alias("start"), stop.alias("stop"), F.array_min(F.filter(reach, speaks)).alias("verb"))

        def judged(x: Column) -> Column:
            subject = F.slice(tk.column, x["start"] + 1, F.greatest(i - x["start"], F.lit(0)))
            ok = T.let(subject, lambda ts: F.exists(ts, named) & ~F.exists(ts, person)) & (x["stop"].isNull() | (x["verb"] < x["stop"]))
            return F.when(K.true(ok), T.span(tk.at(x["start"])["b"], tk.at(verb_end(x["verb"]))["e"]))

        return T.let(bound, lambda x: F.when(x["verb"].isNotNull(), judged(x)))

    spans = F.filter(F.transform(tk.where(lambda i: K.case_particle(tk.at(i), "が")), found), lambda x: x.isNotNull())
    return F.when(tk.any(lambda t: K.true(K.among(t["lemma"], words["speech"]))), spans).otherwise(T.no_spans())


def leading_demonstrative(text: Column, tk: K.Tokens, lists: Lists) -> Column:
    """S02"""
    after = F.when(K.lemma(tk.at(1), "suffix", "ら"), tk.at(2)).otherwise(tk.at(1))
    ok = K.lemma(tk.at(0), "pronoun", "これ", "それ") & (K.particle(after, "は") | K.particle(after, "も"))
    return F.when(ok, F.array(T.span(tk.at(0)["b"], after["e"]))).otherwise(T.no_spans())


def phrases(rule: str, group: str) -> Callable:
    return lambda text, tk, lists: T.any_occurrence(text, lists[rule][group])


def first_person(text: Column, tk: K.Tokens, lists: Lists) -> Column:
    """S04"""
    goes_on = lambda t: (K.pos(t, "particle") & K.true(t["surface"].isin("は", "が", "の", "も"))) | (K.pos(t, "noun", "suffix") & K.true(t["lemma"] == "自身"))
    at = tk.where(lambda i: K.lemma(tk.at(i), "pronoun", "私", "わたし") & goes_on(tk.at(i + 1)))
    return F.transform(at, lambda i: T.span(tk.at(i)["b"], tk.at(i + 1)["e"]))


def negative_contrast(text: Column, tk: K.Tokens, lists: Lists) -> Column:
    """S05"""
    nominal = lambda t: K.pos(t, "noun", "pronoun", "suffix") | (K.pos(t, "supplementary_symbol") & K.true(t["pos2"] == "括弧閉"))

    def denies(i: Column) -> Column:
        t = tk.at(i)
        de = (K.lemma(t, "aux_verb", "だ") & K.true(t["surface"] == "で")) | (K.case_particle(t, "で") & nominal(tk.at(i - 1)))
        return de & K.particle(tk.at(i + 1), "は") & K.lemma(tk.at(i + 2), "adjective", "ない", "無い") & K.true(tk.at(i + 2)["cform"] == "連用形-一般")

    contrast = F.transform(tk.where(denies), lambda i: T.span(tk.at(i)["b"], tk.at(i + 2)["e"]))
    return F.concat(T.any_occurrence(text, ["だけでなく", "だけではなく", "のみならず"]), contrast)


def nativized_term(text: Column, tk: K.Tokens, lists: Lists) -> Column:
    """L01"""
    words = lists["L01"]
    hit = F.filter(tk.column, lambda t: (K.pos(t, "verb") & K.true(K.among(t["lemma"], words["verbs"]))) | (K.pos(t, "noun") & K.true(K.among(t["lemma"], words["nouns"]))))
    spans = F.transform(hit, lambda t: T.span(t["b"], t["e"]))
    return F.concat(T.any_occurrence(text, words["phrases"]), T.outside(spans, T.any_occurrence(text, words["idioms"])))


def literal_translation(text: Column, tk: K.Tokens, lists: Lists) -> Column:
    """L02"""
    words = lists["L02"]
    term = tk.where(lambda i: K.pos(tk.at(i), "noun") & K.true(K.among(tk.at(i)["lemma"], words["terms"])) & ~_suru(tk.at(i + 1)))
    terms = F.transform(term, lambda i: T.span(tk.at(i)["b"], tk.at(i)["e"]))

    def possessed(i: Column) -> Column:
        """Of a count at i, the span up to the machine that has it."""
        reach = tk.between(i + 3, i + 3 + GAP)
        stop = F.array_min(F.filter(reach, lambda j: K.comma(tk.at(j)) | K.case_particle(tk.at(j), "を")))
        ok = lambda j: K.case_particle(tk.at(j), "を") & K.lemma(tk.at(j + 1), "verb", "持つ") & K.true(K.among(tk.at(j + 2)["lemma"], words["machines"]))
        return T.let(stop, lambda j: F.when(ok(j), T.span(tk.at(i)["b"], tk.at(j + 2)["e"])))

    counts = lambda t: (K.pos(t, "noun") & K.true(t["pos2"] == "数詞")) | K.true(t["lemma"] == "複数")
    counted = tk.where(lambda i: counts(tk.at(i)) & K.true(tk.at(i + 1)["surface"].isin("つ", "個")) & K.case_particle(tk.at(i + 2), "の"))
    machines = F.filter(F.transform(counted, possessed), lambda x: x.isNotNull())
    return F.concat(T.any_occurrence(text, words["phrases"]), machines, T.outside(terms, T.any_occurrence(text, words["compounds"])))


def english_rhythm(text: Column, tk: K.Tokens, lists: Lists) -> Column:
    """L03"""

    def last(i: Column) -> Column:
        begins = F.when(K.conjunctive(tk.at(i + 1)), i + 2).otherwise(i + 1)
        moment = K.lemma(tk.at(i + 1), "aux_verb", "た") & K.lemma(tk.at(i + 2), "noun", "瞬間")
        return F.when(K.lemma(tk.at(begins), "verb", "始める"), begins).when(moment, i + 2)

    made = F.transform(tk.where(lambda i: K.pos(tk.at(i), "verb")), lambda i: T.let(last(i), lambda j: F.when(j.isNotNull(), T.span(tk.at(i)["b"], tk.at(j)["e"]))))
    return F.filter(made, lambda x: x.isNotNull())


def fragment(text: Column, tk: K.Tokens, lists: Lists) -> Column:
    """D02"""
    ok = T.is_terminated(text) & (T.ja_chars(text) <= FRAGMENT) & ~tk.any(K.predicate)
    return F.when(ok, F.array(T.span(F.lit(0), F.char_length(text)))).otherwise(T.no_spans())


def _inner(text: Column, x: Column) -> Column:
    return F.substring(text, x["s"] + 3, x["e"] - x["s"] - 4)


def bold_conclusion(text: Column, tk: K.Tokens, lists: Lists) -> Column:
    """F01"""

    def judged(x: Column) -> Column:
        inside = F.filter(tk.column, lambda t: t["e"] <= x["e"] - 2)
        ends = (F.right(_inner(text, x), F.lit(1)) == "。") | K.pos(F.try_element_at(inside, F.lit(-1)), "aux_verb")
        ok = (x["s"] == 0) & F.char_length(_inner(text, x)).between(2, 30) & ends
        return F.when(K.true(ok), F.array(T.span(x["s"], x["e"]))).otherwise(T.no_spans())

    first = F.get(bold_spans(text), F.lit(0))
    return F.when(F.startswith(text, F.lit("**")), T.let(first, judged)).otherwise(T.no_spans())


def body_bold(text: Column, tk: K.Tokens, lists: Lists, seg_text: Column | None = None) -> Column:
    """F02"""
    bold = bold_spans(text)
    colon = lambda c: F.right(T.trim(c), F.lit(1)).isin(":", "：")
    heads = lambda x: (x["s"] == 0) & (F.substring(text, x["e"] + 1, F.lit(1)).isin(":", "：") | colon(_inner(text, x)))
    spans = F.filter(bold, lambda x: ~heads(x) & (T.trim(_inner(text, x)) != ""))
    if seg_text is not None:

        def heading(whole: Column) -> Column:
            alone = lambda seg: (F.size(seg) == 1) & (F.get(seg, F.lit(0))["e"] == F.char_length(whole)) & ~T.is_terminated(T.trim(F.substring(whole, F.lit(3), F.char_length(whole) - 4)))
            return F.when(F.startswith(whole, F.lit("**")) & F.endswith(whole, F.lit("**")), T.let(bold_spans(whole), alone)).otherwise(False)

        spans = F.when(K.true(T.let(T.trim(seg_text), heading)), T.no_spans()).otherwise(spans)
    return F.when(F.contains(text, F.lit("**")), spans).otherwise(T.no_spans())


def dashes(text: Column, tk: K.Tokens, lists: Lists) -> Column:
    """double dashes, then single dashes and arrows outside them; widened only after they are told apart."""
    double = T.occurrences(text, "——")
    single = T.outside(F.concat(T.occurrences(text, "—"), T.occurrences(text, "→")), double)
    return F.when(text.rlike("[—→]"), F.concat(double, single)).otherwise(T.no_spans())


RULES: dict[str, Callable] = {
    "S01": inanimate_speaker,
    "S02": leading_demonstrative,
    "S03": phrases("S03", "phrases"),
    "S04": first_person,
    "S05": negative_contrast,
    "L01": nativized_term,
    "L02": literal_translation,
    "L03": english_rhythm,
    "D02": fragment,
    "R01": phrases("R01", "phrases"),
    "R02": phrases("R02", "phrases"),
    "F01": bold_conclusion,
    "F02": body_bold,
    "F03": dashes,
    "F04": phrases("F04", "words"),
}


def _finding(rule: str, text: Column) -> Callable:
    shown = (lambda x: T.widened(text, x, AROUND)) if rule == "F03" else (lambda x: x)
    return lambda x, i: F.struct(F.lit(rule).alias("rule"), i.cast("int").alias("span_ord"), T.excerpt(text, shown(x)).alias("excerpt"))


def sentence_findings(sentences: DataFrame, lists: Lists = LISTS, rules: tuple[str, ...] = SENTENCE_RULES, polite_gate: bool = True) -> DataFrame:
    """doc_id, sent_id, rule, span_ord, excerpt: a row a finding. R01 is gated by its document elsewhere (findings)."""
    return told(judged(sentences, "doc_id", "sent_id", lists=lists, rules=rules))


def judged(sentences: DataFrame, *keep: str, lists: Lists = LISTS, rules: tuple[str, ...] = SENTENCE_RULES) -> DataFrame:
    """keep, and in `found` the findings of each sentence; they depend on text, seg_text and tokens alone, so that a table of different
    sentences can be judged once and joined to the places where they stand."""

    def made() -> Column:
        text, tk, parts = F.col("text"), K.Tokens(F.col("tokens")), []
        for rule in rules:
            spans = RULES[rule](text, tk, lists, F.col("seg_text")) if rule == "F02" else RULES[rule](text, tk, lists)
            parts.append(F.transform(T.disjoint(spans), _finding(rule, text)))
        return F.concat(*parts)

    return sentences.select(*keep, T.kept("findings " + " ".join(rules), lists, made).alias("found"))


def told(judged: DataFrame) -> DataFrame:
    """The findings of judged sentences in their places: doc_id, sent_id, found."""
    return judged.select("doc_id", "sent_id", F.explode("found").alias("f")).select("doc_id", "sent_id", "f.*")


# --- document rules


def runs(sentences: DataFrame, flag: Column, *keep: Column) -> DataFrame:
    """Runs of three or more neighbouring sentences of a segment that satisfy the flag, with no line end between: doc_id, run, and keep's aggregates."""
    by_doc = Window.partitionBy("doc_id").orderBy("sent_id")
    rows = sentences.withColumn("flag", K.true(flag))
    new = F.lag("seg_id").over(by_doc).isNull() | (F.lag("seg_id").over(by_doc) != F.col("seg_id")) | F.col("newline_before") | (F.lag("flag").over(by_doc) != F.col("flag"))
    rows = rows.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(by_doc)).filter("flag")
    return rows.groupBy("doc_id", "run").agg(F.min("sent_id").alias("sent_id"), F.count(F.lit(1)).alias("n"), *keep).filter(F.col("n") >= RUN)


def _ends_at(tk: K.Tokens, n: int) -> Callable:
    return lambda i: tk.at(i)["e"] == n


def conjunction(text: Column, tk: K.Tokens, words: list[str]) -> Column:
    """The first listed word, by code points, that heads the sentence as whole tokens and begins a new clause there."""
    stays = lambda t: K.pos(t, "particle", "aux_verb", "verb", "adjective", "suffix")
    out = F.lit(None).cast("string")
    for word in sorted(words, key=lambda w: w.encode(), reverse=True):
        place = F.array_min(tk.where(_ends_at(tk, len(word))))
        out = F.when(F.startswith(text, F.lit(word)) & place.isNotNull() & ~stays(tk.at(place + 1)), F.lit(word)).otherwise(out)
    return out


def leading_conjunctions(sentences: DataFrame, lists: Lists = LISTS) -> DataFrame:
    """S06"""
    head = T.kept("conjunction", lists["S06"], lambda: conjunction(F.col("text"), K.Tokens(F.col("tokens")), lists["S06"]["conjunctions"]))
    rows = sentences.withColumn("head", head).select("doc_id", "sent_id", "seg_id", "newline_before", "head")
    ordered = F.array_sort(F.collect_list(F.struct("sent_id", "head")))
    found = runs(rows, F.col("head").isNotNull(), F.array_join(F.transform(ordered, lambda x: x["head"]), "、").alias("excerpt"))
    return found.select("doc_id", "sent_id", F.lit("S06").alias("rule"), "excerpt")


def short_runs(sentences: DataFrame) -> DataFrame:
    """D01"""
    flag = T.is_terminated(F.col("text")) & (T.ja_chars(F.col("text")) <= SHORT)
    rows = sentences.select("doc_id", "sent_id", "seg_id", "newline_before", flag.alias("short"), T.excerpt(F.col("text"), T.span(F.lit(0), F.char_length("text"))).alias("shown"))
    found = runs(rows, F.col("short"), F.min_by("shown", "sent_id").alias("excerpt"))
    return found.select("doc_id", "sent_id", F.lit("D01").alias("rule"), "excerpt")


def _lacks_phrases() -> tuple[Column, Column]:
    hundredths = F.expr("common_phrases * 100000 div prose_chars")
    shown = F.concat(F.lit("1000 字あたり "), F.expr("cast(common_phrases * 100000 div prose_chars div 100 as string)"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(" 件"))
    return K.true((F.col("prose_chars") >= PHRASE_CHARS) & (F.col("common_phrases") * 1000.0 / F.col("prose_chars") < PHRASE_RATE)), shown


def _mixes() -> tuple[Column, Column]:
    shown = F.concat(F.lit("敬体 "), two_places(F.col("polite_ratio")), F.lit(" 常体 "), two_places(F.col("plain_ratio")))
    return (F.coalesce("polite_ratio", F.lit(0.0)) >= MIXED) & (F.coalesce("plain_ratio", F.lit(0.0)) >= MIXED), shown


def _ends_native() -> Column:
    return K.true((F.col("final_wago") + F.col("final_sahen") >= FINAL_LEAST) & (F.col("final_wago_ratio") > FINAL_RATIO))


def missing_phrases(measured: DataFrame) -> DataFrame:
    """D03"""
    ok, shown = _lacks_phrases()
    return measured.filter(ok).select("doc_id", F.col("first_prose").alias("sent_id"), F.lit("D03").alias("rule"), shown.alias("excerpt"))


def two_places(x: Column) -> Column:
    """Two decimals of a share from 1/8 to 1, half to even on the binary value, as printf of a double does it: as the share is a
    whole number of 2 ** -55, it is compared with the middle between two hundredths in whole numbers."""
    unit = F.lit(1 << 55)
    whole = (x * F.lit(float(1 << 55))).cast("long")
    low = F.floor(whole * 100 / F.lit(float(1 << 55))).cast("long")
    low = F.when(whole * 100 < low * unit, low - 1).when(whole * 100 >= (low + 1) * unit, low + 1).otherwise(low)

    def shown(n: Column) -> Column:
        over = whole * 200 - (n * 2 + 1) * unit
        n = n + F.when(over > 0, 1).when(over < 0, 0).otherwise(n % 2)
        return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))

    return T.let(low, shown)


def mixed_register(measured: DataFrame) -> DataFrame:
    """R03"""
    ok, shown = _mixes()
    return measured.filter(ok).select("doc_id", F.col("first_sentence").alias("sent_id"), F.lit("R03").alias("rule"), shown.alias("excerpt"))


def _frequent(final_words: DataFrame) -> DataFrame:
    """doc_id, words: the most frequent final lemmas with their counts."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "lemma"))
    top = final_words.withColumn("k", rank).filter(F.col("k") <= FINAL_WORDS)
    shown = F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", "lemma", F.col("n").cast("string")).alias("w"))))
    return top.groupBy("doc_id").agg(F.array_join(F.transform(shown, lambda x: x["w"]), "、").alias("words"))


def final_wago(measured: DataFrame, final_words: DataFrame) -> DataFrame:
    """G01"""
    over = measured.filter(_ends_native()).select("doc_id", F.col("first_sentence").alias("sent_id"), F.lit("G01").alias("rule"))
    return over.join(_frequent(final_words).withColumnRenamed("words", "excerpt"), "doc_id")


def measured_findings(measured: DataFrame, final_words: DataFrame) -> DataFrame:
    """D03, R03 and G01 from one pass over the measures."""
    (lacks, rate), (mixes, shares) = _lacks_phrases(), _mixes()
    row = lambda ok, rule, at, shown: F.when(ok, F.struct(F.col(at).alias("sent_id"), F.lit(rule).alias("rule"), shown.alias("excerpt")))
    made = F.array(row(lacks, "D03", "first_prose", rate), row(mixes, "R03", "first_sentence", shares), row(_ends_native(), "G01", "first_sentence", F.lit(None).cast("string")))
    found = measured.select("doc_id", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.*")
    return found.join(_frequent(final_words), "doc_id", "left").select("doc_id", "sent_id", "rule", F.coalesce("excerpt", "words").alias("excerpt"))


def findings(sentences: DataFrame, measured: DataFrame, final_words: DataFrame, lists: Lists = LISTS, floor: int = 300, own: DataFrame | None = None) -> DataFrame:
    """All rules' findings in their order: doc_id, phase, sent_id, rule_ord, span_ord, rule, layer, excerpt, hint. own: the sentence rules', if made already."""
    low = (F.col("ja_chars") == 0) | (F.col("ja_chars") < floor)
    docs = measured.select("doc_id", low.alias("low"), F.coalesce(F.col("polite_ratio") >= 0.5, F.lit(False)).alias("polite"))
    own = (sentence_findings(sentences, lists) if own is None else own).withColumn("phase", F.lit(0))
    whole = leading_conjunctions(sentences, lists).unionByName(short_runs(sentences)).unionByName(measured_findings(measured, final_words))
    whole = whole.withColumn("span_ord", F.row_number().over(Window.partitionBy("doc_id", "rule").orderBy("sent_id")) - 1).withColumn("phase", F.lit(1))
    gated = F.col("rule").isin(*(r for r in DOCUMENT_RULES if r[0] in GATED_LAYERS))
    whole = whole.join(docs, "doc_id").filter(~(gated & F.col("low"))).drop("low", "polite")
    polite = own.filter("rule = 'R01'").join(docs.filter("polite").select("doc_id"), "doc_id", "left_semi")
    every = own.filter("rule <> 'R01'").unionByName(polite).unionByName(whole)  # a sentence's own findings stay where they are made
    order = F.create_map(*(F.lit(x) for r, k in RULE_ORDER.items() for x in (r, k)))
    hint = F.create_map(*(F.lit(x) for pair in HINTS.items() for x in pair))
    layer = F.create_map(*(F.lit(x) for pair in LAYERS.items() for x in pair))
    return every.select(
        "doc_id", "phase", "sent_id", order[F.col("rule")].alias("rule_ord"), F.col("span_ord").cast("int").alias("span_ord"), "rule", layer[F.left("rule", F.lit(1))].alias("layer"), "excerpt", hint[F.col("rule")].alias("hint")
    )
