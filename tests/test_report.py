import json

import pytest

from proselens.functions import text as T
from proselens.functions import tokens as K
from proselens.operators import rules as R
from proselens.operators import score as S
from proselens.operators.lexicon import from_dictionary, join_letters, tokenize
from proselens.operators.tally import COUNTS, analysed, tallied, tallies
from proselens.operators.split import bold_spans, scan_bold, split_text
from proselens.operators import measures as M
from proselens.plans import bank
from proselens.plans import report as P
from proselens.rulesdata import rule_id
from proselens.settings import Settings, SettingsError
from proselens.sources import diffs, files, markdown, messages, source_code
from proselens.streaming.findings import stream_findings
from pyspark.sql import functions as F


def sentences(text):
    return [text[s:e] for s, e in split_text(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("風が吹く。寒いか！ まだか？", ["風が吹く。", "寒いか！", "まだか？"]),
        ("係は「測る。\n記す。」と答えた。別だ。", ["係は「測る。\n記す。」と答えた。", "別だ。"]),
        ("**印が片側だけの行。後ろも続く行。", ["**印が片側だけの行。", "後ろも続く行。"]),
        ("**太字。の中**だ。次だ。", ["**太字。の中**だ。", "次だ。"]),
        ("`a。b` だ。\n\n次（だ。\n\n三だ。", ["`a。b` だ。", "次（だ。", "三だ。"]),
        ("abc. 123\n", []),
        ("　行だ\n行だ　", ["行だ", "行だ"]),
    ],
)
def test_split(text, want):
    assert sentences(text) == want


BOLD = ["**a**b**c**", "`**`**a**", "**a\n\nb**", "**a\nb** **c", "x", "**", "****", "`a**b` と**窓**を", "***a***", "`**a** **b**"]


def test_bold_in_the_jvm_is_what_the_scanner_finds(spark):
    rows = spark.createDataFrame([(t,) for t in BOLD], "t string").select("t", bold_spans(F.col("t")).alias("b")).collect()
    assert {r.t: [(x.s, x.e) for x in r.b] for r in rows} == {t: scan_bold(t) for t in BOLD}


def test_spans(spark):
    df = spark.createDataFrame([("あいあいう 冷えた  回",)], "t string")
    t = F.col("t")
    got = df.select(
        T.occurrences(t, "あい").alias("a"),
        T.disjoint(T.any_occurrence(t, ["い", "いあい", "う"])).alias("b"),
        T.excerpt(t, T.span(F.lit(5), F.lit(12))).alias("c"),
        T.ja_chars(t).alias("n"),
        T.trim(F.lit("　 あ ")).alias("s"),
        T.outside(T.occurrences(t, "あ"), T.occurrences(t, "いあ")).alias("o"),
    ).first()
    assert [(x.s, x.e) for x in got.a] == [(0, 2), (2, 4)]
    assert [(x.s, x.e) for x in got.b] == [(1, 4), (4, 5)]
    assert (got.c, got.n, got.s) == (" 冷えた 回", 9, "あ")
    assert [(x.s, x.e) for x in got.o] == [(0, 1)]


def found(spark, text, rule):
    rows = [(0, 0, 0, "prose", False, text, text, [tuple(t[f] for f in ("surface", "lemma", "pos1", "pos2", "pos3", "ctype", "cform", "goshu", "b", "e")) for t in tokenize(text)])]
    df = spark.createDataFrame(rows, f"doc_id long, sent_id int, seg_id int, kind string, newline_before boolean, text string, seg_text string, tokens {K.TOKENS}")
    return [r.excerpt for r in R.sentence_findings(df, rules=(rule,)).orderBy("span_ord").collect()]


@pytest.mark.parametrize(
    "rule, text, want",
    [
        ("S01", "型の doc が名乗る。", ["doc が名乗る"]),
        ("S01", "型が宣言された。", []),
        ("L01", "設定が効いている。", ["効い"]),
        ("L01", "型が効いている。", []),
        ("L02", "8つのワーカーを持つマシンで動く。", ["8つのワーカーを持つマシン"]),
        ("F02", "**注意**: 値を変える。", []),
        ("F02", "**結論です。**", ["**結論です。**"]),
        ("F03", "窓——鍵—値—。", ["窓——鍵—値—。", "窓——鍵—値—。", "窓——鍵—値—。"]),
        ("F04", "極めて速い。非常に。", ["極めて", "非常に"]),
        ("S05", "", []),
    ],
)
def test_rules(spark, rule, text, want):
    assert found(spark, text, rule) == want


def test_tokens():
    assert [t["surface"] for t in tokenize("ab c 型")] == ["ab", "c", "型"]
    kinds = [(t["pos1"], t["surface"]) for t in join_letters([{"surface": c, "lemma": c, "pos1": "symbol", "pos2": "文字", "pos3": "", "goshu": "symbol", "b": k, "e": k + 1} for k, c in zip((0, 1, 3), "abc")])]
    assert kinds == [("noun", "ab"), ("symbol", "c")]
    t = from_dictionary("行っ", ("*", "動詞", "一般", "*", "*", "連用形", "和"), 3)
    assert (t["lemma"], t["pos1"], t["pos3"], t["goshu"], t["e"]) == ("行っ", "verb", "", "wago", 5)
    assert rule_id("S01") == "S01"
    for bad in ("S00", "X01", "S1", "S001"):
        with pytest.raises(ValueError):
            rule_id(bad)


def test_scores(spark):
    counts = {1: {"S01": 1, "D02": 1}, 2: {"S01": 2, "F01": 1}, 3: {}}
    rows = [(k, ja, n, *(counts[k].get(c[2:], 0) for c in COUNTS)) for k, ja, n in ((1, 500, 9), (2, 100, 1), (3, 0, 0))]
    totals = spark.createDataFrame(rows, "doc_id long, ja_chars long, sentences long, " + ", ".join(f"{c} long" for c in COUNTS))
    got = {r.doc_id: r for r in S.points(totals, ["doc_id"], {"S01": 3.0, "D02": 0.5}).withColumn("over", S.exceeds(10.0)).collect()}
    assert (got[1].per_1000, got[1].by_layer, got[1].over) == (7.0, {"structure": 6.0, "density": 1.0}, False)
    assert (got[2]["mode"], got[2].per_1000, got[2].over) == ("count_only", None, True)
    assert (got[3]["mode"], got[3].by_rule, got[3].over) == ("count_only", {}, False)
    rows = [("a", 1000, True, "human", 5.0), ("b", 1000, True, "human", 5.1), ("c", 1000, True, "claude", 6.0), ("d", 1000, True, "claude", 5.9), ("e", 0, True, "human", None), ("f", 9, True, "human", None), ("g", 1000, False, "human", 9.0)]
    verdicts = spark.createDataFrame(rows, "n string, ja_chars long, judge boolean, side string, per_1000 double").select("n", S.verdict().alias("v")).collect()
    assert {r.n: r.v for r in verdicts} == {"a": "met", "b": "violated", "c": "met", "d": "violated", "e": "empty", "f": "below_floor", "g": "reference"}


def test_tallies_count_what_findings_show(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"))
    corpus = bank.corpus(docs)
    facts = M.sentence_facts(corpus)
    shown = R.findings(corpus, M.document_measures(facts), M.final_words(facts)).groupBy("doc_id", "rule").count().collect()
    want = {(r.doc_id, r.rule): r["count"] for r in shown}
    got = {(r.doc_id, c[2:]): r[c] for r in tallies(corpus).collect() for c in COUNTS if r[c]}
    assert got == want and len({r for _, r in want}) > 15
    again = tallied(bank.analysed_corpus(docs, analysed(bank.bank(spark).withColumn("seg_text", F.col("text")), "id")))
    assert sorted(map(str, again.collect())) == sorted(map(str, tallies(corpus).select(*again.columns).collect()))


def test_two_places_are_those_of_printf(spark):
    shares = [a / b for b in range(1, 240) for a in range(1, b + 1) if a / b >= 0.125]
    got = spark.createDataFrame([(x,) for x in shares], "x double").select("x", R.two_places(F.col("x")).alias("s")).collect()
    assert all(r.s == f"{r.x:.2f}" for r in got)


def md(text):
    return [s["text"] for s in markdown.segments(text)]


def test_markdown():
    assert md("# 章の名だ\n\n川の水を測る。\n雨の量も測る。\n") == ["章の名だ", "川の水を測る。\n雨の量も測る。"]
    assert md("- 朝に測る。\n- 夜に測る。\n  - 夜半にも測る。\n") == ["朝に測る。", "夜に測る。", "夜半にも測る。"]
    assert md("- [ ] 器具を洗う。\n- [x] 棚に戻す。\n") == ["器具を洗う。", "棚に戻す。"]
    assert md("> 台帳の上段。\n> 台帳の下段。\n") == ["台帳の上段。\n  台帳の下段。"]
    assert md("| 場所 | 深さ |\n|---|---|\n| **語** | 岸 → 沖。 |\n") == ["場所", "深さ", "  語  ", "岸     沖。"]
    assert md("砂を量る。\n\n```rust\n記号。\n```\n\n    余白だ。\n") == ["砂を量る。"]
    assert md("- 箱だ。\n\n  ```\n  記号。\n  ```\n") == ["箱だ。"]
    assert md("<div>枠の中だ。</div>\n\n砂を量る。\n") == ["砂を量る。"]
    assert md("横に `記号。` と続く。\n") == ["横に " + " " * len("`記号。`".encode()) + " と続く。"]
    assert md("横に [地図](https://x/道) と続く。\n") == ["横に  地図" + " " * len("](https://x/道)".encode()) + " と続く。"]
    assert md("![写真](img.png)\n") == []
    assert [(s["line_start"], s["line_end"]) for s in markdown.segments("# 章の名だ\n\n瓶の上側。\n瓶の下側。\n\n- 箱だ。\n")] == [(1, 1), (3, 4), (6, 6)]


def code(name, text):
    return [(s["kind"], s["text"]) for s in source_code.segments(text, source_code.LANGUAGES[name])]


def test_source_code():
    rust = '//! 箱の説明。\n\n/// 蓋の説明は\n/// 二行で書く。\n// 釘の注記。\n/* 板の注記。 */\nfn f() {\n let s = "文字列\\nだ。";\n let r = r#"生の{x}だ。"#;\n}\n#[cfg(test)]\nmod t { // 試験だ。\n}\n'
    assert code("rs", rust) == [("doc_comment", "箱の説明。"), ("doc_comment", "蓋の説明は二行で書く。"), ("comment", "釘の注記。板の注記。"), ("string_literal", "文字列\nだ。"), ("string_literal", "生の   だ。")]
    assert code("py", '"""説明だ。"""\n# 一行目だ。\n# 二行目だ。\ns = r"生の\\nだ。" + f"{d[1]} だ"\n') == [("doc_comment", "説明だ。"), ("comment", "一行目だ。二行目だ。"), ("string_literal", "生の\\nだ。"), ("string_literal", "       だ")]
    assert code("ts", '/** doc だ。 */\n// 行だ。\nconst t = `外 ${"内だ"} 外`;\n') == [("doc_comment", "doc だ。"), ("comment", "行だ。"), ("string_literal", "外 " + " " * len('${"内だ"}'.encode()) + " 外")]
    assert code("go", 'var x = "符号 \\u3042 だ。"\n') == [("string_literal", "符号 あ だ。")]
    assert code("rs", "/// 窓が開く。\n///\n/// 値が減る。\n") == [("doc_comment", "窓が開く。\n値が減る。")]


def test_settings(tmp_path):
    path = tmp_path / "proselens.toml"
    path.write_text('threshold = 4.5\nexclude = ["tests/**", "*.md"]\n[weights]\nS01 = 9\n[lists.F04.words]\nadd = ["実に"]\nremove = ["非常に"]\n')
    s = Settings.load(start=str(tmp_path / "a"))
    assert (s.threshold, s.floor, s.weights["S01"], s.weights["S02"]) == (4.5, 300, 9.0, 1.0)
    assert "実に" in s.lists["F04"]["words"] and "非常に" not in s.lists["F04"]["words"]
    assert [s.excludes(str(tmp_path / p)) for p in ("tests/a.rs", "tests", "b.md", "a/b.md")] == [True, False, True, False]
    for bad in ("x = 1", "[weights]\nS99 = 1", "[lists.S02.words]\nadd = []", "[lists.F04.nothing]\nadd = []"):
        path.write_text(bad)
        with pytest.raises(SettingsError):
            Settings.load(str(path))


def test_report_over_files(spark, tmp_path):
    (tmp_path / "target").mkdir()
    (tmp_path / "target" / "x.md").write_text("重要なのは。")
    (tmp_path / "a.md").write_text("# 型がエラーを名乗る。\n\n非常に速い処理です。\n")
    (tmp_path / "b.txt").write_text("no prose")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "d.png").write_bytes(b"x")
    report, warnings = P.check(spark, [str(tmp_path), str(tmp_path / "d.png")])
    assert {(r.path.rsplit("/", 1)[1], r.reason) for r in warnings.collect()} == {("c.txt", "not utf-8"), ("d.png", "unsupported")}
    data = json.loads(P.to_json(report))
    assert [d["name"].rsplit("/", 1)[1] for d in data["documents"]] == ["a.md"]
    assert [(f["rule"], f["excerpt"], f["origin"]["lines"]) for f in data["documents"][0]["score"]["findings"]] == [("S01", "型がエラーを名乗る", {"start": 1, "end": 1}), ("F04", "非常に", {"start": 3, "end": 3})]
    assert data["total"]["by_rule"] == {"S01": 1, "F04": 1}
    assert "指摘 2 件" in P.to_text(report)
    assert report.exceeds(10.0)


def test_logs_and_diffs(spark):
    log = spark.createDataFrame([(1, "abc\x00題だ。\n\n本文だ。\n\nSigned-off-by: x\x00\ndef\x00一行\x00\n")], "id int, log string")
    got = messages.log_records(log, ["id"]).orderBy("k").collect()
    assert [(r.hash, r.message.split("\n")[0]) for r in got] == [("abc", "題だ。"), ("def", "一行")]
    text = "\n題だ。\n続き\n# 印\n\n本文だ。\n二行目\n\nSigned-off-by: x\n本当\n# ---- >8 ----\n後だ。"
    rows = messages.message_segments(spark.createDataFrame([(1, text)], "id int, message string"), ["id"]).orderBy("seg_id").collect()
    assert [(r.kind, r.text, r.line_start, r.line_end) for r in rows] == [("commit_subject", "題だ。", 2, 2), ("commit_body", "続き", 3, 3), ("commit_body", "本文だ。\n二行目", 6, 7), ("commit_body", "本当", 10, 10)]
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x.md\t\n@@ -1 +2,3 @@\n+++ b/no\n@@ -9,2 +8,0 @@\n@@ -1 +7 @@ f\ndiff --git a/y b/y\n+++ \"b/y\"\n@@ -1 +1 @@\n"
    got = diffs.changes(spark.createDataFrame([(1, diff)], "id int, diff string"), ["id"]).orderBy("start").collect()
    assert [(r.path, r.start, r.end) for r in got] == [("x.md", 2, 4), ("x.md", 7, 7)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    docs = spark.createDataFrame([(1, "型がエラーを名乗る。窓が開く。")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in" / "p"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in" / "p"))
    q = stream_findings(stream).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.rule, r.excerpt) for r in spark.table("found").collect()} == {("S01", "型がエラーを名乗る"), ("L01", "窓")}


def test_manifest(tmp_path):
    path = tmp_path / "m.toml"
    path.write_text('[[set]]\nname = "a"\nside = "human"\npaths = ["x"]\n')
    assert files.manifest(str(path))[0].paths == (str(tmp_path / "x"),)
    path.write_text('[[set]]\nname = "a"\nside = "human"\n')
    with pytest.raises(ValueError):
        files.manifest(str(path))
    assert files.diff_range("a..b") == ("a..b", "b") and files.diff_range("a..") == ("a..", "HEAD") and files.diff_range("x") == ("x~1..x", "x")
    assert [files.format_of(p) for p in ("a.MD", "b", ".c", "d.tsx", "e.png")] == ["markdown", "text", None, "script", None]


def test_plain_texts_need_no_python(spark):
    """A plain text is a segment as a whole, whatever its length; only other formats go to Python, in bounded batches."""
    texts = ["川だ。", "川だ。\n", "\n\n川", "a\n\n川だ。\n\n", "no Japanese", None, "\r\n川\n" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("doc_id", "'a.txt' name", "'text' format", "text")
    found = files.extract_documents(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
    got = {r.doc_id: (r.seg_id, r.kind, r.text, r.line_start, r.line_end) for r in found.collect()}
    assert got == {k: tuple(files.extract(t, "text")[0][c] for c in ("seg_id", "kind", "text", "line_start", "line_end")) for k, t in enumerate(texts) if t and "川" in t}
    mixed = docs.unionByName(docs.selectExpr("doc_id + 100 doc_id", "'a.md' name", "'markdown' format", "text"))
    assert {r.doc_id for r in files.extract_documents(mixed).collect()} == {*got, *(k + 100 for k in got)}


def test_findings_judge_a_sentence_once(spark):
    """The queries' findings are those of each sentence where it stands, though only the bank's sentences are judged."""
    from proselens import queries as Q
    from proselens.plans import bank as B

    keys = spark.range(3, 6).withColumnRenamed("id", "doc_id")
    bank = B.bank(spark).withColumn("seg_text", F.col("text"))
    once = R.told(B.analysed_corpus(keys, R.judged(bank, "id", rules=("S02", "F03"))))
    each = R.sentence_findings(B.corpus(keys), rules=("S02", "F03"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, each.collect())) != []
    assert hasattr(Q, "_own")
