import random

import pytest

from proselens.operators import dictionary as D
from proselens.operators.lexicon import with_tokens

COLUMNS = "pos1 pos2 pos3 pos4 cType cForm lForm lemma orth pron orthBase pronBase goshu".split()


def folder(tmp_path, rows, matrix, columns=COLUMNS):
    (tmp_path / "columns.txt").write_text("\n".join(columns))
    (tmp_path / "lex.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "matrix.def").write_text("3 3\n" + "".join(f"{r} {left} {c}\n" for (r, left), c in matrix.items()))
    return str(tmp_path)


def row(surface, left, right, cost, base="*", pos="名詞", goshu="和"):
    return f"{surface},{left},{right},{cost},{pos},普通名詞,一般,*,*,*,*,*,*,*,{base},*,{goshu}"


def test_tokens_of_a_folder(spark, tmp_path):
    path = folder(tmp_path, [row("川", 1, 1, 50), row("は", 2, 2, 10, pos="助詞"), row("川は", 1, 1, 900), row("流れ", 1, 1, 80, base="流れる", pos="動詞"), row('"、"', 2, 2, 5, pos="補助記号", goshu="記号").replace('"、"', "、")], {(1, 2): -5, (2, 1): 3})
    got = D.Dictionary(path)("川は 流れabc。")
    assert [(t["surface"], t["lemma"], t["pos1"], t["goshu"], t["b"], t["e"]) for t in got] == [("川", "川", "noun", "wago", 0, 1), ("は", "は", "particle", "wago", 1, 2), ("流れ", "流れる", "verb", "wago", 3, 5), ("abc", "abc", "noun", "unknown", 5, 8), ("。", "。", "noun", "unknown", 8, 9)]
    assert D.Dictionary(path)("") == []
    rows = spark.createDataFrame([("prose", "川は、流れ")], "kind string, text string")
    assert [t.surface for t in with_tokens(rows, D.Dictionary.shipped(spark, path)).first().tokens] == ["川", "は", "、", "流れ"]


def test_missing_columns_are_errors(tmp_path):
    for c in D.COLUMNS:
        with pytest.raises(D.MissingColumn, match=c):
            D.Dictionary(folder(tmp_path, [], {}, [x for x in COLUMNS if x != c]))


def test_the_path_is_the_cheapest_of_all(tmp_path):
    rng = random.Random(2)
    words = {}
    for w in ("あ", "い", "う", "あい", "いう", "あいう", "うあ"):
        words[w] = [(rng.randint(0, 2), rng.randint(0, 2), rng.randint(1, 9000), ("x",)) for _ in range(2)]
    matrix = {(r, left): rng.randint(-3000, 3000) for r in range(3) for left in range(3)}

    def every(text, at, right):
        if at == len(text):
            yield matrix[right, 0]
        for n in range(1, len(text) - at + 1):
            for left, r, cost, _ in words.get(text[at : at + n], []):
                for rest in every(text, at + n, r):
                    yield matrix[right, left] + cost + rest
        if at < len(text):
            n = D.UNKNOWN.match(text, at).end() - at
            for rest in every(text, at + n, 0):
                yield matrix[right, 0] + D.UNKNOWN_COST + rest

    for _ in range(30):
        text = "".join(rng.choice("あいう") for _ in range(rng.randint(1, 7)))
        path = D.segment(text, words, matrix, 3)
        assert [(a, b) for a, b, _ in path] and "".join(text[a:b] for a, b, _ in path) == text
        costs = {0: 0}
        for a, b, labels in path:  # the cheapest entries along this segmentation
            found = words.get(text[a:b], []) if labels else [(0, 0, D.UNKNOWN_COST, None)]
            costs = {r: min(c + matrix[p, left] + cost for p, c in costs.items() for left, r2, cost, _ in found if r2 == r) for r in {x[1] for x in found}}
        assert min(c + matrix[r, 0] for r, c in costs.items()) == min(every(text, 0, 0))
