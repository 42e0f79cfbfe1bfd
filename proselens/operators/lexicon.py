"""Tokens. A backend maps sentences to token arrays; this one knows a small lexicon and says so.

The lexicon covers the example sentences and little else: words outside it become runs of one script, tagged as nouns.
A full dictionary can be used by passing any function from a text to rows of the same fields, or a token table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.functions import tokens as K
from proselens.shipping import ship

FIELDS = ("surface", "lemma", "pos1", "pos2", "pos3", "ctype", "cform", "goshu")

# Dictionary labels of parts of speech and of word origins, and the names used here.
POS = {
    "名詞": "noun", "代名詞": "pronoun", "動詞": "verb", "形容詞": "adjective", "形状詞": "adjectival_noun", "副詞": "adverb", "連体詞": "adnominal", "接続詞": "conjunction", "感動詞": "interjection",
    "助詞": "particle", "助動詞": "aux_verb", "接頭辞": "prefix", "接尾辞": "suffix", "記号": "symbol", "補助記号": "supplementary_symbol", "空白": "whitespace",
}
ORIGINS = {"和": "wago", "漢": "kango", "外": "gairai", "混": "konshu", "記号": "symbol", "固": "proper"}

#: surface[/lemma] by part of speech (1, 2, 3), form and origin.
LEXICON = """
名詞 普通名詞 一般 - 漢: 型 文書 仕様 環境 値 精度 速度 問題 処理 以上 結果 本文 順 数 一般 項目 回路 書式 章 図
名詞 普通名詞 サ変可能 - 漢: 設定 宣言 主張 検査 応答 要求 実装 入力 出力 追加 運用 比較 動作 開始 変更 失敗 約束 確認
名詞 普通名詞 一般 - 漢: 既定 経路 索引 利用者 開発者 瞬間 結論 注意 際
名詞 普通名詞 一般 - 和: 鍵 窓 旗 篩 人 私事 仕組み
名詞 普通名詞 一般 - 外: エラー ワーカー マシン メニュー サーバー ノード
名詞 固有名詞 人名 - 固: 田中
名詞 数詞 - - 漢: 8 二 三
接尾辞 名詞的 助数詞 - 和: つ 個
接尾辞 名詞的 一般 - 和: ら 自身
代名詞 - - - 和: これ それ 私
動詞 一般 - 終止形-一般 和: 名乗る 述べる 比べる 上がる 開く 返す 回る 減る 増える 終わる 読む 進める 足す 回す 数える 動く 呼ぶ 変わる 閉じる 効く 測る 落とす
動詞 一般 - 連用形-一般 和: 変え/変える 比べ/比べる 数え/数える 効い/効く 掛け/掛ける 調べ/調べる 押し/押す 待っ/待つ 変わり/変わる 測り/測る 返し/返す 落とし/落とす
動詞 一般 - 終止形-一般 和: 変える 持つ
動詞 非自立可能 - 終止形-一般 和: する なる いく できる くださる 始める
動詞 非自立可能 - 連用形-一般 和: し/する さ/する なり/なる い/いる 始め/始める ください/くださる でき/できる つい/つく
形容詞 非自立可能 - 連用形-一般 和: なく/ない
形容詞 一般 - 終止形-一般 和: 難しい 速い
形状詞 助動詞語幹 - - 和: よう
形状詞 一般 - - 漢: 優雅 簡単 非常
副詞 - - - 和: よく ちょっと 必ず
副詞 - - - 和: 例えば さらに
接続詞 - - - 和: しかし また したがって
助詞 格助詞 - - 和: が を に の と で
助詞 係助詞 - - 和: は も
助詞 副助詞 - - 和: だけ
助詞 接続助詞 - - 和: て
助詞 終助詞 - - 和: か
助動詞 - - 終止形-一般 和: です ます た だ
助動詞 - - 未然形-一般 和: れ/れる
助動詞 - - 終止形-一般 和: れる られる
名詞 普通名詞 一般 - 和: こと 方
補助記号 句点 - - 記号: 。 ！ ？
補助記号 読点 - - 記号: 、
補助記号 括弧開 - - 記号: 「
補助記号 括弧閉 - - 記号: 」
補助記号 一般 - - 記号: ** — → ： :
"""


def _load(source: str) -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for line in source.strip().splitlines():
        head, _, words = line.partition(": ")
        pos1, pos2, pos3, form, origin = head.split(" ")
        for word in words.split(" "):
            surface, _, lemma = word.partition("/")
            if surface and surface not in out:
                clean = lambda x: "" if x == "-" else x
                out[surface] = (surface, lemma or surface, POS[pos1], clean(pos2), clean(pos3), "", clean(form), ORIGINS[origin])
    return out


WORDS = _load(LEXICON)
LONGEST = max(map(len, WORDS))
#: Runs of what the lexicon does not know.
UNKNOWN = re.compile(r"[A-Za-z]+|[0-9]+|[ァ-ヿー]+|[一-鿿々]+|[ぁ-ゟ]|.", re.S)


def tokenize(text: str) -> list[dict]:
    """Longest known word at each place, else a run of one script; white space gives no token."""
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        for n in range(min(LONGEST, len(text) - at), 0, -1):
            if (known := WORDS.get(text[at : at + n])) is not None:
                row = known
                break
        else:
            run = UNKNOWN.match(text, at)[0]
            n = len(run)
            if run.isascii() and run.isdigit():
                row = (run, run, "noun", "数詞", "", "", "", "unknown")
            elif run.isascii() and run.isalpha():
                row = (run, run, "symbol", "文字", "", "", "", "symbol")
            elif re.match(r"[ァ-ヿ]", run):
                row = (run, run, "noun", "普通名詞", "一般", "", "", "gairai")
            elif re.match(r"[一-鿿々]", run):
                row = (run, run, "noun", "普通名詞", "一般", "", "", "unknown")
            else:
                row = (run, run, "other" if re.match(r"[ぁ-ゟ]", run) else "supplementary_symbol", "一般", "", "", "", "unknown")
        out.append(dict(zip(FIELDS, row)) | {"b": at, "e": at + n})
        at += n
    return join_letters(out)


def join_letters(tokens: list[dict]) -> list[dict]:
    """Letter symbols without a gap between become one noun of unknown origin; a lone letter stays a symbol."""
    out: list[dict] = []
    letter = lambda t: t["pos1"] == "symbol" and t["pos2"] == "文字"
    k = 0
    while k < len(tokens):
        j = k + 1
        while letter(tokens[k]) and j < len(tokens) and letter(tokens[j]) and tokens[j]["b"] == tokens[j - 1]["e"]:
            j += 1
        text = "".join(t["surface"] for t in tokens[k:j])
        if letter(tokens[k]) and len(text) > 1:
            out.append(tokens[k] | {"surface": text, "lemma": text, "pos1": "noun", "pos2": "普通名詞", "pos3": "一般", "goshu": "unknown", "e": tokens[j - 1]["e"]})
        else:
            out += tokens[k:j]
        k = j
    return out


def from_dictionary(surface: str, labels: Iterable[str | None], b: int) -> dict:
    """A dictionary's row (lemma, pos1, pos2, pos3, ctype, cform, origin; '*' is nothing) as a token."""
    lemma, pos1, pos2, pos3, ctype, cform, origin = (None if x in (None, "*") else x for x in labels)
    return {
        "surface": surface, "lemma": lemma or surface, "pos1": POS.get(pos1, "other"), "pos2": pos2 or "", "pos3": pos3 or "",
        "ctype": ctype, "cform": cform, "goshu": ORIGINS.get(origin, "unknown"), "b": b, "e": b + len(surface),
    }


def with_tokens(sentences: DataFrame, backend: Callable[[str], list[dict]] = tokenize) -> DataFrame:
    """sentences with a tokens column, by Arrow batches; table cells without a predicate go."""

    ship(sentences.sparkSession)

    @F.pandas_udf(K.TOKENS)
    def run(texts):
        return texts.map(lambda t: backend(t) if t else [])

    rows = sentences.withColumn("tokens", run(F.col("text")))
    return rows.filter((F.col("kind") != "table_cell") | F.exists("tokens", K.predicate))
