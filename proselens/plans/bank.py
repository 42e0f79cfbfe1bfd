"""A corpus of example sentences dealt over the ids of a table, for queries over tables that hold no Japanese."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.functions import tokens as K
from proselens.operators.lexicon import tokenize

#: Example sentences, at least one for and one against each rule.
SENTENCES = """
型がエラーを名乗る。
利用者が設定を述べる。
文書が仕様を宣言する。
仕様が宣言された。
文書がエラーを返し、設定を宣言する。
これは設定です。
それらも環境だ。
重要なのは、設定を比べることです。
私は設定を変えます。
私自身の設定を変えた。
速度だけでなく精度も上がる。
問題ではなく設定です。
さらに値を比べます。
また、鍵を数えます。
したがって窓が開く。
したがって、値が減る。
設定が効いている。
型が効いている。
検査を掛けます。
既定では応答を返す。
要求仕様を読む。
8つのワーカーを持つマシンで動く。
経路を確認して応答する。
値を調べ始めます。
鍵を押した瞬間、窓が閉じる。
窓が開く。
鍵が回る。
値が減る。
以上の結果。
例えば、値が増えるようになる。
しかし、難しい問題です。
鍵と呼ぶ仕組みだ。
ちょっと待ってください。
処理が優雅に終わる。
**結論です。**値を変える。
**注意**: 値を変える。
設定は**必ず**読む。
**鍵と窓**
設計——実装の順に進める。
入力→出力の順に  進める—。
非常に速い処理です。
値を足す。
鍵を回す。
数を数える。
鍵を測る。
項目を追加します。
値が変わりますか
運用を開始できる。
`a**b` と**窓**を開く。
""".strip().split("\n")

SENTENCE_SCHEMA = f"doc_id long, sent_id int, seg_id int, kind string, newline_before boolean, text string, seg_text string, tokens {K.TOKENS}"


@lru_cache(maxsize=1)
def token_rows() -> list[list[dict]]:
    return [tokenize(s) for s in SENTENCES]


def bank(spark: SparkSession) -> DataFrame:
    """id, text, tokens: a row an example."""
    rows = [(k, s, [tuple(t[f] for f in ("surface", "lemma", "pos1", "pos2", "pos3", "ctype", "cform", "goshu", "b", "e")) for t in ts]) for k, (s, ts) in enumerate(zip(SENTENCES, token_rows()))]
    return spark.createDataFrame(rows, f"id int, text string, tokens {K.TOKENS}")


def places(keys: DataFrame) -> DataFrame:
    """doc_id, sent_id, seg_id, kind, newline_before, id: between 4 and 172 examples a document."""
    rows = keys.select("doc_id", F.explode(F.sequence(F.lit(0), (3 + F.col("doc_id") % 8 * 24).cast("int"))).alias("sent_id"))
    seg = F.expr("sent_id div 5").cast("int")
    return rows.select(
        "doc_id",
        "sent_id",
        seg.alias("seg_id"),
        F.when(seg % 4 == 3, "comment").otherwise("prose").alias("kind"),
        (F.col("sent_id") % 5 == 3).alias("newline_before"),
        ((F.col("doc_id") * 7 + F.col("sent_id") * 5 + F.col("doc_id") * F.col("sent_id")) % len(SENTENCES)).cast("int").alias("id"),
    )


def analysed_corpus(keys: DataFrame, analysis: DataFrame) -> DataFrame:
    """The places with an analysis of the bank (id and its columns), which so is made once a sentence and not once a place."""
    return places(keys).join(F.broadcast(analysis), "id").drop("id")


def corpus(keys: DataFrame) -> DataFrame:
    """The sentences of SENTENCE_SCHEMA; the bank is a few dozen rows and so is sent to every task."""
    found = places(keys).join(F.broadcast(bank(keys.sparkSession)), "id")
    return found.select("doc_id", "sent_id", "seg_id", "kind", "newline_before", "text", F.col("text").alias("seg_text"), "tokens")
