"""The rules: order, layer, weight, hint and word lists."""

from __future__ import annotations

# The six layers in their order.
LAYERS = {"S": "structure", "L": "lexical", "D": "density", "R": "register", "F": "formulaic", "G": "goshu"}

# Default weights, in points a finding.
WEIGHTS = {
    "S01": 3.0, "S02": 1.0, "S03": 2.5, "S04": 2.0, "S05": 0.75, "S06": 0.75, "L01": 3.0, "L02": 2.0, "L03": 3.0, "D01": 0.5,
    "D02": 0.1, "D03": 1.0, "R01": 1.0, "R02": 2.0, "R03": 1.0, "F01": 2.0, "F02": 2.0, "F03": 2.0, "F04": 1.0, "G01": 2.0,
}

#: Rules that look at a whole document; the others look at a sentence.
DOCUMENT_RULES = ("S06", "D01", "D03", "R03", "G01")
SENTENCE_RULES = tuple(r for r in WEIGHTS if r not in DOCUMENT_RULES)
#: Document rules of these layers are left out below the floor.
GATED_LAYERS = ("D", "R", "G")

# Each rule's heading in the rule book.
HEADINGS = {
    "S01": "文書・型・テストを語り手にしない",
    "S02": "文頭の指示代名詞",
    "S03": "説明の足場語",
    "S04": "技術文の「私」",
    "S05": "「ではなく」の対句",
    "S06": "文頭の接続詞の連打",
    "L01": "慣習語の和語化",
    "L02": "辞書の第一義と逐語訳",
    "L03": "英語のリズムの直写",
    "D01": "短文の連打",
    "D02": "述語を持たない短い断片文",
    "D03": "人間の文に普通の表現の欠如",
    "R01": "敬体の文書に混じる口語",
    "R02": "身体的な比喩",
    "R03": "敬体と常体の混在",
    "F01": "冒頭の太字の結論",
    "F02": "本文の太字",
    "F03": "2 倍ダッシュと矢印",
    "F04": "空虚な強調",
    "G01": "文末の述語の和語率",
}

THRESHOLD = 10.0
FLOOR = 300

# What each rule advises.
HINTS = {
    "S01": "文書や型を語り手にしない。所在や手段で受ける",
    "S02": "指示語を省くか、受ける名詞を書く",
    "S03": "前置きを消して主張を書く",
    "S04": "書き手を省く。主体を示すなら「こちらで」「今回は」",
    "S05": "否定と肯定の対句は要所に限る",
    "S06": "毎文に接続詞を置かない。主題の流れで繋がるなら接続詞を削除する",
    "L01": "その分野で通っている語を使う: メニュー、メッセージ、ウィンドウ、キー、フラグ、フォーカスリング、ビルドする、高速パス、雛形、コールドスタート",
    "L02": "慣習語に置き換える: デフォルトでは、エラーにならずに失敗する、決済に失敗する、8 ワーカー構成のマシン、パス、計測、ノード",
    "L03": "「〜すると」「〜した時点で」に戻す",
    "D01": "短い文を 3 つ以上続けない",
    "D02": "断片は読み手に文脈の復元を強いる。主題を補うか前後の文に繋げる",
    "D03": "名詞と記号で済ませた説明を、例を挙げ、語を定義し、変化と対比を述べる文に書き直す",
    "R01": "報告書や仕様では中立語を使う（「〜のような」「〜する」）",
    "R02": "抽象語に温度を下げる: 変更しない、反応、コスト",
    "R03": "読み手ごとに敬体か常体を決めて揃える",
    "F01": "太字で結論を先出ししない。文の順序で示す",
    "F02": "本文の太字は外す。強調は語の選択と文の位置で行う",
    "F03": "括弧か句点で分ける。矢印は表とコードに限る",
    "F04": "中身のない強調は削る。程度は数で書く",
    "G01": "文末の述語は分野の慣習語にする（動作する、追加する、比較する）",
}

# The default word lists, by rule and group.
LISTS = {
    "S01": {
        "person": "利用者 ユーザー ユーザ 開発者 レビュアー 人 私 チーム 筆者 読者 相手 側 者 客 顧客 担当 作者 著者 自分 彼 彼女 誰 皆".split(),
        "speech": "述べる 名乗る 名指す 語る 答える 主張 宣言 約束 教える 訴える".split(),
    },
    "S03": {
        "phrases": "重要なのは 重要な点は つまり、 要するに 正直に言うと 率直に言うと 率直に言えば 正直なところ 結論から言うと 結論から言えば 言い換えれば 言い換えると まとめると 総じて に他ならない ポイントは 注目すべきは 興味深いのは 鍵となるのは 本質的には".split(),
    },
    "S06": {"conjunctions": "さらに また 加えて これにより したがって そのため その結果 一方 ただし なお".split()},
    "L01": {
        "phrases": [*"品書き 繋ぎ口 記録の口 設定の鍵 環境の鍵 項目の鍵 読み手の鍵 ソースから建て 一から建て 手元で建て 冷えた一回目 冷えた1回目".split(), "冷えた 1 回目", *"骨を置く 速い道 遅い道 地とホバー 名乗りが通 練り直し 直選び 載せ替え 配ったもの 配った版".split(), "本番の Run", *"持ち越す字 巡回の番号 照らせ 棚崩し 検証を掛 検査を掛 規則を掛".split()],
        "verbs": "濾す 掃く 測る 採る 繋ぐ 頼む 走る 黙る 効く 落とす 縛る 寄せる 畳む 断る 引き直す 突き合わせる 移す 倒す 配る 写す 載る 食い違う 取り下げる 覆う".split(),
        "nouns": "篩 摘み 物差し 効き目 素通し 持ち越し 待ち受け 段取り 仕掛け 下駄 写し 控え 窓 輪 旗 錠 器 入れ物 札 覆い 重ね 決め 束ね".split(),
        "idioms": "型が効 補完が効 ヒントが効 リロードは効 リロードが効 応用が効 に落と".split(),
    },
    "L02": {
        "phrases": "既定では 静かに失敗 黙って失敗し 失敗を経験 エラーを経験 障害を経験 フォールバックとなり に丸められ 直感的な意味論 意味論を という営み リトライが尽き 試行が尽き 耐障害性を確認 耐障害性を検証 を犠牲にし の温床 に他ならず 明示的に指定し 明示的に設定し 明示的に定義し".split(),
        "machines": "マシン 環境 サーバー ホスト".split(),
        "terms": "既定 照合 応答 要求 経路 索引 実測 土俵 帰結 逐語 電文 実物 節点 往復 土台 配線 指紋 正本 寸法 緩衝 族 免許".split(),
        "compounds": "逐語訳 線形応答 応答性 要求仕様 終了要求 要求時 運転免許".split(),
    },
    "R01": {"phrases": "」的な 」的に ちょっと やつ すごく めっちゃ みたいな てしまいます てしまいました ちゃう ちゃった".split()},
    "R02": {"phrases": "無傷 手応え 代を払 代は承知 に牙 息をす 冷たい失敗 冷たいエラー 静かな失敗 静かなエラー 優雅に エレガントに 魔法 地獄 悪夢".split()},
    "F04": {"words": "非常に 極めて 大いに 不可欠 核心的 根本的な 包括的 多角的 総合的に 劇的に 飛躍的に 画期的".split()},
}

RULE_ORDER = {r: k for k, r in enumerate(WEIGHTS)}


def rule_id(text: str) -> str:
    """A layer letter and two digits from 01 to 99, or ValueError."""
    if len(text) == 3 and text[0] in LAYERS and text[1:].isascii() and text[1:].isdigit() and text[1:] != "00":
        return text
    raise ValueError(f"not a rule id: {text!r}")
