"""Fixed values that results depend on: character classes, patterns, word lists and prices."""

# White space and control characters (Java regex classes, without the brackets).
WS = r"\s\x1c-\x1f\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
CONTROL = r"\x00-\x08\x0b\x0c\x0e-\x1f"

# What may be white space other than U+0020 or a control character; all of WS and CONTROL but the space is in it.
NOT_PLAIN = r"[^ -~\u00A1-\u167F\u3001-\uFFFF]"

# Soft hyphen, zero-width space, byte-order mark.
SOFT = "\u00ad\u200b\ufeff"

# Latin ligatures and the long s.
LIGATURES = (
    ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"),
    ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ſ", "s"),
)

# Ranges of CJK characters, for joining lines and for squeezing spaces.
CJK = (
    "\u2e80-\u303f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
    "\uf900-\ufaff\ufe30-\ufe4f\uff00-\uff60\uffe0-\uffe6"
)
CJK_EDGE = (
    "\u3000-\u303f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
    "\uf900-\ufaff\ufe30-\ufe4f\uff00-\uff60\uffe0-\uffe6"
    "\u2010-\u2015\u2025\u2026\u2500-\u257f"
)

# Kana and kanji ranges.
HIRAGANA = "\u3041-\u309f"
KATAKANA = "\u30a1-\u30f6"
KANA = HIRAGANA + KATAKANA
KANJI = r"㐀-䶿一-鿿豈-﫿"

# Where a document part belongs, by path and then by title; the first match counts.
MATTER_PATHS = (
    ("back", r"allcover|backcover|back-cover|裏表紙|裏表纸"),
    ("cover", r"(^|[/_\-])cover|hyoshi|表紙|表纸"),
    ("toc", r"(^|[/_\-])(toc|contents)|目次|もくじ"),
    ("colophon", r"colophon|okuzuke|奥付|奥附"),
    ("promo", r"bookwalker|promo|advert|広告|試し読み|chirashi"),
    ("afterword", r"afterword|あとがき|後書き|後記|解説|atsugaki"),
    ("front", r"fmatter|front[-_]?matter|titlepage|title[-_]?page|扉|口絵|くちえ|kuchie"),
)
MATTER_TITLES = (
    ("back", r"裏表紙|裏表纸"),
    ("cover", r"^表紙$|^表纸$|^cover$"),
    ("toc", r"^目次$|^contents$|^もくじ$|^目次・"),
    ("colophon", r"^奥付$|^奥附$|colophon"),
    ("afterword", r"あとがき|後書き|後記|^解説$"),
    ("front", r"^扉$|^口絵$|^まえがき$|^前書き$"),
)
SKIP_MATTER = ("colophon", "promo")
STORY_MATTER = ("main", "afterword")

# Characters that simplified Chinese does not use.
NON_SIMPLIFIED = (
    "們這說時會對應該與學樣麼為國實際發現覺讓從來過開關門問間種見語話讀寫戰軍"
    "隊將領點兒幾頭體認識記號產業務動區醫藥書車馬鳥魚龍風飛長東樂買賣錢銀鐵銅"
    "錯題聽習經歷陽陰燈樹橋樓驚嚇媽愛願夢麗歡溫凍淨準確態總縣鄉萬億豐歲"
    "紅綠藍黃筆紙張亂舊觀覽權議講論誰討謝遠邊靜盡層屬榮嚴寶獻"
    "氷駅沢浜畑峠辻込働榊畠嶋瀬麿凪雫咲"
)

# Term patterns and words that are no terms.
TERM_KATAKANA = r"[ァ-ヶー]{2,12}"
TERM_QUOTED = r"[『「]([^『」]{2,14})[』」]"
TERM_KANJI = r"[一-鿿]{2,4}"
STOP_KATAKANA = (
    "コーヒー", "テーブル", "ドア", "カード", "グループ", "システム", "プログラム", "サービス",
    "エネルギー", "イメージ", "タイミング", "パターン", "レベル", "タイプ", "スタイル", "チーム",
    "メンバー", "パーティー", "ゲーム", "バランス", "スピード", "ダメージ", "スキル", "アイテム",
    "モンスター", "キャラクター", "ストーリー", "シーン", "セリフ", "アニメ", "マンガ", "ラノベ",
    "スマホ", "パソコン", "ネット", "メール", "データ", "ファイル", "フォルダ", "ボタン",
)
STOP_KANJI = (
    "自分", "彼女", "彼等", "彼ら", "俺", "僕", "君", "皆", "何", "誰", "今回", "場合",
    "世界", "時間", "問題", "意味", "人間", "存在", "状態", "内容", "状況", "関係",
    "感じ", "気持", "言葉", "方法", "理由", "結果", "場所", "瞬間", "表情", "視線",
    "一方", "以上", "以下", "現在", "本当", "全部", "普通", "最初", "最後", "自分達",
)

# File-name characters and their full-width forms; the longest stem.
STEM_FROM, STEM_TO = ':?*"<>|', "：？＊＂＜＞｜"
MAX_STEM = 80

# A lone page number.
PAGE_NUMBER = r"^[0-9０-９]{1,4}$|^[ivxlcIVXLC]{1,6}$"

# Thresholds of the quality rules.
MIN_RATIO, MAX_RATIO, MIN_SOURCE = 0.12, 3.0, 6

# Price of a million tokens in and out, by model; the factor at peak times.
PRICES = (("flash", 1.0, 4.0), ("pro", 4.5, 13.5))
PEAK = 2.0

# Class names of headings, vertical writing in style sheets, file names of cover images.
HEAD_CLASS = r"bold|mfont|font-1[0-9]{2}per|title|heading|midashi"
HEAD_LENGTH = 40
VERTICAL = r"writing-mode\s*:\s*vertical|vertical-rl|vertical-lr"
COVER_NAMES = ("cover", "hyoshi", "表紙")
