"""Fixed values of the corpus format: tokens, markers, patterns and replacement lists."""

# --- Fixed values: special tokens -----------------------------------------------------
MISSING = "#MISSING#"
ELLIPSIS = "..."
NEWLINE = "\n"
UNK = "<unk>"
PAD = "<pad>"

# marker while cleaning -> token in the finished text
MARKER_TO_TOKEN = [
    ("#MISSING#", "..."),
    ("#SURFACE#", "<SURFACE>"),
    ("#COLUMN#", "<COLUMN>"),
    ("#BLANK_SPACE#", "<BLANK_SPACE>"),
    ("#RULING#", "<RULING>"),
]

LAYOUT_TOKENS = ["<SURFACE>", "<COLUMN>", "<BLANK_SPACE>", "<RULING>"]

# tokens that do not count as content
CLEAN_TOKENS = ["..."] + LAYOUT_TOKENS + ["\n"]

# wordforms that pass the sign lookup unchanged
PASS_THROUGH = LAYOUT_TOKENS + ["...", "\n", "<unk>"]

# vocabulary ids 0..10, in this order
VOCAB_SPECIALS = [
    "<s>", "<pad>", "</s>", "<unk>", "<mask>", "\n",
    "<SURFACE>", "<COLUMN>", "<BLANK_SPACE>", "<RULING>", "...",
]
BOS_ID, PAD_ID, EOS_ID, UNK_ID, MASK_ID = 0, 1, 2, 3, 4
IGNORE_LABEL = -100

# --- Fixed values: corpus filters and category names -----------------------------------
KEPT_LANGUAGES = ["Sumerian", ""]
DROPPED_LANG_MARK = "akk"
DROPPED_PERIODS = ["Ebla", "fake", "Pre-Uruk V"]
DROPPED_GENRES = ["fake (modern)"]
PERIOD_NAMES = [("", "Unknown"), ("Uncertain", "Unknown")]
GENRE_NAMES = [
    ("", "Unknown"),
    ("uncertain", "Unknown"),
    ("Royal/Monumental", "Royal Inscription"),
    ("Royal Inscription", "Royal Inscription"),
    ("Lexical; School", "Lexical"),
    ("Lexical", "Lexical"),
    ("Liturgy", "Liturgy"),
    ("Ritual", "Liturgy"),
    ("Hymn-Prayer", "Liturgy"),
    ("Mathematical", "Math/Science"),
    ("Scientific", "Math/Science"),
    ("Astronomical", "Math/Science"),
]

# --- Fixed values: markers that must be gone after a cleaning step ---------------------
DISALLOWED = {
    "easy": ["<<", ">>", "⸢", "⸣", "{{", "}}"],
    "enclosure": ["<", ">", "(-", "-)", "{-", "-}"],
    "missing": ["[", "]", "$", "..."],
}
DISALLOWED["final"] = (
    DISALLOWED["easy"] + DISALLOWED["enclosure"] + DISALLOWED["missing"]
    + [" " + MISSING, MISSING + " ", "\n ", " \n", "  "]
)

# --- Fixed values: damage notes that count as missing text -----------------------------
DAMAGE_NOTES = [
    "$ traces $", "($erasure$)", "$erasure$",
    "$AN", "$MU", "$UŠ", "$KID", "$DI", "$GA₂", "$HAR",
]
ILLEGIBLE = ["x", "o", "n", "X", "O", "N"]

# --- Fixed values: single-text corrections (step, id, find, replacement) ----------------
TEXT_FIXES = [
    ("unmatched", "P343022", " [x x x\n", MISSING + "\n"),
    ("enclosure", "P324221", "[ma-da za-ab-ša-li{<ki]>}", "[ma-da za-ab-ša-li<{ki}>]"),
    ("illegible", "P010855", "x:ur", "ur" + MISSING),
    ("illegible", "P278368", "-x/EREN", MISSING),
    ("illegible", "P323466", "|3xAN|", "|AN.AN.AN|"),
    ("illegible", "P467714", "x)", MISSING + ")"),
]

# --- Fixed values: wordforms written as bare numbers -----------------------------------
NUMBER_READINGS = {
    "1/2": "1/2(diš)", "1/3": "1/3(diš)", "1/4": "1/3(iku)", "2/3": "2/3(diš)",
    "5/6": "5/6(diš)",
    "1": "1(diš)", "2": "2(diš)", "3": "3(diš)", "4": "4(diš)", "5": "5(diš)",
    "6": "6(diš)", "7": "7(diš)", "8": "8(diš)", "9": "9(diš)",
    "10": "1(u)", "11": "1(u) 1(diš)", "12": "1(u) 2(diš)", "14": "1(u) 4(diš)",
    "18": "1(u) 8(diš)", "20": "2(u)", "21": "2(u) 1(diš)", "23": "2(u) 3(diš)",
    "24": "2(u) 4(diš)", "25": "2(u) 5(diš)", "30": "3(u)", "36": "3(u) 6(diš)",
    "40": "4(u)", "50": "5(u)", "60": "6(u)", "600": "1(gešʾu)",
    "900": "1(gešʾu) 5(geš₂)", "3600": "1(šarʾu@c)", "36000": "1(šar₂)",
}

# --- Fixed values: ordered literal replacements (later ones see earlier output) ---------
SIGN_LIST_REPLACEMENTS = [
    ("BAU377", "GIŠ"), ("KWU147", "LIL"), ("KWU354", "LUM"), ("KWU636", "KU₄"),
    ("KWU777", "ŠITA"), ("KWU844", "|E₂×AŠ@t|"), ("LAK060", "|UŠ×TAK₄|"),
    ("LAK085", "|SI×TAK₄|"), ("LAK173", "KAD₅"), ("LAK175", "SANGA₂"),
    ("LAK218", "|ZU&ZU.SAR|"), ("LAK449", "|NUNUZ.AB₂|"), ("LAK524", "|ZUM×TUG₂|"),
    ("LAK589", "GISAL"), ("LAK672a", "UŠX"), ("LAK672b", "MUNSUB"),
    ("LAK720", "|LAK648×(PAP.PAP.LU₃)|"), ("LAK769", "|LAGAB×AN|"),
    ("LAK777", "|DAG.KISIM₅×UŠ|"),
]
GLYPH_NAME_REPLACEMENTS = [
    ("(ŠE.1(AŠ))", "(ŠE.AŠ)"), ("(ŠE.2(AŠ))", "(ŠE.AŠ.AŠ)"),
    ("|E₂.BALAG|", "|KID.BALAG|"), ("|SAHAR.DU₆.TAK₄|", "IŠ LAGAR@g TAK₄"),
    ("|ŠE.ŠE|", "ŠE ŠE"),
    ("(EN.ZU-TI.LA.BI-DU₁₁.GA)", "|EN.ZU| TI LA BI KA GA"),
    ("|EN₂.E₂|", "|ŠU₂.AN| E₂"), ("|TAB.BA|", "TAB BA"), ("|GAR.UD|", "GAR UD"),
    ("|NE.DAG|", "NE DAG"), ("|ŠU₂.DUN₃@g@g@s|", "|ŠU₂.DUN₃|"),
    ("BAD₃", "|EZEN×BAD|"), ("BIL₂", "NE@s"), ("DU₈", "DUH"), ("ERIM", "ERIN₂"),
    ("GAG", "KAK"), ("GIN₂", "DUN₃@g"), ("GU₄", "GUD"), ("GUB", "DU"),
    ("ITI", "|UD×(U.U.U)|"), ("MUNUS", "SAL"), ("NIG₂", "GAR"), ("ŠAG₄", "ŠA₃"),
    ("ŠE₃", "EŠ₂"), ("SILA₄", "|GA₂×PA|"), ("SIG₇", "IGI@g"), ("TUR₃", "|NUN.LAGAR|"),
    ("UH₃", "KUŠU₂"), ("U₈", "|LAGAB×(GUD&GUD)|"),
]
READING_WITH_NAME_REPLACEMENTS = [
    ("ad₆ ", "ad₆(|LU₂.LAGAB×U|) "), ("dabₓ(|LAGAB×(GUD&GUD)|)", "dibₓ(|LAGAB×(GUD&GUD)|)"),
    ("erinₓ(KWU896)", "erenₓ(KWU896)"), ("gurₓ(|ŠE.KIN|)še₃", "gurₓ(|ŠE.KIN|)-še₃"),
    ("gurumₓ(|IGI.ERIN₂|)", "gurum₂"), ("ilduₓ(NAGAR)", "nagar"),
    ("itiₓ(|UD@s×BAD|)", "iti₂(|UD@s×BAD|)"), ("itiₓ(|UD@s×TIL|)", "iti₂(|UD@s×BAD|)"),
    ("kuₓ(KU₄)", "ku₄"), ("lumₓ(LUM)", "lum"),
    ("mudₓ(|NUNUZ.AB₂|)", "mud₃(|NUNUZ.AB₂|)"),
    ("sangaₓ(|ŠID.GAR|)", "saŋŋaₓ(|ŠID.GAR|)"), ("šaganₓ(AMA)", "daŋal"),
    ("šitaₓ(ŠITA)", "šita"), ("tabₓ(MAN)", "tab₄"),
    ("umbinₓ(|UR₂×KID₂|)", "umbin(|UR₂×KID₂|)"),
    ("ušurₓ(|LAL₂×TUG₂|)", "ušurₓ(|LAL₂.TUG₂|)"), ("ugaₓ(NAGA)", "uga₃"),
    ("zeₓ(SIG₇)", "ziₓ(IGI@g)"), ("zeₓ(IGI@g)", "ziₓ(IGI@g)"),
]
READING_REPLACEMENTS = [
    ("babila", "babilim"), ("eri₁₃", "ere₁₃"), ("eriš₂", "ereš₂"),
    ("šu+nigin₂", "šuniŋin"), ("šu+nigin", "šuniŋin"), ("+...", "..."), ("...+", "..."),
    ("@c", ""), ("@t", ""), ("@v", ""), ("@90", ""),
]
FRACTION_REPLACEMENTS = [
    ("1/2(aš)", "1/2"), ("1/3(aš)", "1/3"), ("1/4(aš)", "1/4"), ("2/3(aš)", "2/3"),
    ("5/6(aš)", "5/6"),
]
FINAL_REPLACEMENTS = [
    ("||LAGAB×(GUD&GUD)|+HUL₂|", "|LAGAB×(GUD&GUD)+HUL₂|"),
    ("||EZEN×BAD|.AN|", "|EZEN×BAD.AN|"),
    ("|NINDA₂×(ŠE.2(AŠ@c))|", "|NINDA₂×(ŠE.AŠ.AŠ)|"),
]
SIGN_REPLACEMENTS = (
    SIGN_LIST_REPLACEMENTS + GLYPH_NAME_REPLACEMENTS + READING_WITH_NAME_REPLACEMENTS
    + READING_REPLACEMENTS + FRACTION_REPLACEMENTS + FINAL_REPLACEMENTS
)

# --- Fixed values: sign names swapped just before the glyph lookup ----------------------
NAME_SWAPS = [
    ("UN", "KALAM@g"), ("ŠITA₂", "|ŠITA.GIŠ|"), ("DE₂", "|UMUM×KASKAL|"),
    ("|ŠU₂.3xAN|", "|ŠU₂.3×AN|"), ("|ŠU₂.DUN₃@g@g@s|", "|ŠU₂.DUN₃|"),
    ("LAK212", "|A.TU.GABA.LIŠ|"),
]

# --- Fixed values: annotated-text markers, photo path, sequence sizes --------------------
ATF_LANGUAGE_MARK = "#atf: lang sux"
ATF_TRANSLATION_PREFIX = "#tr.en: "
PHOTO_ID_PATTERN = r"/([A-Z][0-9]+)[_.]"
CHUNK_LEN, CHUNK_OVERLAP = 64, 10
MAX_PAIR_LEN = 256
PAD_LEN = 128
HELD_OUT_GENRE = "Lexical"
MAJORITY_GENRE = "Administrative"
OVERSAMPLING = 10

# --- Fixed values: words that the tables' usual reader takes for null --------------------
NULL_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
