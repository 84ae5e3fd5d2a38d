"""Measures of text as native expressions: words, scripts, token kinds, characters, lines.

All of it stays in the JVM: one pass of a regular expression per measure, arrays of tokens taken once and
classified by higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code-point ranges of the three scripts, and of punctuation that counts as a character.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{2F800}-\x{2FA1F}\x{30000}-\x{3134F}"
KANA = r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}"
HANGUL = r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{AC00}-\x{D7AF}\x{D7B0}-\x{D7FF}"
CJK = HAN + KANA + HANGUL
PUNCT_BLOCKS = r"\x{3000}-\x{303F}\x{FE10}-\x{FE1F}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}"
CONTEXT_PUNCT = "“”‘’—–…·"
INNER = "'’_./-"
#: White space as a character class that Java and RE2 both read.
SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

TOKEN = rf"[\p{{L}}\p{{N}}&&[^{CJK}]](?:[\p{{L}}\p{{N}}&&[^{CJK}]]|[{INNER}])*"
PUNCT = rf"[\p{{P}}\p{{S}}&&[{PUNCT_BLOCKS}]]|[{CONTEXT_PUNCT}](?=[{CJK}])|(?<=[{CJK}])[{CONTEXT_PUNCT}]"
WORD = rf"[{CJK}]|{TOKEN}|{PUNCT}"
#: Texts without these are measured by the plain token pattern alone.
NEEDS_FULL = rf"[{CJK}{PUNCT_BLOCKS}]"

SCRIPTS = ("latin", "cyrillic", "arabic", "greek", "hebrew", "thai")
_SCRIPT_CLASS = {
    "latin": r"[\p{IsLatin}&&[^ªºʰ-ʸˠ-ˤ]]",
    "cyrillic": r"\p{IsCyrillic}",
    "arabic": r"[\p{IsArabic}\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}]",
    "greek": r"\p{IsGreek}",
    "hebrew": r"\p{IsHebrew}",
    "thai": r"\x{E01}-\x{E7F}",
}


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("bigint")


def han_count(text: Column) -> Column:
    return _count(text, f"[{HAN}]")


def kana_count(text: Column) -> Column:
    return _count(text, f"[{KANA}]")


def hangul_count(text: Column) -> Column:
    return _count(text, f"[{HANGUL}]")


def cjk_count(text: Column) -> Column:
    return _count(text, f"[{CJK}]")


def word_count(text: Column) -> Column:
    """Each Han, kana and hangul character, each run of other letters and digits, each CJK punctuation mark."""
    plain = r"[\p{L}\p{N}][\p{L}\p{N}'’_./-]*"
    return F.when(text.rlike(NEEDS_FULL), _count(text, WORD)).otherwise(_count(text, plain))


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1), F.array().cast("array<string>"))


def cjk_punct_count(text: Column) -> Column:
    """What the word count has beyond characters and tokens."""
    return word_count(text) - cjk_count(text) - F.size(tokens(text))


def token_kind(token: Column) -> Column:
    """number, latin, mixed (latin and digits), another single script, or other."""
    kind = F.when(~token.rlike(r"\p{L}"), "number")
    for script in SCRIPTS:
        cls = _SCRIPT_CLASS[script]
        only = token.rlike(rf"^(?:{cls if cls.startswith(('[', chr(92) + 'p')) else '[' + cls + ']'}|[^\p{{L}}])+$")
        kind = kind.when(only, F.when(token.rlike(r"\p{N}"), "mixed").otherwise("latin") if script == "latin" else script)
    return kind.otherwise("other")


def token_kinds(text: Column) -> Column:
    return F.transform(tokens(text), token_kind)


def of_kind(kinds: Column, *names: str) -> Column:
    return F.size(F.filter(kinds, lambda k: k.isin(*names))).cast("bigint")


def chars(text: Column) -> Column:
    return F.length(text).cast("bigint")


def chars_no_space(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{SPACE}]", "")).cast("bigint")


def meaningful_chars(text: Column) -> Column:
    """Characters that are neither white space nor format characters."""
    return F.length(F.regexp_replace(text, rf"[{SPACE}\p{{Cf}}]", "")).cast("bigint")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def line_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x.rlike(f"[^{SPACE}]"))).cast("bigint")


def paragraph_count(text: Column) -> Column:
    """Blocks between blank lines; a text with one block counts its lines."""
    lean = strip(text)
    blocks = F.size(F.filter(F.split(lean, rf"(?:\r?\n[{SPACE}]*){{2,}}"), lambda x: x.rlike(f"[^{SPACE}]")))
    return F.when(F.length(lean) == 0, F.lit(0)).when(blocks > 1, blocks).otherwise(line_count(lean)).cast("bigint")


def preview(text: Column, length: int) -> Column:
    return F.substring(strip(F.regexp_replace(text, f"[{SPACE}]+", " ")), 1, length)


def timeline_units(text: Column) -> Column:
    """Width of a text on a time line: two for CJK, one for any other visible character."""
    return chars_no_space(text) + cjk_count(F.regexp_replace(text, f"[{SPACE}]", ""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: lambda variables of higher-order functions aren't inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dominant_chars(text: Column, which: str) -> Column:
    """``struct<no_spaces, with_spaces>`` of the segments, between tabs and line ends, that a script dominates.

    ``cjk``: as many CJK characters as words that are no numbers; ``latin``: more Latin words than the rest.
    Separators count where the segments on both sides do.
    """
    segments = F.split(text, r"[\t\r\n]+", -1)
    separators = F.transform(F.regexp_extract_all(text, F.lit(r"([\t\r\n]+)"), 1), F.length)

    def chosen(seg: Column) -> Column:
        cjk = cjk_count(seg)
        if which == "cjk":
            # words are looked at only where there is a CJK character
            return F.when(cjk == 0, False).otherwise(cjk >= F.size(F.filter(token_kinds(seg), lambda k: k != "number")))
        return F.when(~seg.rlike(r"\p{IsLatin}"), False).otherwise(
            let(token_kinds(seg), lambda kinds: of_kind(kinds, "latin", "mixed") > cjk + F.size(F.filter(kinds, lambda k: ~k.isin("latin", "mixed", "number"))))
        )

    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)

    def measured(picked: Column) -> Column:
        pairs = F.arrays_zip(segments.alias("s"), picked.alias("p"))
        inner = total(F.transform(pairs, lambda x: F.when(x["p"], F.length(x["s"])).otherwise(0).cast("bigint")))
        lean = total(F.transform(pairs, lambda x: F.when(x["p"], chars_no_space(x["s"])).otherwise(0).cast("bigint")))
        between = total(F.transform(separators, lambda n, i: F.when(F.element_at(picked, (i + 1).cast("int")) & F.element_at(picked, (i + 2).cast("int")), n).otherwise(0).cast("bigint")))
        return F.struct(lean.alias("no_spaces"), (inner + between).alias("with_spaces"))

    return let(F.transform(segments, chosen), measured)


# What one unit of a language is.
LANGUAGE_UNITS = {
    "zh": r"[\x{4e00}-\x{9fa5}]",
    "ja": r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FAF}]",
    "ko": r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]",
    "ar": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]+",
    "en": "a-zA-Z",
    "es": "a-zA-ZáéíóúüñÁÉÍÓÚÜÑ",
    "pt": "a-zA-ZáéíóúâêôãõçÁÉÍÓÚÂÊÔÃÕÇ",
    "ru": "а-яА-ЯёЁ",
    "fr": "a-zA-ZàâäéèêëïîôùûüÿœæçÀÂÄÉÈÊËÏÎÔÙÛÜŸŒÆÇ",
    "pl": "a-zA-ZąćęłńóśźżĄĆĘŁŃÓŚŹŻ",
    "it": "a-zA-ZàèéìíîòóùúÀÈÉÌÍÎÒÓÙÚ",
    "de": "a-zA-ZäöüßÄÖÜ",
}


def language_units(text: Column, lang: str) -> Column:
    """Characters of a language written without spaces, else whole words of its alphabet."""
    unit = LANGUAGE_UNITS[lang]
    if unit.startswith("["):
        return _count(text, unit)
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}\p{Mn}_]+)"), 1)
    return F.coalesce(F.size(F.filter(runs, lambda w: w.rlike(f"^[{unit}]+$"))), F.lit(0)).cast("bigint")


_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{200B}-\x{200D}\x{FEFF}]"


def normalize_text(text: Column) -> Column:
    """Invisible characters to blanks, blanks squeezed, none before punctuation or at the ends."""
    lean = F.regexp_replace(F.regexp_replace(text, _CONTROL, " "), f"[{SPACE}]+", " ")
    return strip(F.regexp_replace(lean, rf"[{SPACE}]+([。！？!?.,，、；;：:）)\]}}])", "$1"))
