"""Personal information in free text: e-mail addresses, phone and identity numbers, addresses and names.

Detection is by formats, the words around them and, for names, by inventories: the roster of known people
for Latin script, and family and given names in Han and kana script that are learned from the whole table
by the places where only a name can stand. Every find becomes a typed placeholder.

Method of the placeholders: format-preserving Feistel pseudonyms, made in the same pass that finds. Every place of a
number has an alphabet (digits, capital letters, a few digits at the head of a phone number); the value is permuted under a
key among all values of its format. Country codes, trunk zeros and punctuation stay. A date inside an identity number
becomes a date; numbers whose check digit is right get one that is right, others one that is wrong by as much. So
equal values have equal pseudonyms in all documents, different ones never, and only the key reads them back
(:func:`reveal`); names, streets and mailboxes get a keyed tag.

Defined results: null and empty texts give no find and come out as they are; of overlapping finds the
e-mail wins, then address, identity number, phone, person; repeated documents give the same finds.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROSTER = 100_000
#: Learned parts of names travel to the workers up to this many (some 50 MB); more are refused, not cut.
MOST_PARTS = 2_000_000
#: A part that ends in a part seen this many times as often is that part with something before it.
GLUED = 5
#: No word that tells what a number is, with what may stand after it, is longer (tested); text before it can't change a find.
CUE_REACH = 48

# --- widths -------------------------------------------------------------------------------------------

#: Full-width ASCII to ASCII, one character to one, so offsets stay.
_WIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2012: 0x2D, 0x2013: 0x2D, 0x2212: 0x2D}

# --- e-mail -------------------------------------------------------------------------------------------

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_+-])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,60}[A-Za-z0-9])?"
_DOT = r"(?:\.|[ ]?[\[(]dot[\])][ ]?|[ ]dot[ ])"
_EMAIL = re.compile(
    rf"(?i)(?<![A-Za-z0-9._%+-]){_LOCAL}(?:[ ]?@[ ]?|[ ]?[\[(](?:at|@)[\])][ ]?){_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9._%+-]){_LOCAL}[ ]at[ ]{_LABEL}(?:[ ]?[\[(]dot[\])][ ]?{_LABEL}|[ ]dot[ ]{_LABEL})+(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9]+[._+][A-Za-z0-9._+-]*[A-Za-z0-9][ ]at[ ]{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,24}}(?![A-Za-z0-9])"
)

# --- addresses ----------------------------------------------------------------------------------------

_H = "[㐀-鿿々〆]"
_EN_KIND = r"(?:Street|St\.|St|Road|Rd\.|Rd|Lane|Ln\.|Ln|Avenue|Ave\.|Ave|Drive|Dr\.|Row|Close|Way|Court|Ct\.|Square|Sq\.|Place|Pl\.|Terrace|Crescent|Boulevard|Blvd\.|Blvd|Walk|Hill|Gardens|Parade|Mews|Yard|Park|Quay|Wharf|Circle|Highway|Hwy\.?|Parkway|Green|Grove)"
_EN_UNIT = r"(?:Flat|Apartment|Apt\.?|Suite|Ste\.?|Unit|Room|Rm\.?|Floor|Fl\.?|#)\s?\w{1,6}"
_EN_ZIP = r"(?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d{1,2}[A-Z]?[ ]\d[A-Z]{2})"
_EN_CITY = r"(?!(?:Tel|Phone|Fax|Mobile|Mail|The|Suite|Flat|Apt)\b)[A-Z][a-z]+(?:[ ][A-Z][a-z]+)?"
_EN_TOWN = rf"(?:(?:,[ ]?{_EN_UNIT})?(?:(?:,[ ]?|[ ]?\r?\n[ ]*){_EN_CITY}(?:,?[ ](?:[A-Z]{{2}}[ ])?{_EN_ZIP})|,[ ]?{_EN_CITY})?)"
_EN_ADDRESS = re.compile(
    rf"(?:{_EN_UNIT},[ ]?)?(?<![\w.,-])\d{{1,5}}[A-Za-z]?,?[ ](?:[A-Z][a-z']+[ ]){{1,3}}{_EN_KIND}(?![A-Za-z]){_EN_TOWN}"
    rf"|(?i:\bP\.?[ ]?O\.?[ ]?Box)[ ]\d{{1,6}}{_EN_TOWN}"
)
_DE_ADDRESS = re.compile(
    r"(?:(?:Am|An der|An den|Alte[rns]?|Neue[rns]?|Zum|Zur|Im|In der|Auf dem|Auf der|Unter den|Große|Kleine|Obere|Untere)[ ])?[A-ZÄÖÜ][A-Za-zÄÖÜäöüß-]*"
    r"(?:[sS]tra(?:ß|ss)e|[sS]tr\.|gasse|weg|kamp|allee|[pP]latz|ring|damm|ufer|graben|steig|markt|chaussee|berg|hof|wall|pfad|stieg|zeile)"
    r"[ ]\d{1,4}(?:[ ]?[a-z])?(?![\w]|[.,]\d)(?:(?:,[ ]?|[ ]?\r?\n[ ]*)(?:D-)?\d{5}[ ][A-ZÄÖÜ][a-zäöüß]+(?:[ -][A-ZÄÖÜ][a-zäöüß]+)?)?"
    r"|\bPostfach[ ]\d[\d ]{1,8}\d(?:(?:,[ ]?|[ ]?\r?\n[ ]*)(?:D-)?\d{5}[ ][A-ZÄÖÜ][a-zäöüß]+)?"
)
#: What an address can't lack; tells quickly that a text has none.
_EN_HINT = re.compile(rf"[ ]{_EN_KIND}|(?i:P\.?[ ]?O\.?[ ]?Box)")
_DE_HINT = re.compile(r"(?:(?:[sS]tra(?:ß|ss)e|[sS]tr\.|gasse|weg|kamp|allee|[pP]latz|ring|damm|ufer|graben|steig|markt|chaussee|berg|hof|wall|pfad|stieg|zeile)|Postfach)[ ]\d")
_ZH_STREET = rf"(?:(?:(?<=[至为居在于到往是：:，,、；;（(\s])|(?<![㐀-鿿])){_H}{{2,4}}|{_H}{{2}})"
_ZH_ADDRESS = re.compile(
    rf"(?:{_H}{{2,3}}省\s?)?{_ZH_STREET}市\s?(?:{_H}{{1,4}}[区县镇乡]\s?)?{_H}{{1,8}}?(?:大道|路|街|巷|弄|道|胡同)\s?(?:\d{{1,5}}弄)?\d{{1,5}}号"
    rf"(?:[ ]?\r?\n?[ ]?(?:\d{{1,5}}(?:号楼|栋|幢|座|单元|层|楼|室)|{_H}{{2,6}}(?:大厦|广场|中心|小区|公寓|花园|大楼|苑)))*(?:\d{{1,5}}(?![\d号年月日]))?"
)
#: Words that lead to an address and aren't part of it.
_ZH_LEAD = re.compile("(?:(?:现居|现住|居住|家住|住在|寄至|寄到|送至|位于|地址|住址)[在于为是]?)?")
_JA_ADDRESS = re.compile(
    rf"(?:〒?\d{{3}}-\d{{4}}\s?)?(?:{_H}{{2,3}}[都道府県])?(?:(?<=[はがにをへで：:、。（(\s])|(?<![㐀-鿿])|(?<=住所)|(?<=\d)){_H}{{1,4}}[市郡](?:{_H}{{1,4}}[区町村])?[㐀-鿿々ぁ-んァ-ヶー]{{1,8}}?"
    rf"\d{{1,4}}(?:丁目\s?\d{{1,4}})?(?:番地?\s?\d{{0,4}}|-\d{{1,4}}){{0,3}}号?(?:[ \n]?[㐀-鿿々ァ-ヶー]{{1,10}}(?:荘|ビル|マンション|ハイツ|コーポ|アパート|館|寮)\s?(?:\d{{1,4}}(?:号室|階)?)?)?"
)

# --- numbers ------------------------------------------------------------------------------------------

#: Words before a number that tell what it is; the nearest one decides.
_ID_CUE = re.compile(
    r"(?i)(?:\bSSN|\bID(?:[ ]?(?:no\.?|number|card))?|passport[ ]?(?:no\.?|number)?|national insurance(?: number| no\.?)?|driving licen[cs]e(?: no\.?)?|social security(?: number| no\.?)?|tax id"
    r"|Ausweis-?(?:Nr\.?|nummer)|Steuer-?(?:ID|Nr\.?|nummer)|Reisepass(?:-?Nr\.?)?|Personalausweis(?:-?Nr\.?)?|Passnummer|Pass-?Nr\.?"
    r"|证件号码?|身份证(?:号码?)?|护照(?:号码?)?|驾驶证号|社保号|税号|旅券番号|パスポート番号|マイナンバー|個人番号|免許証番号|様の番号(?:は)?|さんの番号(?:は)?|身分証(?:番号)?)[ ]?[:：.は是为]?\s{0,2}$"
)
_PHONE_CUE = re.compile(
    r"(?i)(?:\b(?:tel|phone|fax|mobile|cell|call|text|mobil|telefon|handy|reach me on|whatsapp)\b\.?|电话|手机(?:是|号)?|微信同号|微信|传真|座机|電話(?:番号)?|携帯|致电)[ ]?[:：.是为は]?[（(]?\s{0,2}$"
)
_NOT_CUE = re.compile(
    r"(?i)(?:\b(?:order|tracking|invoice|job|part|account|case|file|docket|ref|isbn|norm|auftrag|rechnung|parcel|article|serial|batch|step|total|lot)(?:[ ](?:no|nr|code|number|total|numbers?)\.?)?"
    r"|\b(?:EN|ISO|DIN|QB/T|GB/T|GB|HX|INV|RE|ISBN)[- ]?|订单号|运单|批次|发票|标准|编号|案号|注文番号|追跡番号|請求書|規格|Sendungsnummer|-Nr\. der Sendung)[ ]?[:：.は]?[-# ]{0,2}$"
)
_EXT = r"(?:[ ]?(?:,[ ]?)?(?:ext\.?|x|extension|Durchwahl|转|内線)[ ]?\d{1,5})?"
_PHONE_FORMS = tuple(
    re.compile(rf"(?<![\w.+/-]){p}{_EXT}(?![\w]|-\d|\.\d)", re.A)
    for p in (
        r"\+\d{1,3}[ .-]?\(0\)[ .-]?\d{1,5}(?:[ .-]?\d{2,10}){1,4}",
        r"\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?)(?:[ .-]?\d{2,8}){1,4}",
        r"00\d{9,14}",
        r"00\d{2}(?:[ .-]\d{2,5}){2,5}",
        r"1[-. ]\d{3}[-. ]\d{3}[-. ]\d{4}",
        r"\(\d{2,5}\)[ ]?\d{2,8}(?:[-. ]\d{2,5}){0,2}",
        r"\d{3}[-. ]\d{3}[-. ]\d{4}",
        r"07\d{3}[ ]?\d{3}[ ]?\d{3}",
        r"020[ ]\d{4}[ ]\d{4}",
        r"0\d{2,4}[ /-]\d{5,8}(?:[ -]\d{2,5})?",
        r"0\d{1,4}-\d{1,4}-\d{4}",
        r"0\d{2}[ -]\d{4}[ -]\d{4}",
        r"1[3-9]\d[- ]?\d{4}[- ]?\d{4}",
        r"\d{4}-\d{8}",
        r"\d{3}-\d{4}-\d{4}",
        r"\d{4}-\d{4}-\d{4}",
    )
)
_PHONE_ANY = re.compile(rf"(?:\+?\(?\d[\d ().-]{{5,22}}\d){_EXT}", re.A)
_ID_FORMS = tuple(
    re.compile(rf"(?<![\w/-]){p}(?![\w]|-\d)", re.A)
    for p in (
        r"[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-D]",
        r"\d{6}[ -]?(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ -]?\d{3}[\dXx]",
        r"\d{2}[ ]?\d{6}[ ]?[A-Z][ ]?\d{3}",
        r"\d{3}[- ]\d{2}[- ]\d{4}",
        r"\d{4}[ -]\d{4}[ -]\d{4}",
        r"\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}",
        r"[A-Z]{1,2}[ ]?\d{7,9}",
        r"(?=[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{8,12}",
        r"\d{6,18}[Xx]?",
    )
)
#: Forms that need no word before them.
_ID_SURE = 2
_NUMBER = re.compile(r"(?<![A-Za-z0-9@_.])[+(]?(?:[A-Z]{1,2}[ ]?)?\d[\dA-Z ().+-]{4,30}", re.A)
_DIGITS = re.compile(r"\d")

# --- names --------------------------------------------------------------------------------------------

#: Edges of a Latin name; Han and kana may stand right beside it.
_LEFT, _RIGHT = r"(?<![A-Za-z0-9À-ɏ_.@+-])", r"(?![A-Za-z0-9À-ɏ_@+-]|\.[A-Za-z0-9])"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Sir|Madam|Mme)\.?"
_TITLE_LEFT = re.compile(rf"\b{_TITLE}[ ]$")
_WORD = re.compile(r"[A-Za-zÀ-ɏ]+")
#: One initial, and two.
_INITIALS = tuple(re.compile(rf"(?:(?<![A-Za-zÀ-ɏ])[A-Za-z]\.[ ]?){{0,{n}}}$") for n in (1, 2))
_CAP = r"[A-Z][a-z]+(?:[A-Z][a-z]+)?"
_TITLED = re.compile(rf"\b{_TITLE}[ ]((?:[A-Z]\.[ ])?{_CAP}(?:-{_CAP})?(?:[ ](?:[A-Z]\.[ ])?{_CAP}(?:-{_CAP})?)?(?:,[ ]{_CAP})?)(?![A-Za-z])")
#: Places where a Chinese name stands.
_ZH_CUES = tuple(
    re.compile(p)
    for p in (
        rf"(?:申请人|联系人|收件人|经办人|姓名|当事人|法定代表人|监护人|负责人|持证人)[ \t]?[:：\t]\s?({_H}{{2,4}})(?![㐀-鿿])",
        rf"收件人({_H}{{2,3}})(?=[。，；\s])",
        rf"经办人({_H}{{2,3}}?)(?=签字|签名|签署|盖章)",
        rf"兹证明({_H}{{2,3}}?)(?=[（(，]|系|是)",
        rf"请联系({_H}{{2,3}}?)(?=[，,。；]|先生|女士)",
        rf"本人({_H}{{2,3}}?)(?=[，,])",
        rf"(?:^|[。！？；，：:\n\s])({_H}{{2,3}}?)(?=先生|女士|小姐)",
    )
)
_SENDER = re.compile(rf"(?m)^[ \t]*({_H}{{2,4}}(?:[ 　]{{0,2}}{_H}{{1,3}})?)[ ]?[:：](?!//)")
_NOT_SENDER = re.compile(r"^(?:客服|住址|住所|電話|电话|申请人|氏名|警告|姓名|证件号码|传真|邮箱|地址|備考|备注|附件|别紙|別紙|总则|総則|注意|日期|时间|主题|主旨|抄送|收件人|发件人|联系人|收款人|编号|名称|登记号|登録番号|手機|手机|微信|単位|单位|内容|步骤|手順|结论|結論|案号|批次|订单号|运单|資料|担当|宛先|件名)$")
_JA_CUES = tuple(
    re.compile(p)
    for p in (
        rf"(?:氏名|名前|担当者|宛名|申請者|連絡先)[ \t]?[:：\t]\s?({_H}{{1,4}}[ 　]{{1,2}}{_H}{{1,3}})(?![㐀-鿿])",
        rf"担当の({_H}{{1,4}}[ 　]{{1,2}}{_H}{{1,3}})(?=が|は|です|と)",
        rf"({_H}{{1,4}}[ 　]{{1,2}}{_H}{{1,3}})(?=様|さん|氏|先生)",
    )
)
_JA_WHOLE = tuple(
    re.compile(p)
    for p in (
        rf"(?:氏名|名前|担当者|宛名|申請者)[ \t]?[:：\t]\s?({_H}{{2,7}})(?![㐀-鿿])",
        rf"担当の({_H}{{2,7}}?)(?=が|は|です|と)",
        rf"(?:^|[。！？、：:\n\s「])({_H}{{2,7}})(?=様の|さんから|さんが|様が|様へ)",
        rf"(?:^|[。！？\n])({_H}{{2,7}})(?=さんは)",
    )
)
_KANA = re.compile("[぀-ヿ]")
#: A text is read as Japanese, too, where it has kana or a word of its forms.
_JA_HINT = re.compile("[぀-ヿ]|氏名|住所|電話|号室|丁目|〒|様")


@dataclass
class Inventory:
    """What names are made of."""

    roster: list[tuple[str, str]] = field(default_factory=list)
    zh_family: frozenset[str] = frozenset()
    zh_given: frozenset[str] = frozenset()
    ja_family: frozenset[str] = frozenset()
    ja_given: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        given = sorted({re.escape(g) for g, _ in self.roster if g}, key=len, reverse=True)
        family = sorted({re.escape(f) for _, f in self.roster if f}, key=len, reverse=True)
        self.latin = self.single = None
        if given and family:
            self.words = {w.lower() for g, f in self.roster for x in (g, f) for w in _WORD.findall(x)}
            n, f = "(?:" + "|".join(dict.fromkeys([*given, *family])) + ")", "(?:" + "|".join(family) + ")"
            one = rf"{n}(?:-{n})?"
            self.latin = re.compile(rf"(?i){_LEFT}(?:{one},[ ]?(?:{n}(?:[ ][A-Z]\.)?|[A-Z]\.)(?![A-Za-z-])|{n}[ ](?:[A-Z]\.[ ]?){{0,2}}{one}|[A-Z]\.[ ]?(?:[A-Z]\.[ ]?)?{f}(?:-{f})?|{n}-{n}){_RIGHT}")
            self.single = re.compile(rf"{_LEFT}(?:{n}|{n.upper()}){_RIGHT}")
            self.sender = re.compile(rf"(?im)^[ \t]*({one})[ ]?(?=[:：])")
        self.zh = re.compile(rf"[{''.join(sorted(self.zh_family))}][{''.join(sorted(self.zh_given))}]{{1,2}}") if self.zh_family and self.zh_given else None
        self.heads = {k: _by_head(v) for k, v in (("family", self.ja_family), ("given", self.ja_given))}
        self.ja_first = re.compile("[" + "".join(sorted({w[0] for w in self.ja_family | self.ja_given})) + "]") if self.ja_family else None

    def ja(self, text: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
        """A family name with a given name or a form of address behind it, or a given name with one."""
        if self.ja_first is None:
            return
        end, busy = len(text) if end is None else min(end, len(text)), start
        for m in self.ja_first.finditer(text, start, end):
            if m.start() >= busy and (stop := self._ja_at(text, m.start(), end)):
                yield m.start(), stop
                busy = stop

    def _ja_at(self, text: str, at: int, end: int) -> int:
        given = self.heads["given"]
        for name in self.heads["family"].get(text[at], ()):
            if text.startswith(name, at, end):
                stop = gap = at + len(name)
                while gap < min(stop + 2, end) and text[gap] in " \u3000":
                    gap += 1
                for begin in range(gap, stop - 1, -1):
                    for more in given.get(text[begin : begin + 1], ()):
                        if text.startswith(more, begin, end):
                            return begin + len(more)
                if text.startswith(_CALLED, stop, end):
                    return stop
        if not (at and "㐀" <= text[at - 1] <= "鿿"):
            for name in given.get(text[at], ()):
                if text.startswith(name, at, end) and text.startswith(_CALLED, at + len(name), end):
                    return at + len(name)
        return 0


#: Forms of address behind a Japanese name.
_CALLED = ("さん", "様", "氏")


def _by_head(names: frozenset[str]) -> dict[str, list[str]]:
    """Names by their first character, the longest first."""
    out: dict[str, list[str]] = defaultdict(list)
    for n in sorted(names, key=lambda n: (-len(n), n)):
        out[n[0]].append(n)
    return dict(out)


def _names_zh(text: str) -> Iterator[tuple[int, int]]:
    for cue in _ZH_CUES:
        for m in cue.finditer(text):
            yield m.span(1)


def learn_parts(text: str) -> Iterator[tuple[str, str]]:
    """Parts of names that stand where only names can."""
    if _KANA.search(text):
        for cue in (*_JA_CUES, _SENDER):
            for m in cue.finditer(text):
                parts = re.split("[ 　]+", m.group(1))
                if len(parts) == 2 and not _NOT_SENDER.match(m.group(1)):
                    yield "ja_family", parts[0]
                    yield "ja_given", parts[1]
        return
    for a, b in _names_zh(text):
        name = text[a:b]
        if 2 <= len(name) <= 3:
            yield "zh_family", name[0]
            for c in name[1:]:
                yield "zh_given", c


def learn_inventory(documents: DataFrame, text: str, roster: DataFrame) -> Inventory:
    """Inventories of the whole table; the counts are combined before the shuffle, only common parts come back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for t in batch["t"]:
                if t:
                    counts.update(learn_parts(t))
            yield pd.DataFrame([(k, p, n) for (k, p), n in counts.items()], columns=["kind", "part", "n"])

    seen = documents.select(F.col(text).alias("t")).filter(F.col("t").rlike("[㐀-鿿]")).mapInPandas(run, "kind string, part string, n bigint")
    kept = seen.groupBy("kind", "part").agg(F.sum("n").alias("n")).limit(MOST_PARTS + 1).collect()
    if len(kept) > MOST_PARTS:
        raise ValueError(f"the texts hold more than {MOST_PARTS} parts of names")
    parts: dict[str, dict[str, int]] = {}
    for r in kept:
        parts.setdefault(r["kind"], {})[r["part"]] = r["n"]
    family = parts.get("ja_family", {})
    parts["ja_family"] = {p: n for p, n in family.items() if not any(family.get(p[i:], 0) >= GLUED * n for i in range(1, len(p)))}
    people = roster.select("given_name", "family_name").limit(MOST_ROSTER + 1).collect()
    if len(people) > MOST_ROSTER:
        raise ValueError(f"the roster has more than {MOST_ROSTER} rows")
    return Inventory(
        [(r[0] or "", r[1] or "") for r in people],
        frozenset(parts.get("zh_family", {})),
        frozenset(parts.get("zh_given", {})),
        frozenset(parts.get("ja_family", {})),
        frozenset(parts.get("ja_given", {})),
    )


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low = text
    if "@" in low or re.search(r"(?i)[\[(]at[\])]| at ", low):
        for m in _EMAIL.finditer(low):
            yield m.span()


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    if _EN_HINT.search(text):
        for m in _EN_ADDRESS.finditer(text):
            yield m.span()
    if _DE_HINT.search(text):
        for m in _DE_ADDRESS.finditer(text):
            yield m.span()
    if "号" in text:
        for m in _ZH_ADDRESS.finditer(text):
            yield m.start() + len(_ZH_LEAD.match(m.group()).group()), m.end()
    if _JA_HINT.search(text) and re.search("[市郡]", text):
        for m in _JA_ADDRESS.finditer(text):
            yield m.start() + len(_ZH_LEAD.match(m.group()).group()), m.end()


def _numbers(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """Identity and phone numbers: the word before decides, else the form."""
    busy = 0
    for m in _NUMBER.finditer(text):
        at = m.start()
        if len(_DIGITS.findall(m.group())) < 6:
            continue
        while at < m.end():
            if at < busy:
                at = busy
                continue
            c = text[at]
            if not (c in "+(" or c.isdigit() or "A" <= c <= "Z") or (at and (text[at - 1].isdigit() or text[at - 1].isascii() and text[at - 1].isalpha())):
                at += 1
                continue
            if any(a <= at < b for a, b in taken):
                at += 1
                continue
            before = text[max(0, at - CUE_REACH) : at]
            found = None
            if _NOT_CUE.search(before):
                skip = re.compile(r"[\dA-Za-z][\dA-Za-z-]*", re.A).match(text, at)
                at = skip.end() if skip else at + 1
                continue
            if _ID_CUE.search(before):
                for form in _ID_FORMS:
                    if x := form.match(text, at):
                        found = ("id_number", at, x.end())
                        break
            elif _PHONE_CUE.search(before):
                for form in _PHONE_FORMS:
                    if x := form.match(text, at):
                        found = ("phone", at, x.end())
                        break
                if found is None and (x := _PHONE_ANY.match(text, at)) and not re.match(r"\d+\.\d\d(?!\d)", x.group()) and 7 <= len(_DIGITS.findall(x.group())) <= 15 and not re.match(r"\d{4}-\d\d-\d\d\b", x.group()):
                    found = ("phone", at, x.end())
            if found is None:
                for form in _ID_FORMS[:_ID_SURE]:
                    if x := form.match(text, at):
                        found = ("id_number", at, x.end())
                        break
            if found is None:
                for form in _PHONE_FORMS:
                    if (x := form.match(text, at)) and not _date_like(x.group()):
                        found = ("phone", at, x.end())
                        break
            if found:
                yield found
                busy = at = found[2]
            else:
                skip = re.compile(r"[\dA-Za-z]+", re.A).match(text, at)
                at = skip.end() if skip else at + 1


def _date_like(text: str) -> bool:
    return bool(re.match(r"(?:19|20)\d{2}[-./]\d{1,2}[-./]\d{1,2}\b", text))


def _persons(text: str, inventory: Inventory) -> Iterator[tuple[int, int]]:
    if inventory.latin is not None:
        for word in _WORD.finditer(text):
            if word.group().lower() not in inventory.words:
                continue
            at = word.start()
            before = text[max(0, at - 8) : at]
            for start in {at, *(at - len(p.search(before).group()) for p in _INITIALS)}:
                if m := inventory.latin.match(text, start):
                    yield m.span()
            if (m := inventory.single.match(text, at)) and _TITLE_LEFT.search(text[max(0, at - 8) : at]):
                yield m.span()
            line = text.rfind("\n", 0, at) + 1
            if not text[line:at].strip() and (m := inventory.sender.match(text, line)):
                yield m.span(1)
    for m in _TITLED.finditer(text):
        yield m.span(1)
    if not re.search("[㐀-鿿]", text):
        return
    if _JA_HINT.search(text):
        yield from inventory.ja(text)
        for cue in (*_JA_CUES, *_JA_WHOLE):
            for m in cue.finditer(text):
                a, b = m.span(1)
                yield next((x for x in inventory.ja(text, a, b + 2) if x[1] == b), (a, b))
    for a, b in _names_zh(text):
        yield a, b
    if inventory.zh is not None:
        for m in inventory.zh.finditer(text):
            yield m.span()


def find(text: str | None, inventory: Inventory) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in order, without overlaps."""
    if not text:
        return []
    plain = text if text.isascii() else text.translate(_WIDTH)
    mails = list(_emails(plain))
    places = _lean(_addresses(plain), mails)
    taken = mails + places
    numbers = list(_numbers(plain, taken))
    found = [("email", a, b) for a, b in mails] + [("address", a, b) for a, b in places]
    found += [(k, a, b) for k, a, b in numbers if not any(a < y and x < b for x, y in taken)]
    busy = sorted((a, b) for _, a, b in found)
    found += [("person", a, b) for a, b in _lean(_persons(plain, inventory), busy)]
    return sorted(found, key=lambda f: f[1])


def _lean(spans: Iterator[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch none of those taken; of overlapping ones the longest, then the first."""
    chosen: list[tuple[int, int]] = []
    busy = sorted(taken)
    for a, b in sorted(set(spans), key=lambda s: (s[0] - s[1], s[0])):
        if not any(a < y and x < b for x, y in _around(busy, a, b)):
            chosen.append((a, b))
            busy.append((a, b))
            busy.sort()
    return sorted(chosen)


def _around(busy: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    i = bisect_left(busy, (a, a))
    return busy[max(0, i - 1) : i + 1] + [s for s in busy[i + 1 : i + 8] if s[0] < b]


# --- pseudonyms ---------------------------------------------------------------------------------------


def _round(key: bytes, n: int, side: int, value: int, modulus: int, tweak: bytes) -> int:
    digest = hashlib.blake2b(b"%d|%d|%d|" % (n, side, value) + tweak, key=key[:64], digest_size=16).digest()
    return int.from_bytes(digest, "big") % modulus


def _half(size: int) -> int:
    a = int(size**0.5)
    while a * a < size:
        a += 1
    return a


def feistel(value: int, size: int, key: bytes, tweak: bytes = b"", rounds: int = 8) -> int:
    """A keyed permutation of ``range(size)``: an alternating Feistel network, walked until it lands inside."""
    if size < 2:
        return value
    a = _half(size)
    while True:
        left, right = divmod(value, a)
        for r in range(rounds):
            left, right = right, (left + _round(key, size % (1 << 60), r, right, a, tweak)) % a
        value = left * a + right
        if value < size:
            return value


def unfeistel(value: int, size: int, key: bytes, tweak: bytes = b"", rounds: int = 8) -> int:
    """The inverse of :func:`feistel`, for whoever holds the key."""
    if size < 2:
        return value
    a = _half(size)
    while True:
        left, right = divmod(value, a)
        for r in reversed(range(rounds)):
            left, right = (right - _round(key, size % (1 << 60), r, left, a, tweak)) % a, left
        value = left * a + right
        if value < size:
            return value


#: Dates of identity numbers: all of the centuries their format allows.
_EPOCH = dt.date(1800, 1, 1)
_DAYS = (dt.date(2100, 1, 1) - _EPOCH).days
#: Weights of ISO 7064 mod 11-2 over 17 digits and its check characters; weights of 11 digits before a check digit.
_CHECK = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
_CHARACTERS = "10X98765432"
_CHECK_11 = (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
#: Country codes of one and two digits; all others have three.
_CODES_1 = ("1", "7")
_CODES_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_EXTENSION = re.compile(r"(?i)[ ]?(?:,[ ]?)?(?:ext\.?|x|extension|Durchwahl|转|内線)[ ]?(?=\d{1,5}$)")

_TEN, _LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def check_character(digits: str) -> str:
    """ISO 7064 mod 11-2 over the first 17 digits."""
    return _CHARACTERS[sum(int(d) * w for d, w in zip(digits, _CHECK, strict=True)) % 11]


def check_of_10(digits: str) -> str:
    """ISO 7064 mod 11,10 over ten digits."""
    p = 10
    for d in digits:
        p = ((int(d) + p) % 10 or 10) * 2 % 11
    return str((11 - p) % 10)


def check_of_11(digits: str) -> str:
    """Weighted sum mod 11 over eleven digits."""
    left = sum(int(d) * w for d, w in zip(digits, _CHECK_11, strict=True)) % 11
    return "0" if left <= 1 else str(11 - left)


#: Check digits by the length of an identity number of digits only.
_CHECKS = {11: (check_of_10, _TEN), 12: (check_of_11, _TEN), 18: (check_character, _CHARACTERS)}


def _permuted(value: str, places: list[str], key: bytes, tweak: str, back: bool) -> str:
    """``value`` among all strings with ``places`` as alphabets; a place of one character stays."""
    n, size = 0, 1
    for c, alphabet in zip(value, places, strict=True):
        n = n * len(alphabet) + alphabet.index(c)
        size *= len(alphabet)
    n = (unfeistel if back else feistel)(n, size, key, f"{tweak}|{'/'.join(places)}".encode())
    out = []
    for alphabet in reversed(places):
        n, k = divmod(n, len(alphabet))
        out.append(alphabet[k])
    return "".join(reversed(out))


def _phone_places(digits: str, plus: bool) -> list[str]:
    """Alphabets of the digits of a phone number; what its format hangs on stays as it is."""
    places: list[str] = []
    if plus or digits[:2] == "00":
        rest = digits if plus else digits[2:]
        size = 1 if rest[:1] in _CODES_1 else 2 if rest[:2] in _CODES_2 else 3
        places = list(digits[: len(digits) - len(rest) + size])
    local = digits[len(places) :]
    if local[:1] == "0":
        second = local[1:2]
        if second not in ("", "0"):
            second = "123456789" if len(local) != 11 else "7" if second == "7" else "12345689"
        places += ["0", second] if second else ["0"]
    elif local[:1] == "1":
        places += ["1"] + (["012" if local[1] < "3" else "3456789"] if len(local) == 11 else [])
    elif local:
        places.append("23456789")
    return places + [_TEN] * (len(digits) - len(places))


def _phone(digits: str, plus: bool, key: bytes, back: bool) -> str:
    return _permuted(digits, _phone_places(digits, plus), key, "phone", back)


def _day(date: str) -> int:
    try:
        day = (dt.date(int(date[:4]), int(date[4:6]), int(date[6:])) - _EPOCH).days
    except ValueError:
        return -1
    return day if day < _DAYS else -1


def _id_number(value: str, key: bytes, back: bool) -> str:
    """``value`` without separators, in capitals."""
    checked = _CHECKS.get(len(value)) if re.fullmatch(r"\d+X?", value, re.A) else None
    if checked and (value[-1] in checked[1]) and (len(value) != 18 or _day(value[6:14]) >= 0):
        body, (check, alphabet) = value[:-1], checked
        off = alphabet.index(value[-1]) - alphabet.index(check(body))
        if len(value) == 18:
            place = _permuted(body[:6] + body[14:], [_TEN] * 9, key, "id place", back)
            day = (unfeistel if back else feistel)(_day(body[6:14]), _DAYS, key, b"id date")
            body = place[:6] + (_EPOCH + dt.timedelta(day)).strftime("%Y%m%d") + place[6:]
        else:
            body = _permuted(body, [_TEN] * len(body), key, "id", back)
        return body + alphabet[(alphabet.index(check(body)) + off) % len(alphabet)]
    places = [_TEN if c.isdigit() else _LETTERS for c in value]
    if re.fullmatch(r"\d+X", value, re.A):
        places[-1] = "X"
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", value, re.A):
        places[-1] = "ABCD"
    new = _permuted(value, places, key, "id", back)
    while len(value) == 18 and new[:17].isdigit() and _day(new[6:14]) >= 0:  # numbers without a date stay among themselves
        new = _permuted(new, places, key, "id", back)
    return new


@lru_cache(100_000)
def _number(kind: str, value: str, key: bytes, back: bool) -> str:
    if kind == "phone":
        return _phone(value.removeprefix("+"), value[0] == "+", key, back)
    if kind == "extension":
        return _permuted(value, [_TEN] * len(value), key, kind, back)
    return _id_number(value, key, back)


def _in_format(given: str, plain: str, new: str, keep: re.Pattern) -> str:
    """The characters of ``new`` in the places of ``plain`` that ``keep`` fits, in the case and width of ``given``."""
    out, at = [], iter(new)
    for g, p in zip(given, plain, strict=True):
        if keep.match(p):
            c = next(at)
            c = c.lower() if p.islower() else c
            out.append(chr(ord(c) + 0xFEE0) if g != p else c)
        else:
            out.append(g)
    return "".join(out)


_DIGIT, _SIGN = re.compile(r"\d", re.A), re.compile(r"[0-9A-Za-z]")


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str:
    """The value's stand-in: for numbers in the same format, else a keyed tag of the folded value."""
    plain = value.translate(_WIDTH)
    if kind == "phone":
        extra = m.end() if (m := _EXTENSION.search(plain)) else len(plain)
        digits = "".join(_DIGIT.findall(plain[:extra]))
        new = _number("phone", "+" * (plain[:1] == "+") + digits, key, back) if digits else ""
        if extra < len(plain):
            new += _number("extension", plain[extra:], key, back)
        return _in_format(value, plain, new, _DIGIT)
    if kind == "id_number":
        signs = "".join(_SIGN.findall(plain)).upper()
        return _in_format(value, plain, _number(kind, signs, key, back) if signs else "", _SIGN)
    folded = re.sub(r"[\s,.\-]+", " ", unicodedata.normalize("NFKC", plain).casefold()).strip()
    if kind == "person":
        folded = " ".join(sorted(folded.split()))
    return hashlib.blake2b(f"{kind}|{folded}".encode(), key=key[:64], digest_size=5).hexdigest()


def reveal(kind: str, stand: str, key: bytes) -> str:
    """The number behind a pseudonym, for whoever holds the key."""
    if kind not in ("phone", "id_number"):
        raise ValueError(f"pseudonyms of kind {kind} are tags and can't be read back")
    return pseudonym(kind, stand, key, back=True)


def redact(text: str | None, finds: list[tuple[str, int, int]], stands: list[str]) -> str | None:
    """The text with ``<KIND:pseudonym>`` for every find and otherwise unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for (kind, a, b), stand in zip(finds, stands, strict=True):
        out += [text[at:a], f"<{kind.upper()}:{stand}>"]
        at = b
    return "".join([*out, text[at:]])


def find_pii(documents: DataFrame, doc_id: str, text: str, roster: DataFrame, key: str) -> DataFrame:
    """Per document its finds ``array<struct<kind,start,end,pseudonym>>`` and its text with placeholders.

    One narrow pass over whole texts after the pass that learns the inventories; nothing but counts is shuffled. ``key`` is
    the secret of the pseudonyms; keys longer than 64 bytes count by their digest.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    known = learn_inventory(documents, text, roster)
    sent = documents.sparkSession.sparkContext.broadcast((known.roster, known.zh_family, known.zh_given, known.ja_family, known.ja_given))
    made: list[Inventory] = []
    secret = key.encode() if len(key.encode()) <= 64 else hashlib.blake2b(key.encode()).digest()

    @F.pandas_udf("struct<finds:array<struct<kind:string,start:int,end:int,pseudonym:string>>,clean:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Inventory(*sent.value))
        rows = []
        for t in texts:
            finds = find(t, made[0])
            stands = [pseudonym(k, t[a:b], secret) for k, a, b in finds]
            rows.append(([{"kind": k, "start": a, "end": b, "pseudonym": p} for (k, a, b), p in zip(finds, stands, strict=True)], redact(t, finds, stands)))
        return pd.DataFrame(rows, columns=["finds", "clean"])

    # not deterministic for the optimizer only: else a generator over the result makes it run the function again in filters
    return documents.select(F.col(doc_id).alias("doc_id"), run.asNondeterministic()(F.col(text)).alias("r")).select("doc_id", "r.finds", "r.clean")
