"""Mapping freely entered values to the entries of a reference list.

Method: all reference forms, alias paths included, sit in one trie, which is searched with a Levenshtein
automaton (the non-deterministic one, one bit set of query positions per error count; a swap of neighbours
is one error). A search gives every entry within a distance that depends on the length; the nearest wins.

Defined results: null and blank values give a null id; values that mean no entry, and values equally near
to two entries, give 0; ties in distance between forms of one entry are that entry. Very long values are
searched whole by their parts; a part longer than any form plus its allowance can't match and costs nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reference lists beyond this are searched in blocks of this many entries, one trie at a time.
BLOCK_ENTRIES = 50_000
CACHE = 200_000

#: Characters that recognition confuses, folded to one on both sides.
CONFUSED = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "5": "s", "$": "s", "8": "b", "6": "g", "9": "g", "2": "z"})

#: Other names of an entry, by its English form.
ALIASES = {
    "Full Name": ("Name", "Name in full", "名字", "全名", "姓名全称"),
    "Gender": ("Sex", "M/F", "男女"),
    "Nationality": ("Citizenship", "Citizen of", "国别"),
    "Date of Birth": ("DOB", "D.O.B.", "Birth Date", "Born on", "出生年月日", "生日", "出生年月"),
    "Place of Birth": ("Birthplace", "Born in", "POB", "出生地", "籍贯"),
    "Home Address": ("Address", "Residence", "Residential Address", "住址", "地址", "家庭住址", "居住地址"),
    "Document Number": ("Doc. No.", "ID document no.", "ID document", "Doc Number", "Document No.", "ID No.", "ID Number", "证号", "证件号", "证件编号"),
    "Vehicle Class": ("Class", "Class of vehicle", "Vehicle Category", "车型", "准驾类别"),
    "Valid From": ("Valid as from", "Effective Date", "Start Date", "起始日期", "有效期起", "生效日期"),
    "Valid Until": ("Valid to", "Expiry Date", "Date of Expiry", "Expires", "Valid till", "截止日期", "有效期至", "有效期止", "失效日期"),
    "Issuing Authority": ("Issued by", "Authority", "发证机关", "签发单位"),
    "First Issue Date": ("Date of first issue", "First issued", "初领日期", "初次领证"),
    "File Number": ("File No.", "档案号"),
    "Offence Record": ("Offences", "Violations", "Violation Record", "违章", "违法记录"),
    "Company Name": ("Company", "Name of company", "Enterprise Name", "公司名称", "单位名称", "企业名"),
    "Legal Representative": ("Legal Rep.", "Legal person", "法人代表", "法人", "法定代表"),
    "Registered Capital": ("Capital", "注册资金"),
    "Business Scope": ("Scope of business", "经营项目", "业务范围"),
    "Establishment Date": ("Date of establishment", "Established on", "Founded on", "成立时间", "创立日期"),
    "Operating Term": ("Term of operation", "Business Term", "经营期限"),
    "Registration Office": ("Registered at", "Registration Authority", "登记单位", "登记处"),
    "Unified Credit Code": ("Credit Code", "USCC", "信用代码", "社会信用代码"),
    "Marital Status": ("Married", "婚姻", "婚否"),
    "Ethnic Group": ("Ethnicity", "族别"),
    "Occupation": ("Job", "Profession", "工作", "职务"),
    "Body Height": ("Height", "身长"),
    "Plate Number": ("Plate", "Plate No.", "License Plate", "Number Plate", "车牌", "车牌号", "号牌号码"),
    "Vehicle Identification Code": ("VIN", "Vehicle Identification Number", "Chassis Number", "车架号"),
    "Engine Number": ("Engine No.", "发动机号"),
    "Usage Type": ("Use", "Type of use", "Usage", "用途"),
    "Seating Capacity": ("Seats", "Number of seats", "载客人数", "座位数", "核载人数"),
    "Kerb Weight": ("Curb Weight", "Unladen Weight", "空车重量", "整车质量", "自重"),
    "Overall Dimensions": ("Dimensions", "Outer dimensions", "外形尺寸", "车辆尺寸"),
    "Fuel Kind": ("Fuel", "Fuel Type", "Kind of fuel", "Type of fuel", "燃料", "燃料类型"),
    "Body Colour": ("Colour", "Color", "Body Color", "Color of body", "Colour of body", "Vehicle Colour", "车身颜色", "颜色"),
    "Graduation School": ("School", "Graduated from", "Alma mater", "毕业学校", "学校"),
    "Field of Study": ("Major", "Subject", "专业"),
    "Degree Category": ("Degree", "Degree Type", "学位"),
    "Guardian": ("Legal guardian", "监护者"),
    "Emergency Contact": ("Contact in emergency", "Emergency Person", "In case of emergency", "紧急联络人", "紧急联系"),
    "Barcode": ("Bar code", "条码"),
    "Driving Restrictions": ("Restrictions", "限制条件", "驾驶限制"),
    "Supplement Remark": ("Remark", "Remarks", "Supplementary Remark", "备注", "附注"),
    "Seal Inscription": ("Seal", "Seal Text", "Stamp Text", "章文", "印文"),
}

#: Traditional characters of the field and their simplified forms.
TRADITIONAL = str.maketrans(
    "別國現證號碼準駕車簽發機關領檔編違記錄業稱註冊資經營範圍統會狀況職輛識動質載數備種類顏畢學專監護緊聯繫係條頁註時單長體項應無據權處務員購輸達遠運選還區醫師華龍",
    "别国现证号码准驾车签发机关领档编违记录业称注册资经营范围统会状况职辆识动质载数备种类颜毕学专监护紧联系系条页注时单长体项应无据权处务员购输达远运选还区医师华龙",
)

_INVISIBLE = re.compile(r"[​-‏⁠﻿­]")
_NUMBERING = re.compile(r"^\s*\d{1,3}\s*[.、)）]\s*")
_SUFFIX = re.compile(r"[_\s]\d{1,2}\s*$")
_HAN = re.compile(r"[㐀-鿿]+")
_BETWEEN = re.compile(r"[/|()（）\[\]【】]")


def allowance(length: int, han: bool) -> int:
    """Errors allowed in a form of this length."""
    if han:
        return 0 if length < 2 else 1 if length < 5 else 2
    return 0 if length < 4 else 1 if length < 5 else 2 if length < 11 else 3 if length < 16 else 4


def fold(text: str) -> str:
    """Letters, digits and Han only, lower case, full width and look-alikes folded."""
    text = unicodedata.normalize("NFKC", text).lower()
    return "".join(c for c in text.translate(CONFUSED).translate(TRADITIONAL) if c.isalnum())


def parts(value: str) -> list[str]:
    """The searched forms of a value: as a whole, its Han and its Latin part, and what marks separate."""
    value = _INVISIBLE.sub("", unicodedata.normalize("NFKC", value)).strip()
    value = _SUFFIX.sub("", _NUMBERING.sub("", value.strip(" *·•:：-—#")).strip(" *·•:：-—"))
    found = [fold(value)]
    if (han := "".join(_HAN.findall(value))) and re.search("[a-zA-Z]", value):
        found += [han, fold(_HAN.sub(" ", value))]
    found += [fold(x) for x in _BETWEEN.split(value)]
    return [x for x in dict.fromkeys(found) if x]


def short_forms(label: str) -> Iterator[str]:
    """A label with one of its words cut short, as in abbreviations with a full stop."""
    words = label.split()
    for i, word in enumerate(words):
        for n in (3, 4, 5):
            if len(words) > 1 and len(word) > n + 1:
                yield " ".join([*words[:i], word[:n], *words[i + 1 :]])


class Trie:
    """Forms as nested nodes ``[children, ends]``: ``ends`` maps each entry to the errors its form may have, and a child stands
    with the least and greatest length of the forms through it."""

    def __init__(self, forms: Iterable[tuple[str, int, int]]):
        self.root: list = [{}, {}]
        for form, entry, slack in forms:
            node = self.root
            for c in form:
                if c not in node[0]:
                    node[0][c] = [[{}, {}], len(form), len(form)]
                step = node[0][c]
                step[1], step[2] = min(step[1], len(form)), max(step[2], len(form))
                node = step[0]
            node[1][entry] = max(slack, node[1].get(entry, 0))

    def search(self, query: str, most: int, more: int = 0) -> dict[int, int]:
        """Entry to distance, for all entries with a form within ``most`` errors of the query.

        A form may have the errors it was given and ``more``.
        """
        n = len(query)
        masks: dict[str, int] = {}
        for i, c in enumerate(query):
            masks[c] = masks.get(c, 0) | 1 << (i + 1)
        full = (1 << (n + 1)) - 1
        start = [(1 << (e + 1)) - 1 & full for e in range(most + 1)]
        final = 1 << n
        best: dict[int, int] = {}
        stack = [(self.root, start, None, "")]
        while stack:
            node, state, before, last = stack.pop()
            if node[1] and (d := next((e for e, bits in enumerate(state) if bits & final), None)) is not None:
                for entry, slack in node[1].items():
                    if d <= slack + more and d < best.get(entry, most + 1):
                        best[entry] = d
            for c, (child, least, greatest) in node[0].items():
                if least > n + most or greatest < n - most:  # an error changes the length by one at most
                    continue
                hit = masks.get(c, 0)
                new = [(state[0] << 1) & hit]
                for e in range(1, most + 1):
                    bits = ((state[e] << 1) & hit) | (state[e - 1] << 1) | state[e - 1] | (new[e - 1] << 1)
                    if before is not None:
                        bits |= (before[e - 1] << 2) & (hit << 1) & masks.get(last, 0)
                    new.append(bits & full)
                if any(new):
                    stack.append((child, new, state, c))
        return best


class Matcher:
    """Best entry of a value over one block of the reference list."""

    def __init__(self, entries: list[tuple[int, str, str]], aliases: dict[str, tuple[str, ...]]):
        forms = []
        for entry, zh, en in entries:
            forms += [(f, entry, allowance(len(f), bool(_HAN.search(f)))) for f in (fold(zh or ""), fold(en or ""))]
            forms += [(fold(a), entry, int(len(fold(a)) > 4)) for a in aliases.get(en, ())]
            forms += [(fold(s), entry, 0) for s in short_forms(en or "")]
        self.trie = Trie(f for f in forms if f[0])
        self.letters: dict[int, list[Counter]] = {}
        for form, entry, slack in forms:
            if slack > 1:
                self.letters.setdefault(entry, []).append(Counter(form))
        self.longest = max((len(f) for f, _, _ in forms), default=0)
        self.find = lru_cache(CACHE)(self._find)

    def _find(self, value: str) -> tuple[int, int]:
        """(entry, distance); entry 0 for none or a tie."""
        best: dict[int, int] = {}
        for part in parts(value):
            han = bool(_HAN.search(part))
            most = allowance(len(part) + 2, han) if len(part) > 1 else 0  # a form may be longer than what is left of it
            if len(part) > self.longest + most:
                continue
            for errors in range(most + 1):
                if found := self.trie.search(part, errors):
                    for entry, d in found.items():
                        best[entry] = min(d, best.get(entry, 99))
                    break
        for part in parts(value) if not best else ():
            # letters that changed places over more than one neighbour: an error more, if the letters are the same but one
            if 6 <= len(part) <= self.longest + 2 and not _HAN.search(part):
                have = Counter(part)
                for entry, d in self.trie.search(part, allowance(len(part) + 2, False) + 1, 1).items():
                    if any(sum(((have - c) + (c - have)).values()) <= 1 for c in self.letters.get(entry, ())):
                        best[entry] = min(d, best.get(entry, 99))
        if not best:
            return 0, 99
        least = min(best.values())
        near = [e for e, d in best.items() if d == least]
        return (near[0], least) if len(near) == 1 else (0, least)


def match_values(df: DataFrame, value: str, labels: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None) -> Column:
    """A column with the id of the entry that ``value`` means; see the module for the defined results.

    ``labels`` has ``label_id, label_zh, label_en`` and is the bounded reference list; beyond
    ``BLOCK_ENTRIES`` entries, its tries are searched block by block and the nearest of all blocks wins.
    The search is a narrow Arrow UDF with a cache per worker, so frequent values make no hot group.
    """
    known = ALIASES if aliases is None else aliases
    rows = [(int(r[0]), r[1], r[2]) for r in labels.select("label_id", "label_zh", "label_en").toLocalIterator()]
    blocks = [rows[i : i + BLOCK_ENTRIES] for i in range(0, len(rows), BLOCK_ENTRIES)] or [[]]
    shared = df.sparkSession.sparkContext.broadcast((blocks, known))
    made: list[Matcher] = []

    @F.pandas_udf("int")
    def meant(values: pd.Series) -> pd.Series:
        if not made:
            made.extend(Matcher(b, shared.value[1]) for b in shared.value[0])

        def one(v):
            if v is None or not v.strip():
                return None
            found = [m.find(v) for m in made]
            least = min(d for _, d in found)
            near = [e for e, d in found if d == least]
            return near[0] if len(near) == 1 else 0

        return pd.Series([one(v) for v in values], dtype="Int32")

    # not deterministic for the optimizer only: else a generator over the result makes it run the function again in filters
    return meant.asNondeterministic()(F.col(value))
