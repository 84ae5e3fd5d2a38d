"""Text split by writing system: neutral characters go with the language before them, leading ones with the next."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import measure as M

_cls = lambda c: regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m.group(1), 16):08x}", c)
_HAN, _KANA, _HANGUL = (_cls(c) for c in (M.HAN, M.KANA, M.HANGUL))
_PIECE = regex.compile(rf"(?V1)(?P<han>[{_HAN}]+)|(?P<kana>[{_KANA}]+)|(?P<hangul>[{_HANGUL}]+)|(?P<token>[[\p{{L}}\p{{N}}]--[{_HAN}{_KANA}{_HANGUL}]](?:[[\p{{L}}\p{{N}}]--[{_HAN}{_KANA}{_HANGUL}]]|[{M.INNER}])*)|(?P<rest>.)", regex.S)
_SCRIPTS = [(name, regex.compile(rf"(?:{c}|[^\p{{L}}])+")) for name, c in (("latin", r"\p{Latin}"), ("cyrillic", r"\p{Cyrillic}"), ("arabic", r"\p{Arabic}"), ("greek", r"\p{Greek}"), ("hebrew", r"\p{Hebrew}"), ("thai", r"[\u0E01-\u0E7F]"))]
_LETTER = regex.compile(r"\p{L}")


def token_language(token: str) -> str | None:
    if not _LETTER.search(token):
        return None
    return next((name for name, p in _SCRIPTS if p.fullmatch(token)), "other")


def language_parts(text: str) -> dict[str, str]:
    pieces = [(m.lastgroup, m.group()) for m in _PIECE.finditer(text)]
    kinds = {k for k, _ in pieces}
    han = "japanese" if "kana" in kinds else "korean" if "hangul" in kinds else "chinese"
    named = [({"han": han, "kana": "japanese", "hangul": "korean"}.get(k) or (token_language(t) if k == "token" else None), t) for k, t in pieces]
    out: dict[str, list[str]] = {}
    last = next((x for x, _ in named if x), "other")
    for language, part in named:
        last = language or last
        out.setdefault(last, []).append(part)
    return {k: "".join(v) for k, v in out.items()}


def parts(text: Column) -> Column:
    """``array<struct<language,text>>``; null for null, empty for an empty text."""

    @F.pandas_udf("array<struct<language:string,text:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"language": k, "text": v} for k, v in language_parts(t).items()] for t in texts])

    # not deterministic for the optimizer only: else a generator over the result makes it run the function again in filters
    return run.asNondeterministic()(text)
