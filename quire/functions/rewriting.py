"""Edits written back to formatted runs of text, and canonical forms of nested values."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def write_back(runs: Sequence[str], edits: Sequence[tuple[int, int, str]]) -> list[str]:
    """Runs of one paragraph with edits ``(start, end, new)`` over their joined text.

    New text goes where an edit begins; what the edit covers in later runs is cut. Runs keep their number, so their format stays.
    """
    edits = sorted(edits)
    if any(a[1] > b[0] for a, b in zip(edits, edits[1:], strict=False)):
        raise ValueError("edits overlap")
    out, at = [], 0
    for run in runs:
        stop, text, pos = at + len(run), "", at
        for a, b, new in edits:
            if b <= at and not (a == b == at == 0) or a >= stop:
                continue
            text += run[pos - at : max(a, pos) - at]
            text += new if a >= at else ""
            pos = max(pos, min(b, stop))
        out.append(text + run[pos - at :])
        at = stop
    return out


def canonical(value):
    """Nested values in one form: keys as sorted strings, sets as sorted lists, strings without outer blanks."""
    if isinstance(value, dict):
        return {str(k): canonical(v) for k, v in sorted(value.items(), key=lambda x: str(x[0]))}
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted((canonical(v) for v in value), key=repr)
    return value.strip() if isinstance(value, str) else value


def digest(task_type: str | None, *documents: str | None) -> str:
    """SHA-256 of a request's canonical JSON; documents that can't be read count as texts."""

    def read(text: str | None):
        try:
            return json.loads(text) if text else None
        except ValueError:
            return text

    body = json.dumps(canonical({"type": task_type, "documents": [read(d) for d in documents]}), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(body.encode()).hexdigest()


def request_digest(task_type: Column, *documents: Column) -> Column:
    @F.pandas_udf("string")
    def run(kind: pd.Series, *docs: pd.Series) -> pd.Series:
        clean = lambda v: v if isinstance(v, str) else None
        return pd.Series([digest(clean(k), *map(clean, d)) for k, *d in zip(kind, *docs, strict=True)], dtype="object")

    return run.asNondeterministic()(task_type, *documents)


def column_named(columns: Sequence[str], patterns: Sequence[str]) -> str | None:
    """The first column whose name holds any of the patterns, whatever their case."""
    return next((c for c in columns if any(re.search(p, str(c), re.I) for p in patterns)), None)
