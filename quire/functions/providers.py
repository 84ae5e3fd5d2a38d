"""Callables that stand for hosted models. Engines take them as arguments; the stubs here work offline and always answer alike."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.operators.sequential import hashed_vector

#: Texts of one call.
BATCH = 64


class Embedder(Protocol):
    """Texts to unit vectors of one size."""

    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class Translator(Protocol):
    """Texts from one language to another, in the same order."""

    def __call__(self, texts: Sequence[str], source: str, target: str) -> Sequence[str]: ...


def hashing_embedder(texts: Sequence[str]) -> list[list[float]]:
    return [hashed_vector(t).tolist() for t in texts]


def echo_translator(texts: Sequence[str], source: str, target: str) -> list[str]:
    return list(texts)


def _batched(values: pd.Series, call: Callable[[list[str]], Sequence]) -> list:
    """One call per ``BATCH`` texts; nulls aren't sent and stay null."""
    found: list = [None] * len(values)
    at = [i for i, v in enumerate(values) if isinstance(v, str)]
    for k in range(0, len(at), BATCH):
        part = at[k : k + BATCH]
        answer = list(call([values.iloc[i] for i in part]))
        if len(answer) != len(part):
            raise ValueError(f"the provider gave {len(answer)} answers to {len(part)} texts")
        for i, a in zip(part, answer, strict=True):
            found[i] = a
    return found


def embedded(text: Column, embedder: Embedder = hashing_embedder) -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else [float(x) for x in v] for v in _batched(texts, embedder)], dtype="object")

    return run.asNondeterministic()(text)


def translated(text: Column, source: str, target: str, translator: Translator = echo_translator) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(_batched(texts, lambda part: translator(part, source, target)), dtype="object")

    return run.asNondeterministic()(text)
