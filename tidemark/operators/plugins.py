"""Hooks: factors and strategies as named columns, scores of texts by a model of the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Factor(Protocol):
    """A score from 0 to 100 of a bar, as a column over bars with indicators."""

    name: str

    def column(self) -> Column: ...


@dataclass(frozen=True)
class ColumnFactor:
    name: str
    make: Callable[[], Column]

    def column(self) -> Column:
        return self.make()


@dataclass
class Factors:
    """A registry: each name once. ``evaluate`` adds all of them, and their lean from -1 to 1, in one projection."""

    known: dict[str, Factor] = field(default_factory=dict)

    def add(self, f: Factor) -> Factors:
        if f.name in self.known:
            raise ValueError(f"there is a factor named {f.name}")
        self.known[f.name] = f
        return self

    def evaluate(self, bars: DataFrame) -> DataFrame:
        scored = bars.select("*", *(f.column().alias(n) for n, f in self.known.items()))
        return scored.select("*", *(((F.col(n) - 50) / 50).alias(f"{n}_lean") for n in self.known))


class Strategy(Protocol):
    """The first gate that fails, null if all hold, as a column over evaluated bars with a regime."""

    def failed(self) -> Column: ...


def summarise(df: DataFrame, by: list[str], score: Callable[[], Column], label: Callable[[], Column], stats: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """by, and each statistic of (score, label): accessors and statistics are the caller's columns, so they run where Spark runs them."""
    s = df.select(*by, score().alias("_score"), label().alias("_label"))
    return s.groupBy(*by).agg(*(f(F.col("_score"), F.col("_label")).alias(n) for n, f in stats.items()))


# Words that the stand-in model counts, where no model is at hand.
GOOD, BAD = ("gain", "gains", "growth", "profit", "record", "rises", "strong", "wins"), ("cuts", "default", "falls", "fraud", "loss", "losses", "penalty", "weak")


def lexicon(texts: list[str]) -> list[tuple[float, float]]:
    """score from -1 to 1, and how neutral from 0 to 1, of each text: a stand-in for a model."""
    out = []
    for t in texts:
        words = t.lower().split()
        good, bad = sum(w in GOOD for w in words), sum(w in BAD for w in words)
        out.append(((good - bad) / (good + bad) if good + bad else 0.0, 1.0 / (1 + good + bad)))
    return out


def scored(news: DataFrame, model: Callable[[], Callable[[list[str]], list[tuple[float, float]]]] = lambda: lexicon, version: str = "lexicon-1", text: str = "title", batch: int = 64, tries: int = 3) -> DataFrame:
    """news with score, neutral and model of each text. ``model`` is made once a task; a batch that fails ``tries`` times gets nulls, and the rest goes on.

    Rows that have this version's score already are not sent again if news has those columns.
    """
    have = {"score", "neutral", "model"} <= set(news.columns)
    done = news.where(F.col("model").eqNullSafe(version) & F.col("score").isNotNull()) if have else None
    todo = (news.where(~F.col("model").eqNullSafe(version) | F.col("score").isNull()) if have else news).drop("score", "neutral", "model")
    schema = T.StructType([*todo.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("neutral", T.DoubleType()), T.StructField("model", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = model()
        for pdf in frames:
            got: list[tuple[float | None, float | None]] = []
            texts = pdf[text].fillna("").tolist()
            for k in range(0, len(texts), batch):
                for attempt in range(tries):
                    try:
                        got += f(texts[k : k + batch])
                        break
                    except Exception:
                        if attempt == tries - 1:
                            got += [(None, None)] * len(texts[k : k + batch])
            yield pdf.assign(score=[x for x, _ in got], neutral=[x for _, x in got], model=version)

    new = todo.mapInPandas(run, schema)
    return new if done is None else new.unionByName(done.select(*new.columns))
