"""Columns that read model answers and mark shared spans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPAN = 20


def json_field(answer: Column, name: str) -> Column:
    """Field of the JSON object in a model's answer, from its first brace to its last; null where there is none."""
    return F.get_json_object(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), f"$.{name}")


def bool_of(value: Column) -> Column:
    """True or false of the usual words; null for any other."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("1", "true", "yes", "correct", "agree"), True).when(v.isin("0", "false", "no", "incorrect", "disagree"), False)


def task_label(value: Column) -> Column:
    """``1`` for the words of a positive answer, else ``0``."""
    return F.when(F.lower(F.trim(value)).isin("1", "true", "yes", "positive", "exploit_relevant"), "1").otherwise("0")


def truncated(text: Column, n: int, marker: str = "...[truncated]") -> Column:
    """``text`` cut to ``n`` characters with a marker where it was longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


@F.pandas_udf(StringType())
def strip_spans(texts: pd.Series, others: pd.Series) -> pd.Series:
    """Every text with the characters blanked that lie in a run of SPAN characters which the other text holds."""

    def one(q: str, g: str) -> str:
        if q is None or g is None or len(q) < SPAN or len(g) < SPAN:
            return q
        held = {g[i : i + SPAN] for i in range(len(g) - SPAN + 1)}
        hits = np.array([q[i : i + SPAN] in held for i in range(len(q) - SPAN + 1)], np.int32)
        if not hits.any():
            return q
        change = np.zeros(len(q) + 1, np.int32)
        at = np.flatnonzero(hits)
        np.add.at(change, at, 1)
        np.add.at(change, at + SPAN, -1)
        covered = np.cumsum(change[:-1]) > 0
        return "".join(" " if c else x for x, c in zip(q, covered))

    return pd.Series([one(q, g) for q, g in zip(texts, others)])
