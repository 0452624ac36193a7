"""Categorical encoding with a fitted vocabulary.

The reference decides the encoding from the data on every run (binary
columns → category codes, others → one-hot), which makes the output schema
data-dependent. Here the decision and the vocabulary are *fitted* once
(one aggregate job, a few values per column to the driver) and then applied
as literal ``CASE`` expressions, so training and scoring tables share one
schema and applying the encoding needs no join, no broadcast and no UDF.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .summary import string_columns


@dataclass
class Vocabulary:
    binary: dict[str, list[str]] = field(default_factory=dict)  # column -> sorted values (<= 2)
    onehot: dict[str, list[str]] = field(default_factory=dict)  # column -> sorted values

    def onehot_names(self, kept: Sequence[str] = ()) -> list[str]:
        """Output names in column, then value order; a name already taken (also by a ``kept`` column) gets ``_2``, ``_3``, ..."""
        names: dict[str, None] = dict.fromkeys(kept)
        for c, values in self.onehot.items():
            for v in values:
                name, n = dummy_name(c, v), 1
                while name in names:
                    n += 1
                    name = f"{dummy_name(c, v)}_{n}"
                names[name] = None
        return list(names)[len(dict.fromkeys(kept)):]


def dummy_name(column: str, value: str) -> str:
    """``get_dummies`` names a column ``<col>_<value>``; characters Parquet rejects become ``_``."""
    return re.sub(r"[^0-9A-Za-z_]", "_", f"{column}_{value}")


def fit_vocabulary(df: DataFrame, columns: Sequence[str] | None = None) -> Vocabulary:
    """One pass: the distinct non-null values of every string column, as many as there are.

    Each value becomes an output column, so they all reach the driver in any case; they are counted in
    parallel and read in order, a partition at a time.
    """
    columns = list(columns or string_columns(df))
    if not columns:
        return Vocabulary()
    pairs = (
        df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
        ])).alias("s"))
        .select("s.column", "s.value")
        .where(F.col("value").isNotNull())
        .distinct()
    )
    found: dict[str, list[str]] = {}
    for r in pairs.orderBy("column", "value").toLocalIterator():
        found.setdefault(r["column"], []).append(r["value"])
    vocab = Vocabulary()
    for c in columns:
        values = found.get(c, [])
        if len(values) <= 2:
            vocab.binary[c] = values
        else:
            vocab.onehot[c] = values
    return vocab


def label_encode(df: DataFrame, vocab: Vocabulary) -> DataFrame:
    """M1: code = position in the sorted vocabulary; null stays null."""
    exprs = {}
    for c, values in vocab.binary.items():
        code = None
        for i, v in enumerate(values):
            cond = F.col(c) == F.lit(v)
            code = F.when(cond, F.lit(i)) if code is None else code.when(cond, F.lit(i))
        exprs[c] = code if code is not None else F.lit(None).cast("int")
    return df.withColumns(exprs) if exprs else df


def one_hot(df: DataFrame, vocab: Vocabulary) -> DataFrame:
    """M2: one 0/1 column per vocabulary value, null -> all zero; source column dropped.

    Dummies come after the other columns, in column then value order, as
    ``get_dummies`` lays them out.
    """
    keep = [c for c in df.columns if c not in vocab.onehot]
    pairs = [(c, v) for c, values in vocab.onehot.items() for v in values]
    dummies = [
        F.when(F.col(c) == F.lit(v), F.lit(1)).otherwise(F.lit(0)).alias(name)
        for (c, v), name in zip(pairs, vocab.onehot_names(keep), strict=True)
    ]
    return df.select(*keep, *dummies)


def encode(df: DataFrame, vocab: Vocabulary | None = None) -> tuple[DataFrame, Vocabulary]:
    vocab = vocab or fit_vocabulary(df)
    return one_hot(label_encode(df, vocab), vocab), vocab
