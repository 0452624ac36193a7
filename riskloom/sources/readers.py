"""Readers for the raw credit files and the input check (SRC-01..SRC-11).

CSV is read with the header and every field as a string, quoted cells with commas,
doubled quote marks and line breaks included (``quoted``); null tokens are cleared
and each declared column is cast by name. Columns that no schema declares are
numbers if every value in the whole file reads as one, else strings (one pass
over them). A cell that its declared type cannot read becomes null; with a
``report`` list such cells are counted by column in the same pass, and the CLI
prints them. Parquet sources get the same casts and the same NaN rule.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StringType, StructField, StructType

from . import quoted, schemas

# The strings the reference's CSV reader (pandas defaults) reads as null.
# 'XNA' is not among them: it is a category value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Driver-side metadata check on any Hadoop file system (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def check_inputs(spark: SparkSession, paths: Mapping[str, str]) -> None:
    """SRC-11 (D13, D20): check every input and list all missing paths in one error."""
    missing = [f"{name}: {p}" for name, p in paths.items() if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing input files:\n  " + "\n  ".join(missing))


def _number(v: Column, t: DataType) -> Column:
    """``v`` as ``t``: integers may be written with a fraction of zero (``-1.0``), NaN is null."""
    if t.typeName() in ("double", "float"):
        d = v.try_cast(t)
        return F.when(F.isnan(d), F.lit(None).cast(t)).otherwise(d)
    whole = v.try_cast("double")
    return F.coalesce(v.try_cast(t), F.when(whole == F.floor(whole), whole.try_cast(t)))


def clean_and_cast(df: DataFrame, schema: StructType) -> DataFrame:
    """Null tokens to null, declared columns cast by name, NaN to null."""
    declared = {f.name: f.dataType for f in schema.fields}
    return df.select(*[_cell(F.col(f"`{c}`"), declared.get(c)).alias(c) for c in df.columns])


def _cleaned(raw: Column) -> Column:
    return F.when(raw.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(raw)


def _cell(raw: Column, t: DataType | None) -> Column:
    return _cleaned(raw) if t is None or isinstance(t, StringType) else _number(_cleaned(raw), t)


def complete_schema(raw: DataFrame, schema: StructType, report: list | None = None) -> StructType:
    """``schema`` with the columns of ``raw`` that it does not declare, typed by all their values (one pass).

    ``report`` gets ``(column, cells)`` for declared columns with cells that their type cannot read.
    """
    declared = {f.name: f.dataType for f in schema.fields}
    free = [c for c in raw.columns if c not in declared]
    typed = [c for c in raw.columns if c in declared and not isinstance(declared[c], StringType)] if report is not None else []
    if not free and not typed:
        return schema
    text = {c: _cleaned(F.col(f"`{c}`")) for c in free + typed}
    unreadable = lambda c, t: F.count_if(text[c].isNotNull() & _number(text[c], t).isNull())
    counts = raw.agg(
        *[F.count(text[c]).alias(f"n{i}") for i, c in enumerate(free)],
        *[unreadable(c, DoubleType()).alias(f"f{i}") for i, c in enumerate(free)],
        *[unreadable(c, declared[c]).alias(f"t{i}") for i, c in enumerate(typed)],
    ).first()
    if report is not None:
        report.extend((c, counts[f"t{i}"]) for i, c in enumerate(typed) if counts[f"t{i}"])
    number = [c for i, c in enumerate(free) if counts[f"n{i}"] and not counts[f"f{i}"]]
    return StructType([*schema.fields, *[StructField(c, DoubleType() if c in number else StringType(), True) for c in free]])


def read_csv(spark: SparkSession, path: str, schema: StructType, report: list | None = None) -> DataFrame:
    raw = quoted.read_raw(spark, path)
    return clean_and_cast(raw, complete_schema(raw, schema, report))


def read_parquet(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet source with the declared types; NaN is null in every floating column."""
    df = spark.read.parquet(path)
    declared = {f.name: f.dataType for f in schema.fields}
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), declared.get(f.name, f.dataType)
        if f.dataType.typeName() in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        out.append((c if f.dataType == t else c.cast("string") if isinstance(t, StringType) else _number(c, t)).alias(f.name))
    return df.select(*out)


def assert_keys(df: DataFrame, name: str) -> DataFrame:
    """``df`` failing on a row whose key is null (``schemas.KEYS``)."""
    keys = [k for k in schemas.KEYS[name] if k in df.columns]
    message = F.lit(f"{name}: null in key {', '.join(keys)}")
    return df.withColumns({k: F.when(F.col(k).isNull(), F.raise_error(message).cast(df.schema[k].dataType)).otherwise(F.col(k)) for k in keys})


def read_source(spark: SparkSession, raw_dir: str, name: str, fmt: str = "csv", report: list | None = None) -> DataFrame:
    """SRC-01..SRC-07: one raw source by name, from CSV (declared schema) or Parquet; keys must not be null."""
    file_name, schema = schemas.SOURCES[name]
    if fmt == "csv":
        return assert_keys(read_csv(spark, f"{raw_dir.rstrip('/')}/{file_name}", schema, report), name)
    stem = file_name.rsplit(".", 1)[0]
    return assert_keys(read_parquet(spark, f"{raw_dir.rstrip('/')}/{stem}.parquet", schema), name)


def source_paths(raw_dir: str, fmt: str = "csv") -> dict[str, str]:
    out = {}
    for name, (file_name, _) in schemas.SOURCES.items():
        stem = file_name.rsplit(".", 1)[0]
        out[name] = f"{raw_dir.rstrip('/')}/{file_name if fmt == 'csv' else stem + '.parquet'}"
    return out


class Sources(Mapping):
    """The seven sources by name: all are checked to exist, each is read (CSV: typed by a scan) when first asked for."""

    def __init__(self, spark: SparkSession, raw_dir: str, fmt: str = "csv", report: dict | None = None):
        self.paths = source_paths(raw_dir, fmt)
        check_inputs(spark, self.paths)
        self._args, self._report, self._read = (spark, raw_dir, fmt), report, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._read:
            if name not in self.paths:
                raise KeyError(name)
            spark, raw_dir, fmt = self._args
            cells = None if self._report is None else self._report.setdefault(name, [])
            self._read[name] = read_source(spark, raw_dir, name, fmt, cells)
        return self._read[name]

    def __iter__(self):
        return iter(self.paths)

    def __len__(self) -> int:
        return len(self.paths)


def load_sources(spark: SparkSession, raw_dir: str, fmt: str = "csv", report: dict | None = None) -> dict[str, DataFrame]:
    """Check all seven inputs, then return them by name. ``report`` gets the unreadable cells of each CSV source."""
    return dict(Sources(spark, raw_dir, fmt, report))
