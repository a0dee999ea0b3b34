"""Raw CSV directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from layerwright.functions import parse

UNPARSED = "_unparsed"
RAGGED = "_ragged"
CSV_OPTIONS = {"header": True, "sep": ",", "columnNameOfCorruptRecord": RAGGED}
#: A reader that parses only the columns asked for does not see how many values a line has.
WHOLE_LINES = {"columnPruning": False}


def landing_schema(spark: SparkSession, path: str, multiline: bool = False) -> StructType:
    """The header of the directory's files, every column as text. Reads one line, no data."""
    return spark.read.options(**CSV_OPTIONS, multiLine=multiline).csv(path).schema


def ragged_schema(schema: StructType) -> StructType:
    """``schema`` with the column that takes lines of another width."""
    return StructType([*schema.fields, StructField(RAGGED, StringType())])


def set_ragged_apart(df: DataFrame) -> DataFrame:
    """Rows of a line that has more or fewer values than the header keep the line in ``_ragged`` and nothing else:
    which value belongs to which column is not known. It is NULL on all other rows."""
    sound = F.col(RAGGED).isNull()
    return df.select(*(F.when(sound, F.col(c)).alias(c) for c in df.columns if c != RAGGED), RAGGED)


def ragged_per_file(df: DataFrame, file: str) -> DataFrame:
    """How many ragged lines each file of a stored table has, of those that have any."""
    return df.where(F.col(RAGGED).isNotNull()).groupBy(file).agg(F.count(F.lit(1)).alias("ragged"))


def typed(df: DataFrame, types: dict[str, str], unparsed: bool = False) -> DataFrame:
    """Give text columns their declared types by name; a value that does not fit becomes NULL.

    ``unparsed`` adds a map from the columns whose text did not fit to that text, NULL if all did.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cast = {c: parse(F.col(c), k, types[c]) for c, k in kinds.items() if c in types}
    columns = [cast[c].alias(c) if c in cast else F.col(c) for c in kinds]
    if not unparsed:
        return df.select(*columns)
    lost = [
        F.when(F.col(c).isNotNull() & value.isNull(), F.struct(F.lit(c).alias("key"), F.col(c).alias("value")))
        for c, value in cast.items()
        if isinstance(kinds[c], StringType) and types[c] != "string"
    ]
    entries = F.array_compact(F.array(*lost)) if lost else None
    kept = F.lit(None) if entries is None else F.when(F.size(entries) > 0, F.map_from_entries(entries))
    return df.select(*columns, kept.cast("map<string,string>").alias(UNPARSED))


def read_text(
    spark: SparkSession, path: str, ragged: bool = False, multiline: bool = False, infer: bool = False
) -> DataFrame:
    """Read a directory of comma-separated files with a header row, every column as text.

    Columns go by their header name, in any order. A file whose header differs from the others is
    an error, not a silent shift of columns. ``ragged`` adds ``_ragged`` (see ``set_ragged_apart``); without it, missing
    values are NULL and surplus ones are lost. ``multiline`` lets a quoted value hold line breaks, for which a file is read by one task;
    without it such a record is two ragged lines. ``infer`` lets Spark guess the types.
    """
    options = {**CSV_OPTIONS, "multiLine": multiline}
    schema = spark.read.options(**options, inferSchema=True).csv(path).schema if infer else landing_schema(spark, path, multiline)
    reader = spark.read.options(**options, enforceSchema=False)
    return set_ragged_apart(reader.options(**WHOLE_LINES).schema(ragged_schema(schema)).csv(path)) if ragged else reader.schema(schema).csv(path)


def read_landing(
    spark: SparkSession,
    path: str,
    types: dict[str, str] | None = None,
    infer: bool = False,
    ragged: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """``read_text``, columns taking their declared type without an inference pass over the data;
    ``infer=True`` lets Spark guess the types instead."""
    return typed(read_text(spark, path, ragged, multiline, infer), {} if infer else types or {})
