from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from layerwright.functions import band, clean_text, fill_number, half_up, label, parse
from layerwright.spec import Entity, Field


def conform_column(field: Field, have: DataType) -> Column:
    """The expression of one conformed column: cast, fill, clean, round, then label or band."""
    c = parse(F.col(field.origin), have, field.dtype)
    if field.fill is not None:
        c = fill_number(c, field.fill, floating=field.dtype == "double")
    if field.text:
        c = clean_text(c, field.text)
    if field.digits is not None:
        c = half_up(c, field.digits)
    if field.codes:
        c = label(c, field.codes)
    if field.edges:
        c = band(c, field.edges)
    return c.alias(field.name)


def conform(df: DataFrame, entity: Entity) -> DataFrame:
    """Raw rows of an entity as its conformed columns, in one projection.

    Optional source columns may be missing; columns the entity does not declare are dropped.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *(
            conform_column(f, types[f.origin])
            for f in entity.fields
            if f.origin in types or not f.optional
        )
    )


def select_by_prefix(df: DataFrame, keep: tuple[str, ...], prefix: str) -> DataFrame:
    """The columns to keep and all whose name starts with ``prefix``."""
    return df.select(*keep, *(c for c in df.columns if c.startswith(prefix)))
