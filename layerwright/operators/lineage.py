from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerwright.functions import record_hash
from layerwright.sources.landing import RAGGED


@dataclass(frozen=True)
class RunStamp:
    """The moment of a run, in UTC. Every time column and partition value of the run comes from it."""

    at: datetime

    @classmethod
    def now(cls) -> RunStamp:
        return cls(datetime.now(timezone.utc))

    @property
    def utc(self) -> datetime:
        return self.at.astimezone(timezone.utc) if self.at.tzinfo else self.at.replace(tzinfo=timezone.utc)

    @property
    def year(self) -> str:
        return f"{self.utc:%Y}"

    @property
    def month(self) -> str:
        return f"{self.utc:%m}"

    def timestamp(self) -> Column:
        return F.to_timestamp(F.lit(self.utc.isoformat()))

    def partition(self, year: str, month: str) -> dict[str, Column]:
        return {year: F.lit(self.year), month: F.lit(self.month)}


# Names of the lineage and partition columns.
SOURCE_FILE = "_source_file"
BRONZE_PARTITION = ("_ing_ano", "_ing_mes")
BATCH = "_batch"
SILVER_PARTITION = ("_proc_ano", "_proc_mes")
SILVER_TIME = "_silver_processed_at"
GOLD_TIME = "_gold_processed_at"


def row_digest(columns: list[str], null_safe: bool = True) -> Column:
    """The hash of a raw row's values; that of a ragged line is of the line."""
    raw = [c for c in columns if c not in (SOURCE_FILE, RAGGED)]
    digest = record_hash(raw, null_safe)
    return F.when(F.col(RAGGED).isNull(), digest).otherwise(record_hash([RAGGED], null_safe)) if RAGGED in columns else digest


def add_lineage(
    df: DataFrame, entity: str, stamp: RunStamp, null_safe_hash: bool = True
) -> DataFrame:
    """Add when, from which file and for which entity a raw row came in, and the hash of its values.

    ``df`` must come from files, with nothing but projections and filters in between, or hold the
    file in ``_source_file`` already.
    """
    kept = [c for c in df.columns if c != SOURCE_FILE]
    file = F.col(SOURCE_FILE if SOURCE_FILE in df.columns else "_metadata.file_path")
    return df.select(
        *kept,
        F.lit(f"{stamp.utc:%Y%m%d_%H%M%S}").alias("_ingestion_timestamp"),
        F.lit(f"{stamp.utc:%Y-%m-%d}").alias("_ingestion_date"),
        file.alias(SOURCE_FILE),
        F.lit(entity).alias("_source_entity"),
        row_digest(df.columns, null_safe_hash).alias("_record_hash"),
        *(c.alias(k) for k, c in stamp.partition(*BRONZE_PARTITION).items()),
    )
