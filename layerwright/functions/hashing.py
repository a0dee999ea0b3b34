from pyspark.sql import Column
from pyspark.sql import functions as F

# Separator and digest size of a record hash.
SEPARATOR = "||"
DIGEST_BITS = 256
NULL_MARK = "-"


def record_hash(columns: list[str], null_safe: bool = False) -> Column:
    """SHA-256 over the text of all columns.

    NULLs are skipped, so (a, NULL, b) and (a, b, NULL) hash alike, and so do values that hold the
    separator and those it separates. ``null_safe=True`` writes each value after its length and
    marks each NULL, so that different rows have different texts.
    """
    values = [F.col(c).cast("string") for c in columns]
    if null_safe:
        marked = [F.concat(F.length(v).cast("string"), F.lit(":"), v) for v in values]
        text = F.concat(*(F.coalesce(v, F.lit(NULL_MARK)) for v in marked))
        return F.sha2(text, DIGEST_BITS)
    return F.sha2(F.concat_ws(SEPARATOR, *values), DIGEST_BITS)
