"""CSV at the edges of the system; stages inside it use Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from wardline.operators.columns import quoted as named

# Fixed value: how a missing value is written in the exchanged files.
MISSING = "NA"

# Doubled quotes and untouched blanks, as R and pandas write and expect them.
_DIALECT = {"header": True, "escape": '"'}
_KEEP_BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, missing: str = MISSING) -> DataFrame:
    """Typed read. Without a schema the types are inferred, which costs one extra pass over the files."""
    reader = spark.read.options(**_DIALECT, nullValue=missing).option("enforceSchema", False)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def scan_csv_strings(spark: SparkSession, path: str, missing: str = MISSING) -> DataFrame:
    """Every column as text, so codes keep leading zeros; only the header line is read to plan."""
    return spark.read.options(**_DIALECT, nullValue=missing).csv(path)


def drop_rowname(df: DataFrame, name: str = "X") -> DataFrame:
    """Drop the row-name column some writers put first."""
    return df.drop(name)


def sink_csv(df: DataFrame, path: str, mode: str = "errorifexists", missing: str = MISSING) -> None:
    """Header, no row index, nulls as ``missing``; one file per partition, written in parallel.

    A text that equals the mark would come back as null, so it is refused when it is written: choose another ``missing``.
    The CSV writer takes one pair of single quotes around a column name for markup and drops it, so
    names that have quotes of their own are given a second pair.
    """
    quoted = {c: f"'{c}'" for c in df.columns if len(c) > 1 and c.startswith("'") and c.endswith("'")}
    df = df.withColumnsRenamed(quoted)
    refused = F.raise_error(F.lit(f"a text equals the mark for missing values, {missing!r}")).cast("string")
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    told = {c: F.when(F.col(named(c)) == missing, refused).otherwise(F.col(named(c))) for c in texts}
    df.withColumns(told).write.mode(mode).options(**_DIALECT, **_KEEP_BLANKS, nullValue=missing).csv(path)
