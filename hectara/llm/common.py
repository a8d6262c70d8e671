"""Helpers shared by the corpus operators."""
from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of anything but space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(*parts: Column) -> Column:
    """60 evenly spread bits of the md5 of the parts joined by |, null parts left out; any SQL engine can repeat it."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def packed(docs: DataFrame, *beside: Column | str) -> DataFrame:
    """All columns of docs as the struct _row, out of the way of other names, and the columns `beside` it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *beside)


def unpacked(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of docs out of _row; those in `changed` by their new values."""
    return [changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark context, so that their Python workers can import it."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if any(os.path.basename(f) == "hectara_package.zip" for f in context.listFiles):
        return
    packed = os.path.join(tempfile.mkdtemp(prefix="spark-"), "hectara_package.zip")
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(packed)


def map_chunks(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: StructType, rows: int = 512) -> DataFrame:
    """Rows through a Python function in chunks of a bounded number of rows, so that lists of long texts stay small.

    fn gets and returns columns as lists. Columns of `schema` that fn leaves out are passed through from the input.
    """
    ship_package(df.sparkSession)
    names, kinds = df.columns, to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = fn({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                columns = []
                for field in kinds:
                    if field.name in made:
                        columns.append(pa.array(made[field.name], type=field.type))
                    else:
                        columns.append(part.column(names.index(field.name)).cast(field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return df.mapInArrow(run, schema)


def with_fields(schema: StructType, new: StructType) -> StructType:
    """`schema` with the fields of `new` added; a field of the same name is replaced."""
    taken = {f.name.lower() for f in new}
    return StructType([f for f in schema if f.name.lower() not in taken] + list(new))
