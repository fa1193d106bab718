"""Tables of the base engine in the shared folder: written once, read as often as needed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .shared import shared_dir


def new_place(df_or_spark, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    spark = df_or_spark.sparkSession if isinstance(df_or_spark, DataFrame) else df_or_spark
    return f"{shared_dir(spark)}/swaraflow/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as read back from Parquet: what follows starts from files, not from its lineage."""
    path = new_place(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
