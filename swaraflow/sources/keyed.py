"""Tables for lookups by key: written so that Parquet skips row groups, read so that it does.

Rows are dealt by ranges of the key and sorted, so the statistics of a row group span
few keys, and each row group has a Bloom filter of them.  A lookup of a bounded number
of keys is a filter with their values, which reaches the scan: a row group is read
only if a needed key is within its range and in its Bloom filter.  More keys than that
are a semi-join, as then most row groups are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are put into a scan's filter; this many strings are some tens of kilobytes.
MOST_KEYS = 1_000
THRESHOLD = "spark.sql.parquet.pushdown.inFilterThreshold"


def write_keyed(rows: DataFrame, key: str, path: str, row_group_bytes: int = 16 << 20, page_bytes: int = 1 << 20) -> None:
    """Rows of null keys can't be looked up and are left out."""
    sorted_rows = rows.filter(F.col(key).isNotNull()).repartitionByRange(key).sortWithinPartitions(key)
    options = {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.block.size.row.check.min": "100", "parquet.block.size.row.check.max": "1000"}
    sorted_rows.write.options(**options).parquet(path)


def row_groups(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``file, row_group, rows, low, high`` from the footers, which tasks read."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    files = spark.read.parquet(path).inputFiles()

    def read(batches):
        import pyarrow as pa
        import pyarrow.fs
        import pyarrow.parquet as pq

        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, at = pa.fs.FileSystem.from_uri(name)
                with store.open_input_file(at) as source:
                    meta = pq.ParquetFile(source).metadata
                groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
                stats = [next(c.statistics for c in (g.column(j) for j in range(g.num_columns)) if c.path_in_schema == key) for g in groups]
                columns = [[name] * len(groups), list(range(len(groups))), [g.num_rows for g in groups], [str(s.min) for s in stats], [str(s.max) for s in stats]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "row_group", "rows", "low", "high"])

    kind = StructType([StructField("file", StringType()), StructField("row_group", LongType()), StructField("rows", LongType()), StructField("low", StringType()), StructField("high", StringType())])
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files))).mapInArrow(read, kind)


def lookup(spark: SparkSession, path: str, needed: DataFrame, key: str, columns: list[str], most: int = MOST_KEYS) -> DataFrame:
    """``key`` and ``columns`` of the rows whose key is needed.

    The keys are looked at once, up to one more than ``most``.  The session's limit for
    ``IN`` filters that reach Parquet is raised to ``most`` if it is below.
    """
    rows = spark.read.parquet(path).select(key, *columns)
    wanted = needed.select(key).filter(F.col(key).isNotNull()).distinct()
    found = [r[0] for r in wanted.limit(most + 1).collect()]
    if len(found) > most:
        return rows.join(wanted, key, "left_semi")
    if int(spark.conf.get(THRESHOLD)) < most:
        spark.conf.set(THRESHOLD, str(most))
    return rows.filter(F.col(key).isin(sorted(found)))
