"""Reading and writing tables (SRC1 to SRC5)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortflow.session import cut_lineage
from cohortflow.sources import records


def load(
    spark: SparkSession,
    base: str,
    name: str,
    columns: Sequence[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Scan one parquet table; filter and projection reach the file reader."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: object,
    upper: object,
    partitions: int,
    **options: str,
) -> DataFrame:
    """Scan a table of a relational server in parallel slices of one column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return reader.options(
        partitionColumn=partition_column,
        lowerBound=str(lower),
        upperBound=str(upper),
        numPartitions=str(partitions),
    ).load()


def cohort_extract(
    src: DataFrame,
    cohort: DataFrame,
    key: str,
    ts: str,
    start: object = None,
    end: object = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of a source inside [start, end] whose key is in the cohort."""
    if start is not None:
        src = src.where(F.col(ts) >= F.lit(start))
    if end is not None:
        src = src.where(F.col(ts) <= F.lit(end))
    if columns:
        src = src.select(*dict.fromkeys([key, *columns]))
    return src.join(cohort.select(key), key, "left_semi")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Delimited files with a header each; large ones are read by many tasks, quoted line feeds included."""
    return records.read_csv(spark, path, schema)


def write_csv(df: DataFrame, path: str) -> None:
    """Texts come back as they were: an empty one is quoted, a NULL is nothing, white space stays."""
    df.write.csv(
        path,
        header=True,
        escape='"',
        emptyValue='""',
        nullValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        mode="errorifexists",
    )


def read_json_records(
    spark: SparkSession, path: str, schema: StructType | str, array: bool = False
) -> DataFrame:
    """Records from JSON lines, or from files that each hold one JSON array; many tasks read either."""
    if array:
        return records.read_json_array(spark, path, schema)
    return spark.read.json(path, schema=schema)


def write_json(df: DataFrame, path: str) -> None:
    """One record a line; text outside ASCII stays readable."""
    df.write.json(path, mode="errorifexists", ignoreNullFields=False)


def write_json_array(df: DataFrame, path: str) -> None:
    """Files that each hold one JSON array, a record a line; NULLs and text outside ASCII are kept."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last record of a file has no comma behind it, so one is always held back.
        held, begin = None, "["
        for batch in batches:
            lines = []
            for text in batch.column(0).to_pylist():
                if held is not None:
                    lines.append(f"{begin}{held},")
                    begin = ""
                held = text
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        last = f"{begin}{held if held is not None else ''}]"
        yield pa.RecordBatch.from_arrays([pa.array([last])], names=["value"])

    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.select(text.alias("value")).mapInArrow(bracketed, "value string").write.text(path)


def save_by_key(
    df: DataFrame, table: str, path: str, key: str, buckets: int, order: Sequence[str] = ()
) -> DataFrame:
    """Keep a frame in the catalog by buckets of a key, and read it back.

    Frames kept by the same key and number of buckets join and group by that key
    without a shuffle.  A bucket is one file, so it has the rows of one task.
    """
    spread = df.repartition(buckets, key).sortWithinPartitions(key, *order)
    writer = spread.write.format("parquet").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key, *order).saveAsTable(table)
    return df.sparkSession.table(table)


def _removed(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def replace_stored(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    key: str,
    part: str,
    staged: str,
    ids: DataFrame | None = None,
) -> list:
    """Replace keys in a stored table that is partitioned by ``part``; gives the partitions touched.

    Rows of the keys in ``ids`` (those of ``new`` by default) go, ``new`` comes.
    Only partitions with such rows are read and written.  Their new content is
    first written whole to the folder ``staged``; a run that finds it complete
    goes on from there, so a run that broke off may be repeated, and a second
    run changes nothing.  The list of partitions is as long as the table's folder.
    """
    done, emptied = f"{staged.rstrip('/')}/parts", f"{staged.rstrip('/')}/emptied"
    if not _there(spark, f"{emptied}/_SUCCESS"):
        old = spark.read.parquet(path)
        gone = (new if ids is None else ids).select(key).where(F.col(key).isNotNull()).distinct()
        touched = old.join(gone, key, "left_semi").select(part).unionByName(new.select(part)).distinct()
        values = sorted((r[0] for r in touched.collect()), key=lambda v: (v is not None, v))
        known = [v for v in values if v is not None]
        inside = F.col(part).isin(known) if known else F.lit(False)
        if None in values:
            inside = inside | F.col(part).isNull()
        kept = old.where(inside).join(gone, key, "left_anti").select(*old.columns)
        _removed(spark, done)
        kept.unionByName(new.select(*old.columns)).write.parquet(done)
        left = {r[0] for r in spark.read.parquet(done).select(part).distinct().collect()}
        rows = [(str(v) if v is not None else None, v in left) for v in values]
        _removed(spark, emptied)
        spark.createDataFrame(rows, "part string, filled boolean").coalesce(1).write.parquet(emptied)
    parts = spark.read.parquet(emptied).collect()
    if any(r["filled"] for r in parts):
        writer = spark.read.parquet(done).write.mode("overwrite").partitionBy(part)
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    for r in parts:
        if not r["filled"]:
            _removed(spark, f"{path.rstrip('/')}/{_folder(spark, part, r['part'])}")
    _removed(spark, staged)
    return sorted((r["part"] for r in parts), key=lambda v: (v is not None, v))


def _folder(spark: SparkSession, part: str, value: str | None) -> str:
    """The folder that the writer gives a value of the partition column."""
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return names.getPartitionPathString(part, value)


def materialize(df: DataFrame, path: str | None = None, mode: str = "save") -> DataFrame:
    """Keep an intermediate result, by switch.

    ``save`` writes parquet and reads it back, ``read`` only reads it,
    ``checkpoint`` keeps it in the shared folder, ``off`` passes it through.
    """
    if mode == "off":
        return df
    if mode == "checkpoint":
        return cut_lineage(df)
    if path is None or mode not in ("save", "read"):
        raise ValueError("save and read need a path")
    if mode == "save":
        df.write.parquet(path, mode="errorifexists")
    return df.sparkSession.read.parquet(path)
