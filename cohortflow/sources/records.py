"""Records of text files that are cut at bytes: quoted line feeds, and arrays in one file.

A file is read in pieces that end at a separator, by as many tasks as it has
blocks.  What a piece means depends on what stands before it: within quotes or
not, how deep in braces.  That state is a running sum, inside each block and
over one row per block of a file, so no task reads a file as a whole; pieces
then go together by the number of record ends before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# A text that stands for NULL where a field is read that is empty and without quotes.
NO_VALUE = "\u0000NULL\u0000"

BLOCK = ["file", "block"]


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, at, text): what stands between separators, in order of block and at within a file."""
    lines = spark.read.option("lineSep", separator).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("text"),
    )


def running(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all pieces of the file before this one."""
    inside = Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*BLOCK).agg(F.sum(value).alias("_sum"))
    offsets = blocks.select(*BLOCK, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inner = df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return inner.join(offsets, BLOCK).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def joined(df: DataFrame, separator: str) -> DataFrame:
    """(file, record, text) of pieces with ``ends``, true for the last piece of a record.

    A piece that is a record by itself goes on as it is; only the pieces of
    longer records meet in a group, which has the size of that record.
    """
    numbered = running(df.withColumn("_end", F.col("ends").cast("int")), "_end", "record")
    previous = F.lag("ends").over(Window.partitionBy(*BLOCK).orderBy("at"))
    marked = numbered.withColumn("_alone", F.col("ends") & F.coalesce(previous, F.lit(False)))
    alone = marked.where("_alone").select("file", "record", "text")
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "text")))
    whole = F.array_join(F.transform(parts, lambda p: p["text"]), separator)
    several = marked.where("NOT _alone").groupBy("file", "record").agg(whole.alias("text"))
    return alone.unionByName(several)


def csv_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, record, text): the records of delimited files; line feeds within quotes belong to the text.

    A quote within quotes is doubled.  A quote that is never closed makes the
    rest of its file one record.
    """
    lines = pieces(spark, path, "\n")
    quotes = F.length("text") - F.length(F.replace(F.col("text"), F.lit(quote)))
    counted = running(lines.withColumn("_quotes", quotes), "_quotes", "_open")
    ends = counted.withColumn("ends", (F.col("_open") + F.col("_quotes")) % 2 == 0)
    return joined(ends.select(*BLOCK, "at", "text", "ends"), "\n")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of delimited files with a header each.

    A quoted empty field is an empty text, an empty one without quotes is NULL.
    Line ends may be ``\\n`` or ``\\r\\n``.
    """
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    rows = csv_records(spark, path).where("record > 0")
    text = F.regexp_replace("text", "\r$", "")
    options = {"escape": '"', "nullValue": NO_VALUE, "emptyValue": ""}
    # A last line feed leaves an empty piece behind only in files that end with two.
    return rows.where(text != "").select(F.from_csv(text, ddl, options).alias("_row")).select("_row.*")


def _outside(text: Column, quoted: Column) -> Column:
    """What of a piece stands outside of JSON strings; ``quoted``: it begins within one."""
    parts = F.split(F.regexp_replace(text, r"\\.", ""), '"')
    kept = F.filter(parts, lambda _, i: (i + quoted.cast("int")) % 2 == 0)
    return F.array_join(kept, "")


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the objects of files that each hold one JSON array of objects.

    Files are cut at closing braces; those within strings or deeper objects end
    no record.
    """
    cut = pieces(spark, path, "}")
    plain = F.regexp_replace("text", r"\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"')))
    counted = running(cut.withColumn("_quotes", quotes), "_quotes", "_open")
    begins, ends = F.col("_open") % 2 == 1, (F.col("_open") + F.col("_quotes")) % 2 == 0
    outside = _outside(F.col("text"), begins)
    opened = F.length(outside) - F.length(F.replace(outside, F.lit("{")))
    deep = counted.withColumn("_step", opened - ends.cast("int")).withColumn("_closes", ends)
    levels = running(deep, "_step", "_depth")
    last = F.col("_closes") & (F.col("_depth") + F.col("_step") == 0)
    records = joined(levels.withColumn("ends", last).select(*BLOCK, "at", "text", "ends"), "}")
    # Before an object stand the array's bracket, a comma, white space; behind the last one its end.
    start = F.instr("text", "{")
    return records.where(start > 0).withColumn(
        "text", F.concat(F.substring("text", start, F.length("text")), F.lit("}"))
    )


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of files that each hold one JSON array of objects."""
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    rows = json_array_records(spark, path)
    return rows.select(F.from_json("text", ddl).alias("_row")).select("_row.*")
