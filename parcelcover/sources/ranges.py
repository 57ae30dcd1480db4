"""Files larger than a task: lines in their order, and the members of one JSON array, read in byte ranges.

Spark reads a text file in blocks, each by another task, cut at a separator. What a block can't know by itself - how many
rows come before it, whether it begins inside a string - is a sum over the blocks before it: each block is summed up,
the sums (one row a block) are added up in order, and rows get what stands before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelcover.plans.materialize import materialize


def blocks(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(value, file, block, place) of a path's text files: block is where a task's range begins in its file, place
    ascends within it."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def before(df: DataFrame, amount: Column, name: str) -> DataFrame:
    """df (file, block, place) with name: the sum of amount over the rows of its file before it. A window holds the rows
    of one block, and one row a block of a file."""
    df = df.withColumn("__amount", amount)
    sums = df.groupBy(F.col("file").alias("__file"), F.col("block").alias("__block")).agg(F.sum("__amount").alias("__sum"))
    upto = Window.partitionBy("__file").orderBy("__block")
    sums = sums.withColumn("__sum", F.sum("__sum").over(upto) - F.col("__sum"))
    within = F.sum("__amount").over(Window.partitionBy("file", "block").orderBy("place")) - F.col("__amount")
    out = df.withColumn("__within", within).join(sums, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    return out.withColumn(name, F.col("__sum") + F.col("__within")).drop("__amount", "__within", "__sum", "__file", "__block")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, pos): every line with its place in its file, from 0."""
    return before(blocks(spark, path), F.lit(1), "pos").select(F.col("value").alias("line"), "file", "pos")


_ESCAPES, _STRING = r"\\.", r'"[^"]*("|$)'
#: Anything before the brace that opens an object: no brace but in strings.
_LEAD = r'^(?:[^"{]|"(?:[^"\\]|\\.)*")*'


def array_members(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, pos): each object inside the top object of a path's JSON files, as text, in order: the members of its
    arrays, and its own values that are objects.

    Files are cut after closing braces. A piece begins inside a string if the quotes before it are odd in number; so its
    braces are counted, and depths follow from the sums before it. Pieces between two closing braces of depth two make
    up one object, put together from its own few pieces. Neither line breaks nor block borders matter. The pieces are
    written with what was counted in them, so that the sums read a few numbers a piece and no text.
    """
    pieces = blocks(spark, path, "}")
    # The texts are looked through once, for both cases: a piece that begins outside a string and one that begins inside.
    plain = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", _ESCAPES, "")).otherwise(F.col("value"))
    count = lambda c, mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
    pieces = pieces.withColumn("plain", plain)
    # Most pieces have no brace to count.
    outer = [F.when(F.contains("plain", F.lit("{")), F.regexp_replace(c, _STRING, "")).otherwise("") for c in (F.col("plain"), F.regexp_replace("plain", r'^[^"]*("|$)', ""))]
    pieces = pieces.select("value", "file", "block", "place", count(F.col("plain"), '"').alias("marks"), *[count(c, "{").alias(k) for c, k in zip(outer, ("opens_out", "opens_in"), strict=True)])
    pieces = before(materialize(pieces, "pieces"), F.col("marks"), "quotes")
    opens = F.when(F.col("quotes") % 2 == 1, F.col("opens_in")).otherwise(F.col("opens_out"))
    closes = F.when((F.col("quotes") + F.col("marks")) % 2 == 0, 1).otherwise(0)
    pieces = before(pieces.withColumns({"opens": opens, "closes": closes}), F.col("opens") - F.col("closes"), "depth")
    ends = F.when((F.col("closes") == 1) & (F.col("depth") + F.col("opens") == 2), 1).otherwise(0)
    pieces = before(pieces, ends, "pos")
    parts = pieces.groupBy("file", "pos").agg(F.sort_array(F.collect_list(F.struct("block", "place", "depth", "value"))).alias("parts"), F.max(ends).alias("whole"))
    text = F.concat(F.array_join("parts.value", "}"), F.lit("}"))
    # The first object of a file stands behind the top object's own brace.
    text = F.when(F.col("parts")[0]["depth"] == 0, F.regexp_replace(F.regexp_replace(text, _LEAD, ""), r"^\{", "")).otherwise(text)
    return parts.where("whole = 1").select(F.regexp_replace(text, _LEAD, "").alias("value"), "file", "pos")
