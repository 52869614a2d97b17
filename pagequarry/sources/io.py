"""Pages from files of any kind, and results to files."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import text as T

#: Labels that Spark decodes by itself, and other names for them.
CHARSETS = {
    "utf-8": "UTF-8",
    "utf8": "UTF-8",
    "us-ascii": "US-ASCII",
    "ascii": "US-ASCII",
    "iso-8859-1": "ISO-8859-1",
    "latin1": "ISO-8859-1",
    "latin-1": "ISO-8859-1",
    "utf-16": "UTF-16",
    "utf-16le": "UTF-16LE",
    "utf-16be": "UTF-16BE",
    "utf-32": "UTF-32",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if it is so small that a few tasks would read it all.

    Larger tables are read as they lie; the optimizer's estimate of the size decides.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * (16 << 20) else df


def decode_bytes(data: Column, charset: str = "utf-8") -> Column:
    """Bytes to text.  A UTF-16 byte order mark overrules the charset; bytes that UTF-8 can't hold become U+FFFD."""
    head = F.hex(F.substring(data, 1, 2))
    label = charset.strip().lower()
    name = CHARSETS.get(label)
    if name is None:
        plain = _other_charset(data, label)
    elif name == "UTF-8":
        plain = F.make_valid_utf8(data.cast("string"))
    else:
        plain = F.decode(data, name)
    return (
        F.when(head == "FFFE", F.decode(F.substring(data, 3, 2147483647), "UTF-16LE"))
        .when(head == "FEFF", F.decode(F.substring(data, 3, 2147483647), "UTF-16BE"))
        .otherwise(plain)
    )


def _other_charset(data: Column, label: str) -> Column:
    codecs.lookup(label)  # an unknown label fails here, not in a task

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode(label, "replace"))

    return decoded(data)


def read_files(spark: SparkSession, path: str, charset: str = "utf-8", glob: str = "*.html") -> DataFrame:
    """``url, html`` of every file under a path, one row each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("url"), decode_bytes(F.col("content"), charset).alias("html"))


def json_lines(result: DataFrame, with_content: bool = True) -> DataFrame:
    """Each row as one JSON object; bytes as base64; ``content`` null unless asked for."""
    columns = []
    for field in result.schema:
        c = F.col(field.name)
        if field.name == "content" and not with_content:
            c = F.lit(None).cast("string")
        if field.dataType.typeName() == "binary":
            c = T.base64(c)
        columns.append(c.alias(field.name))
    return result.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(result: DataFrame, path: str, with_content: bool = True) -> None:
    json_lines(result, with_content).write.mode("overwrite").text(path)
