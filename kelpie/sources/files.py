"""A folder of files as a table, what changed in it, and the sections of markdown files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpie.functions.text import paragraphs, slug


#: Folders that count as one file each, and the folder that the vault's own notes go to.
PACKAGES = r"(?i)\.(app|bundle|framework|photoslibrary|rtfd)$"
VAULT = "Vault"


def scan(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, modified, length and checksum of all files below the folder; what is hidden or in a hidden folder, a package or the
    vault's own folder is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    below = F.substring("path", F.length(F.regexp_extract("path", rf"^.*?{re.escape(folder.rstrip('/'))}/", 0)) + 1, 1 << 30)
    skipped = F.exists(F.split(below, "/"), lambda x: x.startswith(".") | x.rlike(PACKAGES) | (x == VAULT))
    return files.filter(~skipped).select("path", F.col("modificationTime").alias("modified"), "length", F.sha2("content", 256).alias("checksum"), "content")


def changes(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """path and change: new, changed, restored or gone, against the catalogue (path, checksum, deleted_at)."""
    joined = scanned.select("path", F.col("checksum").alias("now")).join(known.select("path", F.col("checksum").alias("was"), "deleted_at"), "path", "full")
    change = (
        F.when(F.col("now").isNull() & F.col("deleted_at").isNull(), "gone").when(F.col("was").isNull() & F.col("now").isNotNull(), "new")
        .when(F.col("now").isNotNull() & F.col("deleted_at").isNotNull(), "restored").when(F.col("now") != F.col("was"), "changed")
    )
    return joined.select("path", change.alias("change")).filter("change is not null")


def preview(content: Column, most: int = 4096) -> Column:
    """The first bytes as text, cut back to whole characters; '[binary]' for what isn't UTF-8."""
    head = F.substring(content, 1, most)
    cuts = [F.try_validate_utf8(F.substring(head, F.lit(1), F.octet_length(head) - k).cast("string")) for k in range(4)]
    whole = F.octet_length(content) <= most
    return F.coalesce(cuts[0], *(F.when(~whole, c) for c in cuts[1:]), F.lit("[binary]"))


def anchors(texts: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, section, heading, key (unique in the file by a number), start_line, end_line and text of the parts that headings open;
    what stands before the first is 'document'."""
    lines = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "value"))
    heading = F.nullif(F.regexp_extract("value", r"^#{1,6}\s+(.*?)\s*#*$", 1), F.lit(""))
    by_line = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    owned = lines.withColumn("h", heading).withColumn("section", F.sum(F.col("h").isNotNull().cast("long")).over(by_line))
    parts = owned.groupBy("id", "section").agg(
        F.max("h").alias("heading"), (F.min("line") + 1).alias("start_line"), (F.max("line") + 1).alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("text"),
    )
    base = F.coalesce(slug(F.col("heading")), F.lit("document"))
    twin = F.row_number().over(Window.partitionBy("id", "base").orderBy("section"))
    keyed = parts.withColumn("base", base).withColumn("twin", twin)
    return keyed.withColumn("key", F.when(F.col("twin") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("twin")))).drop("base", "twin")


def chunks(parts: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, ordinal, text and md5 of the paragraphs of each row; of equal paragraphs of a row the first stays."""
    each = parts.select(F.col(id_col).alias("id"), F.posexplode(paragraphs(F.coalesce(text, F.lit("")))).alias("ordinal", "text")).withColumn("hash", F.md5("text"))
    first = Window.partitionBy("id", "hash").orderBy("ordinal")
    return each.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
