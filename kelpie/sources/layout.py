"""Printed text to markdown: fragments to lines, lines to a title, headings and paragraphs, and these to one text a document.

Each step is a window or grouping over a document's lines in their order, so that a document is sorted by one task, which spills; the
order of lines is that of any column. Cases: blank lines and null texts are passed over, a document without other lines has no
rows; a null document id is a document of its own. Of lines at the same place the smaller text comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.parsing import spaced, stripped

#: How long a title may get before it ends, how many lines it may have, and how short a heading is.
TITLE_CHARACTERS, TITLE_LINES, HEADING_CHARACTERS, HEADING_WORDS = 140, 4, 80, 8
#: What ends a title before its line, what numbers a heading, and what joins the fragment before it without a blank.
MARKS = r"[@†]|^[0-9*]"
NUMBER = r"(?:^|[^0-9A-Za-z_])[0-9]+(?:$|[^0-9A-Za-z_])"
NUMBERED = r"^[0-9]+(?:\.[0-9]+)*\s+[A-Z]"
CLOSING = r"^[),.:;?]"


def lines(fragments: DataFrame, doc: str, order: list[str], text: str, ends: Column) -> DataFrame:
    """doc, line (from 0) and text: fragments joined up to each that ends a line, with a blank before all but closing marks."""
    ordered = Window.partitionBy(doc).orderBy(*order, text)
    given = fragments.withColumn("__ended", F.coalesce(ends, F.lit(False)).cast("long")).withColumn("__text", spaced(F.coalesce(text, F.lit(""))))
    before = F.sum("__ended").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__ended")
    placed = given.select(doc, before.alias("__line"), F.row_number().over(ordered).alias("__at"), "__text").filter("__text <> ''")
    joined = F.array_sort(F.collect_list(F.struct("__at", F.when(F.col("__text").rlike(CLOSING), F.col("__text")).otherwise(F.concat(F.lit(" "), "__text")).alias("t"))))
    grouped = placed.groupBy(doc, "__line").agg(stripped(F.array_join(F.transform(joined, lambda x: x["t"]), "")).alias("text"))
    return grouped.select(doc, (F.row_number().over(Window.partitionBy(doc).orderBy("__line")) - 1).cast("long").alias("line"), "text")


def is_heading(line: Column) -> Column:
    """Whether a line opens a part: 'abstract', a number before a capital, or a short line that doesn't end as a sentence does."""
    short = (F.length(line) < HEADING_CHARACTERS) & (F.size(F.split(line, r"\s+")) <= HEADING_WORDS)
    return (F.lower(line) == "abstract") | line.rlike(NUMBERED) | (short & ~line.rlike(r"[.,;]$") & ~line.contains("@"))


def blocks(given: DataFrame, doc: str, order: str, text: str, title: str | None = None) -> DataFrame:
    """doc, block (in order, the title's is 0), kind (title, heading, paragraph) and text. The title is that of the column `title`,
    else the first lines up to one that can't belong to it. Paragraphs join lines with a blank, a line that ends with '-' without it."""
    named = F.nullif(stripped(F.col(title).cast("string")), F.lit("")) if title else F.lit(None).cast("string")
    each = given.select(doc, F.col(order).alias("__order"), stripped(F.col(text)).alias("__text"), named.alias("__title")).filter("__text <> ''")
    ordered = Window.partitionBy(doc).orderBy("__order", "__text")
    so_far, line = ordered.rowsBetween(Window.unboundedPreceding, 0), F.col("__text")
    each = each.withColumn("__n", F.row_number().over(ordered)).withColumn("__long", F.sum(F.length(line) + 1).over(so_far) - F.length(line) - 2)
    barred = line.rlike(MARKS) | (F.lower(line) == "abstract") | ((F.col("__n") > 1) & line.rlike(NUMBER)) | (F.col("__long") > TITLE_CHARACTERS)
    each = each.withColumn("__no", F.max(barred | (F.col("__n") > TITLE_LINES) | F.col("__title").isNotNull()).over(so_far))
    kind = F.when(~F.col("__no"), "title").when(is_heading(line), "heading").otherwise("paragraph")
    each = each.withColumn("kind", kind).withColumn("__before", F.lag("kind").over(ordered))
    opens = F.when(F.col("kind") == "title", 0).when((F.col("kind") == "paragraph") & (F.col("__before") == "paragraph"), 0).otherwise(1)
    each = each.withColumn("block", F.sum(opens).over(so_far).cast("long"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("__n", "__text"))), lambda x: x["__text"])
    made = each.groupBy(doc, "block", "kind").agg(whole.alias("__lines"), F.first("__title").alias("__title"))
    last = F.size("__lines") - 1
    joined = F.array_join(F.transform("__lines", lambda x, i: F.when(i == last, x).when(x.endswith("-"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(F.concat(x, F.lit(" ")))), "")
    shown = made.select(doc, "block", "kind", F.when(F.col("kind") == "title", F.array_join("__lines", " ")).otherwise(stripped(joined)).alias("text"), "__title")
    if title is None:
        return shown.drop("__title")
    front = F.when((F.col("block") == 1) & F.col("__title").isNotNull(), F.array(F.struct(F.lit(0).cast("long").alias("b"), F.lit("title").alias("k"), F.col("__title").alias("t"))))
    own = F.array(F.struct(F.col("block").alias("b"), F.col("kind").alias("k"), F.col("text").alias("t")))
    each = shown.select(doc, F.explode(F.concat(F.coalesce(front, F.slice(own, 1, 0)), own)).alias("x"))
    return each.select(doc, F.col("x.b").alias("block"), F.col("x.k").alias("kind"), F.col("x.t").alias("text"))


def markdown(made: DataFrame, doc: str) -> DataFrame:
    """doc and markdown: the blocks of a document in order, the title as first heading, the others as second ones."""
    marked = F.concat(F.when(F.col("kind") == "title", "# ").when(F.col("kind") == "heading", "## ").otherwise(""), "text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", marked.alias("t")))), lambda x: x["t"])
    return made.groupBy(doc).agg(stripped(F.array_join(parts, "\n\n")).alias("markdown"))
