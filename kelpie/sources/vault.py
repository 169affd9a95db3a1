"""Markdown notes as one source of four tables: files, anchors, chunks and links, and the files that links lead to.

Notes are rows of path and content (binary), read from a folder or made from any table. Lines are numbered within their file and
written once, each with the heading that owns it; the tables are read from them. A file's lines are sorted by one task, which spills;
nothing but a section is ever held as one row beside the file itself. Parsing is by column expressions alone.

Cases: headings are those that begin with '#' outside fenced code (any line of three or more ` or ~ opens or ends a fence). A file
that isn't UTF-8 is binary: it has a row in files, and no lines. An empty text has the anchor 'document' and no chunks. A null
content is a binary file without checksum; a null path is left out.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpie.functions import parsing as ps
from kelpie.functions import text as tx
from kelpie.plans.storage import cut
from kelpie.sources import files

FRONT = r"\A---\n(?s:.*?)\n---\n"
FENCE = r"^ {0,3}(?:`{3,}|~{3,})"
HEADING = r"(?s)^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\z"
WIKI = r"\[\[([^\]]+)\]\]"
LINK = r'(?<![!\[])\[([^\[\]]*)\]\(\s*<?([^()\s<>]*)>?(?:\s+"[^"]*")?\s*\)'
OUTSIDE = r"^(?:https?://|mailto:)"
MOST = 1 << 30
SHARES = 16


def read(spark: SparkSession, folder: str, below: str = "", glob: str = "*") -> DataFrame:
    """path (from the folder on), modified, length, checksum and content of the folder's files; only those below a part of it are
    listed and read if one is named. Spark's readers pass over files of no bytes, so these aren't there."""
    root = folder.rstrip("/")
    found = files.scan(spark, f"{root}/{below.strip('/')}".rstrip("/"), glob)
    start = F.length(F.regexp_extract("path", rf"^.*?{re.escape(root)}/", 0)) + 1
    return found.withColumn("path", F.substring("path", start, F.lit(MOST)))


def stem(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def sought_key(name: Column) -> Column:
    """How files are looked up: lower case, '/' for backslashes, no dots and slashes around it."""
    return F.regexp_replace(F.lower(F.replace(name, F.lit("\\"), F.lit("/"))), r"^[./]+|[./]+$", "")


def plain_line(line: Column) -> Column:
    """A line of markdown as text: links are their labels, quotes, bullets, numbers and code marks go; a heading is blank."""
    text = line
    for pattern, kept in (
        (r"\[\[[^|\]]+\|([^\]]+)\]\]", "$1"), (WIKI, "$1"), (r"\[([^\[\]]*)\]\([^)]+\)", "$1"), (r"^\s{0,3}>\s?", ""), (r"^\s{0,3}[-*+]\s+", ""),
        (r"^\s{0,3}\d+\.\s+", ""), (r"`{1,3}([^`]+)`{1,3}", "$1"),
    ):
        text = F.regexp_replace(text, pattern, kept)
    return F.when(line.rlike(r"^\s*#"), "").otherwise(ps.stripped(text))


def _lines(notes: DataFrame, marked_only: bool = False) -> DataFrame:
    """path, line, value, code, heading and section: the line of the heading that owns it, 0 before the first. Of all lines, or of those
    that are headings or hold a link. Lines are looked at once, before they are put in order."""
    parts = F.split(F.when(F.contains("body", F.lit("\r")), F.regexp_replace("body", r"\r\n?", "\n")).otherwise(F.col("body")), "\n")
    each = notes.select("path", F.size(F.split("front", "\n")).alias("before"), F.posexplode(parts).alias("at", "value"))
    fence = F.when(F.contains("value", F.lit("```")) | F.contains("value", F.lit("~~~")), F.col("value").rlike(FENCE)).otherwise(False)
    named = F.when(F.contains("value", F.lit("#")) & F.col("value").rlike(HEADING), F.regexp_replace(F.regexp_extract("value", HEADING, 1), r"[*`]+", ""))
    seen = each.select("path", (F.col("at") + F.col("before")).alias("line"), "value", fence.alias("fence"), named.alias("named"))
    linked = F.contains("value", F.lit("[[")) | F.contains("value", F.lit("]("))
    if marked_only:
        tasks = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # all of them: such lines are packed much closer than they are sorted
        seen = seen.filter(F.col("fence") | F.col("named").isNotNull() | linked).repartition(tasks, "path")
    so_far = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    code = F.col("fence") | (F.sum(F.col("fence").cast("int")).over(so_far) % 2 == 1)
    marked = seen.withColumn("code", code).select("path", "line", "value", "code", F.when(~F.col("code"), F.col("named")).alias("heading"))
    owner = F.max(F.when(F.col("heading").isNotNull(), F.col("line"))).over(so_far)
    return marked.withColumn("section", F.coalesce(owner, F.lit(0)))


def _keyed(lines: DataFrame) -> DataFrame:
    """The lines with key: of headings their key, of others null. Keys are slugs of headings, with the number of the twin from the second on;
    'document' counts as taken. If that key is taken too the number goes up by one, and if that is, the line is added after a dot, which
    no slug holds: keys are unique in their file."""
    base = F.when(F.col("heading").isNotNull(), tx.slug(F.coalesce(F.nullif("heading", F.lit("")), stem(F.col("path")))))
    nth = lambda name: F.row_number().over(Window.partitionBy("path", name).orderBy("section"))
    at = lines.withColumn("base", base)
    at = at.withColumn("n", nth("base") + F.when(F.col("base") == "document", 1).otherwise(0))
    numbered = lambda more: F.concat("base", F.lit("-"), (F.col("n") + more).cast("string"))
    at = at.withColumn("key", F.when(F.col("n") == 1, F.col("base")).otherwise(numbered(0))).withColumn("twin", nth("key"))
    at = at.withColumn("key", F.when(F.col("twin") == 1, F.col("key")).otherwise(numbered(1))).withColumn("twin", nth("key"))
    key = F.when(F.col("twin") == 1, F.col("key")).otherwise(F.concat("key", F.lit("."), F.col("section").cast("string")))
    return at.withColumn("key", F.when(F.col("heading").isNotNull(), key)).drop("base", "n", "twin")


class Vault:
    """The tables of a set of notes. Sections are told apart by path and section (the heading's line, 0 for the whole file)."""

    def __init__(self, notes: DataFrame):
        text = F.try_validate_utf8(F.col("content").cast("string"))
        front = F.regexp_extract("text", FRONT, 0)
        read = notes.filter("path is not null").select("path", "content", text.alias("text")).withColumn("front", front)
        self.notes = read.withColumn("body", F.substring("text", F.length("front") + 1, F.lit(MOST)))

    @cached_property
    def lines(self) -> DataFrame:
        """All lines, written once."""
        return cut(_lines(self.notes.filter("text is not null")))

    @cached_property
    def marks(self) -> DataFrame:
        """The headings and the lines with links, written once, with owner: the key of the section that owns the line. A file's lines come
        together in one task, and keys are given there."""
        keyed = _keyed(_lines(self.notes.filter("text is not null"), marked_only=True))
        so_far = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
        return cut(keyed.withColumn("owner", F.last("key", ignorenulls=True).over(so_far)).drop("key"))

    def keys(self) -> DataFrame:
        """path, section, heading and key of the headings."""
        return _keyed(self.lines.filter("heading is not null").select("path", "section", "heading")).select("path", "section", "heading", "key")

    def _blocks(self) -> DataFrame:
        """path, section, end_line and the section's lines as an array, without its heading and a blank line right under it."""
        given = F.transform(F.array_sort(F.collect_list(F.when(F.col("heading").isNull(), F.struct("line", "value")))), lambda x: x["value"])
        grouped = self.lines.groupBy("path", "section").agg(given.alias("given"), F.max("line").alias("end_line"))
        blank = (F.col("section") > 0) & (F.trim(F.get("given", F.lit(0))) == "")
        return grouped.withColumn("given", F.when(blank, F.slice("given", 2, MOST)).otherwise(F.col("given")))

    def anchors(self) -> DataFrame:
        """path, section, type, key, heading, start_line, end_line and text_hash: one row for each file as a whole ('document', with
        the file's name and all its lines) and for each heading."""
        named = self.keys().join(self._blocks(), ["path", "section"]).select(
            "path", "section", F.lit("heading").alias("type"), "key", "heading", F.col("section").alias("start_line"), "end_line",
            F.sha2(F.array_join("given", "\n"), 256).alias("text_hash"),
        )
        count = F.size(F.split("text", r"\r\n|\n|\r"))
        whole = self.notes.filter("text is not null").select(
            "path", F.lit(0).alias("section"), F.lit("document").alias("type"), F.lit("document").alias("key"), stem(F.col("path")).alias("heading"),
            F.lit(1).alias("start_line"), count.alias("end_line"), F.sha2("body", 256).alias("text_hash"),
        )
        return whole.unionByName(named)

    def chunks(self) -> DataFrame:
        """path, section, ordinal (from 0), text and hash of the paragraphs of each section's own lines, as plain text."""
        plain = F.array_join(F.transform("given", plain_line), "\n")
        parts = F.filter(F.transform(F.split(plain, r"\n{2,}"), ps.stripped), lambda p: p != "")
        return self._blocks().select("path", "section", F.posexplode(parts).alias("ordinal", "text")).withColumn("hash", F.sha2("text", 256))

    def links(self) -> DataFrame:
        """path, key (of the section that owns the link), type, text, to_path and to_anchor of each different link. to_path is resolved
        from the file's folder, or from the top after '/'; '#anchor' is in the file itself; both are null for addresses outside."""
        key = F.coalesce("owner", F.lit("document")).alias("key")
        wiki = self.marks.filter(F.contains("value", F.lit("[["))).select("path", key, F.explode(F.regexp_extract_all("value", F.lit(WIKI), 1)).alias("raw"))
        label, to = F.substring("raw", F.locate("|", F.col("raw")) + 1, F.lit(MOST)), F.substring_index("raw", "|", 1)
        wiki = wiki.select("path", "key", F.lit("wikilink").alias("type"), F.when(label == "", to).otherwise(label).alias("text"), to.alias("to"))
        marked = self.marks.filter(~F.col("code") & F.contains("value", F.lit("]("))).select("path", key, F.explode(F.regexp_extract_all("value", F.lit(LINK), 0)).alias("raw"))
        marked = marked.select("path", "key", F.lit("markdown").alias("type"), F.regexp_extract("raw", LINK, 1).alias("text"), F.regexp_extract("raw", LINK, 2).alias("to"))
        found = wiki.unionByName(marked)
        # a step a column: what is used more than once isn't worked out again
        found = found.withColumns({"outside": F.col("to").rlike(OUTSIDE), "folder": F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)})
        found = found.withColumn("resolved", F.when(~F.col("outside"), tx.resolved_path(F.col("folder"), F.col("to"))))
        own = F.when(~F.col("outside"), F.when(F.startswith("to", F.lit("#")), F.col("path")).when(F.col("resolved") != "", F.col("resolved")))
        after = F.when(~F.col("outside") & F.contains("to", F.lit("#")), F.substring("to", F.locate("#", F.col("to")) + 1, F.lit(MOST)))
        found = found.withColumn("to_path", own).withColumn("after", after)
        return found.select("path", "key", "type", "text", "to_path", F.when(F.col("after") != "", F.col("after")).alias("to_anchor")).distinct()

    def files(self) -> DataFrame:
        """path, title (that of the front matter, else the first heading, else the file's name), aliases (sorted), checksum, length and
        metadata: the front matter as JSON of lists by name, a scalar as a list of one, or the kind of content."""
        known = self.lines if "lines" in self.__dict__ else self.marks  # what is written already
        first = known.filter("heading is not null").groupBy("path").agg(F.min_by("heading", "line").alias("first"))
        given = self.notes.withColumn("front_matter", ps.frontmatter_lists(F.coalesce("front", F.lit("")))).join(first, "path", "left")
        said = F.nullif(F.get(F.col("front_matter")["title"], F.lit(0)), F.lit(""))
        aliases = F.array_compact(F.concat(F.array(stem(F.col("path")), said), F.coalesce(F.col("front_matter")["aliases"], F.array().cast("array<string>"))))
        ordered = F.map_from_entries(F.array_sort(F.map_entries("front_matter")))
        kind = F.when(F.col("text").isNull(), '{"content_type":"binary"}').when(F.col("front") == "", '{"content_type":"markdown"}').otherwise(F.to_json(ordered))
        return given.select(
            "path", F.coalesce(said, "first", stem(F.col("path"))).alias("title"), F.array_sort(F.array_distinct(F.filter(aliases, lambda a: a != ""))).alias("aliases"),
            F.sha2("content", 256).alias("checksum"), F.octet_length("content").cast("long").alias("length"), kind.alias("metadata"),
        )

    def targets(self, links: DataFrame) -> DataFrame:
        """to_path and to_file of all that these links lead to: the file of that path, alias, name or title, then of the last part's name, then
        with .md or .markdown added. Of several files with a key the one with the smallest path counts; null if there is none."""
        names = self.files().select("path", F.explode(F.array_union("aliases", F.array("path", "title"))).alias("name"))
        known = names.groupBy(sought_key(F.col("name")).alias("sought")).agg(F.min("path").alias("to_file"))
        wanted = links.select("to_path").filter("to_path is not null").distinct()
        key = sought_key(F.col("to_path"))
        tried = wanted.select("to_path", F.posexplode(F.array(key, sought_key(stem(F.col("to_path"))), F.concat(key, F.lit(".md")), F.concat(key, F.lit(".markdown")))).alias("nth", "sought"))
        return tried.join(known, "sought", "left").groupBy("to_path").agg(F.min_by("to_file", F.when(F.col("to_file").isNotNull(), F.col("nth"))).alias("to_file"))

    def resolved_links(self) -> DataFrame:
        """The links, written once, with to_file; those that lead to no known file have none. A file that a great part of all links lead
        to is met in SHARES tasks: targets are one row a path, so that repeating them costs little."""
        links = cut(self.links())
        shared = self.targets(links).withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        dealt = links.withColumn("__share", F.pmod(F.xxhash64("path", "key", "text"), F.lit(SHARES)).cast("int"))
        return dealt.join(shared, ["to_path", "__share"], "left").drop("__share")
