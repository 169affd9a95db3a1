"""Options, front matter, answers of models and prompts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpie.functions.text import without_narration

_PAIRS = "array<struct<k:string,v:array<string>>>"


def spaced(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _as_map(pairs: Column) -> Column:
    """Of repeated keys the last counts."""
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])))


def options(text: Column) -> Column:
    """'key=value, key=value' as a map; parts without '=' are passed over, an empty key or value makes all of it null."""
    given = F.filter(F.split(text, ","), lambda p: p.contains("="))
    pairs = F.transform(given, lambda p: F.struct(stripped(F.regexp_extract(p, r"(?s)^(.*?)=", 1)).alias("k"), stripped(F.regexp_extract(p, r"(?s)=(.*)$", 1)).alias("v")))
    return F.when(~F.exists(pairs, lambda p: (p["k"] == "") | (p["v"] == "")), _as_map(pairs))


def frontmatter_lists(text: Column) -> Column:
    """Front matter as a map to lists: one item for a scalar, those of '[a, b]', or of the '- ' lines after a key without a value.
    Quotes around items of scalars and brackets go; a text without front matter gives an empty map, a null text null."""
    lines = F.split(F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1), "\n")
    bare = lambda x: F.regexp_replace(stripped(x), r"""^["']+|["']+$""", "")

    def step(done: Column, line: Column) -> Column:
        pairs, item = done["pairs"], stripped(line)
        key, value = stripped(F.regexp_extract(line, r"^([^:]*):", 1)), stripped(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))
        inside = F.filter(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ","), lambda x: x != "")
        items = F.when(value == "", F.array().cast("array<string>")).when(value.rlike(r"^\[.*\]$"), F.transform(inside, bare)).otherwise(F.array(bare(value)))
        last = F.get(pairs, F.size(pairs) - 1)
        grown = F.struct(last["k"].alias("k"), F.concat(last["v"], F.array(F.substring(item, 3, 1 << 30))).alias("v"))
        listed, named = done["open"] & item.startswith("- "), line.contains(":")
        now = F.when(listed, F.concat(F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0))), F.array(grown))).when(named, F.concat(pairs, F.array(F.struct(key.alias("k"), items.alias("v"))))).otherwise(pairs)
        return F.struct(now.cast(_PAIRS).alias("pairs"), (listed | (named & (value == ""))).alias("open"))

    start = F.struct(F.array().cast(_PAIRS).alias("pairs"), F.lit(False).alias("open"))
    return F.aggregate(lines, start, step, lambda done: _as_map(done["pairs"]))


def message(text: Column) -> Column:
    """importance and content of an answer: both of a JSON object (in a fence or bare) where they are strings that aren't blank, else the
    text without its fence and no importance."""
    bare = stripped(F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    value = F.try_parse_json(bare)

    def said(key: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant")) == "STRING"
        return F.nullif(stripped(F.when(is_text, F.try_variant_get(value, f"$.{key}", "string"))), F.lit(""))

    both = said("importance").isNotNull() & said("content").isNotNull()
    return F.struct(F.when(both, F.lower(said("importance"))).alias("importance"), F.when(both, said("content")).otherwise(bare).alias("content"))


def decision(text: Column) -> Column:
    """title and summary of a merge: what follows TITLE: on its line, and all that follows SUMMARY:, without narration; null if empty."""
    title = F.nullif(F.regexp_extract(text, r"(?m)^TITLE:[ \t]*(.*)", 1), F.lit(""))
    summary = F.nullif(F.regexp_extract(text, r"(?sm)^SUMMARY:[ \t]*(.+)", 1), F.lit(""))
    return F.struct(title.alias("title"), without_narration(summary).alias("summary"))


def description(text: Column) -> Column:
    """What follows 'Description:' and one blank on the first line that begins so; null if none does."""
    return F.when(text.rlike(r"(?m)^Description:"), F.regexp_extract(text, r"(?m)^Description: ?(.*)$", 1))


def merge_key(a: Column, b: Column) -> Column:
    """The smaller and the larger id with '-' between."""
    return F.concat_ws("-", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def prompt(query: Column, spoken: Column, texts: Column, most: int = 80_000, clips: tuple[int, int] = (2_000, 700)) -> Column:
    """The query, the spoken text whole and each text clipped, to the first length or, if that is too long in all, to the second.
    Null where even that is too long, or the spoken text leaves no 8000 characters."""
    spoken = F.coalesce(spoken, F.lit(""))
    clipped = lambda n: F.concat_ws("\n", query, spoken, F.transform(texts, lambda t: F.substring(t, 1, n)))
    wide, narrow = map(clipped, clips)
    return F.when(F.length(spoken) < most - 8_000, F.when(F.length(wide) <= most, wide).when(F.length(narrow) <= most, narrow))


_LINKED = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
#: Types of entries that describe a page.
ENTRY = "Article|NewsArticle|BlogPosting|Report|AnalysisNewsArticle|ScholarlyArticle|WebPage"


def _attribute(html: Column, tag: str, name: str, value: str, wanted: str) -> Column:
    """The wanted attribute of the first such tag, in either order of its attributes."""
    said, asked = rf"""{wanted}\s*=\s*["']([^"']*)["']""", rf"""{name}\s*=\s*["']{value}["']"""
    orders = (rf"(?is)<{tag}\b[^>]*?{asked}[^>]*?{said}", rf"(?is)<{tag}\b[^>]*?{said}[^>]*?{asked}")
    return F.coalesce(*(F.nullif(spaced(F.regexp_extract(html, o, 1)), F.lit("")) for o in orders))


def page_metadata(html: Column) -> Column:
    """url, title, author and published of a page: from the first entry of its linked data with a known type, else from its meta tags,
    else its title; empty where nothing says it."""
    blocks = F.transform(F.regexp_extract_all(html, F.lit(_LINKED), 1), stripped)
    graph = lambda x: F.get_json_object(x, "$['@graph']")
    each = F.flatten(F.transform(blocks, lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).when(graph(x).isNotNull(), F.from_json(graph(x), "array<string>")).otherwise(F.array(x))))
    kind = lambda e: F.coalesce(F.get_json_object(e, "$['@type']"), F.lit(""))
    entry = F.get(F.filter(each, lambda e: kind(e).rlike(ENTRY)), 0)
    raw = F.get_json_object(entry, "$.author")
    people = F.transform(F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw)), lambda p: F.when(p.startswith("{"), F.coalesce(F.get_json_object(p, "$.name"), F.get_json_object(p, "$.alternateName"))).otherwise(p))
    meta = lambda name, value: _attribute(html, "meta", name, value, "content")
    some = lambda *given: spaced(F.coalesce(*(F.nullif(g, F.lit("")) for g in given), F.lit("")))
    return F.struct(
        some(_attribute(html, "link", "rel", "canonical", "href"), meta("property", "og:url")).alias("url"),
        some(F.get_json_object(entry, "$.headline"), F.get_json_object(entry, "$.name"), meta("property", "og:title"), meta("name", "twitter:title"), F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        some(F.array_join(people, ", "), meta("name", "author")).alias("author"),
        some(F.get_json_object(entry, "$.datePublished"), meta("property", "article:published_time"), meta("name", "pubdate")).alias("published"),
    )
