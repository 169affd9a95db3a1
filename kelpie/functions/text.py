"""Scalar text functions as column expressions; the word lists and patterns are fixed values."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def normalized_name(name: Column) -> Column:
    """White space collapsed; case, accents and width folded."""
    return folded(F.trim(F.regexp_replace(name, r"\s+", " ")))


def slug(heading: Column) -> Column:
    """Lower case, runs of other than letters and digits as '-', 'section' if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(heading), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    return F.when(bare == "", "section").otherwise(bare)


def file_name(name: Column) -> Column:
    """A name without characters that paths can't hold."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r'[/\\:*?"<>|]+', " "), r"\s+", " "))


def xml_escaped(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def clipped(text: Column, most: int = 12000) -> Column:
    return F.substring(text, 1, most)


def token_estimate(text: Column) -> Column:
    """The largest of four thirds of the words, a quarter of the characters, and 1, in whole numbers."""
    words = F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))
    return F.greatest(F.floor(words * 4 / 3), F.floor(F.length(text) / 4), F.lit(1)).cast("long")


def without_thinking(text: Column) -> Column:
    """Without <think> blocks, also one that doesn't end."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", ""))


def label_or(value: Column, prefix: str, id_: Column) -> Column:
    """The trimmed value, or prefix and id if it is blank."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.concat(F.lit(prefix), id_.cast("string")))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text: parted by blank lines, trimmed, none blank."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), F.trim), lambda p: p != "")


def wiki_links(text: Column) -> Column:
    """Destinations of [[destination|label]] links."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), 1), F.trim)


#: What a term is made of. All characters beyond ASCII belong to terms.
TERM = r"a-z0-9\x{80}-\x{10FFFF}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, _UPPER, _LOWER)


def terms(text: Column) -> Column:
    """The terms in order: runs of ASCII letters and digits, lower-cased, and of all characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), f"[^{TERM}]+"), "")


def term_count(text: Column) -> Column:
    """How many terms a text has."""
    return F.regexp_count(text, F.lit(f"[A-Z{TERM}]+"))


def times(text: Column, word: str) -> Column:
    """How often a text has the word, in lower case, as a term; words with other characters never are terms."""
    if not re.fullmatch(r"[a-z0-9\x80-\U0010FFFF]+", word):
        return F.lit(0)
    return F.regexp_count(text, F.lit(f"(?i)(?<![A-Z{TERM}]){word}(?![A-Z{TERM}])"))  # the flag means ASCII letters alone


def _fold(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text and text.lower()
    wide = "".join(unicodedata.normalize("NFKC", c) if "\uff00" <= c <= "\uffef" else c for c in text.lower())
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", wide) if unicodedata.category(c) != "Mn"))


def folded(text: Column) -> Column:
    """Case, accents and width folded, by full decomposition."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(_fold, na_action="ignore")

    return fold(text)


def keywords(text: Column, stop: list[str], most: int = 12) -> Column:
    """The first distinct folded words of two characters or more that aren't stop words; if all are, the first of those."""
    words = F.array_distinct(F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1))
    said = F.filter(words, lambda t: ~t.isin(stop)) if stop else words
    return F.slice(F.when(F.size(said) == 0, words).otherwise(said), 1, most)


def labelled_line(text: Column, label: str) -> Column:
    """What follows 'Label:' on the first line that starts so; null if none does."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^{label}:[ \t]*(.*)$", 1)), F.lit(""))


def fenced_json(text: Column) -> Column:
    """The body of the first fenced block, or the text itself without a fence."""
    body = F.regexp_extract(text, r"(?s)```[a-zA-Z]*\s*\n(.*?)\s*```", 1)
    return F.trim(F.when(body == "", text).otherwise(body))


def human_size(value: Column) -> Column:
    """Bytes of '30MB' and the like; null if it isn't a size."""
    unit = F.upper(F.regexp_extract(value, r"(?i)^\s*\d+\s*([KMG]?)B?\s*$", 1))
    number = F.nullif(F.regexp_extract(value, r"(?i)^\s*(\d+)\s*[KMG]?B?\s*$", 1), F.lit("")).cast("long")
    return number * F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)


def frontmatter(text: Column) -> Column:
    """The scalar 'key: value' lines between the first two '---' lines as a map; of repeated keys the last counts."""
    head = F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    lines = F.filter(F.split(head, r"\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:[ \t]*\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[\w-]+:", "")), r"""^(["'])(.*)\1$""", "$2").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


#: What narrations begin with.
NARRATION = (
    "the user was ", "the user is ", "the user appears to be ", "this screenshot shows ", "the screenshot shows ", "this image shows ",
    "the image shows ", "a screenshot of ", "an image of ",
)
#: Words that make no keyword of a search.
STOP_WORDS = ("a", "an", "and", "as", "at", "for", "from", "in", "into", "of", "on", "or", "the", "to", "with")
GENERIC_TERMS = (
    "application", "app", "browser", "click", "code", "content", "current", "currently", "desktop", "dialog", "display", "field", "file", "icon",
    "image", "input", "interface", "menu", "modal", "open", "opened", "panel", "page", "screen", "screenshot", "section", "selected", "shows",
    "showing", "sidebar", "tab", "text", "toolbar", "user", "using", "view", "visible", "website", "window", "show", "use", "work",
)


#: Letters whose upper case is several letters, and the single letter that stands for it: ß's own, a title letter, or else the letter itself.
_EXPANDING = [c for c in map(chr, (*range(1, 0xD800), *range(0xE000, 0x110000))) if len(c.upper()) > 1]
_SINGLE = ["ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _EXPANDING]


def upper_letter(letter: Column) -> Column:
    """The upper case of one letter as one letter."""
    upper = F.upper(letter)
    return F.when(F.length(upper) > 1, F.translate(letter, "".join(_EXPANDING), "".join(_SINGLE))).otherwise(upper)


def without_narration(text: Column) -> Column:
    """Without narrating beginnings, however many, and with a capital first letter; the text itself if nothing else is in it."""
    told = "|".join(NARRATION).replace("s", "[sſ]")  # a long s is an s in any case
    bare = F.regexp_replace(text, rf"(?i)\A(?:{told})+", "")
    return F.when(bare == "", text).otherwise(F.concat(upper_letter(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 30)))


def clipped_join(prefix: str, text: Column, most: int = 12000) -> Column:
    return F.substring(F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))), 1, most)


def resolved_path(folder: Column, target: Column) -> Column:
    """A link's target from a folder: '.' and '..' resolved, what follows '#' left out, null for other sites and bare anchors."""
    bare = F.trim(F.split_part(target, F.lit("#"), F.lit(1)))
    parts = F.split(F.when(bare.startswith("/"), bare).otherwise(F.concat(folder, F.lit("/"), bare)), "/")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p.isin("", "."), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    return F.when((bare != "") & ~bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//"), F.array_join(walked, "/"))


def lookup_key(target: Column) -> Column:
    """How a link's target is looked up: trimmed, lower-cased, without leading './' and anchor."""
    return F.regexp_replace(F.lower(F.trim(F.split_part(target, F.lit("#"), F.lit(1)))), r"^(\./)+", "")


def transcript_delta(before: Column, now: Column) -> Column:
    """What a transcript adds: all after the one before if it begins with that, else all after the last blank of what they share."""
    shared = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.length(before), F.length(now)), F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(before, 1, i) == F.substring(now, 1, i)) & (i <= F.length(before)) & (i <= F.length(now)), i).otherwise(n))
    edge = F.length(F.regexp_extract(F.substring(now, 1, shared), r"^(?s:.*)\s", 0))
    return F.trim(F.substring(now, F.when(now.startswith(before), F.length(before)).otherwise(edge) + 1, 1 << 30))


def prefixed_id(kind: str, id_: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), id_.cast("string"))


def without_prefix(kind: str, value: Column) -> Column:
    """The number in a prefixed id of that kind; null for others."""
    return F.nullif(F.regexp_extract(value, rf"^{kind}_(\d+)$", 1), F.lit("")).cast("long")
