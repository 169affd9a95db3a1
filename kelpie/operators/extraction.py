"""Entities, relationships and claims out of answers, where they go in a store, and evidence packed for prompts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.parsing import spaced
from kelpie.functions.text import normalized_name
from kelpie.operators.merge import canonical, latest
from kelpie.operators.selection import valid_entity


def fields(answers: DataFrame, id_col: str, text: str, names: tuple[str, ...]) -> DataFrame:
    """id, section (entities, relationships), block and the fields by name: of blocks that '---' parts, each 'key: value' with the lines
    that go on with it (claims by line, others by blanks). Of a repeated key the last counts, a key that isn't there is null."""
    raw = F.explode(F.transform(F.split(F.regexp_replace(text, r"```(?:markdown|md)?", ""), "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("raw"))))
    lines = answers.select(F.col(id_col).alias("id"), raw.alias("x")).select("id", "x.line", "x.raw", spaced(F.col("x.raw")).alias("said"))
    head = F.when(F.col("said") == "## Entities", "entities").when(F.col("said") == "## Relationships", "relationships")
    so_far = lambda *by: Window.partitionBy(*by).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    owned = lines.withColumn("head", head).withColumn("section", F.last("head", True).over(so_far("id"))).filter("section is not null and head is null")
    cut = owned.withColumn("block", F.count_if(F.col("raw") == "---").over(so_far("id", "section"))).filter("raw <> '---' and said <> ''")
    placed = cut.withColumn("field", F.count_if(F.col("said").contains(":")).over(so_far("id", "section", "block"))).filter("field > 0")
    key = F.nullif(F.lower(F.regexp_extract("said", "^([^:]*):", 1)), F.lit(""))
    value = F.when(F.col("said").contains(":"), spaced(F.regexp_extract("said", "^[^:]*:(.*)$", 1))).otherwise(F.col("said"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("line", value.alias("value")))), lambda x: x["value"])
    whole = placed.groupBy("id", "section", "block", "field").agg(F.min_by(key, "line").alias("key"), pieces.alias("pieces"))
    joined = whole.withColumn("value", F.when(F.col("key") == "claims", F.array_join("pieces", "\n")).otherwise(F.array_join("pieces", " ")))
    return joined.groupBy("id", "section", "block").agg(*(F.max_by("value", F.when(F.col("key") == n, F.col("field"))).alias(n) for n in names))


def entities(answers: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, block, name, normalized_name, type, description and claims of the entities of kept types; none with an empty field."""
    found = fields(answers, id_col, text, ("name", "type", "description", "claims")).filter("section = 'entities' and name <> '' and description <> ''")
    claims = F.filter(F.transform(F.filter(F.split(F.coalesce("claims", F.lit("")), "\n"), lambda x: x.startswith("- ")), lambda x: F.trim(F.substring(x, 3, 1 << 30))), lambda x: x != "")
    kept = found.filter(valid_entity(F.col("name"), F.col("type")))
    return kept.select("id", "block", "name", normalized_name(F.col("name")).alias("normalized_name"), F.lower("type").alias("type"), "description", claims.alias("claims"))


def relationships(answers: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, block, source, target (normalised, different names), type and description; none with an empty field."""
    found = fields(answers, id_col, text, ("source", "target", "type", "description")).filter("section = 'relationships' and source <> '' and target <> '' and type <> '' and description <> ''")
    named = found.select("id", "block", normalized_name(F.col("source")).alias("source"), normalized_name(F.col("target")).alias("target"), F.lower("type").alias("type"), "description")
    return named.filter("source <> target")


def routed(found: DataFrame, stored: DataFrame, key: str, order: list, compared: list[str]) -> DataFrame:
    """The first row found for each key and where it goes: create if the store lacks the key, update if all compared columns are the
    stored ones, else coalesce. `stored_id` is the id there."""
    first = latest(found, [key], order)
    known = stored.select(key, F.col("id").alias("stored_id"), *(F.col(c).alias(f"__{c}") for c in compared))
    same = F.lit(True)
    for c in compared:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    action = F.when(F.col("stored_id").isNull(), "create").when(same, "update").otherwise("coalesce")
    return first.join(known, key, "left").withColumn("action", action).drop(*(f"__{c}" for c in compared))


def edges_of(found: DataFrame) -> DataFrame:
    """Distinct canonical edges of relationships by both ends and the type, with the least description."""
    return canonical(found, "source", "target").groupBy("first_id", "second_id", "type").agg(F.min("description").alias("description"))


PREFIX = "Segment from oversized evidence item:\n"


def _tokens(words: int, characters: int) -> int:
    return max(words * 4 // 3, characters // 4, 1)


class _Budget:
    """What a prompt of a header, instructions and numbered items takes, without writing it out."""

    def __init__(self, header: str, instructions: str, limit: int):
        header = header.strip()
        self.words, self.characters = len(header.split()), len(header) + 1 if header else -1
        self.limit = limit - _tokens(len(instructions.split()), len(instructions))

    def cost(self, item: str, number: int) -> tuple[int, int]:
        return 3 + len(item.split()), len(f"\n### Evidence {number}\n") + len(item.strip())

    def fits(self, words: int, characters: int) -> bool:
        return _tokens(self.words + words, self.characters + characters) <= self.limit

    def pieces(self, item: str) -> list[str]:
        """The item, or its lines, or runs of its words, each within the limit if a character is."""
        item = item.strip()
        if self.fits(*self.cost(item, 1)):
            return [item]
        lines = [x for x in item.split("\n") if x]
        found = []
        for line in lines if len(lines) > 1 else [item]:
            whole = len(lines) > 1 and self.fits(*self.cost(PREFIX + line, 1))
            found += [PREFIX + x for x in ([line] if whole else self.runs(line))]
        return found

    def runs(self, text: str) -> list[str]:
        words, characters = self.cost(PREFIX, 1)
        room = max(self.limit - _tokens(self.words + words, self.characters + characters), 1)
        most_words, most_characters = max(room * 3 // 4, 1), max(room * 4, 1)
        cuts = lambda w: [w[i : i + most_characters] for i in range(0, len(w), most_characters)]
        if len(text.split()) < 2:
            return cuts(text) or [text]
        found, run, size = [], [], 0
        for word in text.split():
            if run and (len(run) >= most_words or size + 1 + len(word) > most_characters):
                found, run, size = found + [" ".join(run)], [], 0
            if len(word) > most_characters:
                found += cuts(word)
            else:
                size += len(word) + (1 if run else 0)
                run.append(word)
        return found + ([" ".join(run)] if run else [])


def packed_evidence(items: DataFrame, group: str, order: str, text: str, header: str, instructions: str, limit: int) -> DataFrame:
    """group, prompt (from 0), place (from 1) and text: each group's items in order, put into the open prompt while it stays within the
    limit of estimated tokens. Items too long for one are first cut by lines, words or characters. Null texts count as empty.

    Which prompt an item goes to depends on all before it, so a group is read by one task, in order and batch by batch: only the open
    prompt's counts are kept, never the group.
    """
    kind = items.schema[group].dataType
    rows = items.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        budget, open_group, prompt, place, words, characters = _Budget(header, instructions, limit), (), 0, 0, 0, 0
        for batch in batches:
            out = []
            for g, t in zip(batch["g"], batch["t"], strict=True):
                g = None if pd.isna(g) else g
                if open_group != (g,):
                    open_group, prompt, place, words, characters = (g,), 0, 0, 0, 0
                for piece in budget.pieces(t):
                    w, c = budget.cost(piece, place + 1)
                    if place and not budget.fits(words + w, characters + c):
                        prompt, place, words, characters = prompt + 1, 0, 0, 0
                        w, c = budget.cost(piece, 1)
                    place, words, characters = place + 1, words + w, characters + c
                    out.append((g, prompt, place, piece))
            yield pd.DataFrame(out, columns=["g", "prompt", "place", "text"])

    done = rows.repartition("g").sortWithinPartitions("g", "o", "t").mapInPandas(pack, f"g {kind.simpleString()}, prompt long, place long, text string")
    return done.withColumnRenamed("g", group)
