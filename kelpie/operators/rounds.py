"""Evidence reduced in rounds until it fits one prompt: each round is a table.

A group whose items fit the final prompt gets it. The items of any other group are packed into prompts, a given reducer answers each,
and the answers are the items of the next round. A group that still doesn't fit at the last depth is told, not dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.text import without_thinking
from kelpie.operators.extraction import packed_evidence
from kelpie.plans.storage import cut

#: The most estimated tokens of a prompt, those it is packed to, and the deepest round.
MOST_TOKENS, PACKED_TOKENS, DEEPEST = 8000, 7500, 8


@dataclass(frozen=True)
class Prompts:
    """Header and instructions of the final prompt and of those for parts."""

    final_header: str
    final_instructions: str
    part_header: str
    part_instructions: str


@dataclass(frozen=True)
class Reduction:
    """finals (grp, depth, status: final or too deep, prompt), tree (grp, depth, prompt, place, text): the items of each prompt of each
    round, and answers (grp, depth, prompt, response)."""

    finals: DataFrame
    tree: DataFrame
    answers: DataFrame


def _tokens(words: Column, characters: Column) -> Column:
    return F.greatest(F.floor(words * 4 / 3), F.floor(characters / 4), F.lit(1))


def _of_text(text: str) -> int:
    return max(len(text.split()) * 4 // 3, len(text) // 4, 1)


def _digits(n: Column) -> Column:
    """The digits of all numbers from 1 to n together."""
    return reduce(lambda s, k: s + F.greatest(n - (10**k - 1), F.lit(0)), range(12), F.lit(0))


def rendered(items: DataFrame, keys: list[str], header: str, more: Column | None = None) -> DataFrame:
    """keys and prompt of items (place, text): the header and the numbered items in order. Only for items that fit a prompt."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x, k: F.concat(F.lit("### Evidence "), (k + 1).cast("string"), F.lit("\n"), F.trim(x["text"])))
    head = F.lit(header.strip()) if more is None else F.concat(F.lit(header.strip()), more)
    return items.groupBy(*keys).agg(listed.alias("listed")).select(*keys, F.array_join(F.concat(F.array(head, F.lit("")), F.col("listed")), "\n").alias("prompt"))


def fitting(items: DataFrame, header: str, instructions: str, most: int) -> DataFrame:
    """grp and fits: whether a prompt of all of a group's items, counted without writing it, is within the limit."""
    words = F.when(F.trim("text") == "", 0).otherwise(F.size(F.split(F.trim("text"), r"\s+")))
    n = F.count("place")
    head = header.strip()
    total = F.coalesce(F.sum(words), F.lit(0)) + 3 * n + len(head.split())
    characters = F.coalesce(F.sum(F.char_length(F.trim("text"))), F.lit(0)) + n * len("\n### Evidence \n") + _digits(n) + len(head) + F.when(n > 0, 1).otherwise(0)
    return items.groupBy("grp").agg((_tokens(total, characters) + _of_text(instructions) <= most).alias("fits"))


def reduced(items: DataFrame, prompts: Prompts, answer: Callable[[DataFrame], DataFrame], most: int = MOST_TOKENS, packed: int = PACKED_TOKENS, deepest: int = DEEPEST) -> Reduction:
    """Items are (grp, place, text); `answer` takes (grp, part, prompt) and gives (grp, part, response). Answers lose their thinking, empty ones
    count for nothing, the others are numbered on."""
    now = cut(items.select("grp", F.col("place").cast("long").alias("place"), F.coalesce("text", F.lit("")).alias("text")))
    finals, tree, answers = [], [], []
    for depth in range(deepest + 1):
        fits = cut(fitting(now, prompts.final_header, prompts.final_instructions, most))
        done = now.join(fits.filter("fits").select("grp"), "grp", "left_semi")
        told = rendered(done.filter("place is not null"), ["grp"], prompts.final_header)
        bare = F.coalesce("prompt", F.lit(prompts.final_header.strip()))
        finals.append(fits.filter("fits").select("grp").join(told, "grp", "left").select("grp", F.lit(depth).alias("depth"), F.lit("final").alias("status"), bare.alias("prompt")))
        left = fits.filter("not fits").select("grp")
        if left.isEmpty():
            break
        if depth == deepest:
            finals.append(left.select("grp", F.lit(depth).alias("depth"), F.lit("too deep").alias("status"), F.lit(None).cast("string").alias("prompt")))
            break
        open_ = now.join(left, "grp", "left_semi")
        parts = cut(packed_evidence(open_, "grp", "place", "text", prompts.part_header, prompts.part_instructions, packed).withColumnRenamed("prompt", "part"))
        tree.append(parts.select("grp", F.lit(depth).alias("depth"), F.col("part").alias("prompt"), "place", "text"))
        count = parts.groupBy("grp").agg((F.max("part") + 1).alias("parts"))
        whole = rendered(parts.join(count, "grp"), ["grp", "part", "parts"], prompts.part_header, F.concat(F.lit("\n\nChunk "), (F.col("part") + 1).cast("string"), F.lit(" of "), F.col("parts").cast("string"), F.lit(".")))
        said = cut(answer(whole.select("grp", "part", "prompt")).select("grp", "part", F.trim(without_thinking(F.col("response"))).alias("response")))
        answers.append(said.select("grp", F.lit(depth).alias("depth"), F.col("part").alias("prompt"), "response"))
        number = F.row_number().over(Window.partitionBy("grp").orderBy("part")).cast("long")
        numbered = said.filter("response <> ''").withColumn("place", number)
        text = F.concat(F.lit("Partial Summary "), F.col("place").cast("string"), F.lit(":\n"), F.col("response"))
        now = cut(left.join(numbered.select("grp", "place", text.alias("text")), "grp", "left"))
    none = items.sparkSession.createDataFrame([], f"grp {items.schema['grp'].dataType.simpleString()}, depth int, prompt long, place long, text string, response string")
    union = lambda frames, *names: reduce(DataFrame.union, frames, none.select(*names))
    return Reduction(reduce(DataFrame.union, finals), union(tree, "grp", "depth", "prompt", "place", "text"), union(answers, "grp", "depth", "prompt", "response"))
