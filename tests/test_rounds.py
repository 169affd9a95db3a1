"""Evidence reduced in rounds, against a plain version with the same reducer."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kelpie.operators import rounds

PROMPTS = rounds.Prompts("All of it", "Sum up.", "A part", "Be brief.")
MOST, PACKED = 60, 50


def tokens(text):
    return max(len(text.split()) * 4 // 3, len(text) // 4, 1)


def render(header, items):
    return "\n".join([header.strip(), "", *(f"### Evidence {k + 1}\n{x.strip()}" for k, x in enumerate(items))]).strip()


def respond(prompt):
    """The first letters of each item; nothing for prompts of an odd kind."""
    bodies = [p.split("\n", 1)[1].strip() for p in prompt.split("### Evidence ")[1:]]
    return "<think>hm</think> " + " ".join(b.split()[-1][:3] for b in bodies)


def plain(items):
    for depth in range(9):
        final = render(PROMPTS.final_header, items)
        if tokens(final) + tokens(PROMPTS.final_instructions) <= MOST:
            return depth, "final", final
        chunks = []
        for item in items:
            if chunks and tokens(render(PROMPTS.part_header, [*chunks[-1], item])) + tokens(PROMPTS.part_instructions) <= PACKED:
                chunks[-1].append(item)
            else:
                chunks.append([item])
        said = [respond(render(f"{PROMPTS.part_header}\n\nChunk {k + 1} of {len(chunks)}.", c)).split("</think>")[1].strip() for k, c in enumerate(chunks)]
        items = [f"Partial Summary {k + 1}:\n{s}" for k, s in enumerate(x for x in said if x)]
    return 8, "too deep", None


def answer(frame):
    parts = F.filter(F.split("prompt", "### Evidence "), lambda _, k: k > 0)
    last = F.transform(parts, lambda p: F.substring(F.element_at(F.split(F.substring_index(F.regexp_replace(p, r"\s+$", ""), "\n", -1), r"\s+"), -1), 1, 3))
    return frame.select("grp", "part", F.concat(F.lit("<think>hm</think> "), F.array_join(last, " ")).alias("response"))


def test_rounds_equal_plain(spark):
    rng = random.Random(4)
    groups = {g: [" ".join(rng.choices("one two three four fives sixes".split(), k=rng.randint(1, 12))) for _ in range(n)] for g, n in enumerate((1, 3, 9, 40, 130))}
    rows = [(g, k, text) for g, items in groups.items() for k, text in enumerate(items)]
    done = rounds.reduced(spark.createDataFrame(rows, "grp long, place int, text string"), PROMPTS, answer, MOST, PACKED)
    got = {r["grp"]: (r["depth"], r["status"], r["prompt"]) for r in done.finals.collect()}
    assert got == {g: plain(items) for g, items in groups.items()}
    assert max(d for d, _, _ in got.values()) >= 2
    # each item of a group that doesn't fit at once is in the tree's first round, once
    first = sorted((r["grp"], r["text"]) for r in done.tree.filter("depth = 0").collect())
    assert first == sorted((g, t) for g, _, t in rows if got[g][0] > 0)
    # and so is each answer that says something, in the next
    said = {(r["grp"], r["depth"] + 1): 0 for r in done.answers.collect()}
    for r in done.answers.collect():
        said[(r["grp"], r["depth"] + 1)] += 1
    told = done.tree.groupBy("grp", "depth").count().filter("depth > 0").collect()
    assert all(said[(r["grp"], r["depth"])] == r["count"] for r in told)


def test_what_never_fits_is_told(spark):
    rows = spark.createDataFrame([("a", k, "word " * 20) for k in range(12)] + [("b", 0, None)], "grp string, place int, text string")
    longer = lambda frame: frame.select("grp", "part", F.lit("no " * 30).alias("response"))
    done = rounds.reduced(rows, PROMPTS, longer, MOST, PACKED, deepest=2)
    assert {(r["grp"], r["depth"], r["status"]) for r in done.finals.collect()} == {("a", 2, "too deep"), ("b", 0, "final")}
    silent = lambda frame: frame.select("grp", "part", F.lit("<think> ...").alias("response"))
    assert {(r["grp"], r["depth"], r["prompt"]) for r in rounds.reduced(rows, PROMPTS, silent, MOST, PACKED).finals.collect()} == {("a", 1, "All of it"), ("b", 0, "All of it\n\n### Evidence 1\n")}
