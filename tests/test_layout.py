"""Printed lines to titles, headings and paragraphs, against a plain version."""

import random
import re

from pyspark.sql import functions as F

from kelpie.sources import layout


def plain(lines, title):
    """The markdown of a document, line by line."""
    lines, taken = [x.strip() for x in lines if x and x.strip()], []
    if not title:
        for x in lines[:4]:
            if "@" in x or "†" in x or x.lower() == "abstract" or re.match(r"[0-9*]", x) or (taken and re.search(r"\b[0-9]+\b", x, re.A)):
                break
            taken.append(x)
            if len(" ".join(taken)) > 140:
                break
        title, lines = " ".join(taken), lines[len(taken) :]
    parts, now = [], ""
    for x in lines:
        if x.lower() == "abstract" or re.match(r"\d+(\.\d+)*\s+[A-Z]", x) or (len(x) < 80 and len(x.split()) <= 8 and x[-1] not in ".,;" and "@" not in x):
            parts += [now.strip()] * (now != "") + [f"## {x}"]
            now = ""
        else:
            now = now[:-1] + x if now.endswith("-") else f"{now} {x}" if now else x
    parts += [now.strip()] * (now != "")
    return "\n\n".join(([f"# {title}"] if title else []) + parts)


def test_blocks_are_those_of_the_plain_version(spark):
    draw = random.Random(8)
    shapes = ["Abstract", "1.2 Results", "A short one", "ends here.", "me@x.org and you", "in the year 1999 it", "* mark", "x" * 90, "a long line that goes on for more than eight words and is bro-", "- ", "  ", None, "with many words that fill this line up to some end that is,", "†", "12 monkeys"]
    docs = {i: [draw.choice(shapes) for _ in range(draw.randint(0, 12))] for i in range(300)}
    titles = {i: draw.choice([None, "Given", " "]) for i in docs}
    rows = [(i, n, x, titles[i], "clash") for i, lines in docs.items() for n, x in enumerate(lines)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "d long, n long, x string, title string, block string")
    got = {r["d"]: r["markdown"] for r in layout.markdown(layout.blocks(frame, "d", "n", "x", "title"), "d").collect()}
    assert {i: got.get(i, "") for i in docs if any(x and x.strip() for x in docs[i])} == {i: plain(x, titles[i] and titles[i].strip()) for i, x in docs.items() if any(y and y.strip() for y in x)}
    free = {r["d"]: r["markdown"] for r in layout.markdown(layout.blocks(frame, "d", "n", "x"), "d").collect()}
    assert free == {i: plain(x, None) for i, x in docs.items() if any(y and y.strip() for y in x)}
    assert layout.blocks(frame.filter("false"), "d", "n", "x").count() == 0


def test_fragments_become_lines(spark):
    rows = [("a", 0, 0, "One ", False), ("a", 0, 1, " two", False), ("a", 0, 2, ", three", True), ("a", 1, 0, None, True), ("a", 1, 1, "(x", None), ("a", 1, 2, ") y", False), ("b", 0, 0, " ", True), (None, 0, 0, "n", True)]
    frame = spark.createDataFrame(rows, "d string, p long, i long, x string, e boolean")
    got = {(r["d"], r["line"]): r["text"] for r in layout.lines(frame, "d", ["p", "i"], "x", F.col("e")).collect()}
    assert got == {("a", 0): "One two, three", ("a", 1): "(x) y", (None, 0): "n"}
