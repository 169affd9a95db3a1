"""Notes of a folder as files, anchors, chunks and links, against plain versions."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from kelpie.sources import vault

A = """---
title: "The start"
aliases: [Begin, 'Origin']
tags:
  - x
---
Before [[b|the other]] and [out](https://x.example/a#b).

# One
text under it [up](../b.md#part "t")

```
# not a heading [no](no.md)
[[b#Part]]
```
## One ##

- item `code` with [[deep/c]]
> quoted

![image](picture.png) [here](#one)
# Document
"""


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def folder_of(tmp_path):
    for name, data in {"sub/a.md": A, "b.md": "no heading\r\n\r\nsecond [[The Start]] [[Nowhere]]", "sub/deep/c.md": "\n", "none.md": "", "x.bin": b"\xff\xfe\x00", ".hidden/h.md": "# h"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(tmp_path)


def test_a_folder_gives_files_anchors_chunks_and_links(spark, tmp_path):
    notes = vault.read(spark, folder_of(tmp_path))
    v = vault.Vault(notes)
    found = {r["path"]: r for r in v.files().collect()}
    assert set(found) == {"sub/a.md", "b.md", "sub/deep/c.md", "x.bin"}
    assert found["sub/a.md"]["title"] == "The start" and found["sub/a.md"]["aliases"] == ["Begin", "Origin", "The start", "a"]
    assert found["sub/a.md"]["metadata"] == '{"aliases":["Begin","Origin"],"tags":["x"],"title":["The start"]}'
    assert found["x.bin"]["metadata"] == '{"content_type":"binary"}' and found["b.md"]["metadata"] == '{"content_type":"markdown"}'
    assert found["x.bin"]["title"] == "x" and found["x.bin"]["length"] == 3 and found["b.md"]["checksum"] == hashlib.sha256((tmp_path / "b.md").read_bytes()).hexdigest()
    anchors = {(r["path"], r["key"]): (r["heading"], r["start_line"], r["end_line"], r["text_hash"]) for r in v.anchors().collect()}
    body = A.split("\n---\n", 1)[1]
    assert anchors[("sub/a.md", "document")] == ("a", 1, 23, sha(body))
    assert anchors[("sub/a.md", "one")][:3] == ("One", 9, 15) and anchors[("sub/a.md", "one-2")][:3] == ("One", 16, 21)
    assert anchors[("sub/a.md", "one-2")][3] == sha("\n".join(A.split("\n")[17:21])) and anchors[("sub/a.md", "document-2")] == ("Document", 22, 23, sha(""))
    assert anchors[("sub/deep/c.md", "document")] == ("c", 1, 2, sha("\n")) and not any(p == "x.bin" for p, _ in anchors) and len(anchors) == 6
    chunks = {(r["path"], r["section"], r["ordinal"]): r["text"] for r in v.chunks().collect()}
    assert chunks[("sub/a.md", 0, 0)] == "Before the other and out." and chunks[("sub/a.md", 9, 0)] == "text under it up"
    assert chunks[("sub/a.md", 16, 0)] == "item code with deep/c\nquoted" and chunks[("b.md", 0, 1)] == "second The Start Nowhere"
    links = {(r["path"], r["key"], r["type"], r["text"]): (r["to_path"], r["to_anchor"], r["to_file"]) for r in v.resolved_links().collect()}
    assert links == {
        ("sub/a.md", "document", "wikilink", "the other"): ("sub/b", None, "b.md"), ("sub/a.md", "document", "markdown", "out"): (None, None, None),
        ("sub/a.md", "one", "markdown", "up"): ("b.md", "part", "b.md"), ("sub/a.md", "one", "wikilink", "b#Part"): ("sub/b", "Part", "b.md"),
        ("sub/a.md", "one-2", "wikilink", "deep/c"): ("sub/deep/c", None, "sub/deep/c.md"), ("sub/a.md", "one-2", "markdown", "here"): ("sub/a.md", "one", "sub/a.md"),
        ("b.md", "document", "wikilink", "The Start"): ("The Start", None, "sub/a.md"), ("b.md", "document", "wikilink", "Nowhere"): ("Nowhere", None, None),
    }


def test_a_part_of_the_folder_is_read_alone(spark, tmp_path):
    notes = vault.read(spark, folder_of(tmp_path), "sub")
    assert sorted(r["path"] for r in notes.select("path").collect()) == ["sub/a.md", "sub/deep/c.md"]


def test_random_notes_have_sections_that_cover_them_and_unique_keys(spark):
    draw = random.Random(3)
    words = ["a", "A 2", "a", "document", "a 3", "!!", "", "é b"]
    texts = []
    for _ in range(120):
        lines = []
        for _ in range(draw.randint(0, 25)):
            lines.append(draw.choice([lambda: f"{'#' * draw.randint(1, 7)} {draw.choice(words)}", lambda: "```", lambda: "", lambda: "word " + draw.choice(words), lambda: "#tag", lambda: "  ~~~~ x"])())
        texts.append("\n".join(lines))
    rows = [(f"d/{i}.md", bytearray(t.encode())) for i, t in enumerate(texts)] + [(None, bytearray(b"# x")), ("null.md", None)]
    v = vault.Vault(spark.createDataFrame(rows, "path string, content binary"))
    got = {}
    for r in v.anchors().filter("section > 0").collect():
        got.setdefault(r["path"], []).append((r["start_line"], r["end_line"], r["heading"], r["text_hash"], r["key"]))
    for i, t in enumerate(texts):
        inside, heads, lines = False, [], t.split("\n")
        for n, line in enumerate(lines, 1):
            if re.match(r" {0,3}(```|~~~)", line):
                inside = not inside
            elif not inside and (m := re.match(r" {0,3}#{1,6}(?:[ \t]+(.*?))?[ \t]*$", line)):
                heads.append((n, m.group(1) or ""))
        want = []
        for at, (n, name) in enumerate(heads):
            end = heads[at + 1][0] - 1 if at + 1 < len(heads) else len(lines)
            block = lines[n:end]
            want.append((n, end, name, sha("\n".join(block[1:] if block and not block[0].strip(" ") else block))))
        mine = sorted(got.get(f"d/{i}.md", []))
        assert [x[:4] for x in mine] == want
        assert len({x[4] for x in mine} | {"document"}) == len(mine) + 1
    assert v.files().filter("path = 'null.md'").select("metadata", "checksum").first() == ('{"content_type":"binary"}', None)
    assert v.files().count() == 121 and v.lines.filter(F.col("path") == "null.md").count() == 0


def test_links_are_made_of_headings_and_lines_with_links_alone(spark):
    """No plain line is put in order or written, keys come with the lines instead of by a join, and tasks aren't put together."""
    texts = {f"n/{i}.md": "plain\n" * 50 + "```\n# no\n[[in]] [out](out.md)\n```\n# A\r\nx\r[[../up#B|said]] [y](./z.md#)\n# A\n[a](#b) [[ |]] [s](https://x.example/#q)" for i in range(9)}
    v = vault.Vault(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "path string, content binary"))
    found = v.links()
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert "lines" not in v.__dict__ and v.marks.count() == 8 * 9
    want = {("document", "wikilink", "in", "n/in", None), ("a", "wikilink", "said", "up", "B"), ("a", "markdown", "y", "n/z.md", None), ("a-2", "markdown", "a", None, "b"), ("a-2", "wikilink", " ", None, None), ("a-2", "markdown", "s", None, None)}
    got = [tuple(r) for r in found.filter("path = 'n/3.md'").select("key", "type", "text", F.when(F.col("to_path") != "n/3.md", F.col("to_path")), "to_anchor").collect()]
    assert len(got) == len(want) and set(got) == want
    plain = vault._lines(v.notes, True)._jdf.queryExecution().logical().toString()
    assert "RepartitionByExpression [path" in plain
