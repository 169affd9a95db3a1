"""Fill-in-middle: documents whose middle is moved behind their end, so that a model learns to fill gaps.

The Split pre-tokenizer of the tokenizers library, with isolated matches of a pattern, gives the code-point offsets of a text's
units without any training. The number of offsets is n; two hashes of the document's id, modulo n + 1, are the ranks of the cuts, and
the offsets at these ranks are where the text is sliced. Texts are looked at in windows that end between a unit's last symbol and
white space, where the pattern always ends a unit, so a very long text never has all its units as Python objects at once.

Cases: a null text is empty; a text that is empty or holds a marker is plain, as are the documents that the rate leaves out and rows
with null ids, which have no hash; equal ids with equal texts give equal rows, each row is kept. White space alone is one unit, a
text without white space too. An empty table gives no rows. Columns of the input other than id and text are not looked at, but
kept by `fill_in_middle` unless it adds one of that name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: White space goes with the word after it; what is left at the end is a unit of its own.
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARKERS = ("<P>", "<S>", "<M>")
_EDGE = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
_ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


@cache
def _splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(UNITS), "isolated")


def unit_ends(text: str, window: int = 1 << 18) -> np.ndarray:
    """The code-point offsets at which the text's units end, in order."""
    found, low = [np.zeros(0, np.int64)], 0
    while low < len(text):
        edge = _EDGE.search(text, low + window - 1) if low + window < len(text) else None
        high = edge.end() if edge else len(text)
        units = _splitter().pre_tokenize_str(text[low:high])
        found.append(np.fromiter((end for _, (_, end) in units), np.int64, len(units)) + low)
        low = high
    return np.concatenate(found)


def ranks(doc_id: int, n: int, salt: str) -> tuple[int, int, int, int]:
    """Ranks of the two cuts, the smaller first, and two numbers below 100 for the rate and the form."""
    digest = hashlib.sha256(f"{salt}{doc_id}".encode()).digest()
    one, two, rate, form = (int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))
    return (*sorted((one % (n + 1), two % (n + 1))), rate % 100, form % 100)


def moved(doc_id: int | None, text: str, rate: int, spm: int, salt: str) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, and the output of one document."""
    ends = unit_ends(text)
    if doc_id is None or not text or any(m in text for m in MARKERS):
        return len(ends), "plain", None, None, text
    first, last, chance, turn = ranks(doc_id, len(ends), salt)
    if chance >= rate:
        return len(ends), "plain", None, None, text
    at, to = (int(ends[k - 1]) if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:at], text[at:to], text[to:]
    p, s, m = MARKERS
    if turn < spm:
        return len(ends), "spm", at, to - at, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return len(ends), "psm", at, to - at, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, salt: str = "42:", batch_bytes: int = 1 << 24) -> DataFrame:
    """The documents with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output. `rate` percent of the documents
    are moved, `spm` percent of these with their suffix first."""
    others = [c for c in docs.columns if c.lower() not in (*_ADDED, "doc_id", "text")]
    # in one column, as mapInArrow takes no names with dots or backticks
    held = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in others), F.lit(0).alias("__")).alias("held")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            made, begun, size = [], 0, 0
            for k in range(batch.num_rows):
                made.append(moved(ids[k].as_py(), texts[k].as_py() or "", rate, spm, salt))
                size += len(made[-1][-1])
                if size >= batch_bytes or k + 1 == batch.num_rows:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    added = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)]
                    part = batch.slice(begun, k + 1 - begun)
                    yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *_ADDED])
                    made, begun, size = [], k + 1, 0

    kinds = (LongType(), StringType(), LongType(), LongType(), StringType())
    found = rows.mapInArrow(move, StructType([*rows.schema.fields, *map(StructField, _ADDED, kinds)]))
    return found.select("doc_id", "text", *(F.col("held").getField(c).alias(c) for c in others), *_ADDED)


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone. No marker ends as it begins, so the first one found is the one put in."""
    cut = lambda text, mark: F.substring_index(text, mark, 1)
    after = lambda text, mark: F.substr(text, F.char_length(cut(text, mark)) + F.lit(1 + len(mark)))
    p, s, m = MARKERS
    psm, spm = after(output, p), after(output, s)
    return (
        F.when(form == "psm", F.concat(cut(psm, s), after(after(psm, s), m), cut(after(psm, s), m)))
        .when(form == "spm", F.concat(cut(after(spm, p), m), after(after(spm, p), m), cut(spm, p)))
        .otherwise(output)
    )


def digest(docs: DataFrame) -> DataFrame:
    """What is moved, with hashes of the output and of the text restored from it."""
    seen = fill_in_middle(docs.select("doc_id", "text"))
    return seen.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


FIM_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
r AS (SELECT *, len(u)::BIGINT AS n, list_transform([0, 1, 2, 3], lambda k: list_reduce(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(h, 8 * k + i, 1)) - 1)::BIGINT), lambda x, y: 16 * x + y)) AS g FROM t),
c AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 50 THEN 'plain' WHEN g[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b FROM r),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a+1:b], ''), '') AS y, coalesce(array_to_string(u[b+1:], ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
