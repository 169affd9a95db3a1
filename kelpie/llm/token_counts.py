"""Token counts of the sections of a text, from one encoding of the whole text.

Each document is encoded once. The tokens' byte spans, which tile the text, are joined with the sections' spans by binary
search, in the task that holds the document. A token that crosses the boundary of sections counts by both of two rules:
`n_tokens` gives it whole to the section that holds its first byte; `token_share` gives each section the fraction of the
token's bytes that lie in it. Over sections that tile the text, both sum to the document's tokens.

Cases: null text is empty; an empty text has one section without tokens; sections outside the text are clipped to it, null
ones are left out; repeated rows stay; null ids stay null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import chunked, rows_of
from kelpie.llm.encoder import encoder

COUNTS = "doc_id long, section long, char_start long, char_end long, n_tokens long, token_share double, n_crossing long, doc_tokens long"


def line_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of the lines of a text, each with its line feed."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if len(text) < 64 else (np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1).tolist()
    starts = [0, *ends]
    return list(zip(starts, [*ends, len(text)], strict=True)) if starts[-1] < len(text) or len(starts) == 1 else list(zip(starts[:-1], ends, strict=True))


def attributed(text: str, spans: list[tuple[int, int]], ids: np.ndarray, byte_length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each span of characters: tokens that begin in it, its share of tokens, and tokens that cross one of its ends."""
    data = np.frombuffer(text.encode(), np.uint8)
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # the byte at which each character begins
    at = chars[np.clip(np.asarray(spans, np.int64).reshape(-1, 2), 0, len(text))]
    lengths = byte_length[ids]
    edge = np.concatenate([[0], np.cumsum(lengths)])
    token = np.searchsorted(edge, at, "right") - 1  # the token that holds each end
    inside = at - edge[np.minimum(token, len(ids))]
    begun = np.searchsorted(edge[:-1], at, "left")
    size = np.append(lengths, 1)[token]
    share = token + inside / size
    crosses = inside > 0
    same = crosses[:, 0] & crosses[:, 1] & (token[:, 0] == token[:, 1])
    real = at[:, 1] > at[:, 0]
    return np.where(real, begun[:, 1] - begun[:, 0], 0), np.where(real, share[:, 1] - share[:, 0], 0.0), np.where(real, crosses.sum(1) - same, 0)


def token_counts(docs: DataFrame, tokenizer: str, spans: str | None = None) -> DataFrame:
    """Token counts of each section; sections are the lines, or the character spans in the column `spans`, an array of structs
    whose first two fields are start and end; spans may overlap or leave parts out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        if enc.plain is None:
            raise ValueError("tokens of this tokenizer file don't say which bytes they stand for")
        for some in chunked(rows_of(batches, "doc_id", "text", "spans"), 256):
            out = []
            for doc_id, text, own in some:
                text = text or ""
                at = line_spans(text) if spans is None else [tuple(x.values())[:2] for x in own or [] if x and None not in tuple(x.values())[:2]]
                tokens = enc.encode(text)
                out += [(doc_id, k, s, e, n, share, cross, len(tokens)) for k, ((s, e), n, share, cross) in enumerate(zip(at, *(x.tolist() for x in attributed(text, at, tokens, enc.byte_length)), strict=True))]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 5 else pa.int64()) for k, c in enumerate(cols)], [x.split()[0] for x in COUNTS.split(", ")])

    wanted = F.lit(None).cast("string") if spans is None else F.col(spans)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), wanted.alias("spans")).mapInArrow(count, COUNTS)
