"""Byte-level BPE ids by the vocabulary of a public tokenizer file.

The ids are those of the tokenizers library for the same file. A text is encoded at once by tiktoken with the same vocabulary
and pre-token pattern, which takes about a third of the time. Texts that hold characters outside the planes whose classes are
tabulated, or very long runs of white space, go to the tokenizers library; it is loaded when the first such text comes. Nothing
is kept between texts.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cached_property, lru_cache

import numpy as np

#: The GPT-2 pre-token pattern, its runs possessive where nothing is given back.
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Code points of Unicode white space up to _TABULATED.
_BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]
#: Characters up to here have had their classes for many Unicode versions, if they are assigned.
_TABULATED = 0x2FFF
#: The pattern's search keeps a step for each character of a run of white space, so longer runs go elsewhere.
_LONGEST_BLANK = 1 << 16


@lru_cache(1)
def _unknown() -> np.ndarray:
    """Whether the class of each code point isn't sure; the last stands for all beyond the table."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(_TABULATED + 1)] + [True])


def is_plain(text: str) -> bool:
    """Whether all pre-token libraries cut the text alike, and its white space comes in runs that aren't very long."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if _unknown()[np.minimum(points, _TABULATED + 1)].any():
        return False
    if len(points) <= _LONGEST_BLANK:
        return True
    other = np.flatnonzero(~np.isin(points, _BLANKS))
    return int(np.diff(np.concatenate([[-1], other, [len(points)]])).max()) <= _LONGEST_BLANK


def byte_level(said: dict) -> bool:
    """Whether a tokenizer file changes nothing of the text, cuts it by PRETOKENS and merges bytes: what tiktoken does with its vocabulary."""
    cut, model = said.get("pre_tokenizer") or {}, said["model"]
    by_pattern = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    other = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    own_tokens = all(x.get("special") for x in said.get("added_tokens") or [])
    return said.get("normalizer") is None and by_pattern and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in other) and own_tokens


class Encoder:
    """Encodes texts without special tokens; strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        #: None for files that cut or merge by other rules than those of PRETOKENS: all their texts go to the tokenizers library.
        self.plain = self._plain(said) if byte_level(said) else None

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.encode_special_tokens = True
        return whole

    def _plain(self, said: dict):
        """The same merges by tiktoken, whose ranks are the vocabulary's ids in order of merging."""
        import tiktoken

        to_byte = {c: b for b, c in self.byte_letters().items()}
        vocabulary, special = said["model"]["vocab"], {x["content"] for x in said.get("added_tokens") or []}
        ranks = {bytes(to_byte[c] for c in word): k for word, k in vocabulary.items() if word not in special and all(c in to_byte for c in word)}
        core = tiktoken.Encoding("plain", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
        self.byte_length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for word, k in ranks.items():
            self.byte_length[k] = len(word)
        return core.encode_ordinary

    @staticmethod
    def byte_letters() -> dict[int, str]:
        """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as unsigned 32-bit numbers."""
        if not text:
            return np.zeros(0, np.uint32)
        ids = self.plain(text) if self.plain and is_plain(text) else self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.uint32)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    return Encoder(path)
