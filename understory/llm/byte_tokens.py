"""Byte-level BPE ids of whole texts with the vocabulary of a public tokenizer file.

The file's tokens go to ``tiktoken``, which gives the ids that the tokenizers library
gives with the same file, in a quarter of its time; tests compare them over all code
points. Long texts are cut where a run of blanks starts, which no pre-token crosses.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import tiktoken
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from understory.llm.bpe import SPACE, byte_letters

# Fixed value: the pattern that byte-level vocabularies split a text by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that are encoded at a time, as far as a run of blanks ends them.
PIECE = 1 << 18

_cut = re.compile(rf"(?<=[^{SPACE}])[ \n]")


class ByteTokens:
    """Encoder, and the bytes of every id, of a byte-level tokenizer file's content."""

    def __init__(self, content: str):
        said = json.loads(content)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        specials = {t["content"]: t["id"] for t in said["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in said["model"]["vocab"].items() if t not in specials}
        merged = [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
        ids = [ranks[bytes(map(byte_of.__getitem__, a + b))] for a, b in merged]
        if ids != sorted(ids) or not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("ids that don't follow the order of merges, or bytes without an id, need another encoder")
        self.coder = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)
        self.bytes = [b""] * (max([*ranks.values(), *specials.values()]) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        for token, i in specials.items():
            self.bytes[i] = token.encode()
        self.size = len(self.bytes)
        self.content = content

    def encode(self, text: str, specials: bool) -> np.ndarray:
        """Ids of a whole text. With ``specials`` a special token's string in it is that token, else plain text."""
        if len(text) <= PIECE:
            return self._encode(text, specials)
        parts, start = [], 0
        while start < len(text):
            end = _cut.search(text, start + PIECE)
            end = end.start() if end else len(text)
            parts.append(self._encode(text[start:end], specials))
            start = end
        return np.concatenate(parts)

    def _encode(self, text: str, specials: bool) -> np.ndarray:
        try:
            return self.coder.encode_to_numpy(text, allowed_special="all" if specials else set(), disallowed_special=())
        except ValueError:  # the expression's stack
            whole = Tokenizer.from_str(self.content)
            whole.encode_special_tokens = not specials
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)


_loaded: dict[str, ByteTokens] = {}


def load(spark: SparkSession, path: str):
    """Function without arguments that gives a worker its encoder; the driver reads the file, workers need no copy."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    key, shared = hashlib.md5(content.encode()).hexdigest(), spark.sparkContext.broadcast(content)

    def tokens() -> ByteTokens:
        if key not in _loaded:
            _loaded[key] = ByteTokens(shared.value)
        return _loaded[key]

    return tokens
