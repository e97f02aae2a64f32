"""Whole-text tokenising inside tasks.

The rank file and the JSON file of the 50k byte-level BPE hold one vocabulary, so both libraries give the same ids;
tests compare them. The JSON file's added tokens are cut out of documents first, as its library does; `encode` alone takes
their strings as ordinary text."""

from __future__ import annotations

import base64
import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np

_RUN = re.compile(r"\s\s")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tokenizer:
    """encode(text) gives a text's ids as an array; n_bytes[id] is the length of an id's bytes, which tile the text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # Where no two white-space characters meet, the look-ahead for runs of them decides nothing.
        single = public_tokenizers.PATTERN.replace(r"|\s+(?!\S)", "")
        # Each encoding holds the whole vocabulary, and is made when a text first needs it.
        self._make = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._patterns = {"any": public_tokenizers.PATTERN, "single": single}
        self.dtype = np.dtype("<u2" if max(ranks.values()) < 65536 else "<u4")
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
        beside = os.path.splitext(path)[0] + ".json"
        self.added: dict[str, int] = {}
        if os.path.exists(beside):
            with open(beside, encoding="utf-8") as file:
                self.added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
            more = np.zeros(max([len(self.n_bytes) - 1, *self.added.values()]) + 1, np.int64)
            more[: len(self.n_bytes)] = self.n_bytes
            self.n_bytes = more
            for token, i in self.added.items():
                self.n_bytes[i] = len(token.encode())
            self.dtype = np.dtype("<u2" if len(more) <= 65536 else "<u4")
        self._added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    @cached_property
    def _any(self):
        return self._make("any", self._patterns["any"])

    @cached_property
    def _single(self):
        return self._make("single", self._patterns["single"])

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        return np.array((self._any if _RUN.search(text) else self._single).encode_ordinary(text), self.dtype)

    def encode_document(self, text: str | None) -> np.ndarray:
        """As encode, with the ids of added tokens in the place of their strings."""
        if not text or not any(t in text for t in self.added):
            return self.encode(text)
        return np.concatenate([np.array([self.added[x]], self.dtype) if k % 2 else self.encode(x) for k, x in enumerate(self._added.split(text))])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for each file and Python worker."""
    return Tokenizer(path)
