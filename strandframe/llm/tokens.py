"""Byte-level BPE ids of whole texts, equal to those of the ``tokenizers`` library for its JSON vocabulary files.

The vocabulary is read from that file and run by the faster core of ``tiktoken``; tests hold the ids against
``tokenizers`` itself. Texts whose white space is single blanks and line feeds between words, the usual case, are split
by a pattern without look-ahead, which gives the same pieces there. Vocabularies whose ids do not follow the order of
merges, texts with very long words, and texts that hold the string of a special token, which is that token as in the
library's own default, go through ``tokenizers``.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

#: Fixed values of the format: how a byte-level vocabulary splits a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pieces where no white space stands beside other white space or at an end.
PLAIN = r"""'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
#: Words of more characters go through ``tokenizers``, whose merges take less than quadratic time.
LONG_WORD = 500


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = self.full = None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = tuple(special)
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        made = [model["vocab"].get(m.replace(" ", "")) for m in merges]
        if made == sorted(made) and len(ranks) == len(made) + 256:
            import tiktoken

            self.plain, self.full = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("plain", PLAIN), ("full", PATTERN)))

    def by_library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> array:
        words = text.split()
        if self.plain is None or max(map(len, words), default=0) > LONG_WORD or any(x in text for x in self.special):
            return array("I", self.by_library(text))
        gaps = len(words) - 1
        single = gaps == text.count(" ") + text.count("\n") and gaps + sum(map(len, words)) == len(text)
        return array("I", (self.plain if single else self.full).encode_ordinary(text))


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One encoder a worker process and vocabulary."""
    return TextEncoder(path)
