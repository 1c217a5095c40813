"""Token ids of a public byte-level BPE vocabulary, whose path is a parameter."""

from __future__ import annotations

import re
from functools import cached_property

#: Up to here the two libraries read Unicode classes alike (checked over all these characters); other texts take the slower one.
_FAR = re.compile(r"[^\x00-ɏ]")
_ENCODERS: dict[str, Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str | None = None) -> Encoder:
    """The process's encoder for a vocabulary file, loaded once per worker."""
    path = path or default_vocabulary()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Ids as the tokenizers library gives them for the file, with no special tokens put around a text.

    Strings of special tokens in a text are ordinary text, or with ``special`` the tokens that they name, which is the library's plain
    reading. The file's vocabulary is also laid out as byte ranks for a faster encoder of the same merges, which takes the
    texts whose characters both split alike.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.special = {t["content"] for t in held["added_tokens"]}
        letters = _byte_letters()
        self.vocabulary = {token: i for token, i in held["model"]["vocab"].items() if token not in self.special}
        ranks = {bytes(letters[c] for c in token): i for token, i in self.vocabulary.items()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def named(self):
        """The library's encoder, in which strings of special tokens name them; loaded where a text asks for it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def encode(self, text: str | None, special: bool = False) -> list[int]:
        if not text:
            return []
        if special and any(x in text for x in self.special):
            return self.named.encode(text, add_special_tokens=False).ids
        if _FAR.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def sentence_ends(self):
        """Boolean array by id: tokens that close a sentence or a line."""
        import numpy as np

        ends = np.zeros(max(self.vocabulary.values()) + 2, dtype=bool)
        for token, i in self.vocabulary.items():
            ends[i] = token[-1] in ".!?" or "Ċ" in token
        return ends


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
