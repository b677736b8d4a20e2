"""Byte-level BPE ids of whole texts, with encoded words kept for the next time."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space beside other white space.
_BESIDE = re.compile(r"[^\S ] "), re.compile(r" [^\S ]")
_ENDING = re.compile(r"([^\W\d_]+)([.,;:!?]+)\Z")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def uneven(text: str) -> bool:
    """Is there a space with white space or an end beside it? If not, the words between spaces can be encoded one by one."""
    return text[:1] == " " or text[-1:] == " " or "  " in text or any(x.search(text) for x in _BESIDE)


class Encoder(dict):
    """Text to little-endian 32-bit ids, the same as ``Tokenizer.encode(text, add_special_tokens=False)`` of the file.

    Byte-level BPE first splits a text, and a single space between two other signs always begins a new part. So
    what lies between such spaces is encoded once, with its space, and looked up from then on (at most ``MOST``
    entries, after which it starts anew); an ending of points, and a line's end between words, are parts of their
    own. Other texts are encoded as a whole, and those that hold a special token's string by the tokenizer itself.
    """

    MOST, LONGEST = 900_000, 40

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(vocabulary, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        ranks = {bytes(map(letters.__getitem__, token)): i for token, i in vocab.items() if token not in self.special}
        self.encode = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.line_end = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        if "\n" in word:
            lines, word = self.lines(word)
            if lines:
                return lines + (self.plain(word) if "\n" in word else self[word])
        return self.plain(word)

    def lines(self, word: str) -> tuple[bytes, str]:
        """Ids up to the last line's end that stands between two signs, each line looked up on its own, and what is left."""
        out = []
        while True:
            line, _, rest = word.partition("\n")
            if not rest or not line.strip("\0") or line[-1].isspace() or rest[0].isspace():
                return b"".join(out), word
            out += self[line], self.line_end
            word = "\0" + rest

    def plain(self, word: str) -> bytes:
        ending = _ENDING.match(word)
        if ending and len(word) <= self.LONGEST:
            ids = self[ending[1]] + self["\0" + ending[2]]
        else:
            ids = self.whole(word[1:]) if word[:1] == "\0" else self.whole(" " + word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "\0" in text or uneven(text):
            try:
                return self.whole(text)
            except UnicodeEncodeError:  # a lone surrogate has no bytes
                return self.whole(text.encode("utf-8", "replace").decode())
        first, *words = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=1)
def shared_encoder(vocabulary: str) -> Encoder:
    """One encoder for all tasks of a Python worker, so its words outlive a task."""
    return Encoder(vocabulary)


def unkept_encoder(vocabulary: str) -> tuple[Callable[[str], list[int]], list[int]]:
    """Text to ids, with special tokens' strings as plain text, and the number of bytes of each id."""
    own = Encoder(vocabulary)
    letters, model = byte_letters(), json.loads(own.tokenizer.to_str())["model"]
    lengths = [0] * own.tokenizer.get_vocab_size()
    for token, i in model["vocab"].items():
        lengths[i] = len(token) if all(c in letters for c in token) else 0
    return own.encode, lengths
