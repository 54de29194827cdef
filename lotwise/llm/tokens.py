"""Token ids of whole texts by a tokenizer file, at the speed of its words.

The tokenizer splits a text into words first and encodes each by itself.  A task keeps
the ids of the words it has seen, so only new words reach the model.  A text with
characters outside ASCII and the Latin-1 letters, or with a token that was added to the
vocabulary, goes to the tokenizer as a whole.
"""

from __future__ import annotations

import os
import re
from itertools import islice

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The word pattern of the byte-level tokenizer, on ASCII and Latin-1 letters.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
_OTHER = re.compile(rf"[^\t\n\x0b\x0c\r\x20-\x7e{_LETTER}]")

#: Words kept by a task; beyond that the half it has known longest goes.
WORDS_KEPT = 300_000


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level tokenizers write for every byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: b for b in shown}, **{b: 256 + k for k, b in enumerate(hidden)}}


class Encoder(dict):
    """Ids of a text as little-endian 32-bit bytes; as a dict, of the words seen.

    With ``special`` a special token in a text is its id, as by the library's defaults; without,
    text that looks like one is text.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and (special or not t.special)]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        before = self.tokenizer.pre_tokenizer
        self.split = self.tokenizer.normalizer is None and isinstance(before, ByteLevel) and not before.add_prefix_space and isinstance(self.tokenizer.model, BPE)
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        from array import array

        letters = word.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(self) >= WORDS_KEPT:
            for old in list(islice(self, WORDS_KEPT // 2)):
                del self[old]
        self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split and not _OTHER.search(text) and not (self.added and self.added.search(text)):
            return b"".join([self[w] for w in _WORD.findall(text)])
        from array import array

        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = False) -> Encoder:
    """This task process's encoder for a tokenizer file."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(path, special)
    return _ENCODERS[path, special]


def public(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizers are, unless LOTWISE_TOKENIZER names a file."""
    if os.environ.get("LOTWISE_TOKENIZER"):
        return os.environ["LOTWISE_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path(name)
