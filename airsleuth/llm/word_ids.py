"""Token ids of whole texts with few calls of the tokenizer.

The word-level vocabulary lower-cases, drops white space and never merges across
it, so the ids of a text are those of its space-separated words in turn. Each
worker keeps the ids of the words it met, and calls the tokenizer for new ones.
"""

from __future__ import annotations

import os
from array import array

END_ID = 1
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space to Python only; the tokenizer takes these for marks.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Words kept by a worker in each of two generations, about 200 bytes each.
KEEP = 150_000

END = END_ID.to_bytes(4, "little")
_BY_FILE: dict[str, WordIds] = {}


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class WordIds:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> WordIds:
        """The one of this worker."""
        if path not in _BY_FILE:
            _BY_FILE[path] = WordIds(path)
        return _BY_FILE[path]

    def _letters_only(self, word: str) -> bytes:
        """Ids of a lower-case word of Latin letters: one merge run, no normalizer."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        tail = word[len(core):]
        low = core.lower()
        # Letters and trailing marks are split by the tokenizer itself; beyond Latin letters it decides alone.
        if low.isalpha() and max(low) < "ƀ":
            if not tail and low == word:
                return self._letters_only(word)
            return self._ids(low) + (self._ids(tail) if tail else b"")
        return self._whole(word)

    def _ids(self, word: str) -> bytes:
        ids = self.young.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                ids = self._new(word)
            if len(self.young) >= KEEP:
                self.young, self.old = {}, self.young
            self.young[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` and the end id, as little-endian unsigned 32-bit integers."""
        text = text or ""
        if any(s in text for s in SEPARATORS):
            return self._whole(text) + END
        known, ids = self.young.get, self._ids
        return b"".join([known(w) or ids(w) for w in text.split()]) + END
