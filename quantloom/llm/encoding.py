"""Token ids by the tokenizers library, each distinct stretch between spaces encoded once per worker.

Both vocabularies pre-tokenise so that no token crosses the place before a space that a visible character follows
(byte-level BPE takes at most that one space into the next word; BPE with word ends drops white space). So the ids of
a text are the ids of its stretches in order, and a worker looks up the stretches that it has met before.

A new stretch of Latin letters with or without punctuation after them is two pre-tokens at most, which go straight to
the library's BPE model; any other goes through the whole library.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

#: Stretches, and words, that a worker remembers; beyond it the memory is emptied and fills anew.
REMEMBERED = 1_500_000

#: A space before a character that is visible by every definition of white space.
SPACE = re.compile(r" (?=[!-~¡-ᙿⰀ-⿿、-퟿])")
#: Letters and ASCII punctuation of which no pre-tokeniser here makes more than two pieces.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_alphabet() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte: itself or the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids as little-endian unsigned 32-bit integers. Texts that hold an added token go through the library whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = byte_alphabet()
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        # how this vocabulary treats a plain word: as it is with its space, or in lower case without it
        self.keeps_space = self._ids(" a") != self._ids("a")

    def _ids(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def word(self, piece: str) -> bytes:
        """The ids of one pre-token."""
        shown = piece.encode().decode("latin-1").translate(self.alphabet)
        ids = self.words[piece] = _packed([t.id for t in self.model.tokenize(shown)])
        return ids

    def stretch(self, stretch: str) -> bytes:
        """The ids of a space and ``stretch``; single line ends inside are pre-tokens of their own, or dropped."""
        words, spaced, out = self.words, self.keeps_space, []
        for part in stretch.split("\n") if "\n" in stretch else (stretch,):
            plain = SIMPLE.fullmatch(part)
            if not plain:
                return self._ids(" " + stretch)
            letters, marks = plain.groups()
            letters = letters.lower() if not spaced else letters if out else " " + letters
            if out and spaced:
                out.append(words.get("\n") or self.word("\n"))
            out.append(words.get(letters) or self.word(letters))
            if marks:
                out.append(words.get(marks) or self.word(marks))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, as the library gives them without special tokens."""
        for a in self.added:
            if a in text:
                return self._ids(text)
        known = self.known
        if len(known) > REMEMBERED or len(self.words) > REMEMBERED:
            known.clear()
            self.words.clear()
        rest = SPACE.split(text)
        parts = list(map(known.get, rest))
        parts[0] = self._ids(rest[0])
        if None in parts:
            for i, ids in enumerate(parts):
                if ids is None:  # a stretch may be new more than once in a text
                    stretch = rest[i]
                    ids = known.get(stretch)
                    if ids is None:
                        ids = known[stretch] = self.stretch(stretch)
                    parts[i] = ids
        return b"".join(parts)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget() -> None:
    """Frees what this worker remembers; Spark reuses workers, and other operators need the memory."""
    encoder.cache_clear()


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
