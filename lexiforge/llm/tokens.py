"""Token ids of whole texts with the tokenizers library, one call per distinct unit of text.

A text is cut where the tokenizer's pre-tokenisation cuts it in any case, and the ids of each unit
are kept, so that a frequent word is encoded once per worker. Strings of special
tokens inside a text count as ordinary text: a document cannot forge an end marker.

Byte-level BPE (its pattern joins at most one leading space to a word): a cut before a line feed that
follows a non-space, and before a space that a non-space follows, is a cut of
the pattern too. Word BPE drops white space, so every run of it is a cut.

Most units are words of Latin letters. Such a unit is one word for the tokenizer too, so it goes to the
library's model at once, in the characters that stand for its bytes: the way over the library's encodings takes three times as long.
"""

from __future__ import annotations

import array
import functools
import os
import re
import sys

import numpy as np

#: Entries of each of the two generations of the unit cache; both together take about 200 MB of a Python worker.
#: When the young one is full it becomes the old one, and units found there again move back: rare words age out.
CACHE_UNITS = 450_000
#: Longer units (characters) are not kept: they hardly come again, and their number bounds no memory.
LONG = 64

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: In texts without a match and without a gap (one pattern of both takes three times as long), letters are Latin ones, white space is single spaces and line feeds, and no apostrophe joins
#: a word's end: there these patterns cut as the tokenizers' own ones do, or coarser.
_ODD = re.compile(rf"[^ -&(-~\n{_LATIN}]")
_GAPS = ("  ", " \n", "\n ", "\n\n")
_BYTE_UNITS = re.compile(rf" ?[{_LATIN}]+| ?[^{_LATIN} ]+| ")
_WORD_UNITS = re.compile(rf"[{_LATIN}]+|[0-9]|[^{_LATIN}0-9 \n]+")
_PLAIN = re.compile(rf" ?[{_LATIN}]+")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


def unusual(text: str) -> bool:
    return any(gap in text for gap in _GAPS) or _ODD.search(text) is not None


class Encoder:
    def __init__(self, path: str, words: bool, cache_units: int = CACHE_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.words, self.cache_units, self.cache, self.old = words, cache_units, {}, {}
        self.model, self.byte_characters = self.tokenizer.model, byte_characters()

    def units(self, text: str) -> list[str]:
        if not unusual(text):
            return (_WORD_UNITS if self.words else _BYTE_UNITS).findall(text)
        if self.words:
            # these four separate words for str.split, yet are characters to the tokenizer
            return [text] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        out: list[str] = []
        open_end = False  # the last unit ends with white space: a cut there may not be one of the pattern
        for k, line in enumerate(text.split("\n")):
            piece = "\n" + line if k else line
            first = True
            for j, word in enumerate(piece.split(" ")):
                unit = " " + word if j else word
                joins = open_end if first else not word or word[0].isspace()
                first = False
                if joins and out:
                    out[-1] += unit
                elif unit:
                    out.append(unit)
            open_end = bool(out) and out[-1][-1:].isspace()
        return out

    def packed(self, ids: list[int]) -> bytes:
        if sys.byteorder == "little" and self.dtype.itemsize == 2:
            return array.array("H", ids).tobytes()
        return np.array(ids, self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids of the whole text, self.dtype each."""
        units = self.units(text or "")
        try:
            return b"".join(map(self.cache.__getitem__, units))
        except KeyError:
            pass
        if len(self.cache) > self.cache_units:
            self.old, self.cache = self.cache, {}
        cache, old, new = self.cache, self.old, []
        for u in set(units):
            if u not in cache:
                if u in old:
                    cache[u] = old[u]
                else:
                    new.append(u)
        rest, long = [], {}
        for u in new:
            if _PLAIN.fullmatch(u):
                (long if len(u) > LONG else cache)[u] = self.packed(self.word_ids(u))
            else:
                rest.append(u)
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            for u, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                (long if len(u) > LONG else cache)[u] = self.packed(e.ids)
        return b"".join([long[u] if u in long else cache[u] for u in units] if long else map(cache.__getitem__, units))

    def word_ids(self, unit: str) -> list[int]:
        """The ids of one word of Latin letters, for byte-level BPE with the space before it, if any."""
        word = unit.lower() if self.words else unit
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.byte_characters))]


@functools.lru_cache(maxsize=4)
def encoder(path: str, words: bool) -> Encoder:
    """One per worker process."""
    return Encoder(path, words)


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
