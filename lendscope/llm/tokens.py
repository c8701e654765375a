"""Token ids of whole texts by the ``tokenizers`` library, with memos of words and of their parts.

Both public vocabularies cut a text at a single space between two visible characters before they merge, so the ids
of a text are the ids of its words in order.  A word of plain characters (printable ASCII, line feeds, Latin-1 letters)
is cut into the parts that the vocabulary's own pattern gives, and each part goes to the library's merge model, which
works on one part at a time; normalising such a word is lower-casing letter by letter, so parts are independent.  Any other
word is encoded by the library as it stands, and a text in which white space meets a space is encoded whole.  A text of plain
characters and spaces is cut into parts at once, without a look at its words.

Memos hold a bounded number of short entries, in two generations: when the young one is full it becomes the old one, and
what is used again moves on, so frequent words stay.  Words over ``LONG`` characters are not kept.
"""

from __future__ import annotations

import codecs
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
WORDS, PARTS, LONG = 250_000, 300_000, 200
SMALL = 50_000, 50_000  # memos for workers that share an executor with much else
CHUNK = 1 << 20
# The letters below, and the patterns of the two vocabularies for them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")
_BYTE_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+")
_SPECIAL = "<|"
_PLAIN_BYTES = bytes([10, *range(32, 127), *(c for c in range(192, 256) if c not in (215, 247))])


def _byte_names() -> str:
    """The character that byte-level vocabularies write for each byte: itself if visible, else the next one from 256."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in seen else next(rest)) for b in range(256))


_NAMES = _byte_names()


def _plain(text: str) -> bool:
    """Whether the text holds plain characters and spaces only: then the pattern cuts it as the library does."""
    try:
        return not text.encode("latin-1").translate(None, _PLAIN_BYTES) and _SPECIAL not in text
    except UnicodeEncodeError:
        return False


class Parts(dict[str, bytes]):
    """Ids of parts of plain characters, merged by the library's model when first asked for; the young generation."""

    def __init__(self, model: object, limit: int):
        super().__init__()
        self.merge, self.limit, self.old = model.tokenize, limit, dict[str, bytes]()

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            named = codecs.charmap_decode(part.encode(), "strict", _NAMES)[0]
            ids = array("I", [t.id for t in self.merge(named)]).tobytes()
        if len(part) <= LONG:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


class Encoder:
    def __init__(self, path: str, words: int = WORDS, parts: int = PARTS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.byte_level = type(self.tok.pre_tokenizer).__name__ == "ByteLevel"  # white space is part of the next word's ids
        self.limits = words, parts
        # ids of words (None: white space touches it); the young and the old generation
        self.words: tuple[dict[str, bytes | None], dict[str, bytes | None]] = {}, {}
        self.ids = Parts(self.model, parts)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @property
    def parts(self) -> tuple[dict[str, bytes], dict[str, bytes]]:
        return self.ids, self.ids.old

    def _cut(self, text: str) -> bytes:
        """Ids of a plain text or word (byte-level: a word with the space before it), part by part."""
        cut = _BYTE_LEVEL.findall(text) if self.byte_level else _WORD_LEVEL.findall(text.lower())
        return b"".join(map(self.ids.__getitem__, cut))

    def _word(self, word: str, space: str) -> bytes | None:
        if not word:
            return None if self.byte_level else b""
        if self.byte_level and (word[0].isspace() or word[-1].isspace()):
            return None
        return self._cut(space + word) if _plain(word) else self.whole(space + word)

    def _learn(self, words: set[str]) -> list[str]:
        """Let the young generation know all of these; those too long to keep are returned."""
        new, space = words.difference(self.words[0]), " " if self.byte_level else ""
        if len(self.words[0]) + len(new) > self.limits[0]:
            self.words = {}, self.words[0]
            new = words
        young, old = self.words
        for w in new:
            young[w] = old[w] if w in old else self._word(w, space)
        return [w for w in new if len(w) > LONG]

    def _together(self, texts: list[str]) -> list[bytes]:
        rest = iter(self._by_words([t for t in texts if not _plain(t)]))
        return [self._cut(t) if _plain(t) else next(rest) for t in texts]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        if self.byte_level:
            cut = [t.split(" ") for t in texts]
            heads = [self._word(c.pop(0), "") for c in cut]  # the first word has no space before it
        else:
            cut, heads = [t.replace("\n", " ").split(" ") for t in texts], [b""] * len(texts)
        long = self._learn(set().union(*cut))
        known, out = self.words[0].__getitem__, []
        for text, head, words in zip(texts, heads, cut):
            if not text:
                out.append(b"")
                continue
            try:
                out.append(head + b"".join(map(known, words)))
            except TypeError:
                out.append(self.whole(text))
        for w in long:
            del self.words[0][w]
        return out

    def stream(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, some megabytes of text at a time."""
        held, size = [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= CHUNK:
                yield from self._together(held)
                held, size = [], 0
        if held:
            yield from self._together(held)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return list(self.stream(texts))


@lru_cache(maxsize=2)
def encoder(path: str, words: int = WORDS, parts: int = PARTS) -> Encoder:
    return Encoder(path, words, parts)


def release() -> None:
    """Forget the vocabularies and memos of this worker: Spark keeps workers for later stages, which have no use for them.

    What Arrow keeps of former batches goes back to the system, too."""
    encoder.cache_clear()
    pa.default_memory_pool().release_unused()
