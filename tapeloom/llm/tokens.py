"""Token ids of the lower-case word vocabulary, as little-endian unsigned 32-bit bytes.

White space ends a word in this vocabulary, and a word falls into pieces (letters, one digit, other signs) that are encoded
one by one. Text of plain Latin characters is lower-cased and cut into pieces here; the ids of pieces are kept in a bounded
table, and what isn't there is given to the tokenizer's model, all new pieces of a text at a time. Words with other
characters, and texts with the tokenizer's own markers or separators that it treats differently, go to it whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from struct import pack

import numpy as np

#: letters that lower-cased plain text holds
LETTERS = "a-zÀ-ÖØ-öø-ʯⱥⱦ"
WORD = re.compile(rf"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9{LETTERS}]+")
ODD = re.compile("[\x1c-\x1f]|<\\|")
#: beyond these, and for characters whose class differs between libraries, the tokenizer itself decides
SIGNS = "\x21-\x7e¡-©«-¬®-±¶-¸»¿À-ɏ"
PLAIN = re.compile(f"[{SIGNS}]+")
PLAIN_TEXT = re.compile(f"[{SIGNS} \t\n\r\x0b\x0c]+")
SPACE = re.compile(r"\s")
KNOWN_PIECES, STRETCH = 300_000, 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in parts of about ``size`` characters that end at white space."""
    at = 0
    while len(text) - at > size:
        gap = SPACE.search(text, at + size)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


class WordIds:
    def __init__(self, path: str, room: int = KNOWN_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.room, self.pieces = room, {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        #: bytes as the model's letters; a line feed, which no piece holds, parts pieces
        self.table = {b: chr(256 + i) for i, b in enumerate(hidden) if b != 10}

    def exact(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        tokens = self.model.tokenize
        shown = "\n".join(pieces).encode().decode("latin-1").translate(self.table).split("\n")
        ids = ([t.id for t in tokens(p)] for p in shown)
        return [pack(f"<{len(i)}I", *i) for i in ids]

    def _plain(self, text: str) -> bytes:
        parts, known = WORD.findall(text.lower()), self.pieces
        got = list(map(known.get, parts))
        if None in got:
            new = list({p for p, g in zip(parts, got) if g is None})
            found = dict(zip(new, self._encoded(new)))
            got = [found[p] if g is None else g for p, g in zip(parts, got)]
            if len(known) + len(found) > self.room:
                known.clear()
            known.update((p, g) for p, g in found.items() if len(p) < 64)
        return b"".join(got)

    def _mixed(self, text: str) -> Iterator[bytes]:
        """Runs of words that are plain, and runs of words that aren't."""
        run: list[str] = []
        plain = True
        for word in text.split():
            now = PLAIN.fullmatch(word) is not None
            if now != plain and run:
                yield self._plain(" ".join(run)) if plain else self.exact(" ".join(run))
                run = []
            plain = now
            run.append(word)
        if run:
            yield self._plain(" ".join(run)) if plain else self.exact(" ".join(run))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text and PLAIN_TEXT.fullmatch(text):
            return b"".join(map(self._plain, stretches(text)))
        if ODD.search(text):
            return self.exact(text)
        return b"".join(got for part in stretches(text) for got in self._mixed(part))


_OPEN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The table of this worker; it outlives a task."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]
