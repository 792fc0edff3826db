"""Byte-level BPE encoding and decoding; long texts by tree concatenation.

A text of up to ``size`` characters is encoded in the task that reads it, to the ids of the tokenizers library. A longer one is cut into
pieces, anywhere but inside an added token; the pieces are written, dealt to all tasks and encoded side by side. Then the
pieces of a text are joined two by two, as a tree: around each join a window grows until both sides agree.

* The window grows over the tokens of each side until it holds a place where a character is followed by white space. What is
  cut there is cut there whatever stands before or behind, so between these two places the text is encoded anew, and beyond
  them both sides' tokens are those of the whole.
* Where no such place is near (a run without white space), the run falls into the tokenizer's own pre-tokens, and the tokens
  of one that spans the join are found by windows of tokens: a window agrees with a side if its outermost token there is the
  side's own token at that place. Merges inside a token don't depend on what is outside it, so encodings that share a whole
  token go together: no merge across the token's edge comes up in the whole that doesn't in one of the two.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import Scratch
from .workers import in_arrow, parts

#: characters of a piece, bytes from which on a run is long, tokens of a first window
SIZE, RUN, WINDOW = 1 << 15, 1 << 11, 8
#: a character that surely isn't white space, before one that surely is
PLACE = re.compile(rb"(?:[!-~]|[\xc3-\xdf][\x80-\xbf]|[\xe4-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})(?=[ \t\n\r])")

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: characters whose classes all versions of Unicode agree on, and runs that a quadratic merge shouldn't meet
PLAIN, LONG_RUN = re.compile("[\t-\r -~¡-ɏ\u2010-\u2027\u2030-\u205e€]*"), 1000


def evenly_cut(text: str) -> bool:
    """No run of characters without white space, or of white space alone, is long."""
    words = list(map(len, text.split()))
    return max(words, default=0) < LONG_RUN and len(text) - sum(words) - len(words) < LONG_RUN


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Coder:
    """A byte-level BPE tokenizer, and each id's bytes as one table."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        told = json.loads(self.tokenizer.to_str())
        if told["normalizer"] or told["pre_tokenizer"]["type"] != "ByteLevel" or told["model"]["type"] != "BPE":
            raise ValueError("a byte-level BPE tokenizer without a normalizer is needed")
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str
        added = {t["content"]: t["id"] for t in sorted(told["added_tokens"], key=lambda t: -len(t["content"]))}
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        #: bytes as the model's letters, and back
        self.letters = {b: chr(256 + i) for i, b in enumerate(hidden)}
        back = {ord(c): b for b, c in self.letters.items()} | {b: b for b in shown}
        vocabulary = self.tokenizer.get_vocab()
        raw = [b""] * (max(vocabulary.values()) + 2)  # the last stands for ids that no token has
        for token, i in vocabulary.items():
            raw[i] = bytes(back[ord(c)] for c in token) if token not in added and all(ord(c) in back for c in token) else token.encode()
        self.size = np.array([len(t) for t in raw], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.fast = self._by_ranks(told["model"], {t: i for t, i in added.items() if i not in told["model"]["vocab"].values()}, raw)

    @staticmethod
    def _by_ranks(model: dict, added: dict[str, int], raw: list[bytes]):
        """The same tokenizer as ranks, several times as fast, if its merges stand in the order of their ids; else None."""
        ids = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if None in ids or ids != sorted(ids) or len(ids) + 256 != len(model["vocab"]):
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={raw[i]: i for i in model["vocab"].values()}, special_tokens=added)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The tokenizers library's ids. Texts of plain characters take the way by ranks, which has no classes of characters to
        disagree on there; all others go to the library itself."""
        out = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if self.fast and PLAIN.fullmatch(t) and evenly_cut(t):
                out[i] = self.fast.encode(t, allowed_special="all")
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The ids' bytes, one behind the other; ids that no token has are nothing."""
        out = []
        for at in range(0, len(ids), 1 << 18):
            some = ids[at : at + (1 << 18)].astype(np.int64)
            some = np.where((some < 0) | (some >= len(self.size)), len(self.size) - 1, some)
            size = self.size[some]
            out.append(self.data[np.repeat(self.begin[some] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(out)

    def merged(self, raw: bytes) -> np.ndarray:
        """The tokens of one pre-token."""
        return np.array([t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))], np.int32)

    def units(self, text: str) -> list[tuple[int, int]]:
        """Where the added tokens and pre-tokens of a text begin and end."""
        out, at = [], 0
        for m in [*self.added.finditer(text), None]:
            end = m.start() if m else len(text)
            out += [(at + a, at + b) for _, (a, b) in self.split(text[at:end])] if end > at else []
            if m:
                out.append(m.span())
                at = m.end()
        return out

    # joins --------------------------------------------------------------------------------------------------------

    def _before(self, ids: np.ndarray) -> tuple[int, bytes]:
        """The last place in a text: the number of tokens before it, and the bytes from it on; else all."""
        k = WINDOW
        while True:
            tail = ids[-k:]
            raw = self.bytes_of(tail)
            edges = np.cumsum(self.size[tail])
            for m in reversed(list(PLACE.finditer(raw))):
                i = int(np.searchsorted(edges, m.end()))
                if edges[i] == m.end() < len(raw):
                    return len(ids) - len(tail) + i + 1, raw[m.end() :]
            if k >= len(ids):
                return 0, raw
            k *= 2

    def _behind(self, ids: np.ndarray) -> tuple[int, bytes]:
        """The first place in a text: the number of tokens up to it, and their bytes; else all."""
        k = WINDOW
        while True:
            head = ids[:k]
            raw = self.bytes_of(head)
            edges = np.cumsum(self.size[head])
            for m in PLACE.finditer(raw):
                i = int(np.searchsorted(edges, m.end()))
                if edges[i] == m.end() < len(raw):
                    return i + 1, raw[: m.end()]
            if k >= len(ids):
                return len(ids), raw
            k *= 2

    def _across(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens of a pre-token whose two parts have these tokens."""
        k = WINDOW
        while True:
            a, b = left[-k:], right[:k]
            got = self.merged(self.bytes_of(np.concatenate([a, b])))
            if (k >= len(left) or got[0] == a[0]) and (k >= len(right) or got[-1] == b[-1]):
                return np.concatenate([left[:-k], got, right[k:]])
            k *= 2

    def _run(self, left: np.ndarray, right: np.ndarray, a: str, b: str) -> np.ndarray:
        """The tokens of a + b, a long run, from those of a and of b."""
        whole, ua, ub = self.units(a + b), self.units(a), [(s + len(a), e + len(a)) for s, e in self.units(b)]
        i = 0
        while i < min(len(whole), len(ua)) and whole[i] == ua[i]:
            i += 1
        j = 0
        while j < min(len(whole) - i, len(ub)) and whole[-1 - j] == ub[-1 - j]:
            j += 1
        middle = whole[i : len(whole) - j]
        begin = middle[0][0] if middle else len(a)
        end = middle[-1][1] if middle else len(a)
        keep = self._tokens_in(left, a[: min(begin, len(a))])
        skip = self._tokens_in(right, b[: max(end - len(a), 0)])
        text = a + b
        if len(middle) == 1 and i == len(ua) - 1 and j == len(ub) - 1 and begin < len(a) < end:
            got = self._across(left[keep:], right[:skip])
        else:  # the places of the pre-tokens have changed: each is encoded for itself
            got = np.array([t for ids in self.encode([text[s:e] for s, e in middle]) for t in ids], np.int32)
        return np.concatenate([left[:keep], got, right[skip:]])

    def _tokens_in(self, ids: np.ndarray, text: str) -> int:
        """How many tokens a beginning of a text that ends at a pre-token's edge has."""
        return int(np.searchsorted(np.cumsum(self.size[ids]), len(text.encode()))) + 1 if text else 0

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of two texts' concatenation from the ids of each."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        x, tail = self._before(left)
        y, head = self._behind(right)
        a, b = tail.decode(), head.decode()
        if len(tail) + len(head) <= RUN:
            got = np.array(self.encode([a + b])[0], np.int32)
        else:
            got = self._run(left[x:], right[:y], a, b)
        return np.concatenate([left[:x], got, right[y:]])

    def tree(self, pieces: list[np.ndarray]) -> np.ndarray:
        while len(pieces) > 1:
            pieces = [self.join(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0] if pieces else np.zeros(0, np.int32)

    def cut(self, text: str, size: int) -> list[str]:
        """Pieces of about ``size`` characters; a cut that would fall into an added token comes behind it."""
        out, at, spans, i = [], 0, [m.span() for m in self.added.finditer(text)], 0
        for k in range(size, len(text), size):
            while i < len(spans) and spans[i][1] <= k:
                i += 1
            place = spans[i][1] if i < len(spans) and spans[i][0] < k else k
            if place > at:
                out.append(text[at:place])
                at = place
        return [*out, text[at:]] if at < len(text) else out


_OPEN: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The tokenizer of this worker; it outlives a task."""
    if path not in _OPEN:
        _OPEN[path] = Coder(path)
    return _OPEN[path]


def _column(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{_column(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)


def encoded(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` with ``ids`` (array of int) in place of their text.

    A null or empty text has no ids: an empty array. Rows that repeat stay as often as they stand there. Another column named
    ``ids`` is replaced; the others pass through, whatever their names. Added tokens in a text are those tokens, as in the
    library. Texts of any length are encoded whole; of a long one the pieces' ids meet in one task, as its result does.
    """
    path = path or default_path()
    rest = [c for c in docs.columns if c not in (text, ids)]
    plain = [f"c{i}" for i in range(len(rest))]  # names that need no quotes, till the end
    shown = F.coalesce(F.col(_column(text)).cast("string"), F.lit("")).alias("text")
    rows = docs.select(shown, *(F.col(_column(c)).alias(p) for c, p in zip(rest, plain)))
    others = _schema(rows.select(*plain)) if rest else ""
    columns = ", ".join(filter(None, ["ids array<int>", others]))
    ints = pa.list_(pa.int32())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = coder(path)
        for batch in parts(batches, 128):
            got = pa.array(table.encode(batch.column(0).to_pylist()), ints)
            yield pa.RecordBatch.from_arrays([got, *batch.columns[1:]], names=["ids", *plain])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = coder(path)
        for batch in parts(batches, 1):
            made = table.cut(batch.column(0)[0].as_py(), size)
            first = pa.array([0, *[None] * (len(made) - 1)], pa.int32())  # the other columns stay with the first piece
            own = [pa.array([uuid.uuid4().hex] * len(made)), pa.array(range(len(made)), pa.int32()), pa.array(made)]
            yield pa.RecordBatch.from_arrays([*own, *(c.take(first) for c in batch.columns[1:])], names=["row", "piece", "text", *plain])

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = coder(path)
        for batch in parts(batches, 32):
            got = pa.array(table.encode(batch.column(2).to_pylist()), ints)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], got, *batch.columns[3:]], names=["row", "piece", "ids", *plain])

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece").combine_chunks()
        got = coder(path).tree([np.array(g.values.to_numpy(), np.int32) for g in group.column(2)])
        flat = pa.ListArray.from_arrays(pa.array([0, len(got)], pa.int32()), pa.array(got, pa.int32()))
        return pa.table([flat, *(group.column(k).slice(0, 1) for k in range(3, group.num_columns))], names=["ids", *plain])

    short = in_arrow(rows.where(F.length("text") <= size), whole, columns)
    # A piece goes by its row's number, which is drawn once: the pieces are written before they are dealt.
    piece = ", ".join(filter(None, ["row string, piece int, {} ", others]))
    long = in_arrow(rows.where(F.length("text") > size), pieces, piece.format("text string"))
    long = Scratch(docs.sparkSession, "bpe").cut(long, "pieces").repartition("row", "piece")
    long = in_arrow(long, halves, piece.format("ids array<int>")).groupBy("row").applyInArrow(joined, columns)
    return short.union(long).toDF(ids, *rest)


def decoded(rows: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """The rows with the text of their ids, added tokens included, bytes that are no UTF-8 as U+FFFD.

    Missing ids have no text, an empty array the empty one; null elements and ids that no token has are left out. A column
    that is named as the text is replaced, all others pass through.
    """
    path = path or default_path()
    rest = [c for c in rows.columns if c not in (ids, text)]
    plain = [f"c{i}" for i in range(len(rest))]
    own = F.filter(F.col(_column(ids)), lambda i: i.isNotNull()).alias("ids")
    df = rows.select(own, *(F.col(_column(c)).alias(p) for c, p in zip(rest, plain)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = coder(path)
        for batch in parts(batches):
            texts = [None if not i.is_valid else table.bytes_of(i.values.to_numpy()).decode("utf-8", "replace") for i in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["ids", *plain, "text"])

    return in_arrow(df, run, f"{_schema(df)}, text string").toDF(ids, *rest, text)
