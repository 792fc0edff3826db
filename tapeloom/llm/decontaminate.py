"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton accepts every run of words that stands in some item. A text's words are streamed through it; it keeps the
length of the longest run that ends at each word. Where that reaches ``window`` words, or a whole item that is shorter,
the window that ends there is an occurrence and its words are hit. Only runs of known words that are long enough for some
window are streamed. The automaton is a few arrays, so one holds a long benchmark and all texts of a batch go side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .automaton import Automaton
from .store import Scratch
from .words import WORD, words
from .workers import in_arrow, parts


#: words of the items that one automaton holds (or one item): about 50 bytes each where it is used, 300 while it is built
MOST_WORDS = 5_000_000


def automata(benchmark: DataFrame, window: int, most_words: int) -> Iterator[Automaton]:
    """Automata of at most ``most_words`` words (or one item) of the items each. Items are read one partition at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).where("text is not null")
    for item, text in rows.toLocalIterator():
        tokens = words(bytes(text))
        if held and size + len(tokens) > most_words:
            yield Automaton(held, window)
            held, size = [], 0
        held.append((item, tokens))
        size += len(tokens)
    yield Automaton(held, window)


SPANS = "array<struct<from:bigint,to:bigint>>"
MARKS = ("hit spans", "hit items", "all words")


def annotated(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` (text as binary) with the columns ``MARKS``.

    An automaton of at most ``MOST_WORDS`` words is broadcast; a longer benchmark is taken in parts of that size, and what one
    part gives is written before the next is read, so neither the driver nor an executor holds more than one.
    """
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    rest = [c for c in docs.columns if c != "text"]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "text binary", f"`{MARKS[0]}` {SPANS}", f"`{MARKS[1]}` array<string>", f"`{MARKS[2]}` long"])

    def over(shared) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for b in parts(batches):
                texts = [words(text.as_py()) for text in b.column("text")]
                n, spans, items = list(map(len, texts)), [], []
                for (runs, found), old, had in zip(automaton.scan(texts), b.column(MARKS[0]), b.column(MARKS[1])):
                    if old.as_py():
                        runs = joined([*runs, *((s["from"], s["to"]) for s in old.as_py())])
                    spans.append([{"from": x, "to": y} for x, y in runs])
                    items.append(sorted(found | set(had.as_py() or ())))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), b.column("text"), pa.array(spans, span), pa.array(items, pa.list_(pa.string())), pa.array(n, pa.int64())], names=[*rest, "text", *MARKS])

        return run

    scratch, shared = Scratch(docs.sparkSession, "decontaminate"), None
    now = docs.select(*(F.col(f"`{c}`") for c in rest), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"), F.lit(None).cast(SPANS).alias(MARKS[0]), F.lit(None).cast("array<string>").alias(MARKS[1]))
    for k, automaton in enumerate(automata(benchmark, window, MOST_WORDS)):
        if shared is not None:
            now = scratch.cut(now, f"part{k}").drop(MARKS[2])
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(automaton)
        now = in_arrow(now, over(shared), kinds)
    return now


def judged(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items) for each row of ``docs``.

    spans: hit runs of words; items: ids (as strings) of the items found; contaminated: at least one word in ``share`` is
    hit. A null or empty text has no words; rows that repeat and null ids stay as they are; other columns are ignored. An
    item whose text is null or has no words is left out; one whose id is null counts for n_hit and is not among the items;
    items that repeat count once. A very long text is streamed in overlapping stretches. No documents give no rows, no items
    no hits.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    got = annotated(named, benchmark, window).select("doc_id", *(F.col(f"`{m}`").alias(c) for m, c in zip(MARKS, ("spans", "items", "n_words")))).withColumn("n_hit", hit)
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans", "items",
    )


def without_spans(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``runs`` and what stands between them."""
    found = list(WORD.finditer(raw.lower()))
    at, out = 0, []
    for a, b in runs:
        out.append(raw[at : found[a].start()])
        at = found[b - 1].end()
    return b"".join([*out, raw[at:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, cut_spans: bool = False) -> DataFrame:
    """``docs`` without contaminated rows; with ``cut_spans`` contaminated rows stay and lose their hit words instead."""
    rest = [f for f in docs.schema if f.name != "text"]
    marked = annotated(docs, benchmark, window)
    n = F.aggregate(F.col(f"`{MARKS[0]}`"), F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    bad = (n > 0) & (share * n >= F.col(f"`{MARKS[2]}`"))
    if not cut_spans:
        return marked.where(~bad).withColumn("text", F.decode("text", "UTF-8")).select(*(F.col(f"`{c}`") for c in docs.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            texts = [without_spans(t, [(s["from"], s["to"]) for s in runs]).decode() if cut else t if t is None else t.decode() for t, runs, cut in zip(*(b.column(c).to_pylist() for c in ("text", MARKS[0], "cut")))]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(texts, pa.string())], names=[*(f.name for f in rest), "text"])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "text string"])
    out = in_arrow(marked.withColumn("cut", bad), run, kinds)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
