"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded; filters of several widths run over a window of bytes; each keeps its maximum (through a rectifier) and
a softmax layer reads them. Letters are lower-cased first. All widths are columns of one matrix, so a window is one product. A text is cut into windows of
fixed length that cover all of it; the logits of its windows, weighted by their bytes, are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from .workers import in_arrow, parts

LETTER = regex.compile(r"\p{L}")
WINDOW = 256


@dataclass
class Model:
    labels: list[str]
    embedding: np.ndarray  # 257 x d; row 256 pads
    filters: np.ndarray  # (width * d) x f
    bias: np.ndarray
    out: np.ndarray  # f x labels
    out_bias: np.ndarray
    width: int

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(patches, responses) of windows of byte numbers."""
        e = self.embedding[x]
        n, length, d = e.shape
        s = e.strides
        patches = np.lib.stride_tricks.as_strided(e, (n, length - self.width + 1, self.width * d), (s[0], s[1], s[2]))
        return patches, (patches.reshape(-1, self.width * d) @ self.filters).reshape(n, -1, self.filters.shape[1])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(x)[1].max(1) + self.bias, 0) @ self.out + self.out_bias

    def of_texts(self, texts: list[bytes], together: int = 64) -> np.ndarray:
        """Mean logits of each text over the windows that cover it."""
        total, weight = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        rows: list[np.ndarray] = []
        owner: list[int] = []
        sizes: list[int] = []

        def flush() -> None:
            if rows:
                got = self.logits(np.stack(rows)) * np.array(sizes)[:, None]
                np.add.at(total, owner, got)
                np.add.at(weight, owner, sizes)
                rows.clear()
                owner.clear()
                sizes.clear()

        for i, text in enumerate(texts):
            data = np.frombuffer(text, np.uint8)
            for at in range(0, len(data), WINDOW):
                part = data[at : at + WINDOW]
                row = np.full(WINDOW, 256, np.int16)
                row[: len(part)] = part
                rows.append(row)
                owner.append(i)
                sizes.append(len(part))
                if len(rows) == together:
                    flush()
        flush()
        return (total / np.maximum(weight, 1)[:, None]).astype(np.float64)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[list[bytes]], labels: list[str], widths: tuple[int, ...] = (2, 3, 4, 5), each: int = 8, d: int = 8, epochs: int = 12, rate: float = 0.01, batch: int = 64, seed: int = 5) -> Model:
    """Adam on cross-entropy; each label weighs the same. A text is a list of parts; in each epoch a window is drawn anew from
    one of them, some of them short."""
    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    width, f = max(widths), each * len(widths)
    mask = np.repeat(np.concatenate([np.r_[np.ones((w, each)), np.zeros((width - w, each))] for w in widths], axis=1), d, axis=0).astype(np.float32)
    emb = rng.normal(0, 0.5, (257, d)).astype(np.float32)
    emb[256] = 0
    m = Model(names, emb, (rng.normal(0, 0.3, (width * d, f)) * mask).astype(np.float32), np.zeros(f, np.float32), rng.normal(0, 0.3, (f, len(names))).astype(np.float32), np.zeros(len(names), np.float32), width)
    weight = (len(y) / len(names) / np.maximum(np.bincount(y, minlength=len(names)), 1)).astype(np.float32)
    params = [m.embedding, m.filters, m.bias, m.out, m.out_bias]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            x = np.full((len(some), WINDOW), 256, np.int16)
            for k, i in enumerate(some):
                size = WINDOW if rng.random() < 0.6 else int(rng.integers(12, WINDOW))
                own = texts[i][int(rng.integers(0, len(texts[i])))]
                begin = int(rng.integers(0, max(1, len(own) - size + 1)))
                part = np.frombuffer(own[begin : begin + size], np.uint8)
                x[k, : len(part)] = part
            patches, r = m.pooled(x)
            arg = r.argmax(1)
            top = np.take_along_axis(r, arg[:, None, :], 1)[:, 0] + m.bias
            hid = np.maximum(top, 0)
            p = softmax(hid @ m.out + m.out_bias)
            g = p
            g[np.arange(len(some)), y[some]] -= 1
            g = (g * weight[y[some]][:, None] / len(some)).astype(np.float32)
            gh = (g @ m.out.T) * (top > 0)
            picked = patches[np.arange(len(some))[:, None], arg]  # n x f x width*d
            gf = np.einsum("nf,nfk->kf", gh, picked) * mask
            gp = (gh[:, :, None] * m.filters.T[None]).reshape(len(some), f, width, d)
            ge = np.zeros_like(m.embedding)
            which = x[np.arange(len(some))[:, None, None], arg[:, :, None] + np.arange(width)]
            np.add.at(ge, which, gp)
            ge[256] = 0
            step += 1
            now = rate * (1 - epoch / epochs)
            for q, grad, (a, b) in zip(params, (ge, gf, gh.sum(0), hid.T @ g, g.sum(0)), moment):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                q -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, per_label: int = 1500, spread: int = 8, seed: int = 5) -> Model | None:
    """A model of the rows of ``docs`` that aren't held out and have a lang; None if there are none.

    At most ``per_label`` rows of each label are taken, those with the smallest hashes of doc_id and text (of rows that are
    alike in both, any): this bound, with ``spread`` parts of ``WINDOW`` bytes that lie evenly over the whole of each text,
    is what bounds the driver's memory. Labels are expected to be few (up to some hundreds).
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # about twice as many are let through by their hash, and of these the first ones count exactly
    share = F.create_map(*(x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, 2 * per_label / n)))))
    h = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30))
    size, raw = F.octet_length("text"), F.encode("text", "UTF-8")
    begin = lambda k: (F.greatest(size - WINDOW, F.lit(0)) * k / max(1, spread - 1)).cast("int") + 1
    own = F.when(size <= spread * WINDOW, F.array(raw)).otherwise(F.array(*(raw.substr(begin(k), F.lit(WINDOW)) for k in range(spread))))
    taken = rows.withColumn("h", h).where(F.col("h") < share[F.col("lang")] * (1 << 30)).select("doc_id", "lang", "h", own.alias("own"))
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "own")
    got = taken.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_label).collect()
    made = [(r["h"], r["lang"], [bytes(p).decode(errors="ignore").lower().encode() for p in r["own"]]) for r in got]
    made = sorted(((h, lang, [p for p in parts_ if p]) for h, lang, parts_ in made), key=lambda r: r[:3])
    made = [r for r in made if r[2]]
    return train([r[2] for r in made], [r[1] for r in made], seed=seed) if made else None


def predicted(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the label and its softmax share; `und` and 0.0 where text is null or has no letter, or without a model."""
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{names[0]}` string", f"`{names[1]}` double"])
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            texts = part.column(columns.index("text")).to_pylist()
            good = [i for i, t in enumerate(texts) if model is not None and t and LETTER.search(t)]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if good:
                p = softmax(model.of_texts([texts[i].lower().encode() for i in good]))
                for i, k, q in zip(good, p.argmax(1).tolist(), p.max(1).tolist()):
                    lang[i], score[i] = model.labels[k], q
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score, pa.float64())], names=[*columns, *names])

    return in_arrow(docs, run, kinds)


def identified(docs: DataFrame, per_label: int = 1500) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang), fitted on its own labelled rows.

    Null or letterless texts are `und`; a null doc_id isn't held out; repeated rows and other columns don't matter; of equal
    scores the first label in order counts; a very long text is read in windows; an empty table gives no rows.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    got = predicted(named.select("doc_id", "text"), fit(named, per_label))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
