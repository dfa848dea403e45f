"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of passage_words words.  Every passage of the whole text is encoded: its
words' embeddings, in VOCABULARY buckets of hashed words, are averaged, and counted features (shares of
character classes, word shapes, how much of it repeats in its document) stand beside them in a hidden
layer.  Gated attention weighs the passages, and the weighted sum of their representations is scored by a
logistic unit.  Embeddings, hidden layer, attention and unit are learned together, from the documents'
labels alone.

The model is fitted in numpy on the driver, batch by batch, from all passages of at most max_train labelled
documents (those with the least hash of their id and of their text); what it holds of a passage is about as large
as its text.  Scoring reads all passages of every text, in one pass without a shuffle, a bounded number of them
at a time.

Defined results: null, empty and blank texts are one passage without words and get a score like any
other; the score depends on the text alone, so copies score alike; rows that repeat a doc_id are
scored each, and of different texts of a labelled doc_id the one with the least hash is learned from; a
null doc_id is never held out and never learned from; if several label rows share an id the largest label
counts; texts of any length are scored whole; without labels of both classes every score is the share of label 1
(0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import groups
from .common import release
from .words import mixed

_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.zeros(256, np.int64)  # 0 other control, 1 space, 2 line feed, 3 lower, 4 upper, 5 digit, 6 high, 7.. punctuation
_CLASS[[9, 11, 12, 13, 32]] = 1
_CLASS[10] = 2
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 3, 4, 5, 6
_CLASS[list(_PUNCT)] = 7 + np.arange(len(_PUNCT))
_N_CLASS = 7 + len(_PUNCT)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MULT = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
N_FEATURES = _N_CLASS + 10
#: buckets of hashed words, and the size of an embedding
VOCABULARY, SIZE = 1 << 14, 16


@dataclass
class Passages:
    """Passages of many texts end to end: features (rows), the first row of each text, the words' buckets and
    the number of words of each passage."""

    x: np.ndarray
    first: np.ndarray
    words: np.ndarray
    count: np.ndarray

    def of(self) -> np.ndarray:
        """The passage of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def texts(self) -> Iterator[Passages]:
        """Each text by itself."""
        ends, at = np.append(self.first[1:], len(self.x)), np.concatenate(([0], np.cumsum(self.count)))
        for lo, hi in zip(self.first, ends):
            yield Passages(self.x[lo:hi], np.zeros(1, np.int64), self.words[at[lo] : at[hi]], self.count[lo:hi])


def together(parts: list[Passages]) -> Passages:
    first = np.concatenate(([0], np.cumsum([len(p.x) for p in parts])[:-1])).astype(np.int64)
    return Passages(np.concatenate([p.x for p in parts]), first, np.concatenate([p.words for p in parts]), np.concatenate([p.count for p in parts]))


def passages(texts: list[str | None], passage_words: int) -> Passages:
    """All passages of the texts."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begin = np.zeros(len(raw), np.int64)
    np.cumsum([len(r) + 1 for r in raw[:-1]], out=begin[1:])
    space = _SPACE[data]
    before = np.concatenate(([True], space[:-1]))
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(~before & space)
    doc = np.searchsorted(begin, starts, "right") - 1
    n_words = np.bincount(doc, minlength=len(raw))
    first_word = np.concatenate(([0], np.cumsum(n_words)[:-1]))
    n_pass = np.maximum(1, -(-n_words // passage_words))
    first = np.concatenate(([0], np.cumsum(n_pass)[:-1]))
    total = int(n_pass.sum())
    inside = np.arange(len(starts)) - first_word[doc] if len(starts) else np.zeros(0, np.int64)
    of_word = first[doc] + inside // passage_words if len(starts) else inside
    # a passage reaches from its first word (the text's begin for a first one) to the next passage
    where = np.zeros(total, np.int64)
    heads = np.flatnonzero(inside % passage_words == 0)
    where[of_word[heads]] = starts[heads]
    where[first] = begin
    size = np.diff(np.append(where, len(data)))
    of_byte = np.repeat(np.arange(total), size)
    chars = np.bincount(of_byte * _N_CLASS + _CLASS[data], minlength=total * _N_CLASS).reshape(total, _N_CLASS) / np.maximum(1, size)[:, None]
    count = np.bincount(of_word, minlength=total)
    per = lambda x: np.bincount(of_word, weights=x, minlength=total) / np.maximum(1, count)
    if len(starts):
        length = ends - starts
        at = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(data)]))))
        weighed = np.where(space, np.uint64(0), data.astype(np.uint64) + np.uint64(1)) * _MULT[np.minimum(at, 63)]
        hashed = np.add.reduceat(weighed, starts)
        repeats = []
        for k in (1, 3, 6):  # the share of k-word sequences that come again in the document
            h = hashed.copy()
            for j in range(1, k):
                h[:-j] += hashed[j:] * _MULT[j]
            h ^= doc.astype(np.uint64) * _MULT[40]
            _, back, times = np.unique(h, return_inverse=True, return_counts=True)
            repeats.append(per((times[back] > 1) * 1.0))
        more = [per(length) / 10, per(length <= 2), per(length > 12), per(_CLASS[data[starts]] == 4), per(_CLASS[data[ends - 1]] >= 7), *repeats]
    else:
        more = [np.zeros(total)] * 8
    whole = np.repeat(n_words, n_pass)
    words = (mixed(hashed) % np.uint64(VOCABULARY)).astype(np.uint16) if len(starts) else np.zeros(0, np.uint16)
    return Passages(np.column_stack([chars, *more, count / passage_words, np.log1p(whole) / 10]).astype(np.float32), first, words, count)


def _sums(rows: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, so many for each; none gives zeros."""
    out = np.zeros((len(count), rows.shape[1]), rows.dtype)
    some = np.flatnonzero(count)
    if len(some):
        out[some] = np.add.reduceat(rows, (np.cumsum(count) - count)[some], axis=0)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    e: np.ndarray  # buckets x embedding
    p: np.ndarray  # embedding x hidden
    w: np.ndarray  # features x hidden
    b: np.ndarray
    v: np.ndarray  # hidden x attention, tanh
    u: np.ndarray  # hidden x attention, gate
    a: np.ndarray  # attention
    c: np.ndarray  # hidden, the logistic unit
    d: np.ndarray

    def encode(self, bags: Passages, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The passages' scaled features, mean embeddings and hidden representations; of long texts some words
        at a time."""
        x = np.clip((bags.x - self.mean) / self.scale, -8, 8)
        ends, means, lo = np.cumsum(bags.count), [], 0
        while lo < len(bags.count):
            begin = ends[lo] - bags.count[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, begin + step, "right")))
            means.append(_sums(self.e[bags.words[begin : ends[hi - 1]]], bags.count[lo:hi]))
            lo = hi
        m = np.concatenate(means) / np.maximum(1, bags.count)[:, None]
        return x, m, np.tanh(x @ self.w + m @ self.p + self.b)

    def forward(self, bags: Passages) -> tuple:
        """Scores of the bags, and what their gradients need."""
        x, m, h = self.encode(bags)
        first = bags.first
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * g) @ self.a
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        weight = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(weight[:, None] * h, first)
        return 1 / (1 + np.exp(-(z @ self.c + self.d[0]))), x, m, h, t, g, weight, z, bag

    def scores(self, bags: Passages) -> np.ndarray:
        return np.round(self.forward(bags)[0], 9)


def fit(bags: list[Passages], y: np.ndarray, hidden: int = 32, attention: int = 16, epochs: int = 10, batch: int = 128, rate: float = 0.004, decay: float = 1e-4, word_decay: float = 0.01, seed: int = 11) -> Model:
    """Adam on the log loss of the bags' labels; of the embeddings only those of a batch's words move, and
    they decay faster, since most words are met in a few documents."""
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    x = np.concatenate([b.x for b in bags]) if bags else np.zeros((1, N_FEATURES))
    share = float(y.mean()) if len(y) else 0.5
    m = Model(x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-3, rng.normal(0, 0.01, (VOCABULARY, SIZE)), init(SIZE, hidden), init(N_FEATURES, hidden), np.zeros(hidden), init(hidden, attention), init(hidden, attention), init(attention), init(hidden), np.array([np.log((share + 1e-6) / (1 - share + 1e-6))]))
    if not len(y) or y.min() == y.max():
        m.c[:] = 0
        return m
    names = ["e", "p", "w", "b", "v", "u", "a", "c", "d"]
    state = {k: [np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))] for k in names}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            part = together([bags[k] for k in pick])
            score, xb, mean, h, t, g, weight, z, bag = m.forward(part)
            dl = (score - y[pick]) / len(pick)
            dz = dl[:, None] * m.c
            dh = weight[:, None] * dz[bag]
            dw = (h * dz[bag]).sum(1)
            de = weight * (dw - np.add.reduceat(weight * dw, part.first)[bag])
            dt, dg = de[:, None] * m.a * g * (1 - t * t), de[:, None] * m.a * t * g * (1 - g)
            dh = (dh + dt @ m.v.T + dg @ m.u.T) * (1 - h * h)
            to_words = (dh @ m.p.T) / np.maximum(1, part.count)[:, None]
            turn = np.argsort(part.words, kind="stable")
            used, times = np.unique(part.words, return_counts=True)
            grads = {"e": _sums(to_words[part.of()[turn]], times), "p": mean.T @ dh, "w": xb.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ dl, "d": np.array([dl.sum()])}
            step += 1
            lr = rate * min(1, 2 * (1 - epoch / epochs))
            for k in names:
                rows = used if k == "e" else slice(None)
                value, (m1, m2) = getattr(m, k), state[k]
                grad = grads[k] + ((word_decay if k == "e" else decay) * value[rows] if k not in ("b", "d") else 0)
                m1[rows] += 0.1 * (grad - m1[rows])
                m2[rows] += 0.001 * (grad * grad - m2[rows])
                value[rows] -= lr * (m1[rows] / (1 - 0.9**step)) / (np.sqrt(m2[rows] / (1 - 0.999**step)) + 1e-8)
    m.e = m.e.astype(np.float32)
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = 5000, passage_words: int = 60, **kw) -> Model:
    """Fits the model on the features of labelled rows that aren't held out."""
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("_y"))
    # the bound holds before the texts are touched: least hashes first
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", F.col("text").alias("text")).join(F.broadcast(marks), "doc_id")
    # of a doc_id's texts the one with the least hash; what is compared is short, the text goes along
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "_y"), F.xxhash64("text")).alias("r")).select("doc_id", "r.text", "r._y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            parts = [p for value in batch.column(1) for p in passages([value.as_py()], passage_words).texts()]
            columns = [[p.x.tobytes() for p in parts], [p.words.tobytes() for p in parts], [p.count.astype(np.int32).tobytes() for p in parts]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.binary()) for c in columns)], names=["doc_id", "y", "x", "words", "count"])

    got = rows.select("doc_id", "text", F.col("_y").cast("int")).mapInArrow(run, "doc_id long, y int, x binary, words binary, count binary").collect()
    got.sort(key=lambda r: r[0])
    bags = [Passages(np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES), np.zeros(1, np.int64), np.frombuffer(r[3], np.uint16), np.frombuffer(r[4], np.int32).astype(np.int64)) for r in got]
    return fit(bags, np.array([float(r[1]) for r in got]), **kw)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, passage_words: int = 60, keep_columns: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every row (all columns of docs before score and
    predicted, which replace columns of these names, if keep_columns)."""
    fields = docs.drop("score", "predicted") if keep_columns else docs.select("doc_id", "text")
    schema = T.StructType([*fields.schema.fields, T.StructField("score", T.DoubleType())]) if keep_columns else "doc_id long, score double"
    at, ids = fields.columns.index("text"), fields.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for k, texts in groups(batch.column(at)):
                part = batch.slice(k, len(texts))
                score = pa.array(model.scores(passages(texts, passage_words)), pa.float64())
                if keep_columns:
                    yield pa.RecordBatch.from_arrays([*part.columns, score], names=[*part.schema.names, "score"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(ids), score], names=["doc_id", "score"])

    if not keep_columns:
        fields = fields.select(F.col("doc_id").cast("long"), "text")
    scored = fields.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return scored if keep_columns else scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
