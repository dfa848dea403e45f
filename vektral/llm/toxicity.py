"""Toxicity: a support vector machine with a subsequence string kernel over Nystroem landmarks.

Texts are cut into sentences of at most SENTENCE_WORDS words, and sentences into units: words; what stands
between white space, where there are other characters inside (id*iot); and three or more single letters after
each other, put together (i d i o t).  The kernel of two units counts the subsequences of LENGTH characters
that they share, gaps included, each weighed by DECAY to the power of the span it takes in either of
them (spans up to SPAN), divided by the units' norms, and raised to the third power; the kernel of two sentences is the
sum over their distinct units.  So inserted characters and gaps leave a unit near to what it was.

Landmarks are units of labelled sentences: those most tied to the label, and others by hash.  The feature map
is the kernel with the landmarks times the inverse root of their own kernel matrix, and the machine is
linear in it (squared hinge, Newton steps), so that a sentence's decision is a sum over its units.  As labels
stand for documents, all sentences of a toxic document begin as toxic; in each later round those that
score near its highest one stand for it, and sentences of clean documents stay clean.  A document scores as its highest
sentence, through a logistic function of the decision's logarithm fitted to the documents.

Labelled documents are dealt out by Spark: units are counted, sentences' features made and gradients and
curvatures summed in tasks; the driver sees the landmarks' counts, sums as large as their number squared, and two
numbers a labelled document.  At most max_train labelled documents are learned from, those of least hash.
Scoring is one pass over all texts without a shuffle; each distinct word of a batch is compared once.

Defined results: null, empty and blank texts have no unit and score as a sentence without one; the score
depends on the text alone, so copies score alike; rows that repeat a doc_id are scored each, and of
different texts of a labelled doc_id the one with the least hash is learned from; a null doc_id is never held
out and never learned from; if several label rows share an id the largest label counts; texts of any length are
scored whole; without labels of both classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import groups
from .common import forget, held, release, written
from .quality_mil import held_out
from .words import mixed

LENGTH, SPAN, DECAY = 3, 6, 0.95
SENTENCE_WORDS = 40
#: letters of a unit that are compared as one string; longer ones are cut, with SPAN - 1 letters shared
UNIT = 48

#: bytes by 6-bit symbols: 0 is none (lead bytes of UTF-8, signs), 1-26 letters, 27-28 digits, 31 the begin of
#: a unit, 32-63 what follows a lead byte
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[48:58] = 27 + np.arange(10) % 2
_SYMBOL[128:192] = 32 + np.arange(64) % 32
BEGIN = 31
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), list(b".!?\n"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WEIGHTS = np.random.default_rng(13).integers(1, 1 << 63, UNIT + 1, dtype=np.uint64) | np.uint64(1)


@dataclass
class Units:
    """The units of some texts: their letters end to end, where each begins, their hash, sentence, and for each
    sentence its text."""

    letters: np.ndarray
    start: np.ndarray
    length: np.ndarray
    hashed: np.ndarray
    sentence: np.ndarray
    text: np.ndarray

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first of equal units, and of each sentence its number and the places of its distinct units among them."""
        _, first, back = np.unique(self.hashed, return_index=True, return_inverse=True)
        key = np.sort(self.sentence * len(first) + back)
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        return first, *np.divmod(key, max(1, len(first)))

    def strings(self) -> list[bytes]:
        return [self.letters[s : s + n].tobytes() for s, n in zip(self.start.tolist(), self.length.tolist())]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true."""
    turn = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    return turn[0::2], turn[1::2]


def _hashes(letters: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
    within = at - np.repeat(start, length)
    off = np.cumsum(length) - length
    h = np.add.reduceat((letters[at].astype(np.uint64) + np.uint64(1)) * _WEIGHTS[within], off)
    return mixed(h + length.astype(np.uint64) * _WEIGHTS[UNIT])


def units(texts: list[str | None]) -> Units:
    raw = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
    letter, space = _LETTER[data], _SPACE[data]
    start, end = _spans(letter)
    # sentences: a stop or the text's end closes one, and so do SENTENCE_WORDS words
    stop = _STOP[data]
    stop[:-1] &= ~letter[1:]  # a dot between letters closes nothing
    stops = np.cumsum(stop | (data == 10), dtype=np.int64)
    place = stops[start] if len(start) else np.zeros(0, np.int64)
    first = np.concatenate(([True], place[1:] != place[:-1])) if len(start) else np.zeros(0, bool)
    run = np.arange(len(start)) - np.maximum.accumulate(np.where(first, np.arange(len(start)), 0)) if len(start) else place
    new = first | (run % SENTENCE_WORDS == 0)
    sentence = np.cumsum(new) - 1 if len(start) else place
    text = np.searchsorted(begin, start[new], "right") - 1
    size = end - start
    more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (letters of each unit by place, length, sentence)
    # single letters after each other, with no more than three other characters between two of them
    one = size == 1
    if one.any():
        near = np.zeros(len(start), bool)
        near[1:] = one[1:] & one[:-1] & (start[1:] - end[:-1] <= 3) & (sentence[1:] == sentence[:-1])
        lo, hi = _spans(near)
        lo = lo - 1  # the run begins with the letter before
        long = hi - lo >= 3
        lo, hi = lo[long], hi[long]
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        more.append((start[at], n, sentence[lo]))
    # what stands between white space, with other characters inside
    inner = np.zeros(len(start), bool)
    if len(start) > 1:
        gap = start[1:] - end[:-1]
        blank = np.concatenate(([0], np.cumsum(space)))
        inner[1:] = (blank[start[1:]] == blank[end[:-1]]) & (gap <= 3) & (sentence[1:] == sentence[:-1])
    if inner.any():
        lo, hi = _spans(inner)
        a, b = start[lo - 1], end[hi - 1]
        n = b - a
        more.append((np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum()), n, sentence[lo]))
    letters = data
    if more:
        extra = np.concatenate([data[m[0]] for m in more])
        n = np.concatenate([m[1] for m in more])
        letters = np.concatenate((data, extra))
        start, size = np.concatenate((start, len(data) + np.cumsum(n) - n)), np.concatenate((size, n))
        sentence = np.concatenate((sentence, *(m[2] for m in more)))
    # long units in pieces that share SPAN - 1 letters
    pieces = np.maximum(1, -(-(size - (SPAN - 1)) // (UNIT - (SPAN - 1))))
    if (pieces > 1).any():
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin_at = np.repeat(start, pieces) + k * (UNIT - (SPAN - 1))
        size = np.minimum(UNIT, np.repeat(start + size, pieces) - begin_at)
        start, sentence = begin_at, np.repeat(sentence, pieces)
    return Units(letters, start, size, _hashes(letters, start, size), sentence, text)


#: weights as whole numbers, so that sums don't depend on their order
_WEIGHT = np.round(DECAY ** np.arange(8) * 2.0**30).astype(np.int64)


def subsequences(letters: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, code, weight) of the subsequences of the units, in this order, each code once; a unit has its begin
    in front."""
    n = length + 1
    off = np.cumsum(n) - n
    at = np.repeat(start - 1 - off, n) + np.arange(int(n.sum()))
    symbols = _SYMBOL[letters[np.maximum(at, 0)]]
    symbols[off] = BEGIN
    unit = np.repeat(np.arange(len(start), dtype=np.int64), n)
    # what has no symbol takes no place
    stay = symbols > 0
    unit, kept = unit[stay], symbols[stay].astype(np.int64)
    m = len(kept)
    unit, kept = np.concatenate((unit, np.full(SPAN, -1))), np.concatenate((kept, np.zeros(SPAN, np.int64)))
    keys = []
    for b in range(2, SPAN):
        ok = np.flatnonzero(unit[b : m + b] == unit[:m])
        ends = (unit[ok] << 21) | (kept[ok] << 15) | (kept[ok + b] << 3) | b
        keys += [ends | (kept[ok + a] << 9) for a in range(1, b)]
    key = np.sort(np.concatenate(keys))
    if not len(key):
        return key, key, key
    weight, key = _WEIGHT[(key & 7) + 1], key >> 3
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[new] >> 18, key[new] & 0x3FFFF, np.add.reduceat(weight, new)


@dataclass
class Landmarks:
    """Landmark units, with their subsequences as lists: for each code where its list begins and ends, and
    the landmarks that hold it with their weights."""

    names: list[bytes]
    begin: np.ndarray
    holder: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, names: list[bytes]) -> Landmarks:
        length = np.array([len(x) for x in names], np.int64)
        who, code, weight = subsequences(np.frombuffer(b"".join(names) or b" ", np.uint8), np.cumsum(length) - length, length)
        norm = np.sqrt(np.bincount(who, weight.astype(float) ** 2, minlength=len(names)))
        order = np.argsort(code, kind="stable")
        return cls(names, np.searchsorted(code[order], np.arange((1 << 18) + 1)).astype(np.int32), who[order].astype(np.int32), (weight / norm[who])[order])

    def kernels(self, letters: np.ndarray, start: np.ndarray, length: np.ndarray, beta: np.ndarray | None = None, step: int = 1 << 12) -> np.ndarray:
        """The kernel of each unit with each landmark, or its product with beta."""
        wide = len(self.names)
        out = np.zeros((len(start), wide) if beta is None else len(start), np.float32)
        for lo in range(0, len(start) if wide else 0, step):
            s, n = start[lo : lo + step], length[lo : lo + step]
            who, code, weight = subsequences(letters, s, n)
            norm = np.sqrt(np.bincount(who, weight.astype(float) ** 2, minlength=len(s)))
            first, many = self.begin[code], self.begin[code + 1] - self.begin[code]
            hit = many > 0
            who, weight, first, many = who[hit], weight[hit] / norm[who[hit]], first[hit], many[hit]
            at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            k = np.bincount(np.repeat(who * wide, many) + self.holder[at], np.repeat(weight, many) * self.weight[at], minlength=len(s) * wide).reshape(len(s), wide)
            k = k * k * k
            out[lo : lo + step] = k if beta is None else k @ beta
        return out

    def root(self, floor: float = 1e-6) -> np.ndarray:
        """The inverse root of the landmarks' kernel matrix."""
        length = np.array([len(x) for x in self.names], np.int64)
        k = self.kernels(np.frombuffer(b"".join(self.names) or b" ", np.uint8), np.cumsum(length) - length, length).astype(float)
        values, vectors = np.linalg.eigh((k + k.T) / 2)
        good = values > floor * max(values.max(initial=0), 1e-12)
        return vectors[:, good] / np.sqrt(values[good])


@dataclass
class Model:
    """beta: a unit's part of the decision from its kernels; slope and offset of the logistic function;
    without landmarks every score is the offset's."""

    landmarks: Landmarks
    beta: np.ndarray
    slope: float
    offset: float

    def decisions(self, texts: list[str | None], known: Known | None = None) -> np.ndarray:
        """Of each text's highest sentence, the logarithm; a text without units counts as one such sentence."""
        u = units(texts)
        out = np.full(len(texts), -np.inf)
        first, sentence, place = u.distinct()
        look = lambda k: self.landmarks.kernels(u.letters, u.start[first[k]], u.length[first[k]], self.beta)
        part = known.get(u.hashed[first], look) if known else look(np.arange(len(first)))
        total = np.round(np.bincount(sentence, part[place], minlength=len(u.text)), 6)
        np.maximum.at(out, u.text, total)
        return logarithm(np.where(np.isinf(out), 0, out))

    def scores(self, texts: list[str | None], known: Known | None = None) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.slope * self.decisions(texts, known) + self.offset, -30, 30))), 9)


class Known:
    """What a worker knows of units by hash; when it is full, it begins again."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.keys, self.values = most, np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def get(self, keys: np.ndarray, look) -> np.ndarray:
        """Values of sorted keys; look gives those of the places that aren't known."""
        at = np.searchsorted(self.keys, keys)
        found = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        found[inside] = self.keys[at[inside]] == keys[inside]
        out = np.zeros(len(keys), np.float32)
        out[found] = self.values[at[found]]
        new = np.flatnonzero(~found)
        if len(new):
            out[new] = look(new)
            if len(self.keys) + len(new) > self.most:
                self.keys, self.values = keys[new], out[new]
            else:
                self.keys, self.values = np.insert(self.keys, at[new], keys[new]), np.insert(self.values, at[new], out[new])
        return out


def _labelled(docs: DataFrame, labels: DataFrame, label: str, max_train: int) -> DataFrame:
    """(doc_id, text, y) of at most max_train labelled rows that aren't held out."""
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    marks = marks.join(docs.select("doc_id"), "doc_id", "left_semi")
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # two numbers a row
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("r")).select("doc_id", "r.text", "r.y")


def _choose(rows: DataFrame, tied: int, others: int) -> list[bytes]:
    """Landmarks: the units of the most toxic documents over their share of clean ones, and units by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for lo, texts in groups(batch.column(0)):
                u = units(texts)
                doc = u.text[u.sentence]
                _, first = np.unique(np.stack([u.hashed, doc.astype(np.uint64)], 1), axis=0, return_index=True)
                pick = Units(u.letters, u.start[first], u.length[first], u.hashed, u.sentence, u.text)
                y = np.asarray(batch.column(1))[lo + doc[first]]
                yield pa.RecordBatch.from_arrays([pa.array(pick.strings(), pa.binary()), pa.array(y, pa.int32())], names=["unit", "y"])

    counts = rows.select("text", "y").mapInArrow(run, "unit binary, y int").groupBy("unit").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    counts = written(counts.filter(F.octet_length("unit") >= LENGTH), "units")
    n = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    # documents with the unit against those expected if it had nothing to do with the label
    expected = (F.col("pos") + F.col("neg")) * (n[0] / (n[0] + n[1]))
    gain = (F.col("pos") - expected) / F.sqrt(expected + 0.1)
    best = counts.filter("pos > 0").orderBy(F.desc(gain), "unit").limit(tied).select("unit")
    other = counts.filter("neg > 0").orderBy(F.xxhash64("unit"), "unit").limit(others).select("unit")
    names = sorted({bytes(r[0]) for r in best.unionByName(other).collect()})
    forget(counts)
    return names


def _parts(flat: bytes, counts: bytes, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """A document's features, kept in half precision, and their counts."""
    return np.frombuffer(flat, np.float16).reshape(-1, wide).astype(np.float32), np.frombuffer(counts, np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = 4000, tied: int = 160, others: int = 32, rounds: int = 3, steps: int = 8, near: float = 0.3, penalty: float = 1.0, tasks: int = 24) -> Model:
    """Fits the machine on the sentences of labelled rows that aren't held out."""
    rows = written(_labelled(docs, labels, label, max_train), "labelled")
    n = [r[0] or 0 for r in [rows.agg(F.count("*")).first(), rows.agg(F.sum("y")).first()]]
    if not 0 < n[1] < n[0]:
        share = n[1] / n[0] if n[0] else 0.5
        return Model(Landmarks.of([]), np.zeros(0), 0.0, float(np.log((share + 1e-12) / (1 - share + 1e-12))))
    landmarks = Landmarks.of(_choose(rows, tied, others))
    root = landmarks.root().astype(np.float32)
    wide = root.shape[1]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document: its sentences' features; equal ones once, with their number."""
        release()
        for batch in batches:
            for lo, texts in groups(batch.column(0), 64, 1_000_000):
                u = units(texts)
                first, s, place = u.distinct()
                mapped = landmarks.kernels(u.letters, u.start[first], u.length[first]) @ root
                sums = np.zeros((len(u.text), wide), np.float32)
                new = np.flatnonzero(np.diff(s, prepend=-1))
                for a in range(0, len(new), 4096):
                    b = new[a + 4096] if a + 4096 < len(new) else len(s)
                    sums[s[new[a : a + 4096]]] = np.add.reduceat(mapped[place[new[a] : b]], new[a : a + 4096] - new[a], axis=0)
                flat, counts = [], []
                for d in range(len(texts)):
                    mine = sums[u.text == d]
                    some = np.abs(mine).sum(1) > 0
                    none = 1 if not some.all() or not len(mine) else 0
                    x = np.concatenate((mine[some], np.zeros((none, wide), np.float32)))
                    flat.append(x.astype(np.float16).tobytes())
                    counts.append(np.concatenate((np.ones(some.sum()), np.full(none, max(1, (~some).sum())))).astype(np.float32).tobytes())
                y = batch.column(1).slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([y, pa.array(flat, pa.binary()), pa.array(counts, pa.binary())], names=["y", "x", "n"])

    # so many tasks, whose sums the driver adds up
    bags = written(rows.select("text", "y").repartition(tasks).mapInArrow(features, "y int, x binary, n binary"), "sentences")
    forget(rows)
    w, weigh = np.zeros(wide + 1), 0.5 * n[0] / np.array([n[0] - n[1], n[1]])

    def sums(w: np.ndarray, first: bool) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and curvature over all sentences that take part."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, grad, curve = 0.0, np.zeros(wide + 1), np.zeros((wide + 1, wide + 1))
            for batch in batches:
                xs, ts, cs = [], [], []
                for y, flat, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    x, c = _parts(flat, counts, wide)
                    if y:
                        f = x @ w[:-1]
                        if not first:  # those near the highest stand for the document
                            x, c = x[f >= near * f.max()], c[f >= near * f.max()]
                        c = c / c.sum()
                    xs.append(x)
                    ts.append(np.full(len(x), 1.0 if y else -1.0))
                    cs.append(c * weigh[y])
                x, t, c = np.concatenate(xs), np.concatenate(ts), np.concatenate(cs)
                x = np.column_stack([x, np.ones(len(x))])
                slack = np.maximum(0, 1 - t * (x @ w))
                on = slack > 0
                loss += float((c * slack**2).sum()) / 2
                grad -= x.T @ (c * slack * t)
                curve += (x[on] * c[on, None]).T @ x[on]
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.tobytes()], pa.binary()), pa.array([curve.tobytes()], pa.binary())], names=["loss", "grad", "curve"])

        got = bags.mapInArrow(run, "loss double, grad binary, curve binary").collect()  # a row a task
        ridge = penalty * np.append(np.ones(wide), 1e-3)
        grad = sum(np.frombuffer(r[1]) for r in got) + ridge * w
        curve = sum(np.frombuffer(r[2]).reshape(wide + 1, -1) for r in got) + np.diag(ridge)
        return sum(r[0] for r in got) + float((ridge * w * w).sum()) / 2, grad, curve

    for k in range(rounds):
        last = np.inf
        for _ in range(steps):
            loss, grad, curve = sums(w, k == 0)
            if loss > last * (1 - 1e-3):
                break
            last = loss
            w = w - np.linalg.solve(curve, grad)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = [float((_parts(x, b"", wide)[0] @ w[:-1]).max()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top, pa.float64())], names=["y", "top"])

    got = bags.select("y", "x").mapInArrow(tops, "y int, top double").collect()  # two numbers a labelled document
    forget(bags)
    slope, offset = _logistic(logarithm(np.array([r[1] for r in got])), np.array([r[0] for r in got], float))
    return Model(landmarks, root.astype(float) @ w[:-1], slope, offset)


def logarithm(decision: np.ndarray) -> np.ndarray:
    """Of what a sentence adds to an empty one.  Edited insults keep a part of their decision, so that
    ratios matter."""
    return np.log(0.05 + np.maximum(decision, 0))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of least log loss, by damped Newton steps; a small ridge keeps them finite."""
    z = np.column_stack([x, np.ones(len(x))])
    v = np.zeros(2)
    # smoothed targets
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (p - t) + 1e-6 * v)
        v = v - step * min(1, 2 / max(np.abs(step).max(), 1e-12))
    return float(v[0]), float(v[1])


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some hundred landmarks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("toxicity", sent.value.beta.tobytes())
        release(key)
        known = held(key, Known)
        for batch in batches:
            for lo, texts in groups(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(sent.value.scores(texts, known), pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
