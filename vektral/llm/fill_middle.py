"""Fill-in-middle transformation: texts cut at two random places and put together in another order.

A numpy kernel works on the UTF-8 buffers of a whole Arrow batch.  Bytes are looked up in a table of
classes; two adjacent bytes' classes say whether a unit begins between them, and every text begins one.  The
cumulative sum of that mask, set back at each document, numbers the units of all rows at once; searchsorted
turns the units at which rows are cut into bytes; one gather writes the outputs of all rows.  Units are code
points (char), words with the white space after them (word), or lines with their line feed (line).

Cuts and forms come from a hash of the seed and doc_id, so reruns, other partitions and lost executors give
the same output.  plain is the text itself; psm is prefix, suffix, middle; spm is suffix, prefix, middle, each
part behind its mark.

Defined results: a null text is an empty one; empty texts and texts that hold a mark are plain; a null
doc_id is hashed as an empty string; rows that repeat a doc_id are cut by the same hash; texts of any length
are cut whole; an empty table gives an empty one.  Other columns of docs, whatever their names, don't come along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release

_byte = np.arange(256)
#: classes of bytes, and whether a unit begins between a byte of one class and a byte of another
UNITS = {
    "char": (((_byte & 0xC0) == 0x80).astype(np.uint8), np.array([[True, False], [True, False]])),
    "word": (np.isin(_byte, [9, 10, 11, 12, 13, 32]).astype(np.uint8), np.array([[False, False], [True, False]])),
    "line": ((_byte == 10).astype(np.uint8), np.array([[False, False], [True, True]])),
}
MARKS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
#: bytes that one gather indexes
STEP = 1 << 20


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and where its texts begin and end in them."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def unit_ordinals(data: np.ndarray, at: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte the number of units begun up to it, over all rows; for each row the units before it
    and the units in it."""
    classes, begins = UNITS[unit]
    cls = classes[data]
    mask = np.ones(len(data), bool)
    mask[1:] = begins[cls[:-1], cls[1:]]
    mask[at[:-1][at[:-1] < at[1:]]] = True
    begun = np.cumsum(mask, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    upto = np.concatenate(([0], begun))[at].astype(np.int64)
    return begun, upto[:-1], np.diff(upto)


def cut_bytes(begun: np.ndarray, base: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The byte at which each row has so many units behind it; at its end that is where the next text begins."""
    return np.searchsorted(begun, (base + units + 1).astype(begun.dtype), "left").astype(np.int64)


def find_marks(data: np.ndarray, at: np.ndarray, marks: tuple[bytes, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mark the places where it stands inside a text, and their rows."""
    out = []
    for m in marks:
        n = len(data) - len(m) + 1
        hit = np.flatnonzero(data[:n] == m[0]) if n > 0 else np.zeros(0, np.int64)
        for k in range(1, len(m)):
            hit = hit[data[hit + k] == m[k]]
        row = np.searchsorted(at, hit, "right") - 1
        whole = hit + len(m) <= at[row + 1]
        out.append((hit[whole], row[whole]))
    return out


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The segments of source one after the other; indexed STEP bytes at a time, long segments copied."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    lo = 0
    while lo < len(lengths):
        begin = ends[lo] - lengths[lo]
        hi = int(np.searchsorted(ends, begin + STEP, "right"))
        if hi <= lo:
            out[begin : ends[lo]] = source[starts[lo] : starts[lo] + lengths[lo]]
            lo += 1
            continue
        n = lengths[lo:hi]
        out[begin : ends[hi - 1]] = source[np.repeat(starts[lo:hi] - (ends[lo:hi] - n - begin), n) + np.arange(ends[hi - 1] - begin)]
        lo = hi
    return out


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    at = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes()))


def row_groups(column: pa.Array, most: int = 16 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some MB of text; a longer text is one by itself."""
    _, at = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def transformed(column: pa.Array, cuts: np.ndarray, shuffle: np.ndarray, spm: np.ndarray, unit: str, marks: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of all rows of a column: their units, form (a place in FORMS), units of prefix and middle, outputs.
    cuts are two random numbers a row, shuffle says which rows aren't left plain, spm which take that form."""
    data, at = buffers(column)
    begun, base, n = unit_ordinals(data, at, unit)
    first, second = np.sort(cuts % (n + 1), axis=0)
    form = np.where(shuffle & (n > 0), np.where(spm, 2, 1), 0)
    for _, row in find_marks(data, at, marks):
        form[row] = 0
    one, two = cut_bytes(begun, base, first), cut_bytes(begun, base, second)
    begin, end = at[:-1], at[1:]
    source = np.concatenate((data, np.frombuffer(b"".join(marks), np.uint8)))
    size = np.array([len(m) for m in marks])
    mark = len(data) + np.cumsum(size) - size
    # mark, part, mark, part, mark, part of every row; a plain row is its first part
    psm, whole = form == 1, form == 0
    starts = np.stack([np.where(psm, mark[0], mark[1]), np.where(psm | whole, begin, two), np.where(psm, mark[1], mark[0]), np.where(psm, two, begin), np.full(len(n), mark[2]), one], 1)
    sizes = np.stack([np.where(psm, size[0], size[1]), np.where(psm, one, end) - np.where(psm | whole, begin, two), np.where(psm, size[1], size[0]), np.where(psm, end - two, one - begin), np.full(len(n), size[2]), two - one], 1)
    sizes[whole, 0] = 0
    sizes[whole, 2:] = 0
    return n, form, first, second - first, strings(gathered(source, starts.ravel(), sizes.ravel()), sizes.sum(1))


def untransformed(column: pa.Array, form: np.ndarray, marks: tuple[bytes, ...]) -> pa.Array:
    """The texts behind outputs of known form, by the places of their marks."""
    data, at = buffers(column)
    begin, end = at[:-1], at[1:]
    place = []
    for hit, row in find_marks(data, at, marks):
        p = begin.copy()
        p[row[::-1]] = hit[::-1]  # the first of a row
        place.append(p)
    p, s, m = place
    lp, ls, lm = (len(x) for x in marks)
    psm, whole = form == 1, form == 0
    starts = np.stack([np.where(whole, begin, p + lp), m + lm, s + ls], 1)
    sizes = np.stack([np.where(whole, end - begin, np.where(psm, s, m) - p - lp), end - m - lm, np.where(psm, m, p) - s - ls], 1)
    sizes[whole, 1:] = 0
    return strings(gathered(data, starts.ravel(), sizes.ravel()), sizes.sum(1))


def hash_numbers(doc_id: Column, seed: int, count: int = 4) -> list[Column]:
    """The first 8-digit groups of the hex sha256 of the seed, a colon and the decimal doc_id, as numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: int = 1, plain_per_cent: int = 10, spm_per_cent: int = 20, marks: tuple[str, str, str] = MARKS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units (null where plain) and output of every row of docs."""
    if unit not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}")
    if len({*marks, ""}) != 4 or any(x.startswith(y[k:]) or x in y[k:] for x in marks for y in marks for k in range(x == y, len(y))):
        raise ValueError("three different marks, not empty, of which none holds or runs into another")
    raw = tuple(m.encode() for m in marks)
    h = hash_numbers(F.col(doc_id), seed)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), h[0].alias("h1"), h[1].alias("h2"), (h[2] % 100 < 100 - plain_per_cent).alias("shuffle"), (h[3] % 100 < spm_per_cent).alias("spm"))
    names = ["doc_id", "n", "form", "prefix_units", "middle_units", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for lo, hi in row_groups(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                flag = lambda k: np.asarray(part.column(k).to_numpy(zero_copy_only=False), bool)  # noqa: B023, E731
                n, form, prefix, middle, output = transformed(part.column(1), np.stack([part.column(2).to_numpy(), part.column(3).to_numpy()]), flag(4), flag(5), unit, raw)
                known = lambda x: pa.array(x, pa.int64(), mask=form == 0)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(np.array(FORMS, object)[form], pa.string()), known(prefix), known(middle), output], names=names)

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restore(fims: DataFrame, marks: tuple[str, str, str] = MARKS, form: str = "form", output: str = "output", restored: str = "restored") -> DataFrame:
    """fims with its texts rebuilt from form and output (null where one of them is)."""
    raw = tuple(m.encode() for m in marks)
    at = (fims.columns.index(form), fims.columns.index(output))
    kept = [f for f in fims.schema.fields if f.name != restored]
    columns = [fims.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for lo, hi in row_groups(batch.column(at[1])):
                part = batch.slice(lo, hi - lo)
                known = pc.and_(pc.is_valid(part.column(at[0])), pc.is_valid(part.column(at[1])))
                forms = np.array([FORMS.index(f) if f in FORMS else 0 for f in part.column(at[0]).to_pylist()])
                texts = untransformed(part.column(at[1]), np.where(part.column(at[1]).is_valid().to_numpy(zero_copy_only=False), forms, 0), raw)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pc.if_else(known, texts, None)], names=[*(f.name for f in kept), restored])

    schema = fims.select(*[F.col(f"`{f.name}`") for f in kept], F.lit("").alias(restored)).schema
    for f in schema.fields:
        f.nullable = True
    return fims.mapInArrow(run, schema)
