"""Substring dedup with repeated-phrase automata.

A window is `window` consecutive words of one document.  A word goes if a window over it is also
found in a document with a smaller doc_id.

1  Confirm recurring passages.  The documents are dealt into blocks by a hash of the row.  A block
   hashes all its windows and sends, bucket by bucket, each distinct hash once with the least doc_id
   that holds it, packed.  A bucket finds the hashes that several blocks hold, and asks the block with
   the least doc_id of each, the holder, to send that phrase to the others.
2  Send phrases.  The holder sends their words: windows that follow each other in a document go to a
   block as one passage, once, with the holder's doc_id.
3  Compile.  A block's passages are those it was sent and those that several of its own documents
   share.  Each phrase in them, whole, is a pattern of an Aho-Corasick automaton.  Automata are sharded: by
   block, each with the phrases that may occur there and no others, and within it so that none holds
   more than `per_machine` phrases.
4  Locate.  All documents of the block stream through each of its automata, one automaton at a time.
   A hit is an occurrence of a phrase, word by word: hits alone say where phrases stand, and what they
   cover goes if the holder's doc_id is smaller.

The texts move once (all steps read one exchange), the hashes once at some 8 to 12 bytes a distinct
window of a block, recurring words once for each other block that holds them; no step holds more than a
block or a bucket, whose numbers grow with the table.

Defined results: null, empty and short texts have no window and stay whole; rows that repeat a doc_id
are equal in rank, so they don't remove each other's words; null doc_ids rank last; a text of any length
is taken whole and must fit a task; an empty table gives an empty one.  Phrases are confirmed by 64-bit
hashes, and words go only where an automaton finds them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import encoded, hash_words, sequences

_LAST = (1 << 63) - 1


class Block:
    """The documents of one block: words end to end, and the windows that lie inside a document."""

    def __init__(self, doc_ids: list[int | None], texts: list[str | None], window: int):
        ids = np.array([_LAST if d is None else d for d in doc_ids], np.int64)
        self.window, self.order = window, np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.raws = encoded([texts[k] for k in self.order], False)
        self.hashed, self.count = hash_words(self.raws)
        self.begin = np.concatenate(([0], np.cumsum(self.count)))
        self.doc = np.repeat(np.arange(len(ids)), self.count)
        every = sequences(self.hashed, window)
        self.at = np.flatnonzero(self.doc[: len(every)] == self.doc[window - 1 :][: len(every)])
        self.windows = every[self.at]
        # distinct hashes in order; documents stand in the order of their ids, so the first place has the least
        self.distinct, first, self.back = np.unique(self.windows, return_index=True, return_inverse=True)
        self.first = self.at[first]
        self.least = self.ids[self.doc[self.first]]
        self._words: dict[int, list[bytes]] = {}

    def passages(self, places: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The documents' ids and words of the windows that begin at these places, windows that follow each
        other as one."""
        places = np.sort(places)
        new = np.flatnonzero(np.r_[True, places[1:] != places[:-1] + 1][: len(places)])
        starts, ends = places[new], np.r_[places[new[1:] - 1], places[-1:]] + self.window
        docs = self.doc[starts]
        out = []
        for d, lo, hi in zip(docs.tolist(), (starts - self.begin[docs]).tolist(), (ends - self.begin[docs]).tolist()):
            if d not in self._words:
                self._words[d] = self.raws[d].split()
            out.append(b" ".join(self._words[d][lo:hi]))
        return self.ids[docs], out


def _cuts(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets begin in sorted hashes: a bucket is an equal range of all 64-bit values."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(values, edges), len(values))


def _pack(values: np.ndarray, ids: np.ndarray) -> bytes:
    """Sorted hashes, as their low 48 bits and the numbers of values under each high 16 bits met, and the id
    of each, as its place among the distinct ids and the steps between these."""
    high, times = np.unique((values >> np.uint64(48)).astype(np.uint16), return_counts=True)
    low = values.view(np.uint8).reshape(-1, 8)[:, :6]
    names, which = np.unique(ids, return_inverse=True)
    steps = (names[1:].view(np.uint64) - names[:-1].view(np.uint64)) if len(names) > 1 else np.zeros(0, np.uint64)
    size = next(w for w in (1, 2, 4, 8) if not len(steps) or int(steps.max()) >> (8 * w) == 0)
    head = np.array([len(values), len(high), len(names), size], np.uint32)
    which = which.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32)
    return b"".join([head.tobytes(), names[:1].tobytes(), high.tobytes(), times.astype(np.uint32).tobytes(), steps.astype(f"<u{size}").tobytes(), which.tobytes(), low.tobytes()])


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, k, m, size = np.frombuffer(data, np.uint32, 4).tolist()
    at = 16

    def take(kind, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    first = take(np.int64, 1)
    high = np.repeat(take(np.uint16, k), take(np.uint32, k))
    names = np.concatenate((first.view(np.uint64), take(f"<u{size}", m - 1).astype(np.uint64))).cumsum(dtype=np.uint64).view(np.int64)
    which = take(np.uint16 if m <= 1 << 16 else np.uint32, n)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = take(np.uint8, 6 * n).reshape(n, 6)
    return wide.view(np.uint64)[:, 0] | high.astype(np.uint64) << np.uint64(48), names[which]


def _send(window: int, buckets: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        b = Block(group["doc_id"].to_pylist(), group["text"].to_pylist(), window)
        cut = _cuts(b.distinct, buckets)
        rows = [(k, _pack(b.distinct[lo:hi], b.least[lo:hi])) for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if hi > lo]
        n = len(rows)
        return pa.table({"block": pa.array([key[0].as_py()] * n, pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})

    return run


_ASKED = np.dtype([("value", "<u8"), ("to", "<i4")])


def _ask(key: tuple, group: pa.Table) -> pa.Table:
    """For each block of a bucket the hashes that it shall send, and to which blocks: it holds them in the
    least document of all, and the other block in larger ones only."""
    values, least, blocks = [], [], []
    for block, data in zip(group["block"].to_pylist(), group["data"]):
        v, d = _unpack(data.as_py())
        values.append(v)
        least.append(d)
        blocks.append(np.full(len(v), block, np.int32))
    value, doc, block = np.concatenate(values), np.concatenate(least), np.concatenate(blocks)
    order = np.lexsort((block, doc, value))
    value, doc, block = value[order], doc[order], block[order]
    group_of = np.cumsum(np.concatenate(([True], value[1:] != value[:-1]))) - 1
    holder = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))[group_of]
    wants = np.flatnonzero(doc[holder] < doc)
    by = block[holder[wants]]
    order = np.argsort(by, kind="stable")
    wants, by = wants[order], by[order]
    asked = np.empty(len(wants), _ASKED)
    asked["value"], asked["to"] = value[wants], block[wants]
    names, starts = np.unique(by, return_index=True)
    ends = [*starts[1:].tolist(), len(by)]
    return pa.table({"block": pa.array(names, pa.int32()), "data": pa.array([asked[lo:hi].tobytes() for lo, hi in zip(starts.tolist(), ends)], pa.binary())})


def _passages(window: int):
    """The words of the phrases asked for: a row for each block they go to."""

    def run(key: tuple, docs: pa.Table, asked: pa.Table) -> pa.Table:
        rows = []
        if asked.num_rows and docs.num_rows:
            b = Block(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), window)
            wanted = np.frombuffer(b"".join(x.as_py() for x in asked["data"]), _ASKED)
            wanted = wanted[np.argsort(wanted["to"], kind="stable")]
            names, starts = np.unique(wanted["to"], return_index=True)
            for to, lo, hi in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(wanted)]):
                ids, words = b.passages(b.first[np.searchsorted(b.distinct, wanted["value"][lo:hi])])
                rows.append((to, ids.tobytes(), b"\n".join(words)))
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "ids": pa.array([r[1] for r in rows], pa.binary()), "words": pa.array([r[2] for r in rows], pa.large_binary()).cast(pa.binary())})

    return run


class Phrases:
    """The phrases of passages, each once, with its least holder."""

    def __init__(self, holders: np.ndarray, passages: list[bytes], window: int, per_machine: int):
        self.window, self.per_machine = window, per_machine
        self.numbers: dict[bytes, int] = {}  # of the words, from 1
        number = self.numbers.setdefault
        self.ids = np.array([number(w, len(self.numbers) + 1) for x in passages for w in x.split(b" ")], np.int32)
        hashed, count = hash_words(passages)
        of = np.repeat(np.arange(len(passages)), count)
        every = sequences(hashed, window)
        at = np.flatnonzero(of[: len(every)] == of[window - 1 :][: len(every)])
        order = np.lexsort((holders[of[at]], every[at]))
        new = np.concatenate(([True], every[at][order][1:] != every[at][order][:-1]))
        self.at = np.sort(at[order][new])
        self.holder = holders[of[self.at]]
        # a word is two letters, the first of them marked: nodes have few children, and matches begin at words
        self.base = max(16, math.isqrt(len(self.numbers)) + 1)

    def letters(self, ids: np.ndarray) -> str:
        """Two letters a word, below the surrogates."""
        if 2 * self.base + 1 >= 0xD800:
            raise ValueError("a block has too many distinct words")
        pairs = np.empty((len(ids), 2), "<u2")
        pairs[:, 0], pairs[:, 1] = self.base + 1 + ids // self.base, 1 + ids % self.base
        return pairs.tobytes().decode("utf-16-le")

    def machines(self) -> Iterator[ahocorasick.Automaton]:
        """Automata over all phrases, one at a time; a pattern's value is its place among the phrases."""
        text, wide = self.letters(self.ids), 2 * self.window
        for lo in range(0, len(self.at), self.per_machine):
            machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, place in enumerate(self.at[lo : lo + self.per_machine].tolist(), lo):
                machine.add_word(text[2 * place : 2 * place + wide], k)
            machine.make_automaton()
            yield machine

    def locate(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Where in b's words phrases begin, and the phrases' holders."""
        known = self.numbers.get
        ids = np.array([known(w, 0) for raw in b.raws for w in raw.split()], np.int32)
        place = np.arange(len(ids)) + b.doc  # 0, no word of a phrase, stands between documents
        stream = np.zeros(len(ids) + len(b.count), np.int32)
        stream[place] = ids
        origin = np.full(len(stream), -1, np.int64)
        origin[place] = np.arange(len(ids))
        # runs of words of phrases; in shorter ones none has room
        edge = np.flatnonzero(np.diff(np.concatenate(([0], stream > 0, [0]))))
        lo, hi = edge[0::2], edge[1::2]
        long = hi - lo >= self.window
        lo, hi = lo[long], hi[long]
        text = self.letters(stream)
        starts, found = [], []
        for machine in self.machines():
            for at, to in zip(lo.tolist(), hi.tolist()):
                hits = np.array(list(machine.iter(text[2 * at : 2 * to])), np.int64).reshape(-1, 2)
                starts.append(at + (hits[:, 0] + 1) // 2 - self.window)
                found.append(hits[:, 1])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return origin[np.concatenate(starts)], self.holder[np.concatenate(found)]


def _locate(window: int, per_machine: int):
    def run(key: tuple, docs: pa.Table, sent: pa.Table) -> pa.Table:
        b = Block(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), window)
        covered = np.zeros(len(b.hashed) + 1, np.int64)
        holders, passages = [], []
        for ids, words in zip(sent["ids"], sent["words"]):
            holders.append(np.frombuffer(ids.as_py(), np.int64))
            passages += words.as_py().split(b"\n")
        if len(b.windows):
            several = np.zeros(len(b.distinct), bool)
            several[b.back[b.ids[b.doc[b.at]] != b.least[b.back]]] = True
            if several.any():
                ids, words = b.passages(b.first[several])
                holders.append(ids)
                passages += words
        if passages:
            at, holder = Phrases(np.concatenate(holders), passages, window, per_machine).locate(b)
            gone = at[holder < b.ids[b.doc[at]]]
            covered += np.bincount(gone, minlength=len(covered)) - np.bincount(gone + window, minlength=len(covered))
        keep = np.cumsum(covered)[:-1] == 0
        n_words, n_removed, kept = [], [], []
        left = np.concatenate(([0], np.cumsum(keep)))
        for k, raw in enumerate(b.raws):
            lo, hi = b.begin[k], b.begin[k + 1]
            n, stay = int(hi - lo), int(left[hi] - left[lo])
            n_words.append(n)
            n_removed.append(n - stay)
            kept.append(b" ".join(raw.split() if stay == n else compress(raw.split(), keep[lo:hi].tolist())) if stay else b"")
        back = pa.array(np.argsort(b.order))
        out = pa.table({"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array([x.decode() for x in kept], pa.string())}).take(back)
        return pa.table({"doc_id": docs["doc_id"].combine_chunks(), **{c: out[c].combine_chunks() for c in out.column_names}})

    return run


def _digested(locate):
    def run(key: tuple, docs: pa.Table, sent: pa.Table) -> pa.Table:
        out = locate(key, docs, sent)
        digest = [hashlib.sha256(x.as_py().encode()).hexdigest() for x in out["kept"]]
        return pa.table({"doc_id": out["doc_id"], "n_words": out["n_words"], "n_removed": out["n_removed"], "kept_sha256": pa.array(digest, pa.string())})

    return run


def remove_repeated_passages(docs: DataFrame, window: int = 13, per_machine: int = 250_000, docs_per_block: int = 2000, bytes_per_block: int = 8_000_000, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by a space) of every row of docs;
    with digest the sha256 of kept instead of it, so that no text leaves the task.

    There are as many blocks as the number or the length of the documents asks for, so that a block of
    long texts is no larger than one of short ones."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    n, length = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // docs_per_block), -(-length // bytes_per_block))
    buckets = max(1, -(-blocks // 4))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    hashes = rows.groupBy("block").applyInArrow(_send(window, buckets), "block int, bucket int, data binary")
    asked = hashes.groupBy("bucket").applyInArrow(_ask, "block int, data binary")
    sent = rows.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_passages(window), "block int, ids binary, words binary")
    locate = _locate(window, per_machine)
    pairs = rows.groupBy("block").cogroup(sent.groupBy("block"))
    if digest:
        return pairs.applyInArrow(_digested(locate), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return pairs.applyInArrow(locate, "doc_id long, n_words long, n_removed long, kept string")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, hash(array_to_string(ws[i:i+12], ' ')) AS h, md5(array_to_string(ws[i:i+12], ' ')) AS m FROM i),
f AS (SELECT h, m, min(doc_id) AS least FROM k GROUP BY h, m HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT DISTINCT k.doc_id, k.i + o.o AS p FROM k JOIN f ON k.h = f.h AND k.m = f.m AND f.least < k.doc_id, (SELECT unnest(range(0, 13)) AS o) o),
r AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id),
o AS (SELECT w.doc_id, len(ws) AS n, CASE WHEN ps IS NULL THEN ws ELSE [ws[j] FOR j IN range(1, len(ws) + 1) IF NOT list_contains(ps, j)] END AS kept
      FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM o
"""
