"""Byte-level BPE encoding and decoding with a lazily determinised finite-state transducer.

Encoding.  For a byte string x the BPE tokens of every prefix of x are known from left to right:
the last token t of a prefix is the only suffix for which (token before t, t) is a pair that the
merges would leave alone.  The transducer reads bytes; its state is (last emitted token, bytes read
since), and on those bytes the chain of last tokens is known.  Whatever boundary all continuations
share -- every chain that a future token could still start from runs through it -- is emitted, so
the lookahead is bounded by the longest token.  A state also holds its places in a trie of the
vocabulary, from which the tokens that end at the next byte are found.  States and transitions are
made when first met and kept in tables of bounded size.

Decoding.  Token bytes go through an incremental UTF-8 state machine, so a character split over
tokens comes out once its last byte has come.

Defined results: null and empty texts give no ids; texts of any length are streamed piece by piece;
lone surrogates cannot occur in Arrow strings.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import ChunkEncoder, groups
from .common import held, release

#: ids that are spelled out at once
RUN = 1 << 18
#: bytes of a worker's table of chunks; the transducer's tables take about as much
ROOM = 128 << 20


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a rank file (base64 token, rank)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, r in pairs:
        tokens[int(r)] = base64.b64decode(token)
    return tokens


class Edges:
    """Transitions of the transducer in flat arrays: an open-addressed table from state << 8 | byte to the
    state after it and the number of what is emitted on the way (0: nothing)."""

    def __init__(self, bits: int = 12):
        self.bits, self.n = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.to, self.out = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is missing."""
        at = self._place(keys)
        there = self.keys[at]
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & len(self.keys) - 1
            there[todo] = self.keys[at[todo]]
            todo = todo[(there[todo] != keys[todo]) & (there[todo] >= 0)]
        at[there < 0] = -1
        return at

    def add(self, keys: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        """New keys, each once."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys >= 0
            before = self.keys[old], self.to[old], self.out[old]
            self.__init__(max(self.bits + 1, int(4 * (self.n + len(keys))).bit_length()))
            self.add(*before)
        self.n += len(keys)
        at, todo = self._place(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = keys[free]  # of several that want a place one gets it
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & len(self.keys) - 1
        self.to[at], self.out[at] = to, out


class BpeTransducer:
    """The transducer of one vocabulary; see the module's text.  It emits ids as little-endian bytes, width
    to an id.  max_states bounds the tables (about 600 bytes a state).  When they are full, what is met
    later is made again whenever it is needed; after four times as many such states the tables start anew.
    """

    def __init__(self, tokens: list[bytes], max_states: int = 150_000):
        self.tokens = tokens
        self.ids = {b: i for i, b in enumerate(tokens) if b}
        self.sizes = [len(b) for b in tokens]
        self.width = 2 if len(tokens) <= 1 << 16 else 4
        self.codes = [i.to_bytes(self.width, "little") for i in range(len(tokens))]
        self.max_states = max_states
        #: the trie: node << 8 | byte -> node; the token spelled by each node (-1: none); nodes with children
        self._trie: dict[int, int] = {}
        self._spelled, self._inner = [-1], bytearray(1)
        for t, data in enumerate(tokens):
            node = 0
            for byte in data:
                to = self._trie.get(node << 8 | byte)
                if to is None:
                    to = self._trie[node << 8 | byte] = len(self._spelled)
                    self._spelled.append(-1)
                    self._inner.append(0)
                    self._inner[node] = 1
                node = to
            if node:
                self._spelled[node] = t
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, int] = {}
        self._reset()

    def _reset(self) -> None:
        #: by state: last emitted token, pending bytes, the last token at each of them, the boundaries on
        #: the way there (bit k: one after k pending bytes), and where a longer token may have begun, as
        #: place << 32 | node of the trie
        self._states: list[tuple[int, bytes, tuple[int, ...], tuple[int, ...], tuple[int, ...]]] = [(-1, b"", (), (), ())]
        self._state_ids: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self._edges, self._passing = Edges(), 0
        self._emitted: list[bytes] = [b""]
        self._emitted_ids: dict[bytes, int] = {b"": 0}

    def _shrink(self, state: int = 0) -> int:
        """Forgets the states beyond the bound, but this one; gives its new number."""
        at = self._states[state]
        for before, data, *_ in self._states[self.max_states :]:
            del self._state_ids[before, data]
        self._passing += len(self._states) - self.max_states
        del self._states[self.max_states :]
        if self._passing > 4 * self.max_states or len(self._emitted) > self.max_states:
            self._reset()
        if at[:2] in self._state_ids:
            return self._state_ids[at[:2]]
        self._states.append(at)
        state = self._state_ids[at[:2]] = len(self._states) - 1
        return state

    # -- which pairs the merges leave alone

    def parts(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t; None for a single byte."""
        if t not in self._parts:
            whole = [self.ids[bytes([b])] for b in self.tokens[t]]
            while len(whole) > 2:
                best, at = min((self.ids.get(self.tokens[x] + self.tokens[y], 1 << 60), k) for k, (x, y) in enumerate(zip(whole, whole[1:])))
                if best >= t:
                    raise ValueError(f"token {t} can't be reached by merges")
                whole[at : at + 2] = [best]
            self._parts[t] = (whole[0], whole[1]) if len(whole) == 2 else None
        return self._parts[t]

    def stays(self, a: int, b: int) -> int:
        """1 if BPE of the joined bytes is exactly (a, b), else -1.

        The merges are undone from the last one made on either side of the boundary; the pair fails
        if at any moment the tokens that then touch would have merged before that.
        """
        if len(self._pairs) > 2 * self.max_states:
            self._pairs.clear()
        known = self._pairs[a << 32 | b] = 1 if self._stays(a, b) else -1
        return known

    def _stays(self, a: int, b: int) -> bool:
        bound = 1 << 60  # a crossing merge with a rank below this one would have come first
        while True:
            if self.ids.get(self.tokens[a] + self.tokens[b], 1 << 60) < bound:
                made = self.parts(self.ids[self.tokens[a] + self.tokens[b]])
                if made == (a, b):
                    return False
            pa_, pb = self.parts(a), self.parts(b)
            if pa_ is None and pb is None:
                return True
            # of equal merges the left one comes first, so on a tie the right side is undone first
            if pb is None or (pa_ is not None and a > b):
                bound, a = a, pa_[1]
            else:
                bound, b = b + 1, pb[0]

    # -- the transducer

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        before, data, ends, cuts, live = self._states[state]
        n, known, trie, inner = len(data) + 1, self._pairs.get, self._trie.get, self._inner
        go, start, t, open_ = [], 0, -1, True
        for x in (*live, n - 1 << 32):  # from the longest token that may end here
            node = trie((x & 0xFFFFFFFF) << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                go.append(x >> 32 << 32 | node)
            if open_ and self._spelled[node] >= 0:
                start, t = x >> 32, self._spelled[node]
                left = ends[start - 1] if start else before
                open_ = not (left < 0 or (known(left << 32 | t) or self.stays(left, t)) > 0)
        data += bytes((byte,))
        ends += (t,)
        cuts += ((cuts[start - 1] if start else 0) | 1 << n,)
        # a later token can only start where the bytes since then begin some longer token
        shared = cuts[-1]
        for x in go:
            shared &= cuts[(x >> 32) - 1] if x >> 32 else 0
            if not shared:
                break
        out = 0
        if shared:
            at = cut = shared.bit_length() - 1
            ids = []
            while at > 0:
                ids.append(ends[at - 1])
                at -= self.sizes[ids[-1]]
            code = b"".join([self.codes[i] for i in reversed(ids)])
            out = self._emitted_ids.get(code)
            if out is None:
                out = self._emitted_ids[code] = len(self._emitted)
                self._emitted.append(code)
            data, ends, cuts, go = data[cut:], ends[cut:], tuple([c >> cut for c in cuts[cut:]]), [x - (cut << 32) for x in go]
            # the emitted token only matters while a token can start right behind it
            before = -2 if data and not (go and go[0] >> 32 == 0) else ids[0]
        key = (before, data)
        to = self._state_ids.get(key)
        if to is None:
            to = self._state_ids[key] = len(self._states)
            self._states.append((before, data, ends, cuts, tuple(go)))
        return to, out

    def transduce(self, data: bytes) -> Iterator[bytes]:
        """Ids of one piece of any length, emitted as its bytes come."""
        state, edge = 0, np.zeros(1, np.int64)
        for byte in data:
            edge[0] = state << 8 | byte
            at = self._edges.find(edge)[0]
            if at < 0:
                was, (state, out) = state, self._step(state, byte)
                if max(was, state) < self.max_states:
                    self._edges.add(edge, np.array([state]), np.array([out]))
            else:
                state, out = int(self._edges.to[at]), int(self._edges.out[at])
            if out:
                yield self._emitted[out]
            if len(self._states) > 2 * self.max_states:
                state = self._shrink(state)
        yield self._final(state)

    def _final(self, state: int) -> bytes:
        """The ids still pending when a piece ends in this state."""
        ends, rest = self._states[state][2], []
        at = len(ends)
        while at > 0:
            t = ends[at - 1]
            rest.append(self.codes[t])
            at -= self.sizes[t]
        return b"".join(rest[::-1])

    def encode_pieces(self, pieces: list[str], together: int = 1 << 15, longest: int = 64) -> list[bytes]:
        """All ids of each piece.  Pieces go through the transducer in step, some thousand at a time; long
        ones go alone."""
        data = [x.encode() for x in pieces]
        out: list[bytes] = [b""] * len(data)
        short = []
        for k, x in enumerate(data):
            if len(x) > longest:
                out[k] = b"".join(self.transduce(x))
            else:
                short.append(k)
        short.sort(key=lambda k: -len(data[k]))
        step = max(1, together // max(1, sum(len(data[k]) for k in short) // max(1, len(short))))
        for lo in range(0, len(short), step):
            part = short[lo : lo + step]
            for k, x in zip(part, self._together([data[k] for k in part])):
                out[k] = x
        return out

    def _together(self, data: list[bytes]) -> list[bytes]:
        """The ids of pieces that come longest first."""
        if len(self._states) > self.max_states:
            self._shrink()
        size = np.array([len(x) for x in data], np.int64)
        flat, begin = np.frombuffer(b"".join(data), np.uint8), np.cumsum(size) - size
        state, ids = np.zeros(len(data), np.int64), [b""] * len(data)
        for j in range(int(size[0]) if len(size) else 0):
            m = len(size) - int(np.searchsorted(size[::-1], j, "right"))  # pieces with more bytes than j
            edge = state[:m] << 8 | flat[begin[:m] + j]
            at = self._edges.find(edge)
            state[:m], emits = self._edges.to[at], self._edges.out[at]
            missing = np.flatnonzero(at < 0)
            if len(missing):
                new, which = np.unique(edge[missing], return_inverse=True)
                to, out = np.array([self._step(e >> 8, e & 255) for e in new.tolist()], np.int32).T
                state[missing], emits[missing] = to[which], out[which]
                keep = (new >> 8 < self.max_states) & (to < self.max_states)
                self._edges.add(new[keep], to[keep], out[keep])
            some = np.flatnonzero(emits)
            for k, e in zip(some.tolist(), emits[some].tolist()):
                ids[k] += self._emitted[e]
        last, which = np.unique(state, return_inverse=True)
        final = [self._final(x) for x in last.tolist()]
        return [x + final[k] for x, k in zip(ids, which.tolist())]


class TextEncoder(ChunkEncoder):
    """Ids of whole texts: each match of the pattern goes through the transducer by itself.  Chunks met
    before are remembered, their path through the states as one edge."""

    def __init__(self, fst: BpeTransducer, pattern: str, room: int = ROOM):
        import regex

        self.fst, self.split = fst, regex.compile(pattern)
        super().__init__(fst.encode_pieces(["\n"])[0], room)

    def fresh(self, chunks: list[str]) -> list[bytes]:
        words = [c for c in chunks if c.isalpha()]  # letters after a space are one piece
        rest = [c for c in chunks if not c.isalpha()]
        ids = dict(zip(words, self.fst.encode_pieces([" " + c for c in words])))
        ids.update(zip(rest, self.whole([c if c[0] == "\n" else " " + c for c in rest])))
        return [ids[c] for c in chunks]

    def whole(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split.findall(x) for x in texts]
        every = list(set().union(*pieces))
        ids = dict(zip(every, self.fst.encode_pieces(every)))
        return [b"".join([ids[y] for y in x]) for x in pieces]


def compiled(ranks_path: str, pattern: str, room: int = ROOM) -> TextEncoder:
    """The encoder of this Python worker, so that its states last from task to task."""
    key = ("bpe", ranks_path, pattern, room)
    release(key)
    return held(key, lambda: TextEncoder(BpeTransducer(load_ranks(ranks_path), max(1, room // 900)), pattern, room))


class Spelling:
    """What each id stands for, put together for many ids at once."""

    def __init__(self, words: list[bytes]):
        self.words = pa.array(words, pa.large_binary())

    def of(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all ids end to end, and where each begins (and the last one ends)."""
        if not len(ids):
            return memoryview(b""), np.zeros(1, np.int64)
        found = self.words.take(pa.array(ids))
        _, offsets, data = found.buffers()
        return memoryview(data), np.frombuffer(offsets, np.int64, len(ids) + 1, 8 * found.offset)


class Utf8Stream:
    """Incremental decoding of ids: feed() gives the characters completed so far."""

    def __init__(self, tokens: Spelling, errors: str = "replace"):
        self.tokens = tokens
        self.machine = codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids) -> str:
        return self.take(self.tokens.of(np.asarray(ids, np.int64))[0])

    def take(self, data: bytes | memoryview) -> str:
        """feed() for ids that have been spelled out already."""
        return self.machine.decode(data)

    def close(self) -> str:
        return self.machine.decode(b"", True)


class Digests:
    """sha256 of the decimal ids joined by spaces and of the decoded text, of many documents at once."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.decimal = Spelling(tokens), Spelling([b"%d " % i for i in range(len(tokens))])

    def of(self, ids: np.ndarray, ends: list[int]) -> Iterator[tuple[str, str]]:
        """For documents whose ids lie end to end, the last at each of ends."""
        begin, done = 0, 0
        while done < len(ends):
            # as many whole documents as a run holds, or a part of one at a time
            upto = done
            while upto < len(ends) and ends[upto] - begin <= RUN:
                upto += 1
            if upto == done:
                yield self._long(ids[begin : ends[done]])
                begin, done = ends[done], done + 1
                continue
            run = ids[begin : ends[upto - 1]]
            (spelled, at), (decimal, at10) = self.tokens.of(run), self.decimal.of(run)
            lo = 0
            for end in ends[done:upto]:
                hi = end - begin
                stream = Utf8Stream(self.tokens)
                text = stream.take(spelled[at[lo] : at[hi]]) + stream.close()
                yield hashlib.sha256(decimal[at10[lo] : max(at10[lo], at10[hi] - 1)]).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
                lo = hi
            begin, done = ends[upto - 1], upto

    def _long(self, ids: np.ndarray) -> tuple[str, str]:
        stream, numbers, text = Utf8Stream(self.tokens), hashlib.sha256(), hashlib.sha256()
        for at in range(0, len(ids), RUN):
            part = ids[at : at + RUN]
            decimal = self.decimal.of(part)[0]
            numbers.update(decimal if at + RUN < len(ids) else decimal[:-1])
            text.update(stream.feed(part).encode())
        text.update(stream.close().encode())
        return numbers.hexdigest(), text.hexdigest()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False, room: int = ROOM) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row; rows aren't combined, so
    repeated ids and rows stay as they are.  A null id stays null, a null text counts as empty.
    room bounds the bytes of the tables that a worker keeps: less is slower, with the same ids."""
    schema = f"{id_column} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = compiled(ranks_path, pattern, room)
        width, digests = encoder.fst.width, Digests(encoder.fst.tokens)
        for batch in batches:
            for at, texts in groups(batch.column(1), 256):
                coded = encoder.encode(texts)
                lengths = np.array([len(x) // width for x in coded], np.int64)
                ids = np.frombuffer(b"".join(coded), f"<u{width}").astype(np.int32)
                found = list(digests.of(ids, np.cumsum(lengths).tolist()))
                out = [batch.column(0).slice(at, len(texts)), pa.array(lengths), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(out, names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    return docs.selectExpr(f"cast(`{id_column}` as long) as `{id_column}`", f"`{text_column}` as text").mapInArrow(run, schema)
