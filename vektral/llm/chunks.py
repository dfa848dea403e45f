"""Cutting texts where the pre-tokenizer's pattern always cuts.

A single space or line feed between two other characters that aren't white space begins a new piece of
the pattern, whatever stands around it, and so do both of two line feeds and one at the end of the text.
What lies between two such places, a chunk, can be encoded by itself.  Texts with other white space at a
cut aren't cut here.  A chunk that begins a line has its line feed in front; others follow a space, which
isn't in the key.
"""

from __future__ import annotations

from string import punctuation as PUNCTUATION

#: bytes of an entry's key, value and place besides their lengths
ENTRY = 165


class NotCut(Exception):
    """The text has white space next to a space or line feed, or at an end."""


def cut(text: str) -> list[str]:
    """The chunks of a text that isn't empty, without a line feed at its end."""
    if "\n\n\n" in text or "\n\n " in text:
        raise NotCut
    return f"\n{text}".replace("\n", " \n")[1:].split(" ")


def proper(chunk: str) -> bool:
    """Whether no white space stands at an end, besides the line feed in front."""
    return chunk == "\n" or bool(chunk) and not chunk[chunk[0] == "\n"].isspace() and not chunk[-1].isspace()


def halves(chunk: str) -> tuple[str, str] | None:
    """Letters, and the punctuation after them as the chunk of a line's begin: pieces of their own."""
    word = chunk.rstrip(PUNCTUATION)
    return (word, "\n" + chunk[len(word) :]) if word != chunk and word[chunk[:1] == "\n" :].isalpha() else None


class ChunkEncoder:
    """Texts to ids by way of their chunks, many texts at once.

    fresh(chunks) gives the ids of chunks that aren't known, each with its line feed or space in front;
    whole(texts) those of texts that can't be cut.  Ids are bytes.  room bounds the bytes held between
    calls: a table that is half full becomes the older one, and what is met again moves to the newer.
    """

    def __init__(self, line_feed: bytes, room: int):
        self.line_feed, self.room = line_feed, room
        self.table: dict[str, bytes] = {"\n": line_feed}
        self.older: dict[str, bytes] = {}
        self.used = 0

    def fresh(self, chunks: list[str]) -> list[bytes]:
        raise NotImplementedError

    def whole(self, texts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _learn(self, new: set[str]) -> None:
        table, older = self.table, self.older
        two = {c: both for c in new if not c.isalpha() and (both := halves(c))}
        ask = []
        for c in new.difference(two).union(*two.values()) if two else new:
            if c not in table:
                value = older.get(c)
                if value is None:
                    ask.append(c)
                else:
                    table[c] = value
        table.update(zip(ask, self.fresh(ask)))
        for c, (word, marks) in two.items():
            table[c] = table[word] + table[marks][len(self.line_feed) :]
        self.used += ENTRY * len(new) + 2 * sum(map(len, new))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        parts: dict[int, tuple[list[str], bytes]] = {}
        for k, text in enumerate(texts):
            try:
                if text:
                    body, last = ended(text, self.line_feed)
                    parts[k] = cut(body), last
                else:
                    out[k] = b""
            except NotCut:
                pass
        new = set().union(*[x[0] for x in parts.values()]).difference(self.table)
        if bad := {c for c in new if not c.isalpha() and not proper(c)}:
            new -= bad
            parts = {k: x for k, x in parts.items() if bad.isdisjoint(x[0])}
        self._learn(new)
        begin, get = len(self.line_feed), self.table.__getitem__
        for k, (chunks, last) in parts.items():
            out[k] = b"".join([*map(get, chunks)])[begin:] + last
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self.whole([texts[k] for k in rest])):
            out[k] = x
        for c in new:
            if len(c) > 64:
                del self.table[c]
        if self.used > self.room // 2:
            self.older, self.table, self.used = self.table, {"\n": self.line_feed}, 0
        return out


def ended(text: str, line_feed: bytes) -> tuple[str, bytes]:
    """The text without the line feed at its end, and its ids."""
    if text[-1] != "\n":
        return text, b""
    if len(text) == 1 or text[-2].isspace():
        raise NotCut
    return text[:-1], line_feed


def groups(column, most: int = 256, length: int = 4_000_000):
    """Of an Arrow column of strings: where some hundred texts, or some million bytes of them, begin, and these."""
    lo, texts, size = 0, [], 0
    for k in range(len(column)):
        texts.append(column[k].as_py() or "")
        size += len(texts[-1])
        if len(texts) == most or size >= length or k == len(column) - 1:
            yield lo, texts
            lo, texts, size = k + 1, [], 0
