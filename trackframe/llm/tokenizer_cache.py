"""Whole-text encoding with a tokenizers file, by pieces that the tokenizer never merges across.

The texts of a group stand in one buffer, which numpy cuts into pieces and Arrow reduces to the distinct ones. Only
those are looked up, only new ones reach the tokenizer, and numpy writes out the ids of all pieces at once.
"""

from __future__ import annotations

import os
import re

import numpy as np

from trackframe.llm.common import TwoGenerations, distinct_pieces, sums_of, take_runs

_LOADED: dict = {}

#: White space as the tokenizers' patterns see it (Unicode White_Space), without space and line feed.
OTHER_SPACE = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes that no UTF-8 text holds: before a piece that stands for exactly itself; for a space and a line feed in one; an end id.
EXACT, SPACE, FEED, END = b"\xff", b"\xfe", b"\xfd", b" \xfc"
#: Pieces that are longer are not kept.
LONGEST_KEPT = 200


def loaded(kind, path: str, *args):
    """One encoder a worker process and file; its cache lives as long as the process."""
    key = (kind, path, *args)
    if key not in _LOADED:
        _LOADED[key] = kind(path, *args)
    return _LOADED[key]


class Encoder:
    """Ids of whole texts (UTF-8 bytes).

    Texts are cut where the tokenizer's own pre-tokenizer always cuts, and the ids of each distinct piece are
    kept; new pieces are encoded together, as one text. A piece begins with the space that it was cut at, or with
    the mark that follows a letter.
    `most` bounds the cache; special tokens' strings are ordinary text.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # pieces reach it once; its own cache only costs time
        self.cache = TwoGenerations(most)
        self.vocabulary = self.tokenizer.get_vocab()
        #: Ids as they are kept, two bytes each where the vocabulary allows it.
        self.kind = np.dtype("<u2" if max(self.vocabulary.values()) < 1 << 16 else "<u4")

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.kind) for e in found]

    def learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new pieces: many as one text, the others by themselves."""
        alone, kinds, out = [], {}, {}
        for p in pieces:
            kinds.setdefault(self.joins(p), []).append(p)
        for kind, own in kinds.items():
            for at in range(0, len(own), 1024):
                some = own[at : at + 1024]
                if kind:
                    (ids,) = self.ids([self.as_one(kind, some)])
                    begin, end = self.bounds(kind, ids)
                    if len(begin) == len(some):
                        raw, size = ids.tobytes(), self.kind.itemsize
                        out.update(zip(some, (raw[a:b] for a, b in zip((begin * size).tolist(), (end * size).tolist(), strict=True)), strict=True))
                        continue
                alone += some
        out.update(zip(alone, (i.tobytes() for i in self.ids(list(map(self.stands_for, alone)))), strict=True))
        self.cache.update(out if max(map(len, out), default=0) <= LONGEST_KEPT else {p: i for p, i in out.items() if len(p) <= LONGEST_KEPT})
        return out

    def look_up(self, texts: list[bytes], end_id: int | None):
        """(ids of each distinct piece, piece numbers in text order, pieces of each text)."""
        after = b"" if end_id is None else END
        pieces, index, counts = distinct_pieces([self.mark(t) + after for t in texts], marks=True)
        cache, old = self.cache, self.cache.old
        found, new = list(map(cache.get, pieces)), []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            p = pieces[i]
            if p == END:
                found[i] = np.array([end_id], self.kind).tobytes()
            elif (ids := old.get(p)) is not None:
                found[i] = cache[p] = ids
            else:
                new.append(i)
        learned = self.learn([pieces[i] for i in new])
        for i in new:
            found[i] = learned[pieces[i]]
        cache.turn()
        return found, index, counts

    def encode_many(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, one text behind the other; how many each text has), with an end id a text if one is given."""
        found, index, counts = self.look_up(texts, end_id)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        ids = take_runs(np.frombuffer(b"".join(found), self.kind), size, index)
        return ids, sums_of(size[index], counts)

    def count_many(self, texts: list[bytes]) -> np.ndarray:
        """How many ids each text has."""
        found, index, counts = self.look_up(texts, None)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        return sums_of(size[index], counts)


class ByteLevelEncoder(Encoder):
    """For byte-level BPE whose pattern gives a single space to the word after it.

    The tokenizer's white-space rule: a run of white space leaves its last character to what follows. So a single
    space or line feed, and two of them, may be cut before each; only longer runs, runs with other
    white space, and runs that end a text stand as exact pieces.
    """

    def __init__(self, path: str, most: int = 600_000):
        super().__init__(path, most)
        self.begins = np.zeros(max(self.vocabulary.values()) + 1, bool)
        # The byte-level letters of space and line feed.
        self.begins[[i for p, i in self.vocabulary.items() if p[0] in "ĠĊ"]] = True

    RUN = re.compile(f"[ \n{OTHER_SPACE}][ \n{OTHER_SPACE}]+")
    OTHER = re.compile(f"[{OTHER_SPACE}]")
    #: What other white space begins with in UTF-8, and white space that is doubled.
    DOUBLED = [b"  ", b"\n\n", b" \n", b"\n ", *(c.encode() for c in OTHER_SPACE if c < "\x80")]
    WIDE = sorted({c.encode()[:2] for c in OTHER_SPACE if c >= "\x80"})

    def mark(self, text: bytes) -> bytes:
        if any(map(text.__contains__, self.DOUBLED)) or not text.isascii() and any(map(text.__contains__, self.WIDE)):
            text = self.with_runs(text.decode())
        return b" " + EXACT + text.replace(b"\n", b" \n")

    def with_runs(self, text: str) -> bytes:
        """The text with its odd runs of white space as exact pieces."""
        out, at = [], 0
        for run in self.RUN.finditer(text):
            begin, end = run.span()
            if end - begin == 2 and end < len(text) and not self.OTHER.search(run[0]):
                continue
            out.append(text[at:begin].encode())
            stays, last = (run[0], "") if end == len(text) else (run[0][:-1], run[0][-1])
            out.append(b" " + EXACT + stays.encode().replace(b" ", SPACE).replace(b"\n", FEED))
            out.append((b"" if last in " \n" else b" " + EXACT) + last.encode())
            at = end
        out.append(text[at:].encode())
        return b"".join(out)

    def joins(self, piece: bytes) -> str:
        """How the piece may be encoded with others: 'begin' where its first id tells it from them, '' for alone."""
        return "begin" if piece[:1] == b" " and piece[1:2] != EXACT and len(piece) > 1 and piece != b" \n" else ""

    def stands_for(self, piece: bytes) -> bytes:
        if piece[:1] == b" " and piece[1:2] == EXACT:
            return piece[2:].replace(SPACE, b" ").replace(FEED, b"\n")
        return piece[1:] if piece[1:2] == b"\n" else piece

    def as_one(self, kind: str, pieces: list[bytes]) -> bytes:
        return b"".join(pieces).replace(b" \n", b"\n")

    def bounds(self, kind: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids begin and end: no id but a piece's first begins with a space or a line feed."""
        at = np.flatnonzero(self.begins[ids])
        return at, np.r_[at[1:], len(ids)]


class WordEncoder(Encoder):
    """For BPE that lower-cases and drops white space: any cut at a space or line feed is one of the tokenizer's own."""

    #: A word of its own that stands between pieces which are encoded as one text.
    BETWEEN = b"\x01"

    def __init__(self, path: str, most: int = 600_000):
        super().__init__(path, most)
        a, *between, b = self.ids([b"a " + self.BETWEEN + b" a"])[0].tolist()
        if a != b or len(between) != 1:
            raise ValueError("no one id for the mark between pieces")
        self.between = between[0]
        self.ends = np.zeros(max(self.vocabulary.values()) + 1, bool)
        self.ends[[i for p, i in self.vocabulary.items() if p.endswith("</w>")]] = True

    def mark(self, text: bytes) -> bytes:
        return b" " + text.lower().replace(b"\n", b" ")

    def joins(self, piece: bytes) -> str:
        """'end': a word of letters, whose last id ends it; 'mark': needs a mark behind it; '': alone."""
        if piece[:1] == b" " and piece[1:].decode().isalpha():
            return "end"
        return "" if self.BETWEEN in piece else "mark"

    def stands_for(self, piece: bytes) -> bytes:
        return piece

    def as_one(self, kind: str, pieces: list[bytes]) -> bytes:
        return b"".join(pieces) if kind == "end" else (b" " + self.BETWEEN + b" ").join([*pieces, b""])

    def bounds(self, kind: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if kind == "end":
            end = np.flatnonzero(self.ends[ids]) + 1
            return np.r_[0, end][: len(end)], end
        end = np.flatnonzero(ids == self.between)
        return np.r_[0, end + 1][: len(end)], end
