"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The texts' distinct pieces are held as flat numpy symbol arrays. A round finds the smallest pair rank
of every piece (a segmented minimum), merges its leftmost pairs in all pieces at once, and compacts the
arrays; a piece leaves once no pair of it is in the vocabulary. In long pieces all pairs merge that come
first within the reach of the longest piece of the vocabulary.
"""

from __future__ import annotations

import codecs
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from trackframe.llm.common import TwoGenerations, row_groups, text_bytes
from trackframe.llm.tokenizer_cache import loaded

SPACE = "▁"
NEVER = np.int64(1) << 40
codecs.register_error("one_byte", lambda e: ("�", e.start + 1))


class PieceModel:
    """A BPE model file with byte fallback; `most` bounds the cache of encoded pieces."""

    def __init__(self, path: str, most: int = 250_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback and no normalisation")
        if not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that put a space in front and keep all others")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal):
            raise ValueError("a piece crosses a word or line boundary")
        self.eos, self.unk = model.trainer_spec.eos_id, model.trainer_spec.unk_id
        self.byte_id = np.array([i for i, p in enumerate(model.pieces) if p.type == 6])
        score = {i: model.pieces[i].score for i in normal.values()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {i: order[s] for i, s in score.items()}
        self.char = {p: i for p, i in normal.items() if len(p) == 1}
        pairs, parent = {}, {}
        n = len(model.pieces)
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = normal.get(p[:k]), normal.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
                    parent[a], parent[b] = min(parent.get(a, NEVER), rank[i]), min(parent.get(b, NEVER), rank[i])
        #: No piece has more letters, so that what happens further off cannot reach a pair before it merges.
        self.reach = max(map(len, normal))
        self.n = n
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_id = np.array([pairs[k] for k in self.pair_key.tolist()], np.int64)
        self.pair_rank = np.array([rank[i] for i in self.pair_id.tolist()], np.int64)
        #: By rank: whether all that the merged piece can grow into comes later, so that all its pairs in a word may merge at once.
        self.safe = np.zeros(len(order), bool)
        for i, r in rank.items():
            self.safe[r] = parent.get(i, NEVER) > r
        self.safe &= np.bincount(list(rank.values()), minlength=len(order)) == 1
        self.surface = [b"" if p.type == 3 else " ⁇ ".encode() if p.type == 2 else bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.spaced = {i for p, i in normal.items() if p[0] == SPACE}
        self.decimal = [str(i) for i in range(n)]
        self.cache = TwoGenerations(most)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of merged pairs; NEVER where the vocabulary has none. Ids below 0 are unknown characters."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_rank[at], NEVER), self.pair_id[at]

    def nearby(self, values: np.ndarray) -> np.ndarray:
        """The least value within `reach` places of each."""
        edge = np.full(self.reach, values.max())
        low, size, width = np.concatenate([edge, values, edge]), 1, 2 * self.reach + 1
        while size < width:
            step = min(size, width - size)
            low = np.minimum(low[: len(low) - step], low[step:])
            size += step
        return low

    def foremost(self, rank: np.ndarray) -> np.ndarray:
        """Places whose pair has no better one within `reach` symbols; of equal ones the leftmost.

        Until such a pair merges, only a symbol grown from beyond could take one of its symbols; it would have to take
        all between first, and be longer than any piece. So all these may merge at once, and where nothing that a merged
        piece grows into comes before it, so may all equal pairs (of a run that overlaps, every second one from its start).
        """
        n = len(rank)
        place = np.arange(n)
        best = (rank == self.nearby(rank)) & (rank < NEVER)
        start = np.maximum.accumulate(np.where(np.r_[True, rank[1:] != rank[:-1]], place, 0))
        safe = best & self.safe[np.where(best, rank, 0)]
        chosen = safe & best[start] & ((place - start) % 2 == 0)
        if (other := best & ~safe).any():
            order = np.minimum(rank, np.int64(1) << 21) << 40 | place
            chosen |= other & (order == self.nearby(order))
        return np.flatnonzero(chosen)

    #: Symbols above which a piece merges more pairs a round than those of its least rank.
    LONG = 64

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece; every piece is encoded alone."""
        out: list = [None] * len(pieces)
        text = "".join(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        points, inverse = np.unique(code, return_inverse=True)
        known = np.array([self.char.get(chr(c), -1 - c) for c in points.tolist()], np.int64)
        sym = known[inverse] if len(code) else code
        word = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(sym), NEVER)
        into = np.zeros(len(sym), np.int64)

        def rate(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at < len(sym) - 1)]
            at = at[word[at] == word[at + 1]]
            rank[at], into[at] = self.look(sym[at], sym[at + 1])

        rate(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(sym)])
            if (ended := low == NEVER).any():
                gone = np.repeat(ended, lengths)
                done, owners = sym[gone], word[starts[ended]]
                for w, ids in zip(owners.tolist(), np.split(done, np.cumsum(lengths[ended])[:-1]), strict=True):
                    out[w] = ids
                sym, word, rank, into = (x[~gone] for x in (sym, word, rank, into))
                low, lengths = low[~ended], lengths[~ended]
                if not len(sym):
                    break
                starts = np.r_[0, np.cumsum(lengths)[:-1]]
            owner = np.repeat(np.arange(len(low)), lengths)
            long = lengths > self.LONG
            best = rank == np.where(long, -1, low)[owner]
            at = np.flatnonzero(best)
            owner = owner[at]
            first = np.r_[True, owner[1:] != owner[:-1]]
            run = np.r_[True, (np.diff(at) != 1) | first[1:]]  # of overlapping pairs, every second one merges
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[first | (self.safe[low[owner]] & (place % 2 == 0))]
            if long.any():
                own = np.flatnonzero(np.repeat(long, lengths))
                at = np.sort(np.r_[at, own[self.foremost(rank[own])]])
            sym[at] = into[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            rank[at] = NEVER
            sym, word, rank, into = (x[stay] for x in (sym, word, rank, into))
            at = moved[at]
            before = at[at > 0] - 1
            rank[before[word[before] == word[before + 1]]] = NEVER
            rate(np.unique(np.r_[at, before]))
        for w, ids in enumerate(out):
            if ids is None:
                out[w] = np.zeros(0, np.int64)
            elif len(ids) and ids.min() < 0:
                out[w] = np.concatenate([[i] if i >= 0 else self.byte_id[list(chr(-1 - i).encode())] for i in ids.tolist()])
        return out

    #: A piece: the spaces before a word and the word up to the next space or line feed.
    RUNS = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")

    def cut(self, text: str) -> list[str]:
        """Pieces that no merge crosses; those without a line feed in front stand with a space before them."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " ":
            return ["\n" + p for p in self.RUNS.findall(SPACE + text.replace(" ", SPACE))]
        return text.replace("\n", " \n\n").split(" ")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Per text, its ids as little-endian unsigned 16-bit bytes (32-bit if the vocabulary needs it), end id excluded."""
        cut = [self.cut(t) for t in texts]
        cache, kind = self.cache, "<u2" if self.n <= 1 << 16 else "<u4"
        new = [p for p in set().union(*cut) if p not in cache]
        fresh = []
        for p in new:
            if (ids := cache.old.get(p)) is None:
                fresh.append(p)
            else:
                cache[p] = ids
        # A piece that begins with a line feed mark stands for what follows the mark.
        for p, ids in zip(fresh, self.encode_pieces([p[1:] if p[:1] == "\n" else SPACE + p for p in fresh]), strict=True):
            cache[p] = ids.astype(kind).tobytes()
        out = [b"".join(map(cache.__getitem__, c)) for c in cut]
        cache.turn()
        return out

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD one by one."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "one_byte")
        first = next((i for i in ids if self.surface[i]), self.unk)  # a word's space in front of all is dropped
        return text[1:] if first in self.spaced else text


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs, the ids with an end id.

    Every row gives one row: null texts are empty, null ids stay null, repeated rows repeat, other
    columns are ignored, an empty table gives none. A long text needs memory in proportion to itself.
    """

    def run(batches):
        import pyarrow as pa

        model = loaded(PieceModel, path)
        kind = "<u2" if model.n <= 1 << 16 else "<u4"
        for rows in row_groups(batches, 2_000_000, lambda r: len(r[1])):
            out = []
            for (doc, _), raw in zip(rows, model.encode_batch([r[1].decode() for r in rows]), strict=True):
                ids = [*np.frombuffer(raw, kind).tolist(), model.eos]
                out.append((doc, len(ids), hashlib.sha256(" ".join(map(model.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_bytes(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
