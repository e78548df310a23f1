"""Best-fit packing by length patterns that non-negative least squares fits to the histogram.

A piece is a whole document, or `window` ids of a longer one. What decides about packing is how many pieces have each
length, a histogram of at most `window` rows, whatever the corpus' size. On the driver:

1. Lengths fall into bins of equal width. All patterns of at most a few pieces whose bins fill a window are enumerated.
2. Non-negative least squares fits how often each pattern is used to the histogram, long pieces weighing more; the counts
   are rounded and held to what is there.
3. Each pattern takes its pieces, the longest of each bin first. What rounding and bins leave over, the residuals, goes
   from long to short where it fits best: into the gaps of those sequences or of new ones.

The plan counts sequences that look alike instead of naming pieces. Spark then numbers the pieces of every length, by
counts for each task and length and their running sums, and a number says which sequence and place a piece has.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import materialize, row_groups, text_bytes
from trackframe.llm.tokenizer_cache import WordEncoder, loaded

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bins of lengths; pieces of a pattern at most; words whose ids a task keeps (twice as many at most).
BINS, MOST, CACHED = 64, 3, 250_000


def patterns(total: int, most: int) -> list[tuple[int, ...]]:
    """All ways to write `total` as a sum of 2 to `most` descending parts."""

    def split(rest: int, parts: int, top: int):
        if parts == 1:
            if rest <= top:
                yield (rest,)
            return
        for first in range(min(top, rest - parts + 1), -(-rest // parts) - 1, -1):
            for more in split(rest - first, parts - 1, first):
                yield (first, *more)

    return [p for n in range(2, most + 1) for p in split(total, n, total)]


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a @ x - b|, by an active set: columns join while their gradient is positive."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    near = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        slope = np.where(active, -np.inf, a.T @ (b - a @ x))
        if slope.max() <= near:
            break
        active[int(slope.argmax())] = True
        while True:
            at = np.flatnonzero(active)
            best = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (best > 0).all():
                x[:] = 0
                x[at] = best
                break
            down = best <= 0
            step = (x[at][down] / np.maximum(x[at][down] - best[down], 1e-300)).min()
            x[at] += step * (best - x[at])
            active[at[x[at] <= 1e-12 * max(1.0, x.max())]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def fitted(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of the bins' upper ends, repeats) of the patterns that are used; no bin gives more pieces than it has."""
    width = -(-window // BINS)
    bins = window // width
    have = np.zeros(bins + 1, np.int64)
    for length, n in histogram.items():
        have[min(-(-length // width), bins)] += n if length <= bins * width else 0
    # Patterns of bins that hold no piece can't be used.
    ways = [p for p in patterns(bins, MOST) if have[list(p)].all()]
    if not ways:
        return []
    use = np.zeros((bins + 1, len(ways)))
    for k, p in enumerate(ways):
        np.add.at(use[:, k], list(p), 1)
    weight = np.arange(bins + 1) / bins
    counts = least_squares(use * weight[:, None], have * weight)
    out = []
    for k in np.argsort(-counts, kind="stable").tolist():
        n = int(min([round(counts[k]), *(have[b] // use[b, k] for b in set(ways[k]))]))
        if n > 0:
            have -= (n * use[:, k]).astype(np.int64)
            out.append((tuple(b * width for b in ways[k]), n))
    return out


class Plan:
    """Sequences that look alike, counted: `alike` has (gap, repeats, [(length, times), ...])."""

    def __init__(self, histogram: dict[int, int], window: int):
        self.window, self.left = window, {k: n for k, n in histogram.items() if n}
        self.by_gap: dict[int, list[list]] = defaultdict(list)
        self.gaps: list[int] = []
        self.done: list[tuple[int, list]] = []
        self._patterns()
        self._residuals()
        self.alike = [*self.done, *((n, what) for gap in self.gaps for n, what in self.by_gap[gap])]

    def _put(self, gap: int, n: int, what: list) -> None:
        if not n:
            return
        if not gap:
            self.done.append((n, what))
            return
        if not self.by_gap[gap]:
            insort(self.gaps, gap)
        self.by_gap[gap].append([n, what])

    def _patterns(self) -> None:
        lengths = sorted(self.left)

        def longest(most: int, used: list[int]) -> int:
            """Of the lengths that are left, the longest up to `most`; 0 for none."""
            while (at := bisect_right(lengths, most)) and self.left[lengths[at - 1]] <= used.count(lengths[at - 1]):
                if used.count(most := lengths[at - 1]):
                    most -= 1
                else:
                    lengths.pop(at - 1)
            return lengths[at - 1] if at else 0

        for ends, n in fitted(self.left, self.window):
            while n:
                used: list[int] = []
                for end in ends[:-1]:
                    used += [x] if (x := longest(end, used)) else []
                while len(used) < len(ends) and (x := longest(self.window - sum(used), used)):  # exact lengths tell what the bins leave
                    used.append(x)
                if not used:
                    return
                times = min([n, *(self.left[x] // used.count(x) for x in set(used))])
                for x in used:
                    self.left[x] -= times
                self._put(self.window - sum(used), times, [(x, used.count(x)) for x in sorted(set(used), reverse=True)])
                n -= times

    def _residuals(self) -> None:
        for length in sorted((k for k, n in self.left.items() if n), reverse=True):
            n = self.left[length]
            while n:
                at = bisect_left(self.gaps, length)
                if at == len(self.gaps):  # new sequences, each filled with this length
                    fill = min(n, self.window // length)
                    self._put(self.window - fill * length, n // fill, [(length, fill)])
                    n %= fill
                    continue
                gap = self.gaps[at]
                own = self.by_gap[gap]
                repeats, what = own.pop()
                if not own:
                    self.gaps.pop(at)
                fill = min(n, gap // length)
                used = min(repeats, n // fill)
                self._put(gap, repeats - used, what)
                self._put(gap - fill * length, used, [*what, (length, fill)])
                n -= used * fill

    def intervals(self) -> np.ndarray:
        """Rows (length, first, times, sequence, offset) by length and first: of the pieces of a length, in any order,
        those from number `first` on lie in sequence + (number - first) // times, `times` in each, from `offset` on."""
        taken, out, sequence = defaultdict(int), [], 0
        for n, what in self.alike:
            offset = 0
            for length, times in what:
                out.append((length, taken[length], times, sequence, offset))
                taken[length] += n * times
                offset += length * times
            sequence += n
        rows = np.array(out, np.int64).reshape(-1, 5)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def cut(docs: DataFrame, path: str, window: int, end_id: int, keep_ids: bool) -> DataFrame:
    """The pieces of every row of docs, with the task that made them (`part`) and their number among its pieces of that length."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, seen = loaded(WordEncoder, path, CACHED), TaskContext.get().partitionId(), [0] * (window + 1)
        for rows in row_groups(batches, 4_000_000, lambda r: len(r[1])):
            every, sizes = enc.encode_many([t for _, t in rows], end_id)
            raw, begin, out, ids = memoryview(every.astype("<u4").tobytes()), 0, [], []
            for (doc, _), total in zip(rows, sizes.tolist(), strict=True):
                for piece, (a, b) in enumerate(pairwise([*range(0, total, window), total])):
                    own = raw[4 * (begin + a) : 4 * (begin + b)]
                    out.append((doc, piece, a, b - a, zlib.crc32(own), seen[b - a]))
                    seen[b - a] += 1
                    if keep_ids:
                        ids.append(bytes(own))
                begin += total
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(out), pa.int32()), *[pa.array(ids, pa.binary())] * keep_ids], [*NAMES, "n_before", "part", *["ids"] * keep_ids])

    return text_bytes(docs).mapInArrow(run, f"{PIECE}, n_before long, part int" + ", ids binary" * keep_ids)


NAMES = [c.split()[0] for c in PIECE.split(", ")]


def pack(docs: DataFrame, path: str, window: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pack every row of docs into few sequences of at most `window` ids: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and the piece's `ids` (little-endian unsigned 32-bit) if asked for.

    A document is its whole text's ids (null: none) and end_id, so empty ones have one id. Only documents of more than
    `window` ids are cut, into pieces of `window` ids and a last one. Repeated rows and null doc_ids are
    packed like any other; an empty table gives none; other columns are ignored. sequence_id counts from 0 without gaps. One
    text is held at a time, whatever its length; the driver holds at most `window` counts; the plan that goes to the tasks has
    a row for each length in each kind of sequence, which depends on the lengths that occur, not on the number of documents.
    """
    pieces = materialize(cut(docs, path, window, end_id, keep_ids), "pieces")
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())
    plan = Plan(histogram, window).intervals()
    held = pieces.sparkSession.sparkContext.broadcast(plan)

    def place(batches):
        import pyarrow as pa

        length, first, times, sequence, offset = held.value.T
        key = length << 45 | first
        for b in batches:
            own = b.column(NAMES.index("length")).to_numpy()
            number = b.column(b.num_columns - 1).to_numpy()
            at = np.searchsorted(key, own << 45 | number, "right") - 1
            far = number - first[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence[at] + far // times[at]), pa.array(offset[at] + far % times[at] * own)], [*b.schema.names[:-1], "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    extra = ["ids"] * keep_ids
    numbered = pieces.join(firsts.hint("merge"), ["length", "part"]).select(*NAMES, *extra, (F.col("first") + F.col("n_before")).alias("number"))
    return numbered.mapInArrow(place, PIECE + ", ids binary" * keep_ids + ", sequence_id long, offset long").select(*NAMES, "sequence_id", "offset", *extra)
