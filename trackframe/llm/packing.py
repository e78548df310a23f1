"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's full windows leave at once; its rest
goes where it fits best; when it fits nowhere, the fullest window leaves. The windows still open at a
partition's end are merged in a second, small step, where ids are cut freely.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import materialize, row_groups, text_bytes
from trackframe.llm.tokenizer_cache import WordEncoder, loaded

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = [c.split()[0] for c in PIECE.split(", ")]
#: Partitions whose open windows are merged in one task.
MERGED = 4


def sizes_of(rest: int, window: int) -> list[int]:
    """Sequence sizes for the last `rest` ids: whole windows, then powers of two, which need no padding."""
    return [window] * (rest // window) + [1 << b for b in range(window.bit_length(), -1, -1) if (rest % window) >> b & 1]


class OpenWindows:
    """At most `most` windows of pieces (doc, start, doc_tokens, ids); yields those that leave."""

    def __init__(self, window: int, most: int):
        self.window, self.most, self.by_room, self.pieces, self.n = window, most, [], {}, 0

    def add(self, doc, start: int, total: int, ids: bytes):
        size = len(ids) // 4
        at = bisect_left(self.by_room, (size, -1))  # the least room that takes it
        if at == len(self.by_room):
            if len(self.by_room) == self.most:
                yield self.pieces.pop(self.by_room.pop(0)[1])
            self.n += 1
            room, name = self.window, self.n
            self.pieces[name] = []
        else:
            room, name = self.by_room.pop(at)
        self.pieces[name].append((doc, start, total, ids))
        if room == size:
            yield self.pieces.pop(name)
        else:
            insort(self.by_room, (room - size, name))

    def rest(self):
        return [p for _, name in self.by_room for p in self.pieces[name]]


def pack(docs: DataFrame, path: str, window: int = 2048, open_windows: int = 64, end_id: int = 1) -> DataFrame:
    """Pack every row of docs into sequences of at most `window` ids; one row per piece.

    A document is its whole text's ids (null: none) and end_id, so empty ones have one id. Each id is in one
    piece; pieces lie gapless in their sequence. Padding stands only in sequences whose length is no power
    of two: those that leave since nothing fits. Repeated rows and null doc_ids are packed like any other;
    an empty table gives none; other columns are ignored. sequence_id is unique, not gapless. Memory: open_windows
    windows and a text in the first step, MERGED * open_windows windows in the second.
    """

    def line(sequence: int, pieces) -> list[tuple]:
        out, offset = [], 0
        for doc, start, total, ids in pieces:
            out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, None))
            offset += len(ids) // 4
        return out

    def batch(rows, names, kinds):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part = loaded(WordEncoder, path), TaskContext.get().partitionId()
        held, made = OpenWindows(window, open_windows), part << 36
        names, kinds = [*COLUMNS, "ids"], [pa.int64()] * 7 + [pa.binary()]
        for rows in row_groups(batches, 4_000_000, lambda r: len(r[1])):
            out, begin = [], 0
            every, sizes = enc.encode_many([t for _, t in rows], end_id)
            every = memoryview(every.astype("<u4").tobytes())
            for (doc, _), total in zip(rows, sizes.tolist(), strict=True):
                ids = every[4 * begin : 4 * (begin + total)]
                begin += total
                whole = total - total % window
                for at in range(0, whole, window):
                    out += line(made := made + 1, [(doc, at, total, ids[4 * at : 4 * (at + window)])])
                if whole < total:
                    for pieces in held.add(doc, whole, total, bytes(ids[4 * whole :])):
                        out += line(made := made + 1, pieces)
            if out:
                yield batch(out, names, kinds)
        if rest := [(doc, start, len(ids) // 4, 0, total, part, i, ids) for i, (doc, start, total, ids) in enumerate(held.rest())]:
            yield batch(rest, names, kinds)

    def merge(batches):
        import pyarrow as pa

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for group, own in groupby(rows, key=lambda r: r[-1]):  # one group at a time: they come sorted
            own, out = sorted(own, key=lambda r: (r[5], r[6])), []
            sizes = sizes_of(sum(r[2] for r in own), window)
            made, at, offset = -((group + 1) << 36), 0, 0
            for doc, start, length, _, total, _, _, ids, _ in own:
                done = 0
                while done < length:
                    take = min(length - done, sizes[at] - offset)
                    out.append((doc, start + done, take, zlib.crc32(ids[4 * done : 4 * (done + take)]), total, made - at, offset))
                    done, offset = done + take, offset + take
                    if offset == sizes[at]:
                        at, offset = at + 1, 0
            yield batch(out, COLUMNS, [pa.int64()] * 7)

    first = materialize(text_bytes(docs).mapInArrow(run, f"{PIECE}, ids binary"), "packed")
    rest = first.where("ids is not null").withColumn("merged", F.expr(f"sequence_id div {MERGED}"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = rest.repartition(n, "merged").sortWithinPartitions("merged").mapInArrow(merge, PIECE)
    return first.where("ids is null").select(*COLUMNS).union(merged)
