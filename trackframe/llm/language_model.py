"""Scores of whole documents under a gated recurrent language model.

The model is a GRU in numpy with a class-factored softmax: P(word) = P(class | state) * P(word | class).
Head words have learned classes and learned places in them; every other word, known or not, is in a class by its
first three bytes, with (count + 1) / (sum of these + 1) as its share, so that the probabilities of all
words and of one unknown word a class sum to one. Untrained, the model equals the unigram base; training
is truncated backpropagation on every partition from common weights, which are then averaged (weighted by
tokens) and used for the next round. The state is carried across windows through the whole document.

All counts are taken over all training documents, and the network's weights are fitted on all of them too, each
once: they are dealt by hash into ROUNDS classes, one a round.
"""

from __future__ import annotations

import zlib
from collections import Counter
from heapq import heapreplace
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import distinct_words, materialize, row_groups, sums_of, take_runs

#: Words whose counts every task holds (bounded, about 30 bytes each); the rest are joined.
FREQUENT = 300_000
HEAD, CLASS_SIZE, BUCKETS = 2048, 64, 32
#: Units; words that gradients go back; streams trained, and scored, side by side; rows of a softmax at once.
HIDDEN, SPAN, BATCH, STREAMS, ROWS = 16, 16, 512, 1024, 2048
ROUNDS = 2
RATE = 0.01
#: Text bytes, and bytes of two-byte codes, of a group of documents that a task works on at once.
GROUP_BYTES, CODE_BYTES = 12_000_000, 8_000_000
NULL_ID = np.iinfo(np.int64).min


def bucket(word: bytes) -> int:
    return zlib.crc32(word[:3]) % BUCKETS


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Spec:
    """What every task knows of the vocabulary: frequent words with counts, head words, class masses.

    words: (word, count) of the frequent words, most frequent first. mass: by bucket the sum of
    (count + 1) of all known words outside the head; total: by bucket the sum of their counts.
    """

    def __init__(self, words: list[tuple[bytes, int]], n: int, v: int, mass: np.ndarray):
        self.n, self.v = n, v
        self.head = min(HEAD, len(words))
        self.classes = -(-self.head // CLASS_SIZE)
        self.place = {w: i for i, (w, _) in enumerate(words)}
        counts = np.array([c for _, c in words], np.float64)
        self.log_count = np.log10(counts + 1)
        self.tail_log = np.log10(mass + 1)
        starts = np.arange(0, self.head, CLASS_SIZE)
        own = np.add.reduceat(counts[: self.head] + 1, starts) if self.head else np.zeros(0)
        every = np.r_[own, mass + 1]
        self.class_bias = np.log(every / every.sum()).astype(np.float32)
        self.head_bias = np.log(counts[: self.head] + 1).astype(np.float32)

    def codes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place among the frequent words or -1, input row: head place or HEAD + bucket) of distinct words."""
        place = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        row = np.where((place >= 0) & (place < self.head), place, 0)
        at = np.flatnonzero((place < 0) | (place >= self.head))
        row[at] = np.fromiter((HEAD + bucket(words[i]) for i in at.tolist()), np.int64, len(at))
        return place, row


def first_weights(spec: Spec) -> dict[str, np.ndarray]:
    rng, h, c = np.random.default_rng(5), HIDDEN, spec.classes + BUCKETS
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "embed": small(HEAD + BUCKETS + 1, h), "w": small(h, 3 * h) * 3, "b": np.zeros(3 * h, np.float32), "u": small(h, 3 * h) * 3,
        "wc": np.zeros((h, c), np.float32), "bc": spec.class_bias.copy(), "wo": np.zeros((spec.head, h), np.float32), "bo": spec.head_bias.copy(),
    }


def flat(weights: dict) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights.values()])


def shaped(values: np.ndarray, like: dict) -> dict[str, np.ndarray]:
    ends = np.cumsum([w.size for w in like.values()])
    return {k: v.reshape(w.shape).astype(np.float32) for (k, w), v in zip(like.items(), np.split(values, ends[:-1]), strict=True)}


class Network:
    """States and probabilities of windows. A window holds steps x streams; the first active[t] streams work at step t.

    inputs, fresh, targets: (steps, streams): the word before (or the start), whether a document begins, the word.
    """

    def __init__(self, spec: Spec, weights: dict[str, np.ndarray]):
        self.spec, self.p = spec, weights
        self.moments = None

    def into(self) -> np.ndarray:
        return self.p["embed"] @ self.p["w"] + self.p["b"]

    def states(self, into, inputs, fresh, active, h, kept: dict | None = None) -> np.ndarray:
        """States after every step (steps, streams, HIDDEN); h, the streams' last states, is brought up to date."""
        u, k = self.p["u"], HIDDEN
        shape = (*inputs.shape, k)
        out = np.zeros(shape, u.dtype)
        stay = (~fresh[:, :, None]).astype(u.dtype)
        if kept is not None:
            kept.update({name: np.zeros(shape, u.dtype) for name in ("before", "z", "r", "new", "un")}, stay=stay)
        for t, n in enumerate(active.tolist()):
            x, before = into[inputs[t, :n]], h[:n] * stay[t, :n]
            hu = before @ u
            gate = sigmoid(x[:, : 2 * k] + hu[:, : 2 * k])
            z, r, un = gate[:, :k], gate[:, k:], hu[:, 2 * k :]
            new = np.tanh(x[:, 2 * k :] + r * un)
            h[:n] = out[t, :n] = new + z * (before - new)
            if kept is not None:
                for name, value in (("before", before), ("z", z), ("r", r), ("new", new), ("un", un)):
                    kept[name][t, :n] = value
        return out

    def log_probs(self, states: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Natural log P of the targets' classes and, for head words, of their places; with grads, d/d states of the mean loss."""
        p, spec, m = self.p, self.spec, len(target)
        head = target < HEAD
        cls = np.where(head, target // CLASS_SIZE, target - HEAD + spec.classes)
        out, back = np.zeros(m), None
        if grads is not None:
            back = np.zeros_like(states)
            grads |= {name: np.zeros_like(p[name]) for name in ("wc", "bc", "wo", "bo")}

        def softmax(rows, weights, bias, place):
            """rows of states against one set of outputs, which stand in columns so that sums run along memory."""
            s = states[rows]
            logits = weights @ s.T
            logits += bias[:, None]
            if np.abs(weights).sum(1).max() + np.abs(bias).max() > 60:  # states lie within -1 and 1
                logits -= logits.max(0)
            own = np.arange(len(place))
            picked = logits[place, own]
            np.exp(logits, out=logits)
            total = logits.sum(0)
            out[rows] += picked - np.log(total)
            if grads is None:
                return None
            logits /= total * m
            logits[place, own] -= logits.dtype.type(1 / m)
            back[rows] += logits.T @ weights
            return logits @ s, logits.sum(1)

        columns = np.ascontiguousarray(p["wc"].T)
        for at in range(0, m, ROWS):
            rows = slice(at, at + ROWS)
            if (g := softmax(rows, columns, p["bc"], cls[rows])) is not None:
                grads["wc"] += g[0].T
                grads["bc"] += g[1]
        at = np.flatnonzero(head)
        at = at[np.argsort(cls[at], kind="stable")]
        cuts = np.searchsorted(cls[at], np.arange(spec.classes + 1))
        for c in range(spec.classes):
            lo, hi = c * CLASS_SIZE, min((c + 1) * CLASS_SIZE, spec.head)
            for first in range(cuts[c], cuts[c + 1], ROWS):
                rows = at[first : min(first + ROWS, cuts[c + 1])]
                if (g := softmax(rows, p["wo"][lo:hi], p["bo"][lo:hi], target[rows] - lo)) is not None:
                    grads["wo"][lo:hi] += g[0]
                    grads["bo"][lo:hi] += g[1]
        return out, back

    def train_window(self, inputs, fresh, targets, active, h) -> None:
        """One step of truncated backpropagation; h becomes the state after the window."""
        p, k, kept, grads = self.p, HIDDEN, {}, {}
        states = self.states(self.into(), inputs, fresh, active, h, kept)
        works = np.arange(inputs.shape[1]) < active[:, None]
        if works.all():
            works = slice(None), slice(None)
        back = np.zeros_like(states)
        own = self.log_probs(states[works].reshape(-1, k), targets[works].ravel(), grads)[1]
        back[works] = own.reshape(back[works].shape)
        before, z, r, new, un, stay = (kept[name] for name in ("before", "z", "r", "new", "un", "stay"))
        to_new, to_z, to_r = (1 - z) * (1 - new * new), (before - new) * z * (1 - z), un * r * (1 - r)
        dhu, dan, carry, ut = np.zeros((*inputs.shape, 3 * k), z.dtype), np.zeros_like(states), np.zeros_like(h), np.ascontiguousarray(p["u"].T)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            dh = back[t, :n] + carry[:n]
            d, a = dhu[t, :n], dan[t, :n]
            np.multiply(dh, to_new[t, :n], out=a)
            np.multiply(dh, to_z[t, :n], out=d[:, :k])
            np.multiply(a, to_r[t, :n], out=d[:, k : 2 * k])
            np.multiply(a, r[t, :n], out=d[:, 2 * k :])
            carry[:n] = (dh * z[t, :n] + d @ ut) * stay[t, :n]
        da = np.concatenate([dhu[:, :, : 2 * k], dan], 2).reshape(-1, 3 * k)
        x = inputs.ravel()
        grads["u"] = before.reshape(-1, k).T @ dhu.reshape(-1, 3 * k)
        grads["b"], grads["w"] = da.sum(0), p["embed"][x].T @ da
        grads["embed"] = np.stack([np.bincount(x, column, len(p["embed"])) for column in p["w"] @ da.T], 1).astype(z.dtype)
        self.adam(grads)

    def adam(self, grads: dict) -> None:
        if self.moments is None:
            self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
            self.steps = 0
        self.steps += 1
        rate = RATE * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for k, g in grads.items():
            a, b = self.moments[k]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            self.p[k] = self.p[k] - (rate * a / (np.sqrt(b) + 1e-6)).astype(self.p[k].dtype)

    def train(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Train once on documents' codes, one behind the other, cut into BATCH streams of one length.

        The state is carried from window to window and starts anew with every document (and stream).
        """
        total = len(codes)
        if not total:
            return
        n = max(1, min(BATCH, total // (64 * SPAN)))  # some tens of steps on small tables too
        sizes = np.full(n, total // n) + (np.arange(n) < total % n)
        starts, steps = np.cumsum(sizes) - sizes, int(sizes[0])
        before, fresh = before_words(codes, counts)
        h = np.zeros((n, HIDDEN), self.p["u"].dtype)
        for at in range(0, steps, SPAN):
            t = np.arange(at, min(at + SPAN, steps))
            place = np.minimum(starts + t[:, None], total - 1)
            self.train_window(before[place], fresh[place], codes[place], (sizes > t[:, None]).sum(1), h)

    def score(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural log probability of each document's classes and head places; every count is 1 at least.

        Whole documents are dealt to STREAMS streams, the longest first to the least filled.
        """
        n = min(STREAMS, len(counts))
        if not n:
            return np.zeros(0)
        begin, fill, own = np.cumsum(counts) - counts, [(0, i) for i in range(n)], [[] for _ in range(n)]
        for d in np.argsort(-counts, kind="stable").tolist():
            size, i = fill[0]
            heapreplace(fill, (size + int(counts[d]), i))
            own[i].append(d)
        own.sort(key=lambda docs: -int(counts[docs].sum()))
        order = np.array([d for docs in own for d in docs])
        place = take_runs(np.arange(len(codes)), counts, order)  # places in `codes` in the streams' order
        before, fresh = (x[place] for x in before_words(codes, counts))
        codes = codes[place]
        sizes = np.array([int(counts[docs].sum()) for docs in own])
        starts, steps = np.cumsum(sizes) - sizes, int(sizes[0])
        h, logs, into, at = np.zeros((n, HIDDEN), self.p["u"].dtype), np.zeros(len(codes)), self.into(), 0
        while at < steps:
            most = int((sizes > at).sum())
            t = np.arange(at, min(at + max(16, 16 * STREAMS // most), steps))
            active = (sizes[:most] > t[:, None]).sum(1)
            places = np.minimum(starts[:most] + t[:, None], len(codes) - 1)
            works = np.arange(most) < active[:, None]
            states = self.states(into, before[places], fresh[places], active, h)
            places = places[works]
            logs[places] = self.log_probs(states[works], codes[places])[0]
            at += len(t)
        out = np.zeros(len(counts))
        out[order] = sums_of(logs, counts[order])
        return out


def before_words(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each (the start where a document begins), and where documents begin."""
    fresh = np.zeros(len(codes), bool)
    fresh[(np.cumsum(counts) - counts)[counts > 0]] = True
    before = np.r_[HEAD + BUCKETS, codes[:-1]]
    before[fresh] = HEAD + BUCKETS
    return before, fresh


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("key_id"), text.alias("text"))
    return key.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)))


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, n) over all rows of train(key_id, text)."""

    def run(batches):
        import pyarrow as pa

        def out(seen):
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        seen: Counter = Counter()
        for rows in row_groups(batches, 8_000_000, lambda r: len(r[0])):
            words, index, _ = distinct_words([t.lower() for (t,) in rows], end=True)
            for w, n in zip(words, np.bincount(index, minlength=len(words)).tolist(), strict=True):
                if n:
                    seen[w] += n
            if len(seen) > 400_000:
                yield out(seen)
                seen = Counter()
        if seen:
            yield out(seen)

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn_spec(vocabulary: DataFrame) -> Spec:
    """Totals, class masses and the frequent words; at most FREQUENT words reach the driver."""
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    band = F.floor(F.log2("n") * 16).cast("int")
    by_band = dict(vocabulary.groupBy(band.alias("band")).count().collect())  # some hundred bands of counts
    room, least = FREQUENT, None
    for b in sorted(by_band, reverse=True):
        if (room := room - by_band[b]) < 0:
            break
        least = b
    words = []
    if least is not None:
        got = vocabulary.where(band >= least).toArrow()
        words = sorted(zip(got.column("word").to_pylist(), got.column("n").to_pylist(), strict=True), key=lambda w: (-w[1], w[0]))
    mass = np.zeros(BUCKETS)
    own = F.crc32(F.substring("word", 1, 3)) % BUCKETS
    for b, m in vocabulary.groupBy(own.alias("b")).agg(F.sum(F.col("n") + 1).alias("m")).collect():
        mass[b] = m
    for w, c in words[:HEAD]:
        mass[bucket(w)] -= c + 1
    return Spec(words, n, v, mass)


CODED = "doc_id long, key_id long, held_out boolean, doc_row long, n_tokens long, n_known long, base double, outside double, codes binary, word binary, k long"


def encoded(docs: DataFrame, spec) -> DataFrame:
    """CODED: a row a document with its words' input rows as two-byte codes and what the counts alone tell of it, and, from
    the same pass, a row (doc_row, word, k) for each of its words that is not frequent. doc_row numbers the rows of docs by their partition and
    their place in it, so that rows with one doc_id, or none, and one text stay apart: it holds where the result is written, as a task's
    two kinds of rows are committed together. spec: a broadcast Spec."""
    names = [c.split()[0] for c in CODED.split(", ")]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        s, at_row = spec.value, TaskContext.get().partitionId() << 40
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.int64()]
        log_count, tail_log = np.append(s.log_count, 0.0), np.append(s.tail_log, 0.0)

        def batch(n: int, cols: dict):
            return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

        for rows in row_groups(batches, GROUP_BYTES, lambda r: len(r[3])):
            words, index, counts = distinct_words([r[3].lower() for r in rows], end=True)
            place, row = s.codes(words)
            # By distinct word: its own term of the base, and its term beside the network's.
            base = log_count[place]
            outside = np.where(row >= HEAD, base - tail_log[np.maximum(row - HEAD, -1)], 0.0)
            doc, key, held, _ = zip(*rows, strict=True)
            doc_row = at_row + np.arange(len(rows))
            at_row += len(rows)
            raw, ends = row.astype("<u2")[index].tobytes(), (2 * np.cumsum(counts)).tolist()
            codes = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            own = {"doc_id": doc, "key_id": key, "held_out": held, "doc_row": doc_row, "n_tokens": counts, "n_known": sums_of((place >= 0)[index].astype(np.int64), counts), "base": sums_of(base[index], counts), "outside": sums_of(outside[index], counts)}
            yield batch(len(rows), own | {"codes": codes})
            rare = np.flatnonzero(place[index] < 0)
            pair, k = np.unique(np.repeat(np.arange(len(rows)), counts)[rare] * len(words) + index[rare], return_counts=True)
            for at in range(0, len(pair), 200_000):
                d, w = np.divmod(pair[at : at + 200_000], len(words))
                yield batch(len(d), {"doc_row": doc_row[d], "word": [words[i] for i in w.tolist()], "k": k[at : at + 200_000]})

    return docs.select("doc_id", "key_id", "held_out", "text").mapInArrow(run, CODED)


def learn_weights(train: DataFrame, spec) -> dict[str, np.ndarray]:
    """Weights after ROUNDS rounds of training on every partition and averaging, each document in one of them.

    train: key_id, codes of `encoded`; spec: a broadcast Spec.
    """
    spark = train.sparkSession
    weights, chunk = first_weights(spec.value), 4096
    for k in range(ROUNDS):
        begin = spark.sparkContext.broadcast(weights)

        def run(batches, begin=begin):
            import pyarrow as pa

            own, seen = Network(spec.value, {k: w.copy() for k, w in begin.value.items()}), 0
            for rows in row_groups(batches, CODE_BYTES, lambda r: len(r[0])):
                order = np.random.default_rng(len(rows)).permutation(len(rows)).tolist()
                counts = np.array([len(rows[i][0]) // 2 for i in order])
                codes = np.frombuffer(b"".join(rows[i][0] for i in order), "<u2").astype(np.int64)
                own.train(codes, counts)
                seen += len(codes)
            if seen:
                parts = np.split(flat(own.p).astype(np.float64) * seen, range(chunk, flat(own.p).size, chunk))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float(seen)] * len(parts)), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "weight", "sums"])

        def add(batches):
            import pyarrow as pa

            sums: dict = {}
            for b in batches:
                for c, w, s in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    have = sums.get(c, (0.0, 0.0))
                    sums[c] = (have[0] + w, have[1] + np.frombuffer(s))
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([w for w, _ in sums.values()]), pa.array([s.tobytes() for _, s in sums.values()], pa.binary())], ["chunk", "weight", "sums"])

        kind = "chunk int, weight double, sums binary"
        chosen = train.where(F.crc32(F.concat(F.col("key_id").cast("string"), F.lit("sgd"))) % ROUNDS == k)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        got = chosen.select("codes").mapInArrow(run, kind).repartition(max(1, round(n**0.5))).mapInArrow(add, kind).repartition(n, "chunk").mapInArrow(add, kind).collect()
        if got:
            weights = shaped(np.concatenate([np.frombuffer(r["sums"]) / r["weight"] for r in sorted(got, key=lambda r: r["chunk"])]), weights)
        begin.unpersist()
    return weights


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Whole texts of any length are scored, in memory in proportion to the longest. Null texts are empty (their end is their one token); a null doc_id is never held out;
    repeated rows are scored alike; extra columns are ignored; with no training document every word is
    unknown; an empty table gives none.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    train = keyed.where("not held_out")
    vocabulary = materialize(word_counts(train), "vocabulary")
    spec = spark.sparkContext.broadcast(learn_spec(vocabulary))
    n, v = spec.value.n, spec.value.v
    both = materialize(encoded(keyed, spec), "codes")
    coded = both.where("word is null").drop("word", "k")
    weights = spark.sparkContext.broadcast(learn_weights(coded.where("not held_out"), spec))
    names = [*coded.columns[:-1], "score"]

    def scores(batches):
        import pyarrow as pa

        net = Network(spec.value, weights.value)
        for rows in row_groups(batches, CODE_BYTES, lambda r: len(r[-1])):
            *own, codes = zip(*rows, strict=True)
            counts = np.array([len(c) // 2 for c in codes])
            own.append(net.score(np.frombuffer(b"".join(codes), "<u2").astype(np.int64), counts) / np.log(10) + np.array(own[-1]))
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(own, types, strict=True)], names)

    found = both.where("word is not null").select("doc_row", "word", "k").join(vocabulary, "word")
    known = found.groupBy("doc_row").agg(F.sum("k").alias("rare_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("rare_log"))
    scored = coded.mapInArrow(scores, CODED.split(", codes")[0] + ", score double")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(known, "doc_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("rare_known")).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_log") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), (F.col("score") + zero("rare_log")).alias("score"),
    )
