"""The whole pipeline over small tables against a plain version of every stage."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def base_failed(t):
    w = t.split()
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    return len(w) < 50 or 100 * len(covered) > 50 * len(w)


def one_of_each_group(rows):
    sets = {d: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for d, t in rows.items() for w in [t.lower().split()]}
    gone = set()
    for b in sorted(rows):
        if any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in rows if a < b):
            gone.add(b)
    return {d: t for d, t in rows.items() if d not in gone}


def without_repeats(rows, window=20):
    first, out = {}, {}
    for d in sorted(rows):
        w = rows[d].split()
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (d, s))
    for d, t in rows.items():
        w, gone = t.split(), set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (d, s):
                gone |= set(range(s, s + window))
        out[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
    return out


def test_run_equals_plain_stages(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage = text(40)
    rows = {i: text(rng.randrange(60, 300)) for i in range(30)}
    rows |= {30: "too short", 31: " ".join(["again and"] * 40), 32: rows[4], 33: rows[5].replace("w1", "v1", 1), 34: text(30) + " " + passage + "\n" + text(30), 35: passage + " " + text(60), 36: text(5000)}
    at = f"file://{tmp_path}/sf"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (31, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    want = without_repeats(one_of_each_group({d: t for d, t in rows.items() if not base_failed(t)}))
    assert {30, 31, 32, 33}.isdisjoint(want) and want[35] != rows[35]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, at).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for d, own in pieces.items():
        ids, start = np.array([*tokenizer.encode(want[d], add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == start and r.ids_crc32 == zlib.crc32(ids[start : start + r.length].tobytes())
            start += r.length
        assert start == len(ids)
    assert all(sum(r.length for r in s) <= 2048 for s in sequences.values())


def test_stages_chain_and_keep_odd_columns(spark, tmp_path):
    """All stages on top of each other, nothing written between, on a table whose columns are named like the stages' own."""
    rng = random.Random(13)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage = text(40)
    rows = {i: text(rng.randrange(60, 200)) for i in range(20)}
    rows |= {20: "too short", 21: rows[4], 22: passage + " " + text(60), 23: text(60) + " " + passage, 24: None}
    names = ["doc_id", "text", "lang", "source", "n_chars", "no_text_", "GONE_", "a.b", "Stats_", "judge_s", "n_words", "new_text", "b`c"]
    kind = ", ".join("`" + n.replace("`", "``") + "` " + {"doc_id": "long", "n_chars": "long"}.get(n, "string") for n in names)
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *(f"{n}{i}" for n in names[5:])) for i, t in rows.items()], kind).repartition(3)
    at = f"file://{tmp_path}/sf"
    spark.createDataFrame([(1, 1, 0), (20, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    want = without_repeats(one_of_each_group({d: t for d, t in rows.items() if t and not base_failed(t)}))
    out, made = docs, []
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, out, at)
        made.append(out)
        assert out.columns == names
    got = {r[0]: tuple(r) for r in out.collect()}
    assert {d: r[1] for d, r in got.items()} == want and {20, 21, 24}.isdisjoint(got) and want[23] != rows[23]
    assert all(r[2:5] == ("en", "s", 1) and r[5:] == tuple(f"{n}{d}" for n in names[5:]) for d, r in got.items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, at).collect()
    assert {r.doc_id for r in pieces} == set(want)
    assert all(m.count() >= len(want) for m in made)  # earlier stages can still be read
