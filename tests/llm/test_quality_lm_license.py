"""Quality rules, language model, licences and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

import corpus_pipeline
from trackframe.llm import language_model as lm
from trackframe.llm import licenses, quality


def key(r):
    return tuple(str(x) for x in r)


def slow_stats(t):
    w = t.encode().split()
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    out = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
    return (*out, out[0] < 50 or 100 * out[4] > 50 * out[0])


def test_statistics(spark, docs, plain, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_report(docs, labels).collect()
    assert sorted(key(r)[:7] for r in got) == sorted(key((d, *slow_stats(t))) for d, t in plain)
    assert all(r.kept == (not r.base_failed) for r in got)  # nothing is certified without labels
    assert quality.quality_report(empty, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_cutoffs_are_certified(spark):
    """English has enough labels to certify a cutoff, German has not; several labels count as the worst."""
    rng = random.Random(6)
    clean = lambda: " ".join(f"word{rng.randrange(9000)}" for _ in range(60))
    junk = lambda: " ".join(f"word{rng.randrange(9000)}%%%" for _ in range(60))
    rows, labels = [], []
    for i in range(1200):
        bad = i % 6 == 0
        rows.append((i, "en", junk() if bad else clean()))
        labels.append((i, 0 if bad else 1))
    for i in range(2000, 2060):
        bad = i % 2 == 0
        rows.append((i, "de", junk() if bad else clean()))
        labels.append((i, 0 if bad else 1))
    rows += [(5000, "en", junk()), (5001, "de", junk()), (5002, None, clean())]
    labels += [(0, 1), (1, None)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    cuts = {r.stratum: r for r in quality.certified_cutoffs(quality.with_stats(docs), lab).collect()}
    assert cuts["1en"].symbols is not None and "1de" not in cuts
    assert tail(0, 400, quality.RISK) <= quality.CONFIDENCE_LOSS / 2 < tail(0, 30, quality.RISK)
    kept = {r.doc_id: r.kept for r in quality.quality_report(docs, lab).collect()}
    assert not kept[5000] and kept[5001] and kept[5002]
    assert all(kept[i] for i in range(1200) if i % 6)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", lab.toPandas())
    assert sorted(key(r) for r in con.sql(quality.ORACLE).fetchall()) == sorted(map(key, quality.quality_report(docs, lab).collect()))


def compared(docs, lab):
    """The query's rows, which must be those of the SQL."""
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", lab.toPandas())
    got = quality.quality_report(docs, lab).collect()
    assert sorted(map(key, got)) == sorted(key(r) for r in con.sql(quality.ORACLE).fetchall())
    return got


def test_the_joint_rule_is_certified(spark):
    """Rules are added while the exact tail of all their rejections together allows it; copies count once."""
    half = lambda t: hashlib.md5(t.encode()).hexdigest() < "8"
    for symbols, shouts in ((0, 0), (0, 60), (60, 0), (9, 9)):
        rng, rows, lab = random.Random(symbols + shouts), [], []
        for i in range(1500):
            kind, bad = i % 5, i >= 1000
            a = "%%%" if (bad and kind < 3) or (not bad and i < symbols) else ""
            b = "!!" if (bad and kind >= 3) or (not bad and 500 <= i < 500 + shouts) else ""
            rows.append((i, "en", " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + a + b))
            lab.append((i, 0 if bad else 1))
        rows += [(2000 + i, "en", rows[0][2]) for i in range(50)]  # copies of one text, with labels of their own
        lab += [(2000 + i, 1) for i in range(50)]
        docs, labels = spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(lab, "doc_id long, quality int")
        cuts = quality.certified_cutoffs(quality.with_stats(docs), labels).collect()
        good = [(i, t) for i, _, t in rows[:1000]]
        held = [(i, t) for i, t in good if not half(t)]
        by_rule = {"symbols": lambda t: "%" in t, "exclamation": lambda t: "!" in t}
        picked = [r for r, f in by_rule.items() if sum(f(t) and half(t) for _, _, t in rows[1000:1500]) >= 10 * sum(f(t) and half(t) for _, t in good)]
        picked.sort(key=lambda r: 10 * sum(by_rule[r](t) and half(t) for _, t in good) - sum(by_rule[r](t) and half(t) for _, _, t in rows[1000:1500]))
        want = []
        for k in range(len(picked)):
            hits = sum(any(by_rule[r](t) for r in picked[: k + 1]) for _, t in held)
            if hits > quality.RISK * len(held) or tail(hits, len(held), quality.RISK) > quality.CONFIDENCE_LOSS:
                break
            want.append(picked[k])
        assert [r for r in by_rule if cuts and cuts[0][r] is not None] == [r for r in by_rule if r in want], (symbols, shouts)
        if symbols == 0:
            compared(docs, labels)


def test_a_missing_language_and_clashing_names(spark):
    rows = [(i, None if i % 4 < 2 else "", " ".join(f"w{i}x{j}" for j in range(60)) + ("%%%" if i % 10 == 0 else ""), 1, 2, 3) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, kept_ int, stratum_ int, stats_ int")
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i in range(2400)] + [(None, 1)], "doc_id long, quality int")
    kept = {r.doc_id for r in compared(docs, labels) if r.kept}
    assert kept == {i for i in range(2400) if i % 10}
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and {(r.doc_id, r.kept_, r.stratum_, r.stats_) for r in good.collect()} == {(i, 1, 2, 3) for i in kept}


def words_of(text):
    return [*text.lower().split(), b""]


def test_gradients():
    rng = np.random.default_rng(0)
    spec = lm.Spec([(b"w%d" % i, int(2000 / (i + 1)) + 1) for i in range(150)], 10_000, 300, rng.integers(1, 50, lm.BUCKETS).astype(float))
    weights = {k: (w + rng.normal(0, 0.3, w.shape)).astype(float) for k, w in lm.first_weights(spec).items()}
    net = lm.Network(spec, weights)
    every = np.r_[np.arange(150), lm.HEAD + np.arange(lm.BUCKETS)]
    inputs, targets, fresh = rng.choice(every, (9, 5)), rng.choice(every, (9, 5)), rng.random((9, 5)) < 0.2
    active, h = np.array([5, 5, 5, 4, 4, 3, 3, 1, 1]), rng.normal(0, 0.3, (5, lm.HIDDEN))
    works = np.arange(5) < active[:, None]

    def loss(p):
        own = lm.Network(spec, p)
        return -own.log_probs(own.states(own.into(), inputs, fresh, active, h.copy())[works], targets[works])[0].mean()

    grads = {}
    net.adam = grads.update
    net.train_window(inputs, fresh, targets, active, h.copy())
    for k in weights:
        at = np.argmax(np.abs(grads[k]))
        up, down = ({n: w.copy() for n, w in weights.items()} for _ in range(2))
        up[k].flat[at] += 1e-5
        down[k].flat[at] -= 1e-5
        assert abs(grads[k].flat[at] - (loss(up) - loss(down)) / 2e-5) < 1e-6


def plain_states(p, codes):
    """The states after each word, one document at a time, word by word."""
    h, out, k = np.zeros(lm.HIDDEN), [], lm.HIDDEN
    for code in [lm.HEAD + lm.BUCKETS, *codes[:-1]]:
        x, hu = p["embed"][code].astype(float) @ p["w"] + p["b"], h @ p["u"]
        z, r = (1 / (1 + np.exp(-(x[i : i + k] + hu[i : i + k]))) for i in (0, k))
        h = z * h + (1 - z) * np.tanh(x[2 * k :] + r * hu[2 * k :])
        out.append(h)
    return np.array(out)


def test_probabilities_sum_to_one_and_state_is_carried():
    rng = np.random.default_rng(2)
    words = [(b"w%d" % i, 300 - i) for i in range(200)]
    outside = {w: c for w, c in [(b"rare%d" % i, 1 + i % 3) for i in range(50)]}
    mass = np.zeros(lm.BUCKETS)
    for w, c in outside.items():
        mass[lm.bucket(w)] += c + 1
    spec = lm.Spec(words, 1, 1, mass)
    net = lm.Network(spec, {k: w + rng.normal(0, 0.3, w.shape).astype(np.float32) for k, w in lm.first_weights(spec).items()})
    state = rng.normal(size=(1, lm.HIDDEN)).astype(np.float32)
    every = np.r_[np.arange(200), lm.HEAD + np.arange(lm.BUCKETS)]
    logs, _ = net.log_probs(np.repeat(state, len(every), 0), every)
    assert abs(np.exp(logs).sum() - 1) < 1e-4  # head words and whole buckets; a bucket's words and one unknown share it
    assert abs(sum(sum((c + 1) for w, c in outside.items() if lm.bucket(w) == b) + 1 for b in range(lm.BUCKETS)) - (10 ** spec.tail_log).sum()) < 1e-6
    docs = [rng.choice(every, n) for n in (300, 1, 40, 40, 7, 1200, 2)]
    whole = net.score(np.concatenate(docs), np.array([len(d) for d in docs]))
    for d, got in zip(docs, whole, strict=True):
        assert abs(got - net.log_probs(plain_states(net.p, d).astype(np.float32), d)[0].sum()) < 1e-4 * len(d) + 1e-3


def test_scores_of_whole_documents(docs, plain, monkeypatch):
    """score_documents against a plain network, word by word, with the shares of words outside the head."""
    monkeypatch.setattr(lm, "FREQUENT", 300)
    count = Counter()
    for d, t in plain:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(words_of(t.encode()))
    kept = {}

    def fixed(train, spec):
        rng = np.random.default_rng(3)
        kept["spec"], kept["weights"] = spec.value, {k: w + rng.normal(0, 0.2, w.shape).astype(np.float32) for k, w in lm.first_weights(spec.value).items()}
        return kept["weights"]

    monkeypatch.setattr(lm, "learn_weights", fixed)
    got = {r.doc_id: r.score for r in lm.score_documents(docs).collect() if r.doc_id is not None}
    spec, p = kept["spec"], kept["weights"]
    place = {w: i for w, i in spec.place.items() if i < spec.head}
    mass = Counter()
    for w, c in count.items():
        if w not in place:
            mass[lm.bucket(w)] += c + 1
    for d, t in plain:
        if d is None:
            continue
        words = words_of(t.encode())
        codes = [place.get(w, lm.HEAD + lm.bucket(w)) for w in words]
        total = 0.0
        for w, code, s in zip(words, codes, plain_states(p, codes), strict=True):
            logits = s @ p["wc"] + p["bc"]
            cls = code // lm.CLASS_SIZE if code < lm.HEAD else code - lm.HEAD + spec.classes
            total += logits[cls] - np.log(np.exp(logits).sum())
            if code < lm.HEAD:
                lo = cls * lm.CLASS_SIZE
                inner = p["wo"][lo : lo + lm.CLASS_SIZE] @ s + p["bo"][lo : lo + lm.CLASS_SIZE]
                total += inner[code - lo] - np.log(np.exp(inner).sum())
            else:
                total += np.log((count[w] + 1) / (mass[lm.bucket(w)] + 1))
        assert abs(got[d] - total / np.log(10)) < 1e-3 + 1e-5 * len(words), d


def test_op5(docs, plain, empty, spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 120)  # so that most words are joined
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter()
    for d, t in plain:
        if not held(d):
            count.update(words_of(t.encode()))
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), held(d), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for d, t in plain for w in [words_of(t.encode())])
    got = lm.score_documents(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_documents(empty).count() == 0
    only = spark.createDataFrame([(d, "a b") for d in range(60) if held(d)], "doc_id long, text string")
    assert [(r.n_known, r.train_tokens, r.base_score) for r in lm.score_documents(only).limit(1).collect()] == [(0, 0, 0.0)]


def test_rows_of_one_doc_id_and_text_stay_apart(spark, monkeypatch):
    """Repeated rows, most of them without doc_id, over several partitions: each has its own joined words, once."""
    monkeypatch.setattr(lm, "FREQUENT", 2)
    rows = [(None, "alpha beta gamma")] * 30 + [(None, "beta delta delta")] * 3 + [(7, "alpha beta gamma")] * 2 + [(8, None), (8, None)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(w for d, t in rows if not held(d) for w in words_of((t or "").encode()))
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for d, t in rows for w in [words_of((t or "").encode())])
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert len({(r.doc_id, round(r.base_score, 6), round(r.score, 3)) for r in got}) == 4


def test_model_beats_the_base_on_held_out_documents(spark):
    """Two languages that share no word: the state tells which one a document is in."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{rng.randrange(60)}" for _ in range(120))) for i in range(900)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in got) / sum(r.n_tokens for r in got) > sum(r.base_score for r in got) / sum(r.n_tokens for r in got) + 0.1


def test_every_document_trains_the_network(spark):
    words = [(f"w{i}".encode(), 9 - i) for i in range(8)]
    spec = spark.sparkContext.broadcast(lm.Spec(words, 44, 8, np.zeros(lm.BUCKETS)))
    first = lm.flat(lm.first_weights(spec.value))
    for k in range(6):
        train = spark.createDataFrame([(k, np.array([1, 2, 3, 1, 2], "<u2").tobytes())], "key_id long, codes binary").coalesce(1)
        assert not np.array_equal(lm.flat(lm.learn_weights(train, spec)), first), k


def test_licenses(spark, docs, empty, sf_dir):
    rows = [
        (1, "Intro. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nx y\nSee the License for the specific language governing permissions and limitations under the License."),
        (2, "RELEASED under the  MIT license!\nmore"), (3, "Licensed under CC BY-NC 4.0"), (4, "no licence here"), (5, None), (6, ""),
        (7, "See the License for the specific language governing permissions and limitations under the License. Licensed under the Apache License, Version 2.0."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert [got[i].license for i in range(1, 8)] == ["apache-2.0-header", "mit", "cc-by-nc-4.0", None, None, None, "apache-2.0"]
    assert got[1].sentence_ids == "apache-name apache-use apache-copy apache-limits" and got[7].sentence_ids == "apache-limits apache-name" and got[5].n_sentences == 0
    assert [got[i].licenses for i in (1, 4)] == ["apache-2.0-header apache-2.0", ""]
    assert licenses.license_scan(docs).count() == docs.count() and licenses.license_scan(empty).count() == 0
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(map(key, con.sql(licenses.ORACLE).fetchall())) == sorted(map(key, got.values()))
    plan = licenses.license_scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


HEADERS = {
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.',
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
}


def test_license_headers_wrapped_and_unwrapped(spark):
    rows = [(i, f"Some file\n\n{t}\n\ncode") for i, t in enumerate(HEADERS.values())]
    rows += [(100 + i, re.sub(r"(?<!\n)\n *(?![\n ])", " ", t)) for i, t in enumerate(HEADERS.values())]
    rows += [(200, "words\nLicensed under CC BY 4.0\nmore words\n" + HEADERS["gpl-2.0"] + "\nAll rights reserved"), (201, "x. Licensed under the MIT license\nand so on")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert [got[i].license for i in range(len(HEADERS))] == list(HEADERS) and [got[100 + i].license for i in range(len(HEADERS))] == list(HEADERS)
    assert got[200].licenses == "gpl-2.0 cc-by-4.0 proprietary" and got[201].license == "mit"
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(map(key, con.sql(licenses.ORACLE).fetchall())) == sorted(map(key, got.values()))


_GPL = "This {} is free software; you can redistribute it and/or modify\nit under the terms of the GNU {}{} as published by\nthe Free Software Foundation{}\n\nThis {} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the\nGNU {} for more details."
#: Texts as they are found, and what a reader would say they are under; nothing else may be listed.
FOUND = [
    (_GPL.format("program", "General Public License", "", "; either version 2 of the License, or\n(at your option) any later version.", "program", "General Public License"), "gpl-2.0"),
    (_GPL.format("program", "General Public License", " version 2", ".", "program", "General Public License"), "gpl-2.0-only"),
    ("This program is free software; you can redistribute it and/or modify it\nunder the terms and conditions of the GNU General Public License,\nversion 2, as published by the Free Software Foundation.", "gpl-2.0-only"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", "gpl-2.0-only"),
    (_GPL.format("program", "General Public License", "", ", either version 3 of the License, or\n(at your option) any later version.", "program", "General Public License"), "gpl-3.0-header"),
    (_GPL.format("library", "Lesser General Public License", "", "; either\nversion 2.1 of the License, or (at your option) any later version.", "library", "Lesser General Public License"), "lgpl-2.1"),
    (_GPL.format("program", "Affero General Public License", "", ", either version 3 of the License, or\n(at your option) any later version.", "program", "Affero General Public License"), "agpl-3.0"),
    (HEADERS["bsd-3-clause"].replace("the copyright holder nor", "Foo Bar Corporation nor"), "bsd-3-clause"),
    (HEADERS["bsd-3-clause"].replace("the copyright holder nor", "Example, Inc. nor").replace("3. Neither", "3) Neither"), "bsd-3-clause"),
    (HEADERS["bsd-3-clause"][: HEADERS["bsd-3-clause"].index("3. Neither")], "bsd-2-clause"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.", "gpl-3.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "cc-by-sa-3.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd-4.0"),
    ("## License\n\nThis project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.", "mit"),
    ("The code is released under the terms of the Apache License, Version 2.0 and\nnothing else", "apache-2.0"),
    ("Code is distributed under the BSD 3-Clause License.", "bsd-3-clause"),
    ("// SPDX-License-Identifier: GPL-2.0-only\n#include <x.h>", "gpl-2.0-only"),
    ("# SPDX-License-Identifier: Apache-2.0\nimport os", "apache-2.0"),
    ("/* SPDX-License-Identifier: MIT */\nint x;", "mit"),
    ("BSD 3-Clause License\n\nCopyright (c) 2020", "bsd-3-clause"),
    (HEADERS["gpl-2.0"] + "\n\n" + HEADERS["lgpl-2.1"], "lgpl-2.1 gpl-2.0"),
    ("We like free software. This program is free software. It is distributed in the hope that it will be useful.", ""),
    ("You must not use the name of MIT. The license of this program is under review. Permission denied. 2. Version 2", ""),
    ("This file is distributed under the same license as the package.", ""),
]


def test_licenses_as_they_are_found(spark):
    df = spark.createDataFrame([(i, f"{t}\n\nmore words here") for i, (t, _) in enumerate(FOUND)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert [(i, got[i].licenses) for i in range(len(FOUND))] == [(i, names) for i, (_, names) in enumerate(FOUND)]
    assert all(got[i].license == (names.split(" ")[0] or None) and (got[i].license_class is None) == (not names) for i, (_, names) in enumerate(FOUND))
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(map(key, con.sql(licenses.ORACLE).fetchall())) == sorted(map(key, got.values()))


def test_pipeline(spark, docs, sf_dir):
    """Every stage keeps the columns, and the last packs what the others kept."""
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf_dir)
        assert after.columns == docs.columns, name
        before = now
        now = corpus_pipeline.materialize(after, name)
        assert now.count() <= before.count()
    kept = {r.doc_id: r.text for r in now.collect()}
    assert 40 not in kept and 53 not in kept  # empty, and one that repeats itself
    assert 3 not in kept or (44 not in kept and 45 not in kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept)
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
