"""Every operator against a plain version of its rule, on all documents of the
smallest tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import queries
from fleetlens.llm.common import documents

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in documents(spark, SF).collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def crc_mod(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_quality_base_counts(spark, texts):
    got = rows(spark, "op6_quality_rules")
    assert len(got) == len(texts)
    for r in got:
        w = WORD.findall(texts[r["doc_id"]])
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in texts[r["doc_id"]].split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r["n_symbols"] == sum(texts[r["doc_id"]].count(x) for x in "#*$%&|<>")
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_quality_keeps_clean_and_drops_low_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in rows(spark, "op6_quality_rules") if r["doc_id"] in labels and not r["base_failed"]]
    assert all(kept for quality, kept in judged if quality == 1)
    assert not any(kept for quality, kept in judged if quality == 0)


def test_mix_reaches_targets(spark, texts):
    source = {r["doc_id"]: r["source"] for r in documents(spark, SF).collect()}
    got = rows(spark, "op3_pareto_mix")
    total = sum(len(WORD.findall(t)) for t in texts.values())
    by = collections.defaultdict(list)
    for r in got:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]])) and 0 <= r["taken"] <= 3 * r["size"]
        by[source[r["doc_id"]]].append(r)
    size = {s: sum(r["size"] for r in v) for s, v in by.items()}
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size))}
    target = {s: 0.0 for s in size}
    full: set = set()
    while True:  # share by weight, stop at the caps, share the excess again
        left = total - sum(3 * size[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in size if x not in full) for s in size if s not in full}
        over = {s for s, x in share.items() if x > 3 * size[s]}
        target = {**{s: 3.0 * size[s] for s in full}, **share}
        if not over:
            break
        full |= over
    for s, v in by.items():
        assert all(r["source_size"] == size[s] and math.isclose(r["target"], target[s], rel_tol=1e-9) for r in v)
        assert abs(sum(r["taken"] for r in v) - target[s]) <= 1
        whole = {r["taken"] // r["size"] for r in v if r["size"]}
        assert max(whole) - min(whole) <= 1  # certain copies for all, one more for the sampled
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows(spark, "op3_pareto_mix")))


def test_jaccard_components(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = rows(spark, "op4_ngram_jaccard")
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(sets[i]), find(i)) for i in ids}


def test_substring_dedup(spark, texts):
    seen, want = {}, {}
    for i in sorted(texts):
        w = texts[i].encode().split()
        gone = [False] * len(w)
        windows = [tuple(w[s : s + 50]) for s in range(len(w) - 49)]
        for s, x in enumerate(windows):
            if seen.get(x, i) < i:
                gone[s : s + 50] = [True] * 50
        for x in windows:
            seen.setdefault(x, i)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(spark, "op2_substring_dedup")} == want


def test_token_files_round_trip(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: tuple(r)[1:] for r in rows(spark, "op7_bit_planes")}
    for i in sorted(texts):
        ids = np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert got.pop(i) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_leaks_are_found_and_no_others(spark, texts):
    from fleetlens.llm.decontamination import LeakConfig, normalise

    cfg = LeakConfig()
    found = {(r["doc_id"], r["item_id"]) for r in rows(spark, "op8_decontamination")}
    items = {r["item_id"]: normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    step = np.arange(25_000)
    want = set()
    for i, t in texts.items():
        data = np.frombuffer(normalise(t), np.uint8)
        for item, text in items.items():
            if not text or not set(text[k : k + cfg.q] for k in range(len(text) - cfg.q + 1)) & set(data[k : k + cfg.q].tobytes() for k in range(len(data) - cfg.q + 1)):
                continue  # no common q-gram, so no alignment within the bound
            n = min(cfg.window, len(text))
            for s in sorted({*range(0, len(text) - n + 1, cfg.step), len(text) - n}):
                row = np.zeros(len(data) + 1, np.int64)
                for c in text[s : s + n]:
                    new = np.concatenate([[row[0] + 1], np.minimum(row[:-1] + (data != c), row[1:] + 1)])
                    row = np.minimum.accumulate(new - step[: len(new)]) + step[: len(new)]
                if row.min() <= cfg.edits * n // cfg.window:
                    want.add((i, item))
                    break
    assert found == want and found


def test_leaks_at_every_offset():
    from fleetlens.llm.decontamination import LeakConfig, build_index, find_leaks

    cfg, rng = LeakConfig(), np.random.default_rng(4)
    letters = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    item = letters(400)
    index = build_index([(7, letters(300)), (9, item), (11, letters(30))], cfg)
    for n in (64, 75, 80, 86):
        for at in range(0, 400 - n + 1):
            got = find_leaks([letters(200), letters(100) + item[at : at + n] + letters(100)], index, cfg)
            assert [(t, i, least) for t, i, _, least, _ in got] == [(1, 9, 0)]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.QUERIES["op1_toxicity"](spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (crc_mod(r["doc_id"], 3) == 1) for r in got)
    test = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in test if y == 0], [s for s, y in test if y == 1]
    assert np.mean([b > g for b in bad for g in good]) > 0.9
    assert np.mean([g >= 0.7 for g in good]) < 0.02


def test_toxicity_locates_the_sentence():
    from fleetlens.llm.toxicity import SentenceScorer, train

    clean = ["the sky is blue. we walk home.", "a good day today. see you soon.", "tea is ready. come in now."] * 6
    toxic = [c.replace(". ", ". you are a moron. ", 1) for c in clean]
    model = train([t.encode() for t in clean + toxic], np.array([0] * len(clean) + [1] * len(toxic)))
    log_clean = SentenceScorer(model).log_clean(b"a new text here. what a moron!\nit ends well.")
    assert len(log_clean) == 3 and np.argmin(log_clean) == 1 and -np.expm1(log_clean[1]) > 0.5 > -np.expm1(log_clean[0])


def test_lm_base_scores_and_model(spark, texts):
    words = {i: t.encode().lower().split() + [None] for i, t in texts.items()}
    count = collections.Counter(x for i, w in words.items() if crc_mod(i, 7) != 2 for x in w)
    n, v = sum(count.values()), len(count)
    got = rows(spark, "op10_lm_scores")
    assert len(got) == len(texts)
    for r in got:
        w = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc_mod(r["doc_id"], 7) == 2, len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r["score"] < 0


def test_lm_gradient_and_distribution():
    from fleetlens.llm.language_model import AttentionModel, LMConfig

    cfg = LMConfig(n_classes=5, n_fine=8, width=4, window=6, stride=4)
    rng = np.random.default_rng(1)
    p = rng.random((9, 5))
    model = AttentionModel(cfg, np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32))
    model.flat[:] = rng.standard_normal(model.flat.size) * 0.3
    before, target = rng.integers(0, 9, (3, 6)), rng.integers(0, 5, (3, 6))
    total = sum(np.exp(model.log_probs(before, np.full((3, 6), c), 0)) for c in range(5))
    assert np.allclose(total, 1, atol=1e-5)
    g = model.gradient(before, target)
    for k in rng.integers(0, model.flat.size, 25):
        x = model.flat[k]
        model.flat[k] = x + 1e-2
        up = -model.log_probs(before, target, 0).mean()
        model.flat[k] = x - 1e-2
        down = -model.log_probs(before, target, 0).mean()
        model.flat[k] = x
        assert abs((up - down) / 2e-2 - g[k]) < 2e-3
    # an id's probability does not depend on what follows
    other = before.copy()
    other[:, 4:] = 0
    assert np.allclose(model.log_probs(before, target, 0)[:, :4], model.log_probs(other, target, 0)[:, :4], atol=1e-5)


def test_lm_trains_on_every_id():
    import pyarrow as pa

    from fleetlens.llm.language_model import LMConfig, _training_windows

    cfg = LMConfig()
    fine = np.arange(cfg.n_ids) % cfg.n_fine
    texts = [np.arange(7, 7 + n, dtype="<u2") for n in (1, 23, 32, 33, 1000, 5000)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary())], ["ids"])
    seen = np.concatenate([np.frombuffer(w, "<i2").reshape(-1, cfg.window + 1)[:, 1:].ravel() for b in _training_windows(cfg, fine)([batch]) for w in b["w"].to_pylist()])
    assert seen[seen >= 0].tolist() == np.concatenate([fine[t] for t in texts]).tolist()


def test_token_counts(spark, texts):
    import public_tokenizers
    from fleetlens.llm.tokenize import PieceEncoder

    one = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    two = PieceEncoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    want: dict = collections.defaultdict(lambda: [0, 0])
    first: dict = {}
    for r in sorted(documents(spark, SF).collect(), key=lambda r: r["doc_id"]):
        if first.setdefault(r["text"], r["doc_id"]) == r["doc_id"]:
            enc, name = (one, "byte_bpe_50k") if r["lang"] == "en" else (two, "byte_bpe_multi_50k")
            w = want[(r["source"], r["lang"], name)]
            w[0], w[1] = w[0] + 1, w[1] + int(enc.encode([r["text"]])[1][0])
    assert {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in rows(spark, "op9_token_rollup")} == dict(want)


def test_license_rules(spark):
    from fleetlens.llm.licenses import license_scan

    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the X).\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    docs = spark.createDataFrame([(1, text), (2, "Released under the MIT License."), (3, "MIT is a school."), (4, None), (5, "Licensed under the Apache License, Version 2.0. Released under the MIT license.\nreleased under the  MIT licensE!")], "doc_id long, text string")
    got = {(r["doc_id"], r["license"], r["rule"], r["n_matches"]) for r in license_scan(docs).collect()}
    assert got == {(1, "MIT", "mit-short-grant", 1), (2, "MIT", "mit-notice", 1), (5, "Apache-2.0", "apache2-notice", 1), (5, "MIT", "mit-notice", 2)}


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT OR OTHERWISE.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one.\n"


def test_wrapped_license_texts(spark):
    from fleetlens.llm.licenses import license_scan

    want = {"mit-full": MIT, "apache2-header": APACHE, "gpl3-header": GPL3, "bsd2-full": BSD2 % "", "bsd3-full": BSD2 % BSD3, "mpl2-notice": MPL, "unlicense-notice": "This is free and unencumbered software released into the public\ndomain.\n", "all-rights-reserved": "All rights\nreserved."}
    docs = spark.createDataFrame(list(enumerate(want.values())), "doc_id long, text string")
    got = {(r["doc_id"], r["rule"], r["n_matches"]) for r in license_scan(docs).collect()}
    assert {(i, rule, 1) for i, rule in enumerate(want)} <= got
    # a blank line ends a sentence
    apart = spark.createDataFrame([(1, MPL.replace("Public\n", "Public\n\n"))], "doc_id long, text string")
    assert license_scan(apart).count() == 0


def test_every_notice_of_the_documents_is_reported(spark, texts):
    notices = {i: last for i, t in texts.items() if re.match(r"(licen[sc]ed|released) under\b", last := re.split(r"\n|(?<=[.!?]) (?=[A-Z])", t.strip())[-1], re.I)}
    assert notices and set(notices) <= {r["doc_id"] for r in rows(spark, "op5_license_scan")}


def test_license_families(spark):
    from fleetlens.llm.licenses import license_scan

    gpl2 = GPL3.replace("software:", "software;").replace("version 3", "version 2")
    lgpl = gpl2.replace("General Public", "Lesser General Public").replace("This program", "This library").replace("version 2", "version 2.1")
    isc = "ISC License\n\nCopyright (c) 2020\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\n"
    want = {"CC-BY-NC-4.0": "A text. Licensed under CC BY-NC 4.0.", "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.", "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-4.0": "Licensed under CC BY 4.0.", "GPL-2.0": gpl2, "GPL-3.0": GPL3, "LGPL-2.1": lgpl, "AGPL-3.0": GPL3.replace("General Public", "Affero General Public"), "ISC": isc}
    docs = spark.createDataFrame(list(enumerate(want.values())), "doc_id long, text string")
    got = license_scan(docs).collect()
    assert {(r["doc_id"], r["license"]) for r in got if r["rule"] != "isc-name"} == set(enumerate(want))


def test_pieces_give_the_librarys_ids():
    import public_tokenizers
    from fleetlens.llm.tokenize import PieceEncoder
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = ["", " ", "\n", "  a  b \n c", "a\nb\nc", "\n\nfoo\n  bar ", "a\t b  <|endoftext|> c", "x <|endoftext|>", "é è  z, q.", "a" * 3000, "it's  we'll I'm 's", "a  b  c", "foo.,bar foo,. foo", "中文 字, 字.", "x \r\n y", "a\x1cb \x85c"]
    encoder, tok = PieceEncoder(path), Tokenizer.from_file(path)
    for _ in range(2):
        flat, n = encoder.encode(odd)
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in odd]


def test_every_license_sentence_has_a_trigger(spark):
    """No known sentence is skipped by the prefilter, and each is found on its own."""
    from fleetlens.llm.licenses import SENTENCES, TRIGGERS, license_scan

    forms = [f.rstrip("* ") for forms in SENTENCES.values() for f in forms]
    assert all(any(t in f for t in TRIGGERS) for f in forms)
    notices = [f for i, forms in SENTENCES.items() if i.endswith("-notice") for f in (x.rstrip("* ") for x in forms)]
    df = spark.createDataFrame(list(enumerate(f"Some text.\n{f.capitalize()}.\nMore." for f in notices)), "doc_id long, text string")
    assert {r["doc_id"] for r in license_scan(df).collect()} == set(range(len(notices)))
