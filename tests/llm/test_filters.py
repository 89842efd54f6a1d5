import hashlib
import random
import re
from collections import Counter
from re import _parser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cedarlog.llm import decontaminate, fingerprints, html_extract, licenses, mixing, quality, toxicity
from cedarlog.llm import text as tx
from tests.llm import brute
from tests.llm.conftest import sentence


@pytest.fixture(scope="module")
def items(spark, messy):
    texts = [r["text"] for r in messy.filter("text is not null and doc_id between 10 and 20").collect()]
    rows = [(i, " ".join(brute.lower_words(t)[3:18]).upper()) for i, t in enumerate(texts)]
    rows += [(90, None), (91, ""), (92, "one"), (93, "!!!"), (None, "two"), (94, "not anywhere in the tables at all, never once, no"), (92, "one")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_decontamination_equals_brute_force(messy, items, limit):
    listed = [(r["item_id"], r["text"]) for r in items.collect()]
    want = Counter()
    for r in messy.collect():
        n, hit, found = brute.leaks(r["text"], listed)
        want[(r["doc_id"], n, hit, ",".join(found))] += 1
    got = Counter()
    for r in decontaminate.contamination(messy, items, max_broadcast_bytes=limit).collect():
        got[(r["_id"], r["n_words"], r["n_hit"], ",".join(r["items"]))] += r["copies"]
    assert got == want and any(k[2] for k in want)


def test_clean_documents_stay(messy, items):
    listed = [(r["item_id"], r["text"]) for r in items.collect()]
    clean = Counter(r["text"] for r in messy.collect() if not brute.leaks(r["text"], listed)[1])
    out = decontaminate.drop_contaminated(messy, items)
    assert out.columns == messy.columns
    assert Counter(r["text"] for r in out.collect()) == clean


def test_empty_benchmark_and_documents(spark, messy, empty, items):
    none = items.limit(0)
    assert decontaminate.contamination(messy, none).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.drop_contaminated(messy, none).count() == messy.count()


def test_mixing_meets_targets(spark, messy):
    rows = messy.collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(brute.SPACE.findall(r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute.fill(sizes, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)})
    out = mixing.mix_sizes(messy).collect()
    assert len(out) == len(rows)
    by_size = {}
    for r in out:
        by_size.setdefault(r["source_size"], []).append(r)
    for s, target in want.items():
        own = by_size[sizes[s]]
        assert own[0]["target"] == pytest.approx(target)
        largest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= max(largest, 1)
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    again = mixing.mix_sizes(messy.repartition(3)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    copies = mixing.mix_documents(messy).groupBy("row.text", "row.doc_id").agg(F.max("copy").alias("n")).collect()
    assert {(r["text"], r["doc_id"]): r["n"] for r in copies}
    assert sum(len(brute.SPACE.findall(r["row"]["text"] or "")) for r in mixing.mix_documents(messy).collect()) == sum(
        r["taken"] for r in out
    )


def test_documents_without_id_split_between_budgets(spark):
    rows = [(None if i % 2 else 7, f"{sentence(random.Random(i), 20 + i % 9)}", "ab"[i % 3 == 0]) for i in range(120)]
    out = mixing.mix_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for size in {r["source_size"] for r in out}:
        own = [r for r in out if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_larger_budgets_take_supersets(messy):
    few = {(r["id"], r["size"]): r["taken"] for r in mixing.mix_sizes(messy, share=0.3).collect()}
    many = {(r["id"], r["size"]): r["taken"] for r in mixing.mix_sizes(messy, share=0.6).collect()}
    assert all(many[k] >= few[k] for k in few) and sum(many.values()) > sum(few.values()) > 0


def test_mixing_of_nothing(empty, messy):
    assert mixing.mix_sizes(empty).count() == 0
    assert mixing.mix_documents(empty).count() == 0
    blank = messy.withColumn("text", F.lit(None).cast("string"))
    assert {r["taken"] for r in mixing.mix_sizes(blank).collect()} == {0}


def test_license_scan_equals_brute_force(messy):
    import random

    rng = random.Random(3)
    rows = [r["text"] for r in messy.collect()]
    parts = ["Under", "the", "MIT-License", "mit", "license", "Apache", "License,", "Version", "2.0", "CC", "BY-NC", "by", "nc", "and"]
    rows += [" ".join(rng.choice(parts) for _ in range(60)) for _ in range(40)]
    out = licenses.scan_batch(pa.array(rows, pa.string())).to_pylist()
    some = 0
    for text, got in zip(rows, out, strict=True):
        w, starts, labels = brute.lower_words(text), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += here
            labels |= {label} if here else set()
        some += bool(starts)
        assert (got["n_words"], got["n_base"]) == (len(w), len(starts))
        assert (got["first_word"], got["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert got["base_labels"] == ",".join(sorted(labels)) and labels <= set(got["labels"].split(","))
        assert 0 <= got["score"] <= 1
        for d in got["detections"]:
            assert 0 <= d["start"] < d["end"] <= len(w)
    assert some > 10


def sample(items, rng):
    """A text that the parsed pattern matches."""
    out = ""
    for op, arg in items:
        if op is _parser.LITERAL:
            out += chr(arg)
        elif op is _parser.NOT_LITERAL:
            out += rng.choice("kq7")
        elif op is _parser.IN:
            kind, a = rng.choice(arg)
            out += {"LITERAL": lambda: chr(a), "RANGE": lambda: chr(rng.randint(*a)), "CATEGORY": lambda: rng.choice("az19")}[str(kind)]()
        elif op is _parser.BRANCH:
            out += sample(rng.choice(arg[1]), rng)
        elif op is _parser.SUBPATTERN:
            out += sample(arg[-1], rng)
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            out += "".join(sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3))))
        else:
            assert op in (_parser.ASSERT, _parser.ASSERT_NOT)
    return out


def matches(rng):
    """Normalised texts by rule: three matches of each, between other words."""
    for rule in licenses.rules():
        for _ in range(3):
            # Normalised texts hold no plus sign.
            text = f" so {sample(_parser.parse(rule.pattern.pattern.decode()), rng)} it ".replace("+", "")
            assert rule.pattern.search(text.encode()), (rule.name, text)
            yield rule, text


def ungated(words):
    found = []
    for rule in licenses.rules():
        for m in rule.pattern.finditer(words):
            start = words.count(b" ", 0, m.start()) - 1
            found.append(licenses.Found(start, start + m.group().count(b" ") + 1, rule.label, rule.name, rule.score, rule.priority))
    return licenses.resolve(found)


def test_license_gates_lose_no_match():
    for rule, text in matches(random.Random(5)):
        assert licenses.scan(text.encode()) == ungated(text.encode()) != [], (rule.name, text)
    for text in ("Licensed under the GPLv3", "licensed under GPL v3", "SPDX-License-Identifier: BUSL-1.1",
                 "license: Creative Commons Attribution-NonCommercial-ShareAlike"):
        assert licenses.scan_batch(pa.array([text])).to_pylist()[0]["labels"], text


def test_no_text_with_a_license_is_passed_over():
    made = list(matches(random.Random(6)))
    out = licenses.scan_batch(pa.array([text for _, text in made])).to_pylist()
    for (rule, text), row in zip(made, out, strict=True):
        got = [(d["start"], d["end"], d["label"], d["rule"]) for d in row["detections"]]
        assert got == [(f.start, f.end, f.label, f.rule) for f in ungated(text.encode())] != [], (rule.name, text)
    texts = ["Released under MPL-2.0", "EPL-2.0", "EUPL 1.2", "CC0 1.0", "0BSD", "released under the MIT", "distributed under ISC",
             "mozilla.org/MPL/2.0", "eclipse.org/legal/epl-2.0", "scripts.sil.org/OFL", "wtfpl.net"]
    for text, row in zip(texts, licenses.scan_batch(pa.array(texts)).to_pylist(), strict=True):
        assert row["labels"] and row["score"] > 0, text


def test_license_rules():
    def of(text):
        return [(d["label"], d["rule"].split("/")[1]) for d in licenses.scan_batch(pa.array([text])).to_pylist()[0]["detections"]]

    assert of("SPDX-License-Identifier: GPL-3.0-or-later") == [("gpl-3.0", "tag")]
    assert of("Licensed under the Apache License, Version 2.0.") == [("apache-2", "grant")]
    assert of("This work is licensed under the GNU General Public License, version 3.") == [("gpl-3.0", "grant")]
    assert of("see https://opensource.org/licenses/MIT for the license") == [("mit", "address")]
    assert of("BSD 3-Clause License, then Mozilla Public 2.0 License") == [("bsd-3-clause", "title"), ("mpl-2.0", "title")]
    assert of("er kam mit der Bahn") == []
    assert len(licenses.rules()) > 250
    kept = licenses.resolve([licenses.Found(0, 9, "a", "a", 1, 2), licenses.Found(2, 5, "b", "b", 1, 1), licenses.Found(8, 12, "c", "c", 1, 1)])
    assert [f.label for f in kept] == ["a", "c"]


#: Texts with the labels they must get: bodies, notices, names, and traps.
LICENSED = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal", "mit"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    ("MIT License\n\nCopyright (c) 2020 Jo", "mit"), ("Use of this source code is governed by an MIT-style license", "mit"), ("released under the MIT", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
    ("Neither the name of the Harbour Board nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement:", "bsd-4-clause"),
    ("BSD-3-Clause", "bsd-3-clause"), ("the 2-clause BSD license", "bsd-2-clause"), ("BSD-style license", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. The software is provided", "0bsd"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "zlib"),
    ("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "zlib"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache-2"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "apache-2"),
    ("You must cause any modified files to carry prominent notices stating that You changed the files", "apache-2"),
    ("Redistributed with products derived from this software may not be called \"Apache\", nor may \"Apache\" appear in their name", "apache-1.1"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2.0"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3.0"),
    ("The GNU General Public License is a free, copyleft license for software and other kinds of works.", "gpl-3.0"),
    ("You should have received a copy of the GNU General Public License along with this program.", "gpl"),
    ("GPL", "gpl"), ("GNU GPL", "gpl"), ("LGPL", "lgpl"), ("AGPL", "agpl"), ("licensed under the GPL", "gpl"), ("GPLv3", "gpl-3.0"), ("GPL version 2", "gpl-2.0"),
    ("GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl-2.1"),
    ("You should have received a copy of the GNU Affero General Public License along with this program", "agpl"),
    ("Your modified version must prominently offer all users interacting with it remotely through a computer network", "agpl-3.0"),
    ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "gfdl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("The contents of this file are subject to the Mozilla Public License Version 1.1", "mpl-1.1"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "epl-1.0"),
    ("The contents of this file are subject to the terms of the Common Development and Distribution License", "cddl-1.0"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost-1.0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("To the extent possible under law, Ada of Harbour has waived all copyright and related or neighboring rights to this work.", "cc0-1.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "cc-by-sa"),
    ("CC BY-NC-ND 4.0", "cc-by-nc,cc-by-nc-nd"), ("You may not use the material for commercial purposes.", "cc-by-nc"),
    ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", "wtfpl"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl-1.1"),
    ("This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit", "openssl"),
    ("This file has been placed in the public domain.", "public-domain"),
    ("All rights reserved. No part of this publication may be reproduced", "proprietary"),
    ("licensed under the Vim license", "vim"), ("the zlib license", "zlib"),
    # Traps: other words, other tongues, other things.
    ("Licence mit Auflagen", ""), ("er kam mit der Lizenz", ""), ("vim license", ""), ("the zlib license plate", ""), ("the MIT campus", ""), ("a ruby and a curl", ""),
    ("the general public was there", ""), ("my driving license is at the office", ""), ("unicode license key", ""), ("Permission is hereby granted to enter", ""),
    ("the software is provided as is", ""), ("apache helicopters", ""), ("", ""), ("free of charge for any person", ""),
]


def test_license_texts_get_their_labels():
    assert len(LICENSED) >= 60
    got = licenses.scan_batch(pa.array([t for t, _ in LICENSED])).to_pylist()
    wrong = [(t, want, row["labels"]) for (t, want), row in zip(LICENSED, got, strict=True) if row["labels"] != want]
    assert not wrong, wrong
    from cedarlog.llm.license_texts import passages

    assert len(passages()) >= 120
    # Inside a long document, between other words, they are found at their place.
    body = "lorem ipsum dolor " * 2_000 + LICENSED[0][0] + " sit amet" * 2_000
    (found,) = licenses.scan_batch(pa.array([body])).to_pylist()
    assert found["labels"] == "mit" and found["detections"][0]["start"] == 6_000


def test_license_scan_on_spark(spark, empty):
    docs = spark.createDataFrame([(1, LICENSED[0][0], "x"), (2, None, None), (3, "", "y"), (1, LICENSED[0][0], "x")], "doc_id long, text string, license string")
    out = licenses.scan_documents(docs.repartition(3))
    assert out.columns == ["doc_id", "text", "license", "_license"]
    assert sorted((r.doc_id, r._license.labels, r._license.n_words) for r in out.collect()) == [(1, "mit", 24), (1, "mit", 24), (2, "", 0), (3, "", 0)]
    assert licenses.scan_documents(empty).count() == 0


def test_fingerprints_equal_brute_force(spark, messy):
    for docs in (messy, messy.limit(1), messy.coalesce(1)):
        rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").collect()
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        texts = [r["text"] or "" for r in rows]
        want = Counter()
        for i, r in enumerate(rows):
            new = fingerprints.edit(texts[i], texts[(i + 1) % len(texts)])
            want[(r["doc_id"], len(texts[i]), hashlib.sha256(new.encode()).hexdigest())] += 1
        out = fingerprints.with_next(docs, fingerprints.lexicon(docs, max_share=0.5)).collect()
        assert Counter((r["id"], r["n_chars"], r["edited_sha256"]) for r in out) == want
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)


def _likeness_by_hand(a, b, parts):
    """Share of the lexicon parts in which two sets of terms agree, among those in which either has one."""
    if a == b:
        return 1.0
    held = [(a & p, b & p) for p in parts if (a | b) & p]
    return sum(x == y for x, y in held) / len(held) if held else 0.0


def test_near_documents_equal_brute_force(spark, messy, monkeypatch):
    """Terms, lexicon, parts and likeness word by word; ranges of few documents."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 4_000)
    docs = messy.filter("text is not null").dropDuplicates(["doc_id"]).filter("doc_id is not null")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()))
    held = Counter(t for _, text in rows for t in set(brute.lower_words(text)))
    low, high = fingerprints.MIN_SHARE * len(rows), 0.5 * len(rows)
    lexicon = sorted(w for w, n in held.items() if low <= n <= high)
    number = {w: int(tx.hash_runs(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]) for w in lexicon}
    terms = fingerprints.lexicon(docs, max_share=0.5)
    assert sorted(number.values()) == terms.tolist()
    masks = dict(zip(terms.tolist(), fingerprints.subset_masks(terms).tolist(), strict=True))
    parts = [{w for w in lexicon if masks[number[w]] >> k & 1} for k in range(fingerprints.SUBSETS)]
    assert sum(map(bool, parts)) > 20
    of = lambda text: frozenset(brute.lower_words(text)) & set(lexicon)
    got = {r["id"]: r for r in fingerprints.with_next(docs, terms).collect()}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = fingerprints.edit(text, following)
        for other, column in ((edited, "near_edited"), (following, "near_next")):
            if of(text) or of(other) or text == other:
                want = _likeness_by_hand(of(text), of(other), parts)
                assert got[i][column] == pytest.approx(want, abs=1e-9), (i, column)
        assert (got[i]["fingerprint"][:16] == got[i]["edited_fingerprint"][:16]) == (of(text) == of(edited) if of(text) or of(edited) else text == edited)


def test_fingerprint_likeness(spark, messy):
    terms = fingerprints.lexicon(messy, max_share=0.9)
    masks = fingerprints.subset_masks(terms)
    base = messy.filter("doc_id = 50").first()["text"]
    upper = "".join(c.upper() if c.isascii() else c for c in base)
    texts = [base, upper, base + " changed", "x y z", None, "", base]
    whole, parts = fingerprints.fingerprint(pa.array(texts, pa.string()), terms, masks)
    like = fingerprints.likeness((whole[[0] * 7], parts[[0] * 7]), (whole, parts))
    assert like[0] == like[1] == like[6] == 1 > like[2] > 0 == like[3] == like[4]
    assert whole[4] == whole[5] and fingerprints.likeness((whole[4:5], parts[4:5]), (whole[5:6], parts[5:6]))[0] == 1
    names = fingerprints.as_texts(whole, parts)
    assert names[0] == names[6] and len(set(map(len, names))) == 1
    # The lexicon: a term counts once for each document that holds it.
    held = Counter(t for r in messy.collect() for t in set(brute.lower_words(r["text"])))
    n = messy.count()
    assert len(terms) == sum(0.001 * n <= c <= 0.9 * n for c in held.values())


def test_fingerprints_of_nothing(empty):
    assert fingerprints.with_next(empty, fingerprints.lexicon(empty)).count() == 0


TOXIC = [("The weather was fine today. You are a zorp and a blarg! We went home.", 1), ("The weather was fine. We went home today.", 0)]


def _sample(spark, texts, labels):
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, labels, strict=True))], "doc_id long, text string, y int")


def test_toxicity_learns_and_locates(spark):
    import random

    rng = random.Random(2)
    from tests.llm.conftest import sentence

    texts, labels = [], []
    for i in range(300):
        parts = [sentence(rng, 8) for _ in range(6)]
        if i % 5 == 0:
            parts[3] += " zorp blarg"
        texts.append(". ".join(parts) + ".")
        labels.append(int(i % 5 == 0))
    model = toxicity.fit(_sample(spark, texts, labels).repartition(7))
    other = toxicity.fit(_sample(spark, texts, labels).repartition(2))
    assert (model.weights == other.weights).all() and model.bias == other.bias
    _noisy_or_by_hand(model, texts[:40] + ["zorp! blarg? zorpling.\nNo", "ZORP", "...", "é zorp é"])
    out = toxicity.score_batch(model, pa.array([TOXIC[0][0], TOXIC[1][0], None, "", "...", TOXIC[0][0]]), 0.5).to_pylist()
    assert out[0]["score"] > 0.9 and out[0] == out[5] and all(o["score"] < 0.1 for o in out[1:5])
    (part,) = out[0]["sentences"]
    assert TOXIC[0][0].encode()[part["start"] : part["start"] + part["length"]].strip() == b"You are a zorp and a blarg"
    nothing = toxicity.fit(_sample(spark, [], []))
    assert len(toxicity.score_batch(nothing, pa.array([], pa.string()))) == 0
    three = pa.array(["You zorp.", "", None])
    assert toxicity.score_batch(toxicity.fit(_sample(spark, texts[:3], [1, 1, 1])), three).to_pylist() == [1.0] * 3
    assert toxicity.score_batch(toxicity.fit(_sample(spark, texts[:3], [0, 0, 0])), three).to_pylist() == [0.0] * 3


def _noisy_or_by_hand(model, texts):
    """Sentence by sentence and word by word in plain Python, with the hash of one word at a time."""
    import math
    import re

    def feature(word, n=None):
        raw = word.encode()
        raw = raw if n is None else raw[:n]
        h = tx.hash_runs(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
        return int((h if n is None else tx.mix(h ^ np.uint64(n)))[0] >> np.uint64(64 - toxicity.BITS))

    for text, got in zip(texts, toxicity.score_batch(model, pa.array(texts, pa.string())).to_pylist(), strict=True):
        clean = 1.0
        for part in re.split("[.!?\n\r]", text):
            held = [model.weights[feature(w, n)] for w in brute.lower_words(part) for n in (None, *toxicity.PREFIXES)]
            if any(held):
                clean *= 1 - 1 / (1 + math.exp(-(sum(held) + model.bias)))
        assert got == pytest.approx(1 - clean, abs=1e-9), text


def _accuracy(spark, sf, train, score, held_out, label):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = train(docs, labels)
    rows = docs.filter(held_out).join(labels, "doc_id").select(label, score(docs, model)(F.col("text")).alias("s"))
    return [(r[0], r["s"]) for r in rows.collect()]


def test_toxicity_held_out(spark):
    rows = _accuracy(spark, "/root/testdata/sf0.1", toxicity.train, toxicity.scorer, toxicity.held_out(), "toxic")
    caught = [s >= 0.3 for y, s in rows if y]
    wrong = [s >= 0.3 for y, s in rows if not y]
    assert sum(caught) / len(caught) > 0.8 and sum(wrong) / len(wrong) < 0.03


def test_quality_held_out(spark):
    rows = _accuracy(spark, "/root/testdata/sf0.1", quality.train, quality.scorer, quality.held_out(), "quality")
    kept = [s >= 0.3 for y, s in rows if y]
    caught = [s < 0.3 for y, s in rows if not y]
    assert sum(kept) / len(kept) > 0.98 and sum(caught) / len(caught) > 0.8


def test_classifiers_on_messy_tables(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, None), (1, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    for module, score in ((toxicity, toxicity.score_documents), (quality, quality.score_documents)):
        model = module.train(messy, labels)
        out = score(messy, model)
        assert out.count() == messy.count()
        assert 0 <= out.agg(F.min(out.columns[-1])).first()[0] <= out.agg(F.max(out.columns[-1])).first()[0] <= 1
        assert score(empty, module.train(empty, labels)).count() == 0
        assert module.train(messy, labels.limit(0)) is not None
    assert toxicity.score_documents(messy, toxicity.fit(_sample(spark, [], []))).columns[-1] == "_toxicity"


def test_quality_equals_a_naive_convolution():
    """Byte by byte, filter by filter in plain Python: chunks, filters, rectifier, maximum, mean, logistic unit."""
    import math

    rng = np.random.default_rng(4)
    model = quality.Model(rng.normal(0, 0.3, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(0, 0.1, quality.FILTERS), rng.normal(0, 1, quality.FILTERS), 0.2)
    texts = ["", None, "a", "eight by", "ü" * 300, "x" * 511, "y" * 512, "z" * 513, "The quick brown fox. " * 120, "#$% " * 400]
    for text, got in zip(texts, quality.score_batch(model, model.pairs(), pa.array(texts, pa.string())).to_pylist(), strict=True):
        raw, step = (text or "").encode(), quality.CHUNK - quality.OVERLAP
        count = max(1, -(-(len(raw) - quality.OVERLAP) // step))
        total = [0.0] * quality.FILTERS
        for c in range(count):
            chunk = raw[c * step : c * step + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            for f in range(quality.FILTERS):
                best = max(sum(float(model.filters[j, chunk[p + j], f]) for j in range(quality.WIDTH)) for p in range(0, quality.CHUNK - quality.WIDTH + 1, 2))
                total[f] += max(best + float(model.bias[f]), 0.0)
        z = sum(t / count * float(w) for t, w in zip(total, model.weights, strict=True)) + model.offset
        assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5), text


def test_quality_covers_whole_texts():
    good, bad = "a quiet text of plain words. " * 60, "### $$$ %%% !!! " * 60
    model = quality.fit([good[i:] for i in range(40)] + [bad[i:] for i in range(40)], [1] * 40 + [0] * 40)
    table = model.pairs()

    def score(*texts):
        return quality.score_batch(model, table, pa.array(texts, pa.string())).to_pylist()

    first, last, empty, none = score(good, bad, "", None)
    assert first > 0.9 and last < 0.1 and empty == none
    # What stands at the end of a long text counts as well.
    assert score(good * 10 + bad * 10)[0] < score(good * 20)[0]
    assert score(good * 3, good)[0] == score(good * 3)[0]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href=/x>News</a></li></ul></nav><div class='ad'>Buy now, it is cheap.</div>
<article><h1>Fish &amp; chips</h1><p>First   line\n of the&nbsp;text with <b>bold</b> words and more of it.<br>Next line here.
<p>Second paragraph &lt;b&gt; with 3 < 4 in it and some more words.</p><!-- <p>hidden</p> --><ul><li>An item of a list, with words.</li></ul></article>
<section id="comments"><div class="comment"><p>I do not agree with this at all, dear writer.</p></div></section>
<form><p>Write to us about this page today.</p></form><footer>&copy; me &middot; All rights.</footer>"""


def test_extraction(spark):
    field = html_extract.fit(html_extract.labelled_pages())
    assert html_extract.main_text(PAGE, field) == (
        "Fish & chips\n\nFirst line of the text with bold words and more of it. Next line here.\n\n"
        "Second paragraph <b> with 3 < 4 in it and some more words.\n\nAn item of a list, with words."
    )
    assert [html_extract.main_text(p, field) for p in (None, "", "<", "<p", "<script>x", "</p></div>")] == [""] * 2 + [
        html_extract.main_text(p, field) for p in ("<", "<p", "<script>x", "</p></div>")
    ]
    fresh_pages = html_extract.labelled_pages(80, seed=5)
    right = total = 0
    for page, labels in fresh_pages:
        found = html_extract.blocks(page)
        kept = html_extract.decode(field.scores(found), field.transitions)
        right, total = right + sum(a == b for a, b in zip(kept, labels, strict=True)), total + len(labels)
    assert right / total > 0.97
    pages = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (None, None, None)], "page_id long, html string, main_text string")
    out = html_extract.extract(pages, field)
    assert out.columns == ["page_id", "html", "main_text", "_main_text"]
    assert out.filter("_main_text = ''").count() == 1 and out.count() == 3


#: Layouts written for this test alone: parts that are not the article, and what the article is made of.
ELSEWHERE = (
    '<div class="l-masthead"><a href="/">{s}</a><span>{s}</span></div>', '<div id="page__kopfzeile"><p>{t}</p></div>', '<nav class="primary"><a href="/1">{s}</a> | <a href="/2">{s}</a></nav>',
    '<div class="c-fusszeile"><p>{t}</p></div>', '<div id="sitefooter-legal"><p>{t}</p></div>', '<aside class="rail"><p>{t}</p><p>{t}</p></aside>', '<div class="l-sidebar-right"><h5>{s}</h5><p>{t}</p></div>',
    '<div class="adslot-top"><p>{t}</p></div>', '<div class="sponsored-post"><p>{t}</p></div>', '<div class="cookiebar"><p>{t}</p><button>{s}</button></div>', '<div class="post-comments-area"><ul><li><p>{t}</p></li><li><p>{t}</p></li></ul></div>',
    '<section id="user-comments"><h4>{s}</h4><article><p>{t}</p></article></section>', '<form class="mailing"><p>{t}</p><label>{s}</label><select><option>{s}</option></select><button>{s}</button></form>',
    '<div class="newsletter-box"><p>{t}</p></div>', '<div class="social-links"><a href="/f">{s}</a> <a href="/g">{s}</a></div>', '<footer class="colophon"><p>{t}</p></footer>', '<div role="banner"><p>{s}</p></div>',
    '<div class="related-articles"><a href="/r">{s}</a><a href="/q">{s}</a></div>', '<script>var x = "{s}";</script>', '<style>.a {{ color: red }}</style>', '<!-- {t} -->', '<noscript><p>{t}</p></noscript>',
)
ARTICLE = ("<h1>{s}</h1>", "<p>{t}</p>", "<p>{t}</p>", "<p>{t}</p>", "<h2>{s}</h2><p>{t}</p>", "<ul><li>{t}</li><li>{t}</li></ul>", "<blockquote>{t}</blockquote>", "<p>{t}<br>{t}</p>", "<p>{s} <em>{t}</em> <a href='/z'>{s}</a> {t}</p>", "<div>{t}</div>")
AROUND = ("<article>{m}</article>", "<main><article>{m}</article></main>", "<div class='post-body'>{m}</div>", "<main><div class='story-text'>{m}</div></main>", "<div id='main-content'><section>{m}</section></div>")


def _written_pages(n, seed):
    """Pages with the texts of their articles; a third of what is not article stands inside it."""
    rng = random.Random(seed)
    for _ in range(n):
        mine = []

        def fill(part, kept):
            def one(m):
                text = sentence(rng, rng.randint(1, 5) if m[1] == "s" else rng.randint(12, 50)).capitalize() + ("" if m[1] == "s" else ".")
                if kept:
                    mine.append(text)
                return text

            return re.sub(r"\{([st])\}", one, part).replace("{{", "{").replace("}}", "}")  # noqa: B023

        body = [("<h1>{s}</h1>", True)] + [(rng.choice(ARTICLE), True) for _ in range(rng.randint(3, 8))]
        for _ in range(rng.randint(0, 3)):
            body.insert(rng.randint(1, len(body)), (rng.choice(ELSEWHERE), False))
        top = "".join(fill(rng.choice(ELSEWHERE), False) for _ in range(rng.randint(1, 4)))
        middle = rng.choice(AROUND).replace("{m}", "".join(fill(p, k) for p, k in body))
        yield f"<html><head><title>{sentence(rng, 3)}</title></head><body>{top}{middle}{''.join(fill(rng.choice(ELSEWHERE), False) for _ in range(3))}</body></html>", mine


@pytest.fixture(scope="module")
def fitted_field():
    return html_extract.fit(html_extract.labelled_pages())


def test_pages_that_no_snippet_resembles(fitted_field):
    right = total = whole = 0
    for page, mine in _written_pages(80, 3):
        found = html_extract.blocks(page)
        kept = html_extract.decode(fitted_field.scores(found), fitted_field.transitions)
        truth = [any(t in b.text for t in mine) for b in found]
        right, total = right + sum(a == b for a, b in zip(kept, truth, strict=True)), total + len(truth)
        whole += kept == truth
    assert right / total >= 0.95 and whole >= 50, (right / total, whole)


@pytest.mark.parametrize("inner", [
    "<aside><p>See also <a href='/x'>this teaser of ours</a></p></aside>", "<form><label>Mail</label><p>Write to us about this page today.</p><button>Send it</button></form>",
    '<section class="comments"><div><p>I do not agree with this at all, dear writer.</p></div></section>', '<div class="ad"><p>Buy now, it is cheap and good.</p></div>', "<button>Share</button>",
    "<footer><p>All rights are with the house of this paper.</p></footer>", "<![CDATA[b>c]]>", "<select><option>One</option><option>Two</option></select>", "<!-- gone --><script>x</script>",
])
def test_nothing_but_the_article_is_left_inside_it(fitted_field, inner):
    page = ("<html><body><nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>First paragraph of the text, long enough to be read as one.</p>"
            f"{inner}<p>Second paragraph of the text, long enough to be read as one.</p></article><footer>x</footer></body></html>")
    assert html_extract.main_text(page, fitted_field) == (
        "Title\n\nFirst paragraph of the text, long enough to be read as one.\n\nSecond paragraph of the text, long enough to be read as one.")


def test_extraction_of_nothing_and_of_a_very_long_page(spark, fitted_field):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, html string, main_text string"), fitted_field).count() == 0
    text = "This is one more sentence of a very long paragraph in the article. " * 40
    page = "<article>" + f"<p>{text}</p>" * 2_000 + "</article>"
    assert len(page) > 5_000_000
    (row,) = html_extract.extract(spark.createDataFrame([(page,)], "html string"), fitted_field).collect()
    assert row.main_text == "\n\n".join([text.strip()] * 2_000)


def test_viterbi_equals_all_sequences():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for n in range(1, 9):
        scores, t = list(rng.normal(0, 2, n)), rng.normal(0, 1, (2, 2))
        value = lambda y: sum(s for s, on in zip(scores, y) if on) + sum(t[a, b] for a, b in zip(y, y[1:]))  # noqa: B023,E731
        best = max(itertools.product([0, 1], repeat=n), key=value)
        assert [int(x) for x in html_extract.decode(scores, t)] == list(best)
    assert html_extract.decode([], np.zeros((2, 2))) == []
