"""Licence scans, toxicity, quality rules, decontamination, language and quality classifiers."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from locuslake.llm import decontaminate, langid, licenses, ordinal, quality_rules, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    for sf in (SF, "/root/testdata/sf0.01"):
        assert compare(queries.QUERIES[name](spark, sf), sf, queries.ORACLES[name]) == ""


def test_license_rules(spark, odd, empty):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software. The above copyright notice and this permission notice shall be included.\n# THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\n# IMPLIED.'
    texts = [mit, "Text.\nReleased under the MIT License.\nMore.", "Licensed under the Apache License, Version 2.0.", "My own license terms apply.", "Nothing here."]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licenses"] for r in got] == ["MIT", "MIT", "Apache-2.0", "NONE", "NONE"]
    assert got[0]["sentence_ids"] == "mitGrant mitNotice mitWarranty" and [r["n_unknown"] for r in got] == [0, 0, 0, 1, 0]
    assert licenses.scan(odd).count() == 11 and licenses.scan(empty).count() == 0


MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
BSD2 = """Copyright (c) 2020, Some Body

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED."""
BSD3 = BSD2.replace("THIS SOFTWARE", """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE""")
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.

You should have received a copy of the GNU General Public License
along with this program."""


def test_whole_license_texts(spark):
    cc = ["Released under CC BY 4.0.", "Released under Creative Commons Attribution 4.0.", "Released under CC BY-NC 4.0.", "This work is released under a\nCreative Commons\nAttribution-ShareAlike 4.0 International text."]
    other = ["This is distributed under the\nMIT License.", "A is licensed under the MIT License\nB is licensed under the Apache License, Version 2.0", "A is under no terms\nCopyright (c) 2020 Some Body\nAll rights reserved."]
    whole = [MIT, BSD2, BSD3, APACHE, GPL]
    names = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0"]
    marked = ["\n".join(f" * {line}".rstrip() for line in x.split("\n")) for x in whole]
    texts = [*whole, *[x.upper() for x in whole], *marked, *[x.replace("\n", "\r\n") for x in whole], *cc, *other]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licenses"] for r in got] == names * 4 + ["CC-BY-4.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "MIT", "Apache-2.0 AND MIT", "All-Rights-Reserved"]
    assert [r["sentence_ids"].replace("copyright ", "").replace("unknown", "").split() for r in got[:5]] == [r["sentence_ids"].replace("copyright ", "").replace("unknown", "").split() for r in got[5:10]]


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely."""
UNLICENSE = """In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0."""


def test_choices_denials_titles_and_expressions(spark):
    cases = {
        "Licensed under the MIT license or the Apache License, Version 2.0.": "Apache-2.0 OR MIT",
        "Licensed under either of the Apache License, Version 2.0 or the MIT license at your option.": "Apache-2.0 OR MIT",
        "This is not licensed under the MIT license.": "NONE", "It is no longer distributed under the Apache License, Version 2.0.": "NONE",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0 OR MIT", "// SPDX-License-Identifier: (Apache-2.0 OR MIT)": "Apache-2.0 OR MIT",
        "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0 WITH Classpath-exception-2.0", "SPDX-License-Identifier: MIT": "MIT",
        "Licensed under MIT.": "MIT", "This project is MIT licensed.": "MIT", "MIT License": "MIT", "The MIT License (MIT)": "MIT",
        "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS": "Apache-2.0",
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Some Foundation\n Everyone is permitted to copy": "GPL-3.0",
        GPL.replace("version 3", "version 2"): "GPL-2.0", GPL.replace("either version 3 of the License, or\n(at your option) any later version", "as given elsewhere"): "GPL",
    }
    got = licenses.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    assert {list(cases)[r["doc_id"]]: r["licenses"] for r in got} == cases


def test_licenses_against_containment(spark):
    """Whole texts put together at random, wrapped anew, marked and in capitals; what is found must be what was put in."""
    import textwrap

    r = random.Random(12)
    whole = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "GPL-3.0": GPL, "ISC": ISC, "Zlib": ZLIB, "Unlicense": UNLICENSE, "MPL-2.0": MPL}
    plain = lambda x: "".join(c if c.isalnum() else " " for c in x.lower()).split()
    texts = []
    for _ in range(120):
        parts = [whole[k] for k in r.sample(sorted(whole), r.randrange(4))] + ["The river is wide. It runs to the sea."] * r.randrange(3)
        r.shuffle(parts)
        width = r.choice([40, 60, 72, 100])
        anew = ["\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in x.split("\n\n")) for x in parts]
        text = "\n\n".join(anew)
        mark = r.choice(["", "# ", " * ", "// "])
        text = "\n".join(mark + line for line in text.split("\n"))
        texts.append(text.upper() if r.random() < 0.3 else text)
    got = {x["doc_id"]: x["licenses"] for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        words = " ".join(plain(text))
        found = sorted(name for name, x in whole.items() if " ".join(plain(x)) in words)
        assert got[k] == (" AND ".join(found) or "NONE"), text


def test_what_is_matched_leaves_a_gap(spark):
    """The parts around a matched run are no run of their own."""
    grant, copy, warranty = "Licensed under the Apache License, Version 2.0 (the License).", "You may obtain a copy of the License at home.", "Unless required by applicable law or agreed to in writing, software is sold."
    mit = MIT.split("\n", 2)[2]
    text = "\n\n".join([BSD2.split("2. Redis")[0], mit, "2. Redis" + BSD2.split("2. Redis")[1]])
    got = licenses.scan(spark.createDataFrame([(1, text), (2, f"{copy}\n\n{mit}\n\n{warranty}"), (3, grant)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x["licenses"] for x in got] == ["MIT", "MIT", "Apache-2.0"]


def test_identifier_lines_and_references(spark):
    lines = {
        "// SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "This is released under the Boost Software License.": "BSL-1.0",
        "Released under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "Licensed under the terms of the ISC License.": "ISC", "It is dedicated under CC0.": "NONE", "Licensed under CC0.": "CC0-1.0",
    }
    got = licenses.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x["licenses"] for x in got][:5] == list(lines.values())[:5] and got[6]["licenses"] == "CC0-1.0"


def test_toxicity_learns_from_positives_and_unlabelled(spark, odd, empty):
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join([word() for _ in range(60)] + (["zzznasty", "yyybad"] if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.drop("toxic"), df.filter("doc_id < 300").select("doc_id", F.col("toxic")))
    got = toxicity.score_documents(df, model).join(df, "doc_id").filter("doc_id >= 300")
    assert got.filter("predicted <> toxic").count() == 0
    odd_scores = toxicity.score_documents(odd, model).collect()
    assert len(odd_scores) == 11 and all(0 <= x["score"] <= 1 for x in odd_scores)
    assert toxicity.score_documents(empty, model).count() == 0
    none = toxicity.learn(df, df.select("doc_id", "toxic").limit(0))
    assert toxicity.score_documents(df, none).filter("predicted = 1").count() == 0


def test_non_negative_risk_falls():
    """The fitted scorer has a lower non-negative risk than the constant one."""
    pos, unl = [np.array([1])] * 20, [np.array([1])] * 10 + [np.array([2])] * 40
    m = toxicity.fit(pos, unl, np.array([1]), 0.2)
    g = lambda f: m.bias + m.weights.get(f, 0.0)
    loss = lambda z: np.logaddexp(0, -z)
    risk = lambda a, b: 0.2 * loss(a) + max(0.0, (10 * loss(-a) + 40 * loss(-b)) / 50 - 0.2 * loss(-a))
    assert risk(g(1), g(2)) < risk(m.bias, m.bias) and g(1) > 0 > g(2)


def test_risk_gradient_against_differences():
    r = np.random.default_rng(0)
    rows = lambda n: [np.sort(r.choice(6, r.integers(0, 5), replace=False)) for _ in range(n)]
    pos, unl = rows(7), rows(11)
    pos[0] = pos[1] = np.array([0])
    signs = set()
    for seed in range(6):
        w, b, prior = np.random.default_rng(seed).normal(0, 2, 6), 0.3 * seed - 1, 0.2 + 0.15 * seed

        def risks(x, prior=prior):
            g = lambda row: sum(x[k] for k in row) + x[6]
            positive = prior * np.mean([np.log1p(np.exp(-g(row))) for row in pos])
            return positive, np.mean([np.log1p(np.exp(g(row))) for row in unl]) - prior * np.mean([np.log1p(np.exp(g(row))) for row in pos])

        positive, negative, gradient = toxicity.risk_and_gradient(toxicity.Sparse(pos), toxicity.Sparse(unl), w, b, prior)
        x = np.append(w, b)
        assert np.allclose((positive, negative), risks(x))
        signs.add(negative >= 0)
        use = (lambda x: sum(risks(x))) if negative >= 0 else (lambda x: -risks(x)[1])
        steps = np.eye(7) * 1e-6
        assert np.allclose(gradient, [(use(x + e) - use(x - e)) / 2e-6 for e in steps], atol=1e-6)
    assert signs == {True, False}


def test_prior_from_positive_and_unlabelled_texts(spark):
    counts = spark.createDataFrame([(1, 900, 110), (2, 500, 480), (3, 30, 2), (4, 2, 0)], "feature long, pos long, unl long")
    chosen, prior = toxicity.screen(counts, 1000, 1000)
    assert chosen.tolist() == [1, 3] and 0.12 < prior < 0.15  # feature 1: 0.11 / 0.9 and a standard error; 3 is too rare to tell
    assert toxicity.screen(counts.limit(0), 0, 0)[1] == toxicity.UNTOLD_PRIOR


def brute_measures(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_against_brute_force(spark, docs, odd, empty):
    extra = spark.createDataFrame([(900 + i, t) for i, t in enumerate(["a b c a b c a b c", "a a a a", "a b c d a b c", "x\nx\n \nx", "a\x0bb\x0cc", "#<> |", "a b c"])], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra).union(odd.select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    texts = {(r["doc_id"], r["text"]) for r in df.collect()}
    got = quality_rules.judge(df)
    assert got.count() == df.count()
    rows = {r["doc_id"]: r for r in got.filter("doc_id is not null").collect()}
    for doc_id, text in texts:
        if doc_id is not None:
            r = rows[doc_id]
            n = brute_measures(text)
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n, (doc_id, n)
            assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(empty).count() == 0 and quality_rules.judge(odd).count() == 11


def test_repeats_are_exact_where_hashes_clash(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice("abcd") for _ in range(n)) for n in (3, 4, 5, 9, 20, 60) for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("w", F.split("text", " "))
    few = lambda *words: F.pmod(F.xxhash64(*words), F.lit(3)).cast("long")
    got = {x["id"]: (x["a"], x["b"]) for x in df.select("id", quality_rules.repeat_words(F.col("w")).alias("a"), quality_rules.repeat_words(F.col("w"), few).alias("b")).collect()}
    for k, text in enumerate(texts):
        assert got[k] == (brute_measures(text)[4],) * 2, text


def brute_votes(text):
    """The nine votes on a text, from the definitions."""
    import regex

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = brute_measures(text)
    if not n_words:
        return (-1, *[0] * 8)
    w = regex.findall(r"[^\x20\x09-\x0D]+", text)
    n_lines = sum(bool(x.strip(" \t\x0b\x0c\r")) for x in text.split("\n"))
    plain = sum(bool(regex.fullmatch(r"\p{L}[\p{L}'-]*[.,;:!?)]?", x)) for x in w)
    distinct = sum(len(set(w[k : k + 100])) for k in range(0, n_words, 100))
    rules = [
        (n_words, 50, None, 80, None), (word_chars / n_words, 2.5, 12, 3, 10), (n_symbols / n_words, None, 0.1, None, 0.02), (n_dup_lines / n_lines, None, 0.3, None, 0.1),
        (n_repeat_words / n_words, None, 0.3, None, 0.15), (len(regex.findall(r"\p{Lu}", text)) / word_chars, None, 0.3, None, 0.1),
        (len(regex.findall(r"[!?]{2,}", text)) / n_words, None, 0.1, None, 0.02), (plain / n_words, 0.7, None, 0.85, None), (distinct / n_words, 0.6, None, 0.7, None),
    ]
    out = []
    for x, bad_below, bad_above, good_from, good_to in rules:
        if (bad_below is not None and x < bad_below) or (bad_above is not None and x > bad_above):
            out.append(-1)
        else:
            out.append(int((good_from is None or x >= good_from) and (good_to is None or x <= good_to)))
    return tuple(out)


def test_verdicts_against_brute_force(spark, docs):
    """Votes, expectation-maximisation over single documents and posteriors, all in numpy."""
    r = random.Random(9)
    rich = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(2500))
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(9001, rich), (9002, None), (9003, "a b c " * 60)], "doc_id long, text string"))
    rows = sorted((x["doc_id"], x["text"]) for x in df.filter("doc_id <> 9002").collect()) + [(9002, None)]
    votes = np.array([brute_votes(text or "") for _, text in rows])
    assert votes[[d for d, _ in rows].index(9001)][8] == 1
    share, good, bad = 0.85, np.full(9, 0.995), np.full(9, 0.25)  # accuracies on good and on bad documents
    posterior = lambda: 1 / (1 + (1 - share) / share * np.exp(
        (np.where(votes == 1, np.log((1 - bad) / good), 0) + np.where(votes == -1, np.log(bad / (1 - good)), 0)).sum(axis=1)
    ))
    for _ in range(2000):
        p = posterior()[:, None]
        plus, minus = votes == 1, votes == -1
        was = np.concatenate([[share], good, bad])
        share = (p.sum() + 1) / (len(rows) + 2)
        good = ((p * plus).sum(0) + 1) / ((p * (plus | minus)).sum(0) + 2)
        bad = (((1 - p) * minus).sum(0) + 1) / (((1 - p) * (plus | minus)).sum(0) + 2)
        if np.abs(was - np.concatenate([[share], good, bad])).max() < 1e-4:
            break
    p = posterior()
    got = {x["doc_id"]: x for x in quality_rules.judge(df).collect()}
    for k, (doc_id, text) in enumerate(rows):
        n = brute_measures(text)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert abs(got[doc_id]["p_good"] - p[k]) < 1e-6 and got[doc_id]["kept"] == (not failed and p[k] >= 0.5), doc_id
    assert got[9001]["kept"] and not got[9003]["kept"]


def test_weak_supervision_recovers_accuracies(spark):
    r = random.Random(3)
    right = [(0.95, 0.8), (0.9, 0.7), (0.85, 0.9), (0.97, 0.6)]
    counts = Counter()
    for _ in range(20_000):
        good = r.random() < 0.8
        counts[tuple((1 if good else -1) * (1 if r.random() < a[0 if good else 1] else -1) if r.random() < 0.9 else 0 for a in right)] += 1
    patterns = spark.createDataFrame([(list(v), n) for v, n in counts.items()], "votes array<tinyint>, n long")
    share, found = quality_rules.estimate(patterns, 4)
    assert abs(share - 0.8) < 0.05
    assert all(abs(a - b) < 0.08 for x, y in zip(found, right, strict=True) for a, b in zip(x, y, strict=True))


def test_wand_equals_exhaustive_scoring():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(8, 25)))) for i in range(50)]
    index = decontaminate.Index(items)
    for _ in range(100):
        query = np.array(sorted({index.terms[t] for t in r.sample(vocabulary, 25) if t in index.terms}))
        scores = [sum(p for t in query.tolist() for k2, p in zip(*index.postings[t], strict=True) if k2 == k) for k in range(50)]
        for least in (0.3, 0.5, 0.8):
            want = {k for k, s in enumerate(scores) if s >= least - 1e-9}
            assert {k for k, _ in index.retrieve(query, least)} == want


def test_leaks_against_brute_force(spark, docs, odd, empty):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    want = set()
    parsed = [(i["item_id"], *(decontaminate.shingles(x, 5) for x in decontaminate.question_and_answer(i["text"]))) for i in items.collect()]
    for d in docs.collect():
        words = decontaminate.tokens(d["text"])
        for item_id, question, answer in parsed:
            if all(sum(any(tuple(words[p : p + len(s)]) == s for p in range(len(words))) for s in part) >= 0.8 * len(part) for part in (question, answer)):
                want.add((d["doc_id"], item_id))
    assert got == want and got
    kept = decontaminate.clean(docs, items)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in got} and kept.columns == docs.columns
    assert decontaminate.leaks(odd, items).count() == 0 and decontaminate.leaks(empty, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.clean(odd, items).count() == 11
    item = items.first()
    named = spark.createDataFrame([(2**60 + 1, item["text"]), (None, item["text"])], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(named, items).collect()} == {(2**60 + 1, item["item_id"]), (None, item["item_id"])}
    blocks = list(decontaminate.indexes(items, max_items=15))
    assert len(blocks) > 1 and sum(len(b.items) for b in blocks) == items.count()


def test_near_copies_of_items_leak():
    item = "What is the name of the third planet that circles around our own sun today in space? It is the blue planet earth which we all live on together."
    index = decontaminate.Index([(7, item), (8, "Some other question about the number of stars? There are very many of them in the sky.")])
    words = ("filler text " * 300 + item + " more filler" * 300).split()
    assert set(index.leaks(" ".join(words))) == {7}
    changed = item.replace("together", "gladly").replace("What is", "Tell me")
    assert set(index.leaks("intro " * 90 + changed)) == {7}
    assert not index.leaks("What is the name of the blue planet " * 3)


def test_edited_items_leak_as_by_brute_force():
    """Copies whose rare words were replaced at an edge or in runs are found wherever the shingles are there."""
    r = random.Random(11)
    common = [f"c{i}" for i in range(40)]
    items, copies = [], []
    for i in range(120):
        question = [f"r{i}x{j}" for j in range(5)] + [r.choice(common) for _ in range(r.randrange(22, 40))]
        answer = [r.choice(common) for _ in range(r.randrange(3, 14))] + [f"a{i}"]
        items.append((i, " ".join(question) + ". " + " ".join(answer)))
        for start in (0, r.randrange(len(question)), None):
            edited = list(question + answer)
            for _ in range(1 if start is not None else 3):
                at = start if start is not None else r.randrange(len(edited))
                edited[at : at + r.randrange(1, 6)] = ["zz"] * 5 if start == 0 else ["zz"]
            copies.append(" ".join(["pad"] * 40 + edited + ["pad"] * 300))
    index = decontaminate.Index(items)
    parsed = [(i, *(decontaminate.shingles(x, 5) for x in decontaminate.question_and_answer(t))) for i, t in items]
    leaked = 0
    for text in copies:
        words = decontaminate.tokens(text)
        there = {k: decontaminate.shingles(words, k) for k in range(1, 6)}
        share = lambda part: len(part & there[len(next(iter(part)))]) / len(part)  # noqa: E731, B023
        want = {i for i, question, answer in parsed if share(question) >= 0.8 and share(answer) >= 0.8}
        assert set(index.leaks(text)) == want
        leaked += bool(want)
    assert 100 < leaked < len(copies)


def test_least_share_bounds_every_choice_of_missing_shingles():
    r = random.Random(2)
    for _ in range(150):
        parts = [[r.choice("abcdefghijkl") for _ in range(r.randrange(5, 16))] for _ in range(2)]
        held = [(x, decontaminate.shingles(x, 5)) for x in parts]
        weights = {w: r.random() for x in parts for w in x}
        weights = {w: v / sum(weights.values()) for w, v in weights.items()}
        least = decontaminate.least_share(held, weights, 0.8)
        lacks = [decontaminate.may_lack(s, 0.8) for _, s in held]
        choices = [[set(s) - set(gone) for gone in itertools.combinations(sorted(s), lack)] for (_, s), lack in zip(held, lacks, strict=True)]
        true = min(sum(weights[w] for w in {w for s in q | a for w in s}) for q in choices[0] for a in choices[1])
        assert 0 < least <= true + 1e-9


def test_items_in_blocks_are_scored_over_all(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = next(decontaminate.indexes(items))
    want = {x[0]: shares for x, shares in zip(whole.items, whole.shares, strict=True)}
    for block in decontaminate.indexes(items, max_items=15):
        for x, shares in zip(block.items, block.shares, strict=True):
            assert shares == pytest.approx(want[x[0]])


def test_leaks_do_not_depend_on_blocks_or_on_a_long_item(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    r = random.Random(3)
    long = " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(4000)) + ". The answer is here today."
    more = items.union(spark.createDataFrame([(7777, long)], "item_id long, text string"))
    assert {x.passage for x in decontaminate.indexes(more)} == {next(decontaminate.indexes(items)).passage, 2 * 4005}
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(8888, f"Before it. {long} After it.")], "doc_id long, text string"))
    found = lambda x, **kw: {(y["doc_id"], y["item_id"]) for y in decontaminate.leaks(df, x, **kw).collect()}
    want = found(items)
    assert found(more) == want | {(8888, 7777)}
    blocks = list(decontaminate.indexes(items, max_items=7))
    got = {(d["doc_id"], k) for d in docs.collect() for b in blocks for k in b.leaks(d["text"])}
    assert len(blocks) > 1 and got == want


def test_languages(spark, docs, odd, empty):
    profiles = langid.learn(docs.filter("doc_id % 2 = 0"))
    got = langid.identify(docs.filter("doc_id % 2 = 1"), profiles).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("lang_pred = lang").count() / got.count() > 0.95
    by_text = {r["doc_id"]: r for r in langid.identify(odd, profiles).filter("doc_id is not null").collect()}
    assert [by_text[k]["lang_pred"] for k in (1, 2, 3, 8)] == ["und"] * 4 and by_text[4]["lang_pred"] != "und"
    assert langid.identify(odd, profiles).count() == 11 and langid.identify(empty, profiles).count() == 0
    assert langid.learn(docs.limit(0)).languages == []


def test_out_of_place_distance_against_brute_force():
    text = "Abba, cab ab!"
    words = ["abba", "cab", "ab"]
    counts = Counter(g for w in words for p in [f"\x01{w}\x01"] for n in (1, 2, 3) for i in range(len(p) - n + 1) for g in [p[i : i + n]] if g != "\x01")
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    want = sorted(counts, key=lambda g: (-counts[g], code(g)))
    assert langid.ranked(langid.grams(text), 100).tolist() == [code(g) for g in want]
    profiles = langid.Profiles(["x"], np.sort([code("a"), code("b")]), np.array([[1, 0]]), 5)
    own = [code(g) for g in want[:5]]
    ranks = {code("a"): 1, code("b"): 0}
    distance = sum(abs(ranks[g] - k) if g in ranks else 5 for k, g in enumerate(own))
    assert profiles.classify(text) == ("x", 1 - distance / 25)


def test_ordinal_regression(spark, odd, empty):
    r = random.Random(2)
    rows = []
    for i in range(600):
        grade = i % 3
        rows.append((i, " ".join(r.choice(["good", "fine", "plain"] if r.random() < 0.2 + 0.35 * grade else ["spam!!", "BUY", "junk"]) for _ in range(40)), grade))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = ordinal.learn(df, df.filter("doc_id < 400").select("doc_id", "grade"))
    assert model.grades == [0, 1, 2] and np.all(np.diff(model.thresholds) > 0)
    got = ordinal.select(df, model, 2).join(df, "doc_id").filter("doc_id >= 400").groupBy("grade").agg(F.avg("expected_grade").alias("e"), F.avg("tail_probability").alias("t")).orderBy("grade").collect()
    assert got[0]["e"] < 0.6 < got[1]["e"] < 1.5 < got[2]["e"] and got[0]["t"] < 0.2 and got[2]["t"] > 0.6
    out = ordinal.select(odd, model, 2).collect()
    assert len(out) == 11 and all(0 <= x["tail_probability"] <= 1 for x in out) and ordinal.select(empty, model, 2).count() == 0
    assert ordinal.learn(df, df.select("doc_id", "grade").limit(0)).grades == [0]


def test_likelihood_gradient_against_differences():
    r = np.random.default_rng(1)
    rows = [np.sort(r.choice(5, 3, replace=False)) for _ in range(30)]
    values = [r.random(3) for _ in rows]
    y = r.integers(0, 4, 30)
    x = ordinal.Sparse(rows, values)

    def loss(at):
        """From the definition: P(grade <= k) = sigmoid(threshold_k - s)."""
        w, first, gaps = at[:5], at[5], np.exp(at[6:])
        edges = [-np.inf, first, first + gaps[0], first + gaps[0] + gaps[1], np.inf]
        below = lambda e, s: 1 / (1 + np.exp(s - e))
        scores = [sum(w[k] * v for k, v in zip(ids, vs, strict=True)) for ids, vs in zip(rows, values, strict=True)]
        return -np.mean([np.log(below(edges[k + 1], s) - below(edges[k], s)) for k, s in zip(y, scores, strict=True)])

    at = r.normal(0, 0.4, 8)
    got, d_weights, d_theta = ordinal.loss_and_gradient(x, y, at[:5], at[5:])
    assert np.isclose(got, loss(at))
    assert np.allclose(np.append(d_weights, d_theta), [(loss(at + e) - loss(at - e)) / 2e-6 for e in np.eye(8) * 1e-6], atol=1e-6)


def test_fit_is_near_the_likeliest(monkeypatch):
    """Against plain gradient descent, from the same definition, on a small table."""
    monkeypatch.setattr(ordinal, "BUCKETS", 8)
    r = np.random.default_rng(2)
    y = [i % 3 for i in range(90)]
    rows = [np.array([g if r.random() < 0.7 else int(r.integers(0, 3)), 3 + int(r.integers(0, 5))]) for g in y]
    model = ordinal.fit(rows, [np.ones(2)] * 90, y)
    x, w, theta = ordinal.Sparse(rows, [np.ones(2)] * 90), np.zeros(8), np.array([-1.0, 0.5])
    for _ in range(20_000):
        _, dw, dt = ordinal.loss_and_gradient(x, np.array(y), w, theta)
        w, theta = w - 0.5 * (dw + ordinal.DECAY * w), theta - 0.5 * dt
    best = ordinal.loss_and_gradient(x, np.array(y), w, theta)[0]
    fitted = ordinal.loss_and_gradient(x, np.array(y), model.weights, np.append(model.thresholds[:1], np.log(np.diff(model.thresholds))))[0]
    assert fitted < best + 0.01


def test_shapes_of_whole_tokens():
    assert ordinal.shape("Abc-DEF12x") == "a-Uda" and ordinal.shape("a1" * 30) == "ad" * 30


def test_tail_and_expectation_agree():
    m = ordinal.CumulativeLink([0, 1, 3], np.array([-1.0, 2.0]), np.empty(0))
    expected, tail = m.rate(np.array([0.5]), 1)
    p0, p1 = 1 / (1 + np.exp(1.5)), 1 / (1 + np.exp(-1.5))
    assert np.isclose(tail[0], 1 - p0) and np.isclose(expected[0], (p1 - p0) + 3 * (1 - p1))
