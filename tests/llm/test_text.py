"""Toxicity, quality, licences and pseudonyms."""

import hashlib
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barwright.llm import common, licences, pii, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_grammar_scores_clauses():
    own = toxicity.Scorer(toxicity.Grammar())
    plain, aimed = own.clause("what an idiot"), own.clause("you are an idiot")
    assert aimed > plain > own.clause("you are not an idiot") > 0
    assert aimed > own.clause('she said you are an "idiot"') > 0
    assert own.clause("they kill time") > own.clause("kill the process") > 0 == own.clause("a quiet day")
    assert own.score("You are a worthless idiot.") > 0.3 > own.score("It is a fine day.") == own.score(None) == own.score("")


def test_composition_multiplies_factors_of_paired_states():
    both = toxicity.composed(toxicity.NEGATION, toxicity.REPORTED)
    state, a, b = both.start, toxicity.NEGATION.start, toxicity.REPORTED.start
    for kind in ("report", "other", "negation", "quote", "insult", "threat", "quote", "other", "other", "other", "target", "insult"):
        state, factor = both.step(state, kind)
        (a, p), (b, q) = toxicity.NEGATION.step(a, kind), toxicity.REPORTED.step(b, kind)
        assert state == (a, b) and factor == p * q


@pytest.mark.parametrize("times", [1, 4, 20, 100])
def test_curve_converges_on_any_number_of_rows(times):
    rnd = np.random.default_rng(3)
    y = (np.arange(957) % 10 == 0).astype(float)
    x = np.column_stack([rnd.gamma(2.0, 0.2 + y), rnd.gamma(2.0, 0.2 + 2 * y), rnd.gamma(2.0, 0.05 + y)])
    x[rnd.random(957) < 0.7 * (1 - y)] = 0  # nearly separable
    curve = np.array(toxicity._logistic(np.tile(x, (times, 1)), np.tile(y, times)))
    share = (np.column_stack([np.ones(957), x]) @ curve > np.log(0.3 / 0.7)).mean()
    assert 0.07 < share < 0.16


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    grammar = toxicity.fit(docs, labels)
    held = labels.where(toxicity.held_out()).join(docs.select("doc_id", "text"), "doc_id")
    got = toxicity.score(held.select("doc_id", "text", "toxic"), grammar).toPandas()
    right = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert right >= 0.85 * (got.toxic == 1).sum() and right >= 0.85 * (got.predicted == 1).sum()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "you idiot", 9.0), (1, "you idiot", 9.0), (None, None, 9.0), (2, "", 9.0)], "doc_id long, text string, toxic double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, None), (1, 0, 1), (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert [r["predicted"] for r in got if r["doc_id"] != 1] == [0, 0] and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs).join(labels, "doc_id").toPandas()
    assert (got.keep.astype(int) == got.quality).mean() > 0.95 and (got.keep | (got.quality == 0)).all()


def quality_by_hand(texts):
    """Votes, posteriors and scores, document by document."""
    import itertools
    import math

    import xxhash

    place = lambda x: xxhash.xxh3_64_intdigest(x) % quality.DIM
    cast, rows = [], []
    for text in texts:
        text = text or ""
        words, raw, lines = text.split(), text.encode(), text.split("\n")
        n = len(words)
        share = lambda k, of: k / of if n else 0.0
        symbols = share(sum(c in "#$%&*|!~^<>{}=\\" for c in text), len(raw))
        marked = share(sum(w[-1] in "#$%&*|!~^<>{}=\\" for w in words), n)
        capitals = share(sum("A" <= c <= "Z" for c in text), len(raw))
        distinct, stutter = share(len(set(words)), n), share(sum(a == b for a, b in zip(words, words[1:])), n)
        length, repeated = share(len(text) - n, n), share(len(lines) - len(set(lines)), len(lines))
        ends = share(sum(w[-1] in ".!?" for w in words), n)
        bad = [symbols > 0.03, marked > 0.15, capitals > 0.3, n >= 20 and distinct < 0.4, n >= 8 and stutter > 0.2, length > 8.5 or length < 2, len(lines) >= 3 and repeated > 0.4, n >= 20 and (ends > 0.5 or ends == 0), n == 0]
        good = [symbols < 0.01, marked < 0.05, capitals < 0.1, n < 20 or distinct > 0.55, stutter < 0.08, 3 <= length <= 7, len(lines) >= 3 and repeated < 0.1, 0.01 < ends < 0.4, n >= 30]
        cast.append([0 if b or not n else 2 if g else 1 for b, g in zip(bad, good)])
        x = [0.0] * quality.DIM
        for w in words:
            kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w]
            x[place("".join(k for k, _ in itertools.groupby(kinds)) + f"|{min(len(w), 12) // 3}")] += 1 / n
        for k, v in enumerate((symbols, marked, capitals, distinct, stutter, length, repeated, ends)):
            x[place(f"{k}:{min(20, int(v)) if k == 5 else min(quality.BINS, int(v * quality.BINS))}")] += 1
        x[place(f"n:{n.bit_length()}")] += 1
        rows.append(x)
    good = [1 / (1 + math.exp(-1.5 * sum(v - 1 for v in c) + 3 * (0 in c))) for c in cast]
    for _ in range(100):
        prior, chance = (sum(good) + 1) / (len(good) + 2), {}
        for side in (0, 1):
            for k in range(9):
                held = [0.5 + sum((g if side else 1 - g) for g, c in zip(good, cast) if c[k] == v) for v in range(3)]
                chance[side, k] = [h / sum(held) for h in held]
        log = lambda c, side: math.log(prior if side else 1 - prior) + sum(math.log(chance[side, k][v]) for k, v in enumerate(c))
        new = [1 / (1 + math.exp(max(-50, min(50, log(c, 0) - log(c, 1))))) for c in cast]
        if max(abs(a - b) for a, b in zip(new, good)) < 1e-9:
            break
        good = new
    x, y, w, b = np.array(rows), np.array(good), np.zeros(quality.DIM), 0.0
    for _ in range(300):
        off = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        w, b = w - 2.0 * (off @ x / len(y) + 1e-4 * w), b - 2.0 * off.mean()
    scores = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
    return [sum(v * 3**k for k, v in enumerate(c)) for c in cast], good, scores.tolist()


def test_quality_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, ""), (-2, None), (-3, "A A A A A A A A A #!"), (-4, "\n\n\n")], "doc_id long, text string")
    held = docs.union(odd)
    texts = {r["doc_id"]: r["text"] for r in held.collect()}
    got = {r["doc_id"]: r for r in quality.classify(held).collect()}
    votes, chances, scores = quality_by_hand(list(texts.values()))
    for k, v, c, z in zip(texts, votes, chances, scores):
        assert got[k]["votes"] == v and got[k]["posterior"] == pytest.approx(c, abs=1e-6) and got[k]["score"] == pytest.approx(z, abs=1e-3)
        assert got[k]["keep"] == (got[k]["score"] >= 0.5)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "Fine words here.", 1), (2, "Fine words here.", 1)], "doc_id long, text string, score long")
    got = quality.classify(docs).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(docs.limit(0)).count() == 0


def test_em_finds_the_better_labellers():
    import itertools
    import random

    rnd, counts = random.Random(1), {}
    accuracy = [0.95, 0.9, 0.9, 0.85, 0.8, 0.55, 0.9, 0.9, 0.6]
    truth = {}
    for _ in range(20000):
        good = rnd.random() < 0.7
        cast = [2 * (good == (rnd.random() < a)) for a in accuracy]
        code = sum(v * 3**k for k, v in enumerate(cast))
        counts[code] = counts.get(code, 0) + 1
        truth.setdefault(code, []).append(good)
    chances = quality.posteriors(counts)
    right = sum(g == (chances[c] > 0.5) for c, gs in truth.items() for g in gs)
    assert right > 0.97 * 20000 and all(itertools.starmap(lambda c, p: 0 <= p <= 1, chances.items()))


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/code", "some code"),
        (3, "a/b/own", "head\nlicensed under the apache license version 2.0\nmore words in this file that are no licence at all"),
        (4, "z/code", "nothing"),
        (5, "a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        (6, None, None),
        (7, "a/LICENSE2", "copyright someone, all rights reserved"),
        (3, "a/b/own", "head\nlicensed under the apache license version 2.0\nmore words in this file that are no licence at all"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("licence", F.lit("clash"))
    got = {r["doc_id"]: (r["licence"], r["origin"], r["from_dir"]) for r in licences.scan(df).collect()}
    assert got == {
        1: ("MIT", "file", None),
        2: ("GPL-3.0", "inherited", "a/b"),
        3: ("Apache-2.0", "header", None),
        4: (None, None, None),
        5: ("GPL-3.0", "file", None),
        6: (None, None, None),
        7: (licences.PROPRIETARY, "header", None),
    }
    assert licences.scan(df).count() == len(rows) and licences.scan(df.limit(0)).count() == 0


def test_each_template_finds_itself(spark):
    lines = spark.createDataFrame([(t,) for _, t in licences.TEMPLATES], "line string")
    got = {r["line"]: (r["licence"], round(r["cosine"], 6)) for r in licences.line_matches(lines).collect()}
    assert got == {t: (n, 1.0) for n, t in licences.TEMPLATES}


@pytest.mark.parametrize(
    "text, licence",
    [
        ("// SPDX-License-Identifier: MIT\nint main;", "MIT"),
        ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        ("/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\ncode", "GPL-3.0"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0"),
        ("Copyright 2020 X\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice,\nthis list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright\nnotice, this list of conditions and the following disclaimer in the\ndocumentation and/or other materials provided with the distribution.\n3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.", "BSD-3-Clause"),
        ("# Use of this source code is governed by a BSD-style license that can be\n# found in the LICENSE file.", "BSD-3-Clause"),
        ("Distributed under the terms of the GNU GPL v3", "GPL-3.0"),
        ("Dual licensed under MIT or Apache-2.0.", "Apache-2.0 OR MIT"),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
        ("Copyright 1999 A House. All rights reserved.", licences.PROPRIETARY),
        ("Copyright 1999 A House. All rights reserved.\nReleased under the MIT License", "MIT"),
        ("a license to speak, as they say, was never granted to the old man in the village", None),
    ],
)
def test_usual_headers_are_found(spark, text, licence):
    noise = [(k, f"n/{k}", f"This line {k} says that copyright matters for number {k * 7} in some way\nand the license of house {k} is old") for k in range(2, 40)]
    df = spark.createDataFrame([(1, "x/a.c", text), *noise], "doc_id long, path string, text string")
    assert {r["licence"] for r in licences.scan(df).where("doc_id = 1").collect()} == {licence}


def test_templates_hold_cues_and_long_lines_part_blocks():
    import re as own

    assert all(own.search(licences.CUE, text) for _, text in licences.KNOWN)


def brute_cosines(units, known):
    """TF-IDF cosines with words and pairs, written out."""
    import math
    from collections import Counter

    def tokens(line):
        words = re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", line.lower())
        return Counter(words + [f"{a}_{b}" for a, b in zip(words, words[1:])])

    units = sorted(set(units))
    df = Counter(t for line in [*units, *(x for _, x in known)] for t in tokens(line))
    n = len(units) + len(known)

    def vector(line):
        w = {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in tokens(line).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / norm for t, v in w.items()}

    out = {}
    for line in units:
        v = vector(line)
        said = {v if "." in v else v + ".0" for v in re.findall(licences.VERSION, line.lower())}
        fits = [(name, x) for name, x in known if not said or not (m := re.search(r"-([0-9]+\.[0-9]+)$", name)) or m[1] in said]
        best = max(((sum(x * u.get(t, 0) for t, x in v.items()), name) for u, name in ((vector(x), name) for name, x in fits)), key=lambda b: (round(b[0], 9), [-ord(c) for c in b[1]]))
        if best[0] > 0:
            out[line] = (best[1], round(best[0], 6))
    return out


def test_cosines_against_brute_force(spark):
    units = ["Licensed under the Apache License", "the MIT license of all", "license license mit", "SPDX license", "public domain work under CC0", "copyright of nobody", "mit", "qqq zzz"]
    got = {r["line"]: (r["licence"], round(r["cosine"], 6)) for r in licences.line_matches(spark.createDataFrame([(u,) for u in units * 2], "line string"), licences.KNOWN).collect()}
    assert got == brute_cosines(units, licences.KNOWN)


def shape(text):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", text)))


@pytest.mark.parametrize("find", ["und.34@mail7.example.com", "a@b.co", "+1 (017) 555-7713", "4111 1111 1111 1111", "9807915762804490", "123-45-6789", "DE89370400440532013000", "1985-07-14", "03/04/1990", "31.12.1999"])
def test_pseudonyms_keep_the_format(spark, find):
    texts = [f"see {find}, ok", f"{find}\nagain {find}."]
    rows = [r["text"] for r in pii.pseudonymised(spark.createDataFrame([(t,) for t in texts], "text string"), "k").collect()]
    new = rows[0][4:-4]
    assert new != find and rows[1] == f"{new}\nagain {new}."
    assert shape(new) == shape(find)
    other = pii.pseudonymised(spark.createDataFrame([(texts[0],)], "text string"), key="else").first()["text"]
    assert other[4:-4] not in (new, find)


@pytest.mark.parametrize(
    "forms",
    [
        ("4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"),
        ("+49 (151) 5553 217", "+491515553217", "+49-151-5553-217"),
        ("(555) 123-4567", "555-123-4567", "555.123.4567"),
        ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00"),
        ("1985-07-14", "14.07.1985"),
        ("Ann.Lee7@x.org", "ann.lee7@x.org"),
    ],
)
def test_values_are_linked_however_they_are_written(spark, forms):
    got = [r["text"] for r in pii.pseudonymised(spark.createDataFrame([(f"is {f}; yes",) for f in forms], "text string"), "k'|").collect()]
    values = {re.sub("[^a-z0-9@]", "", g[3:-5].lower()) for g in got}
    if forms[0] == "1985-07-14":
        y, m, d = got[0][3:-5].split("-")
        assert got[1] == f"is {d}.{m}.{y}; yes"
    else:
        assert len(values) == 1
    assert [shape(g) for g in got] == [shape(f"is {f}; yes") for f in forms]


def feistel(s, kind, key):
    """The permutation of strings, written out."""
    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for n in range(1, pii.ROUNDS + 1):
        h = bytes.fromhex(hashlib.sha256(f"{key}|{kind}|{n}|{right}".encode()).hexdigest())
        out = ""
        for i, c in enumerate(left):
            for low, size in (("0", 10), ("a", 26), ("A", 26)):
                if ord(low) <= ord(c) < ord(low) + size:
                    c = chr(ord(low) + (ord(c) - ord(low) + h[i % 32]) % size)
                    break
            out += c
        left, right = right, out
    return left + right


def test_pseudonyms_against_a_plain_feistel_network(spark):
    secret = "bw8:" + hashlib.sha256(b"some key").hexdigest()
    names = [f"user{i}x.{i * i}" for i in range(40)]
    texts = [(f"{n}@a.org",) for n in names] + [("(555) 000-%04d" % i,) for i in range(40)] + [("+44 20 7946 %04d" % i,) for i in range(40)]
    got = [r["text"] for r in pii.pseudonymised(spark.createDataFrame(texts, "text string"), "some key").collect()]
    assert got[:40] == [feistel(n, "mail", secret) + "@a.org" for n in names]
    for i in range(40):
        assert re.sub("[^0-9]", "", got[40 + i]) == feistel("555000%04d" % i, "phone", secret)
        assert re.sub("[^0-9]", "", got[80 + i]) == "44" + feistel("207946%04d" % i, "phone", secret)


def test_pseudonyms_are_valid_and_distinct(spark):
    numbers = spark.range(3000).select(F.concat(F.lpad((F.col("id") * 104729 + 4000000000).cast("string"), 15, "4")).alias("b"))
    cards = numbers.select(F.expr("concat(b, element_at(filter(sequence(0, 9), k -> luhn_check(concat(b, k))), 1))").alias("text"))
    got = pii.pseudonymised(cards, "k")
    assert got.where("luhn_check(text) AND n_found = 1").count() == 3000 == got.select("text").distinct().count()
    byte = spark.range(70000).select(F.concat_ws(".", F.lit("10"), F.lit("7"), F.floor(F.col("id") / 256 % 256).cast("string"), (F.col("id") % 256).cast("string")).alias("text")).distinct()
    assert pii.pseudonymised(byte, "k").select("text").distinct().count() == byte.count()
    days = spark.range(3000).select(F.date_add(F.lit("1980-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    assert pii.pseudonymised(days, "k").where("try_to_date(text) IS NOT NULL").select("text").distinct().count() == 3000
    assert spark.range(10000).selectExpr(f"{pii.permuted('format_string(' + chr(39) + '%04d' + chr(39) + ', id)', 't', 'k')} p").distinct().count() == 10000


def test_pseudonyms_of_numbers_that_are_not_valid_stay_apart(spark):
    def valid_social(s):
        return not re.match(r"000|666|9", s) and s[4:6] != "00" and s[7:] != "0000"

    socials = [f"{a:03d}-{b:02d}-{c:04d}" for a in (0, 1, 665, 666, 899, 900, 999) for b in (0, 1, 57) for c in (0, 1, 2024)] + [f"{a:03d}-12-3456" for a in range(1000)]
    got = pii.pseudonymised(spark.createDataFrame([(x, x) for x in socials], "raw string, text string"), "k").collect()
    assert len({r["text"] for r in got}) == len(set(socials)) and all(valid_social(r["raw"]) == valid_social(r["text"]) for r in got)
    cards = [str(4000000000000000 + 7 * i) for i in range(1500)]
    got = pii.pseudonymised(spark.createDataFrame([(x, x) for x in cards], "raw string, text string"), "k")
    assert got.select("text").distinct().count() == 1500 and got.where("luhn_check(raw) <> luhn_check(text)").count() == 0
    accounts = [f"DE{c:02d}{b:018d}" for c in range(100) for b in (370400440532013000, 5, 123456789)]
    got = pii.pseudonymised(spark.createDataFrame([(x,) for x in accounts], "text string"), "k")
    assert got.select("text").distinct().count() == 300 and got.where("text RLIKE '^DE[0-9]{20}$'").count() == 300


def test_secret_is_made_once(spark):
    assert len(common.shared_secret(spark, "test")) == 64 and common.shared_secret(spark, "test") == common.shared_secret(spark, "test") != common.shared_secret(spark, "other")


def test_pseudonyms_leave_the_rest(spark):
    rows = [("version 2.0 of 1984",), ("",), (None,), ("bad 2024-99-99 and 300.1.2.3",)]
    got = pii.pseudonymised(spark.createDataFrame(rows, "text string").withColumn("m", F.lit(1)), "k")
    assert [(r["text"],) for r in got.collect()] == rows and got.columns == ["text", "m", "n_found"]
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())
    assert pii.pseudonymised(got.select("text").limit(0), "k").count() == 0


def test_pipeline(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    n = docs.count()
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0)], docs.schema)
    given = docs.union(odd)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        given = common.stored(stage(spark, given, SF))
        counts.append(given.count())
        if name != "bpe":
            assert tuple(given.columns) == corpus_pipeline.COLUMNS
        assert given.where("doc_id IS NULL").count() == 1 and given.where("doc_id = 1000000000").count() == 1
        if name == "line_dedup":  # copies lose all their lines, and go; what had no text before stays
            assert given.where("text RLIKE r'^\\s*$'").count() == 1
    assert n * 0.85 < counts[0] < n and counts[0] > counts[1] >= counts[2] > counts[3] == counts[4]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


@pytest.mark.parametrize(
    "file, licence",
    [("Apache-2.0", "Apache-2.0"), ("GPL-1", "GPL-1.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2", "LGPL-2.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-1.1", "MPL-1.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("Artistic", "Artistic-1.0"), ("GFDL-1.3", "GFDL-1.3"), ("GFDL-1.2", "GFDL-1.2")],
)
def test_whole_licence_texts(spark, file, licence):
    path = Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("no such text here")
    rows = [(1, "x/LICENSE", path.read_text(errors="replace")), (2, "x/y/code", "code"), (3, "x/y/own", "All rights reserved."), (4, "z/code", "code")]
    got = {r["doc_id"]: (r["licence"], r["origin"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: (licence, "file"), 2: (licence, "inherited"), 3: (licences.PROPRIETARY, "header"), 4: (None, None)}


def test_licences_of_headers_over_several_lines(spark):
    gnu = "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU %s as published by\n * the Free Software Foundation, either version %s of the License, or\n * (at your option) any later version.\n *\n * It is given without any warranty.\n */\n\nint main() { return 0; }\n" + "more = code + of + this + file;\n" * 30
    mit = 'Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above notice shall be included in all copies.'
    rows = [
        (1, "p/a.c", gnu % ("General Public License", "3")),
        (2, "q/b.c", gnu % ("General Public License", "2")),
        (3, "r/c.c", gnu % ("Affero General Public License", "3")),
        (4, "m/LICENSE", mit),
        (5, "m/x/code", "code"),
        (6, "n/notes", "the copyright of words\nis a theme of this text,\nwhich licenses nothing"),
    ]
    got = {r["doc_id"]: (r["licence"], r["origin"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("GPL-3.0", "header"), 2: ("GPL-2.0", "header"), 3: ("AGPL-3.0", "header"), 4: ("MIT", "file"), 5: ("MIT", "inherited"), 6: (None, None)}
