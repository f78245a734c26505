"""Periodic runs, source mixes and phrases against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import mixing, periodic_runs, phrases, queries

SF = "/root/testdata/sf0.01"


def runs_by_force(words, shortest):
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            smaller = any(all(words[x] == words[x + q] for x in range(i, i + length - q)) for q in range(1, p))
            if length >= max(shortest, 2 * p) and not smaller:
                out.append([i, length, p])
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rnd = random.Random(1)
    for _ in range(600):
        n, letters = rnd.randrange(0, 70), rnd.choice([1, 2, 3, 5])
        words = [rnd.choice("abcde"[:letters]) for _ in range(n)]
        if n and rnd.random() < 0.5:
            unit = words[: rnd.randrange(1, n + 1)]
            words = (unit * 100)[:n]
            for _ in range(rnd.randrange(3)):
                words[rnd.randrange(n)] = "z"
        for shortest in (2, 4, 12):
            assert periodic_runs.word_runs(words, shortest).tolist() == runs_by_force(words, shortest)


def test_suffix_tree_gives_suffixes_in_order_and_their_common_words():
    rnd = random.Random(2)
    for _ in range(100):
        letters = [rnd.randrange(1, rnd.choice([2, 3, 6])) for _ in range(rnd.randrange(1, 40))]
        tree, n = periodic_runs.SuffixTree(letters), len(letters)
        assert sorted(range(n + 1), key=lambda i: letters[i:]) == np.argsort(tree.ranks(False)).tolist()
        assert sorted(range(n + 1), key=lambda i: [-x for x in letters[i:]]) == np.argsort(tree.ranks(True)).tolist()
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        a, b = np.array(pairs).T
        common = [next((k for k, (x, y) in enumerate(itertools.zip_longest(letters[i:], letters[j:])) if x != y)) for i, j in pairs]
        assert tree.extension(a, b).tolist() == common


def test_long_text_is_one_run():
    words = [str(i) for i in range(9_999)] * 20
    assert periodic_runs.word_runs(words).tolist() == [[0, 199_980, 9_999]]


def test_runs_query_equals_brute_force(spark):
    texts = ["a b c d " * 9, None, "", "x " * 11, "x " * 12, "  A a A a\tA a A a A a A a\n", "é\xa0y é\xa0y " * 6] + [" ".join("the cat sat on a mat and so did we all today".split()[: i % 13]) * (i % 5) for i in range(120)]
    rows = [(i if i % 9 else None if i else 0, t, "s", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, runs string, n_words int")
    got = sorted((tuple(r) for r in periodic_runs.digests(docs).collect()), key=repr)
    want = []
    for key, text, *_ in [*rows, rows[0]]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_by_force(words, 12)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert got == sorted(want, key=repr) and any(r[1] for r in got)
    assert periodic_runs.digests(docs.limit(0)).collect() == []


def cheapest(patterns, quotas, most):
    """The most words that can flow, negative, and the least cost of that, over all flows."""
    cells = [(i, s) for i, (own, _) in enumerate(patterns) for s in own]
    best = (0, 0)
    for flow in itertools.product(*(range(min(quotas[s], most * patterns[i][1]) + 1) for i, s in cells)):
        taken, got = Counter(), Counter()
        for (i, s), f in zip(cells, flow):
            taken[i] += f
            got[s] += f
        if all(got[s] <= quotas[s] for s in quotas) and all(taken[i] <= most * size for i, (_, size) in enumerate(patterns)):
            best = min(best, (-sum(taken.values()), epochs(taken, patterns, most)))
    return best


def epochs(taken, patterns, most):
    return sum(e * min(max(taken[i] - (e - 1) * size, 0), size) for i, (_, size) in enumerate(patterns) for e in range(1, most + 1))


def test_flow_is_the_cheapest_of_all():
    rnd = random.Random(3)
    for _ in range(120):
        names = ["a", "b", None][: rnd.randrange(1, 4)]
        patterns = [(c, rnd.randrange(0, 3)) for r in range(1, len(names) + 1) for c in itertools.combinations(names, r) if rnd.random() < 0.5]
        while sum(len(c) for c, _ in patterns) > 5:
            patterns.pop()
        quotas = {s: rnd.randrange(0, 4) for s in names}
        sent = mixing.route(patterns, quotas, 2)
        taken = Counter({i: sum(x.values()) for i, x in enumerate(sent)})
        assert all(sum(x.get(s, 0) for x in sent) <= quotas[s] for s in names) and all(v >= 0 for x in sent for v in x.values())
        assert (-sum(taken.values()), epochs(taken, patterns, 2)) == cheapest(patterns, quotas, 2)


def test_targets_stop_at_twice_a_size_and_share_the_excess():
    got = mixing.targets({"a": 10, "b": 100, None: 100}, {"a": 5, "b": 2, None: 1}, 315)
    assert got == {"a": 20, "b": Fraction(590, 3), None: Fraction(295, 3)}
    assert mixing.targets({"a": 10, "b": 40, None: 100}, {"a": 5, "b": 2, None: 1}, 225) == {"a": 20, "b": 80, None: 125}
    assert mixing.targets({"a": 0}, {"a": 5}, 0) == {"a": 0} and mixing.targets({}, {}, 0) == {}
    assert mixing.targets({"a": 10, "b": 10}, {"a": 5, "b": 2}, 30) == {"a": 20, "b": 10}


@pytest.mark.parametrize("few", [3, 10_000])
def test_mix_takes_each_source_to_its_target(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    rows = [(i % 97 if i % 3 else None, "a b c " * (i % 5), ["x", None, "y", "z"][i % 4], "t") for i in range(700)] + [(1000, "w " * 5000, "y", "t"), (1001, None, "x", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    got = mixing.mix(docs, F.array("source")).select("doc_id", "size", F.col("sources")[0].alias("source"), "source_size", "target", "taken").collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sizes, taken, aims = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        aims[r["source"]] = r["target"]
    want = mixing.targets(dict(sizes), {"x": 5, "y": 2, "z": 1, None: 5}, sum(sizes.values()) * 3 / 2)
    assert aims == pytest.approx({s: float(t) for s, t in want.items()})
    assert all(aims[s] - 20 <= taken[s] <= aims[s] for s in aims)
    for s in aims:  # a source's words are repeated only once all are taken
        own = [r for r in got if r["source"] == s and r["size"]]
        assert len({r["taken"] > r["size"] for r in own}) == 1 or all(r["taken"] >= r["size"] for r in own)
    again = mixing.mix(docs.repartition(7), F.array("source")).select("doc_id", "size", F.col("sources")[0].alias("source"), "source_size", "target", "taken").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_of_overlapping_sources_and_edges(spark):
    docs = spark.createDataFrame([(i, "a b c d") for i in range(40)], "doc_id long, text string")
    both = F.when(F.col("doc_id") < 20, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("y")))
    got = mixing.mix(docs, both, weights=(1, 1), percent=100).collect()
    # x can only be served by the first half; y's quota is filled by what is left, without repeating a document
    assert sum(r["taken"] for r in got) == 160 and all(r["taken"] == r["size"] for r in got)
    assert mixing.mixed_documents(docs.limit(0).withColumn("source", F.lit("s"))).collect() == []
    assert [(r["taken"], r["target"]) for r in mixing.mix(docs.limit(1), F.lit(None).cast("array<string>")).collect()] == [(0, 0.0)]


def phrases_by_force(rows, least, top):
    counts, total, out = {}, Counter(), []
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    for lang, own in counts.items():
        good = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inner = {p[i : i + k] for p, a in good.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if good[p[i : i + k]] <= a}
        rows = []
        for p, a in good.items():
            if p not in inner:
                score, _, l, r = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd, vocabulary = random.Random(3), ["a", "B", "é", "x\xa0y", "-", "of", "The", "ÀB"]
    out = []
    for i in range(300):
        text = "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", " ! "]) for _ in range(rnd.randrange(0, 40)))
        out.append((rnd.choice(["en", "de", None, "und"]), None if i % 50 == 0 else text + " we hold these truths to be self evident to all " * (i % 3 == 0)))
    return [*out, ("en", "long " * 3000), ("en", "rare")]


@pytest.mark.parametrize("least, top, slots", [(5, 2000, 1 << 23), (5, 2000, 1 << 14), (30, 7, 1 << 23), (1, 100_000, 1 << 23), (300, 50, 1 << 23)])
def test_phrases_equal_brute_force(spark, rows, least, top, slots):
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string").repartition(5)
    assert sorted(map(tuple, phrases.collocations(docs, least, top, slots).collect())) == phrases_by_force(rows, least, top)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([("en", None), (None, " . , ")], "lang string, text string")
    assert phrases.collocations(docs, 1).collect() == [] == phrases.collocations(docs.limit(0), 1).collect()


def test_scores_pass_64_bits(spark):
    a, l, r, n = 10**12 + 7, 10**12 + 9, 10**12 + 11, 10**14 + 3
    counts = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r)], "lang string, phrase string, k int, n long")
    got = phrases.scored(counts, spark.createDataFrame([("en", n)], "lang string, total long")).first()
    assert got["score"] == 1000 * a * n // (l * r)


def test_unary_paths_are_joined_and_cycles_end(spark):
    chain = [(f"{chr(99 + i)} {chr(100 + i)}", 2, 7) for i in range(9)] + [(chr(99 + i), 1, 7) for i in range(10)]
    rows = [("a b", 2, 5), ("b a", 2, 5), ("a", 1, 5), ("b", 1, 5), ("x y", 2, 4), ("y z", 2, 3), ("y", 1, 4), *chain]
    counts = spark.createDataFrame([("e", *r) for r in rows], "lang string, phrase string, k int, n long")
    got = {r["phrase"]: (r["path"], r["words"]) for r in phrases.paths(counts, 2).collect()}
    assert got == {"a b": (None, None), "b a": (None, None), "x y": ("x y", 2), "y z": ("y z", 2), **{p: ("c d", 10) for p, k, _ in chain if k == 2}}


def test_phrases_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.sql(queries.oracle_sql()["op13_phrases"])
    got = queries.op13_phrases(spark, SF).select(*want.columns)
    rows = want.fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows) and len(rows) > 50


def test_a_task_gives_each_of_its_phrases_once(spark):
    texts = spark.createDataFrame([("en", "a b c d e f g. x y")] * 6, "lang string, t string").coalesce(1)
    full = [np.full(size // 8, 255, np.uint8) for size in (phrases.WORD_BITS, 1 << 14, 1 << 14)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # three batches
    try:
        rows = phrases.own_edges(texts, *full).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = [dict(zip(r["phrases"], r["counts"])) for r in rows]
    assert got == [{"a b c d e": 6, "b c d e f": 6, "c d e f g": 6, "d e f g": 6, "x y": 6}]
