"""Joins and near-duplicate operators against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import decontamination, edits, embedding_dedup, graph, line_dedup, ngram_join

VOCABULARY = [f"w{i}" for i in range(400)]


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)]
    want = Groups({n for e in edges for n in e})
    for a, b in edges:
        want.join(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges + [(7, None)], "a long, b long")).collect()}
    assert got == {n: want.find(n) for e in edges if e[0] != e[1] for n in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_maybe_in_drops_none(spark):
    ids = spark.range(0, 5000, 7).toDF("k")
    left = graph.maybe_in(spark.range(5000).toDF("k"), "k", ids)
    assert left.join(ids, "k").count() == ids.count() and left.count() < 2500


def near_texts(rnd, groups, size):
    out = []
    for _ in range(groups):
        words = [rnd.choice(VOCABULARY) for _ in range(rnd.choice(size))]
        out.append(" ".join(words))
        for _ in range(rnd.randrange(5)):
            other = list(words)
            for _ in range(rnd.randrange(1 + len(words) // 15)):
                other[rnd.randrange(len(other))] = rnd.choice(VOCABULARY)
            out.append(" ".join(other[: len(other) - rnd.randrange(1 + len(words) // 20)]))
    return out


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, n, percent):
    rnd = random.Random(n)
    texts = near_texts(rnd, 60, [1, 3, 5, 7, 9, 12, 20, 45, 90, 300]) + [None, "", " \n ", "A  b\tC", "a B c", "one two three four", "ONE two three four", "x " * 3000]
    texts += [" ".join(VOCABULARY[:60][:i] + ["z"] + VOCABULARY[:60][i + 1 :]) for i in range(60)]  # a hub and its near copies
    rows = [(i, t, -1) for i, t in enumerate(texts)] + [(3, texts[3], -1)]
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    want = Groups(sets)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                want.join(a, b)
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = ngram_join.jaccard_groups(df, n, percent).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want.find(i)) for i in sets}
    assert ngram_join.jaccard_groups(df.limit(0), n, percent).count() == 0


def test_sets_within_the_bound_share_a_key():
    rnd = random.Random(9)
    for size in [*range(1, 40), 64, 100, 333, 1000]:
        for _ in range(6):
            a = {rnd.getrandbits(64) for _ in range(size)}
            b = set(a)
            while True:  # one change after another, as far as the threshold allows
                step = b - {rnd.choice(sorted(b))} if rnd.random() < 0.5 and len(b) > 1 else b | {rnd.getrandbits(64)}
                if 100 * len(a & step) < 85 * len(a | step):
                    break
                b = step
            keys = [set(ngram_join.block_keys(np.array(sorted(s), np.uint64), 85).tolist()) for s in (a, b)]
            assert keys[0] & keys[1], size


def test_long_items_are_found_in_bounded_memory(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [text(12) for _ in range(60)] + [text(3000)]
    edited = list(items[-1])
    for k in range(40, len(edited), 90):
        edited[k] = "z"
    docs = spark.createDataFrame([(1, text(50) + " " + "".join(edited) + " " + text(50)), (2, text(4000)), (3, text(5) + " " + items[3])], "doc_id long, text string")
    got = decontamination.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), percent=2)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 60), (3, 3)}
    whole = decontamination.hashes_of(items)
    assert all((whole[k] == decontamination.hashes_of([t])[0]).all() for k, t in enumerate(items))
    short = decontamination.leaks(docs, spark.createDataFrame([(7, items[3])], "item_id long, text string"), shortest=10_000)
    assert [(r["doc_id"], r["edits"]) for r in short.collect()] == [(3, 0)]


def test_wide_sketches_bound_the_difference_and_tell_others_apart(spark):
    rnd, rows = np.random.default_rng(4), []
    for size in (400, 511, 513, 1030, 5000, 40_000):
        for percent in (30, 75, 85, 100):
            pool = np.unique(rnd.integers(0, 1 << 63, 4 * size).astype(np.uint64))
            both = size * 2 * percent // (100 + percent)
            a, b = (np.sort(np.concatenate([pool[:both], pool[k : k + (size - both) * m // 8]])) for k, m in ((size, 8), (2 * size, 5)))
            if min(len(a), len(b)) >= ngram_join.LARGE:
                rows.append((percent, len(a), len(b), 2 * both, *([int(v) for v in ngram_join.wide_parity(x)] for x in (a, b))))
    df = spark.createDataFrame(rows, "percent int, na long, nb long, common long, x array<long>, y array<long>")
    got = df.withColumn("apart", ngram_join._wide_apart(F.col("x"), F.col("y"))).collect()
    assert len({len(r["x"]) == len(r["y"]) for r in got}) == 2 and all(r["apart"] <= r["na"] + r["nb"] - r["common"] for r in got)
    for r in got:  # linked sets stay, others of size go
        assert r["percent"] != 100 or r["apart"] == 0
        assert r["percent"] > 75 or 185 * r["apart"] > 15 * (r["na"] + r["nb"])
    assert not len(ngram_join.wide_parity(np.arange(399, dtype=np.uint64)))


def test_large_sets_link_exactly_at_the_threshold(spark):
    """Texts of 1,000 to 2,000 shingles whose similarity is just at or just under the threshold."""
    texts, want = [], []
    for k, n in enumerate((997, 1200, 1999)):
        for percent in (80, 85):
            union = n
            common = -(-union * percent // 100)
            for short in (0, 1):
                words = [f"g{k}p{percent}s{short}w{i}" for i in range(union + 3)]  # n + 3 words: n shingles of four
                texts += [" ".join(words), " ".join(words[: common + 3 - short])]
                want.append((percent, not short))
    for percent in (80, 85):
        own = [t for i, t in enumerate(texts) if want[i // 2][0] == percent]
        docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_groups(docs, 4, percent).collect()}
        flags = [w for p, w in want if p == percent]
        for j, linked in enumerate(flags):
            assert got[2 * j] == 2 * j and (got[2 * j + 1] == 2 * j) == linked, (percent, j)


def test_edit_distance():
    rnd = random.Random(2)

    def slow(a, b, free):
        row = [0 if free else j for j in range(len(b) + 1)]
        for i, c in enumerate(a, 1):
            row, last = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row

    for _ in range(2000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(14))) for _ in range(2))
        assert edits.distance(a, b) == slow(a, b, False)[-1]
        assert not a or edits.best_within(a, b)[0] == min(slow(a, b, True))


def test_line_dedup(spark):
    rnd = random.Random(5)
    long = [" ".join("word" + rnd.choice(VOCABULARY) for _ in range(60)) for _ in range(12)]
    texts = []
    for _ in range(50):
        lines = []
        for _ in range(rnd.randrange(1, 5)):
            words = rnd.choice(long).split()
            if rnd.random() < 0.5:
                words[rnd.randrange(60)] = rnd.choice(VOCABULARY)
            lines.append(" ".join(words) if rnd.random() < 0.8 else rnd.choice(["", "Short 1", "short  2!", "--"]))
        texts.append("\n".join(lines))
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)] + [(100, None, "x", 5), (101, "", "x", 5), (0, texts[0], "x", 5)]
    rows += [(None, "alone here\nsecond nowhere else", "x", 5), (None, "third\nfourth only here", "x", 5), (5, "one id\nand another text of it", "x", 5), (None, None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _id int")
    hashes = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    name = lambda i, t: (line_dedup.LAST if i is None else i, hashes[t])
    seen = {}
    for i, t, *_ in rows:
        for k, w in enumerate(line_dedup.normalised_lines(t)):
            if w and t is not None:
                seen.setdefault(b" ".join(w), []).append((*name(i, t), k))
    names = sorted(seen)
    want = Groups(range(len(names)))  # by edit similarity alone
    for a in range(len(names)):
        for b in range(a):
            x, y = names[a].decode(), names[b].decode()
            if edits.distance(x, y) * 100 <= max(len(x), len(y)) * 20:
                want.join(a, b)
    first = {}
    for k, line in enumerate(names):
        first[want.find(k)] = min([first.get(want.find(k), (1 << 63, 0, 0)), *seen[line]])
    gone = defaultdict(set)
    for k, line in enumerate(names):
        for at in seen[line]:
            if at != first[want.find(k)]:
                gone[at[:2]].add(at[2])
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"] and sum(map(len, gone.values())) > 40
    lines_of = lambda i, t: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[name(i, t)])
    expected = sorted(((i, lines_of(i, t), 0 if t is None else len(t.split("\n")), 0 if t is None else len(gone[name(i, t)])) for i, t, *_ in rows), key=str)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()), key=str) == expected
    assert {(r["_gone"], r["_id"]) for r in got.collect()} == {("x", 5)}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    assert line_dedup.dedup_lines(got).columns == got.columns


def hashed(lines):
    _, cls, sim, chars, owner, value = line_dedup.hashed_chunk("".join(x + "\n" for x in lines).encode())
    return [(c, s, n, sorted(value[owner == k].tolist())) for k, (c, s, n) in enumerate(zip(cls, sim, chars))]


def test_lines_are_hashed_alike_in_any_company():
    rnd = random.Random(3)
    lines = [" ".join(rnd.choice(VOCABULARY) * rnd.randrange(1, 4) for _ in range(n)) for n in (1, 2, 3, 5, 8, 9, 12, 40, 300, 1000)]
    assert hashed(lines) == [hashed([x])[0] for x in lines]
    assert hashed(["a b", "", " - ", "a  b"])[0] == hashed(["x", "a b"])[1] and len(hashed(["", " "])) == 0


def test_very_long_texts_keep_their_line_numbers(spark):
    rnd = random.Random(6)
    text = "\n".join(" ".join(rnd.choice(VOCABULARY) + str(k) for k in range(rnd.randrange(3, 12))) for _ in range(120_000))
    big = "word " * 300_000
    df = spark.createDataFrame([(1, text), (2, "x\n" + text.split("\n")[-1]), (3, big), (4, big + "end")], "doc_id long, text string")
    got = {(r["id"], r["line"]): (r["first_id"], r["first_line"]) for r in line_dedup.line_groups(df).collect()}
    assert got[2, 1][0] == 1 and got[4, 0] == (3, 0) and (2, 0) not in got


def test_embeddings(spark):
    rnd = np.random.default_rng(3)
    rows, vec_id = [], 0
    for label in (1, 2, None):
        for _ in range(25):
            base = rnd.standard_normal(16)
            for _ in range(rnd.integers(1, 5)):
                v = base + rnd.standard_normal(16) * rnd.choice([0, 0.1, 0.25, 0.3])
                rows.append((vec_id, [float(x) for x in v], label))
                vec_id += 1
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [float("inf")] * 16, 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1)]
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want, links = Groups([i for i, *_ in rows]), defaultdict(int)
    for i, u, a in good:
        for j, v, b in good:
            if i < j and a == b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                links[i] += 1
                links[j] += 1
                want.join(i, j)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert sum(links.values()) > 30 and got == {i: (links[i], want.find(i), want.find(i) == i) for i, *_ in rows}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_decontamination(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(12, 50)))) for i in range(30)] + [(50, None), (51, ""), (52, "Qz  short"), (53, None), (54, "qz short")]
    docs, want = [], set()
    for k in range(90):
        text = " ".join(word() for _ in range(rnd.randrange(0, 200)))
        i, t = items[k % 30]
        chars = list(t)
        for _ in range(len(t) * (k % 3) * 3 // 100):
            chars[rnd.randrange(len(chars))] = "x"
        docs.append((k, f"{text}\n {''.join(chars).upper() if k % 2 else ''.join(chars)}  {text}"))
        want.add((k, i))
    docs += [(200 + k, " ".join(word() for _ in range(300))) for k in range(20)] + [(300, None), (301, ""), (0, docs[0][1]), (302, "the " * 5000)]
    short = [(400, "a qz short, b"), (401, "qz\tSHORT"), (402, "qz shorts"), (403, "aqz short"), (404, "xqz short qz short")]
    docs += short
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 item_id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 doc_id")
    got = decontamination.leaks(df, bench)
    exact = {(d, i) for d, t in docs if t is not None for i, x in items[:30] if (e := edits.best_within(decontamination.normalised(x), decontamination.normalised(t) or " ")[0]) <= len(decontamination.normalised(x)) // 10}
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in got.where("doc_id >= 400").collect()} == {(d, i, 0) for d in (400, 401, 404) for i in (52, 54)}
    got = got.where("doc_id < 400")
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert got.count() == len(found) and found <= exact and want <= exact
    assert len(found) >= 0.97 * len(exact)
    assert all(r["edits"] == 0 for r in got.collect() if r["doc_id"] % 3 == 0)
    assert decontamination.leaks(df, bench.limit(0)).count() == decontamination.leaks(df.limit(0), bench).count() == 0
    assert decontamination.recall([t for _, t in items[:10]]) >= 0.95


def test_decontamination_without_spaces(spark):
    rnd = random.Random(12)
    signs = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(n))
    items = [(i, signs(60)) for i in range(12)] + [(20 + i, "".join(rnd.choice("abcdefgh(){};=+_") for _ in range(70))) for i in range(12)]
    docs = []
    for k, (i, t) in enumerate(items):
        chars = list(t)
        for at, new in ((10, ""), (25, "xy"), (45, "z"))[: k % 4]:
            chars[at] = new
        docs.append((i, signs(200) + "".join(chars) + signs(200)))
    df = spark.createDataFrame([*docs, (99, signs(3000))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i): (0, 1, 3, 4)[k % 4] for k, (i, _) in enumerate(items)}


def test_line_dedup_finds_lines_at_the_edit_similarity(spark):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("etaoinshrdlucm") for _ in range(rnd.randrange(2, 9)))
    texts, pairs = [], []
    for size in (12, 18, 27, 35, 60, 120):
        for changed in (1, 2, 4):
            for _ in range(6):
                words = [word() for _ in range(size)]
                other = list(words)
                for i in rnd.sample(range(size), changed):
                    other[i] = word()
                texts += [" ".join(words), " ".join(other)]
                pairs.append((texts[-2], texts[-1]))
    rnd.shuffle(texts)
    want = Groups(range(len(texts)))  # by edit similarity alone
    for a in range(len(texts)):
        for b in range(a):
            if edits.distance(texts[a], texts[b]) * 100 <= max(len(texts[a]), len(texts[b])) * 20:
                want.join(a, b)
    gone = {k for k in range(len(texts)) if want.find(k) != k}
    got = {r["id"] for r in line_dedup.line_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got <= gone and len(gone) > 90 and len(got) >= 0.97 * len(gone)
    assert line_dedup.recall(pairs) >= 0.97


def test_distances_of_many_pairs():
    rnd = random.Random(22)
    left, right = [""], ["abc"]
    for _ in range(900):
        a = [rnd.choice("abcd \u00e9\u4e2d") for _ in range(rnd.choice((1, 9, 63, 64, 65, 128, 200, 700)))]
        b = list(a)
        for _ in range(rnd.randrange(len(a) // 4 + 1)):
            k = rnd.randrange(len(b) + 1)
            b[k : k + rnd.randrange(2)] = rnd.choice(["", "x", "y"])
        left.append("".join(a))
        right.append("".join(b))
    assert edits.distances(left, right).tolist() == [edits.distance(a, b) for a, b in zip(left, right)]
    assert len(edits.distances([], [])) == 0


def test_pairs_within_a_distance():
    rnd = random.Random(23)
    left, right = [""], ["abc"]
    for _ in range(900):
        a = [rnd.choice("abcd \u00e9\u4e2d") for _ in range(rnd.choice((1, 9, 63, 200, 700)))]
        b = list(a)
        for _ in range(rnd.randrange(len(a) // 2 + 1)):
            k = rnd.randrange(len(b) + 1)
            b[k : k + rnd.randrange(2)] = rnd.choice(["", "x", "y"])
        left.append("".join(a))
        right.append("".join(b) if rnd.random() < 0.7 else left[rnd.randrange(len(left))])
    exact, longest = edits.distances(left, right), np.array([max(len(a), len(b)) for a, b in zip(left, right)])
    for most in (exact, exact - 1, exact // 2, longest // 5, longest // 2):
        assert edits.within(left, right, most).tolist() == (exact <= most).tolist()
    assert len(edits.within([], [], np.zeros(0, np.int64))) == 0


def test_lines_are_compared_in_portions(spark, monkeypatch):
    rnd = random.Random(24)
    lines = [" ".join(rnd.choice(VOCABULARY) + rnd.choice("abc") for _ in range(12)) for _ in range(10)]
    texts = [" ".join(w if rnd.random() < 0.95 else "new" for w in rnd.choice(lines).split()) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = lambda: sorted(map(tuple, line_dedup.line_groups(df).collect()))
    want, given, similar = named(), [], line_dedup._similar
    monkeypatch.setattr(line_dedup, "PORTION", 10)
    monkeypatch.setattr(line_dedup, "_similar", lambda percent: given.append(percent) or similar(percent))
    assert named() == want and len(want) > 20 and len(given) > 3  # three rounds, and some of them in portions


def test_groups_of_unlinked_and_linked_members(spark):
    """Groups whose leaders are linked with nobody, a hub, and keys given twice."""
    rnd = random.Random(31)
    place = {c: rnd.randrange(60) for c in range(200)}
    rows = [(k, c) for k in range(25) for c in rnd.sample(range(200), rnd.choice((2, 3, 5, 60)))]
    linked = lambda a, b: abs(place[a] - place[b]) <= 1
    want, mates = Groups(range(200)), defaultdict(set)
    for k, c in rows:
        mates[k].add(c)
    for group in mates.values():
        for a in group:
            for b in group:
                if a < b and linked(a, b):
                    want.join(a, b)
    classes = spark.createDataFrame(list(place.items()), "cls long, place int")
    near = lambda x, y: F.abs(F.col(f"{x}.place") - F.col(f"{y}.place")) <= 9
    table = spark.createDataFrame(list(place.items()), "c long, p int")
    verify = lambda pairs: pairs.join(table.toDF("a", "p"), "a").join(table.toDF("b", "q"), "b").where("abs(p - q) <= 1").select("a", "b")
    got = {r["cls"]: r["component"] for r in graph.linked_components(spark.createDataFrame(rows + rows[:50], "key long, cls long"), classes, near, verify).collect()}
    assert got == {c: want.find(c) for c in got} and set(got) == {c for c in range(200) if any(want.find(c) == want.find(d) for d in range(200) if d != c)}


def test_without_keeps_nulls_and_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "k long, _slot long").withColumns({"__word": F.lit(1), "_bits": F.lit(2)})
    got = graph.without(df, "k", spark.createDataFrame([(1,), (None,)], "k long"))
    assert got.columns == df.columns and sorted(r["_slot"] for r in got.collect()) == [6, 7]


def test_unlike_pairs_are_told_and_like_ones_never(monkeypatch):
    monkeypatch.setattr(edits, "FEW", 1)
    rnd = random.Random(25)
    text = lambda n: "".join(rnd.choice("etaoin shrdlué中") for _ in range(n))
    strings, left, right, near = [text(0), text(5)], [0, 0, 1], [1, 0, 1], [False, True, True]
    for size in (1, 9, 40, 63, 64, 65, 100, 128, 129, 300, 450, 900):
        for k in range(60):
            a = text(size)
            b = list(a) if k % 2 else list(text(size + rnd.randrange(-(size // 9), size // 9 + 1)))
            for _ in range(rnd.randrange(size // 4 + 1) if k % 2 else 0):
                at = rnd.choice((0, rnd.randrange(len(b) + 1), len(b)))  # edits at the ends move the rest
                b[at : at + rnd.randrange(2)] = rnd.choice(["", "x", "yz"])
            strings += [a, "".join(b)]
            left.append(len(strings) - 2 + k % 3 // 2)
            right.append(len(strings) - 1 - k % 3 // 2)
            near.append(bool(k % 2))
    left, right, near = map(np.array, (left, right, near))
    exact = edits.distances([strings[i] for i in left], [strings[i] for i in right])
    longest = np.array([max(len(strings[a]), len(strings[b])) for a, b in zip(left, right)])
    for most in (exact, longest // 5, exact - 1, np.zeros_like(exact)):
        told = edits.unlike(edits.packed(strings), left, right, most)
        assert not (told & (exact <= most)).any()
    told = edits.unlike(edits.packed(strings), left, right, longest // 5)
    assert told[~near & (longest >= 40)].mean() > 0.9  # random text is told without the exact distance
    assert len(edits.unlike(edits.packed([]), *np.zeros((3, 0), np.int64))) == 0
