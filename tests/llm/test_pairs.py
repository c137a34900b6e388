"""Near-duplicates (1), new batches against history (5), similar vectors (6): against brute force on small tables."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from ragmill.llm import history, knn, neardup, prefixes, words

VOCABULARY = [f"w{i}" for i in range(400)]


def corpus(seed, families=25, alone=120, longest=90):
    """Texts in families of edited copies: words replaced, put in, taken out, moved."""
    rng = random.Random(seed)
    base = lambda: [rng.choice(VOCABULARY) for _ in range(rng.randint(6, longest))]
    texts = [" ".join(base()) for _ in range(alone)]
    for _ in range(families):
        first = base()
        for _ in range(rng.randint(1, 4)):
            t = list(first)
            for _ in range(rng.randint(0, max(1, len(t) // 6))):
                how, at = rng.randint(0, 3), rng.randrange(len(t))
                if how == 0:
                    t[at] = rng.choice(VOCABULARY)
                elif how == 1:
                    t.insert(at, rng.choice(VOCABULARY))
                elif how == 2 and len(t) > 3:
                    del t[at]
                else:
                    t.append(t.pop(at))
            texts.append(" ".join(t).upper() if rng.random() < 0.2 else ", ".join(t))
        texts.append(" ".join(first))
    texts += ["same here", "same here", "...", "...", "!!!", "one", "One", "x " * 3000, "x " * 2900]
    rng.shuffle(texts)
    return texts


def brute(texts):
    found = set()
    counted = [Counter(words.WORD.findall(t.lower())) if t and t.strip() else None for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = counted[i], counted[j]
        if a is None or b is None:
            continue
        common, total = sum((a & b).values()), a.total() + b.total()
        if texts[i] == texts[j] or (total and common / (total - common) >= 0.75):
            found.add((i, j))
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_pairs_equal_brute_force(spark, seed):
    texts = [*corpus(seed), None, "", "  \n"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "k long, t string, s string")
    got = {(r.key_a, r.key_b) for r in neardup.near_pairs(df, "k", "t", "s").collect()}
    assert got == brute(texts)


def copies_and_versions(seed=7):
    """One text in a third of the rows, with versions of it that have 30 words more or fewer, among others."""
    rng = random.Random(seed)
    hot = [f"h{i}" for i in range(300)]
    texts = [" ".join(hot)] * 60
    for v in range(6):
        texts += [" ".join([*hot[:100], *(f"n{v}x{i}" for i in range(30)), *hot[100:]]), " ".join(hot[30 + v :])]
    return texts + [" ".join(rng.choice(VOCABULARY) for _ in range(80)) for _ in range(108)]


def test_near_pairs_of_a_text_in_a_third_of_the_rows(spark):
    texts = copies_and_versions()
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "k long, t string, s string")
    got = {(r.key_a, r.key_b) for r in neardup.near_pairs(df, "k", "t", "s").collect()}
    assert got == brute(texts)


def test_repeats_of_a_text_in_a_third_of_the_history(spark):
    texts = copies_and_versions()
    hot = texts[0].split()
    old = [(i, None, t) for i, t in enumerate(t for t in texts if t == texts[0] or t[0] == "w")]
    new = [(i, 1, None, " ".join([*hot[:100], *(f"m{i}x{j}" for j in range(30)), *hot[100:]])) for i in range(6)]
    got = history.repeats(spark.createDataFrame(old, "item long, id string, text string"), spark.createDataFrame(new, "in_no long, batch int, id string, text string"), "item", "in_no", "batch")
    assert {(r.in_no, r.batch) for r in got.collect()} == repeats_brute(old, new) == {(i, 1) for i in range(6)}


def mostly_common_words(pairs=100, seed=8):
    """Texts of 60 words that all have and 40 others, each with a version just above the threshold where only others differ."""
    rng = random.Random(seed)
    texts = []
    for _ in range(pairs):
        drawn = rng.sample(VOCABULARY[:300], 54)
        common = [f"c{i}" for i in range(60)]
        texts += [" ".join(common + drawn[:40]), " ".join(common + drawn[14:])]
    return texts


def test_near_pairs_of_texts_of_mostly_common_words(spark):
    texts = mostly_common_words()
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "k long, t string, s string")
    got = {(r.key_a, r.key_b) for r in neardup.near_pairs(df, "k", "t", "s").collect()}
    assert got == brute(texts) and len(got) >= 100


def test_repeats_of_texts_of_mostly_common_words(spark):
    texts = mostly_common_words()
    old, new = [(i, None, t) for i, t in enumerate(texts[::2])], [(i, 1, None, t) for i, t in enumerate(texts[1::2])]
    got = history.repeats(spark.createDataFrame(old, "item long, id string, text string"), spark.createDataFrame(new, "in_no long, batch int, id string, text string"), "item", "in_no", "batch")
    assert {(r.in_no, r.batch) for r in got.collect()} == repeats_brute(old, new) == {(i, 1) for i in range(100)}


def test_near_pairs_within_scopes_and_clashing_names(spark):
    rows = [(1, "a b c d", "x", 1), (2, "a b c d", "x", 1), (3, "a b c d", "y", 1), (4, "d c b a", "y", 1), (5, "a b c d", None, 1), (6, "a b c d", None, 1)]
    df = spark.createDataFrame(rows, "n long, sig string, fp string, key int")
    got = sorted((r.within, r.key_a, r.key_b) for r in neardup.near_pairs(df, "n", "sig", "fp").collect())
    assert [(a, b) for _, a, b in got] == [(5, 6), (1, 2), (3, 4)]
    assert neardup.near_pairs(df.where("false"), "n", "sig", "fp").count() == 0


def test_groups(spark):
    texts = [" ".join(f"v{i + j}" for i in range(20)) for j in range(6)] + ["other text"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(7, None, "s"), (8, "other text", "s")], "k long, t string, s string")
    got = {r.key: (r.group_key, r.links) for r in neardup.groups(df, "k", "t", "s").collect()}
    # Texts one or two apart are alike (19/21, 18/22), so all six hang together.
    assert got == {0: (0, 2), 1: (0, 3), 2: (0, 4), 3: (0, 4), 4: (0, 3), 5: (0, 2), 6: (6, 0), 8: (6, 0)}


def test_depths_keep_the_miss_for_every_size():
    forest = prefixes.Forest(neardup.TREES, neardup.DEEPEST, neardup.MISS)
    for n in range(4, 500):
        d = int(forest.depth(np.array([n]))[0])
        for union in range(n, 8 * n // 7 + 1):
            common = -(-3 * union // 4)
            shared = math.comb(common, d) / math.comb(union, d)
            assert d == prefixes.HEAD or (1 - shared) ** forest.trees <= forest.miss


def test_first_tokens_are_the_first_of_each_order():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 90, 60)
    tokens = rng.integers(0, 2**32, counts.sum(), dtype=np.uint64).astype(np.uint32)
    got = prefixes.first_tokens(tokens, counts, 3, 5)
    single = [prefixes.first_tokens(tokens[i : i + 1], np.array([1]), 3, 1)[0, :, 0] for i in range(len(tokens))]
    ends = np.cumsum(counts)
    for r, (start, end) in enumerate(zip(ends - counts, ends)):
        for j in range(3):
            want = sorted(int(single[i][j]) for i in range(start, end))[:5]
            assert list(got[r, j]) == want + [2**32 - 1] * (5 - len(want))


def test_entries_per_record_are_the_same_at_every_size():
    # Labels, and what a text's own tokens add: nothing in the plan knows how many records there are.
    rng = np.random.default_rng(5)
    forest = prefixes.Forest(neardup.TREES, neardup.DEEPEST, neardup.MISS)
    for rows in (10, 1_000):
        counts = np.full(rows, 60)
        tokens = rng.integers(0, 2**63, counts.sum()).astype(np.uint64)
        prints = rng.integers(0, 2**63, (rows, 2)).astype(np.uint64)
        blobs = list(neardup.entry_parts(forest, np.arange(rows), prints, tokens, counts, 1_000))
        assert sum(len(b) for _, _, b in blobs) == rows * neardup.TREES * 26


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r.node: r.root for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_parities_bound_the_distance():
    rng = np.random.default_rng(1)
    for n in (50, 500, 3000, 7000):
        a = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        b = np.concatenate([a[n // 5 :], rng.integers(1, 2**63, n // 9).astype(np.uint64)])
        apart = len(np.setxor1d(a, b))
        pa, pb = (neardup.parities(x, np.zeros(len(x), np.int64), np.array([len(x)]))[0] for x in (a, b))
        m, start = min(len(pa), len(pb)), 0
        for width, _ in neardup.PARITY_LEVELS:
            if start + width <= m:
                differ = (pa[:m] ^ pb[:m])[start : start + width].view(np.uint64)
                assert np.bitwise_count(differ).sum() <= apart
            start += width


def repeats_brute(old, new):
    same = lambda a, b: bool(a and b and a.strip() and b.strip()) and (a == b or words.similarity(a, b) >= 0.75)
    norm = lambda s: (s or "").strip().lower()
    accepted, cases = [(norm(i), t) for _, i, t in old], set()
    for k, b, i, t in sorted(new, key=lambda r: (r[1], r[0])):
        if any((norm(i) and norm(i) == x) or same(t, y) for x, y in accepted):
            cases.add((k, b))
        else:
            accepted.append((norm(i), t))
    return cases


@pytest.mark.parametrize("seed", [4, 5])
def test_repeats_equal_replay(spark, seed):
    rng = random.Random(seed)
    texts = corpus(seed, families=20, alone=60)
    ids = [None, "", " ", *[f"id{i}" for i in range(60)]]
    rows = [(i, rng.choice(ids), t) for i, t in enumerate([*texts, None, " "])]
    old, new = rows[: len(rows) // 2], [(i, rng.randint(1, 5), f" {d.upper()}\t" if d and rng.random() < 0.3 else d, t) for i, d, t in rows[len(rows) // 2 :]]
    got = history.repeats(spark.createDataFrame(old, "item long, id string, text string"), spark.createDataFrame(new, "in_no long, batch int, id string, text string"), "item", "in_no", "batch")
    assert {(r.in_no, r.batch) for r in got.collect()} == repeats_brute(old, new)


def test_repeats_without_history_or_batch(spark):
    old = spark.createDataFrame([(1, "a", "some words here")], "item long, id string, text string")
    new = spark.createDataFrame([(1, 1, "b", "some words here"), (2, 1, "c", "quite other words"), (3, 2, "C ", None)], "in_no long, batch int, id string, text string")
    run = lambda a, b: sorted(r.in_no for r in history.repeats(a, b, "item", "in_no", "batch").collect())
    assert run(old, new) == [1, 3]
    assert run(old.where("false"), new) == [3]
    assert run(old, new.where("false")) == []


def test_chain_is_settled_in_order(spark):
    # Each is like its neighbours only, so every other one stays.
    new = [(i, 1, None, " ".join(f"v{4 * i + j}" for j in range(40))) for i in range(9)]
    df = spark.createDataFrame(new, "in_no long, batch int, id string, text string")
    old = spark.createDataFrame([], "item long, id string, text string")
    got = {(r.in_no, r.batch) for r in history.repeats(old, df, "item", "in_no", "batch").collect()}
    assert got == repeats_brute([], new) == {(i, 1) for i in (1, 3, 5, 7)}


@pytest.mark.parametrize("rounds, most", [(1, 500_000), (2, 500_000), (1, 5)])
def test_a_chain_is_settled_alike_in_rounds_and_by_component(spark, monkeypatch, rounds, most):
    monkeypatch.setattr(history, "MOST_TOGETHER", most)
    rng = random.Random(2)
    marks = [(b, k, f"t{k}", True) for b, k in enumerate(range(12))] + [(k, k, f"t{j}", False) for k in range(12) for j in (k - 1, k + 1) if 0 <= j < 12]
    marks += [(None if k < 45 else 1, k, f"i{rng.randrange(6)}", True) for k in range(40, 60)]
    rows = sorted({(-1 if b is None else b, k) for b, k, _, _ in marks})
    own = lambda r: {m for b, k, m, o in marks if o and (-1 if b is None else b, k) == r}
    every = lambda r: {m for b, k, m, _ in marks if (-1 if b is None else b, k) == r}
    held, late = set(), set()
    for r in rows:
        if held & every(r):
            late.add(r[1])
        else:
            held |= own(r)
    df = spark.createDataFrame([((b, k), m, o) for b, k, m, o in marks], "ord struct<batch:int,key:bigint>, mark string, own boolean")
    assert {r.ord.key for r in history.settle(df, rounds).collect()} == late and len(late) > 15


def test_hot_groups_are_compared_block_by_block(monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 7)
    rng = np.random.default_rng(8)
    forest = prefixes.Forest(40, 6, 1e-3)
    rows = 120
    label = np.repeat(np.array([5, 6, 5 << 16, 9 << 40], np.uint64), 30) + (rng.integers(0, 3, rows).astype(np.uint64) << np.uint64(1))
    fields = (label, np.arange(rows) + 2**40 * rng.integers(0, 2), rng.integers(5, 90, rows).astype(np.uint16), rng.integers(0, 4, rows).astype(np.uint64), np.zeros(rows, np.uint32), np.arange(rows).astype(np.uint16))
    entries = prefixes.Entries(*fields)
    pairs = lambda parts: set(zip(*(x.tolist() for x in prefixes.distinct_pairs(parts))))
    whole, hot = pairs(prefixes.self_pairs(entries, forest)), []
    cold = pairs(prefixes.self_pairs(entries, forest, hot))
    blocks = pairs(p for d, one, two in hot for p in prefixes.block_pairs(d, one, two, forest))
    assert hot and len(whole) > 100 and cold | blocks == whole


def test_cross_pairs_are_those_of_both_sides_together():
    rng = np.random.default_rng(9)
    forest = prefixes.Forest(40, 6, 1e-3)
    rows = 300
    fields = (rng.integers(0, 6, rows).astype(np.uint64) << np.uint64(16), np.arange(rows), rng.integers(5, 90, rows).astype(np.uint16), rng.integers(0, 4, rows).astype(np.uint64), np.zeros(rows, np.uint32), np.arange(rows).astype(np.uint16))
    one, two = (prefixes.Entries(*(x[part] for x in fields)) for part in (slice(0, 150), slice(150, rows)))
    cross = set(zip(*(x.tolist() for x in prefixes.distinct_pairs(prefixes.cross_pairs(one, two, forest)))))
    both = set(zip(*(x.tolist() for x in prefixes.distinct_pairs(prefixes.self_pairs(prefixes.Entries(*fields), forest)))))
    assert cross == {(a, b) for a, b in both if (a < 150) != (b < 150)} and cross


def entries_of(forest):
    from ragmill.llm.prefixes import fields_of

    rows = forest.entries().collect()
    return sorted((r.bucket, r.kind, int(label), int(key)) for r in rows for label, key in zip(*fields_of([r.base], [r.blob])[:2]))


def test_forest_runs(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"id{i}", t) for i, t in enumerate(corpus(6, families=5, alone=20))], "k long, id string, t string")
    forest = history.Forest.create(f"file://{tmp_path}/f", texts.where("k < 20"), "k", "t", buckets=5, slots=3)
    forest.append(texts.where("k >= 20"), "k", "t")
    before, found = entries_of(forest), sorted(forest.find(texts, "k", "t").collect())
    assert len(forest.runs()) == 2 and found
    (tmp_path / "f/run-000007-000009/labels").mkdir(parents=True)  # a merge that broke off
    forest.merge_runs()
    again = history.Forest(spark, f"file://{tmp_path}/f")
    assert len(again.runs()) == 1
    # Copies in different runs are one entry after merging.
    assert {e[:3] for e in entries_of(again)} == {e[:3] for e in before}
    assert {(r.a, r.how) for r in again.find(texts, "k", "t").collect()} == {(r.a, r.how) for r in found}


def test_batches_taken_one_by_one_equal_a_replay(spark, tmp_path):
    rng = random.Random(11)
    texts = corpus(11, families=12, alone=30)
    rows = [(i, rng.choice([None, *[f"id{j}" for j in range(40)]]), t) for i, t in enumerate(texts)]
    old, new = rows[: len(rows) // 2], [(i, b, d, t) for b, part in enumerate(np.array_split(np.arange(len(rows) // 2, len(rows)), 3)) for i, d, t in (rows[j] for j in part)]
    forest = history.Forest.create(f"file://{tmp_path}/f", spark.createDataFrame(old, "k long, id string, text string"), "k", "text", buckets=4, slots=4)
    got = set()
    for b in range(3):
        batch = spark.createDataFrame([r for r in new if r[1] == b], "in_no long, batch int, id string, text string")
        got |= {(r.in_no, r.batch) for r in forest.take(batch, "in_no", "batch").collect()}
    assert got == repeats_brute(old, new) and len(forest.runs()) == 4


def test_lookups_read_what_the_batch_needs_whatever_the_history(spark, tmp_path):
    batch = spark.createDataFrame([(i, 1, None, " ".join(f"q{i}x{j}" for j in range(50))) for i in range(1)], "in_no long, batch int, id string, text string")
    read = []
    for n in (700, 4_200):
        rng = random.Random(n)
        texts = [" ".join(f"z{rng.randrange(5000)}" for _ in range(60)) for _ in range(n)] + [" ".join(f"q{i}x{j}" for j in range(48)) for i in range(1)]
        old = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "k long, id string, text string")
        forest = history.Forest.create(f"file://{tmp_path}/f{n}", old, "k", "text", buckets=4, slots=4, block=32, texts_together=20)
        rows = history.as_rows(batch, "in_no", "id", "text")
        met = forest.meet(rows)
        held = forest.held(rows, met)
        size = sum(p.stat().st_size for p in (tmp_path / f"f{n}").rglob("*.parquet"))
        read.append((met.where(f"kind = {history.READ}").agg({"a": "sum"}).first()[0] + held.agg({"read": "sum"}).first()[0], size))
        assert {(r.a, r.b) for r in held.where("tb is not null").collect()} == {(i, n + i) for i in range(1)}
    (few, small), (more, large) = read
    assert large > 5 * small and more < 1.5 * few


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def exact(x, k):
    x = x.astype(np.float32).astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    return [sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k] for i in range(len(x))], s


def test_nearest_in_one_part_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(270, 8)) * rng.uniform(0.1, 30, (270, 1))
    x[40:60] = x[5]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [1.0] * 7), (1005, [float("inf")] + [1.0] * 7)]
    got = knn.nearest(vectors(spark, x, bad), "id", "embedding", 10, 8).toPandas()
    want, s = exact(x, 10)
    for i, g in got.groupby("key"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11))
        assert np.allclose(g.score, [s[i, j] for j in want[i]], atol=2e-6)
    assert set(got.key) == set(range(270))
    copies = got[got.key == 5].sort_values("rank")
    assert list(copies.neighbour) == list(range(40, 50))


def clustered(rows=3000, hot=900):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 16))
    x = centres[rng.integers(0, 25, rows)] + 0.6 * rng.normal(size=(rows, 16))
    x[:hot] = x[0] + 1e-3 * rng.normal(size=(hot, 16))  # a third of the rows in one place
    return x


def recall_of(got, x):
    want, s = exact(x, 10)
    kth = {i: s[i, want[i][-1]] for i in range(len(x))}
    assert len(got) == 10 * len(x) and not got.duplicated(["key", "neighbour"]).any()
    return np.mean([s[k, n] >= kth[k] - 2e-6 for k, n in zip(got.key, got.neighbour)])


@pytest.mark.parametrize("most_parts", [1_024, 8])
def test_nearest_recall_with_parts_and_cells(spark, monkeypatch, most_parts):
    monkeypatch.setattr(knn, "CELL", 150)
    monkeypatch.setattr(knn, "BLOCK", 200)
    monkeypatch.setattr(knn, "MOST_PARTS", most_parts)
    x = clustered()
    assert recall_of(knn.nearest(vectors(spark, x), "id", "embedding", 10, 16).toPandas(), x) >= 0.95


def test_visits_per_vector_stay_level_when_parts_are_few(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 150)
    monkeypatch.setattr(knn, "MOST_PARTS", 8)
    rng, visits = np.random.default_rng(6), []
    for rows in (4_800, 14_400):
        units = knn.unit_vectors(vectors(spark, rng.normal(size=(rows, 6))), "id", "embedding", 6).cache()
        found = knn.fit(units, 10, 6)
        assert found.top.parts == 8 and knn.total_cells(found) >= rows // 400
        query, _ = found.visits(knn._matrix(units.select("vec").toArrow().column("vec"), 6))
        visits.append(len(query) / rows)
        units.unpersist()
    assert visits[1] < 1.5 * visits[0]


def test_routing_is_calibrated_to_the_recall_first_set():
    assert knn.RECALL >= 0.985


def test_mutual_and_too_few(spark):
    got = knn.nearest(vectors(spark, np.eye(3)[[0, 0, 1]]), "id", "embedding", 10, 3)
    assert sorted((r.key, r.neighbour) for r in got.collect()) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert [(r.a, r.b) for r in knn.mutual(got, 0.9).collect()] == [(0, 1)]
    assert knn.nearest(vectors(spark, np.zeros((0, 3))), "id", "embedding", 10, 3).count() == 0
    assert knn.nearest(vectors(spark, np.ones((1, 3))), "id", "embedding", 10, 3).count() == 0


def test_nearest_in_rounds_is_the_same_and_sends_less_at_once(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 150)
    monkeypatch.setattr(knn, "BLOCK", 100)  # the hot cell has several blocks
    x, sent, written = clustered(1500, 500), [], knn.materialise
    x[700:720] = x[5]

    def watched(df, name):
        if name in ("lists", "best"):
            sent.append(name)
        return written(df, name)

    monkeypatch.setattr(knn, "materialise", watched)
    run = lambda: {(r.key, r.neighbour, round(r.score, 6), r["rank"]) for r in knn.nearest(vectors(spark, x), "id", "embedding", 10, 16).collect()}
    monkeypatch.setattr(knn, "PER_ROUND", 10**6)
    whole = run()
    assert sent == ["best"]
    monkeypatch.setattr(knn, "PER_ROUND", 1)
    sent.clear()
    assert run() == whole and len(whole) == 10 * len(x) and len(sent) > 3
