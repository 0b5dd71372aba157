"""Hard negatives, toxicity and the source audit against brute force, on rows that are hard."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quotemill.llm import divergence, gated_reader, zone_search

VECTORS = "vec_id long, embedding array<float>, label int, grp string, a string, key long"
DOCUMENTS = "doc_id long, text string, lang string, source string, term string, n long"


def negatives_by_force(rows):
    """The contract, pair by pair, in Python's whole numbers."""
    good = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        good.append((i, q, (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, q, label in good:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, r, strict=False)), j, m) for j, r, m in good if j != i]
        for p, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fits = sorted(s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p)[:5]
            out.extend((i, j, n + 1, k, -p, -s) for n, (s, k, _) in enumerate(fits))
    return sorted(out)


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


NEGATIVE = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("shape", ["spread", "grouped"])
def test_hard_negatives_equal_brute_force(spark, shape):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1600, 6)) if shape == "spread" else rng.normal(size=(8, 6))[rng.integers(0, 8, 1600)]
    vectors = vectors / 4 + (rng.normal(size=(1600, 6)) / 40 if shape == "grouped" else 0)
    rows = [(i, [float(x) for x in v], int(rng.integers(0, 3)), "g", "a", 1) for i, v in enumerate(vectors)]
    rows += [(5000 + i, rows[100][1], 1, None, None, None) for i in range(600)]  # a large group of equal vectors
    rows += [(None, [1.0], 1, "", "", 0), (100_000, None, 1, "", "", 0), (100_100, [1.0], None, "", "", 0), (100_200, [], 1, "", "", 0),
             (100_300, [1.0, None], 1, "", "", 0), (100_400, [float("nan")], 1, "", "", 0), (100_500, [float("inf")], 1, "", "", 0),
             (100_600, [0.5, 0.5], 2, "", "", 0), (-700, [0.1] * 8, 0, "", "", 0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = zone_search.hard_negatives(df)
    assert found(got, *NEGATIVE) == negatives_by_force(rows) != []
    assert dict(got.dtypes) == dict.fromkeys(NEGATIVE, "bigint") | {"rank": "int"}


def test_hard_negatives_of_huge_components_repeated_rows_and_nothing(spark):
    rows = [(100, [2.0e6, 1.0], 1), (1, [2.0e6, 1.5], 1), (2, [1.9e6, 7.0], 2), (3, [1.9e6, 7.5], 2), (4, [3.0e6, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert found(zone_search.hard_negatives(df), *NEGATIVE) == negatives_by_force(rows) != []
    assert zone_search.hard_negatives(df.limit(0)).count() == 0
    assert zone_search.hard_negatives(df.where("vec_id <> 100")).count() == 0
    huge = [(100, [3e38], 1), (1, [3e38], 1), (2, [3e38], 2)]
    assert found(zone_search.hard_negatives(spark.createDataFrame(huge, df.schema)), "negative_id", "negative_score") == [(2, 2**63 - 1)]
    twice = zone_search.hard_negatives(df.union(df.where("vec_id = 100")))
    once = negatives_by_force(rows)
    assert found(twice, *NEGATIVE) == sorted(once + once)


@pytest.mark.parametrize(("d", "bits"), [(2, 3), (3, 2), (5, 1)])
def test_the_curve_visits_every_cell_and_steps_to_neighbours(d, bits):
    cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * d, indexing="ij"), -1).reshape(-1, d)
    keys = [k.tobytes() for k in zone_search.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_are_reached():
    rng = np.random.default_rng(2)
    low = rng.integers(-90, 40, (5, 4)).astype(float)
    high = low + rng.integers(0, 60, (5, 4))
    anchors = rng.integers(-50, 50, (7, 4)).astype(float)
    least, most = zone_search.bounds(anchors, low, high, True)
    corners = np.stack(np.meshgrid(*[[0, 1]] * 4), -1).reshape(-1, 4)
    for b in range(5):
        scores = anchors @ (low[b] + corners * (high[b] - low[b])).T
        assert (scores.min(axis=1) == least[:, b]).all() and (scores.max(axis=1) == most[:, b]).all()


def test_blocks_that_cannot_matter_are_not_read():
    space = zone_search.Space(1024, np.array([-500.0]), np.array([500.0]))
    vectors = np.concatenate((np.full((512, 1), 3.0), np.full((512, 1), 9.0)))
    ids, labels = np.arange(1024), np.zeros(1024, np.int64)
    part = zone_search.Part(space, vectors, ids, labels, np.array([[3.0], [9.0]]), np.array([[3.0], [9.0]]), [512, 512])
    part.vectors[:512] = 9  # would be found if the first block were read
    got = list(part.search(np.array([[2.0]]), [-1], [7], [[(18, 18)]], False, 2000))
    assert [row for *_, row, _ in got] == list(range(512, 1024))


def small_network(kind=np.float32):
    network = gated_reader.Network({"river": 1, "stone": 2}, seed=9)
    network.kind = kind
    network.p = {name: value.astype(kind) for name, value in network.p.items()}
    network.p["vocab"][1:] += 0.3
    return network


def test_gradients_equal_finite_differences():
    network = small_network(np.float64)
    words = ["river", "stone", "a", "höhle", "漢字漢"]
    windows = np.array([[0, 1, 2, 3], [4, 4, 1, 0], [2, 3, 0, 0]])
    lengths, labels = np.array([4, 4, 2]), np.array([1.0, 0.0, 1.0])
    _, gradients = network.gradients(words, windows, lengths, labels)
    assert gradients.keys() == network.p.keys()
    rng = np.random.default_rng(1)
    for name, g in gradients.items():
        flat = np.flatnonzero(g) if name in ("grams", "vocab") else np.arange(g.size)
        for at in rng.choice(flat, 6):
            values = []
            for step in (1e-6, -1e-6):
                network.p[name].ravel()[at] += step
                values.append(network.gradients(words, windows, lengths, labels)[0])
                network.p[name].ravel()[at] -= step
            assert (values[0] - values[1]) / 2e-6 == pytest.approx(g.ravel()[at], rel=1e-4, abs=1e-8)


def logit_by_loops(network, words):
    """One window, word by word, unit by unit."""
    p, n = network.p, gated_reader.HIDDEN
    inputs, _ = network.word_inputs(words)
    states = np.zeros((len(words), 2 * n))
    for d in (0, 1):
        h = np.zeros(n)
        for t in range(len(words)) if d == 0 else range(len(words) - 1, -1, -1):
            x, a = inputs[t] @ p["in"][d] + p["bias"][d], h @ p["rec"][d]
            z, r = (1 / (1 + np.exp(-(x[i * n : (i + 1) * n] + a[i * n : (i + 1) * n]))) for i in (0, 1))
            h = (1 - z) * np.tanh(x[2 * n :] + r * a[2 * n :]) + z * h
            states[t, d * n : (d + 1) * n] = h
    e = np.exp([np.tanh(s @ p["att"]) @ p["att_v"] for s in states])
    return (e / e.sum()) @ states @ p["out"] + p["out_b"][0]


def test_reader_equals_loops_over_all_windows():
    network, rng = small_network(), random.Random(3)
    names = ["river", "stone", "Élan", "x", "b" * 130, "漢字"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(names) for _ in range(n)) for n in (1, 31, 32, 33, 55, 56, 57, 200, 0)]
    got = gated_reader.Reader(network).logits(texts)
    for text, found in zip(texts, got, strict=True):
        words = gated_reader.words_of(text)
        starts = gated_reader.starts_of(len(words))
        assert {i for s in starts for i in range(s, min(s + 32, len(words)))} == set(range(len(words)))
        expected = [logit_by_loops(network, words[s : s + 32]) for s in starts]
        assert found.tolist() == pytest.approx(expected, rel=1e-3, abs=1e-4)
    long = " ".join(names * 900)  # more windows than are in work at once
    assert len(gated_reader.Reader(network).logits([long, "x"])[0]) == len(gated_reader.starts_of(len(gated_reader.words_of(long))))


def test_threshold_has_fewest_errors():
    assert gated_reader.threshold(np.array([0.0, 1, 2, 5, 6]), np.array([0, 0, 1, 1, 1], bool)) == 1.5
    assert gated_reader.threshold(np.array([0.0, 1, 2, 9]), np.array([0, 1, 0, 1], bool)) in (0.5, 5.5)
    assert gated_reader.threshold(np.array([1.0, 1.0]), np.array([0, 1], bool)) == 0


def test_toxicity_defined_cases(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice("soft calm blue open warm tall".split()) + str(rng.randint(0, 9)) for _ in range(rng.randint(5, 90))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = "grubble" + rng.choice(["", "d", "st", "ing"])
        rows.append((i, " ".join(words), "en", "s", "t", 1))
        labels += [(i, int(i % 4 == 0), 1)] * (1 + i % 2)
    rows += [(None, "calm", None, None, None, None), (900, None, "en", "", "", 0), (901, "", "en", "", "", 0), (902, " !? ", "en", "", "", 0),
             (903, "soft " * 40_000 + "grubble", "en", "", "", 0), (903, "soft1 " * 200, "en", "", "", 0)]
    labels += [(None, 1, 1), (900, None, 1), (5000, 1, 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    df = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = gated_reader.toxicity(docs, df)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    result = got.collect()
    assert len(result) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in result)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in result)
    held = [r for r in result if r.held_out and r.doc_id < 400]
    right = sum(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert right >= 0.95 * len(held)
    assert [r.score for r in result if r.doc_id in (900, 901, 902)] == [0, 0, 0]
    assert sorted(r.predicted for r in result if r.doc_id == 903) == [0, 1]  # the last of 40,001 words counts
    assert {r.score for r in gated_reader.toxicity(docs, df.limit(0)).collect()} == {0.0}
    assert gated_reader.toxicity(docs.limit(0), df).count() == 0


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    result = gated_reader.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([r.predicted for r in result if r.toxic == y] for y in (1, 0))
    assert sum(toxic) >= 0.75 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def audit_by_force(rows):
    groups = defaultdict(Counter)
    docs = defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for (lang, source), counts in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= 10)
        mine = {s: c for (x, s), c in groups.items() if x == lang}
        whole = Counter()
        for c in mine.values():
            whole.update(c)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return [1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept]

        def gap(p, q):
            return (p - q) * (p - q) // (p + q)

        p, q = shares(counts), shares(whole)
        pairs = [(-sum(map(gap, p, shares(c))), s.encode()) for s, c in mine.items() if s != source]
        terms = [(-gap(x, y), t.encode()) for t, x, y in zip(kept, p, q, strict=True) if counts[t] and x > y]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
            out.extend((lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(items))
    return sorted(out)


PARTS = ("lang", "source", "part", "item", "value", "rank")


def test_audit_equals_brute_force(spark):
    rng = random.Random(12)
    words = ["river", "Stone", "Élan", "ÉLAN", "x́y", "don't", "a_b", "漢字", "\u0085mark", "one\x00two", "naïve", "zz9top"]
    rows = []
    for i in range(700):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", None, "", "only" if i % 50 == 0 else "s3", "é"])
        rows.append((i, rng.choice([" ", "\n", "-"]).join(rng.choice(words[: 4 + i % 9]) for _ in range(rng.randint(0, 20))), lang, source, "t", 1))
    rows += [(None, None, "en", "empty", None, None), (None, "river", "xx", "s1", "", 0), (1, "stone", "xx", "s2", "", 0)]
    rows += [(7, "Big " * 20_000, "en", "s1", "", 0)] * 12
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    got = divergence.audit(df)
    assert found(got, *PARTS) == audit_by_force(rows)
    assert {r[4] for r in audit_by_force(rows) if r[0] == "xx"} == {0}
    assert dict(got.dtypes) == dict.fromkeys(PARTS, "string") | {"value": "bigint", "rank": "int"}
    assert divergence.audit(df.limit(0)).count() == 0


def test_audit_of_more_sources_than_a_tile(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(6)), "en", f"s{i % 150}", "", 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    assert found(divergence.audit(df), *PARTS) == audit_by_force(rows)
