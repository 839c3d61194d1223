"""Resampling, ranked search and embedding classes against plain versions."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pytest

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def texts(seed, n, vocabulary=("the", "Of", "red-ring", "café", "東京", "x1", "y2", "long" * 9, "a_b", "q", "\U0001f600z")):
    rng = random.Random(seed)
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(n)]


# --- resampling -------------------------------------------------------------------------------------


def features(text):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, percent, min_words):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    own, goal = (collections.Counter(bucket(f) for t in ts for f in features(t)) for ts in ([t for _, t in docs], target))
    s, t = sum(own.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000))))
    out = []
    for i, text in docs:
        weight = sum(gain(bucket(f)) for f in features(text))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= min_words))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    return out, drawn


def test_resampling_against_a_plain_version(spark):
    from folio.llm.importance import resample

    rows = [(i, t, "x", 1) for i, t in enumerate(texts(1, 150))]
    rows += [(900, None, "x", 1), (901, "", "x", 1), (902, "?! \n", "x", 1), (None, texts(2, 1)[0] + " the" * 30, "x", 1), (903, "one", "x", 1), (904, "one two", "x", 1)]
    rows += [rows[3], rows[3]] + [(905, "the of " * 60_000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, weight string, planes int")
    target = texts(3, 20, ("the", "café", "x1", "new")) + [None, ""]
    got = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=20, min_words=20).collect()
    want, drawn = plain_resample([(r[0], r[1]) for r in rows], target, 20, 20)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted((r[:4] for r in want), key=key)
    chosen = sorted((r["rank"], r["score"], r["doc_id"]) for r in got if r["rank"] is not None)
    assert chosen == [(n + 1, r[3], r[0]) for n, r in enumerate(drawn)] and len(drawn) > 10


def test_resampling_of_empty_tables(spark):
    from folio.llm.importance import resample

    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).collect() == []
    assert [r["weight"] for r in resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).collect()] != []


def test_planes_carry_exact_sums():
    from folio.llm.importance import BUCKETS, count_planes, gain_planes, plane_weights

    rng = np.random.default_rng(4)
    counts = rng.integers(0, 3, (5, BUCKETS)) * rng.integers(0, 1 << 33, (5, BUCKETS))
    counts[2] = 0
    gains = rng.integers(-9000, 9000, BUCKETS)
    assert plane_weights(count_planes(counts), gain_planes(gains)).tolist() == [sum(int(a) * int(b) for a, b in zip(c, gains, strict=True)) for c in counts]
    assert plane_weights(count_planes(counts), gain_planes(np.zeros(BUCKETS, np.int64))).tolist() == [0] * 5


def test_long_texts_are_cut_like_short_ones(monkeypatch):
    from folio.llm import importance, word_pieces

    text = " ".join(texts(5, 40))
    whole = importance.bucket_counts(text, importance._Words(16))
    assert list(whole[1]) == list(np.bincount([zlib.crc32(f.encode()) % 10000 for f in features(text)], minlength=10000))
    monkeypatch.setattr(word_pieces, "PIECE", 7)
    monkeypatch.setattr(importance, "MEMO_WORDS", 3)
    pieces = importance.bucket_counts(text, importance._Words(3))
    assert pieces[0] == whole[0] and (pieces[1] == whole[1]).all()


def test_ranks_follow_the_order_over_partitions(spark):
    from pyspark.sql import functions as F

    from folio.operators.ranks import ranked

    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, 3, 4]), i, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, rank string")
    got = ranked(df, [F.desc_nulls_last("a"), F.col("b")]).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted((r["rank"], r["a"], r["b"]) for r in got) == [(n + 1, a, b) for n, (a, b, _) in enumerate(want)]
    assert ranked(df.limit(0), [F.col("a")]).collect() == []


# --- ranked search ----------------------------------------------------------------------------------


def plain_search(docs, items, k=20):
    rows = [(i, collections.Counter(words_of(t))) for i, t in docs]
    rows = [(i, c, sum(c.values())) for i, c in rows if c]
    n_docs, n_words = len(rows), sum(n for _, _, n in rows)
    df = collections.Counter(w for _, c, _ in rows for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in rows:
            m = 100 - 25 + (25 * n * n_docs) // n_words
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, q in collections.Counter(words_of(text)).items() if c[w])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("item_terms", [200_000, 12])
def test_search_against_a_plain_version(spark, monkeypatch, item_terms):
    from folio.llm import ranked_search

    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of"] * 30 + ["東京"]
    rows = [(i, t) for i, t in enumerate(texts(7, 300, vocabulary))]
    rows += [(400, None), (401, ""), (402, "--"), (None, "w1 w2 w3 the"), (403, "w1 w2 w3 the"), (404, "w1 w2 w3 the"), (404, "w1 w2 w3 the"), (405, "w1 of " * 150_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, score int").repartition(3)
    items = [(1, "W1 w2 the"), (2, "the the of"), (3, None), (4, ""), (5, "unknown"), (None, "w7 w7 w8 of"), (1, "W1 w2 the"), (6, " ".join(vocabulary)), (7, "w5")]
    got = ranked_search.top_documents(docs, spark.createDataFrame([(*r, 0) for r in items], "item_id int, text string, rank int"), item_terms=item_terms)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == plain_search(rows, items)


def test_search_over_empty_tables(spark):
    from folio.llm.ranked_search import top_documents

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert top_documents(docs.limit(0), items).collect() == [] and top_documents(docs, items.limit(0)).collect() == []


def test_blocks_stop_creating_accumulators_and_lose_nothing():
    from folio.llm.ranked_search import _Block

    rng = np.random.default_rng(8)
    for _ in range(60):
        n, k = int(rng.integers(1, 200)), int(rng.integers(1, 6))
        rows = [sorted(rng.choice(30, int(rng.integers(1, 12)), replace=False, p=np.arange(1, 31) / 465).tolist()) for _ in range(n)]
        lengths = np.array([len(r) + int(rng.integers(0, 50)) for r in rows])
        times = rng.integers(1, 4, sum(map(len, rows)))
        block = _Block(lengths, np.array([len(r) for r in rows]), np.concatenate(rows), times, n, int(lengths.sum()))
        terms = [(t, int(31 - t)) for t in range(30)]  # rare terms have small numbers and high weights
        exact, at = [], 0
        for r, length in zip(rows, lengths.tolist(), strict=True):
            m = 75 + 25 * length * n // int(lengths.sum())
            exact.append(sum((31 - t) * (10**9 * int(f) // (1000 * int(f) + 12 * m)) for t, f in zip(r, times[at : at + len(r)], strict=True)))
            at += len(r)
        least = int(rng.choice([1, sorted(exact)[len(exact) // 2]]))
        found, scores = block.best(terms, k, least)
        assert all(exact[d] == s for d, s in zip(found.tolist(), scores.tolist(), strict=True))
        want = sorted((-s, d) for d, s in enumerate(exact) if s >= max(least, 1))[:k]
        assert sorted((-s, d) for d, s in zip(found.tolist(), scores.tolist(), strict=True))[:k] == want


# --- embeddings -------------------------------------------------------------------------------------


def plain_embeddings(rows, threshold=0.98):
    """(id, links, component, kept) of each row."""
    good = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    scaled = [np.array(v) / max(map(abs, v)) if good(v) else None for _, v, _ in rows]
    units = [None if v is None else v / np.linalg.norm(v) for v in scaled]
    links = [[j for j in range(len(rows)) if j != i and units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and (rows[i][1] == rows[j][1] or units[i] @ units[j] >= threshold)] for i in range(len(rows))]
    component, least = [-1] * len(rows), [None] * len(rows)
    for i in range(len(rows)):
        if component[i] < 0:
            seen, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            for j in seen:
                component[j] = i
                least[j] = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
    return [(r[0], len(links[i]), least[i], least[i] == r[0]) for i, r in enumerate(rows)]


def near_vectors(rng, n, dim, spread):
    centre = rng.standard_normal(dim)
    centre /= np.linalg.norm(centre)
    out = centre + spread * rng.standard_normal((n, dim)) / np.sqrt(dim)
    return (out * rng.uniform(0.5, 2, (n, 1))).astype(np.float32).astype(float).tolist()


def test_embeddings_against_all_pairs(spark, monkeypatch):
    from folio.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "TILE", 16)  # large cells are dealt out
    rng = np.random.default_rng(9)
    vectors = [(v, 1) for v in rng.standard_normal((80, 16)).tolist()]
    vectors += [(v, label) for label, n, spread in ((1, 60, 0.13), (2, 30, 0.12), (2, 8, 0.05), (None, 5, 0.01), (3, 40, 0.02)) for v in near_vectors(rng, n, 16, spread)]
    vectors += [(v, 1) for v in near_vectors(rng, 5, 8, 0.02)]
    vectors += [vectors[100]] * 7 + [(vectors[100][0], 2)]
    vectors += [(None, 1), ([], 1), ([0.0] * 16, 1), ([0.0] * 16, 1), ([float("nan")] + [1.0] * 15, 1), ([float("inf")] + [1.0] * 15, 1), ([None] + [1.0] * 15, 1), ([1e300] * 16, 5), ([1e-300] * 16, 5), ([1.0, -0.0], 6), ([2.0, 0.0], 6)]
    rows = [(i, v, label) for i, (v, label) in enumerate(vectors)]
    rng.shuffle(rows)
    rows = [(None if n in (3, 50) else i, v, label) for n, (i, v, label) in enumerate(rows)] + [rows[10], rows[10]]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, label int, node int, cells int")
    got = sorted(map(tuple, embedding_dedup.embedding_classes(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
    assert got == sorted(plain_embeddings(rows), key=repr)
    assert sum(1 for r in got if r[1] > 0) > 100


def test_embeddings_of_an_empty_table(spark):
    from folio.llm.embedding_dedup import embedding_classes

    assert embedding_classes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_lattice_points_are_nearest_and_cells_find_near_vectors():
    from folio.llm.embedding_dedup import Lattice, cells_of, nearest_lattice_points, shortest_vectors, unit

    steps = shortest_vectors()
    assert len({tuple(v) for v in steps}) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    rng = np.random.default_rng(10)
    x = rng.uniform(-3, 3, (400, 8))
    points = nearest_lattice_points(x)
    off = ((x - points) ** 2).sum(axis=1)
    assert off.max() <= 1 + 1e-9  # the covering radius
    assert all((((x - (points + s)) ** 2).sum(axis=1) >= off - 1e-9).all() for s in steps)  # no neighbour is nearer
    for dim, least in ((64, 0.99), (256, 0.99), (16, 0.99)):
        a = unit(rng.standard_normal((1000, dim)))
        z = rng.standard_normal((1000, dim))
        z = unit(z - (z * a).sum(axis=1, keepdims=True) * a)
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * z  # cosine 0.98, the hardest
        met = (cells_of(a, Lattice())[:, :, None] == cells_of(b, Lattice())[:, None, :]).any(axis=(1, 2))
        assert met.mean() >= least
