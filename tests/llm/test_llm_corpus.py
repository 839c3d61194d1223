"""Corpus-wide operators against plain versions: near duplicates, WARC, scores, mixing, the pipeline."""

import base64
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
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_classes(rows, similarity=0.8):
    """Least id of each row's class, by all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or (sets[i] and sets[j] and inter >= similarity * (len(sets[i]) + len(sets[j]) - inter) - 1e-9):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(rows))]


def near_rows(seed, base_words, copies, edits):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(base_words)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        out.append(" ".join(own))
    return out + [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(60)]


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    from folio.llm import word_hashes as w

    rng = random.Random(31)
    texts = ["".join(rng.choice(["ab", "é", " ", "\n", "  ", "x" * 40, "-"]) for _ in range(rng.randint(0, 40))) for _ in range(50)] + ["", " ", "y" * 500]
    for kind, lower in ((w.NOT_SPACE, False), (w.ALNUM, True)):
        want = w.hash_words(texts, kind, lower)
        one = {x: w.hash_words([x], kind, lower)[0] for t in texts for x in (re.findall(r"[^\x20\x09-\x0D]+", t) if not lower else re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t))}
        assert len(want[0]) == want[1][-1] and all(len(h) == 1 and h[0] in want[0] for h in one.values()) and len({int(h[0]) for h in one.values()}) == len(one)
        for piece in (1, 7, 64):
            monkeypatch.setattr(w, "PIECE", piece)
            got = w.hash_words(texts, kind, lower)
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        monkeypatch.undo()
    assert len(w.hash_words([], w.NOT_SPACE)[0]) == 0


def test_near_duplicates_equal_all_pairs(spark):
    from folio.llm.minhash_dedup import near_duplicate_classes

    texts = near_rows(1, 120, 70, 9) + near_rows(2, 300, 25, 3) + ["", None, "  \n", "one two", "one  two", "one three"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5000, texts[0]), (5000, texts[0]), (None, "nobody else has this text")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class_id long").repartition(5)
    got = near_duplicate_classes(df).collect()
    want = plain_classes(rows)
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in got) == collections.Counter((d, c) for (d, _), c in zip(rows, want))
    kept = collections.Counter(r["class_id"] for r in got if r["keep"])
    assert set(kept.values()) == {1} and set(kept) == set(want)
    assert all(r["doc_id"] == r["class_id"] for r in got if r["keep"])
    assert near_duplicate_classes(df.limit(0)).count() == 0


def test_weighted_near_duplicates_equal_all_pairs(spark):
    from folio.llm.minhash_dedup import near_duplicate_classes

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    texts = [" ".join(base), " ".join(base * 3), " ".join(base * 3 + base[:20]), " ".join(base + base[:3]), " ".join(rng.choice(vocabulary) for _ in range(60))]
    bags = [collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(words_of, texts)]
    alike = lambda a, b: sum((a & b).values()) >= 0.8 * sum((a | b).values())
    want = {}
    for i in range(len(texts)):
        want[i] = next((want[j] for j in range(i) if alike(bags[i], bags[j])), i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(df, weighted=True).collect()} == want == {0: 0, 1: 1, 2: 1, 3: 0, 4: 4}
    assert {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    from folio.operators import joins
    from folio.llm import minhash_dedup as m

    monkeypatch.setattr(m, "SMALL_BUCKET", 3)
    monkeypatch.setattr(m, "BLOCK", 16)
    monkeypatch.setattr(m, "BLOCK_ELEMENTS", 900)
    monkeypatch.setattr(m, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(joins, "HEAVY_PART", 0.05)
    rows = list(enumerate(near_rows(7, 90, 110, 12)))
    got = {r["doc_id"]: r["class_id"] for r in m.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip((i for i, _ in rows), plain_classes(rows)))


def test_signatures_estimate_weighted_similarity():
    from folio.llm.minhash_dedup import dart_minhash
    from folio.llm.word_hashes import mix

    rng = np.random.default_rng(3)
    element = mix(np.arange(40, dtype=np.uint64))
    a, b = rng.uniform(0.2, 9, 40), rng.uniform(0.2, 9, 40)
    a[:10] = 0
    of = np.repeat([0, 1], [30, 40])
    weight = np.concatenate([a[10:], b])
    signature, some = dart_minhash(of, np.concatenate([element[10:], element]), weight, 2, 4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert some.all() and abs((signature[0] == signature[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 4000)


def test_components_on_a_chain(spark):
    from folio.llm.components import components

    chain = [(i, i + 1) for i in range(0, 50)] + [(100, 102), (101, 102), (7, 7)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_warc_round_trip(spark):
    from folio.llm.warc import MAGIC, warc_round_trip

    inner = f"é{MAGIC}WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n{MAGIC}tail"
    rows = [
        (1, "u", "x"), (2, f"u\r\n{MAGIC}", "x"), (3, None, None), (4, "é", ""), (None, "q", "null id"), (5, "a", inner), (6, "a", MAGIC), (7, "a", "\r\n\r\n"),
        (8, "a", MAGIC * 3 + "\r\n"), (9, "a", "x" * 300_000 + MAGIC + "y"), (5, "a", inner), (None, "q", "both null"), (None, "q", "both null"), (10, "b", inner),
    ]
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max((x for x in (largest.get(h or ""), i) if x is not None), default=None)

    def want(i, html):
        raw = (html or "").encode()
        revisit = i != largest[html or ""]
        return i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", largest[html or ""] if revisit else None

    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
        got = warc_round_trip(df).collect()
        assert warc_round_trip(df.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter(want(i, h) for i, _, h in rows)
    assert all(r["verified"] for r in got)


def test_warc_of_many_splits_and_copies(spark, monkeypatch):
    """Records over many small splits, false records inside payloads, and more copied payloads than a broadcast takes."""
    from folio.llm import warc

    monkeypatch.setattr(warc, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(warc, "HEAVY_PART", 0.2)
    rng = random.Random(2)
    false = f"{warc.MAGIC}WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, "u", "" if i % 3 == 0 else f"copy {i % 8}" if i % 3 == 1 else f"{i} " + "".join(rng.choice([false, warc.MAGIC, "x" * 900]) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    largest = {h: i for i, _, h in rows}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(i, len(h), largest[h] if largest[h] != i else None) for i, _, h in rows}
    assert {(r["page_id"], r["payload_bytes"], r["refers_to"]) for r in got} == want and len(got) == 150 and all(r["verified"] for r in got)


def test_warc_pieces_survive_other_splits(spark, monkeypatch):
    from folio.llm import warc

    sizes, pieces = iter(["50000", "9000"]), warc._pieces

    def read(session, path):
        session.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return pieces(session, path)

    monkeypatch.setattr(warc, "_pieces", read)
    rows = [(i, "u", f"{i} " + "x" * 7000 + warc.MAGIC + "y" * (i % 7)) for i in range(60)]
    try:
        got = warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["page_id"] for r in got) == list(range(60)) and all(r["verified"] for r in got)


def topic_rows():
    rng = random.Random(9)
    topics = [["".join(rng.choice(letters) for _ in range(4)) for _ in range(60)] for letters in ("abcde", "vwxyz")]
    rows = []
    for i in range(300):
        words = rng.choice(topics)
        rows.append((i, " ".join(rng.choice(words[: rng.choice([10, 60])]) for _ in range(rng.randint(1, 80)))))
    return rows


def test_scores(spark):
    from folio.llm.hmm import score_texts

    rows = [*topic_rows(), (900, None), (901, ""), (None, "The the THE zzqq"), (902, "É é\x0bx")]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = {i: [*words_of((t or "").translate(LOWER)), None] for i, t in rows}
    counts = collections.Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in got:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(own), sum(w in counts for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
    out = [r for r in got if r["held_out"]]
    assert len(got) == len(rows) and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def plain_forward(model, s):
    """All filtered states, unscaled, and log10 of the likelihood."""
    alphas, log, alpha = [], 0.0, None
    for x in s:
        alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[x]
        log += math.log10(alpha.sum())
        alpha = alpha / alpha.sum()
        alphas.append(alpha)
    return alphas, log


def plain_counts(model, s):
    """Expected starts, moves and emissions of one sequence, by the textbook."""
    alphas, _ = plain_forward(model, s)
    states = len(model.start)
    moves, emits, beta = np.zeros((states, states)), np.zeros(model.emit.shape), np.ones(states)
    for t in range(len(s) - 1, -1, -1):
        gamma = alphas[t] * beta
        emits[s[t]] += gamma / gamma.sum()
        if t:
            both = alphas[t - 1][:, None] * model.move * (model.emit[s[t]] * beta)[None]
            moves += both / both.sum()
            beta = model.move @ (model.emit[s[t]] * beta)
            beta /= beta.sum()
    return gamma / gamma.sum(), moves, emits


@pytest.mark.parametrize("segment", [1, 4, 7, 1000])
def test_segments_change_nothing(segment):
    from folio.llm import hmm

    rng = np.random.default_rng(1)
    model = hmm.Model.first(rng.dirichlet(np.ones(50)), 3)
    model.start = rng.dirichlet(np.ones(3))
    sequences = [rng.integers(0, 50, size).astype(np.uint16) for size in (1, 5, 8, 4, 29, 3)]
    assert hmm.log10_likelihood(model, sequences, segment) == pytest.approx([plain_forward(model, s)[1] for s in sequences])
    want = [sum(x) for x in zip(*(plain_counts(model, s) for s in sequences), strict=True)]
    for got, plain in zip(hmm.expected_counts(model, sequences, segment), want, strict=True):
        assert np.allclose(got, plain, rtol=1e-3, atol=1e-4)


def plain_scores(rows, states, iterations, own, classes):
    """The whole method with loops: ranks, classes, Baum-Welch and the score."""
    from folio.llm.hmm import Model

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [[*(w.encode() for w in words_of((t or "").translate(LOWER))), b""] for _, t in rows]
    counts = collections.Counter(w for (i, _), ws in zip(rows, tokens) if not held(i) for w in ws)
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    number = {w: k for k, w in enumerate(ranked[:own])}
    symbol = lambda w: number.get(w, own + zlib.crc32(w[-3:]) % classes)
    n, v = np.zeros(own + classes), np.zeros(own + classes)
    for w, c in counts.items():
        n[symbol(w)] += c
        v[symbol(w)] += 1
    unigram = n / max(n.sum(), 1)
    model = Model.first(unigram, states)
    coded = [[symbol(w) for w in ws] for ws in tokens]
    for _ in range(iterations):
        parts = [plain_counts(model, s) for (i, _), s in zip(rows, coded) if not held(i)]
        start, move, emit = (sum(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(states), np.zeros((states, states)), np.zeros((len(n), states)))
        emit = emit + 0.1 * (unigram[:, None] + 1e-6)
        model = Model((start + 1e-3) / (start + 1e-3).sum(), (move + 1e-3) / (move + 1e-3).sum(1, keepdims=True), emit / emit.sum(0))
    inside = lambda w: 0.0 if w in number else math.log10(counts[w] + 0.1) - math.log10(n[symbol(w)] + 0.1 * (v[symbol(w)] + 1))
    return [plain_forward(model, s)[1] + sum(map(inside, ws)) for s, ws in zip(coded, tokens)]


@pytest.mark.parametrize("own", [6, 400])
def test_scores_equal_a_plain_version(spark, monkeypatch, own):
    from folio.llm import hmm

    monkeypatch.setattr(hmm, "KEY_BYTES", 12)
    monkeypatch.setattr(hmm, "PIECE_BYTES", 40)
    rows = topic_rows()[:60] + [(901, None), (902, "a long " + "w" * 30 + " word " + "w" * 30), (903, "w" * 30 + " unseen zz"), (None, "É é"), (1, "twice"), (1, "twice")]
    got = hmm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), states=3, iterations=2, symbols=hmm.Symbols(own, 5)).collect()
    want = collections.Counter((i, round(x, 2)) for (i, _), x in zip(rows, plain_scores(rows, 3, 2, own, 5)))
    assert collections.Counter((r["doc_id"], round(r["score"], 2)) for r in got) == want


def test_scores_of_odd_tables(spark):
    from folio.llm.hmm import score_texts

    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    df = spark.createDataFrame([(held, "nothing to learn from", "clash")], "doc_id long, text string, score string")
    row = score_texts(df).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 5, 0, 0, 0.0) and math.isfinite(row["score"])
    assert score_texts(df.limit(0)).count() == 0
    long = [(1, "the cat " * 200_000), (2, "x" * 3_000_000), (3, "the cat")]
    rows = {r["doc_id"]: r for r in score_texts(spark.createDataFrame(long, "doc_id long, text string"), iterations=1).collect()}
    assert rows[1]["n_tokens"] == 400_001 and rows[2]["n_known"] == 2 and all(math.isfinite(r["score"]) for r in rows.values())


def test_mixing_meets_targets(spark):
    from folio.llm.mixing import mix_documents

    rng = random.Random(4)
    plain, odd = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(200)], ["bad", "worse", "worst"]
    rows = [(i, " ".join(rng.choice(odd if i % 4 == 0 and rng.random() < 0.4 else plain) for _ in range(30))) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, "bad worse"), (999, None), (1, rows[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "odd" if i % 4 == 0 else "plain") for i in range(300)], "doc_id long, domain string")
    got = mix_documents(df, labels, {"plain": 0.5, "odd": 0.5}).collect()
    total = sum(r["n_tokens"] for r in got)
    for d in ("plain", "odd"):
        assert sum(r["rate"] * r["n_tokens"] * r["posterior"][d] for r in got) == pytest.approx(0.5 * total, rel=0.01)
    assert all(r["domain"] == ("odd" if r["doc_id"] % 4 == 0 else "plain") for r in got if r["doc_id"] is not None and r["doc_id"] < 400)
    assert all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) <= 1 for r in got) and len(got) == 403
    assert {r["rate"] for r in mix_documents(df, labels.limit(0), {"plain": 1.0, "odd": 3.0}).collect()} == {1.0}
    assert mix_documents(df.limit(0), labels, {"plain": 1.0, "odd": 1.0}).count() == 0


@pytest.mark.parametrize("most_found", [3, None])
def test_mixing_rates_equal_a_plain_projection(spark, most_found):
    """The totals of plain projected gradient steps on nonnegative least squares over the returned posteriors, which have no better ones."""
    from folio.llm.mixing import mix_documents

    rng = random.Random(8)
    plain, odd = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(200)], ["bad", "worse", "worst", "ill", "foul"]
    rows = [(i, " ".join(rng.choice(odd if rng.random() < (i % 5) / 5 else plain) for _ in range(rng.randint(5, 60))), 7) for i in range(300)] + [(None, None, 7), (400, "", 7), (401, "bad " * 90_000, 7)]
    labels = spark.createDataFrame([(i, "odd" if i % 5 > 2 else "plain") for i in range(200)], "doc_id long, domain string")
    mixed = mix_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), labels, {"plain": 0.5, "odd": 0.5}, scale=0.8, tolerance=1e-6, most_found=most_found, keep_columns=["n_tokens"])
    got = mixed.collect()
    n, p = np.array([r["n_tokens"] for r in got], float), np.array([[r["posterior"][d] for d in ("odd", "plain")] for r in got])
    goal, r, spread = 0.8 * n.sum() * np.array([0.5, 0.5]), np.ones(len(n)), n @ p**2
    for _ in range(20_000):
        r = np.maximum(0, r - 0.5 * p @ (((n * r) @ p - goal) / spread))
    mine = np.array([x["rate"] for x in got])
    assert (mine >= 0).all() and np.allclose((n * r) @ p, goal, rtol=1e-6) and np.allclose((n * mine) @ p, goal, rtol=1e-5)
    assert (n * (mine - 1) ** 2).sum() <= 1.05 * (n * (r - 1) ** 2).sum()  # nor does it move the rates further
    assert mixed.columns.count("n_tokens") == 1 and len(got) == len(rows)


def test_mixing_meets_the_target_of_a_rare_domain(spark):
    from folio.llm.mixing import mix_documents

    rng = random.Random(6)
    plain = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(["bad", "worse", "worst"] if i % 500 == 0 else plain) for _ in range(30))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, "odd" if i % 500 == 0 else "plain") for i, _ in rows], "doc_id long, domain string")
    mixed = mix_documents(df, labels, {"plain": 0.95, "odd": 0.05})
    got = mixed.collect()
    for d, share in (("plain", 0.95), ("odd", 0.05)):
        assert sum(r["rate"] * r["n_tokens"] * r["posterior"][d] for r in got) == pytest.approx(share * 90_000, rel=0.01)
    assert mixed.schema["rate"].metadata["mixing"]["optimal"]
    with pytest.warns(UserWarning, match="not optimal after 0 steps"):
        report = mix_documents(df, labels, {"plain": 0.95, "odd": 0.05}, steps=0).schema["rate"].metadata["mixing"]
    assert not report["optimal"] and report["expected"]["odd"] < 0.1 * report["goal"]["odd"]


@pytest.mark.parametrize("toxic", [4, 40, 400])
def test_pipeline_mixing_drops_toxic_documents_at_any_share(spark, tmp_path, toxic):
    import corpus_pipeline

    rng = random.Random(toxic)
    plain, bad = (["".join(rng.choice(letters) for _ in range(4)) for _ in range(100)] for letters in ("abcdef", "uvwxyz"))
    rows = [(i, " ".join(rng.choice(bad[:8] if i < toxic and rng.random() < 0.5 else plain) for _ in range(30)), "en", "s", 0) for i in range(4000)]
    spark.createDataFrame([(i, 1, int(i < toxic)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = collections.Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect())
    assert sorted(got) == list(range(toxic, 4000))
    assert sum(got.values()) < 1.3 * (4000 - toxic)  # one language alone is hardly written twice


def test_pipeline_mixing_keeps_clean_documents_beside_many_low_ones(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    plain, poor = (["".join(rng.choice(letters) for _ in range(4)) for _ in range(100)] for letters in ("abcdef", "uvwxyz"))
    rows = [(i, " ".join(rng.choice(poor[:8] if i < 400 and rng.random() < 0.5 or rng.random() < 0.01 else plain) for _ in range(30)), "en", "s", 0) for i in range(2000)]
    spark.createDataFrame([(i, int(i >= 400), 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = {r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()}
    assert len(got & set(range(400, 2000))) >= 1590


def test_pipeline_mixing_writes_the_stated_mix(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(15)
    share = {"en": 0.62, "de": 0.15, "fr": 0.15, "es": 0.08}
    vocabularies = {d: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)] for d in share}
    langs = rng.choices(list(share), list(share.values()), k=5000)
    rows = [(i, " ".join(rng.choice(vocabularies[d]) for _ in range(rng.randint(20, 60))), d if i % 3 else None, "s", 0) for i, d in enumerate(langs)]
    spark.createDataFrame([(i, 1, 0) for i in range(0, 5000, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = collections.Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect())
    tokens = collections.Counter()
    for i, text, *_ in rows:
        tokens[langs[i]] += got[i] * len(text.split())
    assert set(got) == set(range(5000))  # none is lost
    for d, target in corpus_pipeline.MIX.items():
        assert tokens[d] / sum(tokens.values()) == pytest.approx(target, rel=0.03)


def test_pipeline_near_duplicates_with_ids_that_are_not_unique(spark):
    import corpus_pipeline

    x, y, z, u, v, w, copied = near_rows(21, 60, 0, 0)[:7]
    rows = [(None, x), (None, y), (None, z), (7, z), (8, u), (8, v), (8, copied), (3, copied), (9, w), (9, w)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(None, x), (None, y), (7, z), (8, u), (8, v), (3, copied), (9, w)], key=str)


def test_pipeline_of_empty_tables(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, f"{text(40)}\nshared line of all\n{text(30)}", "en", "s", 0) for i in range(120)]
    rows += [(200 + i, rows[0][1], "en", "s", 0) for i in range(12)]
    rows += [(300, rows[1][1] + " more", "en", "s", 0), (301, "too short", "en", "s", 0), (302, None, None, None, None), (None, text(60), "en", "s", 0), (5, rows[5][1], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = docs
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = lambda name: sorted(str(r["doc_id"]) for r in after[name].select("doc_id").collect())
    assert "301" not in ids("quality_rules") and "302" not in ids("quality_rules")
    assert after["line_dedup"].where("text LIKE '%shared line%'").count() == 1
    assert ids("minhash_dedup") == sorted([*map(str, range(120)), "None"])
    assert sorted(set(ids("mixing"))) == ids("minhash_dedup") and ids("bpe") == ids("mixing")
    assert after["bpe"].where("NOT round_trip").count() == 0
