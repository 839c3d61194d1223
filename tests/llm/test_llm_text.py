"""Whole-text operators against plain versions: BPE, token counts, FLAC, licenses, quality rules, line dedup."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TEXTS = [
    (1, None), (2, ""), (3, "  a  \n\n ▁▁b \x00 \x01\r\n日本 <s>"), (4, " " * 50 + "x\n"), (None, "null id"), (5, "<|endoftext|> a <|endoftext|>"),
    (6, "twice"), (6, "twice"), (7, "aé" * 3000), (8, "CC BY cc-by, General  Public\nLicense. ALL RIGHTS RESERVED cc"), (9, "a²½ ⅧⅨ \x1c\x1d _x__ it's we'll"),
    (10, "released under the mit license " * 3), (11, "one two three four five six seven eight nine " * 4), (12, "same line\nSame Line \nother $ # |\nsame line"),
    (13, "z" * 200_000), (14, "\t\n\x0b\x0c\r "), (15, "long <|endoftext|> text, 'tis é \n\n  of words " * 9000), (None, "日本語 " * 60_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    # A column with the name of an operator's output must not matter.
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long, n_tokens string").repartition(3)


def counted(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_lookahead_and_streams():
    from folio.llm.bpe import ByteTextDecoder, Encoder, StreamingEncoder, Transducer, Vocabulary, sufficient_lookahead

    assert sufficient_lookahead([(b"a", b"b"), (b"c", b"ab")]) == 2  # "ab" may pull in a "c" before it
    assert sufficient_lookahead([]) == 0
    vocab = Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, decoder, rng = Encoder(vocab), ByteTextDecoder(vocab), random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice(["a", "e", "the", "ing", " ", "  ", "\n", "é", "日", "1", "'s", "!", "guarantee"]) for _ in range(rng.randint(0, 80)))
        ids = encoder.encode(text).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert decoder.decode(ids, step=3) == text
    word = "".join(rng.choice("aeinorstguh") for _ in range(20_000)).encode()
    for size in (1, 7, 1000, 50_000):
        machine, got = StreamingEncoder(Transducer(vocab, step=64)), b""
        for at in range(0, len(word), size):
            got += b"".join(machine.feed(word[at : at + size]))
            assert len(machine.held) <= 2 * (vocab.lookahead + 64)
        assert np.frombuffer(got + machine.finish(), np.int32).tolist() == library.encode(word.decode(), add_special_tokens=False).ids


def test_every_id_comes_from_the_transducer(monkeypatch):
    from folio.llm import bpe

    vocab, gave = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")), {}
    advance = bpe.Transducer.advance

    def recorded(self, held, ended):
        out = advance(self, held, ended)
        for raw, (ids, rest) in zip(held, out, strict=True):
            assert len(raw) <= self.window + vocab.lookahead and b"".join(vocab.token_bytes[i] for i in np.frombuffer(ids, np.int32)) + rest == raw
            gave[raw] = gave.get(raw, 0) + len(ids) // 4
        return out

    monkeypatch.setattr(bpe.Transducer, "advance", recorded)
    texts = ["the cat the dog", "it's <|endoftext|> cat " + "z" * 9000]
    encoder = bpe.Encoder(vocab)
    every = encoder.encode_many(texts)
    # Each distinct pre-token passes once: seven of one id, and the long one, which is the second text without five ids of others.
    assert sum(gave.values()) == 7 + len(every[1]) - 5
    assert [b"".join(vocab.token_bytes[i] for i in x).decode() for x in every] == texts


def test_most_ids_are_stable_before_a_text_ends():
    from folio.llm import bpe

    vocab = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, early, late = bpe.Encoder(vocab), [], []
    advance = encoder.advance

    def recorded(streams, windows, ended):
        out = advance(streams, windows, ended)
        for ids, over in zip(out, ended, strict=True):
            (late if over else early).append(len(ids))
        return out

    encoder.advance = recorded
    every = encoder.encode_many(["the cat sat on the mat " * 400, "w" * 90_000, "x " * 5000])
    assert sum(early) > 4 * sum(late) and sum(early) + sum(late) == 4 * sum(map(len, every))


@pytest.mark.parametrize("size", [1, 2, 5, 37, 1 << 17])
def test_texts_in_pieces_equal_the_library(size, monkeypatch):
    from folio.llm import bpe

    vocab = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(size)
    monkeypatch.setattr(bpe, "WINDOW", 40)
    bits = ["a", "the", "ing", " ", "  ", "\n", "é", "日", "1", "'s", "'", "'re", "!", "<|endoftext|>", "<|endof", "<", "\u3000", "z" * 90, " " * 90, "7" * 90, "?" * 90, "\n" * 90, " " + "q" * 90]
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        got = list(bpe.Encoder(vocab).encode_pieces(text[at : at + size] for at in range(0, len(text), size)))
        assert "".join(p for p, _ in got) == text
        assert [i for _, ids in got for i in ids.tolist()] == library.encode(text, add_special_tokens=False).ids


def test_memory_of_a_long_text_is_constant():
    import tracemalloc

    from folio.llm import bpe

    vocab = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, peaks = bpe.Encoder(vocab), []
    for pieces in (20, 200):
        tracemalloc.start()
        n = sum(len(ids) for _, ids in encoder.encode_pieces("ab cd " * 100 + "z" * 9000 for _ in range(pieces)))
        n += sum(len(ids) for _, ids in encoder.encode_pieces("x" * 9600 for _ in range(pieces)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n > pieces * 500
    assert peaks[1] < 1.5 * peaks[0] + 1_000_000


def test_malformed_bytes_decode_like_the_library():
    from folio.llm.bpe import ByteTextDecoder, Vocabulary

    vocab = Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(12)]
        assert ByteTextDecoder(vocab).decode(ids, step=1) == library.decode(ids, skip_special_tokens=False)


def test_bpe_query(docs):
    from folio.llm.bpe import bpe_digest

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def want(i, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))

    got = bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert counted(got, *got.columns) == collections.Counter(want(*r) for r in TEXTS)
    assert bpe_digest(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_counts(docs):
    spm = pytest.importorskip("sentencepiece")
    from folio.llm.token_counts import token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = spm.SentencePieceProcessor(model_file=path)
    want = collections.Counter((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in TEXTS)
    for hot in (3, 1 << 18):
        assert counted(token_counts(docs, path, hot_entries=hot), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts(docs.limit(0), path).count() == 0


def test_flac_round_trip_and_damage():
    from folio.llm.flac import FlacError, decode, encode, payload_of

    rng = random.Random(4)
    payloads = [payload_of(t or "") for _, t in TEXTS] + [rng.randbytes(192 * 7), bytes([128, 255, 0, 255]) * 480, b"\xff\xf8" * 960, bytes([128]) * 191 + b"\xff" + bytes([128]) * 192]
    for block, order in ((576, 2), (192, 0), (1000, 4), (4608, 1)):
        streams = encode(payloads, block=block, lpc_order=order)
        read = decode(streams)
        assert [pcm for pcm, _ in read] == payloads
        for pcm, blocks in read:
            assert [b[0] for b in blocks] == list(range(0, len(pcm), block))
    assert encode(payloads[:3])[2] == encode(payloads)[2]
    stream = encode([payloads[8]])[0]
    for at in (30, 70, len(stream) // 2, len(stream) - 3):  # stream information and frames; the seek table has no checksum
        bad = bytearray(stream)
        bad[at] ^= 0x10
        with pytest.raises(FlacError):
            decode([bytes(bad)])


def test_flac_in_ranges_and_from_an_offset(spark, monkeypatch):
    from folio.llm import flac

    rng = random.Random(11)
    payloads = [rng.randbytes(192 * 30), b"text of some kind " * 900, bytes(192), b"\xff\xf8\x60\x02" * 4800]
    whole = flac.encode(payloads)
    monkeypatch.setattr(flac, "GROUP_SAMPLES", 1000)
    assert flac.encode(payloads) == whole and [pcm for pcm, _ in flac.decode(whole)] == payloads
    assert flac._feature(payloads[1]) == (monkeypatch.undo() or flac._feature(payloads[1]))
    for stream, payload in zip(whole, payloads):
        for _ in range(30):
            at, n = rng.randrange(len(payload)), rng.choice([1, 16, 600, 10_000])
            assert flac.decode_range(stream, at, n) == payload[at : at + n]
    assert flac.decode_range(whole[1], 10**9, 4) == b""
    damaged = bytearray(whole[3])
    damaged[-5] ^= 1
    assert flac.decode_range(bytes(damaged), 0, 16) == payloads[3][:16]  # the damage lies behind the next seek point
    rows = [(i, bytes(s), 192 * i, 16) for i, s in enumerate(whole)] + [(None, None, 0, 1)]
    got = flac.read_samples(spark.createDataFrame(rows, "doc_id long, media binary, a long, n long"), "a", "n").collect()
    assert {r["doc_id"]: r["pcm"] and bytes(r["pcm"]) for r in got} == {0: payloads[0][:16], 1: payloads[1][192:208], 2: b"", 3: payloads[3][576:592], None: None}


def test_flac_memory_of_a_long_payload():
    import tracemalloc

    from folio.llm.flac import decode, encode

    payload = b"some words that go on " * 500_000
    tracemalloc.start()
    stream = encode([payload])[0]
    after_encode = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    assert decode([stream])[0][0] == payload
    after_decode = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert after_encode < 120_000_000 and after_decode < 120_000_000  # eleven million samples


def test_flac_reads_partitions_and_escapes():
    """A hand-made frame: fixed order 1, two Rice partitions, the second escaped to raw 5-bit values."""
    from folio.llm.flac import _CRC8, _CRC16, _crc, decode
    import numpy as np

    samples = [10, 12, 11, 11] + [11, 15, 3, 3] * 3
    residual = [b - a for a, b in zip(samples, samples[1:])]
    bits = f"{0:01b}{0b001001:06b}0" + f"{samples[0]:08b}" + "00" + f"{1:04b}" + f"{1:04b}"
    for r in residual[:7]:
        u = (r << 1) ^ (r >> 31)
        bits += "0" * (u >> 1) + "1" + f"{u & 1:b}"
    bits += "1111" + f"{5:05b}" + "".join(f"{r & 31:05b}" for r in residual[7:])
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x60, 0x02, 0x00, 15])
    crc = lambda table, data: int(_crc(table, np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])
    frame = head + bytes([crc(_CRC8, head)]) + int(bits, 2).to_bytes(len(bits) // 8)
    frame += crc(_CRC16, frame).to_bytes(2)
    info = (16).to_bytes(2) * 2 + bytes(6) + (16000 << 44 | 7 << 36 | 16).to_bytes(8) + bytes(16)
    stream = b"fLaC\x80" + (34).to_bytes(3) + info + frame
    assert decode([stream])[0][0] == bytes(s + 128 for s in samples)


def test_media_query(docs):
    from folio.llm.flac import media_digest, payload_of

    got = media_digest(docs)
    want = collections.Counter((i, len((t or "").encode()), len(p := payload_of(t or "")), sha(p), zlib.crc32(p[-16:])) for i, t in TEXTS)
    assert counted(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    assert media_digest(docs.limit(0)).count() == 0


def test_license_query(docs):
    from folio.llm.license_scan import PHRASES, license_digest

    def want(i, text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        places = [(k, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for k in range(len(words)) if words[k : k + len(p)] == p]
        return i, len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))

    got = license_digest(docs)
    assert counted(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == collections.Counter(want(*r) for r in TEXTS)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got.collect()}
    assert labels[10] == ("mit", 1.0) and labels[2] == ("", 0.0)
    assert license_digest(docs.limit(0)).count() == 0


def plain_common(a, b):
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def plain_notices(text, notices):
    """Spans by dictionaries: votes by diagonal, merged diagonals, words in order by the table."""
    from folio.llm.license_scan import NEAR, SHARE, VOTES, WORD

    words, found = WORD.findall(text.translate(LOWER)), []
    for label, notice in notices:
        own = WORD.findall(notice.translate(LOWER))
        places = collections.defaultdict(list)
        for j in range(len(own) - 3):
            places[tuple(own[j : j + 4])].append(j)
        votes = collections.Counter(i - j for i in range(len(words) - 3) for j in places.get(tuple(words[i : i + 4]), ()))
        runs = []
        for d in sorted(votes):
            if runs and d - runs[-1][-1] <= NEAR:
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            if sum(votes[d] for d in run) >= max(1, int(VOTES * (len(own) - 3))):
                lo = max(0, run[0])
                n = plain_common(own, words[lo : run[-1] + len(own)])
                if n >= SHARE * len(own):
                    found.append((label, round(n / len(own), 6)))
    return found


def test_repeated_rows_vote_for_themselves(spark):
    from folio.llm.license_scan import scan_licenses
    from folio.llm.license_texts import NOTICES

    words = dict(NOTICES)["isc"].split()
    for step in (3, 4, 5, 6, 8):  # about the threshold of votes and of words
        text = " ".join("other" if i % step == 0 else w for i, w in enumerate(words))
        seen = {}
        for copies in (1, 2, 4):
            rows = spark.createDataFrame([(1, text)] * copies + [(2, "cc by"), (2, "cc by"), (3, None)], "doc_id long, text string")
            got = [repr(r) for r in scan_licenses(rows).where("doc_id = 1").collect()]
            assert len(got) == copies and len(set(got)) == 1
            seen[copies] = got[0]
        assert len(set(seen.values())) == 1


def test_false_headers_are_sorted_out_in_linear_time():
    import time

    from folio.llm import flac

    rng = np.random.default_rng(3)
    payload = rng.integers(32, 127, 3_000_000).astype(np.uint8).tobytes()
    data = np.frombuffer(flac.encode([payload])[0] + bytes(8), np.uint8)
    at, _, number, _ = flac._headers(data)
    assert len(at) == number[-1] + 1  # the stream has no false header of its own
    end = len(data) - 8
    assert flac._crc16_of(data, int(at[3]), 4321) == int(flac._crc(flac._CRC16, data, at[3:4], np.array([4321]))[0])
    false = [(int(at[k]) + 30, int(k)) for k in (0, 7, 8)] + [(int(at[900]) + 11, 5), (int(at[10]) + 17, int(number[-1]) + 1), (int(at[20]) + 9, int(number[-1]))]
    every = sorted([(int(a), int(n), True) for a, n in zip(at, number, strict=True)] + [(a, n, False) for a, n in false])
    began = time.perf_counter()
    path = flac._chain(data, np.array([x[0] for x in every]), np.array([x[1] for x in every]), np.arange(len(every)), end)
    assert path == [i for i, x in enumerate(every) if x[2]] and time.perf_counter() - began < 30


def test_license_notices_equal_a_plain_version(spark):
    from folio.llm.license_scan import NOTICES, scan_licenses

    rng, rows = random.Random(14), []
    for i in range(60):
        label, notice = rng.choice(NOTICES)
        words = notice.split()
        for _ in range(rng.randint(0, max(1, len(words) // 6))):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 2)] = rng.choice([[], ["changed"], ["two", "more"]])
        if i % 7 == 0:
            words = words[len(words) // 2 :] + words[: len(words) // 2]  # out of order
        filler = lambda n: [rng.choice(["some", "other", "words", "license", "the", "software"]) for _ in range(n)]
        rows.append((i, " ".join(filler(rng.randint(0, 30)) + words + filler(rng.randint(0, 30)))))
    got = {r["doc_id"]: r["spans"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = plain_notices(text, NOTICES)
        mine = [(s["label"], round(s["share"], 6)) for s in got[i]]
        assert set(mine) <= set(want)
        # What is left out overlaps a notice with as many words in order.
        assert bool(mine) == bool(want) and (not want or max(x for _, x in want) >= max(x for _, x in mine))
    whole = {label: text for label, text in NOTICES}
    span = scan_licenses(spark.createDataFrame([(1, "x y " + whole["zlib"] + " z")], "doc_id long, text string")).first()["spans"]
    assert [(s["start"], s["label"], s["share"]) for s in span] == [(2, "zlib", 1.0)]
    own = scan_licenses(spark.createDataFrame([(1, "these are my own five words here")], "doc_id long, text string"), notices=[("own", "My own five words"), ("short", "too short")]).first()["spans"]
    assert [(s["start"], s["end"], s["label"]) for s in own] == [(2, 6, "own")]


def test_words_in_order():
    from folio.llm.license_scan import common_in_order

    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        n, first, last = common_in_order(a, b)
        assert n == plain_common(a, b) and (n == 0 or plain_common(a, b[first : last + 1]) == n)


def plain_counts(text):
    words = re.findall(SPACE, text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, covered = collections.Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs):
    from folio.llm.quality_rules import with_counts

    got = with_counts(docs)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert counted(got, *columns) == collections.Counter((i, *plain_counts(t)) for i, t in TEXTS)


def test_quality_rules_learn_a_threshold(spark):
    from folio.llm.quality_rules import quality_verdicts

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(words) + ("##" if i % 5 == 0 else "") for _ in range(40))) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_verdicts(df, labels).collect()}
    assert all(got[i] == (False, i % 5 != 0) for i in range(400))
    assert got[900] == (True, False) and got[None] == (False, False)
    none = quality_verdicts(df, labels.limit(0))
    assert none.where("kept").count() == 401 and quality_verdicts(df.limit(0), labels).count() == 0


def plain_rules(rows, bins=32, most_rules=6, most_conditions=3, precision=0.9, least=5):
    """Sequential covering with loops over rows of (bad, third, features)."""
    feats = range(len(rows[0][2]))

    def cuts_of(own, f):
        values = sorted(r[2][f] for r in own)
        return [values[max(0, math.ceil(i / bins * len(values)) - 1)] for i in range(1, bins)]

    cuts = [sorted({*cuts_of(rows, f), *cuts_of([r for r in rows if r[0]], f)}) for f in feats]
    holds = lambda rule, r: all((r[2][f] > t) == above for f, above, t in rule)
    left, rules = rows, []
    while len(rules) < most_rules:
        rule = []
        while len(rule) < most_conditions:
            own = [r for r in left if r[1] < 2 and holds(rule, r)]
            p0, n0 = sum(r[0] for r in own), sum(not r[0] for r in own)
            if not p0 or not n0:
                break
            gain, best = 0.0, None
            for f in feats:
                for i, t in enumerate(cuts[f]):
                    for above in (False, True):
                        p, n = (sum((r[2][f] > t) == above and bool(r[0]) == bad for r in own) for bad in (True, False))
                        if p and (g := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > gain:
                            gain, best = g, (f, above, (t + (cuts[f][i + 1] if i + 1 < len(cuts[f]) else t)) / 2)
            if best is None:
                break
            rule.append(best)
        score = []
        for k in range(1, len(rule) + 1):
            p, n = (sum(holds(rule[:k], r) for r in left if r[1] == 2 and bool(r[0]) == bad) for bad in (True, False))
            score.append(((p - n) / max(p + n, 1), p, -k, n))
        if not score:
            break
        _, p, k, n = max(score)
        if p < least or p < precision * (p + n):
            break
        rules.append(rule[:-k])
        left = [r for r in left if not holds(rules[-1], r)]
    return rules


def test_quality_rules_equal_plain_covering(spark):
    from folio.llm.quality_rules import FEATURES, feature_columns, learn_rules

    rng = random.Random(21)
    rows = []
    for i in range(400):
        words, chars = rng.randint(20, 200), rng.uniform(3, 9)
        symbols, dup, repeat = rng.randint(0, 30), rng.randint(0, 9), rng.randint(0, 60)
        bad = symbols / words > 0.15 or (chars < 4.5 and repeat > 20) or rng.random() < 0.03
        rows.append((i, bad, words, int(words * chars), symbols, dup, repeat))
    df = spark.createDataFrame(rows, "doc_id long, bad boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    third = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)).alias("third")
    seen = [(r["bad"], r["third"], [r[f"f_{f}"] for f in FEATURES]) for r in df.select("bad", third, *(c.alias(f"f_{f}") for f, c in feature_columns().items())).collect()]
    want = [[(FEATURES[f], above, pytest.approx(t)) for f, above, t in rule] for rule in plain_rules(seen)]
    assert want
    for parts in (1, 3, 7):
        got = learn_rules(df.repartition(parts)).rules
        assert [[(c.feature, c.above, c.threshold) for c in rule] for rule in got] == want


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup(spark, keep_first):
    from folio.llm.line_dedup import dedup_lines

    rng = random.Random(8)
    pool = ["Common ", " common", "other", "x", "", " ", "é", "É"]
    rows = [(i, "\n".join(rng.choice(pool) + ("" if rng.random() < 0.6 else str(rng.randint(0, 99))) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(None, "common\nonly here"), (100, None), (101, "common"), (101, "common")]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    distinct = {(i, t or "") for i, t in rows}
    found, first = collections.defaultdict(set), {}
    for d in sorted(distinct, key=lambda d: (d[0] is not None, d[0] or 0)):  # nulls come first
        for at, line in enumerate(d[1].split("\n")):
            found[key(line)].add(d)
            first.setdefault(key(line), (d, at))

    def want(i, t):
        lines, d = (t or "").split("\n"), (i, t or "")
        keep = [not key(x) or len(found[key(x)]) < 10 or (keep_first and first[key(x)] == (d, at)) for at, x in enumerate(lines)]
        return i, len(lines), keep.count(False), "\n".join(x for x, k in zip(lines, keep) if k), "".join("01"[k] for k in keep)

    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup_lines(df, keep_first=keep_first).collect()
    bits = lambda r: "".join("1" if any(a <= p < a + n for a, n in r["keep_runs"]) else "0" for p in range(r["n_lines"]))
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"], bits(r)) for r in got) == collections.Counter(want(*r) for r in rows)
    assert dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_with_shuffled_joins(spark, monkeypatch):
    """Many frequent lines, one of them in every document, and a column with the name of a result."""
    from folio.operators import joins
    from folio.llm import line_dedup as m

    rows = [(i, "\n".join(["in all", *(f"line {(i + k) % 20}" for k in range(8)), f"own {i}"]), i) for i in range(60)] + [(99, "x" * 300_000 + "\nin all\n" + "y\n" * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines long")
    want = {r["doc_id"]: (r["n_dropped"], r["kept_text"]) for r in m.dedup_lines(df).collect()}
    assert want[0] == (9, "own 0") and want[99][0] == 1 and want[99][1] == rows[-1][1].replace("\nin all", "")
    monkeypatch.setattr(m, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(joins, "HEAVY_PART", 1 / 20)
    got = m.dedup_lines(df, keep_columns=["n_lines"])
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "keep_runs", "kept_text"]
    assert {r["doc_id"]: (r["n_dropped"], r["kept_text"]) for r in got.collect()} == want
