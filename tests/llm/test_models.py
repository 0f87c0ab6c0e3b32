"""Quality, toxicity, PII, media, licences and language model."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import edge
from promolith.llm import common, licenses, lm, media, pii, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return quality.labels_of(spark, sf_dir)


# ------------------------------------------------------------------ quality


def brute_counts(text):
    words = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def brute_llr(docs, trusted):
    """The ratio of every document by plain dictionaries."""
    def grams(text):
        pieces = [zlib.crc32(p) for w in re.findall(rb"[^ \t-\r]+", text.encode()) for p in re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff]+", w)]
        n = quality.BUCKETS
        pair = lambda a, b: ((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1) >> 40
        return [p % n for p in pieces] + [n + pair(a, b) % n for a, b in zip(pieces, pieces[1:])]

    each = {i: grams(t) for i, t in docs.items()}
    raw, good = Counter(), Counter()
    for i, g in each.items():
        raw.update(g)
        if i in trusted:
            good.update(g)
    total = lambda c, half: sum(v for k, v in c.items() if k // quality.BUCKETS == half) + quality.BUCKETS
    sums = [(total(good, h), total(raw, h)) for h in (0, 1)]
    value = lambda k: math.log((good[k] + 1) / sums[k // quality.BUCKETS][0]) - math.log((raw[k] + 1) / sums[k // quality.BUCKETS][1])
    return {i: sum(map(value, g)) / len(g) if g else 0.0 for i, g in each.items()}


def test_quality_counts_and_ratio(spark, sf_dir, docs, labels):
    got = {r.doc_id: r for r in quality.judge_quality(common.documents(spark, sf_dir), labels).collect()}
    assert got.keys() == docs.keys()
    trusted = {r.doc_id for r in labels.filter("quality = 1").collect()}
    want = brute_llr(docs, trusted)
    for i, text in docs.items():
        r, n = got[i], brute_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.llr == pytest.approx(want[i], abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)
    kept = quality.keep_good(common.documents(spark, sf_dir), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept} and kept.columns == common.documents(spark, sf_dir).columns


def test_quality_keeps_good_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.judge_quality(common.documents(spark, sf), quality.labels_of(spark, sf)).join(quality.labels_of(spark, sf), "doc_id").filter("not base_failed").collect()
    assert all(r.kept == (r.quality == 1) for r in rows)


def test_no_trusted_rows_leaves_the_base_rules(spark, sf_dir, labels):
    got = quality.judge_quality(common.documents(spark, sf_dir), labels.limit(0)).collect()
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in got)


def test_repeated_windows():
    rng = np.random.default_rng(0)
    for _ in range(100):
        words = rng.integers(0, 4, rng.integers(0, 30))
        text = " ".join(map(str, words))
        assert quality.repeated(words) == brute_counts(text)[4]
        # numbers past 21 bits, which would run into each other if packed
        assert quality.repeated(words * ((1 << 21) + 1)) == brute_counts(text)[4]
    unlike = np.array([1 << 21, 5, 6, 7, 0, 5 + 1, 6, 7])
    assert quality.repeated(unlike) == 0


def test_kept_rows_are_those_of_the_judgement(spark, docs, labels):
    """Over many partitions, in workers that have numbered other texts before."""
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(12)
    want = {r.doc_id for r in quality.judge_quality(table, labels).filter("kept").collect()}
    assert 0 < len(want) < len(docs)
    for k in range(3):
        other = spark.createDataFrame([(i, t[k:][::-1]) for i, t in docs.items()], "doc_id long, text string").repartition(5 + k)
        quality.judge_quality(other, labels).count()
        assert {r.doc_id for r in quality.keep_good(table, labels).collect()} == want


def test_a_full_word_memo_changes_nothing(docs, monkeypatch):
    class Told:
        value = np.random.default_rng(0).standard_normal(2 * quality.BUCKETS)

    texts = [t for t in docs.values()][:60] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t or "" for t in texts])], names=["doc_id", "text"])
    told = []
    for limit in (3, 200, 1 << 20):
        monkeypatch.setattr(quality, "_WORDS", quality.Words(limit))
        judged = next(quality._judge(iter([batch]), Told, 0.0)).to_pylist()
        kept = next(quality._keep(iter([batch]), Told, 0.0, 1)).column(0).to_pylist()
        assert kept == [r["doc_id"] for r in judged if r["kept"]]
        told.append([(r["doc_id"], round(r["llr"], 9), r["kept"]) for r in judged])
    assert told[0] == told[1] == told[2]


# ----------------------------------------------------------------- toxicity


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_plain_edit_distance():
    terms = {"moron": 1.0, "idiot": 1.0, "scum": 1.0, "worthless": 1.0, "disgusting": 1.0, "trash": 1.0}
    lexicon = toxicity.Lexicon(terms, {}, set())
    rng = np.random.default_rng(4)
    words = ["", "moron", "mor0n", "moroon", "oron", "idoit", "scumm", "disgsting", "digusting", "diszzusting", "worthles"]
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.integers(0, 4)):
                k, op = int(rng.integers(0, len(w) + 1)), int(rng.integers(0, 3))
                if op == 0:
                    w.insert(k, str(rng.choice(list("abcost"))))
                elif w and k < len(w):
                    w[k : k + 1] = [] if op == 1 else [str(rng.choice(list("abcost")))]
            words.append("".join(w))
    for w in words:
        near = sorted((plain_distance(w, t), t) for t in terms if plain_distance(w, t) <= toxicity.Lexicon.edits(t))
        want = (near[0][1], near[0][0]) if near else None
        assert lexicon.fuzzy(w) == want, w


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.documents(spark, sf), quality.labels_of(spark, sf)
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.9
    # held-out labels play no part
    changed = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, changed).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)


def test_quotation_counts_less_than_abuse():
    lexicon = toxicity.Lexicon({"idiot": 4.0}, {}, set())
    told = dict(zip(toxicity.FEATURES, toxicity.features('he said "idiot" and left', lexicon)))
    meant = dict(zip(toxicity.FEATURES, toxicity.features("you are an idiot you fool", lexicon)))
    assert told["quoted"] > 0 == told["addressed"] and meant["addressed"] > 0 == meant["quoted"] and told["weight"] < meant["weight"]


def brute_score(text, lexicon, weights):
    """The score by plain distances to every term, window by window."""
    strip = lambda w: w.strip(toxicity.PUNCTUATION)
    words, hits = text.lower().split(), []
    for k, w in enumerate(words):
        bare = strip(w)
        stem = next((bare[:n] for n in range(1, len(bare)) if bare[:n] in lexicon.stems), None)
        if bare in lexicon.words:
            hits.append((k, "word", bare))
        elif stem is not None:
            hits.append((k, "stem", stem))
        elif bare not in lexicon.clean and len(bare) >= 4:
            near = sorted((plain_distance(bare, t), t) for t in lexicon.words if abs(len(t) - len(bare)) < 3 and plain_distance(bare, t) <= (0 if len(t) < 5 else 1 if len(t) < 10 else 2))
            if near:
                hits.append((k, "fuzzy", near[0][1]))
    number, best = Counter(), {}
    for k, kind, term in hits:
        around = [strip(w) for w in words[max(0, k - 6) : k + 7]]
        lead = words[k][: len(words[k]) - len(words[k].lstrip(toxicity.QUOTES))]
        opened = sum(c in "\"“„«”»" for c in " ".join(words[max(0, k - 6) : k]) + lead)
        addressed = any(w in toxicity.ADDRESS for w in around)
        told = (opened % 2 == 1 or any(w in toxicity.REPORTS for w in around)) and not addressed
        worth = (lexicon.stems if kind == "stem" else lexicon.words)[term] * (0.6 if kind == "fuzzy" else 1) * (0.5 if told else 1)
        best[kind, term] = max(best.get((kind, term), 0), worth)
        number.update([kind, *["addressed"] * addressed, *["told"] * told])
    log = lambda k: math.log(1 + number[k])
    x = [1, log("word"), log("stem"), log("fuzzy"), log("addressed"), log("told"), min(sum(best.values()), 12), 1 if hits else 0]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, weights))))


def test_scores_against_plain_distances(spark):
    sf = "/root/testdata/sf0.01"
    table, labels = common.documents(spark, sf), quality.labels_of(spark, sf)
    lexicon, weights = toxicity.fit(table, labels).parts()
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(table, labels).collect()}
    short = {r.doc_id: r.text for r in table.filter("length(text) < 900").collect()}
    some = [i for i, t in short.items() if any(w in t.lower() for w in [*lexicon.words, *lexicon.stems])][:60] + list(short)[:60]
    assert len({round(got[i], 6) for i in some}) > 10
    for i in some:
        assert got[i] == pytest.approx(brute_score(short[i], lexicon, weights), abs=1e-9), short[i]


def test_no_labels(spark, sf_dir, labels):
    rows = toxicity.score_toxicity(common.documents(spark, sf_dir), labels.limit(0)).collect()
    assert {r.predicted for r in rows} == {0}


# ---------------------------------------------------------------------- PII


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


PERSONAL = [
    "a@b.c@d.e x.y@z-1.co.uk. @no.one nobody@ q@w", "1.2.3.4.5 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 79927398713 5500 0000 0000 0004 12", "+1 (555) 555-1234, +123 +49.30.123456-",
    "mail me at jane.doe+x@mail.example.com or call +44 20 7946 0958 from 10.0.0.1", "", "IBAN DE89370400440532013000 and DE89370400440532013001", "SSN 123-45-6789, dear Jennifer Miller", "+1 555 555 1234 5678 9012 +1 2",
]


def test_base_spans_match_a_plain_search(spark, docs):
    every = docs | {-1 - k: t for k, t in enumerate(PERSONAL)}
    got = {r.doc_id: r for r in pii.scan_pii(spark.createDataFrame(list(every.items()), "doc_id long, text string")).collect()}
    for i, text in every.items():
        want = brute_pii(text)
        told = [f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in want]
        assert got[i].base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest(), text
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(x[2] == k for x in want) for k in range(4))
        assert set(told) <= set(got[i].spans.split(","))
    assert sum(r.n_email for r in got.values()) > 0


def test_added_spans_and_reliabilities():
    rows = Counter()
    texts = PERSONAL * 20
    for t in texts:
        rows.update((k, pii.votes(t, s, e, k, met)) for s, e, k, met in pii.candidates(t))
    model = pii.train([(k, v, n) for (k, v), n in rows.items()])
    spans = pii.joined(pii.find(PERSONAL[6], model))
    assert spans == "iban:5:27"
    assert model.reliability["prior"][0] > 0.2
    assert pii.train([]).probability(0, (1, 0, 0, 0, 1, 0, 0, 0)) == 0.5


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.4
    right = [0.95, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(len(y)) < r, y, ~y) * 2 - 1 for r in right], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    p, table, prior = pii.expectation_maximisation(patterns, counts.astype(float))
    assert abs(prior - 0.4) < 0.05 and all(abs(table[1, k, 2] - r) < 0.05 for k, r in enumerate(right))


# -------------------------------------------------------------------- media


def test_media_round_trip(spark, docs):
    some = list(docs.items())[:40] + [(-1, None), (-2, ""), (-3, "a" * 64), (-4, "é" * 40), (-5, "a" * 64)]
    got = {r.doc_id: r for r in media.media_digests(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    for i, text in some:
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_bytes == 44 + len(payload)
        stored = media.write_wav(payload)
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest() and media.read_wav(stored) == (media.RATE, payload)
        assert r.feature == media.feature_text(media.read_tensors(media.write_tensors(media.tensors_of(stored))))
    assert got[-3].feature == got[-5].feature and got[-1].feature == got[-2].feature


def brute_audio(payload):
    """(log-mel, energy in dB) of each frame by sums alone."""
    x, taps = [(b - 128) / 128 for b in payload], 12
    sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
    h = [sinc((t - 11.5) / 3) * (0.54 - 0.46 * math.cos(2 * math.pi * t / 23)) for t in range(24)]
    gain = [sum(h[p::2]) for p in (0, 1)]
    y = []
    for k in range(-(-len(x) * 2 // 3)):
        at, p = divmod(3 * k, 2)
        y.append(sum(h[p + 2 * (taps - 1 - j)] / gain[p] * x[min(max(at - 6 + j, 0), len(x) - 1)] for j in range(taps)))
    count = max(1, -(-max(0, len(y) - 256) // 128) + 1)
    y += [0.0] * ((count - 1) * 128 + 256 - len(y))
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    top = 8000 * 2 / 3 / 2
    edges = [700 * (10 ** (mel(top) * i / 21 / 2595) - 1) for i in range(22)]
    dft = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    bands, energy = [], []
    for k in range(count):
        frame = np.array(y[k * 128 : k * 128 + 256])
        power = abs(dft @ (frame * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)))) ** 2
        f = [top * b / 128 for b in range(129)]
        bands.append([math.log10(sum(power[b] * max(0, min((f[b] - lo) / (mid - lo), (hi - f[b]) / (hi - mid))) for b in range(129)) + 1e-6) for lo, mid, hi in zip(edges, edges[1:], edges[2:])])
        energy.append(10 * math.log10(sum(frame**2) / 256 + 1e-6))
    return np.array(bands), np.array(energy)


def test_stored_tensors_against_sums(docs, monkeypatch):
    monkeypatch.setattr(media, "BLOCK", 5)  # several blocks, none at a whole number of tiles
    for text in ["", "a", "short text", "x" * 700, *sorted(docs.values(), key=len)[-60:-58], "words and pauses " * 400 + "\x00" * 3000 + "end " * 300]:
        payload = media.payload_of(text[:12_000])[1]
        stored = media.read_tensors(media.write_tensors(media.tensors_of(media.write_wav(payload))))
        bands, energy = brute_audio(payload)
        n = len(bands)
        assert stored.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float32(), (media.TILE_FRAMES, media.MELS))
        mel = stored["log_mel"].to_numpy_ndarray().reshape(-1, media.MELS)
        assert len(stored) == -(-n // media.TILE_FRAMES) and np.allclose(mel[:n], bands, atol=1e-4) and np.allclose(mel[n:], -6)
        assert np.allclose(stored["energy_db"].to_numpy_ndarray().reshape(-1)[:n], energy, atol=1e-3)
        step = 128 * 3 / 2 / 8000
        assert np.allclose(stored["start_s"], np.arange(len(stored)) * 64 * step) and np.allclose(stored["end_s"], [min(64 * (k + 1), n) * step for k in range(len(stored))])
        spans = media.segments(energy - np.median(energy))
        assert {(round(s["start_s"] / step), round(s["end_s"] / step)) for row in stored["segments"].to_pylist() for s in row} == set(spans)
        for k, row in enumerate(stored["segments"].to_pylist()):
            assert [round(s["start_s"] / step) for s in row] == [a for a, b in spans if a < 64 * (k + 1) and b > 64 * k]
        told = dict(x.split("=") for x in media.feature_text(stored).split(";"))
        assert (int(told["frames"]), int(told["tiles"]), int(told["segments"])) == (n, len(stored), len(spans))
        assert np.allclose(np.array(told["mel"].split(","), float), bands.mean(axis=0), atol=0.006) and abs(float(told["energy"]) - energy.mean()) < 0.006


def test_audio_memory_does_not_follow_the_samples():
    import tracemalloc

    stored = media.write_wav(b"some words, " * 350_000)
    tracemalloc.start()
    media.feature_text(media.tensors_of(stored))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(stored), peak / len(stored)


def test_resampling_keeps_a_tone():
    t = np.arange(4000) / media.RATE
    y = media.resample(np.sin(2 * np.pi * 440 * t))
    rate = media.RATE * media.UP / media.DOWN
    assert len(y) == -(-4000 * media.UP // media.DOWN)
    spectrum = np.abs(np.fft.rfft(y * np.hanning(len(y))))
    assert abs(np.fft.rfftfreq(len(y), 1 / rate)[spectrum.argmax()] - 440) < 3


def test_hysteresis_and_tiles():
    energy = np.array([-5, 1, 4, 2, 1, -1, 2, 5, -2, 2.0])
    assert media.segments(energy) == [(2, 5), (7, 8)]


def test_audio_tiles(spark, docs):
    some = spark.createDataFrame(list(docs.items())[:10] + [(None, None)], "doc_id long, text string")
    rows = media.audio_tiles(media.with_tensors(media.store_audio(some))).collect()
    assert all(len(r.log_mel) == media.TILE_FRAMES * media.MELS and len(r.energy_db) == media.TILE_FRAMES and r.end_s > r.start_s for r in rows)
    assert {r.doc_id for r in rows} == {None, *(i for i, _ in list(docs.items())[:10])}
    for i, text in list(docs.items())[:3]:
        want = media.tensors_of(media.write_wav(media.payload_of(text)[1]))
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.tile)
        assert np.array_equal(np.array([r.log_mel for r in mine], np.float32).reshape(-1), want["log_mel"].to_numpy_ndarray().reshape(-1))
    assert media.audio_tiles(media.with_tensors(media.store_audio(some.limit(0)))).count() == 0


def test_every_good_label_is_trusted(spark):
    many = spark.range(25_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    again = many.filter("doc_id < 10").withColumn("quality", F.lit(0))
    assert quality.trusted_labels(many.unionByName(again)).count() == 24_990


# ----------------------------------------------------------------- licences


def test_licences_match_sql(spark):
    texts = [
        "Released under the MIT License.", "intro\n(Released  under the MIT, License)\nend", "released under MIT", licenses.TEXTS["MIT"], licenses.TEXTS["ISC"] + "\nCopyright (c) 2020 someone", "", None,
        "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "the the the " * 500, "Licensed under CC BY-NC 4.0.", "all rights reserved",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan_licenses(df).collect()))
    con = duckdb.connect()
    documents = pa.table({"doc_id": list(range(len(texts))), "text": texts})  # noqa: F841
    want = sorted(con.execute(licenses.oracle()).fetchall())
    assert [(a, b, c and round(c, 12), d) for a, b, c, d in got] == [(a, b, c and round(c, 12), d) for a, b, c, d in want]
    assert [r[1] for r in got][:4] == ["MIT", "MIT", None, "MIT"] and got[3][3] == "text"


def test_bounds_prune_nothing():
    for n in range(1, 200):
        lo, hi = licenses.bounds(n)
        reach = [a for a in range(1, 3 * n + 2) if 2 * min(a, n) / (a + n) >= licenses.THRESHOLD]
        assert (min(reach), max(reach)) == (lo, hi)


def test_a_full_bsd_3_text_is_not_bsd_2(spark):
    two = licenses.TEXTS["BSD-2-Clause"]
    at = two.index("THIS SOFTWARE IS")
    three = f"{two[:at]}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {two[at:]}"
    df = spark.createDataFrame([(2, two), (3, three)], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan_licenses(df).collect()} == {2: "BSD-2-Clause", 3: "BSD-3-Clause"}


# ----------------------------------------------------------- language model


def test_gradient():
    rng = np.random.default_rng(0)
    net = lm.GRU(rng.integers(1, 50, lm.KNOWN).astype(float), 100.0)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    tokens, targets, h = rng.integers(0, lm.KNOWN + 2, (5, 3)), rng.integers(-1, lm.KNOWN + 1, (5, 3)), rng.standard_normal((3, lm.HIDDEN))
    _, grad, _ = net.loss_gradient(tokens, targets, h)
    for k in net.p:
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        value, loss = net.p[k][at], []
        for e in (1e-5, -1e-5):
            net.p[k][at] = value + e
            loss.append(net.loss_gradient(tokens, targets, h)[0])
        net.p[k][at] = value
        assert grad[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-5, rel=1e-4)


def test_probabilities_sum_to_one():
    net = lm.GRU(np.arange(lm.KNOWN).astype(float), 500.0)
    h = np.random.default_rng(1).standard_normal((1, lm.HIDDEN)).astype(np.float32).clip(-1, 1)
    assert np.exp(net.log_p(np.repeat(h, lm.KNOWN + 1, axis=0), np.arange(lm.KNOWN + 1))).sum() == pytest.approx(1, abs=1e-4)


def test_scores_do_not_depend_on_the_layout():
    rng = np.random.default_rng(2)
    net = lm.GRU(rng.integers(1, 50, lm.KNOWN).astype(float), 100.0)
    docs = [np.append(rng.integers(1, lm.KNOWN + 1, n), 0).astype(np.int32) for n in (0, 1, 5, 70, 300, 33)]
    many = lm.score_documents(net, docs, lanes=3, window=16)
    alone = [lm.score_documents(net, [d])[0] for d in docs]
    h, total = np.zeros((1, lm.HIDDEN), np.float32), 0.0
    for before, token in zip([lm.START, *docs[3][:-1]], docs[3]):
        h, _ = net.step(np.array([before]), h)
        total += float(net.log_p(h, np.array([token]))[0])
    assert many == pytest.approx(alone, rel=1e-4) and many[3] == pytest.approx(total, rel=1e-4)


def test_one_long_text_among_short_ones():
    """Memory goes with the tokens, not with the longest text times the lanes."""
    import tracemalloc

    rng = np.random.default_rng(3)
    net = lm.GRU(rng.integers(1, 50, lm.KNOWN).astype(float), 100.0)
    docs = [np.append(rng.integers(1, lm.KNOWN + 1, n), 0).astype(np.int32) for n in (100_000, *[20] * 300)]
    tracemalloc.start()
    got = lm.score_documents(net, docs)
    lm.learn(net, docs[1:] + [docs[0][-5000:]], 1, 0.01, 128)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak
    assert np.isfinite(got).all() and got[0] < got[1:].min()


def test_long_words_are_looked_up_too(spark):
    long = "x" * 100
    rows = [(i, f"{long} a b{i % 3}") for i in range(200)]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 200 and all(r.n_known == 4 for r in got)


def test_base_score_and_gain(spark, sf_dir, docs):
    got = {r.doc_id: r for r in lm.score_texts(common.documents(spark, sf_dir), hot_words=1500).collect()}
    words = {i: [w.lower() for w in re.findall(rb"[^ \t-\r]+", t.encode())] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(w for i, ws in words.items() if not held[i] for w in [*ws, b" end"])
    n, v = sum(c.values()), len(c)
    assert got.keys() == docs.keys()
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(ws) + 1, n)
        assert r.n_known == sum(c[w] > 0 for w in [*ws, b" end"])
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, b" end"]), rel=1e-9)
        assert r.score < 0
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_network_learns_from_every_row(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 1000, raising=False)
    rows = [(i, f"one two three word{i % 5}") for i in range(lm.TRAIN_DOCS + 50)]
    frame = lambda rs: spark.createDataFrame(rs, "doc_id long, text string")
    last = frame(rows).orderBy(F.xxhash64("doc_id").desc()).first().doc_id  # not in the sample of the start
    words = [b" ", b"one", b"two", b"three", *(b"word%d" % k for k in range(5))]
    hot = lm.Hot(words, [len(rows)] * 4 + [len(rows) // 5] * 5)
    total = 5 * len(rows)
    all_rows, again = lm.fit(frame(rows), hot, total), lm.fit(frame(rows).repartition(7), hot, total)
    other = lm.fit(frame([(i, "three two one " * 50 if i == last else t) for i, t in rows]), hot, total)
    assert all(np.allclose(all_rows.p[k], again.p[k], atol=1e-6) for k in all_rows.p)
    assert not all(np.allclose(all_rows.p[k], other.p[k], atol=1e-6) for k in all_rows.p)


# --------------------------------------------------------------- edge cases


def test_edge_rows(spark, labels):
    df, none = edge.frame(spark), edge.empty(spark)
    want = Counter(r[0] for r in edge.rows())
    for f in (
        lambda d: quality.judge_quality(d, labels), lambda d: toxicity.score_toxicity(d, labels), pii.scan_pii, media.media_digests, licenses.scan_licenses, lm.score_texts,
        lambda d: toxicity.drop_toxic(d, labels.limit(0)), lambda d: quality.keep_good(d, labels).select("doc_id"),
    ):
        got = Counter(r.doc_id for r in f(df).collect())
        assert got == want or got <= want and f(df).columns == ["doc_id"]
        assert f(none).count() == 0 and f(none).columns == f(df).columns
