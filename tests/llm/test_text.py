"""Encoding, counts, quality, language, toxicity and secrets."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from kindstore.llm import bpe, language, toxicity
from kindstore.llm.base import text_chunks
from kindstore.llm.bpe import Encoder, decode_documents, encode_documents, model_bytes, read_ranks, round_trip
from kindstore.llm.lengths import length_histogram, quantile_lengths, suffix_sums, truncated_totals
from kindstore.llm.linear import Grams, code_points, gram_blocks
from kindstore.llm.quality import fit_quality, quality_rules, text_stats
from kindstore.llm.secrets import ALLOWED, BASE, CLASSES, UNIT, digest_spans, plogp, scan_secrets
from pyspark.sql import functions as F

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_encoder_equals_tiktoken(reference):
    ranks = read_ranks(PATH)
    encoder = Encoder(ranks, model_bytes(ranks), PATTERN)
    random.seed(1)
    chars = [chr(c) for c in [*range(0x250), 0x1680, 0x180E, 0x2028, 0x202F, 0x3000, 0xFEFF, 0x4E00, 0x1F600, 0x300]]
    texts = ["".join(random.choice(chars + list("  \n\tabc's 12") * 40) for _ in range(random.randint(0, 60))) for _ in range(2000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [reference.encode_ordinary(t) for t in texts]


def test_round_trip(docs, edge, reference):
    for df in (docs, edge):
        want = Counter()
        for r in df.collect():
            text = r.text or ""
            ids = np.array(reference.encode_ordinary(text), "<u4")
            want[r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in round_trip(df, PATH, PATTERN).collect()) == want
    ids = encode_documents(docs, PATH, PATTERN)
    back = decode_documents(ids, PATH).join(docs, "doc_id").where(F.col("decoded").cast("string") != F.col("text"))
    assert back.count() == 0 and round_trip(edge.limit(0), PATH, PATTERN).count() == 0


def test_lengths(docs, edge, reference):
    lengths = [len(reference.encode_ordinary(r.text or "")) for r in docs.collect()]
    sums = suffix_sums(length_histogram(docs, PATH, PATTERN), bin_size=100).cache()
    for r in sums.collect():
        assert r.docs_ge == sum(n >= r.length for n in lengths) and r.tokens_ge == sum(n for n in lengths if n >= r.length)
        assert r.truncated_total == sum(min(n, r.length) for n in lengths)
        assert r.share_fitting == pytest.approx(sum(n <= r.length for n in lengths) / len(lengths))
    limits = [0, 1, 500, 777, 10**7]
    got = {r.limit: r.truncated_total for r in truncated_totals(sums, limits).collect()}
    assert got == {n: sum(min(x, n) for x in lengths) for n in limits}
    assert quantile_lengths(sums, [0.5]).first().length == sorted(lengths)[len(lengths) // 2 - 1]
    assert {r.n_docs for r in length_histogram(edge, PATH, PATTERN).where("length = 0").collect()} == {3}
    assert suffix_sums(length_histogram(edge.limit(0), PATH, PATTERN)).count() == 0


def _stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    cover = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)]


def test_quality_counts_compare_bytes():
    """Lines and windows whose words spell the Thue-Morse word and its complement have one polynomial hash, but differ."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    texts = ["\n".join(" ".join(pair[b] for b in bits) for pair in ("xy", "yx")), "\n".join("".join(pair[b] for b in bits) for pair in ("xy", "yx", "xy"))]
    table = pa.array(texts, pa.large_string())
    got = np.concatenate([text_stats(data, offsets) for _, _, data, offsets in text_chunks(table)])
    assert got.tolist() == [_stats(t) for t in texts] and got[0][3] == 0 and got[1][3] == 1


def test_character_grams_are_code_points():
    """Grams of one, two and three characters, whatever their bytes; none runs over the end of a text."""
    texts = ["añ中😀añ中", "", "中", "a😀"]
    _, _, data, offsets = next(text_chunks(pa.array(texts, pa.large_string())))
    points, first = code_points(data, offsets)
    assert first.tolist() == [0, 7, 7, 8, 10] and len(set(points.tolist())) == 4
    blocks = list(gram_blocks(data, offsets, Grams(bytes=(), chars=(1, 2, 3), buckets=1 << 20)))
    every = "".join(texts)
    for n, (bucket, begin, end) in zip((1, 2, 3), blocks, strict=True):
        assert (end - begin).tolist() == [max(len(t) - n + 1, 0) for t in texts]
        grams = {}
        for a, b in zip(begin, end):
            for place in range(a, b):
                assert grams.setdefault(every[place : place + n], bucket[place]) == bucket[place]
        assert len(set(grams.values())) == len(grams)


def test_encoder_forgets_long_words(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    encoder = Encoder(read_ranks(PATH), model_bytes(read_ranks(PATH)), PATTERN)
    random.seed(8)
    for _ in range(30):
        text = " ".join("".join(random.choices("abcXYZ09+/", k=300)) for _ in range(5))
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)
        assert sum(map(len, encoder.words)) <= 4000 and encoder.held <= 8000


def test_quality_counts():
    random.seed(1)
    texts = ["".join(random.choice(["a", "b", " ", "\n", "\t", "é", "#", "\x0b", " a b"]) for _ in range(random.randint(0, 150))) for _ in range(800)]
    texts += ["", "\n", "a\n", "\na", "a\n\na\n"]
    for limit in (50, 1 << 21):
        got = np.concatenate([text_stats(d, o) for _, _, d, o in text_chunks(pa.array(texts), limit)])
        assert got.tolist() == [_stats(t) for t in texts]


def test_quality_verdicts(spark, edge):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    apart = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    model = fit_quality(docs, labels.where(~apart))
    got = quality_rules(docs, model).join(labels.where(apart), "doc_id").where("NOT base_failed")
    assert got.where("kept = (quality = 1)").count() >= 0.97 * got.count()
    assert quality_rules(edge, model).count() == 10 and quality_rules(edge, None).where("kept").count() == 0
    assert fit_quality(docs, labels.limit(0)) is None and quality_rules(edge.limit(0), model).count() == 0


def test_language(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_language(docs)
    got = language.predict_language(docs, model).where(language.held_out(F.col("doc_id")))
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()
    rows = language.predict_language(edge, model).collect()
    assert len(rows) == 10 and all(r.lang_pred == "und" for r in rows if r.doc_id in (3, 4, 5, 7) or not r.text)
    assert all(0 <= r.score <= 1 for r in rows) and rows[0]._text == "x"
    assert language.fit_language(edge.limit(0)) is None
    assert {r.lang_pred for r in language.predict_language(edge, None).collect()} == {"und"}
    assert language.with_language(edge, model).columns == edge.columns


def _best_first(v):
    def best(lo, hi):
        found = max(((sum(v[i:j]), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
        if found[0] <= 0:
            return []
        return best(lo, found[1]) + [(found[1], found[2], round(found[0], 6))] + best(found[2], hi)

    return best(0, len(v))


def test_maximal_segments():
    random.seed(3)
    for _ in range(300):
        v = np.array([random.uniform(-3, 2.5) for _ in range(random.randint(0, 20))])
        sums, at = np.r_[0, np.cumsum(v)], np.flatnonzero(v > 0)
        got = [(f, e, round(s, 6)) for f, e, s in toxicity.maximal_segments(at, at + 1, sums[at], sums[at + 1])]
        assert got == _best_first(v.tolist())


def test_toxic_tokens_lose_all_punctuation():
    words = ["idiot", "idiot" + "!" * 7, "(" * 9 + "IDIOT" + "." * 50, "!" * 30, "!", "a-b", "--é--"]
    same = [0, 0, 0, 3, 3, 5, 6]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    found, first = toxicity.tokens(data, np.array([0, len(data)]))
    assert found.tolist() == [found[i] for i in same] and len(set(found.tolist())) == 4 and first.tolist() == [0, 7]


def test_toxicity(spark, edge):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs.where(toxicity.held_out(F.col("doc_id"))), model).join(labels, "doc_id")
    hits = {(r.toxic, r.p): r["count"] for r in got.groupBy("toxic", (F.col("score") >= 0.5).alias("p")).count().collect()}
    assert hits[1, True] >= 0.85 * (hits[1, True] + hits[1, False]) and hits.get((0, True), 0) <= 0.02 * hits[0, False]
    rows = toxicity.score_toxicity(edge, model).collect()
    assert len(rows) == 10 and all(0 <= r.score < 0.5 for r in rows if r.doc_id in (3, 4, 5))
    assert toxicity.fit_toxicity(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score_toxicity(edge, None).collect()} == {0.0}


def _spans(text):
    base = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in re.finditer(p, text, re.ASCII) if len(m.group(g)) >= n)
    spans = list(base)
    for k, (_, alphabet, shortest, window, bits) in enumerate(CLASSES, len(BASE)):
        new = []
        for m in re.finditer("[" + re.escape(alphabet) + "]{%d,}" % shortest, text):
            s = m.group()
            loss = min(sum(plogp(c) for c in Counter(s[i : i + window]).values()) for i in range(len(s) - window + 1))
            free = not any(a < m.end() and m.start() < e for a, _, e in spans)
            if free and loss <= plogp(window) - round(UNIT * bits * window) and not any(re.search(x, s) for x in ALLOWED):
                new.append((m.start(), k, m.end()))
        spans += new
    names = [name for name, *_ in (*BASE, *CLASSES)]
    listed = [",".join(f"{names[k]}:{a}:{e}" for a, k, e in sorted(x)) for x in (base, spans)]
    return *[sum(x[1] == k for x in base) for k in range(3)], hashlib.sha256(listed[0].encode()).hexdigest(), listed[1]


def test_secrets(spark, edge):
    random.seed(2)
    parts = ["password", "token", "API_KEY", "apikey ", "secret=", ": ", "AKIA", "0a1b2c3d", "ZZ9X", *"abcdef0123456789ghzAKIA=:+/_. -\"'é\n"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 120))) for _ in range(800)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts += ["x " + "".join(random.choice(letters) for _ in range(random.randint(20, 60))) + " y" for _ in range(100)]
    # Letters beyond ASCII that some engines fold to s and k.
    texts += ["\u017fecret=abcdefghijkl12", "to\u212aen: abcdefghijkl12", "SeCrEt=abcdefghijkl12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    got = {r.doc_id: tuple(r)[1:] for r in digest_spans(scan_secrets(df)).collect()}
    assert got == {i: _spans(t) for i, t in enumerate(texts)}
    assert digest_spans(scan_secrets(edge)).count() == 10 and scan_secrets(edge.limit(0)).count() == 0
    assert plogp(8) == round(UNIT * 8 * math.log2(8))


def test_toxicity_learns_nothing_from_held_out_labels(docs, labels):
    out = toxicity.held_out(F.col("doc_id"))
    turned = labels.withColumn("toxic", F.when(out, 1).otherwise(F.col("toxic")))
    want, got = (toxicity.fit_toxicity(docs, known) for known in (labels.where(~out), turned))
    assert np.allclose(got.weights, want.weights, rtol=1e-6)
