"""Whole result rows of the learned operators against plain loops over the fitted weights."""

import math

import numpy as np
import pytest
from kindstore.llm import language, quality, toxicity
from kindstore.llm.base import FOLDED_CODES, span_hashes
from pyspark.sql import functions as F

M = (1 << 64) - 1


def _mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def _sigmoid(x):
    return 1 / (1 + math.exp(-min(max(x, -30), 30)))


def _hash(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]), FOLDED_CODES)[0])


def _blanks(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def _byte_buckets(text, n, buckets):
    raw = text.encode()
    for i in range(len(raw) - n + 1):
        rolled = int.from_bytes(raw[i : i + n], "little")
        spread = (rolled ^ (rolled >> 15)) * (0x9E3779B97F4A7C15 + 2 * n) & M
        spread ^= spread >> 29
        yield (spread * 0xBF58476D1CE4E5B9 & M) >> (65 - buckets.bit_length())


def _joined_buckets(units, n, buckets):
    for i in range(len(units) - n + 1):
        joined = units[i]
        for unit in units[i + 1 : i + n]:
            joined = _mixed((joined * 31 + unit) & M)
        yield joined >> (65 - buckets.bit_length())


def _linear(kinds, buckets, weights):
    """Sum over the kinds of n-gram of the mean weight of a text's n-grams."""
    total = 0.0
    for place, found in enumerate(kinds):
        found = list(found)
        total += sum(weights[place * buckets + b] for b in found) / max(len(found), 1)
    return total


@pytest.fixture(scope="module")
def short(docs):
    return docs.where(F.length("text") < 1500).cache()


def test_quality_rows(short, docs, labels):
    model = quality.fit_quality(docs, labels)
    got = {r.doc_id: r for r in quality.quality_rules(short, model).collect()}
    grams, rows = quality.GRAMS, short.collect()
    assert not grams.bytes and len(got) == len(rows) > 20
    for r in rows:
        text = r.text.lower()
        units = [_mixed(int.from_bytes(c.encode(), "little")) for c in text]
        words = [_hash(w) for w in _blanks(text)]
        kinds = [_joined_buckets(units, n, grams.buckets) for n in grams.chars]
        kinds += [_joined_buckets(words, n, grams.buckets) for n in grams.words]
        score = _linear(kinds, grams.buckets, model.weights[:, 0]) + model.offset
        chance = _sigmoid(model.slope * score + model.shift)
        mine = got[r.doc_id]
        assert mine.probability == pytest.approx(chance, abs=1e-6)
        failed = mine.n_words < 20 or 100 * mine.n_repeat_words > 30 * mine.n_words
        assert mine.base_failed == failed and mine.kept == (not failed and mine.probability >= quality.THRESHOLD)


def test_quality_probabilities_are_observed_rates(spark):
    """Of all labelled rows, those given a probability around p are good in about p of the cases."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    rows = quality.quality_rules(docs.join(labels.select("doc_id", "quality"), "doc_id"), model).join(labels, "doc_id")
    bands = rows.groupBy(F.floor(F.col("probability") * 4).alias("band")).agg(
        F.avg("probability").alias("p"), F.avg(F.col("quality").cast("double")).alias("rate"), F.count("*").alias("n")
    )
    for r in bands.where("n >= 100").collect():
        assert abs(r.p - r.rate) <= 0.1, r


def test_language_rows(short, docs):
    model, grams = language.fit_language(docs), language.GRAMS
    got = {r.doc_id: r for r in language.predict_language(short, model).collect()}
    for r in short.collect():
        text = r.text.lower()
        buckets = [list(_byte_buckets(text, n, grams.buckets)) for n in grams.bytes]

        def chance(machine):
            w, (slope, offset) = machine
            return _sigmoid(slope * (_linear(buckets, grams.buckets, w[:-1]) + w[-1]) + offset)

        families = [chance(m) for m in model.first] or [1.0]
        family = families.index(max(families))
        inside = [i for i, name in enumerate(model.family) if name == model.families[family]]
        votes = dict.fromkeys(inside, 0.0) if len(inside) > 1 else {inside[0]: 1.0}
        for f, a, b, machine in model.pairs:
            if f == family:
                p = chance(machine)
                votes[a] += p / (len(inside) - 1)
                votes[b] += (1 - p) / (len(inside) - 1)
        best = max(votes, key=votes.get)
        lettered = any(c.isalpha() for c in r.text)
        mine = got[r.doc_id]
        assert mine.lang_pred == (model.languages[best] if lettered else "und")
        want = families[family] / sum(families) * min(votes[best], 1) if lettered else 0.0
        assert mine.score == pytest.approx(want, abs=1e-6)


def _segments(values, low, high):
    """All maximal segments: the best one, and those left and right of it."""
    best, start, total, top = None, low, 0.0, 0.0
    for i in range(low, high):
        if total <= 0:
            start, total = i, 0.0
        total += values[i]
        if total > top + 1e-12:
            best, top = (start, i + 1), total
    if best is None:
        return []
    return [*_segments(values, low, best[0]), (*best, top), *_segments(values, best[1], high)]


def test_toxicity_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    scores = dict(zip(model.hashes.tolist(), model.scores.tolist()))
    some = docs.where(F.length("text") < 1500)
    got = {r.doc_id: r for r in toxicity.score_toxicity(some, model).collect()}
    marks = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())
    n_passages = 0
    for r in some.collect():
        words = [w.strip(marks) or w[0] for w in _blanks(r.text.lower())]
        values = [scores.get(_hash(w), -toxicity.DRIFT) for w in words]
        found = _segments(values, 0, len(values))
        chance = math.log(model.scale * max(len(words), 1))
        bits = [model.rate * s - chance for *_, s in found]
        best = min(max(max(bits, default=-chance), -15), 15)
        more = math.log1p(sum(max(b - math.log(toxicity.SIGNIFICANT), 0) for b in bits))
        a, b, c = model.weights
        mine = got[r.doc_id]
        assert mine.n_tokens == len(words) and mine.score == pytest.approx(_sigmoid(a * best + b * more + c), abs=1e-6)
        want = [(f, e, s) for f, e, s in found if model.scale * len(words) * math.exp(-model.rate * s) < toxicity.SIGNIFICANT]
        assert [(p["first"], p["last"]) for p in mine.passages] == [(f, e) for f, e, _ in want]
        n_passages += len(want)
    assert n_passages
