"""Conversation repair, nearest vectors and ranked search against brute force."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from kindstore.llm import conversations, hnsw, lexical
from kindstore.llm.conversations import damage, repair_conversations, repair_damaged, repaired_digests
from kindstore.llm.hnsw import build_index, nearest_vectors, search_index
from kindstore.llm.lexical import item_terms, rank_documents
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def _cheapest(rows):
    """(cost, letters) over all edits, by the states of the pattern s?(ua)+ or nothing; rows are (initial, fault)."""

    @functools.cache
    def best(i, state, inserted):
        following = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        out = []
        if i == len(rows):
            if state in ("", "a"):
                out.append((0, ""))
        else:
            initial, fault = rows[i]
            cost, letters = best(i + 1, state, 0)
            out.append((3 + cost, "D" + letters))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if initial == following or (initial == "s" and state == ""):
                    cost, letters = best(i + 1, initial, 0)
                    out.append((more + cost, "K" + letters))
                cost, letters = best(i + 1, following, 0)
                out.append((2 + more + cost, "R" + letters))
        if inserted < 3:
            cost, letters = best(i, following, inserted + 1)
            out.append((2 + cost, "I" + letters))
        return min(out) if out else (10**9, "")

    return best(0, "", 0)


def _repaired(rows):
    """What ``repair_conversations`` reports of one conversation: rows are (turn, role, text), nulls filled but the turn."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        kind = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        faults.append(kind)
        seen.add((role, text))
    pairs = zip(rows[:-1], rows[1:])
    illegal = sum(a[1][:1] + "|" + b[1][:1] not in ("s|u", "u|a", "a|u") for a, b in pairs)
    cost, audit = _cheapest(tuple((r[1][:1], f) for r, f in zip(rows, faults)))
    lines, place, length = [], 0, len(re.sub("D", "", audit))
    for letter in audit:
        role = "assistant" if (length - len(lines)) % 2 else "user"
        if letter in "KR":
            lines.append(f"{rows[place][1] if letter == 'K' else role}:{rows[place][2]}")
        if letter == "I":
            lines.append(f"{role}:")
        place += letter != "I"
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _damaged(rows):
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        for _ in range({0: 0, 3: 2}.get(fault, 1)):
            yield conv, turn, role, text


def _want(rows):
    groups = defaultdict(list)
    for conv, *rest in _damaged(rows):
        groups[conv].append(tuple(rest))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {conv: _repaired(groups[conv]) if conv in groups else empty for conv, *_ in rows}


def _random_rows(seed, convs=60):
    rng = random.Random(seed)
    roles = ["user", "assistant"] * 4 + ["system", "", None, "Tool"]
    texts = ["Yes.", "Yes.", "No", "ok!  ", "", " \t", None, "x\ny?", "é.", "a. b"]
    rows = []
    for conv in [*range(convs), None]:
        for _ in range(rng.randint(0, 16)):
            rows.append((conv, rng.choice([None, *range(-2, 20)]), rng.choice(roles), rng.choice(texts)))
    return rows


CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("bits", [12, 1])
def test_repair(spark, monkeypatch, bits):
    """Also with two places a chunk, so that conversations are chained over many chunks."""
    monkeypatch.setattr(conversations, "CHUNK_BITS", bits)
    rows = _random_rows(3)
    got = {r.conv_id: tuple(r)[1:] for r in repair_damaged(spark.createDataFrame(rows, CONVERSATION)).collect()}
    assert got == _want(rows)


def test_repair_driver_rows(spark):
    df = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in repair_damaged(df).collect()}
    assert got == _want(rows)
    assert Counter(map(tuple, damage(df).collect())) == Counter(_damaged(rows))


def test_repair_edges(spark):
    """One long conversation of copies, extra columns with clashing names, empty tables, long texts."""
    rows = [(1, t, "user", "Same.") for t in range(500)] * 3 + [(1, 500, "assistant", "x" * 300_000 + ".")]
    rows += [(2, None, None, None)] * 3 + [(3, 0, "system", "Be kind."), (3, 1, "assistant", "No")]
    wide = [(*r, 0, "n", 1.0) for r in rows]
    df = spark.createDataFrame(wide, f"{CONVERSATION}, _conv int, Role string, place double")
    found = repair_conversations(df)
    plain = defaultdict(list)
    for conv, turn, role, text in rows:
        plain[conv].append((turn, " " if role is None else role, " " if text is None else text))
    want = {conv: _repaired(own) for conv, own in plain.items() if conv != 1}
    report = {r.conv_id: tuple(r)[1:] for r in found.report.collect()}
    digests = {r.conv_id: r.repaired_sha256 for r in repaired_digests(found.edits).collect()}
    assert {c: (*report[c], digests[c]) for c in want} == want
    # All but the first row of the long one are duplicates; the long answer stays.
    assert report[1][1:4] == (0, 1499, 0) and report[1][4] == 1499 and report[1][5] == 3 * 1499
    assert report[1][6] == "K" + "D" * 1499 + "K"
    kept = found.edits.where("conv_id = 1 and edit = 'K'").orderBy("place").select("role", F.length("text").alias("n")).collect()
    assert [tuple(r) for r in kept] == [("user", 5), ("assistant", 300_001)]
    empty = repair_damaged(df.limit(0))
    assert empty.count() == 0 and empty.columns[:2] == ["conv_id", "gaps"]


def _nearest(rows, k=5, every=50):
    """Exact answers: {query id: [(id, cosine)]}."""
    own = defaultdict(list)
    for ident, vector in rows:
        if ident is None or not vector or any(x is None or not math.isfinite(x) for x in vector) or not any(vector):
            continue
        # Halved until squares are finite; cosines stay the same to the bit.
        own[ident].append(np.array(vector, float) / 2.0 ** math.frexp(max(map(abs, vector)))[1])
    out = {}
    for query in (i for i in own if i % every == 0):
        scores = {}
        for ident, vectors in own.items():
            pairs = [(a, b) for a in own[query] for b in vectors if len(a) == len(b)]
            if ident != query and pairs:
                scores[ident] = max(float((a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum()))) for a, b in pairs)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        if best:
            out[query] = best
    return out


def _answers(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def _recall(got, want):
    hits = [len({i for i, _ in best} & {i for i, _ in got.get(q, [])}) / len(best) for q, best in want.items()]
    return sum(hits) / len(hits)


@pytest.mark.parametrize("shard_rows", [1 << 14, 300])
def test_nearest_vectors(spark, shard_rows):
    """Recall on the driver's rows, in one shard and in several, with a beam narrower than a shard."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = _nearest([tuple(r) for r in df.select("vec_id", "embedding").collect()])
    got = _answers(nearest_vectors(df, shard_rows=shard_rows))
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert _recall(got, want) >= 0.98
    exact = {(q, i): s for q, best in want.items() for i, s in best}
    assert all(s == pytest.approx(exact[q, i], abs=1e-15) for q, best in got.items() for i, s in best if (q, i) in exact)


def test_graph():
    """A thin beam finds near neighbours among clustered points; links stay within their layers."""
    rng = np.random.default_rng(1)
    points = (rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] * 2 + rng.normal(size=(3000, 24))).astype(np.float32)
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    levels = np.floor(-np.log(1 - rng.random(3000)) / np.log(16)).astype(int)
    graph = hnsw.Graph.build(units, levels)
    for level, (nodes, links) in enumerate(graph.layers):
        assert (levels[nodes] >= level).all() and np.isin(links[links >= 0], nodes).all()
        assert links.shape[1] == (16 if level else 32) and not (links == nodes[:, None]).any()
    got = graph.search(units[:100], 40)
    exact = np.argsort(-(units[:100] @ units.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(exact, got)]) >= 0.95


def test_nearest_edges(spark):
    """Nulls, zeros, non-finite parts, copies, ids with several vectors, other lengths, huge parts, clashing names."""
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0])]
    rows += [(6, [None, 1.0]), (7, []), (None, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 1.0]), (8, [3.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    rows += [(100, [1e200, 1e200]), (150, [1.0, 2.0, 3.0]), (200, [5.0])] + [(1000 + i, [0.5, 0.5]) for i in range(30)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, _id string, Embedding int")
    for size in (1 << 14, 4):
        assert _answers(nearest_vectors(df, shard_rows=size)) == {
            q: [(i, pytest.approx(s, abs=1e-15)) for i, s in best] for q, best in _nearest(rows).items()
        }
    assert nearest_vectors(df.limit(0)).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert nearest_vectors(one).count() == 0
    index = build_index(df)
    assert search_index(one, index, k=1).first().vec_id == 100


TERM = re.compile(lexical.TERM)
FOLD = str.maketrans(lexical.UPPER, lexical.LOWER)


def _ranked(docs, items, k=10):
    terms = [(i, TERM.findall(t.translate(FOLD))) for i, t in docs if t is not None]
    terms = [(i, t) for i, t in terms if t]
    n_docs, n_terms = len(terms), sum(len(t) for _, t in terms)
    holding = Counter(w for _, t in terms for w in set(t))
    wanted = defaultdict(Counter)
    for item, text in set(items):
        if text is not None:
            wanted[item] += Counter(TERM.findall(text.translate(FOLD)))
    out = []
    for item, words in wanted.items():
        scores = []
        for ident, t in terms:
            tf, m = Counter(t), 100 - 75 + (75 * len(t) * n_docs) // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m))
                for w, times in words.items() if tf[w]
            )
            if score > 0:
                scores.append((-score, ident is None, ident or 0, ident))
        out += [(item, rank, ident, -s) for rank, (s, _, _, ident) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def test_ranked_search(spark, monkeypatch):
    """Random short texts, with many ties, one block of items and several."""
    rng = random.Random(5)
    letters = ["a", "B", "b", "é", "É", "7", " ", " ", "-", "\n", "\x7f", "ſ", "😀"]
    docs = [(rng.randint(0, 400), "".join(rng.choices(letters, k=rng.randint(0, 60)))) for _ in range(400)] + [(None, "a b"), (1, None)]
    items = [(i, "".join(rng.choices(letters, k=rng.randint(0, 12)))) for i in range(40)] + [(3, "b"), (None, "a"), (7, None), (0, "b b")]
    items += items[:2]
    left = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id bigint, text string, _text string, score int").repartition(5)
    right = spark.createDataFrame(items, "item_id bigint, text string")
    want = _ranked(docs, items)
    for size in (lexical.BLOCK_POSTINGS, 20):
        assert Counter(map(tuple, rank_documents(left, right, block_postings=size).collect())) == want
    monkeypatch.setattr(lexical, "TABLE_CELLS", 100)
    assert Counter(map(tuple, rank_documents(left, right).collect())) == want


def test_ranked_search_driver_rows(spark, docs, edge):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    pairs = [(r.item_id, r.text) for r in items.collect()]
    for df in (docs, edge):
        want = _ranked([(r.doc_id, r.text) for r in df.collect()], pairs)
        assert Counter(map(tuple, rank_documents(df, items).collect())) == want
    assert rank_documents(docs.limit(0), items).count() == 0 and rank_documents(docs, items.limit(0)).count() == 0
    assert item_terms(items).agg(F.min("times")).first()[0] >= 1
