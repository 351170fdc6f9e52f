"""Exact, near and line deduplication against brute force."""

import random
import time
from collections import defaultdict

import numpy as np
import xxhash
from kindstore.llm.components import connected
from kindstore.llm.exact import exact_groups
from kindstore.llm import linededup
from kindstore.llm.linededup import LEAST_WORDS, common_lines, dedup_lines, patience
from kindstore.llm.simhash import near_groups, near_links


def test_exact_edges(edge):
    rows = [tuple(r) for r in exact_groups(edge).collect()]
    assert len(rows) == 10
    same = [r for r in rows if r[0] in (1, 2)]
    assert {(r[0], r[1], r[2], r[3]) for r in same} == {(1, 1, 3, True), (2, 1, 3, False)}
    empty = [r for r in rows if r[0] in (3, 4)]  # null, empty, and a null id with null text
    assert {(r[1], r[2]) for r in empty} == {(3, 3)}
    assert [r[3] for r in rows if r[0] is None] == [True, False] or [r[3] for r in rows if r[0] is None] == [False, True]
    assert exact_groups(edge.limit(0)).count() == 0


def test_exact_lanes_agree(docs):
    a = exact_groups(docs, lanes=64, fan_in=2)
    b = exact_groups(docs, lanes=1)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {9: 32, 10: 32, 11: 32, 12: 32, 13: 32}
    ).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(nodes, near):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_near_groups_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: _fingerprint(t) for i, t in texts.items()}
    want = _components(sorted(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in near_groups(docs).collect()}
    assert got == {i: (prints[i], want[i]) for i in texts}


def test_near_edges(edge):
    rows = [tuple(r) for r in near_groups(edge).collect()]
    assert len(rows) == 10
    assert {r[2] for r in rows if r[1] == "0" * 16} == {3}
    assert {r[2] for r in rows if r[0] in (1, 2)} == {1}
    assert near_groups(edge.limit(0)).count() == 0


def test_trie_finds_every_link(spark):
    rng = np.random.default_rng(5)
    points = set()
    for centre in rng.integers(0, 1 << 63, 40):
        for _ in range(12):
            value = int(centre)
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                value ^= 1 << int(bit)
            points.add(value)
    points = sorted(points)
    want = defaultdict(set)
    for node, top in _components(points, lambda a, b: (a ^ b).bit_count() <= 4).items():
        want[top].add(node)
    want = sorted(sorted(g) for g in want.values() if len(g) > 1)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "_print bigint")
    for node_rows in (10**6, 3):  # whole subtries, and subtries cut by the second block
        got = defaultdict(set)
        for r in connected(near_links(df, node_rows=node_rows)).collect():
            got[r.component] |= {r.node % (1 << 64), r.component % (1 << 64)}
        assert sorted(sorted(g) for g in got.values()) == want


def test_components_of_a_path(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (100, 101)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected(links).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {101: 100}
    assert connected(links.limit(0)).count() == 0


def test_patience_is_a_common_order():
    random.seed(4)
    for _ in range(200):
        a = [random.randint(0, 12) for _ in range(random.randint(0, 20))]
        b = [random.randint(0, 12) for _ in range(random.randint(0, 20))]
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
    assert patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]


def _runs(lines, words):
    """Every run of lines with words at both ends that holds LEAST_WORDS words and no line more than it needs on one side."""
    for i, n in enumerate(words):
        total = 0
        for j in range(i, len(lines)):
            total += words[j]
            if n and words[j] and total >= LEAST_WORDS:
                yield i, j + 1
                if total - words[i] >= LEAST_WORDS:
                    break


def test_line_dedup_brute_force(docs):
    texts = {r.doc_id: r.text.split("\n") for r in docs.collect()}
    # A passage cut into short lines, of which each has an earlier holder of its own; and one that moved and repeats.
    short = [" ".join(f"p{i}{j}" for j in range(8)) for i in range(7)]
    block = [" ".join(f"q{i}{j}" for j in range(30)) for i in range(4)]
    top = max(texts)
    for i, line in enumerate(short):
        texts[top + 1 + i] = [f"own {i}", line]
    texts |= {top + 20: ["x", *short, "y"], top + 21: ["z", *short], top + 22: block}
    texts |= {top + 23: [*block[2:], "", *block[:2], "own", *block, "own", *block]}
    spark = docs.sparkSession
    found = dedup_lines(spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()], "doc_id bigint, text string"))
    got = {r.doc_id: (set(r.deleted_lines), r.text) for r in found.collect()}
    seen = set()
    for i in sorted(texts):
        words = [len(line.replace("\t", " ").split()) for line in texts[i]]
        plain = [line if n else "" for line, n in zip(texts[i], words)]
        runs = [(a, b, tuple(plain[a:b])) for a, b in _runs(plain, words)]
        want = {k for a, b, run in runs if run in seen for k in range(a, b) if words[k]}
        assert {k for k in got[i][0] if words[k]} == want, i
        assert got[i][1] == "\n".join(line for k, line in enumerate(texts[i]) if k not in got[i][0])
        seen |= {run for _, _, run in runs}
    assert len(got[top + 21][0]) == 7 and got[top + 23][1].split() == ["own", "own"]


def test_line_dedup_passages_and_edges(spark, edge):
    passage = "\n".join(" ".join(f"w{i}{j}" for j in range(20)) for i in range(3))
    rows = [(3, f"own three\n{passage}\nend"), (1, f"own one\n{passage}"), (2, "own two\nend"), (4, passage), (None, passage)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].text == rows[1][1] and got[2].text == "own two\nend" and got[None].text == passage
    assert got[3].text == "own three\nend" and got[3].copied_from == [1] and got[4].text == ""
    assert dedup_lines(edge).count() == 10 and dedup_lines(edge.limit(0)).count() == 0


def test_line_dedup_passages_outvoted_by_short_lines(spark):
    passage = " ".join(f"w{i}" for i in range(50))
    rows = [(1, f"n1\nx\nn2\n{passage}"), (2, f"{passage}\nn1\ny\nn2")]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].deleted_lines == [] and got[2].deleted_lines == [0] and got[2].text == "n1\ny\nn2"


def test_common_lines_brute_force():
    random.seed(6)
    sizes = {line: random.choice([1, 2, 8, 12, 25]) if line else 0 for line in range(14)}
    for _ in range(3000):
        a = [random.randint(0, 13) for _ in range(random.randint(0, 16))]
        b = [random.randint(0, 13) for _ in range(random.randint(0, 16))]
        for _ in range(random.randint(0, 2)):
            i, j = random.randint(0, len(a)), random.randint(0, len(b))
            b[j:j] = a[i : i + random.randint(1, 5)]
        words = [sizes[line] for line in b]
        parts = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        want = set()
        for i in range(len(b)):
            for j in range(i + 1, len(b) + 1):
                if sum(words[i:j]) >= LEAST_WORDS and tuple(b[i:j]) in parts:
                    want.update(k for k in range(i, j) if words[k])
        assert {k for k in common_lines(a, b, words, LEAST_WORDS) if words[k]} == want, (a, b)


def _thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_lines_with_colliding_polynomials_differ(spark):
    """The Thue-Morse word and its complement have one polynomial hash modulo 2 ** 64; lines go by their bytes."""
    bits = _thue_morse(2048)
    lines = [" ".join("xy"[b] for b in bits), " ".join("yx"[b] for b in bits)]
    rows = [(1, lines[0]), (2, lines[1]), (3, "\n".join([*lines, "own", lines[0]]))]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].deleted_lines == got[2].deleted_lines == [] and got[2].copied_from == []
    assert got[3].deleted_lines == [0, 1, 3] and got[3].text == "own" and got[3].copied_from == [1, 2]


def test_only_aligned_blocks_go(monkeypatch):
    """Without alignment nothing is deleted."""
    a, b = [1, 2, 3, 4], [9, 2, 3, 8]
    assert common_lines(a, b, [10] * 4, LEAST_WORDS) == [1, 2]
    monkeypatch.setattr(linededup, "patience", lambda a, b: [])
    assert common_lines(a, b, [10] * 4, LEAST_WORDS) == []


def test_long_texts_align_in_about_linear_time():
    a = [i // 2 + 1 for i in range(200_000)]  # every line doubled
    b = [*a[100_000:], 0, *a[:100_000]]  # halves exchanged
    start = time.perf_counter()
    assert len(common_lines(a, a, [3] * len(a), LEAST_WORDS)) == len(a)
    found = common_lines(a, b, [3 if line else 0 for line in b], LEAST_WORDS)
    assert len(found) == len(a) and time.perf_counter() - start < 60
