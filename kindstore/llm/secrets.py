"""Secret scans: patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindstore.llm.base import narrow

# The base kinds with their patterns and the shortest value (group) that counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 1, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
# Character classes for entropy. Name, characters, shortest candidate, window, least bits a character.
CLASSES = (
    ("entropy_hex", "0123456789abcdefABCDEF", 20, 20, 3.0),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 24, 4.0),
)
# Candidates that are no secrets. No digit or no letter; counting and alphabet runs; placeholders; UUIDs.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"(?i)0123456789|abcdefghijkl|qwertyuiop",
    r"(?i)example|placeholder|changeme|xxxxxx|lorem",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
# Entropy is summed in whole millionths of a bit, so that every engine agrees on it.
UNIT = 1_000_000


def plogp(count: int) -> int:
    return round(UNIT * count * math.log2(count)) if count else 0


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array, by doubling: about log2(n) passes, each linear."""
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(values).cast("double"))).cast("int"), F.lit(0)))

    def add(sums: Column, k: Column) -> Column:
        step = F.pow(F.lit(2), k).cast("int")
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - step), F.lit(0)))

    return F.aggregate(passes, values, add)


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Leftmost non-overlapping matches: array of ``start``, ``kind``, ``end``, ``found`` in code points.

    The gaps between matches and the matches alternate, so their lengths give the
    places. Matches whose ``group`` is shorter than ``least`` are dropped afterwards.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    steps = F.transform(
        whole, lambda m, i: (F.char_length(F.get(gaps, i)) + F.char_length(F.get(whole, i))).cast("bigint")
    )
    ends = running_sums(steps)
    spans = F.transform(
        ends,
        lambda end, i: F.struct(
            (end - F.char_length(F.get(whole, i))).alias("start"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            F.get(whole, i).alias("found"),
            F.get(value, i).alias("value"),
        ),
    )
    return F.filter(spans, lambda s: F.char_length(s["value"]) >= least)


def repetition(candidate: Column, alphabet: str, window: int) -> Column:
    """The smallest sum of c * log2(c) over windows, c being the counts of characters in it.

    Counts and sum change by the one character that enters and the one that leaves.
    The entropy of a window is log2(window) less this sum divided by the window.
    """
    table = F.array(*[F.lit(plogp(c)).cast("bigint") for c in range(window + 2)])
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c))
    start = F.struct(
        codes.alias("codes"),
        F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"),
        F.lit(0).cast("bigint").alias("sum"),
        F.lit(1 << 62).cast("bigint").alias("least"),
    )

    def slide(state: Column, place: Column) -> Column:
        enters = F.get(state["codes"], place)
        leaves = F.get(state["codes"], place - window)  # null while the window fills
        more = F.get(state["counts"], enters)
        gained = F.get(table, more + 1) - F.get(table, more)
        fewer = F.get(state["counts"], leaves) + F.when(leaves == enters, 1).otherwise(0)
        lost = F.coalesce(F.get(table, fewer) - F.get(table, fewer - 1), F.lit(0))
        total = state["sum"] + gained - lost
        counts = F.transform(
            state["counts"],
            lambda n, code: n + F.when(code == enters, 1).otherwise(0) - F.when(code == leaves, 1).otherwise(0),
        )
        least = F.when(place >= window - 1, F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(
            state["codes"].alias("codes"), counts.alias("counts"), total.alias("sum"), least.alias("least")
        )

    places = F.sequence(F.lit(0), F.char_length(candidate) - 1)
    return F.aggregate(places, start, slide, lambda state: state["least"])


def high_entropy(text: Column, kind: int, alphabet: str, shortest: int, window: int, bits: float) -> Column:
    """Runs of one character class with a window of at least ``bits`` a character, not on the allow-list."""
    letters = alphabet.replace("-", r"\-")
    found = matches(text, f"[{letters}]{{{shortest},}}", 0, shortest, kind)
    suspect = F.filter(found, lambda s: ~_any(s["found"], ALLOWED))
    most = plogp(window) - round(UNIT * bits * window)
    return F.filter(suspect, lambda s: repetition(s["found"], alphabet, window) <= most)


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | text.rlike(pattern)
    return out


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*[F.lit(name) for name, *_ in (*BASE, *CLASSES)])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in whole texts, in one pass of built-in functions and without a shuffle.

    Base kinds are patterns (``assign``, ``access``, ``hex``). The method adds
    ``entropy_hex`` and ``entropy_base64``: runs of a character class in which a
    sliding window has high Shannon entropy, unless the allow-list knows them or a
    base span (or an earlier class) overlaps them.

    Returns one row per input row: ``id_col``, ``base`` and ``spans`` (arrays of
    ``start``, ``kind`` (place in the list of kinds), ``end``; code points, end
    exclusive; sorted by start, then kind).

    Defined cases: null and empty texts have no spans; null ids and repeated rows
    are scanned each; further columns are ignored; no rows give none. A text with
    many matches costs a little more than linear time (see ``running_sums``).
    """
    rows = narrow(df, _id=id_col, _text=text_col)
    text = F.coalesce(F.col("_text"), F.lit(""))
    found = rows.select(
        "_id",
        *[
            matches(text, pattern, group, least, kind).alias(name)
            for kind, (name, pattern, group, least) in enumerate(BASE)
        ],
        *[
            high_entropy(text, kind, *options).alias(name)
            for kind, (name, *options) in enumerate(CLASSES, len(BASE))
        ],
    )

    def bare(name: str) -> Column:
        return F.transform(name, lambda s: F.struct(s["start"], s["kind"], s["end"]))

    base = F.array_sort(F.concat(*[bare(name) for name, *_ in BASE]))
    found = found.select("_id", base.alias("base"), *[bare(name).alias(name) for name, *_ in CLASSES])
    found = found.withColumn("spans", F.col("base"))
    for name, *_ in CLASSES:
        free = F.filter(
            name,
            lambda s: ~F.exists("spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        )
        found = found.withColumn("spans", F.concat("spans", free))
    return found.select(F.col("_id").alias(id_col), "base", F.array_sort("spans").alias("spans"))


def digest_spans(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans written out."""
    counts = [
        _count(F.col("base"), kind).alias(f"n_{name}") for kind, (name, *_) in enumerate(BASE)
    ]
    return found.select(
        id_col, *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )


def _either_case(pattern: str) -> str:
    """A pattern whose letters in either case are spelled out: some engines also fold letters beyond ASCII."""
    spelled = lambda m: "(?:" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in m[1]) + ")"
    return re.sub(r"\(\?i:([^)]*)\)", spelled, pattern)


def secrets_sql() -> str:
    """The same scan in SQL, with each window counted anew."""
    parts, runs = [], []
    for kind, (_, pattern, group, least) in enumerate(BASE):
        p = _either_case(pattern).replace("'", "''")
        parts.append(
            f"SELECT doc_id, {kind} AS kind, {least} AS least, regexp_extract_all(t, '{p}') AS w,"
            f" regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d"
        )
    for kind, (_, alphabet, shortest, window, bits) in enumerate(CLASSES, len(BASE)):
        p = f"[{alphabet.replace('-', chr(92) + '-')}]{{{shortest},}}"
        parts.append(
            f"SELECT doc_id, {kind} AS kind, {shortest} AS least, regexp_extract_all(t, '{p}') AS w,"
            f" regexp_extract_all(t, '{p}') AS v, string_split_regex(t, '{p}') AS g FROM d"
        )
        runs.append(f"WHEN {kind} THEN {window}")
    windows = f"CASE kind {' '.join(runs)} END"
    most = " ".join(
        f"WHEN {kind} THEN {plogp(window) - round(UNIT * bits * window)}"
        for kind, (_, _, _, window, bits) in enumerate(CLASSES, len(BASE))
    )
    allowed = " AND ".join(f"NOT regexp_matches(found, '{p}')" for p in ALLOWED)
    names = ", ".join(f"'{name}'" for name, *_ in (*BASE, *CLASSES))
    listed = f"string_agg(concat([{names}][kind + 1], ':', s, ':', e), ',' ORDER BY s, kind)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
i AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m WHERE len(w) > 0),
p AS (
  SELECT doc_id, kind, w[i] AS found,
         CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(w[1:i], lambda x: length(x))) AS BIGINT) AS e
  FROM i WHERE length(v[i]) >= least
), a AS (SELECT doc_id, kind, found, e - length(found) AS s, e FROM p),
c AS (SELECT *, row_number() OVER () AS n FROM a WHERE kind >= {len(BASE)} AND {allowed}),
x AS (SELECT n, kind, found, unnest(range(1, length(found) - {windows} + 2)) AS j FROM c),
y AS (SELECT n, kind, j, unnest(string_split(substr(found, j, {windows}), '')) AS ch FROM x),
z AS (SELECT n, kind, j, count(*) AS c FROM y GROUP BY n, kind, j, ch),
h AS (SELECT n, kind, j, sum(CAST(round({UNIT} * c * log2(c)) AS BIGINT)) AS loss FROM z GROUP BY n, kind, j),
r AS (SELECT n FROM h GROUP BY n, kind HAVING min(loss) <= CASE kind {most} END),
b AS (SELECT doc_id, kind, s, e FROM a WHERE kind < {len(BASE)}),
e0 AS (SELECT doc_id, kind, s, e FROM c SEMI JOIN r USING (n)),
e1 AS (SELECT * FROM e0 WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = e0.doc_id AND b.s < e0.e AND e0.s < b.e)),
f AS (SELECT * FROM b UNION ALL SELECT * FROM e1),
e2 AS (SELECT * FROM e0 WHERE kind = 4 AND NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = e0.doc_id AND f.s < e0.e AND e0.s < f.e)),
u AS (SELECT * FROM f UNION ALL SELECT * FROM e2)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce({listed} FILTER (kind < {len(BASE)}), '')) AS base_sha256, coalesce({listed} FILTER (kind >= 0), '') AS spans
FROM d LEFT JOIN u ON d.doc_id = u.doc_id GROUP BY d.doc_id
"""
