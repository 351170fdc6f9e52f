"""Language identification: family first, then one-versus-one support vector machines."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kindstore.llm.base import id_checksum, large_strings, numbered, text_chunks
from kindstore.llm.linear import (
    Grams,
    bounded_sample,
    fit_sigmoid,
    fit_svm,
    keyed,
    linear_scores,
    lowered,
    sample_features,
    sigmoid,
)

# Families of closely related languages (ISO 639-1 codes). A language not listed is its own family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy gd br",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn ur mr gu pa ne",
    "semitic": "ar he mt am",
    "austronesian": "id ms tl jv",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"
GRAMS = Grams(bytes=(1, 2, 3, 4), buckets=1024)
ROWS_PER_LANGUAGE = 800
SEED = 6


def held_out(ident: Column) -> Column:
    """Rows whose label must not be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(id_checksum(ident), F.lit(4)) == 2


class LanguageModel:
    """Families against the rest, and a machine for each pair of languages of a family."""

    def __init__(self, labels: np.ndarray, rows: np.ndarray, folds: np.ndarray):
        self.languages = sorted(set(labels.tolist()))
        self.family = [FAMILY_OF.get(x, f"only {x}") for x in self.languages]
        self.families = sorted(set(self.family))
        of = np.array([self.families.index(self.family[self.languages.index(x)]) for x in labels], int)
        language = np.array([self.languages.index(x) for x in labels], int)
        self.first = [self._machine(rows, of == f, folds) for f in range(len(self.families))] if len(self.families) > 1 else []
        self.pairs = []
        for f in range(len(self.families)):
            inside = [i for i, name in enumerate(self.family) if name == self.families[f]]
            for a, b in combinations(inside, 2):
                use = (language == a) | (language == b)
                self.pairs.append((f, a, b, self._machine(rows[use], language[use] == a, folds[use])))

    @staticmethod
    def _machine(rows, positive, folds):
        """Weights and the sigmoid of their scores, the latter fitted on rows kept apart."""
        apart = folds == 0
        if len(set(positive[apart])) < 2 or len(set(positive[~apart])) < 2:
            apart = np.ones(len(rows), bool)
            w = fit_svm(rows, positive)
        else:
            w = fit_svm(rows[~apart], positive[~apart])
        return w, fit_sigmoid(rows[apart] @ w[:-1] + w[-1], positive[apart])

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the language of each text, and its probability."""

        def chance(machines, data, offsets):
            raw = linear_scores(data, offsets, GRAMS, np.stack([w[:-1] for w, _ in machines], axis=1))
            raw += [w[-1] for w, _ in machines]
            return sigmoid(raw * [s for _, (s, _) in machines] + [o for _, (_, o) in machines])

        docs = len(offsets) - 1
        family, sure = np.zeros(docs, int), np.ones(docs)
        if self.first:
            found = chance(self.first, data, offsets)
            found /= found.sum(1, keepdims=True)
            family, sure = found.argmax(1), found.max(1)
        best, score = np.zeros(docs, int), np.zeros(docs)
        for f, name in enumerate(self.families):
            here = np.flatnonzero(family == f)
            inside = [i for i, x in enumerate(self.family) if x == name]
            votes = np.zeros((len(here), len(inside)))
            mine = [(a, b, m) for g, a, b, m in self.pairs if g == f]
            if mine and len(here):
                part = np.concatenate([data[offsets[d] : offsets[d + 1]] for d in here])
                edges = np.concatenate([[0], np.cumsum(np.diff(offsets)[here])])
                found = chance([m for _, _, m in mine], part, edges)
                for column, (a, b, _) in enumerate(mine):
                    votes[:, inside.index(a)] += found[:, column]
                    votes[:, inside.index(b)] += 1 - found[:, column]
                votes /= len(inside) - 1
            else:
                votes += 1
            best[here] = np.array(inside)[votes.argmax(1)]
            score[here] = sure[here] * np.minimum(votes.max(1), 1)
        return best, score


def fit_language(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    seed: int = SEED,
) -> LanguageModel | None:
    """Fit on a bounded sample of labelled rows: about ``rows_per_language`` of each language.

    Rows held out (see ``held_out``), without language or without text are not
    learned from. Features are computed in tasks; the driver gets the sample's
    hashed features only. None if no row can be learned from.
    """
    rows = keyed(df, id_col, _text=text_col, _label=lang_col)
    rows = rows.where(F.col("_label").isNotNull() & (F.length("_text") > 0) & ~held_out(F.col("_id")))
    keys, labels, found = sample_features(bounded_sample(rows, "_label", rows_per_language, seed), GRAMS, "string")
    if not len(labels):
        return None
    return LanguageModel(labels, found, np.arange(len(keys)) % 5)


def _predicted(df: DataFrame, model: LanguageModel | None, text_col: str) -> DataFrame:
    """The numbered columns of ``df``, then ``_lang`` and ``_score``."""
    place = df.columns.index(text_col)
    plain = numbered(df)
    schema = StructType([*plain.schema.fields]).add("_lang", "string").add("_score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = large_strings(batch.column(place))
            lettered = np.asarray(pc.match_substring_regex(text, r"\p{L}"))
            for begin, end, data, offsets in text_chunks(lowered(text)):
                part = batch.slice(begin, end - begin)
                known = lettered[begin:end]
                if model is None:
                    lang, score = np.full(end - begin, UNKNOWN, object), np.zeros(end - begin)
                else:
                    best, score = model.predict(data, offsets)
                    lang = np.where(known, np.array(model.languages, object)[best], UNKNOWN)
                columns = [*part.columns, pa.array(lang.tolist(), pa.string()), pa.array(np.where(known, score, 0.0))]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "_lang", "_score"])

    return plain.mapInArrow(run, schema)


def predict_language(
    df: DataFrame, model: LanguageModel | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score"
) -> DataFrame:
    """All columns of ``df`` with the predicted language and a score in 0 to 1.

    Whole texts are scored in Arrow batches, lower-cased, as means of the weights
    of their byte n-grams; nothing is shuffled. Defined cases: a text that is null
    or has no letter, and every text if the model is None, is ``und`` with score 0;
    null ids and repeated rows are predicted each; columns named like the new ones
    are replaced; no rows give none.
    """
    found = _predicted(df, model, text_col)
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in (lang_out.lower(), score_out.lower())]
    columns = [*[F.col(f"_column{i}") for i in kept], F.col("_lang"), F.col("_score")]
    return found.select(*columns).toDF(*[df.columns[i] for i in kept], lang_out, score_out)


def with_language(df: DataFrame, model: LanguageModel | None, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """The rows whose text has a language, with a score of ``least_score`` at least; columns unchanged."""
    found = _predicted(df, model, text_col).where((F.col("_lang") != UNKNOWN) & (F.col("_score") >= least_score))
    return found.drop("_lang", "_score").toDF(*df.columns)
