"""Operator 5, toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digit substitutions), matched
against the lexicon by an Aho-Corasick automaton, freed of matches inside
exception phrases, and scored by the weights found, normalised by length.  The
lexicon and its weights are learned from labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, clash_free, lean, table

#: Labelled rows that a model is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 30_000
#: Entries that a lexicon keeps, at most.
ENTRIES = 20_000
#: Lengths of the beginnings of words that are entries beside whole words.
STEMS = (4, 5, 6)

# What stands for what.  Accented letters are folded by their decomposition.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n", "ʟ": "l", "ɡ": "g",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i",
    # capitals that look like others than their small letters do
    "В": "b", "Н": "h", "Ν": "n", "Η": "h", "Ρ": "p", "Υ": "y", "Β": "b", "Ζ": "z", "Μ": "m", "Χ": "x", "Τ": "t", "Р": "p", "С": "c", "У": "y", "Х": "x",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e", "£": "l"}
#: Phrases in which an entry is no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "take out the trash", "clown fish", "circus clown", "stupid question", "pond scum", "soap scum", "scum line", "sore loser board", "the idiot by dostoevsky")

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()}
_DIGIT = {ord(k): v for k, v in DIGITS.items()}
_WORD = re.compile(r"[^\W_]+")
_STAND_INS = "@$!|+€£"
#: A run of letters, digits and characters that may stand for letters.
_RUN = re.compile(rf"[\w{_STAND_INS}]+")
_LETTER = re.compile(r"[^\W\d_]")
_TRAILING = re.compile(r"[!|+]+$")
_STAND_IN = re.compile(rf"[01345789{_STAND_INS}]")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff]+")
_GLYPH = re.compile(f"[{''.join(HOMOGLYPHS)}]")


def _unmask(word: str) -> str:
    core = _TRAILING.sub("", word)
    return core.translate(_DIGIT) + word[len(core) :]


def _unmasked(text: str) -> str:
    """text with the stand-ins of runs that also hold letters undone; only runs around a stand-in are looked at."""
    out, done = [], 0
    for m in _STAND_IN.finditer(text):
        at = m.start()
        if at < done:
            continue
        while at > done and (text[at - 1].isalnum() or text[at - 1] == "_" or text[at - 1] in _STAND_INS):
            at -= 1
        run = _RUN.match(text, at)[0]
        if _LETTER.search(run):
            out += (text[done:at], _unmask(run))
        else:
            out.append(text[done : at + len(run)])
        done = at + len(run)
    out.append(text[done:])
    return "".join(out)


def fold(text: str) -> str:
    """Lower case, without accents, homoglyphs and, in runs that also hold letters, digit substitutions."""
    if text.isascii():
        text = text.lower()
    else:
        if _GLYPH.search(text):
            text = text.translate(_FOLD)
        text = text.lower()
        if _GLYPH.search(text):
            text = text.translate(_FOLD)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _unmasked(text)


def entries_of(folded: str) -> set[str]:
    """What a text offers to a lexicon: whole words (with both edges) and beginnings of words."""
    out = set()
    for word in set(_WORD.findall(folded)):
        if 3 <= len(word) <= 30:
            out.add(f" {word} ")
            out.update(f" {word[:n]}" for n in STEMS if len(word) > n)
    return out


@dataclass
class Model:
    """A lexicon with weights, exception phrases, and the logistic scale of a text's features."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    scale: tuple[float, ...] = (-2.0, 1.0, 0.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "scale": self.scale, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                found.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                found.add_word(f" {phrase} ", (len(phrase) + 2, None))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def features(self, text: str) -> tuple[float, float]:
        """log(1 + sum of weights) and log(1 + sum of weights per 100 words); one match, the heaviest, for each word."""
        if not (self.weights or self.exceptions):
            return 0.0, 0.0
        words = _WORD.findall(fold(text))
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton().iter(" " + " ".join(words) + " "):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            else:
                best[start] = max(best.get(start, 0.0), weight)
        total = sum(w for at, w in best.items() if not any(s <= at < e for s, e in spared))
        return float(np.log1p(total)), float(np.log1p(100 * total / max(len(words), 10)))

    def score(self, text: str) -> float:
        a, *b = self.scale
        z = a + sum(x * y for x, y in zip(b, self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_scale(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton's method, with a small ridge."""
    design = np.c_[np.ones(len(x)), x]
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - ridge * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(beta.size)
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def train(rows: DataFrame, label: str = "toxic", text: str = "text", exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """A model from labelled rows; the caller bounds them.  No rows, or one label only: no entries, the share of the label as score.

    An entry's weight is its log odds among toxic against other texts, with a
    prior; an entry must occur in three toxic texts or one in a thousand of
    them, and at eight times the rate of other texts.
    """

    def offered(batches):
        for batch in batches:
            toxic: dict[str, list[int]] = {}
            for body, y in zip(batch.column(0), batch.column(1).to_pylist()):
                for entry in entries_of(fold(body.as_py() or "")):
                    toxic.setdefault(entry, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(toxic)), pa.array([v[0] for v in toxic.values()], pa.int64()), pa.array([v[1] for v in toxic.values()], pa.int64())], ["entry", "other", "toxic"])

    y = (F.col(label) > 0).cast("int").alias("y")
    kept = rows.where(F.col(label).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("text"), y)
    n1, n = kept.select(F.sum("y"), F.count("*")).first()
    n1, n0 = n1 or 0, n - (n1 or 0)
    if not n1 or not n0:
        share = (n1 + 0.5) / (n + 1)
        return Model({}, exceptions, (float(np.log(share / (1 - share))), 0.0, 0.0))
    odds = F.log((F.col("t") + 1) / (n1 + 2)) - F.log((F.col("o") + 1) / (n0 + 2))
    counted = kept.mapInArrow(lean(offered), "entry string, other long, toxic long").groupBy("entry").agg(F.sum("other").alias("o"), F.sum("toxic").alias("t"))
    best = counted.where((F.col("t") >= max(3, n1 // 1000)) & (F.col("t") * n0 >= 8 * (F.col("o") + 1) * n1))
    top = best.select("entry", odds.alias("w"), "t").orderBy(F.desc(F.col("w") * F.sqrt("t")), "entry").limit(ENTRIES).collect()
    model = Model({r["entry"]: r["w"] for r in top if r["w"] > 0}, exceptions)

    def measured(batches):
        for batch in batches:
            x = [model.features(body.as_py()) for body in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), batch.column(1)], ["a", "b", "y"])

    got = kept.mapInArrow(lean(measured), "a double, b double, y int").select(F.round("a", 1).alias("a"), F.round("b", 1).alias("b"), "y").groupBy("a", "b", "y").count().collect()
    many = np.array([r["count"] for r in got])
    x = np.repeat(np.array([[r["a"], r["b"]] for r in got]), many, axis=0)
    model.scale = fit_scale(x, np.repeat(np.array([r["y"] for r in got]), many))
    return model


def score_documents(docs: DataFrame, model: Model, *, text_column: str = "text") -> DataFrame:
    """The rows of docs with score (0 to 1) and predicted (1 if score is 0.5 or more); a null text is empty.

    Columns of docs named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            scores = [model.score(x.as_py() or "") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(lean(run), f"{names}, score double, predicted int")


def held_out(id_column: str = "doc_id") -> Column:
    return F.crc32(F.col(id_column).cast("string")) % 5 == 0


def training_rows(spark: SparkSession, sf_dir: str, limit: int = SAMPLE) -> DataFrame:
    """Texts and labels of rows that aren't held out: ``limit`` of them at most, chosen by a hash of their ids."""
    labels = table(spark, sf_dir, "labels").where(~held_out() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    chosen = labels.orderBy(F.xxhash64("doc_id"), "toxic").limit(limit)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(bounded_broadcast(chosen, limit, SAMPLE), "doc_id")


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the labelled rows, which are kept only as long as it is fitted."""
    rows = training_rows(spark, sf_dir).persist()
    try:
        return train(rows)
    finally:
        rows.unpersist()


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fitted(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


@clash_free
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on labelled rows, doesn't find toxic."""
    model = fitted(spark, sf_dir)
    return score_documents(docs, model).where("predicted = 0").select(*docs.columns)
