"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Folding: NFKC, lower case, accents off, letters that look like Latin ones replaced, and digits and signs that stand for
letters read as such where a letter is beside them (a sign only before one, so closing punctuation stays); runs of white space are one blank.
Learning (labelled rows only; FIT_ROWS of them at most, those with the smallest seeded hash): a word's support is the number of
different neighbour pairs it has in toxic texts, so copies of one text count once. Words of SUPPORT pairs and a log-odds
of MIN_ODDS against clean texts are the lexicon, weighted by it; nothing else bounds it but FIT_ROWS. A stem (the first STEMS letters of words,
written with a star) is a term like a word, from STEM_SUPPORT pairs on; a word counts for its heaviest term alone. Two-word phrases with a lexicon word
that clean texts hold more often than toxic ones are exceptions: a match inside one doesn't count. The sum of weights for each 100
words and the number of matches, as logarithms, and the largest weight go through a logistic curve fitted on the same rows.

Defined results: a null or empty text has no match and gets the score of such texts; repeated rows score alike; null ids score
and are never learnt from; labels other than 0 and 1 are ignored; with no labels, or one class, the lexicon is empty and the
score is the smoothed share of toxic labels. Only the fitted rows' figures, bounded by FIT_ROWS, reach the driver.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_ROWS, SEED = 20_000, 5
SUPPORT, MIN_ODDS, MAX_ODDS = 5, 2.0, 9.0
EXCEPTION_SUPPORT = 3
STEMS, STEM_SUPPORT, STEM_ODDS = range(4, 11), 20, 3.0

#: Cyrillic and Greek letters by the Latin ones they look like.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
#: Digits and signs by the letters they stand for.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i"}

_LOOKS = str.maketrans(HOMOGLYPHS)
_SUBSTITUTE = re.compile(r"(?<=[a-z])[01345789]|[01345789](?=[01345789@$!]*[a-z])|[@$!](?=[01345789@$!]?[a-z])")
_LETTERS = {**DIGITS, **SIGNS}
_NEEDS = re.compile(r"[0-9@$!]")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    """Folded text; never fails, whatever the text."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
        text = text.lower().translate(_LOOKS)
    else:
        text = text.lower()
    if _NEEDS.search(text):
        text = _SUBSTITUTE.sub(lambda m: _LETTERS[m[0]], text)
    return " ".join(text.split())


@dataclass
class Model:
    lexicon: dict[str, float]
    exceptions: list[str]
    curve: tuple[float, ...]

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for w, x in sorted(self.lexicon.items(), key=lambda t: t[0].endswith("*")):
            w, stem = w.rstrip("*"), w.endswith("*")
            found.add_word(w, (len(w), x, stem))
        for p in self.exceptions:
            found.add_word(p, (len(p), None, False))
        if len(found):
            found.make_automaton()
        return found


def matches(automaton, text: str) -> tuple[int, float, float]:
    """Whole-word matches outside exception phrases: their number, sum of weights and largest weight."""
    if not len(automaton):
        return 0, 0.0, 0.0
    by_start, safe = {}, []
    for end, (n, weight, stem) in automaton.iter(text):
        start = end - n + 1
        if (start and text[start - 1].isalpha()) or (not stem and end + 1 < len(text) and text[end + 1].isalpha()):
            continue
        if weight is None:
            safe.append((start, end, weight))
        elif start not in by_start or weight > by_start[start][2]:
            by_start[start] = (start, end, weight)
    hits = list(by_start.values())
    if safe:
        reach, spans = -1, []
        for s, e, _ in sorted(safe, key=lambda x: x[0]):
            if s <= reach:
                spans[-1][1] = reach = max(reach, e)
            else:
                spans.append([s, e])
                reach = e
        starts = [s for s, _ in spans]
        from bisect import bisect_right

        hits = [h for h in hits if not ((k := bisect_right(starts, h[0]) - 1) >= 0 and h[1] <= spans[k][1])]
    return len(hits), sum(h[2] for h in hits), max((h[2] for h in hits), default=0.0)


def features(automaton, text: str | None) -> tuple[int, float, float]:
    """Number of matches, the largest weight, and log(1 + weights for each 100 words)."""
    folded = fold(text)
    n, total, most = matches(automaton, folded)
    return n, most, float(np.log1p(100.0 * total / max(len(folded.split()), 1))) if n else 0.0


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn, rows: int) -> DataFrame:
    """x, y of the labelled documents to learn from, one for each key however often it is repeated; the labels' side is bounded by rows, so it may be broadcast."""
    y = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).filter(learn(F.col("k")) & F.col("y").isin(0, 1))
    y = y.groupBy("k").agg(F.max("y").cast("int").alias("y")).orderBy(F.xxhash64(F.lit(SEED), "k"), "k").limit(rows)
    return docs.select(F.col(key).alias("k"), F.col(text).alias("x")).join(F.broadcast(y), "k").groupBy("k").agg(F.min(F.struct("x", "y")).alias("r")).select("r.x", "r.y")


def terms_of(word: str) -> list[str]:
    """The word and its stems."""
    return [word, *(word[:n] + "*" for n in STEMS if n <= len(word))]


def _wanted(term: str, support: int, odds: float) -> bool:
    return odds >= STEM_ODDS and support >= STEM_SUPPORT if term.endswith("*") else odds >= MIN_ODDS


def _longest(lexicon: dict[str, float], support: dict[str, int]) -> dict[str, float]:
    """The lexicon without stems that a longer term stands for: one with nine tenths of the stem's support."""
    gone = set()
    for t in lexicon:
        for n in STEMS:
            stem = t.rstrip("*")[:n] + "*"
            if stem != t and stem in lexicon and n <= len(t.rstrip("*")) and support[t] >= 0.9 * support[stem]:
                gone.add(stem)
    return {t: x for t, x in lexicon.items() if t not in gone}


def _toxic_contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = set()
        for x in f["x"]:
            w = ["", *_WORD.findall(fold(x)), ""]
            for a, b, c in zip(w, w[1:], w[2:]):
                rows.update((t, a + " " + c) for t in terms_of(b))
        yield pd.DataFrame(list(rows), columns=["w", "c"])


def fit(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """learn: of a key column, true where a row may be learnt from."""
    spark = docs.sparkSession
    from terrane.llm.common import settle

    sample = settle(_sample(docs, labels, key, text, label, learn, rows), "toxicity-sample")
    support = sample.filter("y = 1").select("x").mapInPandas(_toxic_contexts, "w string, c string").distinct().groupBy("w").count()
    toxic = {r["w"]: r["count"] for r in support.filter(F.col("count") >= SUPPORT).collect()}
    words = spark.sparkContext.broadcast(frozenset(toxic))

    def clean_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, clean, size = words.value, Counter(), Counter()
        for f in frames:
            for x, y in zip(f["x"], f["y"]):
                w = _WORD.findall(fold(x))
                size[str(y)] += len(w)
                if y == 0:
                    clean.update(t for b in w for t in terms_of(b) if t in known)
        yield pd.DataFrame([("w", k, v) for k, v in clean.items()] + [("n", k, v) for k, v in size.items()], columns=["what", "w", "n"])

    got = sample.mapInPandas(clean_counts, "what string, w string, n long").groupBy("what", "w").agg(F.sum("n").alias("n")).collect()
    clean = {r["w"]: r["n"] for r in got if r["what"] == "w"}
    size = {r["w"]: r["n"] for r in got if r["what"] == "n"}
    odds = {w: float(np.log((n + 0.5) / (size.get("1", 0) + 1) * (size.get("0", 0) + 1) / (clean.get(w, 0) + 0.5))) for w, n in toxic.items()}
    lexicon = {w: min(x, MAX_ODDS) for w, x in odds.items() if _wanted(w, toxic[w], x)} if size.get("0") and size.get("1") else {}
    lexicon = _longest(lexicon, toxic)
    in_lexicon = spark.sparkContext.broadcast(frozenset(lexicon))

    def phrases(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = in_lexicon.value, Counter()
        for f in frames:
            for x, y in zip(f["x"], f["y"]):
                w = fold(x).split()
                seen.update((a + " " + b, int(y)) for a, b in zip(w, w[1:]) if not known.isdisjoint(terms_of(a)) or not known.isdisjoint(terms_of(b)))
        yield pd.DataFrame([(p, n * (1 - y), n * y) for (p, y), n in seen.items()], columns=["p", "clean", "toxic"])

    exceptions = []
    if lexicon:
        found = sample.mapInPandas(phrases, "p string, clean long, toxic long").groupBy("p").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        exceptions = [r["p"] for r in found.filter((F.col("clean") >= EXCEPTION_SUPPORT) & (F.col("clean") > 2 * F.col("toxic"))).orderBy("p").collect()]
    model = Model(lexicon, exceptions, (0.0,) * 4)

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = model.automaton()
        for f in frames:
            rows = [features(a, x) for x in f["x"]]
            yield pd.DataFrame({"most": [w for _, w, _ in rows], "x": [v for _, _, v in rows], "n": [float(np.log1p(n)) for n, _, _ in rows], "y": f["y"]})

    points = sample.mapInPandas(measured, "most double, x double, n double, y int").toPandas()
    model.curve = _logistic(points[["most", "x", "n"]].to_numpy(np.float64), points["y"].to_numpy(np.float64))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method; the intercept has a prior of one row of each class."""
    k = x.shape[1] + 1
    if not len(y):
        return (0.0,) * k
    nothing = np.zeros((2, k))
    nothing[:, 0] = 1
    x, y, w = np.vstack([np.column_stack([np.ones(len(y)), x]), nothing]), np.append(y, [0, 1]), np.zeros(k)
    penalty = np.array([1e-6, *[ridge] * (k - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_matches, score of each row; the score depends on the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        a = m.automaton()
        b0, b1, b2, b3 = m.curve
        for f in frames:
            rows = [features(a, x) for x in f.column(1).to_pylist()]
            z = np.array([b0 + b1 * w + b2 * v + b3 * np.log1p(n) for n, w, v in rows], np.float64)
            yield pa.RecordBatch.from_arrays([f.column(0), pa.array([n for n, _, _ in rows], pa.int64()), pa.array(1 / (1 + np.exp(-z)))], ["k", "n_matches", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("x"))
    return rows.mapInArrow(run, f"k {kind}, n_matches long, score double").withColumnRenamed("k", key)
