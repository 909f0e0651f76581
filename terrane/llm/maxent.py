"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(w | h) = P(class | h) P(member | class, h) P(w | member). The HEAD most frequent words form HEAD / MEMBERS classes by frequency;
all others fall into TAIL classes by their last byte. The class is a softmax over hashed features of the history: the word before
(n-gram), the one before that (skip), and both together. Inside each class its MEMBERS members are a softmax over hashed features
of the word before. A member of a head class is a word; one of a tail class is a group of words by hash, in which a word has its
share of the group's training count. Unknown words have the share of a tail class that words seen once have in it (Good-Turing),
one unknown word for each class. The tables of features grow with the number of different words (Table.sizes), up to ROWS_MOST rows, which
every machine holds.

Training: each task runs minibatch gradient descent (row-wise Adagrad) from the common weights over its texts; the tasks' steps
are averaged row by row, by how often each task used the row, as exact sums of whole numbers; ROUNDS such rounds share the texts.
Scoring: sparse numpy batches. Counts of the MID most frequent words are sent to all machines (a bounded table); the rest are
joined by word hash, one row for each text and word. Words are told apart by 64-bit hashes.

Defined results: a null or empty text has the end token alone; rows are scored each, repeated or not; null ids are learnt from like
others; an empty table gives no rows; no training text at all leaves the base at one unknown word and the model at its start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import own_shuffles, settle
from terrane.llm.wordhash import Batch, batches, mix, space_map

HEAD, MEMBERS, TAIL = 512, 32, 16
HEAD_CLASSES = HEAD // MEMBERS
CLASSES = HEAD_CLASSES + TAIL
ROWS_LEAST, ROWS_MOST = 1 << 13, 1 << 16  # hashed feature rows for the class: a power of two
TYPES_A_ROW = 32
CONTEXT_ROWS = 32  # one context for the members of classes for so many rows
MID = 1 << 19
ROUNDS, MINIBATCH, RATE = 2, 8192, 0.15
_PLACE_BITS = 13  # of a place in a minibatch
_ONES = np.ones(MEMBERS, np.float32)
SLOT_BITS = 21
FIX = 2048.0  # steps travel as whole numbers of 1 / FIX, two bytes each
_MAP = space_map()
END, START = np.uint64(0xE1D0E1D0E1D0E1D1), np.uint64(0x57A2757A2757A275)


def _tail_classes() -> np.ndarray:
    """Tail class by a word's last byte: marks, digits, non-ASCII letters, groups of Latin letters."""
    t = np.full(256, 8, np.int64)
    for i, c in enumerate("%*$&#!.,"):
        t[ord(c)] = i
    t[48:58] = 9
    t[128:] = 10
    t[97:123] = 15
    for i, some in enumerate(("ao", "e", "nr", "stx")):
        for c in some:
            t[ord(c)] = 11 + i
    return t


_TAIL_OF = _tail_classes()


class Tokens:
    """Hashes, tail classes, text numbers and two words of history of all tokens of some texts, an end token after each."""

    def __init__(self, texts: list):
        b = Batch(texts, _MAP)
        n, m = len(b.hashes), len(texts)
        text = b.text_of()
        place = np.arange(n) + text  # one end token for each text before
        ends = b.first[1:] + np.arange(m)
        self.h, self.tail, self.text = np.empty(n + m, np.uint64), np.zeros(n + m, np.int64), np.empty(n + m, np.int64)
        self.h[place], self.h[ends] = b.hashes, END
        raw = np.frombuffer(b.data, np.uint8)
        self.tail[place] = _TAIL_OF[_MAP[raw[b.ends - 1]]] if n else 0
        self.text[place], self.text[ends] = text, np.arange(m)
        new = np.ones(n + m, bool)
        new[1:] = self.text[1:] != self.text[:-1]
        self.h1 = np.concatenate([[START], self.h[:-1]])
        self.h1[new] = START
        self.h2 = np.concatenate([[START], self.h1[:-1]])
        self.h2[new] = START


@dataclass
class Table:
    """What scoring needs of the counts: sorted hashes, counts and member numbers (-1: not in the head) of the MID words, and figures of members."""

    h: np.ndarray
    c: np.ndarray
    member: np.ndarray
    tokens: int
    types: int
    least: int  # words counted at least so often are in the table
    count: np.ndarray  # CLASSES x MEMBERS, of the tokens
    once: np.ndarray  # of the words seen once, for each tail class

    def sizes(self) -> tuple[int, int]:
        """Rows for the class, and contexts for the members, both powers of two."""
        rows = ROWS_LEAST
        while rows < ROWS_MOST and rows * TYPES_A_ROW < self.types:
            rows *= 2
        return rows, rows // CONTEXT_ROWS

    def index(self) -> np.ndarray:
        """First place of each value of the hashes' top bits: a handful of words share one."""
        return np.searchsorted(self.h >> np.uint64(64 - SLOT_BITS), np.arange((1 << SLOT_BITS) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Place in the table, or -1."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, end = index[slot], index[slot + 1]
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        while len(live):
            same = self.h[at] == h[live]
            out[live[same]] = at[same]
            at += 1
            go = ~same & (at < end)
            live, at, end = live[go], at[go], end[go]
        return out

    def units(self, h: np.ndarray, tail: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Class and member, as class * MEMBERS + member, of words at places of the table (-1: elsewhere)."""
        unit = HEAD + group(h, tail)
        if len(self.member):
            member = np.where(at >= 0, self.member[at], -1)
            unit = np.where(member >= 0, member, unit)
        return unit

    def unknown(self) -> np.ndarray:
        """Share of unknown words in each tail class."""
        return (self.once + 1) / (self.count[HEAD_CLASSES:].sum(axis=1) + 2)

    def share(self) -> np.ndarray:
        """Share of one occurrence of a known word in its group."""
        return ((1 - self.unknown())[:, None] / np.maximum(self.count[HEAD_CLASSES:], 1)).ravel()


def group(h: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Number of a tail word's group: its class, and five bits of its hash."""
    return tail * MEMBERS + ((h >> np.uint64(7)) & np.uint64(MEMBERS - 1)).astype(np.int64)


@dataclass
class Weights:
    rows: np.ndarray  # rows + contexts * CLASSES, each MEMBERS wide: class weights, then member weights
    bias: np.ndarray
    words: np.ndarray  # CLASSES x MEMBERS


def _features(t: Tokens, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        one = mix(t.h1 ^ np.uint64(0x1111))
        two = mix(t.h2 ^ np.uint64(0x2222))
        both = mix(one * np.uint64(3) + two)
    cut = lambda x, n: (x & np.uint64(n - 1)).astype(np.int64)
    rows, contexts = sizes
    return cut(one, rows), cut(two, rows), cut(both, rows), rows + cut(one >> np.uint64(20), contexts) * CLASSES


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities, and logarithms of the sums. Takes z as room to work in."""
    e = np.exp(z, out=z)
    s = e @ _ONES.astype(z.dtype)
    e *= (1 / s)[:, None]
    return e, np.log(s)


def _sum(w: np.ndarray, first: np.ndarray, *rows: np.ndarray) -> np.ndarray:
    z = w.take(rows[0], axis=0)
    for r in rows[1:]:
        z += w.take(r, axis=0)
    z += first
    return np.minimum(z, 60, out=z)  # far above what training gives


def _spread(rows: np.ndarray, d: np.ndarray, w: np.ndarray, acc: np.ndarray, used: np.ndarray) -> None:
    """One Adagrad step on the rows named, by the sums of d."""
    n = len(rows)
    key = (rows << _PLACE_BITS) | np.arange(n)
    key.sort()
    r = key >> _PLACE_BITS
    key &= (1 << _PLACE_BITS) - 1
    at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    g, r = np.add.reduceat(d.take(key, axis=0), at, axis=0), r[at]
    used[r] += np.diff(np.append(at, n))
    size = acc[r] + np.einsum("ij,ij->i", g, g) / MEMBERS
    acc[r] = size
    g *= (RATE / np.sqrt(size + 1e-6))[:, None]
    g += w.take(r, axis=0)
    w[r] = g


def _train(start: Weights, table: Table):
    """Texts to steps: row, used, and the step as whole numbers."""
    sizes = table.sizes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = start.rows.copy()
        acc, used = np.zeros(len(w), np.float32), np.zeros(len(w), np.int64)
        unit, index = np.arange(MINIBATCH), table.index()
        for f in frames:
            texts = f["x"].tolist()
            for a, b in batches(texts):
                t = Tokens(texts[a:b])
                f1, f2, f12, ctx = _features(t, sizes)
                cls, member = np.divmod(table.units(t.h, t.tail, table.find(t.h, index)), MEMBERS)
                ctx += cls
                for i in range(0, len(cls), MINIBATCH):
                    s = slice(i, i + MINIBATCH)
                    x1, x2, x3, x4, y, k = f1[s], f2[s], f12[s], ctx[s], cls[s], member[s]
                    d, _ = _softmax(_sum(w, start.bias, x1, x2, x3))
                    e, _ = _softmax(_sum(w, start.words.take(y, axis=0), x4))
                    for x, goal in ((d, y), (e, k)):
                        np.negative(x, out=x)
                        x[unit[: len(y)], goal] += 1
                    _spread(x4, e, w, acc, used)
                    for x in (x1, x2, x3):
                        _spread(x, d, w, acc, used)
        seen = np.flatnonzero(used)
        step = np.clip(np.rint((w[seen] - start.rows[seen]) * FIX), -32768, 32767).astype(np.int16)
        for i in range(0, len(seen), 1 << 14):
            s = slice(i, i + (1 << 14))
            yield pd.DataFrame({"row": seen[s], "used": used[seen[s]], "step": pd.Series(list(step[s]), dtype=object)})

    return run


def vocabulary(docs: DataFrame) -> DataFrame:
    """docs: x (text). h, tail (tail class), c (count) of each word, the end token included."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, parts = f["x"].tolist(), []
            for a, b in batches(texts, 1 << 22):
                t = Tokens(texts[a:b])
                h, first, n = np.unique(t.h, return_index=True, return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "tail": t.tail[first].astype(np.int32), "n": n})

    words = docs.select("x").mapInPandas(run, "h long, tail int, n long")
    return settle(words.groupBy("h").agg(F.sum("n").alias("c"), F.min("tail").alias("tail")), "lm-vocabulary")


def table_of(words: DataFrame) -> Table:
    """Figures of the vocabulary; only MID rows and a few sums reach the driver."""
    cuts = [1 << k for k in range(1, 48)]
    sums = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), *(F.count_if(F.col("c") >= k).alias(f"c{k}") for k in cuts)).first()
    least = next(k for k in cuts if sums[f"c{k}"] <= MID)
    top = words.filter(F.col("c") >= least).toPandas().sort_values(["c", "h"], ascending=[False, True]).reset_index(drop=True)
    top["member"] = np.where((np.arange(len(top)) < HEAD), np.arange(len(top)), -1)
    groups = words.groupBy("tail", F.shiftrightunsigned("h", 7).bitwiseAND(MEMBERS - 1).alias("g"))
    return figures(top, groups.agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once")).collect(), int(sums["n"] or 0), int(sums["v"]), least)


def figures(top: pd.DataFrame, groups: list, tokens: int, types: int, least: int) -> Table:
    """top: h, c, tail, member of the MID words; groups: tail class, number in it, tokens and words seen once, the head's included."""
    count, once = np.zeros(CLASSES * MEMBERS), np.zeros(TAIL)
    for tail, g, n, seen_once in groups:
        count[HEAD + tail * MEMBERS + g] = n
        once[tail] += seen_once
    head = top[top["member"] >= 0]
    h = head["h"].to_numpy(np.int64).view(np.uint64)
    np.subtract.at(count, HEAD + group(h, head["tail"].to_numpy(np.int64)), head["c"].to_numpy(np.int64))
    np.subtract.at(once, head["tail"].to_numpy(np.int64), head["c"].to_numpy(np.int64) == 1)
    count[head["member"].to_numpy(np.int64)] = head["c"]
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Table(h[order], top["c"].to_numpy(np.int64)[order], top["member"].to_numpy(np.int64)[order], tokens, types, least, count.reshape(CLASSES, MEMBERS), once)


def first_weights(table: Table) -> Weights:
    total = table.count.sum(axis=1)
    bias = np.log((total + 1) / (total.sum() + CLASSES))
    inside = np.log(table.count + 0.5)
    inside[:HEAD_CLASSES][table.count[:HEAD_CLASSES] == 0] = -30.0  # no such word
    inside -= _softmax(inside.copy())[1][:, None]
    rows, contexts = table.sizes()
    return Weights(np.zeros((rows + contexts * CLASSES, MEMBERS), np.float32), bias.astype(np.float32), inside.astype(np.float32))


def train(docs: DataFrame, table: Table, rounds: int = ROUNDS) -> Weights:
    """docs: x, part (a number that deals texts to rounds)."""
    w = first_weights(table)
    for k in range(rounds):
        some = docs.filter(F.pmod("part", F.lit(rounds)) == k).select("x")
        steps = some.mapInPandas(_train(w, table), "row int, used long, step array<smallint>")
        # One row for each feature row and task; the sums are spread over the feature rows, and their result has a fixed size.
        means = F.array(*((F.sum(F.col("step")[i].cast("long") * F.col("used")) / F.sum("used") / FIX).cast("float") for i in range(MEMBERS)))
        with own_shuffles(docs.sparkSession):
            got = steps.groupBy("row").agg(means.alias("step")).toArrow().combine_chunks()
        rows = w.rows.copy()
        if len(got):
            rows[got["row"].to_numpy()] += pa.concat_arrays(got["step"].chunks).flatten().to_numpy().reshape(-1, MEMBERS)
        w = Weights(rows, w.bias, w.words)
    return w


def _score(w: Weights, table: Table):
    log_total = np.log10(table.tokens + table.types + 1)
    ln10 = np.log(10.0)
    known_share, sizes = np.log10(table.share()), table.sizes()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid, index = TaskContext.get().partitionId() << 40, table.index()
        for f in frames:
            texts = f.column(1).to_pylist()
            for a, b in batches(texts):
                t, m = Tokens(texts[a:b]), b - a
                f1, f2, f12, ctx = _features(t, sizes)
                at = table.find(t.h, index)
                seen, units = at >= 0, table.units(t.h, t.tail, at)
                cls, member = np.divmod(units, MEMBERS)
                ctx += cls
                logp, inside = np.empty(len(cls)), np.empty(len(cls))
                for i in range(0, len(cls), MINIBATCH):
                    s = slice(i, i + MINIBATCH)
                    y, k = cls[s], member[s]
                    unit = np.arange(len(y))
                    z = _sum(w.rows, w.bias, f1[s], f2[s], f12[s])
                    x = _sum(w.rows, w.words.take(y, axis=0), ctx[s])
                    logp[s], inside[s] = z[unit, y], x[unit, k]
                    logp[s] -= _softmax(z)[1]
                    inside[s] -= _softmax(x)[1]
                logp /= ln10
                inside /= ln10
                logp[seen] += inside[seen]
                c = table.c[at] if len(table.c) else np.zeros(len(at), np.int64)
                middle = seen & (units >= HEAD)
                logp[middle] += np.log10(c[middle]) + known_share[units[middle] - HEAD]
                base = np.where(seen, np.log10(c + 1.0), 0.0) - log_total
                n = np.bincount(t.text, minlength=m)
                out = {
                    "k": f.column(0).slice(a, m),
                    "rid": rid + np.arange(m),
                    "n_tokens": n,
                    "n_known": np.bincount(t.text[seen], minlength=m),
                    "base": np.bincount(t.text, base, minlength=m),
                    "score": np.bincount(t.text, logp, minlength=m),
                }
                rid += m
                rare = np.flatnonzero(~seen)
                order = rare[np.lexsort((t.h[rare], t.text[rare]))]
                h, x = t.h[order], t.text[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (x[1:] != x[:-1])])) if len(order) else np.empty(0, np.int64)
                count = np.diff(np.append(new, len(order)))
                inside = np.add.reduceat(inside[order], new) if len(new) else np.empty(0)
                cut = pa.array(np.searchsorted(x[new], np.arange(m + 1)).astype(np.int32))
                for name, values in (("rare", h[new].view(np.int64)), ("groups", (units[order][new] - HEAD).astype(np.int32)), ("times", count.astype(np.int32)), ("inside", inside)):
                    out[name] = pa.ListArray.from_arrays(cut, pa.array(values))
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()], list(out))

    return run


def scores(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; held_out: of a key column, true where the row isn't learnt from."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("x"))
    training = rows.filter(~held_out(F.col("k"))).select("x", F.coalesce(F.crc32(F.col("x").cast("binary")), F.lit(0)).alias("part"))
    words = vocabulary(training)
    table = table_of(words)
    weights = train(training, table, rounds)
    kind = docs.schema[key].dataType.simpleString()
    part = settle(rows.mapInArrow(_score(weights, table), f"k {kind}, rid long, n_tokens long, n_known long, base double, score double, rare array<long>, groups array<int>, times array<int>, inside array<double>"), "lm-scored")

    rare = part.select("rid", F.explode(F.arrays_zip("rare", "groups", "times", "inside")).alias("r")).select("rid", F.col("r.rare").alias("h"), F.col("r.groups").alias("t"), F.col("r.times").alias("n"), F.col("r.inside").alias("inside"))
    joined = rare.join(words.filter(F.col("c") < table.least).select("h", "c"), "h", "left")
    share = F.array(*(F.lit(float(x)) for x in np.log10(table.share())))
    lost = F.array(*(F.lit(float(x)) for x in np.log10(table.unknown())))
    joined = joined.select(
        "rid",
        F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).cast("long").alias("known"),
        (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("base"),
        (F.col("n") * F.when(F.col("c").isNotNull(), F.log10(F.col("c").cast("double")) + F.get(share, F.col("t"))).otherwise(F.get(lost, (F.col("t") / MEMBERS).cast("int"))) + F.when(F.col("c").isNotNull(), F.col("inside")).otherwise(0.0)).alias("score"),
    )
    more = joined.groupBy("rid").agg(F.sum("known").alias("known2"), F.sum("base").alias("base2"), F.sum("score").alias("score2"))
    zero = F.lit(0.0)
    return part.select("k", "rid", "n_tokens", "n_known", "base", "score").join(more, "rid", "left").select(
        F.col("k").alias(key),
        held_out(F.col("k")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(table.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("score2", zero)).alias("score"),
    )
