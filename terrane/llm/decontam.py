"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are lower-cased runs of letters and digits. A seed is an n-gram of a test item that chance would bring at most
RARE times in a million corpus words, by the counts of its words (with PRIOR words more, so that little text makes none look common),
whatever the corpus's size; besides, of each SPREAD n-grams in a row
the rarest is a seed in any case, so an item of common words has seeds all along that one edit doesn't spoil together. So a passage that was leaked a million times still has its seeds: rarity is that of its words together, not of the
passage. Each seed hit opens a window of about three item lengths around the item's place in the document, and local
alignment (match 2, mismatch and gap -1) scores it; the score is a share of the best possible, 2 for each item word.

The corpus is never shuffled: it is scanned twice, once to count the items' words and once to seed and align. The
items' index is broadcast in shards of at most SHARD_BYTES of item text; more text means more scans, not a larger index.

Defined results: items of fewer than MIN_ITEM words must be there word for word, those of fewer than N words as the whole of a text
(chance can't be told from a leak otherwise); null texts and items without words match nothing;
a null id is reported as null; repeated rows are reported each; empty tables give no rows; whole texts are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.wordhash import Batch, batches, letter_map, mix

N, MIN_ITEM = 3, 5
RARE, SPREAD, PRIOR = 0.01, 4, 1_000_000
MATCH, MISMATCH, GAP = 2, -1, 1
THRESHOLD = 0.5
SHARD_BYTES = 8 << 20
AT_ONCE, CELLS = 256, 1 << 20
_MAP = letter_map()
_PAD, _NONE = np.uint64(1), np.uint64(2)


def _grams(h: np.ndarray) -> np.ndarray:
    """Hash of the N words from each place on; the last N - 1 places have none."""
    if len(h) < N:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - N + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(N):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return mix(out)


@dataclass
class Index:
    """Items' words in one array, and seeds by hash: seed s has the entries at[s] to at[s + 1] of item and place."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    seeds: np.ndarray
    at: np.ndarray
    item: np.ndarray
    place: np.ndarray
    tiny: dict  # items of fewer than N words, by their hashes

    @property
    def sieve(self) -> np.ndarray:
        s = np.zeros(1 << 20, bool)
        s[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return s


def build_index(ids: list, texts: list[str | None], counts: dict[int, int], total: int) -> Index:
    b = Batch(texts, _MAP)
    rows: list[tuple[int, int, int]] = []
    tiny: dict[tuple[int, ...], list[int]] = {}
    share = np.array([max(counts.get(int(h), 0), 1) for h in b.hashes], np.float64) / (total + PRIOR)
    for i in range(len(ids)):
        lo, hi = b.first[i], b.first[i + 1]
        if hi - lo < N:
            if hi > lo:
                tiny.setdefault(tuple(b.hashes[lo:hi].tolist()), []).append(i)
            continue
        g = _grams(b.hashes[lo:hi])
        p = np.prod([share[lo + k : lo + k + len(g)] for k in range(N)], axis=0)
        own = p * 1e6 <= RARE
        own[[k + int(np.argmin(p[k : k + SPREAD])) for k in range(0, len(p), SPREAD)]] = True
        rows += [(int(g[j]), i, int(j)) for j in np.flatnonzero(own)]
    rows.sort()
    h = np.array([r[0] for r in rows], np.uint64)
    seeds, start = np.unique(h, return_index=True)
    return Index(ids, b.hashes, b.first, seeds, np.append(start, len(rows)), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), tiny)


def align(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each row of items (B, L) with its row of windows (B, M): score and end place in the window."""
    n, m = windows.shape
    slope = np.arange(m, dtype=np.int32) * GAP
    above = np.zeros((n, m + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        same = np.where(windows == items[:, i : i + 1], np.int32(MATCH), np.int32(MISMATCH))
        h = np.maximum(np.maximum(above[:, :-1] + same, above[:, 1:] - GAP), 0)
        h = np.maximum.accumulate(h + slope, axis=1) - slope
        at = h.argmax(axis=1)
        top = h[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        above[:, 1:] = h
    return best, end


def find_in(index: Index, sieve: np.ndarray, texts: list[str | None], threshold: float = THRESHOLD) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, score, first byte, end byte) of every aligned span; spans of one item in a text don't overlap."""
    b = Batch(texts, _MAP)
    if index.tiny:
        for t in np.flatnonzero((np.diff(b.first) > 0) & (np.diff(b.first) < N)).tolist():
            lo, hi = b.first[t], b.first[t + 1]
            for i in index.tiny.get(tuple(b.hashes[lo:hi].tolist()), []):
                yield t, i, 1.0, int(b.starts[lo] - b.base[t]), int(b.ends[hi - 1] - b.base[t])
    g = _grams(b.hashes)
    hit = np.flatnonzero(sieve[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
    s = np.searchsorted(index.seeds, g[hit])
    s[s == len(index.seeds)] = 0
    ok = index.seeds[s] == g[hit] if len(index.seeds) else np.zeros(len(hit), bool)
    hit, s = hit[ok], s[ok]
    text = np.searchsorted(b.first, hit, side="right") - 1
    whole = hit + N <= b.first[text + 1]
    hit, s, text = hit[whole], s[whole], text[whole]
    if not len(hit):
        return
    n = index.at[s + 1] - index.at[s]
    entry = np.repeat(index.at[s], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, place = index.item[entry], index.place[entry]
    hit, text = np.repeat(hit, n), np.repeat(text, n)
    length = index.first[item + 1] - index.first[item]
    start = hit - place
    key = np.stack([text, item, start // length], axis=1)
    groups, inv = np.unique(key, axis=0, return_inverse=True)
    inv = inv.reshape(-1)
    lo, hi = np.full(len(groups), 1 << 60), np.full(len(groups), -1)
    np.minimum.at(lo, inv, start)
    np.maximum.at(hi, inv, start)
    text, item = groups[:, 0], groups[:, 1]
    length = index.first[item + 1] - index.first[item]
    slack = length // 2 + 4
    lo, hi = np.maximum(lo - slack, b.first[text]), np.minimum(hi + length + slack, b.first[text + 1])
    found: list[tuple[int, int, float, int, int]] = []
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        # So many that the matrices of the longest of them stay bounded.
        many = AT_ONCE
        while many > 1 and many * int(length[order[min(at + many, len(order)) - 1]]) > CELLS:
            many //= 2
        part = order[at : at + many]
        at += many
        size, span = int(length[part].max()), int((hi[part] - lo[part]).max())
        its, wins = np.full((len(part), size), _PAD), np.full((len(part), span), _NONE)
        for r, w in enumerate(part):
            its[r, : length[w]] = index.words[index.first[item[w]] : index.first[item[w] + 1]]
            wins[r, : hi[w] - lo[w]] = b.hashes[lo[w] : hi[w]]
        best, end = align(its, wins)
        good = np.flatnonzero(best >= np.where(length[part] < MIN_ITEM, 1.0, threshold) * MATCH * length[part])
        if not len(good):
            continue
        back_i, back_w = np.full((len(good), size), _PAD), np.full((len(good), span), _NONE)
        for r, x in enumerate(good):  # the reverse of item and window up to the end gives the start
            back_i[r, : length[part[x]]] = its[x, : length[part[x]]][::-1]
            back_w[r, : end[x] + 1] = wins[x, : end[x] + 1][::-1]
        _, behind = align(back_i, back_w)
        for r, x in enumerate(good):
            w = part[x]
            first, last = int(lo[w] + end[x] - behind[r]), int(lo[w] + end[x])
            found.append((int(text[w]), int(item[w]), float(best[x]) / (MATCH * int(length[w])), first, last))
    found.sort(key=lambda r: (r[0], r[1], -r[2], r[3]))
    kept: list[tuple[int, int, float, int, int]] = []
    spans: list[tuple[int, int]] = []  # of the item at hand, in order; none overlap
    for r in found:
        if not kept or kept[-1][:2] != r[:2]:
            spans = []
        k = bisect_left(spans, (r[3], r[4]))
        if (k == 0 or spans[k - 1][1] < r[3]) and (k == len(spans) or spans[k][0] > r[4]):
            spans.insert(k, (r[3], r[4]))
            kept.append(r)
    for t, i, score, first, last in kept:
        yield t, i, score, int(b.starts[first] - b.base[t]), int(b.ends[last] - b.base[t])


def _word_counts(docs: DataFrame, text: str, vocabulary: np.ndarray) -> tuple[dict[int, int], int]:
    """How often each of the (sorted) hashes occurs in all texts, and the number of all words."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = sent.value
        counts, total = np.zeros(len(words) + 1, np.int64), 0
        for f in frames:
            texts = f["x"].tolist()
            for a, b in batches(texts):
                h = Batch(texts[a:b], _MAP).hashes
                total += len(h)
                at = np.searchsorted(words, h)
                at[at == len(words)] = 0
                counts[: len(words)] += np.bincount(at[words[at] == h], minlength=len(words))
        counts[-1] = total
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"i": seen, "n": counts[seen]})

    got = docs.select(F.col(text).alias("x")).mapInPandas(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    by = {r["i"]: r["n"] for r in got}
    return {int(h): by.get(i, 0) for i, h in enumerate(vocabulary)}, by.get(len(vocabulary), 0)


def indexes(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> list[Index]:
    """An index for each shard of the items; what reaches the driver at once is a shard's text, bounded by shard_bytes."""
    items = items.select(F.col(item_key).alias("k"), F.col(item_text).alias("x")).filter("x is not null")
    size = items.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    shards, out = 1 + 2 * size // shard_bytes, []
    for k in range(shards):
        rows = items.filter(F.pmod(F.xxhash64("k", "x"), F.lit(shards)) == k).collect()
        rows.sort(key=lambda r: (r["k"] is None, r["k"], r["x"]))
        ids, texts = [r["k"] for r in rows], [r["x"] for r in rows]
        vocabulary = np.unique(Batch(texts, _MAP).hashes)
        if not len(vocabulary):
            continue
        counts, total = _word_counts(docs, text, vocabulary)
        out.append(build_index(ids, texts, counts, total))
    return out


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """key, item key, score (share of the best), start_byte and end_byte of each leaked span in the UTF-8 text."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"k {kind}, i {item_kind}, score double, start_byte long, end_byte long"
    out = spark.createDataFrame([], schema)
    for index in indexes(docs, items, text, item_key, item_text, shard_bytes):
        sent = spark.sparkContext.broadcast(index)

        def run(frames: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, fields = sent.value, None
            sieve = index.sieve
            for f in frames:
                keys, texts = f.column(0).to_pylist(), f.column(1).to_pylist()
                rows = [(keys[a + t], index.ids[i], score, s, e) for a, b in batches(texts) for t, i, score, s, e in find_in(index, sieve, texts[a:b], threshold)]
                if rows:
                    cols = list(zip(*rows))
                    fields = fields or [f.schema.field(0).type, None, pa.float64(), pa.int64(), pa.int64()]
                    arrays = [pa.array(c, t) for c, t in zip(cols, fields)]
                    yield pa.RecordBatch.from_arrays(arrays, ["k", "i", "score", "start_byte", "end_byte"])

        out = out.unionByName(docs.select(F.col(key).alias("k"), F.col(text).alias("x")).mapInArrow(run, schema))
    return out.withColumnsRenamed({"k": key, "i": item_key})


def drop_leaked(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that hold a leaked item; same columns and types, nothing shuffled."""
    at = [c.lower() for c in docs.columns].index(text.lower())
    for index in indexes(docs, items, text, item_key, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(frames: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            sieve = index.sieve
            for f in frames:
                texts, clean = f.column(at).to_pylist(), np.ones(f.num_rows, bool)
                for a, b in batches(texts):
                    for t, *_ in find_in(index, sieve, texts[a:b], threshold):
                        clean[a + t] = False
                yield f.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
