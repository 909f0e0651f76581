"""Near copies by an exact join on Jaccard similarity, beside the SimHash classes.

Two texts are linked if their sets of SHINGLE-word shingles (words lower-cased A-Z; all words of a shorter text are one shingle)
have a Jaccard similarity of 0.8 at least, or if their fingerprints are (see simhash). Each text gives its smallest shingle
hashes, so many that a fifth of its shingles cannot hold them all: any pair of that similarity shares one. Shingles that are
frequent in a sample come last in that order, whatever the sample: order decides only how many texts meet. Who meets in a key is
first compared with the key's first document, then with its last; then whoever is in another component still. A pair is sifted before
any text moves: a bit for each bucket of shingle hashes says whether an odd number falls in it, and two sets differ in at least as
many shingles as bits. With twice as many buckets as shingles few pairs below the similarity pass; those that do are verified on
whole sets.

Texts, not keys, are the nodes: equal texts are one node (told apart by 64-bit hashes, and of the HEAVY texts with most copies only
one copy is read), and texts that share a key are compared like others.

Defined results: of a component the row with the smallest key, then the smallest hash of the text, stays; a null key takes no part
and stays; of rows with equal key and text the one with the smallest hash over all columns that have one stays; different texts
of one key stay if nothing is similar to them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.llm import simhash
from terrane.llm.common import forget, scratch, settle
from terrane.llm.wordhash import Batch, batches, mix, space_map

SHINGLE = 5
MOST_BITS, RUN, BLOCK = 1 << 15, 256, 1024
HEAVY = 1 << 17  # texts with most copies, sent to all machines
SAMPLE, OFTEN, FREQUENT = 5000, 3, 1 << 16  # documents looked at for frequent shingles; times seen; how many of them at most

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles (63 bits), ascending and distinct; none for a text without words."""
    table = space_map()
    for a, b in batches(texts):
        batch = Batch(texts[a:b], table)
        w = batch.hashes
        with np.errstate(over="ignore"):
            h = np.zeros(max(len(w) - SHINGLE + 1, 0), np.uint64)
            for j in range(SHINGLE):
                h = mix(h * _PRIME + w[j : j + len(h)])
            for i, j in zip(batch.first[:-1].tolist(), batch.first[1:].tolist()):
                if 0 < j - i < SHINGLE:
                    one = np.uint64(j - i)
                    for x in w[i:j]:
                        one = mix(one * _PRIME + x)
                    yield np.array([one >> np.uint64(1)], np.uint64)
                else:
                    yield np.unique(h[i : max(i, j - SHINGLE + 1)] >> np.uint64(1))


def prefix(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of a set, first ones first, of which any set of similarity 0.8 or more holds one."""
    n = len(hashes)
    late = np.isin(hashes, frequent, assume_unique=True) if len(frequent) else np.zeros(n, bool)
    return np.concatenate([hashes[~late], hashes[late]])[: n - (4 * n + 4) // 5 + 1]


def _shingles(docs: DataFrame, frequent: np.ndarray | None) -> DataFrame:
    """docs: k, x. key, k, n (shingles of the text): prefixes, or all shingles if frequent is None."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, held, size = f["k"].to_numpy(), [], 0
            for k, s in zip(ids, shingle_sets(f["x"].tolist())):
                p = s if frequent is None else prefix(s, frequent)
                held.append((k, len(s), p))
                size += len(p)
                if size > 1 << 18:
                    yield frame(held)
                    held, size = [], 0
            if held:
                yield frame(held)

    def frame(held: list) -> pd.DataFrame:
        many = [len(p) for _, _, p in held]
        ks, ns = np.array([k for k, _, _ in held], np.int64), np.array([n for _, n, _ in held], np.int32)
        return pd.DataFrame({"key": np.concatenate([p for _, _, p in held]).view(np.int64), "k": np.repeat(ks, many), "n": np.repeat(ns, many)})

    return docs.mapInPandas(run, "key long, k long, n int")


def sketch(hashes: np.ndarray) -> bytes:
    """A bit for each of 2^b buckets, 64 and twice the number of hashes at least, MOST_BITS at most: whether its number of hashes is odd."""
    bits = min(max(64, 1 << int(2 * len(hashes)).bit_length()), MOST_BITS)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sketches(docs: DataFrame) -> DataFrame:
    """k, s (sketch)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"k": f["k"], "s": pd.Series([sketch(h) for h in shingle_sets(f["x"].tolist())], dtype=object)})

    return docs.mapInPandas(run, "k long, s binary")


class _Sieve:
    """Sketches of several texts; a longer one is folded to the length of the other."""

    def __init__(self, sketches: list[bytes]):
        self.size = np.fromiter(map(len, sketches), np.int64, len(sketches))
        self.at, self.rows = {}, {}
        for n in np.unique(self.size).tolist():
            own, twice = np.flatnonzero(self.size == n), np.flatnonzero(self.size == 2 * n)
            at = np.full(len(sketches), -1)
            at[own], at[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            rows = np.frombuffer(b"".join(sketches[i] for i in own), np.uint64).reshape(len(own), -1)
            if len(twice):
                wide = np.frombuffer(b"".join(sketches[i] for i in twice), np.uint64).reshape(len(twice), -1)
                rows = np.concatenate([rows, wide[:, : n // 8] ^ wide[:, n // 8 :]])
            self.at[n], self.rows[n] = at, rows

    def may(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the pairs (x, y), with n shingles together, can be similar: their difference is a ninth of n at most."""
        out = np.zeros(len(x), bool)
        least = np.minimum(self.size[x], self.size[y])
        for size in np.unique(least).tolist():
            mine = np.flatnonzero(least == size)
            at, rows = self.at[size], self.rows[size]
            for i in range(0, len(mine), step := max(1, (1 << 24) // size)):
                part = mine[i : i + step]
                u, v = at[x[part]], at[y[part]]
                out[part] = (u < 0) | (v < 0) | (9 * np.bitwise_count(rows[u] ^ rows[v]).sum(axis=1, dtype=np.int64) <= n[part])
        return out


def _sifted(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """pairs: a, b, ca, cb, nn (shingles of both), without those whose sketches differ too much."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = np.arange(len(f))
            yield f[_Sieve([*map(bytes, f["x"]), *map(bytes, f["y"])]).may(m, m + len(f), f["nn"].to_numpy())][["a", "b", "ca", "cb"]]

    pairs = settle(pairs.distinct(), "near-pairs")
    x, y = sketches.select(F.col("k").alias("a"), F.col("s").alias("x")), sketches.select(F.col("k").alias("b"), F.col("s").alias("y"))
    out = settle(pairs.join(x, "a").join(y, "b").mapInPandas(run, "a long, b long, ca long, cb long"), "near-sifted")
    forget(pairs)
    return out


def _similar(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs: a, b (nodes), ca, cb (their components), settled and used up. (a, b): components of the pairs whose similarity is 0.8 at least."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = []
            for p, q in zip(shingle_sets(f["x"].tolist()), shingle_sets(f["y"].tolist())):
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both > 0 and 5 * both >= 4 * (len(p) + len(q) - both))
            yield pd.DataFrame({"a": f["ca"][ok], "b": f["cb"][ok]})

    wanted = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    texts = settle(docs.join(wanted, "k", "left_semi").dropDuplicates(["k"]), "near-texts")
    rows = pairs.join(texts.withColumnsRenamed({"k": "a"}), "a").join(texts.withColumnsRenamed({"k": "b", "x": "y"}), "b")
    out = settle(rows.select("ca", "cb", "x", "y").mapInPandas(run, "a long, b long").distinct(), "near-links")
    forget(pairs, texts)
    return out


def _relabelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    roots = simhash.components(edges)
    return rows.join(roots, rows["c"] == roots["node"], "left").withColumn("c", F.coalesce("root", "c")).drop("node", "root")


def _run_pairs(f: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b, ca, cb) among rows (key sorted, k, n, c, s) of whole keys that are in different components and pass the sieve."""
    key, k, n, c = (f[x].to_numpy() for x in ("key", "k", "n", "c"))
    sieve = _Sieve(list(map(bytes, f["s"])))
    last, place, out = np.searchsorted(key, key, side="right"), np.arange(len(key)), []
    d, live = 1, np.flatnonzero(last - place > 1)
    while len(live):
        x, y = live, live + d
        ok = (c[x] != c[y]) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        good = sieve.may(x, y, n[x] + n[y])
        out.append(np.stack([x[good], y[good]]))
        d += 1
        live = live[last[live] - live > d]
    x, y = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
    swap = k[x] > k[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    return pd.DataFrame({"a": k[x], "b": k[y], "ca": c[x], "cb": c[y]}).drop_duplicates()


def _stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for f in frames:
        held.append(f)
        size += len(f) + int(f["s"].str.len().sum()) // 512
        if size >= 1 << 14:
            whole = pd.concat(held, ignore_index=True)
            open_key = (whole["key"] == whole["key"].iloc[-1]).to_numpy()
            yield _run_pairs(whole[~open_key])
            held, size = [whole[open_key]], int(open_key.sum())
            held[0] = held[0].copy()  # a view would keep the whole
    if held:
        yield _run_pairs(pd.concat(held, ignore_index=True))


def _all_pairs(rest: DataFrame, run_limit: int, block: int) -> DataFrame:
    """rest: key, k, n, c, s, m (rows of the key). Pairs that pass the sieve; crowded keys are dealt out in pairs of blocks."""
    names = ["key", "k", "n", "c", "s"]
    pairs = rest.filter(F.col("m") <= run_limit).select(names).repartition("key").sortWithinPartitions("key").mapInPandas(_stream, "a long, b long, ca long, cb long")
    crowd = rest.filter(F.col("m") > run_limit)
    if not crowd.isEmpty():
        blocks = F.ceil(F.col("m") / block).cast("int")
        dealt = crowd.withColumn("i", F.pmod(F.xxhash64("k"), blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.select(*names, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
        pairs = pairs.unionByName(dealt.groupBy("key", "lo", "hi").applyInPandas(lambda f: _run_pairs(f[names]), "a long, b long, ca long, cb long"))
    every = settle(pairs, "near-all")
    out = settle(every.distinct(), "near-rest")
    forget(every)
    return out


def classes(docs: DataFrame, run_limit: int = RUN, block: int = BLOCK) -> DataFrame:
    """docs: k (the text's hash), x; copies allowed. k, c (the smallest hash reachable) of every text."""
    found = settle(simhash.classes(docs, "k", "x").select("k", F.col("component_id").alias("c")).distinct(), "near-simhash")
    every = max(found.count() // SAMPLE, 1)
    sample = docs.filter(F.pmod("k", F.lit(every)) == 0)
    often = _shingles(sample, None).distinct().groupBy("key").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "key").limit(FREQUENT)
    frequent = np.sort(np.array([r["key"] for r in often.collect()], np.int64).view(np.uint64))
    by = W.partitionBy("key")
    met = _shingles(docs, frequent).withColumn("lo", F.min("k").over(by)).withColumn("hi", F.max("k").over(by)).filter("lo <> hi")
    met = settle(met.select("key", "k", "n").distinct(), "near-met")

    def open_keys(rows: DataFrame) -> DataFrame:
        """rows: key, k, n, c, of the keys with several components, with m (rows of the key) and its first and last row."""
        row = F.struct("k", "n", "c")
        kept = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m"), F.min(row).alias("first"), F.max(row).alias("last"))
        kept = settle(kept.filter("lo <> hi").drop("lo", "hi"), "near-open-keys")
        out = settle(rows.join(kept, "key"), "near-open")
        forget(kept)
        return out

    placed = settle(met.join(found, "k"), "near-met-in")
    forget(met)
    met = open_keys(placed)
    forget(placed)
    if met.isEmpty():
        return found
    sketches = settle(_sketches(docs.join(met.select("k").distinct(), "k", "left_semi")).dropDuplicates(["k"]), "near-sketches")

    def with_end(end: str) -> DataFrame:
        """Pairs of the open keys' rows with the first or last one."""
        pairs = met.filter(f"c <> {end}.c and 5 * least(n, {end}.n) >= 4 * greatest(n, {end}.n)")
        less, more = F.least("k", f"{end}.k"), F.greatest("k", f"{end}.k")
        return pairs.select(less.alias("a"), more.alias("b"), F.least("c", f"{end}.c").alias("ca"), F.greatest("c", f"{end}.c").alias("cb"), (F.col("n") + F.col(f"{end}.n")).alias("nn"))

    edges = _similar(_sifted(with_end("first"), sketches), docs)
    before, met = met, open_keys(_relabelled(met.select("key", "k", "n", "c"), edges))
    forget(before)
    edges = edges.unionByName(_similar(_sifted(with_end("last"), sketches), docs))
    rest = open_keys(_relabelled(met.select("key", "k", "n", "c"), edges))
    forget(met)
    if not rest.isEmpty():
        edges = edges.unionByName(_similar(_all_pairs(rest.drop("first", "last").join(sketches, "k"), run_limit, block), docs))
    return _relabelled(found, edges)


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each component, as defined above, and the rows with a null key."""
    names = df.columns
    h, id_ = F.xxhash64(F.col(text)), F.col(key)
    with scratch(df.sparkSession):
        rows = settle(df.filter(id_.isNotNull()).select(id_.alias("i"), h.alias("k")), "near-rows")
        copies = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("p")).filter("n > 1").orderBy(F.desc("n"), "k").limit(HEAVY)
        docs = df.filter(id_.isNotNull()).select(id_.alias("i"), h.alias("k"), F.col(text).alias("x")).join(F.broadcast(copies.select("k", "p")), "k", "left")
        found = settle(classes(docs.filter("p is null or i = p").select("k", "x")), "near-classes")
        placed = settle(rows.join(found, "k").select("i", "k", "c"), "near-placed")
        first = settle(placed.groupBy("c").agg(F.min(F.struct("i", "k")).alias("p")), "near-firsts")
        gone = placed.join(first, "c").filter("p.i <> i or p.k <> k").select(F.col("i").alias("_i"), F.col("k").alias("_k")).distinct()
        gone = settle(gone, "near-gone", outer=True)
        repeated = settle(rows.groupBy("i", "k").count().filter("count > 1").select(F.col("i").alias("_i"), F.col("k").alias("_k")), "near-repeated", outer=True)
    out = df.join(gone, (id_ == gone["_i"]) & (h == gone["_k"]), "left_anti")
    if repeated.isEmpty():
        return out
    again = (id_ == repeated["_i"]) & (h == repeated["_k"])
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(names)))
    some = out.join(repeated, again, "left_semi").groupBy(id_.alias("_i"), h.alias("_k")).agg(F.min_by(whole, F.xxhash64(*plain)).alias("_row"))
    return out.join(repeated, again, "left_anti").unionByName(some.select(*(F.col(f"_row.c{n}").alias(c) for n, c in enumerate(names))))
