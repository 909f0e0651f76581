"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits are linked at RADIUS or fewer differing bits. Bit i has the (RADIUS + 1)-bit vector
1 + i mod (2^(RADIUS+1) - 1); table v keeps the bits whose vector has odd parity with v. The vectors of RADIUS bits span
less than the whole space, so some v is orthogonal to all of them, and its table keeps none of the bits in which a pair
differs: every pair within the radius shares a key in some table, with no chance involved.

Equal fingerprints are one node, so copies cost nothing beyond their fingerprint. Nodes that share a key are compared
in a stream sorted by key; what leaves is a spanning forest, never all pairs. Keys are counted with partial sums first: one shared
by more than RUN nodes is dealt out by pairs of blocks, so no task holds it whole. Components come from alternating stars over tables on the shared
folder; nothing is collected.

Defined results: a text without words has fingerprint zero; a null id is fingerprinted, but takes no part in linking and has
component null; rows with one id are one node; repeated rows get the same row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import scratch, settle

SHINGLE, RADIUS, SEED = 4, 4, 42
RUN = 2048  # nodes of one key that are compared in the stream; more are dealt out in blocks
BLOCK = 8192
PAIRS = 1 << 20  # pairs held at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of lower-cased (A-Z) words, repeats included, as an unsigned number."""
    from xxhash import xxh64_intdigest

    found = ("" if text is None else text).encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    k = min(shingle, len(found))
    starts = [0, *ends[: len(found) - k].tolist()]
    hashes = np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """k (the key), fp (signed long)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            fps = np.array([fingerprint(t, shingle) for t in f.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([f.column(0), pa.array(fps)], ["k", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("x")).mapInArrow(run, f"k {kind}, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed numbers of 64 bits."""
    n = (1 << (radius + 1)) - 1
    vectors = [1 + i % n for i in range(64)]
    found = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges a-b to stars: each node that isn't the smallest of its component, with the smallest."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (jump := new[new]).tolist() != new.tolist() if len(new) < 64 else not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _near_runs(bk: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over all pairs with one bk (sorted) within the radius."""
    ends = np.searchsorted(bk, bk, side="right")
    left = ends - np.arange(len(bk)) - 1  # later rows in the same run
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    held, d, live = 0, 1, np.flatnonzero(left >= 1)
    while len(live):
        near = live[np.bitwise_count(fp[live] ^ fp[live + d]) <= radius]
        out_a.append(rep[near])
        out_b.append(rep[near + d])
        held += len(near)
        if held > PAIRS:
            x, y = forest(np.concatenate(out_a), np.concatenate(out_b))
            out_a, out_b, held = [x], [y], len(x)
        d += 1
        live = live[left[live] >= d]
    return forest(np.concatenate(out_a), np.concatenate(out_b))


def _stream(radius: int):
    """Sorted (bk, fp, rep) rows to forest edges (a, b)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def edges(f: pd.DataFrame) -> pd.DataFrame:
            a, b = _near_runs(f["bk"].to_numpy(), f["fp"].to_numpy().view(np.uint64), f["rep"].to_numpy(), radius)
            return pd.DataFrame({"a": a, "b": b})

        for f in frames:
            held.append(f)
            size += len(f)
            if size >= 1 << 17:
                whole = pd.concat(held, ignore_index=True)
                open_run = (whole["bk"] == whole["bk"].iloc[-1]).to_numpy()
                yield edges(whole[~open_run])
                held, size = [whole[open_run]], int(open_run.sum())
        if held:
            yield edges(pd.concat(held, ignore_index=True))

    return run


def _block_edges(radius: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        fp, rep = f["fp"].to_numpy().view(np.uint64), f["rep"].to_numpy()
        out_a, out_b, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for i in range(len(fp) - 1):
            near = i + 1 + np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius)
            out_a.append(np.full(len(near), rep[i]))
            out_b.append(rep[near])
            held += len(near)
            if held > PAIRS:
                x, y = forest(np.concatenate(out_a), np.concatenate(out_b))
                out_a, out_b, held = [x], [y], len(x)
        a, b = forest(np.concatenate(out_a), np.concatenate(out_b))
        return pd.DataFrame({"a": a, "b": b})

    return run


def links(nodes: DataFrame, radius: int = RADIUS, run_limit: int = RUN, block: int = BLOCK) -> DataFrame:
    """nodes: fp, rep (long). Edges (a, b) whose components are those of all pairs within the radius."""
    tables = F.array(*(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks(radius))))
    keyed = nodes.select("fp", "rep", F.explode(tables).alias("bk"))
    # Counted with partial sums, so a crowded key is known before its rows move, and they never meet in one task.
    crowded = settle(keyed.groupBy("bk").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > run_limit), "simhash-crowded")
    none = crowded.isEmpty()
    rest = keyed if none else keyed.join(crowded, "bk", "left_anti")
    edges = rest.repartition("bk").sortWithinPartitions("bk").select("bk", "fp", "rep").mapInPandas(_stream(radius), "a long, b long")
    edges = settle(edges, "simhash-links")
    if none:
        return edges
    crowds = keyed.join(crowded, "bk")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = crowds.withColumn("i", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bk", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp", "rep")
    return edges.unionByName(dealt.groupBy("bk", "lo", "hi").applyInPandas(_block_edges(radius), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, root), root the smallest of the component, for every node that isn't a root.

    Large star (each larger neighbour points to the smallest one), then small star, until nothing changes.
    """

    def sides(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, low: DataFrame, large: bool) -> DataFrame:
        joined = e.join(low, "a")
        if large:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))

    with scratch(edges.sparkSession):
        edges = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
        seen = None
        while True:
            both = sides(edges)
            # The minima are written first: a join with the aggregate itself would share its exchange, and Spark could not split a hub.
            low = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-least")
            edges = settle(star(both, low, True).filter("a <> b").distinct(), "cc-large")
            low = settle(edges.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
            edges = settle(star(edges, low, False).filter("a <> b").distinct(), "cc-small")
            state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
            if state == seen:
                return settle(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "cc-roots", outer=True)
            seen = state


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """key, fingerprint (hex) and component_id (the smallest key reachable) for every row."""
    with scratch(df.sparkSession):
        fps = settle(fingerprints(df, key, text, shingle), "simhash-fingerprints", outer=True)
        nodes = settle(fps.filter("k is not null").groupBy("fp").agg(F.min("k").cast("long").alias("rep")), "simhash-nodes")
        # A key with several fingerprints is one node: it ties them, too.
        same = fps.filter("k is not null").join(nodes, "fp").filter("k <> rep").select(F.col("k").cast("long").alias("a"), F.col("rep").alias("b"))
        roots = components(links(nodes, radius).unionByName(same.join(nodes.select(F.col("rep").alias("a")).distinct(), "a", "left_semi")))
        of = nodes.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("c"))
        of = settle(of, "simhash-components", outer=True)
    out = fps.join(of, "fp", "left")
    return out.select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("k").isNotNull(), F.col("c")).alias("component_id"))
