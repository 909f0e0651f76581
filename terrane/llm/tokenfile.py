"""Token ids in a compressed binary file: an adaptive context-mixing range coder over independent, checksummed blocks.

Model. For each id three predictions are mixed: order 2 (the id that last followed the two ids before it), order 1 (the
id that last followed the id before it) and order 0 (adaptive counts of id classes). How much of the range order 2 and
order 1 get is learned: their hits are counted by how often each has been right of late, and those counts are the mixing
weights. What they leave goes to order 0: a class by its count, then the id inside the class.
Coder. A range coder of 48 bits with 16-bit output words drives all choices; carries are settled when a block ends.
Blocks. BLOCK ids at most; each starts from an empty model and has its own length and CRC-32, so it can be read alone.
All blocks at hand are coded side by side, one id of each block at a time, in numpy.

File. Rows of a Parquet dataset on the shared folder: (part, seg, n_ids, doc_ids, doc_lens, body). A segment holds whole
documents, SEGMENT ids or the last one's end; its body is MAGIC, the number of blocks, and for each block its number of
ids, number of words, CRC-32 of the ids and the words, all little-endian 32-bit numbers (words: 16-bit). Parts follow
the order of doc_id, so a document's place is the sum of the parts and segments before it.

Defined results: a null text is empty and has the end id alone; rows with one id stand side by side, each encoded; null ids
come first; an empty table gives an empty dataset and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.llm.common import stage_dir

BLOCK, SEGMENT, TOGETHER = 2048, 1 << 16, 1 << 22  # ids
ENCODED = 1 << 23  # characters encoded at a time
MAGIC = b"TOK1"
_TABLE_BITS = 10  # the tables of all lanes together must stay near the cache
_CONF = 8  # steps of confidence of a prediction
_SCALE = np.uint64(16)
_ID = np.uint32(0xFFFF)
_LOW32, _MASK48 = np.uint64(1 << 32), np.uint64((1 << 48) - 1)


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First id and width of each order-0 class, and the class of each id: widths double as ids grow rarer."""
    edges = [*range(0, 256, 16), *range(256, 1024, 48), *range(1024, 4096, 192), *range(4096, 1 << 16, 3840), 1 << 16]
    first, width = np.array(edges[:-1]), np.diff(edges)
    return first, width, np.repeat(np.arange(len(first)), width)


_FIRST, _WIDTH, _CLASS_OF = _classes()
_CLASSES, _GROUP = len(_FIRST), 8


def _running(x: np.ndarray) -> np.ndarray:
    """Running sums over the rows: a sum of rows at a time is much faster than cumsum along the first axis."""
    out = x.copy()
    for i in range(1, len(out)):
        out[i] += out[i - 1]
    return out


def _upto(sums: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many of each lane's running sums are v at most."""
    out = np.zeros(len(v), np.uint8)
    for row in sums:
        out += row <= v
    return out.astype(np.int64)


class _Model:
    """The adaptive state of several blocks, one lane each; lanes are the last, contiguous axis, and stop from the right."""

    def __init__(self, lanes: int):
        self.lanes, self.size = lanes, 1 << _TABLE_BITS
        self.guess1, self.guess2 = np.zeros(lanes * self.size, np.uint32), np.zeros(lanes * self.size, np.uint32)  # confidence << 16 | id
        # The mixing weights by the two confidences. A start: the more often a prediction was right, the more of the range it gets.
        c2, c1 = np.repeat(np.arange(_CONF), _CONF), np.tile(np.arange(_CONF), _CONF)
        start = np.stack([1 + 12 * c2, 1 + 6 * c1, np.full(_CONF * _CONF, 24)])
        self.hits = np.repeat(start.reshape(-1, 1), lanes, axis=1).astype(np.uint64)
        self.flat_hits = self.hits.reshape(-1)
        # Counts of the classes, and of groups of _GROUP classes.
        self.counts = np.full(_CLASSES * lanes, 2, np.uint64)
        self.groups = np.full((_CLASSES // _GROUP, lanes), 2 * _GROUP, np.uint64)
        self.flat_groups = self.groups.reshape(-1)
        self.member = (np.arange(_GROUP) * lanes)[:, None]
        self.step = _CONF * _CONF * lanes
        self.live(lanes)
        self.p1, self.p2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def live(self, n: int) -> None:
        """Only the first n lanes go on."""
        self.n, self.lane = n, np.arange(n)
        self.table = self.lane * self.size
        if hasattr(self, "p1"):
            self.p1, self.p2 = self.p1[:n], self.p2[:n]

    def look(self) -> None:
        """The two guesses, and the weights of order 2, order 1 and order 0 (what they leave)."""
        h = self.p1 * np.uint32(40503)
        self.x1 = ((h >> np.uint32(4)) & np.uint32(self.size - 1)) + self.table
        self.x2 = (((h ^ self.p2 * np.uint32(30011)) >> np.uint32(3)) & np.uint32(self.size - 1)) + self.table
        self.k1, self.k2 = self.guess1.take(self.x1), self.guess2.take(self.x2)
        self.g1, self.g2 = self.k1 & _ID, self.k2 & _ID
        self.mixer = ((self.k2 >> np.uint32(16)) * np.uint32(_CONF) + (self.k1 >> np.uint32(16))) * np.int64(self.lanes) + self.lane
        self.w0, self.w1, self.w2 = self.flat_hits.take(self.mixer), self.flat_hits.take(self.mixer + self.step), self.flat_hits.take(self.mixer + 2 * self.step)
        self.w01 = self.w0 + self.w1
        self.total = self.w01 + self.w2

    def choice(self, hit2: np.ndarray, hit1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands before the prediction that is right, and its own weight; hit1 counts where hit2 doesn't hold."""
        self.own = np.where(hit2, self.w0, np.where(hit1, self.w1, self.w2))
        return np.where(hit2, np.uint64(0), np.where(hit1, self.w0, self.w01)), self.own

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        self.flat_hits[self.mixer + np.where(hit2, 0, np.where(hit1, self.step, 2 * self.step))] = self.own + np.uint64(24)
        # Right: a step of confidence more. Wrong: half of it; a guess of confidence 1 or less gives way.
        sure = ids | np.uint32((_CONF - 1) << 16)
        for table, at, k, guess in ((self.guess1, self.x1, self.k1, self.g1), (self.guess2, self.x2, self.k2, self.g2)):
            wrong = np.where(k >= np.uint32(2 << 16), ((k >> np.uint32(1)) & ~_ID) | guess, ids)
            table[at] = np.where(guess == ids, np.minimum(k + np.uint32(1 << 16), sure), wrong)
        self.p2, self.p1 = self.p1, ids

    def group_sums(self) -> np.ndarray:
        """Running sums of the groups' counts."""
        return _running(self.groups[:, : self.n])

    def inside(self, rows: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Counts of the classes in the group of each lane."""
        return self.counts.take(self.member + (group * _GROUP * self.lanes + rows))

    def learn_class(self, rows: np.ndarray, cls: np.ndarray, own: np.ndarray) -> None:
        self.counts[cls * self.lanes + rows] = own + np.uint64(8)
        self.flat_groups[cls // _GROUP * self.lanes + rows] += np.uint64(8)


class _Writer:
    """Range encoders, one per lane."""

    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, _MASK48, np.uint64)
        self.words = np.zeros((room + 1, lanes), np.uint32)  # lanes contiguous, as they are written at like places; word 0 takes no carry
        self.n = np.ones(lanes, np.int64)

    def put(self, rows, *choices: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """rows: lanes, as a slice or as numbers; choices, one after the other: before, own and total, all uint64."""
        low, rng = self.low[rows], self.range[rows]
        for before, own, total in choices:
            step = rng // total
            low, rng = low + step * before, step * own
            carry = np.flatnonzero(low > _MASK48)
            if len(carry):
                c = carry if isinstance(rows, slice) else rows[carry]
                self.words[self.n[c] - 1, c] += 1
                low &= _MASK48
            at = np.flatnonzero(rng < _LOW32)
            if len(at):
                c = at if isinstance(rows, slice) else rows[at]
                n, some = self.n[c], low[at]
                self.words[n, c] = some >> np.uint64(32)
                self.n[c] = n + 1
                low[at] = (some << _SCALE) & _MASK48
                rng[at] <<= _SCALE
        self.low[rows], self.range[rows] = low, rng

    def close(self, lanes: int) -> list[np.ndarray]:
        """Words of all lanes; the last three hold the rest of low."""
        r = np.arange(lanes)
        for k in (32, 16, 0):
            self.words[self.n, r] = (self.low >> np.uint64(k)).astype(np.uint32) & np.uint32(0xFFFF)
            self.n += 1
        while (up := self.words >> 16).any():
            self.words &= 0xFFFF
            self.words[:-1] += up[1:]
        words = np.ascontiguousarray(self.words[: self.n.max()].T, "<u2")
        return [words[i, 1 : self.n[i]] for i in range(lanes)]


class _Reader:
    """Range decoders, one per lane."""

    def __init__(self, words: list[np.ndarray]):
        room = max(map(len, words)) + 4
        rows = np.zeros((len(words), room), np.uint16)
        for i, w in enumerate(words):
            rows[i, : len(w)] = w
        self.words = np.ascontiguousarray(rows.T)  # lanes contiguous, as they are read at like places
        first = self.words[:3].astype(np.uint64)
        self.code = (first[0] << np.uint64(32)) | (first[1] << _SCALE) | first[2]
        self.range = np.full(len(words), _MASK48, np.uint64)
        self.n = np.full(len(words), 3, np.int64)

    def at(self, rows, total: np.ndarray) -> np.ndarray:
        self.step = self.range[rows] // total
        return np.minimum(self.code[rows] // self.step, total - np.uint64(1))

    def take(self, rows, before: np.ndarray, own: np.ndarray) -> None:
        code, rng = self.code[rows] - self.step * before, self.step * own
        at = np.flatnonzero(rng < _LOW32)
        if len(at):
            c = at if isinstance(rows, slice) else rows[at]
            code[at] = (code[at] << _SCALE) | self.words[self.n[c], c]
            self.n[c] += 1
            rng[at] <<= _SCALE
        self.code[rows], self.range[rows] = code, rng


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids, coded side by side; in the order given."""
    if not blocks:
        return []
    order = np.argsort([-len(b) for b in blocks], kind="stable")
    sizes = np.array([len(blocks[i]) for i in order])
    ids = np.zeros((sizes[0], len(blocks)), np.uint32)
    for r, i in enumerate(order):
        ids[: len(blocks[i]), r] = blocks[i]
    out, m = _Writer(len(blocks), 3 * int(sizes[0]) + 8), _Model(len(blocks))
    n, one = len(blocks), np.uint64(1)
    for t in range(int(sizes[0])):
        if sizes[n - 1] <= t:
            n = int(np.searchsorted(-sizes, -t, side="left"))
            m.live(n)
        x = ids[t, :n]
        m.look()
        hit2, hit1 = x == m.g2, x == m.g1
        out.put(slice(0, n), (*m.choice(hit2, hit1), m.total))
        rest = np.flatnonzero(~(hit2 | hit1))
        if len(rest):
            y = x[rest]
            cls = _CLASS_OF[y]
            group, at = cls // _GROUP, np.arange(len(rest))
            sums, upto = m.group_sums(), _running(m.inside(rest, group))
            own = m.counts.take(cls * m.lanes + rest)
            before = sums[group, rest] - upto[-1] + upto[cls % _GROUP, at] - own
            out.put(rest, (before, own, sums[-1].take(rest)), ((y - _FIRST[cls]).astype(np.uint64), one, _WIDTH[cls].astype(np.uint64)))
            m.learn_class(rest, cls, own)
        m.learn(x, hit2, hit1)
    words = out.close(len(blocks))
    coded: list[bytes] = [b""] * len(blocks)
    for r, i in enumerate(order):
        raw = np.ascontiguousarray(blocks[i], "<u4").tobytes()
        coded[i] = struct.pack("<III", len(blocks[i]), len(words[r]), zlib.crc32(raw)) + words[r].tobytes()
    return coded


def decode_blocks(coded: list[tuple[int, int, np.ndarray]]) -> list[np.ndarray]:
    """(number of ids, CRC-32, words) to ids; raises ValueError on a block whose checksum doesn't hold."""
    if not coded:
        return []
    order = np.argsort([-c[0] for c in coded], kind="stable")
    sizes = np.array([coded[i][0] for i in order])
    ids = np.zeros((sizes[0], len(coded)), np.uint32)
    inp, m = _Reader([coded[i][2] for i in order]), _Model(len(coded))
    n = len(coded)
    for t in range(int(sizes[0])):
        if sizes[n - 1] <= t:
            n = int(np.searchsorted(-sizes, -t, side="left"))
            m.live(n)
        m.look()
        v = inp.at(slice(0, n), m.total)
        hit2, hit1 = v < m.w0, v < m.w01
        inp.take(slice(0, n), *m.choice(hit2, hit1))
        x = np.where(hit2, m.g2, m.g1)
        rest = np.flatnonzero(~hit1)
        if len(rest):
            sums, at = m.group_sums().take(rest, axis=1), np.arange(len(rest))
            v = inp.at(rest, sums[-1])
            group = _upto(sums, v)
            inside = m.inside(rest, group)
            upto = _running(inside)
            skip = sums[group, at] - upto[-1]
            part = _upto(upto, v - skip)
            cls, own = group * _GROUP + part, inside[part, at]
            inp.take(rest, skip + upto[part, at] - own, own)
            width = _WIDTH[cls].astype(np.uint64)
            tail = inp.at(rest, width)
            inp.take(rest, tail, np.uint64(1))
            x[rest] = _FIRST[cls] + tail.view(np.int64)
            m.learn_class(rest, cls, own)
        ids[t, :n] = x
        m.learn(x, hit2, hit1)
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(coded)
    for r, i in enumerate(order):
        out[i] = ids[: coded[i][0], r].astype("<u4")
        if zlib.crc32(out[i].tobytes()) != coded[i][1]:
            raise ValueError("a block's checksum doesn't hold")
    return out


def pack(segments: list[np.ndarray], block: int = BLOCK) -> list[bytes]:
    """A body for each segment's ids; the blocks of all segments are coded together."""
    blocks = [s[i : i + block] for s in segments for i in range(0, len(s), block)]
    coded = iter(encode_blocks(blocks))
    out = []
    for s in segments:
        n = -(-len(s) // block)
        out.append(MAGIC + struct.pack("<I", n) + b"".join(next(coded) for _ in range(n)))
    return out


def unpack(bodies: list[bytes]) -> list[np.ndarray]:
    """The ids of each body."""
    blocks, counts = [], []
    for body in bodies:
        if body[:4] != MAGIC:
            raise ValueError("not a token segment")
        n, at = struct.unpack_from("<I", body, 4)[0], 8
        counts.append(n)
        for _ in range(n):
            size, words, crc = struct.unpack_from("<III", body, at)
            blocks.append((size, crc, np.frombuffer(body, "<u2", words, at + 12)))
            at += 12 + 2 * words
    ids, k, out = decode_blocks(blocks), 0, []
    for n in counts:
        out.append(np.concatenate(ids[k : k + n]) if n else np.empty(0, np.uint32))
        k += n
    return out


_FILE = "part int, seg int, n_ids long, doc_ids array<long>, doc_lens array<long>, body binary"


def write(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 0) -> None:
    """Encode every text, append end_id to each, and write the file in ascending order of key."""
    from terrane.llm.tokencount import batches, encoder

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seg = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        docs: list[tuple[int | None, np.ndarray]] = []
        held, open_ids = [], 0  # held: finished segments

        def flush() -> pa.RecordBatch:
            nonlocal held, seg
            bodies = pack([np.concatenate([x for _, x in s]) for s in held])
            n = len(held)
            columns = [[part] * n, range(seg, seg + n), [sum(len(x) for _, x in s) for s in held], [[k for k, _ in s] for s in held], [[len(x) for _, x in s] for s in held], bodies]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            seg += n
            held = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "seg", "n_ids", "doc_ids", "doc_lens", "body"])

        ready = 0
        for f in frames:
            keys, texts = f.column(0).to_pylist(), [t or "" for t in f.column(1).to_pylist()]
            for a, b in batches(texts, ENCODED):
                for k, ids in zip(keys[a:b], encode.many(texts[a:b])):
                    docs.append((k, np.concatenate([ids, end])))
                    open_ids += len(docs[-1][1])
                    if open_ids >= SEGMENT:
                        held.append(docs)
                        ready, docs, open_ids = ready + open_ids, [], 0
                    if ready >= TOGETHER:
                        yield flush()
                        ready = 0
        if docs:
            held.append(docs)
        if held:
            yield flush()

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("x"))
    # Rows with one key are dealt by their text, so a key held by many rows isn't one task.
    dealt = rows.withColumn("h", F.xxhash64("x")).repartitionByRange("k", "h").sortWithinPartitions("k", "h", "x").select("k", "x")
    dealt.mapInArrow(run, _FILE).write.parquet(path)


def read(spark, path: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of each document, and part and seg of its place, from the file's bytes."""
    rows = spark.read.schema(_FILE).parquet(path)
    # A row for each part: as many as the writing tasks, whatever the number of documents.
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before_part"))
    segs = rows.select("part", "seg", "n_ids").withColumn("before", F.sum("n_ids").over(W.partitionBy("part").orderBy("seg")) - F.col("n_ids"))
    places = segs.join(parts, "part").select("part", "seg", (F.col("before") + F.col("before_part")).alias("base"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digest(held: list) -> pa.RecordBatch:
            out = []
            for (part, seg, n, doc_ids, doc_lens, _), ids in zip(held, unpack([r[5] for r in held])):
                raw, at = memoryview(np.ascontiguousarray(ids, "<u4").tobytes()), 0
                for k, size in zip(doc_ids, doc_lens):
                    out.append((part, seg, k, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
                    at += size
                if at != len(ids) or at != n:
                    raise ValueError("a segment's documents and ids don't agree")
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["part", "seg", "k", "at", "n_tokens", "ids_crc32"])

        held, size = [], 0
        for f in frames:
            for r in zip(*(c.to_pylist() for c in f.columns)):
                held.append(r)
                size += r[2]
                if size >= TOGETHER:
                    yield digest(held)
                    held, size = [], 0
        if held:
            yield digest(held)

    docs = rows.mapInArrow(run, "part int, seg int, k long, at long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["part", "seg"]).select(F.col("k").alias(key), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "seg")


def written(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Write df's ids to a new file on the shared folder and read the file back."""
    path = stage_dir(df.sparkSession, "token-file")
    write(df, path, key, text, vocabulary)
    return read(df.sparkSession, path, key)
