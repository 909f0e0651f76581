"""Every operator's query on odd and on empty tables, held against plain Python."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import queries
from terrane.llm.tokencount import tokenizer

NAMES = sorted(queries.QUERIES)


def docs(spark, where):
    return [tuple(r) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith(("op2", "op4"))])
def test_one_row_for_each_document(spark, odd_dir, wide_dir, name):
    for where in (odd_dir, wide_dir):
        got = Counter(r["doc_id"] for r in queries.QUERIES[name](spark, where).select("doc_id").collect())
        assert got == Counter(d[0] for d in docs(spark, where))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, odd_dir, wide_dir, name):
    import duckdb

    for where in (odd_dir, wide_dir):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS FROM read_parquet('{where}/documents.parquet/*.parquet')")
        want = con.sql(queries.ORACLES[name])
        names = sorted(want.columns)
        got = Counter(tuple(r[c] for c in names) for r in queries.QUERIES[name](spark, where).collect())
        assert got == Counter(tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall())


def test_op1(spark, odd_dir):
    out = queries.op1_sharding(spark, odd_dir).collect()
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    body = lambda t: (t or "").encode()
    want = Counter((d[0], len(body(d[1])) + 16, zlib.crc32(body(d[1]))) for d in docs(spark, odd_dir))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    by = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        by.setdefault(r["source"], []).append(r["rank"])
    n = len(out)
    for ranks in by.values():  # each source is spread evenly over the whole
        for k, rank in enumerate(ranks):
            assert abs((rank + 0.5) / n - (k + 0.5) / len(ranks)) < 0.12


def test_op1_ranks(spark, odd_dir, monkeypatch):
    """Against plain windows over each source and over all rows, however many buckets there are."""
    from pyspark.sql import Window as W

    from terrane.llm import sharding

    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    plain = docs.select("doc_id", "source", crc.alias("text_crc32"), F.xxhash64(F.lit(7), "doc_id", crc).alias("h"))
    by = W.partitionBy("source")
    unsigned = [F.col("h") < 0, "h", "doc_id", "text_crc32"]
    plain = plain.withColumn("f", (2 * F.row_number().over(by.orderBy(*unsigned)) - 1) / (2 * F.count("*").over(by)))
    tie = [F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "h", "doc_id", "text_crc32"]
    plain = plain.withColumn("rank", F.row_number().over(W.orderBy("f", *tie)) - 1)
    want = Counter((r["doc_id"], r["text_crc32"], r["rank"]) for r in plain.collect())
    for bits in (1, sharding.LEAST_BITS, 14):
        monkeypatch.setattr(sharding, "LEAST_BITS", bits)
        monkeypatch.setattr(sharding, "LEAST_SLICE_BITS", bits + 3)
        got = sharding.interleave(docs, 40).collect()
        assert Counter((r["doc_id"], r["text_crc32"], r["rank"]) for r in got) == want


def test_op2_ranges(spark, odd_dir, monkeypatch):
    """What is drawn doesn't depend on the number of ranges."""
    from terrane.llm import mixing

    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    drawn = []
    for bits in (2, 8, 14):
        monkeypatch.setattr(mixing, "LEAST_BITS", bits)
        drawn.append(Counter(tuple(r) for r in mixing.drawn(docs, corpus_pipeline.MIX).collect()))
    assert drawn[0] == drawn[1] == drawn[2] and drawn[0]


def test_op2_budgets(spark, odd_dir):
    out = queries.op2_mixing(spark, odd_dir).collect()
    count = Counter()
    for r in out:
        count[r["domain"], r["lang"], r["source"]] += r["tokens"]
        assert r["quota"] >= 0
    quota = {(r["domain"], r["lang"], r["source"]): r["quota"] for r in out}
    for leaf, n in count.items():
        assert n <= quota[leaf]
    twice = queries.op2_mixing(spark, odd_dir).collect()
    assert Counter(map(str, out)) == Counter(map(str, twice))


def test_op4(spark, odd_dir, tmp_path):
    assert queries.op4_decontamination(spark, odd_dir).count() == 0
    from terrane.llm import decontam

    items = spark.read.parquet(f"{odd_dir}/benchmark.parquet")
    texts = [(1, "before it, A leaked riddle of nine, rather rare silver words here. after"), (2, "a leaked riddle about nine rather rare golden words here"), (3, "nothing leaked here"), (None, "a leaked riddle of nine rather rare silver words here")]
    df = spark.createDataFrame(texts, "doc_id LONG, text STRING")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(df, items).collect()}
    assert got == {(1, 1), (2, 1), (None, 1)}
    span = decontam.leaks(df, items).filter("doc_id = 1").first()
    assert texts[0][1].encode()[span["start_byte"] : span["end_byte"]].decode() == "A leaked riddle of nine, rather rare silver words here"
    assert [r["doc_id"] for r in decontam.drop_leaked(df, items).collect()] == [3]
    many = decontam.leaks(df, items, shard_bytes=10)  # several indexes instead of one
    assert {(r["doc_id"], r["item_id"]) for r in many.collect()} == got


def test_op4_short_items(spark):
    """Items of three and four words are found word for word, shorter ones as whole texts."""
    from terrane.llm import decontam

    items = spark.createDataFrame([(1, "Four rare quirky zebras"), (2, "tiny answer"), (3, "one two three"), (4, "")], "item_id LONG, text STRING")
    texts = [(1, "we saw four rare, quirky zebras there"), (2, "four rare zebras there"), (3, "Tiny answer."), (4, "no tiny answer here"), (5, "and one two three four"), (6, "one two"), (7, "")]
    got = decontam.leaks(spark.createDataFrame(texts, "doc_id LONG, text STRING"), items).collect()
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in got} == {(1, 1, 1.0), (3, 2, 1.0), (5, 3, 1.0)}


def _smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def test_op4_recall(spark):
    """Against alignment of every item with every whole text: no clean text is named, and of edited copies nine tenths at least are found, in a corpus of common words, too."""
    import random

    from terrane.llm import decontam

    rng = random.Random(31)
    common = [f"c{i}" for i in range(40)]
    rare = [f"r{i}" for i in range(4000)]
    word = lambda: rng.choice(common) if rng.random() < 0.6 else rng.choice(rare)
    items = [[word() for _ in range(rng.randint(12, 40))] for _ in range(30)] + [[rng.choice(common) for _ in range(25)] for _ in range(5)]
    texts = []
    for k in range(160):
        body = [word() for _ in range(120)]
        if k % 2:
            copy = list(rng.choice(items))
            for p in range(rng.randrange(6), len(copy), 6):
                copy[p] = "edited"
            body[40:40] = copy
        texts.append(body)
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if _smith_waterman(x, t) >= 0.5 * 2 * len(x)}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id LONG, text STRING")
    found = decontam.leaks(df, spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id LONG, text STRING"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got <= want and len(want) >= 70 and len(got) >= 0.9 * len(want)


def test_op5_round_trip(spark, odd_dir):
    out = sorted(queries.op5_token_file(spark, odd_dir).collect(), key=lambda r: r["start"])
    tok, start, want = tokenizer(), 0, Counter()
    for d in docs(spark, odd_dir):
        ids = np.array([*tok.encode(d[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want[d[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    assert [r["doc_id"] for r in out] == sorted((r["doc_id"] for r in out), key=lambda k: (k is not None, k))
    for r in out:
        assert r["start"] == start
        start += r["n_tokens"]


def test_op6_sums(spark, odd_dir):
    out = queries.op6_lm_scoring(spark, odd_dir).collect()
    for r in out:
        assert r["n_known"] <= r["n_tokens"] and r["base_score"] <= 0 and np.isfinite(r["score"]) and r["score"] < 0
    empty = next(r for r in out if r["doc_id"] == 201)
    assert empty["n_tokens"] == 1 and empty["n_known"] == 1


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_op7_columns(spark, tmp_path):
    """Every column against all pairs of lines: the first line of each class, by id and place, stays; an edited line is found."""
    import random

    from terrane.llm.linededup import threshold

    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(80)]
    lines = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 6, 9, 14, 25) for _ in range(4)]
    for x in list(lines):
        y = list(x)
        for _ in range(max(1, len(x) // 25)):
            y[rng.randrange(len(y))] = "z"
        lines.append("".join(y))
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 5))) + "\n  \n") for i in range(30)]
    rows += [(40, "one line of it\n\none line of it\nand the end")] * 2 + [(41, None), (42, ""), (None, lines[-1] + "\nlast of all")]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    at = [(k is None, k or 0, n, x.strip()) for k, t in dict.fromkeys(rows) for n, x in enumerate((t or "").split("\n")) if x.strip()]
    at.sort()
    parent = list(range(len(at)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(at)):
        for j in range(i):
            a, b = at[i][3], at[j][3]
            if a == b or abs(len(a) - len(b)) <= (t := int(threshold(min(len(a), len(b))))) and _edits(a, b) <= t:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    gone = {(p[:2], p[2]) for i, p in enumerate(at) if find(i) != i}
    want = Counter()
    for k, t in rows:
        mine = [p for p in at if p[:2] == (k is None, k or 0)]
        dropped = tuple(p[2] for p in mine if (p[:2], p[2]) in gone)
        want[k, len(mine), len(dropped), dropped] += 1
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], tuple(r["dropped"])) for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()) == want
    assert sum(n for _, _, n, _ in want) > 20


def test_op6_base(spark, odd_dir, wide_dir):
    """The columns that counts alone decide, exactly."""
    import math
    import re

    for where in (odd_dir, wide_dir):
        rows = []
        for d in docs(spark, where):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in d[1] or "")
            rows.append((d[0], d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 2, [*re.findall(r"[^\x20\x09-\x0d]+", low), None]))
        count = Counter(w for _, held, ws in rows if not held for w in ws)
        n, v = sum(count.values()), len(count)
        want = Counter((k, held, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for k, held, ws in rows)
        out = queries.op6_lm_scoring(spark, where).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want


def test_op8_scores(spark, odd_dir):
    for r in queries.op8_toxicity(spark, odd_dir).collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op9_counts(spark, odd_dir):
    import re

    def base(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = {g for g, n in Counter(grams).items() if n > 1}
        hit = {i + k for i, g in enumerate(grams) if g in many for k in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    want = Counter((d[0], *base(d[1])) for d in docs(spark, odd_dir))
    out = queries.op9_quality_rules(spark, odd_dir).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out) == want
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"])


def test_op10(spark, odd_dir):
    tok = tokenizer()
    want = Counter((d[0], len((d[1] or "").encode()), n := len(tok.encode(d[1] or "", add_special_tokens=False).ids), n > 1024) for d in docs(spark, odd_dir))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op10_token_counts(spark, odd_dir).collect()) == want


def test_pipeline(spark, odd_dir, empty_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, odd_dir)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names
        docs = corpus_pipeline.settle(docs, "test")
    ids = [r["doc_id"] for r in docs.collect()]
    assert ids and 101 not in ids and ids.count(300) <= 1 and 200 not in ids
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_many_spans_of_one_item(spark, odd_dir):
    from terrane.llm import decontam

    items = spark.read.parquet(f"{odd_dir}/benchmark.parquet")
    item = "a leaked riddle of nine rather rare silver words here"
    text = " ".join(f"{item} between{i}" for i in range(150))
    rows = decontam.leaks(spark.createDataFrame([(1, text)], "doc_id LONG, text STRING"), items).orderBy("start_byte").collect()
    assert [text.encode()[r["start_byte"] : r["end_byte"]].decode() for r in rows] == [item] * 150
