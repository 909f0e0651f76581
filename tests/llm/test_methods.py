"""The methods themselves against brute force: fingerprints, links, edit joins, chunks, range coder, folding, water levels."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from terrane.llm import linededup, maxent, mixing, nearcopies, simhash, tokencount, tokenfile, toxicity
from terrane.llm.wordhash import Batch, letter_map, space_map


def components_of(n, linked):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_bits():
    for text in ("", " ", "One", "a b c", "The cat\tsat on THE mat; the cat sat on the mat", "é Ü x " * 9):
        w = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
        k = min(4, len(w))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_masks_cover_every_pair_within_the_radius():
    masks = [m % (1 << 64) for m in simhash.masks(2)]
    for bits in itertools.combinations(range(64), 2):
        assert any(not m >> bits[0] & 1 and not m >> bits[1] & 1 for m in masks)
    masks, rng = [m % (1 << 64) for m in simhash.masks(4)], random.Random(1)
    for _ in range(5000):
        d = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & d == 0 for m in masks)


@pytest.mark.parametrize("run_limit", [2048, 20])
def test_links_of_a_dense_cluster(spark, run_limit):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    values = set()
    while len(values) < 150:
        x = base
        for b in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << b
        values.add(x)
    values = sorted(values)
    near = [(i, j) for i in range(150) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4]
    nodes = spark.createDataFrame(pd.DataFrame({"fp": np.array(values, np.uint64).astype(np.int64), "rep": np.arange(150)}))
    roots = simhash.components(simhash.links(nodes, 4, run_limit, 16)).toPandas()
    got = list(range(150))
    for n, r in zip(roots["node"], roots["root"]):
        got[n] = r
    assert got == components_of(150, near)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a LONG, b LONG")
    out = simhash.components(edges).toPandas()
    assert len(out) == 300 and set(out["root"]) == {0}


def test_near_copies(spark):
    """The pipeline's stage keeps no two documents whose 5-word shingles are similar to 0.8 or more."""
    import corpus_pipeline

    rng = random.Random(6)
    texts = []
    for n in (3, 5, 8, 30, 100, 100, 300):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for edits in [0, 0, *range(1, 12)]:
            w = list(base)
            for p in rng.sample(range(n), min(edits * n // 150 + (edits > 0), n)):
                w[p] = f"W{rng.randrange(5000)}"
            texts.append(" ".join(w))
    texts += ["common passage of many words that is in each text here " + " ".join(f"v{rng.randrange(5000)}" for _ in range(40)) for _ in range(30)]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    sets = [shingles(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    fps = [simhash.fingerprint(t) for t in texts]
    bits = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = set(components_of(len(texts), near + bits))
    assert len(want) < len(set(components_of(len(texts), bits)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == want


@pytest.mark.parametrize("run_limit,block", [(256, 1024), (3, 4)])
def test_near_copies_of_crowded_keys(spark, run_limit, block):
    """Families whose members share most shingles, too few or just enough: components as by all pairs."""
    from pyspark.sql import functions as F

    rng, texts = random.Random(8), []
    for _ in range(3):
        base = [f"w{rng.randrange(900)}" for _ in range(120)]
        for _ in range(25):
            w = list(base)
            for p in rng.sample(range(120), rng.randint(1, 7)):
                w[p] = f"W{rng.randrange(5000)}"
            texts.append(" ".join(w))
    texts = sorted(set(texts))
    sets = [set(zip(*(t.lower().split()[i:] for i in range(5)))) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    fps = [simhash.fingerprint(t) for t in texts]
    near += [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    df = spark.createDataFrame(list(enumerate(texts)), "i LONG, x STRING").withColumn("k", F.xxhash64("x"))
    got = {r["k"]: r["c"] for r in nearcopies.classes(df.select("k", "x"), run_limit, block).collect()}
    at = [got[r["k"]] for r in df.orderBy("i").collect()]
    want = components_of(len(texts), near)
    assert len(set(zip(at, want))) == len(set(at)) == len(set(want)) and len(set(want)) > 3


def test_sieve_lets_every_similar_pair_pass():
    rng = np.random.default_rng(9)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 3, 30, 31, 33, 200, 260, 5000, 40000)]
    pairs = []
    for s in sets:
        for share in (0.75, 0.8, 0.85, 1.0):
            kept = s[: int(np.ceil(len(s) * share))]
            pairs.append((s, kept))
            pairs.append((s, np.concatenate([kept, rng.integers(0, 1 << 63, len(s) // 20, dtype=np.uint64)])))
    n = len(pairs)
    sieve = nearcopies._Sieve([nearcopies.sketch(a) for a, _ in pairs] + [nearcopies.sketch(b) for _, b in pairs])
    got = sieve.may(np.arange(n), np.arange(n) + n, np.array([len(a) + len(b) for a, b in pairs]))
    for ok, (a, b) in zip(got, pairs):
        both = len(np.intersect1d(a, b))
        assert ok or 5 * both < 4 * (len(a) + len(b) - both)
    assert not got.all()


def test_rows_of_one_id(spark, wide_dir):
    """Different texts of one id stay, of equal rows one does, null ids stay."""
    out = nearcopies.keep_first(spark.read.parquet(f"{wide_dir}/documents.parquet"))
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(ids, key=lambda k: (k is None, k or 0)) == [-9007199254740995, 1, 5, 7, 7, None]  # the largest is like 5


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def edited(rng, a, most):
    b = list(a)
    for _ in range(rng.randint(0, most)):
        p, op = rng.randint(0, max(len(b) - 1, 0)), rng.choice("sid")
        if op == "i":
            b.insert(p, rng.choice("abé"))
        elif b and op == "s":
            b[p] = rng.choice("abé")
        elif b:
            del b[p]
    return "".join(b)


def test_banded_distance():
    rng = random.Random(3)
    a = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    b = [edited(rng, x, 4) for x in a]
    for most in (0, 1, 2):
        assert linededup.within(a, b, np.full(len(a), most)).tolist() == [distance(x, y) <= most for x, y in zip(a, b)]


@pytest.mark.parametrize("run_limit", [512, 8])
def test_line_classes(spark, run_limit):
    rng = random.Random(4)
    lines = {"".join(rng.choice("abé ") for _ in range(rng.randint(8, 40))).strip() for _ in range(120)}
    lines |= {edited(rng, x, 3).strip() for x in lines} | {f"the quick brown fox jumps over {i:03d}" for i in range(40)}
    lines = sorted(x for x in lines if x)
    size = [len(x) for x in lines]
    near = [(i, j) for i in range(len(lines)) for j in range(i) if abs(size[i] - size[j]) <= 2 and (t := int(linededup.threshold(min(size[i], size[j])))) and distance(lines[i], lines[j]) <= t]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id LONG, text STRING")
    at = linededup.lines_of(df, "doc_id", "text")
    roots = dict(map(tuple, simhash.components(linededup.links(at, run_limit=run_limit, block=8)).collect()))
    hashes = {r["k"]: r["h"] for r in at.collect()}
    got = [roots.get(hashes[i], hashes[i]) for i in range(len(lines))]
    want = components_of(len(lines), near)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_long_distance():
    rng = random.Random(13)
    for _ in range(400):
        a = "".join(rng.choice("abcdeé ") for _ in range(rng.randint(0, 150)))
        b = edited(rng, a, 12)
        for most in (0, 3, 7):
            assert linededup.close(a, b, most) == (distance(a, b) <= most)


@pytest.mark.parametrize("run_limit", [512, 3])
def test_long_line_classes(spark, run_limit):
    """A twentieth of the characters of a long line may be edited, anywhere, also at equal steps."""
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    lines = []
    for n in (57, 60, 61, 79, 80, 90, 91, 134, 135, 140, 300, 620):
        a = "".join(rng.choice(words) + " " for _ in range(n))[:n].strip()
        t = max(2, len(a) // 20)
        even = list(a)
        for i in range(t):
            even[(i + 1) * len(a) // (t + 1)] = "#"
        lines += [a, "".join(even), a.replace(a[20:24], "", 1), edited(rng, a, t), edited(rng, a, 2 * t), a + "x" * t, a + "x" * (t + 1), a + "y" * t]
    lines = sorted({x.strip() for x in lines})
    near = [(i, j) for i in range(len(lines)) for j in range(i) if abs(len(lines[i]) - len(lines[j])) <= 40 and distance(lines[i], lines[j]) <= max(2, min(len(lines[i]), len(lines[j])) // 20)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id LONG, text STRING")
    at = linededup.lines_of(df, "doc_id", "text")
    roots = dict(map(tuple, simhash.components(linededup.links(at, run_limit=run_limit, block=4)).collect()))
    hashes = {r["k"]: r["h"] for r in at.collect()}
    got = [roots.get(hashes[i], hashes[i]) for i in range(len(lines))]
    want = components_of(len(lines), near)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want)) < len(lines)


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (200, 30), (1000, 64)])
def test_spliced_chunks(chunk, overlap):
    tok, rng = tokencount.tokenizer(), random.Random(5)
    texts = ["a" * 3000, " " * 900 + "x", "x y " * 300 + "<|endoftext|>" * 20 + " zz" * 200, "".join(rng.choice("ab  é1'!\n") for _ in range(2000))]
    texts += ["".join(rng.choice("漢字仮名かなカナ。、") for _ in range(3000)), "漢字" * 1500, "it's we'll 'tis o'clock\r\n" * 120, "<|endof" * 300 + "text|>", "0123" * 600 + "!?" * 300 + "x" * 50]
    texts += ["".join(rng.choice(["don't", "'s", "'", " ", "  ", "\t", "漢", "é", "7", "<|endoftext|>", "ß", "ไทย", "🙂"]) for _ in range(900))]
    for t in texts:
        assert tokencount.encode_ids(tok, t, chunk, overlap) == tok.encode(t, add_special_tokens=False).ids


def test_long_texts_take_linear_time():
    """Texts without a blank: within three times the library's own time for the whole."""
    import time

    tok, rng = tokencount.tokenizer(), random.Random(7)
    for t in ("".join(rng.choice("漢字仮名交文書。、") for _ in range(160_000)), ("word,and;no(blank)" * 60_000)[:1_000_000]):
        began = time.perf_counter()
        want = tok.encode(t, add_special_tokens=False).ids
        whole = time.perf_counter() - began
        began = time.perf_counter()
        assert tokencount.encode_ids(tok, t) == want
        assert time.perf_counter() - began < 3 * whole + 0.5


def test_remembered_pre_tokens():
    e, tok = tokencount.Encoder(), tokencount.tokenizer()
    for t in ("", " ", "a\x1cb", "x<|endoftext|>y", "漢字 かな", "it's  we'll\n\n\t x", "ſ ǆ ­-", "the the  the\n"):
        assert list(e(t)) == tok.encode(t, add_special_tokens=False).ids


def test_texts_are_encoded_together(monkeypatch):
    """A unit that many texts hold reaches the library once, however few are remembered."""
    monkeypatch.setattr(tokencount, "_MEMO", 4)
    rng, tok, asked = random.Random(5), tokencount.tokenizer(), []
    words = ["the", "und", "caf\u00e9", "x" * 300, "it's", "a,b", "7\u00bd"]
    odd = ["", " ", "\n", "ends ", " begins", "", "a\x1cb", "x<|endoftext|>y", "\u6f22\u5b57 \u304b\u306a", "\t\r\n", "y" * 40_000]
    texts = odd + [rng.choice(["", " ", "\n\n"]) + rng.choice([" ", "  ", "\t"]).join(rng.choices(words, k=rng.randrange(40))) for _ in range(300)] + odd
    e = tokencount.Encoder()
    fast = e.fast
    e.fast = lambda units, **how: (asked.extend(units), fast(units, **how))[1]
    got = e.many(texts)
    assert [list(x) for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == len(set(asked)) and len(e.young) + len(e.old) <= 4
    assert [len(x) for x in e.many([])] == [] and [len(x) for x in e.many(["", ""])] == [0, 0]


def test_range_coder_round_trip():
    rng = np.random.default_rng(6)
    cases = [np.zeros(0, np.uint32), np.array([0], np.uint32), np.full(9000, 50256, np.uint32), rng.integers(0, 50257, 9000).astype(np.uint32), np.tile(np.arange(50, dtype=np.uint32), 300), np.array([65535, 0] * 4100, np.uint32)]
    for s in (cases, cases[::-1], [cases[3]]):
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(s, tokenfile.unpack(tokenfile.pack(s))))
    assert len(tokenfile.pack([cases[4]])[0]) < 2 * len(cases[4])
    body = bytearray(tokenfile.pack([cases[3]])[0])
    body[40] ^= 1
    with pytest.raises(ValueError):
        tokenfile.unpack([bytes(body)])


def test_folding_and_matching():
    assert [toxicity.fold(t) for t in ("1d10t", "$cum", "pаthеtic", "idiot$$$", "100 5")] == ["idiot", "scum", "pathetic", "idiot$$$", "100 5"]
    m = toxicity.Model({"clown": 2.0, "clownish": 1.0, "scummy*": 3.0}, ["clown fish"], (0.0,) * 4)
    a = m.automaton()
    assert toxicity.matches(a, "scummyish but not unscummy") == (1, 3.0, 3.0)
    assert toxicity.matches(a, "a clown, a clown fish; clowns") == (1, 2.0, 2.0)
    assert toxicity.features(a, None) == (0, 0.0, 0.0)
    assert toxicity.features(a, "a clown\nfish, a clown \t fish and clown  fishes")[0] == 1


def test_word_hashes():
    b = Batch(["The THE, the", None, "", "x\x00y x\x01y"], space_map())
    assert np.diff(b.first).tolist() == [3, 0, 0, 2]
    assert len(set(b.hashes.tolist())) == 4  # the, the,(with comma), and two with controls
    words = [random.Random(7).choice(["alpha", "beta", "gamma"]) for _ in range(300_000)]
    big = Batch([" ".join(words)], letter_map())
    assert len(big.hashes) == 300_000 and len(set(zip(big.hashes.tolist(), words))) == len(set(words))


def test_water_levels(spark):
    mix = mixing.Mix(domains=(("a", "^a", 50),), other_domain=("b", 50), languages={"x": 50, "y": 50}, other_language=0, share=0.5, epochs=1)
    leaves = spark.createDataFrame([("a", "=x", "=a1", 1000), ("a", "=y", "=a2", 10), ("b", "=x", "=b1", 100), ("b", "=y", "=b2", 100)], "_d STRING, _l STRING, _s STRING, tokens LONG")
    got = {r["_s"]: r["quota"] for r in mixing.quotas(leaves, mix).collect()}
    # 605 in all; b holds 200 of its 302 only, so a gets 405; there y gives 10, and its sibling takes the rest.
    assert got == {"=b1": 100, "=b2": 100, "=a2": 10, "=a1": 395}


def test_maxent_is_a_distribution():
    """Over all words of the table and one unknown word for each tail class, the probabilities after any history add up to 1."""
    rng = np.random.default_rng(5)
    made = [f"w{i}{'aenz7%'[i % 6]}" for i in range(900)]
    t = maxent.Tokens([" ".join(rng.choice(made, 4000, p=(w := 1 / np.arange(1, 901)) / w.sum()))])
    h, first, n = np.unique(t.h, return_index=True, return_counts=True)
    top = pd.DataFrame({"h": h.view(np.int64), "c": n, "tail": t.tail[first]}).sort_values(["c", "h"], ascending=[False, True])
    top["member"] = np.where(np.arange(len(top)) < maxent.HEAD, np.arange(len(top)), -1)
    groups = top.assign(g=maxent.group(h := top["h"].to_numpy().view(np.uint64), top["tail"].to_numpy()) % maxent.MEMBERS, one=top["c"] == 1).groupby(["tail", "g"]).agg(n=("c", "sum"), once=("one", "sum")).reset_index()
    table = maxent.figures(top, list(groups.itertuples(index=False, name=None)), int(n.sum()), len(top), 1)
    assert table.count.sum() == n.sum() and (table.count >= 0).all() and (table.once >= 0).all()
    w = maxent.first_weights(table)
    w.rows[:] = rng.normal(0, 0.3, w.rows.shape)

    seen = table.units(table.h, np.array([dict(zip(top["h"], top["tail"]))[x] for x in table.h.view(np.int64)]), np.arange(len(table.h)))
    total = 0.0
    z = maxent._sum(w.rows, w.bias, np.array([3]), np.array([5]), np.array([7]))[0]
    p_class = np.exp(z - np.log(np.exp(z).sum()))
    for unit, c in zip(seen, table.c):
        y, k = divmod(int(unit), maxent.MEMBERS)
        x = w.words[y] + w.rows[table.sizes()[0] + y]
        p = p_class[y] * np.exp(x[k] - np.log(np.exp(x).sum()))
        total += p if unit < maxent.HEAD else p * c * table.share()[unit - maxent.HEAD]
    lost = (p_class[maxent.HEAD_CLASSES :] * table.unknown()).sum()
    assert 0.8 < total + lost <= 1 + 1e-4  # groups without a word keep a little that no word has


def test_maxent_tables_grow():
    sizes = [maxent.Table(*[np.empty(0)] * 3, 0, types, 1, np.empty(0), np.empty(0)).sizes() for types in (0, 10**5, 10**6, 10**9)]
    assert sizes == [(8192, 256), (8192, 256), (32768, 1024), (65536, 2048)]


def test_line_rows_packed():
    """Packed rows of keys come back whole, in order, and a sketch's counts are never further apart than twice the edits."""
    rng = np.random.default_rng(3)
    key, h, sketch = rng.integers(0, 1 << 64, 3000, dtype=np.uint64), rng.integers(-(1 << 63), 1 << 63, 3000), rng.integers(0, 1 << 48, 3000, dtype=np.uint64)
    got = linededup._unpacked([rows for _, rows in linededup._rows(key, h, sketch, 64)])
    by = np.argsort(key)
    assert np.array_equal(got[0], key[by]) and np.array_equal(got[1], (h[by].view(np.uint64) >> np.uint64(24)).astype(np.int64)) and np.array_equal(got[2], sketch[by])
    rng = random.Random(3)
    for _ in range(200):
        a, k = "".join(rng.choice("abcdefghijklmnop é") for _ in range(rng.randint(60, 900))), rng.randint(0, 30)
        size, cp, *_ = linededup._prepared([a, edited(rng, a, k)])
        sketches = linededup._sketches(size, cp)
        assert all(linededup._like(sort, sketches[sort][:1], sketches[sort][1:])[0] <= 2 * k for sort in range(3))


@pytest.mark.parametrize("words", [1, 2, 4])
def test_band_of_words(words):
    rng = random.Random(15)
    a = ["".join(rng.choice("abcdeé 😀") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    most = [rng.randint(1, 32 * words - 1) for _ in a]
    b = [edited(rng, x, rng.randint(0, m + m // 3 + 3)) for x, m in zip(a, most)]
    assert linededup.banded(a, b, np.array(most), words).tolist() == [linededup.close(x, y, m) for x, y, m in zip(a, b, most)]


def test_many_like_lines(spark):
    """A key of many lines that don't belong together gives no more pairs than the lines have to do with each other."""
    from pyspark.sql import functions as F

    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    lines = ["the very same beginning " + " ".join(rng.choice(words) for _ in range(20)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id LONG, text STRING")
    rows = linededup.lines_of(df, "doc_id", "text").select("line", "h").mapInArrow(linededup._emit_keys(np.empty(0, np.uint64), 64), "part int, rows binary")
    met = rows.repartition(2, "part").sortWithinPartitions("part").mapInArrow(linededup._stream(linededup.RUN), "a long, b long, crowd boolean")
    assert met.filter(~F.col("crowd")).count() < 400 * 399 // 20


def test_crowded_key_has_a_line_once(spark):
    """A line that repeats one word gives its key at many places; where the key is crowded, the line counts once."""
    from pyspark.sql import functions as F

    rng = random.Random(17)
    lines = ["repeatedly " * 300 + "".join(rng.choice("abcdefghijklmnop") for _ in range(400)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id LONG, text STRING")
    at = linededup.lines_of(df, "doc_id", "text").select("line", "h")
    rows = at.mapInArrow(linededup._emit_keys(np.empty(0, np.uint64), 64), "part int, rows binary")
    assert sum(len(r["rows"]) for r in rows.collect()) // sum(linededup._PLANES) < 60 * 300
    met = rows.repartition(2, "part").sortWithinPartitions("part").mapInArrow(linededup._stream(1), "a long, b long, crowd boolean")
    crowd = met.filter("crowd").select(F.shiftright("a", 16), "b").collect()
    assert 60 <= len(crowd) == len(set(crowd))


def test_new_units_meet_the_library_together():
    """Thousands of new words are a few texts for the library, and a text's ids are the library's own."""
    rng = random.Random(18)
    blank = (" ", "\n", "  ", " \n", "\t", "\r\n ", "\n\n  ")
    texts = ["".join(rng.choice(blank) + "".join(rng.choice("abcdeéüABC019.,'s!") for _ in range(rng.randint(1, 9))) for _ in range(2000)) for _ in range(4)]
    texts += ["", " ", "word", " a  ", "don't stop\n", "x" * 300 + " y", texts[0][1:].strip() + "   "]
    enc, given = tokencount.Encoder(), []
    library = enc.fast

    def counted(batch, **options):
        given.extend(batch)
        return library(batch, **options)

    enc.fast = counted
    got = enc.many(texts)
    assert [x.tolist() for x in got] == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert 0 < len(given) < 20
    # Where the tokens' bytes don't tell the units apart, each is encoded alone.
    odd = tokencount.Encoder()
    odd.width = odd.width + 1
    assert all(np.array_equal(x, y) for x, y in zip(got, odd.many(texts)))
