import pytest

EN = "The house of the wind and the river is that it was for the people with a song as it was on the hill."


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """Tables with nulls in every column, empty and long texts, ties, repeated rows and extra columns with clashing names."""
    root = tmp_path_factory.mktemp("odd")
    long = " ".join(f"word{i} of the" for i in range(9000))
    dense = "漢字仮名、文書。" * 3000
    rows = [(i, f"{EN} Number {i} stands\nalone {i * 7}.", "en", f"src{i % 3}", 1) for i in range(40)]
    rows += [(100, EN * 3, "en", "src0", 1), (101, EN * 3, "en", "src1", 1), (102, EN * 3 + " end", "en", "src1", 1)]
    rows += [(200, None, "en", "src0", 1), (201, "", "de", "src0", 0), (202, "   \n\t ", None, "src12", 0), (203, "x", "fr", None, 1), (204, long, "en", "src19", 9)]
    rows += [(None, EN, "en", "src1", None), (None, None, None, None, None), (205, "ünï 漢字 🙂 \x00 z", "zz", "srcX", None), (300, EN + " twice", "en", "src2", 1), (300, EN + " twice", "en", "src2", 1)]
    rows += [(206, dense, "ja", "src4", 1), (207, "un-broken," * 4000, "en", "src4", 1)]
    rows = [(*r, "clash", 5, [1]) for r in rows]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, k STRING, rank INT, _d ARRAY<INT>")
    df.repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(40)] + [(7, 1, None), (None, None, 1)]
    spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").write.parquet(f"{root}/labels.parquet")
    items = [(1, "a leaked riddle of nine rather rare silver words here"), (2, None), (None, "the of"), (3, "")]
    spark.createDataFrame(items, "item_id LONG, text STRING").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("none")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{root}/{t}.parquet")
    return str(root)


@pytest.fixture(scope="session")
def wide_dir(spark, odd_dir, tmp_path_factory):
    """One file: ids beyond 2^53 beside a null, words parted by every control that parts words, equal rows, one id with two texts."""
    root = tmp_path_factory.mktemp("wide")
    rows = [(9007199254740993, EN, "en", "src1"), (None, EN + " null", "en", "src1"), (5, "a\rb\x0bc\x0cd\te  " + EN, "de", "src2"), (-9007199254740995, "", None, None)]
    rows += [(1, f"{EN} one line\n{EN} one line\nshort", "en", "src3")] * 2 + [(7, "one more with words of its own that stand nowhere else at all", "en", "src3"), (7, "quite another text " * 9, "fr", "src3")]
    spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING").coalesce(1).write.parquet(f"{root}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").write.parquet(f"{root}/{t}.parquet")
    return str(root)
