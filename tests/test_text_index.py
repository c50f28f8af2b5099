"""Search over the index against the search that reads all texts."""

import random

import pytest

from tracewell.operators import search, text_index


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    words = [f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(100)]
    rows = [(i % 50, i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(100)], k=rng.randrange(60)))) for i in range(3_000)]
    # rare words in a few neighbouring texts
    rows += [(7, 3_000 + i, "needle " * (1 + i % 5) + "waa wba " * (i % 3)) for i in range(40)] + [(0, 4_000, None), (0, 4_001, ""), (0, 4_002, "Needle, NEEDLE! é needles")]
    return spark.createDataFrame(rows, "part long, n long, text string").repartition(3, "n").cache()


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/i"
    with pytest.MonkeyPatch.context() as m:
        m.setattr(text_index, "BLOCK", 16)
        text_index.build(texts, path)
    return path


@pytest.mark.parametrize("query", ["needle", "needle waa", "WJJ wab", "waa", "waa waa the", "nothing here", "", "needles"])
def test_equals_the_reading_of_all_texts(spark, texts, index, query):
    for limit in (1, 10, 60):
        got, reading = text_index.search(spark, index, query, limit)
        assert got.collect() == search.bm25(texts, query, limit=limit).collect()
        assert reading.read <= reading.rows


def test_a_query_skips_what_cannot_reach_its_last_result(spark, index):
    _, rare = text_index.search(spark, index, "needle waa", 10)
    assert 0 < rare.read < rare.rows / 4
    _, none = text_index.search(spark, index, "absent")
    assert (none.rows, none.read) == (0, 0)


def test_groups_are_blocks(spark, index):
    words = spark.read.parquet(f"{index}/words")
    assert words.selectExpr("max(texts)").first()[0] <= 16 and words.where("size(found) <> texts").count() == 0


def test_empty_table(spark, texts, tmp_path):
    text_index.build(texts.limit(0), f"{tmp_path}/i")
    assert text_index.search(spark, f"{tmp_path}/i", "waa")[0].collect() == []


def test_words_of_a_block_are_one_row_before_the_shuffle():
    """Texts come in batches that cut blocks; each word of each block leaves the task as one row."""
    import pyarrow as pa

    texts = [(3, ["b", "a", "b"]), (4, ["a"]), (7, ["c"]), (8, ["a", "c", "c"]), (9, ["b"]), (2**33, ["a"]), (2**33 + 5, ["a", "b"])]
    batches = [pa.RecordBatch.from_pylist([{"id": i, "length": len(w), "words": w} for i, w in texts[k : k + 2]]) for k in range(0, len(texts), 2)]
    rows = [tuple(r.values()) for batch in text_index._postings(8)(iter(batches)) for r in batch.to_pylist()]
    assert sorted(rows) == [("a", 0, [3, 4], [1, 1], [3, 1]), ("a", 1, [0], [1], [3]), ("a", 2**30, [0, 5], [1, 1], [1, 2]), ("b", 0, [3], [2], [3]), ("b", 1, [1], [1], [1]), ("b", 2**30, [5], [1], [2]), ("c", 0, [7], [1], [1]), ("c", 1, [0], [2], [3])]
    assert list(text_index._postings(8)(iter([]))) == []
