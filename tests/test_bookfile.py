import random

import pytest

from loomgrid.sources import bookfile as b
from loomgrid.sources.mapfile import BitWriter


def test_page_of_the_format_description():
    # two records of two tokens, one of one, through slots 1 to 4: payload 1 2 0 3 2 0 4 0
    records = [[0, 1], [2, 1], [3]]
    body = b.write_page(records, 8)
    assert b.read_page(body, 3, 8) == records
    w = BitWriter().unsigned(2).put(0, 2).unsigned(15 + 32).put(15, 15)
    for t in (0, 1, 2, 3):
        w.put(t, 8)
    w.put(2, 2).unsigned(32)
    for c in (1, 2, 0, 3, 2, 0, 4, 0):
        w.put(c, 4)
    assert body == w.done()


def test_index_keeps_neighbours_apart():
    paths = [[0, 1, 2], [0, 1, 3], [4, 1, 2], [0, 1, 2]]
    assert b.read_index(b.write_index(paths, 5)) == paths


@pytest.mark.parametrize("encoding", b.ENCODINGS)
@pytest.mark.parametrize("seed", range(6))
def test_round_trip(encoding, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("東京都千代田区abcdefghijklmnopqr") for _ in range(rng.randint(0, 9)))
    names = [word() for _ in range(60)]
    paths = [[rng.choice(names[:4]), rng.choice(names[:9]), rng.choice(names)] for _ in range(rng.randint(1, 200))]
    got = b.read_book(b.write_book(paths, header=b"HEAD", version=b"any/0", metadata="m", encoding=encoding, page_size=16), encoding)
    assert [[got["texts"][c] for c in p] for p in got["paths"]] == paths and got["metadata"] == "m"
    assert len(set(got["texts"])) == len(got["texts"])


def test_broken():
    data = b.write_book([["a", "b"]], header=b"HEAD", version=b"any/0")
    for cut in (1, 3, 8):
        with pytest.raises(ValueError):
            b.read_book(data[:-cut])
    with pytest.raises(ValueError):
        b.write_tokens([b"ab", b"c"])
    with pytest.raises(ValueError):
        b.write_texts([[1, 2], [1]], 4)


def test_files(spark, tmp_path):
    paths = [["x", "", "y"], ["x", "", "z"], ["x", "q", ""]]
    (tmp_path / "d.bin").write_bytes(b.write_book(paths, header=b"HEAD", version=b"any/0"))
    got = b.read_book_files(spark, str(tmp_path)).orderBy("code").collect()
    assert [list(r.parts) for r in got] == paths and [r.code for r in got] == [1, 2, 3]


def test_stream_size_is_the_encoders(spark):
    from pyspark.sql import functions as F

    from loomgrid.operators import tokenmerge as tm

    rng = random.Random(5)
    pages = {(5, p): [[rng.randrange(40) for _ in range(5)] for _ in range(30)] for p in range(3)}
    rows = [(n, p, s, r) for (n, p), rs in pages.items() for s, r in enumerate(rs)]
    records = spark.createDataFrame(rows, "n_tokens long, page long, slot long, ids array<long>")
    ids = spark.range(40).select(F.col("id").alias("token_id"), F.col("id").cast("string").alias("token"))
    got = {(r.n_tokens, r.page): r.bytes for r in tm.stream_bits(records, ids).collect()}
    assert got == {k: len(b.write_page(v, 6)) for k, v in pages.items()}


def test_model_size_is_the_files(spark):
    """Against a written dictionary, whose index chunk and header are left out."""
    from loomgrid.operators import tokenmerge as tm

    rng = random.Random(9)
    names = list(dict.fromkeys("".join(rng.choice("abcab") for _ in range(rng.randint(0, 12))) for _ in range(150)))
    data = b.write_book([[n] for n in names], header=b"HEAD", version=b"any/0")
    parts = dict(b.chunks(data))
    want = sum(len(b.chunk(k, v)) for k, v in parts.items() if k in (b.TOKENS, b.TEXTS)) + len(b.chunk(b"HEAD", b"\0" * 17))
    arrays = tm.arrays_of(spark.createDataFrame(list(enumerate(names)), "text_code long, text string"))
    assert tm.model_size(arrays) == want
    found = tm.best_pair_by_size(arrays, tried=2)
    assert found is not None and found[2] < want and found[5] == want
    merged, report = tm.optimize_tokens(spark.createDataFrame(list(enumerate(names)), "text_code long, text string"), max_merge=2, by_size=True, tried=2)
    rows = report.orderBy("step").collect()
    assert (rows[0].left, rows[0].right, rows[0].before_bytes, rows[0].after_bytes) == (found[0], found[1], want, found[2])
    assert all(r.merged == r.left + r.right and r.after_bytes < r.before_bytes for r in rows) and all(b.before_bytes == a.after_bytes for a, b in zip(rows, rows[1:]))
    assert tm.model_size(merged) == rows[-1].after_bytes and rows[-1].distinct_tokens == len({t for r in merged.collect() for t in r.tokens})


def test_flat_dictionary():
    texts = ["bb", "a", "", "ccc", "a"]
    got = b.read_book(b.write_flat_book(texts, header=b"HEAD", version=b"flat/0"))
    assert got["texts"] == ["", "a", "a", "bb", "ccc"] and got["paths"] is None


def test_widths():
    data = b.write_book([["a", "b"], ["a", "c"]], header=b"HEAD", version=b"any/0")
    assert b.book_widths(data) == {"tokens": 3, "token_bits": 2, "texts": 3, "code_bits": 2, "paths": 2, "fits": True}
    flat = b.book_widths(b.write_flat_book(["bb", "a"], header=b"HEAD", version=b"flat/0"))
    assert flat["code_bits"] is None and flat["paths"] is None and flat["fits"]
    parts = dict(b.chunks(data))
    narrow = b"".join(b.chunk(k, v if k != b.INDEX else b.write_index([[0, 1], [0, 1]], 1)) for k, v in parts.items())
    assert not b.book_widths(narrow)["fits"]
    with pytest.raises(ValueError):
        b.read_book(narrow)
