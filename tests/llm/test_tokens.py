import json
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from loomgrid.llm.packing import best_fit_packing, pack, plan
from loomgrid.llm.tokenfile import read_token_files, token_files
from loomgrid.llm.tokens import PieceEncoder, keeps_space

NAMES = {"word_bpe_49k.json": False, "byte_bpe_50k.json": True}
ODD = ["", None, "  a  b ", "it's ok, I'll  go\n\nnow \n x", "été, É×y …, áb", "<|endoftext|> x <|startoftext|>", "a<|endoftext|>b it's, x<|end", "a\tb\t c\x1cd", "12 345a6'd 's 'S", "\n", "é ́x ΣΣ İx", "x　y z", "don't.\"quoted\"(x)[y]", "ªºµ ½2 ×÷,"]


def test_forms():
    """Only files of the two known forms are cut; a changed one goes through the library whole."""
    for name, keeps in NAMES.items():
        form = json.loads(Tokenizer.from_file(P.path(name)).to_str())
        assert keeps_space(form) is keeps
        assert keeps_space(form | {"pre_tokenizer": {"type": "Whitespace"}}) is None and keeps_space(form | {"normalizer": {"type": "NFKC"}}) is None


@pytest.mark.parametrize("name", NAMES)
def test_other_form(name, tmp_path):
    form = json.loads(open(P.path(name)).read()) | {"pre_tokenizer": {"type": "Whitespace"}}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(form))
    ids, offs = PieceEncoder(str(path)).encode(pa.array(ODD))
    for i, t in enumerate(ODD):
        assert ids[offs[i] : offs[i + 1]].tolist() == Tokenizer.from_file(str(path)).encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_pieces_encode_as_in_the_text(name):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice([*"ab'sSt .,\n\té×… 12 <|é", "<|endoftext|>"] if k % 5 == 0 else "ab'sSt .,\n\té×… 12 <|é") for _ in range(30)) for k in range(1500)]
    enc = PieceEncoder(P.path(name))
    ids, offs = enc.encode(pa.array(texts))
    for i, e in enumerate(Tokenizer.from_file(P.path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[offs[i] : offs[i + 1]].tolist() == e.ids, texts[i]


def brute_bins(lengths, capacity):
    """A plain greedy matching and best fit, bin by bin."""
    left = sorted(lengths, reverse=True)
    bins = []
    large = [x for x in left if 3 * x > capacity]
    while large:
        top = large.pop(0)
        mate = next((x for x in large if x <= capacity - top), None)
        if mate is not None:
            large.remove(mate)
        bins.append(capacity - top - (mate or 0))
    for x in (x for x in left if 3 * x <= capacity):
        gap = min((g for g in bins if g >= x), default=None)
        if gap is None:
            bins.append(capacity - x)
        else:
            bins.remove(gap)
            bins.append(gap - x)
    return len(bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [min(capacity, max(1, int(rng.paretovariate(0.8) * rng.choice([1, 3])))) for _ in range(rng.randint(0, 400))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    rows = plan(counts, capacity)
    ranks = {x: [] for x in counts}
    bins = {}
    for length, rank, n, seq, offset in rows:
        for i in range(n):
            ranks[length].append(rank + i)
            bins.setdefault(seq + i, []).append((offset, length))
    assert all(sorted(ranks[x]) == list(range(counts[x])) for x in counts)
    for slots in bins.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * x > capacity for _, x in slots) <= 2
    assert len(bins) <= brute_bins(lengths, capacity)
    assert len(rows) <= 40 * capacity


def frame(spark):
    rng = random.Random(2)
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(100 + i, "word " * rng.randint(0, 900), 2) for i in range(20)] + [(None, "x", 3), (1, None, 3), (200, "very long, " * 3000, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, length int"), rows


def ids_of(name, text):
    tok = Tokenizer.from_file(P.path(name))
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_packing(spark):
    docs, rows = frame(spark)
    got = best_fit_packing(docs, P.path("word_bpe_49k.json")).collect()
    want = []
    for i, t, _ in rows:
        ids = ids_of("word_bpe_49k.json", t)
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(map(str, (tuple(r[:5]) for r in got))) == sorted(map(str, want))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in bins.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    assert best_fit_packing(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_token_files(spark, tmp_path):
    docs, rows = frame(spark)
    path = str(tmp_path / "t")
    got = token_files(docs, P.path("byte_bpe_50k.json"), path, bytes_each=1 << 12).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    whole, at = [], 0
    for i, t, _ in order:
        ids = ids_of("byte_bpe_50k.json", t)
        whole.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(str, whole))
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == [r[0] for r in order]
    one = read_token_files(spark, path).where("doc_id = 200").first()
    assert one.ids == ids_of("byte_bpe_50k.json", "very long, " * 3000).tolist()
    assert token_files(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_pack_by_either_join(spark, broadcast_rows, monkeypatch):
    """Many pieces of one null id and one length; each lies once in a place of its own."""
    monkeypatch.setattr("loomgrid.llm.packing.RANK_BITS", 6)
    pieces = spark.range(5000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0 AS piece", "0L AS start", "CASE WHEN id % 3 = 0 THEN 7L + id % 40 ELSE 64L END AS length", "1L AS ids_crc32", "id AS key")
    got = pack(pieces, 64, broadcast_rows).collect()
    assert len(got) == 5000
    taken = {(r.sequence_id, k) for r in got for k in range(r.offset, r.offset + r.length)}
    assert len(taken) == sum(r.length for r in got) and max(k for _, k in taken) < 64


def test_token_files_of_one_id(spark, tmp_path):
    """Rows of one id are spread over files and stay whole."""
    docs = spark.range(2000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('text ', id) AS text")
    path = str(tmp_path / "one")
    got = token_files(docs, P.path("byte_bpe_50k.json"), path).orderBy("start").collect()
    assert len(got) == 2000 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert read_token_files(spark, path).select("start").distinct().count() == 2000
    assert spark.read.parquet(path).select("shard").distinct().count() > 1


def test_files_can_be_read_in_part(spark, tmp_path):
    """Footers: dictionary pages for the ids, page indexes of every column, several row groups; and a read of the numbers alone takes few bytes."""
    import pyarrow.parquet as pq

    from loomgrid.llm.tokenfile import write_token_files

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x1", "y2"]) for _ in range(200))) for i in range(3000)]
    path = str(tmp_path / "t")
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, P.path("byte_bpe_50k.json"), row_group_bytes=16 << 10, page_bytes=4 << 10, page_rows=100)
    groups = sizes = numbers = 0
    for f in sorted((tmp_path / "t").glob("*.parquet")):
        meta = pq.ParquetFile(f).metadata
        groups = max(groups, meta.num_row_groups)
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                assert col.has_offset_index and (col.has_column_index or "ids" in col.path_in_schema)
                sizes += col.total_compressed_size
                if "ids" in col.path_in_schema:
                    assert col.has_dictionary_page
                else:
                    numbers += col.total_compressed_size
    assert groups > 1 and numbers < sizes / 10
    from loomgrid.llm.tokenfile import read_token_files as read

    one = read(spark, path).where("doc_id = 1500").collect()
    assert len(one) == 1 and one[0].n_tokens == len(one[0].ids)
    plan = read(spark, path).select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and all("ids" not in part.split("\n")[0] for part in plan.split("ReadSchema:")[1:])
