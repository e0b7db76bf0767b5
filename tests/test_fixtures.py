"""Worked examples and small plain versions."""

import random
from collections import Counter

import pytest

from loomgrid.functions import grid as g
from loomgrid.operators import lexicon as x
from loomgrid.operators import render as v
from loomgrid.operators import tokenmerge as tm
from loomgrid.operators.atlas import Atlas

BLOCKS = [1, 2, 3, 4, 2, 1, 5, 6, 7, 8, 11, 12, 9, 10, 13, 14]
MAPS = [(0, 10, 20, 4, 4, BLOCKS), (1, 11, 21, 2, 2, [0, 90, 0, 91]), (2, 30, 40, 4, 4, BLOCKS)]


@pytest.fixture(scope="module")
def atlas(spark):
    maps = spark.createDataFrame([m[:5] for m in MAPS], "map_ord long, west long, south long, width long, height long")
    runs = [(o, i // w, i % w, 1, c) for o, _, _, w, _, codes in MAPS for i, c in enumerate(codes)]
    return Atlas(maps, spark.createDataFrame(runs, "map_ord long, y long, x0 long, len long, code long"), 1, 1, bucket=4)


def rects(spark, atlas, wanted):
    got = {k: {} for k in range(len(wanted))}
    for r in atlas.rect_codes(spark.createDataFrame([(k, *w) for k, w in enumerate(wanted)], "rect_id long, x long, y long, w long, h long")).collect():
        got[r.rect_id][r.x, r.y] = r.code
    return got


def test_overlay(spark, atlas):
    want = {(11, 21, 2, 2): [1, 90, 8, 91], (10, 20, 1, 1): [1], (9, 19, 5, 5): [0, 0, 0, 0, 0, 0, 1, 2, 3, 4, 0, 2, 1, 90, 6, 0, 7, 8, 91, 12, 0, 9, 10, 13, 14], (13, 23, 3, 3): [14] + [0] * 8, (0, 0, 1, 1): [0], (10, 20, 0, 0): []}
    got = rects(spark, atlas, list(want))
    for k, ((x0, y0, w, h), codes) in enumerate(want.items()):
        assert [got[k][x0 + i % w, y0 + i // w] for i in range(w * h)] == codes
    points = spark.createDataFrame([(30, 40), (12, 21), (11, 21), (0, 0), (10, 20)], "x long, y long")
    codes = {(r.x, r.y): r.code for r in atlas.point_codes(points).collect()}
    assert codes == {(30, 40): 1, (12, 21): 5, (11, 21): 1, (0, 0): None, (10, 20): 1}


def test_rectangle_sweep(spark, atlas):
    wanted = [(x0 + 10, y0 + 20, w, h) for x0 in range(-2, 6) for y0 in range(-2, 6) for w in range(0, 6, 2) for h in range(0, 6)]
    got = rects(spark, atlas, wanted)
    for k, (x0, y0, w, h) in enumerate(wanted):
        assert set(got[k]) == {(x, y) for x in range(x0, x0 + w) for y in range(y0, y0 + h)}
        for (x, y), code in got[k].items():
            want = 0
            for _, west, south, mw, mh, codes in MAPS:
                if west <= x < west + mw and south <= y < south + mh:
                    want = codes[x - west + (y - south) * mw] or want
            assert code == want


def test_containers_keep_neighbours_apart(spark):
    rows = [(1, "a", "b", "c", "1"), (2, "a", "b", "c", "2"), (3, "a", "b", "d", ""), (4, "z", "b", "d", ""), (5, "a", "b", "d", "9")]
    c = x.containers(spark.createDataFrame(rows, "code long, l1 string, l2 string, l3 string, l4 string")).orderBy("depth", "ord").collect()
    assert [tuple(r) for r in c if r.depth == 1] == [(1, 0, "a", 0, 3), (1, 1, "z", 3, 1), (1, 2, "a", 4, 1)]
    assert [(r.name, r.leaf_count) for r in c if r.depth == 3] == [("c", 2), ("d", 1), ("d", 1), ("d", 1)]


def test_tree(spark):
    t = spark.createDataFrame([(1, '[["p",[["q",[["r",[["s"],["t"]]]]]]]]')], "tree_id long, json string")
    assert [list(r.parts) for r in x.tree_paths(t, 4).orderBy("path").collect()] == [["p", "q", "r", "s"], ["p", "q", "r", "t"]]
    with pytest.raises(Exception, match="ends above"):
        x.tree_paths(spark.createDataFrame([(1, '[["p"]]')], "tree_id long, json string"), 2).collect()


def brute_merge(texts, steps, candidates=64):
    rows, report = [list(t) for t in texts], []
    for k in range(steps):
        n, first = Counter(), {}
        for i, r in enumerate(rows):
            for p, pair in enumerate(zip(r, r[1:])):
                n[pair] += 1
                first.setdefault(pair, (i, p))
        top = sorted(n, key=lambda q: (-n[q], first[q]))[:candidates]
        gains = [(4 * n[q] - 8 * (1 + len("".join(q).encode())), n[q], *q) for q in top if len("".join(q).encode()) <= 32]
        best = max((c for c in gains if c[0] >= 1), default=None)
        if best is None:
            break
        out = []
        for r in rows:
            new, i = [], 0
            while i < len(r):
                if tuple(r[i : i + 2]) == best[2:]:
                    new.append(r[i] + r[i + 1])
                    i += 2
                else:
                    new.append(r[i])
                    i += 1
            out.append(new)
        rows = out
        report.append((k, best[2], best[3], best[1], best[0], sum(map(len, rows)), len({t for r in rows for t in r})))
    return rows, report


def texts_for_merging():
    rng = random.Random(3)
    odd = ["".join(rng.choice("aab") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    words = ["".join(rng.choice(["ab", "abc", "c", "bc", "a", "é", "cab"]) for _ in range(rng.randint(0, 14))) for _ in range(90)]
    names = [f"{rng.choice(['Customer', 'Supplier', 'Part'])}#{rng.randint(0, 9999):07d}" for _ in range(150)]
    return {"odd": odd, "words": words, "names": names}


@pytest.mark.parametrize("kind, candidates", [("odd", 64), ("words", 64), ("names", 64), ("words", 5), ("names", 9)])
def test_token_merging(spark, kind, candidates):
    """Rounds of several merges give what one merge at a time gives, whatever the number of candidates."""
    texts = texts_for_merging()[kind]
    codes = spark.createDataFrame(list(enumerate(texts)), "text_code long, text string")
    arrays, report = tm.optimize_tokens(codes, max_merge=14, cut_every=2, candidates=candidates)
    rows, want = brute_merge(texts, 14, candidates)
    got = report.orderBy("step").collect()
    assert [(r.step, r.left, r.right, r.n, r.gain, r.tokens, r.distinct_tokens) for r in got] == want and len(got) > 3
    assert all(r.merged == r.left + r.right and r.before_bytes is None and r.after_bytes is None for r in got)
    assert [list(r.tokens) for r in arrays.orderBy("text_code").collect()] == rows


def test_merges_of_a_round():
    pair = lambda a, b, n, gain, rank=1: tm.Candidate(a, b, n, gain, rank)
    far = [pair("a", "b", 90, 300), pair("c", "d", 80, 280, 2), pair("b", "e", 70, 240, 3)]
    assert tm.safe_prefix(far, 64, 0) == far[:2]  # the third has the first one's right part
    assert tm.safe_prefix(far, 64, 0, {"ab"}) == far[:1]  # its token is there already
    assert tm.safe_prefix(far, 64, 79) == far[:1]  # a pair from outside could gain more
    assert tm.safe_prefix(far, 1, 0) == far[:1] and tm.safe_prefix([], 64, 0) == []
    assert tm.safe_prefix([pair("a", "a", 90, 300), pair("a", "b", 85, 290)], 64, 0) == [pair("a", "a", 90, 300)]
    assert tm.safe_prefix([pair("a", "a", 90, 300), far[1]], 64, 0) == [pair("a", "a", 90, 300), far[1]]
    assert tm.safe_prefix([pair("a", "bc", 90, 300), pair("ab", "c", 80, 280, 2), pair("x", "y", 70, 240, 3)], 64, 0) == [pair("a", "bc", 90, 300), pair("ab", "c", 80, 280, 2)]


def test_runs_of_one_token(spark):
    """The pair of a merged pair of runs may gain more than the pair that was second."""
    double, other = tm.Candidate("0", "0", 90, 300, 1), tm.Candidate("u", "s", 50, 139, 2)
    assert tm.safe_prefix([double, other], 64, 0) == [double]
    texts = ["0" * (3 + k % 9) + ["us", "su", "usu"][k % 3] for k in range(60)]
    got = tm.optimize_tokens(spark.createDataFrame(list(enumerate(texts)), "text_code long, text string"), max_merge=5)[1].orderBy("step").collect()
    want = brute_merge(texts, 5)[1]
    assert [(r.step, r.left, r.right, r.n, r.gain, r.tokens, r.distinct_tokens) for r in got] == want and [r[1:3] for r in want[:2]] == [("0", "0"), ("00", "00")]


def test_sizes_of_all_steps(spark):
    """The report's bytes are those of each step's own model."""
    texts = texts_for_merging()["words"]
    codes = spark.createDataFrame(list(enumerate(texts)), "text_code long, text string")
    got = tm.optimize_tokens(codes, max_merge=6, sizes=True)[1].orderBy("step").collect()
    assert len(got) == 6 and all(a.after_bytes == b.before_bytes for a, b in zip(got, got[1:]))
    for k in (0, 3, 6):
        arrays = tm.optimize_tokens(codes, max_merge=k)[0]
        assert tm.model_size(arrays) == (got[k].before_bytes if k < 6 else got[5].after_bytes)


def test_token_merging_to_its_end(spark):
    from loomgrid.plans import lexicon_queries as q

    sf = "/root/testdata/sf0.001"
    texts = [r["text"] for r in q.codes(spark, sf).orderBy("text_code").collect()]
    want = brute_merge(texts, 1000)[1]
    assert 5 < len(want) < 1000
    got = q.lex_bpe_report(spark, sf).orderBy("step").collect()
    assert [(r.step, r.left, r.right, r.n, r.gain, r.tokens, r.distinct_tokens) for r in got] == want
    assert got[-1].after_bytes < got[0].before_bytes and all(a.after_bytes == b.before_bytes for a, b in zip(got, got[1:]))
    assert tm.optimize_tokens(spark.createDataFrame([], "text_code long, text string"))[1].count() == 0


def test_page_palette():
    writes = tm._page_slots([[1, 2], [3, 2], [4]])
    assert writes == [(-1, 1, 1), (-1, 2, 2), (-1, 3, 3), (-1, 4, 4)]
    rng = random.Random(1)
    records = [[rng.randrange(30) for _ in range(5)] for _ in range(60)]
    slots, decoded, writes = {}, [], tm._page_slots(records)
    stream = [t for r in records for t in [*r, None]]
    later = {at: (t, s) for at, t, s in writes if at >= 0}
    slots = {s: t for at, t, s in writes if at < 0}
    for i, t in enumerate(stream):
        if i in later:
            slots[later[i][1]] = later[i][0]
        assert t is None or t in slots.values()
        decoded.append(t)
    assert decoded == stream and len(slots) <= tm.SLOTS


def test_options():
    with pytest.raises(ValueError):
        v.Edge(width=0)
    with pytest.raises(ValueError):
        v.checked((0, 0, 300, 0))


def test_negative_size_is_an_error(spark):
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(g.anchored(F.lit(1), F.lit(1), F.lit(-1), F.lit(1), F.lit("CENTER"))).collect()


def test_translucent_over(spark):
    schema = "img_x long, img_y long, r int, g int, b int, a int"
    bottom = spark.createDataFrame([(0, 0, 100, 100, 100, 255)], schema)
    top = spark.createDataFrame([(0, 0, 200, 0, 50, 128)], schema)
    assert tuple(v.over(bottom, top).first())[2:] == (150, 50, 75, 255)


def test_stream(spark, tmp_path, atlas):
    from pyspark.sql import functions as F

    from loomgrid.streaming.points import name_stream, read_points

    rows = spark.createDataFrame([(1, 30.0, 40.0), (2, 0.0, 0.0), (3, 12.0, 21.0)], "event_id long, lon double, lat double").withColumn("ts", F.lit(None).cast("timestamp"))
    rows.select("event_id", "ts", "lon", "lat").write.parquet(str(tmp_path / "in"))
    paths = spark.createDataFrame([(1, "a", "", "", "b"), (5, "c", "d", "", "")], "code long, l1 string, l2 string, l3 string, l4 string")
    q = name_stream(read_points(spark, str(tmp_path / "in")), atlas, paths, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.event_id: (r.code, r.place) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (1, "a / b"), 2: (None, "(not found)"), 3: (5, "c / d")}
