import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from brute import SPACE
from pyspark.sql import functions as F

from loomgrid.llm.mixture import STEPS, hypergeometric, mix_sources, mixed_texts, shuffled, split_quotas, taken, to_left


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while True:
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if part[s] > most * sizes[s]]
        if not over:
            return {**target, **part}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.discard(s)


def brute_taken(rows, block):
    """Word by word, block by block."""
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    target = brute_targets(sizes)
    got = Counter()
    for no, s in enumerate(sorted(sizes, key=lambda s: (s is None, s))):
        own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n) for i, x, n in rows if x == s)
        stream = [i for _, i, n in own for _ in range(n)]
        blocks = [stream[k : k + block] for k in range(0, len(stream), block)]
        left, nb = int(target[s]), len(blocks)
        for turn in range(3):
            step = next((p for p in STEPS[turn % 3 :] + STEPS[: turn % 3] if nb and p % nb), 0)
            at = {(0 if nb == 1 else (step % nb * k + no * 7919 + turn * 104729) % nb): k for k in range(nb)}
            for k in range(nb):
                part = blocks[at[k]][:left]
                got.update(part)
                left -= len(part)
        assert left == 0
    return sizes, target, got


def docs_of(spark, rows):
    return spark.createDataFrame([(i, s, None if n is None else " \t".join(f"w{k}" for k in range(n)), "x") for i, s, n in rows], "doc_id long, source string, text string, size string")


def some_rows(seed, n=400):
    rng = random.Random(seed)
    names = ["a", "b", "é", None, "zz", "", "hot"]
    return [(i, "hot" if rng.random() < 0.4 else rng.choice(names), rng.choice([0, 1, 3, 20, rng.randint(0, 300)])) for i in range(n)]


@pytest.mark.parametrize("block, seed", [(64, 1), (7, 2), (100_000, 3)])
def test_against_plain_version(spark, block, seed):
    rows = some_rows(seed)
    sizes, target, want = brute_taken(rows, block)
    got = {r.doc_id: r for r in taken(docs_of(spark, rows), block=block, shard_words=900).collect()}
    assert len(got) == len(rows)
    for i, s, n in rows:
        r = got[i]
        assert (r["size"], r.source_size, r.taken) == (n, sizes[s], want[i]) and math.isclose(r.target, target[s], rel_tol=1e-12) and r.taken <= 2 * n


def test_quota_and_shards(spark):
    """Each source gives its target; each shard has its blocks; every draw lies in one shard."""
    rows = some_rows(4)
    mix = mix_sources(docs_of(spark, rows), block=16, shard_words=500, carry=("text",))
    q = mix.quotas.collect()
    sources = {r.no: r for r in mix.sources.collect()}
    by_shard, by_source = Counter(), defaultdict(list)
    for r in q:
        by_shard[r.shard] += r.blocks
        by_source[r.no] += range(r.first, r.first + r.blocks)
    assert len(by_shard) > 20 and max(by_shard.values()) - min(by_shard.values()) <= 1
    assert all(sorted(by_source[no]) == list(range(s.draws)) for no, s in sources.items())
    words = Counter()
    for r in mix.pieces.collect():
        words[r.no] += r.words
    assert all(words[no] == int(s.target) for no, s in sources.items())
    texts = mixed_texts(mix).collect()
    assert sum(len(SPACE.findall(r.text)) for r in texts) == sum(words.values())
    order = defaultdict(list)
    for r in shuffled(mix).collect():
        order[r.shard].append(r.order)
    assert all(sorted(v) == list(range(len(v))) for v in order.values())
    again = mix_sources(docs_of(spark, rows).repartition(3), block=16, shard_words=500)
    assert sorted(map(str, again.quotas.collect())) == sorted(map(str, q))


def exact(good, bad, m):
    return {k: math.comb(good, k) * math.comb(bad, m - k) / math.comb(good + bad, m) for k in range(max(0, m - bad), min(good, m) + 1)}


@pytest.mark.parametrize("good, bad, m", [(5, 7, 6), (40, 3, 20), (1, 0, 1), (0, 9, 4), (300, 700, 400), (9, 9, 18), (9, 9, 0)])
def test_draws_follow_the_distribution(spark, good, bad, m):
    n = 20_000
    u = spark.range(n).select(((F.col("id") + 0.5) / n).alias("u"))
    got = Counter(r[0] for r in u.select(hypergeometric(F.lit(good), F.lit(bad), F.lit(m), F.col("u"))).collect())
    for k, p in exact(good, bad, m).items():  # u on an even grid: counts are the probabilities but for one at each edge
        assert abs(got[k] - p * n) <= 2, (k, got[k], p * n)


def test_split_of_three_sources(spark):
    n = 6000
    r = spark.range(n).select(to_left(F.array(F.lit(3), F.lit(2), F.lit(4)).cast("array<bigint>"), F.lit(4).cast("long"), 5, F.col("id"), F.lit(0).cast("long")).alias("x")).collect()
    got = Counter(tuple(x.x) for x in r)
    for a in range(4):
        for b in range(3):
            c = 4 - a - b
            p = math.comb(3, a) * math.comb(2, b) * math.comb(4, c) / math.comb(9, 4) if 0 <= c <= 4 else 0
            assert abs(got[a, b, c] - n * p) <= 5 * math.sqrt(n * p + 1), (a, b, c)


def test_large_counts(spark):
    s = spark.createDataFrame([(0, 10**9), (1, 5), (2, 3 * 10**9)], "no long, draws long")
    got = split_quotas(s, 3, 1).collect()
    assert sum(r.blocks for r in got) == 4 * 10**9 + 5
    for r in got:
        if r.no == 2:
            assert abs(r.blocks - 10**9) < 10**5


def test_many_shards(spark):
    s = spark.createDataFrame([(0, 3000), (1, 1000)], "no long, draws long")
    got = split_quotas(s, 1500, 1)
    assert got.agg(F.sum("blocks")).first()[0] == 4000 and got.select("shard").distinct().count() == 1500


def test_nulls_and_empty(spark):
    rows = [(None, None, 5), (None, None, 5), (3, "a", None), (3, "a", None), (4, "b", 0)]
    got = sorted(map(str, taken(docs_of(spark, rows)).collect()))
    assert len(got) == 5 and sum("size=5, source_size=10, target=15.0" in r for r in got) == 2
    assert sum(r.taken for r in taken(docs_of(spark, rows)).collect()) == 15
    assert taken(docs_of(spark, [(1, "a", 0)])).collect()[0].taken == 0
    assert taken(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_long_text(spark):
    rows = [(1, "a", 100_000), (2, "b", 10)]
    got = {r.doc_id: r.taken for r in taken(docs_of(spark, rows), shard_words=20_000).collect()}
    assert got == {1: 149_995, 2: 20}
