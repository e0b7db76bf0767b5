"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text's set of word shingles gets a digest and a MinHash signature. Texts of equal sets are one node from here on.
2. Bands of the signature deal nodes into buckets; only buckets of two nodes or more go on.
3. In each bucket, in blocks of bounded size, nodes are compared with some of the block by batches of the signature; after
   each batch a pair is dropped if its posterior chance of reaching the similarity is under the miss probability. Each
   node's best surviving pair is verified on the full sets, and verified links are joined into components; then the best
   surviving pair of each two components, twice.
4. In buckets that still hold nodes of several components, a node stays if one of its rarest shingles, just over a
   quarter of them, is among the rarest of another component: similar sets share one of these, so unlike texts that meet
   in a bucket go, however many they are. Nodes that stay are compared across components, those of the commonest component
   against the others and the others among themselves, by the shingles themselves (their 32-bit hashes, with room for
   collisions), in blocks of bounded nodes and shingles, so a large set stands in a smaller block and is compared in
   the same way. A pair that is sure to reach the similarity stands for all of its two components in a block. What is found is verified on the full sets, each node's
   best first, then all that are still across components, and components are taken again. A link inside a component
   changes nothing, so no pair that could matter is left out.

Pruning by signatures, and bands that miss a pair, are where the method may lose a link: each with the chosen
probability. No link is made without the full sets.

Defined results: null or wordless texts have an empty set, link with nothing and stay; a repeated row takes part with
its own doc_id; a null doc_id never is the smallest, and is kept only where its component has no other id; other columns
are dropped, also those named like a result; an empty table gives no rows. A very long text is one slice of its own; its shingles are in memory at once.
Which of equally good matches is verified first doesn't change components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_since, gathered, made, materialize, partitions_for, tidy
from .components import components
from .shingles import digest, sets, shingle_hashes

BATCH = 32
#: Nodes of a block that the others are compared with.
PIVOTS = 8
#: Shingles of a block in the comparison across components.
BLOCK_SHINGLES = 1 << 21
#: Slots in which shingles are counted.
SLOTS = 1 << 20
#: Two sets' 32-bit hashes may lose or gain this much of their intersection by collisions.
ROOM = 2


def permutations(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signatures(h: np.ndarray, offs: np.ndarray, hashes: int) -> np.ndarray:
    """rows x hashes of minima (uint32); rows without shingles hold the largest value."""
    n = len(offs) - 1
    out = np.full((n, hashes), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offs))
    if not len(full):
        return out
    a, b = permutations(hashes)
    x = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32)
    starts = offs[full]
    for k in range(hashes):
        out[full, k] = np.minimum.reduceat(x * a[k] + b[k], starts)
    return out


def least_matches(threshold: float, hashes: int, miss: float) -> np.ndarray:
    """By hashes compared: the matches under which the posterior (uniform prior) of threshold or more is below miss.

    Signatures are compared by their low bytes, which match by chance once in 256.
    """
    x = threshold + (1 - threshold) / 256
    out = np.zeros(hashes + 1, np.int64)
    for n in range(1, hashes + 1):
        below = 0.0
        for m in range(n + 1):
            # the chance that a Beta(m + 1, n - m + 1) variable is x or more
            below += math.comb(n + 1, m) * x**m * (1 - x) ** (n + 1 - m)
            if below >= miss:
                out[n] = m
                break
    return out


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs survive every batch, and their matches."""
    alive, got = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k in range(0, sig.shape[1], BATCH):
        part = sig[:, k : k + BATCH]
        got[alive] += (part[a[alive]] == part[b[alive]]).sum(1)
        alive = alive[got[alive] >= least[min(k + BATCH, sig.shape[1])]]
        if not len(alive):
            break
    return alive, got[alive]


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that lie next to each other by their first `keys` columns; and the groups' n + 1 offsets."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) < 20_000:
            continue
        whole = pa.Table.from_batches(held)
        edges = _edges(whole, keys)
        if len(edges) > 2:
            yield whole.slice(0, int(edges[-2])), edges[:-1]
            held = whole.slice(int(edges[-2])).to_batches()
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, _edges(whole, keys)


def _edges(t: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in range(keys):
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def _sig(t: pa.Table) -> np.ndarray:
    col = t["sig"].combine_chunks().cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    return np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(len(col), -1)


def _pairs(t: pa.Table, a: np.ndarray, b: np.ndarray, got: np.ndarray) -> pa.RecordBatch:
    node = t["node"].combine_chunks()
    return pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b)), pa.array(got)], ["a", "b", "got"])


def across(t: pa.Table, edges: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of different roots within each group of rows that may be similar enough."""
    root = t["root"].combine_chunks().dictionary_encode().indices.to_numpy()
    n = t["n"].to_numpy()
    own = t["own"].combine_chunks()
    offs = np.concatenate([[0], np.cumsum(pc.list_value_length(own).to_numpy(zero_copy_only=False))]).astype(np.int64)
    tokens = own.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    for x, y in zip(edges[:-1], edges[1:]):
        if y - x < 2 or (root[x:y] == root[x]).all():
            continue
        a, b, inter = intersections(tokens, offs, np.arange(x, y), root, n, percent)
        sure = 100 * (inter - ROOM) >= percent * (n[a] + n[b] - inter + ROOM)
        got = (inter * 1_000_000 // np.maximum(n[a] + n[b] - inter, 1)).astype(np.int64)
        # of sure pairs the best of each two roots goes on; the others go on as they are
        pair = np.minimum(root[a], root[b]).astype(np.int64) * (len(root) + 1) + np.maximum(root[a], root[b])
        order = np.lexsort((-got, pair, ~sure))
        first = np.append(True, (pair[order][1:] != pair[order][:-1]) | (sure[order][1:] != sure[order][:-1]))[: len(order)]
        keep = order[first | ~sure[order]]
        if len(keep):
            yield _pairs(t, a[keep], b[keep], got[keep])


def intersections(tokens: np.ndarray, offs: np.ndarray, rows: np.ndarray, root: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, size of the intersection) of rows of different roots whose sets may be similar enough; all pairs are counted."""
    none = np.zeros(0, np.int64)
    if len(rows) < 2:
        return none, none, none
    size = offs[rows + 1] - offs[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offs[rows], size)
    values, column, df = np.unique(tokens[at], return_inverse=True, return_counts=True)
    keep = df[column] > 1  # what one set alone holds meets nothing
    owner, column = owner[keep], column[keep]
    used = np.flatnonzero(df > 1)
    place = np.full(len(values), -1)
    place[used] = np.arange(len(used))
    column = place[column]
    common = np.zeros((len(rows), len(rows)), np.float32)
    for c in range(0, len(used), 4096):
        part = (column >= c) & (column < c + 4096)
        m = np.zeros((len(rows), min(4096, len(used) - c)), np.float32)
        m[owner[part], column[part] - c] = 1
        common += m @ m.T
    own, r = n[rows], root[rows]
    room = common + ROOM
    a, b = np.nonzero(np.triu((percent * (own[:, None] + own[None, :] - room) <= 100 * room) & (r[:, None] != r[None, :]) & (common > 0), 1))
    return rows[a], rows[b], common[a, b].astype(np.int64)


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 75, bands: int = 26, rows: int = 4, hashes: int = 512, miss: float = 1e-5, block: int = 512, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. Bands use the first bands * rows hashes; the comparison uses a byte of all."""
    mark, n_parts = made(), partitions_for(docs)
    least = least_matches(percent / 100, hashes, miss)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, most=2 << 20):
            h, offs = shingle_hashes(part["text"].combine_chunks(), shingle)
            sig = signatures(h, offs, hashes)
            own = [np.unique(h[a:b]) for a, b in zip(offs[:-1], offs[1:])]
            some = [len(x) > 0 for x in own]
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"].combine_chunks().cast(pa.int64()),
                    part["text_key"].combine_chunks(),
                    pa.array([len(x) for x in own], pa.int64()),
                    pa.array([digest(x) if s else None for x, s in zip(own, some)], pa.binary()),
                    pa.array([sig[i, : bands * rows].tobytes() if s else None for i, s in enumerate(some)], pa.binary()),
                    pa.array([sig[i].astype(np.uint8).tobytes() if s else None for i, s in enumerate(some)], pa.binary()),
                ],
                ["doc_id", "text_key", "n_shingles", "node", "bands", "sig"],
            )

    signed = materialize(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(tidy(sign), "doc_id long, text_key long, n_shingles long, node binary, bands binary, sig binary"), "signed")
    some = signed.where(F.col("node").isNotNull())

    keys = F.array(*[F.xxhash64(F.substring("bands", 4 * rows * k + 1, 4 * rows), F.lit(k)) for k in range(bands)])
    dealt = some.select("node", F.explode(keys).alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket")
    members = dealt.join(shared, "bucket").distinct()
    nodes = some.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key")).alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
    held = materialize(members.join(nodes, "node").select("bucket", "node", F.col("rep.doc_id").alias("rep"), "rep.text_key", "sig", "size"), "buckets")

    sizes = held.groupBy("bucket").agg(F.ceil(F.count("node") / block).cast("int").alias("blocks"))

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in groups_of(batches, 2):
            size = np.diff(edges)
            place = np.arange(t.num_rows) - np.repeat(edges[:-1], size)
            a = np.concatenate([np.flatnonzero(place > p) for p in range(PIVOTS)])
            b = np.concatenate([np.flatnonzero(place > p) - place[place > p] + p for p in range(PIVOTS)])
            alive, got = surviving(_sig(t), a, b, least)
            a, b = a[alive], b[alive]
            order = np.lexsort((-got, a))  # the best of each node
            a, b, got = a[order], b[order], got[order]
            best = np.append(True, a[1:] != a[:-1])[: len(a)]
            yield _pairs(t, a[best], b[best], got[best])

    def order(part: DataFrame, *cols: str) -> DataFrame:
        # the first of a block is the one that all are compared with; which it is differs by bucket
        return part.repartition(n_parts, *cols).sortWithinPartitions(*cols, F.xxhash64("node", "bucket"), "node")

    blocked = held.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    stars = order(blocked.select("bucket", "block", "node", "sig"), "bucket", "block").mapInArrow(tidy(star), "a binary, b binary, got long")
    stars = materialize(stars, "stars")
    texts = _texts(held, docs, shingle)
    best = stars.groupBy("a").agg(F.max(F.struct("got", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    links = materialize(verify(best, texts, shingle, percent), "links")
    roots = components(links)
    for _ in range(2):  # what the stars know between components, the best of each two
        far = apart(stars, roots)
        pair = far.groupBy(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")).agg(F.max(F.struct("got", "a", "b")).alias("m")).select("m.a", "m.b")
        more = materialize(verify(pair, texts, shingle, percent), "links")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        roots = components(links)

    rooted = held.join(roots, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    counted = rooted.groupBy("bucket", "root").agg(F.count("node").alias("n"), F.sum("size").alias("size"))
    split = counted.groupBy("bucket").agg(F.max(F.struct("n", "root", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("root").alias("roots")).where("roots > 1")

    def blocks_of(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / block, size / block_shingles)).cast("int")

    split = split.select("bucket", "roots", F.col("top.root").alias("top"), blocks_of(F.col("top.n"), F.col("top.size")).alias("top_blocks"), blocks_of(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("blocks"))
    mixed = materialize(rooted.join(split, "bucket"), "split")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, most=2 << 20):
            own = sets(part["text"].combine_chunks(), shingle)
            small = [np.unique(x.astype(np.uint32)).view(np.int32) for x in own]
            yield pa.RecordBatch.from_arrays([part["node"].combine_chunks(), pa.array([len(x) for x in own], pa.int64()), pa.array(small, pa.list_(pa.int32()))], ["node", "n", "own"])

    shown = texts.join(mixed.select("node").distinct(), "node").select("node", "text").mapInArrow(tidy(short), "node binary, n long, own array<int>").dropDuplicates(["node"])
    shown = materialize(shown, "shown")
    near = sharing(mixed.select("root", "node").distinct(), shown, percent)
    mixed = materialize(mixed.join(near, "node", "left_semi").join(shown, "node"), "mixed")
    carried = ["root", "node", "n", "own"]
    in_top = F.col("root") == F.col("top")
    mine = F.xxhash64("node")
    # sides: the commonest component's blocks each meet all others' blocks; others' blocks meet each other
    top_rows = mixed.where(in_top).withColumn("i", F.pmod(mine, F.col("top_blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.lit(0).alias("kind"), "i", "j", *carried)
    others = mixed.where(~in_top).withColumn("me", F.pmod(mine, F.col("blocks")).cast("int"))
    to_top = others.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("top_blocks") - 1))).select("bucket", F.lit(0).alias("kind"), "i", F.col("me").alias("j"), *carried)
    to_others = others.where("roots > 2").withColumn("you", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.lit(1).alias("kind"), F.least("me", "you").alias("i"), F.greatest("me", "you").alias("j"), *carried)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in groups_of(batches, 4):
            yield from across(t, edges, percent)

    crossing = top_rows.unionByName(to_top).unionByName(to_others)
    found = order(crossing, "bucket", "kind", "i", "j").mapInArrow(tidy(cross), "a binary, b binary, got long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "got").distinct()
    found = materialize(found, "crossing")
    if not found.isEmpty():
        ends = found.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "a", "b", "got"), F.struct(F.col("b").alias("node"), "a", "b", "got"))).alias("e")).select("e.*")
        first = ends.groupBy("node").agg(F.max(F.struct("got", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
        links = links.unionByName(materialize(verify(first, texts, shingle, percent), "links"))
        roots = components(links)
        far = apart(found, roots).select("a", "b").join(first, ["a", "b"], "left_anti")
        more = materialize(verify(far, texts, shingle, percent), "links")
        if not more.isEmpty():
            roots = components(links.unionByName(more))

    classes = some.groupBy("node").agg(F.min("doc_id").alias("doc")).join(roots, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    named = classes.groupBy("root").agg(F.min("doc").alias("component_id")).join(classes, "root").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    out = materialize(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "classes")
    return drop_since(mark, out).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def sharing(rooted: DataFrame, shown: DataFrame, percent: int) -> DataFrame:
    """(node) of those that may be similar to a node of another root.

    rooted: root, node. shown: node, n, own (32-bit shingles). Of two sets as similar as asked,
    each shares at least percent of its own with the other; so, in any one order of shingles, one of the first
    n - percent of n + 1 of each is common to both (with room for collisions). The order is by how many sets hold a
    shingle, counted in SLOTS slots of a hash: a number for each slot comes to the driver, at any input size.
    """
    slots = shown.select(F.explode("own").alias("token")).groupBy(F.pmod("token", F.lit(SLOTS)).alias("slot")).agg(F.count(F.lit(1)).alias("sets")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[slots["slot"].to_numpy()] = slots["sets"].to_numpy()
    sent = shown.sparkSession.sparkContext.broadcast(counts)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for batch in batches:
            own = batch.column(2)
            size = np.diff(own.offsets.to_numpy())
            tokens = own.flatten().to_numpy(zero_copy_only=False)
            sets_ = often[tokens % SLOTS]
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((tokens, sets_, row))
            n = batch.column(1).to_numpy()
            first = n + 1 + ROOM - -(-percent * n // 100)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            # a shingle of one set alone has its place in the order, but can't be shared
            keep = order[(place < np.repeat(first, size)) & (sets_[order] > 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[keep])), pa.array(tokens[keep], pa.int32())], ["node", "token"])

    placed = shown.select("node", "n", "own").mapInArrow(tidy(rarest), "node binary, token int").join(rooted, "node")
    met = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return placed.join(met, "token", "left_semi").select("node").distinct()


def _texts(held: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, text) of the nodes in shared buckets, each from the first of its documents. Rows that repeat a text without an id come once."""
    wanted = held.select("node", F.col("rep").alias("id"), F.col("text_key").alias("key")).distinct()
    source = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), "text")
    without = source.where(F.col("id").isNull()).groupBy("key").agg(F.first("text").alias("text"))
    joined = source.join(wanted, ["id", "key"]).select("node", "text").unionByName(without.join(wanted.where(F.col("id").isNull()), "key").select("node", "text"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, most=2 << 20):
            node = part["node"].to_pylist()
            keep = [digest(s) == n for s, n in zip(sets(part["text"].combine_chunks(), shingle), node)]
            yield from part.filter(pa.array(keep)).to_batches()

    return materialize(joined.mapInArrow(tidy(own), "node binary, text string"), "texts")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of pairs (a, b, ...) whose nodes are in different components, with their roots ra and rb."""
    ra, rb = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    j = pairs.join(ra, "a", "left").join(rb, "b", "left").withColumn("ra", F.coalesce("ra", "a")).withColumn("rb", F.coalesce("rb", "b"))
    return j.where(F.col("ra") != F.col("rb"))


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose full sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, "ta", 1 << 20):
            left, right = (sets(part[c].combine_chunks(), shingle) for c in ("ta", "tb"))
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)]
            keep = [100 * n >= percent * (len(x) + len(y) - n) for n, x, y in zip(both, left, right)]
            yield from part.select(["a", "b"]).filter(pa.array(keep)).to_batches()

    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(tidy(check), "a binary, b binary").distinct()
