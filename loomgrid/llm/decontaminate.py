"""Benchmark decontamination by an FM-index of each training shard.

A shard is some MB of documents in one task. Its words become symbols: a benchmark word has its own, and any run of other
words, like a document's edge, is one separator no phrase can cross. Suffixes up to their separator are sorted by
Larsson-Sadakane refinement, the transformed text goes into a wavelet matrix, and all test phrases are searched backward
at once by its ranks. Occurrences are located by walking back to sampled suffix positions; their spans of words merge.

Documents aren't shuffled. The benchmark is the query set: it is sent whole while it is under block_bytes of text, and
otherwise in hash blocks of that size, each searched in all documents. Documents are then written once with a key, and
what the blocks find is merged by it.

Defined results: a null or wordless text has no words, no hits and is clean; null or wordless items have no windows; a
repeated item id counts once and a null one is the empty string; repeated documents each get a row; null doc_id stays
null; other columns are dropped, also those named like a result; an empty table gives no rows, an empty benchmark no hits. A very long text is a shard of its own. Windows that
several items share are hits of each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import AT_END, gathered, materialize, text_bytes, tidy, word_hashes

WINDOW = 13
SAMPLE = 16
_WORD = np.ones(256, bool)
_WORD[0:48] = _WORD[58:97] = _WORD[123:128] = False
_PRIME = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: list[np.ndarray] = []
AT_END.append(_powers.clear)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a fixed odd number and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = -(-n // (1 << 18)) << 18
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)])) for base in (np.uint64(_PRIME), np.uint64(pow(_PRIME, -1, 1 << 64)))]
    return _powers[0][:n], _powers[1][:n]


class Vocabulary:
    """Word hash to number, from 1; 0 for other words."""

    BITS = 18

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        slot = (self.hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        self.tables = []
        for k in range(int(nth.max(initial=-1)) + 1):
            t = np.zeros(1 << self.BITS, np.int32)
            t[slot[nth == k]] = np.flatnonzero(nth == k) + 1
            self.tables.append(t)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.zeros(len(h), np.int32)
        known = np.concatenate([np.zeros(1, np.uint64), self.hashes])
        for t in self.tables:
            at = t[slot]
            np.copyto(out, at, where=(at > 0) & (known[at] == h))
        return out


class FMIndex:
    """Of symbols (0 separates; the last is 0). Equal suffixes up to a separator keep the order of their positions."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.symbols, n = symbols, len(symbols)
        self.bits = max(1, int(sigma).bit_length())
        seps = np.flatnonzero(symbols == 0)
        first = np.flatnonzero(symbols)
        suffixes = self._sorted(first, seps)
        sa = np.concatenate([seps, suffixes])
        self.start = np.zeros(sigma + 2, np.int64)
        self.start[1:] = np.cumsum(np.bincount(symbols, minlength=sigma + 1))
        self.bwt = np.where(sa > 0, symbols[sa - 1], 0).astype(np.int32)
        self.sampled = np.where((sa % SAMPLE == 0) | (self.bwt == 0), sa, -1)
        self.levels = []
        a = self.bwt
        for k in range(self.bits - 1, -1, -1):
            b = ((a >> k) & 1).astype(bool)
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            self.levels.append((k, n - int(ones[-1]), ones))
            a = np.concatenate([a[~b], a[b]])

    def _sorted(self, first: np.ndarray, seps: np.ndarray) -> np.ndarray:
        """Larsson-Sadakane: sort by a few symbols, then refine only groups still tied, by the ranks h symbols on."""
        s = self.symbols
        if not len(first):
            return first
        length = seps[np.searchsorted(seps, first)] - first  # symbols before the separator
        place = max(1, (len(first) - 1).bit_length())
        take = max(1, (64 - place) // self.bits)
        key = np.zeros(len(first), np.uint64)
        for j in range(take):
            at = np.minimum(first + j, len(s) - 1)
            key = (key << np.uint64(self.bits)) | np.where(j < length, s[at], 0).astype(np.uint64)
        packed = np.sort((key << np.uint64(place)) | np.arange(len(first), dtype=np.uint64))
        order = (packed & np.uint64((1 << place) - 1)).astype(np.int64)
        key = packed >> np.uint64(place)
        new = np.ones(len(order), bool)
        new[1:] = key[1:] != key[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        sa, rank = first[order], np.zeros(len(s), np.int64)
        rank[sa] = head + 1
        left = length[order]
        alone = new & np.append(new[1:], True)
        # a suffix of just h symbols is active too: it goes before the longer ones it ties with
        active, h = np.flatnonzero(~alone & (left >= take)), take
        while len(active):
            at = sa[active]
            group = rank[at]
            after = np.where(left[active] > h, rank[np.minimum(at + h, len(s) - 1)], 0)
            by = np.lexsort((after, group))
            sa[active], left[active] = at[by], left[active][by]
            group, after = group[by], after[by]
            new = np.ones(len(active), bool)
            new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))
            rank[sa[active]] = active[head] + 1
            alone = new & np.append(new[1:], True)
            h *= 2
            active = active[~alone & (left[active] >= h)]
        return sa

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c among the first i of the transformed text."""
        low, high = np.zeros_like(i), i
        for k, zeros, ones in self.levels:
            bit = ((c >> k) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) that begin with each pattern; a pattern is right-aligned in its row."""
        q, width = patterns.shape
        low, high = np.zeros(q, np.int64), np.full(q, len(self.bwt), np.int64)
        live = np.arange(q)
        for step in range(width):
            live = live[(sizes[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            c = patterns[live, width - 1 - step].astype(np.int64)
            both = self.rank(np.concatenate([c, c]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = self.start[c] + both[: len(live)], self.start[c] + both[len(live) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.full(len(rows), -1, np.int64), 0
        live, at = np.arange(len(rows)), rows.copy()
        while len(live):
            found = self.sampled[at]
            done = found >= 0
            out[live[done]] = found[done] + steps
            live, at = live[~done], at[~done]
            c = self.bwt[at].astype(np.int64)
            at = self.start[c] + self.rank(c, at)
            steps += 1
        return out


@dataclass(frozen=True)
class Phrases:
    """The windows of a block of items, distinct, as numbers of vocabulary words."""

    vocabulary: Vocabulary
    patterns: np.ndarray
    sizes: np.ndarray
    item_first: np.ndarray
    item_of: np.ndarray
    names: np.ndarray


def phrases(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases | None:
    """items: (name, text)."""
    raw, offs = text_bytes(pa.array([t for _, t in items], pa.string()))
    if not len(raw):
        return None
    h, rows = word_hashes(raw, offs, _WORD)
    if not len(h):
        return None
    vocabulary = Vocabulary(h)
    numbers = vocabulary.numbers(h)
    names, item = np.unique(np.array([n for n, _ in items], object), return_inverse=True)
    n_words = np.diff(rows)
    count = np.where(n_words > 0, np.maximum(n_words - window + 1, 1), 0)
    first = ranges(rows[:-1], count)
    size = np.repeat(np.minimum(n_words, window), count)
    owner = np.repeat(item, count)
    patterns = np.zeros((len(first), window), np.int32)
    for k in range(window):  # from the right; short items leave the left empty
        has = size > k
        patterns[has, window - 1 - k] = numbers[(first + size - 1 - k)[has]]
    _, kept, which = np.unique(np.ascontiguousarray(patterns).view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
    pairs = np.unique(which * np.int64(len(names)) + owner)
    item_first = np.searchsorted(pairs // len(names), np.arange(len(kept) + 1))
    return Phrases(vocabulary, patterns[kept], size[kept], item_first, pairs % len(names), names)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def scan(column: pa.Array, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row; then (row, first word, words) of its merged spans; then (row, item) of its items."""
    raw, offs = text_bytes(column)
    n = len(offs) - 1
    none = np.zeros(0, np.int64)
    if not len(raw):
        return np.zeros(n, np.int64), none, none, none, none, none
    h, rows = word_hashes(raw, offs, _WORD)
    del raw
    numbers = p.vocabulary.numbers(h)
    # a separator before each document, then one for each run of foreign words
    stream = np.insert(numbers, rows[:-1], 0)
    word = np.insert(np.arange(len(numbers)), rows[:-1], -1)
    keep = stream > 0
    keep[1:] |= stream[:-1] > 0
    keep[0] = True
    symbols, word = np.append(stream[keep], 0), np.append(word[keep], -1)
    index = FMIndex(symbols, len(p.vocabulary.hashes))
    low, high = index.search(p.patterns, p.sizes)
    hit = np.flatnonzero(high > low)
    size = (high - low)[hit]
    at = word[index.locate(ranges(low[hit], size))]
    which = np.repeat(hit, size)
    row = np.searchsorted(rows, at, "right") - 1
    cover = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + p.sizes[which], -1)
    inside = np.cumsum(cover)[:-1] > 0
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    heads = rows[:-1][np.diff(rows) > 0]
    edge[heads] = inside[heads]
    first = np.flatnonzero(edge)
    total = np.concatenate([[0], np.cumsum(inside)])
    span_size = np.diff(np.append(total[first], total[-1]))
    span_row = np.searchsorted(rows, first, "right") - 1
    count = np.diff(p.item_first)[which]
    pairs = np.unique(np.repeat(row, count) * (len(p.names) + 1) + p.item_of[ranges(p.item_first[which], count)])
    return np.diff(rows), span_row, first - rows[span_row], span_size, pairs // (len(p.names) + 1), pairs % (len(p.names) + 1)


FOUND = "row long, doc_id long, n_words long, spans array<struct<first:long,n:long>>, items array<string>"


def find_block(rows: DataFrame, block: Phrases | None, carry: Sequence[str] = ()) -> DataFrame:
    """rows: row, doc_id, text, and what is carried along."""
    schema = FOUND + "".join(f", `{c}` {kind}" for c in carry for name, kind in rows.dtypes if name == c)
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for part in gathered(batches):
            text, n = part["text"].combine_chunks(), part.num_rows
            if p is None:
                raw, offs = text_bytes(text)
                n_words = np.diff(word_hashes(raw, offs, _WORD)[1]) if len(raw) else np.zeros(n, np.int64)
                srow = first = size = irow = np.zeros(0, np.int64)
                names = pa.array([], pa.string())
            else:
                n_words, srow, first, size, irow, item = scan(text, p)
                names = pa.array(p.names[item].tolist(), pa.string())
            spans = pa.StructArray.from_arrays([pa.array(first), pa.array(size)], ["first", "n"])
            yield pa.RecordBatch.from_arrays([part["row"].combine_chunks(), part["doc_id"].combine_chunks().cast(pa.int64()), pa.array(n_words), lists(srow, n, spans), lists(irow, n, names), *(part[c].combine_chunks() for c in carry)], ["row", "doc_id", "n_words", "spans", "items", *carry])

    return rows.mapInArrow(tidy(run), schema)


def merged(found: DataFrame) -> DataFrame:
    """(row, spans, items) of what several blocks found: spans that meet are one, by gaps and islands in each row's spans."""
    spans = found.select("row", F.explode("spans").alias("s")).select("row", "s.first", (F.col("s.first") + F.col("s.n")).alias("end"))
    w = Window.partitionBy("row").orderBy("first", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(F.col("first") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("row", "island").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    spans = islands.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", (F.col("end") - F.col("first")).alias("n")))).alias("spans"))
    items = found.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.collect_set("item").alias("items"))
    return spans.join(items, "row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_percent: int = 5, block_bytes: int = 8 << 20, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (first word, words), items, and columns of docs named in carry."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *(c for c in carry if c != "text"))
    if blocks == 1:
        found = find_block(rows, phrases([(r["name"], r["text"]) for r in items.collect()], window), carry)
    else:
        rows = materialize(rows, "rows")
        counted = find_block(rows, None, carry).drop("spans", "items")
        parts = []
        for b in range(blocks):
            own = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == b).collect()
            parts.append(materialize(find_block(rows, phrases([(r["name"], r["text"]) for r in own], window)).where(F.size("spans") > 0).select("row", "spans", "items"), "found"))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        none = F.array().cast("array<struct<first:bigint,n:bigint>>"), F.array().cast("array<string>")
        found = counted.join(merged(found), "row", "left").withColumns({c: F.coalesce(c, v) for c, v in zip(("spans", "items"), none)})
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), "spans", F.sort_array("items").alias("items"), *carry)
    dirty = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", dirty.alias("contaminated"), "spans", "items", *carry)
