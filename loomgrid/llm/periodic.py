"""Runs of repeated words, by recompression.

Words of a slice of documents are numbered exactly, by the words themselves. A run of period q and at least 3q words holds
a place i that is a multiple of q, with words i, i + q and i + 2q alike, so multiples of every q are the candidates: n log n
of them for n words. How far a candidate's period reaches to both sides is the longest common extension of places i and
i + q, read from a grammar: blocks of one symbol and pairs of symbols are replaced in turn until one symbol is left, and a
query climbs level by level while both places begin the same symbols, and descends to where they part. A place's symbols
depend on its neighbours alone, so equal stretches are parsed alike and a query looks at a few symbols a level. Nothing is
sorted but the symbols of a level.

Documents stay in their partition: no shuffle. Only documents with a candidate enter a grammar.

Defined results: a null or blank text has no words and no run; a null doc_id stays null; repeated rows each get a row;
other columns are dropped unless carried, also those named like a result; an empty table gives no rows. A very long text is
a task's work of n log n; its candidates are looked at in chunks of CHUNK. Of runs of equal exponent the one that starts
first counts as the greatest, then that of the smaller period.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, let, tidy

#: Candidates that are held at once.
CHUNK = 1 << 20
SPACE_WORD = "[^\\x20\\x09-\\x0D]+"
RUN = "struct<start:long,length:long,period:long>"


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers from 0."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


@dataclass(frozen=True)
class Level:
    """A string of symbols and how it is cut into those of the next level."""

    symbols: np.ndarray
    head: np.ndarray  # whether a symbol begins one of the next level
    above: np.ndarray  # place in the next level
    first: np.ndarray  # place here of each symbol of the next level
    left: np.ndarray | None  # in a level of blocks: symbols from here to the block's end


class Grammar:
    """A string whose last symbol occurs once, replaced level by level: blocks, then pairs, and so on to one symbol."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[Level] = []
        symbols, turn = _numbered(symbols), 0
        while len(symbols) > 1:
            symbols = self._blocks(symbols)
            turn += 1
            if len(symbols) > 1:
                symbols = self._pairs(symbols, turn)

    def _blocks(self, s: np.ndarray) -> np.ndarray:
        head = np.ones(len(s), bool)
        head[1:] = s[1:] != s[:-1]
        if head.all():
            return s
        first = np.flatnonzero(head)
        ends = np.append(first[1:], len(s))
        above = np.cumsum(head) - 1
        self.levels.append(Level(s, head, above, first, ends[above] - np.arange(len(s))))
        return _numbered(s[first] * (len(s) + 1) + (ends - first))

    def _pairs(self, s: np.ndarray, turn: int) -> np.ndarray:
        """Symbols are dealt into two sides, and each left one is joined with a right one after it. Of a few dealings the one of most pairs is taken."""
        kinds = np.arange(int(s.max()) + 1, dtype=np.uint64)
        most, inner = -1, None
        for k in range(4):
            h = (kinds + np.uint64(turn * 4 + k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            side = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(bool)[s]
            for a, b in ((side[:-1], side[1:]), (side[1:], side[:-1])):
                joined = a & ~b
                if (n := int(np.count_nonzero(joined))) > most:
                    most, inner = n, joined
        head = np.ones(len(s), bool)
        head[1:] = ~inner
        first = np.flatnonzero(head)
        right = np.zeros(len(first), np.int64)
        two = np.append(first[1:], len(s)) - first == 2
        right[two] = s[first[two] + 1] + 1
        self.levels.append(Level(s, head, np.cumsum(head) - 1, first, None))
        return _numbered(s[first] * (int(s.max()) + 2) + right)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols of the string are alike from places i and j on; i and j differ."""
        a, b, open_ = i.astype(np.int64), j.astype(np.int64), np.arange(len(i))
        parted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in self.levels:  # up: from the places to where both begin a symbol of the next level
            s, met = level.symbols, np.zeros(len(open_), bool)
            if level.left is not None:
                inside = np.flatnonzero(~(level.head[a] & level.head[b]))
                x, y = a[inside], b[inside]
                alike = s[x] == s[y]
                p, q = level.left[x], level.left[y]
                step = np.where(alike, np.minimum(p, q), 0)
                a[inside], b[inside] = x + step, y + step
                met[inside] = ~alike | (p != q)
            else:
                inside = np.flatnonzero(~(level.head[a] & level.head[b]))
                while len(inside):
                    x, y = a[inside], b[inside]
                    alike = s[x] == s[y]
                    met[inside[~alike]] = True
                    inside = inside[alike]
                    a[inside] += 1
                    b[inside] += 1
                    inside = inside[~(level.head[a[inside]] & level.head[b[inside]])]
            parted.append((open_[met], a[met], b[met]))
            open_, a, b = open_[~met], level.above[a[~met]], level.above[b[~met]]
        out = np.zeros(len(i), np.int64)
        who, a, b = open_, a, b
        for n in range(len(self.levels) - 1, -1, -1):  # down: both stand before symbols that differ
            level = self.levels[n]
            s, a, b = level.symbols, level.first[a], level.first[b]
            alike = s[a] == s[b]
            step = alike.astype(np.int64) if level.left is None else np.where(alike, np.minimum(level.left[a], level.left[b]), 0)
            own, x, y = parted[n]
            who, a, b = np.concatenate([who, own]), np.concatenate([a + step, x]), np.concatenate([b + step, y])
        out[who] = a - i[who]
        return out


def _grid(sizes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, period, number of candidate places) of all periods that fit into each document."""
    longest = np.where(sizes >= least, sizes // times, 0)
    doc = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    return doc, period, (sizes[doc] - 1) // period - 1


def _candidates(words: np.ndarray, base: np.ndarray, sizes: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place in words, period) where words at the place, a period on and two periods on are alike; in chunks."""
    doc, period, count = _grid(sizes, least, times)
    ends = np.cumsum(count)
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        n = count[at:to]
        q = np.repeat(period[at:to], n)
        k = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        i = np.repeat(base[doc[at:to]], n) + k * q
        ok = np.flatnonzero(words[i] == words[i + q])
        ok = ok[words[i[ok]] == words[i[ok] + 2 * q[ok]]]
        yield np.repeat(doc[at:to], n)[ok], i[ok], q[ok]
        at = to


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (document, start, length, period) in order of start, then period, of documents whose word numbers stand one after another.

    A run has `least` words and `times` (3 or more) periods at least.
    """
    base = np.cumsum(sizes) - sizes
    some = np.zeros(len(sizes), bool)
    for doc, _, _ in _candidates(words, base, sizes, least, times):
        some[doc] = True
    if not some.any():
        return np.zeros((0, 4), np.int64)
    own = np.flatnonzero(some)
    n = sizes[own]
    before = np.cumsum(n) - n
    inside = np.concatenate([words[base[d] : base[d] + sizes[d]] for d in own])
    # each document ends by a symbol of its own, so nothing is alike across documents
    spaced = np.insert(inside, before + n, int(words.max()) + 1 + np.arange(len(own)))
    starts = before + np.arange(len(own))
    forward, backward = Grammar(spaced), Grammar(np.append(spaced[-2::-1], spaced[-1]))
    last = len(spaced) - 2
    found = []
    for doc, i, q in _candidates(spaced, starts, n, least, times):
        ahead = forward.common(i, i + q)
        # the word before place i is place last - i + 1 of the string read backwards
        behind = backward.common(last - i + 1, last - i - q + 1)
        length = behind + q + ahead
        ok = length >= np.maximum(least, times * q)
        found.append(np.stack([doc, i - behind - starts[doc], length, q], 1)[ok])
        found[-1] = np.unique(found[-1], axis=0)
    rows = np.concatenate(found)
    # the same stretch has its smallest period first
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    rows[:, 0] = own[rows[:, 0]]
    return rows


def dropped(rows: np.ndarray, n: int) -> np.ndarray:
    """Of n words, those that a run (start, length, period) holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edge, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def periodic_runs(docs: DataFrame, *, least: int = 24, times: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period), collapsed (the words that stay, joined by one blank), carry."""
    if times < 3:
        raise ValueError("candidates are three words a period apart: times must be 3 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches):
            numbers: dict[bytes, int] = {}
            texts = [[] if t is None else t.encode().split() for t in part["text"].to_pylist()]
            sizes = np.array([len(w) for w in texts], np.int64)
            words = np.fromiter((numbers.setdefault(w, len(numbers)) for own in texts for w in own), np.int64, int(sizes.sum()))
            rows = runs_of(words, sizes, least, times)
            cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
            collapsed = []
            for k, own in enumerate(texts):
                if cuts[k] < cuts[k + 1]:
                    gone = dropped(rows[cuts[k] : cuts[k + 1], 1:], len(own))
                    own = [w for w, g in zip(own, gone.tolist()) if not g]
                collapsed.append(b" ".join(own).decode())
            runs = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), runs)
            head = [part[c].combine_chunks() for c in ("doc_id", *carry)]
            yield pa.RecordBatch.from_arrays([*head, pa.array(sizes), lists, pa.array(collapsed, pa.string())], ["doc_id", *carry, "n_words", "runs", "collapsed"])

    own = docs.select("doc_id", *carry, "text")
    kinds = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))
    return own.mapInArrow(tidy(run), f"{kinds}, n_words long, runs array<{RUN}>, collapsed string")


def greatest(runs: Column) -> Column:
    """The run of the greatest length/period, compared exactly; of equal ones the first by start, then period. Null without a run."""

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def looped(words: Column, g: Column) -> Column:
    """words, of which those from place g % n on are its first ones there, again and again, three times or more."""

    def repeat(t: Column) -> Column:
        return F.transform(t["w"], lambda w, i: F.when(i >= t["a"], F.get(t["w"], (t["a"] + (i - t["a"]) % t["p"]).cast("int"))).otherwise(w))

    def place(s: Column) -> Column:
        n = F.size(s["w"])
        a = s["g"] % n
        return let(F.struct(s["w"].alias("w"), a.alias("a"), (F.floor((n - a) / (s["g"] % 8 + 3)) + 1).alias("p")), repeat)

    return let(F.struct(words.alias("w"), g.alias("g")), place)


def with_loops(docs: DataFrame) -> DataFrame:
    """docs, of which a tenth by a hash of doc_id end in a stretch of words repeated (looped)."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all("text", F.lit(SPACE_WORD), F.lit(0))
    text = F.when((h % 10 == 0) & F.rlike("text", F.lit(SPACE_WORD)), F.array_join(looped(words, F.floor(h / 10)), " ")).otherwise(F.col("text"))
    return docs.withColumn("text", text)


def run_digests(runs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the greatest run's start, length, period and exponent_milli, and checksums of all runs and of the words that stay."""
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = runs.withColumn("best", greatest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
