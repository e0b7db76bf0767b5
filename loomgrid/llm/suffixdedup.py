"""Exact removal of repeated byte strings by suffix arrays of shards.

A byte goes if a string of `window` bytes over it also starts earlier: in an earlier row, or earlier in the same text. Rows
are ordered by doc_id, null first; rows of one doc_id by their place in the table.

Strings that occur once are most of any text and need no sorting. Each window has an anchor, its least hashed k-gram;
neighbouring windows of one anchor are a piece. Equal windows have equal anchors, so only pieces of an anchor that occurs
more than once can hold equal windows:

1. Shards are some MB of documents of a task. A shard's pieces of repeated anchors go into suffix arrays: suffixes are
   sorted by Larsson-Sadakane refinement, common prefixes are measured by Kasai's rule, and of windows whose prefixes reach
   the window length all but the earliest are settled. What is left of a shard goes on: a text copied a million times
   sends its pieces once from each shard.
2. By anchor, pieces that several shards hold are asked for.
3. Their bytes are cut from the texts and dealt to shards by anchor. Pieces that are copies of an earlier one, byte for
   byte, are settled at once, which is the pre-aggregation that large groups of copies need; the others of an anchor are
   sorted and settled in the same way as in a shard of documents.
4. An anchor of many pieces is dealt over several shards. Each of those sends its distinct windows, sorted, with their
   bytes; these runs are merged two at a time by binary search, which settles what lies in different shards.
5. Settled windows are spans of their texts; spans meet their text and merge.

Hashes only choose what is compared: every window is settled by its bytes. What is dealt travels as packed arrays, one row
for each task and partition, so no key gathers rows. Rows are written once with a key of their own, which keeps rows of
equal or null doc_id apart.

Defined results: null or empty text has 0 bytes and nothing removed; a null doc_id is smaller than any; of rows that repeat
a doc_id or a text the later ones lose what the earlier ones hold; other columns are dropped unless carried, also those named like a result; an empty table gives no rows. A very long text is cut into
pieces in bounded segments, and is one row of the last step. Of equal windows the earliest stays, so there are no ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, materialize, partitions_for, text_bytes, tidy
from .decontaminate import powers, ranges

GRAM = 32
SEGMENT = 1 << 19
POSITION_BITS = 21
#: Windows of a piece at most.
PIECE_WINDOWS = 512
#: A shard of a task is made of about this many bytes of text.
HELD_BYTES = 16 << 20
#: Pieces of one anchor that one shard takes.
SHARD_PIECES = 64
#: Bytes that one suffix array takes, whole anchors together.
SHARD_BYTES = 1 << 20
NO_DOC = -(1 << 63)

#: Rows that travel: dealt by __part; a text or a packed array.
ROW = "__part int, __kind int, __row long, doc_id long, text string, __blob binary"
SPANS, ASKED, PIECES, RUNS, TEXT = 1, 2, 3, 4, 9


def pack(*columns: np.ndarray) -> bytes:
    head = np.array([len(columns[0])], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for k in kinds.split():
        d = np.dtype(k)
        out.append(np.frombuffer(raw, d, n, at))
        at += n * d.itemsize
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


def joined(blobs: list[bytes], kinds: str) -> list[np.ndarray]:
    parts = [unpack(b, kinds) for b in blobs]
    if not parts:
        return [np.zeros(0, k) for k in kinds.split()] + [np.zeros(0, np.uint8)]
    return [np.concatenate(x) for x in zip(*parts)]


SPAN_KINDS = "i8 i4 i4"  # row, first byte, bytes
PIECE_KINDS = "u8 i8 i4 i4 i8"  # anchor, row, first byte, windows, shard
ASK_KINDS = "u8 i8 i4 i4 i4"  # anchor, row, first byte, windows, shards of the anchor
CUT_KINDS = "u8 u8 i8 i8 i4 i4 i4"  # anchor, content, doc, row, first byte, windows, shards of the anchor


def spread(x: np.ndarray) -> np.ndarray:
    """A hash of whole numbers."""
    x = x.astype(np.int64, copy=False).view(np.uint64) if x.dtype != np.uint64 else x
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spark_hash(doc: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs (the published XXH64 of eight bytes, seed 42), so texts and arrays meet."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x: np.ndarray, r: int) -> np.ndarray:
        return (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    h = turn(doc.view(np.uint64) * p2, 31) * p1 ^ (np.uint64(42) + p5 + np.uint64(8))
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def row_part(row: np.ndarray, parts: int) -> np.ndarray:
    return spark_hash(np.ascontiguousarray(row, np.int64)).view(np.int64) % parts


def by_part(part: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One packed row for each part."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(part[a]), kind, pack(*(c[a:b] for c in columns))


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array([r[2] for r in rows], pa.binary())],
        [c.split()[0] for c in ROW.split(", ")],
    )


def batches_of(rows: Iterator[tuple[int, int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2]) + 64
        if size > most:
            yield batch_of(held)
            held, size = [], 0
    if held:
        yield batch_of(held)


def doc_ids(part: pa.Table) -> np.ndarray:
    return part["doc_id"].combine_chunks().cast(pa.int64()).fill_null(NO_DOC).to_numpy()


def content_hash(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return spread((total[starts + sizes] - total[starts]) * down[starts])


def cut_pieces(raw: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of all rows: (row, first byte in the row, windows, anchor, whether the anchor comes again in it) of each piece."""
    out = []
    span = window - GRAM + 1
    ends = np.repeat(offs[1:], np.diff(offs))
    low = np.uint64((1 << POSITION_BITS) - 1)
    for s in range(0, len(raw) - window + 1, SEGMENT):
        n = min(SEGMENT, len(raw) - window + 1 - s)  # windows that start here
        part = raw[s : s + n + window - 1]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        grams = len(part) - GRAM + 1
        h = (total[GRAM:] - total[:grams]) * down[:grams]
        h = spread(h)
        key = (h & ~low) | np.arange(grams, dtype=np.uint64)
        # sliding least over span grams: the least of a block's tail and the next block's head
        width = -(-grams // span) * span
        blocks = np.full(width + span, np.iinfo(np.uint64).max, np.uint64)
        blocks[:grams] = key
        head = np.minimum.accumulate(blocks.reshape(-1, span), 1).ravel()
        tail = np.minimum.accumulate(blocks.reshape(-1, span)[:, ::-1], 1)[:, ::-1].ravel()
        at = (np.minimum(tail[:n], head[span - 1 : span - 1 + n]) & low).astype(np.int64)
        valid = np.arange(s, s + n) + window <= ends[s : s + n]
        new = np.ones(n, bool)
        new[1:] = at[1:] != at[:-1]
        moved = np.flatnonzero(new)[1:]
        new[moved] = h[at[moved]] != h[at[moved - 1]]  # a k-gram that comes again is the same anchor
        new[1:] |= valid[1:] != valid[:-1]
        first = np.flatnonzero(new)
        windows = np.diff(np.append(first, n))
        keep = valid[first]
        first, windows = first[keep], windows[keep]
        several = -(-windows // PIECE_WINDOWS)
        inner = ranges(np.zeros(len(first), np.int64), several) * PIECE_WINDOWS
        first, windows = np.repeat(first, several) + inner, np.minimum(np.repeat(windows, several) - inner, PIECE_WINDOWS)
        row = np.searchsorted(offs, first + s, "right") - 1
        out.append((row, first + s - offs[row], windows, h[at[first]], at[first] != at[first + windows - 1]))
    if not out:
        return tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.int64, np.uint64, bool))
    return tuple(np.concatenate(x) for x in zip(*out))


def repeated(values: np.ndarray) -> np.ndarray:
    """Which of the values occur more than once."""
    s = np.sort(values)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(twice, values), len(twice) - 1)
    return twice[at] == values


def refine(text: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Larsson-Sadakane: all positions in suffix order; suffixes that are equal to their ends keep text order.

    end: where each position's piece ends; a suffix stops there. depth: the longest piece. Each sort is of one number that
    holds what is compared and the place before, so ties keep their order.
    """
    n = len(text)
    left = (end - np.arange(n)).astype(np.int32)
    place = max(1, (n - 1).bit_length())
    used = np.flatnonzero(np.bincount(text, minlength=256))
    bits = len(used).bit_length()
    take = max(1, (64 - place) // bits)
    symbol = np.zeros(256, np.uint8)
    symbol[used] = np.arange(1, len(used) + 1)
    padded = np.append(symbol[text], np.zeros(take, np.uint8))
    short = np.flatnonzero(left < take)
    key = np.zeros(n, np.uint64)
    for j in range(take):
        key <<= np.uint64(bits)
        key |= padded[j : j + n]
    ended = left[short].astype(np.uint64)  # what lies past a piece's end is no part of its suffixes
    cut = (np.uint64(take) - ended) * np.uint64(bits)
    key[short] = key[short] >> cut << cut
    key <<= np.uint64(place)
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    sa = (key & np.uint64((1 << place) - 1)).astype(np.int32)
    key >>= np.uint64(place)
    new = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1, dtype=np.int32), 0))
    h = take
    active = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
    while len(active) and h < depth:
        step = min(h, depth - h)
        at = sa.take(active)
        group, after = rank.take(at), rank.take(np.minimum(at + np.int32(step), n - 1))
        after[left.take(at) <= step] = 0
        dense = np.cumsum(np.append(False, group[1:] != group[:-1]))
        low = max(1, (len(active) - 1).bit_length())
        if int(dense[-1] + 1).bit_length() + (n + 1).bit_length() + low < 63:
            dense *= n + 2
            dense += after
            dense <<= low
            dense |= np.arange(len(active))
            dense.sort()
            by = dense & ((1 << low) - 1)
        else:
            by = np.lexsort((after, dense))
        at, group, after = at.take(by), group.take(by), after.take(by)
        sa[active] = at
        new = np.ones(len(active), bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        # ranks of this round are read above; they change only here
        rank[at] = np.maximum.accumulate(np.where(new, active + np.int32(1), 0))
        h += step
        active = active[~(new & np.append(new[1:], True))]
    return sa


def kasai(text: np.ndarray, end: np.ndarray, piece: np.ndarray, windows: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By position in sa: the prefix a window shares with the one before it, `most` at most.

    Kasai's rule: the prefix of the next position is one byte shorter at worst. Each piece is a lane, and all lanes take
    their k-th window together.
    """
    n = len(text)
    where = np.empty(n, np.int32)
    where[sa] = np.arange(n, dtype=np.int32)
    out = np.zeros(n, np.int32)
    length = np.zeros(len(piece), np.int64)
    for k in range(int(windows.max(initial=0))):
        lane = np.flatnonzero(windows > k)
        at = piece[lane] + k
        slot = where[at]
        prev = sa[np.maximum(slot - 1, 0)]
        got = np.maximum(length[lane] - 1, 0)
        cap = np.minimum(np.minimum(end[at] - at, end[prev] - prev), most)
        cap[slot == 0] = 0
        got = np.minimum(got, cap)
        live = np.flatnonzero(got < cap)
        while len(live):
            same = text[at[live] + got[live]] == text[prev[live] + got[live]]
            live = live[same]
            got[live] += 1
            live = live[got[live] < cap[live]]
        length[lane] = got
        out[slot] = got
    return out


def equal_windows(text: np.ndarray, first: np.ndarray, windows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a shard's pieces in suffix order: (piece, window in the piece, number of its group of equals)."""
    size = windows + window - 1
    end = np.repeat(first + size, size)
    # the whole depth: Kasai's rule needs ties only between suffixes that are equal to their ends
    sa = refine(text, end, int(size.max(initial=0)))
    common = kasai(text, end, first, windows, sa, window)
    owner = np.repeat(np.arange(len(first)), size)
    inner = np.arange(len(text)) - first[owner]
    is_window = inner < windows[owner]
    group = np.cumsum(common < window)
    keep = is_window[sa]
    at = sa[keep]
    return owner[at], inner[at], group[keep]


def settle(text: np.ndarray, n: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's pieces, one after the other in text: (piece, window in the piece, whether it is the earliest of its equals), in suffix order."""
    size = n.astype(np.int64) + window - 1
    piece, inner, group = equal_windows(text, np.cumsum(size) - size, n.astype(np.int64), window)
    place = np.empty(len(n), np.int64)
    place[np.lexsort((start, row, doc))] = np.arange(len(n))
    at = place[piece] * np.int64(PIECE_WINDOWS) + inner
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
    least = np.minimum.reduceat(at, begin) if len(begin) else at
    return piece, inner, at == np.repeat(least, np.diff(np.append(begin, len(group))))


def copies(body: np.ndarray, at: np.ndarray, size: np.ndarray, anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which pieces equal an earlier one byte for byte. Hashes say what to compare; where bytes differ, suffix arrays decide."""
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    order = np.lexsort((start, row, doc, size, content, anchor))
    a, c, n = anchor[order], content[order], size[order]
    new = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1]))
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.flatnonzero(~new)
    for k in np.array_split(later, max(1, int(n[later].sum()) >> 20)):  # a MB at a time
        x, y, m = order[k], lead[k], n[k]
        same = body[ranges(at[x], m)] == body[ranges(at[y], m)]
        if len(k):
            out[x] = np.logical_and.reduceat(same, np.cumsum(m) - m)
    return out


def shards_of(anchor: np.ndarray, salt: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces in order of their anchors, cut into suffix arrays of about SHARD_BYTES, whole anchors together."""
    order = np.lexsort((salt, anchor))
    a, s = anchor[order], salt[order]
    heads = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1]))[: len(a)])
    if not len(heads):
        return
    total = np.cumsum(size[order])
    shard = (total[heads] // SHARD_BYTES).astype(np.int64)
    cuts = np.append(heads[np.append(True, shard[1:] != shard[:-1])], len(order))
    for x, y in zip(cuts[:-1], cuts[1:]):
        yield order[x:y]


def spans_of(piece: np.ndarray, inner: np.ndarray, row: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Settled windows as spans of bytes, neighbours joined."""
    if not len(piece):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    at = np.sort(piece * np.int64(2 * PIECE_WINDOWS) + inner)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
    p, k = at[first] // (2 * PIECE_WINDOWS), at[first] % (2 * PIECE_WINDOWS)
    n = np.diff(np.append(first, len(at)))
    return row[p], (start[p] + k).astype(np.int32), (n + window - 1).astype(np.int32)


Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # sorted windows, and the doc, row and first byte of each
Lost = tuple[np.ndarray, np.ndarray]  # row, first byte


def merge(a: Run, b: Run) -> tuple[Run, Lost]:
    """Two sorted runs of distinct windows as one: each window of b is looked up in a by binary search; of equals the earlier stays."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    at = np.searchsorted(a[0], b[0])
    met = a[0][np.minimum(at, len(a[0]) - 1)] == b[0]
    i, j = at[met], np.flatnonzero(met)
    earlier = (b[1][j] < a[1][i]) | ((b[1][j] == a[1][i]) & ((b[2][j] < a[2][i]) | ((b[2][j] == a[2][i]) & (b[3][j] < a[3][i]))))
    lost = np.where(earlier, a[2][i], b[2][j]), np.where(earlier, a[3][i], b[3][j])
    kept = [x.copy() for x in a]
    for k in (1, 2, 3):
        kept[k][i[earlier]] = b[k][j[earlier]]
    fresh = np.flatnonzero(~met)
    return tuple(np.insert(x, at[fresh], y[fresh]) for x, y in zip(kept, b)), lost


def suffix_dedup(docs: DataFrame, *, window: int = 100, with_text: bool = False, carry: Sequence[str] = (), shard_pieces: int = SHARD_PIECES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text also kept_text; and columns of docs named in carry.

    Where a removal cuts a character of several bytes, the kept text has its remaining bytes replaced by nothing; sizes
    and the digest are of the bytes.
    """
    parts = partitions_for(docs)
    keyed = materialize(docs.select(F.monotonically_increasing_id().alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), "text", *carry), "keyed")
    run_kinds = f"S{window} i8 i8 i4"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[np.ndarray] = []
        size, flushes = 0, 0

        def flush() -> Iterator[tuple[int, int, bytes]]:
            anchor, again, doc, row, start, n, at = (np.concatenate(x) for x in zip(*held))
            raw = np.concatenate(texts)
            source = np.int64(TaskContext.get().partitionId()) << 20 | flushes
            some = np.flatnonzero(repeated(anchor) | again)
            send = np.ones(len(anchor), bool)
            bytes_of = n.astype(np.int64) + window - 1
            for k in shards_of(anchor[some], np.zeros(len(some), np.uint64), bytes_of[some]):
                k = some[k]
                piece, inner, earliest = settle(raw[ranges(at[k], bytes_of[k])], n[k], doc[k], row[k], start[k], window)
                yield from by_rows(*spans_of(piece[~earliest], inner[~earliest], row[k], start[k], window))
                send[k] = np.bincount(piece[earliest], minlength=len(k)) > 0
            own = np.flatnonzero(send)
            yield from by_part((anchor[own] % np.uint64(parts)).astype(np.int64), PIECES, anchor[own], row[own], start[own], n[own], np.full(len(own), source))

        for part in gathered(batches):
            raw, offs = text_bytes(part["text"].combine_chunks())
            r, start, n, anchor, again = cut_pieces(raw, offs, window)
            doc = part["doc_id"].combine_chunks().fill_null(NO_DOC).to_numpy()
            held.append((anchor, again, doc[r], part["__row"].to_numpy()[r], start.astype(np.int32), n.astype(np.int32), size + offs[r] + start))
            texts.append(raw)
            size += len(raw)
            if size >= held_bytes:
                yield from batches_of(flush())
                held, texts, size, flushes = [], [], 0, flushes + 1
        if held:
            yield from batches_of(flush())

    def by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            kind = batch.column(1).to_numpy()
            passed = batch.filter(pa.array(kind == SPANS))
            if passed.num_rows:
                yield passed
            blobs += batch.column(5).filter(pa.array(kind == PIECES)).to_pylist()
        columns = joined(blobs, PIECE_KINDS)[:-1]
        del blobs
        columns = [x[repeated(columns[0])] for x in columns]
        order = np.lexsort((columns[4], columns[0]))
        anchor, row, start, n, source = (x[order] for x in columns)
        head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)])
        pieces = np.diff(np.append(head, len(anchor)))
        last = head + pieces - 1
        ask = np.flatnonzero(np.repeat(source[head] != source[last], pieces))  # shards have settled what they alone hold
        shards = np.repeat(-(-pieces // shard_pieces), pieces).astype(np.int32)
        yield from batches_of(by_part(row_part(row[ask], parts), ASKED, *(x[ask] for x in (anchor, row, start, n, shards))))

    def with_docs(arrays: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        """Texts and packed arrays dealt by row; in a partition, arrays come first."""
        texts = keyed.select(F.pmod(F.xxhash64("__row"), F.lit(parts)).cast("int").alias("__part"), F.lit(TEXT).alias("__kind"), "__row", "doc_id", "text", F.lit(None).cast("binary").alias("__blob"), *also)
        return texts.unionByName(arrays, allowMissingColumns=True).repartitionById(parts, F.col("__part")).sortWithinPartitions("__kind")

    def first_arrays(batches: Iterator[pa.RecordBatch], kind: int) -> tuple[list[bytes], Iterator[pa.RecordBatch]]:
        blobs: list[bytes] = []

        def rest(lead: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if lead is not None:
                yield lead
            yield from batches

        for batch in batches:
            kinds = batch.column(1).to_numpy()
            blobs += batch.column(5).filter(pa.array(kinds == kind)).to_pylist()
            if (kinds == TEXT).any():
                return blobs, rest(batch.filter(pa.array(kinds == TEXT)))
        return blobs, iter(())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, texts = first_arrays(iter(batches), ASKED)
        columns = joined(blobs, ASK_KINDS)[:-1]
        del blobs
        order = np.argsort(columns[1], kind="stable")
        anchor, row, start, n, shards = (x[order] for x in columns)

        def rows() -> Iterator[tuple[int, int, bytes]]:
            for part in gathered(texts):
                ids = part["__row"].to_numpy()
                a, b = np.searchsorted(row, ids, "left"), np.searchsorted(row, ids, "right")
                if not (b > a).any():
                    continue
                raw, offs = text_bytes(part["text"].combine_chunks())
                ask, own = ranges(a, b - a), np.repeat(np.arange(len(ids)), b - a)
                size = n[ask].astype(np.int64) + window - 1
                at = offs[own] + start[ask]
                content, doc = content_hash(raw, at, size), part["doc_id"].combine_chunks().fill_null(NO_DOC).to_numpy()[own]
                to = (spread(anchor[ask] ^ spread(salted(content, shards[ask]) + np.uint64(1))) % np.uint64(parts)).astype(np.int64)
                by = np.lexsort((content, anchor[ask], to))
                ask, size, at, to, content, doc = ask[by], size[by], at[by], to[by], content[by], doc[by]
                edges = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
                for x, y in zip(edges[:-1], edges[1:]):
                    k = ask[x:y]
                    yield int(to[x]), PIECES, pack_with(raw[ranges(at[x:y], size[x:y])], anchor[k], content[x:y], doc[x:y], *(c[k] for c in (row, start, n, shards)))

        yield from batches_of(rows())

    def salted(content: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """Which of its anchor's shards takes a piece; equal pieces go to one."""
        return np.where(shards > 1, content % np.maximum(shards, 1).astype(np.uint64), 0).astype(np.uint64)

    def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            blobs += batch.column(5).to_pylist()
        *columns, body = joined(blobs, CUT_KINDS)
        del blobs
        size = columns[5].astype(np.int64) + window - 1
        at = np.cumsum(size) - size
        anchor, content, doc, row, start, n, shards = columns
        copy = copies(body, at, size, *columns[:5])

        def rows() -> Iterator[tuple[int, int, bytes]]:
            yield from by_rows(row[copy], start[copy], size[copy].astype(np.int32))
            left = np.flatnonzero(~copy)
            left = left[repeated(anchor[left]) | (shards[left] > 1)]
            for k in shards_of(anchor[left], salted(content[left], shards[left]), size[left]):
                k = left[k]
                text = body[ranges(at[k], size[k])]
                piece, inner, earliest = settle(text, n[k], doc[k], row[k], start[k], window)
                yield from by_rows(*spans_of(piece[~earliest], inner[~earliest], row[k], start[k], window))
                several = np.flatnonzero(earliest & (shards[k][piece] > 1))  # in suffix order
                if len(several):
                    p, i = piece[several], inner[several]
                    first = (np.cumsum(size[k]) - size[k])[p] + i
                    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, window)[first]).view(f"S{window}").ravel()
                    to = (content_hash(text, first, np.full(len(first), window)) % np.uint64(parts)).astype(np.int64)
                    yield from by_part(to, RUNS, windows, doc[k][p], row[k][p], (start[k][p] + i).astype(np.int32))

        yield from batches_of(rows())

    def by_rows(row: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        yield from by_part(row_part(row, parts), SPANS, row, start, size)

    def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[Run] = [tuple(unpack(b, run_kinds)[:4]) for batch in batches for b in batch.column(5).to_pylist()]
        lost: list[Lost] = []
        while len(runs) > 1:
            pairs = [merge(a, b) for a, b in zip(runs[::2], runs[1::2])]
            lost += [x for _, x in pairs]
            runs = [x for x, _ in pairs] + runs[len(pairs) * 2 :]
        if lost:
            row, start = (np.concatenate(x) for x in zip(*lost))
            yield from batches_of(by_rows(row, start.astype(np.int32), np.full(len(row), window, np.int32)))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text + "".join(f", `{c}` {kind}" for c in carry for name, kind in docs.dtypes if name == c)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, texts = first_arrays(iter(batches), SPANS)
        row, start, size, _ = joined(blobs, SPAN_KINDS)
        order = np.argsort(row, kind="stable")
        row, start, size = row[order], start[order], size[order]
        for part in gathered(texts):
            ids = part["__row"].to_numpy()
            raw, offs = text_bytes(part["text"].combine_chunks())
            a, b = np.searchsorted(row, ids, "left"), np.searchsorted(row, ids, "right")
            k, own = ranges(a, b - a), np.repeat(np.arange(len(ids)), b - a)
            begin = offs[own] + start[k]
            cover = np.zeros(len(raw) + 1, np.int32)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + size[k], -1)
            gone = np.cumsum(cover[:-1]) > 0
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            heads = offs[:-1][np.diff(offs) > 0]
            edge[heads] = gone[heads]
            removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, edge))
            kept = raw[~gone]
            left = np.concatenate([[0], np.cumsum(np.diff(offs) - np.diff(removed[offs]))])
            body = [kept[x:y].tobytes() for x, y in zip(left[:-1], left[1:])]
            columns = [part["doc_id"].combine_chunks(), pa.array(np.diff(offs)), pa.array(np.diff(removed[offs])), pa.array(np.diff(spans[offs])), pa.array([hashlib.sha256(x).hexdigest() for x in body])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array([x.decode(errors="ignore") for x in body], pa.string()))
                names.append("kept_text")
            columns += [part[c].combine_chunks() for c in carry]
            names += carry
            yield pa.RecordBatch.from_arrays(columns, names)

    found = keyed.select("__row", "doc_id", "text").mapInArrow(tidy(find), ROW).repartitionById(parts, F.col("__part")).mapInArrow(tidy(by_anchor), ROW)
    settled = materialize(found, "settled")
    asked = settled.where(F.col("__kind") == ASKED)
    spans = settled.where(F.col("__kind") == SPANS)
    if not asked.isEmpty():
        shards = with_docs(asked).mapInArrow(tidy(cut), ROW).repartitionById(parts, F.col("__part")).mapInArrow(tidy(sort_shard), ROW)
        sorted_ = materialize(shards, "sorted")
        spans = spans.unionByName(sorted_.where(F.col("__kind") == SPANS))
        runs = sorted_.where(F.col("__kind") == RUNS)
        if not runs.isEmpty():
            spans = spans.unionByName(runs.repartitionById(parts, F.col("__part")).mapInArrow(tidy(merge_runs), ROW))
    return with_docs(spans, carry).mapInArrow(tidy(finish), schema)


def pack_with(body: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns, then bytes that belong to them in order."""
    head = np.array([len(columns[0])], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns) + body.tobytes())
