"""Import and export of binary dictionaries: header, token table, text table and, for path dictionaries, an index.

Texts are records of token ids in pages of equal token count; a page is a stream of packets over a palette of 15 slots.
The index is a tree of prefixes, each with its number of leaves. A file is decoded whole, into rows of texts and paths.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators.tokenmerge import SLOTS, _page_slots

from .mapfile import VERSION_BYTES, Bits, BitWriter, chunk, chunks

# ---- fixed values of the format
TOKENS, TEXTS, INDEX = b"TM00", b"TT00", b"TI00"
PALETTE, UPDATE, PAYLOAD = 0, 1, 2
PAGE = 128
ENCODINGS = ("utf-8", "cp932", "utf-16-le")


def bits_for(n: int) -> int:
    return max(1, (n - 1).bit_length())


# ---- reading


def read_tokens(data: bytes) -> list[bytes]:
    src, out, last = Bits(data), [], 0
    n, pages = src.unsigned(), src.unsigned()
    for _ in range(pages):
        if src.take(8):
            raise ValueError("a token page's header is not known")
        size, count, total = src.unsigned(), src.unsigned(), src.unsigned()
        if size < last or not size or not count or total != size * count:
            raise ValueError("token pages are not in order")
        body, last = src.bytes(total), size
        out += [body[k : k + size] for k in range(0, total, size)]
    if len(out) != n or src.bit != len(data) * 8:
        raise ValueError("the token table's count is not its pages'")
    return out


def read_page(body: bytes, n_records: int, token_bits: int) -> list[list[int]]:
    src, held, out, cur = Bits(body), {}, [], []
    for _ in range(src.unsigned()):
        kind, size = src.take(2), src.unsigned()
        begin = src.bit
        if kind == PALETTE:
            chosen = src.take(SLOTS)
            held = {k + 1: src.take(token_bits) for k in range(SLOTS) if chosen >> k & 1}
        elif kind == UPDATE:
            slot = src.take(4)
            if not slot:
                raise ValueError("slot 0 ends records and holds no token")
            held[slot] = src.take(token_bits)
        elif kind == PAYLOAD:
            for _ in range(size // 4):
                slot = src.take(4)
                if slot == 0:
                    out.append(cur)
                    cur = []
                elif slot in held:
                    cur.append(held[slot])
                else:
                    raise ValueError("a record uses an empty slot")
        else:
            src.bit += size
        if src.bit - begin != size:
            raise ValueError("a packet's size is not what it holds")
    if len(out) != n_records or cur:
        raise ValueError("a page's records are not its count")
    return out


def read_texts(data: bytes) -> tuple[list[list[int]], int]:
    """Records of token ids in code order, and the page size."""
    src, out, last = Bits(data), [], -1
    n, page_size, pages, token_bits = src.unsigned(), src.unsigned(), src.unsigned(), src.unsigned()
    if not 1 <= token_bits <= 16:
        raise ValueError("token ids have 1 to 16 bits")
    for _ in range(pages):
        if src.take(8):
            raise ValueError("a text page's header is not known")
        length, count, total = src.unsigned(), src.unsigned(), src.unsigned()
        if length < last:
            raise ValueError("text pages are not in order")
        last = length
        out += read_page(src.bytes(total), count, token_bits)
    if len(out) != n or src.bit != len(data) * 8:
        raise ValueError("the text table's count is not its pages'")
    return out, page_size


def read_index(data: bytes) -> list[list[int]]:
    """Text codes of every path, in leaf order."""
    src = Bits(data)
    depth, n, code_bits, roots = src.unsigned(), src.unsigned(), src.unsigned(), src.unsigned()
    body = Bits(src.bytes(src.unsigned()))
    if not (depth and n and roots and 1 <= code_bits <= 31) or src.bit != len(data) * 8:
        raise ValueError("the index header is not valid")
    out: list[list[int]] = []

    def leaves(prefix: list[int]) -> int:
        count = body.unsigned()
        out.extend([*prefix, body.take(code_bits)] for _ in range(count))
        return count

    def prefixes(prefix: list[int], want: int | None, times: int | None) -> None:
        done = 0
        while (done < want) if want is not None else (times > 0):
            if len(prefix) == depth - 1:
                done += leaves(prefix)
            else:
                code, count, _ = body.take(code_bits), body.unsigned(), body.unsigned()
                prefixes([*prefix, code], count, None)
                done += count
            times = None if times is None else times - 1
        if want is not None and done != want:
            raise ValueError("a prefix's leaves are not its count")

    prefixes([], None, roots)
    if len(out) != n:
        raise ValueError("the index has not as many paths as it says")
    return out


def book_widths(data: bytes) -> dict:
    """Counts and bit widths by the headers of a dictionary's tables; paths and code_bits are None without an index.

    fits: token ids and text codes have bits enough for the tables that they point into.
    """
    parts = list(chunks(data))
    if [p[0] for p in parts[1:]] not in ([TOKENS, TEXTS], [TOKENS, TEXTS, INDEX]):
        raise ValueError("a dictionary's chunks are out of order")
    tokens = Bits(parts[1][1]).unsigned()
    src = Bits(parts[2][1])
    texts, _, _, token_bits = (src.unsigned() for _ in range(4))
    paths = code_bits = None
    if len(parts) == 4:
        src = Bits(parts[3][1])
        _, paths, code_bits = (src.unsigned() for _ in range(3))
    fits = token_bits >= bits_for(tokens) and (code_bits is None or code_bits >= bits_for(texts))
    return {"tokens": tokens, "token_bits": token_bits, "texts": texts, "code_bits": code_bits, "paths": paths, "fits": fits}


def read_book(data: bytes, encoding: str = "utf-8") -> dict:
    """metadata, texts by code, tokens, records (token ids) and, if there is an index, paths (text codes)."""
    if not book_widths(data)["fits"]:
        raise ValueError("ids have fewer bits than the tables they point into need")
    parts = list(chunks(data))
    head = Bits(parts[0][1], VERSION_BYTES)
    metadata = head.bytes(head.unsigned()).decode() or None
    tokens = read_tokens(parts[1][1])
    records, page_size = read_texts(parts[2][1])
    texts = [b"".join(tokens[t] for t in r).decode(encoding) for r in records]
    return {"metadata": metadata, "tokens": tokens, "records": records, "texts": texts, "page_size": page_size, "paths": read_index(parts[3][1]) if len(parts) == 4 else None}


# ---- writing


def write_tokens(tokens: Sequence[bytes]) -> bytes:
    sizes = [len(t) for t in tokens]
    if sizes != sorted(sizes) or 0 in sizes:
        raise ValueError("tokens come by their size, and none is empty")
    distinct = sorted(set(sizes))
    out = BitWriter().unsigned(len(tokens)).unsigned(len(distinct)).done()
    for s in distinct:
        body = b"".join(t for t in tokens if len(t) == s)
        out += BitWriter().put(0, 8).unsigned(s).unsigned(len(body) // s).unsigned(len(body)).done() + body
    return out


def write_page(records: list[list[int]], token_bits: int) -> bytes:
    writes = _page_slots(records)
    base = [(s, t) for at, t, s in writes if at < 0]
    later = {at: (s, t) for at, t, s in writes if at >= 0}
    held = {t: s for s, t in base}
    packets: list[tuple[int, list[tuple[int, int]]]] = [(PALETTE, [((1 << len(base)) - 1, SLOTS), *((t, token_bits) for _, t in base)])]
    payload: list[tuple[int, int]] = []
    for at, t in enumerate(t for r in records for t in [*r, None]):
        if at in later:
            if payload:
                packets.append((PAYLOAD, payload))
                payload = []
            slot = later[at][0]
            held = {u: s for u, s in held.items() if s != slot} | {t: slot}
            packets.append((UPDATE, [(slot, 4), (t, token_bits)]))
        payload.append((0 if t is None else held[t], 4))
    if payload:
        packets.append((PAYLOAD, payload))
    w = BitWriter().unsigned(len(packets))
    for kind, values in packets:
        w.put(kind, 2).unsigned(sum(n for _, n in values))
        for v, n in values:
            w.put(v, n)
    return w.done()


def write_texts(records: list[list[int]], token_bits: int, page_size: int = PAGE) -> bytes:
    """records must come by their number of tokens."""
    lengths = [len(r) for r in records]
    if lengths != sorted(lengths):
        raise ValueError("texts come by their number of tokens")
    pages = []
    for n in sorted(set(lengths)):
        own = [r for r in records if len(r) == n]
        pages += [own[k : k + page_size] for k in range(0, len(own), page_size)]
    out = BitWriter().unsigned(len(records)).unsigned(page_size).unsigned(len(pages)).unsigned(token_bits).done()
    for p in pages:
        body = write_page(p, token_bits)
        out += BitWriter().put(0, 8).unsigned(len(p[0])).unsigned(len(p)).unsigned(len(body)).done() + body
    return out


def write_index(paths: list[list[int]], code_bits: int) -> bytes:
    depth = len(paths[0])

    def node(own: list[list[int]], d: int) -> tuple[BitWriter, int]:
        w, n = BitWriter(), 0
        if d == depth - 1:
            w.unsigned(len(own))
            for p in own:
                w.put(p[d], code_bits)
            return w, 1
        at = 0
        while at < len(own):  # neighbours of one code; the same code further on is another prefix
            end = next((k for k in range(at, len(own)) if own[k][d] != own[at][d]), len(own))
            inner, _ = node(own[at:end], d + 1)
            w.put(own[at][d], code_bits).unsigned(end - at).unsigned(inner.n).put(inner.value, inner.n)
            at, n = end, n + 1
        return w, n

    if any(len(p) != depth for p in paths):
        raise ValueError("paths have one depth")
    body, roots = node(paths, 0)
    stream = body.done()
    return BitWriter().unsigned(depth).unsigned(len(paths)).unsigned(code_bits).unsigned(roots).unsigned(len(stream)).done() + stream


def _model(names: list[str], encoding: str) -> tuple[list[bytes], list[list[int]]]:
    """Tokens, one a character, by size, falling frequency and bytes; and each name's token ids."""
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding is one of {ENCODINGS}")
    split = [[c.encode(encoding) for c in t] for t in names]
    counts: dict[bytes, int] = {}
    for cs in split:
        for c in cs:
            counts[c] = counts.get(c, 0) + 1
    tokens = sorted(counts, key=lambda c: (len(c), -counts[c], c))
    ids = {c: k for k, c in enumerate(tokens)}
    return tokens, [[ids[c] for c in cs] for cs in split]


def _head(version: bytes, metadata: str | None) -> bytes:
    text = (metadata or "").encode()
    return version.ljust(VERSION_BYTES, b"\0") + BitWriter().unsigned(len(text)).done() + text


def write_flat_book(texts: list[str], *, header: bytes, version: bytes, metadata: str | None = None, encoding: str = "utf-8", page_size: int = PAGE) -> bytes:
    """A dictionary without paths. Codes go by the number of tokens, then by the order given."""
    order = sorted(range(len(texts)), key=lambda k: (len(texts[k]), k))
    tokens, records = _model(texts, encoding)
    body = write_texts([records[k] for k in order], bits_for(len(tokens)), page_size)
    return chunk(header, _head(version, metadata)) + chunk(TOKENS, write_tokens(tokens)) + chunk(TEXTS, body)


def write_book(paths: list[list[str]], *, header: bytes, version: bytes, metadata: str | None = None, encoding: str = "utf-8", page_size: int = PAGE) -> bytes:
    """A path dictionary. header and version are the tags that a reader of the files expects."""
    names = list(dict.fromkeys(t for p in paths for t in p))
    flat = write_flat_book(names, header=header, version=version, metadata=metadata, encoding=encoding, page_size=page_size)
    order = sorted(range(len(names)), key=lambda k: (len(names[k]), k))
    code = {names[k]: c for c, k in enumerate(order)}
    return flat + chunk(INDEX, write_index([[code[t] for t in p] for p in paths], bits_for(len(names))))


# ---- Spark


def read_books(files: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """(file, code, parts) of every path of dictionaries (path, content); of a flat one, every text. A file is decoded by one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, data in zip(part["path"], part["content"]):
                b = read_book(bytes(data), encoding)
                rows = [[b["texts"][c] for c in p] for p in b["paths"]] if b["paths"] is not None else [[t] for t in b["texts"]]
                yield pd.DataFrame({"file": file, "code": range(1, len(rows) + 1), "parts": rows})

    return files.select("path", "content").mapInPandas(run, "file string, code long, parts array<string>")


def relations(files: DataFrame) -> DataFrame:
    """(file, tokens, token_bits, texts, code_bits, paths, fits) of dictionaries (path, content), from their headers alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"file": file} | book_widths(bytes(data)) for file, data in zip(part["path"], part["content"])]
            yield pd.DataFrame(rows, columns=["file", "tokens", "token_bits", "texts", "code_bits", "paths", "fits"]).astype({"code_bits": "Int64", "paths": "Int64"})

    return files.select("path", "content").mapInPandas(run, "file string, tokens long, token_bits long, texts long, code_bits long, paths long, fits boolean")


def read_book_files(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    return read_books(spark.read.format("binaryFile").load(path), encoding)


def write_books(paths: DataFrame, parts: str, order: str, *, header: bytes, version: bytes, per_file: int = 1000, encoding: str = "utf-8", flat: bool = False) -> DataFrame:
    """(path, content): dictionaries of per_file rows each along order (whole numbers from 0); flat ones hold the first part alone."""
    j = paths.select(F.format_string("%010d", F.expr(f"{order} div {per_file}")).alias("path"), F.col(order).alias("o"), F.col(parts).alias("p"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [list(p) for p in pdf.sort_values("o")["p"]]
        options = {"header": header, "version": version, "encoding": encoding}
        data = write_flat_book([r[0] for r in rows], **options) if flat else write_book(rows, **options)
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [data]})

    # a group is per_file rows
    return j.groupBy("path").applyInPandas(run, "path string, content binary")
