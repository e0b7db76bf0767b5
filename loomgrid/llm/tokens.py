"""Token ids of whole texts by the tokenizers library, with each distinct piece of a batch encoded once.

A text is cut where neither tokenizer's pre-token can reach across: before a run of white space, after one that the next
pre-token cannot take in, and between a letter and ASCII punctuation. Pieces then encode alone exactly as in the text,
so a batch encodes its distinct pieces and gathers their ids. A text with white space beyond ASCII, or with the string of
a special token, is not cut at all: the library's own call on the whole text gives its ids.

Where to cut follows from the tokenizer file's normalizer and pre-tokenizer. A file with others than the two forms known
here is encoded by the library alone, text by text.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_bytes

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
KEPT_PIECES = 150_000


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte, by the published rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


def odd_space(raw: np.ndarray) -> np.ndarray:
    """Positions of the first bytes of white-space characters beyond ASCII."""
    at = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
    if not len(at):
        return at
    padded = np.concatenate([raw, np.zeros(2, np.uint8)])
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    ogham = (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    punct = (a == 0xE2) & (((b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    wide = (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return at[two | ogham | punct | wide]


#: What a file must say for its texts to be cut: forms of public tokenizers.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORDS = [{"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
_WORD_FORM = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def _has(given: dict | None, wanted: dict) -> bool:
    return given is not None and all(given.get(k) == v for k, v in wanted.items())


def keeps_space(form: dict) -> bool | None:
    """Whether white space is part of a file's ids (byte-level) or dropped (word-level); None for a file of another form."""
    before, split = form.get("normalizer"), form.get("pre_tokenizer")
    if form.get("model", {}).get("type") != "BPE" or any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") or t.get("single_word") or t["content"].isalpha() for t in form.get("added_tokens", [])):
        return None
    if before is None and _has(split, _BYTES):
        return True
    steps = (split or {}).get("pretokenizers", [])
    if before == {"type": "Sequence", "normalizers": _WORD_FORM} and len(steps) == 2 and all(map(_has, steps, _WORDS)):
        return False
    return None


class PieceEncoder:
    """Ids of a tokenizer file as the library gives them for whole texts with its default settings."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        form = json.loads(self.tok.to_str())
        self.specials = [t["content"] for t in form.get("added_tokens", [])]
        self.keeps_space = keeps_space(form)
        self.symbols = str.maketrans({chr(b): c for b, c in byte_symbols().items()})
        self.blank = chr(32).translate(self.symbols)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _simple(self, text: str) -> str | None:
        """What the model sees of a piece that is one pre-token of Latin letters; else None."""
        word = text[1:] if self.keeps_space and text[:1] == " " else text
        if not word.isalpha():
            return None
        if text.isascii():
            if self.keeps_space:
                return text if word is text else self.blank + word
            return word.lower()
        if max(word) > "ɏ" or "İ" in word:
            return None
        if not self.keeps_space:
            text = unicodedata.normalize("NFC", word).lower()
        return text.encode().decode("latin-1").translate(self.symbols)

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        sizes = [0] * len(pieces)
        flat: list[int] = []
        rest: list[int] = []
        texts: list[str] = []
        tokenize = self.model.tokenize
        for i, piece in enumerate(pieces):
            text = piece.decode()
            simple = self._simple(text)
            if simple is None:
                rest.append(i)
                texts.append(text)
            else:
                found = tokenize(simple)
                sizes[i] = len(found)
                flat += [t.id for t in found]
        raw, at, out = np.array(flat, np.uint32).tobytes(), 0, [b""] * len(pieces)
        for i, n in enumerate(sizes):
            if n:
                out[i] = raw[at : at + 4 * n]
                at += 4 * n
        if rest:
            for i, e in zip(rest, self.tok.encode_batch(texts, add_special_tokens=False)):
                out[i] = np.array(e.ids, np.uint32).tobytes()
        return out

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        young, old = self.young, self.old
        out = [young.get(p) for p in pieces]
        missing = [i for i, x in enumerate(out) if x is None]
        todo = []
        for i in missing:
            found = old.get(pieces[i])
            if found is None:
                todo.append(i)
            else:
                out[i] = young[pieces[i]] = found
        for i, ids in zip(todo, self._encode([pieces[i] for i in todo])):
            out[i] = ids
            if len(pieces[i]) <= 64:
                young[pieces[i]] = ids
        if len(young) > KEPT_PIECES:
            self.old, self.young = young, {}
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of a string column's texts in one array, and n + 1 offsets."""
        raw, offs = text_bytes(column)
        n = len(offs) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if self.keeps_space is None:
            found = self.tok.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)
            return np.array([i for e in found for i in e.ids], np.uint32), np.concatenate([[0], np.cumsum([len(e.ids) for e in found])]).astype(np.int64)
        space, prev = _SPACE[raw], np.empty(len(raw), np.uint8)
        prev[0], prev[1:] = 0, raw[:-1]
        was_space = _SPACE[prev]
        start = space & ~was_space
        if self.keeps_space:  # a run of one that is no blank stands alone; a longer run depends on what follows it
            lone = was_space & (prev != 32)
            lone[2:] &= ~space[:-2]
            start |= ~space & lone
        else:
            start |= ~space & was_space
        letter = _LETTER[prev]
        two = np.zeros(len(raw), bool)
        two[2:] = (raw[:-2] == 0xC3) & (prev[2:] != 0x97) & (prev[2:] != 0xB7)
        start |= _PUNCT[raw] & (letter | two)
        odd = np.searchsorted(offs, odd_space(raw), "right") - 1
        for s in self.specials:
            odd = np.append(odd, np.flatnonzero(pc.fill_null(pc.match_substring(column, s), False).to_numpy(zero_copy_only=False)))
        for r in np.unique(odd):
            start[offs[r] : offs[r + 1]] = False
        first = offs[:-1][np.diff(offs) > 0]
        start[first] = True
        at = np.flatnonzero(start)
        edges = pa.py_buffer(np.append(at, len(raw)).astype(np.int64))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, edges, pa.py_buffer(raw)])
        if not self.keeps_space:
            keep = ~space[at] | (np.isin(at, first) if len(odd) else False)
            words, at = words.filter(pa.array(keep)), at[keep]
        coded = words.dictionary_encode()
        index = coded.indices.to_numpy()
        ids = self._ids_of(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), np.uint32)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        base = np.cumsum(size) - size
        each = size[index]
        total = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each, out=total[1:])
        gather = np.arange(total[-1]) + np.repeat(base[index] - total[:-1], each)
        row_piece = np.searchsorted(at, offs)  # the first piece of each row
        return flat[gather], total[row_piece]


_made: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker, kept between batches."""
    if path not in _made:
        _made[path] = PieceEncoder(path)
    return _made[path]
