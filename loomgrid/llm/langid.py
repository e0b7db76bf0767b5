"""Language ID by error-correcting output codes.

Each language has a codeword; each bit of it is predicted by a linear classifier over hashed byte n-grams of the text.
Decoding sums each bit's logistic loss, weighted by how well that bit was learned for that language, and takes the
codeword of the least loss. Where the runner-up is nearly as near, the text is marked ambiguous.

Learned on the driver in numpy from at most max_labelled labelled rows of at most max_bytes of text, chosen by a hash of
the row, languages in turns, so that a rare one is learned too; every text is scored in Arrow batches, in slices of bounded size.

Defined results: a null text or one without a letter is 'und' with score 0; labels that are null don't teach; repeated
rows each get a row and teach once; null doc_id stays null and counts as the empty string in the fold; other columns are
dropped, also those named like a result; if nothing can be learned, every text is 'und'; an empty table gives no rows. A very long text is one slice of
its own, scored whole, in memory of some times its size. Of equally near codewords the language first in the alphabet is
taken; its gap is 0, so the text is ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, fold, gathered, text_bytes, tidy

DIMS = 4096
UNDEFINED = "und"
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[65:91] += 32
_CLASS[:32] = 32
_CLASS[48:58] = 48


def ngram_features(column: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed byte bigrams and trigrams: rows of length 1 (0 for a text of under two bytes)."""
    raw, offs = text_bytes(column)
    n = len(offs) - 1
    c = _CLASS[raw]
    if len(c) < 2:
        return np.zeros((n, DIMS), np.float32)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offs))
    two = (c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)) >> np.uint32(21)
    same = row[:-1] == row[1:]
    counts = np.bincount(row[:-1][same] * DIMS + two[same], minlength=n * DIMS).astype(np.float32)
    if len(c) > 2:
        three = ((c[:-2] * np.uint32(0xC2B2AE3D) + c[1:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)) >> np.uint32(21)) + np.uint32(2048)
        same = row[:-2] == row[2:]
        counts += np.bincount(row[:-2][same] * DIMS + three[same], minlength=n * DIMS)
    x = counts.reshape(n, DIMS)
    return np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))


def codewords(classes: int, bits: int, seed: int = 7) -> np.ndarray:
    """classes x bits of -1 and 1, far apart; every split of the classes once if there are few enough."""
    if classes == 1:
        return np.ones((1, 1), np.int8)
    if 2 ** (classes - 1) - 1 <= bits:
        splits = np.arange(1, 2 ** (classes - 1))
        return np.where((splits[None, :] >> np.arange(classes)[:, None]) & 1, 1, -1).astype(np.int8)
    rng, best = np.random.default_rng(seed), None
    for _ in range(300):
        m = rng.choice(np.array([-1, 1], np.int8), (classes, bits))
        if (np.abs(m.sum(0)) == classes).any():
            continue
        near = (m.astype(int) @ m.T - 2 * bits * np.eye(classes, dtype=int)).max()
        if best is None or near < best[0]:
            best = (near, m)
    return best[1] if best else np.where(np.eye(classes, dtype=bool), 1, -1).astype(np.int8)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray  # DIMS x bits
    bias: np.ndarray
    trust: np.ndarray  # classes x bits, rows sum to 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        f = x @ self.weights + self.bias
        per_bit = np.logaddexp(0, -f[:, None, :] * self.codes[None])
        return (per_bit * self.trust[None]).sum(2)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, score of it, and gap to the runner-up's score."""
        loss = self.losses(x) * self.codes.shape[1]
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, 1)
        return loss.argmin(1), p.max(1), order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)


def code_bits(classes: int) -> int:
    """Bits of a codeword: they grow with the logarithm of the classes, so that codewords stay about a quarter of them apart."""
    return max(15, math.ceil(10 * math.log2(classes)))


def train(x: np.ndarray, labels: list[str], *, bits: int | None = None, steps: int = 150, rate: float = 8.0, l2: float = 1e-5) -> LanguageModel | None:
    langs = tuple(sorted(set(labels)))
    if not langs:
        return None
    y = np.array([langs.index(v) for v in labels])
    codes = codewords(len(langs), bits or code_bits(len(langs)))
    target = codes[y].astype(np.float32)
    share = np.bincount(y, minlength=len(langs))
    sample = (1 / share[y]).astype(np.float32)[:, None]
    sample *= len(y) / sample.sum()  # each language counts the same
    w, b = np.zeros((DIMS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        f = x @ (w + 0.9 * vw) + b + 0.9 * vb
        g = -target * sample / (1 + np.exp(np.clip(target * f, -30, 30))) / len(y)
        vw = 0.9 * vw - rate * (x.T @ g + l2 * w)
        vb = 0.9 * vb - rate * g.sum(0)
        w, b = w + vw, b + vb
    right = ((x @ w + b) * target > 0).astype(np.float64)
    trust = np.array([right[y == k].mean(0) for k in range(len(langs))])
    trust = np.maximum(trust - 0.5, 0.01)
    return LanguageModel(langs, codes, w, b, trust / trust.sum(1, keepdims=True))


def labelled_texts(docs: DataFrame, max_labelled: int, max_bytes: int) -> tuple[list[str], list[str]]:
    """Labelled texts outside the held-out fold, at most max_labelled and max_bytes of them, chosen by a hash of the row; languages take turns."""
    teach = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 2)).select("doc_id", "text", "lang")
    rows = bounded_rows(teach, max_labelled, max_bytes, "text", "lang")
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def has_letter(column: pa.Array) -> np.ndarray:
    raw, offs = text_bytes(column)
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(letter)])
    out = total[offs[1:]] > total[offs[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[i] = any(map(str.isalpha, column[int(i)].as_py()))
    return out


def language_id(docs: DataFrame, *, max_labelled: int = 3000, max_bytes: int = 64 << 20, ambiguous_gap: float = 0.2, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, and columns of docs named in carry."""
    spark = docs.sparkSession
    texts, labels = labelled_texts(docs, max_labelled, max_bytes)
    model = train(np.concatenate([ngram_features(pa.array(texts[i : i + 500], pa.string())) for i in range(0, len(texts), 500)]), labels) if texts else None
    sent = spark.sparkContext.broadcast(model)  # DIMS x bits floats, at any input size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in gathered(batches, most=1 << 20):
            text = part["text"].combine_chunks()
            known = has_letter(text)
            if m is None:
                known[:] = False
                best, score, gap = np.zeros(len(text), int), np.zeros(len(text)), np.zeros(len(text))
                names = np.array([UNDEFINED], object)
            else:
                found = [m.predict(ngram_features(text[i : i + 500])) for i in range(0, len(text), 500)]
                best, score, gap = (np.concatenate(v) for v in zip(*found))
                names = np.array(m.langs, object)
            lang = np.where(known, names[best], UNDEFINED)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].combine_chunks().cast(pa.int64()), part["held_out"].combine_chunks(), pa.array(lang.tolist(), pa.string()), pa.array(np.where(known, score, 0.0).astype(np.float64)), pa.array(known & (gap < ambiguous_gap)), *(part[c].combine_chunks() for c in carry)],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous", *carry],
            )

    schema = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean" + "".join(f", `{c}` {kind}" for c in carry for name, kind in docs.dtypes if name == c)
    # a prediction sees the text alone; carried columns pass by it
    return docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "text", *(c for c in carry if c != "text")).mapInArrow(tidy(run), schema)
