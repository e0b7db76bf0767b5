"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams between boundary marks; n-grams are hashed into a table of vectors, so an
unseen misspelling shares most vectors with the word it bends. A text is the weighted mean of its n-grams' vectors, a
frequent n-gram weighing less, and a softmax over two classes reads that mean. Vectors and softmax are trained together.

As the softmax is linear, an n-gram's share of a text's score is one number, so a batch scores its distinct words once.

Learned on the driver from at most max_labelled labelled rows of at most max_bytes of text, chosen by hashes; every text
is scored whole. The score is calibrated on texts that a part of the training left out, so that the least-cost line
between the two kinds of labelled texts lies at the threshold.

Defined results: null, empty or wordless texts get the score of the bias alone; repeated rows each get a row and teach
once; null doc_id stays null; other columns of the documents and of the labels are dropped, also those named like a result; an
empty table gives no rows; without labels of both kinds every
score is the share of toxic labels (0 if there are none). A very long text is one slice of its own, scored whole. A text
of several labels is toxic if one says so; of equally good lines between the kinds the highest is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, fold, gathered, text_bytes, tidy

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[36] = _WORD[64] = True  # $ and @ stand in for letters
_WORD[128:] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all rows (binary), and n + 1 offsets of the rows among them."""
    raw, offs = text_bytes(column)
    raw = _LOW[raw]
    inside = _WORD[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offs[:-1][np.diff(offs) > 0]
    begin[heads] = inside[heads]
    stop = ~inside
    stop[heads] = True
    starts = np.flatnonzero(begin)
    marks = np.append(np.flatnonzero(stop), len(raw))
    ends = marks[np.searchsorted(marks, starts, "right")]
    # gaps between words are entries too, and dropped
    edges = np.empty(2 * len(starts) + 1, np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = starts, ends, len(raw)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(edges), pa.py_buffer(raw)])
    return whole.take(pa.array(np.arange(0, 2 * len(starts), 2))), np.searchsorted(starts, offs)


def subwords(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' character n-grams, and the word of each."""
    text = "".join(f"<{w.decode(errors='replace')}>" for w in vocabulary)
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w.decode(errors="replace")) + 2 for w in vocabulary), np.int64, len(vocabulary))
    word = np.repeat(np.arange(len(vocabulary)), size)
    buckets, owners = [], []
    for n in SIZES:
        if len(c) < n:
            continue
        m = len(c) - n + 1
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = (h ^ c[j : j + m]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        same = word[:m] == word[n - 1 :]
        buckets.append((h[same] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(word[:m][same])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass(frozen=True)
class ToxicityModel:
    value: np.ndarray  # an n-gram's weight times its share of the log odds
    weight: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(column), -40, 40)))

    def log_odds(self, column: pa.Array) -> np.ndarray:
        found, rows = words(column)
        coded = found.dictionary_encode()
        bucket, word = subwords(coded.dictionary.to_pylist())
        n = len(coded.dictionary)
        top = np.bincount(word, self.value[bucket], n)
        below = np.bincount(word, self.weight[bucket], n)
        index = coded.indices.to_numpy()
        top = np.concatenate([[0.0], np.cumsum(top[index])])
        below = np.concatenate([[0.0], np.cumsum(below[index])])
        a, b = rows[:-1], rows[1:]
        mean = (top[b] - top[a]) / np.maximum(below[b] - below[a], 1e-9)
        mean[a == b] = 0
        return mean + self.bias


def bags(texts: list[str], block: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of each text's n-grams."""
    t, b, n = [], [], []
    for i in range(0, len(texts), block):
        found, rows = words(pa.array(texts[i : i + block], pa.string()))
        coded = found.dictionary_encode()
        bucket, word = subwords(coded.dictionary.to_pylist())
        by_word = np.argsort(word, kind="stable")
        bucket, size = bucket[by_word], np.bincount(word, minlength=len(coded.dictionary))
        first = np.cumsum(size) - size
        index = coded.indices.to_numpy()
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        each = size[index]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[index], each)
        key, count = np.unique(np.repeat(row, each) * BUCKETS + bucket[at], return_counts=True)
        t.append(key // BUCKETS + i)
        b.append(key % BUCKETS)
        n.append(count)
    return np.concatenate(t), np.concatenate(b), np.concatenate(n)


def train(texts: list[str], toxic: np.ndarray, *, dims: int = 8, epochs: int = 12, batch: int = 64, rate: float = 0.3, common: float = 2e-4, l2: float = 1e-6, seed: int = 3) -> ToxicityModel:
    share = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < share < 1:
        p = min(max(share, 1e-9), 1 - 1e-9)
        return ToxicityModel(np.zeros(BUCKETS), np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    text, bucket, count = bags(texts)
    freq = np.bincount(bucket, count, BUCKETS) / max(1, count.sum())
    weight = common / (common + freq)
    w = count * weight[bucket]
    w = w / np.maximum(np.bincount(text, w, len(texts)), 1e-9)[text]
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    rng = np.random.default_rng(seed)
    vec = rng.normal(0, 0.1, (BUCKETS, dims))
    soft = rng.normal(0, 0.1, (dims, 2))
    bias = np.log(np.array([1 - share, share]))
    seen_v, seen_s, seen_b = np.full(BUCKETS, 1e-8), np.full((dims, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            ids = np.sort(order[k : k + batch])
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in ids])
            size = first[ids + 1] - first[ids]
            own = np.repeat(np.arange(len(ids)), size)
            bk, wt = bucket[at], w[at]
            mean = np.stack([np.bincount(own, wt * vec[bk, d], len(ids)) for d in range(dims)], 1)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ids)), toxic[ids].astype(int)] -= 1
            g_mean = p @ soft.T
            gs, gb = mean.T @ p / len(ids), p.sum(0) / len(ids)
            uniq, inv = np.unique(bk, return_inverse=True)
            gv = np.stack([np.bincount(inv, wt * g_mean[own, d], len(uniq)) for d in range(dims)], 1) + l2 * vec[uniq]
            # one adaptive rate a vector: what is rare but telling moves as fast as what is common
            seen_v[uniq] += (gv**2).mean(1)
            vec[uniq] -= rate * gv / np.sqrt(seen_v[uniq])[:, None]
            seen_s += gs**2
            soft -= rate * gs / np.sqrt(seen_s)
            seen_b += gb**2
            bias -= 0.1 * rate * gb / np.sqrt(seen_b)
    line = soft[:, 1] - soft[:, 0]
    return ToxicityModel((vec @ line) * weight, weight, float(bias[1] - bias[0]))


def cut_line(score: np.ndarray, toxic: np.ndarray, clean_weight: float) -> float:
    """The score (log odds) above which the share of toxic texts, less the weighted share of clean ones, is largest."""
    order = np.argsort(-score, kind="stable")
    s, t = score[order], toxic[order]
    gain = np.cumsum(t) / t.sum() - clean_weight * np.cumsum(~t) / (~t).sum()
    gain[:-1][s[:-1] == s[1:]] = -np.inf  # equal scores are on one side
    k = int(np.argmax(gain))
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


def calibrated(texts: list[str], toxic: np.ndarray, threshold: float, *, folds: int = 3, clean_weight: float = 5.0, least: int = 12) -> ToxicityModel:
    """A model of all texts, its bias moved so that the line found on texts left out of training has score threshold.

    With fewer than `least` texts of a kind the bias stays as it was trained.
    """
    model = train(texts, toxic)
    if min(toxic.sum(), (~toxic).sum()) < least:
        return model
    fold_of, found = np.arange(len(texts)) % folds, np.zeros(len(texts))
    for k in range(folds):
        part = train([t for t, f in zip(texts, fold_of) if f != k], toxic[fold_of != k])
        found[fold_of == k] = part.log_odds(pa.array([t for t, f in zip(texts, fold_of) if f == k], pa.string()))
    move = float(np.log(threshold / (1 - threshold))) - cut_line(found, toxic, clean_weight)
    return ToxicityModel(model.value, model.weight, model.bias + move)


def labelled_texts(docs: DataFrame, labels: DataFrame, max_labelled: int, max_bytes: int) -> tuple[list[str], np.ndarray]:
    """Labelled texts outside the held-out fold, at most max_labelled and max_bytes of them, chosen by hashes of ids and rows."""
    teach = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in bounded_rows(teach, max_labelled)], "doc_id long, toxic int")
    # at most max_labelled ids
    known = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    rows = bounded_rows(known, max_labelled, max_bytes, "text")
    return [r["text"] for r in rows], np.array([r["toxic"] == 1 for r in rows], bool)


def toxicity(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 3000, max_bytes: int = 64 << 20, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    texts, toxic = labelled_texts(docs, labels, max_labelled, max_bytes)
    sent = spark.sparkContext.broadcast(calibrated(texts, toxic, threshold))  # two numbers a bucket, at any input size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in gathered(batches):
            score = model.score(part["text"].combine_chunks())
            yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks().cast(pa.int64()), part["held_out"].combine_chunks(), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "text").mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")
