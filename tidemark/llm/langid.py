"""Language identification by a byte convolutional network trained in numpy.

A text is its UTF-8 bytes cut into windows of a fixed length, the last one padded. Each byte has a learned vector;
filters of several widths slide over a window, are rectified and max-pooled, and a softmax names the language. A
text's prediction is the mean log probability over all its windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, in_batches

UNDETERMINED = "und"
WINDOW_BYTES = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
# Bound of the training sample: rows, and text pieces of PIECE_CHARS code points taken from each.
SAMPLE_ROWS = 3000
PIECES = 3
PIECE_CHARS = 160


@dataclass
class ByteNet:
    """Parameters: byte vectors, one filter bank of the largest width (narrow filters end in zeros), softmax."""

    labels: list[str]
    table: np.ndarray
    bank: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    mask: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator) -> ByteNet:
        top, n = max(WIDTHS), FILTERS * len(WIDTHS)
        mask = np.zeros((top * EMBED, n), np.float32)
        for k, width in enumerate(WIDTHS):
            mask[: width * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        return cls(labels, normal(256, EMBED) * 0.5, normal(top * EMBED, n) * 0.2 * mask, np.zeros(n, np.float32), normal(n, len(labels)) * 0.1, np.zeros(len(labels), np.float32), mask)

    def forward(self, windows: np.ndarray):
        n, length = windows.shape
        top = max(WIDTHS)
        vectors = self.table[np.pad(windows, ((0, 0), (0, top - 1)))]
        cols = np.lib.stride_tricks.sliding_window_view(vectors.reshape(n, -1), top * EMBED, axis=1)[:, ::EMBED]
        cols = np.ascontiguousarray(cols).reshape(n * length, -1)
        found = (cols @ self.bank).reshape(n, length, -1)
        pooled = np.maximum(found.max(axis=1) + self.bias, 0)
        logits = pooled @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        logp = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return logp, pooled, found, cols

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        logp, pooled, found, cols = self.forward(windows)
        n, length = windows.shape
        top = max(WIDTHS)
        d_logits = np.exp(logp)
        d_logits[np.arange(n), target] -= 1
        d_logits /= n
        d_pooled = (d_logits @ self.out.T) * (pooled > 0)
        where = found.argmax(axis=1)
        at = (np.arange(n)[:, None] * length + where).ravel()
        chosen = cols[at].reshape(n, -1, top * EMBED)
        d_bank = np.einsum("nf,nfe->ef", d_pooled, chosen) * self.mask
        d_cols = (d_pooled[:, :, None] * self.bank.T[None]).reshape(-1, top, EMBED)
        d_table = np.zeros_like(self.table)
        padded = np.pad(windows, ((0, 0), (0, top - 1)))
        rows = np.repeat(np.arange(n), where.shape[1])
        for k in range(top):
            np.add.at(d_table, padded[rows, where.ravel() + k], d_cols[:, k])
        return [d_table, d_bank, d_pooled.sum(axis=0), pooled.T @ d_logits, d_logits.sum(axis=0)]


def windows_of(data: bytes, length: int = WINDOW_BYTES) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.pad(raw, (0, -len(raw) % length)).reshape(-1, length)


def train(texts: list[str], labels: list[str], epochs: int = 6, seed: int = 7) -> ByteNet:
    """Adam on single windows, order and start drawn from the seed."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = ByteNet.fresh(names, rng)
    parts = [windows_of(t.encode("utf-8", "replace")) for t in texts]
    data = np.concatenate(parts)
    target = np.repeat([names.index(x) for x in labels], [len(p) for p in parts])
    fields = ("table", "bank", "bias", "out", "out_bias")
    first = [np.zeros_like(getattr(net, f)) for f in fields]
    second = [np.zeros_like(getattr(net, f)) for f in fields]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), 64):
            pick = order[a : a + 64]
            step += 1
            for k, (field, grad) in enumerate(zip(fields, net.gradients(data[pick], target[pick]))):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                getattr(net, field)[...] -= (0.004 * move).astype(np.float32)
    return net


def training_sample(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, lang): at most sample_rows labelled rows, even over the languages, in pieces of bounded length.

    A row enters where the hash of its doc_id falls under its language's share, so no language is ordered or windowed as
    a whole. What is sent to every task is one count per language, which the network's output layer must hold
    as well, and then the keys of at most sample_rows rows; texts are not shuffled before they are chosen.
    """
    named = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text rlike '\\\\p{L}'")
    counts = named.groupBy("lang").count()
    share = F.lit(float(sample_rows)) / F.count("*").over(_everything()) / F.col("count")
    unit = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    rated = named.select("doc_id", "lang").join(F.broadcast(counts.select("lang", share.alias("share"))), "lang").where(unit < F.col("share"))
    keys = rated.orderBy(*order).limit(sample_rows).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    chosen = named.join(F.broadcast(keys), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")
    spread = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - PIECE_CHARS, F.lit(1))).cast("int") + 1 for k in range(PIECES)]
    pieces = F.array_distinct(F.array(*(F.col("text").substr(at, F.lit(PIECE_CHARS)) for at in spread)))
    return chosen.orderBy(*order).limit(sample_rows).select(F.explode(pieces).alias("text"), "lang")


def _everything():
    from pyspark.sql import Window

    # Over one row per language.
    return Window.partitionBy()


def scrambled(text: str, seed: int) -> str:
    """The text's characters in random order: no language, but the same letters."""
    return "".join(np.random.default_rng(seed).permutation(list(text)))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, with_reject: bool = False) -> ByteNet | None:
    """A network from labelled rows; None without any.

    With a reject class every fourth piece is learned a second time with its characters in random order, as `und`:
    a text without the byte sequences of any language then has a class of its own to go to.
    """
    rows = training_sample(docs, sample_rows).toPandas().sort_values(["lang", "text"])
    texts, names = rows["text"].tolist(), rows["lang"].tolist()
    if with_reject:
        noise = [scrambled(t, k) for k, t in enumerate(texts[::4])]
        texts, names = texts + noise, names + [UNDETERMINED] * len(noise)
    return train(texts, names) if len(rows) else None


def score_texts(net: ByteNet, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and probability of whole texts; all windows of all texts go through the network in small batches."""
    parts = [windows_of(t.encode("utf-8", "replace")) for t in texts]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    total = np.zeros((len(parts), len(net.labels)))
    data = np.concatenate(parts)
    for a in range(0, len(data), 256):
        logp = net.forward(data[a : a + 256])[0]
        np.add.at(total, owner[a : a + 256], logp)
    mean = total / np.maximum(np.bincount(owner, minlength=len(parts)), 1)[:, None]
    share = np.exp(mean - mean.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    return [net.labels[k] for k in best], share[np.arange(len(parts)), best].clip(0, 1).tolist()


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """docs with lang_pred and score; `und` and 0 where a text is null or has no letter, or nothing was learned.

    Texts are read whole; equal texts, repeated rows included, get equal answers, and of languages that tie the first by name
    counts. An empty table gives no rows. Every other column passes unchanged (columns named lang_pred or score are replaced).
    """
    base = docs.drop("lang_pred", "score")
    mark = free_name(base, "_letters")
    rated = base.withColumn(mark, F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    schema = base.schema
    for name, kind in (("lang_pred", "string"), ("score", "double")):
        schema = schema.add(name, kind)

    def rate(frames):
        for frame in frames:
            letters = frame.pop(mark).to_numpy(bool)
            names, scores = np.full(len(frame), UNDETERMINED, object), np.zeros(len(frame))
            rows = np.flatnonzero(letters) if net else []
            for a in range(0, len(rows), 128):
                pick = rows[a : a + 128]
                names[pick], scores[pick] = score_texts(net, frame["text"].iloc[pick].tolist())
            yield frame.assign(lang_pred=names, score=scores)

    return in_batches(rated, rate, schema)


def held_out(doc_id="doc_id"):
    """True for the third of the rows that training never sees; a null id counts as learnable."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
