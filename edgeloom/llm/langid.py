"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network labels every byte position of a text; a document's probabilities are the mean over its positions. Texts are
read whole, in windows of a fixed number of bytes that all go through the network side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm import tokens

#: Bytes of a window, hidden units each way.
WINDOW = 64
HIDDEN = 12
#: The bounded sample the network is fitted on: documents for each language, windows of each, by hashes of their ids.
DOCS_PER_LANGUAGE = 600
WINDOWS_PER_DOC = 6
STEPS = 260
BATCH = 192
#: Windows that go through the network at once when predicting.
BLOCK = 2048
#: Rows, and about as many bytes of text, that a worker holds beside the batch it was sent.
ROWS = 512
TEXT_BYTES = 1 << 22
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class Network:
    """Parameters of both directions; ``w``: rows by byte, columns update, reset and candidate gates."""

    languages: list[str]
    w: list[np.ndarray]
    u: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [*self.w, *self.u, self.out, self.bias]


def fresh(languages: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(hidden)).astype("f4")
    # gate rows first: (3 * hidden) x bytes, so that a step's batch lies along the fast axis
    return Network(languages, [small(3 * hidden, 256) for _ in range(2)], [small(3 * hidden, hidden) for _ in range(2)], small(len(languages), 2 * hidden), np.zeros((len(languages), 1), "f4"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def run_direction(w: np.ndarray, u: np.ndarray, x: np.ndarray, back: bool, trace: list | None = None) -> np.ndarray:
    """Hidden states ``steps x hidden x batch`` for bytes ``steps x batch``; ``trace`` gets what the gradient needs."""
    steps, batch = x.shape
    hidden = u.shape[1]
    states, h = np.empty((steps, hidden, batch), "f4"), np.zeros((hidden, batch), "f4")
    for t in range(steps - 1, -1, -1) if back else range(steps):
        g, a = w[:, x[t]], u @ h
        gates = a[: 2 * hidden]
        gates += g[: 2 * hidden]
        np.clip(gates, -30, 30, out=gates)
        _sigmoid(gates)
        inner = a[2 * hidden :].copy() if trace is not None else a[2 * hidden :]
        c = inner * gates[hidden:] if trace is not None else np.multiply(inner, gates[hidden:], out=inner)
        c += g[2 * hidden :]
        np.tanh(c, out=c)
        if trace is not None:
            trace.append((t, h, gates.copy(), inner, c.copy()))
        c -= h
        c *= gates[:hidden]
        h = np.add(h, c, out=states[t])
    return states


def _logits(net: Network, states: list[np.ndarray]) -> np.ndarray:
    """``steps x languages x batch``."""
    hidden = states[0].shape[1]
    return np.matmul(net.out[:, :hidden], states[0]) + np.matmul(net.out[:, hidden:], states[1]) + net.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def loss_and_gradients(net: Network, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the positions in ``mask`` (steps x batch), and its gradients in the order of ``params``."""
    hidden = net.u[0].shape[1]
    traces: list[list] = [[], []]
    states = [run_direction(net.w[i], net.u[i], x, bool(i), traces[i]) for i in range(2)]
    p = _softmax(_logits(net, states))
    n = max(1.0, float(mask.sum()))
    at = np.arange(x.shape[1])
    loss = float(-(np.log(p[:, y, at] + 1e-9) * mask).sum() / n)
    p[:, y, at] -= 1
    p *= (mask / n)[:, None, :]
    d_out = np.concatenate([np.einsum("tcb,thb->ch", p, s) for s in states], axis=1)
    grads_w, grads_u = [], []
    for i in range(2):
        w_grad, u_grad = np.zeros_like(net.w[i]).T.copy(), np.zeros_like(net.u[i])
        down = np.zeros((hidden, x.shape[1]), "f4")
        mine = net.out[:, hidden * i : hidden * (i + 1)].T
        for t, before, gates, inner, c in reversed(traces[i]):
            d = down + mine @ p[t]
            z, r = gates[:hidden], gates[hidden:]
            d_c = d * z * (1 - c * c)
            d_inner = d_c * r
            d_z = d * (c - before) * z * (1 - z)
            d_r = d_c * inner * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_inner])
            down = d * (1 - z) + net.u[i].T @ d_a
            u_grad += d_a @ before.T
            np.add.at(w_grad, x[t], np.concatenate([d_z, d_r, d_c]).T)
        grads_w.append(w_grad.T)
        grads_u.append(u_grad)
    return loss, [*grads_w, *grads_u, d_out.astype("f4"), p.sum(axis=(0, 2))[:, None].astype("f4")]


def train(windows: list[bytes], labels: list[str], steps: int = STEPS, batch: int = BATCH, hidden: int = HIDDEN, window: int = WINDOW, seed: int = 7) -> Network:
    """Adam on balanced batches of windows, each position labelled by its document's language. Same input, same network."""
    languages = sorted(set(labels))
    net = fresh(languages, hidden, seed)
    x = np.zeros((len(windows), window), np.intp)
    mask = np.zeros((len(windows), window), "f4")
    for i, raw in enumerate(windows):
        x[i, : len(raw)] = np.frombuffer(raw, np.uint8)
        mask[i, : len(raw)] = 1
    of = {c: np.array([i for i, y in enumerate(labels) if y == c]) for c in languages}
    rng = np.random.default_rng(seed + 1)
    first, second = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), batch)
        at = np.array([rng.choice(of[languages[c]]) for c in y])
        _, grads = loss_and_gradients(net, np.ascontiguousarray(x[at].T), y, np.ascontiguousarray(mask[at].T))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for p, g, m, v in zip(net.params(), grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype("f4")
    return net


def predict(net: Network, texts: list[bytes], window: int = WINDOW, block: int = BLOCK) -> np.ndarray:
    """Mean probabilities over all byte positions of each text; empty texts get zeros."""
    sizes = np.array([len(t) for t in texts], np.int64)
    parts = -(-sizes // window)
    total = int(parts.sum())
    flat = np.zeros(total * window, np.uint8)
    owner = np.repeat(np.arange(len(texts)), parts)
    starts = (np.cumsum(parts) - parts) * window
    for t, s in zip(texts, starts.tolist(), strict=True):
        flat[s : s + len(t)] = np.frombuffer(t, np.uint8)
    inside = np.full(total, window, np.int64)
    ends = np.cumsum(parts)[parts > 0] - 1
    inside[ends] = (sizes - (parts - 1) * window)[parts > 0]
    rows = flat.reshape(total, window)
    sums = np.zeros((len(texts), len(net.languages)))
    for i in range(0, total, block):
        x = np.ascontiguousarray(rows[i : i + block].T).astype(np.intp)
        p = _softmax(_logits(net, [run_direction(net.w[k], net.u[k], x, bool(k)) for k in range(2)]))
        n = inside[i : i + block]
        if (n < window).any():
            p *= (np.arange(window)[:, None] < n[None, :])[:, None, :]
        np.add.at(sums, owner[i : i + block], p.sum(axis=0).T)
    return sums / np.maximum(sizes, 1)[:, None]


def held_out(doc_id) -> F.Column:
    """Whether a document stays out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample_windows(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, per_doc: int = WINDOWS_PER_DOC, window: int = WINDOW) -> tuple[list[bytes], list[str]]:
    """Training windows and their labels: a bounded sample of labelled documents outside the held-out part.

    Documents are drawn by hashes of their ids, windows by hashes of id and number anywhere in the text. Only ids with hashes so
    small that about twice as many are left as wanted are ranked: what meets in one place does not grow with the table.
    """
    fit = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    counted = F.broadcast(fit.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))  # a row for each language
    low = F.xxhash64("doc_id") / 2.0**64 + 0.5 < (2.0 * per_language + 200) / F.col("n")
    ids = fit.select("doc_id", "lang").join(counted, "lang").where(low).withColumn("r", rank).where(F.col("r") <= per_language).select("doc_id").distinct()
    drawn = fit.select("doc_id", F.col("lang").cast("string"), "text").join(F.broadcast(ids), "doc_id", "left_semi")  # bounded by per_language

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, lang, raw = [], [], []
            for d, y, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode()
                if not LETTER.search(text):
                    continue
                rng = np.random.default_rng([int(d) & 0x7FFFFFFFFFFFFFFF, len(data)])
                for s in rng.integers(0, max(1, len(data) - window + 1), per_doc):
                    doc.append(d), lang.append(y), raw.append(data[s : s + window])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lang, pa.string()), pa.array(raw, pa.binary())], names=["doc_id", "lang", "raw"])

    got = drawn.mapInArrow(cut, "doc_id long, lang string, raw binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("raw", "ascending")])
    return got["raw"].to_pylist(), got["lang"].to_pylist()


def fit(docs: DataFrame, steps: int = STEPS) -> Network | None:
    """The network for a table's labelled documents; none without any."""
    windows, labels = sample_windows(docs)
    return train(windows, labels, steps) if labels else None


def named(net: Network | None, batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, their last column, the texts, replaced by languages and scores."""
    tokens.forget()  # a stage before may have left its tokenizer in this worker
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            b = batch.slice(first, ROWS)
            texts = b.column(b.num_columns - 1).to_pylist()
            known = [net is not None and t is not None and bool(LETTER.search(t)) for t in texts]
            lang: list[str] = []
            score: list[float] = []
            at, held, size = 0, [], 0
            for i, (t, k) in enumerate(zip(texts, known, strict=True)):
                held.append(t.encode() if k else b"")
                size += len(held[-1])
                if size >= TEXT_BYTES or i + 1 == len(texts):
                    p = predict(net, held) if net is not None else np.zeros((len(held), 1))
                    best = p.argmax(axis=1)
                    for j in range(len(held)):
                        lang.append(net.languages[best[j]] if known[at + j] else UNKNOWN)
                        score.append(float(min(1.0, p[j, best[j]])) if known[at + j] else 0.0)
                    at, held, size = i + 1, [], 0
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=columns)


def identify(docs: DataFrame, net: Network | None, column: str = "text", carry: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (mean probability of the language over all positions) to the carried columns.

    ``und`` with score 0 for a null text, one without a letter (Unicode category L), or without a network. Carried columns
    (all by default) of the same names give way; pass other ``names`` to keep them.
    """
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in names]
    inner = docs.select(*[F.col(c) for c in carry], F.col(column).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return named(sent.value, batches, [*carry, *names])

    return inner.mapInArrow(run, f"{schema + ', ' if schema else ''}`{names[0]}` string, `{names[1]}` double")
