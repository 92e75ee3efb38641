"""Language ID with a byte convolutional network, trained here in numpy and applied to fixed-length windows.

Filters of several widths over byte embeddings, maximum over the window, softmax.
A trained filter sees bytes only, so its response is a sum of table entries: one
table for each position, two neighbouring positions folded into one table of
65,536 rows. A text is cut into windows of ``WINDOW`` bytes (all of it; the last
window is filled with zero bytes) and the windows' log odds are averaged, weighed
by their bytes.

Fitting takes at most ``SAMPLE`` labelled documents and ``WINDOWS`` windows of
each (documented bounds: the documents of least hash of their id, so the sample
does not depend on the layout of the files); prediction takes every whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0;
repeated rows are each judged; rows with a null ``doc_id`` are predicted, never
learned from; without anything learned every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import free_name, prepare, texts_of

SAMPLE = 3000
WINDOWS = 3
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 10
UNKNOWN = "und"


@dataclass
class Network:
    """Embedding (256, e), filters by width (w * e, f), their biases, and the dense layer (all filters, languages)."""

    languages: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    dense: np.ndarray
    offset: np.ndarray
    tables: dict = field(default_factory=dict)

    def prepare(self) -> None:
        """Tables by width: filter responses to single bytes and pairs of bytes at each position."""
        for w, f in self.filters.items():
            single = [(self.embed @ f[j * EMBED : (j + 1) * EMBED]).astype(np.float32) for j in range(w)]
            pairs = [(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, w - 1, 2)]
            self.tables[w] = (pairs, single[-1] if w % 2 else None)

    def log_odds(self, windows: np.ndarray) -> np.ndarray:
        """(n, WINDOW) bytes -> (n, languages)."""
        if not self.tables:
            self.prepare()
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for begin in range(0, len(windows), 256):
            part = windows[begin : begin + 256].astype(np.int32)
            pair = (part[:, :-1] << 8) | part[:, 1:]
            pooled = []
            for w, (pairs, last) in self.tables.items():
                n = WINDOW - w + 1
                h = pairs[0][pair[:, :n]]
                for j in range(1, len(pairs)):
                    h += pairs[j][pair[:, 2 * j : 2 * j + n]]
                if last is not None:
                    h += last[part[:, w - 1 : w - 1 + n]]
                pooled.append(np.maximum(h.max(1) + self.biases[w], 0))
            out[begin : begin + 256] = np.concatenate(pooled, 1) @ self.dense + self.offset
        return out


def windows_of(text: bytes) -> np.ndarray:
    """All of a text as (n, WINDOW) bytes; at least one window."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 4, batch: int = 64, rate: float = 4e-3) -> Network:
    """Adam on the cross-entropy; gradients flow through the positions that won the maximum."""
    random = np.random.default_rng(11)
    total = FILTERS * len(WIDTHS)
    p: dict[str, np.ndarray] = {"embed": random.normal(0, 0.3, (256, EMBED)), "dense": random.normal(0, 0.2, (total, len(languages))), "offset": np.zeros(len(languages))}
    for w in WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = random.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)), np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = random.permutation(len(windows))
        for begin in range(0, len(order), batch):
            x, y = windows[order[begin : begin + batch]].astype(np.int64), labels[order[begin : begin + batch]]
            n, rows = len(x), np.arange(len(x))
            e = p["embed"][x]
            pooled, won = [], {}
            for w in WIDTHS:
                cols = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], 2)
                h = cols @ p[f"f{w}"]
                won[w] = (cols, h.argmax(1))
                pooled.append(h.max(1) + p[f"b{w}"])
            z = np.concatenate(pooled, 1)
            a = np.maximum(z, 0)
            logit = a @ p["dense"] + p["offset"]
            q = np.exp(logit - logit.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[rows, y] -= 1
            q /= n
            g = {"dense": a.T @ q, "offset": q.sum(0), "embed": np.zeros_like(p["embed"])}
            dz = (q @ p["dense"].T) * (z > 0)
            for i, w in enumerate(WIDTHS):
                d = dz[:, i * FILTERS : (i + 1) * FILTERS]
                cols, at = won[w]
                best = cols[rows[:, None], at]  # n, filters, w * e
                g[f"b{w}"] = d.sum(0)
                g[f"f{w}"] = np.einsum("nf,nfk->kf", d, best)
                back = d[:, :, None] * p[f"f{w}"].T[None]
                for j in range(w):
                    np.add.at(g["embed"], x[rows[:, None], at + j], back[:, :, j * EMBED : (j + 1) * EMBED])
            step += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, p["embed"], {w: p[f"f{w}"] for w in WIDTHS}, {w: p[f"b{w}"] for w in WIDTHS}, p["dense"], p["offset"])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """Fits on windows of ``sample`` documents at most: evenly spread ones of each, so long texts do not outweigh others."""
    prepare(docs.sparkSession)
    # lang may be missing where the table is: then nothing is learned
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, lang, text in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), texts_of(b), strict=True):
                w = windows_of(text)
                picked = np.unique(np.linspace(0, len(w) - 1, WINDOWS).astype(int))
                out += [(doc, lang, int(i), w[i].tobytes()) for i in picked]
            yield pa.RecordBatch.from_pydict({k: [x[i] for x in out] for i, k in enumerate(("doc_id", "lang", "at", "bytes"))}, pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.int32()), ("bytes", pa.binary())]))

    t = rows.mapInArrow(run, "doc_id long, lang string, at int, bytes binary").toArrow().sort_by([("doc_id", "ascending"), ("at", "ascending"), ("bytes", "ascending")])
    names = t.column("lang").to_pylist()
    languages = sorted(set(names))
    windows = np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8).reshape(-1, WINDOW)
    epochs = int(np.clip(30_000 // max(1, len(windows)), 3, 30))
    return fit(windows, np.array([languages.index(x) for x in names], np.int64), languages, epochs=epochs)


def has_letter(text: bytes) -> bool:
    """Whether a text has a letter of any script."""
    return any(map(str.isalpha, text.decode()))


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """All rows and columns of ``docs``, then the language and its score, under names that no column of ``docs`` has."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(network)
    fields = [f.name for f in docs.schema]
    names = [free_name("__lang_pred", fields), free_name("__lang_score", fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = texts_of(b)
            told = np.fromiter((bool(model.languages) and has_letter(x) for x in texts), bool, len(texts))
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            where = np.flatnonzero(told)
            for begin in range(0, len(where), 64):
                some = where[begin : begin + 64]
                cut = [windows_of(texts[i]) for i in some]
                size = np.fromiter(map(len, cut), np.int64, len(cut))
                odds = model.log_odds(np.concatenate(cut))
                weight = np.full(len(odds), WINDOW, np.float32)
                weight[np.cumsum(size) - 1] = [len(texts[i]) - (n - 1) * WINDOW for i, n in zip(some, size, strict=True)]
                at = np.cumsum(size) - size
                mean = np.add.reduceat(odds * weight[:, None], at) / np.add.reduceat(weight, at)[:, None]
                q = np.exp(mean - mean.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                for i, row in zip(some, q, strict=True):
                    pred[i], score[i] = model.languages[int(row.argmax())], float(row.max())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred), pa.array(score)], names=[*fields, *names])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The contract's columns, one row per document."""
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, sample))
    return out.select("doc_id", held_out().alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score"))


def keep_known(docs: DataFrame, least_score: float = 0.0, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without rows whose language cannot be told (``und``) or is told with less than ``least_score``."""
    out = predict(docs, train(docs, sample))
    pred, score = out.columns[-2:]
    return out.where((F.col(pred) != UNKNOWN) & (F.col(score) >= least_score)).select(*docs.columns)
