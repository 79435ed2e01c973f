"""Language identification by a convolutional network over bytes, trained here with numpy.

A text is cut into windows of a fixed number of bytes (the last one padded).  In each window bytes are embedded, filters
of several widths run over them, each filter keeps its maximum, and a softmax layer gives the languages' probabilities.
A text's prediction is the mean over all its windows, weighted by their bytes.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import remainder, unused

WINDOW = 256
WIDTHS = (2, 3, 4)
#: At most so many windows of labelled texts are used to fit: from all windows of all of them, those of the smallest hashes.
SAMPLE = 24_000
_LETTER = re.compile(r"[^\W\d_]")


def windows_of(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """The whole text as rows of `size` bytes, padded with 0."""
    n = max(1, -(-len(raw) // size))
    return np.frombuffer(raw.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


@dataclass
class ByteConvNet:
    languages: list[str]
    dim: int = 8
    filters: int = 8
    parts: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        longest = max(WIDTHS)
        self.parts = {"embed": f(256, self.dim, scale=0.5), "out": f(len(WIDTHS) * self.filters, len(self.languages), scale=0.2), "bias": np.zeros(len(self.languages), np.float32), "shift": np.zeros(len(WIDTHS) * self.filters, np.float32)}
        conv = f(longest * self.dim, len(WIDTHS) * self.filters, scale=(longest * self.dim) ** -0.5)
        self.parts["conv"] = conv * self.mask()

    def mask(self) -> np.ndarray:
        """A filter narrower than the longest sees zeros beyond its width, so all widths are one matrix product."""
        m = np.zeros((max(WIDTHS), self.dim, len(WIDTHS), self.filters), np.float32)
        for i, w in enumerate(WIDTHS):
            m[:w, :, i] = 1
        return m.reshape(max(WIDTHS) * self.dim, -1)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.parts["embed"][x]
        longest = max(WIDTHS)
        view = np.lib.stride_tricks.sliding_window_view(e, longest, axis=1)  # (n, places, dim, longest)
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(x), e.shape[1] - longest + 1, -1)

    def probabilities(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        p = self.parts
        for a in range(0, len(x), block):
            peak = np.maximum((self._columns(x[a : a + block]) @ p["conv"]).max(axis=1) + p["shift"], 0)
            z = peak @ p["out"] + p["bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[a : a + block] = z / z.sum(axis=1, keepdims=True)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, passes: int = 6, rate: float = 3e-3, seed: int = 5) -> None:
        """Adam on cross-entropy; the gradient of a maximum goes to the place that had it."""
        r, mask = np.random.default_rng(seed), self.mask()
        m1, m2, t = ({k: np.zeros_like(v) for k, v in self.parts.items()} for _ in "12"), None, 0
        m1, m2 = m1
        for _ in range(passes):
            order = r.permutation(len(x))
            for a in range(0, len(x), 64):
                take = order[a : a + 64]
                bx, by, p = x[take], y[take], self.parts
                cols = self._columns(bx)
                conv = cols @ p["conv"]
                at = conv.argmax(axis=1)
                pre = np.take_along_axis(conv, at[:, None], axis=1)[:, 0] + p["shift"]
                peak = np.maximum(pre, 0)
                z = peak @ p["out"] + p["bias"]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(by)), by] -= 1
                z /= len(by)
                g = {"out": peak.T @ z, "bias": z.sum(axis=0)}
                gp = (z @ p["out"].T) * (pre > 0)
                g["shift"] = gp.sum(axis=0)
                picked = cols[np.arange(len(bx))[:, None], at]  # (n, filters, inputs)
                g["conv"] = np.einsum("nf,nfi->if", gp, picked) * mask
                gi = (gp[:, :, None] * p["conv"].T[None]).reshape(len(bx), at.shape[1], max(WIDTHS), self.dim)
                bytes_ = bx[np.arange(len(bx))[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))]
                g["embed"] = np.zeros_like(p["embed"])
                np.add.at(g["embed"], bytes_.reshape(-1), gi.reshape(-1, self.dim))
                t += 1
                for k, v in g.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    p[k] -= (rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)


def _draw(share: float):
    """(hash, lang, window): each window of a text is drawn with the same chance, by a hash of the id, the text's length
    and the window's place."""
    limit = np.uint64(min(int(share * 2.0**64), 2**64 - 1))

    def run(batches):
        for batch in tb.slices(batches):
            ids, texts, langs = batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("lang")
            out = []
            for i, size in enumerate(pc.binary_length(texts).to_pylist()):
                n = max(1, -(-size // WINDOW))
                with np.errstate(over="ignore"):
                    keys = tb.mix(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(zlib.crc32(f"{ids[i]} {size}".encode()) + 1))
                if len(drawn := np.flatnonzero(keys <= limit)):
                    every = windows_of(texts[i].as_py().encode("utf-8", "surrogatepass").lower())
                    out += [(int(keys[j] >> np.uint64(1)), langs[i].as_py(), every[j].tobytes()) for j in drawn if j < len(every)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out]), pa.array([x[2] for x in out], pa.binary())], ["key", "lang", "window"])

    return run


def fit_language_id(docs: DataFrame, sample: int = SAMPLE) -> ByteConvNet | None:
    """A network trained on a bounded sample of the windows of all labelled texts (not held out; text, doc_id and lang
    present); None without any."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).select("doc_id", "text", "lang")
    total = labelled.agg(F.sum(F.greatest(F.ceil(F.octet_length("text") / WINDOW), F.lit(1)))).first()[0]
    if not total:
        return None
    # a little more than the sample is drawn, and the smallest hashes of it are kept
    drawn = labelled.mapInArrow(_draw(1.1 * sample / total), "key long, lang string, window binary").orderBy("key", "lang", "window").limit(sample).collect()
    drawn = sorted((r[1], bytes(r[2])) for r in drawn)
    net = ByteConvNet(sorted({r[0] for r in drawn}))
    x = np.frombuffer(b"".join(r[1] for r in drawn), np.uint8).reshape(-1, WINDOW)
    y = np.array([net.languages.index(r[0]) for r in drawn])
    net.start()
    net.train(x, y)
    return net


def predict(net: ByteConvNet | None, texts: list) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text; `und` and 0 for a null text or one without letters, or without a network."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        x = np.concatenate([w for _, w in held])
        size = np.concatenate([np.maximum((w != 0).sum(axis=1), 1) for _, w in held])
        p = net.probabilities(x).astype(np.float64) * size[:, None]
        at = np.concatenate([[0], np.cumsum([len(w) for _, w in held])])
        mean = np.add.reduceat(p, at[:-1], axis=0) / np.add.reduceat(size, at[:-1])[:, None]
        for (i, _), m in zip(held, mean):
            langs[i], scores[i] = net.languages[int(m.argmax())], min(1.0, float(m.max()))
        held.clear()

    n = 0
    for i, text in enumerate(texts):
        if net is not None and text is not None and _LETTER.search(text):
            held.append((i, windows_of(text.encode("utf-8", "surrogatepass").lower())))
            n += len(held[-1][1])
            if n >= 4096:
                flush()
                n = 0
    if held:
        flush()
    return langs, scores


def _predictor(net: ByteConvNet | None, names: list[str]):
    def run(batches):
        for batch in tb.slices(batches):
            langs, scores = predict(net, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names])

    return run


def with_language(docs: DataFrame, net: ByteConvNet | None, names: tuple[str, str] = ("_lang", "_score")) -> DataFrame:
    """`docs` with language and score; only the text is looked at."""
    schema = docs.withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0)}).schema
    return docs.mapInArrow(_predictor(net, list(names)), schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `docs` (doc_id, text, lang).

    A null doc_id is not held out and not learned from.  Repeated rows are predicted alike.  Without labelled rows all
    texts are `und`.  No rows give no rows; other columns are ignored.
    """
    net = fit_language_id(docs)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return with_language(docs.select("doc_id", "text"), net).select("doc_id", held.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def identified_documents(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whatever they are called, whose language is found with a score of at least `least`.

    Null texts and texts without letters go; equal texts stay or go together.  Without labelled rows none stays.  No rows
    give no rows.
    """
    lang, score = unused(docs, "_lang", "_score")
    out = with_language(docs, fit_language_id(docs), (lang, score))
    return out.where((F.col(lang) != "und") & (F.col(score) >= least)).drop(lang, score)
