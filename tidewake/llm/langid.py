"""Language identification by a byte convolutional network in numpy.

A text's UTF-8 bytes are cut into windows of fixed length. Each byte has a small vector; filters of several widths run
over the window, the greatest response of each filter is kept, and a softmax over these gives the languages. A text's
answer is the mean of the probabilities of all its windows, weighted by their bytes, so the whole text counts.

Training takes a bounded sample: of the windows of labelled rows the SAMPLE_WINDOWS with the least hash for each
language. The sample goes to the driver, which fits the network; batches of windows are scored in the tasks.

Cases: a null text or one without a letter is `und` with score 0; with no labelled row at all every text is `und`; equal
texts get equal answers, to six decimals; ties go to the language that sorts first; other columns pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.bpe import LETTER, classes, code_points
from tidewake.llm.common import text_chunks

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 12
VECTOR = 6
#: Training windows of each language at most.
SAMPLE_WINDOWS = 600
#: Documents whose windows the sample is drawn from, for each language at most.
SAMPLE_DOCS = 400
EPOCHS = 6
BATCH = 64
UNKNOWN = "und"
#: Windows that are scored at a time.
SCORED = 256


@dataclass
class Network:
    languages: list[str]
    vectors: np.ndarray  # 257 x VECTOR; the last stands for what lies beyond a text's end and is zero
    filters: list[np.ndarray]  # width * VECTOR x FILTERS for each width
    bias: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray


def sample(docs: DataFrame, labelled: Column, text: str = "text", lang: str = "lang", windows: int = SAMPLE_WINDOWS, most: int = SAMPLE_DOCS) -> list[tuple[str, bytes]]:
    """At most `windows` windows for each language, from at most `most` labelled documents of each.

    The different texts of each language are counted first; then each language gives the share of them that makes about
    `most`, chosen by a hash of the text, so the sample is spread over all rows, does not depend on how rows lie, and a
    text counts once however many copies it has. The text of the least hash is taken in any case, so no language that a
    labelled row has is lost.
    """
    rows = docs.filter(labelled & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(text).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.25 * most / max(n, 1)))])
    chosen = rows.filter(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    least = rows.groupBy("lang").agg(F.min_by("text", "h").alias("text"), F.min("h").alias("h")).select("text", "lang", "h")
    chosen = chosen.unionByName(least).dropDuplicates(["h", "lang"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_lang, out, order = [], [], []
            for text_, lang_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text_.encode()
                places = list(range(0, max(1, len(raw)), WINDOW))
                for at in sorted(places, key=lambda a: (a * 0x9E3779B1 + len(raw)) % 1009)[:4]:
                    out_lang.append(lang_)
                    out.append(raw[at : at + WINDOW])
                    order.append((at * 0x9E3779B1 + sum(raw[at : at + WINDOW]) * 40503 + len(raw)) % 1_000_003)
            yield pa.RecordBatch.from_arrays([pa.array(out_lang, pa.string()), pa.array(out, pa.binary()), pa.array(order, pa.int64())], ["lang", "window", "place"])

    found = chosen.mapInArrow(cut, "lang string, window binary, place bigint").collect()
    kept: dict[str, list[bytes]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["place"], bytes(r["window"]))):
        if len(held := kept.setdefault(r["lang"], [])) < windows:
            held.append(bytes(r["window"]))
    return [(k, w) for k, held in kept.items() for w in held]


def matrix(windows: list[bytes]) -> np.ndarray:
    """A row per window; 256 beyond a window's end."""
    out = np.full((len(windows), WINDOW), 256, np.int32)
    for k, w in enumerate(windows):
        out[k, : len(w)] = np.frombuffer(w, np.uint8)
    return out


def responses(net: Network, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Greatest responses of all filters, where they lie, the unrolled inputs, and probabilities."""
    n, vectors = len(rows), net.vectors[rows].astype(np.float32)
    tops, places, inputs = [], [], []
    for width, w, b in zip(WIDTHS, net.filters, net.bias):
        strips = np.concatenate([vectors[:, k : WINDOW - width + 1 + k] for k in range(width)], axis=2)
        out = strips.reshape(-1, width * vectors.shape[2]) @ w
        out = out.reshape(n, WINDOW - width + 1, -1)
        tops.append(np.maximum(out.max(axis=1) + b, 0))
        places.append(out)
        inputs.append(strips)
    pooled = np.concatenate(tops, axis=1)
    z = pooled @ net.weights + net.offset
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return pooled, places, inputs, z / z.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, bytes]], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fit by Adam on cross entropy; weights of languages even out their numbers of windows."""
    languages = sorted({k for k, _ in samples})
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(k) for k, _ in samples])
    x = matrix([w for _, w in samples])
    share = 1.0 / np.bincount(y, minlength=len(languages))
    weight = share[y] * len(y) / len(languages)
    f32 = np.float32
    vectors = rng.normal(0, 0.5, (257, VECTOR)).astype(f32)
    vectors[256] = 0
    net = Network(languages, vectors, [rng.normal(0, (w * VECTOR) ** -0.5, (w * VECTOR, FILTERS)).astype(f32) for w in WIDTHS], [np.zeros(FILTERS, f32) for _ in WIDTHS], rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(f32), np.zeros(len(languages), f32))
    parts = [net.vectors, *net.filters, *net.bias, net.weights, net.offset]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            at = order[a : a + BATCH]
            pooled, outs, inputs, p = responses(net, x[at])
            d = p.copy()
            d[np.arange(len(at)), y[at]] -= 1
            d *= (weight[at] / len(at))[:, None]
            d = d.astype(f32)
            g_weights, g_offset, d_pool = pooled.T @ d, d.sum(axis=0), (d @ net.weights.T) * (pooled > 0)
            g_vectors, g_filters, g_bias = np.zeros_like(net.vectors), [], []
            for k, width in enumerate(WIDTHS):
                dk = d_pool[:, k * FILTERS : (k + 1) * FILTERS]
                place = outs[k].argmax(axis=1)
                strip = inputs[k][np.arange(len(at))[:, None], place]  # windows x filters x width * VECTOR
                g_filters.append(np.einsum("nfw,nf->wf", strip, dk))
                g_bias.append(dk.sum(axis=0))
                back = (dk[:, :, None] * net.filters[k].T[None]).reshape(len(at), FILTERS, width, VECTOR)
                symbols = x[at][np.arange(len(at))[:, None, None], place[:, :, None] + np.arange(width)]
                np.add.at(g_vectors, symbols.ravel(), back.reshape(-1, VECTOR))
            g_vectors[256] = 0
            step += 1
            for part, g, m, v in zip(parts, [g_vectors, *g_filters, *g_bias, g_weights, g_offset], first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                part -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def window_probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities of every text over all its windows, each weighted by its bytes."""
    lengths = np.diff(offsets)
    count = -(-lengths // WINDOW)
    row = np.repeat(np.arange(len(count)), count)
    begin = offsets[row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    size = np.minimum(begin + WINDOW, offsets[row + 1]) - begin
    held = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    out = np.zeros((len(count), len(net.languages)))
    for a in range(0, len(row), SCORED):
        at, n = begin[a : a + SCORED], size[a : a + SCORED]
        rows = np.full((SCORED, WINDOW), 256, np.int32)  # always as many rows, so that products come out alike
        rows[: len(at)] = held[at[:, None] + np.arange(WINDOW)]
        rows[: len(at)][np.arange(WINDOW) >= n[:, None]] = 256
        np.add.at(out, row[a : a + SCORED], probabilities(net, rows)[: len(at)] * n[:, None])
    return np.round(out / np.maximum(lengths, 1)[:, None], 6)


def probabilities(net: Network, rows: np.ndarray) -> np.ndarray:
    """Softmax of the network for windows of bytes: the filters of all widths in one product over the widest strip."""
    n, most = len(rows), max(WIDTHS)
    vectors = net.vectors[np.concatenate([rows, np.full((n, most - 1), 256, rows.dtype)], axis=1)]
    wide = np.zeros((most * VECTOR, FILTERS * len(WIDTHS)), np.float32)
    for k, (width, w) in enumerate(zip(WIDTHS, net.filters)):
        wide[: width * VECTOR, k * FILTERS : (k + 1) * FILTERS] = w
    step, item = vectors.strides[1], vectors.strides[2]
    strips = np.lib.stride_tricks.as_strided(vectors, (n, WINDOW, most * VECTOR), (vectors.strides[0], step, item))
    out = (np.ascontiguousarray(strips).reshape(n * WINDOW, -1) @ wide).reshape(n, WINDOW, -1)
    tops = [np.maximum(out[:, : WINDOW - width + 1, k * FILTERS : (k + 1) * FILTERS].max(axis=1) + b, 0) for k, (width, b) in enumerate(zip(WIDTHS, net.bias))]
    z = np.concatenate(tops, axis=1) @ net.weights + net.offset
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a letter."""
    at, cp = code_points(data)
    places = at[classes()[cp] == LETTER]
    return np.searchsorted(places, offsets[1:]) > np.searchsorted(places, offsets[:-1])


def predict(net: Network | None, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n = len(offsets) - 1
    if not net:
        return [UNKNOWN] * n, np.zeros(n)
    p = window_probabilities(net, data, offsets)
    has, best = lettered(data, offsets), p.argmax(axis=1)
    return [net.languages[k] if h else UNKNOWN for k, h in zip(best.tolist(), has.tolist())], np.where(has, np.clip(p.max(axis=1), 0, 1), 0.0)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                lang, score = predict(net, data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def accepted(docs: DataFrame, net: Network | None, least: float) -> DataFrame:
    """The documents, all columns, whose language has at least a score; a missing lang becomes the predicted one."""
    at = docs.columns.index("text")
    lang = docs.columns.index("lang") if "lang" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(at)):
                found, score = predict(net, data, offsets)
                part = batch.slice(a, b - a)
                if lang >= 0 and part.column(lang).null_count:
                    part = part.set_column(lang, part.schema.field(lang), pa.array([x if x is not None else y for x, y in zip(part.column(lang).to_pylist(), found)], pa.string()))
                yield part.filter(pa.array([x != UNKNOWN and y >= least for x, y in zip(found, score.tolist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    """Documents whose text and language training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame) -> Network | None:
    """The network for a table's languages, or None where no row is labelled."""
    found = sample(docs, ~held_out() & F.col("doc_id").isNotNull())
    return train(found) if found else None
