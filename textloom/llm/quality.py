"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its potential is a sum of weights, one for the bin that each measure of the line falls into (symbols,
capitals, repeated words and so on), and likewise for the measures of its neighbours; a transition weight ties the labels of
neighbouring lines. Training maximises the conditional likelihood on labelled documents, whose lines start with the document's
label; lines of bad documents that the model finds clearly good are then taken as good and training goes on. Forward-backward
gives every line's marginal, and a document's score is the length-weighted mean of its lines', calibrated on the same documents.

Defined results: a null or empty text is one empty line. Repeated rows score alike. A score of exactly 0.5 counts as good. Without
a labelled row of both classes every score is 0.5. Texts of any length are whole; a text with many lines is scanned by itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import crc_mod_col, id_and_text, read_table, text_bytes
from textloom.llm.toxicity import labelled_sample

#: Labelled rows that a model is fitted on at most, the first by a hash of their ids.
SAMPLE_ROWS = 2500
BINS, EPOCHS, RATE, RIDGE = 8, 30, 0.1, 1e-3
#: Lines that one padded scan holds at most, if a single document does not have more.
GRID_LINES = 60_000

_LETTER = bytes(b for b in range(256) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PROSE = b".,;:?'\"()-"
_NOT_SYMBOL = _LETTER + _DIGIT + _PROSE + b" \t\r\n\x0b\x0c"
_NOT_UPPER = bytes(b for b in range(256) if b not in _UPPER)
_NOT_DIGIT = bytes(b for b in range(256) if b not in _DIGIT)
_NOT_PROSE = bytes(b for b in range(256) if b not in _PROSE)
MEASURES = ("words", "symbols", "capitals", "distinct", "again", "word_length", "digits", "prose", "ends")


def measures(line: bytes) -> tuple:
    """The measures of a line, in the order of MEASURES."""
    n, w = len(line), line.split()
    k = len(w)
    if not k:
        return (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    again = sum(map(bytes.__eq__, w, w[1:]))
    return (
        float(k), len(line.translate(None, _NOT_SYMBOL)) / n, len(line.translate(None, _NOT_UPPER)) / n, len(set(w)) / k, again / k,
        n / k, len(line.translate(None, _NOT_DIGIT)) / n, len(line.translate(None, _NOT_PROSE)) / n, float(line.rstrip()[-1:] in (b".", b"?", b":")),
    )


def lines_of(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def line_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines, their lengths, and the number of lines of each text."""
    values, lengths, counts = [], [], []
    for t in texts:
        lines = lines_of(t)
        counts.append(len(lines))
        lengths += map(len, lines)
        values += map(measures, lines)
    return np.array(values, np.float64).reshape(-1, len(MEASURES)), np.array(lengths, np.float64), np.array(counts)


def binned(values: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Places of the weights of each line: a column for each measure of the line, of the one before and of the one behind."""
    m = values.shape[1]
    own = np.stack([np.searchsorted(edges[j], values[:, j], side="right") for j in range(m)], 1)
    wide = edges.shape[1] + 2  # the last bin: no neighbour
    before, behind = np.full_like(own, wide - 1), np.full_like(own, wide - 1)
    before[1:], behind[:-1] = own[:-1], own[1:]
    ends = np.cumsum(counts)
    before[ends - counts] = wide - 1
    behind[ends - 1] = wide - 1
    return np.concatenate([own, before, behind], 1) + np.arange(3 * m) * wide


def grids(counts: np.ndarray):
    """Documents in groups of like numbers of lines, so that padding stays small."""
    order = np.argsort(counts, kind="stable")
    start = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or (i + 1 - start) * counts[order[i]] > GRID_LINES or counts[order[i]] > 2 * counts[order[start]] + 4:
            yield order[start:i]
            start = i


def forward_backward(s: np.ndarray, n: np.ndarray, trans: np.ndarray):
    """s: potentials of good over bad, documents by lines; n: lines of each. Returns P(good) of lines and P of label pairs."""
    docs, width = s.shape
    a, b = np.zeros((width, docs, 2)), np.zeros((width, docs, 2))
    node = np.zeros((width, docs, 2))
    node[:, :, 1] = s.T
    a[0] = node[0]
    for t in range(1, width):
        prev = a[t - 1][:, :, None] + trans
        a[t] = np.logaddexp(prev[:, 0], prev[:, 1]) + node[t]
    last = n - 1
    for t in range(width - 2, -1, -1):
        nxt = trans + (b[t + 1] + node[t + 1])[:, None, :]
        b[t] = np.where((t < last)[:, None], np.logaddexp(nxt[:, :, 0], nxt[:, :, 1]), 0.0)
    z = np.logaddexp(*np.moveaxis(a[last, np.arange(docs)], 1, 0))
    good = 1 / (1 + np.exp(np.clip((a + b)[:, :, 0] - (a + b)[:, :, 1], -50, 50)))
    pair = np.zeros((2, 2))
    if width > 1:
        p = a[:-1][:, :, :, None] + trans + (b[1:] + node[1:])[:, :, None, :] - z[None, :, None, None]
        inside = np.arange(width - 1)[:, None] < last[None, :]
        pair = np.where(inside[:, :, None, None], np.exp(np.minimum(p, 0)), 0).sum((0, 1))
    return good.T, pair


def marginals(model: dict, places: np.ndarray, counts: np.ndarray, gather: bool = False):
    """P(good) of every line; with gather also the expected label pairs."""
    scores = model["weights"][places].sum(1) + model["bias"]
    first = np.cumsum(counts) - counts
    out, pairs = np.zeros(len(scores)), np.zeros((2, 2))
    for group in grids(counts):
        n = counts[group]
        at = np.minimum(first[group][:, None] + np.arange(n.max()), (first + counts - 1)[group][:, None])
        inside = np.arange(n.max()) < n[:, None]
        good, pair = forward_backward(np.where(inside, scores[at], 0.0), n, model["trans"])
        out[at[inside]] = good[inside]
        pairs += pair
    return (out, pairs) if gather else out


def fit(texts: list[bytes], y: np.ndarray) -> dict | None:
    """A model from texts and their labels, or None if a class is missing."""
    if not len(y) or y.min() == y.max():
        return None
    values, lengths, counts = line_table(texts)
    edges = np.stack([np.quantile(values[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(values.shape[1])])
    low = np.stack([np.quantile(values[np.repeat(y, counts) == 0, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(values.shape[1])])
    edges = np.sort(np.concatenate([edges, low], 1), 1)
    places = binned(values, counts, edges)
    model = {"edges": edges, "weights": np.zeros(places.max() + 1 + edges.shape[1]), "bias": 0.0, "trans": np.zeros((2, 2))}
    label = np.repeat(y, counts).astype(np.int64)
    bad_doc = label == 0
    size = len(model["weights"]) + 5
    m, v, total = np.zeros(size), np.zeros(size), len(label)
    inner = np.ones(total, bool)
    inner[np.cumsum(counts) - 1] = False
    for step in range(1, 2 * EPOCHS + 1):
        p, pairs = marginals(model, places, counts, gather=True)
        if step == EPOCHS + 1:
            label = np.where(bad_doc & (p > 0.85), 1, label)
        miss = label - p
        seen = np.zeros((2, 2))
        i = np.flatnonzero(inner)
        np.add.at(seen, (label[i], label[i + 1]), 1)
        w = np.bincount(places.ravel(), np.repeat(miss, places.shape[1]), len(model["weights"]))
        g = np.concatenate([w, [miss.sum()], (seen - pairs).ravel()]) / total - RIDGE * np.concatenate([model["weights"], np.zeros(5)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model["weights"] += move[:-5]
        model["bias"] += move[-5]
        model["trans"] = np.clip(model["trans"] + move[-4:].reshape(2, 2), -4, 4)
    x = aggregated(model, places, lengths, counts)
    model["calibration"] = _calibrate(x, y)
    return model


def aggregated(model: dict, places: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each document the length-weighted share of good lines and its logit."""
    p, weight, first = marginals(model, places, counts), np.maximum(lengths, 1.0), np.cumsum(counts) - counts
    share = np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)
    clipped = np.clip(share, 1e-3, 1 - 1e-3)
    return np.stack([np.ones_like(share), share, np.log(clipped / (1 - clipped))], 1)


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 0.1, x.T @ (y - p) - 0.1 * w)
    return w


def score(texts: list[bytes], model: dict | None) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    values, lengths, counts = line_table(texts)
    x = aggregated(model, binned(values, counts, model["edges"]), lengths, counts)
    return 1 / (1 + np.exp(-np.clip(x @ model["calibration"], -50, 50)))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, folds: int = 3, held_out: int = 1) -> dict | None:
    found = labelled_sample(docs, labels, "quality", folds, held_out, rows).toPandas().sort_values("doc_id")
    return fit([t.encode() for t in found["text"]], found["y"].to_numpy(float))


def classify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score (1: good) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                b = whole.slice(low, 500)
                s = score(text_bytes(b.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Score every document; the fold crc32(doc_id) mod 3 = 1 is held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", (crc_mod_col(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
