"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. The weights of a line's label come from
binned features of the line and of both neighbours, those of a pair of labels
from a 2 x 2 table. Forward-backward gives each line's marginal probability of
good; a document's quality is their mean, weighted by line length, put on the
scale of the labels by a logistic curve.

Only the marked documents' labels are learned from: a line bears its
document's label. The model maximises one objective, the log-likelihood of the
documents' lines, weighted so that both labels count the same, less a penalty.
It is fitted on at most SAMPLE training documents (documented bound; the rows
with the smallest hash of their id) of each label, with all of their lines,
whose features, not texts, come to the driver. For the fit, chains of more
than PIECE lines are cut into pieces, which drops no line; scores and their
calibration run over whole documents.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_where, map_batches

#: Training documents of each label at most, and lines of a chain in training.
SAMPLE, PIECE = 800, 64
#: A document with this score or more is of good quality.
THRESHOLD = 0.7
FEATURES = ("chars", "words", "distinct", "repeats", "upper", "digits", "symbols", "doubled", "bars", "word_chars", "short", "stops", "starts_upper", "same_line", "wide")
BINS = 8

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_DOUBLED = re.compile(rb"([!-/:-@\[-`{-~])\1")


def line_features(line: str, before: str | None) -> tuple[float, ...]:
    b = line.encode("utf-8", "surrogatepass")
    n = max(1, len(b))
    words = line.split()
    k = max(1, len(words))
    upper = len(b) - len(b.translate(None, _UPPER))
    return (
        math.log1p(len(line)), math.log1p(len(words)), len(set(words)) / k, sum(map(eq, words, words[1:])) / k, upper / n,
        (len(b) - len(b.translate(None, _DIGIT))) / n, (len(b) - len(b.translate(None, _SYMBOL))) / n, len(_DOUBLED.findall(b)) / k, b.count(b"|") / k,
        len(line) / k, sum(map((4).__gt__, map(len, words))) / k, float(line[-1:] in tuple(".!?:;\"'") and line != ""), float(line[:1].isupper()), float(before is not None and line == before), (len(b) - len(line)) / n,
    )


def lines_of(text: str | None) -> tuple[list[str], np.ndarray]:
    """Lines, one at least, and the features of each."""
    lines = (text or "").split("\n")
    x = np.array([line_features(a, b) for a, b in zip(lines, [None, *lines[:-1]], strict=True)], np.float32)
    return lines, x


@dataclass
class Model:
    edges: np.ndarray  # (features, BINS - 1)
    weights: np.ndarray  # (3 neighbours, features, BINS): log odds of good
    pairs: np.ndarray  # (2, 2): from, to; 1 is good
    first: float  # log odds of good for any line
    slope: float = 1.0
    offset: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], 1)

    def odds(self, bins: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds of good of every line by its and its neighbours' bins;
        starts: where documents start, and the end."""
        f = np.arange(bins.shape[1])
        own, before, after = (w[f, bins].sum(1) for w in self.weights)
        out = self.first + own
        out[1:] += before[:-1]
        out[:-1] += after[1:]
        inner = starts[1:-1]
        out[inner] -= before[inner - 1]
        out[inner - 1] -= after[inner]
        return out

    def score(self, p: float) -> float:
        p = min(max(p, 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * math.log(p / (1 - p)) + self.offset))))


def forward_backward(odds: np.ndarray, starts: np.ndarray, pairs: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginals of good by line, expected counts of pairs, log partition
    sum) over chains that lie one after the other; the last two weighted with
    the chains' shares. Chains advance together, one position at a time,
    longest first."""
    length = np.diff(starts)
    share = np.ones(len(length)) if share is None else share
    order = np.argsort(-length, kind="stable")
    begin, length, share = starts[:-1][order], length[order], share[order]
    m = np.exp(pairs - pairs.max())
    unary = np.stack([np.full_like(odds, 0.0), odds], 1)
    unary = np.exp(unary - unary.max(1, keepdims=True))
    logz = (np.add.reduceat(np.maximum(odds, 0), begin[np.argsort(begin)])[np.argsort(np.argsort(begin))] * share).sum() + pairs.max() * ((length - 1) * share).sum() if len(length) else 0.0
    top = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(1, top + 1), side="right")
    alpha, beta = np.empty_like(unary), np.ones_like(unary)
    for t in range(top):
        at = begin[: alive[t]] + t
        a = unary[at] if t == 0 else (alpha[at - 1] @ m) * unary[at]
        z = a.sum(1, keepdims=True)
        alpha[at] = a / z
        logz += (np.log(z[:, 0]) * share[: alive[t]]).sum()
    expected = np.zeros((2, 2))
    for t in range(top - 1, 0, -1):
        at = begin[: alive[t]] + t
        ub = unary[at] * beta[at]
        joint = alpha[at - 1][:, :, None] * m * ub[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        expected += (joint * share[: alive[t], None, None]).sum(0)
        b = ub @ m.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    marginal = alpha * beta
    return marginal[:, 1] / marginal.sum(1), expected, float(logz)


def document_means(marginal: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(marginal * weight, starts[:-1]) / np.add.reduceat(weight, starts[:-1])


class Objective:
    """The weighted, penalised log-likelihood of training lines, and its
    gradient, as functions of the parameters in a row."""

    def __init__(self, model: Model, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, ridge: float) -> None:
        self.model, self.starts, self.ridge = model, starts, ridge
        size = np.diff(starts)
        self.y = np.repeat(labels, size).astype(np.int64)
        # Both labels weigh the same, whatever their share in the sample.
        lines = np.bincount(labels, size, 2)
        self.share = 0.5 * size.sum() / np.maximum(1, lines)[labels]
        self.line_share = np.repeat(self.share, size)
        self.bins = model.bins(x)
        self.flat = self.bins + np.arange(self.bins.shape[1]) * BINS
        heads = np.zeros(len(x), bool)
        heads[starts[:-1]] = True
        self.after = np.flatnonzero(~heads)
        pair = 2 * self.y[self.after - 1] + self.y[self.after]
        self.observed = np.bincount(pair, self.line_share[self.after], 4).reshape(2, 2)
        self.size = 3 * self.bins.shape[1] * BINS

    def place(self, theta: np.ndarray) -> None:
        m = self.model
        m.weights, m.pairs, m.first = theta[: self.size].reshape(m.weights.shape), theta[self.size : self.size + 4].reshape(2, 2), float(theta[-1])

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        self.place(theta)
        odds = self.model.odds(self.bins, self.starts)
        p, expected, logz = forward_backward(odds, self.starts, self.model.pairs, self.share)
        miss = (self.y - p) * self.line_share
        d = self.bins.shape[1]
        count = lambda rows, m: np.bincount(self.flat[rows].ravel(), np.repeat(m, d), minlength=d * BINS)
        grad = np.concatenate([count(slice(None), miss), count(self.after - 1, miss[self.after]), count(self.after, miss[self.after - 1]), (self.observed - expected).ravel(), [miss.sum()]])
        value = (odds * self.y * self.line_share).sum() + (self.observed * self.model.pairs).sum() - logz - self.ridge / 2 * (theta**2).sum()
        return value, grad - self.ridge * theta


def fit(features: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, rounds: int = 200, ridge: float = 2.0) -> Model:
    """A model from the line features, line lengths and label of each training
    document, by gradient steps (Adam) on the objective. With no documents, or
    only one label, it gives that label's share."""
    d = len(FEATURES)
    if len(features) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.tile(np.arange(1.0, BINS), (d, 1)), np.zeros((3, d, BINS)), np.zeros((2, 2)), 0.0, 0.0, math.log(share / (1 - share)))
    x, weight = np.concatenate(features), np.concatenate(weights)
    whole = np.concatenate([[0], np.cumsum([len(f) for f in features])])
    pieces = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(whole[:-1], whole[1:], strict=True)])
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T.copy()
    model = Model(edges, np.zeros((3, d, BINS)), np.zeros((2, 2)), 0.0)
    objective = Objective(model, x, np.append(pieces, len(x)), np.repeat(labels, [-(-len(f) // PIECE) for f in features]), ridge)
    theta, mean, square = (np.zeros(objective.size + 5) for _ in range(3))
    for step in range(1, rounds + 1):
        grad = objective(theta)[1] / len(x)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta = theta + 0.1 * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    objective.place(theta)
    p, _, _ = forward_backward(model.odds(objective.bins, whole), whole, model.pairs)
    q = np.clip(document_means(p, weight, whole), 1e-6, 1 - 1e-6)
    model.slope, model.offset = _calibrate(np.log(q / (1 - q)), labels.astype(float))
    return model


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by damped Newton steps; both
    labels weigh the same and the slope is never negative."""
    w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g = np.array([(w * (y - p) * z).sum() - 1e-3 * (a - 1), (w * (y - p)).sum() - 1e-3 * b])
        v = w * p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -1, 1)
    return max(float(a), 0.0), float(b)


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on documents with a label (0 or 1), outside the held-out quarter.
    An id that has both labels counts as 0; of several texts of one id the one
    with the least hash is used. Rows of labels without an id or with another
    label don't count, repeated rows count once."""
    named = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    marked = named.where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~is_held_out("id")).groupBy("id").agg(F.min("y").cast("int").alias("y"))
    rank = F.xxhash64("id", F.lit(17))
    chosen = None
    for y in (0, 1):
        few = marked.where(F.col("y") == y).orderBy(rank, "id").limit(sample)
        chosen = few if chosen is None else chosen.union(few)
    # At most 2 x sample ids: a bounded broadcast.
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "y").agg(F.min_by("content", F.xxhash64("content")).alias("content"))

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": b["id"], "y": b["y"], "x": [], "w": []}
        for text in b["content"]:
            lines, x = lines_of(text)
            out["x"].append(x.tobytes())
            out["w"].append([max(1, len(a)) for a in lines])
        return out

    rows = sorted(map_batches(texts, run, "id long, y int, x binary, w array<int>").toLocalIterator(), key=lambda r: r["id"])
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)) for r in rows]
    model = fit(x, [np.array(r["w"], float) for r in rows], np.array([r["y"] for r in rows], np.int64))
    share = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if model.slope and len(share) == 2:  # the sample is even, the labels are not
        model.offset += math.log(share[1] / share[0])
    return model


def _marginals(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of good, lengths, where texts start) of all lines."""
    found = [lines_of(x) for x in texts]
    starts = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])])
    p, _, _ = forward_backward(model.odds(model.bins(np.concatenate([f[1] for f in found])), starts), starts, model.pairs)
    return p, np.array([max(1, len(a)) for f in found for a in f[0]], float), starts


def scores(texts: list[str | None], model: Model) -> list[float]:
    """Quality of each text, 0 to 1; an empty or null one is one empty line."""
    if not texts:
        return []
    p, weight, starts = _marginals(texts, model)
    return [model.score(v) for v in document_means(p, weight, starts)]


def label_lines(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lines) of every row: for each line of its text the probability
    that it is good and the label (1: good) that this makes likelier. Nulls,
    long texts and repeated rows are as in score_documents()."""
    kind = dict(docs.dtypes)[id_col]

    def run(b: dict[str, list]) -> dict[str, list]:
        if not b["text"]:
            return {"doc_id": [], "lines": []}
        p, _, starts = _marginals(b["text"], model)
        return {"doc_id": b["doc_id"], "lines": [[{"p": float(v), "good": int(v >= 0.5)} for v in p[s:e]] for s, e in zip(starts[:-1], starts[1:], strict=True)]}

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, lines array<struct<p: double, good: int>>")


def score_documents(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row, whatever its id. A null or empty text is
    one empty line; long texts are scored whole; rows that repeat have the
    same score; an empty table gives no rows."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, lambda b: {"doc_id": b["doc_id"], "score": scores(b["text"], model)}, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all of their columns, that score threshold or
    more; texts are treated as in score_documents()."""
    return keep_where(docs, "text", lambda x: [s >= threshold for s in scores(x, model)])
