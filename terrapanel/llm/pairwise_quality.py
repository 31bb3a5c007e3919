"""Document quality by Bradley-Terry pairwise ranking.

Method: a document's score is linear in features of its text.  From labelled
documents, preference pairs (a label 1 before a label 0) are drawn; the weights
maximise the Bradley-Terry likelihood, a logistic loss on the feature difference
of each pair, by Newton steps.  A quantile of the labelled documents' scores,
the one that errs least on them, is the threshold; the score of 0 to 1 is
logistic in the distance from it, with the threshold at ``CUT``.

The fit uses at most about ``MAX_LABELS`` labelled documents and ``MAX_PAIRS``
pairs, drawn by hash; that bounds what the driver holds and what is broadcast
(the drawn ids).  All documents are scored, over their whole texts, where they
are read; nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import materialize

MAX_LABELS = 20_000
MAX_PAIRS = 100_000
RIDGE = 1e-3
CUT = 0.3
QUANTILES = 1000
SEED = 11

#: Byte classes: lower, upper, digit, blank, newline, stop, comma, bang, bar, other ASCII marks, control, beyond ASCII.
CLASSES = 12


def _class_table() -> np.ndarray:
    t = np.full(256, 11, dtype=np.uint8)
    t[:32] = 10
    t[127] = 10
    t[33:127] = 9
    t[97:123], t[65:91], t[48:58], t[32], t[9], t[10] = 0, 1, 2, 3, 3, 4
    for c in b".?":
        t[c] = 5
    for c in b",;:":
        t[c] = 6
    t[ord("!")], t[ord("|")] = 7, 8
    return t


CLASS_TABLE = _class_table()
FEATURES = 2 * CLASSES + 14


def features(text: bytes) -> np.ndarray:
    """Features of a whole text: shares of byte classes and of their kinds of neighbours, words, lines, repetition."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    classes = CLASS_TABLE[np.frombuffer(text, dtype=np.uint8)]
    n = len(classes)
    share = np.bincount(classes, minlength=CLASSES) / n
    out[:CLASSES] = share
    out[CLASSES:2 * CLASSES] = np.sqrt(share)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    if not words or not lines:
        return out
    lengths = np.array(list(map(len, words)))
    seen = np.array(list(map(hash, words)))
    _, counts = np.unique(seen, return_counts=True)
    _, pairs = np.unique(seen[1:] * 31 + seen[:-1], return_counts=True) if len(words) > 1 else (None, np.ones(1))
    change = np.count_nonzero(classes[1:] != classes[:-1]) / n
    doubled = np.count_nonzero((classes[1:] == classes[:-1]) & (classes[1:] >= 5) & (classes[1:] < 10)) / n
    mark_ends = sum(w[-1:] in b"#$%&*!|" for w in words) / len(words)
    upper_words = sum(w.isupper() for w in words) / len(words)
    stops = sum(w[-1:] in b".!?" for w in words) / len(words)
    out[2 * CLASSES:] = [
        np.log1p(len(words)), np.log1p(n / len(lines)), np.log1p(lengths.mean()), np.log1p(lengths.std()),
        len(counts) / len(words), counts.max() / len(words), pairs.max() / len(words), (pairs[pairs > 1]).sum() / len(words),
        len(set(lines)) / len(lines), change, doubled, mark_ends, upper_words, stops]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weights - self.threshold
        z = np.clip(self.slope * raw + np.log(CUT / (1 - CUT)), -700, 700)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, max_pairs: int = MAX_PAIRS, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Bradley-Terry weights from rows ``x`` with labels ``y`` (0 or 1); with one label only, every score is 0.5."""
    mean, scale = x.mean(axis=0) if len(x) else np.zeros(FEATURES), x.std(axis=0) if len(x) else np.ones(FEATURES)
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(len(mean))
    if not good.size or not bad.size:
        return Model(mean, scale, w, np.log(CUT / (1 - CUT)), 1.0)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    m = min(max_pairs, len(good) * len(bad))
    d = z[rng.choice(good, m)] - z[rng.choice(bad, m)]
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -700, 700)))  # chance of the pair's losing order
        grad = d.T @ p / m - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / m + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w += move * min(1.0, 5.0 / max(np.linalg.norm(move), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    raw = z @ w
    cuts = np.unique(np.quantile(raw, np.linspace(0, 1, QUANTILES + 1)))
    order = np.argsort(raw)
    ones = np.r_[0, np.cumsum(y[order] == 1)]
    below = np.searchsorted(raw[order], cuts, side="left")
    wrong = ones[below] / len(good) + ((len(bad) - (below - ones[below])) / len(bad))
    best = int(np.argmin(wrong))
    # in the middle of the gap under the best quantile
    under = raw[raw < cuts[best]]
    threshold = (cuts[best] + under.max()) / 2 if under.size else cuts[best]
    spread = max(np.abs(raw - threshold).mean(), 1e-9)
    return Model(mean, scale, w, float(threshold), float(3.0 / spread))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the fit never sees: crc32 of the id as text is divisible by 5 (a null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_labels: int = MAX_LABELS, seed: int = SEED) -> Model:
    """Fit on labelled documents outside the held-out rows; null ids and labels other than 0 and 1 are left out.

    An id counts once, so that ``max_labels`` bounds what is drawn, broadcast and
    gathered whatever repeats: ids with both labels are left out, and of several
    texts of an id the smallest is taken.  Without documents or labels the model
    gives every text the same score.
    """
    y = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
         .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"), F.max(F.col(label_col).cast("int")).alias("most"))
         .filter("y = most").drop("most"))
    y = materialize(y, "quality_labels")
    n = y.count()
    part = min(1.0, max_labels / max(n, 1))
    y = y.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) < int(part * (1 << 40)))
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = text.join(F.broadcast(y), "id").groupBy("id", "y").agg(F.min(F.coalesce("text", F.lit(b""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py() or b"") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    got = sorted(rows.mapInArrow(run, "id long, y int, x array<double>").collect(), key=lambda r: (r["id"], r["y"], r["x"]))
    x = np.array([r["x"] for r in got]) if got else np.zeros((0, FEATURES))
    return fit(x, np.array([r["y"] for r in got], dtype=np.int64), seed=seed)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score): the input row as a struct and its score of 0 to 1; null and empty texts are scored as empty.

    An empty table gives no rows; ``row`` keeps the input's own names apart.
    """
    schema = docs.select(F.struct("*").alias("row"), F.lit(0.0).cast("double").alias("score")).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0)
            text = row.field(at)
            x = np.array([features((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in text]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([row, pa.array(model.scores(x))], ["row", "score"])

    return docs.select(F.struct("*").alias("row")).mapInArrow(run, schema)


def crc_mod_5(doc_id: int) -> int:
    """The held-out rule in plain Python, for checks."""
    return zlib.crc32(str(doc_id).encode()) % 5
