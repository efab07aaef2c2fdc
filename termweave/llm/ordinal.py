"""Quality classifier: ordinal regression with cumulative links on graded ratings.

P(grade >= k) = 1 / (1 + exp(threshold_k - score)) with ascending thresholds and one score,
the sum of shared weights of a text's features: hashed words (present or not), and the
shares of hashed word shapes. The fit minimises the negative log-likelihood with an L1
penalty by accelerated proximal gradient steps, so words that tell nothing get weight 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import list_of, map_texts, slices, strings

WORDS, SHAPES = 1 << 18, 256
#: About so many labelled rows are fitted, the ones with the smallest hashes of their ids; the only bound of this operator.
SAMPLE_ROWS = 12_000
#: The L1 penalty per row, the number of gradient steps, and what a share of 1 of a shape counts.
PENALTY, STEPS, SHAPE_SCALE = 5e-5, 200, 8.0
_RUNS = ((re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"))


class Features(dict):
    """Word feature and shape feature of a word, remembered up to a bounded number of words."""

    def __init__(self, size: int = 200_000):
        super().__init__()
        self.size = size

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.size:
            self.clear()
        shape = word
        for pattern, by in _RUNS:
            shape = pattern.sub(by, shape)
        letters = word.lower().strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        value = self[word] = (xxhash.xxh64_intdigest(letters) % WORDS) * SHAPES + xxhash.xxh64_intdigest(shape, 1) % SHAPES
        return value

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct word features, and shares of the shapes (with the share of repeated words in the last place)."""
        words = text.encode("utf-8", "surrogatepass").split()
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        shares = np.zeros(SHAPES + 1, np.float32)
        if not len(codes):
            return codes, shares
        distinct = np.unique(codes // SHAPES)
        shares[:SHAPES] = np.bincount(codes % SHAPES, minlength=SHAPES) / len(codes)
        shares[SHAPES] = max(0.0, 1 - 3 * len(distinct) / len(codes)) if len(codes) >= 20 else 0
        return distinct, SHAPE_SCALE * shares


class Model:
    """Weights of words and shapes, and ascending thresholds (one fewer than grades)."""

    def __init__(self, words: np.ndarray, shapes: np.ndarray, thresholds: np.ndarray):
        self.words, self.shapes, self.thresholds = words.astype(np.float32), shapes.astype(np.float32), thresholds

    def score(self, features: Features, text: str) -> float:
        distinct, shares = features.of(text)
        return float(self.words[distinct].sum() + shares @ self.shapes)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. in columns."""
        return _logistic(scores[:, None] - self.thresholds)


def _logistic(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """Fits `(word features, shape shares, grade)` rows."""
    n = max(1, len(rows))
    lengths = np.array([len(r[0]) for r in rows], np.int64)
    column = np.concatenate([*(r[0] for r in rows), np.empty(0, np.int64)]).astype(np.int32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    used, column = np.unique(column, return_inverse=True)
    shares = np.stack([r[1] for r in rows]) if rows else np.zeros((0, SHAPES + 1), np.float32)
    grade = np.array([r[2] for r in rows], np.int64)
    counts = np.bincount(column, minlength=len(used))
    scale = 1 / np.sqrt(np.maximum(counts, 1) / n)  # rare words move as fast as frequent ones
    scale = np.minimum(scale, np.sqrt(n / 5))
    # Class balance: each grade weighs alike on the whole.
    weight = (len(grade) / (grades * np.maximum(np.bincount(grade, minlength=grades), 1)))[grade] if len(grade) else np.ones(0)
    share = np.bincount(grade, weights=weight, minlength=grades) / max(weight.sum(), 1)
    above = np.clip(1 - np.cumsum(share)[:-1], 0.02, 0.98)
    start = np.log((1 - above) / above)
    gaps = np.log(np.maximum(np.diff(start), 1e-2))

    def thresholds(t):
        return t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))])

    w, s, t = np.zeros(len(used)), np.zeros(SHAPES + 1), np.concatenate([start[:1], gaps])
    vw, vs, vt, momentum, rate = w.copy(), s.copy(), t.copy(), 1.0, 2.0 / max(1.0, np.sqrt(lengths.mean()) if len(lengths) else 1.0)
    lowest = np.inf
    for _ in range(steps if len(rows) else 0):
        z = np.bincount(row, weights=vw[column] * scale[column], minlength=len(rows)) / 10 + shares @ vs
        theta = thresholds(vt)
        tail = np.concatenate([np.ones((len(z), 1)), _logistic(z[:, None] - theta), np.zeros((len(z), 1))], axis=1)
        at = np.arange(len(z))
        up, down = tail[at, grade], tail[at, grade + 1]
        p = np.maximum(up - down, 1e-9)
        loss = -(weight * np.log(p)).sum() / n
        lowest = min(lowest, loss)
        if loss > 1.5 * lowest + 0.1:  # too large a step: go on from the last point with a smaller one
            rate, momentum, lowest = rate / 2, 1.0, np.inf
            vw, vs, vt = w.copy(), s.copy(), t.copy()
            continue
        gu, gd = up * (1 - up) / p, down * (1 - down) / p
        gz = -weight * (gu - gd) / n
        gt = np.zeros(grades + 1)
        np.add.at(gt, grade, weight * gu / n)
        np.add.at(gt, grade + 1, -weight * gd / n)
        gt = gt[1:grades]
        chain = np.concatenate([[gt.sum()], [np.exp(vt[k]) * gt[k:].sum() for k in range(1, len(vt))]])
        gw = np.bincount(column, weights=gz[row], minlength=len(used)) * scale / 10
        nw = vw - rate * 10 * gw
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * 10 * penalty * scale / 10, 0)
        ns, nt = vs - rate * (shares.T @ gz) - rate * 1e-5 * vs, vt - rate * chain
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / following
        vw, vs, vt = nw + pull * (nw - w), ns + pull * (ns - s), nt + pull * (nt - t)
        w, s, t, momentum = nw, ns, nt, following
    words = np.zeros(WORDS)
    words[used] = w * scale / 10
    return Model(words, s, thresholds(t))


def fit(docs: DataFrame, labels: DataFrame, grades: int, key: str = "doc_id", text: str = "text", grade: str = "grade", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of `labels(key, grade)`, grades from 0 to `grades` - 1, on the texts of `docs`.

    At most about `sample_rows` labelled rows are fitted: those whose id hash is below
    the share that this makes of all labels. Rows without a grade, a key or a document
    don't count, nor do grades out of range; a repeated key counts once, with its
    smallest grade. Without any row the model gives every text the same score.
    """
    sound = labels.where(F.col(key).isNotNull() & F.col(grade).between(0, grades - 1)).groupBy(key).agg(F.min(grade).cast("int").alias("_grade"))
    total = max(1, sound.count())
    parts = 1 << 20
    chosen = sound.where(F.pmod(F.xxhash64(key), F.lit(parts)) < int(parts * min(1.0, sample_rows / total)))
    # The sample is bounded by a parameter, whatever the size of the tables.
    rows = docs.select(key, text).join(F.broadcast(chosen), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for part in slices(batch, text):
                found = [features.of(t) for t in strings(part, text)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).cast(pa.int64()),
                        part.column("_grade"),
                        list_of(np.concatenate([*(f[0] for f in found), np.empty(0, np.int64)]).astype(np.int32), [len(f[0]) for f in found]),
                        list_of(np.concatenate([*(f[1] for f in found), np.empty(0, np.float32)]), [len(f[1]) for f in found]),
                    ],
                    names=["key", "grade", "words", "shares"],
                )

    made = rows.withColumn(key, F.col(key).cast("long")).mapInArrow(run, "key long, grade int, words array<int>, shares array<float>").toArrow()
    order = np.argsort(made.column("key").to_numpy(), kind="stable")  # the same sums whatever the partitions
    words, shares, grade_of = made.column("words").combine_chunks(), made.column("shares").combine_chunks(), made.column("grade").to_numpy()
    seen, out = set(), []
    keys = made.column("key").to_numpy()
    for i in order.tolist():
        if keys[i] not in seen:
            seen.add(keys[i])
            out.append((words[i].values.to_numpy(), shares[i].values.to_numpy(), int(grade_of[i])))
    return fit_rows(out, grades)


def rate(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """Adds `expected_grade`, `tail` (probability of the highest grade) and `selected` (tail of at least `least`) to every row.

    Null and empty texts have no features: they get what the thresholds alone say, and
    are not selected. Columns of the three names are replaced.
    """
    memory: list[Features] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not memory:
            memory.append(Features())
        texts = strings(batch, text)
        tails = model.tails(np.array([model.score(memory[0], t) for t in texts], np.float64))
        tail = np.where([not t.strip() for t in texts], 0.0, tails[:, -1]) if len(texts) else tails[:, -1]
        return {"expected_grade": pa.array(tails.sum(axis=1)), "tail": pa.array(tail), "selected": pa.array(tail >= least)}

    return map_texts(docs, text, run, "expected_grade double, tail double, selected boolean")
