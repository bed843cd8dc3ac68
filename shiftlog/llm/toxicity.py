"""Toxicity by a small convolutional text classifier, in numpy.

A word is hashed to two buckets, and its beginning to one, and embedded as the
sum of their rows.  Filters
of several widths run over the words of the whole text, each is max-pooled to
its strongest window, and a linear layer over the pooled values gives the
score, calibrated to a probability on labelled rows that trained nothing.
Those rows also give each language a threshold; the score itself sees nothing
but the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlog.llm.common import extended, rows_of, stored
from shiftlog.llm.shingles import hash_words

#: Labelled rows that the model may see: about this many per label (ids chosen
#: by a hash) and whole texts of at most this many words together; lower
#: hashes first.  This bounds what reaches the driver (16 bytes a word).
SAMPLE_ROWS = 2000
SAMPLE_WORDS = 4_000_000
BUCKETS = 1 << 16
STEM = 6
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 12
EPOCHS = 10
BATCH = 32
RATE = 0.15
#: Words convolved at a time: bounds the working memory, whatever the text.
PIECE = 1 << 15
THRESHOLD = 0.3
#: Calibrating rows of either label without which a language takes the
#: threshold of all rows.
LEAST = 5

_BLANKS = np.frombuffer(b"\t\n\v\f\r ", np.uint8)
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def held_out(column="doc_id"):
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 4,
    is 2 (a null id counts as the empty text)."""
    key = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 4 == 2


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of each word of a text in lower case and of its first
    ``STEM`` bytes, as two columns; ASCII signs part words."""
    data = text.lower().encode().translate(_SPACED)
    words, starts = hash_words(data)
    raw = np.frombuffer(data, np.uint8)
    mark = np.zeros(len(raw), np.int64)
    mark[starts] = starts
    place = np.arange(len(raw)) - np.maximum.accumulate(mark)
    stems, _ = hash_words(raw[(place < STEM) | np.isin(raw, _BLANKS)].tobytes())
    return np.stack([words, stems], 1)


def _buckets(words: np.ndarray) -> np.ndarray:
    """Two buckets per word, from different bits of its hash, and its stem's."""
    n = np.uint64(BUCKETS)
    word, stem = words[:, 0], words[:, 1]
    return np.stack([word % n, (word >> np.uint64(32)) % n, stem % n], 1).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """``words`` ends in a row of zeros, the word beside a text;
    ``filters[i][j]`` maps the j-th word of a window of ``WIDTHS[i]`` words to
    its filters.  Without ``words`` every score is ``base``."""
    words: np.ndarray | None
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    base: float
    slope: float = 1.0
    level: float = 0.0
    threshold: float = THRESHOLD
    thresholds: dict[str, float] = field(default_factory=dict)

    def raw(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """Uncalibrated scores of whole texts, given as word hashes."""
        pooled = np.full((len(texts), len(self.out)), -np.inf, np.float32)
        for docs, pieces, windows in _blocks(texts):
            ids, begin = _rows(pieces)
            x = _embed(self.words, ids)
            edges = np.stack([begin, begin + windows], 1).ravel()
            best = [np.maximum.reduceat(_convolve(x, w)[:edges[-1]], edges[:-1])[::2] + b
                    for w, b in zip(self.filters, self.shifts)]
            np.maximum.at(pooled, docs, np.concatenate(best, 1))
        return np.maximum(pooled, 0) @ self.out

    def scores(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """Probabilities from 0 to 1."""
        if self.words is None:
            return np.full(len(texts), self.base)
        return _logistic(self.slope * self.raw(texts).astype(float) + self.level)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _blocks(texts: Sequence[np.ndarray]) -> Iterator[tuple[list, list, list]]:
    """The texts, long ones in overlapping pieces, in blocks of bounded size:
    the number of each piece's text, the pieces, and how many windows begin in
    each (in the last of a text one more than its words: all zeros)."""
    docs, pieces, windows, size = [], [], [], 0
    for doc, words in enumerate(texts):
        for at in range(0, max(1, len(words)), PIECE):
            docs.append(doc)
            pieces.append(words[at:at + PIECE + max(WIDTHS) - 1])
            windows.append(PIECE if at + PIECE < len(words) else len(words) - at + 1)
            size += len(pieces[-1]) + max(WIDTHS)
            if size >= PIECE:
                yield docs, pieces, windows
                docs, pieces, windows, size = [], [], [], 0
    if docs:
        yield docs, pieces, windows


def _rows(pieces: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pieces' words, each piece followed by rows of zeros, and
    where each piece begins."""
    beside = np.full((max(WIDTHS), 3), BUCKETS, np.int32)
    ids = np.concatenate([part for p in pieces for part in (_buckets(p), beside)])
    length = np.array([len(p) + max(WIDTHS) for p in pieces])
    return ids, length.cumsum() - length


def _embed(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return words[ids[:, 0]] + words[ids[:, 1]] + words[ids[:, 2]]


def _convolve(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Windows beginning at every row but the last ``max(WIDTHS) - 1``."""
    n = len(x) - max(WIDTHS) + 1
    return sum(x[j:n + j] @ w[j] for j in range(len(w)))


def fit(texts: Sequence[np.ndarray], y: np.ndarray, seed: int = 13) -> Model:
    """Weights by Adagrad over mini-batches, either label weighing half.

    A filter's gradient flows through its strongest window of a text alone, so
    a step touches few embedding rows.
    """
    rng = np.random.default_rng(seed)
    words = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
    words[-1] = 0
    filters = [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32)
               for w in WIDTHS]
    shifts = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
    level = np.zeros(1, np.float32)
    held = {id(a): np.full(a.shape, 1e-4, np.float32) for a in (words, *filters, *shifts, out, level)}

    def step(a: np.ndarray, grad: np.ndarray, at=slice(None)) -> None:
        seen = held[id(a)]
        seen[at] += grad * grad
        a[at] -= RATE * grad / np.sqrt(seen[at])

    share = np.array([0.5 / max(1, (y == v).sum()) for v in (0, 1)]) * len(y)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            batch = order[i:i + BATCH]
            ids, begin = _rows([texts[d] for d in batch])
            end = begin + [len(texts[d]) + 1 for d in batch]
            x = _embed(words, ids)
            at, pooled = [], []  # strongest window and its value, [text, filter]
            for w, b in zip(filters, shifts):
                z = _convolve(x, w)
                at.append(np.array([s + z[s:e].argmax(0) for s, e in zip(begin, end)]))
                pooled.append(np.take_along_axis(z, at[-1], 0) + b)
            flat = np.concatenate(pooled, 1)
            p = _logistic(np.maximum(flat, 0) @ out + level)
            err = ((p - y[batch]) * share[y[batch]] / len(batch)).astype(np.float32)
            back = np.split(err[:, None] * out * (flat > 0), len(WIDTHS), 1)
            step(out, np.maximum(flat, 0).T @ err + 1e-4 * out)
            step(level, err.sum(keepdims=True))
            rows, grads = [], []
            for w, b, where, g in zip(filters, shifts, at, back):
                own = np.empty_like(w)
                for j in range(len(w)):
                    own[j] = np.einsum("nf,nfd->df", g, x[where + j])
                    rows.append(where + j)
                    grads.append(np.einsum("nf,df->nfd", g, w[j]))
                step(w, own + 1e-4 * w)
                step(b, g.sum(0))
            touched, slot = np.unique(ids[np.concatenate([r.ravel() for r in rows])],
                                      return_inverse=True)
            grad = np.zeros((len(touched), DIM), np.float32)
            each = np.concatenate([g.reshape(-1, DIM) for g in grads])
            for own in slot.reshape(-1, 3).T:
                np.add.at(grad, own, each)
            real = touched < BUCKETS
            step(words, grad[real], touched[real])
    return Model(words, filters, shifts, out, 0.0, 1.0, float(level[0]))


def calibrate(model: Model, texts: Sequence[np.ndarray], y: np.ndarray,
              langs: Sequence[str | None], share: float) -> Model:
    """``model`` with scores that are probabilities where ``share`` of all rows
    have label 1, and a threshold per language.

    The threshold of a language is the one of best F1 among its calibrating
    rows, halfway between neighbouring scores; with fewer than ``LEAST`` rows
    of either label it is that of all rows.
    """
    raw = model.raw(texts).astype(float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    middle, spread = raw.mean(), raw.std() + 1e-9
    slope, level = _platt((raw - middle) / spread, y, weight)
    slope, level = slope / spread, level - slope * middle / spread
    score = _logistic(slope * raw + level)
    by = {}
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if min((y[own] == v).sum() for v in (0, 1)) >= LEAST:
            by[lang] = _best_threshold(score[own], y[own], weight[own])
    return replace(model, slope=slope, level=level, thresholds=by, base=share,
                   threshold=_best_threshold(score, y, weight))


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level of a weighted ridge logistic regression on one feature,
    by Newton steps that are halved until they lower the loss."""
    a = np.stack([z, np.ones_like(z)], 1)
    ridge = np.diag([0.05, 1e-6])

    def loss(w):
        t = a @ w
        return (weight * (np.logaddexp(0, t) - y * t)).sum() + 0.5 * w @ ridge @ w

    w = np.zeros(2)
    for _ in range(100):
        p = _logistic(a @ w)
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(2),
                               a.T @ (weight * (p - y)) + ridge @ w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _best_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(-score, kind="stable")
    s, w = score[order], weight[order]
    hit = (w * y[order]).cumsum()
    f1 = 2 * hit / (w.cumsum() + hit[-1])
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores pass together
    at = int(f1.argmax())
    return float((s[at] + s[min(at + 1, len(s) - 1)]) / 2)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic",
          sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS) -> Model:
    """Model from the labelled rows of ``docs`` outside the held-out fold.

    Per label about ``sample_rows`` ids are chosen by a hash (all, where there
    are fewer); their whole texts are turned to word hashes by the tasks, and
    those of lowest hash reach the driver until ``sample_words`` are reached.
    A quarter of them calibrates, the others train.  A null label is no label,
    an id with several counts as 1 if one of them is; of several texts of an id
    one is taken.  With fewer than 4 rows of either label in either part,
    every score is the share of label 1.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max((F.col(label) == 1).cast("int")).alias("y")))
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = count.get(1, 0) / sum(count.values()) if count else 0.5
    none = Model(None, [], [], np.zeros(0), share)
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(2 ** 40))
    part = {v: min(1.0, sample_rows / max(1, n)) for v, n in count.items()}
    chosen = known.where(place < F.when(F.col("y") == 1, int(part.get(1, 0) * 2 ** 40))
                         .otherwise(int(part.get(0, 0) * 2 ** 40)))
    texts = (docs.where(F.col("text") != "").select("doc_id", "text", "lang")
             .join(F.broadcast(chosen), "doc_id")  # about 2 * sample_rows
             .groupBy("doc_id", "y").agg(F.max(F.struct("text", "lang")).alias("d"))
             .select(place.alias("place"), "y", "d.text", "d.lang"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(t) for t in rows_of(batch, "text")[0]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3),
                 pa.array([len(w) for w in words], pa.int64()),
                 pa.array([w.tobytes() for w in words], pa.binary())],
                names=["place", "y", "lang", "n", "words"])

    sample = stored(texts.mapInArrow(hashed, "place long, y int, lang string, n long, words binary"),
                    "toxicity")
    sizes = sorted(map(tuple, sample.select("place", "y", "n").collect()))
    ends = np.cumsum([n for _, _, n in sizes])
    enough = int(np.searchsorted(ends, sample_words, "right"))
    if not enough:
        return none
    rows = sorted(sample.where(F.col("place") <= sizes[enough - 1][0]).collect(),
                  key=lambda r: (r["place"], r["y"], r["words"]))
    y = np.array([r["y"] for r in rows])
    words = [np.frombuffer(r["words"], np.uint64).reshape(-1, 2) for r in rows]
    quarter = np.array([r["place"] % 4 == 0 for r in rows])
    if min((y[side] == v).sum() for side in (quarter, ~quarter) for v in (0, 1)) < 4:
        return none
    model = fit([w for w, q in zip(words, quarter) if not q], y[~quarter])
    return calibrate(model, [w for w, q in zip(words, quarter) if q], y[quarter],
                     [r["lang"] for r, q in zip(rows, quarter) if q], share)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with ``column``: the probability (0 to 1) of being toxic, from
    the whole text alone.

    Null is scored as the empty text; rows are independent, so repeated or
    null ids and other columns pass as they are (an old ``column`` is
    replaced), and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(t or "") for t in rows_of(batch, "text")[0]]
            out = pa.array(shared.value.scores(words), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out],
                                             names=[*batch.schema.names, column])

    return docs.mapInArrow(run, extended(docs, **{column: "double"}))


def flagged(model: Model, score="score", lang="lang"):
    """Whether a scored row reaches the threshold of its language (null or
    one without a threshold of its own: that of all)."""
    limit = F.lit(model.threshold)
    for name, own in sorted(model.thresholds.items()):
        limit = F.when(F.col(lang) == name, own).otherwise(limit)
    return F.col(score) >= limit
