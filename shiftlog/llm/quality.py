"""Quality by compression: two zstandard dictionaries and a calibrated score.

One dictionary is trained on good, one on bad labelled text.  A document is
compressed with either; how much smaller it gets with the good one, relative
to its size, is calibrated to a probability on labelled rows that built no
dictionary (a logistic regression over that difference, the relative sizes and
the text's size).  Whole texts are compressed for both, calibration and scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlog.llm.common import batch_of, extended, rows_of, stored

#: Labelled rows that the model may see, per label, chosen by a hash of the id.
SAMPLE_ROWS = 3000
#: Blocks of a sampled text that its dictionary is trained on, spread from its
#: first to its last: with SAMPLE_ROWS this bounds what reaches the driver.
TEXT_BLOCKS = 8
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
BLOCK_BYTES = 512
#: Length of the segments that dictionary training chooses.
TRAIN_K = 256
THRESHOLD = 0.3


def held_out(column="doc_id"):
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 5,
    is 0 (a null id counts as the empty text)."""
    key = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    base: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in (self.good, self.bad):
            kind = zstandard.ZstdCompressionDict(content, zstandard.DICT_TYPE_AUTO)
            kind.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_dict_id=False,
                                                write_content_size=False))
        return out

    def scorer(self):
        """text -> score; compressors are made once per task."""
        pair = self.compressors() if len(self.weights) else None

        def score(text: str) -> float:
            if not text or pair is None:
                return self.base
            x = _design((np.array([sizes(text, *pair)]) - self.mean) / self.spread)
            return float(_logistic(x @ self.weights)[0])

        return score


def sizes(text: str, with_good, with_bad) -> list[float]:
    """What is calibrated: the normalised difference of the compressed sizes
    (above 0 when the good dictionary serves the text better), either size
    relative to the text's, and the log of the text's size.

    The whole text is compressed, in blocks small enough that the dictionary
    and not the block's own repetition does most of the work.
    """
    data = text.encode()
    good = bad = 0
    for i in range(0, len(data), BLOCK_BYTES):
        block = data[i:i + BLOCK_BYTES]
        good += len(with_good.compress(block))
        bad += len(with_bad.compress(block))
    return [(bad - good) / (bad + good), good / len(data), bad / len(data), np.log(len(data))]


def _design(z: np.ndarray) -> np.ndarray:
    """Columns, their products and a constant."""
    i, j = np.triu_indices(z.shape[1])
    return np.concatenate([z, z[:, i] * z[:, j], np.ones((len(z), 1))], 1)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _fit_logistic(a: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps, each halved until
    it lowers the loss (labels that can be told apart fully would otherwise
    send the weights off)."""
    def loss(w):
        z = a @ w
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * w @ w

    w, now = np.zeros(a.shape[1]), loss(np.zeros(a.shape[1]))
    for _ in range(200):
        p = _logistic(a @ w)
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.eye(len(w)),
                               a.T @ (weight * (p - y)) + w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * (1 + before):
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "quality",
          sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from the labelled rows of ``docs`` outside the held-out fold.

    At most ``sample_rows`` ids per label, lowest hash first, are looked up in
    ``docs`` (a small broadcast side).  Half of them build the dictionaries:
    blocks spread over each whole text reach the driver.  Half calibrate,
    weighted to the labels' true shares: their whole texts are compressed by
    the tasks, and only what is calibrated reaches the driver.  A null label
    is no label; with fewer than 8 texts of either label in either half the
    score is the share of good labels for every text.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")))
    base = known.agg(F.avg("y")).first()[0]
    base = 0.5 if base is None else base
    order = F.xxhash64(F.lit("sample"), "doc_id")
    chosen = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(sample_rows)
              for y in (0, 1)]
    sample = stored(docs.where(F.col("text") != "").select("doc_id", "text")
                    .join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # 2 * sample_rows
                    .groupBy("doc_id", "y").agg(F.max("text").alias("text"))
                    .select("y", F.xxhash64(F.lit("fold"), "doc_id").alias("fold"), "text"),
                    "labelled")
    none = np.zeros(0)
    blocks = _of_texts(sample.where("fold % 2 = 0"), spread_blocks, "array<binary>",
                       pa.list_(pa.binary()))
    if min(map(len, blocks)) < 8:
        return Model(b"", b"", none, none, none, base)
    bad, good = ([b for own in texts for b in own] for texts in blocks)
    bad, good = _dictionary(bad), _dictionary(good)
    shared = docs.sparkSession.sparkContext.broadcast(Model(good, bad, none, none, none, base))
    made = []

    def measure(text: str) -> list[float]:
        made[:] = made or shared.value.compressors()  # once per task
        return sizes(text, *made)

    measured = _of_texts(sample.where("fold % 2 <> 0"), measure, "array<double>",
                         pa.list_(pa.float64()))
    if min(map(len, measured)) < 8:
        return Model(b"", b"", none, none, none, base)
    x = np.array([*measured[0], *measured[1]])
    y = np.repeat([0.0, 1.0], list(map(len, measured)))
    mean, spread = x.mean(0), x.std(0) + 1e-9
    weight = np.where(y == 1, base / y.mean(), (1 - base) / (1 - y.mean()))
    return Model(good, bad, mean, spread, _fit_logistic(_design((x - mean) / spread), y, weight),
                 base)


def _of_texts(sample: DataFrame, make, kind: str, arrow: pa.DataType) -> tuple[list, list]:
    """``make(text)`` of the bad and of the good sampled texts, in one order
    whatever the partitioning."""
    schema = pa.schema([("y", pa.int32()), ("fold", pa.int64()), ("made", arrow)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of([(y, fold, make(text)) for y, fold, text in
                            zip(*rows_of(batch, "y", "fold", "text"))], schema)

    rows = sorted(sample.mapInArrow(run, f"y int, fold long, made {kind}").collect(),
                  key=lambda r: (r["fold"], r["made"]))
    return tuple([r["made"] for r in rows if r["y"] == y] for y in (0, 1))


def spread_blocks(text: str) -> list[bytes]:
    """The text's blocks, or ``TEXT_BLOCKS`` of them at even distances from the
    first to the last; blocks as ``sizes`` cuts them."""
    data = text.encode()
    n = -(-len(data) // BLOCK_BYTES)
    last = min(n, TEXT_BLOCKS) - 1
    at = [i * (n - 1) // max(1, last) * BLOCK_BYTES for i in range(last + 1)]
    return [data[i:i + BLOCK_BYTES] for i in at]


def _dictionary(blocks: list[bytes]) -> bytes:
    """The blocks themselves where they fit, else a dictionary that zstandard
    trains on all of them."""
    if sum(map(len, blocks)) <= DICTIONARY_BYTES:
        return b"".join(blocks)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, k=TRAIN_K, d=8).as_bytes()
    except zstandard.ZstdError:  # hardly anything but repeats: an even choice of blocks
        some = DICTIONARY_BYTES // BLOCK_BYTES
        return b"".join(blocks[i * len(blocks) // some] for i in range(some))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with ``column`` (0 to 1, higher: good likelier), from the whole
    text alone.

    Null or empty text gets the base rate; rows are independent, so repeated
    or null ids and other columns pass as they are (an old ``column`` is
    replaced), and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            scores = [of(t or "") for t in rows_of(batch, "text")[0]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, column])

    return docs.mapInArrow(run, extended(docs, **{column: "double"}))
