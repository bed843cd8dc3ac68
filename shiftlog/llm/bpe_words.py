"""Byte-level BPE of whole tables through one global distinct-word shuffle.

Tasks cut texts into pre-tokens and keep, per block of documents, each
distinct word once and the documents as sequences of word numbers (the
positions).  Words are dealt by hash: a word's occurrences from all blocks
meet once and are encoded once.  The ids go back to the blocks, where the
documents are put together by position.  A block sends a word once however
often it occurs, so frequent words do not make a hot key.

Words and positions are made in two passes over the texts, which moves less
than carrying the positions past the word shuffle.  A block is named by a
digest of its texts: should the passes ever cut different blocks, the second
one finds no words and the job fails.

Decoding joins ids with the table of token bytes.  The table has one row per
token of the vocabulary, so every task holds it (a broadcast join).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlog.llm.bpe import encoder, ranks_of, read_file, runs
from shiftlog.llm.common import (batch_of, extended, pack_numbers, rows_of, squeeze, text_of,
                                 unpack_numbers)

#: Characters of text in a block: bounds a worker's memory and a block's rows.
BLOCK_CHARS = 6_000_000
#: Bytes of text for each word bucket; the number of buckets follows the input.
BUCKET_BYTES = 8_000_000

_WORDS = "bucket long, block string, sizes array<int>, payload binary"
_PLACES = "block string, buckets long, doc_ids array<long>, sizes array<int>, payload binary"


class _Block:
    """Words and documents of one block while it fills."""

    def __init__(self, pattern):
        self.find, self.words, self.of_run = pattern.findall, {}, {}
        self.docs, self.sizes, self.parts, self.chars = [], [], [], 0
        self.digest = hashlib.blake2b(digest_size=12)

    def numbers(self, run: str) -> bytes:
        words = self.words
        n = [words.setdefault(w, len(words)) for w in self.find(run)]
        out = self.of_run[run] = np.array(n, "<u4").tobytes()
        return out

    def add(self, doc, text: str) -> None:
        known, missing = self.of_run, self.numbers
        part = b"".join([known.get(r) or missing(r) for r in runs(text)]) if text else b""
        self.docs.append(doc)
        self.sizes.append(len(part) // 4)
        self.parts.append(part)
        self.chars += len(text)
        self.digest.update(b"%d " % len(part))
        self.digest.update(text.encode())

    def deal(self, buckets: int):
        """Word codes, their order by bucket and frequency, each bucket's first
        place in that order, and the sequence renumbered so that word ``i`` of
        bucket ``b`` is ``i * buckets + b``."""
        seq = np.frombuffer(b"".join(self.parts), "<u4")
        coded = [w.encode() for w in self.words]
        of = np.array([zlib.crc32(w) % buckets for w in coded], np.int64)
        order = np.lexsort((-np.bincount(seq, minlength=len(coded)), of))
        starts = np.searchsorted(of[order], np.arange(buckets + 1))
        number = np.empty(len(coded), np.int64)
        number[order] = (np.arange(len(coded)) - starts[of[order]]) * buckets + of[order]
        return coded, order, starts, number[seq]

    def word_rows(self, buckets: int) -> list[tuple]:
        coded, order, starts, _ = self.deal(buckets)
        rows, name = [], self.digest.hexdigest()
        for b in np.flatnonzero(np.diff(starts)):
            own = [coded[i] for i in order[starts[b]:starts[b + 1]]]
            rows.append((int(b), name, [len(w) for w in own], squeeze(b"".join(own))))
        return rows

    def place_rows(self, buckets: int) -> list[tuple]:
        *_, starts, seq = self.deal(buckets)
        return [(self.digest.hexdigest(), int((np.diff(starts) > 0).sum()), self.docs, self.sizes,
                 pack_numbers(seq))]


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_WORDS_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.string()), ("sizes", _INTS),
                          ("payload", pa.binary())])
_PLACES_ARROW = pa.schema([("block", pa.string()), ("buckets", pa.int64()), ("doc_ids", _LONGS),
                           ("sizes", _INTS), ("payload", pa.binary())])


def _blocks(texts: DataFrame, pattern: str, kind: str, schema: pa.Schema, rows) -> DataFrame:
    """``rows(block)`` of each block of documents that a task reads."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre_tokens = regex.compile(pattern)
        block = _Block(pre_tokens)
        for batch in batches:
            for doc, text in zip(*rows_of(batch, "doc_id", "text")):
                block.add(doc, text)
                if block.chars >= BLOCK_CHARS:
                    yield batch_of(rows(block), schema)
                    block = _Block(pre_tokens)
        if block.docs:
            yield batch_of(rows(block), schema)

    return texts.mapInArrow(split, kind)


def decoder(content: bytes) -> Callable[[bytes | None], bytes | None]:
    """Packed ids -> bytes, by the table of token bytes; null for null ids and
    for an id outside the table."""
    token = {i: t for t, i in ranks_of(content).items()}

    def run(packed: bytes | None) -> bytes | None:
        try:
            return None if packed is None else b"".join(
                [token[i] for i in np.frombuffer(packed, "<u4").tolist()])
        except KeyError:
            return None

    return run


def encode(docs: DataFrame, rank_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids of every whole text, each match of ``pattern`` encoded by
    itself; ids are packed as little-endian unsigned 32-bit integers (binary).
    ``decoded`` adds what :func:`decode` would, in the tasks that put the ids
    together: half as many Python workers at a time.

    Null text is the empty text (no ids); null and repeated doc_ids keep one
    result per row; an empty table gives no rows; other columns are ignored.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_file(rank_path))
    texts = docs.select("doc_id", text_of().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))

    def encode_words(group: pa.Table) -> pa.Table:
        """Each distinct word of a bucket once."""
        enc, known, out = encoder(content.value, pattern), {}, []
        for bucket, block, sizes, payload in zip(*rows_of(group, "bucket", "block", "sizes",
                                                          "payload")):
            data, at, ids = zstandard.decompress(payload), 0, []
            for size in sizes:
                word = data[at:at + size]
                at += size
                got = known.get(word)
                if got is None:
                    got = known[word] = enc.ids(word.decode())
                ids.append(got)
            out.append((bucket, block, [len(i) // 4 for i in ids],
                        pack_numbers(np.frombuffer(b"".join(ids), "<u4"))))
        return pa.Table.from_batches([batch_of(out, _WORDS_ARROW)])

    def reassemble(places: pa.Table, words: pa.Table) -> pa.Table:
        """A block's documents by position, from its words' ids."""
        lengths, starts, flat, at = {}, {}, [], 0
        for bucket, sizes, payload in zip(*rows_of(words, "bucket", "sizes", "payload")):
            if bucket not in lengths:  # equal blocks have equal words
                n = np.array(sizes, np.int64)
                lengths[bucket], starts[bucket] = n, at + n.cumsum() - n
                flat.append(unpack_numbers(payload))
                at += int(n.sum())
        high = max(map(len, lengths.values()), default=0)
        length, start = (np.zeros((high, buckets), np.int64) for _ in range(2))
        for b, n in lengths.items():
            length[:len(n), b], start[:len(n), b] = n, starts[b]
        ids, doc_ids, out = np.concatenate([*flat, np.zeros(0, "<u4")]), [], []
        for n_buckets, docs_, sizes, payload in zip(*rows_of(places, "buckets", "doc_ids",
                                                             "sizes", "payload")):
            if n_buckets != len(lengths):
                raise RuntimeError("the passes over the documents cut different blocks")
            seq = unpack_numbers(payload)
            n, first = length.ravel()[seq], start.ravel()[seq]
            ends = np.concatenate([[0], n.cumsum()])
            own = ids[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])].astype("<u4")
            cuts = ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
            doc_ids += docs_
            out += [own[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        made = {"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(out, pa.binary())}
        if decoded:
            made["decoded"] = pa.array([*map(decoder(content.value), out)], pa.binary())
        return pa.table(made)

    words = (_blocks(texts, pattern, _WORDS, _WORDS_ARROW, lambda b: b.word_rows(buckets))
             .groupBy("bucket").applyInArrow(encode_words, _WORDS))
    places = _blocks(texts, pattern, _PLACES, _PLACES_ARROW, lambda b: b.place_rows(buckets))
    return (places.groupBy("block").cogroup(words.groupBy("block"))
            .applyInArrow(reassemble, "doc_id long, ids binary" + ", decoded binary" * decoded))


def decode(encoded: DataFrame, rank_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): its packed ids joined with the
    token bytes, in order.  Null ids give null, as does an id outside the
    table; no ids give no bytes.  An old ``decoded`` is replaced."""
    content = encoded.sparkSession.sparkContext.broadcast(read_file(rank_path))

    encoded = encoded.drop("decoded")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = decoder(content.value)
        for batch in batches:
            out = [run(packed) for packed in rows_of(batch, ids)[0]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())],
                                             names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(join, extended(encoded, decoded="binary"))
