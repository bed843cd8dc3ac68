"""Byte-level BPE over safe runs of a text, for tasks on the executors.

A text is cut in front of every single space that stands between two
characters other than white space.  Every match of the pre-token pattern ends
at such a place and begins there, whatever surrounds it, so a run's
pre-tokens and ids do not depend on the rest of the text; runs repeat and are
encoded once per task.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import tiktoken

_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
#: Runs kept per task: bounds a worker's memory, whatever the vocabulary.
KEPT_RUNS = 400_000
_LOADED: dict = {}


def runs(text: str) -> list[str]:
    """The text's runs, in order; they join to the text."""
    if ("  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " "
            or not text.replace("\n", "").isprintable()):
        return _BOUNDARY.split(text)
    # single spaces and line ends only: every space is a boundary
    return text.replace(" ", "\0 ").split("\0")


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(c): b for b, c in [*zip(kept, kept), *((b, 256 + i) for i, b in enumerate(rest))]}


def ranks_of(content: bytes) -> dict[bytes, int]:
    """Token bytes -> id from a rank file or a byte-level BPE json.

    In a json, merges must be listed in the order of their ids: then merging
    by id is what the merge list says.
    """
    if content[:1] != b"{":
        import base64
        return {base64.b64decode(t): int(i) for t, i in map(bytes.split, content.splitlines()) if t}
    spec = json.loads(content)
    special = {t["content"] for t in spec["added_tokens"]}
    alphabet = _byte_alphabet()
    vocab = spec["model"]["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    order = [vocab["".join(p)] for p in pairs]
    pre = spec["pre_tokenizer"]
    if (spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]
            or order != sorted(order)):
        raise ValueError("not a byte-level BPE whose merges follow the ids")
    return {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}


def added_of(content: bytes) -> dict[str, int]:
    """Added tokens of a json -> id; a text is cut at them before anything else."""
    added = json.loads(content)["added_tokens"] if content[:1] == b"{" else []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that look at their surroundings")
    return {t["content"]: t["id"] for t in added}


class Encoder(dict):
    """run -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, content: bytes, pattern: str):
        super().__init__()
        self.ranks = ranks_of(content)
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added_of(content).items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self._cut = (re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
                     if self.added else None)
        self._bpe = tiktoken.Encoding("runs", pat_str=pattern, mergeable_ranks=self.ranks,
                                      special_tokens={})

    def ids(self, text: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, run: str) -> bytes:
        ids = self.ids(run)
        if len(run) <= 64:
            if len(self) >= KEPT_RUNS:
                self.clear()
            self[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self._cut and any(t in text for t in self.added):
            # what stands between added tokens is a text of its own
            return b"".join([self.added[part] if i % 2 else b"".join([self[r] for r in runs(part)])
                             for i, part in enumerate(self._cut.split(text))])
        return b"".join([self[r] for r in runs(text)])

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4

    def token_bytes(self) -> list[bytes]:
        table = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            table[i] = t
        return table


def encoder(content: bytes, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (len(content), zlib.crc32(content), pattern)
    if key not in _LOADED:
        _LOADED[key] = Encoder(content, pattern)
    return _LOADED[key]
