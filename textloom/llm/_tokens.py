"""Token ids of whole texts through the tokenizers library, with a cache of white-space separated chunks.

White space is dropped by the word-level vocabularies and no rule of theirs looks across it, nor across the border of
a Latin letter and ASCII punctuation or digits (an apostrophe may belong to the letters after it, so no border follows
one). The ids of a text are therefore those of its chunks in order. A worker encodes each distinct chunk once and then
finds it by a 64-bit hash. Slabs that hold the text of a special token are only split at white space.
"""

from __future__ import annotations

import os

import numpy as np

from textloom.llm import _text

#: Chunks and ids that a worker keeps before it starts afresh; only speed depends on them.
MAX_CHUNKS, MAX_IDS = 1_500_000, 12_000_000

#: Chunks that go into one call of the library.
TOGETHER = 64

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_OTHER = np.zeros(256, bool)
_OTHER[33:128] = True
_OTHER &= ~_LETTER

_open: dict[str, ChunkEncoder] = {}


def borders(data: np.ndarray) -> np.ndarray:
    """Where a Latin letter meets ASCII punctuation or a digit: true at the first byte after the border."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n < 2:
        return cut
    letter, other = _LETTER[data], _OTHER[data]
    accented = np.zeros(n, bool)  # the lead byte of U+00C0 to U+00FF but the signs of multiplication and division
    accented[:-1] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    ends = letter.copy()
    ends[1:] |= accented[:-1]
    cut[1:] = (ends[:-1] & other[1:]) | (other[:-1] & (data[:-1] != 0x27) & (letter | accented)[1:])
    return cut


def chunks(data: np.ndarray, off: np.ndarray, special: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first chunk of each text and their total)."""
    starts, ends, first = _text.spans(~_text.SPACE[data], off)
    if not len(starts) or special:
        return starts, ends, first
    heads = off[:-1][off[:-1] < off[1:]]
    cut = borders(data)
    cut[heads] = False
    cuts = np.flatnonzero(cut)
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, off)




class ChunkEncoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        normalizer = self.tokenizer.normalizer
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.folds = normalizer is not None and normalizer.normalize_str(alphabet) == alphabet.lower()
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        sizes, ids = [], []
        for k in range(0, len(texts), TOGETHER):
            some = texts[k : k + TOGETHER]
            begins = np.cumsum([0] + [len(x) + 1 for x in some])
            done = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            own = np.searchsorted(begins, [a for a, _ in done.offsets], "right") - 1
            sizes.append(np.bincount(own, minlength=len(some)))
            ids += done.ids
        size = np.concatenate(sizes)
        total = len(ids)
        if self.used + total > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.used + total), np.uint32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + total] = ids
        where = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, where, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, where, size)
        self.keys = np.insert(self.keys, where, keys)
        self.used += total

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text and their total) for a slab of texts."""
        if len(self.keys) > MAX_CHUNKS or self.used > MAX_IDS:
            self.clear()
        folded = _text.LOWER[data]
        raw = folded.tobytes()
        special = any(x.lower() in raw for x in self.special)
        if self.folds and not special:
            data = folded
        starts, ends, first = chunks(data, off, special)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        keys, example, inverse = np.unique(_text.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            self._learn(keys[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)])
            where = np.searchsorted(self.keys, keys)
        size = self.size[where][inverse]
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        source = np.repeat(self.at[where][inverse] - upto[:-1], size) + np.arange(upto[-1])
        return self.ids[source], upto[first]


def encoder(path: str) -> ChunkEncoder:
    if path not in _open:
        _open[path] = ChunkEncoder(path)
    return _open[path]
