import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import _text, _tokens
from textloom.llm.registry import vocabulary

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t日.", max_size=30)), max_size=8))
def test_words_and_hashes(texts):
    seen = {}
    for row, data, off in _text.slabs(pa.array(texts, pa.string()), 16):
        starts, ends, first = _text.spans(~_text.SPACE[data], off)
        h = _text.span_hashes(data, starts, ends)
        for k in range(len(off) - 1):
            want = WORD.findall((texts[row + k] or "").encode())
            got = [data[a:b].tobytes() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)]
            assert got == want
            for word, value in zip(got, h[first[k] : first[k + 1]].tolist(), strict=True):
                assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_sliced_columns_and_chunks():
    column = pa.array(["x y", None, "z", "", "a b c"]).slice(1, 4)
    got = [bytes(data[off[k] : off[k + 1]]) for _, data, off in _text.slabs(pa.chunked_array([column, column])) for k in range(len(off) - 1)]
    assert got == [b"", b"z", b"", b"a b c"] * 2


def test_windows():
    h = np.arange(1, 8, dtype=np.uint64)
    at, _ = _text.windows(h, np.array([0, 3, 3, 7]), 3)
    assert at.tolist() == [0, 3, 4]


PIECES = [*"aBzÉéñ×'.!#1 9\n\u00a0\u0301日ﬁ<|>", "don't", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "ll", " "]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=24).map("".join), min_size=1, max_size=6))
def test_chunked_encoding_is_the_librarys(texts):
    encoder = _tokens.encoder(vocabulary())
    for row, data, off in _text.slabs(pa.array(texts)):
        ids, first = encoder.encode(data, off)
        for k in range(len(off) - 1):
            assert ids[first[k] : first[k + 1]].tolist() == encoder.tokenizer.encode(texts[row + k], add_special_tokens=False).ids


def test_cache_limits(monkeypatch):
    monkeypatch.setattr(_tokens, "MAX_CHUNKS", 3)
    encoder = _tokens.ChunkEncoder(vocabulary())
    rng = random.Random(0)
    for _ in range(5):
        text = " ".join("".join(rng.choice("abc") for _ in range(4)) for _ in range(6))
        for _, data, off in _text.slabs(pa.array([text])):
            assert encoder.encode(data, off)[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
