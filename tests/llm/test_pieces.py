"""Segments that run side by side against the agenda of each alone."""

import random

import numpy as np
import pytest
import xxhash

from loamgrid.llm import pieces

LETTERS = "abcdeilnorstuvé▁中я\n"


def segments(text):
    """A text's segments, as the marks and line breaks cut it."""
    out = []
    for i, x in enumerate("▁" + text.replace(" ", "▁")):
        before = out[-1][-1] if out else "\n"
        if i == 0 or "\n" in (x, before) or (x == "▁" and before != "▁"):
            out.append(x)
        else:
            out[-1] += x
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_texts_of_rare_words_run_side_by_side(dropout, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choice(LETTERS.replace("▁", " ")) for _ in range(r.randrange(1, 40)))
    texts = [" ".join(word() for _ in range(30)) for _ in range(20)] + ["", None, "x" * 300, " ", "\n"]
    docs = [str(i) for i in range(len(texts))]
    codec = pieces.PieceCodec(pieces.default_model(), dropout, 9)
    want = []
    for text, doc in zip(texts, docs):
        base = xxhash.xxh32_intdigest(text or "", xxhash.xxh32_intdigest(f"={doc}", 9)) if dropout else 0
        want.append(b"".join(codec._ids(s, codec.merges(s, (base + i) & 0xFFFFFFFF)) for i, s in enumerate(segments(text)) if text) if text else b"")
    alone, merges = [], codec.merges
    monkeypatch.setattr(codec, "merges", lambda segment, place=None: alone.append(segment) or merges(segment, place))
    assert codec.encode_all(texts, docs) == want and [codec.decode(x) for x in want] == [t or "" for t in texts]
    assert all(len(s) > pieces.WIDE for s in alone)  # no word has an agenda of its own, however rare


def test_hashes_are_the_librarys():
    r = np.random.default_rng(2)
    for n in range(70):
        raw = r.integers(0, 256, n, np.uint8).tobytes()
        words = np.frombuffer(raw.ljust(n // 4 * 4 + 4, b"\0"), "<u4")
        seeds = r.integers(0, 2**32, 5, np.uint32)
        got = pieces._digests(n, lambda k: np.repeat(words[k], 5), seeds)
        assert got.tolist() == [xxhash.xxh32_intdigest(raw, s) for s in seeds.tolist()]
