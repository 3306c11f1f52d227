"""Text operators over whole inputs: every place, word and row counts."""

import collections

import numpy as np

from loamgrid.llm import pieces


def test_pieces_vary_within_a_run(spark):
    text = " ".join(["international"] * 200)
    copies = spark.createDataFrame([(i, text) for i in range(5)] + [(0, text)], "doc_id long, text string")
    got = pieces.encode(copies, 0.1, 1).collect()
    assert len({bytes(r["ids"]) for r in got}) == 5  # copies differ, rows equal in doc_id and text do not
    codec = pieces.PieceCodec(pieces.default_model(), 0.1, 1)
    ways, word = set(), []
    for i in np.frombuffer(codec.encode(text, "7"), "<u4").tolist():
        if codec.bytes_of[i][:1] == b" " and word:
            ways.add(tuple(word))
            word = []
        word.append(i)
    assert len(ways) > 10


def test_kept_segmentations_equal_the_agenda():
    for dropout in (0.05, 0.3):
        codec = pieces.PieceCodec(pieces.default_model(), dropout, 3)
        counts = collections.Counter()
        for segment in ["▁international", "▁ananananananananan", "x", "▁the", "▁Straße", "▁" + "long" * 20]:
            node = codec._node(segment)
            for place in range(400):
                want = codec._ids(segment, codec.merges(segment, place))
                assert codec._at(node, place) == want
                counts[segment, want] += 1
        assert len(counts) > 100
