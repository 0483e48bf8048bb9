"""Very long units beside many short ones."""

import random

from accountgraph.llm import pieces


def test_batches_stay_small(monkeypatch):
    vocabulary = pieces.load()
    cells, real = [], pieces._segment_lanes

    def watched(v, units):
        cells.append(max(map(len, units)) * len(units))
        return real(v, units)

    monkeypatch.setattr(pieces, "_segment_lanes", watched)
    rng = random.Random(1)
    text = " ".join([f"w{i}x" for i in range(6_000)] + ["Zm9v" * 12_000] + ["".join(rng.choice("abcdefg") for _ in range(900)) for _ in range(5_000)])
    codec = pieces.Codec(vocabulary)
    assert codec.decode(codec.encode([text])[0]) == text
    assert max(cells) <= pieces.CELLS


def test_units_alone_are_segmented_like_lanes():
    vocabulary = pieces.load()
    rng = random.Random(2)
    units = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 900))).encode() for signs in ("ab cdefe", "the and of ", "漢字é🙂x", "0x41<>") for _ in range(8)]
    units = [u.replace(b" ", pieces._MARK) for u in units] + [b"\xff" * 300, b"a" * 5_000]
    assert list(pieces._segment_alone(vocabulary, units)) == pieces._segment_lanes(vocabulary, units)
