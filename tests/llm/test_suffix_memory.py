"""What one call of the segment scan holds is bounded by PIECE."""

import tracemalloc

import numpy as np

from screenlens.llm import op10_suffix as S


def test_work_arrays_of_a_piece():
    data = np.random.default_rng(1).integers(32, 127, S.PIECE, dtype=np.uint8).tobytes()
    tracemalloc.start()
    S.segments(data, [(0, len(data))], S.LENGTH, S.GRAM)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20
