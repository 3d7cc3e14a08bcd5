import tracemalloc

import numpy as np

from aeolia.llm import maxent


def test_sums_of_rows_as_added_at_once_in_little_room():
    rng = np.random.default_rng(5)
    table, rows = rng.standard_normal((500, 48)).astype(np.float32), rng.integers(0, 500, (4096, 4))
    want = table[rows].sum(axis=1)
    tracemalloc.start()
    got = maxent._summed(table, rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tobytes() == want.tobytes() and most < 2.5 * want.nbytes
