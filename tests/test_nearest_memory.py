"""Memory of a task that searches the nearest rows of many queries."""

import tracemalloc

import numpy as np
import pyarrow as pa

from siltstone.operators import nearest


def test_first_rows_do_not_all_become_candidates_of_all_queries():
    rng = np.random.default_rng(0)
    unit = rng.normal(size=(8000, 4))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    rows = rng.normal(size=(600, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["r", "v"])
    tracemalloc.start()
    (found,) = nearest._search(np.arange(8000), unit, 3, False, 6, False)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    score = np.round(np.maximum(0, unit @ (rows / np.linalg.norm(rows, axis=1)[:, None]).T), 6)
    order = np.lexsort((np.broadcast_to(np.arange(600), score.shape), -score))[:, :3]
    assert sorted(zip(found["query"].to_pylist(), found["row"].to_pylist(), strict=True)) == sorted((q, r) for q in range(8000) for r in order[q])
