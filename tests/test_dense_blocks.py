"""What a task of the dense search holds, and that a matrix product before the sums in order changes no row."""

from __future__ import annotations

import inspect

import numpy as np
import pyarrow as pa
import pytest

from evirank.operators import similarity


def test_a_task_holds_few_pairs_even_if_all_are_hits():
    of = {n: p.default for n, p in inspect.signature(similarity.cosine_join).parameters.items()}
    assert of["seed_block"] * of["target_block"] <= 1 << 23  # 16 bytes a hit: 128 MB


@pytest.mark.parametrize(("threshold", "maximum", "per_query"), [(0.25, None, None), (-1.0, None, 5), (0.2, 0.3, 4), (1.0 - 1e-12, None, 3), (0.1, 1.0, 3), (-1.0, None, 1), (2.0, None, 1)])
def test_the_rows_and_scores_of_ordered_sums(monkeypatch, threshold, maximum, per_query):
    monkeypatch.setattr(similarity, "AT_ONCE", 1 << 12)
    rng = np.random.default_rng(3)
    q, x = (similarity._units(rng.normal(size=(n, 24))) for n in (60, 500))
    x[100:140], q[:9] = x[5], x[5]  # ties, and scores of about 1 on either side of a limit
    c = np.einsum("qd,td->qt", q, x)
    want = {}
    for i, row in enumerate(c):
        ok = np.flatnonzero((row >= threshold) & (row <= (np.inf if maximum is None else maximum)))
        want |= {(i, int(j)): row[j] for j in ok[np.lexsort((ok, -row[ok]))][:per_query]}
    i, j, value = similarity._near(q, x, threshold, maximum, per_query)
    assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), value.tolist(), strict=True)) == want


def test_vectors_as_a_matrix():
    rows = pa.array([[9.0, 9.0], [1.0, None], [3.0, 4.0]], pa.list_(pa.float32())).slice(1)
    np.testing.assert_array_equal(similarity._matrix(rows), [[1.0, np.nan], [3.0, 4.0]])
    with pytest.raises(ValueError):
        similarity._matrix(pa.array([[1.0], [1.0, 2.0, 3.0]]))
