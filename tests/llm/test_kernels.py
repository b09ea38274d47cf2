import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docquery.llm.kernels import SPACE, byte_table, covered, expand, prefix_hash, range_hash, rolling_hash, row_of, runs_of, slices, sliding_max, sliding_min, window_runs, words


@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 12))
@settings(deadline=None)
def test_sliding(xs, width):
    x = np.array(xs, dtype=np.uint64)
    want = [min(xs[i : i + width]) for i in range(len(xs) - width + 1)]
    assert sliding_min(x, width).tolist() == want
    assert sliding_max(x, width).tolist() == [max(xs[i : i + width]) for i in range(len(xs) - width + 1)]


@given(st.binary(max_size=80), st.integers(1, 9))
@settings(deadline=None)
def test_equal_ranges_have_equal_hashes(data, size):
    v = byte_table(1)[np.frombuffer(data, dtype=np.uint8)]
    h = rolling_hash(v, size)
    p = prefix_hash(v)
    at = np.arange(len(h))
    assert (h == range_hash(p, at, at + size)).all()
    seen = {}
    for i in range(len(h)):
        assert seen.setdefault(data[i : i + size], h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t", max_size=12)), max_size=12), st.integers(1, 40))
@settings(deadline=None)
def test_words_of_slices(texts, limit):
    got, rows = [], 0
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]).slice(0)
    for part, data, off in slices(batch, "text", limit):
        s, e, bounds = words(data, off, SPACE)
        row = row_of(bounds, len(s))
        own = [[] for _ in range(part.num_rows)]
        for a, z, r in zip(s, e, row, strict=True):
            own[r].append(data[a:z].tobytes())
        got += own
        rows += part.num_rows
    assert rows == len(texts) and got == [(t or "").encode().split() for t in texts]


def test_ranges():
    assert expand(np.array([3, 10]), np.array([2, 3])).tolist() == [3, 4, 10, 11, 12]
    assert covered(6, np.array([1, 4]), np.array([2, 9])).tolist() == [False, True, True, False, True, True]
    assert [x.tolist() for x in runs_of(np.array([True, False, True, True]))] == [[0, 2], [1, 4]]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(2, 6), st.integers(1, 8))
@settings(deadline=None)
def test_window_runs_hold_every_window(xs, width, longest):
    x = byte_table(4)[np.array(xs, dtype=np.uint8)]
    n = len(xs) - width + 1
    row = np.zeros(len(xs), dtype=np.int64)
    valid = np.arange(len(xs)) < n
    key, lo, size, times = window_runs(x, row, valid, width, longest)
    seen = []
    for k, a, s, t in zip(key, lo, size, times, strict=True):
        assert s <= longest
        for p in range(a, a + s):
            assert x[p : p + width].min() == k
            seen.append(p)
        assert t == (x[a : a + s + width - 1] == k).sum()
    assert seen == list(range(max(n, 0)))
