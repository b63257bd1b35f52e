"""Parts of Arrow batches: every row once, in order, and few bytes at a time."""

import pyarrow as pa

from logloom.llm.common import slices


def test_slices():
    batches = [pa.RecordBatch.from_pydict({"i": list(range(a, a + n)), "text": ["x" * 1000] * n}) for a, n in ((0, 1000), (1000, 1), (1001, 7))]
    empty = pa.RecordBatch.from_pydict({"i": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    got = list(slices(iter([*batches, empty]), 64_000))
    assert [i for b in got for i in b.column("i").to_pylist()] == list(range(1008))
    assert max(b.nbytes for b in got) <= 64_000 and len(list(slices(iter(batches), 1))) == 1008
