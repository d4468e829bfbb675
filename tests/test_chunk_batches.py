"""What a task of the chunker holds at once."""

from __future__ import annotations

import pyarrow as pa

from quillspark.functions import chunking


def test_chunks_leave_in_small_batches():
    """A batch of many notes gives its chunks a few at a time."""
    bodies = ["word " * 4000, None, "", "short"] * 500
    batch = pa.RecordBatch.from_pydict({"path": [f"n{k}" for k in range(len(bodies))], "body": pa.array(bodies, pa.string())})
    out = list(chunking._cut(chunking.Policy())(iter([batch])))
    assert max(b.nbytes for b in out) < 3 * chunking.TEXTS < sum(b.nbytes for b in out)
    want = [(f"n{k}", *c) for k, body in enumerate(bodies[:4]) for c in chunking.chunk(body)]
    got = [tuple(r.values()) for b in out[:1] for r in b.to_pylist()][: len(want)]
    assert got == want
