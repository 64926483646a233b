"""Arrow batches in small parts: Spark sends up to 10,000 rows at once, of which a Python worker then holds few as objects and results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows and mean bytes of a part.
ROWS, BYTES = 64, 1 << 20


def parts(batch: pa.Array | pa.RecordBatch) -> Iterator[pa.Array | pa.RecordBatch]:
    """All rows in order, ROWS at a time, fewer where they are long; an empty batch is one part."""
    n = len(batch)
    step = max(1, min(ROWS, n * BYTES // max(1, batch.nbytes)))
    for i in range(0, max(1, n), step):
        yield batch.slice(i, step)
