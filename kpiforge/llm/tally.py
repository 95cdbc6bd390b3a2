"""Map-side counts of byte strings with a bound on what a task holds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa

HELD_WORDS = 200_000


def tally(counts: Iterable[dict[bytes, int]], kind: pa.DataType, name: str = "word",
          held: int = HELD_WORDS) -> Iterator[pa.RecordBatch]:
    """Partial sums (name, n) of ``counts``; a word may come in several batches,
    as the sums go out whenever ``held`` different words are reached."""
    total: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()).cast(kind), pa.array(list(total.values()), pa.int64())],
            [name, "n"])

    for some in counts:
        for word, n in some.items():
            total[word] += n
        if len(total) >= held:
            yield out()
            total.clear()
    if total:
        yield out()
