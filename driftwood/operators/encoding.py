"""The encoder stage: an injected model makes vectors of texts, once per worker, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an encoder returns for a list of texts: dense vectors, {token id: weight}, and lists of token vectors.
Encoded = tuple[list, list[dict[int, float]], list]
SCHEMA = "dense array<double>, sparse_idx array<long>, sparse_val array<double>, late array<array<double>>"


def encode(rows: DataFrame, build: Callable[[], Callable[[list[str]], Encoded]], key: str = "chunk_id", text: str = "text", prefix: str = "", batch: int = 32) -> DataFrame:
    """key and the vectors of each text; sparse weights in descending order, ties by token id.

    `build` loads the model and is called once in each task; texts are encoded `batch` at a time, with a prefix.  A null
    text is encoded as an empty one.  Rows are not shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            model = model or build()
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                dense, sparse, late = model([prefix + (t or "") for t in part["_text"]])
                ordered = [sorted(w.items(), key=lambda kv: (-kv[1], kv[0])) for w in sparse]
                yield pd.DataFrame({key: part[key], "dense": [list(map(float, v)) for v in dense], "sparse_idx": [[int(i) for i, _ in o] for o in ordered], "sparse_val": [[float(x) for _, x in o] for o in ordered], "late": [[list(map(float, v)) for v in m] for m in late]})

    named = rows.select(key, F.col(text).alias("_text"))
    return named.mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {SCHEMA}")


def letters() -> Callable[[list[str]], Encoded]:
    """A stand-in for a model: counts of the letters a-z, as dense vector, as sparse weights and one vector per word."""

    def run(texts: list[str]) -> Encoded:
        count = lambda t: [t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"]
        lower = [t.lower() for t in texts]
        dense = [count(t) for t in lower]
        return dense, [{k: n for k, n in enumerate(d) if n} for d in dense], [[count(w) for w in t.split()[:8]] for t in lower]

    return run
