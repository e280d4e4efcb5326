"""The one place where Python runs: a caller's batch function over a table of prompts."""

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

REPLY_FIELDS = [
    ("reply", pa.string()), ("in_tokens", pa.int64()), ("out_tokens", pa.int64()),
    ("latency_ms", pa.int64()), ("error", pa.string()),
]


def infer_batches(prompts: DataFrame, fn: Callable[[list], list], key: str = "rec_id",
                  concurrency: int = None, batch_size: int = 256, attempts: int = 3,
                  pause: float = 1.0) -> DataFrame:
    """``fn(list of prompts) -> list of dicts``, called with at most ``batch_size`` prompts.

    Adds ``reply``, ``in_tokens``, ``out_tokens``, ``latency_ms`` and ``error``. A reply may be
    ``{"error": ...}`` and stands for its own prompt only. A ``ValueError`` says that something in the
    batch is unfit: the batch is halved until the unfit prompts stand alone. Any other failure, such as a
    service that is down, is tried ``attempts`` times with a pause that doubles; then the prompts of
    the batch get the error, without further calls. ``concurrency`` bounds the number of tasks that call
    the model at once. A lost executor repeats the calls of its unfinished tasks, so write the result to
    a table before joining it.
    """
    dtype = dict(prompts.dtypes)[key]
    schema = (
        f"{key} {dtype}, kind string, reply string, in_tokens bigint, out_tokens bigint,"
        " latency_ms bigint, error string"
    )

    def failed(texts, failure):
        return [{"error": f"{type(failure).__name__}: {failure}"}] * len(texts)

    def call(texts):
        for attempt in range(attempts):
            try:
                replies = list(fn(texts))
                if len(replies) != len(texts):
                    raise ValueError(f"{len(replies)} replies for {len(texts)} prompts")
                return replies
            except ValueError as failure:
                if len(texts) == 1:
                    return failed(texts, failure)
                half = len(texts) // 2
                return call(texts[:half]) + call(texts[half:])
            except Exception as failure:  # noqa: BLE001 - any model error becomes a row
                last = failure
                if attempt + 1 < attempts:
                    time.sleep(pause * 2**attempt)
        return failed(texts, last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "kind"] + [name for name, _ in REPLY_FIELDS]
        for arrived in batches:
            for start in range(0, arrived.num_rows, batch_size):
                batch = arrived.slice(start, batch_size)
                replies = [r or {} for r in call(batch["prompt"].to_pylist())]
                made = [pa.array([r.get(name) for r in replies], kind) for name, kind in REPLY_FIELDS]
                yield pa.RecordBatch.from_arrays([batch[key], batch["kind"], *made], names=names)

    if concurrency:
        prompts = prompts.repartition(concurrency)
    return prompts.select(key, "kind", "prompt").mapInArrow(run, schema)
