"""A batch's rows are Python objects a few at a time."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from quern.functions import batches, outline


def test_rows_in_order_with_nulls_and_none():
    a = pa.array([None if i % 7 == 0 else "x" * i for i in range(1_000)])
    made = batches.by_rows(lambda x, n: None if x is None else x + str(n), pa.string(), a, pa.array(range(1_000)))
    assert made.to_pylist() == [None if i % 7 == 0 else "x" * i + str(i) for i in range(1_000)]
    assert batches.by_rows(str, pa.string(), pa.array([], pa.string())).to_pylist() == []


def test_outlines_of_a_batch_are_not_all_objects_at_once():
    text = pa.array(["\n".join(f"def f{k}(x):" for k in range(400))] * 1_000)
    tracemalloc.start()
    made = outline.python_outline.func(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made[999].as_py()[399] == {"level": 2, "text": "f399", "start_line": 400, "end_line": 400} and len(made) == 1_000
    assert peak < 20_000_000  # 400,000 headings as dictionaries take over 100 MB


def test_converted_texts_need_no_copies_of_the_batch():
    """What text_load runs: bytes to text, one slice after another."""
    raw = pa.array([b"word " * 4_000] * 2_000)
    tracemalloc.start()
    made = batches.by_rows(lambda b: b.decode("utf-8", "replace"), pa.string(), raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == 2_000 and made.nbytes >= 40_000_000 and peak < 10_000_000
