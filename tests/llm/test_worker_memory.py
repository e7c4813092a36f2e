"""Python workers live on beside all later stages, so what a stage leaves in them counts against these."""

import re
import time
from pathlib import Path

import pyarrow as pa
import pytest

from tallymark.llm import packing, pii
from tallymark.llm.queries import vocabulary

ROLLUP = "/proc/self/smaps_rollup"


def _held(batches):
    import os

    time.sleep(1)  # so that each task has a worker of its own
    for _ in batches:
        pass
    mb = sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(ROLLUP).read_text()))) / 1024
    yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([mb])], names=["pid", "mb"])


@pytest.mark.skipif(not Path(ROLLUP).exists(), reason="memory can't be read here")
def test_a_stage_leaves_no_memory_to_later_ones(spark):
    rows = spark.range(0, 80, 1, 8).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 4000), k -> concat('w', md5(concat(id, ':', k))))) AS text")
    small = rows.selectExpr("doc_id", "concat('mail bob', doc_id, '@mail.example.com') AS text").repartition(8)
    held = lambda: {r.pid: r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(_held, "pid long, mb double").collect()}
    masked = lambda: pii.mask(small).write.format("noop").mode("overwrite").save()
    masked()
    before = held()
    packing.pack(rows, vocabulary()).write.format("noop").mode("overwrite").save()
    masked()
    after = held()
    both = before.keys() & after.keys()
    assert both and max(after[p] - before[p] for p in both) < 40, (before, after)
