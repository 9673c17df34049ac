import os
import sys

import numpy as np
import pyarrow as pa
import pytest

from ordinate.llm import common


def tools():
    """Functions that a worker gets by value, as it can't import this file."""

    def held() -> int:
        """MB of this process that are not mapped files."""
        with open("/proc/self/status") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("RssAnon")) // 1024

    def litter(mb: int) -> None:
        """Small arrays that go, and one of each MB that stays, so that the heap can't shrink at its end."""
        blocks, sys.kept_here = [], []
        for _ in range(mb):
            blocks.append([np.ones(4096) for _ in range(32)])
            sys.kept_here.append(blocks[-1].pop())

    def told(mb: int) -> pa.Table:
        return pa.table({"pid": pa.array([os.getpid()], pa.int64()), "mb": pa.array([mb], pa.int64())})

    return held, litter, told


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="reads /proc")
@pytest.mark.parametrize("grouped", [False, True])
def test_python_workers_give_their_memory_back(spark, grouped):
    held, litter, told = tools()

    def fill(batches):
        before = held()
        for _ in batches:
            litter(300)
        yield from told(before).to_batches()

    def fill_group(group):
        before = held()
        litter(300)
        return told(before)

    def look(batches):
        for _ in batches:
            pass
        yield from told(held()).to_batches()

    one = spark.range(1).coalesce(1)
    schema = "pid bigint, mb bigint"
    filled = common.apply_arrow(one, ["id"], fill_group, schema, large=0) if grouped else common.map_arrow(one, fill, schema)
    first = filled.collect()[0]
    for _ in range(30):  # until the same worker gets a task again
        later = {r["pid"]: r["mb"] for r in one.repartition(8).mapInArrow(look, schema).collect()}
        if first["pid"] in later:
            break
    assert later[first["pid"]] < first["mb"] + 100
