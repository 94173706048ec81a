import gc
import time
from pathlib import Path

from lattica.llm.common import release, stage


def test_the_drivers_jvm_gives_native_memory_back(spark):
    """What was freed between blocks that stay in use goes back to the system as a table is written."""
    jvm = spark.sparkContext._jvm
    own = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")

    def mb():
        return next(int(x.split()[1]) for x in own.read_text().splitlines() if x.startswith("Anonymous")) / 1024

    stage(spark.range(10), "before")
    blocks = [jvm.java.nio.ByteBuffer.allocateDirect(100_000) for _ in range(2000)]
    kept = blocks[::50]
    del blocks
    for _ in range(3):
        gc.collect()
        jvm.System.gc()
        time.sleep(1)
    full = mb()
    stage(spark.range(10), "after")
    after = mb()
    assert len(kept) == 40 and after < full - 100, (full, after)
    release(spark)


def test_idle_python_workers_give_memory_back(spark):
    """What a worker has freed between blocks that stay in use goes back to the system before the next stage."""

    def fill(batches):
        import os
        import sys

        for batch in batches:
            blocks = [bytearray(100_000) for _ in range(2000)]
            sys.kept_by_test = blocks[::50]
            del blocks
            yield batch.from_arrays([[os.getpid()]], names=["pid"])

    (pid,) = [r["pid"] for r in spark.range(0, 1, 1, 1).mapInArrow(fill, "pid long").collect()]

    def mb():
        return next(int(x.split()[1]) for x in Path(f"/proc/{pid}/smaps_rollup").read_text().splitlines() if x.startswith("Anonymous")) / 1024

    full = mb()
    release(spark, executors=True)
    assert mb() < full - 100, (full, mb())
