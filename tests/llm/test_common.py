import re
import threading
import time
from pathlib import Path

from cairn.llm.common import cut, freeing, keep, scratch


def test_scratches_of_two_threads(spark):
    """Each thread's scratch deletes its own tables only, and keep() hands a table to the scratch around it."""
    ready, done, seen = threading.Event(), threading.Event(), {}

    def first():
        with scratch(spark):
            with scratch(spark):
                inner, kept = cut(spark.range(3)), keep(spark.range(4))
            seen["kept"] = kept.count()
            own = cut(spark.range(5))
            ready.set()
            done.wait(60)
            seen["own"] = own.count()
            try:
                inner.count()
            except Exception as e:
                seen["inner"] = type(e).__name__

    def second():
        ready.wait(60)
        with scratch(spark):
            seen["second"] = cut(spark.range(6)).count()
        time.sleep(0.1)
        done.set()

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert (seen["kept"], seen["own"], seen["second"]) == (4, 5, 6) and "inner" in seen


def test_freeing_gives_memory_back():
    """Memory that a task took and let go leaves the process, although a small object that lives on lies above it."""
    held = []

    def run(batches):
        for b in batches:
            many = [bytes(600) for _ in range(200_000)]
            held.append(bytes(600))
            yield b + len(many)

    own = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    before = own()
    assert list(freeing(run)([1, 2])) == [200_001, 200_002]
    assert own() - before < 40
