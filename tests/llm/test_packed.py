import subprocess
import sys
from pathlib import Path

import numpy as np

from lattica.llm import packed as p


def test_a_few_words_take_a_small_table():
    code = """
import numpy as np
from lattica.llm.packed import Ranges
def kb():
    return next(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous"))
before = kb()
kept = Ranges(np.arange(200, dtype=np.uint8)).hash(np.array([0, 5]), np.array([5, 10]))
print(kb() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(done.stdout) < 40_000


def test_hashes_do_not_follow_the_table(monkeypatch):
    """The same bytes at any place, before and after a longer text has made the tables longer, and with tables of any step."""
    data = np.random.default_rng(1).integers(0, 256, 3000, np.uint8)
    found = []
    for step, lengths in ((1, (100, 3000)), (7, (3000, 100)), (1 << 17, (100, 400_000))):
        monkeypatch.setattr(p, "_POWERS_STEP", step)
        monkeypatch.setattr(p, "_made", {})
        for n in lengths:
            whole = np.resize(data, n)
            at = np.arange(0, 60) + (3000 if n > 3000 else 0)
            ranges = p.Ranges(whole)
            found.append(ranges.hash(at, at + 40).tolist() + ranges.hash_width(40)[at].tolist())
    assert all(f == found[0] for f in found) and len(set(found[0])) == 120
    monkeypatch.setattr(p, "_made", {})
    assert len(p.Ranges(data[:0]).hash_width(40)) == 0
