"""What training leaves with the driver, and how much of its batches the n-gram join holds at once."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

from echolith.llm import ngram_join

_TRAIN = """
import gc, random, re
from echolith.llm import toxicity

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng = random.Random(3)
words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(4, 12))) for _ in range(8000)]
texts = [" ".join(rng.choices(words, k=1000)) for _ in range(600)]
toxicity.train(texts[:20], [0, 1] * 10, epochs=1)
before = held()
toxicity.train(texts, [0, 1] * 300, epochs=1)
gc.collect()
print(held() - before)
"""


def test_training_leaves_little_with_the_driver():
    done = subprocess.run([sys.executable, "-c", _TRAIN], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True)
    assert float(done.stdout) < 25


def test_shingles_are_unpacked_a_few_sets_at_a_time():
    class Rows:
        """Stands for a DataFrame: hands over the function that mapInArrow would run."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    sets = [np.arange(k, k + 50, dtype=np.uint64) for k in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(range(2000)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["c", "label", "shingles"])
    out = list(ngram_join._unpacked(Rows(), 0, 1 << 64)(iter([batch])))
    assert max(b.num_rows for b in out) <= 256 * 50
    assert [v for b in out for v in b.column("token").to_pylist()] == [int(v) for x in sets for v in x]
    assert [v for b in out for v in b.column("c").to_pylist()] == [k for k in range(2000) for _ in range(50)]
