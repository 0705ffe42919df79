import subprocess
import sys
from pathlib import Path

import corpus_pipeline

#: Encodes a batch as large as Spark makes them, in a process of its own; prints the MB by which that grows beyond the batch.
GROWTH = """
import random, re
import pyarrow as pa
import public_tokenizers
from scrubwell.llm import bpe, common

def mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

r = random.Random(1)
words = ["".join(r.choices("etaoinshrdlu", k=r.randrange(3, 8))) for _ in range(15_000)]
texts = pa.array([" ".join(r.choices(words, k=500)) for _ in range(8_000)], pa.string())
batch = pa.RecordBatch.from_arrays([pa.array(range(8_000), pa.int64()), texts], names=["key", "text"])
codec = bpe.codec(public_tokenizers.path(bpe.RANKS))
common.give_back()
before, most = mb(), 0
for _, _, part in bpe.slices(iter([batch]), codec):
    made = part.ids_text(), part.decoded(), part.numbers()
    most = max(most, mb())
print(most - before)
"""


def test_slices_leave_little_behind():
    """Two workers beside a full heap: what allocators held from slice to slice took an executor beyond its memory in tokens."""
    done = subprocess.run([sys.executable, "-c", GROWTH], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300, check=True)
    assert float(done.stdout) < 60


def test_tokens_makes_no_arrays_of_texts(spark, docs):
    """The ids come as numbers; an array of texts of each row's ids filled the executors' heap with garbage."""
    out = corpus_pipeline.tokens(spark, docs(["one two", "", None]), "")
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.n_tokens, len(r.ids)) for r in out.collect()) == [(0, 0), (0, 0), (2, 2)]
