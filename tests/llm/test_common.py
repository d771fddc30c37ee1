import subprocess
import sys

import pyarrow as pa

from strandlake.llm import common, tokens
from strandlake.llm.queries import tokenizer_path

#: A worker of near-dup: what it still holds after its task on blocks of long texts, in MB, beside a worker that did nothing.
WORKER = """
import random
import pyarrow as pa
from strandlake.llm import common, near_dup

def held():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20

class Sink:
    def mapInArrow(self, run, schema):
        self.run = run
        return self

near_dup.TaskContext = type("Context", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 0)})
r = random.Random(1)
def batch(k):
    texts = [" ".join(f"w{r.randrange(10**5)}" for _ in range(2000)) for _ in range(300)]
    return pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array([b"%d %d" % (k, i) for i in range(300)]), pa.array(texts)], ["doc_id", "key", "text"])

blocks = list(near_dup._block(map(batch, range(6))))
lean = getattr(common, "lean", lambda run: run)
common._give_back() if hasattr(common, "_give_back") else None
before = held()
for _ in lean(near_dup._deal(8, 30))(iter(blocks)):
    pass
print(held() - before)
"""


def test_a_worker_gives_memory_back():
    out = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, check=True, cwd=common.__file__.rsplit("/strandlake/", 1)[0])
    assert int(out.stdout) < 20


def test_tasks_empty_what_other_operators_cached(spark):
    """One worker encodes, then another operator's task runs in it; encoding again keeps the encoder."""
    path = tokenizer_path()

    def states(batches):
        yield pa.RecordBatch.from_arrays([pa.array([len(tokens._encoders)])], ["n"])

    def encode(batches):
        tokens.Encoder.of(path)
        yield from states(batches)

    one = spark.range(1, numPartitions=1)
    kept = [spark.range(1, numPartitions=1).mapInArrow(common.lean(encode, path), "n long").first()["n"] for _ in range(2)]
    assert kept == [1, 1]
    assert one.mapInArrow(common.lean(states), "n long").first()["n"] == 0


def test_lean_keeps_results():
    table = pa.table({"a": [1, 2]})
    assert common.lean(lambda t: t)(table) is table
    assert common.lean(lambda a, b: pa.concat_tables([a, b]))(table, table).num_rows == 4
    assert list(common.lean(lambda batches: (x for x in batches))(iter([1, 2]))) == [1, 2]
