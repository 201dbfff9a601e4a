"""What a Python worker holds when its work is done, and signatures counted in sorted runs."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import jaccard

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORKER = """
import re
import numpy as np, pyarrow as pa
from graphloom.llm import jaccard
from graphloom.llm.common import slices

pins = []
batch = pa.RecordBatch.from_arrays([pa.array(["x"])], names=["t"])
for part in slices(iter([batch]), "t"):
    many = [np.ones(8000) for _ in range(1500)]  # 96 MB in pieces; the last stays, so the C library keeps the others
    pins.append(many[-1])
    del many
print(sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_slices_give_freed_memory_back():
    out = subprocess.run([sys.executable, "-c", WORKER], env=os.environ | {"PYTHONPATH": HERE}, capture_output=True, text=True, check=True)
    assert float(out.stdout) < 100  # 60 for the libraries


def test_signatures_are_counted_across_batches():
    r = np.random.default_rng(5)
    sig, often = np.sort(r.integers(0, 300, 400)), r.integers(1, 3, 400)
    for cuts in ([], [1, 2, 3], [0, 0, 150, 150, 399], list(range(1, 400))):
        parts = zip([0, *cuts], [*cuts, 400])
        got = [b for b in jaccard._shared(iter([pa.RecordBatch.from_arrays([pa.array(sig[a:b]), pa.array(often[a:b])], names=["sig", "often"]) for a, b in parts]))]
        got = [x for b in got for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert got == [(int(s), int(often[sig == s].sum())) for s in np.unique(sig) if often[sig == s].sum() > 1]
    assert sum(b.num_rows for b in jaccard._shared(iter([]))) == 0


def test_a_text_in_very_many_rows_is_one_row_of_a_signature():
    texts = pa.array(["a b c d e f g h"] * 500 + ["q r s t u v w x"])
    one = pa.RecordBatch.from_arrays([pa.array(range(501)), texts], names=["i", "t"])
    rows = [x for b in jaccard._counted(5, 80, 40)(iter([one])) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert len({s for s, _ in rows}) == len(rows) and {n for _, n in rows} <= {1, 500, 501}
