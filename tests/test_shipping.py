"""Worker functions must load where the package is not installed."""

import subprocess
import sys

from pyspark import cloudpickle

from heldout.operators import nulls, similarity


def test_functions_travel_by_value(tmp_path):
    (tmp_path / "f.bin").write_bytes(cloudpickle.dumps((nulls._flow, similarity._looked)))
    code = "import pickle; f, g = pickle.load(open('f.bin', 'rb')); print(f([('a', 3, 1), ('b', 3, 1)])[0])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("[True, True]"), out.stderr
