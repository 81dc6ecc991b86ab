import base64
import os
import subprocess
import sys

from pyspark import cloudpickle

from tessera.operators import pipeline, vectors


def test_functions_load_without_the_package(tmp_path):
    data = base64.b64encode(cloudpickle.dumps((pipeline.semantic_chunk, pipeline.storage_chunk, vectors.hashing_embedder(8)))).decode()
    code = "import base64, pickle, sys; a, b, c = pickle.loads(base64.b64decode(sys.stdin.read())); print(len(a('x' * 300, 32)), len(b('a\\nb', 1)), len(c('hi there')), 'tessera' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], input=data, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    assert run.stdout.split() == ["3", "2", "8", "False"], run.stderr
