"""The registry stands whatever the training-data subpackage lacks."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
CODE = "import sys; sys.modules[{name!r}] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); assert 'node_scan' in q and 'node_scan' in e.oracle_sql(); print(any(k.startswith('op1_') for k in q), 'pipeline' in q)"


@pytest.mark.parametrize("name", ["xxhash", "public_tokenizers", "loomgraph.llm", "corpus_pipeline"])
def test_queries_without(name):
    out = subprocess.run([sys.executable, "-c", CODE.format(name=name)], cwd=REPO, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert "pipeline" not in out.stdout.split()[1:] and out.stdout.split()[1] == "False"
