"""The driver's entry without the optional parts."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("hidden", ["public_tokenizers", "transitreach.llm", "corpus_pipeline"])
def test_reference_queries_do_not_need_the_optional_subpackage(hidden):
    code = (f"import sys; sys.modules[{hidden!r}] = None; sys.path.insert(0, {REPO!r})\n"
            "import __spark_entry__ as e\n"
            "from transitreach.catalog.registry import QUERIES\n"
            "assert set(QUERIES) <= set(e.queries()) and not any(n.startswith('op') and '_' in n and n[2].isdigit()"
            " for n in e.queries()), sorted(e.queries())\n")
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env={**os.environ}, timeout=120)
    assert run.returncode == 0, run.stderr
