"""The entry with and without the optional parts."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("blocked", ["", "tiktoken", "estatelens.llm"])
def test_queries_are_there_without_optional_libraries(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; print('signatures' in e.queries(), any(n.startswith('op') and '_' in n[:5] for n in e.queries()))"
    code = code if blocked else code.replace("sys.modules[''] = None; ", "")
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    optional = not blocked and os.path.isdir(os.path.join(ROOT, "estatelens", "llm"))
    assert done.stdout.split() == ["True", str(optional)], done.stderr[-500:]
