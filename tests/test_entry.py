"""The driver contract with and without the optional subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

WITHOUT = """
import sys
for name in {blocked}:
    sys.modules[name] = None
import __spark_entry__ as entry
from tillscope.plans import reports
assert set(entry.queries()) == set(reports.QUERIES) == set(entry.oracle_sql())
"""


def test_queries_without_the_optional_parts():
    for blocked in (["tillscope.llm", "corpus_pipeline"], ["tillscope.llm"]):
        subprocess.run([sys.executable, "-c", WITHOUT.format(blocked=blocked)], cwd=ROOT, check=True, timeout=120)


def test_an_error_inside_the_optional_parts_is_not_hidden():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__"
    if os.path.isdir(os.path.join(ROOT, "tillscope", "llm")):
        ran = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, timeout=120)
        assert ran.returncode != 0


def test_the_library_does_not_import_the_optional_subpackage():
    code = "import sys, tillscope.plans.reports, tillscope.plans.pages; assert not any('.llm' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
