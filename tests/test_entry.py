"""The entry loads with and without the corpus operators and the pipeline."""
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len([n for n in q if not n.startswith('op') and n != 'pipeline']), len(q), set(o) <= set(q))"


@pytest.mark.parametrize("gone", [["hectara/llm", "tests/llm"], ["hectara/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without(tmp_path, gone):
    kept = {str(Path(g)) for g in gone}

    def left_out(folder, names):
        here = Path(folder).relative_to(ROOT)
        return [n for n in names if str(here / n) in kept or n in (".git", "__pycache__")]

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=left_out)
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    location, every, fits = run.stdout.split()
    assert int(location) >= 218 and fits == "True"
    assert (int(every) == int(location)) == ("hectara/llm" in gone)
