"""The entry file stands without the training-data operators and what they import."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
ASKED = """
import __spark_entry__ as e
names = set(e.queries())
assert set(e.oracle_sql()) <= names
print(len(names), sum(x.startswith("op") and x[2].isdigit() for x in names), "pipeline" in names)
"""


@pytest.fixture(scope="module")
def core(tmp_path_factory):
    """The repository without the operators and their tests."""
    target = tmp_path_factory.mktemp("entry") / "repo"
    shutil.copytree(
        ROOT, target, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", ".*")
    )
    return target


def asked(folder, code=ASKED):
    done = subprocess.run(
        [sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120
    )
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_without_operators(core):
    from checks.queries import QUERIES

    assert asked(core) == [str(len(QUERIES)), "0", "False"]


def test_without_operators_and_pipeline(core, tmp_path):
    target = tmp_path / "repo"
    shutil.copytree(core, target, ignore=shutil.ignore_patterns("corpus_pipeline.py"))
    assert asked(target)[1:] == ["0", "False"]


def test_without_the_tokenizers():
    from checks.queries import QUERIES

    hidden = "import sys\nsys.modules['public_tokenizers'] = None\n" + ASKED
    assert asked(ROOT, hidden) == [str(len(QUERIES)), "0", "False"]
