"""The entry point without the optional folders."""

import os
import shutil
import subprocess
import sys

from quillon.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTED = "import __spark_entry__ as e; print(*sorted(e.queries())); print(len(e.oracle_sql()))"


def listed(folder):
    done = subprocess.run([sys.executable, "-c", LISTED], cwd=folder, capture_output=True, text=True,
                          check=True, timeout=300)
    names, statements = done.stdout.strip().splitlines()
    return names.split(), int(statements)


def test_the_library_stands_without_the_optional_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(
        ".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse", "metastore_db"))
    names, statements = listed(tmp_path / "copy")
    assert set(names) == set(registry.QUERIES) and statements == len(names)


def test_a_broken_optional_import_leaves_the_rest(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(
        ".git", "llm", "__pycache__", "spark-warehouse", "metastore_db"))
    broken = tmp_path / "copy" / "quillon" / "llm"
    broken.mkdir()
    (broken / "__init__.py").write_text("import a_module_that_is_not_there\n")
    assert set(registry.QUERIES) <= set(listed(tmp_path / "copy")[0])
