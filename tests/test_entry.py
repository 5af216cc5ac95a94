"""The driver's entry module with and without the optional text corpora part."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from siteprism.plans import catalog

REPO = Path(__file__).resolve().parents[1]
LISTED = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


@pytest.fixture(scope="module")
def bare(tmp_path_factory):
    """A copy of the repository without the optional files."""
    copy = tmp_path_factory.mktemp("bare") / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    return copy


def listed(folder: Path, before: str = "") -> list[set[str]]:
    out = subprocess.run([sys.executable, "-B", "-c", before + LISTED], cwd=folder, capture_output=True, text=True, check=True)
    return [set(line.split()) for line in out.stdout.splitlines()]


def test_with_the_folders_deleted(bare):
    names, sql = listed(bare)
    assert names == set(catalog.QUERIES) and sql == set(catalog.ORACLES)


def test_without_a_package_that_the_text_corpora_need():
    names, sql = listed(REPO, "import sys; sys.modules['ahocorasick'] = None\n")
    assert names == set(catalog.QUERIES) and sql == set(catalog.ORACLES)


def test_sql_belongs_to_queries():
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
