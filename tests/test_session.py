"""The shared folder, and what is registered with and without the optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from quern import session

ROOT = Path(__file__).resolve().parent.parent


def fake(master, setting=None, made=None):
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: made)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting or default), sparkContext=sc)


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(fake(master))
        assert session.shared_dir(fake(master, "hdfs://x/work/")) == "hdfs://x/work"
        assert session.shared_dir(fake(master, None, "hdfs://x/made")) == "hdfs://x/made"


def test_written_tables_can_be_forgotten(spark):
    rows = session.written(spark.range(5).toDF("n"), "test")
    assert rows.count() == 5 and rows.schema["n"].dataType.simpleString() == "bigint"
    path = Path(rows._quern_path.removeprefix("file:").replace("//", "/"))
    assert path.is_dir()
    session.forget(rows)
    assert not path.exists()


def copy_of_the_repository(to: Path, without: tuple[str, ...]) -> Path:
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis"))
    for name in without:
        target = to / name
        shutil.rmtree(target) if target.is_dir() else target.unlink(missing_ok=True)
    return to


def registered(repository: Path) -> subprocess.CompletedProcess:
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op1_') for n in e.queries()))"
    return subprocess.run([sys.executable, "-c", code], cwd=repository, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})


def test_the_rest_stands_alone(tmp_path):
    lone = registered(copy_of_the_repository(tmp_path / "lone", ("quern/llm", "tests/llm", "corpus_pipeline.py")))
    assert lone.returncode == 0, lone.stderr
    queries, with_sql, has_llm = lone.stdout.split()
    assert int(queries) > 80 and queries == with_sql and has_llm == "False"


def test_a_broken_import_is_not_hidden(tmp_path):
    if not (ROOT / "quern/llm").is_dir():
        pytest.skip("the subpackage is not here")
    broken = copy_of_the_repository(tmp_path / "broken", ())
    with open(broken / "quern/llm/queries.py", "a") as f:
        f.write("\nimport no_such_module_anywhere\n")
    got = registered(broken)
    assert got.returncode != 0 and "no_such_module_anywhere" in got.stderr
