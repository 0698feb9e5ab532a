import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage(tmp_path):
    """The rest imports and registers its queries, even if the subpackage left a folder behind."""
    shutil.copytree(ROOT / "newsloom", tmp_path / "newsloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "newsloom" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)


def test_every_query_is_registered_once():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
    assert all(callable(q) and q.__doc__ for q in queries.values())
