"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


NONE = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"


def _run(folder: Path, code: str) -> None:
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=folder, check=True, env={"PYTHONPATH": str(folder), "PATH": "/usr/bin:/bin", "HOME": str(folder)})


def _link(folder: Path, *names: str, leave: tuple[str, ...] = ()) -> None:
    for name in names:
        if (ROOT / name).is_dir():
            _copy(ROOT / name, folder / name, leave)
        elif (ROOT / name).exists():
            (folder / name).symlink_to(ROOT / name)


def test_without_training_data_operators(tmp_path):
    for n, names in enumerate((("__spark_entry__.py", "sluice"), ("__spark_entry__.py", "corpus_pipeline.py", "sluice"))):
        folder = tmp_path / str(n)
        folder.mkdir()
        _link(folder, *names, leave=("llm",))
        _run(folder, NONE)


def test_without_a_library_of_the_training_data_operators(tmp_path):
    _link(tmp_path, "__spark_entry__.py", "corpus_pipeline.py", "sluice")
    (tmp_path / "zstandard.py").write_text("raise ImportError('not here', name='zstandard')")
    _run(tmp_path, NONE)


def _copy(src: Path, to: Path, leave: tuple[str, ...] = ()) -> None:
    to.mkdir()
    for p in src.iterdir():
        if p.name not in (*leave, "__pycache__"):
            (to / p.name).symlink_to(p)
