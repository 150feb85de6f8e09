"""The driver's entry module loads anywhere: without Spark's jars, and without what may be taken away."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT

HIDE = """
import sys
def hook(event, args):
    if event in ("open", "glob.glob", "os.listdir", "os.scandir") and "/jars" in str(args[0]):
        raise FileNotFoundError(args[0])
sys.addaudithook(hook)
"""
LOOK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); from matchloom.plans.queries import QUERIES as c; print(sum(n in c for n in q), sum(n not in c for n in q), len(s))"


def run(folder, code):
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([folder, *[p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and p != ROOT]])}
    done = subprocess.run([sys.executable, "-W", "error", "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    return [int(x) for x in done.stdout.split()]


def test_queries_load_without_jars():
    core, _, sql = run(ROOT, HIDE + LOOK)
    assert core >= 90
    assert sql >= 90


def test_queries_load_without_the_corpus_operators(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/matchloom", tmp_path / "matchloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    core, corpus, _ = run(str(tmp_path), LOOK)
    assert core >= 90
    assert corpus == 0
    assert core == run(ROOT, LOOK)[0]


def test_what_is_broken_is_said_aloud(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/matchloom", tmp_path / "matchloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_package\n")
    code = "import warnings\nwith warnings.catch_warnings(record=True) as w:\n    warnings.simplefilter('always')\n    import __spark_entry__ as e\nassert any('no_such_package' in str(x.message) for x in w)\nprint(len(e.queries()))"
    assert run(str(tmp_path), code)[0] >= 90


def test_a_cluster_has_to_name_its_shared_folder():
    from types import SimpleNamespace

    import pytest

    from matchloom.storage import shared_root

    nothing = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: nothing, getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(SimpleNamespace(sparkContext=context, conf=nothing))
