import glob
import importlib.util
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "p4_found" in e.queries()


def test_core_does_not_import_the_subpackage():
    for path in glob.glob(f"{REPO}/corvane/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "corvane.llm" not in open(path).read(), path


def test_entry_without_the_subpackage(tmp_path):
    code = "import sys, importlib.abc\nclass B(importlib.abc.MetaPathFinder):\n    def find_spec(self, n, p, t=None):\n        if n.startswith('corvane.llm'): raise ModuleNotFoundError(n)\nsys.meta_path.insert(0, B())\nimport importlib.util as u\nreal = u.find_spec\nu.find_spec = lambda n, *a: None if n.startswith('corvane.llm') else real(n, *a)\nimport __spark_entry__ as e\nassert 'p1_found' not in e.queries() and 'p4_found' in e.queries()\n"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_queries_agree_with_sql_on_the_smallest_tables(spark):
    import duckdb

    from corvane.plans import catalogue

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    q, sql = catalogue.queries(), catalogue.oracle_sql()
    text = lambda v: "NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    for name in ("clean_demands", "profile_skill_levels", "bullet_classify", "bm25_batch", "rrf_fuse", "expand_2hop", "graph_edges"):
        df = q[name](spark, sf)
        cols = sorted(df.columns)
        cur = c.execute(sql[name])
        names = [x[0] for x in cur.description]
        wanted = sorted(tuple(text(r[names.index(k)]) for k in cols) for r in cur.fetchall())
        assert sorted(tuple(text(r[k]) for k in cols) for r in df.collect()) == wanted, name
