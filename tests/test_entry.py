import importlib.util
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

CHEAP = ["page_identity", "front_matter_fields", "section_slices", "keyword_analysis", "term_matches", "batch_search", "eval_metrics"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHEAP)
def test_same_rows_as_sql(spark, folder, name):
    db = duckdb.connect()
    for file in pathlib.Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    ours = entry.queries()[name](spark, folder)
    theirs = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(ours.columns)

    def text(x):
        return repr(round(x, 6)) if isinstance(x, float) else repr(x)

    assert sorted(tuple(map(text, r)) for r in ours.select(*columns).collect()) == sorted(tuple(map(text, r)) for r in theirs.fetchall())


def test_core_stands_alone():
    root = pathlib.Path(entry.__file__).parent
    for file in (root / "pagequarry").rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "pagequarry.llm" not in file.read_text(), file
    assert importlib.util.find_spec("pagequarry")
