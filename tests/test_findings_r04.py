"""Small tests of what the fourth review found."""

import builtins
import dis
import importlib
import inspect
import pkgutil
import types

import duckdb
import pytest

import spanforge
from spanforge import plans


def functions(code):
    for c in code.co_consts:
        if isinstance(c, types.CodeType):
            yield c
            yield from functions(c)


@pytest.mark.parametrize("name", [m.name for m in pkgutil.walk_packages(spanforge.__path__, "spanforge.")])
def test_functions_find_the_names_they_use(name):
    """a name that a function needs and its module lacks is an error only when the function is called."""
    module = importlib.import_module(name)
    code = compile(inspect.getsource(module), name, "exec")
    used = {i.argval for f in functions(code) for i in dis.get_instructions(f) if i.opname == "LOAD_GLOBAL"}
    assert {n for n in used if not hasattr(module, n) and not hasattr(builtins, n)} == set()


def test_levels_on_their_bounds(spark, tmp_path):
    """F1: spans of just 0.5, 0.7 and 0.9 are of the level above; texts without a span, empty or missing add nothing."""
    texts = ["John Doe", "Jean Dupont", "1980-02-03", "born 1980-02-03", "10.0.0.1", "phone 514-555-0199", "123-45-6789", "ssn 123-45-6789", "nothing here", "", None]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["o157_levels"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("high", 2), ("medium", 2), ("very_high", 3), ("very_low", 1)]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(plans.ORACLE_SQL["o157_levels"]).fetchall()) == sorted(map(tuple, got))
