"""What the training-data operators bring to the driver, each with its bound."""

import ast
from pathlib import Path

PACKAGE = Path(__file__).resolve().parents[2] / "tidemill" / "llm"
#: file: number of collect calls. mixing: at most 16 exponents; counters: arrays of a fixed length;
#: quality_classifier: at most 4,096 bins a round; lexical_search: one bundle of items, 1 MB or so; whitening: moments of four components.
ALLOWED = {"mixing.py": 1, "counters.py": 1, "quality_classifier.py": 1, "lexical_search.py": 1, "whitening.py": 1}


def test_rows_come_to_the_driver_only_where_their_number_is_bounded():
    banned = {"toPandas", "toLocalIterator", "localCheckpoint", "crossJoin"}  # take is also a call of Arrow tables
    for path in PACKAGE.rglob("*.py"):
        calls = [n.func.attr for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)]
        assert not banned & {*calls}, path
        assert calls.count("collect") == ALLOWED.get(path.name, 0), path
