from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnlake.dsl import syntax
from cairnlake.dsl.literals import number_of
from cairnlake.operators import scope
from tests import edge

CASES = {
    "source.ext=jpg": [1],
    "source.ext!=jpg": [2, 3, 4],
    "source.ext>JPF": [1, 3, 4],
    "!source.ext=jpg": [2, 3, 4],
    "content.Make=apple": [1, 4],
    "content.Make!=apple": [1],
    "NOT content.Make=apple": [2, 3],
    "NOT NOT content.Make=apple": [1, 4],
    "content.Make?": [1, 4],
    "content.code>9": [],
    "content.n=3": [1, 4],
    "content.n>=2.5": [1, 4],
    "content.n!=abc": [],
    "content.shot>=2024-01-15": [3],
    'content.shot="2024-01-15T00:00:00Z"': [3],
    "content.tags?": [3],
    'content.tags="[1]"': [],
    'content.city="é"': [],
    'content.city="É"': [2],
    'content.note=""': [3],
    "source.device?": [1, 2, 3, 4],
    "source.device=1": [1, 3, 4],
    "source.device!=1": [],
    "content.hash.sha256?": [1, 3, 4],
    "NOT content.hash.sha256?": [2],
    "content.hash.sha256 IN (AA, bb)": [1, 3, 4],
    "object_id?": [1, 2, 3, 4],
    "object_id=100": [],
    "source.mtime<0": [3],
    "source.mtime=-1": [3],
    "source.size=nan": [],
    "source.size!=nan": [],
    "source.ext=png OR source.ext=jpg AND source.size>1000": [4],
    "(source.ext=png OR source.ext=jpg) AND source.size>1000": [],
}


@pytest.mark.parametrize("text", ["", "source.ext", "source.ext=", "t=image/jpeg", "a-b=1", "x=1e6", 'x="abc', "(x?", "x IN ()", "x=and", '"x"=1', "x? y?"])
def test_no_filter(text):
    with pytest.raises(syntax.FilterError):
        syntax.parse(text)


def test_edge_filters(spark):
    cat = edge.catalog(spark)
    sources = cat.located().where("present = 1 and role = 'source'").cache()
    from cairnlake.dsl.compiler import apply_filters

    for text, want in CASES.items():
        assert sorted(r["id"] for r in apply_filters(cat, sources, [text]).collect()) == want, text


def test_literals():
    assert number_of("2024-01-15") == number_of("2024-01-15T00:00:00") == number_of("2024:01:15 00:00:00") == number_of("2024-01-15T01:00:00+01:00") == 1705276800.0
    assert number_of("1_000") is None and number_of(" 1") is None and number_of("nan") is None and number_of("2024-13-01") is None
    assert number_of(".5") == 0.5 and number_of("5.") == 5.0 and number_of("1e6") == 1e6


_keys = st.sampled_from(["source.ext", "source.size", "content.Make", "content.n", "content.note", "nothing", "source.device", "content.hash.sha256"])
_leaf = st.one_of(st.builds(syntax.Exists, _keys), st.builds(syntax.Compare, _keys, st.sampled_from(syntax.OPERATORS), st.sampled_from(["jpg", "3", "apple", "", "1000", "aa"])), st.builds(lambda k, v: syntax.In(k, tuple(v)), _keys, st.lists(st.sampled_from(["jpg", "nikon", "3"]), min_size=1, max_size=3)))
_trees = st.recursive(_leaf, lambda x: st.one_of(st.builds(syntax.Not, x), st.builds(lambda a, b: syntax.And((a, b)), x, x), st.builds(lambda a, b: syntax.Or((a, b)), x, x)), max_leaves=6)


def shown(node) -> str:
    if isinstance(node, syntax.Exists):
        return f"{node.key}?"
    if isinstance(node, syntax.Compare):
        return f'{node.key} {node.op} "{node.value}"'
    if isinstance(node, syntax.In):
        return f"{node.key} IN (" + ", ".join(f"'{v}'" for v in node.values) + ")"
    if isinstance(node, syntax.Not):
        return f"NOT ({shown(node.item)})"
    return f" {'AND' if isinstance(node, syntax.And) else 'OR'} ".join(f"({shown(i)})" for i in node.items)


def truth(node, row) -> bool:
    """The language's meaning, one row at a time."""
    if isinstance(node, syntax.Not):
        return not truth(node.item, row)
    if isinstance(node, syntax.And):
        return all(truth(i, row) for i in node.items)
    if isinstance(node, syntax.Or):
        return any(truth(i, row) for i in node.items)
    if isinstance(node, syntax.In):
        return any(truth(syntax.Compare(node.key, "=", v), row) for v in node.values)
    held = [f for f in edge.FACTS if f[2] == node.key and (f[0] == "source" and f[1] == row[0] or f[0] == "object" and f[1] == row[11])]
    if isinstance(node, syntax.Exists):
        return node.key.startswith("source.") or bool(held) or node.key == "content.hash.sha256" and row[11] is not None
    import re

    fold = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    if node.key == "source.ext":
        stored = [(re.search(r"^(?:.*/)?[^/]+\.([^./]*)$", row[2]) or ["", ""])[1]]
    elif node.key in ("source.size", "source.device"):
        stored = [] if row[{"source.size": 5, "source.device": 3}[node.key]] is None else [float(row[{"source.size": 5, "source.device": 3}[node.key]])]
    else:
        stored = [v for f in held for v in [f[3] if f[3] is not None else f[4] if f[4] is not None else float(f[5]) if f[5] is not None else None] if v is not None]
    for v in stored:
        if isinstance(v, str):
            a, b = (fold(v), fold(node.value)) if node.op in ("=", "!=") else (v.encode(), node.value.encode())
        else:
            b, a = number_of(node.value), v
            if b is None:
                continue
        if {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[node.op]:
            return True
    return False


@settings(max_examples=12, deadline=None, derandomize=True)
@given(_trees)
def test_random_trees(spark, tree):
    assert syntax.parse(shown(tree)) == tree or isinstance(tree, syntax.And | syntax.Or | syntax.Not)
    cat = edge.catalog(spark)
    got = [r["id"] for r in scope.candidates(cat, [shown(tree)], include_excluded=True).collect()]
    assert sorted(got) == [r[0] for r in edge.SOURCES if r[10] == 1 and r[1] != 3 and truth(tree, r)]
