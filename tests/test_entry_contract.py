"""Driver contract: names, callables and oracle coverage."""

import inspect

import __spark_entry__ as E
from recsmith.plans import registry


def test_contract_shapes():
    registry.load_all()
    q, s = {k: v for k, v in E.queries().items() if k in registry.QUERIES}, registry.ORACLE
    assert set(q) == set(registry.QUERIES) and set(s) <= set(E.oracle_sql())
    assert set(s) <= set(q)
    assert len(q) >= 100
    for name, fn in q.items():
        assert callable(fn) and list(inspect.signature(fn).parameters) == ["spark", "sf_dir"], name
        assert fn.__doc__, name
        assert not name.startswith("op") and "pipeline" not in name
    for name, sql in s.items():
        assert sql.strip(), name
