"""Every rule of the definition file."""

import copy

import pytest

from tidefold.errors import ConfigError
from tidefold.plans.spec import DSN_VARIABLE, AggSpec, load_config, parse_config

GOOD = {
    "database": {"dsn": "postgresql://h/db"},
    "views": [{"name": "v", "source": "sales.orders", "group_by": ["status"], "aggregates": [{"fn": "count", "as": "n"}, {"fn": "count", "column": "coupon", "as": "n_coupon"}, {"fn": "sum", "column": "total", "as": "revenue"}, {"fn": "avg", "column": "total", "as": "mean"}]}],
}


def changed(path, value):
    out = copy.deepcopy(GOOD)
    at = out
    for k in path[:-1]:
        at = at[k]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


V, A = ("views", 0), ("views", 0, "aggregates", 0)


def test_good_definition():
    c = parse_config(GOOD, {})
    v = c.views[0]
    assert (c.dsn, c.slot, c.publication, c.max_ms, c.max_txns, c.sources) == ("postgresql://h/db", "tidefold", "tidefold", 200, 500, ("sales.orders",))
    assert v.source == "sales.orders" and v.needed == ("status", "coupon", "total") and v.aggregates[0] == AggSpec("count", None, "n")
    assert parse_config(changed((*V, "source"), "orders"), {}).views[0].source == "public.orders"
    assert parse_config(changed((*V, "group_by"), KeyError), {}).views[0].group_by == ()


def test_address_of_the_environment_goes_first():
    assert parse_config(GOOD, {DSN_VARIABLE: "x"}).dsn == "x"
    assert parse_config(changed(("database",), KeyError), {DSN_VARIABLE: "x"}).dsn == "x"
    assert parse_config(GOOD, {DSN_VARIABLE: ""}).dsn == "postgresql://h/db"


@pytest.mark.parametrize(
    "path,value",
    [
        (("database",), KeyError),
        (("database",), 3),
        (("database", "dsn"), ""),
        (("database", "dsn"), 3),
        (("slot",), "Bad"),
        (("slot",), "a\n"),
        (("publication",), "x-y"),
        (("batch",), []),
        (("batch",), {"max_ms": 0}),
        (("batch",), {"max_ms": True}),
        (("batch",), {"max_txns": "5"}),
        (("views",), []),
        (("views",), {}),
        (("views",), ["x"]),
        (("views",), GOOD["views"] * 2),
        ((*V, "name"), KeyError),
        ((*V, "name"), "1a"),
        ((*V, "name"), "checkpoint"),
        ((*V, "name"), "a" * 64),
        ((*V, "source"), KeyError),
        ((*V, "source"), "a.b.c"),
        ((*V, "source"), "a."),
        ((*V, "group_by"), "status"),
        ((*V, "group_by"), ["a", "a"]),
        ((*V, "group_by"), ["A"]),
        ((*V, "group_by"), ["_rows"]),
        ((*V, "group_by"), ["revenue__sum"]),
        ((*V, "aggregates"), KeyError),
        ((*V, "aggregates"), []),
        ((*V, "aggregates"), {}),
        (A, "count"),
        ((*A, "fn"), KeyError),
        ((*A, "fn"), "min"),
        ((*A, "as"), KeyError),
        ((*A, "as"), "N"),
        ((*A, "as"), "a" * 64),
        ((*A, "as"), "revenue"),
        ((*A, "as"), "status"),
        ((*A, "as"), "_rows"),
        ((*A, "as"), "x__nn"),
        ((*A, "column"), "B ad"),
        ((*A, "fn"), "sum"),
        (("views", 0, "aggregates", 2, "as"), "a" * 59),
    ],
)
def test_bad_definitions(path, value):
    with pytest.raises(ConfigError):
        parse_config(changed(path, value), {})


@pytest.mark.parametrize("text", ["- a\n", "a: [", "", None])
def test_bad_files(tmp_path, text):
    path = tmp_path / "c.yaml"
    if text is not None:
        path.write_text(text)
    with pytest.raises(ConfigError):
        load_config(str(path), {})


def test_longest_name_of_a_sum():
    assert parse_config(changed(("views", 0, "aggregates", 2, "as"), "a" * 58), {}).views[0].aggregates[2].alias == "a" * 58
