"""Definitions of views, and their YAML file with all its checks."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

import yaml

from tidefold.errors import ConfigError

ROWS, SUM, NN = "_rows", "__sum", "__nn"
FUNCTIONS = ("count", "sum", "avg")
#: Names that the engine's own columns and folders have.
RESERVED = frozenset({ROWS, "_bucket", "_all", "_sign"})
DSN_VARIABLE = "TIDEFOLD_DSN"
_NAME = re.compile(r"[a-z_][a-z0-9_]*")
_MOST_BYTES = 63


@dataclass(frozen=True)
class AggSpec:
    """One aggregate: ``fn`` over ``column`` (None: all rows), shown as ``alias``."""

    fn: str
    column: str | None
    alias: str


@dataclass(frozen=True)
class ViewSpec:
    """A view: aggregates of one source table by its key columns; without keys it has exactly one row."""

    name: str
    schema: str
    table: str
    group_by: tuple[str, ...]
    aggregates: tuple[AggSpec, ...]

    @property
    def source(self) -> str:
        return f"{self.schema}.{self.table}"

    @property
    def needed(self) -> tuple[str, ...]:
        """The columns that the view reads, each once, keys first."""
        return tuple(dict.fromkeys([*self.group_by, *(a.column for a in self.aggregates if a.column)]))


@dataclass(frozen=True)
class Config:
    dsn: str
    views: tuple[ViewSpec, ...]
    slot: str = "tidefold"
    publication: str = "tidefold"
    max_ms: int = 200
    max_txns: int = 500
    sources: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "sources", tuple(dict.fromkeys(v.source for v in self.views)))


def is_name(x: object) -> bool:
    """Whether x is an identifier that needs no quotes: lower-case letters, digits and underscores, at most 63 bytes."""
    return isinstance(x, str) and _NAME.fullmatch(x) is not None and len(x) <= _MOST_BYTES


def _name(x: object, what: str) -> str:
    if not is_name(x):
        raise ConfigError(f"{what} must be a lower-case identifier of at most {_MOST_BYTES} bytes, not {x!r}")
    return str(x)


def _mapping(x: object, what: str) -> Mapping:
    if not isinstance(x, Mapping):
        raise ConfigError(f"{what} must be a mapping")
    return x


def _section(top: Mapping, name: str) -> Mapping:
    """A section of the file; empty where it is missing or has nothing."""
    return {} if top.get(name) is None else _mapping(top[name], name)


def _positive(x: object, what: str) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x <= 0:
        raise ConfigError(f"{what} must be a positive integer, not {x!r}")
    return x


def _aggregate(raw: object, at: str, group_by: tuple[str, ...]) -> AggSpec:
    item = _mapping(raw, f"{at}: an aggregate")
    fn, column = item.get("fn"), item.get("column")
    if fn not in FUNCTIONS:
        raise ConfigError(f"{at}: fn must be one of {', '.join(FUNCTIONS)}, not {fn!r}")
    if "as" not in item:
        raise ConfigError(f"{at}: {fn} needs 'as'")
    alias = _name(item["as"], f"{at}: 'as'")
    if column is not None:
        _name(column, f"{at}: column of {alias}")
    elif fn != "count":
        raise ConfigError(f"{at}: {fn} needs a column")
    if alias in group_by or alias in RESERVED or alias.endswith((SUM, NN)):
        raise ConfigError(f"{at}: the name {alias} is that of a key or reserved")
    if fn != "count" and len(alias) + len(SUM) > _MOST_BYTES:
        raise ConfigError(f"{at}: the name {alias} is too long for a {fn}")
    return AggSpec(fn, column, alias)


def parse_view(raw: object) -> ViewSpec:
    item = _mapping(raw, "a view")
    name = _name(item.get("name"), "the name of a view")
    if name in ("checkpoint", "manifests"):
        raise ConfigError(f"view {name}: the name is reserved")
    at, source = f"view {name}", item.get("source")
    parts = source.split(".") if isinstance(source, str) else []
    if len(parts) not in (1, 2):
        raise ConfigError(f"{at}: source must be 'table' or 'schema.table', not {source!r}")
    schema, table = (_name(x, f"{at}: each part of source") for x in (["public", *parts] if len(parts) == 1 else parts))
    keys = item.get("group_by")
    if not isinstance(keys, list | None):
        raise ConfigError(f"{at}: group_by must be a list")
    group_by = tuple(_name(k, f"{at}: a key") for k in keys or ())
    if len(set(group_by)) < len(group_by):
        raise ConfigError(f"{at}: a key repeats")
    for k in group_by:
        if k in RESERVED or k.endswith((SUM, NN)):
            raise ConfigError(f"{at}: the key {k} has a reserved name")
    aggregates = item.get("aggregates")
    if not isinstance(aggregates, list) or not aggregates:
        raise ConfigError(f"{at}: aggregates must be a list of one or more")
    found = tuple(_aggregate(a, at, group_by) for a in aggregates)
    aliases = [a.alias for a in found]
    if len(set(aliases)) < len(aliases):
        raise ConfigError(f"{at}: two aggregates have one name")
    return ViewSpec(name, schema, table, group_by, found)


def parse_config(raw: object, env: Mapping[str, str] | None = None) -> Config:
    """A checked definition from the parsed YAML.  The environment's address goes before the file's."""
    top = _mapping(raw, "the definition file")
    database = _section(top, "database")
    dsn = (os.environ if env is None else env).get(DSN_VARIABLE) or database.get("dsn")
    if not dsn:
        raise ConfigError(f"database.dsn is missing, and {DSN_VARIABLE} is not set")
    if not isinstance(dsn, str):
        raise ConfigError("database.dsn must be text")
    batch = _section(top, "batch")
    views = top.get("views")
    if not isinstance(views, list) or not views:
        raise ConfigError("views must be a list of one or more")
    found = tuple(parse_view(v) for v in views)
    names = [v.name for v in found]
    if len(set(names)) < len(names):
        raise ConfigError("two views have one name")
    return Config(dsn, found, _name(top.get("slot", "tidefold"), "slot"), _name(top.get("publication", "tidefold"), "publication"), _positive(batch.get("max_ms", 200), "batch.max_ms"), _positive(batch.get("max_txns", 500), "batch.max_txns"))


def load_config(path: str, env: Mapping[str, str] | None = None) -> Config:
    try:
        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f)
    except OSError as e:
        raise ConfigError(f"can't read {path}: {e.strerror}") from e
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path} is not valid YAML: {e}") from e
    return parse_config(raw, env)
