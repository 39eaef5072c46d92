"""Assembles oracle SQL: named views over the base tables, pulled in by use."""
from __future__ import annotations

import re

from silvergrain.sources import derive


def _table_sql(spec: derive.Derived) -> str:
    columns = ", ".join(f"{sql} AS {col}" for col, sql in spec.columns)
    source = f"(SELECT event_id AS n, * FROM {spec.base})"
    if spec.per_face:
        source = f"(SELECT *, unnest(range(n % 5)) AS face_index FROM {source})"
    where = f" WHERE {spec.where}" if spec.where else ""
    return f"SELECT {columns} FROM {source} AS src{where}"


def _fixture_views() -> dict[str, str]:
    tables = derive.derived_tables(derive.DuckDialect)
    views = {name: _table_sql(spec) for name, spec in tables.items()}
    media = dict(tables["media"].columns)
    geo = tables["photo_geo"]
    places = ", ".join(f"{sql} AS {col}" for col, sql in derive.geocoded_columns(derive.DuckDialect))
    views["geo_cache"] = (
        f"SELECT coord_key, lat_rounded, lon_rounded, {places} FROM (SELECT {dict(geo.columns)['coord_key']} AS coord_key,"
        f" min((n // 8) % 60) AS p, min(CASE WHEN n % 13 = 0 THEN 1 ELSE 0 END) AS o,"
        f" min(round({media['latitude']}, 3)) AS lat_rounded, min(round({media['longitude']}, 3)) AS lon_rounded"
        f" FROM (SELECT event_id AS n, * FROM events) AS src WHERE {geo.where} GROUP BY 1)")
    return views


VIEWS: dict[str, str] = _fixture_views()


def view(name: str, sql: str) -> None:
    """Name a piece of oracle SQL so that later oracles can select from it."""
    if name in VIEWS:
        raise ValueError(f"oracle view {name} is already named")
    VIEWS[name] = sql.strip()


def _used(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]


def assemble(sql: str) -> str:
    """Prefix ``sql`` with every view it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _used(VIEWS[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for name in _used(sql):
        visit(name)
    body = sql.strip()
    extra = ""
    if re.match(r"WITH\b", body, re.I):
        extra = ", " + re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I)
        if not order:
            return body
    heads = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order)
    if not order:
        return body
    return f"WITH RECURSIVE {heads}\n{extra or body}"
