"""SQL of the ten warehouses: merges with values not sent, the split forms, table changes, defaults.

A statement is put together from what a dialect has: its quotes, how it compares with
nulls, whether it knows MERGE, and how it joins in an UPDATE or DELETE. Staging rows
carry the two delete markers.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..kinds import Kind, type_text
from ..operators.evolve import default_strategy
from ..sources.frames import UNAVAILABLE


@dataclass(frozen=True)
class Dialect:
    name: str
    mark: str = '"'
    false: str = "FALSE"
    merges: bool = True
    text: str = "VARCHAR"
    null_safe: str = "{a} IS NOT DISTINCT FROM {b}"
    end: str = ""  # of a MERGE

    def quote(self, name: str) -> str:
        if self.mark == "[":
            return f"[{name.replace(']', ']]')}]"
        return self.mark + name.replace(self.mark, self.mark * 2) + self.mark


DIALECTS = {
    d.name: d
    for d in (
        Dialect("snowflake", null_safe="EQUAL_NULL({a}, {b})"), Dialect("bigquery", mark="`", text="STRING"), Dialect("databricks", mark="`", text="STRING", null_safe="{a} <=> {b}"),
        Dialect("spark", mark="`", text="STRING", null_safe="{a} <=> {b}"), Dialect("postgres", text="TEXT"), Dialect("duckdb", text="TEXT"),
        Dialect("mssql", mark="[", false="0", text="NVARCHAR(MAX)", null_safe="({a} = {b} OR ({a} IS NULL AND {b} IS NULL))", end=";"),
        Dialect("redshift", merges=False, null_safe="({a} = {b} OR ({a} IS NULL AND {b} IS NULL))"), Dialect("mysql", mark="`", merges=False, text="CHAR", null_safe="{a} <=> {b}"),
        Dialect("clickhouse", mark="`", merges=False, text="String"),
    )
}


@dataclass(frozen=True)
class Batch:
    """A staged batch and where it goes; ``columns`` are names with kinds, without the markers."""

    table: str
    staging: str
    keys: tuple[str, ...]
    columns: dict[str, Kind]
    soft: bool = False
    placeholders: tuple[str, ...] = ()  # columns that hold values not sent
    predicates: tuple[str, ...] = ()  # columns that join besides the keys
    null_safe: bool = False
    hard_deletes: bool = True  # whether the batch has any
    prefix: str = "__cf_"

    @property
    def gone(self) -> str:
        return f"{self.prefix}delete"

    @property
    def only(self) -> str:
        return f"{self.prefix}only_set_delete"

    def stored(self) -> list[str]:
        return [*self.columns, *([self.gone] if self.soft else [])]


def _false(d: Dialect, column: str) -> str:
    return f"COALESCE(stg.{d.quote(column)}, {d.false}) = {d.false}"


def _true(d: Dialect, column: str) -> str:
    return f"COALESCE(stg.{d.quote(column)}, {d.false}) <> {d.false}"


def _on(d: Dialect, b: Batch) -> str:
    pair = lambda c: {"a": f"tgt.{d.quote(c)}", "b": f"stg.{d.quote(c)}"}
    same = d.null_safe if b.null_safe else "{a} = {b}"
    return " AND ".join([same.format(**pair(k)) for k in b.keys] + ["{a} = {b}".format(**pair(c)) for c in b.predicates])


def was_sent(d: Dialect, column: str, kind: Kind) -> str:
    """The test that a staged value isn't the placeholder: alone, or marked in an object or a list; a null was sent."""
    value = f"stg.{d.quote(column)}"
    if kind.name == "string":
        return f"({value} IS NULL OR {value} <> '{UNAVAILABLE}')"
    text = f"TO_JSON_STRING({value})" if d.name == "bigquery" and kind.name in ("struct", "array") else f"JSON_SERIALIZE({value})" if d.name == "redshift" and kind.name == "struct" else f"CAST({value} AS {d.text})"
    return f"({value} IS NULL OR {text} NOT LIKE '%{UNAVAILABLE}%')"


def assignments(d: Dialect, b: Batch, qualified: bool = False) -> str:
    """The SET list: keys and joined columns stay; a column that may lack its value keeps the target's."""
    out = []
    for c in b.stored():
        if c in b.keys or c in b.predicates:
            continue
        new = f"stg.{d.quote(c)}"
        if c in b.placeholders:
            new = f"CASE WHEN {was_sent(d, c, b.columns[c])} THEN {new} ELSE tgt.{d.quote(c)} END"
        out.append(f"{'tgt.' if qualified else ''}{d.quote(c)} = {new}")
    return ", ".join(out)


def merge_statements(dialect: str, b: Batch) -> list[str]:
    """The statements that merge a batch, in the order to run them."""
    d = DIALECTS[dialect]
    if d.name == "clickhouse":
        # The engine collapses rows by key and update time when it reads.
        names = ", ".join(d.quote(c) for c in [*b.columns, b.gone])
        return [f"INSERT INTO {b.table} ({names}) SELECT {names} FROM {b.staging}"]
    return [_merge(d, b)] if d.merges else _split(d, b)


def _insert_lists(d: Dialect, b: Batch) -> tuple[str, str]:
    return ", ".join(map(d.quote, b.stored())), ", ".join(f"stg.{d.quote(c)}" for c in b.stored())


def _merge(d: Dialect, b: Batch) -> str:
    names, values = _insert_lists(d, b)
    sets = assignments(d, b)
    parts = [f"MERGE INTO {b.table} {'AS ' if d.name != 'snowflake' else ''}tgt USING {b.staging} AS stg ON {_on(d, b)}"]
    if b.soft:
        if sets:
            parts.append(f"WHEN MATCHED AND {_false(d, b.only)} THEN UPDATE SET {sets}")
        parts.append(f"WHEN MATCHED AND {_true(d, b.only)} THEN UPDATE SET {d.quote(b.gone)} = stg.{d.quote(b.gone)}")
        parts.append(f"WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})")
    else:
        if b.hard_deletes:
            parts.append(f"WHEN MATCHED AND {_true(d, b.gone)} THEN DELETE")
        if sets:
            parts.append(f"WHEN MATCHED AND {_false(d, b.gone)} THEN UPDATE SET {sets}")
        parts.append(f"WHEN NOT MATCHED AND {_false(d, b.gone)} THEN INSERT ({names}) VALUES ({values})")
    return " ".join(parts) + d.end


def _split(d: Dialect, b: Batch) -> list[str]:
    return update_statements(d.name, b) + [insert_statement(d.name, b)] + ([delete_statement(d.name, b)] if b.hard_deletes and not b.soft else [])


def update_statements(dialect: str, b: Batch) -> list[str]:
    """UPDATE of the rows that the target has: all values, or, of keys that saw nothing but deletes, the marker."""
    d = DIALECTS[dialect]

    def update(sets: str, where: str, qualified_sets: str) -> str:
        if d.name == "mysql":
            return f"UPDATE {b.table} AS tgt INNER JOIN {b.staging} AS stg ON {_on(d, b)} SET {qualified_sets} WHERE {where}"
        if d.name == "mssql":
            return f"UPDATE tgt SET {sets} FROM {b.table} AS tgt INNER JOIN {b.staging} AS stg ON {_on(d, b)} WHERE {where};"
        return f"UPDATE {b.table} AS tgt SET {sets} FROM {b.staging} AS stg WHERE {_on(d, b)} AND {where}"

    sets = assignments(d, b)
    out = [update(sets, _false(d, b.only if b.soft else b.gone), assignments(d, b, True))] if sets else []
    if b.soft:
        mark = f"{d.quote(b.gone)} = stg.{d.quote(b.gone)}"
        out.append(update(mark, _true(d, b.only), f"tgt.{mark}"))
    return out


def insert_statement(dialect: str, b: Batch) -> str:
    """INSERT of the rows that the target lacks; deleted ones only if deletes are soft."""
    d = DIALECTS[dialect]
    names, values = _insert_lists(d, b)
    lives = "" if b.soft else f" AND {_false(d, b.gone)}"
    return f"INSERT INTO {b.table} ({names}) SELECT {values} FROM {b.staging} AS stg LEFT JOIN {b.table} AS tgt ON {_on(d, b)} WHERE tgt.{d.quote(b.keys[0])} IS NULL{lives}{d.end}"


def delete_statement(dialect: str, b: Batch) -> str:
    """DELETE of the rows whose keys the batch deletes."""
    d = DIALECTS[dialect]
    if d.name == "mysql":
        return f"DELETE tgt FROM {b.table} AS tgt INNER JOIN {b.staging} AS stg ON {_on(d, b)} WHERE {_true(d, b.gone)}"
    if d.name == "mssql":
        return f"DELETE tgt FROM {b.table} AS tgt INNER JOIN {b.staging} AS stg ON {_on(d, b)} WHERE {_true(d, b.gone)};"
    if d.name in ("postgres", "redshift", "duckdb"):
        target = b.table if d.name == "redshift" else f"{b.table} AS tgt"
        on = _on(d, b).replace("tgt.", f"{b.table}.") if d.name == "redshift" else _on(d, b)
        return f"DELETE FROM {target} USING {b.staging} AS stg WHERE {on} AND {_true(d, b.gone)}"
    return f"DELETE FROM {b.table} AS tgt WHERE EXISTS (SELECT 1 FROM {b.staging} AS stg WHERE {_on(d, b)} AND {_true(d, b.gone)})"


def upsert_statement(b: Batch) -> str:
    """MySQL's upsert by a unique key; its deletes are a statement of their own."""
    d = DIALECTS["mysql"]
    names, values = _insert_lists(d, b)
    sets = assignments(d, b).replace("tgt.", f"{b.table}.")
    where = "" if b.soft else f" WHERE {_false(d, b.gone)}"
    return f"INSERT INTO {b.table} ({names}) SELECT {values} FROM {b.staging} AS stg{where} ON DUPLICATE KEY UPDATE {sets}"


# ---------------------------------------------------------------- tables


def create_statement(dialect: str, table: str, columns: dict[str, Kind], keys: tuple[str, ...] = (), temporary: bool = False) -> str:
    """CREATE TABLE; columns of unknown kind are left out; keys become the primary key where the dialect enforces one."""
    d = DIALECTS[dialect]
    key = lambda c: c in keys
    parts = [f"{d.quote(c)} {type_text(k, dialect, key(c))}" for c, k in columns.items() if k.name != "invalid"]
    enforced = dialect in ("postgres", "mysql", "mssql", "duckdb")
    if keys and enforced and not temporary:
        parts.append(f"PRIMARY KEY ({', '.join(map(d.quote, keys))})")
    tail = f" ENGINE = ReplacingMergeTree ORDER BY ({', '.join(map(d.quote, keys))})" if dialect == "clickhouse" and keys else " ENGINE = MergeTree ORDER BY tuple()" if dialect == "clickhouse" else " USING iceberg" if dialect == "spark" else ""
    guard = "" if dialect == "mssql" else "IF NOT EXISTS "
    return f"CREATE TABLE {guard}{table} ({', '.join(parts)}){tail}"


def add_column_statements(dialect: str, table: str, columns: dict[str, Kind]) -> list[str]:
    """One ALTER TABLE a column."""
    d = DIALECTS[dialect]
    word = "ADD" if dialect == "mssql" else "ADD COLUMN"
    return [f"ALTER TABLE {table} {word} {d.quote(c)} {type_text(k, dialect)}" for c, k in columns.items() if k.name != "invalid"]


def drop_column_statement(dialect: str, table: str, column: str) -> str:
    return f"ALTER TABLE {table} DROP COLUMN {DIALECTS[dialect].quote(column)}"


def widen_statement(dialect: str, table: str, column: str, length: int) -> str:
    """A limited text column made longer."""
    d = DIALECTS[dialect]
    if dialect == "mysql":
        return f"ALTER TABLE {table} MODIFY COLUMN {d.quote(column)} VARCHAR({length})"
    return f"ALTER TABLE {table} ALTER COLUMN {d.quote(column)} {'' if dialect == 'mssql' else 'TYPE '}VARCHAR({length})"


def literal(value: object, kind: Kind, dialect: str) -> str:
    """A default as SQL text of its kind."""
    if value is None:
        return "NULL"
    d = DIALECTS[dialect]
    if kind.name == "bool":
        return ("1" if value else "0") if d.false == "0" else ("TRUE" if value else "FALSE")
    if kind.name in ("int", "float", "decimal") and not isinstance(value, str):
        return str(value)
    text = str(value).replace("'", "''")
    if kind.name == "struct":
        return {"bigquery": f"JSON '{text}'", "snowflake": f"PARSE_JSON('{text}')", "redshift": f"JSON_PARSE('{text}')"}.get(dialect, f"'{text}'")
    return f"'{text}'"


def backfill_statement(dialect: str, table: str, column: str, value: object, kind: Kind) -> str | None:
    """The UPDATE that fills a new column's default in; None where the dialect does it itself or not at all."""
    if default_strategy(dialect) != "backfill" or value is None:
        return None
    c = DIALECTS[dialect].quote(column)
    return f"UPDATE {table} SET {c} = {literal(value, kind, dialect)} WHERE {c} IS NULL"


def staging_upsert_statement(dialect: str, b: Batch) -> str:
    """A batch merged into a multi-step staging table: matched rows are replaced, markers included, others added."""
    d = DIALECTS[dialect]
    every = [*b.columns, b.gone, b.only]
    sets = ", ".join(f"{d.quote(c)} = " + (f"CASE WHEN {was_sent(d, c, b.columns[c])} THEN stg.{d.quote(c)} ELSE tgt.{d.quote(c)} END" if c in b.placeholders else f"stg.{d.quote(c)}") for c in every if c not in b.keys)
    names, values = ", ".join(map(d.quote, every)), ", ".join(f"stg.{d.quote(c)}" for c in every)
    return f"MERGE INTO {b.table} AS tgt USING {b.staging} AS stg ON {_on(d, b)} WHEN MATCHED THEN UPDATE SET {sets} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values}){d.end}"


def dedupe_statements(table: str, staging: str, keys: list[str], updated: list[str], dialect: str = "duckdb") -> list[str]:
    """Dedupe by the second row: the second oldest of each repeated key is set aside, the key's rows are deleted, it is put back."""
    d = DIALECTS[dialect]
    by = ", ".join(map(d.quote, keys))
    order = ", ".join(f"{d.quote(c)} ASC" for c in [*keys, *updated])
    match = " AND ".join(f"tgt.{d.quote(k)} = stg.{d.quote(k)}" for k in keys)
    return [
        f"CREATE TABLE {staging} AS SELECT * FROM {table} QUALIFY ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY {order}) = 2",
        f"DELETE FROM {table} AS tgt USING {staging} AS stg WHERE {match}",
        f"INSERT INTO {table} SELECT * FROM {staging}",
    ]
