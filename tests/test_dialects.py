"""The dialects' SQL: that of DuckDB is run against a model of the merge, the others' parts are compared with it."""

import random

import duckdb
import pytest
from changeflow import config
from changeflow.kinds import Kind
from changeflow.sinks import dialects as D
from changeflow.sources.frames import UNAVAILABLE as PH

COLUMNS = {"k": Kind("int"), "v": Kind("string"), "j": Kind("struct")}


def batch(**more):
    return D.Batch(**{"table": "tgt_t", "staging": "stg_t", "keys": ("k",), "columns": COLUMNS, "placeholders": ("v", "j"), **more})


def model(target, staged, soft):
    out = dict(target)
    for k, (v, j, gone, only) in staged.items():
        old = out.get(k)
        value = (old[0] if old and v == PH else v, old[1] if old and j is not None and PH in j else j)
        if soft:
            if old and only:
                out[k] = (*old[:2], bool(gone))
            else:
                out[k] = (*value, bool(gone) if gone is not None else None)
        elif gone:
            out.pop(k, None)
        else:
            out[k] = (*value, None)
    return out


def cases(seed):
    r = random.Random(seed)
    text = lambda: r.choice(["a", "b'c", None, PH])
    obj = lambda: r.choice(['{"x":1}', None, '{"key":"' + PH + '"}'])
    target = {k: (r.choice(["t", None]), '{"t":1}', False) for k in range(20) if r.random() < 0.6}
    staged = {k: (text(), obj(), g := r.choice([True, False, False, None]), bool(g) and r.random() < 0.5) for k in range(20) if r.random() < 0.6}
    return target, staged


@pytest.mark.parametrize("soft", [False, True])
@pytest.mark.parametrize("form", ["merge", "split"])
def test_duckdb_runs_the_merge(soft, form):
    for seed in range(25):
        target, staged = cases(seed)
        c = duckdb.connect()
        b = batch(soft=soft)
        for s in (D.create_statement("duckdb", "tgt_t", {**COLUMNS, **({"__cf_delete": Kind("bool")} if soft else {})}, ("k",)), D.create_statement("duckdb", "stg_t", {**COLUMNS, "__cf_delete": Kind("bool"), "__cf_only_set_delete": Kind("bool")})):
            c.execute(s)
        for k, (v, j, gone) in target.items():
            c.execute(f"INSERT INTO tgt_t VALUES (?, ?, ?{', ?' if soft else ''})", [k, v, j, *([gone] if soft else [])])
        for k, row in staged.items():
            c.execute("INSERT INTO stg_t VALUES (?, ?, ?, ?, ?)", [k, *row])
        want = model({k: (v, j, gone if soft else None) for k, (v, j, gone) in target.items()}, staged, soft)
        statements = D.merge_statements("duckdb", b) if form == "merge" else [*D.update_statements("duckdb", b), D.insert_statement("duckdb", b), *([] if soft else [D.delete_statement("duckdb", b)])]
        for _ in range(2):  # a batch that comes again changes nothing
            for s in statements:
                c.execute(s)
            got = {r[0]: (r[1], r[2], r[3] if soft else None) for r in c.execute("SELECT * FROM tgt_t").fetchall()}
            assert got == want, seed


def test_duckdb_runs_table_changes_and_staging_upserts():
    c = duckdb.connect()
    c.execute(D.create_statement("duckdb", "t", {"k": Kind("int"), "odd": Kind("invalid")}, ("k",)))
    for s in D.add_column_statements("duckdb", "t", {"a b": Kind("string"), "d": Kind("decimal", 10, 2), "no": Kind("invalid")}):
        c.execute(s)
    c.execute(D.drop_column_statement("duckdb", "t", "d"))
    c.execute("INSERT INTO t VALUES (1, NULL)")
    assert [r[0] for r in c.execute("DESCRIBE t").fetchall()] == ["k", "a b"] and D.backfill_statement("duckdb", "t", "a b", "x", Kind("string")) is None
    c.execute("CREATE TABLE r AS SELECT * FROM (VALUES (1, 1, 'a'), (1, 2, 'b'), (1, 3, 'c'), (2, 1, 'd')) x(k, seen, v)")
    for s in D.dedupe_statements("r", "r_stg", ["k"], ["seen"]):
        c.execute(s)
    assert sorted(c.execute("SELECT k, v FROM r").fetchall()) == [(1, "b"), (2, "d")]
    b = D.Batch("p", "s", ("k",), {"k": Kind("int"), "v": Kind("string")}, placeholders=("v",))
    for t, rows in (("p", "(1, 'a', false, false), (2, 'b', false, false)"), ("s", f"(2, '{PH}', true, true), (3, 'c', false, false)")):
        c.execute(f"CREATE TABLE {t} AS SELECT * FROM (VALUES {rows}) x(k, v, __cf_delete, __cf_only_set_delete)")
    c.execute(D.staging_upsert_statement("duckdb", b))
    assert sorted(c.execute("SELECT * FROM p").fetchall()) == [(1, "a", False, False), (2, "b", True, True), (3, "c", False, False)]


@pytest.mark.parametrize("dialect", sorted(D.DIALECTS))
def test_every_dialect_keeps_values_not_sent(dialect):
    for soft in (False, True):
        statements = D.merge_statements(dialect, batch(soft=soft, null_safe=True, predicates=("j",)))
        joined = " ".join(statements)
        if dialect == "clickhouse":
            assert len(statements) == 1 and statements[0].startswith("INSERT INTO tgt_t")
            continue
        sets = next(s for s in statements if "SET" in s)
        assert PH in sets and "ELSE tgt." in sets
        q = D.DIALECTS[dialect].quote
        assert f"SET {q('k')}" not in joined and f"{q('j')} = stg.{q('j')}" in joined.replace("tgt.", ""), "predicates join"
        assert ("DELETE" in joined) != soft
    assert D.create_statement(dialect, "t", COLUMNS, ("k",)).startswith("CREATE TABLE")
    assert D.literal("a'b", Kind("string"), dialect) == "'a''b'" and D.literal(None, Kind("int"), dialect) == "NULL"
    assert D.DIALECTS[dialect].quote("a") in D.widen_statement(dialect, "t", "a", 99)


def test_an_upsert_by_a_unique_key():
    s = D.upsert_statement(batch())
    assert "ON DUPLICATE KEY UPDATE `v` = CASE WHEN" in s and "ELSE tgt_t.`v` END" in s and "WHERE COALESCE(stg.`__cf_delete`, FALSE) = FALSE" in s
    assert "WHERE" not in D.upsert_statement(batch(soft=True, placeholders=()))


def test_a_batch_of_nothing_but_keys():
    b = D.Batch("t", "s", ("k",), {"k": Kind("int")}, hard_deletes=False)
    assert "UPDATE" not in D.merge_statements("postgres", b)[0] and "DELETE" not in D.merge_statements("postgres", b)[0]
    assert [s.split()[0] for s in D.merge_statements("redshift", b)] == ["INSERT"]


def test_settings_from_text():
    e = config.from_text('{"flush_seconds": 20, "topics": [{"topic": "t", "schema": "s", "include": ["a"], "static": {"x": "1"}, "soft_partitions": {"column": "c", "frequency": "daily", "max_partitions": 3}}]}')
    assert e.flush_seconds == 20 and e.topics[0].include == ("a",) and e.topics[0].static == (("x", "1"),) and e.topics[0].soft_partitions.max_partitions == 3
    pytest.importorskip("yaml")
    assert config.from_text("topics:\n  - topic: t\n    schema: s\n    soft_delete: true\n").topics[0].soft_delete is True
    for bad in ("7", '{"topics": []}', '{"nonsense": 1, "topics": [{"topic": "t", "schema": "s"}]}'):
        with pytest.raises(ValueError):
            config.from_text(bad)
