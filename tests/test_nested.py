import json

from changeflow.operators import nested


def doc(after, **payload):
    return json.dumps({"payload": {"after": after, **payload}})


def shred(spark, values, **kw):
    df = spark.createDataFrame(list(enumerate(values)), "rec_id bigint, msg_value string").selectExpr("*", "'clash' as child_path", "'clash' as value")
    return nested.shred(df, "rec_id", "msg_value", **kw)


def links(df):
    return sorted((r.rec_id, r.parent_path, r.child_path) for r in df.collect())


A = "payload.after."
CASES = [
    doc({"orders": [None, {"lines": [{"a": 1}, None, {"b": [{"c": 1}]}]}]}),
    doc(json.dumps({"orders": [{"lines": {"x": {"y": [{"z": 1}]}}}]})),
    doc({"email": "plain", "grid": [[{"v": 1}, 2], [[{"w": 1}]]], "ext": [{"$numberLong": "1"}], "empty": [], "nulls": [None]}),
    doc({"email": {"address": "x"}, "lone": {"deep": [{"q": 1}]}}),
    doc({"email": [{"address": "y"}], "meta.v2": {"flags": [{"k": 1}]}}),
    None, "", "{", "[{\"top\": 1}]", "7", doc("not json"), doc(None), doc([{"listed": 1}]),
]
EXPECT = sorted([
    (0, "$", A + "orders[1]"), (0, A + "orders[1]", A + "orders[1].lines[0]"), (0, A + "orders[1]", A + "orders[1].lines[2]"), (0, A + "orders[1].lines[2]", A + "orders[1].lines[2].b[0]"),
    (1, "$", A + "orders[0]"), (1, A + "orders[0]", A + "orders[0].lines[0]"), (1, A + "orders[0].lines[0]", A + "orders[0].lines[0].x.y[0]"),
    (2, "$", A + "grid[0][0]"), (2, "$", A + "grid[1][0][0]"), (3, "$", A + "email[0]"), (3, "$", A + "lone.deep[0]"), (4, "$", A + "email[0]"), (4, "$", A + "meta.v2.flags[0]"), (8, "$", "[0]"),
])


def test_links_of_all_cases(spark):
    # The last record makes payload.after a member that holds lists of objects.
    values = CASES[:-1]
    assert links(shred(spark, values)) == EXPECT


def test_the_joined_way_gives_the_same(spark):
    assert links(shred(spark, CASES[:-1], broadcast_limit=0)) == EXPECT
    assert links(shred(spark, CASES, broadcast_limit=0)) == links(shred(spark, CASES))


def test_a_member_that_holds_lists_elsewhere_counts_as_a_list_all_the_way_down(spark):
    got = links(shred(spark, CASES))
    assert (12, "$", "payload.after[0]") in got
    assert (0, "payload.after[0]", "payload.after[0].orders[1]") in got
    assert (0, "$", "payload.after[0]") in got


def test_variants_and_typed_subtypes(spark):
    values = [doc({"orders": [{"no": 1, "qty": {"$numberLong": "5"}}, {"no": 2.5, "ok": True}, {"no": "x", "when": {"$date": 1}, "child_path": "c"}]}), doc({"orders": [{"qty": {"$numberLong": "7"}, "no": 3}]})]
    objects = shred(spark, values)
    v = nested.variants(objects).collect()
    assert sorted(r.objects for r in v) == [1, 1, 2] and {r.member_path for r in v} == {A + "orders"}
    fields = nested.fields_of([r.signature for r in v])
    assert fields == {"child_path": "string", "no": "string", "ok": "boolean", "qty": "bigint", "when": "string"}
    t = nested.subtype_table(objects, A + "orders", {**fields, "no": "bigint"}).collect()
    rows = {r.child_path: r for r in t if r.rec_id == 0}
    assert rows[A + "orders[0]"].qty == 5 and rows[A + "orders[0]"].no == 1 and rows[A + "orders[0]"].misfit is None
    assert json.loads(rows[A + "orders[1]"].misfit) == {"no": "2.5"} and rows[A + "orders[1]"].ok is True
    assert rows[A + "orders[2]"].f_child_path == "c" and rows[A + "orders[2]"].variant != rows[A + "orders[1]"].variant


def test_equal_shapes_have_equal_states():
    run = lambda x: nested.states(x)[id(x)][0]
    a, b, c = {"x": [nested.Int("1"), None], "y": {"z": "t"}}, {"y": {"z": "u"}, "x": [None, nested.Int("7"), None]}, {"x": ["1"], "y": {"z": "t"}}
    assert run(a) == run(b) != run(c)


def test_empty_table_repeats_and_depth(spark):
    assert shred(spark, []).count() == 0
    one = doc({"a": [{"b": 1}]})
    df = spark.createDataFrame([(1, one), (1, one), (None, one)], "rec_id bigint, msg_value string")
    assert sorted(r.child_path for r in nested.shred(df, "rec_id", "msg_value").collect()) == [A + "a[0]"] * 3
    deep = '{"a":' * 300 + "[{}]" + "}" * 300
    assert [r[2].count(".") for r in links(shred(spark, [deep]))] == [299]
    assert links(shred(spark, ["[" * 100_000])) == []
    deeper = '{"a":[' * 20_000 + '{"v": 1}' + "]}" * 20_000
    assert len(links(shred(spark, ["[" * 5_000 + "{}" + "]" * 5_000]))) == 1
    assert nested.states(nested.load(deeper, ())) and nested.load(deeper[:-1], ()) is None
    long = json.dumps({"a": [{"i": i} for i in range(30_000)]})
    assert shred(spark, [long]).count() == 30_000


def test_the_record_lone_objects_and_lists_of_scalars_are_kept(spark):
    values = [doc({"email": "a@b", "tags": ["x", None, 1.50, [True]], "contacts": [{"address": {"city": "Ky"}}, 7], "none": []}, source={"db": "d", "ts_ms": 12}, op="u"), '[{"top": 1}]', '{"": {"in": {"v": 1}}}', "7"]
    for limit in (20_000, 0):
        rows = {(r.rec_id, r.child_path): r for r in shred(spark, values, every=True, broadcast_limit=limit).collect()}
        assert sorted((i, c, r.parent_path) for (i, c), r in rows.items() if i == 0) == [
            (0, "$", None), (0, "payload", "$"), (0, "payload.after", "payload"), (0, A + "contacts[0]", "payload.after"), (0, A + "contacts[0].address", A + "contacts[0]"), (0, "payload.source", "payload")
        ]
        assert rows[0, "payload"].members == {"op": "u"} and rows[0, "payload.source"].members == {"db": "d", "ts_ms": "12"}
        assert rows[0, "payload.after"].members == {"email": "a@b"} and rows[0, A + "contacts[0].address"].members == {"city": "Ky"}
        assert rows[0, "payload.after"].lists == {"tags": '["x", null, 1.5, [true]]', "contacts": "[{}, 7]", "none": "[]"}
        assert rows[1, "[0]"].parent_path == "$" and rows[1, "$"].parent_path is None and rows[1, "[0]"].members == {"top": "1"}
        assert rows[2, ""].parent_path == "$" and rows[2, ".in"].parent_path == ""
        assert all(r.variant and r.signature for r in rows.values()) and not any(i == 3 for i, _ in rows)


def test_every_object_gets_to_the_typed_table_of_its_member(spark, tmp_path):
    values = [doc({"orders": [{"no": 1, "a b": "x", "Rec_id": "r"}, {"no": 2.5, "rec_id": True}, {}], "tags": [1]}, op="u"), doc({"orders": [{"no": 12345678901234567890}], "id": 7}), '[{"top": {"$numberLong": "5"}}]']
    objects = shred(spark, values, every=True)
    listed = {r.member_path: r for r in nested.route(objects, str(tmp_path / "typed")).collect()}
    assert {m: r.objects for m, r in listed.items()} == {"$": 3, "payload": 2, "payload.after": 2, A + "orders": 4, "": 1}
    read = lambda m: {(r.rec_id, r.child_path): r for r in spark.read.parquet(listed[m].location).collect()}
    lines, after = read(A + "orders"), read("payload.after")
    assert json.loads(listed[A + "orders"].fields) == {"Rec_id": "string", "a b": "string", "no": "double", "rec_id": "boolean"} and listed[A + "orders"].variants == 4
    first = lines[0, A + "orders[0]"]
    assert first.no == 1.0 and first["a b"] == "x" and first.f_Rec_id == "r" and first.f_f_rec_id is None and first.parent_path == "payload.after"
    assert lines[0, A + "orders[1]"].f_f_rec_id is True and lines[0, A + "orders[2]"].variant
    assert after[1, "payload.after"].id == 7 and after[0, "payload.after"].lists == '{"tags":"[1]"}'
    assert read("payload")[0, "payload"].op == "u" and read("")[2, "[0]"].top == 5
    assert nested.route(objects.limit(0), str(tmp_path / "none")).count() == 0


def test_what_does_not_fit_stays_beside_the_typed_row(spark, tmp_path):
    big = "123456789012345678901234567890"
    objects = shred(spark, [f'{{"a": [{{"n": 1}}, {{"n": {big}}}]}}'], every=True)
    row = next(r for r in nested.route(objects, str(tmp_path / "typed")).collect() if r.member_path == "a")
    assert row.misfits == 1
    assert {r.child_path: (r.n, r.misfit) for r in spark.read.parquet(row.location).collect()} == {"a[0]": (1, None), "a[1]": (None, json.dumps({"n": big}, separators=(",", ":")))}


def test_the_deep_parser_is_the_parser():
    """Both on texts that are JSON and on texts that a change has broken."""
    import random

    r = random.Random(3)
    texts = ['{"a": [1, -2.5e3, "x\\u00e9", null, true, {"b": {}}], "": []}', "[]", '"t"', " 7 ", "[1,]", "{,}", '{"a":1,}', '{"a" 1}', "[1 2]", "01", "-", "1.", "tru", '{"a":}', "", "  ", "]", "[}", '{"a":1}}', '"\\x"', "[nulll]", '{1:2}', '{"a":"b\tc"}']
    for t in list(texts):
        for _ in range(40):
            i = r.randrange(len(t) + 1)
            texts.append(t[:i] + r.choice(["", ",", "}", "]", '"', "0", " ", ":"]) + t[i + r.randint(0, 1) :])

    def out(f, t):
        try:
            return repr(f(t))
        except ValueError:
            return "no JSON"

    assert nested._DECODER.decode('"\t"') == "\t"
    for t in texts:
        if "NaN" not in t and "Infinity" not in t:
            assert out(nested._parse_deep, t) == out(nested._DECODER.decode, t), t


def test_rejects_say_why(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "7"), (5, "null"), (6, "{}"), (7, '{"a":["x\ty",{"b":"\x01"}]}'), (None, "x"), (9, "[" * 3000)], "rec_id bigint, msg_value string")
    assert sorted((r.rec_id or 0, r.reason) for r in nested.rejects(df, "rec_id", "msg_value").collect()) == [(0, "no JSON"), (1, "null"), (2, "empty"), (3, "no JSON"), (4, "scalar"), (5, "scalar"), (9, "no JSON")]
    assert links(nested.shred(df, "rec_id", "msg_value")) == [(7, "$", "a[1]")], "control characters in texts are let pass"
    assert nested.rejects(df.limit(0), "rec_id", "msg_value").count() == 0


def test_a_variant_has_a_table_of_its_own(spark, tmp_path):
    objects = shred(spark, [doc({"orders": [{"no": 1, "qty": 2}, {"no": "x"}, {"no": 5, "qty": 7}]}), doc({"orders": {"no": 3, "qty": 9}})])
    listed = nested.route(objects, str(tmp_path / "typed")).collect()
    assert [(r.member_path, r.variants, r.objects) for r in listed] == [(A + "orders", 2, 4)]
    found = {json.loads(r.signature)["no"]: r for r in nested.variants(objects).collect()}
    read = lambda kind: nested.variant_table(objects, listed[0].location, found[kind].variant, json.loads(listed[0].fields), found[kind].signature)
    assert sorted((r.rec_id, r.child_path, r.no, r.qty) for r in read("int").collect()) == [(0, A + "orders[0]", "1", 2), (0, A + "orders[2]", "5", 7), (1, A + "orders[0]", "3", 9)]
    assert read("text").columns == ["rec_id", "parent_path", "child_path", "no", "misfit", "lists"] and [r.no for r in read("text").collect()] == ["x"]
