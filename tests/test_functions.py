import base64
import json
import hashlib
import hmac
import struct
from datetime import datetime
from decimal import Context, Decimal

import pytest
from changeflow import kinds
from changeflow.functions import decode, masking, redact, text
from changeflow.sources import documents, relational, tracking
from changeflow.sources.frames import UNAVAILABLE as PH
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"a {kind}").select(f(F.col("a")).alias("v")).first().v


def coded(n):
    return base64.b64encode(n.to_bytes(max(1, (n.bit_length() + 8) // 8), "big", signed=True)).decode()


def test_decimals_of_any_size(spark):
    numbers = [0, 1, -1, 127, 128, -128, -129, 255, 2**31, -(2**63), 2**64 + 7, 10**37, -(10**37), 10**38 - 1, -(10**38) + 1]
    df = spark.createDataFrame([(i, coded(n)) for i, n in enumerate(numbers)], "i int, a string")
    got = df.select("i", decode.fixed_decimal(F.col("a"), 0).alias("s0"), decode.fixed_decimal(F.col("a"), 2).alias("s2"), decode.any_decimal(F.col("a"), F.lit(2)).alias("t")).collect()
    for r in got:
        n = numbers[r.i]
        assert r.s0 == n and r.s2 == Decimal(n).scaleb(-2, Context(prec=60)) and Decimal(r.t) == r.s2
    assert one(spark, coded(2**200), lambda c: decode.fixed_decimal(c, 0)) is None
    assert one(spark, coded(-(2**200)), lambda c: decode.any_decimal(c, F.lit(3))) == f"-{2**200 // 1000}.{2**200 % 1000:03d}"
    assert one(spark, None, lambda c: decode.fixed_decimal(c, 2)) is None
    assert one(spark, f'{{"scale":1,"value":"{coded(-5)}"}}', decode.variable_decimal) == "-0.5"
    assert one(spark, '{"scale":1}', decode.variable_decimal) is None


def test_times(spark):
    assert str(one(spark, 19_000, decode.date, "bigint")) == "2022-01-08"
    assert one(spark, 3_000_000, decode.date, "bigint") is None
    assert one(spark, 3_723_004, lambda c: decode.clock(c, "ms"), "bigint") == "01:02:03.004000"
    assert one(spark, 3_723_004_005_999, lambda c: decode.clock(c, "ns"), "bigint") == "01:02:03.004005"
    assert one(spark, 1_700_000_000_123_456_789, lambda c: decode.timestamp(c, "ns"), "bigint") == datetime(2023, 11, 14, 22, 13, 20, 123456)
    assert one(spark, 253_402_300_800_000, lambda c: decode.timestamp(c, "ms"), "bigint") is None
    for bad in ("-2023-01-01T00:00:00Z", "12023-01-01T00:00:00Z", "0000-01-01T00:00:00Z", "x", None):
        assert one(spark, bad, decode.zoned_timestamp) is None
    assert one(spark, "2023-01-01T02:00:00.5+02:00", lambda c: decode.zoned_timestamp(c).cast("timestamp_ntz")) == datetime(2023, 1, 1, 0, 0, 0, 500000)
    assert one(spark, "10:20:30.5+02:00", decode.zoned_clock) == "10:20:30.500000"


def test_other_decoders(spark):
    assert one(spark, "NaN", decode.double) is None and one(spark, "1.5", decode.double) == 1.5
    assert one(spark, PH, decode.binary) is None and one(spark, "YWI=", decode.binary) == b"ab"
    assert [one(spark, x, decode.is_unavailable) for x in (PH, base64.b64encode(PH.encode()).decode(), f'["{PH}"]', "x", None)] == [True, True, True, False, False]
    assert one(spark, '["a",{"b":1},null]', decode.text_array) == ["a", '{"b":1}', None]
    assert one(spark, "7", decode.text_array) == ["7"] and one(spark, f'["{PH}"]', decode.text_array) is None
    assert one(spark, '{"x":1.5,"y":2}', decode.point) == '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5,2]},"properties":null}'
    wkb = base64.b64encode(struct.pack("<BII2d", 1, 0x20000001, 4326, 1.0, 2.0)).decode()
    assert one(spark, f'{{"wkb":"{wkb}"}}', decode.geometry) == '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.0,2.0]},"properties":null}'
    assert one(spark, '{"wkb":"AA=="}', decode.geometry) is None
    import gzip

    assert one(spark, base64.b64encode(gzip.compress(b"abc")).decode(), decode.gunzip) == b"abc"
    assert one(spark, "x", decode.gunzip) is None


def test_polygons_and_collections():
    ring = struct.pack("<I", 2) + struct.pack("<4d", 0, 0, 1, 1)
    polygon = struct.pack("<BII", 1, 3, 1) + ring
    assert decode.read_wkb(polygon)[0] == {"type": "Polygon", "coordinates": [[[0, 0], [1, 1]]]}
    many = struct.pack("<BII", 1, 7, 1) + polygon
    assert decode.read_wkb(many)[0]["geometries"][0]["type"] == "Polygon"


def test_text_functions(spark):
    assert [one(spark, x, text.is_json) for x in ('{"a":1}', " [1]", "1", "{", "", None, '"x"')] == [True, True, False, False, False, False, False]
    assert one(spark, "é" * 10, lambda c: text.overlong(c, 5, "truncate")) == "éé"
    assert one(spark, "abcdef", lambda c: text.overlong(c, 5, "truncate")) == "abcde"
    assert one(spark, "abcdef", lambda c: text.overlong(c, 5)) == text.EXCEEDED and one(spark, "abcdef", lambda c: text.overlong(c, 5, "widen")) == "abcdef"
    assert one(spark, '{"a":"' + "x" * 50 + '"}', lambda c: text.overlong(c, 5, "json", 20)) == '{"key":"' + text.EXCEEDED + '"}'
    assert one(spark, "a\\b", text.escape_backslashes) == "a\\\\b"
    assert one(spark, b"caf\xe9 \xc3\xa9", text.repair_utf8, "binary") == "café é" and one(spark, None, text.repair_utf8, "binary") is None
    for good in ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05.000Z", "2024-01-02T03:04:05.000000+00:00", "Tue Jan  2 03:04:05 2024", "Tue Jan 02 03:04:05 +0000 2024", "Tue, 02 Jan 2024 03:04:05 UTC", "Tue, 02 Jan 2024 05:04:05 +0200", "Tuesday, 02-Jan-24 03:04:05 UTC"):
        assert one(spark, good, lambda c: text.parse_timestamp_tz(c).cast("timestamp_ntz")) == datetime(2024, 1, 2, 3, 4, 5), good
    for bad in ("2024-01-02 03:04:05", "02.01.2024", "", None, "2024-13-01T00:00:00Z"):
        assert one(spark, bad, text.parse_timestamp_tz) is None
    assert one(spark, "2024-01-02 03:04:05.120", text.parse_timestamp_ntz) is None and one(spark, "2024-01-02 03:04:05.12", text.parse_timestamp_ntz) == datetime(2024, 1, 2, 3, 4, 5, 120000)
    assert one(spark, "03:04:05.1", text.parse_time) == "03:04:05.100000"
    assert one(spark, 1500.5, lambda c: text.from_millis(c).cast("timestamp_ntz"), "double") == datetime(1970, 1, 1, 0, 0, 1, 500500)
    assert one(spark, 1e20, lambda c: text.to_text(c, kinds.FLOAT), "double") == "100000000000000000000" and one(spark, 7.0, lambda c: text.to_text(c, kinds.FLOAT), "double") == "7"
    assert one(spark, "7.5", lambda c: text.convert(c, kinds.INT)) is None and one(spark, "7.0", lambda c: text.convert(c, kinds.INT)) == 7
    with pytest.raises(Exception, match="no int"):
        one(spark, "x", lambda c: text.convert(c, kinds.INT, "error"))


def test_masking(spark):
    assert one(spark, "abc", masking.hash_value) == hashlib.sha256(b"abc").hexdigest() and one(spark, None, masking.hash_value) is None
    for salt in ("s", "s" * 100):
        assert one(spark, "é", lambda c, s=salt: masking.hash_value(c, s)) == hmac.new(salt.encode(), "é".encode(), "sha256").hexdigest()
    key = masking.key_of("p")
    assert one(spark, "é", lambda c: masking.decrypt(masking.encrypt(c, key), key)) == "é" and one(spark, None, lambda c: masking.encrypt(c, key)) is None
    with pytest.raises(ValueError):
        masking.encrypt(F.lit("x"), b"short")


def test_redaction(spark):
    R = redact.MARKER
    jwt = "eyJhbGciOi.eyJzdWIiOi.c2lnbmF0dXJl"
    pairs = [
        ("https://svc:pa:ss@word@host:8443/x?y=1", f"https://svc:{R}@host:8443/x?y=1"), ("https://host/a@b.example", f"https://host/{R}"), ("ftp://host/path:with@nothing", "ftp://host/path:with@nothing"),
        ("PASSWORD = 'two words', next", f"PASSWORD = '{R}', next"), ('{"Private_Key":"a\\"b","n":1}', f'{{"Private_Key":"{R}","n":1}}'), ("access_key:zzz;other=1", f"access_key:{R};other=1"),
        ("Authorization: Bearer abcdef.ghi", f"Authorization: Bearer {R}"), ("auth=Basic dXNlcg==", f"auth={R}"), (f"cookie {jwt} end", f"cookie {R} end"), ("ASIA" + "7" * 16, R), ("AKIA" + "a" * 16, "AKIA" + "a" * 16),
        ("x -----BEGIN EC PRIVATE KEY-----\nMIIB\n-----END EC PRIVATE KEY----- y", f"x {R} y"), ("write to o.x+1@mail.example, please", f"write to {R}, please"),
        ("078-05-1120 and 666-12-3456 and 123-45 6789", f"{R} and 666-12-3456 and 123-45 6789"), ("pay 5555 5555 5555 4444 now", f"pay {R} now"), ("no. 5555555555554445", "no. 5555555555554445"), ("378282246310005", R),
        ("author: Bob, secretary", "author: Bob, secretary"), ("", ""), (None, None),
    ]
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pairs)], "i int, a string")
    assert [r.v for r in df.orderBy("i").select(redact.redact(F.col("a")).alias("v")).collect()] == [p[1] for p in pairs]
    numbers = spark.createDataFrame([("79927398713",), ("79927398710",), ("4111 1111-11111111",)], "a string").select(redact.luhn(F.col("a")).alias("v"))
    assert [r.v for r in numbers.collect()] == [True, False, True]


def test_values_that_do_not_fit_are_null(spark):
    assert one(spark, "!!", lambda c: decode.fixed_decimal(c, 2)) is None and one(spark, "", lambda c: decode.fixed_decimal(c, 2)) is None
    assert one(spark, coded(2**127 - 1), lambda c: decode.fixed_decimal(c, 0)) is None and one(spark, coded(2**127 - 1), lambda c: decode.any_decimal(c, F.lit(0))) == str(2**127 - 1)
    assert one(spark, coded(12345), lambda c: decode.fixed_decimal(c, 2, 4)) is None and one(spark, coded(5), lambda c: decode.fixed_decimal(c, 20)) == Decimal(5).scaleb(-20)
    big = 2**63 - 1
    assert [one(spark, big, lambda c, u=u: decode.timestamp(c, u), "bigint") for u in ("ms", "us")] == [None, None]
    assert one(spark, "!!", decode.binary) is None and one(spark, PH, decode.binary) is None
    assert one(spark, Decimal("-12.345"), lambda c: decode.fixed_decimal(decode.encode_decimal(c, 2), 2), "decimal(10,3)") == Decimal("-12.35")


def test_fields_by_their_definition(spark):
    import gzip

    packed = base64.b64encode(gzip.compress(b"squeezed")).decode()
    assert one(spark, packed, lambda c: decode.decode(c, None, "string", compressed=True)) == "squeezed" and one(spark, PH, lambda c: decode.decode(c, None, "string", compressed=True)) == PH
    assert one(spark, packed, lambda c: decode.decode(c, None, "bytes", compressed=True)) == b"squeezed" and one(spark, "junk", lambda c: decode.decode(c, None, "string", compressed=True)) is None
    days = {"type": "int32", "name": "io.debezium.time.Date"}
    assert one(spark, "[0, 1, null]", lambda c: decode.decode(c, None, "array", items=days)) == ["1970-01-01", "1970-01-02", None]
    assert one(spark, "[[0],[1]]", lambda c: decode.decode(c, None, "array", items={"type": "array", "items": days})) == ['["1970-01-01"]', '["1970-01-02"]']
    assert one(spark, '[{"a":1},"x"]', lambda c: decode.decode(c, None, "array", items={"type": "string"})) == ['{"a":1}', "x"]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.createDataFrame([("1000000",)], "a string").select(decode.decode(F.col("a"), "io.debezium.time.MicroTimestamp", "int64", force_utc=True).alias("v"))
        assert df.dtypes == [("v", "timestamp")] and df.select(F.unix_micros("v")).first()[0] == 1_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_lists_as_text(spark):
    df = spark.sql("select array(named_struct('a', 1, 'b', 'x')) s, array(map('k', 1)) m, array(array(1, 2)) l, array(1, null) n, named_struct('a', 1) one, 'plain' p")
    got = df.select(*[text.text_list(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert got.s == ['{"a":1,"b":"x"}'] and got.m == ['{"k":1}'] and got.l == ["[1,2]"] and got.n == ["1", None] and got.one == ['{"a":1}'] and got.p == ["plain"]
    assert one(spark, "1e39", text.float32) is None and one(spark, "1.5", text.float32) == 1.5


def test_columns_that_schemas_define_differently(spark):
    f = lambda *fields: json.dumps([{"field": n, "type": t, **({"name": k} if k else {})} for n, t, k in fields])
    rows = [('{"a":1,"b":2}', f(("a", "int32", None), ("b", "int32", None))), ('{"a":3,"b":0}', f(("a", "int32", None), ("b", "int32", "io.debezium.time.Date"))), ('{"a":1}', None), (f'{{"a":"{PH}"}}', f(("a", "int32", None)))]
    t = relational.typed_rows(spark.createDataFrame(rows, "row string, after_schema string")).collect()
    assert [(r.a, r.b, r.unavailable) for r in t] == [(1, "2", []), (3, "1970-01-01", []), (None, None, []), (None, None, ["a"])]
    many = [(json.dumps({f"c{i}": i}), f((f"c{i}", "int32", None))) for i in range(600)]
    wide = relational.typed_rows(spark.createDataFrame(many, "row string, after_schema string"))
    assert len(wide.columns) == 601 and wide.select(F.sum("c7"), F.sum("c599"), F.count("*")).first()[:] == (7, 599, 600)


def test_kinds_and_names():
    assert kinds.decimal_kind(2, 5) == kinds.Kind("decimal", 6, 5)
    assert kinds.spark_type(kinds.decimal_kind(39, 1)).simpleString() == "string" and kinds.spark_type(kinds.decimal_kind(10, 2)).simpleString() == "decimal(10,2)"
    for dialect in kinds.TYPE_TEXT:
        for name in ("bool", "float", "date"):
            assert kinds.kind_from_text(kinds.type_text(kinds.Kind(name), dialect), dialect).name == name
    assert kinds.kind_from_text("NUMERIC(10, 2)") == kinds.decimal_kind(10, 2) and kinds.kind_from_text("varchar(20)") == kinds.Kind("string", length=20)
    assert kinds.kind_from_text("no such type") == kinds.INVALID
    assert [kinds.escape_name(x, frozenset({"start"})) for x in ("", "A B", "1x", "a#", "Start")] == ["", "a__b", "col_1x", "a__", "col_start"]


def test_extended_json(spark):
    t = '{"_id":{"$oid":"ab"},"n":{"$numberLong":"5"},"d":{"$date":0},"far":{"$date":{"$numberLong":"999999999999999999"}},"x":NaN,"q":"NaN","l":[{"$numberDecimal":"1.50"},-Infinity],"b":{"$binary":{"base64":"AA==","subType":"0"}},"u":{"$binary":{"base64":"AAAAAAAAAAAAAAAAAAAAAA==","subType":"04"}},"k":{"$minKey":1}}'
    got = json.loads(one(spark, t, documents.plain_json))
    assert got == {"_id": "ab", "n": 5, "d": "1970-01-01T00:00:00Z", "far": None, "x": None, "q": "NaN", "l": ["1.50", None], "b": {"$binary": {"base64": "AA==", "subType": "00"}}, "u": "00000000-0000-0000-0000-000000000000", "k": {"$minKey": 1}}
    assert one(spark, "{", documents.plain_json) is None and one(spark, None, documents.plain_json) is None and one(spark, '{"a": 1}', documents.plain_json) == '{"a":1}'
    assert one(spark, '{"payload":{"id":"{\\"$oid\\": \\"ab\\"}"}}', documents.document_key) == "ab" and one(spark, '{"id":"7"}', documents.document_key) == "7"


def test_tracking(spark):
    rows = ['{"event":"e","timestamp":"2024-01-01T00:00:00Z","messageID":"m","properties":{"a":1,"id":"p","plan":"x"},"extraFields":{"plan":"free","b":{"c":1}}}', '{"event":"e"}', "", None, "{"]
    df = spark.createDataFrame([(r,) for r in rows], "msg_value string")
    got = tracking.tracked_rows(df).collect()
    assert len(got) == 1 and got[0].row == {"a": "1", "id": "m", "plan": "free", "b": '{"c":1}', "event": "e", "timestamp": "2024-01-01T00:00:00Z"}
    assert tracking.invalid(df).count() == 4
    assert [tracking.hinted_kind(c) for c in ("user_id", "Created_At", "x_started", "x")] == ["string", "timestamp_tz", "timestamp_tz", None]


def test_envelopes(spark):
    schema = '{"fields":[{"field":"after","type":"struct","fields":[{"field":"id","type":"int32"},{"field":"Price","type":"bytes","name":"org.apache.kafka.connect.data.Decimal","parameters":{"scale":"2","connect.decimal.precision":"5"}},{"field":"note","type":"string"}]}]}'
    rows = [
        f'{{"schema":{schema},"payload":{{"after":{{"id":1,"Price":"{coded(150)}","note":"{PH}"}},"op":"c","source":{{"db":"d","table":"t","ts_ms":5}}}}}}',
        '{"payload":{"before":{"id":2},"op":"d"}}', "", "{", None,
    ]
    e = relational.envelopes(spark.createDataFrame([(r,) for r in rows], "msg_value string"))
    assert e.count() == 2
    t = relational.typed_rows(relational.with_image(e)).collect()
    r = next(x for x in t if x.op == "c")
    assert (r.id, r.price, r.note, r.unavailable, r.source_ts) == (1, Decimal("1.50"), None, ["note"], 5)
    assert next(x for x in t if x.op == "d")["__cf_only_set_delete"] is True
    bad = relational.with_image(spark.createDataFrame([("x", None, "{}")], "op string, before string, after string"))
    with pytest.raises(Exception, match="unknown operation"):
        bad.collect()
    assert relational.typed_rows(relational.with_image(e.limit(0))).count() == 0


def test_inference(spark):
    rows = ['{"a":1,"b":"x","c":null,"d":"{\\"k\\":1}","e":[1],"f":{"g":1},"h":true,"i":1}', '{"a":2.5,"c":null,"i":"text"}', None, "{"]
    df = spark.createDataFrame([(r,) for r in rows], "row string")
    got = {r.field: r.kind for r in relational.infer_kinds(df).collect()}
    assert got == {"a": "float", "b": "string", "c": "invalid", "d": "struct", "e": "array", "f": "struct", "h": "bool", "i": "string"}
    assert {r.field: r.kind for r in relational.infer_kinds(df, whole_numbers=True).collect()}["a"] == "float"
