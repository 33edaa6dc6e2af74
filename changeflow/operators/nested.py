"""Problem 1: deeply nested records into flat tables, by structural variants.

Objects are classified bottom-up by a tree automaton: a scalar's state is its kind,
a list's is the set of its elements' states, an object's is the set of its members
with their states. An object's state is its variant. What the automaton calls an object
is a row, if it is an element of a list, of the supertype table (record, own path,
parent's path, path without indexes, variant); with ``every``, so are the record itself
and each lone object. :func:`route` sends each variant to its typed subtype table.

Two passes over the records: the first finds the members that hold lists of objects
in some records and a lone object in others (distinct paths, combined map-side); the
second emits the rows. The set of such members is broadcast only up to
``broadcast_limit``; beyond it, rows meet it in a shuffled join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONE, ELEMENT = "\x01", "\x02"
OBJECTS = "rec_id bigint, parent_path string, child_path string, member_path string, variant string, signature string, members map<string,string>, lists map<string,string>"
MARKED = "rec_id bigint, marked string, variant string, signature string, members map<string,string>, lists map<string,string>"
_BATCH = 20_000
#: Shapes that a task remembers with their states.
MOST_SHAPES = 100_000


class Int(str):
    """A whole number, kept as its text."""


class Real(str):
    """Any other number, kept as its text."""


_DECODER = json.JSONDecoder(parse_int=Int, parse_float=Real, strict=False)
_BLANK = re.compile(r"[ \t\n\r]*")
_LITERAL = re.compile(r"(true|false|null)|(-?(?:0|[1-9]\d*))(\.\d+)?([eE][+-]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None}


def parse(text: str) -> object:
    """JSON text of any depth as a value, numbers as their text; control characters in texts are let pass. ValueError if it is none."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> object:
    """:func:`parse` with a list for a stack."""
    holder: list = []
    stack: list[list | dict] = []
    keys: list[str] = []
    at, n, state = 0, len(text), "value"

    def put(v: object) -> None:
        if not stack:
            holder.append(v)
        elif type(stack[-1]) is dict:
            stack[-1][keys.pop()] = v
        else:
            stack[-1].append(v)

    while True:
        at = _BLANK.match(text, at).end()
        if at >= n:
            break
        ch = text[at]
        if state in ("value", "first item") and ch in "{[":
            v: list | dict = {} if ch == "{" else []
            put(v)
            stack.append(v)
            at += 1
            state = "first key" if ch == "{" else "first item"
        elif state in ("key", "first key") and ch == '"':
            key, at = scanstring(text, at + 1, False)
            keys.append(key)
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at += 1
            state = "value"
        elif stack and ch == ("}" if type(stack[-1]) is dict else "]") and state in ("after", "first key", "first item"):
            stack.pop()
            at += 1
            state = "after" if stack else "end"
        elif state == "after" and ch == ",":
            at += 1
            state = "key" if type(stack[-1]) is dict else "value"
        elif state in ("value", "first item"):
            if ch == '"':
                v, at = scanstring(text, at + 1, False)
            elif m := _LITERAL.match(text, at):
                v = _WORDS[m[1]] if m[1] else Real(m[0]) if m[3] or m[4] else Int(m[0])
                at = m.end()
            else:
                raise ValueError(f"no value at {at}")
            put(v)
            state = "after" if stack else "end"
        else:
            raise ValueError(f"unexpected {ch!r} at {at}")
    if state != "end":
        raise ValueError("the text breaks off")
    return holder[0]


def load(text: str | None, unwrap: tuple[str, ...]) -> object:
    """The record, JSON text at the member path ``unwrap`` read as nested; None if it is null or no JSON. Numbers keep their text."""
    if not text:
        return None
    try:
        doc = parse(text)
    except ValueError:
        return None
    at = doc
    for name in unwrap[:-1]:
        at = at.get(name) if isinstance(at, dict) else None
    if unwrap and isinstance(at, dict) and type(at.get(unwrap[-1])) is str:
        try:
            inner = parse(at[unwrap[-1]])
        except ValueError:
            inner = None
        if isinstance(inner, dict | list):
            at[unwrap[-1]] = inner
    return doc


def is_scalar_object(o: dict) -> bool:
    """Extended-JSON values, objects with a member that starts with ``$``, are scalars."""
    for k in o:
        if k[:1] == "$":
            return True
    return False


def holders(doc: object) -> set[tuple[str, int]]:
    """Index-free paths of members that hold (1) a list with an object in it, (0) a lone object."""
    found: set[tuple[str, int]] = set()
    stack: list[tuple[object, str, int]] = [(doc, "", 2)]
    while stack:
        x, path, within = stack.pop()
        if type(x) is dict:
            if is_scalar_object(x):
                continue
            if within == 0 and path:
                found.add((path, 0))
            elif within == 1 and path:
                found.add((path, 1))
            stack.extend((v, f"{path}.{k}" if path else k, 0) for k, v in x.items() if type(v) in (dict, list))
        elif type(x) is list:
            stack.extend((v, path, 1 if within == 0 else 2) for v in x if type(v) in (dict, list))
    return found


def _kind(x: object) -> str:
    if x is None:
        return "null"
    return {bool: "bool", Int: "int", Real: "real"}.get(type(x), "text")


#: State and signature of an object whose members have the states that the text names.
_SHAPES: dict[str, tuple[str, str]] = {}
_SCALAR_STATES = {str: "text", Int: "int", Real: "real", bool: "bool", type(None): "null"}


def _shape(states_: list[tuple[str, str]]) -> tuple[str, str]:
    whole = ";".join([f"{len(k)}:{k}={s}" for k, s in states_])
    known = _SHAPES.get(whole)
    if known is None:
        state = hashlib.blake2b(whole.encode("utf8", "surrogatepass"), digest_size=8).hexdigest()
        plain = {k: "object" if s[0] == "{" else "list" if s[0] == "[" else s for k, s in states_}
        if len(_SHAPES) >= MOST_SHAPES:
            _SHAPES.clear()
        known = _SHAPES[whole] = state, json.dumps(plain, ensure_ascii=False)
    return known


def states(doc: object) -> dict[int, tuple[str, str]]:
    """The automaton's run: state and signature of every object of ``doc``, by its ``id``; an extended-JSON value is no object."""
    out: dict[int, tuple[str, str]] = {}
    done: dict[int, str] = {}
    # Parents before their children; worked off from the end.
    order: list[object] = [doc]
    for x in order:
        if type(x) is dict:
            if not is_scalar_object(x):
                order.extend([v for v in x.values() if type(v) in (dict, list)])
        elif type(x) is list:
            order.extend([v for v in x if type(v) in (dict, list)])
    of = _SCALAR_STATES
    for x in reversed(order):
        if type(x) is list:
            done[id(x)] = "[" + "|".join(sorted({of.get(type(v)) or done[id(v)] for v in x})) + "]"
        elif type(x) is dict:
            if is_scalar_object(x):
                done[id(x)] = "ext:" + min(k for k in x if k[:1] == "$")
            else:
                known = out[id(x)] = _shape(sorted([(k, of.get(type(v)) or done[id(v)]) for k, v in x.items()]))
                done[id(x)] = "{" + known[0] + "}"
    return out


def _scalars(o: dict) -> list[tuple[str, str | None]]:
    out = []
    for k, v in o.items():
        if type(v) is dict and is_scalar_object(v):
            inner = next(iter(v.values())) if len(v) == 1 else None
            out.append((k, str(inner) if isinstance(inner, str) else json.dumps(v, ensure_ascii=False)))
        elif type(v) not in (dict, list):
            out.append((k, None if v is None else str(v).lower() if type(v) is bool else str(v)))
    return out


class _Sign(str):
    """A piece of JSON text between values."""


def _json(v: object) -> str:
    if type(v) in (Int, Real):
        return str(v)
    if type(v) is dict:
        return "{" + ", ".join(f"{json.dumps(k)}: {_json(x)}" for k, x in v.items()) + "}"
    return "[" + ", ".join(map(_json, v)) + "]" if type(v) is list else json.dumps(v)


def outline(x: list) -> str | None:
    """A list as JSON, ``{}`` in the place of each object (a row of its own); None if it holds nothing but objects."""
    out: list[str] = []
    plain = False
    stack: list[object] = [x]
    while stack:
        v = stack.pop()
        if type(v) is _Sign:
            out.append(v)
        elif type(v) is list:
            plain = plain or not v
            out.append("[")
            stack.append(_Sign("]"))
            for i in range(len(v) - 1, -1, -1):
                stack.append(v[i])
                if i:
                    stack.append(_Sign(", "))
        elif type(v) is dict and not is_scalar_object(v):
            out.append("{}")
        else:
            plain = True
            out.append(_json(v))
    return "".join(out) if plain else None


def _lists(o: dict) -> list[tuple[str, str]]:
    return [(k, text) for k, v in o.items() if type(v) is list and (text := outline(v)) is not None]


def marked_paths(doc: object, every: bool = False) -> Iterator[tuple[str, dict]]:
    """Every object but the root with its path, a mark after each object on it: lone or element of a list.

    With ``every`` the root comes as well, without any mark.
    """
    stack: list[tuple[object, str, bool]] = [(doc, "", False)]
    while stack:
        x, path, element = stack.pop()
        if type(x) is dict:
            if is_scalar_object(x):
                continue
            if path or (every and x is not doc):
                path += ELEMENT if element else LONE
                yield path, x
            elif every:
                yield path, x
            stack.extend((v, f"{path}.{k}" if path else k, False) for k, v in x.items() if type(v) in (dict, list))
        else:
            stack.extend((v, f"{path}[{i}]", True) for i, v in enumerate(x) if type(v) in (dict, list))


def without_indexes(path: str) -> str:
    """``a[0].b[1][2]`` is ``a.b``: what :func:`holders` calls the member."""
    out, i = [], 0
    while i < len(path):
        j = path.find("]", i) if path[i] == "[" else -1
        if j > 0 and path[i + 1 : j].isdigit() and (j + 1 == len(path) or path[j + 1] in ".[" + LONE + ELEMENT):
            i = j + 1
        else:
            out.append(path[i])
            i += 1
    return "".join(out)


def resolve(marked: str, counts_as_list: Callable[[str], bool], every: bool = False) -> tuple[str | None, str] | None:
    """(parent path, own path) of a marked object; None if it is no element of a list.

    With ``every`` any object is a parent, and none is left out: the root is ``$``, without a parent.
    """
    if every and not marked:
        return None, "$"
    own, parent, last, piece = "", "$", "$", ""
    element = False
    for ch in marked:
        if ch == ELEMENT or ch == LONE:
            own += piece
            piece = ""
            element = every or ch == ELEMENT
            if ch == LONE and counts_as_list(without_indexes(own)):
                own += "[0]"
                element = True
            if element:
                parent, last = last, own
        else:
            piece += ch
    return (parent, own) if element else None


def lone_members(marked: str) -> list[str]:
    """Index-free paths of the lone objects on a marked path."""
    own, out = "", []
    for ch in marked:
        if ch == LONE:
            out.append(without_indexes(own))
        elif ch != ELEMENT:
            own += ch
    return out


def placed(doc: object, run: dict[int, tuple[str, str]], counts_as_list: Callable[[str], bool], every: bool = False) -> Iterator[tuple[str | None, str, str, dict]]:
    """The objects of a record that are rows: (parent path, own path, path without indexes, object), for a known set of members.

    As :func:`marked_paths` and :func:`resolve` together: what the automaton (``run``) calls
    an object is a row if it is an element of a list or, with ``every``, whatever it is.
    """
    stack: list[tuple[object, str, str, str | None, bool]] = [(doc, "", "", "$", False)]
    if every and type(doc) is dict and id(doc) in run:
        yield None, "$", "$", doc
    while stack:
        x, path, member, holder, element = stack.pop()
        if type(x) is list:
            stack.extend([(v, f"{path}[{i}]", member, holder, True) for i, v in enumerate(x) if type(v) in (dict, list)])
            continue
        if id(x) not in run:
            continue
        if x is not doc:
            if not element and counts_as_list(member):
                path += "[0]"
                element = True
            if element or every:
                yield holder, path, member, x
                holder = path
        stack.extend([(v, f"{path}.{k}" if x is not doc else k, f"{member}.{k}" if x is not doc else k, holder, False) for k, v in x.items() if type(v) in (dict, list)])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, str | None]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_S, _M = pa.string(), pa.map_(pa.string(), pa.string())
_OBJECTS = pa.schema([("rec_id", pa.int64()), ("parent_path", _S), ("child_path", _S), ("member_path", _S), ("variant", _S), ("signature", _S), ("members", _M), ("lists", _M)])
_MARKED = pa.schema([("rec_id", pa.int64()), ("marked", _S), ("variant", _S), ("signature", _S), ("members", _M), ("lists", _M)])


def list_members(records: DataFrame, unwrap: tuple[str, ...]) -> DataFrame:
    """Members (``path``) that hold lists of objects in some records and a lone object in others."""

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[str, int]] = set()
        for batch in it:
            for _, text in _rows(batch):
                if (doc := load(text, unwrap)) is not None:
                    found |= holders(doc)
            if len(found) > _BATCH:
                yield pa.RecordBatch.from_pydict({"path": [p for p, _ in found], "kind": pa.array([k for _, k in found], pa.int32())})
                found = set()
        if found:
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in found], "kind": pa.array([k for _, k in found], pa.int32())})

    kinds = records.mapInArrow(scan, "path string, kind int")
    return kinds.groupBy("path").agg(F.min("kind").alias("a"), F.max("kind").alias("b")).where("a <> b").select("path")


def rejects(records: DataFrame, rec_id: str, value: str) -> DataFrame:
    """The records that :func:`shred` can't read: ``rec_id, reason, value`` (``null``, ``empty``, ``no JSON``, or ``scalar``, which holds no object)."""

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rec_id", pa.int64()), ("reason", _S), ("value", _S)])

        def rows() -> Iterator[tuple]:
            for batch in it:
                for rid, text in _rows(batch):
                    doc = load(text, ())
                    if type(doc) not in (dict, list):
                        reason = "null" if text is None else "empty" if not text.strip() else "scalar" if doc is not None or text.strip() == "null" else "no JSON"
                        yield rid, reason, text

        yield from _batches(rows(), schema)

    return records.select(F.col(rec_id).cast("bigint").alias("rec_id"), F.col(value).alias("value")).mapInArrow(scan, "rec_id bigint, reason string, value string")


def shred(records: DataFrame, rec_id: str, value: str, unwrap: str | None = "payload.after", broadcast_limit: int = 20_000, values: bool = True, every: bool = False) -> DataFrame:
    """The supertype table of all objects that are elements of lists: columns :data:`OBJECTS`.

    ``member_path`` is the path without indexes, ``variant`` the automaton's state,
    ``signature`` the members with their kinds, ``members`` the scalar members as text
    (a JSON null is a null), ``lists`` the lists that hold anything but objects, as of
    :func:`outline`; without ``values`` the last two are null.
    With ``every`` the record (path ``$``, no parent) and each lone object are rows too, and
    a parent is the next object around, of either sort; a record that is a list is an
    object with that list as its member of no name.
    A lone object of a member that holds lists of objects elsewhere is element 0.
    Null, empty and unreadable values have no rows (they are in :func:`rejects`), an empty table gives an empty one,
    a record that occurs twice gives its rows twice; other columns are not read.
    """
    slim = records.select(F.col(rec_id).cast("bigint").alias("rec_id"), F.col(value).alias("value"))
    into = tuple(unwrap.split(".")) if unwrap else ()
    mixed = list_members(slim, into)
    head = [r.path for r in mixed.limit(broadcast_limit + 1).collect()]
    if len(head) > broadcast_limit:
        return _shred_by_join(slim, mixed, into, values, every)
    known = frozenset(head)

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in it:
                for rid, text in _rows(batch):
                    doc = load(text, into)
                    if type(doc) not in (dict, list):
                        continue
                    doc = {"": doc} if every and type(doc) is list else doc
                    run = states(doc)
                    for parent, own, member, o in placed(doc, run, known.__contains__, every):
                        yield rid, parent, own, member, *run[id(o)], *((_scalars(o), _lists(o)) if values else (None, None))

        yield from _batches(rows(), _OBJECTS)

    return slim.mapInArrow(emit, OBJECTS)


def _shred_by_join(slim: DataFrame, mixed: DataFrame, into: tuple[str, ...], values: bool, every: bool) -> DataFrame:
    """As :func:`shred`, for a set of members of any size: each row meets those on its own path in a shuffled join."""

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in it:
                for rid, text in _rows(batch):
                    doc = load(text, into)
                    if type(doc) not in (dict, list):
                        continue
                    doc = {"": doc} if every and type(doc) is list else doc
                    run = states(doc)
                    for marked, o in marked_paths(doc, every):
                        yield rid, marked, *run[id(o)], *((_scalars(o), _lists(o)) if values else (None, None))

        yield from _batches(rows(), _MARKED)

    def paths(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("marked", _S), ("path", _S)])
        for batch in it:
            yield from _batches(((m, p) for m in batch.column(0).to_pylist() for p in lone_members(m)), schema)

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in it:
                for r in batch.to_pylist():
                    if at := resolve(r["marked"], frozenset(r["here"] or ()).__contains__, every):
                        yield r["rec_id"], *at, without_indexes(at[1]), r["variant"], r["signature"], r["members"], r["lists"]

        yield from _batches(rows(), _OBJECTS)

    marked = slim.mapInArrow(emit, MARKED)
    # Distinct marked paths, not rows, meet the members.
    known = marked.select("marked").distinct().mapInArrow(paths, "marked string, path string").join(mixed, "path", "left_semi")
    here = known.groupBy("marked").agg(F.collect_set("path").alias("here"))
    return marked.join(here, "marked", "left").select("rec_id", "marked", "variant", "signature", "members", "lists", "here").mapInArrow(place, OBJECTS)


def variants(objects: DataFrame) -> DataFrame:
    """Every variant of each member: ``member_path, variant, signature, objects`` (how many). Variants of one signature differ further down."""
    return objects.groupBy("member_path", "variant").agg(F.min("signature").alias("signature"), F.count("*").alias("objects"))


#: Spark type of a subtype table's column by the kind in a signature.
TYPES = {"int": "bigint", "real": "double", "bool": "boolean", "text": "string", "ext:$numberLong": "bigint", "ext:$date": "string", "ext:$oid": "string"}


def subtype_table(objects: DataFrame, member_path: str, fields: dict[str, str]) -> DataFrame:
    """The typed table of one member's objects: keys, parent link, variant, and ``fields`` (name to Spark type).

    A member that a variant lacks, or whose value doesn't fit the type, is null; the text
    of what didn't fit stays in ``misfit`` (JSON), as do lists of scalars in ``lists``. A
    field named as a column before it, whatever the case, gets the prefix ``f_``.
    """
    keys = ["rec_id", "parent_path", "child_path", "variant"]
    of = objects.where(F.col("member_path") == member_path)
    named = column_names(fields)
    typed = [F.col("members")[n].try_cast(t).alias(named[n]) for n, t in fields.items()]
    wrong = F.map_filter("members", lambda k, v: v.isNotNull() & F.lit(False) if not fields else _any(k, v, fields))
    return of.select(*keys, *typed, F.when(F.size(wrong) > 0, F.to_json(wrong)).alias("misfit"), F.when(F.size("lists") > 0, F.to_json("lists")).alias("lists"))


def column_names(fields: Iterable[str]) -> dict[str, str]:
    """A subtype table's column for each field: its name, prefixed by ``f_`` until no column before it is equal but for case."""
    taken = {"rec_id", "parent_path", "child_path", "variant", "misfit", "lists"}
    out = {}
    for n in fields:
        name = n or "f_"
        while name.lower() in taken:
            name = f"f_{name}"
        taken.add(name.lower())
        out[n] = name
    return out


def member_fields(objects: DataFrame) -> dict[str, dict[str, str]]:
    """The fields of every member, as of :func:`fields_of` over all its variants."""
    kinds = objects.select("member_path", F.explode_outer(F.from_json("signature", "map<string,string>")).alias("name", "kind")).distinct()
    by: dict[str, list[str]] = {}
    for r in kinds.collect():
        by.setdefault(r.member_path, []).append(json.dumps({} if r.name is None else {r.name: r.kind}))
    return {m: fields_of(by[m]) for m in sorted(by)}


def route(objects: DataFrame, path: str, at_once: int = 6) -> DataFrame:
    """Send every object to the typed table of its variant below ``path``, which must be new.

    A member's variants lie side by side in ``location``, one folder ``variant=<state>`` each,
    under fields that hold them all; :func:`variant_table` reads one variant under its own.
    Members are written by jobs of their own, ``at_once`` at a time; a variant with most of a
    member's objects is many tasks. Returns a row a member: ``member_path, location, fields``
    (JSON: name to type), and as read back ``variants``, ``objects`` and ``misfits`` (rows with any).
    """
    spark = objects.sparkSession
    of = lambda m: f"m{hashlib.md5(m.encode('utf8', 'surrogatepass')).hexdigest()}"
    objects.withColumn("member", F.concat(F.lit("m"), F.md5("member_path"))).write.partitionBy("member").parquet(f"{path}/objects")
    kept = spark.read.schema(f"{OBJECTS}, member string").parquet(f"{path}/objects")
    found = member_fields(kept)

    def write(m: str) -> tuple[str, str, str, str]:
        location = f"{path}/tables/member={of(m)}"
        typed = subtype_table(kept.where(F.col("member") == of(m)), m, found[m])
        typed.hint("rebalance", "variant").write.partitionBy("variant").parquet(location)
        return of(m), m, location, json.dumps(found[m], ensure_ascii=False)

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(write, found))
    listed = spark.createDataFrame(rows, "member string, member_path string, location string, fields string")
    if not rows:
        return listed.selectExpr("member_path", "location", "fields", "0L as variants", "0L as objects", "0L as misfits")
    stored = spark.read.schema("misfit string, member string, variant string").parquet(f"{path}/tables")
    counts = stored.groupBy("member").agg(F.count_distinct("variant").alias("variants"), F.count("*").alias("objects"), F.count("misfit").alias("misfits"))
    return listed.join(counts, "member").drop("member")


def variant_table(objects: DataFrame, location: str, variant: str, fields: dict[str, str], signature: str) -> DataFrame:
    """One variant's typed rows as :func:`route` wrote them: keys, parent link, and just the scalar members that the variant has.

    ``fields``: those of the member's table; ``signature``: the variant's.
    """
    named = column_names(fields)
    own = [n for n in fields_of([signature]) if n in fields]
    columns = [("rec_id", "bigint"), ("parent_path", "string"), ("child_path", "string"), *[(named[n], fields[n]) for n in own], ("misfit", "string"), ("lists", "string")]
    schema = ", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in columns)
    return objects.sparkSession.read.schema(schema).parquet(f"{location}/variant={variant}")


def _any(k: Column, v: Column, fields: dict[str, str]) -> Column:
    out = F.lit(False)
    for n, t in fields.items():
        out = out | ((k == n) & v.isNotNull() & v.try_cast(t).isNull())
    return out


def fields_of(signatures: Iterable[str]) -> dict[str, str]:
    """Field types that hold every value of the given variants: kinds that differ widen to double or string."""
    kinds: dict[str, set[str]] = {}
    for s in signatures:
        for name, kind in json.loads(s).items():
            if kind not in ("null", "object", "list"):
                kinds.setdefault(name, set()).add(TYPES.get(kind, "string"))
    return {n: next(iter(k)) if len(k) == 1 else "double" if k == {"bigint", "double"} else "string" for n, k in sorted(kinds.items())}
