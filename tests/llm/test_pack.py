import itertools
from collections import Counter

from changeflow.llm import pack
from hypothesis import given, settings
from hypothesis import strategies as st


def bins(fillings):
    return sum(n for _, n in fillings)


def check(counts, capacity, fillings):
    used = Counter()
    for filling, n in fillings:
        assert n > 0 and all(c > 0 for c in filling.values()) and sum(s * c for s, c in filling.items()) <= capacity
        for s, c in filling.items():
            used[s] += c * n
    assert used == Counter({s: c for s, c in counts.items() if c})


def fewest(items, capacity):
    """The least number of containers, by trying all ways."""
    items = sorted(items, reverse=True)
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in {*rooms}:
            if r >= items[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, [*rest, r - items[i]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


COUNTS = st.dictionaries(st.integers(1, 30), st.integers(1, 60), max_size=20)


@settings(max_examples=300, deadline=None)
@given(COUNTS, st.integers(30, 60))
def test_every_piece_has_its_place(counts, capacity):
    check(counts, capacity, pack.solve(counts, capacity))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_fixing_dominant_fillings_keeps_the_optimum(items):
    h = pack.Histogram(Counter(items))
    fixed = pack.reduce_dominated(h, 20)
    rest = [s for s, n in h.n.items() for _ in range(n)]
    assert bins(fixed) + fewest(rest, 20) == fewest(items, 20)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 25), st.integers(1, 9), max_size=12))
def test_best_fit_in_bulk_is_best_fit_piece_by_piece(counts):
    rooms = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(25 - s)
    fillings = pack.best_fit(pack.Histogram(counts), 25)
    check(counts, 25, fillings)
    got = sorted(25 - sum(s * c for s, c in f.items()) for f, n in fillings for _ in range(n))
    assert got == sorted(rooms)


def placed(spark, sizes, capacities, **kw):
    df = spark.createDataFrame(sizes, "doc_id bigint, size bigint").selectExpr("*", "'x' as kind", "1 as rest")
    caps = spark.createDataFrame(capacities, "bin_kind string, capacity_tokens int")
    return pack.pack(df, caps, **kw).collect()


def test_placing(spark):
    sizes = [(i, s) for i, s in enumerate([0, None, 1, 7, 10, 11, 20, 25, 3, 3, 3, 4, 40])] + [(99, 3), (99, 3), (None, 5), (None, None)]
    rows = placed(spark, sizes, [("ten", 10), ("large", 1000), ("ten", 10), ("none", 0), (None, None)])
    assert {r.bin_kind for r in rows} == {"ten", "large"}
    for kind, cap in (("ten", 10), ("large", 1000)):
        of = [r for r in rows if r.bin_kind == kind]
        fill = Counter()
        for r in of:
            fill[r.bin_id] += r.n_tokens
        assert max(fill.values()) <= cap and sorted(fill) == list(range(len(fill)))
        assert sum(fill.values()) == sum(s or 0 for _, s in sizes)
        assert len(fill) <= -(-sum(fill.values()) // cap) + 1
        by = {}
        for r in of:
            by.setdefault(r.doc_id, []).append(r)
        for doc, size in sizes[:13]:
            parts = sorted(by[doc], key=lambda r: r.piece_no)
            assert [p.piece_no for p in parts] == list(range(max(1, -(-(size or 0) // cap))))
            assert [p.start_token for p in parts] == [i * cap for i in range(len(parts))]
        assert len(by[99]) == 2 and len(by[None]) == 2


def test_one_size_and_slices(spark):
    sizes = [(i, 5) for i in range(200)]
    rows = placed(spark, sizes, [("ten", 10)], rows_per_slice=1)
    assert Counter(Counter(r.bin_id for r in rows).values()) == {2: 100}


def test_nothing_to_place(spark):
    assert placed(spark, [], [("ten", 10)]) == [] and placed(spark, [(1, 5)], []) == []
    assert [(r.bin_id, r.n_tokens) for r in placed(spark, [(1, 0), (2, None)], [("ten", 10)])] == [(0, 0), (0, 0)]


def test_kinds_in_several_plans(spark):
    rows = placed(spark, [(1, 1), (2, 7)], [(str(i), 5) for i in range(4)], kinds_at_once=3)
    assert Counter((r.bin_kind, r.doc_id) for r in rows) == {(str(k), d): n for k in range(4) for d, n in ((1, 1), (2, 2))}


def test_equal_rows_are_told_apart_by_their_salt(spark):
    df = spark.createDataFrame([(None, 5, s % 3) for s in range(40)] + [(1, 5, s % 3) for s in range(40)], "doc_id bigint, size bigint, salt int")
    caps = spark.createDataFrame([("ten", 10)], "bin_kind string, capacity_tokens int")
    assert Counter(Counter(r.bin_id for r in pack.pack(df, caps).collect()).values()) == {2: 40}


def test_documents(spark, data):
    docs, caps = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "pack_capacities"))
    out = pack.pack_documents(docs, caps)
    for r in pack.report(out, caps).collect():
        assert r.fullest <= {"short": 512, "regular": 2048, "wide": 8192}[r.bin_kind] and r.bins <= 1.1 * r.least_bins + 1
    assert out.select("bin_kind", "doc_id").distinct().count() == 3 * docs.count()
    assert sorted(itertools.chain(*out.select("piece_no").distinct().collect()))[0] == 0
