"""Problem 7: filling containers of fixed capacity, by dominance reduction and best fit.

Sizes are whole numbers up to the capacity, so an instance is a histogram: how many
pieces there are of each size. It has at most ``capacity`` entries whatever the number
of documents, and is solved on the driver: sets of pieces that provably dominate every
other way to fill the container of a piece are fixed, from the largest piece down (Martello and Toth),
the rest is packed best fit, largest first, many containers of one filling at a time.
Documents are then matched to places by their rank within their size, counted in slices
so that no size is one task.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize
from .encode import token_counts

#: A filling: sizes with their counts, and how many containers are filled so.
Filling = tuple[dict[int, int], int]


class Histogram:
    """Counts of sizes, with the sizes in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {s: c for s, c in counts.items() if c > 0 and s > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def largest(self, most: int) -> int | None:
        """The largest size up to ``most``."""
        i = bisect.bisect_right(self.sizes, most)
        return self.sizes[i - 1] if i else None


def _smallest(h: Histogram, without: int, k: int) -> list[int]:
    """The ``k`` smallest pieces beside one of size ``without``."""
    out: list[int] = []
    for s in h.sizes:
        out += [s] * min(k - len(out), h.n[s] - (s == without))
        if len(out) >= k:
            break
    return out


def _best_pair(h: Histogram, j: int, room: int) -> tuple[int, int] | None:
    """The two pieces beside ``j`` with the greatest sum up to ``room``; of equal sums the one with the larger piece."""
    best, found = -1, None
    lo, hi = 0, len(h.sizes) - 1
    while lo <= hi:
        a, b = h.sizes[lo], h.sizes[hi]
        if a + b > room:
            hi -= 1
            continue
        left_a, left_b = h.n[a] - (a == j), h.n[b] - (b == j)
        if left_b < 1:
            hi -= 1
            continue
        if left_a < (2 if a == b else 1):
            lo += 1
            continue
        if a + b > best:
            best, found = a + b, (b, a)
        lo += 1
    return found


def dominant(h: Histogram, j: int, capacity: int) -> list[int] | None:
    """Pieces that, put beside a piece ``j``, dominate any other filling of its container; None if none is proven.

    A filling dominates another if the other's pieces can be grouped so that each group
    is no larger than a piece of its own of the first. Beside ``j``:
    nothing else fits; or one piece fills the room exactly; or no two fit, then the
    largest that does; or no three fit, then the largest alone if no pair is larger, or
    the best pair if it holds the largest piece and no fitting pair has both its pieces
    larger than the pair's smaller one.
    """
    room = capacity - j
    few = _smallest(h, j, 3)
    if not few or few[0] > room:
        return []
    top = h.largest(room)
    if top == j and h.n[j] < 2:
        i = bisect.bisect_left(h.sizes, j)
        top = h.sizes[i - 1]
    if top == room or len(few) < 2 or few[0] + few[1] > room:
        return [top]
    if len(few) < 3 or sum(few) > room:
        pair = _best_pair(h, j, room)
        if pair is None or top >= sum(pair):
            return [top]
        if pair[0] == top:
            above: list[int] = []
            for s in h.sizes[bisect.bisect_right(h.sizes, pair[1]) :]:
                above += [s] * min(2 - len(above), h.n[s] - (s == j))
                if len(above) >= 2:
                    break
            if len(above) < 2 or sum(above) > room:
                return [*pair]
    return None


def reduce_dominated(h: Histogram, capacity: int) -> list[Filling]:
    """Fix dominating fillings, the largest piece first; pieces for which none is proven stay in ``h``.

    A filling is proven against all pieces that are left, larger ones without a proof of
    their own included. It is used as often as its sizes last: fewer pieces allow no
    filling that more didn't.
    """
    out: list[Filling] = []
    i = len(h.sizes) - 1
    while i >= 0:
        j = h.sizes[i]
        beside = dominant(h, j, capacity)
        if beside is not None:
            need: dict[int, int] = defaultdict(int)
            for s in [j, *beside]:
                need[s] += 1
            times = min(h.n[s] // c for s, c in need.items())
            for s, c in need.items():
                h.take(s, c * times)
            out.append((dict(need), times))
            i = bisect.bisect_right(h.sizes, j) - 1
        else:
            i -= 1
    return out


def best_fit(h: Histogram, capacity: int) -> list[Filling]:
    """Best fit, largest first: each piece goes to the fullest container with room; equal containers are filled together."""
    groups: dict[int, list[Filling]] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def put(room: int, filling: dict[int, int], count: int) -> None:
        if count:
            if not groups[room]:
                bisect.insort(rooms, room)
            groups[room].append((filling, count))

    for s in reversed(h.sizes):
        left = h.n[s]
        at = bisect.bisect_left(rooms, s)
        while left and at < len(rooms):
            room = rooms[at]
            filling, count = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            each = room // s
            full = min(count, left // each)
            put(room - each * s, filling | {s: filling.get(s, 0) + each}, full)
            left -= full * each
            if full < count:
                rest = min(left, each - 1) if left < each else 0
                if rest:
                    put(room - rest * s, filling | {s: filling.get(s, 0) + rest}, 1)
                    left -= rest
                    full += 1
                put(room, filling, count - full)
                if not left:
                    break
            at = bisect.bisect_left(rooms, s)
        if left:
            each = capacity // s
            put(capacity - each * s, {s: each}, left // each)
            if left % each:
                put(capacity - (left % each) * s, {s: left % each}, 1)
    return [f for room in rooms for f in groups[room]]


def solve(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Fillings for a histogram of sizes from 1 to ``capacity``, all pieces placed."""
    h = Histogram(counts)
    fixed = reduce_dominated(h, capacity)
    return fixed + best_fit(h, capacity)


class Places:
    """Where the piece of a given rank within its size goes: container number."""

    def __init__(self, fillings: list[Filling]) -> None:
        starts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        first = 0
        for filling, count in fillings:
            for s, c in filling.items():
                starts[s].append((used[s], first, c))
                used[s] += c * count
            first += count
        self.containers = first
        self.by_size = {s: tuple(np.array(x, np.int64) for x in zip(*l, strict=True)) for s, l in starts.items()}

    def of(self, sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes), np.int64)
        for s in np.unique(sizes):
            if s in self.by_size:
                start, first, each = self.by_size[s]
                at = sizes == s
                i = np.searchsorted(start, ranks[at], "right") - 1
                out[at] = first[i] + (ranks[at] - start[i]) // each[i]
        return out


def pack(sizes: DataFrame, capacities: DataFrame, kinds_at_once: int = 100, rows_per_slice: int = 1_000_000) -> DataFrame:
    """Place every item in a container of each kind: ``bin_kind, doc_id, piece_no, bin_id, start_token, n_tokens``.

    ``sizes``: ``doc_id, size`` (a null size counts as 0; a written table, as it is read
    several times) and, if rows may be equal or ids null, ``salt`` that deals such rows to
    slices; ``capacities``: ``bin_kind, capacity_tokens``, a configuration, solved
    ``kinds_at_once`` kinds in one plan. A kind with a null or non-positive capacity has no
    containers. An item no larger than the capacity is one piece; a larger one is cut
    into full containers of its own and one piece of what remains. Items of size 0 are dealt
    out over the containers. Repeated rows are items of their own; null ids are kept.
    The driver holds a histogram of at most ``capacity`` entries a kind, whatever the number of items.
    """
    kinds = [(r.bin_kind, int(r.capacity_tokens)) for r in capacities.where("capacity_tokens > 0").distinct().orderBy("bin_kind", "capacity_tokens").collect()]
    spark = sizes.sparkSession
    if not kinds:
        return spark.createDataFrame([], "bin_kind string, doc_id bigint, piece_no bigint, bin_id bigint, start_token bigint, n_tokens bigint")
    parts = [_pack(sizes, kinds[i : i + kinds_at_once], rows_per_slice) for i in range(0, len(kinds), kinds_at_once)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pack(sizes: DataFrame, kinds: list[tuple[str, int]], rows_per_slice: int) -> DataFrame:
    spark = sizes.sparkSession
    size = F.coalesce(F.col("size"), F.lit(0))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(c).cast("bigint").alias("cap")) for i, (_, c) in enumerate(kinds)])).alias("k")
    salt = F.col("salt") if "salt" in sizes.columns else F.lit(0)
    items = sizes.select("doc_id", salt.alias("salt"), size.alias("size"), each).select("doc_id", "salt", "k.kind", (F.col("size") % F.col("k.cap")).alias("rest"), F.expr("size div k.cap").alias("full"))
    found = items.groupBy("kind", "rest").agg(F.count("*").alias("n"), F.sum("full").alias("full"), F.count_if(F.col("full") == 0).alias("whole")).collect()
    counts: list[dict[int, int]] = [{} for _ in kinds]
    full, nothing, total = [0] * len(kinds), [0] * len(kinds), 0
    for r in found:
        total += r.n
        full[r.kind] += r.full
        if r.rest:
            counts[r.kind][r.rest] = r.n
        else:
            nothing[r.kind] = r.whole
    places = [Places(solve(counts[i], c)) for i, (_, c) in enumerate(kinds)]
    held = [max(p.containers, 1) if n else p.containers for p, n in zip(places, nothing, strict=True)]

    slices = max(total // rows_per_slice, 16)
    dealt = items.withColumn("slice", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(slices)).cast("int"))
    per = dealt.groupBy("kind", "rest", "slice").agg(F.count("*").alias("n"), F.sum("full").alias("f"))
    before = Window.partitionBy("kind", "rest").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    at = per.select("kind", "rest", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0"))
    # Containers of cut items are numbered by remainder: the remainders before come first.
    tops: list[dict[int, int]] = [{} for _ in kinds]
    for i in range(len(kinds)):
        run = held[i]
        for r in sorted((r for r in found if r.kind == i and r.full), key=lambda r: r.rest):
            tops[i][r.rest] = run
            run += r.full
    w = Window.partitionBy("kind", "rest", "slice").orderBy("doc_id", "full")
    ranked = dealt.join(at, ["kind", "rest", "slice"]).select(
        "kind", "doc_id", "rest", "full",
        (F.col("n0") + F.row_number().over(w) - 1).alias("rank"),
        (F.col("f0") + F.sum("full").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")).alias("f_rank"),
    )

    shared = spark.sparkContext.broadcast((places, held, tops))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, held, tops = shared.value
        for batch in it:
            kind, rest, full_, rank, f_rank = (np.asarray(batch.column(c)) for c in ("kind", "rest", "full", "rank", "f_rank"))
            bin_id, top = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for i in np.unique(kind):
                on = kind == i
                bin_id[on] = np.where(rest[on] > 0, places[i].of(rest[on], rank[on]), rank[on] % max(held[i], 1))
                top[on] = [tops[i].get(int(r), 0) for r in rest[on]]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("doc_id"), batch.column("rest"), batch.column("full"), pa.array(bin_id), pa.array(top + f_rank)], names=["kind", "doc_id", "rest", "full", "bin_id", "top"])

    placed = ranked.mapInArrow(place, "kind int, doc_id bigint, rest bigint, full bigint, bin_id bigint, top bigint")
    name, cap = F.array(*[F.lit(k) for k, _ in kinds])[F.col("kind")], F.array(*[F.lit(c).cast("bigint") for _, c in kinds])[F.col("kind")]
    rest_piece = F.array(F.struct(F.col("full").alias("piece_no"), F.col("bin_id"), (F.col("full") * cap).alias("start_token"), F.col("rest").alias("n_tokens")))
    cut = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("full")), lambda i: F.struct((i - 1).alias("piece_no"), (F.col("top") + i - 1).alias("bin_id"), ((i - 1) * cap).alias("start_token"), cap.alias("n_tokens")))
    pieces = F.when(F.col("full") == 0, rest_piece).when(F.col("rest") == 0, cut).otherwise(F.concat(cut, rest_piece))
    return placed.select(name.alias("bin_kind"), "doc_id", F.explode(pieces).alias("p")).select("bin_kind", "doc_id", "p.*")


def pack_documents(docs: DataFrame, capacities: DataFrame, **tokens) -> DataFrame:  # noqa: ANN003
    """:func:`pack` of documents by their token counts, which are written once to the shared folder, each with the task that counted it to tell equal rows apart."""
    return pack(materialize(token_counts(docs, **tokens).withColumn("salt", F.spark_partition_id()), "sizes"), capacities)


def report(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """By kind: containers used, the least that the tokens need, and the share of space unused."""
    caps = capacities.groupBy("bin_kind").agg(F.max("capacity_tokens").cast("bigint").alias("cap"))
    by = placed.groupBy("bin_kind", "bin_id").agg(F.sum("n_tokens").alias("n")).groupBy("bin_kind").agg(F.count("*").alias("bins"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
    least = F.ceil(F.col("tokens") / F.col("cap"))
    return by.join(caps, "bin_kind").select("bin_kind", "bins", least.alias("least_bins"), "tokens", "fullest", (1 - F.col("tokens") / (F.col("bins") * F.col("cap"))).alias("unused"))
