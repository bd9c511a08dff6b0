"""Near-duplicate vectors by sorted projection passes.

In each pass vectors are ordered by the bits of random projections, and every vector is compared
with a bounded number of those that follow it. A bit tells on which side of the median of its range
a vector lies, so bits halve dense ranges as they do others. Medians come from a sample of the
vectors, and so do the window and the number of passes: from the chance that sampled vectors meet a
partner at the threshold. Pairs that pass the exact check are united over all passes. Within the
components found, links are then counted exactly, tile by tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listweave.llm.components import LINKS, components, star_batches
from listweave.operators.spread import numbered
from listweave.session import pinned

BITS = 62
#: The least and the widest window.
WINDOW = 64
MOST_WINDOW = 4096
BLOCK = 1024
#: Rows that are compared at once.
CHUNK = 256
#: Vectors that give the medians, and how many of them a range has at least.
SAMPLE = 32_768
LEAF = 32
#: Rows and passes from which the passes are planned.
PLAN_ROWS = 4_096
PLAN_PASSES = 16
#: Wanted chance of a miss over all rows, and over the part of rows (one in ...) that meets worst.
MISS = 0.01
HOT_MISS = 0.05
HOT_SHARE = 32
#: Work of a row in a pass besides comparisons, as a number of comparisons.
ROW_WORK = 2_048
TILE_ROWS = 512
PASSES_AT_ONCE = 8
SEED = 11
ERF = np.vectorize(math.erf, otypes=[float])


def planes_of(number: int, size: int, seed: int = SEED) -> np.ndarray:
    """Random directions of one pass, a column per bit."""
    return np.random.default_rng([seed, number, size]).standard_normal((size, BITS))


def medians_of(sample: np.ndarray, planes: np.ndarray) -> list[np.ndarray]:
    """Per bit the threshold of every range: medians while a range holds enough of the sample, then
    means of the last ranges. Without a sample all thresholds are zero."""
    depth = int(math.log2(max(1, len(sample) // LEAF)))
    places = sample @ planes
    node = np.zeros(len(sample), np.int64)
    cuts = []
    for bit in range(depth):
        own = places[:, bit]
        ordered = own[np.lexsort((own, node))]
        counts = np.bincount(node, minlength=1 << bit)
        middle = np.cumsum(counts) - counts + counts // 2
        last = max(0, len(own) - 1)
        cut = (ordered[np.clip(middle - 1, 0, last)] + ordered[np.clip(middle, 0, last)]) / 2
        cuts.append(cut)
        node = 2 * node + (own > cut[node])
    counts = np.maximum(np.bincount(node, minlength=1 << depth), 1)
    for bit in range(depth, BITS):
        cuts.append(np.bincount(node, places[:, bit], 1 << depth) / counts)
    return cuts


def sides(places: np.ndarray, cuts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per bit the thresholds of the rows' ranges, and which rows lie above them."""
    node = np.zeros(len(places), np.int64)
    for bit, cut in enumerate(cuts):
        own = cut[node]
        above = places[:, bit] > own
        yield own, above
        if bit + 1 < len(cuts) and len(cuts[bit + 1]) > len(cut):
            node = 2 * node + above


def projection_keys(
    units: np.ndarray, number: int, seed: int = SEED, cuts: list[np.ndarray] | None = None
) -> np.ndarray:
    """Bits of one pass as a number, the first one highest; signs if there are no thresholds."""
    planes = planes_of(number, units.shape[1], seed)
    key = np.zeros(len(units), np.int64)
    for _, above in sides(units @ planes, cuts or [np.zeros(1)] * BITS):
        key = 2 * key + above
    return key


def meeting(
    units: np.ndarray, planes: np.ndarray, cuts: list[np.ndarray], cosine: float
) -> np.ndarray:
    """Row b: the log of the chance that a partner at the threshold shares the first b bits.

    A partner's place on a random direction is normal around ``cosine`` times the row's own.
    """
    places = units @ planes
    spread = math.sqrt(2 * max(1e-12, 1 - cosine * cosine))
    logs = [np.zeros(len(units))]
    for bit, (cut, above) in enumerate(sides(places, cuts)):
        off = (cosine * places[:, bit] - cut) / spread
        chance = (1 + ERF(np.where(above, off, -off))) / 2
        logs.append(logs[-1] + np.log(np.maximum(chance, 1e-12)))
    return np.array(logs)


def passes_until(misses: np.ndarray) -> int:
    """Passes after which pairs at the threshold are missed with probability ``MISS`` at most, and
    with ``HOT_MISS`` at most among the sampled rows that meet worst. ``misses`` has the log of
    the chance of a miss in one pass."""
    worst = np.sort(misses)[-max(1, len(misses) // HOT_SHARE) :]

    def enough(passes: int) -> bool:
        return (
            np.exp(passes * misses).mean() <= MISS and np.exp(passes * worst).mean() <= HOT_MISS
        )

    high = 1
    while not enough(high):
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def plan(
    samples: dict[int, np.ndarray], counts: dict[int, int], cosine: float, least: int, seed: int
) -> tuple[int, int]:
    """The window, ``least`` or wider, and the number of passes that reach the wanted recall by the
    least work. ``samples`` has unit rows and ``counts`` the number of vectors of each length."""
    logs = {}
    for size, sample in samples.items():
        rows = sample[:PLAN_ROWS]
        logs[size] = []
        for number in range(PLAN_PASSES):
            planes = planes_of(number, size, seed)
            logs[size].append(meeting(rows, planes, medians_of(sample, planes), cosine))
    best = None
    window = least
    while True:
        passes = 1
        for size, found in logs.items():
            bits = min(BITS, math.log2(max(1.0, counts[size] / window)))
            low = int(bits)
            high = min(BITS, low + 1)
            met = [np.exp(x[low] + (bits - low) * (x[high] - x[low])) for x in found]
            misses = np.mean([np.log1p(-np.minimum(m, 1 - 1e-9)) for m in met], axis=0)
            passes = max(passes, passes_until(np.minimum(misses, -1e-9)))
        work = passes * (ROW_WORK + window)
        if best is None or work < best[0]:
            best = work, window, passes
        if 2 * window > MOST_WINDOW:
            return best[1:]
        window *= 2


def sampled(classes: DataFrame, counts: dict[int, int]) -> dict[int, np.ndarray]:
    """Unit rows of about ``SAMPLE`` vectors in all, as many of each length, by their hash."""
    if not counts:
        return {}
    share = max(1, SAMPLE // len(counts))
    shares = F.create_map(*[F.lit(x) for n, c in counts.items() for x in (n, min(1.0, share / c))])
    place = F.pmod(F.xxhash64("vector"), F.lit(1 << 30))
    chosen = (
        classes.filter(place < shares[F.col("dims")] * (1 << 30)).orderBy(place, "node").toArrow()
    )
    dims = chosen["dims"].to_numpy()
    return {
        size: unit_rows(chosen.filter(pa.array(dims == size))["vector"].combine_chunks(), size)
        for size in np.unique(dims).tolist()
    }


def unit_rows(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    rows = column.flatten().to_numpy().astype(np.float64).reshape(-1, size)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vector):
    """Neither null nor zero, and all components finite."""
    finite = F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    nonzero = F.exists(F.col(vector), lambda x: x != 0)
    return F.coalesce(finite & nonzero, F.lit(False))


def window_links(
    units: np.ndarray, cosine: float, window: int, own: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs at or above the threshold of one of the first ``own`` rows and one that
    follows it by a window or little more."""
    left, right = [], []
    step = min(window, CHUNK)
    for start in range(0, own, step):
        rows = units[start : start + step]
        i, j = np.nonzero(rows @ units[start : start + step + window].T >= cosine)
        later = i < j
        left.append(i[later] + start)
        right.append(j[later] + start)
    return np.concatenate(left), np.concatenate(right)


def pass_links(
    classes: DataFrame,
    samples: dict[int, np.ndarray],
    numbers: range,
    cosine: float,
    window: int,
    seed: int,
) -> DataFrame:
    """Links ``(a, b)`` found in some passes over ``classes`` (``node``, ``dims``, ``vector``)."""
    size_of_block = max(BLOCK, 2 * window)
    cuts = {
        (size, number): medians_of(sample, planes_of(number, size, seed))
        for size, sample in samples.items()
        for number in numbers
    }

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for size in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == size))
                units = unit_rows(own.column(2), size)
                for number in numbers:
                    yield pa.record_batch(
                        [
                            pa.array(np.full(len(own), number, np.int32)),
                            pa.array(projection_keys(units, number, seed, cuts.get((size, number)))),
                            *own.columns,
                        ],
                        names=["pass", "key", "node", "dims", "vector"],
                    )

    schema = classes.select(
        F.lit(0).alias("pass"), F.lit(0).cast("bigint").alias("key"), "node", "dims", "vector"
    ).schema
    keyed = classes.mapInArrow(project, schema)
    ranked = numbered(keyed, ["pass", "dims"], [F.col("key"), F.col("node")], "rank")
    place = F.col("rank") - 1
    block = F.floor(place / size_of_block)
    # The first rows of a block are also the last ones of the block before it.
    copied = ranked.withColumn(
        "block",
        F.explode(
            F.when(
                (place % size_of_block < 2 * window) & (block > 0), F.array(block, block - 1)
            ).otherwise(F.array(block))
        ),
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank").combine_chunks()
        units = unit_rows(table["vector"].combine_chunks(), table["dims"][0].as_py())
        node = table["node"].to_numpy()
        following = (table["block"][0].as_py() + 1) * size_of_block
        own = int(np.count_nonzero(table["rank"].to_numpy() <= following))
        i, j = window_links(units, cosine, window, own)
        batches = list(star_batches(iter([(node[i], node[j])] if len(i) else [])))
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        return pa.Table.from_batches(batches, kind)

    return copied.groupBy("pass", "dims", "block").applyInArrow(compare, LINKS)


def link_counts(classes: DataFrame, roots: DataFrame, cosine: float) -> DataFrame:
    """``(node, n_links)``: rows linked to each class in a component, its own copies included.

    The members of a component are cut into tiles by hash, and pairs of tiles are compared whole:
    all links within a component are counted, and only sums leave a task.
    """
    sizes = roots.groupBy("root").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("tiles"))
    members = (
        roots.join(sizes, "root")
        .withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
        .join(classes, "node")
    )
    tiles = pinned(
        members.groupBy("root", "tile", "tiles").agg(
            F.collect_list(F.struct("node", "copies", "dims", "vector")).alias("rows")
        )
    )
    pairs = (
        tiles.select(
            "root", "tile", "rows", F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("other")
        )
        .join(
            tiles.select("root", F.col("tile").alias("other"), F.col("rows").alias("other_rows")),
            ["root", "other"],
        )
        .select((F.col("tile") == F.col("other")).alias("same"), "rows", "other_rows")
    )

    def parts(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, copies, dims, vector = rows.flatten()
        return node.to_numpy(), copies.to_numpy(), unit_rows(vector, dims[0].as_py())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sums = [], []
            for row in range(len(batch)):
                same = batch.column(0)[row].as_py()
                node, copies, left = parts(batch.column(1)[row].values)
                other, other_copies, right = parts(batch.column(2)[row].values)
                linked = left @ right.T >= cosine
                if same:
                    np.fill_diagonal(linked, True)
                nodes.append(node)
                sums.append(linked @ other_copies)
                if not same:
                    nodes.append(other)
                    sums.append(copies @ linked)
            if nodes:
                yield pa.record_batch(
                    [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sums))],
                    names=["node", "n"],
                )

    counted = pairs.mapInArrow(count, "node bigint, n bigint")
    return counted.groupBy("node").agg(F.sum("n").alias("linked"))


def embedding_groups(
    vectors: DataFrame,
    cosine: float = 0.9,
    window: int = WINDOW,
    seed: int = SEED,
    passes: int | None = None,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``vectors``.

    Two rows link if the cosine of their ``embedding`` is ``cosine`` or more; ``component_id`` is
    the smallest ``vec_id`` reachable over links, itself included, and ``kept`` says whether it is
    the row's own. Equal vectors are one class that is compared once and counts with its rows.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different lengths. A component is found if its classes met in some pass; within
    it no link is missed. Null ids count as absent in ``component_id``. Other columns are ignored
    whatever their names. An empty table gives no rows.
    """
    rows = vectors.select("vec_id", "embedding").withColumn("_usable", usable("embedding"))
    classes = pinned(
        rows.filter("_usable")
        .groupBy(F.col("embedding").alias("vector"))
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("lowest"))
        .select(
            F.monotonically_increasing_id().alias("node"),
            F.size("vector").alias("dims"),
            "vector",
            "copies",
            "lowest",
        )
    )
    bare = classes.select("node", "dims", "vector")
    counts = {r["dims"]: r["count"] for r in bare.groupBy("dims").count().collect()}
    samples = sampled(bare, counts)
    planned, total = plan(samples, counts, cosine, window, seed)
    if passes:
        planned, total = window, passes
    found = None
    for first in range(0, total, PASSES_AT_ONCE):
        numbers = range(first, min(total, first + PASSES_AT_ONCE))
        links = pinned(pass_links(bare, samples, numbers, cosine, planned, seed))
        found = links if found is None else found.unionByName(links)
    roots = pinned(components(found))
    linked = link_counts(classes.select("node", "dims", "vector", "copies"), roots, cosine)
    lowest = (
        roots.join(classes, "node").groupBy("root").agg(F.min("lowest").alias("joint"))
    )
    named = roots.join(lowest, "root").join(linked, "node")
    result = pinned(
        classes.join(named.select("node", "joint", "linked"), "node", "left").select(
            "vector",
            (F.coalesce("linked", "copies") - 1).alias("n_links"),
            F.coalesce("joint", "lowest").alias("component_id"),
        )
    )
    joined = rows.filter("_usable").join(result, F.col("embedding") == F.col("vector"))
    alone = rows.filter(~F.col("_usable")).withColumns(
        {"n_links": F.lit(0).cast("bigint"), "component_id": F.col("vec_id")}
    )
    columns = ["vec_id", "n_links", "component_id"]
    return (
        joined.select(*columns)
        .unionByName(alone.select(*columns))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
