"""Product codes of vectors: k-means by parts over anchors hierarchies of balls.

Vectors are cut into equal parts, each with a codebook of its own. The rows of a task are
taken in blocks, and over every part of a block a metric tree of balls is built once,
middle-out: anchors (points far from each other) take over the points that lie nearer to
them, neighbouring balls are joined upwards, and large anchors are divided again downwards.
A ball keeps the sum and the number of its points. In a round the entries that may be
nearest to a point of a ball are handed down as its candidates; an entry leaves the list
once another is nearer to the whole ball. A ball with one candidate left gives its cached
sum at once, and only the points of undecided leaves are compared one by one. All distances
are integers; bounds that hold radii are rounded so that no entry is dropped wrongly.

The trees are written once and read in every round; a round sends one row per part,
entry and position of a task to an aggregation, and its sums make the next codebooks.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tidewatch.llm.common import written
from tidewatch.llm.vectors import batch_map, integer_rows, lists

LEAF = 24
#: Components of a block, at most: a block of vectors with 64 of them has 4,096 rows.
BLOCK = 1 << 18
_FAR = np.iinfo(np.int64).max


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, by broadcasting."""
    gap = a - b
    return (gap * gap).sum(axis=-1)


# ---- the tree -------------------------------------------------------------------


def anchors(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The anchor of every point within its segment (segments are runs of points, given by their starts).

    A segment of m points gets up to about sqrt(m) anchors, its first point being one. The
    next is the point farthest from its own anchor, and it takes the points that lie nearer
    to it. A point cannot be taken while the two anchors are over twice as far apart as it
    is from its own.
    """
    sizes = np.diff(np.append(starts, len(points)))
    segment = np.repeat(np.arange(len(starts)), sizes)
    wanted = np.ceil(np.sqrt(sizes)).astype(int)
    pivot = starts[segment]
    own = np.zeros(len(points), dtype=np.int64)
    dist = squared(points, points[pivot])
    for number in range(1, int(wanted.max())):
        radius = np.maximum.reduceat(dist, starts)
        farthest = np.flatnonzero((dist == radius[segment]) & (dist > 0) & (wanted[segment] > number))
        if not len(farthest):
            break
        segments, first = np.unique(segment[farthest], return_index=True)
        new = np.full(len(starts), -1)
        new[segments] = farthest[first]
        to = new[segment]
        within = np.flatnonzero(to >= 0)
        apart = squared(points[pivot[within]], points[to[within]])
        near = within[4 * dist[within] > apart]
        there = squared(points[near], points[to[near]])
        taken = there < dist[near]
        moved = near[taken]
        own[moved], pivot[moved], dist[moved] = number, to[moved], there[taken]
    return own


def joined(centres: np.ndarray, sizes: np.ndarray, radii: np.ndarray) -> list[tuple[int, int]]:
    """The order in which balls are joined: each time the two whose common ball is smallest. The
    new ball takes the first one's place."""
    c, n, r = centres.astype(float), sizes.astype(float), radii.astype(float)
    k = len(c)

    def common(i):
        apart = np.sqrt(((c - c[i]) ** 2).sum(axis=1))
        share = n / (n + n[i])
        return np.maximum(share * apart + r[i], (1 - share) * apart + r)

    cost = np.array([common(i) for i in range(k)])
    np.fill_diagonal(cost, np.inf)
    pairs = []
    for _ in range(k - 1):
        i, j = divmod(int(cost.argmin()), k)
        pairs.append((i, j))
        r[i] = cost[i, j]
        c[i] = (c[i] * n[i] + c[j] * n[j]) / (n[i] + n[j])
        n[i] += n[j]
        cost[j, :] = cost[:, j] = np.inf
        row = np.where(np.isinf(cost[i]), np.inf, common(i))
        row[i] = np.inf
        cost[i, :] = cost[:, i] = row
    return pairs


def tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """The balls over the points of one part. ``order`` sorts the points so that a ball's lie together,
    from ``low`` to ``high``; ``left`` is -1 at leaves; ball 0 holds all points."""
    children: list[tuple[int, int] | None] = [None]
    members: dict[int, np.ndarray] = {0: np.arange(len(points))}
    todo = [0]
    while todo := [v for v in todo if len(members[v]) > LEAF]:
        at = np.concatenate([members[v] for v in todo])
        starts = np.cumsum([0] + [len(members[v]) for v in todo])[:-1]
        own = anchors(points[at], starts)
        following = []
        for v, first in zip(todo, starts):
            mine = members[v]
            number = own[first : first + len(mine)]
            if not number.any():
                continue  # equal points
            sort = np.argsort(number, kind="stable")
            mine, number = mine[sort], number[sort]
            begin = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            groups = np.split(mine, begin[1:])
            size = np.array([len(g) for g in groups])
            centres = np.add.reduceat(points[mine].astype(float), begin) / size[:, None]
            away = np.sqrt(squared(points[mine].astype(float), np.repeat(centres, size, axis=0)))
            ball = list(range(len(children), len(children) + len(groups)))
            children += [None] * len(groups)
            members.update(zip(ball, groups))
            following += ball
            pairs = joined(centres, size, np.maximum.reduceat(away, begin))
            for k, (i, j) in enumerate(pairs):
                if k == len(pairs) - 1:
                    children[v] = (ball[i], ball[j])
                else:
                    children.append((ball[i], ball[j]))
                    ball[i] = len(children) - 1
            del members[v]
        todo = following
    low, high = np.zeros(len(children), dtype=np.int64), np.zeros(len(children), dtype=np.int64)
    order, placed, stack = [], 0, [(0, False)]
    while stack:
        v, done = stack.pop()
        if children[v] is None:
            low[v], placed = placed, placed + len(members[v])
            high[v] = placed
            order.append(members[v])
        elif done:
            low[v], high[v] = low[children[v][0]], high[children[v][1]]
        else:
            stack += [(v, True), (children[v][1], False), (children[v][0], False)]
    order = np.concatenate(order)
    points = points[order]
    sums = np.zeros((len(points) + 1, points.shape[1]), dtype=np.int64)
    np.cumsum(points, axis=0, out=sums[1:])
    total, size = sums[high] - sums[low], high - low
    centre = total // size[:, None]
    begin = np.cumsum(size) - size
    covered = np.arange(size.sum()) - np.repeat(begin - low, size)  # the points of all balls, one after the other
    reach = np.maximum.reduceat(squared(points[covered], np.repeat(centre, size, axis=0)), begin)
    ends = np.array([c or (-1, -1) for c in children], dtype=np.int64)
    return {
        "points": points, "order": order, "low": low, "high": high, "left": ends[:, 0], "right": ends[:, 1],
        "centre": centre, "radius": np.nextafter(np.sqrt(reach.astype(float)), np.inf), "sums": total,
    }


# ---- a round over a tree --------------------------------------------------------


def owners(balls: dict[str, np.ndarray], entries: np.ndarray):
    """Yields ("balls", ids, entries) for balls owned by one entry, and ("points", positions, entries) for the
    points of undecided leaves. Every point is in one of them; of equally near entries the first owns."""
    apart = np.sqrt(squared(entries[:, None], entries[None]).astype(float))
    first = np.array([not (entries[:i] == e).all(axis=1).any() for i, e in enumerate(entries)])  # copies never own
    front, lists_ = np.zeros(1, dtype=np.int64), first[None]
    while len(front):
        away = squared(balls["centre"][front][:, None], entries[None])
        best = np.where(lists_, away, _FAR).argmin(axis=1)
        rows = np.arange(len(front))
        # over the whole ball, the nearest entry wins against another by at least this much
        lead = away - away[rows, best][:, None] - 2 * balls["radius"][front][:, None] * apart[best]
        lists_ = lists_ & (lead <= 1 + 1e-9 * away)
        lists_[rows, best] = True
        owned = lists_.sum(axis=1) == 1
        if owned.any():
            yield "balls", front[owned], best[owned]
        leaf = ~owned & (balls["left"][front] < 0)
        if leaf.any():
            low, size = balls["low"][front[leaf]], (balls["high"] - balls["low"])[front[leaf]]
            at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
            near = np.where(np.repeat(lists_[leaf], size, axis=0), squared(balls["points"][at][:, None], entries[None]), _FAR)
            yield "points", at, near.argmin(axis=1)
        inner = ~owned & ~leaf
        front = np.concatenate([balls["left"][front[inner]], balls["right"][front[inner]]])
        lists_ = np.concatenate([lists_[inner], lists_[inner]])


def sums_by_entry(balls: dict[str, np.ndarray], entries: np.ndarray) -> np.ndarray:
    """For every entry, the number of its points and their sums by position."""
    out = np.zeros((len(entries), 1 + entries.shape[1]), dtype=np.int64)
    for what, at, entry in owners(balls, entries):
        if what == "balls":
            np.add.at(out, entry, np.column_stack([(balls["high"] - balls["low"])[at], balls["sums"][at]]))
        else:
            np.add.at(out, entry, np.column_stack([np.ones(len(at), np.int64), balls["points"][at]]))
    return out


def assigned(balls: dict[str, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every point, in the block's order."""
    entry = np.zeros(len(balls["order"]), dtype=np.int64)
    for what, at, e in owners(balls, entries):
        if what == "balls":
            for v, k in zip(at, e):
                entry[balls["low"][v] : balls["high"][v]] = k
        else:
            entry[at] = e
    back = np.argsort(balls["order"])
    return entry[back], squared(balls["points"], entries[entry])[back]


# ---- on Spark -------------------------------------------------------------------


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{k: a if k in ("sums", "radius") else a.astype(np.int32) for k, a in arrays.items()})
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    arrays = np.load(io.BytesIO(data))
    return {k: a.astype(np.int64) if a.dtype == np.int32 else a for k, a in ((k, arrays[k]) for k in arrays.files)}


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end; the last ones are shorter if the length is no multiple."""
    width = -(-dim // parts)
    return [(min(dim, i * width), min(dim, (i + 1) * width)) for i in range(parts)]


def forest_of_blocks(rows: DataFrame, dim: int, parts: int) -> DataFrame:
    """One row per block: the ids and labels of its vectors, and a tree for each part; written once."""
    schema = StructType([
        StructField("vec_ids", ArrayType(rows.schema["vec_id"].dataType)),
        StructField("labels", ArrayType(rows.schema["label"].dataType)),
        StructField("trees", ArrayType(BinaryType())),
    ])
    full, places = max(1, BLOCK // max(1, dim)), cuts(dim, parts)

    def build(batches):
        import pyarrow as pa

        def block(held):
            table = pa.Table.from_batches(held).combine_chunks()
            x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(table), dim)

            def one(name):
                return pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table[name].combine_chunks())

            return {"vec_ids": one("vec_id"), "labels": one("label"), "trees": [[_packed(tree(x[:, a:z])) for a, z in places]]}

        held, n = [], 0
        for batch in batches:
            while n + batch.num_rows >= full:
                yield block([*held, batch.slice(0, full - n)])
                batch, held, n = batch.slice(full - n), [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield block(held)

    return written(batch_map(rows.select("vec_id", "label", "x"), build, schema))


def next_codebooks(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: assign every part, and move each entry that has parts to the floor of their mean."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def sums(batches):
        total = None
        for batch in batches:
            for trees in batch.column(0).to_pylist():
                got = [sums_by_entry(_unpacked(t), e) for t, e in zip(trees, shared.value)]
                total = got if total is None else [a + b for a, b in zip(total, got)]
        for part, table in enumerate(total or []):
            entry, place = np.indices(table.shape)
            yield {"part": np.full(table.size, part, np.int32), "entry": entry.ravel(), "place": place.ravel(), "s": table.ravel()}

    schema = StructType.fromDDL("part int, entry int, place int, s long")
    partial = batch_map(blocks.select("trees"), sums, schema)
    # parts x entries x positions numbers; decimals, as a sum over all rows may leave the range of a long
    rows = partial.groupBy("part", "entry", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {(r["part"], r["entry"], r["place"]): int(r["s"]) for r in rows}
    out = []
    for p, book in enumerate(books):
        n = [found.get((p, e, 0), 0) for e in range(len(book))]
        moved = [[found[p, e, 1 + i] // n[e] for i in range(book.shape[1])] if n[e] else book[e].tolist() for e in range(len(book))]
        out.append(np.array(moved, dtype=np.int64).reshape(book.shape))
    return out


def digest(books: list[np.ndarray]) -> str:
    text = ",".join(str(c) for book in books for entry in book.tolist() for c in entry)
    return hashlib.sha256(text.encode()).hexdigest()


def compress(
    vectors: DataFrame, vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, few_labels: int = 50_000
) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every vector, and the codebooks.

    Components become floor(scale * x). Rows whose vector is NULL or holds a NULL or non-finite
    component are dropped, as are those of another length than most (see ``integer_rows``, also for
    the range of components). Every part's codebook starts with the rows of the smallest ids (NULL
    last, then by the vector; all rows if there are fewer) and takes ``rounds`` rounds. Repeated ids
    and rows are rows like any other. Where the parts are no whole number of components the last
    ones are shorter. Labels, NULL being one of them, are joined from a broadcast table up to
    ``few_labels`` of them, and by a shuffled join beyond, with the same result.
    """
    rows, dim = integer_rows(vectors, vector, scale, 0, ["vec_id", "label"])
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    begin = np.array([r["x"] for r in start], dtype=np.int64).reshape(len(start), dim)
    books = [begin[:, a:z] for a, z in cuts(dim, parts)]
    blocks = forest_of_blocks(rows, dim, parts)
    for _ in range(rounds if len(start) else 0):
        books = next_codebooks(blocks, books)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def coded(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                trees = batch.column(2).slice(i, 1).to_pylist()[0]
                got = [assigned(_unpacked(t), e) for t, e in zip(trees, shared.value)]
                digits = np.column_stack([e for e, _ in got]).astype(np.uint8)
                yield {
                    "vec_id": batch.column(0).slice(i, 1).flatten(), "label": batch.column(1).slice(i, 1).flatten(),
                    "code": [r.tobytes().hex() for r in digits], "error": sum(d for _, d in got),
                }

    schema = StructType([rows.schema["vec_id"], rows.schema["label"], *StructType.fromDDL("code string, error long").fields])
    codes = written(batch_map(blocks, coded, schema))
    by_label = written(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    if by_label.count() <= few_labels:
        by_label = F.broadcast(by_label)
    out = codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return out.withColumn("codebooks_sha256", F.lit(digest(books))), books
