"""Vectors in blocks of rows, and training steps that shuffle links and the gradients of blocks, never a vector for each link."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.manifolds import LOSSES, MANIFOLDS, Poincare
from ..tables import saved

#: Bytes of the vectors of one block, and links of one group of them.
BLOCK_BYTES, GROUP_LINKS = 4 << 20, 50_000
#: What a block holds of its rows beside their indices.
STATE = ("x", "m", "v")


def rows_of_block(width: int) -> int:
    """How many rows of `width` numbers a block holds."""
    return max(1, BLOCK_BYTES // (8 * width))


def pack(rows: DataFrame, size: int, columns: dict[str, str]) -> DataFrame:
    """(block int, idx binary, <columns> binary) of rows(idx, <columns>): idx div size is the block, rows in order of idx.

    columns: a NumPy kind for each column, of numbers or arrays of them. A block is one row, and bounded by `size`.
    """

    def run(table):
        import numpy as np
        import pyarrow as pa

        idx = table.column("idx").to_numpy()
        order = np.argsort(idx, kind="stable")
        out = [pa.array([int(idx[0]) // size], pa.int32()), pa.array([idx[order].astype("<i8").tobytes()], pa.binary())]
        for c, kind in columns.items():
            data = table.column(c).combine_chunks()
            m = (data.flatten() if pa.types.is_list(data.type) else data).to_numpy(zero_copy_only=False).astype(kind)
            out.append(pa.array([m.reshape(len(idx), -1)[order].tobytes()], pa.binary()))
        return pa.Table.from_arrays(out, ["block", "idx", *columns])

    kinds = "block int, idx binary, " + ", ".join(f"{c} binary" for c in columns)
    return rows.select(F.floor(F.col("idx") / size).cast("int").alias("_b"), F.col("idx").cast("long").alias("idx"), *columns).groupBy("_b").applyInArrow(run, kinds)


def unpack(blocks: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(idx, <columns> array<double>) of packed blocks; the names of `columns` are those of the blocks."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                idx = np.frombuffer(r["idx"], "<i8")
                lists = []
                for c, kind in columns.items():
                    m = np.frombuffer(r[c], kind).reshape(len(idx), -1)
                    lists.append(pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), m.ravel().astype(float)))
                yield pa.RecordBatch.from_arrays([pa.array(idx.astype(np.int32)), *lists], ["idx", *columns])

    return blocks.mapInArrow(run, "idx int, " + ", ".join(f"{c} array<double>" for c in columns))


class AtHand:
    """The rows of the blocks that a task holds, by index."""

    def __init__(self, blocks: list[dict], tiers: int):
        import numpy as np

        blocks = sorted(blocks, key=lambda r: r["block"])
        parts = [np.frombuffer(r["idx"], "<i8") for r in blocks]
        self.block = np.repeat([r["block"] for r in blocks], [len(p) for p in parts])
        self.idx = np.concatenate(parts)
        self.x = np.concatenate([np.frombuffer(r["x"], "<f8").reshape(len(p), -1) for r, p in zip(blocks, parts)])
        self.pools = []
        if tiers:
            keys = np.concatenate([np.frombuffer(r["pools"], "<i8").reshape(len(p), -1) for r, p in zip(blocks, parts)])
            for t in range(tiers):
                order = np.argsort(keys[:, t], kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                self.pools.append((keys[:, t], order, keys[order, t], place))

    def find(self, ids):
        import numpy as np

        at = np.minimum(np.searchsorted(self.idx, ids), len(self.idx) - 1)
        if not (self.idx[at] == ids).all():
            raise ValueError(f"no vector has the index {ids[self.idx[at] != ids][0]}")
        return at

    def draw(self, rng, desc, k: int, last: list[int]):
        """(n, k) places of negatives of the rows at `desc`: draw d (from 0) comes from the first tier whose last number is above
        d and that has another row of the same pool, else from any other row at hand."""
        import numpy as np

        out = np.full((len(desc), k), -1, np.int64)
        low = 0
        ranges = [(t, a, min(b, k)) for t, a, b in zip(range(len(last)), [0, *last], last) if a < k]
        for t, low, high in ranges + ([(len(last) - 1, 0, k)] if last else []):  # what is left asks the last tier once more
            keys, order, ordered, place = self.pools[t]
            first = np.searchsorted(ordered, keys[desc], "left")
            others = np.searchsorted(ordered, keys[desc], "right") - first - 1
            r, d = np.nonzero((out[:, low:high] < 0) & ((others > 0) & (keys[desc] != 0))[:, None])
            j = (rng.random(len(r)) * others[r]).astype(np.int64)
            j += first[r] + (j >= place[desc[r]] - first[r])  # past the row itself
            out[r, low + d] = order[j]
        r, d = np.nonzero(out < 0)
        j = (rng.random(len(r)) * (len(self.idx) - 1)).astype(np.int64)
        out[r, d] = j + (j >= desc[r])
        return out


def group_gradients(links: dict, at: AtHand, manifold: Poincare, loss, negatives: int, last: list[int], seed: list[int]) -> tuple:
    """(places, gradients, losses) of links with ancestor, descendant, margin, weight and, or else drawn, an (n, k) array of
    negatives. Each place comes once: rows of a place are sorted together and added up as one stretch."""
    import numpy as np

    a, d = at.find(links["ancestor_idx"]), at.find(links["descendant_idx"])
    if links.get("negatives") is not None:
        n = at.find(links["negatives"].ravel()).reshape(len(a), -1)
    elif len(at.idx) < 2:
        return np.zeros(0, np.int64), np.zeros((0, at.x.shape[1])), np.zeros(len(a))
    else:
        n = at.draw(np.random.default_rng(seed), d, negatives, last)
    losses, parts = np.zeros(len(a)), []
    for lo in range(0, len(a), 4096):
        cut = slice(lo, lo + 4096)
        losses[cut], ga, gd, gn = loss(manifold, at.x[a[cut]], at.x[d[cut]], at.x[n[cut]], links["margin"][cut], links["weight"][cut])
        parts.append(_added(np.concatenate([a[cut], d[cut], n[cut].ravel()]), np.concatenate([ga, gd, gn.reshape(-1, gn.shape[2])])))
    places, grads = _added(*(np.concatenate(x) for x in zip(*parts)))
    return places, grads, losses


def _added(places, rows):
    """Different places in order, and the sum of the rows of each."""
    import numpy as np

    order = np.argsort(places, kind="stable")
    places = places[order]
    first = np.nonzero(np.r_[True, places[1:] != places[:-1]])[0]
    return places[first], np.add.reduceat(rows[order], first)


def _groups(links: DataFrame, size: int, n_blocks: int, seed: int) -> DataFrame:
    """links with ba, bd, slot, extra: the blocks of both ends, a share of about GROUP_LINKS of their links, and the block that
    such a share draws from besides. A pair of blocks that most links join has many shares."""
    both = links.withColumns({"ba": F.floor(F.col("ancestor_idx") / size).cast("int"), "bd": F.floor(F.col("descendant_idx") / size).cast("int")})
    counts = both.groupBy("ba", "bd").agg(F.ceil(F.count("*") / F.lit(GROUP_LINKS)).alias("_shares"))
    both = both.join(counts, ["ba", "bd"]).withColumn("slot", F.pmod(F.xxhash64("ancestor_idx", "descendant_idx", F.lit(seed)), F.col("_shares")).cast("int")).drop("_shares")
    return both.withColumn("extra", F.pmod(F.xxhash64("ba", "bd", "slot", F.lit(seed)), F.lit(n_blocks)).cast("int"))


def block_gradients(links: DataFrame, blocks: DataFrame, manifold: str = "poincare", loss: str = "ranking", negatives: int = 0, last: list[int] | None = None, size: int = 0, n_blocks: int = 1, seed: int = 0, k: float = 0.1) -> DataFrame:
    """(block, place binary, g binary, loss, n): gradients of each touched block, one row for each task that touched it.

    links(ancestor_idx, descendant_idx, margin, weight) and either negatives array<int>, as many on every row, or `negatives`
    to draw: from rows of the blocks at hand, which are those of both ends and one that a hash picks for each share of
    their links and `seed`, in the tiers of the blocks' `pools` column (see AtHand.draw). blocks are packed rows of
    (x, pools) with `size` rows a block. A share's links meet its blocks in one task; a task adds up the gradients of all
    its shares before they leave it, so what is shuffled is links once, blocks once a share, and gradients of blocks.
    """
    given = "negatives" in links.columns
    grouped = _groups(links, size, n_blocks, seed)
    key = ["ba", "bd", "slot"]
    more = F.transform("negatives", lambda i: F.floor(i / size).cast("int")) if given else F.array("extra")
    theirs = [F.col(c).alias(f"_{c}") for c in key]
    wanted = grouped.select(*theirs, F.explode(F.array_distinct(F.concat(F.array("ba", "bd"), more))).alias("block")).distinct()
    held = wanted.join(blocks.select("block", "idx", "x", *([] if given else ["pools"])), "block")
    tiers = list(last or [])
    rule, space = LOSSES[loss], MANIFOLDS[manifold](k)

    def run(links, held):
        import numpy as np
        import pyarrow as pa

        kinds = [("block", pa.int32()), ("place", pa.binary()), ("g", pa.binary()), ("loss", pa.float64()), ("n", pa.int64())]
        if not links.num_rows:
            return pa.schema(kinds).empty_table()
        links = links.sort_by([("ancestor_idx", "ascending"), ("descendant_idx", "ascending")])
        at = AtHand(held.to_pylist(), 0 if given else len(tiers))
        c = {x: links.column(x).to_numpy() for x in ("ancestor_idx", "descendant_idx", "margin", "weight")}
        if given:
            c["negatives"] = links.column("negatives").combine_chunks().flatten().to_numpy().reshape(links.num_rows, -1)
        share = [seed, *[links.column(x)[0].as_py() for x in key]]
        places, g, losses = group_gradients(c, at, space, rule, negatives, tiers, share)
        starts = np.searchsorted(at.block, at.block[places])  # where a row's block begins among those at hand
        rows = []
        for b in np.unique(at.block[places]):
            own = at.block[places] == b
            rows.append((int(b), (places[own] - starts[own]).astype("<i4").tobytes(), g[own].astype("<f8").tobytes(), 0.0, 0))
        rows.append((int(at.block[0]), b"", b"", float(losses.sum()), links.num_rows))
        return pa.Table.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    # links are few bytes and much work: without a number of its own, Spark would put them all into one task
    grouped = grouped.repartition(2 * links.sparkSession.sparkContext.defaultParallelism, *key)
    grads = grouped.groupBy(*key).cogroup(held.groupBy(*[f"_{c}" for c in key])).applyInArrow(run, GRADIENTS)
    return grads.mapInArrow(_combined, GRADIENTS)


GRADIENTS = "block int, place binary, g binary, loss double, n long"


def _combined(batches: Iterator) -> Iterator:
    """The gradients of a task's groups, added up by block; what is held is written out beyond 64 MB."""
    import numpy as np
    import pyarrow as pa

    def out():
        rows = [(b, p.astype("<i4").tobytes(), g.astype("<f8").tobytes(), *facts[b]) for b, (p, g) in ((b, _merged(v)) for b, v in held.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.int64()))], ["block", "place", "g", "loss", "n"])

    held, facts, total = {}, {}, 0
    for batch in batches:
        for r in batch.to_pylist():
            place = np.frombuffer(r["place"], "<i4")
            g = np.frombuffer(r["g"], "<f8").reshape(len(place), -1) if len(place) else np.zeros((0, 0))
            held.setdefault(r["block"], []).append((place, g))
            old = facts.get(r["block"], (0.0, 0))
            facts[r["block"]] = (old[0] + r["loss"], old[1] + r["n"])
            total += g.nbytes
            if total > 64 << 20:
                yield from out()
                held, facts, total = {}, {}, 0
    if held:
        yield from out()


def _merged(parts: list[tuple]) -> tuple:
    import numpy as np

    parts = [p for p in parts if len(p[0])]
    if not parts:
        return np.zeros(0, np.int32), np.zeros((0, 0))
    return _added(*(np.concatenate(x) for x in zip(*parts)))


def gradient_rows(grads: DataFrame, width: int) -> DataFrame:
    """(block, place, g array<double>) of the whole sums: for tests and reports."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        p, g = _merged([(np.frombuffer(r["place"], "<i4"), np.frombuffer(r["g"], "<f8").reshape(-1, width)) for r in table.to_pylist()])
        return pa.Table.from_arrays([pa.array([table.column("block")[0].as_py()] * len(p), pa.int32()), pa.array(p, pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], ["block", "place", "g"])

    return grads.groupBy("block").applyInArrow(run, "block int, place int, g array<double>")


def adam_blocks(blocks: DataFrame, grads: DataFrame, step: int, rate: float, radial: float, n: int, manifold: str = "poincare", clip: float = 1.0, riemannian: bool = False, k: float = 0.1) -> tuple[DataFrame, float, int]:
    """(new blocks, loss, links): one step of Adam with dense moments; gradients get the pull to the target radius, are clipped by
    their global norm, and points are put back where vectors may lie. Blocks stay one row each; only gradients and
    their own blocks meet."""
    space = MANIFOLDS[manifold](k)
    whole = "block int, idx binary, target binary, pools binary, x binary, m binary, v binary, g binary, squares double, loss double, n long"

    def total(block, grads):
        import numpy as np
        import pyarrow as pa

        rows, parts = block.to_pylist(), grads.to_pylist()
        r = rows[0]
        x = np.frombuffer(r["x"], "<f8").reshape(len(r["idx"]) // 8, -1)
        g = np.zeros_like(x)
        for p in parts:
            place = np.frombuffer(p["place"], "<i4")  # each once in a part
            if len(place):
                g[place] += np.frombuffer(p["g"], "<f8").reshape(len(place), -1)
        if radial:
            norm = np.sqrt((x * x).sum(1))
            g += ((2 * radial / n) * (norm - np.frombuffer(r["target"], "<f8")) / np.maximum(norm, 1e-8))[:, None] * x
        if riemannian:
            g = space.riemannian(x, g)
        r |= {"g": g.tobytes(), "squares": float((g * g).sum()), "loss": sum(p["loss"] for p in parts), "n": sum(p["n"] for p in parts)}
        return pa.Table.from_pylist([r], schema=schema_of(whole))

    met = saved(blocks.groupBy("block").cogroup(grads.groupBy("block")).applyInArrow(total, whole), "sums")
    one = met.agg(F.sqrt(F.sum("squares")).alias("norm"), F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
    shrink = min(1.0, clip / ((one["norm"] or 0.0) + 1e-6))
    state = "block int, idx binary, target binary, pools binary, x binary, m binary, v binary"

    def move(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                x, m, v, g = (np.frombuffer(r[c], "<f8").reshape(len(r["idx"]) // 8, -1) for c in ("x", "m", "v", "g"))
                g = g * shrink
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                by = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                r |= {"x": space.settle(x - by).tobytes(), "m": m.tobytes(), "v": v.tobytes()}
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in state.replace(",", "").split(" ")[::2]}], schema=schema_of(state))

    return saved(met.mapInArrow(move, state), "state"), float(one["loss"] or 0.0), int(one["n"] or 0)


def schema_of(kinds: str):
    import pyarrow as pa

    of = {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "long": pa.int64()}
    return pa.schema([(n, of[t]) for n, t in (x.split(" ") for x in kinds.split(", "))])


class Versions:
    """Blocks of which a step writes only those it changed: the newest row of each block counts.

    Which step holds a block's newest row is one number a block, kept by the driver like a list of files. After `most` steps
    all blocks are written anew, so a read never opens more folders.
    """

    def __init__(self, blocks: DataFrame, most: int = 16):
        self.tables = {0: saved(blocks, "blocks")}
        self.newest = {r.block: 0 for r in self.tables[0].select("block").collect()}
        self.most, self.step, self.written = most, 0, []

    def current(self) -> DataFrame:
        out = None
        for step, table in self.tables.items():
            own = [b for b, s in self.newest.items() if s == step]
            if own:
                part = table.where(F.col("block").isin(own))
                out = part if out is None else out.unionByName(part)
        return out

    def put(self, changed: DataFrame) -> int:
        """Takes blocks over the older ones; how many there were."""
        self.step += 1
        self.tables[self.step] = saved(changed, "blocks")
        new = [r.block for r in self.tables[self.step].select("block").collect()]
        self.newest |= dict.fromkeys(new, self.step)
        self.written.append(len(new))
        if len(self.tables) > self.most:
            self.tables = {self.step: saved(self.current(), "blocks")}
            self.newest = dict.fromkeys(self.newest, self.step)
        return len(new)


def descend(versions: Versions, grads: DataFrame, rate: float, manifold: str = "poincare", k: float = 0.1, clear: bool = False) -> tuple[float, int]:
    """(loss, links) of a step of Riemannian gradient descent: touched rows move against their gradient under the metric, along
    the manifold's own map. Blocks without a gradient are neither read nor written. With `clear`, points of cones are kept
    outside the inner radius."""
    space = MANIFOLDS[manifold](k)
    grads = saved(grads, "grads")
    one = grads.agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
    touched = [r.block for r in grads.where(F.octet_length("place") > 0).select("block").distinct().collect()]
    blocks = versions.current().where(F.col("block").isin(touched))
    columns = blocks.columns
    kinds = ", ".join(f"{c} {'int' if c == 'block' else 'binary'}" for c in columns)

    def move(block, grads):
        import numpy as np
        import pyarrow as pa

        r = block.to_pylist()[0]
        x = np.frombuffer(r["x"], "<f8").reshape(len(r["idx"]) // 8, -1).copy()
        place, g = _merged([(np.frombuffer(p["place"], "<i4"), np.frombuffer(p["g"], "<f8").reshape(-1, x.shape[1])) for p in grads.to_pylist()])
        if len(place):
            p = space.settle(x[place])
            p = space.move(p, -rate * space.riemannian(p, g))
            x[place] = space.outside(p) if clear and hasattr(space, "outside") else p
        return pa.Table.from_pylist([r | {"x": x.tobytes()}], schema=schema_of(kinds))

    if touched:
        versions.put(blocks.groupBy("block").cogroup(grads.where(F.col("block").isin(touched)).groupBy("block")).applyInArrow(move, kinds))
    return float(one["loss"] or 0.0), int(one["n"] or 0)


def pool_keys(tiers: list[tuple[str, list[str], int]]) -> Column:
    """An array with a number for each tier that rows of one pool share; 0 where a column of the tier is null."""
    some = lambda by: F.when(F.expr(" or ".join(f"{c} is null" for c in by)), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit("pool"), *by))
    return F.array(*[some(by) for _, by, _ in tiers])
