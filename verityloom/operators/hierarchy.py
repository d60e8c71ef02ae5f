"""Trees from parent links: paths, depths, roots and nested-set ranges, with the cycles laid bare.

Subtree sizes are summed upward, sibling ranges in preorder are allotted downward by prefix sums, and ancestors are read
off the ranges: a node's depth is the number of ranges open at its position, its root the outermost of them. Nodes that no
line brings to a root stay unprocessed; they lie on a ring or hang below one.

The work is done in chunks of bounded size, laid out by columns that related nodes share, so that most links stay inside a
chunk. What leaves a chunk is one group per (chunk, parent outside it), however many children hang on that parent. The
groups form a tree of their own, solved in one chunk if they fit and else by pointer doubling, and enter the chunk of
their parent as leaves of known size: nothing but groups is ever moved along a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verityloom.session import cut_lineage

CHUNK = 1 << 18  # nodes that a task holds at a time


def _links(nodes: DataFrame, node_id: str, edges: DataFrame, child: str, parent: str, near: str | None) -> DataFrame:
    """(v, near, parent) of every node; links from or to anything that is no node are dropped, of several parents the least id stays."""
    by = F.col(near).cast("string") if near else F.lit(None).cast("string")
    v = nodes.select(
        F.col(node_id).cast("string").alias("v"), by.alias("near")
    ).where("v is not null").groupBy("v").agg(F.min("near").alias("near"))
    e = edges.select(
        F.col(child).cast("string").alias("c"), F.col(parent).cast("string").alias("p")
    ).where("c is not null and p is not null")
    e = e.join(v.select(F.col("v").alias("p")), "p", "left_semi").groupBy("c").agg(F.min("p").alias("parent"))
    return v.join(e, F.col("v") == F.col("c"), "left").select("v", "near", "parent")


def ends_of(par: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the node that each line ends at, or one on its ring; whether it never ends) from indices of parents, -1 for none."""
    at = np.where(par >= 0, par, np.arange(len(par)))
    for _ in range(len(par).bit_length() + 1):
        at = at[at]
    return at, par[at] >= 0


def least_of_ring(par: np.ndarray, at: np.ndarray, endless: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least value on the ring that each endless node runs into; value itself for the others."""
    m, anc = value.copy(), par
    i = np.flatnonzero(endless)
    for _ in range(len(i).bit_length() + 1):
        m[i] = np.minimum(m[i], m[anc[i]])
        anc = np.where(endless, anc[anc], anc)
    return np.where(endless, m[at], value)


def along(par: np.ndarray, value: np.ndarray, join) -> np.ndarray:
    """value joined over every line from the node to its end; lines must end."""
    x, anc = value.copy(), par.copy()
    while (i := np.flatnonzero(anc >= 0)).size:
        x[i] = join(x[i], x[anc[i]])
        anc[i] = anc[anc[i]]
    return x


def below(par: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of weight over every subtree; lines must end. A round doubles the depth that is covered."""
    size, anc = weight.astype(np.int64), par.copy()
    while (i := np.flatnonzero(anc >= 0)).size:
        more = size.copy()
        np.add.at(more, anc[i], size[i])
        size = more
        anc[i] = anc[anc[i]]
    return size


def before(par: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sizes of the siblings that come before, in the order of their index; trees without a parent are siblings."""
    order = np.argsort(par, kind="stable")
    run = np.cumsum(size[order]) - size[order]
    first = np.r_[True, np.diff(par[order]) != 0] if len(par) else np.zeros(0, dtype=bool)
    out = np.empty_like(size)
    out[order] = run - np.maximum.accumulate(np.where(first, run, 0))
    return out


def _strings(c: pa.ChunkedArray | pa.Array) -> pa.Array:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.cast(pa.large_string())


def _at(wanted: pa.Array, among: pa.Array) -> np.ndarray:
    return pc.fill_null(
        pc.index_in(wanted, value_set=among, skip_nulls=True), -1
    ).to_numpy(zero_copy_only=False).astype(np.int64)


def _pick(a: pa.Array, at: np.ndarray, use: np.ndarray) -> pa.Array:
    return a.take(pa.array(at, mask=~use)) if len(at) else a.slice(0, 0)


def _contract(chunk: int):
    """Chunks of links: each node with the parent outside the chunk that its line leaves by (g), or the root of its ring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def flush(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            v, parent = _strings(t["v"]), _strings(t["parent"])
            order = pc.sort_indices(v)
            v, parent = v.take(order), parent.take(order)
            par = _at(parent, v)
            at, endless = ends_of(par)
            every = np.arange(len(par))
            least = along(np.where(endless, -1, par), every, np.minimum)
            ring = least_of_ring(par, at, endless, every)
            cols = [
                pa.array(np.full(len(v), number)), v, parent, _pick(parent, at, ~endless), v.take(pa.array(least)),
                _pick(v, ring, endless)
            ]
            yield from pa.Table.from_arrays(
                [c if i == 0 else c.cast(pa.string()) for i, c in enumerate(cols)],
                names=["chunk", "v", "parent", "g", "least", "ring"]
            ).to_batches(max_chunksize=1 << 14)

        held, n = [], 0
        for b in batches:
            while n + b.num_rows >= chunk:
                held.append(b.slice(0, chunk - n))
                yield from flush(held, number)
                b, held, n, number = b.slice(chunk - n), [], 0, number + 1
            held.append(b)
            n += b.num_rows
        if n:
            yield from flush(held, number)

    return run


_ROWS = "ext boolean, v string, parent string, k string, root string, lo long, size long, depth long, path string"


def _number(separator: str, with_path: bool):
    """Preorder ranges within a chunk, in which a group from elsewhere is a leaf of known size; depths and roots by the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            c = b.column("chunk").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(c)) + 1, len(c)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if z > a:
                    if held and held[-1].column("chunk")[0].as_py() != c[a]:
                        yield from whole(held)
                        held = []
                    held.append(b.slice(a, z - a))
        if held:
            yield from whole(held)

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        t = t.take(pc.sort_indices(t, sort_keys=[("ext", "ascending"), ("v", "ascending")]))
        chunk, m = t["chunk"][0].as_py(), len(t)
        n = m - int(pc.sum(t["ext"]).as_py() or 0)
        v, parent, g = _strings(t["v"]), _strings(t["parent"]), _strings(t["g"])
        # groups stand as roots of no size above their members
        names = pc.unique(g.slice(0, n)).drop_null()
        par = _at(parent, v.slice(0, n))
        top = par < 0
        par = np.where(
            top,
            np.where(
                np.r_[_at(g.slice(0, n), names), np.full(m - n, -1)] >= 0,
                m + np.r_[_at(g.slice(0, n), names), np.full(m - n, 0)], -1
            ),
            par
        )
        par = np.r_[par, np.full(len(names), -1)]
        own = np.r_[
            np.ones(n, dtype=np.int64), t["size"].to_numpy()[n:], np.zeros(len(names), dtype=np.int64)
        ].astype(np.int64)
        size = below(par, own)
        lo = along(par, before(par, size) + np.where(par >= 0, own[par], 0), np.add)
        # the ranges say the rest: what is open at a node's position are its ancestors
        order = np.argsort(lo[:n], kind="stable")
        at = lo[:n][order]
        open_ = np.arange(n) - np.searchsorted(np.sort(at + size[:n][order]), at, "right")
        depth, outer = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        depth[order] = open_
        outer[order] = order[np.maximum.accumulate(np.where(open_ == 0, np.arange(n), 0))] if n else 0
        holder = np.r_[np.arange(n), par[n:m]]  # what a row's place is counted in: the node itself, or the parent of a group
        base = np.where(par[outer[holder]] >= 0, lo[np.maximum(par[outer[holder]], 0)], lo[outer[holder]])
        in_group = np.asarray(g.take(pa.array(holder)).is_valid())
        root = _pick(v, outer[holder], ~in_group)
        keys = pc.binary_join_element_wise(
            pa.scalar(f"{chunk}", pa.large_string()), g.take(pa.array(holder)), pa.scalar("|", pa.large_string())
        )
        d = np.where(np.arange(m) < n, depth[holder], depth[holder] + 1)
        ext = np.arange(m) >= n
        shown = np.r_[order, np.arange(n, m)]  # nodes in preorder
        stack: list[str] = []
        parents = set(par[n:m].tolist())
        kept: dict[int, str] = {}
        for a in range(0, m, 8192):
            i = shown[a : a + 8192]
            at = pa.array(i)
            path = pa.nulls(len(i), pa.string())
            if with_path:
                text = []
                for j, name in zip(i.tolist(), v.take(at).to_pylist()):
                    if j < n:
                        del stack[depth[j] :]
                        stack.append(stack[-1] + separator + name if stack else name)
                        text.append(stack[-1])
                        if j in parents:
                            kept[j] = stack[-1]
                    else:
                        text.append(kept[int(par[j])])
                path = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ext[i]), v.take(at).cast(pa.string()), parent.take(at).cast(pa.string()),
                    keys.take(at).cast(pa.string()), root.take(at).cast(pa.string()), pa.array((lo[:m] - base)[i]),
                    pa.array(size[i]), pa.array(d[i]), path
                ],
                names=["ext", "v", "parent", "k", "root", "lo", "size", "depth", "path"]
            )

    return run


def _groups_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all groups (k, anc, size, least, ring): (k, size of all below, ring)."""
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    k, least, ring = _strings(t["k"]), _strings(t["least"]), _strings(t["ring"])
    par = _at(_strings(t["anc"]), k)
    at, endless = ends_of(par)
    names = pc.unique(least)
    names = names.take(pc.sort_indices(names))
    found = names.take(pa.array(least_of_ring(par, at, endless, _at(least, names))))
    size = below(np.where(endless, -1, par), t["size"].to_numpy())
    ring = pc.if_else(pa.array(endless), found, ring.take(pa.array(at)))
    yield pa.RecordBatch.from_arrays(
        [k.cast(pa.string()), pa.array(size), ring.cast(pa.string())], names=["k", "size", "ring"]
    )


def _groups_down(separator: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From all groups (k, anc, root, lo, depth, path), each against the group above: the same against the root."""
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        k = _strings(t["k"])
        par = _at(_strings(t["anc"]), k)
        at, _ = ends_of(par)
        steps = along(par, (par >= 0).astype(np.int64), np.add)
        path = t["path"].to_pylist()
        for i in np.argsort(steps, kind="stable").tolist():
            if par[i] >= 0 and path[i] is not None:
                path[i] = path[par[i]] + separator + path[i]
        yield pa.RecordBatch.from_arrays(
            [
                k.cast(pa.string()), _strings(t["root"]).take(pa.array(at)).cast(pa.string()),
                pa.array(along(par, t["lo"].to_numpy(), np.add)), pa.array(along(par, t["depth"].to_numpy(), np.add)),
                pa.array(path, pa.string())
            ],
            names=["k", "root", "lo", "depth", "path"]
        )

    return run


def _doubled_up(groups: DataFrame) -> DataFrame:
    """As _groups_up, by pointer doubling over the cluster: groups that reached an end are set aside, the others jump."""
    state = cut_lineage(groups.withColumn("up", F.col("anc")))
    left, k = state.where("anc is not null").count(), 0
    while left:
        going = state.where("anc is not null")
        look = state.select(
            F.col("k").alias("anc"), F.col("anc").alias("_anc"), F.col("least").alias("_least"),
            F.col("ring").alias("_ring")
        )
        add = going.groupBy(F.col("anc").alias("k")).agg(F.sum("size").alias("_add"))
        jumped = going.join(look, "anc").select(
            "k", F.col("_anc").alias("anc"), "size", F.least("least", "_least").alias("least"),
            F.coalesce("ring", "_ring").alias("ring"), "up"
        )
        state = cut_lineage(
            jumped.unionByName(state.where("anc is null")).join(add, "k", "left").withColumn(
                "size", F.col("size") + F.coalesce("_add", F.lit(0))
            ).drop("_add")
        )
        now, k = state.where("anc is not null").count(), k + 1
        if now == left and 2**k >= left:  # every pointer has gone round its ring
            break
        left = now
    rest = state.where("anc is not null")
    rings = rest.join(
        rest.select(F.col("k").alias("anc"), F.col("least").alias("_ring")), "anc"
    ).select("k", "size", F.col("_ring").alias("ring"))
    return state.where("anc is null").select("k", "size", "ring").unionByName(rings)


def _doubled_down(groups: DataFrame, separator: str) -> DataFrame:
    state = cut_lineage(groups)
    while not state.where("anc is not null").isEmpty():
        look = state.select(
            F.col("k").alias("anc"), *(F.col(c).alias(f"_{c}") for c in ("anc", "root", "lo", "depth", "path"))
        )
        jumped = state.where("anc is not null").join(look, "anc").select(
            "k", F.col("_anc").alias("anc"), F.col("_root").alias("root"), (F.col("lo") + F.col("_lo")).alias("lo"),
            (F.col("depth") + F.col("_depth")).alias("depth"), F.concat("_path", F.lit(separator), "path").alias("path")
        )
        state = cut_lineage(jumped.unionByName(state.where("anc is null")))
    return state.drop("anc")


def tree(
    nodes: DataFrame, node_id: str, edges: DataFrame, child: str, parent: str, separator: str = "/",
    with_path: bool = True, near: str | None = None, chunk: int = CHUNK
) -> DataFrame:
    """One row per distinct node: node, parent, root, depth, subtree_size, lo, hi, path (if with_path).

    Per root, lo numbers the nodes in preorder from 0 and [lo, hi) is the range of a node's subtree: the descendants of x
    are the rows of the same root with lo in (x.lo, x.hi), its ancestors those whose range holds x.lo. The path runs from
    the root to the node. `near` is a column of nodes that related nodes share: it decides only how the work is laid out.

    Rows with a null node are left out; repeated rows count once; links whose ends are null or no nodes are ignored; of
    several parents of a node the least id is taken. A node whose line never ends has depth -1, the least id of the
    ring it runs into as root, and nulls for size, range and path. Empty tables give no rows.
    """
    links = _links(nodes, node_id, edges, child, parent, near)
    parts = cut_lineage(
        links.repartitionByRange("near", "v").sortWithinPartitions("near", "v").select("v", "parent").mapInArrow(
            _contract(chunk), "chunk long, v string, parent string, g string, least string, ring string"
        )
    )
    key = lambda c, g: F.concat_ws("|", F.col(c).cast("string"), F.col(g))
    inner = parts.where("ring is null")
    out = parts.where("g is not null").groupBy("chunk", "g").agg(F.count("*").alias("size"))
    held = parts.select(F.col("v").alias("g"), F.col("chunk").alias("_chunk"), F.col("g").alias("_g"), "least", "ring")
    groups = cut_lineage(
        out.join(held, "g").select(
            key("chunk", "g").alias("k"), F.when(F.col("_g").isNotNull(), key("_chunk", "_g")).alias("anc"), "size",
            "least", "ring", F.col("_chunk").alias("at"), F.col("g").alias("p")
        )
    )
    n = groups.count()
    leaves = inner.select("chunk", F.lit(False).alias("ext"), "v", "parent", "g", F.lit(1).cast("long").alias("size"))
    if n:
        narrow = groups.select("k", "anc", "size", "least", "ring")
        up = narrow.coalesce(1).mapInArrow(
            _groups_up, "k string, size long, ring string"
        ) if n <= chunk else _doubled_up(narrow)
        known = cut_lineage(groups.select("k", "at", "p").join(up, "k"))
        hung = known.where("ring is null").select(
            F.col("at").alias("chunk"), F.lit(True).alias("ext"), F.col("k").alias("v"), F.col("p").alias("parent"),
            F.lit(None).cast("string").alias("g"), "size"
        )
        leaves = leaves.unionByName(hung)
    numbered = leaves.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(
        _number(separator, with_path), _ROWS
    )
    if not n:
        ended = numbered.select(
            F.col("v").alias("node"), "parent", "root", "depth", F.col("size").alias("subtree_size"), "lo",
            (F.col("lo") + F.col("size")).alias("hi"), "path"
        )
    else:
        numbered = cut_lineage(numbered)
        ext = numbered.where("ext").select(
            F.col("v").alias("k"), F.col("k").alias("anc"), "root", "lo", "depth", "path"
        )
        down = ext.coalesce(1).mapInArrow(
            _groups_down(separator), "k string, root string, lo long, depth long, path string"
        ) if n <= chunk else _doubled_down(ext, separator)
        above = down.select(
            "k", F.col("root").alias("_root"), F.col("lo").alias("_lo"), F.col("depth").alias("_depth"),
            F.col("path").alias("_path"), F.lit(None).cast("string").alias("_ring")
        )
        lost = known.where("ring is not null").select(
            "k", F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("string"),
            "ring"
        )
        x = numbered.where("not ext").join(above.union(lost), "k", "left")
        here = F.col("_ring").isNull()
        only = lambda c: F.when(here, c)
        lo = F.col("lo") + F.coalesce("_lo", F.lit(0))
        ended = x.select(
            F.col("v").alias("node"), "parent", F.coalesce("_ring", "_root", "root").alias("root"),
            F.when(here, F.col("depth") + F.coalesce("_depth", F.lit(0))).otherwise(F.lit(-1)).alias("depth"),
            only(F.col("size")).alias("subtree_size"), only(lo).alias("lo"), only(lo + F.col("size")).alias("hi"),
            only(
                F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", F.lit(separator), "path"))
            ).alias("path")
        )
    none = lambda t: F.lit(None).cast(t)
    endless = parts.where("ring is not null").select(
        F.col("v").alias("node"), "parent", F.col("ring").alias("root"), F.lit(-1).cast("long").alias("depth"),
        none("long").alias("subtree_size"), none("long").alias("lo"), none("long").alias("hi"),
        none("string").alias("path")
    )
    all_ = ended.unionByName(endless)
    return all_ if with_path else all_.drop("path")


def descendants(trees: DataFrame, of: DataFrame | None = None, piece: int = 4096) -> DataFrame:
    """(root, node, descendant, steps): every descendant of every node, or of the nodes in of(node), read off the ranges.

    A node's range is unrolled into positions that are matched to the rows at those positions: an equality join whose
    size is that of the result. Long ranges are cut into pieces first, so that those of a huge root unroll in many tasks.
    """
    t = trees.where("lo is not null")
    q = t if of is None else t.join(of.select("node").distinct(), "node", "left_semi")
    pieces = q.where("subtree_size > 1").select(
        "root", "node", F.col("depth").alias("_d"), "hi",
        F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1, F.lit(piece).cast("long"))).alias("_s")
    ).repartition("root", "node", "_s")
    wanted = pieces.select(
        "root", "node", "_d", F.explode(F.sequence("_s", F.least(F.col("hi") - 1, F.col("_s") + piece - 1))).alias("lo")
    )
    return wanted.join(t.select("root", "lo", F.col("node").alias("descendant"), "depth"), ["root", "lo"]).select(
        "root", "node", "descendant", (F.col("depth") - F.col("_d")).alias("steps")
    )
