"""Exact n-gram Jaccard self-join with a count-vector R-tree, and its components.

A document's set holds its distinct windows of five words (all its words as one where it has fewer). Windows are hashed
into ``GROUPS`` groups; the counts per group are the document's point. Two sets share at most the summed coordinate minima
of their points, so a pair whose sum is too small is no link. Points of one cell are packed into leaves, whose corner
points bound whole leaf pairs before single pairs are looked at. Pairs that survive are verified on the sets themselves.

One R-tree over all points prunes nothing here: random texts of n windows lie about 1.13 * sqrt(n * groups) apart, links
up to 2n/7, so boxes of leaves overlap at any affordable number of groups. The index is therefore cut into cells by a rule
that loses no link: linked sets share one of their first n - ceil(3n/4) + 1 windows in any fixed order. The order is rare
first: windows counted as frequent over the whole corpus come last, by count (the count table is bounded; what it misses
costs time, not links).

No cell emits its pairs. First each member is only compared with one hub of its cell; links found are joined to
components. Pairs within a component need no second look. Cells that still hold several components then go through the
R-tree, large cells in blocks of bounded size, and out comes a spanning forest of the pairs that may link different
components. Its trees over all cells are families: every link that is still open lies inside one. The sets of a family
meet once, in blocks, or in its cells where that moves fewer of them; there pairs are verified, and a link joins two
components, so that a task sends on fewer links than it has components. So a group of thousands of near copies costs one
comparison a copy and rows grow with members, not with pairs, yet no link between different components is lost. Links
inside components are counted afterwards, where that is asked for: the sets of a component meet once, in blocks, as
matrices whose products are the sizes of all intersections. That work grows with the square of a component, memory with
that of a block, and what is sent on with its members.

Sets of more than ``LONG`` windows are another matter: points of 256 groups tell little of them, so their families would
be large and their sets heavy. Their possible pairs leave the cells one by one, are bounded by points of 4,096 groups and
then verified. Those pairs grow with the square of the long texts in a cell.

Null and empty texts have empty sets, linked with nothing. Very long texts are read whole; their sets travel in pieces.
Rows with equal sets are one node. Rows without doc_id link like others and get the smallest doc_id of their component
(null if all of it has no id). Sets and windows are told apart by 64-bit hashes. Only doc_id and text are read;
``one_of_each`` keeps further columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardstone.llm import bytesops as B
from wardstone.llm.graph import bits_of, components, maybe
from wardstone.session import cut_lineage, forget
from wardstone.llm.columns import any_names

K = 5
GROUPS = 256
FINE = 4096
# Entries of the count table a task keeps, and those of all tasks that are sent to the tasks.
COUNTED = 65_536
FREQUENT = 100_000
MANY = 255
LEAF = 32
# Members of a cell that one task compares with as many others, and windows of all their sets (roughly).
BLOCK = 2048
WINDOWS = 1 << 20
# Windows of a set up to which the coarse points tell unlike sets apart.
LONG = 3 * GROUPS
# Windows of a set that travel in one row.
PIECE = 512
# Windows whose holders are compared at a time when links are counted.
COLUMNS = 4096


def window_sets(texts: pa.Array, k: int = K):
    """Per text the sorted distinct hashes of its windows."""
    words, number = _words(texts)
    hashes, at = B.window_hashes(words, number, k)
    of = number[at]
    counts = np.bincount(number, minlength=len(texts)) if len(number) else np.zeros(len(texts), np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        if counts[i] >= k:
            yield np.unique(hashes[edges[i] : edges[i + 1]])
        elif counts[i]:
            h = B.U(counts[i])
            with np.errstate(over="ignore"):
                for w in words[first[i] : first[i + 1]]:
                    h = B.mix(h * B.BASE + w)
            yield np.array([h], B.U)
        else:
            yield np.zeros(0, B.U)


def _words(texts: pa.Array):
    data, at = B.buffer_of(texts)
    data = B.LOWER[data]
    starts, stops, number = B.word_bounds(data, at, B.SPACED)
    return B.word_hashes(data, starts, stops), number


def frequent_windows(docs: DataFrame, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the windows that are counted most often, from all texts. A task keeps a summary of
    ``COUNTED`` entries (Misra and Gries): what has to give way lowers all counts."""

    def count(batches):
        keep, n = np.zeros(0, B.U), np.zeros(0, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                hashes, _ = B.window_hashes(*_words(b.column("text").slice(i, 512)), k)
                new, m = np.unique(hashes, return_counts=True)
                both, at = np.unique(np.concatenate([keep, new]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, m]), len(both)).astype(np.int64)
                keep = both
                if len(keep) > COUNTED:
                    n = n - np.partition(n, -COUNTED - 1)[-COUNTED - 1]
                    keep, n = keep[n > 0], n[n > 0]
        held = n > 1
        yield pa.RecordBatch.from_pydict({"h": pa.array(keep[held].view(np.int64)), "n": pa.array(n[held])})

    # as few batches a task as Spark makes: each is cut to 512 texts above
    rows = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = rows.where("n > 3").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h = rows["h"].to_numpy().view(B.U)
    order = np.argsort(h)
    return h[order], rows["n"].to_numpy()[order]


def node_of(windows: np.ndarray) -> np.uint64:
    """A hash of the set."""
    return B.mix(np.array([np.bitwise_xor.reduce(B.mix(windows + B.U(1)), initial=B.U(len(windows)))], B.U) + windows.sum(dtype=B.U))[0]


def pack_point(windows: np.ndarray, groups: int = GROUPS) -> bytes:
    """Counts per group in a byte each; the largest stands for any count from there on."""
    counts = np.bincount((windows >> B.U(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups)
    return np.minimum(counts, MANY).astype(np.uint8).tobytes()


def unpack_points(column, groups: int = GROUPS) -> np.ndarray:
    points = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, groups).astype(np.int32)
    points[points == MANY] = 2**24  # no bound from this group
    return points


def signatures(docs: DataFrame, frequent) -> DataFrame:
    """doc_id, n, node (hash of the set), point (counts per group) and the windows of the prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def sign(batches):
        known, times = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                n, node, point, first = [], [], [], []
                for s in window_sets(b.column("text").slice(i, 256)):
                    m = len(s)
                    n.append(m)
                    node.append(node_of(s))
                    point.append(pack_point(s))
                    at = np.searchsorted(known, s)
                    at[at == len(known)] = 0
                    count = np.where(known[at] == s, times[at], 0) if len(known) else np.zeros(m, np.int64)
                    first.append(s[np.argsort(count, kind="stable")[: m - (3 * m + 3) // 4 + 1]].view(np.int64) if m else s.view(np.int64))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(i, 256).cast(pa.int64()), "n": pa.array(n, pa.int64()),
                    "node": pa.array(np.array(node, B.U).view(np.int64)), "point": pa.array(point, pa.binary()),
                    "first": pa.array(first, pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sign, "doc_id long, n long, node long, point binary, first array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, fine: bool = False) -> DataFrame:
    """node, windows: the sets of ``wanted`` (doc_id, node), or as ``fine`` their points of ``FINE`` groups. A bitmap of
    fixed size keeps most other texts with an id from being hashed and moved."""
    sent = docs.sparkSession.sparkContext.broadcast(bits_of(wanted.select("doc_id")))

    def read(batches):
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            b = b.filter(pc.or_(maybe(sent.value, ids), ids.is_null()))
            for i in range(0, b.num_rows, 256):
                sets = list(window_sets(b.column("text").slice(i, 256)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(i, 256).cast(pa.int64()),
                    "node": pa.array(np.array([node_of(s) for s in sets], B.U).view(np.int64)),
                    "windows": pa.array([pack_point(s, FINE) for s in sets], pa.binary()) if fine
                    else pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    kind = "binary" if fine else "array<long>"
    found = docs.select("doc_id", "text").mapInArrow(read, f"doc_id long, node long, windows {kind}")
    # of documents that share an id, or have none, those with the node's set
    same = (F.col("f.node") == F.col("w.node")) & F.col("f.doc_id").eqNullSafe(F.col("w.doc_id"))
    return found.alias("f").join(wanted.alias("w"), same).select("f.node", "windows").dropDuplicates(["node"])


def bounded(pairs: DataFrame, points: DataFrame, groups: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose summed coordinate minima allow a link. points: node, point."""

    def bound(batches):
        for b in batches:
            step = max(1, (1 << 18) // groups)
            for i in range(0, b.num_rows, step):
                t = b.slice(i, step)
                n = t.column("n_a").to_numpy() + t.column("n_b").to_numpy()
                shared = np.minimum(unpack_points(t.column("p_a"), groups), unpack_points(t.column("p_b"), groups)).sum(1)
                yield t.select(["a", "b", "n_a", "n_b"]).filter(pa.array(7 * shared >= 3 * n))

    met = pairs.join(points.select(F.col("node").alias("a"), F.col("point").alias("p_a")), "a").join(
        points.select(F.col("node").alias("b"), F.col("point").alias("p_b")), "b")
    return met.select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(bound, "a long, b long, n_a long, n_b long")


def links_among(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b: nodes) that are links: by sizes, by their points, by finer points, and by their sets."""
    sized = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(
        nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b").where("4 * n_a >= 3 * n_b AND 4 * n_b >= 3 * n_a")
    likely = cut_lineage(bounded(sized, nodes, GROUPS))

    def wanted(some):
        return some.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select(
            F.col("rep").alias("doc_id"), "node")

    points = cut_lineage(sets_of(docs, wanted(likely), fine=True).withColumnRenamed("windows", "point"))
    close = cut_lineage(bounded(likely, points, FINE))
    forget(likely, points)
    sets = cut_lineage(sets_of(docs, wanted(close)))
    joined = close.join(sets.select(F.col("node").alias("a"), F.col("windows").alias("w_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("windows").alias("w_b")), "b")
    both = F.size(F.array_intersect("w_a", "w_b"))
    links = cut_lineage(joined.where(100 * both >= 75 * (F.size("w_a") + F.size("w_b") - both)).select("a", "b").distinct())
    forget(close, sets)
    return links


def tree_blocks(n: np.ndarray, points: np.ndarray, side: np.ndarray, lone: bool, open_=None):
    """Pairs of rows that may be links, as two arrays a pair of leaves, by a packed R-tree over their points; ``side`` 0
    against 1, or all if ``lone``. ``open_`` tells of the rows of two leaves whether a link between them is of interest."""
    order = np.argsort(n, kind="stable")
    leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
    top = np.stack([points[x].max(0) for x in leaves])
    least, most = np.array([n[x[0]] for x in leaves]), np.array([n[x[-1]] for x in leaves])
    for i, x in enumerate(leaves):
        # leaves of larger sets that sizes and corner points allow
        js = np.arange(i, len(leaves))
        js = js[4 * most[i] >= 3 * least[js]]
        js = js[7 * np.minimum(top[i], top[js]).sum(1) >= 3 * (least[i] + least[js])]
        for j in js:
            y = leaves[j]
            if open_ and not open_(x, y):
                continue
            fits = 7 * np.minimum(points[x][:, None, :], points[y][None, :, :]).sum(2) >= 3 * (n[x][:, None] + n[y][None, :])
            if j == i:
                fits &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
            if not lone:
                fits &= side[x][:, None] != side[y][None, :]
            a, b = np.nonzero(fits)
            yield x[a], y[b]


def tree_pairs(n: np.ndarray, points: np.ndarray, side: np.ndarray, lone: bool):
    """The pairs of ``tree_blocks`` one by one."""
    for x, y in tree_blocks(n, points, side, lone):
        yield from zip(x, y)


def in_blocks(members: DataFrame, blocks) -> DataFrame:
    """Each member of a cell (key) next to every block of it: own is the member's block, (i, j) the two that meet.
    ``blocks`` aggregates their number from the cell's members."""
    sizes = members.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(blocks)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).drop("blocks", "other")


def whole_cells(batches):
    """Tables of whole cells (key, i, j) of sorted batches, with the rows at which cells begin and the end."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        cut = _changes(t, ("key", "i", "j"))
        if len(cut):
            yield t.slice(0, cut[-1]), np.concatenate([[0], cut])
            t = t.slice(cut[-1])
        rest = t
    if rest is not None and rest.num_rows:
        yield rest, np.concatenate([[0], _changes(rest, ("key", "i", "j")), [rest.num_rows]])


def _changes(t: pa.Table, columns) -> np.ndarray:
    cell = np.stack([t.column(c).to_numpy() for c in columns], 1)
    return np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1


def several(labels: np.ndarray):
    """Whether rows x and rows y of the labels hold more than one label."""
    return lambda x, y: (labels[x] != labels[x[0]]).any() or (labels[y] != labels[x[0]]).any()


def possible_links(members: DataFrame) -> DataFrame:
    """key, a, b: per block pair of a cell a spanning forest of the pairs of nodes of different components that pass the
    R-tree. members: key, node, n, component, point."""

    def find(batches):
        for t, edges in whole_cells(batches):
            node, n, comp, own, i, j = (t.column(c).to_numpy() for c in ("node", "n", "component", "own", "i", "j"))
            points = unpack_points(t.column("point"))
            at, found = [], []
            for a, z in zip(edges, edges[1:]):
                if z - a < 2 or (comp[a:z] == comp[a]).all():
                    continue
                c, label = comp[a:z], np.arange(z - a)
                for x, y in tree_blocks(n[a:z], points[a:z], own[a:z], i[a] == j[a], several(c)):
                    new = (c[x] != c[y]) & (label[x] != label[y])
                    for p, q in zip(x[new], y[new]):
                        if label[p] != label[q]:
                            label[label == label[q]] = label[p]
                            at.append(a)
                            found.append((node[a + p], node[a + q]))
            pairs = np.array(found, np.int64).reshape(-1, 2)
            out = t.select(["key", "i", "j"]).take(pa.array(at, pa.int64())).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(out.column(c).to_numpy()) for c in ("key", "i", "j")), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                names=["key", "i", "j", "a", "b"])

    dealt = in_blocks(members, F.count("*") / F.lit(BLOCK)).select("key", "i", "j", "own", "node", "n", "component", "point")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = dealt.mapInArrow(find, "key long, i int, j int, a long, b long")
    return found.select(F.xxhash64("key", "i", "j").alias("key"), "a", "b")


def long_pairs(members: DataFrame) -> DataFrame:
    """a, b: pairs of nodes of different components, at least one of more than ``LONG`` windows, that share a cell and
    pass the R-tree. members: key, node, n, component, point."""
    long = LONG

    def find(batches):
        for t, edges in whole_cells(batches):
            node, n, comp, own, i, j = (t.column(c).to_numpy() for c in ("node", "n", "component", "own", "i", "j"))
            points = unpack_points(t.column("point"))
            found = [np.zeros((0, 2), np.int64)]
            for a, z in zip(edges, edges[1:]):
                if z - a < 2 or (comp[a:z] == comp[a]).all():
                    continue
                for x, y in tree_blocks(n[a:z], points[a:z], own[a:z], i[a] == j[a], several(comp[a:z])):
                    new = (comp[a + x] != comp[a + y]) & (np.maximum(n[a + x], n[a + y]) > long)
                    found.append(np.sort(np.stack([node[a + x[new]], node[a + y[new]]], 1), axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    some = members.where(4 * F.col("n") > 3 * LONG)
    dealt = in_blocks(some, F.count("*") / F.lit(BLOCK)).select("key", "i", "j", "own", "node", "n", "component", "point")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(find, "a long, b long").distinct()


def joining_links(node: np.ndarray, component: np.ndarray, own: np.ndarray, lone: bool, sets: list[np.ndarray]):
    """Links (a, b: nodes) that join components of a cell, fewer than there are components: pairs that pass the R-tree,
    verified on their sets while their components are still apart."""
    n = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(n)])
    windows = np.concatenate(sets)
    group = (windows >> B.U(64 - GROUPS.bit_length() + 1)).astype(np.int64) + GROUPS * np.repeat(np.arange(len(n)), n)
    points = np.bincount(group, minlength=GROUPS * len(n)).reshape(-1, GROUPS).astype(np.int32)
    known, number = np.unique(windows, return_inverse=True)
    held = np.zeros(len(known), bool)
    distinct, part = np.unique(component, return_inverse=True)
    label, left = np.arange(len(distinct)), len(distinct)
    for xs, ys in tree_blocks(n, points, own, lone, lambda x, y: several(label[part])(x, y)):
        apart = label[part[xs]] != label[part[ys]]
        xs, ys = xs[apart], ys[apart]
        for x in np.unique(xs):
            y = ys[xs == x]
            y = y[label[part[y]] != label[part[x]]]
            if not len(y):
                continue
            mine = number[first[x] : first[x + 1]]
            held[mine] = True
            both = np.array([np.count_nonzero(held[number[first[k] : first[k + 1]]]) for k in y])
            held[mine] = False
            for k in y[100 * both >= 75 * (n[x] + n[y] - both)]:
                old, new = label[part[k]], label[part[x]]
                if old != new:
                    label[label == old] = new
                    left -= 1
                    yield node[x], node[k]
        if left == 1:
            return


def dealt_sets(members: DataFrame, blocks, sets: DataFrame, extra: str) -> DataFrame:
    """The members (key, node, ``extra``) of cells with their sets, dealt by block pairs and sorted for ``met_sets``."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("windows") - 1) / PIECE).cast("int")),
        lambda p: F.slice("windows", p * PIECE + 1, F.lit(PIECE)))
    cut = sets.select("node", F.posexplode(pieces).alias("piece", "windows"))
    dealt = in_blocks(members, blocks).select("key", "i", "j", "own", "node", extra).join(cut, "node")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node", "piece")


def met_sets(c: pa.Table, extra: str):
    """node, ``extra``, own (one entry a member), whether the block meets itself, and the members' sets of one cell."""
    starts = np.concatenate([[0], _changes(c, ("node",))])
    node, more, own, i, j = (c.column(k).to_numpy()[starts] for k in ("node", extra, "own", "i", "j"))
    flat = c.column("windows").combine_chunks()
    flat = (pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat)
    ends = np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy())])
    windows = flat.flatten().to_numpy().view(B.U)
    edge = np.append(ends[starts], len(windows))
    return node, more, own, i[0] == j[0], [windows[x:y] for x, y in zip(edge, edge[1:])]


def linked_rows(sets: list[np.ndarray], rows: np.ndarray, own: np.ndarray, lone: bool) -> np.ndarray:
    """Per set the sum of ``rows`` of the sets it links with: those of the other side, or all others if ``lone``."""
    n = np.array([len(s) for s in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[number] > 1
    of, column = np.repeat(np.arange(len(n)), n)[shared], (np.cumsum(times > 1) - 1)[number[shared]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both = np.zeros((len(n), len(n)), np.int64)
    for lo in range(0, int((times > 1).sum()), COLUMNS):
        a, z = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((len(n), COLUMNS if z < len(column) else int(column[-1]) - lo + 1), np.float32)
        part[of[a:z], column[a:z] - lo] = 1
        both += (part @ part.T).astype(np.int64)
    link = 100 * both >= 75 * (n[:, None] + n - both)
    link &= ~np.eye(len(n), dtype=bool) if lone else own[:, None] != own
    return link @ rows


def link_counts(parts: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n_links: the rows with other sets that the node's set links with. Links lie inside components, so each pair
    of nodes of a component (parts: node, component) meets in one block pair, whose tasks send on one count a member."""
    placed = parts.join(nodes, "node").select(F.col("component").alias("key"), "node", "n", "rows", "rep")
    placed = cut_lineage(placed)
    sets = cut_lineage(sets_of(docs, placed.select(F.col("rep").alias("doc_id"), "node")))
    blocks = F.greatest(F.ceil(F.sum("n") / F.lit(WINDOWS // 4)), F.ceil(F.count("*") / F.lit(BLOCK // 4)))

    def count(batches):
        for t, edges in whole_cells(batches):
            found, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, z in zip(edges, edges[1:]):
                node, rows, own, lone, sets_ = met_sets(t.slice(a, z - a), "rows")
                if len(node) > 1:
                    found.append(node)
                    links.append(linked_rows(sets_, rows, own, lone))
            yield pa.RecordBatch.from_pydict({"node": pa.array(np.concatenate(found)), "n_links": pa.array(np.concatenate(links))})

    counted = dealt_sets(placed, blocks, sets, "rows").mapInArrow(count, "node long, n_links long")
    out = cut_lineage(counted.groupBy("node").agg(F.sum("n_links").alias("n_links")))
    forget(placed, sets)
    return out


def links_across(members: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: links that join the different components of each cell. members: key, node, n, component, point."""
    possible = cut_lineage(possible_links(members))
    known = members.select("node", "n", "component").distinct()
    family = cut_lineage(components(possible.select("a", "b")).withColumnRenamed("component", "family").join(known, "node"))
    met = cut_lineage(possible.select("key", F.explode(F.array("a", "b")).alias("node")).distinct())
    # windows of one shared passage leave the same members: one of their cells is enough
    name = F.xxhash64("node").cast("decimal(20,0)")
    once = met.groupBy("key").agg(F.sum(name).alias("names"), F.count("*").alias("rows")).groupBy("names", "rows").agg(
        F.min("key").alias("key")).select("key")
    placed = cut_lineage(met.join(once, "key").join(family, "node"))
    forget(possible, met)
    blocks = F.greatest(F.ceil(F.sum("n") / F.lit(WINDOWS)), F.ceil(F.count("*") / F.lit(BLOCK)))
    whole = cut_lineage(family.groupBy("family").agg((F.count("*") * blocks).alias("moved")).join(
        placed.groupBy("family").agg(F.count("*").alias("rows")), "family").where("moved <= rows").select("family"))
    met = family.join(whole, "family").withColumn("key", F.col("family")).select("key", "node", "n", "component").union(
        placed.join(whole, "family", "left_anti").select("key", "node", "n", "component"))
    met = cut_lineage(met)
    forget(placed, whole)
    wanted = family.select("node").join(nodes, "node").select(F.col("rep").alias("doc_id"), "node")
    sets = cut_lineage(sets_of(docs, wanted))

    def verify(batches):
        for t, edges in whole_cells(batches):
            found = []
            for a, z in zip(edges, edges[1:]):
                node, comp, own, lone, sets_ = met_sets(t.slice(a, z - a), "component")
                if len(node) < 2:
                    continue
                found.extend(joining_links(node, comp, own, lone, sets_))
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    found = dealt_sets(met, blocks, sets, "component").mapInArrow(verify, "a long, b long")
    links = cut_lineage(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    forget(family, met, sets)
    return links


def with_hub(signed: DataFrame) -> DataFrame:
    """key, node, hub: the nodes of each prefix window that several nodes have, and the smallest of them. Most windows have
    one node only; a window function moves them once, counts that are joined back would move them twice."""
    posted = signed.where("n > 0").select(F.explode("first").alias("key"), "node")
    cell = Window.partitionBy("key")
    hubs = posted.select("key", "node", F.min("node").over(cell).alias("hub"), F.max("node").over(cell).alias("last"))
    return hubs.where("hub <> last").drop("last")


def joined(docs: DataFrame, counted: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and, if ``counted``, n_links: all other rows that the row links with."""
    docs = docs.select("doc_id", "text")
    signed = cut_lineage(signatures(docs, frequent_windows(docs)))
    nodes = cut_lineage(signed.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("point").alias("point"), F.count("*").alias("rows")))
    members = cut_lineage(with_hub(signed))
    rows = cut_lineage(signed.select("doc_id", "n", "node"))
    forget(signed)
    first = links_among(
        members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), docs, nodes)
    parts = components(first)
    placed = members.select("key", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # the windows of one shared passage make cells with the same members: one of them is enough
    name = F.xxhash64("node").cast("decimal(20,0)")
    several = placed.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum(name).alias("names"), F.count("*").alias("rows"),
    ).where("lo <> hi").groupBy("names", "rows").agg(F.min("key").alias("key")).select("key")
    open_ = cut_lineage(placed.join(several, "key").distinct().join(nodes.select("node", "n", "point"), "node"))
    forget(members)
    second = links_across(open_.where(F.col("n") <= LONG), docs, nodes)
    third = links_among(long_pairs(open_), docs, nodes)
    forget(open_)
    links = first.union(second).union(third)
    parts = cut_lineage(components(links))
    named = parts.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = nodes.select("node", "rep", "rows").join(parts.join(named, "component"), "node", "left")
    columns = [F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
    if counted:
        of_node = of_node.join(link_counts(parts, docs, nodes), "node", "left")
        # rows of the same set link as well
        columns.append(F.coalesce(F.col("rows") - 1 + F.coalesce("n_links", F.lit(0)), F.lit(0)).alias("n_links"))
    of_node = of_node.withColumn("component_id", F.coalesce("component_id", "rep"))
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(of_node, "node", "left")
    return out.select("doc_id", *columns)


@any_names
def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the document with the smallest id; documents without id stay. Of rows with the same id, one."""
    kept = joined(docs, counted=False).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    found = docs.where("doc_id IS NOT NULL").join(kept, F.col("doc_id") == F.col("_kept")).drop("_kept")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    return found.withColumn("_nth", nth).where("_nth = 1").drop("_nth").union(docs.where("doc_id IS NULL"))
