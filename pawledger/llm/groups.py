"""Connected components, and exact comparison of all members of a group, as Spark jobs.

Nodes are long numbers. No group is collected: runs and groups beyond a
block are dealt out as pairs of blocks, and only spanning edges are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import stored
from .words import mix

#: Rows of one run or group that are compared in one task; more are dealt out in pairs of blocks.
BLOCK_ROWS = 512


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for each node of the edges (a, b); the root is the smallest node reachable.

    Large-star and small-star steps in turn until nothing changes; each step is a written table.
    No edges give no rows; loops and repeated edges change nothing.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stored(pairs, name)
    state = _checksum(pairs)
    while state[0]:
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        # The row of the smallest neighbour links the node itself, any other its neighbour.
        end = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        pairs = stored(small.select(end.alias("u"), F.col("m").alias("v")).distinct(), name)
        after = _checksum(pairs)
        if after == state:
            break
        state = after
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _checksum(pairs: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(pairs.agg(F.count(F.lit(1)), total).first())


class Forest:
    """Labels of rows that are joined as links are found."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def root(self, i: int) -> int:
        label = self.label
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.label[max(i, j)] = min(i, j)
        return True

    def flatten(self) -> None:
        while not np.array_equal(self.label, self.label[self.label]):
            self.label = self.label[self.label]


def spanning_links(run: np.ndarray, side: np.ndarray, linked: Callable) -> Iterator[tuple[int, int]]:
    """Links that span the components of each run of equal values (rows are sorted by run).

    Each row meets each later one of its run, from the nearest on, unless they are connected by
    then. `linked(i, j)` says for arrays of row numbers which pairs are linked. Where a run holds
    two blocks (sides 0 and 1), only rows of different sides meet.
    """
    n = len(run)
    forest = Forest(n)
    number = np.zeros(n, np.int64)
    number[1:] = np.cumsum(run[1:] != run[:-1])
    crossed = np.zeros(n, bool)
    two = np.flatnonzero(side == 1)
    crossed[np.isin(run, run[two])] = True
    left = np.arange(n - 1) if n else np.zeros(0, np.int64)
    step = 1
    while len(left):
        left = left[left + step < n]
        left = left[run[left] == run[left + step]]
        right = left + step
        apart = (forest.label[left] != forest.label[right]) & (~crossed[left] | (side[left] != side[right]))
        i, j = left[apart], right[apart]
        if len(i):
            hit = linked(i, j)
            new = [(a, b) for a, b in zip(i[hit].tolist(), j[hit].tolist()) if forest.join(a, b)]
            if new:
                forest.flatten()
                yield from new
                # A run of one component is done.
                roots = np.flatnonzero(forest.label == np.arange(n))
                parts = np.bincount(number[roots], minlength=int(number[-1]) + 1)
                left = left[parts[number[left]] > 1]
        step += 1


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Sorted rows as tables that end where a run of equal keys ends. The flag marks pieces of runs
    of more than `most` rows, which come alone and in pieces."""
    held: list[pa.Table] = []
    long_run = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        table = pa.concat_tables(held).combine_chunks()
        change = np.zeros(table.num_rows, bool)
        for key in keys:
            column = table.column(key).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        starts = np.concatenate(([0], np.flatnonzero(change), [table.num_rows]))
        last = int(starts[-2])
        tail = [table.column(key)[last].as_py() for key in keys]
        lengths = np.diff(starts)
        if long_run is not None and [table.column(key)[0].as_py() for key in keys] == long_run:
            first = int(starts[1])
            yield table.slice(0, first), True
            table, starts, lengths = table.slice(first), starts[1:] - first, lengths[1:]
            last -= first
            if not len(lengths):
                held = []
                continue
        long_run = None
        at = 0
        for k in np.flatnonzero(lengths > most):
            if starts[k] > at:
                yield table.slice(at, int(starts[k]) - at), False
            at = int(starts[k + 1])
            yield table.slice(int(starts[k]), int(lengths[k])), True
        if lengths[-1] > most:
            long_run, held = tail, []
            continue
        if last > at:
            yield table.slice(at, last - at), False
        held = [table.slice(last)]
    if held and held[0].num_rows:
        yield held[0], False


def dealt_blocks(rows: DataFrame, group: str, node: str, most: int) -> DataFrame:
    """Each row once for each pair of blocks of its group that it takes part in: columns `lo`, `hi`
    and `side` (0: the lower block). A group of up to `most` rows is one block."""
    counts = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    large = counts.where("blocks > 1")
    block = F.pmod(F.xxhash64(F.col(node), F.lit(7)), F.col("blocks")).cast("int")
    return (
        rows.join(large, group, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .withColumn("side", F.when(F.col("block") > F.col("other"), 1).otherwise(0))
        .drop("blocks", "block", "other")
    )


def compared(rows: DataFrame, group: str, node: str, links: Callable, most: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) that span the links inside each group; all members are compared.

    `links(table)` returns the function `linked(i, j)` for a table of rows.
    """
    keys = [group, "lo", "hi"]
    dealt = dealt_blocks(rows, group, node, most)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = dealt.repartition(parts, *keys).sortWithinPartitions(*keys)

    def work(batches):
        for table, _ in whole_runs(batches, keys, 1 << 60):
            run = np.zeros(table.num_rows, np.int64)
            for key in keys:
                column = table.column(key).to_numpy()
                run[1:] |= column[1:] != column[:-1]
            edges = list(spanning_links(np.cumsum(run), table.column("side").to_numpy(), links(table)))
            yield edge_batch(table.column(node), edges)

    return sorted_rows.mapInArrow(work, "a long, b long")


def edge_batch(nodes: pa.ChunkedArray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    nodes = nodes.to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], ["a", "b"])


def sorted_runs(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key")


def repeated_rows(table: pa.Table) -> pa.Table:
    """The rows of a sorted table that share their key with another one."""
    key = table.column("key").to_numpy()
    repeated = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    repeated[1:] |= same
    repeated[:-1] |= same
    return table.filter(pa.array(repeated))


def run_edges(table: pa.Table, links: Callable) -> list[tuple[int, int]]:
    """Spanning edges, as row numbers, of each run of a table sorted by key."""
    key = table.column("key").to_numpy()
    return list(spanning_links(key, np.zeros(len(key), np.int8), links(table)))


def linked_sets(nodes: np.ndarray, edges: list[tuple[int, int]]) -> pa.Table:
    """key and node of the rows at the edges (row numbers): one key for each connected set of nodes,
    the same wherever the same nodes are connected."""
    forest = Forest(len(nodes))
    for a, b in edges:
        forest.join(a, b)
    forest.flatten()
    rows = np.unique(np.array(edges, np.int64).reshape(-1))
    rows = rows[np.argsort(forest.label[rows], kind="stable")]
    label, found = forest.label[rows], nodes[rows]
    starts = np.flatnonzero(np.append(True, label[1:] != label[:-1])[: len(rows)])
    sums = np.add.reduceat(mix(found.view(np.uint64)), starts) if len(rows) else found.view(np.uint64)
    keys = np.repeat(mix(sums), np.diff(np.append(starts, len(rows))))
    return pa.table({"key": keys.view(np.int64), "node": found})


def partnered(keys: DataFrame, links: Callable, most: int = 4096) -> DataFrame:
    """key and node of the rows that are linked to another row of equal key. The key is one of the nodes
    linked to each other, so that nodes which meet under many keys share one afterwards; rows of runs
    of more than `most` rows are all taken as linked and keep their key. `keys` has key (long), node
    (long) and what links asks for."""

    def work(batches):
        for table, is_long in whole_runs(batches, ["key"], most):
            if not is_long:
                table = repeated_rows(table)
                table = linked_sets(table.column("node").to_numpy(), run_edges(table, links))
            for batch in table.select(["key", "node"]).combine_chunks().to_batches():
                yield batch

    return sorted_runs(keys).mapInArrow(work, "key long, node long")


def candidate_edges(keys: DataFrame, near: Callable, name: str, most: int = 4096) -> DataFrame:
    """linked_edges of rows with a sketch; `near(sketches)` returns the function `linked(i, j)`."""
    return linked_edges(keys, lambda table: near(table.column("sketch")), name, most)


def linked_edges(rows: DataFrame, links: Callable, name: str, most: int = 4096) -> DataFrame:
    """Edges (a, b) that span, in each set of rows with equal `key`, the pairs that are linked.

    `rows` has key (long), node (long) and what links asks for; `links(table)` returns the function
    `linked(i, j)`. Runs of more than `most` rows pass through and are compared in pairs of blocks.
    """
    fields = [f for f in rows.schema.fields if f.name not in ("key", "node")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    names = [f.name for f in fields]

    def work(batches):
        for table, is_long in whole_runs(batches, ["key"], most):
            payload = [table.column(n) for n in names]
            if is_long:
                empty = pa.nulls(table.num_rows, pa.int64())
                columns = [table.column("node").combine_chunks(), empty, table.column("key").combine_chunks()]
                columns += [c.combine_chunks() for c in payload]
            else:
                table = repeated_rows(table)
                found = edge_batch(table.column("node"), run_edges(table, links))
                blank = [pa.nulls(found.num_rows, t) for t in (pa.int64(), *[c.type for c in payload])]
                columns = [*found.columns, *blank]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "key", *names])

    found = stored(sorted_runs(rows.select("key", "node", *names)).mapInArrow(work, f"a long, b long, key long, {kinds}"), name)
    long_rows = found.where("key is not null").select("key", F.col("a").alias("node"), *names)
    rest = compared(long_rows, "key", "node", links, most)
    return found.where("key is null").select("a", "b").union(rest)
