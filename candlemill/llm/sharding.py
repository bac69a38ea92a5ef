"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells; every shard owns ``virtual_nodes`` of them, and
a row belongs to the next owned cell clockwise of its own. Every shard has a room
(row counts at most one apart). Where an arc brings more rows than its shard has
room for, the surplus continues clockwise, in order, to the next arc whose shard
still has room. So balance is guaranteed, and only surplus rows leave their arc.

DataFrame functions only. Texts are read once, to narrow rows (no texts) that are written
down; then come an aggregate to ``CELLS * SLICES`` counts, a fold over the arcs of the
ring (a constant number), and one shuffle of narrow rows to number them inside their
slice of a cell. An id, or a row, that a third of all rows share is many tasks' work.

Defined cases: null id = empty id; null text = no bytes (size 1, crc of nothing);
equal rows are interchangeable; an empty table gives an empty result; a table with
fewer rows than shards leaves some shards empty; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.llm.jobs import keep

#: Cells of the ring: bounds every table below, whatever the input's size.
CELLS = 4096
#: Slices of a cell, by text: rows of one id are numbered in as many tasks.
SLICES = 16
#: Copies of a row that are written in one task.
RUN = 1 << 16


def ring(shards: int, virtual_nodes: int = 64) -> list[tuple[int, int]]:
    """Sorted (cell, shard) of the virtual nodes; a taken cell moves a node on clockwise."""
    if shards * virtual_nodes > CELLS:
        raise ValueError(f"{shards} shards of {virtual_nodes} nodes exceed {CELLS} cells")
    taken: dict[int, int] = {}
    for v in range(virtual_nodes):
        for s in range(shards):
            cell = int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:3], 16)
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = s
    return sorted(taken.items())


def arcs(nodes: list[tuple[int, int]]) -> list[int]:
    """For each cell, the index of the node that owns it: the next one clockwise."""
    owner, k = [0] * CELLS, 0
    for cell in range(CELLS):
        while k < len(nodes) and nodes[k][0] < cell:
            k += 1
        owner[cell] = k % len(nodes)
    return owner


def constants(values: list[int]) -> Column:
    """An array literal; one folded constant rather than a literal for each entry."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def cell_of(key: Column) -> Column:
    """Cell of a key: the first 12 bits of its md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 3), 16, 10).cast("int")


def fill(counts: Column, shard_of: list[int], shards: int) -> Column:
    """Walk the ring twice over an array of arc counts; array of placed runs.

    A run is (arc, lap, surplus_from, surplus_to, own, slot): ``own`` rows of the arc
    stay; rows numbered [surplus_from, surplus_to) in the surplus queue stop here;
    ``slot`` is the shard's fill before the run.
    """
    n = len(shard_of)
    shard = constants(shard_of)
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    lit0 = F.lit(0).cast("long")
    run = "array<struct<arc:int,own:bigint,slot:bigint,from:bigint,to:bigint,slot2:bigint,pushed:bigint>>"
    start = F.struct(
        F.array_repeat(lit0, shards).alias("load"), lit0.alias("queued"), lit0.alias("left"), F.array().cast(run).alias("runs")
    )

    def step(state: Column, i: Column) -> Column:
        arc = i % n
        s = F.get(shard, arc)
        room = total.cast("long") / F.lit(shards)
        cap = F.floor(room) + F.when(s < total % shards, 1).otherwise(0)
        load = F.get(state["load"], s)
        come = F.when(i < n, F.get(counts, arc)).otherwise(lit0)
        own = F.least(come, cap - load)
        pushed = come - own
        waiting = state["queued"] - state["left"]
        take = F.greatest(lit0, F.least(waiting, cap - load - own))
        return F.struct(
            F.transform(state["load"], lambda x, k: F.when(k == s, x + own + take).otherwise(x)).alias("load"),
            (state["queued"] + pushed).alias("queued"),
            (state["left"] + take).alias("left"),
            F.concat(
                state["runs"],
                F.array(
                    F.struct(
                        arc.cast("int").alias("arc"), own.alias("own"), load.alias("slot"), state["left"].alias("from"),
                        (state["left"] + take).alias("to"), (load + own).alias("slot2"), state["queued"].alias("pushed"),
                    )
                ),
            ).alias("runs"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * n - 1)), start, step, lambda s: s["runs"])


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, virtual_nodes: int = 64) -> DataFrame:
    """Place every row: (key, size, text_crc32, shard, slot); slots run from 0 in each shard."""
    nodes = ring(shards, virtual_nodes)
    owner, shard_of = arcs(nodes), [s for _, s in nodes]
    n = len(nodes)
    # cells in ring order from the first node's arc: an arc's cells are then consecutive
    turn = (nodes[-1][0] + 1) % CELLS
    owners = constants(owner)
    # equal rows are one row with a count, so copies are numbered without being gathered
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    ).groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("rows"))
    groups = keep(
        rows.withColumns(
            {"_cell": cell_of(F.col("doc_id")), "_slice": F.pmod(F.xxhash64("text_crc32", "size"), F.lit(SLICES)).cast("int")}
        ),
        "groups",
    )
    by_cell = groups.groupBy("_cell", "_slice").agg(F.sum("rows").alias("rows")).withColumn("arc", F.get(owners, F.col("_cell")))
    # rows before a slice in its arc: at most CELLS * SLICES rows are summed
    within = Window.partitionBy("arc").orderBy((F.col("_cell") + (CELLS - turn)) % CELLS, "_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_cell.withColumn("start", F.coalesce(F.sum("rows").over(within), F.lit(0)).cast("long"))
    totals = by_cell.groupBy("arc").agg(F.sum("rows").alias("rows"))
    # one row: the counts of all arcs
    laid = totals.agg(F.map_from_entries(F.collect_list(F.struct("arc", "rows"))).alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda a: F.coalesce(F.element_at(F.col("m"), a.cast("int")), F.lit(0)).cast("long")).alias("counts")
    )
    runs = laid.select(fill(F.col("counts"), shard_of, shards).alias("runs"))
    shard = constants(shard_of)
    # first lap: what stays in each arc, and where its surplus starts in the queue
    first = runs.select(F.posexplode("runs").alias("i", "r")).filter(F.col("i") < n).select("r.arc", "r.own", "r.slot", "r.pushed")
    surplus = runs.select(
        F.filter("runs", lambda r: r["to"] > r["from"]).alias("stops")
    ).select(F.transform("stops", lambda r: F.struct(r["from"].alias("from"), r["to"].alias("to"), F.get(shard, r["arc"]).alias("shard"), r["slot2"].alias("slot"))).alias("stops"))
    plan = starts.join(F.broadcast(first), "arc").select("_cell", "_slice", "arc", "start", "own", F.col("slot").alias("base"), "pushed")
    before = Window.partitionBy("_cell", "_slice").orderBy(F.xxhash64("doc_id"), "doc_id", "text_crc32", "size")
    numbered = groups.withColumn("_in", F.sum("rows").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows"))
    # a group of many copies is dealt out in runs before its rows are written singly
    dealt = numbered.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {RUN}")))).repartition("_cell", "_slice", "doc_id", "_run")
    single = dealt.withColumn("_n", F.explode(F.sequence(F.col("_run") * RUN, F.least("rows", (F.col("_run") + 1) * RUN) - 1)))
    # both small sides are bounded: CELLS * SLICES rows, and one row of at most 2 * nodes runs
    placed = single.join(F.broadcast(plan), ["_cell", "_slice"]).crossJoin(F.broadcast(surplus))
    rank = F.col("start") + F.col("_in") + F.col("_n")
    queue = F.col("pushed") + rank - F.col("own")
    stop = F.filter("stops", lambda r: (r["from"] <= queue) & (queue < r["to"]))[0]
    stays = rank < F.col("own")
    placed = placed.withColumn("_stop", F.when(~stays, stop))
    return placed.select(
        "doc_id", "size", "text_crc32",
        F.when(stays, F.get(shard, F.col("arc"))).otherwise(F.col("_stop.shard")).cast("int").alias("shard"),
        F.when(stays, F.col("base") + rank).otherwise(F.col("_stop.slot") + queue - F.col("_stop.from")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.lit("rows").alias("law"),
        (~stays).alias("overflowed"),
    )
