"""Order-dependent building blocks that never put a whole group into one task.

``dense_index`` numbers rows 1..n inside each group in a given order.  It
range-partitions on (group, order) so that even a group holding a third of all
rows is spread over many tasks, numbers rows locally after a sort inside each
partition, and adds per-partition offsets taken from a table whose size is
bounded by (number of partitions + number of groups).  With a dense index, the
previous row in order is an equi-join on ``idx - 1``: evenly hashed, no hot key.

``with_previous`` needs no join of rows at all: one range exchange puts neighbours side by side, a shift
inside each partition gives every row but the first its previous one, and one carried row per partition
border (a halo) supplies the rest.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.session import ensure_checkpoint_dir, stored


def _ranged(df: DataFrame, n: int | None, keys: list) -> DataFrame:
    """Range-partitioned and sorted by ``keys``; without a number adaptive execution merges small neighbouring ranges."""
    dealt = df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def dense_index(df: DataFrame, group_cols: list[str], order_cols: list[Column | str],
                name: str = "idx", num_partitions: int | None = None,
                total: str | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of the row inside its group in ``order_cols`` order.

    The order must be total (make the last order column unique) so the result
    is deterministic and survives task retries.  The numbered rows are
    checkpointed (reliable, under ``spark.checkpoint.dir``) before the offset
    table is derived from them, so both read one materialised partitioning.
    The offset table has at most partitions + groups rows; Spark broadcasts it
    if its measured bytes allow.  Rows whose group is null form a group of their
    own.  Many tiny groups are better served by ``row_number``.  ``total`` optionally names a
    column with the group size.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    keys = [F.col(c) for c in group_cols] + order
    n = _partitions(df, num_partitions)
    ranged = (df.repartitionByRange(n, *keys)
                .sortWithinPartitions(*keys)
                .withColumn("__di_pid", F.spark_partition_id())
                .withColumn("__di_pos", F.monotonically_increasing_id()))
    # Written once to the shared checkpoint folder: the offset table and the rows
    # must see the same range bounds (two range exchanges would sample their own
    # bounds), and a lost executor then re-reads files instead of re-sampling.
    ensure_checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint(eager=True)
    # (partition, group) slices: first local position and size.  At most
    # partitions + groups rows, because range partitions hold contiguous groups.
    slices = ranged.groupBy("__di_pid", *group_cols).agg(F.min("__di_pos").alias("__di_first"),
                                                     F.count(F.lit(1)).alias("__di_n"))
    w = Window.partitionBy(*group_cols).orderBy("__di_pid") if group_cols else Window.orderBy("__di_pid")
    slices = slices.withColumn("__di_offset", F.coalesce(
        F.sum("__di_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        whole = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
        slices = slices.withColumn("__di_total", F.sum("__di_n").over(whole))
    slices = slices.drop("__di_n")
    slices = slices.select(F.col("__di_pid").alias("__di_p"), *[F.col(g).alias(f"__di_g{i}") for i, g in enumerate(group_cols)],
                           "__di_first", "__di_offset", *(["__di_total"] if total else []))
    same = F.col("__di_pid") == F.col("__di_p")
    for i, g in enumerate(group_cols):
        same = same & F.col(g).eqNullSafe(F.col(f"__di_g{i}"))
    joined = ranged.join(slices, same, "inner").drop("__di_p", *[f"__di_g{i}" for i in range(len(group_cols))])
    out = (joined.withColumn(name, (F.col("__di_offset") + F.col("__di_pos") - F.col("__di_first") + 1).cast("bigint"))
                 .drop("__di_pid", "__di_pos", "__di_first", "__di_offset"))
    return out.withColumnRenamed("__di_total", total) if total else out


def previous_row(df: DataFrame, group_cols: list[str], index_col: str, carry: list[str],
                 prefix: str = "prev_") -> DataFrame:
    """Left-join every row with the row one position earlier in its group.

    ``carry`` columns of the earlier row come back as ``prefix + column``
    (null for the first row).  Needs a dense ``index_col``.
    """
    keys = [*group_cols, index_col]
    prev = df.select(*[F.col(g).alias(f"__pr_{g}") for g in group_cols], (F.col(index_col) + 1).alias(f"__pr_{index_col}"),
                     *[F.col(c).alias(prefix + c) for c in carry])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__pr_{k}"))
    # Both sides are the whole input: never broadcast, sort-merge (spills) on a unique key.
    return df.join(prev.hint("merge"), same, "left").drop(*[f"__pr_{k}" for k in keys])


def _shifted(groups: list[str], carry: list[str], prefix: str):
    """Rows of one sorted partition with the values of the row before, null where the group changes;
    ``__first`` and ``__last`` mark the partition's borders."""
    def run(batches):
        held = before = None  # the batch that may be the last, and the row before it
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield with_shift(held, before, False)
                before = held.slice(held.num_rows - 1)
            held = batch
        if held is not None:
            yield with_shift(held, before, True)

    def with_shift(batch, before, ends):
        n = batch.num_rows
        same = None
        for g in groups:
            a = shift(batch, before, g)
            b = batch.column(g)
            equal = pc.or_kleene(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            same = equal if same is None else pc.and_(same, equal)
        index = pa.array(range(n), pa.int64())
        opens = pc.and_(pc.equal(index, 0), before is None)
        same = pc.and_(same, pc.invert(opens)) if same is not None else pc.invert(opens)
        rows = pc.if_else(same, index, pa.scalar(None, pa.int64()))
        columns = [shift(batch, before, c).take(rows) for c in carry]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns, same, opens, pc.and_(pc.equal(index, n - 1), ends)],
                                          names=[*batch.schema.names, *[prefix + c for c in carry], "__has", "__first", "__last"])

    def shift(batch, before, name):
        column = batch.column(name)
        head = pa.nulls(1, column.type) if before is None else before.column(name)
        return pa.concat_arrays([head, column.slice(0, batch.num_rows - 1)])
    return run


def with_previous(df: DataFrame, group_cols: list[str], order_cols: list[str], carry: list[str], result: dict[str, Column],
                  keep: list[str], prefix: str = "prev_", num_partitions: int | None = None) -> DataFrame:
    """(``keep`` columns, ``result`` columns): every row against the previous one of its group in ``order_cols`` order.

    ``result`` may use the row's columns, ``prefix + c`` for the ``carry`` columns of the row before (null at
    the start of a group) and the flag ``has_prev``.  The order must be total within a group; a null group is a group.

    One exchange, by range, of ``keep``, groups, order and ``carry``: select digests into ``carry``, not texts.
    The result is computed inside the partitions, and only it is checkpointed, with the carried values of the two
    border rows of each partition (so ``result`` may use ``keep``, group and ``carry`` columns only).  The first rows of partitions (at most one per partition) are then
    compared with the last row before them that belongs to their group.
    """
    keys = [*group_cols, *order_cols]
    used = list(dict.fromkeys([*keep, *keys, *carry]))
    # A range exchange reads its input twice, the first time for a sample of the keys: signatures are not worked out for that.
    rows = stored(df.select(*used), "rows")
    ranged = _ranged(rows, num_partitions, keys).withColumn("__pid", F.spark_partition_id())
    fields = {f.name: f.dataType.simpleString() for f in ranged.schema.fields}
    schema = [*fields.items(), *((prefix + c, fields[c]) for c in carry), *((f, "boolean") for f in ("__has", "__first", "__last"))]
    shifted = ranged.mapInArrow(_shifted(group_cols, carry, prefix), ", ".join(f"`{c}` {t}" for c, t in schema))
    border = F.col("__first") | F.col("__last")
    held = list(dict.fromkeys([*group_cols, *carry]))
    # ``has_prev`` stands for the flag while the result is computed.
    local = shifted.withColumnRenamed("__has", "has_prev").select(
        *[F.col(c) for c in keep], *[e.alias(f"__r_{name}") for name, e in result.items()], "__pid", "__first", "__last",
        F.when(border, F.struct(*held, *[c for c in keep if c not in held])).alias("__row"))
    ensure_checkpoint_dir(df.sparkSession)
    local = local.checkpoint(eager=True)
    own = [*keep, *[F.col(f"__r_{name}").alias(name) for name in result]]
    # At most two rows per partition; a partition's first row comes before its last.
    borders = local.where("__first").select("__pid", F.lit(0).alias("__end"), "__row").unionByName(
        local.where("__last").select("__pid", F.lit(1).alias("__end"), "__row"))
    groups = [F.col(f"__row.{g}").alias(f"__g_{g}") for g in group_cols]
    before = Window.partitionBy(*[f"__g_{g}" for g in group_cols]).orderBy("__pid", "__end").rowsBetween(Window.unboundedPreceding, -1)
    carried = (borders.select("__pid", "__end", "__row", *groups)
                      .withColumn("__before", F.last(F.when(F.col("__end") == 1, F.col("__row")), ignorenulls=True).over(before))
                      .where("__end = 0"))
    heads = carried.select("__row.*", *[F.col(f"__before.{c}").alias(prefix + c) for c in carry], F.col("__before").isNotNull().alias("has_prev"))
    heads = heads.select(*keep, *[e.alias(name) for name, e in result.items()])
    return local.where(~F.col("__first")).select(*own).unionByName(heads)


def _summed(weight: str):
    """Running sum of ``weight`` over one partition, batch after batch."""
    def run(batches):
        total = 0
        for batch in batches:
            sums = pc.add(pc.cumulative_sum(batch.column(weight).cast(pa.int64())), total)
            if batch.num_rows:
                total = sums[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, sums], names=[*batch.schema.names, "__run"])
    return run


def running_total(df: DataFrame, order_cols: list[Column | str], weight: str, name: str = "running",
                  num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = sum of ``weight`` (whole, not null) over all rows up to and including this one in ``order_cols`` order.

    Weighted prefix sums: rows are range-partitioned, summed up inside each partition, and shifted by the totals of the
    partitions before (one number per partition, read by the driver).  No key is gathered in one task.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = _ranged(df, num_partitions, keys).withColumn("__pid", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    ensure_checkpoint_dir(df.sparkSession)
    summed = ranged.mapInArrow(_summed(weight), f"{schema}, __run long").checkpoint(eager=True)
    totals = {r["__pid"]: r["n"] for r in summed.groupBy("__pid").agg(F.max("__run").alias("n")).collect()}
    offsets, before = [], 0
    for pid in range(max(totals, default=-1) + 1):
        offsets.append(before)
        before += totals.get(pid, 0)
    offset = F.get(F.array(*[F.lit(x) for x in offsets]).cast("array<bigint>"), F.col("__pid"))
    return summed.withColumn(name, F.col("__run") + offset).drop("__pid", "__run")
