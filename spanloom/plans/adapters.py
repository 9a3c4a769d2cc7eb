"""The given tables read as captures: plain projections, which SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that a task takes; those of orders are sorted for more windows at once.
TASK_ROWS = {"lineitem": 250_000, "orders": 100_000}


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """How many partitions the rows of a table make, so that tasks stay as large however long the table; counted from its footers."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // TASK_ROWS[name]))


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """All lines of a customer in one of n partitions, in which windows, the steps that lines are split into and a replay leave them."""
    return rows.repartition(n, "o_custkey")


#: What orders the lines of an order, as line numbers alone may repeat; rows that agree in all of it are alike.
WITHIN = "l_linenumber, l_returnflag, ns, l_partkey, l_suppkey"


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order, numbered within it, and whether they are its last.

    Lines go from the join straight to their customer's partition and are sorted there once: windows over an order, windows over a
    customer in ``WITHIN``'s order and ``in_order`` all find them as they need them.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("ns"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    rows = dealt(lines.join(orders, lines.l_orderkey == orders.o_orderkey).drop("l_orderkey"), parts(spark, sf_dir, "lineitem"))
    order = f"OVER (PARTITION BY o_custkey, o_orderkey ORDER BY {WITHIN})"
    return rows.selectExpr("*", f"row_number() {order} AS nth", f"lead(1) {order} IS NULL AS last")


def in_order(rows: DataFrame) -> DataFrame:
    """Lines of each customer one after another, before they are split into steps, so that many fewer and narrower rows are sorted than a replay reads."""
    return rows.sortWithinPartitions("o_custkey", "o_orderkey", *WITHIN.split(", "))


def _steps(*cases: str) -> str:
    """SQL of the steps of the first condition that holds, none if none does; of plain literals, so that it compiles."""
    pairs = zip(cases[::2], cases[1::2], strict=True)
    return f"CASE {' '.join(f'WHEN {when} THEN array({steps})' for when, steps in pairs)} ELSE CAST(array() AS ARRAY<INT>) END"


def call_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each customer and a core for each order key modulo 4; in order, as for a replay.

    An order is an activation ``order-<status>`` of task ``t<core>``; its lines are children
    ``line-<flag>`` that last as many nanoseconds as their quantity, end to end, orders one after another.
    """
    # a sum for each core in the one order, as a window for each core would sort twice more; remainders of negative keys are cores, too
    until = [f"WHEN {core} THEN sum(if(o_orderkey % 4 = {core}, ns, NULL)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey, {WITHIN} ROWS UNBOUNDED PRECEDING)" for core in range(-3, 4)]
    rows = in_order(order_lines(spark, sf_dir).selectExpr("*", "o_orderkey % 4 AS core_id", f"CASE o_orderkey % 4 {' '.join(until)} END AS until_ns"))
    rows = rows.selectExpr("concat('cust-', o_custkey) AS session_id", "core_id", "o_orderkey", "concat('order-', o_orderstatus) AS outer_id", "concat('line-', l_returnflag) AS inner_id", "ns", "nth", "last", "until_ns")
    steps = _steps("nth = 1 AND last", "0, 1, 2, 3", "nth = 1", "0, 1, 2", "last", "1, 2, 3", "true", "1, 2")
    each = rows.selectExpr("*", f"explode({steps}) AS step")
    return each.selectExpr(
        "session_id", "(o_orderkey * 1000 + nth) * 4 + step AS ord", "concat('core-', core_id) AS source_id", "'exact' AS quality", "if(step < 2, 'FunctionEnter', 'FunctionExit') AS type", "if(step < 2, until_ns - ns, until_ns) AS ts_ns",
        "core_id", "concat('t', core_id) AS context_id", "if(step IN (0, 3), outer_id, inner_id) AS function_id",
    )


def busy_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each customer on one core, whose orders follow one another, with everything that real captures hold; in order, as for a replay.

    An order lasts as long as its lines, a nanosecond a unit of quantity. Every seventh order key is idle time, which an instant ends. Else its
    task is switched to and calls ``order``; lines of odd number are calls ``line-<flag>``, those of even number
    interrupts ``irq-<flag>`` that call ``handler``. Of every fifth order key, a last call ``lost`` never returns; after
    every eleventh follows a gap of 3 ns, after every thirteenth a return that no call goes with.
    """
    rows = order_lines(spark, sf_dir).selectExpr("*", "if(last AND o_orderkey % 11 = 0, 3, 0) AS pause")
    rows = in_order(rows.selectExpr("*", f"sum(ns + pause) OVER (PARTITION BY o_custkey ORDER BY o_orderkey, {WITHIN} ROWS UNBOUNDED PRECEDING) - pause AS until_ns"))
    rows = rows.selectExpr(
        "concat('cust-', o_custkey) AS session_id", "o_orderkey", "nth", "last", "l_linenumber", "ns", "until_ns", "concat('t', o_orderkey % 3) AS task", "o_orderkey % 7 <> 0 AS busy", "l_linenumber % 2 = 1 AS odd",
        "concat('line-', l_returnflag) AS call", "concat('irq-', l_returnflag) AS irq",
    )
    steps = [
        _steps("nth = 1 AND busy", "0, 1", "nth = 1", "0"), _steps("busy AND NOT odd", "2, 3, 4, 5", "busy", "3, 4"), _steps("last AND busy AND o_orderkey % 5 = 0", "6, 7", "last", "7"),
        _steps("last AND busy AND o_orderkey % 13 = 0", "8"), _steps("last AND o_orderkey % 11 = 0", "9"),
    ]
    each = rows.selectExpr("*", f"explode(concat({', '.join(steps)})) AS step")
    return each.selectExpr(
        "session_id", "(o_orderkey * 1000 + nth) * 10 + step AS ord", "'probe' AS source_id", "'exact' AS quality", "if(step < 9, CAST(0 AS BIGINT), NULL) AS core_id",
        "CASE WHEN step = 0 THEN 'ContextSwitch' WHEN step IN (1, 3, 6) THEN 'FunctionEnter' WHEN step = 2 THEN 'InterruptEnter' WHEN step = 5 THEN 'InterruptExit' WHEN step = 9 THEN 'TraceGap' WHEN step = 7 AND NOT busy THEN 'Instant' ELSE 'FunctionExit' END AS type",
        "if(step < 4, until_ns - ns, until_ns) AS ts_ns", "CASE WHEN step IN (3, 4) THEN if(odd, task, irq) WHEN step IN (1, 6, 8) OR step = 7 AND busy THEN task END AS context_id",
        "CASE WHEN step IN (3, 4) THEN if(odd, call, 'handler') WHEN step = 1 OR step = 7 AND busy THEN 'order' WHEN step = 6 THEN 'lost' WHEN step = 8 THEN 'ghost' END AS function_id",
        "if(step = 0, if(busy, task, 'idle'), NULL) AS next_context_id", "if(step IN (2, 5), irq, NULL) AS interrupt_id", "if(step IN (2, 5), CAST(l_linenumber AS STRING), NULL) AS activation_id", "if(step = 9, CAST(3 AS BIGINT), NULL) AS duration_ns",
    )


def counter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user, a counter for each event type; clicks count as monotonic, views as ratios."""
    behaviour = F.when(F.col("event_type") == "click", "monotonic").when(F.col("event_type") == "view", "high_watermark").otherwise("gauge")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("counter_id"), F.col("event_id").alias("ord"), (F.unix_micros(F.col("ts").cast("timestamp_ltz")) * 1000).alias("ts_ns"), "value", behaviour.alias("behaviour"), F.lit(False).alias("whole"), F.lit("exact").alias("quality"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source_id"), F.col("event_id").alias("source_seq"), F.lit(0).cast("bigint").alias("core_id"),
    )


def pc_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address for each event, over the 64 bytes of each part."""
    span = F.broadcast(table(spark, sf_dir, "part").agg((F.max("p_partkey") * 64).alias("span")))  # one row
    events = table(spark, sf_dir, "events").crossJoin(span)
    return events.select(F.concat(F.lit("user-"), (F.col("user_id") % 10).cast("string")).alias("session_id"), F.expr("4096 + event_id * 37 % span").alias("address"), F.col("event_type").alias("context_id"), F.lit(None).cast("bigint").alias("weight_ns"))


def pc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of 64 bytes for each part, in the session that its key belongs to by its last digit and in the next one."""
    own = F.array(F.col("p_partkey") % 10, (F.col("p_partkey") + 1) % 10)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(own).alias("user")).select(F.concat(F.lit("user-"), F.col("user").cast("string")).alias("session_id"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("function_id"), F.expr("4096 + 64 * (p_partkey - 1)").alias("start"), F.expr("4096 + 64 * p_partkey").alias("end"))


def stack_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf-to-root stack for each order: status, customer group, priority."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("s-"), (F.col("o_custkey") % 8).cast("string")).alias("session_id"), F.when(F.col("o_orderkey") % 5 == 0, "truncated").otherwise("terminal").alias("termination"), F.array(F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("frames"))
