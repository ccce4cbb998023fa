"""A grid of tasks in which each block of one side meets each block of the other once, without a cross join.

A left block goes to one row of the grid and is copied to its columns, a right block to one column and copied to its
rows. Copies grow with the sides of the grid, and the work with its area. Both sides are dealt out by the grid's cells
into as many tasks as it has, and met by a sort-merge join, so what a task holds at a time is the right blocks of one
cell: a bounded number, whatever spark.sql.shuffle.partitions is, as the grid grows with the blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tiles that a task multiplies, on average, once there are more than tasks.
TASK_TILES = 256


def sides(left_blocks: int, right_blocks: int, width: int, weight: float = 1.0) -> tuple[int, int]:
    """Rows (of left blocks) and columns (of right blocks) of the grid, near to square in bytes; weight: bytes of a right block for one of a left one."""
    tasks = max(min(width, left_blocks * right_blocks), left_blocks * right_blocks // TASK_TILES)
    columns = min(right_blocks, max(1, math.ceil(math.sqrt(tasks * right_blocks * weight / left_blocks))))
    return min(left_blocks, -(-tasks // columns)), columns


def tiles(left: DataFrame, right: DataFrame, rows: int, columns: int, by: str) -> DataFrame:
    """Each left block beside each right block of the same dim; by: the binary column that deals a block out, and by which left blocks follow each other."""

    def copied(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        dealt = df.withColumn(own, F.pmod(F.xxhash64(by), F.lit(own_n)).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))).repartition(rows * columns, "dim", "line", "column")

    a = copied(left, "line", rows, "column", columns)
    b = copied(right, "column", columns, "line", rows)
    b = b.select("dim", "line", "column", *(F.col(c).alias(f"c_{c}") for c in right.columns if c != "dim"))
    return a.join(b.hint("merge"), ["dim", "line", "column"])
