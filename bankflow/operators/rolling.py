"""Rolling counts and sums over a time range, safe for very hot keys.

A range frame asked for directly makes Spark add up the frame again for every row, and puts a key
into one task. Here every row writes two marks on a time line: plus its value when it enters the
frame and minus its value when it leaves. The rolling value is then a running sum over the marks,
which costs one pass. Running sums also add up over slices of time, so a hot key is cut into slices
that different tasks handle, with the total of the earlier slices carried in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bankflow.functions import micros

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000
_SUM_TYPE = "decimal(25,2)"


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("key_rows"))


def hot_keys(
    counts: DataFrame, key: str, hot_rows: int = HOT_ROWS, max_keys: int = MAX_HOT_KEYS
) -> DataFrame:
    """Keys with more than ``max(hot_rows, total / max_keys)`` rows.

    Each listed key holds more than ``total / max_keys`` rows, so there are fewer than ``max_keys``
    of them: the list may be broadcast at any data size.
    """
    total = counts.agg(F.sum("key_rows")).scalar()
    return counts.filter(
        F.col("key_rows") > F.greatest(F.lit(float(hot_rows)), total / F.lit(max_keys))
    ).select(F.col(key).alias("_hot_key"))


def rolling_plain(
    rows: DataFrame,
    *,
    seconds: int,
    exclude_current: bool = False,
    amount: str = "amount",
    key: str = "customer_id",
    time: str = "txn_date",
) -> DataFrame:
    """The range frame as written, as the check of :func:`rolling_totals`."""
    frame = (
        Window.partitionBy(key)
        .orderBy("_at")
        .rangeBetween(-seconds * 1_000_000, -1 if exclude_current else 0)
    )
    return (
        rows.withColumn("_at", micros(time))
        .withColumn("window_rows", F.count("*").over(frame))
        .withColumn("window_sum", F.sum(amount).over(frame).cast(_SUM_TYPE))
        .drop("_at")
    )


@dataclass(frozen=True)
class Lane:
    """One rolling frame on a shared time line: rows of the last ``seconds``, both ends included.

    With ``exclude_current`` the frame ends one microsecond earlier, which leaves out the row itself and
    its peers. ``total`` asks for the sum of the amounts besides the number of rows.
    """

    name: str
    seconds: int
    exclude_current: bool = False
    total: bool = True

    @property
    def gap(self) -> int:
        return 1 if self.exclude_current else 0

    @property
    def stay(self) -> int:
        return self.seconds * 1_000_000 + 1 - self.gap

    @property
    def columns(self) -> list[str]:
        return [f"{self.name}_rows", *([f"{self.name}_sum"] if self.total else [])]


def rolling_totals(
    rows: DataFrame,
    *,
    seconds: int,
    exclude_current: bool = False,
    amount: str = "amount",
    key: str = "customer_id",
    time: str = "txn_date",
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    slice_seconds: int = 60,
) -> DataFrame:
    """Adds ``window_rows`` and ``window_sum`` over the last ``seconds`` of each row's key."""
    return rolling_lanes(
        rows,
        [Lane("window", seconds, exclude_current)],
        amount=amount,
        key=key,
        time=time,
        counts=counts,
        hot_rows=hot_rows,
        slice_seconds=slice_seconds,
    )


def rolling_lanes(
    rows: DataFrame,
    lanes: list[Lane],
    *,
    amount: str = "amount",
    key: str = "customer_id",
    time: str = "txn_date",
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    slice_seconds: int = 60,
) -> DataFrame:
    """Adds ``<lane>_rows`` and ``<lane>_sum`` for several frames in one sweep.

    All lanes share the mark of a row's arrival and have a mark each for its leaving, so they cost one
    exchange and one sort together. ``counts`` may pass rows per key (``key_rows``) when the caller can
    get them more cheaply than by counting ``rows``.

    Keys up to the hot limit take one shuffle by key. A hot key never meets in one task: its rows
    are reduced to instants, spread over slices of ``slice_seconds``, and only one total per slice
    is gathered. When no key is hot, AQE drops that branch once the key list turns out empty.
    """
    timed = rows.withColumn("_at", micros(time)).withColumn(
        "_amount", F.col(amount).cast(_SUM_TYPE)
    )
    hot = F.broadcast(hot_keys(key_counts(rows, key) if counts is None else counts, key, hot_rows))
    is_hot = timed[key].eqNullSafe(F.col("_hot_key"))
    cold_rows = timed.join(hot, is_hot, "left_anti")
    hot_part = timed.join(hot, is_hot, "left_semi")
    results = [name for lane in lanes for name in lane.columns]
    output = [*rows.columns, *results]

    # Dealt out by key before rows become several marks: the running sums keep this partitioning.
    dealt = cold_rows.withColumn("_rows", F.lit(1)).repartition(key)
    cold_result = _running(_marks(dealt, key, lanes), [key], lanes).select(*output)

    instants = hot_part.groupBy(key, "_at").agg(
        F.count("*").alias("_rows"), F.sum("_amount").cast(_SUM_TYPE).alias("_amount")
    )
    hot_values = _sliced(instants, key, lanes, slice_seconds).select(
        F.col(key).alias("_key"), F.col("_at").alias("_instant"), *results
    )
    hot_result = hot_part.join(
        hot_values,
        hot_part[key].eqNullSafe(hot_values["_key"]) & (hot_part["_at"] == hot_values["_instant"]),
    ).select(*output)
    return cold_result.unionByName(hot_result)


def _steps(lane: int) -> list[str]:
    return [f"_rows_{lane}", f"_sum_{lane}"]


def _marks(rows: DataFrame, key: str, lanes: list[Lane]) -> DataFrame:
    """Each row once as it enters, with its columns, and once per lane as it leaves, bare.

    ``_rows_<i>`` and ``_sum_<i>`` are what a mark adds to lane ``i``.
    """
    kept = {"_at", "_amount", "_rows", key}
    sides = F.explode(F.array(*[F.lit(i) for i in range(-1, len(lanes))]))
    sided = rows.withColumn("_side", sides)
    entering = F.col("_side") == -1
    payload = [F.when(entering, F.col(c)).alias(c) for c in rows.columns if c not in kept]
    mark, steps = F.when(entering, F.col("_at")), []
    for i, lane in enumerate(lanes):
        leaving = F.col("_side") == i
        mark = mark.when(leaving, F.col("_at") + lane.stay)
        for source, name in zip(("_rows", "_amount"), _steps(i)):
            step = F.when(entering, F.col(source)).when(leaving, -F.col(source))
            steps.append((step.cast("bigint") if source == "_rows" else step).alias(name))
    return sided.select(key, "_side", "_at", mark.alias("_mark"), *steps, *payload)


def _running(marks: DataFrame, parts: list[str], lanes: list[Lane]) -> DataFrame:
    """Running sums of the marks at the entering rows; sums are NULL while no row is in the frame."""
    summed = marks
    for i, lane in enumerate(lanes):
        until = (
            Window.partitionBy(*parts)
            .orderBy("_mark")
            .rangeBetween(Window.unboundedPreceding, -lane.gap)
        )
        for name in _steps(i)[: len(lane.columns)]:
            summed = summed.withColumn(f"_run{name}", F.sum(name).over(until))
    found = summed.filter("_side = -1")
    for i, lane in enumerate(lanes):
        rows, total = (_carried(marks, name) for name in _steps(i))
        found = found.withColumn(f"{lane.name}_rows", rows.cast("bigint"))
        if lane.total:
            found = found.withColumn(
                f"{lane.name}_sum", F.when(F.col(f"{lane.name}_rows") > 0, total.cast(_SUM_TYPE))
            )
    return found


def _carried(marks: DataFrame, name: str) -> Column:
    """The running value of a step column, with what earlier slices carry in."""
    value = F.coalesce(F.col(f"_run{name}"), F.lit(0))
    carry = f"_carry{name}"
    return value + F.coalesce(F.col(carry), F.lit(0)) if carry in marks.columns else value


def _sliced(
    instants: DataFrame, key: str, lanes: list[Lane], slice_seconds: int
) -> DataFrame:
    """Running sums inside time slices plus the total of the key's earlier slices."""
    width = slice_seconds * 1_000_000
    marks = _marks(instants, key, lanes).withColumn(
        "_slice", F.floor(F.col("_mark") / F.lit(width)).cast("bigint")
    )
    earlier = (
        Window.partitionBy(key)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    names = [name for i in range(len(lanes)) for name in _steps(i)]
    carry = (
        marks.groupBy(key, "_slice")
        .agg(*[F.sum(name).alias(name) for name in names])
        .select(
            F.col(key).alias("_carry_key"),
            F.col("_slice").alias("_carry_slice"),
            *[
                F.sum(name).over(earlier).cast(
                    "bigint" if name.startswith("_rows") else _SUM_TYPE
                ).alias(f"_carry{name}")
                for name in names
            ],
        )
    )
    with_carry = marks.join(
        carry,
        marks[key].eqNullSafe(carry["_carry_key"]) & (marks["_slice"] == carry["_carry_slice"]),
    )
    return _running(with_carry, [key, "_slice"], lanes)
