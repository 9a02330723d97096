"""Event contract: which columns an event needs and which values they may have."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankflow.schemas import DEVICES, EVENT_TYPES, SCREENS


@dataclass(frozen=True)
class EventContract:
    required: tuple[str, ...] = (
        "event_id", "customer_id", "event_timestamp", "event_type", "session_id", "app_version",
    )
    domains: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "event_type": EVENT_TYPES, "screen_name": SCREENS, "device_type": DEVICES,
        }
    )
    time_column: str = "event_timestamp"


APP_EVENT_CONTRACT = EventContract()


def validate_events(events: DataFrame, contract: EventContract = APP_EVENT_CONTRACT) -> DataFrame:
    """Adds ``reason``: NULL for a good event, else what is wrong with it.

    The time becomes a timestamp; text that is no time becomes NULL and thus a reason. All checks
    are expressions of one row, so they run alike on a stream and on a table. The time as it came
    stays in ``raw_<time column>``, which only invalid events keep.
    """
    typed = events.withColumn(
        _raw_time(contract), F.col(contract.time_column).cast("string")
    ).withColumn(
        contract.time_column, F.col(contract.time_column).try_cast("timestamp")
    )
    failures = [
        F.when(F.col(c).isNull(), F.lit(f"{c} is missing or unreadable"))
        for c in contract.required
    ]
    failures += [
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), F.lit(f"{c} is unknown"))
        for c, allowed in contract.domains.items()
    ]
    return typed.withColumn("reason", F.nullif(F.concat_ws("; ", *failures), F.lit("")))


def split_valid(
    validated: DataFrame, contract: EventContract = APP_EVENT_CONTRACT
) -> tuple[DataFrame, DataFrame]:
    """Valid events without the reason, and invalid events with it and their time as it came."""
    valid = validated.filter(F.col("reason").isNull()).drop("reason", _raw_time(contract))
    return valid, validated.filter(F.col("reason").isNotNull())


def _raw_time(contract: EventContract) -> str:
    return f"raw_{contract.time_column}"
