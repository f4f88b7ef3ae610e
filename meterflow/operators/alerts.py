"""Threshold alerts on slices, routing, pacing and message payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions.slices import round2
from meterflow.operators.folds import cooldown, paced
from meterflow.operators.windows import house_avg_watt, rollup
from meterflow.schemas import DEVICE, SLICE

# Notification types and default limits.
UNDER_MIN, ABOVE_USUAL, OVER_MAX = -1, 0, 1
ALERT_WINDOW_MIN = 5
DEVICE_MAX_W = 2000.0
HOUSE_MAX_W = 20000.0
GLOBAL_TOPIC = "iot-notification"


def slice_start_ms(day: str = "read_date", gap: str = "slice_gap", index: str = "slice_index") -> Column:
    minutes = F.col(index).cast("long") * F.col(gap)
    return F.unix_date(day).cast("long") * 86_400_000 + minutes * 60_000


def attach_house_avg(slices: DataFrame, own: str = "slice_avg", averages: DataFrame | None = None) -> DataFrame:
    """House average beside each device slice; a device without one falls back to its own average.

    The averages have one row per house and come out of a partial aggregation; Catalyst broadcasts them when
    their size allows it and AQE splits a hot house otherwise.
    """
    known = house_avg_watt(slices) if averages is None else averages
    return slices.join(known, "house_id", "left").withColumn("house_avg", F.coalesce("house_avg", F.col(own)))


def device_overload(slices: DataFrame, limit: float = DEVICE_MAX_W, gap: int = ALERT_WINDOW_MIN) -> DataFrame:
    """Device slices of ``gap`` minutes whose average exceeds the limit, as notifications; other sizes in the table are left out.

    Averages are taken over all slices, the join then only sees the few overloaded ones.
    """
    slices = slices.where(F.col("slice_gap") == gap)
    averaged = slices.where(F.col("value_count") > 0).withColumn("slice_avg", F.col("value_sum") / F.col("value_count"))
    over = averaged.where(F.col("slice_avg") > limit)
    return attach_house_avg(over, averages=house_avg_watt(slices)).select(
        *DEVICE,
        *SLICE,
        F.lit(OVER_MAX).alias("type"),
        round2("slice_avg").alias("value"),
        F.lit(float(limit)).alias("max"),
        round2("house_avg").alias("avg"),
        slice_start_ms().alias("event_ms"),
    )


def house_overload(slices: DataFrame, limit: float = HOUSE_MAX_W, gap: int = ALERT_WINDOW_MIN) -> DataFrame:
    """House slices of ``gap`` minutes whose device averages add up to more than the limit."""
    total = round2("value_sum")
    return (
        rollup(slices.where(F.col("slice_gap") == gap), "house")
        .where((F.col("value_count") > 0) & (F.col("value_sum") > limit))
        .select(
            "house_id",
            *SLICE,
            F.lit(OVER_MAX).alias("type"),
            total.alias("value"),
            F.lit(float(limit)).alias("max"),
            total.alias("avg"),
            slice_start_ms().alias("event_ms"),
        )
    )


def threshold_cooldown(overloads: DataFrame, keys: list[str], wait_ms: int, partitions: int | None = None) -> DataFrame:
    """Slices in time order; the next one fires only strictly later than ``wait_ms`` after the last fired one."""
    return cooldown(overloads, keys, ["event_ms", "slice_gap"], wait_ms, strict=True, partitions=partitions)


def notification_class(value: Column, low: Column | None, usual: Column | None, high: Column | None) -> Column:
    """Over the maximum, else under the minimum, else above the usual value; null when none applies."""
    kind = F.when(value > high, OVER_MAX) if high is not None else F.when(F.lit(False), OVER_MAX)
    if low is not None:
        kind = kind.when(value < low, UNDER_MIN)
    if usual is not None:
        kind = kind.when(value > usual, ABOVE_USUAL)
    return kind


def route_alerts(alerts: DataFrame, routes: DataFrame, default_url: str = "") -> DataFrame:
    """Destination per alert: the house's own route, else the default; ``dropped`` when there is neither.

    ``routes`` has unique houses. No broadcast is forced: Catalyst decides by the size of the route table.
    """
    own = routes.select("house_id", F.when(F.trim("url") != "", F.trim("url")).alias("_own"))
    url = F.coalesce("_own", F.lit(default_url.strip()))
    routed = alerts.join(own, "house_id", "left").withColumn("url", url).drop("_own")
    return routed.withColumn("dropped", F.col("url") == "")


def dispatch_schedule(
    routed: DataFrame, min_interval_ms: int = 1000, order: list[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """Send time per alert, spaced per destination; one busy destination never delays another."""
    order = order or ["event_ms", "event_id"]
    return paced(routed.where(~F.col("dropped")), ["url"], order, min_interval_ms, partitions=partitions)


def topic_name(level: str) -> Column:
    if level == "device":
        return F.format_string("device-%d-%d-%d-notification", *[F.col(k) for k in DEVICE])
    return F.format_string("house-%d-notification", F.col("house_id"))


def notification_json(level: str) -> Column:
    ids = [F.col("house_id").alias("houseId")]
    if level == "device":
        ids += [F.col("household_id").alias("householdId"), F.col("plug_id").alias("deviceId")]
    return F.to_json(
        F.struct(
            "type", *ids, "value", "max", "avg", F.col("slice_gap").alias("windowMin"), F.col("event_ms").alias("ts")
        )
    )


def notify_fanout(notifications: DataFrame, level: str, global_topic: str = GLOBAL_TOPIC) -> DataFrame:
    """Each notification once for its entity's topic and once for the common one."""
    return notifications.select(
        "*", F.explode(F.array(topic_name(level), F.lit(global_topic))).alias("topic"), notification_json(level).alias("payload")
    )


def alert_message_json(tag: str = "METER-ALERT") -> Column:
    """Chat message with header, section and context blocks, and a plain text fallback."""
    critical = F.col("severity") == "CRITICAL"
    # Message wording and block layout.
    header = F.format_string(
        f"%s [{tag}] %s — House #%d / Household %d / Plug %d",
        F.when(critical, "🚨").otherwise("⚠️"),
        F.when(critical, "CRITICAL").otherwise("WARNING"),
        *[F.col(k) for k in DEVICE],
    )
    sigma = F.when(F.col("type") == "Z_SCORE", F.format_string("*Deviation:* %.1fσ", F.col("z_score")))
    detail = F.concat_ws(
        "\n",
        F.format_string("*Reading:* %.0f W", F.col("value")),
        F.format_string("*Baseline (EWMA):* %.0f W", F.col("mean_before")),
        sigma,
        F.concat(F.lit("*Why:* "), F.col("reason")),
    )
    context = F.format_string(
        "⏱ %s  |  Gateway: %s  |  Detector: %s",
        F.date_format(F.timestamp_millis("event_ms"), "yyyy-MM-dd HH:mm:ss"),
        F.col("gateway_id"),
        F.col("type"),
    )

    def text(kind: str, content: Column, emoji: Column | None = None) -> Column:
        parts = [F.lit(kind).alias("type"), content.alias("text")]
        return F.struct(*parts, *([emoji.alias("emoji")] if emoji is not None else []))

    # One array needs one element type; absent members are left out of the JSON because they are null.
    text_type = "struct<type:string,text:string,emoji:boolean>"
    none_text, none_elements = F.lit(None).cast(text_type), F.lit(None).cast(f"array<{text_type}>")
    no_emoji = F.lit(None).cast("boolean")

    def block(kind: str, body: Column, elements: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), body.alias("text"), elements.alias("elements"))

    blocks = F.array(
        block("header", text("plain_text", header, F.lit(True)), none_elements),
        block("section", text("mrkdwn", detail, no_emoji), none_elements),
        block("context", none_text, F.array(text("mrkdwn", context, no_emoji))),
    )
    return F.to_json(F.struct(header.alias("text"), blocks.alias("blocks")))
