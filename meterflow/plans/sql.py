"""SQL building blocks of the oracle texts."""

from __future__ import annotations

IDS = "house_id, household_id, plug_id"


def readings(layout: str = "wide") -> str:
    """CTEs ``readings`` and ``loads`` over the events table."""
    house, household = {
        "wide": ("user_id % 40", "user_id // 40"),
        "dense": ("user_id % 5", "(user_id // 5) % 2"),
    }[layout]
    return f"""readings AS MATERIALIZED (
  SELECT event_id, epoch_us(ts) // 1000 AS event_ms, value,
         CAST(event_type <> 'error' AS INT) AS property,
         CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3
              ELSE -1 END AS INT) AS plug_id,
         CAST({household} AS INT) AS household_id, CAST({house} AS INT) AS house_id
  FROM events),
loads AS MATERIALIZED (SELECT * FROM readings WHERE property = 1)"""


def day_text(ms: str = "event_ms") -> str:
    return f"strftime(DATE '1970-01-01' + CAST({ms} // 86400000 AS INT), '%Y-%m-%d')"


def slices(gaps: list[int], name: str = "slices", source: str = "loads") -> str:
    """CTE of device slices for the given window sizes."""
    return f"""{name} AS MATERIALIZED (
  SELECT {IDS}, {day_text()} AS read_date, slice_gap,
         CAST((event_ms % 86400000) // (slice_gap * 60000) AS INT) AS slice_index,
         count(*) AS value_count, round(sum(value), 6) AS value_sum, max(event_ms) AS event_ts
  FROM (SELECT *, CAST(unnest({gaps}) AS INT) AS slice_gap FROM {source})
  GROUP BY ALL)"""


def rollup(level: str, name: str, source: str = "slices") -> str:
    keys = {"household": "house_id, household_id", "house": "house_id"}[level]
    return f"""{name} AS MATERIALIZED (
  SELECT {keys}, read_date, slice_gap, slice_index, count(*) AS value_count,
         round(sum(CASE WHEN value_count > 0 THEN value_sum / value_count ELSE 0 END), 9) AS value_sum
  FROM {source} GROUP BY {keys}, read_date, slice_gap, slice_index)"""


def flushes(gap: int = 30, name: str = "flushes") -> str:
    """CTE of cumulative flushes in mid-slice and at slice end."""
    ms = gap * 60_000

    def part(offset: int, condition: str) -> str:
        return f"""SELECT {IDS}, {day_text()} AS read_date, CAST({gap} AS INT) AS slice_gap,
         CAST((event_ms % 86400000) // {ms} AS INT) AS slice_index,
         event_ms - event_ms % {ms} + {offset} AS flush_ts, count(*) AS value_count, round(sum(value), 6) AS value_sum,
         max(event_ms) AS event_ts
  FROM loads WHERE {condition} GROUP BY ALL"""

    return f"{name} AS MATERIALIZED (\n  {part(ms // 2, f'event_ms % {ms} < {ms // 2}')}\n  UNION ALL\n  {part(ms, 'true')})"


def device_view(source: str = "flushes", name: str = "device") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT {IDS}, read_date, slice_gap, slice_index, arg_max(value_count, flush_ts) AS value_count,
         arg_max(value_sum, flush_ts) AS value_sum, max(event_ts) AS event_ts,
         min(flush_ts) AS first_written_at, max(flush_ts) AS updated_at
  FROM {source} GROUP BY {IDS}, read_date, slice_gap, slice_index)"""


SAFE_AVG = "CASE WHEN value_count > 0 THEN value_sum / value_count ELSE 0 END"


def round2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def label(day: str = "read_date", gap: str = "slice_gap", index: str = "slice_index") -> str:
    def clock(minutes: str) -> str:
        return f"right('0' || CAST(({minutes}) // 60 AS VARCHAR), 2) || ':' || right('0' || CAST(({minutes}) % 60 AS VARCHAR), 2)"

    start, end = f"{index} * {gap}", f"({index} + 1) * {gap}"
    return f"replace({day}, '-', '/') || ' ' || {clock(start)} || '->' || {clock(end)}"


def gateway(house: str = "house_id") -> str:
    return f"'gw-0' || CAST({house} // 5 + 1 AS VARCHAR)"


SAMPLES = """samples AS MATERIALIZED (
  SELECT event_id, plug_id, event_ms / 1000.0 AS epoch, 'gw-0' || CAST(house_id // 5 + 1 AS VARCHAR) AS gateway_id,
         value / 400.0 AS cap, CASE WHEN property = 1 THEN value END AS lat, CAST(event_id AS DOUBLE) AS ack,
         CAST(event_id AS DOUBLE) AS tup, CASE WHEN plug_id <> 3 THEN value / 500.0 END AS gwcap,
         CASE WHEN plug_id <> 1 THEN CAST(event_id AS DOUBLE) * 512 END AS wan_rx
  FROM readings)"""

STEPS = """steps AS MATERIALIZED (
  SELECT event_ms // 86400000 AS day, CAST(day(epoch_ms(min(event_ms))) AS INT) AS houses,
         min(event_ms) / 1000.0 AS step_start, min(event_ms) / 1000.0 + 43200 AS step_end
  FROM readings GROUP BY 1)"""

IN_STEP = """joined AS MATERIALIZED (
  SELECT s.*, t.day, t.houses FROM samples s JOIN steps t ON s.epoch >= t.step_start + 600 AND s.epoch <= t.step_end)"""


def baseline(alpha: float, keys: str, source: str, value: str) -> str:
    """Recursive CTE ``fold``: state before and after each row, in time order per key."""
    first = keys.split(", ")
    same = " AND ".join(f"o.{k} = f.{k}" for k in first)
    own = ", ".join(f"o.{k}" for k in first)
    gap = f"(o.{value} - f.mean_after)"
    return f"""o AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY event_ms, event_id) AS rn FROM {source}),
fold AS (
  SELECT {keys}, rn, event_id, event_ms, {value} AS x, CAST(0 AS DOUBLE) AS mean_before, CAST(0 AS DOUBLE) AS var_before,
         CAST(0 AS BIGINT) AS seen_before, {value} AS mean_after, CAST(0 AS DOUBLE) AS var_after
  FROM o WHERE rn = 1
  UNION ALL
  SELECT {own}, o.rn, o.event_id, o.event_ms, o.{value}, f.mean_after, f.var_after, CAST(o.rn - 1 AS BIGINT),
         f.mean_after + {alpha} * {gap}, {1 - alpha} * (f.var_after + {alpha} * {gap} * {gap})
  FROM fold f JOIN o ON {same} AND o.rn = f.rn + 1)"""


def classified(ceiling: float, warmup: int, z: float) -> str:
    """CTEs ``scored`` on top of ``fold``."""
    return f"""distances AS MATERIALIZED (
  SELECT *, CASE WHEN seen_before >= {warmup} THEN (x - mean_before) / greatest(sqrt(greatest(var_before, 0)), 1.0)
            ELSE 0 END AS dist FROM fold),
scored AS MATERIALIZED (
  SELECT *, CASE WHEN x >= {ceiling} THEN 'HARD_CEILING' WHEN abs(dist) >= {z} THEN 'Z_SCORE' ELSE 'NORMAL' END AS type,
         CASE WHEN x >= {ceiling} THEN 0 ELSE dist END AS z_score FROM distances)"""


def cooled(keys: str, source: str, order: str, wait: int, strict: bool, extra: str) -> str:
    """Recursive CTE ``cool`` with a ``fired`` flag per row; needs ``event_ms``."""
    first = keys.split(", ")
    same = " AND ".join(f"c.{k} = f.{k}" for k in first)
    own = ", ".join(f"c.{k}" for k in first)
    more, more_own = (f", {extra}", "".join(f", c.{e.strip()}" for e in extra.split(","))) if extra else ("", "")
    compare = ">" if strict else ">="
    due = f"c.event_ms - f.last_fired {compare} {wait}"
    return f"""c AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS cn FROM {source}),
cool AS (
  SELECT {keys}, cn, event_ms{more}, event_ms AS last_fired, true AS fired FROM c WHERE cn = 1
  UNION ALL
  SELECT {own}, c.cn, c.event_ms{more_own}, CASE WHEN {due} THEN c.event_ms ELSE f.last_fired END, {due}
  FROM cool f JOIN c ON {same} AND c.cn = f.cn + 1)"""
