"""The portal's record list: visibility, facets, orders, paging and decorated rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import search_fold

VISIBLE = ("READY", "SUMMARIZED", "RELEVANT", "AI_FAILED")
PREPARING = ("SUMMARIZED", "RELEVANT", "AI_FAILED")
ELIGIBLE_ATTEMPTS = 3


@dataclass(frozen=True)
class ListQuery:
    """Criteria of a list; those given hold together, values of one are alternatives."""

    as_of: str
    issuers: tuple[str, ...] = ()
    severities: tuple[int, ...] = ()
    status: str | None = None
    units: tuple[int, ...] = ()
    effective: tuple[str, ...] = ()
    detected: str | tuple[str, ...] | None = None
    days: int | None = None
    text: str | None = None
    metric: str | None = None
    queue: str | None = None
    needs_unit: bool = False
    unit_changed: bool = False
    ids: tuple[int, ...] | None = None
    sources: tuple[str, ...] = ()
    edited: bool = False
    sort: str | None = None
    descending: bool = True
    page: int = 1
    page_size: int = 10
    zone: str = "Europe/Istanbul"
    weak_score: float = 0.5


def visible() -> Column:
    return F.col("is_relevant") & F.col("processing_status").isin(*VISIBLE)


def _today(q: ListQuery) -> Column:
    return F.lit(q.as_of).cast("date")


def day_start(day: Column, zone: str) -> Column:
    """The instant at which a civil day of ``zone`` begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def effective_within(values: tuple[str, ...], q: ListQuery) -> Column:
    day, today = F.col("effective_date"), _today(q)
    known = {
        "7": day.between(today, F.date_add(today, 7)),
        "30": day.between(today, F.date_add(today, 30)),
        "in_force": day < today,
        "none": day.isNull(),
    }
    if not values or any(v not in known for v in values):
        raise ValueError(f"effective: one of {sorted(known)}")
    return reduce(lambda a, b: a | b, [F.coalesce(known[v], F.lit(False)) for v in values])


def metric(name: str, q: ListQuery) -> Column:
    """The named figure's condition."""
    pending, today = F.col("review_status") == "pending", _today(q)
    if name == "pending":
        return pending
    if name == "critical_high":
        return pending & (F.col("severity") >= 3)
    if name == "today":
        return (F.col("detected_at") >= day_start(today, q.zone)) & (F.col("detected_at") < day_start(F.date_add(today, 1), q.zone))
    if name == "upcoming":
        return F.col("effective_date").between(today, F.date_add(today, 30))
    raise ValueError(f"unknown metric {name}")


def trusted_units(suggestions: DataFrame, q: ListQuery) -> DataFrame:
    """Ids of records with an active suggestion that is manual or strong enough."""
    good = F.col("is_active") & ((F.col("origin") == "manual") | (F.col("score") >= q.weak_score))
    return suggestions.where(good).select("reg_id").distinct()


def _given(table: DataFrame | None, what: str) -> DataFrame:
    if table is None:
        raise ValueError(f"this criterion needs the table of {what}")
    return table


def searched(records: DataFrame, text: str, summaries: DataFrame | None = None) -> DataFrame:
    """Records whose title, or current summary where ``summaries`` (reg_id, is_current, short_content) is given, holds a text, letter case aside.

    Signs that are wild cards elsewhere stand for themselves.
    """
    wanted = search_fold(F.lit(text.strip()))
    in_title = F.coalesce(search_fold("title").contains(wanted), F.lit(False))
    if summaries is None:
        return records.where(in_title)
    told = summaries.where(F.col("is_current") & search_fold("short_content").contains(wanted)).select("reg_id", F.lit(True).alias("_told")).distinct()
    return records.join(told, "reg_id", "left").where(in_title | F.col("_told").isNotNull()).select(*records.columns)


def filtered(records: DataFrame, suggestions: DataFrame, q: ListQuery, links: DataFrame | None = None, summaries: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """The visible records that meet all criteria; facets over other tables are semi and anti joins.

    ``links`` (reg_id, source) is needed for ``sources``, ``history`` (reg_id,
    kind) for ``edited``; with ``summaries`` a text is looked for in them too.
    """
    out, today = records.where(visible()), _today(q)
    if q.ids is not None:
        out = out.where(F.col("reg_id").isin(*q.ids) if q.ids else F.lit(False))
    if q.sources:
        out = out.join(_given(links, "links").where(F.col("source").isin(*q.sources)), "reg_id", "left_semi")
    if q.edited:
        out = out.join(_given(history, "history").where("kind = 'content_edited'"), "reg_id", "left_semi")
    if q.queue:
        if q.queue not in ("all", "preparing"):
            raise ValueError("queue: all or preparing")
        ready = (F.col("review_status") == "pending") & (F.col("processing_status") == "READY")
        out = out.where(F.col("processing_status").isin(*PREPARING) if q.queue == "preparing" else ready)
    if q.detected:
        start = day_start(F.date_sub(today, 7), q.zone)
        periods = {"recent": F.col("detected_at") >= start, "older": F.col("detected_at") < start}
        values = (q.detected,) if isinstance(q.detected, str) else q.detected
        if any(v not in periods for v in values):
            raise ValueError(f"detected: one of {sorted(periods)}")
        out = out.where(reduce(lambda a, b: a | b, [periods[v] for v in values]))
    if q.issuers:
        out = out.where(F.col("issuer").isin(*q.issuers))
    if q.severities:
        out = out.where(F.col("severity").isin(*q.severities))
    if q.status:
        out = out.where(F.col("review_status") == q.status)
    if q.effective:
        out = out.where(effective_within(q.effective, q))
    if q.days:
        out = out.where(F.col("publish_date") >= F.date_sub(today, q.days))
    if q.text and q.text.strip():
        out = searched(out, q.text, summaries)
    if q.metric:
        out = out.where(metric(q.metric, q))
    if q.units:
        out = out.join(suggestions.where(F.col("is_active") & F.col("unit").isin(*q.units)), "reg_id", "left_semi")
    if q.needs_unit:
        out = out.join(trusted_units(suggestions, q), "reg_id", "left_anti")
    if q.unit_changed:
        changed = ((F.col("origin") == "manual") & F.col("is_active")) | ((F.col("origin") == "ai") & ~F.col("is_active"))
        out = out.join(suggestions.where(changed), "reg_id", "left_semi")
    return out


def with_priority(records: DataFrame, suggestions: DataFrame, q: ListQuery) -> DataFrame:
    """Add ``priority``: severity by urgency of the effective date, more without a unit or when new."""
    day, today = F.col("effective_date"), _today(q)
    urgency = F.when(day.isNull(), 1.0).when(day < today, 1.8).when(day <= F.date_add(today, 7), 3.0)
    urgency = urgency.when(day <= F.date_add(today, 30), 2.2).when(day <= F.date_add(today, 90), 1.4).otherwise(1.0)
    new = F.when(F.col("detected_at") >= day_start(F.date_sub(today, 1), q.zone), 0.4).otherwise(0.0)
    flagged = records.join(trusted_units(suggestions, q).withColumn("_unit", F.lit(True)), "reg_id", "left")
    lone = F.when(F.col("_unit").isNull(), 0.6).otherwise(0.0)
    return flagged.withColumn("priority", F.round(F.col("severity") * urgency + lone + new, 4)).drop("_unit")


def ordered(records: DataFrame, suggestions: DataFrame, q: ListQuery) -> DataFrame:
    """Sorted by the query's key, nulls last either way; ties by publishing day and id."""
    if q.sort == "priority":
        records = with_priority(records, suggestions, q)
        first = [F.col("priority").desc() if q.descending else F.col("priority").asc(), F.desc("detected_at")]
    elif q.sort == "unit":
        active = suggestions.where("is_active").groupBy("reg_id").agg(F.min(F.struct("rank", "unit"))["unit"].alias("top_unit"))
        records = records.join(active, "reg_id", "left")
        first = [F.col("top_unit").desc_nulls_last() if q.descending else F.col("top_unit").asc_nulls_last(), F.col("publish_date").desc_nulls_last()]
    elif q.sort:
        first = [F.col(q.sort).desc_nulls_last() if q.descending else F.col(q.sort).asc_nulls_last(), F.col("publish_date").desc_nulls_last()]
    else:
        first = [F.desc("severity"), F.col("publish_date").desc_nulls_last()]
    return records.orderBy(*first, F.desc("reg_id"))


def page(rows: DataFrame, q: ListQuery) -> DataFrame:
    """One page: the feature's own limit."""
    return rows.offset((q.page - 1) * q.page_size).limit(q.page_size)


def units_of(suggestions: DataFrame) -> DataFrame:
    """reg_id and its active units by rank, as one text."""
    units = F.array_sort(F.collect_list(F.struct("rank", "unit")))
    joined = F.array_join(F.transform(units, lambda x: F.concat_ws(":", x["rank"].cast("string"), x["unit"].cast("string"))), ",")
    return suggestions.where("is_active").groupBy("reg_id").agg(joined.alias("units"))


def decorated(rows: DataFrame, suggestions: DataFrame, q: ListQuery) -> DataFrame:
    """The list's columns, with units, analysis state and effective mode, for a page of rows."""
    failed = F.col("processing_status") == "AI_FAILED"
    analysis = F.when(failed & (F.col("ai_attempts") >= ELIGIBLE_ATTEMPTS), "exhausted").when(failed, "failed")
    analysis = analysis.when(F.col("processing_status") == "READY", "complete").otherwise("running")
    mode = F.when(F.col("effective_date").isNull(), "none").when(F.col("effective_date") == F.col("publish_date"), "on_publish").otherwise("date")
    own = suggestions.join(F.broadcast(rows.select("reg_id")), "reg_id", "left_semi")  # a page of ids
    return rows.join(units_of(own), "reg_id", "left").select(
        "reg_id",
        "title",
        "issuer",
        "severity",
        F.col("publish_date").cast("string").alias("publish_date"),
        F.col("effective_date").cast("string").alias("effective_date"),
        "review_status",
        analysis.alias("analysis"),
        mode.alias("effective_mode"),
        F.coalesce("units", F.lit("")).alias("units"),
    )


def list_records(records: DataFrame, suggestions: DataFrame, q: ListQuery) -> DataFrame:
    return decorated(page(ordered(filtered(records, suggestions, q), suggestions, q), q), suggestions, q)
