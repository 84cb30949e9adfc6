"""Filed numbers to one clean series per tag.

The many filings of one period are combined by aggregates that merge map-side, so a tag with
an extreme number of filings never travels as a group.  What is left per ``(ticker, tag)``
is bounded by the calendar, and the windows that turn year-to-date ladders into quarters run
on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck import constants as K
from quarterdeck.session import cut_lineage, never_broadcast

TAG = ("ticker", "tag")
#: rows that a task of ``decumulate`` should get, about
TASK_ROWS = 1 << 17


def drop_known_bad(raw: DataFrame, known_bad: DataFrame) -> DataFrame:
    """Remove curated wrong facts ``(ticker, tag, end, filed, val)``.

    Only facts of the tags that have corrections travel to meet them.
    """
    keys = ["ticker", "tag", "end", "filed", "val"]
    names = F.broadcast(known_bad.select("tag").distinct())
    met = raw.join(names, "tag", "left_semi").join(
        never_broadcast(known_bad.select(*keys)), keys, "left_anti")
    rows = raw.join(names, "tag", "left_anti").unionByName(met)
    return rows.select(*keys, *[c for c in raw.columns if c not in keys])


def of_tags(raw: DataFrame, tags: DataFrame) -> DataFrame:
    """Facts of ``tags(ticker, tag)``; facts whose tag has no such name do not travel."""
    names = F.broadcast(tags.select("tag").distinct())
    return raw.join(names, "tag", "left_semi").join(never_broadcast(tags), list(TAG), "left_semi")


def _unit_rank() -> Column:
    return F.coalesce(*[F.when(F.col("unit") == u, F.lit(i))
                        for i, u in enumerate(K.PREFERRED_UNITS)],
                      F.col("unit_pos") + len(K.PREFERRED_UNITS))


def preferred_units(raw: DataFrame) -> DataFrame:
    """The unit to read per tag: dollars, per-share dollars, shares, else the first listed."""
    units = raw.groupBy(*TAG, "unit").agg(F.min(_unit_rank()).alias("_rank"))
    # one row per unit is left of a tag
    first = F.row_number().over(Window.partitionBy(*TAG).orderBy("_rank"))
    return units.withColumn("_first", first).filter("_first = 1").select(*TAG, "unit")


def in_preferred_unit(raw: DataFrame) -> DataFrame:
    """Facts in their tag's preferred unit, chosen by rank: a number, so it combines map-side.

    Only facts of tags that have several units somewhere travel; those of all others are in the preferred one.
    """
    ranked = raw.withColumn("_rank", _unit_rank()).dropna(subset=[*TAG, "_rank"])
    several = ranked.groupBy(*TAG).agg(F.min("_rank").alias("_best"), F.max("_rank").alias("_last")).filter("_best < _last")
    names = F.broadcast(several.select("tag").distinct())
    met = ranked.join(names, "tag", "left_semi").join(several.drop("_last"), list(TAG), "left").filter(
        F.col("_rank") == F.coalesce("_best", "_rank")).drop("_best")
    rows = ranked.join(names, "tag", "left_anti").unionByName(met)
    return rows.select(*TAG, *[c for c in raw.columns if c not in TAG])


def with_days(raw: DataFrame) -> DataFrame:
    return raw.withColumn("days", F.datediff("end", "start"))


def _quarter_length(days: Column, long_ok: Column | bool) -> Column:
    normal = days.between(*K.QUARTER_DAYS)
    long_quarter = (days > K.QUARTER_DAYS[1]) & (days <= K.LONG_QUARTER_MAX_DAYS)
    return normal | (F.lit(long_ok) if isinstance(long_ok, bool) else long_ok) & long_quarter


def _annual_length(days: Column) -> Column:
    return days.between(*K.ANNUAL_DAYS)


def of_period(raw: DataFrame, period: str, point_in_time: bool) -> DataFrame:
    """Facts whose actual day span fits the period; labels are not trusted."""
    days = F.col("days")
    if point_in_time and period == "annual":
        ok = F.coalesce(F.col("fp") == "FY", F.lit(False))
    elif point_in_time:
        ok = days.isNull() | _quarter_length(days, True) | _annual_length(days)
    elif period == "annual":
        ok = F.coalesce(_annual_length(days), F.lit(False))
    else:
        ok = F.coalesce(days.between(K.QUARTER_DAYS[0], K.ANNUAL_DAYS[1]), F.lit(False))
    if period not in ("annual", "quarterly"):
        raise ValueError(f"unknown period {period!r}")
    return with_days(raw).filter(ok)


def _earliest_first() -> Column:
    return F.lit(2**31 - 1).cast("long") - F.col("ordinal")


def latest_filed_durations(facts: DataFrame) -> DataFrame:
    """Per period the number filed last; the first listed one when filed on the same day."""
    order = F.shiftleft(F.unix_date("filed").cast("long"), 31) + _earliest_first()
    return facts.groupBy(*TAG, "end", "days").agg(
        F.max_by("val", order).alias("value"), F.max("filed").alias("filed"),
        F.min("ordinal").alias("first_ordinal")
    ).withColumn("start", F.date_sub("end", F.col("days")))


#: bits of the document order that a chunk of filings, a run of chunks and so on leave out
_CHUNK_BITS, *_RUN_BITS = 9, 16, 23, 31
_OUT = "named_struct('k', CAST(NULL AS INT), 'value', CAST(NULL AS DOUBLE), 'filed', CAST(NULL AS DATE))"
# does row ``r`` replace state ``s``?  A state without filing date is the one before the first row.
_REPLACES = "IF(s.days <> r.days, r.days < s.days, COALESCE(r.filed > s.filed, s.filed IS NULL))"
# a chunk as a map: what each state becomes after its rows; null ``k`` where the state stays
_CHUNK_MAP = f"""aggregate(rows, transform(states, s -> {_OUT}), (m, r) -> transform(states, (start, i) ->
    IF(exists(array(IF(m[i].k IS NULL, start, states[m[i].k])), s -> {_REPLACES}),
       named_struct('k', r.k, 'value', r.value, 'filed', r.filed), m[i])))"""
# two maps one after the other
_IN_ORDER = """aggregate(slice(maps, 2, size(maps)), maps[0].map, (f, g) -> transform(f, (out, i) ->
    IF(out.k IS NULL, g.map[i], IF(g.map[out.k].k IS NULL, out, g.map[out.k]))))"""


def _replay_mixed(facts: DataFrame, mixed: DataFrame) -> DataFrame:
    """Replay the filing order of the ends in ``mixed``, in chunks that fold on their own.

    What a state turns into depends on its span and filing date alone, and of those the calendar
    allows few to an end.  So a chunk of filings becomes a map from state to state; maps combine in
    document order, by runs of bounded length, and the last one is read at the state before
    the first filing.  No task holds more than one run of an end, however often it was filed.
    """
    key = [*TAG, "end"]
    wide = _RUN_BITS[0]
    part = lambda bits: F.shiftright("ordinal", bits)
    # one row per run of an end, so that the filings of one end spread over tasks
    runs = mixed.select(*key, F.explode(F.sequence(
        F.lit(0).cast("long"), F.shiftright("_last", wide))).alias("_run"))
    filed = facts.select(*key, F.col("ordinal").cast("long").alias("ordinal"), "days", "filed",
                         F.col("val").alias("value")).withColumn("_run", part(wide))
    row = F.struct("ordinal", "days", "filed", "value")
    chunks = filed.join(runs, [*key, "_run"], "left_semi").groupBy(
        *key, "_run", part(_CHUNK_BITS).alias("_chunk")).agg(
        F.array_sort(F.collect_list(row)).alias("_all")).withColumn("_all", F.expr(
            # a filing with the span and date of the one before it changes nothing
            "filter(_all, (r, i) -> i = 0 OR NOT (r.days <=> _all[i - 1].days AND r.filed <=> _all[i - 1].filed))"))
    states = chunks.select(*key, F.explode(F.expr(
        "array_distinct(transform(_all, r -> named_struct('days', r.days, 'filed', r.filed)))")).alias("_state")).groupBy(
        *key).agg(F.concat(
            F.array(F.expr("named_struct('days', CAST(NULL AS INT), 'filed', CAST(NULL AS DATE))")),
            F.array_sort(F.collect_set("_state"))).alias("states"))
    maps = chunks.join(runs.join(states, key), [*key, "_run"]).withColumn("rows", F.expr(
        "transform(_all, r -> named_struct('days', r.days, 'filed', r.filed, 'value', r.value, 'k', "
        "CAST(array_position(states, named_struct('days', r.days, 'filed', r.filed)) - 1 AS INT)))")).select(
        *key, F.shiftleft(F.col("_chunk"), _CHUNK_BITS).alias("ordinal"), F.expr(_CHUNK_MAP).alias("map"))
    for bits in _RUN_BITS:
        maps = maps.groupBy(*key, part(bits).alias("_part")).agg(F.array_sort(F.collect_list(
            F.struct("ordinal", "map"))).alias("maps")).select(
            *key, F.shiftleft(F.col("_part"), bits).alias("ordinal"), F.expr(_IN_ORDER).alias("map"))
    return maps.select(*key, F.expr("map[0].value").alias("value"), F.expr("map[0].filed").alias("filed"))


def latest_filed_instants(facts: DataFrame) -> DataFrame:
    """Per period end: the shortest averaging span, then the number filed last.

    Where some facts of an end have a span and others none, the rule compares neighbours in
    document order and is not transitive.  Only those ends are replayed in order.
    """
    shortest = F.coalesce(F.lit(511) - F.col("days"), F.lit(0)).cast("long")
    order = (F.shiftleft(shortest, 47) + F.shiftleft(F.unix_date("filed").cast("long"), 31)
             + _earliest_first())
    best = facts.groupBy(*TAG, "end").agg(
        F.max_by("val", order).alias("value"), F.max_by("filed", order).alias("filed"),
        F.max(F.col("ordinal").cast("long")).alias("_last"),
        (F.count("days") % F.count(F.lit(1)) != 0).alias("mixed"))
    clear = best.filter(~F.col("mixed")).drop("mixed", "_last")
    return clear.unionByName(_replay_mixed(facts, best.filter("mixed").select(*TAG, "end", "_last")))


def _accepted_and_annual(entries: DataFrame) -> DataFrame:
    """Quarter candidates and annual points out of year-to-date ladders."""
    day = F.unix_date("end")
    per_start = Window.partitionBy(*TAG, "start")
    has_quarter = F.max(_quarter_length(F.col("days"), True).cast("int")).over(per_start) == 1
    rows = (entries.withColumn("day", day).withColumn("_has_quarter", has_quarter)
            .filter(~(_annual_length(F.col("days")) & ~F.col("_has_quarter"))))
    ladder = per_start.orderBy("day")
    rows = rows.withColumns({
        "group_ordinal": F.min("first_ordinal").over(per_start),
        "_prev_value": F.lag("value", 1, 0.0).over(ladder),
        "_prev_days": F.lag("days", 1, 0).over(ladder),
    })
    rows = rows.withColumns({
        "step_value": F.col("value") - F.col("_prev_value"),
        "step_days": F.col("days") - F.col("_prev_days"),
        "is_annual": _annual_length(F.col("days")),
    }).withColumn("is_step", ~F.col("is_annual") | (F.col("_prev_days") > 0))
    is_long = (F.col("is_step") & (F.col("step_days") > K.QUARTER_DAYS[1])
               & (F.col("step_days") <= K.LONG_QUARTER_MAX_DAYS))
    n_long = F.sum(is_long.cast("int")).over(Window.partitionBy(*TAG))
    rows = rows.withColumn("_n_long", n_long)
    accepted = F.col("is_step") & _quarter_length(
        F.col("step_days"), F.col("_n_long") >= K.LONG_QUARTER_MIN_PERIODS)
    point = lambda side, value: F.struct(
        F.lit(side).alias("side"), F.col(value).alias("value"))
    both = F.array(F.when(accepted, point(0, "step_value")),
                   F.when(F.col("is_annual"), point(1, "value")))
    return rows.select(*TAG, "end", "day", "filed", "group_ordinal", F.inline(both)).filter(
        F.col("side").isNotNull())


def decumulate(entries: DataFrame) -> DataFrame:
    """Year-to-date values to quarters, and the fourth quarter from the annual figure.

    Of several ladders that yield the same quarter the one listed last wins; of several
    annual facts the one listed first.
    """
    # the windows below sort a task's rows one after another, so tasks are dealt by rows, not by bytes
    entries = cut_lineage(entries)
    tasks = max(entries.sparkSession.sparkContext.defaultParallelism, -(-entries.count() // TASK_ROWS))
    entries = entries.repartition(tasks, *TAG)
    points = _accepted_and_annual(entries)
    preference = F.when(F.col("side") == 0, -F.col("group_ordinal")).otherwise(
        F.col("group_ordinal"))
    one = Window.partitionBy(*TAG, "side", "end").orderBy(preference)
    points = points.withColumn("_place", F.row_number().over(one)).filter("_place = 1")
    quarters = Window.partitionBy(*TAG, "side").orderBy("day")
    points = points.withColumns({
        "_two_back": F.lag("value", 2).over(quarters),
        "_one_back": F.lag("value", 1).over(quarters),
        "_first_day": F.lag("day", 2).over(quarters),
    }).withColumn("_three", F.struct(
        (F.col("_two_back") + F.col("_one_back") + F.col("value")).alias("total"),
        F.col("_first_day").alias("first_day")))
    before = (Window.partitionBy(*TAG).orderBy("day", F.col("side").desc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same_end = Window.partitionBy(*TAG, "end")
    points = points.withColumns({
        "_last_three": F.last(F.when(F.col("side") == 0, F.col("_three")),
                              ignorenulls=True).over(before),
        "_has_quarter": F.min("side").over(same_end) == 0,
    })
    covers = F.col("day") - F.col("_last_three.first_day") <= K.Q4_LOOKBACK_DAYS
    fourth = F.col("value") - F.col("_last_three.total")
    kept = (F.col("side") == 0) | (~F.col("_has_quarter") & F.coalesce(covers, F.lit(False)))
    return points.filter(kept).select(
        *TAG, "end", F.when(F.col("side") == 0, F.col("value")).otherwise(fourth).alias("value"),
        "filed")


def tag_series(raw: DataFrame, period: str, point_in_time: bool) -> DataFrame:
    """``(ticker, tag, end, value, filed)`` of every tag in ``raw`` for one kind of concept."""
    facts = of_period(raw, period, point_in_time)
    if point_in_time:
        return latest_filed_instants(facts)
    latest = latest_filed_durations(facts)
    if period == "annual":
        # two spans may share an end; the one listed first stays
        return latest.groupBy(*TAG, "end").agg(
            F.min_by("value", "first_ordinal").alias("value"),
            F.min_by("filed", "first_ordinal").alias("filed"))
    return decumulate(latest)
