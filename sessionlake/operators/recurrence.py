"""Recurring events to occurrences, with the exceptions of their calendars.

Rules are read in columns. Plain sequences of steps are generated in nested
blocks, so that no row lists more than BLOCK of them. Rules that pick days
(BYDAY, BYMONTHDAY, BYMONTH, BYSETPOS) go over the periods near the range: one
list of candidate days for each. Only what is left goes to the recurrence
library, in batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import LOCAL_ZONE, in_local_time

#: Steps, or periods, that one row lists at most.
BLOCK = 1024
_PERIODS = 64  # a year of candidate days each at most

# Seconds and months of one step of a rule; the parts of a rule that a plain sequence has, and those that pick days.
_SECONDS = {"SECONDLY": 1, "MINUTELY": 60, "HOURLY": 3600, "DAILY": 86_400, "WEEKLY": 604_800}
_MONTHS = {"MONTHLY": 1, "YEARLY": 12}
_PLAIN = ("FREQ", "INTERVAL", "UNTIL", "COUNT")
_PICKS = ("BYDAY", "BYMONTHDAY", "BYMONTH", "BYSETPOS", "WKST")
_WEEKDAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
#: A step of ten thousand years has no second one in any calendar; longer ones count as this.
_LONGEST_DAYS = 3_652_500


def _numbers(text: Column, least: int, most: int) -> Column:
    """Whole numbers of a list between ``least`` and ``most``, never 0; null for the whole list if one is not."""
    found = F.transform(F.split(text, ","), lambda x: x.try_cast("int"))
    good = F.forall(found, lambda x: F.coalesce(x.between(least, most) & (x != 0), F.lit(False)))
    return F.when(good, found)


def step(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later steps use again and again: behind a generator each is worked out once."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def read_rules(df: DataFrame, rule: str = "rrule", at: str = "dtstart") -> DataFrame:
    """``df`` and the parts of each row's rule; null where not given. _kind is once, plain, days or general.

    Of repeated parts the first counts. A rule that cannot be read (no known
    FREQ, an INTERVAL or COUNT that is no positive number, an UNTIL that is no
    time) is none: the event occurs once. Each text is read once, however
    many events share it; only what depends on a start is left to the rows.
    """
    text = F.coalesce(rule, F.lit(""))
    parts = F.filter(F.split(F.upper("_rule_text"), ";"), lambda p: F.trim(p) != "")
    read = step(df.select(text.alias("_rule_text")).distinct(), _parts=parts)
    given = lambda name: F.substring_index(F.get(F.filter("_parts", lambda p: F.startswith(p, F.lit(name + "="))), F.lit(0)), "=", -1)
    read = step(read, _names=F.transform("_parts", lambda p: F.substring_index(p, "=", 1)), **{f"_raw_{name}": given(name) for name in (*_PLAIN, *_PICKS)})

    lookup = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("_raw_FREQ")].cast("long")
    ends = F.coalesce(*[F.try_to_timestamp(F.regexp_replace("_raw_UNTIL", "Z$", ""), F.lit(form)) for form in ("yyyyMMdd'T'HHmmss", "yyyyMMdd")]).cast("timestamp_ntz")
    weekdays = F.array(*[F.lit(d) for d in _WEEKDAYS])
    days = F.transform(
        F.split("_raw_BYDAY", ","),
        lambda x: F.struct(
            F.coalesce(F.regexp_extract(x, r"^([+-]?\d{0,2})[A-Z]{2}$", 1).try_cast("int"), F.lit(0)).alias("n"),
            F.nullif(F.array_position(weekdays, F.regexp_extract(x, r"^(?:[+-]?[1-9]\d?)?([A-Z]{2})$", 1)).cast("int"), F.lit(0)).alias("day"),
        ),
    )
    read = step(
        read, _every=F.when(F.col("_raw_INTERVAL").isNull(), 1).otherwise(F.col("_raw_INTERVAL").try_cast("long")), _unit=lookup(_SECONDS), _month_unit=lookup(_MONTHS), _until=ends, _count=F.col("_raw_COUNT").try_cast("long"),
        _found_days=days, _month_days=_numbers(F.col("_raw_BYMONTHDAY"), -31, 31), _in_months=_numbers(F.col("_raw_BYMONTH"), 1, 12), _positions=_numbers(F.col("_raw_BYSETPOS"), -366, 366),
        _week=F.nullif(F.array_position(weekdays, F.coalesce("_raw_WKST", F.lit("MO"))).cast("int"), F.lit(0)), _numbered=F.size(F.filter(days, lambda d: d["n"] != 0)),
    )

    seconds = F.least(F.try_multiply("_unit", "_every"), F.lit(_LONGEST_DAYS * 86_400))
    months = F.least(F.try_multiply("_month_unit", "_every"), F.lit(_LONGEST_DAYS // 30))
    whole_list = F.forall("_found_days", lambda d: d["day"].isNotNull()) & ((F.col("_numbered") == 0) | (F.col("_numbered") == F.size("_found_days")) | F.col("_unit").isNotNull())
    read = step(read, _second_step=F.when(F.col("_unit").isNotNull(), seconds), _month_step=F.when(F.col("_month_unit").isNotNull(), months), _days=F.when(whole_list, F.col("_found_days")))
    readable = (F.col("_every") > 0) & (F.col("_second_step").isNotNull() | F.col("_month_step").isNotNull()) & (F.col("_raw_UNTIL").isNull() | F.col("_until").isNotNull())
    readable = F.coalesce(readable & (F.col("_raw_COUNT").isNull() | (F.col("_count") > 0)), F.lit(False))
    known = F.col("_week").isNotNull()
    for raw, found in (("_raw_BYDAY", "_days"), ("_raw_BYMONTHDAY", "_month_days"), ("_raw_BYMONTH", "_in_months"), ("_raw_BYSETPOS", "_positions")):
        known = known & (F.col(raw).isNull() | F.col(found).isNotNull())
    only = lambda allowed: F.size(F.array_except("_names", F.array(*[F.lit(x) for x in allowed]))) == 0
    by_days = only((*_PLAIN, *_PICKS)) & known & F.col("_raw_FREQ").isin("DAILY", "WEEKLY", "MONTHLY", "YEARLY") & (F.size("_names") == F.size(F.array_distinct("_names")))
    read = read.select("*", readable.alias("_readable"), only(_PLAIN).alias("_is_plain"), by_days.alias("_by_days"))

    read = df.join(read, text == F.col("_rule_text"))
    skips = F.col("_month_step").isNotNull() & (F.dayofmonth(at) > 28) & F.col("_count").isNotNull()  # months without the day do not count
    kind = F.when(~F.col("_readable"), "once").when(F.col("_is_plain") & ~skips, "plain").when(F.col("_by_days"), "days").otherwise("general")

    # what a rule leaves open it takes from its start
    yearly, no_months = F.col("_raw_FREQ") == "YEARLY", F.col("_raw_BYMONTH").isNull()
    by_default = F.col("_raw_BYDAY").isNull() & F.col("_raw_BYMONTHDAY").isNull()
    return read.select(
        *df.columns, kind.alias("_kind"), F.col("_raw_FREQ").alias("_freq"), F.coalesce("_second_step", F.lit(0)).cast("long").alias("_seconds"), F.coalesce("_month_step", F.lit(0)).cast("long").alias("_months"),
        "_until", "_count", "_week", "_positions", F.when(by_default & yearly & no_months, F.array(F.month(at))).otherwise(F.col("_in_months")).alias("_in_months"),
        F.when(by_default & F.col("_month_step").isNotNull(), F.array(F.dayofmonth(at))).otherwise(F.col("_month_days")).alias("_month_days"),
        F.when(by_default & (F.col("_raw_FREQ") == "WEEKLY"), F.array(F.struct(F.lit(0).alias("n"), (F.weekday(at) + 1).alias("day")))).otherwise(F.col("_days")).alias("_days"),
        (yearly & no_months).alias("_of_year"),
    )


def _plain(rows: DataFrame, low: Column, high: Column, at: str) -> DataFrame:
    """Occurrences of events without a rule, and of plain sequences of steps."""
    begins = F.col(at).cast("timestamp_ntz")
    limit = F.least(high - F.make_dt_interval(secs=F.lit(0.000001)), F.col("_until"))

    def steps_until(moment: Column) -> Column:
        """Whole steps from the start to ``moment``, rounded down."""
        by_month = F.months_between(moment, begins) / F.col("_months")
        return F.floor(F.when(F.col("_months") > 0, by_month).otherwise(F.timestamp_diff("SECOND", begins, moment) / F.col("_seconds"))).cast("long")

    # only the steps around the range are made, one more on either side; the filter below is exact
    plain = F.col("_kind") == "plain"
    last = F.when(plain, F.least(steps_until(limit) + 1, F.col("_count") - 1)).otherwise(F.lit(0).cast("long"))
    first = F.when(plain, F.greatest(F.lit(0).cast("long"), steps_until(low) - 1)).otherwise(F.lit(0).cast("long"))
    made = rows.select("*", F.inline(F.array(F.struct(first.alias("_first"), last.alias("_last"))))).filter("_last >= _first")
    for size in (BLOCK * BLOCK, BLOCK):  # blocks of blocks, then blocks
        made = made.withColumn("_block", F.explode(F.expr(f"sequence(_first div {size}, _last div {size})")))
        made = made.withColumns({"_first": F.greatest("_first", F.col("_block") * size), "_last": F.least("_last", F.col("_block") * size + size - 1)})
    made = made.withColumn("_i", F.explode(F.sequence("_first", "_last")))
    made = made.withColumn("occurs", begins + F.make_ym_interval(months=(F.col("_i") * F.col("_months")).cast("int")) + F.make_dt_interval(secs=(F.col("_i") * F.col("_seconds")).cast("decimal(18,6)")))
    inside = (F.col("occurs") >= low) & (F.col("occurs") < high) & (~plain | F.col("_until").isNull() | (F.col("occurs") <= F.col("_until")))
    whole = (F.col("_months") == 0) | (F.dayofmonth("occurs") == F.dayofmonth(begins))
    return made.filter(inside & (whole | ~plain))


def _picked_days(rows: DataFrame, low: Column, high: Column, at: str) -> DataFrame:
    """Occurrences of rules that pick days of their periods (days, weeks, months or years).

    Without a COUNT only the periods near the range are looked at, with one
    those from the start on: a row then lists the days up to the range's end
    that the rule picks.
    """
    begins = F.col(at).cast("timestamp_ntz")
    start, by_month = F.to_date(begins), F.col("_months") > 0
    weekly, yearly = F.col("_freq") == "WEEKLY", F.col("_freq") == "YEARLY"
    day_step = (F.col("_seconds") / 86_400).cast("int")
    counted = F.col("_count").isNotNull()
    base = (
        F.when(weekly, F.date_sub(start, (F.weekday(start) + 1 - F.col("_week") + 7) % 7))
        .when(yearly, F.trunc(start, "year")).when(by_month, F.trunc(start, "month")).otherwise(start)
    )

    def period_of(day: Column) -> Column:
        months = (F.year(day) - F.year("_base")) * 12 + F.month(day) - F.month("_base")
        return F.floor(F.when(by_month, months / F.col("_months")).otherwise(F.datediff(day, F.col("_base")) / day_step)).cast("int")

    made = step(rows, _base=base, _start=start)
    first = F.when(counted, 0).otherwise(F.greatest(F.lit(0), period_of(F.to_date(low)) - 1))
    last = period_of(F.to_date(F.least(high, F.col("_until"))))
    made = step(made, _first=first.cast("int"), _last=last).filter("_last >= _first")
    made = made.withColumn("_block", F.explode(F.when(counted, F.array(F.lit(0))).otherwise(F.expr(f"sequence(_first div {_PERIODS}, _last div {_PERIODS})").cast("array<int>"))))
    made = step(
        made, _low=F.when(counted, F.col("_first")).otherwise(F.greatest("_first", F.col("_block") * _PERIODS)),
        _high=F.when(counted, F.col("_last")).otherwise(F.least("_last", F.col("_block") * _PERIODS + _PERIODS - 1)),
    )

    def fits(day: Column) -> Column:
        length = F.dayofmonth(F.last_day(day))
        in_month = F.col("_in_months").isNull() | F.array_contains("_in_months", F.month(day))
        numbered = F.col("_month_days").isNull() | F.array_contains("_month_days", F.dayofmonth(day)) | F.array_contains("_month_days", F.dayofmonth(day) - length - 1)
        of_year = F.col("_of_year")
        place = F.when(of_year, F.dayofyear(day)).otherwise(F.dayofmonth(day))
        left = F.when(of_year, F.datediff(F.make_date(F.year(day), F.lit(12), F.lit(31)), day)).otherwise(length - F.dayofmonth(day))
        nth, nth_last = F.floor((place - 1) / 7) + 1, -F.floor(left / 7) - 1
        named = F.col("_days").isNull() | F.exists("_days", lambda d: (d["day"] == F.weekday(day) + 1) & (~by_month | (d["n"] == 0) | (d["n"] == nth) | (d["n"] == nth_last)))
        # a week's set begins with the start of the series, as in the library
        return in_month & numbered & named & (~weekly | (day >= F.col("_start")))

    def candidates(k: Column) -> Column:
        from_day = F.when(by_month, F.add_months("_base", (k * F.col("_months")).cast("int"))).otherwise(F.date_add("_base", (k * day_step).cast("int")))
        to_day = F.when(weekly, F.date_add(from_day, 6)).when(yearly, F.date_sub(F.add_months(from_day, 12), 1)).when(by_month, F.last_day(from_day)).otherwise(from_day)
        found = F.array(F.filter(F.sequence(from_day, to_day), fits))
        at_position = lambda days: F.filter(days, lambda _, i: F.array_contains("_positions", i + 1) | F.array_contains("_positions", i - F.size(days)))
        return F.get(F.transform(found, lambda days: F.when(F.col("_positions").isNull(), days).otherwise(at_position(days))), F.lit(0))

    days = F.filter(F.flatten(F.transform(F.sequence("_low", "_high"), candidates)), lambda d: d >= F.col("_start"))
    days = F.when(counted, F.slice(days, 1, F.least(F.col("_count"), F.lit(1 << 30)).cast("int"))).otherwise(days)
    made = made.withColumn("_day", F.explode(days)).withColumn("occurs", F.col("_day").cast("timestamp_ntz") + (begins - F.col("_start").cast("timestamp_ntz")))
    return made.filter((F.col("occurs") >= low) & (F.col("occurs") < high) & (F.col("_until").isNull() | (F.col("occurs") <= F.col("_until"))))


def _by_library(rows: DataFrame, start: str, end: str, at: str, rule: str, schema: T.StructType) -> DataFrame:
    """Occurrences of all other rules, in batches of at most BLOCK rows."""

    def occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from dateutil.rrule import rrule, rrulestr

        first, after = pd.Timestamp(start).to_pydatetime(), (pd.Timestamp(end) + pd.Timedelta(days=1)).to_pydatetime()
        for batch in batches:
            for n, (text_value, begins) in enumerate(zip(batch[rule], batch[at])):
                begins = begins.to_pydatetime()
                try:
                    read = rrulestr(re.sub(r"(?i)(UNTIL=[^;]*?)Z", r"\1", text_value), dtstart=begins)
                    if isinstance(read, rrule):  # one that never hits would be followed to the end of the calendar
                        read = read.replace(until=min(read._until or after, after))
                    series = iter(read.xafter(first, inc=True))
                    found = list(islice(series, BLOCK))
                except Exception:  # noqa: BLE001 - whatever the library makes of it, it is not a rule: one occurrence
                    series, found = iter(()), [begins] if first <= begins else []
                while found:
                    inside = [x for x in found if x < after]
                    yield batch.iloc[[n] * len(inside)].assign(occurs=pd.Series(inside, dtype="datetime64[us]").values)
                    if len(inside) < len(found):
                        break
                    try:
                        found = list(islice(series, BLOCK))
                    except Exception:  # noqa: BLE001 - beyond the last year of its calendar
                        break

    return rows.mapInPandas(occurrences, schema)


def expand_recurrence(df: DataFrame, start: str, end: str, at: str = "dtstart", rule: str = "rrule") -> DataFrame:
    """One row per occurrence between the dates ``start`` and ``end``; adds ``occurs`` (timestamp without zone).

    Every FREQ with INTERVAL, UNTIL and COUNT is a sequence of built-in
    columns; months without the day of the start have no occurrence. BYDAY,
    BYMONTHDAY, BYMONTH, BYSETPOS and WKST of DAILY to YEARLY rules are
    columns too. Rules with other parts, and lists of weekdays of which only
    some are numbered, go through the recurrence library in batches. No rule,
    or none that can be read, means one occurrence; a null start none.
    """
    low, high = F.lit(start).cast("date").cast("timestamp_ntz"), F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    read = read_rules(df.filter(F.col(at).isNotNull()), rule, at)
    plain = _plain(read.filter("_kind in ('once', 'plain')"), low, high, at).select(*df.columns, "occurs")
    days = _picked_days(read.filter("_kind = 'days'"), low, high, at).select(*df.columns, "occurs")
    schema = T.StructType([*df.schema.fields, T.StructField("occurs", T.TimestampNTZType())])
    return plain.unionByName(days).unionByName(_by_library(read.filter("_kind = 'general'").select(*df.columns), start, end, at, rule, schema))


def standing(by_rule: DataFrame, added: DataFrame, gone: DataFrame, series: str = "uid") -> DataFrame:
    """Occurrences ``by_rule``, and of those ``added`` the ones no rule hits itself, less what is ``gone`` (series, occurs).

    All three meet once, by (series, occurs), so a long series is spread. Rows
    without a series stay as they are.
    """
    keys = gone.filter(F.col(series).isNotNull()).select(series, "occurs").distinct()
    ranked = [df.withColumn("_rank", F.lit(n)) for n, df in enumerate((keys, by_rule, added))]
    rows = ranked[1].unionByName(ranked[2]).unionByName(ranked[0], allowMissingColumns=True)
    apart = F.when(F.col(series).isNull(), F.spark_partition_id())  # rows without a series are no group
    rows = rows.withColumn("_apart", apart).withColumn("_least", F.min("_rank").over(Window.partitionBy(series, "occurs", "_apart")))
    return rows.filter((F.col("_rank") > 0) & (F.col(series).isNull() | (F.col("_rank") == F.col("_least")))).select(*by_rule.columns)


def expand_calendar(calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Occurrences of whole calendars between two local dates: rules, exclusions, additions and moved occurrences.

    In: rows of ``documents.read_ics`` or of the same form: uid, starts and
    zone (wall clock of the event and its zone, null for local time), all_day,
    rrule, and exdates, rdates and recurrence_id in local time. A series
    recurs in its own zone, so that its wall clock stays over a change to or
    from summer time; an UNTIL in UTC is read there. Then come RDATEs that
    the rule does not hit itself, less the EXDATEs. An event with a
    recurrence_id stands for that occurrence of its uid, whether inside the
    range or not, at its own start. Out: all columns and ``occurs``, in local
    time. Null uids belong to no series: nothing is taken from them. A null
    start has no occurrence; an empty table gives none.
    """
    low, high = F.lit(start).cast("date").cast("timestamp_ntz"), F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    inside = (F.col("occurs") >= low) & (F.col("occurs") < high)
    masters, moved = calendar.filter("recurrence_id is null"), calendar.filter("recurrence_id is not null")
    until = F.regexp_extract("rrule", r"(?i)UNTIL=(\d{8}T\d{6})Z", 1)
    instant = F.try_to_timestamp(until, F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")
    own = F.date_format(F.convert_timezone(F.lit("UTC"), F.coalesce("zone", F.lit(LOCAL_ZONE)), instant), "yyyyMMdd'T'HHmmss")
    rule = F.when(instant.isNotNull(), F.regexp_replace("rrule", F.lit(r"(?i)UNTIL=\d{8}T\d{6}Z"), F.concat(F.lit("UNTIL="), own))).otherwise(F.col("rrule"))
    # zones are up to 26 hours apart
    wide = [f"{d:%Y-%m-%d}" for d in (pd.Timestamp(start) - pd.Timedelta(days=2), pd.Timestamp(end) + pd.Timedelta(days=2))]
    by_rule = expand_recurrence(masters.withColumn("_rule", rule), *wide, at="starts", rule="_rule").drop("_rule")
    by_rule = by_rule.withColumn("occurs", in_local_time(F.col("occurs"), F.col("zone"))).filter(inside)
    added = masters.withColumn("occurs", F.explode(F.array_distinct("rdates"))).filter(inside)
    added = added.select(*calendar.columns, "occurs")
    gone = masters.select("uid", F.explode("exdates").alias("occurs")).unionByName(moved.select("uid", F.col("recurrence_id").alias("occurs"))).filter(inside)
    there = moved.withColumn("occurs", in_local_time(F.col("starts"), F.col("zone"))).filter(inside)
    return standing(by_rule, added, gone).unionByName(there)
