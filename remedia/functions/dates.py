"""Date predicates as Column expressions: no table, no UDF, safe in codegen."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from remedia.functions.text import strip

# fixed values: (month, day, first year observed) of the fixed-date federal holidays
FIXED_HOLIDAYS = [(1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0)]
# fixed values: (month, weekday with Monday = 0, first and last day of month it can fall on)
FLOATING_HOLIDAYS = [
    (1, 0, 15, 21),   # third Monday of January
    (2, 0, 15, 21),   # third Monday of February
    (5, 0, 25, 31),   # last Monday of May
    (9, 0, 1, 7),     # first Monday of September
    (10, 0, 8, 14),   # second Monday of October
    (11, 3, 22, 28),  # fourth Thursday of November
]
FRIDAY, SATURDAY, MONDAY = 4, 5, 0


def parse_day(text: Column) -> Column:
    """ISO day from the first ten characters of the trimmed text; NULL when it is not one."""
    head = F.substring(strip(text.cast("string")), 1, 10)
    return F.coalesce(
        F.try_to_date(head, "yyyy-MM-dd"), F.try_to_date(head, "yyyyMMdd"))


def iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def _is_fixed_holiday(day: Column) -> Column:
    return reduce(
        lambda a, b: a | b,
        [(F.month(day) == m) & (F.dayofmonth(day) == d) & (F.year(day) >= since)
         for m, d, since in FIXED_HOLIDAYS])


def is_federal_holiday(day: Column) -> Column:
    """Observed federal holidays.

    A fixed holiday on a Saturday is observed on the Friday before (so 31 December
    when 1 January is a Saturday), one on a Sunday on the Monday after.
    """
    weekday = F.weekday(day)
    floating = reduce(
        lambda a, b: a | b,
        [(F.month(day) == m) & (weekday == w) & F.dayofmonth(day).between(lo, hi)
         for m, w, lo, hi in FLOATING_HOLIDAYS])
    return (
        (_is_fixed_holiday(day) & (weekday < SATURDAY))
        | ((weekday == FRIDAY) & _is_fixed_holiday(F.date_add(day, 1)))
        | ((weekday == MONDAY) & _is_fixed_holiday(F.date_sub(day, 1)))
        | floating)


def is_business_day(day: Column) -> Column:
    return (F.weekday(day) < SATURDAY) & ~is_federal_holiday(day)


# --- business days by arithmetic -------------------------------------------------------
#
# Weekdays are numbered from 1 January of year 1, a Monday. An observed holiday is a weekday,
# so it is named by its number; a year's holidays are a short ascending list of numbers.

FIRST_DAY = "DATE'0001-01-01'"
SINCE_2021 = 2021                   # first year with eleven holidays instead of ten
BUSINESS_DAYS_BEFORE_2021 = 506_794  # business days of the years 1 to 2020, by the count below
YEAR_OF_TEN, YEAR_OF_ELEVEN = 250.8881, 249.8875  # business days of a year, on average


def weekday_number(day: Column) -> Column:
    """Weekdays up to and including ``day``; a weekend has the number of its Friday."""
    t = F.date_diff(day, F.expr(FIRST_DAY))
    return (5 * F.floor(t / 7) + F.least(F.pmod(t, F.lit(7)) + 1, F.lit(5))).cast("int")


def weekday_at(number: Column) -> Column:
    days = 7 * F.floor((number - 1) / 5) + F.pmod(number - 1, F.lit(5))
    return F.date_add(F.expr(FIRST_DAY), days.cast("int"))


def _fixed(year: Column, month: int, day: int, since: int) -> Column:
    """A Saturday has its Friday's number already; a Sunday is observed on the next weekday."""
    date = F.make_date(year, F.lit(month), F.lit(day))
    number = weekday_number(date) + (F.weekday(date) == 6).cast("int")
    return F.when(year >= since, number) if since else number


def _floating(year: Column, month: int, weekday: int, first: int) -> Column:
    date = F.make_date(year, F.lit(month), F.lit(first))
    return weekday_number(F.date_add(date, F.pmod(weekday - F.weekday(date), F.lit(7)).cast("int")))


def holiday_numbers(year: Column) -> Column:
    """Weekday numbers of a year's holidays in order, with 1 January's even if it is observed on 31 December."""
    found = [((m, d), _fixed(year, m, d, since)) for m, d, since in FIXED_HOLIDAYS]
    found += [((m, lo), _floating(year, m, w, lo)) for m, w, lo, _ in FLOATING_HOLIDAYS]
    return F.filter(F.array(*[c for _, c in sorted(found, key=lambda f: f[0])]), lambda p: p.isNotNull())


def _holidays_before(year: Column) -> Column:
    return 10 * (year - 1) + F.greatest(year - SINCE_2021, F.lit(0))


def _placed(year: int, eleven: bool) -> list[date]:
    """The observed holidays of a year in order, the first perhaps on 31 December before it."""
    found = [date(year, m, d) for m, d, since in FIXED_HOLIDAYS if eleven or not since]
    found = [d + timedelta({SATURDAY: -1, SATURDAY + 1: 1}.get(d.weekday(), 0)) for d in found]
    for m, weekday, first, _ in FLOATING_HOLIDAYS:
        start = date(year, m, first)
        found.append(start + timedelta((weekday - start.weekday()) % 7))
    return sorted(found)


def _number(day: date) -> int:
    weeks, weekday = divmod(day.toordinal() - 1, 7)
    return 5 * weeks + min(weekday + 1, 5)


def _year_pairs() -> str:
    """Holidays of a year and the next by the year's kind, numbered from its 1 January.

    A kind is the weekday of 1 January, which of the two years is a leap year, and which of
    them have eleven holidays: 63 rows of constants for all years.
    """
    leap = lambda y: y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    years = {(date(y, 1, 1).weekday(), 0 if leap(y) else 1 if leap(y + 1) else 2): y for y in range(2001, 2401)}
    rows = []
    for weekday in range(7):
        for leaps in range(3):
            y = years[weekday, leaps]
            for full in range(3):
                days = _placed(y, full == 2) + _placed(y + 1, full >= 1)
                rows.append([_number(d) - _number(date(y, 1, 1)) for d in days])
    return f"array({', '.join(f'array{tuple(r)}' for r in rows)})"


YEAR_PAIRS = _year_pairs()


def _new_year(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def near_holidays(year: Column) -> Column:
    """Weekday numbers of the holidays of a year and the next, less that of the year's 1 January."""
    leap = lambda y: (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    leaps = F.when(leap(year), 0).when(leap(year + 1), 1).otherwise(2)
    full = F.when(year >= SINCE_2021, 2).when(year + 1 >= SINCE_2021, 1).otherwise(0)
    return F.get(F.expr(YEAR_PAIRS), F.weekday(_new_year(year)) * 9 + leaps * 3 + full)


def business_index(day: Column) -> Column:
    """Business days from year 1 up to and including ``day``."""
    year, number = F.year(day), weekday_number(day)
    at = number - weekday_number(_new_year(year))
    # the next year's list begins with 31 December when its 1 January is a Saturday
    passed = F.get(F.transform(F.array(F.struct(at.alias("at"), near_holidays(year).alias("near"))), lambda x: F.size(
        F.filter(x["near"], lambda p: p <= x["at"]))), F.lit(0))
    return (number - _holidays_before(year) - passed).cast("int")


def _past(number: Column, holidays: Column, after: Column | None = None) -> Column:
    """``number`` moved on by a weekday for each of the ascending ``holidays`` that it meets."""
    def step(q: Column, p: Column) -> Column:
        met = p <= q if after is None else (p <= q) & (p > after)
        return F.when(met, q + 1).otherwise(q)

    return F.aggregate(holidays, number.cast("int"), step)


def business_day_at(index: Column) -> Column:
    """The business day with this ``business_index``.

    Its year is known from the average year to one more or less, so the holidays of three
    years decide, whatever the date.
    """
    later = index - BUSINESS_DAYS_BEFORE_2021
    year = F.when(later <= 0, F.floor((index - 1) / YEAR_OF_TEN) + 1).otherwise(
        SINCE_2021 + F.floor((later - 1) / YEAR_OF_ELEVEN)).cast("int")
    near = F.flatten(F.transform(F.sequence(year - 1, year + 1), holiday_numbers))
    return weekday_at(_past(index + _holidays_before(year - 1), near))


def holidays_ahead(day: Column) -> Column:
    """``since, at, holidays``: what ``business_days_after`` needs of a day, taken once for several periods."""
    since = weekday_number(_new_year(F.year(day)))
    return F.struct(since.alias("since"), (weekday_number(day) - since).alias("at"),
                    near_holidays(F.year(day)).alias("holidays"))


def business_days_after(ahead: Column, n: int | Column) -> Column:
    """The ``n``-th business day after the day of ``holidays_ahead``, for ``n`` from 1 to 240."""
    steps = F.lit(n) if isinstance(n, int) else n
    return weekday_at(ahead["since"] + _past(ahead["at"] + steps, ahead["holidays"], ahead["at"]))
