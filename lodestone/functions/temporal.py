"""Times as evidence has them: parsing dialects, validity, ages and chronology. Unknown stays null throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numeric strings of at least this magnitude are epoch seconds; smaller ones are basic dates such as 20200709.
EPOCH_FLOOR = 1e8


# The formats in which mined sources spell their dates.
MINED_FORMATS = ("yyyy-M-d", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d H:m:s", "yyyy/M/d")


# The ISO spellings of a time: a whole date, with or without hyphens, then perhaps hours and what follows them, and an offset.
ISO_DATE = r"(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2}))"
ISO_TIME = r"(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?|(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?"
ISO_OFFSET = r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?"
ISO = rf"^{ISO_DATE}(?s:.{ISO_TIME}{ISO_OFFSET})?$"


def _iso(s: Column) -> Column:
    """An ISO time with a whole date, one without a zone as UTC (the session's zone); null for anything else, and for days that don't exist.

    What is left out of a time is zero; nothing else is ever filled in. Digits of a fraction beyond six are dropped.
    """
    # one match gives all parts, and lambdas bind them, so that they are found once; what stands behind the last bar is a line feed at the end
    groups = F.split(F.regexp_replace(s, ISO, "$1|$2$4|$3$5|$6|$7$10|$8$11|$9$12|$13|"), r"\|")
    or_zero = lambda c: F.when(c == "", "00").otherwise(c)

    def whole(p: Column) -> Column:
        offset, fraction = F.replace(p[7], F.lit(":"), F.lit("")), p[6]
        zone = F.when(offset.isin("", "Z"), "Z").when(F.length(offset) == 3, F.concat(offset, F.lit(":00"))).otherwise(F.concat_ws(":", F.substring(offset, 1, 3), F.substring(offset, 4, 2), F.nullif(F.substring(offset, 6, 2), F.lit(""))))
        return F.concat(
            p[0], F.lit("-"), p[1], F.lit("-"), p[2], F.lit("T"), or_zero(p[3]), F.lit(":"), or_zero(p[4]), F.lit(":"), or_zero(p[5]),
            F.when(fraction != "", F.concat(F.lit("."), F.substring(fraction, 1, 6))).otherwise(""), zone,
        )

    return F.try_to_timestamp(_bound(F.when(s.rlike(ISO), groups), whole))


def _bound(c: Column, f) -> Column:
    """f of a value that is made once, however often f names it."""
    return F.transform(F.array(c), f)[0]


def parse_time(s: Column, dialect: str = "pool") -> Column:
    """A timestamp from text, null if it is none.

    pool: numbers of EPOCH_FLOOR or more are epoch seconds, others basic dates. mining: every number is epoch
    seconds, and other texts are one of MINED_FORMATS. gaps: only digits are. metric: no numbers in text at all, nor blanks around it.
    """
    s = s if dialect == "metric" else F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    return _bound(s, lambda s: _bound(s.try_cast("double"), lambda number: _parsed(s, number, dialect)))


def _parsed(s: Column, number: Column, dialect: str) -> Column:
    if dialect == "pool":
        epoch = F.when(F.abs(number) >= EPOCH_FLOOR, number)
    elif dialect == "mining":
        epoch = number
    elif dialect == "gaps":
        epoch = F.when(s.rlike("^[0-9]+$"), number)
    else:
        epoch = F.lit(None).cast("double")
    spelled = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in MINED_FORMATS]) if dialect == "mining" else _iso(s)
    return F.coalesce(F.timestamp_seconds(epoch), spelled)


def strict_utc(s: Column) -> Column:
    """Whether the text is an RFC 3339 time in UTC with at most six fractional digits that exists."""
    return F.coalesce(s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|\+00:00)$") & F.try_to_timestamp(s).isNotNull(), F.lit(False))


def time_valid(evidence: Column, question: Column) -> Column:
    """Whether the evidence is not later than the question; null if either time is unknown."""
    return evidence <= question


def age_days(evidence: Column, question: Column) -> Column:
    """Days from the evidence to the question, with fractions; both in epoch seconds."""
    return (question - evidence) / 86400.0


def chronology(evidence: Column, question: Column) -> Column:
    """By UTC day of epoch seconds: PRIOR, FUTURE, SAME_DATE_UNCERTAIN or UNKNOWN."""
    e, q = F.floor(evidence / 86400), F.floor(question / 86400)
    return F.when(e < q, "PRIOR").when(e > q, "FUTURE").when(e == q, "SAME_DATE_UNCERTAIN").otherwise("UNKNOWN")


def pushed_into_future(evidence: Column, question: Column, days: int = 7) -> Column:
    """The later of the two, in whole seconds, and `days` more; null if either is unknown."""
    return F.when(evidence.isNotNull() & question.isNotNull(), F.floor(F.greatest(evidence, question)) + days * 86400)


def end_of_year(year: Column) -> Column:
    """The last second of a year."""
    return F.make_timestamp(year, F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(59))


def question_time(effective_year: Column, latest_snapshot: Column) -> tuple[Column, Column]:
    """(time, where it came from): the year's end, else the latest snapshot of the question's pool, else none."""
    by_year = end_of_year(effective_year)
    return (
        F.coalesce(by_year, latest_snapshot),
        F.when(effective_year.isNotNull(), "effective_year").when(latest_snapshot.isNotNull(), "latest_snapshot").otherwise("none"),
    )
