"""Text line -> typed point, with built-in expressions only.

Nothing here raises on dirty text, with ANSI mode on or off: a value that
cannot be read is NULL and its row is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltpoint.schema import (
    FILE_NAME_PATTERN,
    NANOS_PER_SECOND,
    SECONDS_PER_DAY,
)


MOST_BIGINT, LEAST_BIGINT = 2**63 - 1, -(2**63)


def file_name_matches(path: Column) -> Column:
    """Whether a path names an input file: ``<word>_<yymmdd>_<n>_<n>.dat[.gz]``."""
    return path.rlike(FILE_NAME_PATTERN)


def file_day(path: Column) -> Column:
    """DATE in the file name; NULL when the name or the date is not valid."""
    # Below a matching name the day is the third part from the end.
    digits = F.substring_index(F.substring_index(path, "_", -3), "_", 1)
    iso = F.concat(
        F.lit("20"),
        F.substring(digits, 1, 2),
        F.lit("-"),
        F.substring(digits, 3, 2),
        F.lit("-"),
        F.substring(digits, 5, 2),
    )
    # Five digits leave one for the day; fewer leave none.
    return F.when(file_name_matches(path) & (F.length(digits) >= 5), iso.try_cast("date"))


def split_spaces(line: Column) -> Column:
    """Trim, then split on runs of spaces; a line of spaces is one empty token.

    ``split(s, ' +')`` compiles its pattern for every row. Splitting on a single
    character takes no pattern, and the empty texts it leaves between the
    spaces of a run are removed.
    """
    cut = F.substring(line, F.lit(1), F.length(line) - F.lit(1))
    text = F.when(F.endswith(line, F.lit("\r")), cut).otherwise(line)
    tokens = F.array_remove(F.split(text, " "), "")
    return F.when(F.trim(line).isin("", "\r"), F.array(F.lit(""))).otherwise(tokens)


def token(tokens: Column, position: int) -> Column:
    """1-based token, NULL when the line is too short."""
    return F.get(tokens, F.lit(position - 1))


def _decimal_text(text: Column, doubtful: Column | None) -> Column:
    # Java number syntax also takes a type suffix ('3.5f') and hexadecimal
    # floats ('0x1p3'); neither is a number here, while 'inf' is one.
    foreign = text.rlike("[xX]|[^nN][dDfF]$")
    return F.when(~(foreign if doubtful is None else doubtful & foreign), text)


def to_double(text: Column, doubtful: Column | None = None) -> Column:
    """DOUBLE, or NULL. Where ``doubtful`` is given and false the text is known
    to have no foreign number syntax, and the test for it is not made."""
    return _decimal_text(text, doubtful).try_cast("double")


def to_float(text: Column, doubtful: Column | None = None) -> Column:
    return _decimal_text(text, doubtful).try_cast("float")


def to_int(text: Column) -> Column:
    """Signed 32-bit integer from hexadecimal, binary or decimal text.

    Decimal text with a fraction or an exponent is rounded half away from zero.
    """
    digits = F.substring(text, 3, 2**31 - 1)
    return (
        F.when(text.rlike("^0[xX]0*[0-9a-fA-F]{1,8}$"), F.conv(digits, 16, 10).try_cast("int"))
        .when(text.rlike("^0[bB]0*[01]{1,32}$"), F.conv(digits, 2, 10).try_cast("int"))
        .otherwise(F.round(to_double(text)).try_cast("int"))
    )


def station_count(mask: Column) -> Column:
    """Number of set bits of a 32-bit station mask."""
    # bit_count widens to 64 bits, so the sign extension is masked off.
    bits = to_int(mask).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.bit_count(bits).cast("tinyint")


def alt_km(metres: Column, doubtful: Column | None = None) -> Column:
    return (to_double(metres, doubtful) / F.lit(1000.0)).cast("float")


def epoch_ns(seconds_of_day: Column, day: Column, doubtful: Column | None = None) -> Column:
    """Seconds of day (text) + UTC day (DATE) -> nanoseconds since the epoch.

    The sum is a DOUBLE on purpose: the format's own precision is kept.
    """
    day_seconds = (F.unix_date(day).cast("bigint") * F.lit(SECONDS_PER_DAY)).cast("double")
    seconds = to_double(seconds_of_day, doubtful) + day_seconds
    return F.rint(seconds * F.lit(float(NANOS_PER_SECOND))).try_cast("bigint")


def epoch_ns_of_timestamp(ts: Column) -> Column:
    """Nanoseconds of a timestamp without time zone that holds UTC; the session
    time zone has no part in it."""
    day = F.unix_date(ts.cast("date")).cast("bigint") * F.lit(SECONDS_PER_DAY)
    minutes = (F.hour(ts) * F.lit(60) + F.minute(ts)).cast("bigint")
    micros = (F.extract(F.lit("SECOND"), ts) * F.lit(1_000_000)).cast("bigint")
    return ((day + minutes * F.lit(60)) * F.lit(1_000_000) + micros) * F.lit(1000)


def _fits(high: Column, low: Column) -> Column:
    """Whether a difference of two BIGINTs is one. Asked before it is taken, as an
    overflow costs an exception for each row."""
    return F.when(low < 0, high <= F.lit(MOST_BIGINT) + low).otherwise(high >= F.lit(LEAST_BIGINT) + low)


def exact_difference(high: Column, low: Column) -> Column:
    """BIGINT difference, NULL where it is beyond 64 bits."""
    return F.when(_fits(high, low), high - low)


def difference(high: Column, low: Column) -> Column:
    """DOUBLE difference of two BIGINTs: exact before it is rounded, or of the
    rounded numbers where the exact one is beyond 64 bits."""
    rounded = high.cast("double") - low.cast("double")
    return F.when(_fits(high, low), (high - low).cast("double")).otherwise(rounded)


def timestamp_of_epoch_ns(ns: Column) -> Column:
    """Display timestamp, cut to microseconds."""
    return F.timestamp_micros(floor_div(ns, 1000))


def floor_div(value: Column, by: int) -> Column:
    """Integer division rounding down, over the whole range of BIGINT."""
    below = F.when(value % F.lit(by) < 0, 1).otherwise(0)
    return F.call_function("div", value, F.lit(by)) - below


def fixed_decimals(value: Column) -> Column:
    """Text with six decimals, ties to even as C's ``%f`` rounds them; the sign
    of a small negative value stays. From 1e15 on, where a DOUBLE has no sixth
    decimal, digits after the 17th are zeros."""
    number = value.cast("double")
    small = F.abs(number) < F.lit(1e15)
    text = F.bround(F.when(small, number).cast("decimal(38,12)"), 6).cast("string")
    signed = F.when((number < 0) & ~text.startswith("-"), F.concat(F.lit("-"), text)).otherwise(text)
    return F.when(small, signed).otherwise(F.format_string("%.6f", number))


def parse_lines(lines: DataFrame) -> DataFrame:
    """``(file_day, line, ...)`` -> the point columns, other columns kept."""
    kept = [F.col(c) for c in lines.columns if c != "line"]
    tokens, doubtful = F.col("_tokens"), F.col("_doubtful")
    # One test per line instead of one per number: on a complete line every
    # number is followed by a space, the mask as a rule is not.
    foreign = F.col("line").rlike("[dDfFxX][^ ]* ")
    return (
        lines.select(*kept, "line", split_spaces(F.col("line")).alias("_tokens"))
        .select(*kept, "_tokens", ((F.size(tokens) < 7) | foreign).alias("_doubtful"))
        .select(
            *kept,
            epoch_ns(token(tokens, 1), F.col("file_day"), doubtful).alias("epoch_ns"),
            to_double(token(tokens, 2), doubtful).cast("float").alias("lat"),
            to_double(token(tokens, 3), doubtful).cast("float").alias("lon"),
            alt_km(token(tokens, 4), doubtful).alias("alt"),
            to_float(token(tokens, 5), doubtful).alias("chi"),
            to_float(token(tokens, 6), doubtful).alias("pdb"),
            station_count(token(tokens, 7)).alias("number_stations"),
        )
    )
