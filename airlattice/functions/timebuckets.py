"""Time text, epoch seconds and time buckets."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Time formats, bucket text formats, the text of the one bucket that holds
# everything, the pattern of a valid time (years 19xx and 20xx).
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
TIME_PATTERN = (
    r"^((19|20)[0-9]{2})-(0?[1-9]|1[012])-(0?[1-9]|[12][0-9]|3[01]) "
    r"([01]?[0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"
)
BUCKET_FORMATS = {
    "hour": "yyyy-MM-dd HH",
    "day": "yyyy-MM-dd",
    "month": "yyyy-MM",
    "season": "yyyy",
    "year": "yyyy",
}
ALL_TIME = "0000"

_ALIASES = {"hours": "hour"}
_TRUNC_UNITS = {"season": "quarter"}


def time_level(level: str) -> str:
    """Normalise a level name; unknown names are an error."""
    level = _ALIASES.get(level, level)
    if level != "all" and level not in BUCKET_FORMATS:
        raise ValueError(f"unknown time level {level!r}; use one of {[*BUCKET_FORMATS, 'all']}")
    return level


def bucket_start(ts: Column, level: str) -> Column:
    """First instant of the bucket: an 8-byte grouping key, unlike the text."""
    level = time_level(level)
    if level == "all":
        return F.lit(None).cast("timestamp")
    return F.date_trunc(_TRUNC_UNITS.get(level, level), ts)


def bucket_text(start: Column, level: str) -> Column:
    """Text of a bucket, given any instant in it."""
    level = time_level(level)
    if level == "all":
        return F.lit(ALL_TIME)
    text = F.date_format(start, BUCKET_FORMATS[level])
    if level == "season":
        text = F.concat(text, F.lit("*"), F.quarter(start).cast("string"))
    return text


def is_time_text(text: Column) -> Column:
    return text.rlike(TIME_PATTERN)


def parse_time(text: Column) -> Column:
    """TIMESTAMP of a valid time text, else NULL; one-digit month, day and hour are fine."""
    return F.when(is_time_text(text), text.try_cast("timestamp"))


def epoch_seconds(text: Column, zone: str | None = None) -> Column:
    """Epoch seconds of a time text, which tells the time of ``zone`` (without one, of the session's);
    an impossible date is an error, not a shifted date."""
    if zone is None:
        parsed = F.try_to_timestamp(text, F.lit(TIME_FORMAT))
    else:
        parsed = F.try_to_timestamp(F.concat(text, F.lit(f" {zone}")), F.lit(f"{TIME_FORMAT} VV"))
    checked = F.coalesce(parsed, F.raise_error(F.concat(F.lit("not a valid time: "), text)).cast("timestamp"))
    return F.when(text.isNotNull(), F.unix_timestamp(checked))
