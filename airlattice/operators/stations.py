"""Cleaning and typing of hourly station rows.

Rows are ragged, in one of two layouts, switched at a date. Array forms of the steps
(``split_rows`` ... ``repair_rows``) keep whole rows for text output; ``clean_station`` is the
whole chain on single fields, where only the fields that end up in the typed table are repaired
and everything stays in generated code.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.functions.timebuckets import is_time_text, parse_time
from airlattice.joins import spread_key

# Column names of layout A, the date of the switch to layout B, places of the
# measures in a row after province, lng and lat were inserted, the least number of fields,
# patterns of a number (plain, and the one that refuses a 0 digit before the point), the text
# of a bad time and of a blank value.
LAYOUT_A_COLUMNS = (
    "time", "city", "site", "aqi", "pm2.5", "pm2.5_24h", "pm10", "pm10_24h", "so2", "so2_24h",
    "no2", "no2_24h", "o3", "o3_24h", "o3_8h", "o3_8h_24h", "co", "co_24h",
)
LAYOUT_SWITCH = "2016-07-01 00:00:00"
MEASURES = ("aqi", "pm25", "pm10", "co", "no2", "ozone1hour", "ozone8hour", "so2")
LAYOUT_A_PLACES = (6, 7, 9, 19, 13, 15, 17, 11)
LAYOUT_B_PLACES = (6, 9, 10, 11, 12, 13, 14, 15)
LAYOUT_A_FIELDS = 20
LAYOUT_B_FIELDS = 16
NUMBER_PATTERN = r"^\d+(\.\d+)?$"
COMPAT_NUMBER_PATTERN = r"^([1-9]+(\.\d+)?|0\.\d+)$"
BAD_TIME = "0-0-0 00:00:00"
BLANK = "0"

# Province, lng and lat come before these places of the full row.
INSERTED_FIELDS = 3
# Places of the full row whose text must be a number: this one, and all from the second on.
CHECKED_PLACE = 6
CHECKED_FROM = 9


def number_pattern(compat: bool) -> str:
    return COMPAT_NUMBER_PATTERN if compat else NUMBER_PATTERN


def _is_empty(text: Column) -> Column:
    """Nothing but white space and control characters; decided at the first character mostly."""
    return text.rlike(r"^[\x00-\x20]*$")


def _is_blank(text: Column) -> Column:
    return text.isNull() | (text == "_") | _is_empty(text)


def _checked(place):
    return (place == CHECKED_PLACE) | (place >= CHECKED_FROM)


def _number_or_blank(text: Column, compat: bool) -> Column:
    """Numbers as they are; blanks and everything else become "0"."""
    return F.when(text.rlike(number_pattern(compat)), text).otherwise(BLANK)


def _text_or_blank(text: Column) -> Column:
    return F.when(_is_blank(text), BLANK).otherwise(text)


def _is_layout_a(ts: Column) -> Column:
    """Rows before the switch; rows without a readable time count as old ones."""
    return ts.isNull() | (ts < F.lit(LAYOUT_SWITCH).cast("timestamp"))


# --- array forms ----------------------------------------------------------------------------


def data_lines(lines: DataFrame) -> DataFrame:
    """Without header lines and lines of nothing but commas; judged on the text, before any split."""
    return lines.where(~F.col("value").rlike(r"^(time(,|$)|,+$)"))


def split_rows(lines: DataFrame) -> DataFrame:
    """``value`` to ``fields``: trailing empty fields go, as do header lines and lines of commas."""
    return data_lines(lines).select(F.split(F.regexp_replace("value", ",+$", ""), ",").alias("fields"))


def fill_blanks(rows: DataFrame) -> DataFrame:
    """Blank fields become "0"."""
    return rows.withColumn("fields", F.transform("fields", lambda x: F.when(_is_empty(x), BLANK).otherwise(x)))


def add_province(rows: DataFrame, provinces: DataFrame) -> DataFrame:
    """Insert the province of the city as second field (NULL if unknown); needs 2 fields or more.

    ``provinces`` is (city, province), one row per city. No broadcast is forced: Spark
    broadcasts the lookup while its size is below the threshold, else shuffles both sides and
    splits hot cities. Rows without a city are spread over all tasks.
    """
    kept = rows.where(F.size("fields") > 1).withColumn("city", spread_key(F.get("fields", F.lit(1)), F.col("fields")))
    joined = kept.join(provinces, "city", "left")
    return joined.withColumn(
        "fields",
        F.concat(F.slice("fields", 1, 1), F.array("province"), F.slice("fields", F.lit(2), F.size("fields"))),
    ).drop("city", "province")


def station_address(province: Column, city: Column, site: Column, compat: bool = False) -> Column:
    """Key of a station; without a province NULL, or with the text "null" in front (``compat``)."""
    return F.concat(F.coalesce(province, F.lit("null")) if compat else province, city, site)


def add_location(rows: DataFrame, locations: DataFrame, compat: bool = False) -> DataFrame:
    """Insert lng and lat as fifth and sixth field ("" if unknown); needs 6 fields or more.

    ``locations`` is (address, lng, lat) as text, one row per address. Rows without an address are spread over
    all tasks, whatever share of all they are.
    """
    address = spread_key(station_address(*[F.get("fields", F.lit(i)) for i in (1, 2, 3)], compat=compat), F.col("fields"))
    joined = rows.where(F.size("fields") > 5).withColumn("address", address).join(locations, "address", "left")
    found = F.array(F.coalesce("lng", F.lit("")), F.coalesce("lat", F.lit("")))
    return joined.withColumn(
        "fields", F.concat(F.slice("fields", 1, 4), found, F.slice("fields", F.lit(5), F.size("fields")))
    ).drop("address", "lng", "lat")


def distinct_addresses(rows: DataFrame, compat: bool = False) -> DataFrame:
    """Distinct station addresses of rows that carry a province."""
    address = station_address(*[F.get("fields", F.lit(i)) for i in (1, 2, 3)], compat=compat)
    return rows.select(address.alias("address")).distinct()


def is_valid_row(fields: Column, compat: bool = False) -> Column:
    """Strict check of a full row: nothing blank, enough fields, numbers where they belong."""
    full = ~F.exists(fields, _is_blank)
    old = _is_layout_a(parse_time(F.get(fields, F.lit(0))))
    long_enough = F.size(fields) >= F.when(old, LAYOUT_A_FIELDS).otherwise(LAYOUT_B_FIELDS)
    pattern = number_pattern(compat)
    numbers = F.get(fields, F.lit(CHECKED_PLACE)).rlike(pattern) & F.forall(
        F.slice(fields, F.lit(CHECKED_FROM + 1), F.size(fields)), lambda x: x.rlike(pattern)
    )
    return F.coalesce(long_enough & full & numbers, F.lit(False))


# Why a row is rejected: too few fields to be placed, unknown province or location, fewer fields than its
# layout has, a blank field, no number where one belongs.
REASONS = ("few", "province", "location", "short", "blank", "number")
# Fields of a row before its province and location are inserted.
PLACED_FIELDS = 5
_INSERTED_PLACES = (1, 4, 5)


def judged_rows(lines: DataFrame, provinces: DataFrame, locations: DataFrame, compat: bool = False) -> DataFrame:
    """value (the line), fields (the full row, or what there is of it), reasons: every data line with what is
    wrong with it. A row without reasons is valid, see ``is_valid_row``.

    One pass, without a shuffle while both lookups are small enough to broadcast.
    """
    rows = data_lines(lines).select("value", F.split(F.regexp_replace("value", ",+$", ""), ",").alias("fields"))
    rows = fill_blanks(rows).withColumn("few", F.size("fields") < PLACED_FIELDS)
    cities = rows.withColumn("city", spread_key(F.get("fields", F.lit(1)), F.col("fields")))
    placed = cities.join(provinces, "city", "left")
    address = station_address(F.col("province"), F.get("fields", F.lit(1)), F.get("fields", F.lit(2)), compat)
    located = placed.withColumn("address", spread_key(address, F.col("fields"))).join(locations, "address", "left")
    found = F.array("province"), F.array(F.coalesce("lng", F.lit("")), F.coalesce("lat", F.lit("")))
    parts = F.slice("fields", 1, 1), found[0], F.slice("fields", 2, 2), found[1], F.slice("fields", F.lit(4), F.size("fields"))
    full = located.withColumn("fields", F.when(F.col("few"), F.col("fields")).otherwise(F.concat(*parts)))

    own = F.filter("fields", lambda x, i: ~i.isin(*_INSERTED_PLACES))
    old = _is_layout_a(parse_time(F.get("fields", F.lit(0))))
    pattern = number_pattern(compat)
    wrong = F.exists(
        F.filter("fields", lambda x, i: _checked(i)), lambda x: ~F.coalesce(x.rlike(pattern), F.lit(False))
    )
    tests = {
        "few": F.col("few"),
        "province": F.get("fields", F.lit(1)).isNull(),
        "location": F.get("fields", F.lit(4)) == "",
        "short": F.size("fields") < F.when(old, LAYOUT_A_FIELDS).otherwise(LAYOUT_B_FIELDS),
        "blank": F.exists(own, _is_blank),
        "number": wrong,
    }
    found = [F.when(tests[r] if r == "few" else ~F.col("few") & tests[r], r) for r in REASONS]
    return full.select("value", "fields", F.filter(F.array(*found), lambda r: r.isNotNull()).alias("reasons"))


def reason_counts(prefix: str = "") -> list[Column]:
    """Aggregates over judged rows: all, valid, and those with each reason; a row may have several."""
    each = [F.count_if(F.array_contains("reasons", r)).alias(f"{prefix}{r}") for r in REASONS]
    return [F.count(F.lit(1)).alias(f"{prefix}rows"), F.count_if(F.size("reasons") == 0).alias(f"{prefix}valid"), *each]


def repair_rows(rows: DataFrame, compat: bool = False) -> DataFrame:
    """Full rows made regular: blanks and ``_`` to "0", bad times to a fixed text, padded to the
    layout's length, non-numbers in checked places to "0"."""

    def repaired(x, i):
        time = F.when(is_time_text(x), x).otherwise(BAD_TIME)
        checked = F.when(_checked(i), _number_or_blank(x, compat))
        return F.when(i == 0, time).otherwise(F.coalesce(checked, _text_or_blank(x)))

    old = _is_layout_a(parse_time(F.get("fields", F.lit(0))))
    want = F.when(old, LAYOUT_A_FIELDS).otherwise(LAYOUT_B_FIELDS)
    padding = F.array_repeat(F.lit(BLANK), F.greatest(want - F.size("fields"), F.lit(0)))
    return rows.withColumn("fields", F.concat(F.transform("fields", repaired), padding))


def project_columns(rows: DataFrame, names) -> DataFrame:
    """Columns of layout A by name; an unknown name is an error."""
    unknown = [n for n in names if n not in LAYOUT_A_COLUMNS]
    if unknown:
        raise ValueError(f"unknown columns {unknown}; known are {LAYOUT_A_COLUMNS}")
    return rows.select(*[F.get("fields", F.lit(LAYOUT_A_COLUMNS.index(n))).alias(n) for n in names])


def to_csv_lines(rows: DataFrame) -> DataFrame:
    """Rows back to comma-separated text; a missing field is written as "null"."""
    return rows.select(F.array_join("fields", ",", "null").alias("value"))


def top_lines(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` greatest lines in text order (each task keeps only its own n)."""
    return to_csv_lines(rows).orderBy(F.desc("value")).limit(n)


# --- typed table ----------------------------------------------------------------------------


def _measure(old: Column, place_a: int, place_b: int, shift: int, compat: bool) -> Column:
    """A measure from whichever layout applies, repaired and typed; not a number gives NULL."""
    text = F.get("fields", F.when(old, place_a - shift).otherwise(place_b - shift))
    number = _number_or_blank(text, compat)
    if not _checked(place_a):
        number = F.when(old, _text_or_blank(text)).otherwise(number)
    return number.try_cast("double")


def _typed(rows: DataFrame, shift: int, compat: bool) -> DataFrame:
    """The typed station table from raw_time, province, city, site, lng, lat and ``fields``, whose
    measures sit ``shift`` places before those of a full row. Unknown province and location are
    NULL, or "0" and 0.0 (``compat``)."""
    timed = rows.withColumn("ts", parse_time(F.col("raw_time"))).withColumn("old", _is_layout_a(F.col("ts")))
    old = F.col("old")

    def degrees(name: str) -> Column:
        number = F.col(name).try_cast("double")
        return (F.coalesce(number, F.lit(0.0)) if compat else number).alias(name)

    return timed.select(
        F.when(is_time_text(F.col("raw_time")), F.col("raw_time")).otherwise(BAD_TIME).alias("time"),
        "ts",
        (_text_or_blank(F.col("province")) if compat else F.col("province")).alias("province"),
        _text_or_blank(F.col("city")).alias("city"),
        _text_or_blank(F.col("site")).alias("site"),
        degrees("lng"),
        degrees("lat"),
        *[
            _measure(old, a, b, shift, compat).alias(name)
            for name, a, b in zip(MEASURES, LAYOUT_A_PLACES, LAYOUT_B_PLACES, strict=True)
        ],
    )


def to_air_data(rows: DataFrame, compat: bool = False) -> DataFrame:
    """Full rows (province and location inserted) to the typed table; repairs on the way."""
    names = ("raw_time", "province", "city", "site", "lng", "lat")
    named = rows.select("fields", *[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return _typed(named, 0, compat)


def clean_station(lines: DataFrame, provinces: DataFrame, locations: DataFrame, compat: bool = False) -> DataFrame:
    """Station text to the typed table: split, drop headers and short rows, join both lookups,
    repair, type. No shuffle while both lookups are small enough to broadcast.

    Rows need five fields, which is judged on the text, so that a line is split once.
    """
    long_enough = data_lines(lines).where(F.col("value").rlike(r"^([^,]*,){4,}[^,]"))
    rows = split_rows(long_enough)

    def filled(place: int) -> Column:
        text = F.get("fields", F.lit(place))
        return F.when(_is_empty(text), BLANK).otherwise(text)

    named = rows.select(
        "fields", F.get("fields", F.lit(0)).alias("raw_time"), filled(1).alias("city"), filled(2).alias("site")
    )
    placed = named.join(provinces, "city", "left")
    address = spread_key(station_address(F.col("province"), F.col("city"), F.col("site"), compat), F.col("fields"))
    located = placed.withColumn("address", address).join(locations, "address", "left")
    return _typed(located, INSERTED_FIELDS, compat)
