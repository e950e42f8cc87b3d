"""Cleaning and typing of station text."""

import uuid

from pyspark.sql import functions as F

from airlattice.operators import stations as ops
from airlattice.plans.station_etl import preview, read_rejects, read_valid, run_station_etl, sort_out, station_table
from airlattice.registry import standins as st
from airlattice.sources.text import read_lines, write_lines

# Fixed values of the questions asked.
COLUMNS = ("time", "city", "site", "aqi", "o3_8h")
TOP = 100


def _lined(rows):
    return rows.select(F.size("fields").cast("bigint").alias("n"), F.array_join("fields", "|", "null").alias("line"))


def split_rows(spark, sf_dir):
    return ops.split_rows(st.station_lines(spark, sf_dir))


def filled(spark, sf_dir):
    return ops.fill_blanks(split_rows(spark, sf_dir))


def full_rows(spark, sf_dir, compat=False):
    with_province = ops.add_province(filled(spark, sf_dir), st.provinces(spark, sf_dir))
    return ops.add_location(with_province, st.locations(spark, sf_dir), compat)


def station_split(spark, sf_dir):
    return _lined(split_rows(spark, sf_dir))


def station_clean(spark, sf_dir):
    return _lined(filled(spark, sf_dir))


def add_province(spark, sf_dir):
    return _lined(ops.add_province(filled(spark, sf_dir), st.provinces(spark, sf_dir)))


def add_location(spark, sf_dir):
    return _lined(full_rows(spark, sf_dir))


def distinct_address(spark, sf_dir):
    rows = ops.add_province(filled(spark, sf_dir), st.provinces(spark, sf_dir)).where(F.size("fields") > 3)
    return ops.distinct_addresses(rows, compat=True)


def _valid(compat):
    def run(spark, sf_dir):
        rows = full_rows(spark, sf_dir, compat)
        checked = rows.withColumn("valid", ops.is_valid_row(F.col("fields"), compat))
        return _lined(checked.where("valid"))

    return run


def _repair(compat):
    def run(spark, sf_dir):
        return _lined(ops.repair_rows(full_rows(spark, sf_dir, compat), compat))

    return run


def _time(df):
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def _typed(compat):
    def run(spark, sf_dir):
        return _time(ops.to_air_data(full_rows(spark, sf_dir, compat), compat))

    return run


def _chain(compat):
    def run(spark, sf_dir):
        lookups = st.provinces(spark, sf_dir), st.locations(spark, sf_dir)
        return _time(ops.clean_station(st.station_lines(spark, sf_dir), *lookups, compat))

    return run


def station_files(spark, sf_dir):
    """The same from files: station text and both lookups as files; through a view."""
    folder = _lookup_files(spark, sf_dir)
    cleaned = station_table(spark, st.station_folder(spark, sf_dir), f"{folder}/provinces", f"{folder}/locations")
    preview(cleaned)
    return _time(spark.sql("SELECT * FROM air_data"))


def _lookup_files(spark, sf_dir) -> str:
    folder = st.scratch(spark, "lookups")
    header = spark.createDataFrame([(0, "province city")], "part int, value string")
    cities = st.provinces(spark, sf_dir).select(F.lit(1).alias("part"), F.concat_ws(" ", "province", "city").alias("value"))
    write_lines(header.unionByName(cities).orderBy("part").coalesce(1), f"{folder}/provinces")
    header = spark.createDataFrame([(0, "address lng lat")], "part int, value string")
    places = st.locations(spark, sf_dir).select(F.lit(1).alias("part"), F.concat_ws(" ", "address", "lng", "lat").alias("value"))
    write_lines(header.unionByName(places).orderBy("part").coalesce(1), f"{folder}/locations")
    return folder


def station_managed(spark, sf_dir):
    """The whole job into a managed table, run twice (it replaces), then read by name."""
    folder = _lookup_files(spark, sf_dir)
    name = f"station_{uuid.uuid4().hex}"
    for _ in range(2):
        run_station_etl(spark, st.station_folder(spark, sf_dir), f"{folder}/provinces", f"{folder}/locations", name)
    return _time(spark.table(name))


def _sorted_out(spark, sf_dir):
    folder, target = _lookup_files(spark, sf_dir), st.scratch(spark, "sorted-out")
    places = f"{folder}/provinces", f"{folder}/locations"
    return target, sort_out(spark, st.station_folder(spark, sf_dir), *places, target)


def station_rejects(spark, sf_dir):
    """Every line, valid as full rows or rejected with its reasons."""
    target, _ = _sorted_out(spark, sf_dir)
    valid = read_valid(spark, target).select("value", F.lit("").alias("reasons"))
    return valid.unionByName(read_rejects(spark, target).select("value", F.array_join("reasons", " ").alias("reasons")))


def station_reject_counts(spark, sf_dir):
    """The counts taken while the lines were written."""
    _, counts = _sorted_out(spark, sf_dir)
    return spark.createDataFrame(sorted(counts.items()), "reason string, n bigint")


def station_preview(spark, sf_dir):
    """The first rows by every column, through the view."""
    folder = _lookup_files(spark, sf_dir)
    cleaned = _time(station_table(spark, st.station_folder(spark, sf_dir), f"{folder}/provinces", f"{folder}/locations"))
    return preview(cleaned, "air_preview", TOP, cleaned.columns)


def station_project(spark, sf_dir):
    return ops.project_columns(filled(spark, sf_dir), COLUMNS)


def station_csv(spark, sf_dir):
    """Written as text and read back."""
    path = st.scratch(spark, "csv")
    write_lines(ops.to_csv_lines(full_rows(spark, sf_dir)), path)
    return read_lines(spark, path)


def station_topn(spark, sf_dir):
    return ops.top_lines(filled(spark, sf_dir), TOP)


def _row_sql(relation, where=""):
    return (
        "SELECT len(f) AS n, array_to_string(list_transform(f, lambda v: coalesce(v, 'null')), '|') AS line "
        f"FROM {relation} {where}"
    )


_BLANK_SQL = "(v IS NULL OR trim(v) = '' OR v = '_')"
_TIME_SQL = (
    "regexp_full_match(f[1], '((19|20)[0-9]{2})-(0?[1-9]|1[012])-(0?[1-9]|[12][0-9]|3[01]) "
    "([01]?[0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]')"
)
_OLD_SQL = f"(NOT {_TIME_SQL} OR f[1] < '2016-07-01 00:00:00')"


def _number_sql(compat):
    return r"([1-9]+(\.\d+)?|0\.\d+)" if compat else r"\d+(\.\d+)?"


def _valid_sql(compat):
    number = _number_sql(compat)
    where = f"""WHERE len(list_filter(f, lambda v: {_BLANK_SQL})) = 0
  AND len(f) >= CASE WHEN {_OLD_SQL} THEN 20 ELSE 16 END
  AND regexp_full_match(f[7], '{number}')
  AND len(list_filter(f[10:], lambda v: NOT regexp_full_match(v, '{number}'))) = 0"""
    return f"WITH {st.station_full_sql(compat)} {_row_sql('full_rows', where)}"


def _repaired_sql(compat):
    """Relation ``repaired`` of lists f, and the time as parsed."""
    number = _number_sql(compat)
    return f"""{st.station_full_sql(compat)},
padded AS (
  SELECT list_transform(
    list_concat(f, list_transform(range(greatest(CASE WHEN {_OLD_SQL} THEN 20 ELSE 16 END - len(f), 0)), lambda i: '0')),
    lambda v: CASE WHEN {_BLANK_SQL} THEN '0' ELSE v END) AS f, {_OLD_SQL} AS old, {_TIME_SQL} AS timed, f AS before
  FROM full_rows),
repaired AS (
  SELECT list_transform(f, lambda v, i: CASE
    WHEN i = 1 AND NOT timed THEN '0-0-0 00:00:00'
    WHEN (i = 7 OR i >= 10) AND NOT regexp_full_match(v, '{number}') THEN '0' ELSE v END) AS f, old, timed, before
  FROM padded)"""


def _typed_sql(compat):
    a = dict(zip(ops.MEASURES, ops.LAYOUT_A_PLACES))
    b = dict(zip(ops.MEASURES, ops.LAYOUT_B_PLACES))
    measures = ", ".join(
        f"TRY_CAST(CASE WHEN old THEN f[{a[m] + 1}] ELSE f[{b[m] + 1}] END AS DOUBLE) AS {m}" for m in ops.MEASURES
    )
    if compat:
        province, lng, lat = "f[2]", "f[5]::DOUBLE", "f[6]::DOUBLE"
    else:
        province, lng, lat = "before[2]", "TRY_CAST(before[5] AS DOUBLE)", "TRY_CAST(before[6] AS DOUBLE)"
    return f"""WITH {_repaired_sql(compat)}
SELECT f[1] AS time, CASE WHEN timed THEN f[1] END AS ts, {province} AS province, f[3] AS city, f[4] AS site,
       {lng} AS lng, {lat} AS lat, {measures} FROM repaired"""


_JUDGED_SQL = f"""{st.STATION_SQL},
raw AS (SELECT value, string_split(rtrim(value, ','), ',') AS f FROM lines WHERE rtrim(value, ',') <> '' AND NOT starts_with(value, 'time,')),
data AS (SELECT value, list_transform(f, lambda v: CASE WHEN trim(v) = '' THEN '0' ELSE v END) AS f FROM raw),
placed AS (
  SELECT value, len(f) < 5 AS few, CASE WHEN len(f) < 5 THEN f ELSE
    list_concat([f[1]], [province], f[2:3], [coalesce(lng, ''), coalesce(lat, '')], f[4:]) END AS f
  FROM data LEFT JOIN provinces ON f[2] = city LEFT JOIN locations ON address = province || f[2] || f[3]),
judged AS (
  SELECT value, f, CASE WHEN few THEN ['few'] ELSE list_filter([
    CASE WHEN f[2] IS NULL THEN 'province' END, CASE WHEN f[5] = '' THEN 'location' END,
    CASE WHEN len(f) < CASE WHEN {_OLD_SQL} THEN 20 ELSE 16 END THEN 'short' END,
    CASE WHEN len(list_filter(list_concat(f[1:1], f[3:4], f[7:]), lambda v: {_BLANK_SQL})) > 0 THEN 'blank' END,
    CASE WHEN len(list_filter(list_concat(f[7:7], f[10:]), lambda v: NOT regexp_full_match(v, '{_number_sql(False)}'))) > 0 THEN 'number' END],
    lambda r: r IS NOT NULL) END AS reasons
  FROM placed)"""

_REASON_COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{r}' AS reason, count(*) FILTER (list_contains(reasons, '{r}')) AS n FROM judged" for r in ops.REASONS
)


QUERIES = {
    "station_split": (station_split, f"WITH {st.STATION_SQL} {_row_sql('split')}"),
    "station_clean": (station_clean, f"WITH {st.STATION_SQL} {_row_sql('filled')}"),
    "add_province": (
        add_province,
        f"WITH {st.station_full_sql(False)} {_row_sql('with_province')}",
    ),
    "add_location": (add_location, f"WITH {st.station_full_sql(False)} {_row_sql('full_rows')}"),
    "distinct_address": (
        distinct_address,
        f"WITH {st.station_full_sql(True)} SELECT DISTINCT concat(coalesce(f[2], 'null'), f[3], f[4]) AS address "
        "FROM with_province WHERE len(f) > 3",
    ),
    "station_valid": (_valid(False), _valid_sql(False)),
    "station_valid_compat": (_valid(True), _valid_sql(True)),
    "station_repair": (_repair(False), f"WITH {_repaired_sql(False)} {_row_sql('repaired')}"),
    "station_repair_compat": (_repair(True), f"WITH {_repaired_sql(True)} {_row_sql('repaired')}"),
    "station_typed": (_typed(False), _typed_sql(False)),
    "station_typed_compat": (_typed(True), _typed_sql(True)),
    "station_chain": (_chain(False), _typed_sql(False)),
    "station_chain_compat": (_chain(True), _typed_sql(True)),
    "station_files": (station_files, _typed_sql(False)),
    "station_managed": (station_managed, _typed_sql(False)),
    "station_rejects": (
        station_rejects,
        f"""WITH {_JUDGED_SQL}
SELECT CASE WHEN len(reasons) = 0 THEN array_to_string(f, ',') ELSE value END AS value, array_to_string(reasons, ' ') AS reasons
FROM judged""",
    ),
    "station_reject_counts": (
        station_reject_counts,
        f"WITH {_JUDGED_SQL} {_REASON_COUNTS_SQL} UNION ALL SELECT 'rows', count(*) FROM judged "
        "UNION ALL SELECT 'valid', count(*) FILTER (len(reasons) = 0) FROM judged",
    ),
    "station_preview": (station_preview, f"SELECT * FROM ({_typed_sql(False)}) ORDER BY ALL NULLS FIRST LIMIT {TOP}"),
    "station_project": (
        station_project,
        f"WITH {st.STATION_SQL} SELECT f[1] AS time, f[2] AS city, f[3] AS site, f[4] AS aqi, f[15] AS o3_8h FROM filled",
    ),
    "station_csv": (
        station_csv,
        f"WITH {st.station_full_sql(False)} SELECT array_to_string(list_transform(f, lambda v: coalesce(v, 'null')), ',') AS value "
        "FROM full_rows",
    ),
    "station_topn": (
        station_topn,
        f"WITH {st.STATION_SQL} SELECT array_to_string(f, ',') AS value FROM filled ORDER BY value DESC LIMIT {TOP}",
    ),
}
