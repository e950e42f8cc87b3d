"""ASCII grid files: reading, naming, writing."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlattice.joins import MAX_BROADCAST_KEYS, broadcast_if_small
from airlattice.session import listing_in_few_tasks, stage, staged

# Fixed value: raster names are province[%city]#yyyy-MM-ddHhh#pollutant, a missing city being
# the province itself; the pollutant ends at the first dot.
NAME_PATTERN = r"^([^%#]+)(?:%([^#]+))?#(\d{4}-\d{2}-\d{2})H(\d{2})#([^.#]+)(?:\.[^#]*)?$"

# Files above this size are read line by line in many tasks instead of as one record.
MAX_WHOLE_FILE = 256 * 1024 * 1024

# Most tasks that write parts of rasters.
MAX_PART_FILES = 99_999

# Tasks that write parts: a few per core, more where each would write more bytes than this.
WRITERS_PER_CORE = 4
WRITER_BYTES = 64 * 1024 * 1024

# Header keys in lower case, with the column each of them fills.
HEADER_KEYS = {
    "ncols": ("ncols",),
    "nrows": ("nrows",),
    "xll": ("xllcorner", "xllcenter"),
    "yll": ("yllcorner", "yllcenter"),
    "cellsize": ("cellsize", "dx", "dy"),
    "nodata": ("nodata_value",),
}
HEADER_TYPES = {"ncols": "int", "nrows": "int"}
_KNOWN_KEYS = [key for keys in HEADER_KEYS.values() for key in keys]
_HEADER_LINE = rf"(?i)^\s*({'|'.join(_KNOWN_KEYS)})\s"


def _file_path():
    return F.url_decode("_metadata.file_path")


def _is_part_file():
    return _file_path().rlike(r"/part-\d+[^/]*$")


def _raster_name():
    """Name of the raster a file holds: the file's own, or of its folder for Spark part files."""
    file = F.regexp_extract(_file_path(), r"([^/]+?)(\.[A-Za-z]+)?$", 1)
    folder = F.regexp_extract(_file_path(), r"/([^/]+)/[^/]+$", 1)
    # partition folders escape special characters once more
    escaped = F.replace(F.regexp_replace(folder, "^raster=", ""), F.lit("+"), F.lit("%2B"))
    of_folder = F.when(F.startswith(folder, F.lit("raster=")), F.url_decode(escaped)).otherwise(folder)
    return F.when(_is_part_file(), of_folder).otherwise(file)


def _raster_path():
    """The file of a raster, or the folder of its part files."""
    return F.when(_is_part_file(), F.regexp_extract(_file_path(), r"^(.*)/[^/]+$", 1)).otherwise(_file_path())


def with_name_parts(df: DataFrame, name: str = "name") -> DataFrame:
    """Add province, city, time (text) and pollutant from the raster name; a name of another form gives
    empty parts (see ``has_name_parts``)."""
    part = lambda i: F.regexp_extract(name, NAME_PATTERN, i)
    return df.withColumns(
        {
            "province": part(1),
            "city": F.when(part(2) == "", part(1)).otherwise(part(2)),
            "time": F.concat(part(3), F.lit(" "), part(4), F.lit(":00:00")),
            "pollutant": part(5),
        }
    )


def has_name_parts(name: str = "name"):
    return F.col(name).rlike(NAME_PATTERN)


def list_rasters(spark: SparkSession, paths) -> DataFrame:
    """(path, name, size, in_parts, modified) of all rasters below the paths; no file is opened. The part files
    of a folder are one raster, whose size is their sum and whose time the latest; a raster that consists of
    one file is not in parts."""
    with listing_in_few_tasks(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    each = files.select(
        _raster_path().alias("path"), _raster_name().alias("name"),
        F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"),
    )
    parts = F.count(F.lit(1))
    listed = each.groupBy("path", "name").agg(F.sum("size").alias("size"), (parts > 1).alias("in_parts"), F.max("modified").alias("modified"))
    return listed.select("path", "name", "size", "in_parts", "modified")


def _text_files(spark: SparkSession, paths, wanted: list | None, **options) -> DataFrame:
    """Text below the paths; of the rasters ``wanted`` only, if they are listed. Spark leaves out files by a
    condition on their paths before any is opened."""
    with listing_in_few_tasks(spark):
        files = spark.read.option("recursiveFileLookup", True).text(paths, **options)
    return files if wanted is None else files.where(_raster_path().isin(wanted))


def _header_columns(value_of):
    """The header columns, from a function that gives the number under a key, if any."""
    columns = []
    for name, keys in HEADER_KEYS.items():
        missing = F.raise_error(F.concat(F.lit(f"no {keys[0]} in the header of "), F.col("path"))).cast("double")
        number = F.coalesce(*[value_of(key) for key in keys], missing)
        columns.append(number.cast(HEADER_TYPES.get(name, "double")).alias(name))
    return columns


def _word(line, index: int):
    return F.get(F.split(F.trim(line), r"\s+"), F.lit(index))


def read_asc(spark: SparkSession, paths, max_size: int = None, wanted: list = None, rasters: DataFrame = None) -> DataFrame:
    """One row per raster: path, name, ncols, nrows, xll, yll, cellsize, nodata, lines.

    A file is one record, so it must fit a task; with ``max_size``, larger files are left out (see
    ``read_asc_rows``, which also reads rasters in parts). Parallelism comes from the number of files. The header is
    the leading lines with known keys, in any case and order. ``lines`` is the raster body, top row
    first, still as text. ``wanted`` lists the paths of the rasters to open, all by default; of what is
    opened only ``rasters`` (path) are looked into, if given.
    """
    files = _text_files(spark, paths, wanted, wholetext=True)
    if max_size is not None:
        files = files.where(F.col("_metadata.file_size") <= max_size)
    named = files.select(_raster_path().alias("path"), _raster_name().alias("name"), "value")
    if rasters is not None:
        named = named.join(broadcast_if_small(rasters.select("path"), MAX_BROADCAST_KEYS), "path", "left_semi")
    split = named.select(
        "path",
        "name",
        F.filter(F.split("value", r"\r?\n"), lambda line: F.trim(line) != "").alias("all_lines"),
    )
    size, is_header = F.size("all_lines"), F.transform("all_lines", lambda line: line.rlike(_HEADER_LINE))
    first_other = F.array_position(is_header, F.lit(False)).cast("int")
    leading = F.when(first_other > 0, first_other - 1).otherwise(size)
    header_lines = F.slice("all_lines", F.lit(1), leading)
    entries = F.transform(header_lines, lambda line: F.struct(F.lower(_word(line, 0)), _word(line, 1)))
    parted = split.select(
        "path",
        "name",
        F.map_from_entries(entries).alias("header"),
        F.slice("all_lines", leading + 1, size).alias("lines"),
    )
    numbers = _header_columns(lambda key: F.try_element_at("header", F.lit(key)).cast("double"))
    return parted.select("path", "name", *numbers, "lines")


def _headers_of(lines: DataFrame, *counts) -> DataFrame:
    """path, ``counts`` and the header columns, from lines (path, value)."""
    key, value = F.lower(_word(F.col("value"), 0)), _word(F.col("value"), 1).try_cast("double")
    found = lines.groupBy("path").agg(*counts, *[F.max(F.when(key == k, value)).alias(f"header_{k}") for k in _KNOWN_KEYS])
    kept = [c for c in found.columns if not c.startswith("header_") or c == "header_lines"]
    return found.select(*kept, *_header_columns(lambda k: F.col(f"header_{k}")))


def read_headers(spark: SparkSession, paths, wanted: list = None, rasters: DataFrame = None) -> DataFrame:
    """path and the header columns of rasters, without their bodies: those ``wanted`` by path, those of
    ``rasters`` (path), or all."""
    lines = _text_files(spark, paths, wanted).where(F.col("value").rlike(_HEADER_LINE)).select(_raster_path().alias("path"), "value")
    if rasters is not None:
        lines = lines.join(broadcast_if_small(rasters.select("path"), MAX_BROADCAST_KEYS), "path", "left_semi")
    return _headers_of(lines)


def read_asc_rows(
    spark: SparkSession, paths, min_size: int = None, rasters: DataFrame = None, wanted: list = None
) -> DataFrame:
    """One row per raster row, as from ``raster_rows(read_asc(...))``, for rasters of any size.

    Files are read in splits by many tasks, and the part files of one folder make up one raster
    (see ``write_asc``). Lines are staged with the place they were read at; a line's number is the
    number of lines in the splits before its own plus its place in that split. ``min_size``
    leaves out whole files up to that size; parts are read whatever their size. ``rasters`` (path)
    are those to read, or ``wanted``, a list of their paths.
    """
    files = _text_files(spark, paths, wanted)
    if min_size is not None:
        files = files.where((F.col("_metadata.file_size") > min_size) | _is_part_file())
    placed = files.where(F.trim("value") != "").select(
        _raster_path().alias("path"),
        _raster_name().alias("name"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").rlike(_HEADER_LINE).alias("is_header"),
        "value",
    )
    if rasters is not None:
        placed = placed.join(broadcast_if_small(rasters.select("path"), MAX_BROADCAST_KEYS), "path", "left_semi")
    lines = stage(placed, "raster-lines")

    split = ["path", "file", "block"]
    counted = lines.groupBy(*split).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(*split, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))

    headers = _headers_of(lines, F.count_if("is_header").alias("header_lines"), F.count(F.lit(1)).alias("all_lines"))
    short = F.raise_error(F.concat(F.lit("raster does not hold nrows rows: "), F.col("path"))).cast("int")
    whole = F.col("all_lines") - F.col("header_lines") == F.col("nrows")
    headers = headers.withColumn("nrows", F.when(whole, F.col("nrows")).otherwise(short)).drop("all_lines")

    numbered = lines.join(broadcast_if_small(starts, MAX_BROADCAST_KEYS), split)
    joined = numbered.join(broadcast_if_small(headers, MAX_BROADCAST_KEYS), "path")
    # Header lines below the body are an error, not rows less.
    row = F.col("place") + F.col("shift") - F.col("header_lines")
    late = F.raise_error(F.concat(F.lit("a header line inside the body of "), F.col("path"))).cast("bigint")
    row = F.when(F.col("is_header") & (row >= 0), late).otherwise(row)
    body = joined.withColumn("row", row).where(F.col("row") >= 0)
    row = F.col("row")
    # Spark may look at values before it drops header lines.
    values = F.when(~F.col("is_header"), F.split(F.trim("value"), r"\s+").cast("array<float>"))
    return body.select("path", "name", *HEADER_KEYS, row.cast("int").alias("row"), values.alias("values"))


def raster_rows(rasters: DataFrame) -> DataFrame:
    """One row per raster row: the raster's columns, row (0 = top), values."""
    kept = [c for c in rasters.columns if c != "lines"]
    exploded = rasters.select(*kept, F.posexplode("lines").alias("row", "line"))
    return exploded.select(*kept, "row", F.split(F.trim("line"), r"\s+").cast("array<float>").alias("values"))


def write_asc(text: DataFrame, path: str) -> None:
    """Raster text (line, value) of one raster as ordered part files that read as one, by
    concatenation or ``read_asc_rows``."""
    text.orderBy("line").select("value").write.mode("overwrite").text(path)


def write_asc_files(text: DataFrame, path: str, max_file: int = None) -> None:
    """Raster text (raster, line, value) of many rasters, in folders ``raster=name``; all are written side by
    side.

    A raster is one file, so its lines meet in one task. With ``max_file`` only those up to that many bytes
    are; larger ones become ordered parts of about that size (by line range), which read as one raster.
    The text is then computed once, into a staging folder that goes afterwards.
    """
    if max_file is None:
        _write_folders(text.repartition("raster"), path)
        return
    with staged(text.select("raster", "line", "value"), "raster-text") as lines:
        bytes_of = F.sum(F.octet_length("value") + 1)
        sizes = lines.groupBy("raster").agg(F.count(F.lit(1)).alias("n_lines"), bytes_of.alias("bytes"))
        # Names of part files are in the order of tasks as long as these have five digits.
        parts = F.least(F.ceil(F.col("bytes") / max_file), F.lit(MAX_PART_FILES))
        sizes = sizes.select("raster", F.ceil(F.col("n_lines") / parts).alias("part_lines"), parts.alias("parts"), "bytes")
        # A task writes parts of many rasters, but one of each: tasks follow from bytes and cores, and are no
        # fewer than the parts of one raster, which lie in successive tasks.
        total = sizes.agg(F.sum("parts").alias("parts"), F.max("parts").alias("most"), F.sum("bytes").alias("bytes")).first()
        cores = text.sparkSession.sparkContext.defaultParallelism
        wanted = max(WRITERS_PER_CORE * cores, -(-(total["bytes"] or 0) // WRITER_BYTES))
        tasks = max(1, total["most"] or 0, min(total["parts"] or 0, wanted, MAX_PART_FILES))
        first = F.pmod(F.xxhash64("raster"), F.lit(tasks) - F.col("parts") + 1)
        placed = sizes.select("raster", "part_lines", "parts", first.alias("first"))
        placed = lines.join(broadcast_if_small(placed, MAX_BROADCAST_KEYS), "raster")
        part = F.least(F.coalesce(F.floor(F.col("line") / F.col("part_lines")), F.lit(0)), F.col("parts") - 1)
        task = (F.col("first") + part).cast("int")
        _write_folders(placed.repartitionById(tasks, task), path)


def _write_folders(text: DataFrame, path: str) -> None:
    text.sortWithinPartitions("raster", "line").select("raster", "value").write.mode("overwrite").partitionBy("raster").text(path)


def write_single_csv(result: DataFrame, path: str) -> None:
    """A time query result (one row per bucket) as a single file."""
    result.repartition(1).write.mode("overwrite").csv(path)
