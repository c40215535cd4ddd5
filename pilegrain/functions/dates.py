"""Dates from file and folder names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A plausible year, then month and day with one kind of separator, not inside a longer number.
NAME_DATE = r"(?<!\d)(19\d{2}|20\d{2})([-_.]?)(0[1-9]|1[0-2])\2(0[1-9]|[12]\d|3[01])(?!\d)"
NAME_TIME = r"(?<!\d)([01]\d|2[0-3])([-_.:]?)([0-5]\d)\2([0-5]\d)\d{0,3}(?!\d)"
FOLDER_YEAR = r"(?<!\d)(19[89]\d|20[0-4]\d)(?!\d)"
EARLIEST_YEAR = 1990


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def date_from_name(name: Column, as_of_year: int) -> Column:
    """Timestamp without zone in a file name, a time after the date included; null where none is plausible."""
    part = lambda pattern, i, text=name: F.regexp_extract(text, pattern, i)
    year = part(NAME_DATE, 1)
    rest = F.regexp_replace(name, rf"^.*?{NAME_DATE}", "")
    clock = F.when(part(NAME_TIME, 1, rest) != "", F.concat_ws(":", part(NAME_TIME, 1, rest), part(NAME_TIME, 3, rest), part(NAME_TIME, 4, rest))).otherwise("00:00:00")
    written = F.concat(F.concat_ws("-", year, part(NAME_DATE, 3), part(NAME_DATE, 4)), F.lit(" "), clock)
    fits = (year != "") & F.try_to_number(year, F.lit("9999")).between(EARLIEST_YEAR, as_of_year + 1)
    return F.when(fits, F.try_to_timestamp(written, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def year_from_folder(rel_path: Column, as_of_year: int) -> Column:
    """1 January of the year in the deepest plausible folder name; null where there is none."""
    folders = F.reverse(F.slice(F.split(rel_path, "/"), F.lit(1), F.greatest(F.size(F.split(rel_path, "/")) - 1, F.lit(0))))
    years = F.transform(folders, lambda x: F.regexp_extract(x, FOLDER_YEAR, 1))
    good = F.filter(years, lambda y: (y != "") & F.try_to_number(y, F.lit("9999")).between(EARLIEST_YEAR, as_of_year + 1))
    return F.when(F.size(good) > 0, F.make_timestamp_ntz(F.get(good, 0).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def exif_time(written: Column) -> Column:
    """A camera's local time in one of three forms, with T in either case; the offset, if any, is left aside."""
    bare = F.regexp_replace(F.trim(written), "\x00", "")
    forms = ["yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]
    return F.coalesce(*[F.try_to_timestamp(F.substring(bare, 1, 19), F.lit(f)).cast("timestamp_ntz") for f in forms])


def recovered(rel_path: Column, modified: Column, mtime: Column, as_of_year: int, use_mtime: bool = False) -> Column:
    """Struct (at, source) from the best weaker source: name, modified tag, folder, then, if asked for, the file's mtime."""
    by_file = F.timestamp_seconds(mtime).cast("timestamp_ntz")
    options = [(date_from_name(base_name(rel_path), as_of_year), "filename"), (modified, "exif_modified"), (year_from_folder(rel_path, as_of_year), "folder")]
    if use_mtime:
        options.append((F.when(F.year(by_file).between(EARLIEST_YEAR, as_of_year + 1), by_file), "mtime"))
    return F.coalesce(*[F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(source).alias("source"))) for at, source in options])
