"""JSON response pages kept as files: ``{"lastRecordID": .., "partOrderLines": [..]}``.

Pages lie below ``orderStatus=<status>/fromDate=<day>/``, so the fetch windows
select directories. All pages are read in one scan; there is no loop over pages. A page
may also say after which record it was asked for, ``"afterRecordID"``, empty for the first
one; ``chain_faults`` then finds what is missing between pages.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lineforge.operators.columns import flatten_structs
from lineforge.operators.increments import DAYS_BACK, within_windows
from lineforge.session import writing

LINES = "partOrderLines"
CURSOR = "lastRecordID"
ASKED = "afterRecordID"
FAULT = "fault"
HARMLESS = "repeated"
BAD_PAGE = "_corrupt_record"
UNKNOWN = "otherFields"
STATUS_DIRECTORY = "orderStatus"
DAY_DIRECTORY = "fromDate"
PAGE_TEXT = "value"
TEXTS = "texts"
DAMAGED = "damaged"

# What a page's text is cut into: strings, which may be cut off at the page's end, brackets, and all between.
_PIECE = r'"(?:[^"\\]++|\\[\s\S])*+(?:"|\\?\Z)|[{}\[\]]|[^"{}\[\]]++'


def read_pages(
    spark: SparkSession,
    path: str,
    as_of: date | None = None,
    days_back: int = DAYS_BACK,
    multi_line: bool = False,
) -> DataFrame:
    """Page texts with their status and day; with ``as_of`` only the fetch windows' directories.

    Pages stay text, so nothing the source adds is lost to a schema. One page per line is
    the splittable form; ``multi_line`` reads files holding one page each.
    """
    schema = T.StructType(
        [
            T.StructField(PAGE_TEXT, T.StringType()),
            T.StructField(STATUS_DIRECTORY, T.StringType()),
            T.StructField(DAY_DIRECTORY, T.DateType()),
        ]
    )
    pages = spark.read.schema(schema).text(path, wholetext=multi_line)
    pages = pages.filter(F.length(F.btrim(PAGE_TEXT)) > 0)
    if as_of is None:
        return pages
    return pages.filter(within_windows(F.col(DAY_DIRECTORY), as_of, days_back))


def _cutter():
    """A function from a page's text to its whole line objects, see ``whole_lines``.

    Made anew for each use, so that it is sent to the tasks by its code.
    """
    pattern, name = _PIECE, f'"{LINES}"'

    def cut(text: str | None) -> list[str] | None:
        if text is None:
            return None
        found, seen, depth, begin = [], 0, -1, 0  # seen: 1 after the array's name, 2 after its colon
        for match in re.finditer(pattern, text):
            piece = match.group()
            if depth < 0:
                if seen == 2 and piece == "[":
                    depth = 0
                else:
                    seen = 1 if piece == name else 2 if seen == 1 and piece.strip(" ") == ":" else 0
            elif piece in ("{", "["):
                if depth == 0:
                    begin = match.start()
                depth += 1
            elif piece in ("}", "]"):
                depth -= 1
                if depth < 0:  # the array's end; no other is entered
                    break
                if depth == 0 and piece == "}" and text[begin] == "{":
                    found.append(text[begin : match.end()])
        return found

    return cut


def whole_lines(text: Column) -> Column:
    """The line objects of a page's text that are whole, as an array of JSON texts.

    One pass over the text's pieces keeps the nesting depth, strings being pieces of their
    own. The array after the first ``"partOrderLines":`` is where lines begin; an object that
    opens at that array's own level is a line if it closes there, whatever it nests, and can
    be read. So neither a line that breaks off nor an object inside one counts as a line.
    The pass is a small function in Python; null texts cost nothing there. A character that
    the page's end cuts in two becomes the replacement character.
    """
    found = F.udf(_cutter(), "array<string>", useArrow=True)(F.make_valid_utf8(text))
    return F.filter(found, lambda t: F.get_json_object(t, "$").isNotNull())


def _legible(name: str) -> Column:
    """A text field of a damaged page, null if it is not there or cut off."""
    found = F.regexp_extract_all(PAGE_TEXT, F.lit(rf'"{name}"\s*:\s*"([^"]*)"'), F.lit(1))
    return F.get(found, F.lit(0))


def cut_pages(pages: DataFrame) -> DataFrame:
    """Pages with ``texts``, the JSON text of each line, their cursors, and whether they are damaged.

    Of a damaged page the whole lines are taken, see ``whole_lines``, and its text is kept.
    What follows may read this frame, once written, in place of the pages.
    """
    return with_whole_lines(cut_sound_pages(pages))


def with_whole_lines(cut: DataFrame) -> DataFrame:
    """What ``cut_sound_pages`` made, with the whole lines of damaged pages."""
    damaged = F.when(F.col(DAMAGED), F.col(PAGE_TEXT))
    return cut.withColumn(TEXTS, F.when(F.col(DAMAGED), whole_lines(damaged)).otherwise(F.col(TEXTS)))


def cut_sound_pages(pages: DataFrame) -> DataFrame:
    """The same, but ``texts`` of damaged pages are null; no Python runs for it."""
    outer = f"{ASKED} string, {CURSOR} string, {LINES} array<string>, {BAD_PAGE} string"
    page = F.from_json(PAGE_TEXT, outer, {"columnNameOfCorruptRecord": BAD_PAGE})
    sound = F.col("__page").isNotNull() & F.col(f"__page.{BAD_PAGE}").isNull()
    cut = pages.withColumn("__page", page).withColumn(DAMAGED, ~sound)
    return cut.select(
        STATUS_DIRECTORY,
        DAY_DIRECTORY,
        DAMAGED,
        F.when(F.col(DAMAGED), F.col(PAGE_TEXT)).alias(PAGE_TEXT),
        *(F.when(F.col(DAMAGED), _legible(c)).otherwise(F.col(f"__page.{c}")).alias(c) for c in (ASKED, CURSOR)),
        F.when(~F.col(DAMAGED), F.col(f"__page.{LINES}")).alias(TEXTS),
    )


def _cut(pages: DataFrame) -> DataFrame:
    return pages if TEXTS in pages.columns else cut_pages(pages)


def page_lines(pages: DataFrame, line: T.StructType) -> DataFrame:
    """One row per order line, nested objects flattened, with status and day.

    ``pages`` are page texts or what ``cut_pages`` made of them, here and below. Fields may
    come in any order, a missing field is null. Fields that ``line`` does not
    name are kept in the map ``UNKNOWN`` with their values as text, objects as JSON.
    """
    lines = _cut(pages).select(F.explode(TEXTS).alias("text"), STATUS_DIRECTORY, DAY_DIRECTORY)
    fields = F.from_json("text", "map<string,string>")
    unknown = F.map_filter(fields, lambda name, _: ~name.isin(*line.names))
    rows = lines.select(
        F.from_json("text", line).alias("line"),
        F.when(F.size(unknown) > 0, unknown).alias(UNKNOWN),
        STATUS_DIRECTORY,
        DAY_DIRECTORY,
    )
    return flatten_structs(rows.select("line.*", UNKNOWN, STATUS_DIRECTORY, DAY_DIRECTORY))


def bad_pages(pages: DataFrame) -> DataFrame:
    """Damaged pages, as text, and how many whole lines were taken from each."""
    legible = F.coalesce(F.size(TEXTS), F.lit(0))
    return (
        _cut(pages)
        .filter(DAMAGED)
        .select(
            STATUS_DIRECTORY,
            DAY_DIRECTORY,
            F.col(PAGE_TEXT).alias(BAD_PAGE),
            F.greatest(legible, F.lit(0)).alias("legible_lines"),
        )
    )


def page_counts(pages: DataFrame) -> DataFrame:
    """Number of pages and of damaged ones."""
    return _cut(pages).agg(F.count("*").alias("n_pages"), F.count_if(F.col(DAMAGED)).alias("n_bad"))


def chain_faults(pages: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Where the pages of a status and day don't make one chain: (status, day, fault, cursor, n_pages).

    A page is asked for with a cursor, empty for the first one, and gives the cursor of the
    next; the last page gives none, or the one it was asked with. Faults, and the cursor
    they are reported at:

    * ``missing start``: no page was asked for with the empty cursor
    * ``missing before``: pages were asked for with this cursor, which no page gives
    * ``missing after``: pages give this cursor, with which no page was asked for
    * ``fork``: pages asked for with this cursor give different ones
    * ``merge``: pages asked for with different cursors give this one
    * ``broken``: damaged pages asked for with this cursor, their own being lost
    * ``repeated``: the same link more than once, which harms nothing
    * ``unlinked``: pages that don't say what they were asked for with; the cursor is null

    A fetch begins at the empty cursor, so whatever it lost or got twice shows as one of
    them. ``expected`` names statuses and days that must have pages: without any they are
    a missing start. All is counted by cursor, pages are never put in order, and no day's
    pages meet in one task.
    """
    group = (STATUS_DIRECTORY, DAY_DIRECTORY)
    last = F.when(F.col(DAMAGED) & F.col(CURSOR).isNull(), None).when(
        F.col(CURSOR).isNull() | (F.col(CURSOR) == F.col(ASKED)), ""
    )
    links = (
        _cut(pages)
        .select(*group, F.col(ASKED).alias("asked"), last.otherwise(F.col(CURSOR)).alias("given"))
        .groupBy(*group, "asked", "given")
        .agg(F.count("*").alias("n"))
    )

    def end(role: str, cursor: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(role).alias("role"), cursor.alias("cursor")))

    linked = F.col("asked").isNotNull()
    ends = F.array(
        end("asked", F.col("asked"), F.lit(True)),
        end("given", F.col("given"), linked & (F.col("given") != "")),
        end("day", F.lit(""), linked),
    )
    seen = links.withColumn("end", F.explode(F.array_compact(ends))).select(*group, "end.*", "given", "n")
    if expected is not None:
        days = expected.select(*(F.col(c) for c in group), F.lit("day").alias("role"), F.lit("").alias("cursor"))
        seen = seen.unionByName(days.distinct(), allowMissingColumns=True)

    asked, gives = F.col("role") == "asked", F.col("role") == "given"
    whole = asked & F.col("given").isNotNull()

    def pages_of(rows: Column) -> Column:
        return F.coalesce(F.sum(F.when(rows, F.col("n"))), F.lit(0))

    counted = seen.groupBy(*group, "cursor").agg(
        F.count_if(whole).alias("next"),
        F.count_if(gives).alias("before"),
        pages_of(asked).alias("n_asked"),
        pages_of(gives).alias("n_given"),
        pages_of(asked & F.col("given").isNull()).alias("n_broken"),
        pages_of(whole & (F.col("n") > 1)).alias("n_repeated"),
    )
    first, unlinked = F.col("cursor") == "", F.col("cursor").isNull()
    found = {
        "missing start": (first & (F.col("n_asked") == 0), F.lit(0)),
        "missing before": (~first & (F.col("n_asked") > 0) & (F.col("n_given") == 0), F.col("n_asked")),
        "missing after": ((F.col("n_given") > 0) & (F.col("n_asked") == 0), F.col("n_given")),
        "fork": (~unlinked & (F.col("next") > 1), F.col("n_asked")),
        "merge": (F.col("before") > 1, F.col("n_given")),
        "broken": (~unlinked & (F.col("n_broken") > 0), F.col("n_broken")),
        HARMLESS: (~unlinked & (F.col("n_repeated") > 0), F.col("n_repeated")),
        "unlinked": (unlinked, F.col("n_asked")),
    }
    faults = F.array_compact(
        F.array(
            *(
                F.when(when, F.struct(F.lit(name).alias(FAULT), n.cast("bigint").alias("n_pages")))
                for name, (when, n) in found.items()
            )
        )
    )
    return counted.select(*group, F.col("cursor").alias(CURSOR), F.inline(faults)).select(
        *group, FAULT, CURSOR, "n_pages"
    )


def write_pages(lines: DataFrame, path: str, page: str, linked: bool = False) -> None:
    """Write lines as page files; ``page`` names the column with the page number.

    ``lines`` also holds the two directory columns. The caller numbers pages so that
    each stays small, as a page is one JSON text. With ``linked`` a page says after which
    it was asked for, and the last of a status and day gives no cursor. Files are compressed
    as a whole, and so not split when they are read: a task should write few lines.
    """
    outer = (STATUS_DIRECTORY, DAY_DIRECTORY, page)
    fields = [c for c in lines.columns if c not in outer]
    pages = lines.groupBy(*outer).agg(F.collect_list(F.struct(*fields)).alias(LINES))
    cursor = F.col(page).cast("string")
    if linked:
        order = Window.partitionBy(*outer[:2]).orderBy(page)
        before = F.coalesce(F.lag(cursor).over(order), F.lit(""))
        cursor = F.when(F.lead(page).over(order).isNull(), "").otherwise(cursor)
        pages = pages.withColumns({ASKED: before, CURSOR: cursor})
    else:
        pages = pages.withColumn(CURSOR, cursor)
    with writing(lines.sparkSession):
        (
            pages.drop(page)
            .write.partitionBy(STATUS_DIRECTORY, DAY_DIRECTORY)
            .mode("overwrite")
            .json(path, compression="gzip")
        )
