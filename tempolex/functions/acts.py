"""What titles and headers of Acts say: years, numbers, repeal notes, initials, unique keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Two-digit years up to the pivot belong to 20xx; no repeal lies before the first year; the shortest key.
PIVOT, FIRST_YEAR, SHORTEST_KEY = 40, 1800, 3

_EFFECT = r"(?i)w\.?\s?e\.?\s?f\.?\s*(\d{1,2})[-./](\d{1,2})[-./](\d{2,4})"
_YEAR = r"(?<!\d)(\d{4})(?!\d)"


def four_digit(year: Column) -> Column:
    """Of a year written with two or four digits."""
    y = year.try_cast("int")
    return F.when(y >= 100, y).when(y <= PIVOT, y + 2000).otherwise(y + 1900)


def title_year(title: Column) -> Column:
    """The last year a title names, null without one."""
    years = F.regexp_extract_all(title, F.lit(_YEAR))
    return F.when(F.size(years) > 0, F.element_at(years, -1).cast("int"))


def act_number(text: Column) -> Column:
    """The Roman or Arabic number in 'Act XXXVII of 1947', '' without one."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b(?:act|ordinance|order|regulation|ord\.)\s+(?:no\.?\s*)?([IVXLCDM]+|\d+)\s+of\s+\d{2,4}", 1)


def repealed_on(note: Column, last_year: int) -> list[Column]:
    """(repealed_on, exact): the day of a 'w.e.f. d-m-y', else 1 January of the latest plausible year the note names, else null.

    A day that does not exist falls through to the year. Two-digit years count behind 'of'.
    """
    day = F.try_to_date(F.concat_ws("-", four_digit(F.regexp_extract(note, _EFFECT, 3)).cast("string"), F.lpad(F.regexp_extract(note, _EFFECT, 2), 2, "0"), F.lpad(F.regexp_extract(note, _EFFECT, 1), 2, "0")), "yyyy-MM-dd")
    years = F.concat(F.regexp_extract_all(note, F.lit(_YEAR)), F.regexp_extract_all(note, F.lit(r"(?i)\bof\s+(\d{2})(?!\d)")))
    plausible = F.filter(F.transform(years, four_digit), lambda y: y.between(FIRST_YEAR, last_year))
    first_of = F.when(F.size(plausible) > 0, F.try_to_date(F.concat(F.array_max(plausible).cast("string"), F.lit("-01-01")), "yyyy-MM-dd"))
    return [F.coalesce(day, first_of).alias("repealed_on"), day.isNotNull().alias("exact")]


def ended(start: Column, end: Column, exact: Column) -> list[Column]:
    """(ends_on, exact): an end not after the start moves to the day behind it and is not exact."""
    late = end <= start
    return [F.when(late, F.date_add(start, 1)).otherwise(end).alias("ends_on"), (exact & ~F.coalesce(late, F.lit(False))).alias("end_exact")]


# Names of the months, the reach of a date that is not a line of its own.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
HEADER = 12_000


def assent_date(text: Column) -> Column:
    """The first date in brackets that is a line of its own, '[16th August, 1997]', else the first within the header of HEADER characters; null without one.

    Only days that exist count; months are written in full.
    """
    date = r"\[\s*(\d{1,2}\s*(?:st|nd|rd|th)?\s+[A-Za-z]{3,12}\s*,?\s*\d{4})\s*\]"
    numbers = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, str(i))])

    def days(found: Column) -> Column:
        part = lambda d, k: F.regexp_extract(d, r"^(\d{1,2})\s*(?:st|nd|rd|th)?\s+([A-Za-z]+)\s*,?\s*(\d{4})$", k)
        made = F.transform(found, lambda d: F.try_to_date(F.concat_ws("-", part(d, 3), F.lpad(F.element_at(numbers, F.lower(part(d, 2))), 2, "0"), F.lpad(part(d, 1), 2, "0")), "yyyy-MM-dd"))
        return F.filter(made, lambda d: d.isNotNull())

    lines = days(F.regexp_extract_all(text, F.lit(rf"(?m)^[ \t]*{date}[ \t]*$"), F.lit(1)))
    header = days(F.regexp_extract_all(F.substring(text, 1, HEADER), F.lit(date), F.lit(1)))
    return F.coalesce(F.get(lines, 0), F.get(header, 0))


def without_annotations(title: Column) -> Column:
    """A title without bracketed notes that speak of repeal; what an opening bracket without its partner begins goes too, and lone closing ones."""
    bare = F.regexp_replace(title, r"(?i)\s*[\[(][^\[\]()]*(?:repealed|w\.?e\.?f|omitted)[^\[\]()]*[\])]", "")
    open_left = F.regexp_replace(bare, r"\([^()]*$", "")
    depth = F.aggregate(
        F.split(open_left, ""), F.struct(F.lit(0).alias("open"), F.lit("").alias("out")),
        lambda s, c: F.struct(
            (s["open"] + F.when(c == "(", 1).when((c == ")") & (s["open"] > 0), -1).otherwise(0)).alias("open"),
            F.concat(s["out"], F.when((c == ")") & (s["open"] == 0), "").otherwise(c)).alias("out"),
        ),
    )["out"]
    return F.regexp_replace(depth, r"^[\])\s,.;]+|[\[(\s,.;]+$", "")


def initials(title: Column) -> Column:
    """First letters of the words of a title that are no small words, upper case."""
    skipped = F.array(*[F.lit(w) for w in ("of", "the", "and", "for", "to", "in", "on", "a", "an")])
    found = F.regexp_extract_all(F.regexp_replace(title, r",?\s*\d{4}$", ""), F.lit(r"([A-Za-z][\w'-]*)"))
    return F.upper(F.array_join(F.transform(F.filter(found, lambda w: ~F.array_contains(skipped, F.lower(w))), lambda w: F.substring(w, 1, 1)), ""))


def unique_keys(acts: DataFrame, title: str) -> DataFrame:
    """Adds act_key: the initials, with the year where several Acts share them, with a counter where those share the year too.

    Counters follow the order of titles, of equal titles that of their other columns.
    """
    base = F.when(F.length(initials(F.col(title))) >= SHORTEST_KEY, initials(F.col(title))).otherwise(F.rpad(initials(F.col(title)), SHORTEST_KEY, "X"))
    one = acts.withColumns({"_base": base, "_year": F.coalesce(title_year(F.col(title)).cast("string"), F.lit(""))})
    alone, same = Window.partitionBy("_base"), Window.partitionBy("_base", "_year").orderBy(title, *sorted(c for c in acts.columns if c != title))
    counted = one.withColumns({"_of": F.count("*").over(alone), "_n": F.row_number().over(same)})
    key = F.when(F.col("_of") == 1, F.col("_base")).otherwise(F.concat("_base", "_year", F.when(F.col("_n") > 1, F.concat(F.lit("_"), F.col("_n"))).otherwise("")))
    return counted.withColumn("act_key", key).drop("_base", "_year", "_of", "_n")
