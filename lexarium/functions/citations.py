"""Parts of citations, authors, journals, titles and document types, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexarium.functions import text as T

#: ASCII marks.
_MARKS = r"[!-/:-@\[-`{-~]"


def lastname(c: Column) -> Column:
    """Letters a-z of a name without its accents."""
    return F.regexp_replace(T.plain(c), "[^a-z]", "")


def first_author(c: Column) -> Column:
    """The first author's last name; null if the field is empty or begins with a comma."""
    last = F.split(F.trim(F.split(c, ";")[0]), r"[,\s]+")[0]
    return F.when(last != "", lastname(last))


def journal(c: Column) -> Column:
    """Lower case without accents; marks become blanks, one each."""
    return F.trim(F.regexp_replace(T.plain(c), "[^a-z0-9 ]", " "))


def citation(c: Column) -> Column:
    """(lastname, year, journal) of `Author, Year, Journal, ...`; null if the
    first part has no word or the second isn't a year of four digits."""
    parts = F.transform(F.split(c, ","), lambda p: F.trim(p))
    year = F.try_element_at(parts, F.lit(2))
    whole = F.struct(lastname(F.split(parts[0], r"\s+")[0]).alias("lastname"), year.try_cast("int").alias("year"), F.try_element_at(parts, F.lit(3)).alias("journal"))
    return F.when((parts[0] != "") & year.rlike(r"^\d{4}$"), whole)


def cleaned_title(c: Column) -> Column:
    """Words of letters and apostrophes in lower case; all else is a blank."""
    low = F.replace(F.lower(c), F.lit("’"), F.lit("'"))
    return T.squeeze(F.regexp_replace(low, "[^a-z']+", " "))


def is_review(kind: Column, title: Column, detect: str = "both") -> Column:
    """Whether the type has a part `review` ("type"), the title names a review that
    is none of peers ("title"), or either. Reports of referees never are."""
    parts = F.transform(F.split(F.lower(F.coalesce(kind, F.lit(""))), ";"), lambda p: F.trim(p))
    low = F.lower(F.coalesce(title, F.lit("")))
    by_type = F.array_contains(parts, "review")
    by_title = F.contains(low, F.lit("review")) & ~low.rlike("peer[- ]review")
    hit = {"type": by_type, "title": by_title, "both": by_type | by_title}[detect]
    return hit & ~F.array_contains(parts, "peer-review") & ~F.array_contains(parts, "peer review")


def is_unkeyed(token: Column) -> Column:
    """Whether a reference isn't the id of a work."""
    return T.openalex_id(token).isNull()


def is_bridgeable(token: Column) -> Column:
    """Whether a reference that is no id is or has a DOI."""
    return is_unkeyed(token) & F.coalesce(T.embedded_doi(token), T.normalise_doi(token)).isNotNull()


def file_stem(doi: Column) -> Column:
    """A DOI as a file's name."""
    return F.regexp_replace(doi, r"(?U)[^\w\-]", "_")


def short_label(c: Column, most: int = 42) -> Column:
    """At most `most` characters, the last an ellipsis if any were cut."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most - 1), r"\s+$", ""), F.lit("…")))


def combine_hyphens(c: Column) -> Column:
    return T.squeeze(F.replace(c, F.lit("-"), F.lit("")))


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, _MARKS, "")
