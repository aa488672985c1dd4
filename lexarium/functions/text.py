"""Scalar text functions as Column builders; all stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bases() -> tuple[str, str]:
    """Letters that a compatibility decomposition makes one ASCII character (and
    marks), and those characters."""
    found = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00))}
    single = {c: b for c, b in found.items() if len(b) == 1 and b != " "}
    return "".join(single), "".join(single.values())


ACCENTED, PLAIN = _bases()

#: Words whose absence marks a text as no prose.
FUNCTION_WORDS = """
    the a an is are was were be been being
    have has had do does did this that these
    those we our they their it its of in on
    at by for with from to and or but not
    as than then which while between among however
    thus therefore moreover furthermore where when
""".split()

#: Verbs that abstracts have.
VERB_CUES = """
    show shows showed present presents presented
    propose proposes proposed demonstrate demonstrates
    demonstrated find finds found describe describes
    described report reports reported investigate
    investigates investigated study studies studied
    analyze analyzes analyzed analyse analyses analysed
    develop develops developed examine examines examined
    suggest suggests suggested provide provides provided
    use uses used apply applies applied
""".split()

#: Whole texts that stand for a missing one.
KNOWN_GARBAGE = (
    "", "international audience", "no abstract available", "no abstract", "abstract not available",
    "abstract not provided", "abstract unavailable", "not available", "n/a", "na", "none", "null", "unknown", "tbd",
    "to be determined", "see above", "see text", "see article", "not applicable", "summary not available",
)


_AROUND = r"[ .,;:!?()\[\]{}\"'\u00a0\t\n\r]+"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_doi(c: Column) -> Column:
    """The longest prefix of characters a DOI may have, without final marks."""
    return F.regexp_replace(F.regexp_extract(c, r"^[A-Za-z0-9._;()/:<>#+\-]*", 0), r"[.,;:]+$", "")


def normalise_doi(c: Column) -> Column:
    """Bare lower-case DOI, null if there is none."""
    d = F.regexp_replace(F.lower(F.trim(c)), r"^https?://(dx\.)?doi\.org/", "")
    return F.when(d.startswith("10."), F.regexp_replace(d, r"[.,;]+$", ""))


def embedded_doi(c: Column) -> Column:
    """A DOI inside a citation: of a doi.org address, else after a DOI label."""
    url = F.regexp_extract(F.lower(c), r"doi\.org/(10\.\d{4,9}/[^\s;]+)", 1)
    label = F.regexp_extract(F.lower(c), r"\bdoi:?\s+\[?(10\.\d{4,9}/[^\s;\]]+)", 1)
    found = F.regexp_replace(F.when(url != "", url).otherwise(label), r"[.,;]+$", "")
    return F.when(found != "", found)


def openalex_id(c: Column) -> Column:
    w = F.upper(F.regexp_extract(c, r"^(?:https?://openalex\.org/)?([Ww]\d+)$", 1))
    return F.when(w != "", w)


def plain(c: Column) -> Column:
    """Lower case in ASCII: letters without their accents, other characters gone
    without a blank."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"[^\x00-\x7F]+", "")


def norm_words(c: Column) -> Column:
    """Words of a-z and 0-9, joined by one blank."""
    return F.trim(F.regexp_replace(plain(c), r"[^a-z0-9]+", " "))


def canonical_title(c: Column) -> Column:
    return norm_words(c)


def title_key(c: Column, size: int = 90) -> Column:
    k = F.substring(F.regexp_replace(F.lower(c), r"[^a-z0-9]", ""), 1, size)
    return F.when(k != "", k)


def split_references(c: Column) -> Column:
    """Parts at `;` before white space or the end; a DOI's own `;` stays."""
    parts = F.transform(F.split(c, r";(?=\s|$)"), lambda x: F.trim(x))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def truncate(c: Column, most: int) -> Column:
    """At most `most` characters: up to the last sentence end if that keeps more
    than three quarters, else to the last blank if that does, else cut hard."""
    head, floor = F.substring(c, 1, most), int(0.75 * most)
    end = F.length(F.regexp_extract(head, r"^(?s)(.*[.!?])", 1))
    blank = F.length(F.regexp_extract(head, r"^(?s)(.*) ", 1))
    cut = F.when(end > floor, F.substring(c, F.lit(1), end)).when(blank > floor, F.substring(c, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.regexp_replace(cut, r"\s+$", ""))


def words(c: Column) -> Column:
    """Lower-case runs of letters."""
    return F.filter(F.split(F.lower(c), r"[^a-zà-öø-ÿß]+"), lambda x: x != "")


def implausible_signals(c: Column) -> Column:
    """How many signs a text gives of not being prose: no function word, no verb
    of abstracts, a very diverse vocabulary, no sentence mark."""
    found = F.transform(F.regexp_extract_all(c, F.lit("[a-zA-Z][a-zA-Z'-]*"), F.lit(0)), F.lower)
    has = lambda w, known: F.arrays_overlap(w, F.array(*map(F.lit, known)))

    def signs(w: Column) -> Column:
        diverse = (F.size(w) >= 6) & (F.size(F.array_distinct(w)) > 0.85 * F.size(w))
        return (~has(w, FUNCTION_WORDS)).cast("int") + (~has(w, VERB_CUES)).cast("int") + diverse.cast("int")

    # the words are made once, as the one element of an array
    return F.element_at(F.transform(F.array(found), signs), 1) + (~c.rlike("[.!?]")).cast("int")


def plausible_abstract(c: Column, least: int = 2, garbage: tuple[str, ...] = ()) -> Column:
    """Whether a text reads like an abstract: not missing, no known phrase that
    stands for a missing one (or one of `garbage`), fewer than `least` signs."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^" + _AROUND + "|" + _AROUND + "$", ""))
    known = bare.isin(*KNOWN_GARBAGE, *(g.lower() for g in garbage))
    return F.coalesce(c.rlike(r"\S") & ~known & (implausible_signals(c) < least), F.lit(False))


def heuristic_tokens(c: Column) -> Column:
    """Tokens of prose at 3.7 characters each, with 12 for the frame."""
    return (F.floor(F.length(c) / 3.7) + 12).cast("bigint")


def person_norm(c: Column, initials: bool = True) -> Column:
    """Surname and first initial (or all first names) of `Last, First`, `First
    Last` or `Last F.M.`; null if there is no surname."""
    # each step is computed once, as the one element of an array
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    joined = lambda x: F.array_join(x, " ")

    def halves(x: Column) -> Column:
        name, parts = x["name"], x["parts"]
        n, tail, comma = F.size(parts), F.element_at(parts, -1), F.instr(name, ",") > 0
        short = (n > 1) & tail.rlike(r"^(?:[A-Z]\.?-?){1,4}$")
        before = joined(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))))
        last = F.when(comma, F.substring_index(name, ",", 1)).when(short, before).otherwise(tail)
        first = F.when(comma, F.regexp_extract(name, r"(?s)^[^,]*,(.*)$", 1)).when(short, tail).otherwise(before)
        return F.struct(norm_words(last).alias("last"), norm_words(first).alias("first"))

    def whole(x: Column) -> Column:
        given = F.substring(x["first"], 1, 1) if initials else x["first"]
        return F.when(x["last"] != "", F.when(x["first"] == "", x["last"]).otherwise(F.concat(x["last"], F.lit(" "), given)))

    name = F.trim(F.regexp_replace(c, r"(?i)\(\s*corresponding author\s*\)", ""))
    return once(once(once(name, lambda n: F.struct(n.alias("name"), F.split(n, r"\s+").alias("parts"))), halves), whole)


def institution_norm(c: Column) -> Column:
    """An institution's name without accents, acronyms in brackets and a leading
    article; `&` is `and`. Null if nothing is left."""
    text = F.regexp_replace(F.replace(F.replace(c, F.lit("\\&"), F.lit("&")), F.lit("&"), F.lit(" and ")), r"\([^)]*\)", " ")
    text = F.regexp_replace(norm_words(text), r"^the\s+", "")
    return F.when(text != "", text)


def _bare(c: Column, host: str) -> Column:
    return F.regexp_replace(F.trim(c), f"(?i)^https?://{host}/", "")


def orcid_key(c: Column) -> Column:
    """`orcid:` and the identifier, null if it has not its form."""
    bare = F.upper(_bare(c, "orcid[.]org"))
    return F.when(bare.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$"), F.concat(F.lit("orcid:"), bare))


def ror_key(c: Column) -> Column:
    bare = F.lower(_bare(c, "ror[.]org"))
    return F.when(bare != "", F.concat(F.lit("ror:"), bare))


def openalex_key(c: Column) -> Column:
    bare = _bare(c, "openalex[.]org")
    return F.when(bare != "", F.concat(F.lit("openalex:"), bare))


def author_name_key(c: Column) -> Column:
    return F.concat(F.lit("name:"), person_norm(c))


def institution_name_key(c: Column) -> Column:
    return F.concat(F.lit("name:"), institution_norm(c))


def html_text(c: Column) -> Column:
    """Visible text: no scripts, styles or tags."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    return squeeze(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))


def abstract_of_index(m: Column) -> Column:
    """Text of an inverted index, map<word, array<position>>."""
    pairs = F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
