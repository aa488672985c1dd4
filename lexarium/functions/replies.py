"""JSON in a language model's answer, and the prompts' texts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings of JSON, the last of which may run into the mark that ends the text.
_STRING = r'"[^"\\\x00]*+(?:\\[^\x00][^"\\\x00]*+)*+(?:"|\\?(\x00))'


def unclosed(text: Column) -> Column:
    """Whether a text ends inside a JSON structure; marks in strings don't count.
    One pass, however long the text and whatever it quotes."""
    marked = F.concat(F.replace(text, F.lit("\0"), F.lit("")), F.lit("\0"))
    bare = F.regexp_replace(marked, _STRING, "$1$1")  # an open string doubles the mark
    begun, ended = (F.length(F.regexp_replace(bare, marks, "")) for marks in (r"[^{\[]", r"[^}\]]"))
    return (begun > 0) & ((begun > ended) | bare.endswith("\0\0"))


def _span(text: Column) -> Column:
    """Places of the first opening bracket and the last closing one of its kind."""

    def of(begin: str, end: str) -> Column:
        first, last = F.instr(text, begin), F.length(text) - F.instr(F.reverse(text), end) + 1
        return F.when((first > 0) & F.contains(text, F.lit(end)) & (last > first), F.struct(first.alias("first"), last.alias("last")))

    return F.array_min(F.array(of("{", "}"), of("[", "]")))


def payload(text: Column) -> Column:
    """The JSON of an answer: the whole text, else what stands from its first
    bracket to the last of its kind; null if neither can be read."""
    at = _span(text)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.substr(text, at["first"], at["last"] - at["first"] + 1)))


def status(text: Column) -> Column:
    """ok, truncated (ask again with more room), malformed, or none."""
    return F.when(payload(text).isNotNull(), "ok").when(unclosed(text), "truncated").when(_span(text).isNotNull(), "malformed").otherwise("none")


def _score(item: Column) -> Column:
    x = F.try_variant_get(item, "$.evaluation", "variant")
    kind, text = F.schema_of_variant(x), F.try_variant_get(x, "$", "string")
    whole = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("int"))
    return F.when(kind == "STRING", whole).when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("int")).otherwise(F.try_variant_get(x, "$", "double").try_cast("int"))


def evaluations(text: Column) -> Column:
    """(evaluation, reasoning) of each item of an answer: a list, the list under
    `evaluations`, or one object. A score that is no whole number is null, never a
    default; a missing reasoning is empty. Null if there is no list and no object."""
    v = payload(text)
    whole = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v))
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.evaluations", "array<variant>"), whole)
    return F.transform(items, lambda x: F.struct(_score(x).alias("evaluation"), F.coalesce(F.try_variant_get(x, "$.reasoning", "string"), F.lit("")).alias("reasoning")))


def complete(items: Column, n: int | Column) -> Column:
    """Whether there are n items, each with a score."""
    return F.coalesce((F.size(items) == n) & F.forall(items, lambda x: x["evaluation"].isNotNull()), F.lit(False))


def prompt_text(*names: str) -> Column:
    """`name: value` of each column that isn't null, a line each."""
    return F.concat_ws("\n", *[F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}: "), F.col(n).cast("string"))) for n in names])


def reference_text(title: Column, venue: Column, abstract: Column) -> Column:
    """What is known of a reference, joined by `. `."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.concat_ws(". ", filled(title), filled(venue), filled(abstract))
