"""Records of the Web of Science's extended JSON, as the columns of FIELDS and actors.

A value that comes alone or as a list is a list here. What is missing or has
another shape is null; lines that aren't JSON give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.functions import actors as A
from lexarium.functions import text as T
from lexarium.sources.bibliographic import conform

_SUMMARY, _META, _DYNAMIC = "$.static_data.summary", "$.static_data.fullrecord_metadata", "$.dynamic_data"


def _value(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return F.when(~F.is_variant_null(x), x)


def _string(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _list(v: Column, path: str) -> Column:
    one = _value(v, path)
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def _typed(items: Column, kind: str, value: str) -> Column:
    """The value of the first item whose type is `kind`."""
    return _string(_first(F.filter(items, lambda x: _string(x, "$.type") == kind)), value)


def _text(x: Column) -> Column:
    """An item's content, or the item itself if it is a string."""
    return F.coalesce(_string(x, "$.content"), _string(x, "$"))


def cited_by(v: Column) -> Column:
    """The count of the core collection, else of all databases."""
    path = f"{_DYNAMIC}.citation_related.tc_list.silo_tc"
    items = F.try_variant_get(v, path, "array<variant>")
    of = lambda kind: _first(F.filter(items, lambda x: _string(x, "$.coll_id") == kind))
    found = F.when(items.isNull(), _value(v, path)).otherwise(F.coalesce(of("WOS"), of("WOK")))
    return F.trim(_string(found, "$.local_count")).try_cast("int")


def _orcid(name: Column) -> Column:
    ids = _list(name, '$["data-item-ids"]["data-item-id"]')
    of = lambda kind: _first(F.array_compact(F.transform(F.filter(ids, lambda x: _string(x, '$["id-type"]') == kind), lambda x: T.orcid_key(_string(x, "$.content")))))
    return F.coalesce(T.orcid_key(_string(name, "$.orcid_id")), of("PreferredORCID"), of("OtherORCID"))


def _author(name: Column) -> Column:
    filled = lambda c: F.when(c != "", c)
    shown = F.coalesce(*[filled(_string(name, f"$.{f}")) for f in ("display_name", "full_name", "wos_standard")])
    key = F.coalesce(_orcid(name), F.concat(F.lit("wos:"), filled(_string(name, "$.daisng_id"))), T.author_name_key(shown))
    return F.struct(key.alias("key"), shown.alias("name"))


def _institution(spec: Column) -> Column:
    """Of an address: its preferred organisation of the least level, else the
    first, else what the address itself names."""

    def part(o: Column, i: Column) -> Column:
        level = F.coalesce(F.try_variant_get(o, "$.level", "int"), F.lit(0))
        preferred = F.coalesce(_string(o, "$.pref") == "Y", F.lit(False))
        return F.struct((~preferred).alias("rest"), F.when(preferred, level).otherwise(0).alias("level"), i.alias("i"), _string(o, "$.content").alias("name"), _string(o, "$.ror_id").alias("ror"))

    named = F.filter(_list(spec, "$.organizations.organization"), lambda o: _string(o, "$.content") != "")
    best = F.array_min(F.transform(named, part))
    address = _string(spec, "$.full_address")
    name = F.coalesce(best["name"], A.institution_from_address(address))
    country = F.coalesce(A.country_code(_string(spec, "$.country")), A.country_from_address(address))
    return F.struct(F.coalesce(T.ror_key(best["ror"]), T.institution_name_key(name)).alias("key"), name.alias("name"), country.alias("country"))


def actors(v: Column) -> Column:
    """The struct of A.ACTORS: persons whose role is author (or who have none),
    by ORCID, else the source's own number, else name; organisations by ROR or name."""
    people = F.filter(_list(v, f"{_SUMMARY}.names.name"), lambda n: F.coalesce(_string(n, "$.role"), F.lit("author")) == "author")
    specs = F.filter(F.transform(_list(v, f"{_META}.addresses.address_name"), lambda a: _value(a, "$.address_spec")), lambda s: s.isNotNull())
    places = F.filter(F.transform(specs, _institution), lambda i: i["name"] != "")
    return A.make_actors(F.transform(people, _author), places, F.lit(None).cast("array<string>"))


def from_records(records: DataFrame, value: str = "value") -> DataFrame:
    """FIELDS and actors of a column of JSON texts, a record each."""
    v = F.col("_v")
    titles, tongues = _list(v, f"{_SUMMARY}.titles.title"), _list(v, f"{_SUMMARY}.languages.language")
    abstract = _first(_list(v, f"{_META}.abstracts.abstract"))
    lines = F.filter(F.transform(_list(abstract, "$.abstract_text.p"), lambda p: _string(p, "$")), lambda p: p != "")
    words = F.filter(F.transform(_list(v, f"{_META}.keywords.keyword"), lambda k: _string(k, "$")), lambda k: k != "")
    refs = F.filter(F.transform(_list(v, f"{_META}.references.reference"), lambda r: _string(r, "$.uid")), lambda r: r != "")
    joined = lambda a, mark: F.when(F.size(a) > 0, F.array_join(a, mark))
    parsed = records.select(F.try_parse_json(F.col(value)).alias("_v")).where(F.col("_v").isNotNull())
    return conform(
        parsed.select(
            _string(v, "$.UID").alias("id"),
            joined(lines, " ").alias("abstract"),
            _typed(titles, "source", "$.content").alias("journal"),
            _typed(titles, "item", "$.content").alias("title"),
            joined(words, "; ").alias("author_keywords"),
            _typed(_list(v, f"{_DYNAMIC}.cluster_related.identifiers.identifier"), "doi", "$.value").alias("doi"),
            F.coalesce(_typed(tongues, "primary", "$.content"), _text(_first(tongues))).alias("language"),
            _string(_first(_list(v, f"{_SUMMARY}.doctypes.doctype")), "$").alias("document_type"),
            joined(refs, "; ").alias("references"),
            _string(v, f"{_SUMMARY}.pub_info.pubyear").alias("year"),
            cited_by(v).cast("string").alias("cited_by"),
            actors(v).alias("actors"),
        )
    )


def read_wos_json(spark: SparkSession, path: str) -> DataFrame:
    """Files of one record a line."""
    return from_records(spark.read.text(path))
