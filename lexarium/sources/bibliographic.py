"""Readers of bibliographic exports; all give the columns of FIELDS.

A file of tagged records is read whole, one row a file, and split into records
and fields by expressions, so files are parsed in parallel. Null where a record
has no such field; numbers that can't be read are null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from lexarium.functions import actors as A
from lexarium.functions import text as T

FIELDS = ["id", "author", "affiliations", "abstract", "journal", "title", "author_keywords", "doi", "language", "document_type", "references", "year", "cited_by"]
NUMERIC = ("year", "cited_by")

# Field labels of the export formats.
WOS = {"unique-id": "id", "author": "author", "affiliation": "affiliations", "abstract": "abstract", "journal": "journal", "title": "title", "keywords": "author_keywords", "doi": "doi", "language": "language", "type": "document_type", "cited-references": "references", "year": "year", "times-cited": "cited_by"}
MEDLINE = {"PMID": "id", "AU": "author", "AD": "affiliations", "AB": "abstract", "JT": "journal", "TI": "title", "OT": "author_keywords", "LID": "doi", "LA": "language", "PT": "document_type", "DP": "year"}
SCOPUS = {"eid": "id", "authors": "author", "affiliations": "affiliations", "abstract": "abstract", "source title": "journal", "title": "title", "author keywords": "author_keywords", "doi": "doi", "language of original document": "language", "document type": "document_type", "references": "references", "year": "year", "cited by": "cited_by"}
PATTERNS = {"wos": "*.bib", "scopus": "*.csv", "pubmed": "*.{nbib,txt}"}

# Language codes of MEDLINE records.
LANGUAGES = {
    "afr": "Afrikaans", "alb": "Albanian", "amh": "Amharic", "ara": "Arabic", "arm": "Armenian", "aze": "Azerbaijani", "bos": "Bosnian",
    "bul": "Bulgarian", "cat": "Catalan", "chi": "Chinese", "cze": "Czech", "dan": "Danish", "dut": "Dutch", "eng": "English", "epo": "Esperanto",
    "est": "Estonian", "fin": "Finnish", "fre": "French", "geo": "Georgian", "ger": "German", "gla": "Scottish Gaelic", "gre": "Greek, Modern",
    "heb": "Hebrew", "hin": "Hindi", "hrv": "Croatian", "hun": "Hungarian", "ice": "Icelandic", "ind": "Indonesian", "ita": "Italian",
    "jpn": "Japanese", "kin": "Kinyarwanda", "kor": "Korean", "lat": "Latin", "lav": "Latvian", "lit": "Lithuanian", "mac": "Macedonian",
    "mal": "Malayalam", "mao": "Maori", "may": "Malay", "mul": "Multiple languages", "nor": "Norwegian", "per": "Persian, Iranian",
    "pol": "Polish", "por": "Portuguese", "pus": "Pushto", "rum": "Romanian, Rumanian, Moldovan", "rus": "Russian", "san": "Sanskrit",
    "slo": "Slovak", "slv": "Slovenian", "spa": "Spanish", "srp": "Serbian", "swe": "Swedish", "tha": "Thai", "tur": "Turkish",
    "ukr": "Ukrainian", "und": "Undetermined", "vie": "Vietnamese", "wel": "Welsh",
}


def _records(spark: SparkSession, path: str, pattern: str, start: str) -> DataFrame:
    """file, pos, record: what stands from one line that begins with `start` to the next."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    whole = F.regexp_replace("value", r"\r\n?", "\n")
    return files.select(F.input_file_name().alias("file"), F.posexplode(F.split(whole, rf"(?m)^(?={start})")).alias("pos", "record")).where(F.col("record").rlike(rf"^{start}"))


def _last(name: str) -> Column:
    """The value of the last field of that name."""
    return F.try_element_at(F.filter("fields", lambda x: x["k"] == name), F.lit(-1))["v"]


def conform(df: DataFrame) -> DataFrame:
    """All of FIELDS in order: blank and unknown values null, numbers doubles; and
    actors, if there."""
    cols = []
    for name in FIELDS:
        c = F.col(name) if name in df.columns else F.lit(None)
        c = F.trim(c.cast("string"))
        c = F.when(~F.lower(c).isin("", "unkn", "[no abstract available]"), c)
        cols.append((F.expr(f"try_cast(trim(`{name}`) AS DOUBLE)") if name in df.columns and name in NUMERIC else c.cast("double") if name in NUMERIC else c).alias(name))
    return df.select(*cols, *[c for c in ("actors",) if c in df.columns])


def read_wos(spark: SparkSession, path: str) -> DataFrame:
    """BibTeX of the Web of Science. A field's further lines are indented; in the
    cited references each is one more reference, its own `;` written as `,`."""
    rec = _records(spark, path, PATTERNS["wos"], "@")

    def field(line: Column) -> Column:
        key = F.lower(F.regexp_extract(line, r"^([A-Za-z0-9-]+)\s*=", 1))
        value = F.regexp_extract(line, r'(?s)=\s*[{"]*(.*?)[}",\s]*$', 1)
        cited = F.array_join(F.transform(F.split(value, r"\n\s*"), lambda r: F.regexp_replace(T.squeeze(r), ";", ",")), "; ")
        return F.struct(key.alias("k"), F.when(key == "cited-references", cited).otherwise(T.squeeze(value)).alias("v"))

    rec = rec.withColumn("fields", F.transform(F.split("record", r"\n(?=\S)"), field))
    return conform(rec.select(*[_last(k).alias(v) for k, v in WOS.items()]))


def read_medline(spark: SparkSession, path: str) -> DataFrame:
    """MEDLINE records. Authors are joined by ` and `, other fields that come
    again by `; `; of the publication types the first stays."""
    rec = _records(spark, path, PATTERNS["pubmed"], "PMID-")

    def field(line: Column) -> Column:
        return F.struct(F.trim(F.substring(line, 1, 4)).alias("k"), T.squeeze(F.substring(line, 7, 1 << 30)).alias("v"))

    def every(tag: str, mark: str) -> Column:
        return F.array_join(F.transform(F.filter("fields", lambda x: x["k"] == tag), lambda x: x["v"]), mark)

    rec = rec.withColumn("fields", F.transform(F.split("record", r"\n(?=[A-Z]{2,4} *-)"), field))
    cols = {v: every(k, " and " if k == "AU" else "; ") for k, v in MEDLINE.items()}
    cols["document_type"] = F.try_element_at(F.filter("fields", lambda x: x["k"] == "PT"), F.lit(1))["v"]
    cols["doi"] = T.embedded_doi(F.concat(F.lit("DOI "), F.regexp_extract(every("LID", "; "), r"(10\.\d{4,9}/\S+) \[doi\]", 1)))
    cols["year"] = F.substring(cols["year"], 1, 4)
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    cols["language"] = F.coalesce(F.try_element_at(names, cols["language"]), cols["language"])
    return conform(rec.select(*[c.alias(n) for n, c in cols.items()]))


def read_scopus(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Scopus CSV; older exports need encoding="windows-1252". Spark takes such
    charsets only under a session setting, which is then set and stays."""
    if not re.match(r"(?i)utf-|iso-8859-1$|us-ascii$", encoding):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    raw = spark.read.options(header=True, multiLine=True, escape='"', encoding=encoding, pathGlobFilter=PATTERNS["scopus"]).csv(path)
    low = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    out = raw.select(*[F.col(f"`{low[k]}`").alias(v) for k, v in SCOPUS.items() if k in low])
    if "author" in out.columns:
        out = out.withColumn("author", F.regexp_replace("author", r"\s*;\s*", " and "))
    return conform(out)


_NAMED = "struct<display_name:string>"
OPENALEX = (
    "id string, title string, publication_year string, cited_by_count string, language string, type string, doi string, "
    f"primary_location struct<source:{_NAMED}>, referenced_works array<string>, keywords array<{_NAMED}>, "
    f"abstract_inverted_index map<string,array<int>>, authorships {A.AUTHORSHIPS}"
)


def read_openalex(spark: SparkSession, path: str) -> DataFrame:
    """JSON works, one a line; the abstract comes from its inverted index."""
    w = spark.read.schema(t._parse_datatype_string(OPENALEX)).json(path)
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, "; "))
    return conform(
        w.select(
            "id",
            joined(F.transform("authorships", lambda a: a["author"]["display_name"])).alias("author"),
            joined(F.flatten(F.transform("authorships", lambda a: F.coalesce(a["raw_affiliation_strings"], F.array().cast("array<string>"))))).alias("affiliations"),
            T.abstract_of_index(F.col("abstract_inverted_index")).alias("abstract"),
            F.col("primary_location.source.display_name").alias("journal"),
            "title",
            joined(F.transform("keywords", lambda k: k["display_name"])).alias("author_keywords"),
            T.normalise_doi(F.col("doi")).alias("doi"),
            "language",
            F.col("type").alias("document_type"),
            joined(F.col("referenced_works")).alias("references"),
            F.col("publication_year").alias("year"),
            F.col("cited_by_count").alias("cited_by"),
            A.from_openalex(F.col("authorships")).alias("actors"),
        )
    )


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """seed: the first token of each line that isn't blank or a comment."""
    line = F.trim(F.regexp_replace("value", "^﻿", ""))
    return spark.read.text(path).select(line.alias("l")).where("l <> '' AND l NOT LIKE '#%'").select(F.split("l", r"\s+")[0].alias("seed"))


READERS = {"wos": read_wos, "pubmed": read_medline, "scopus": read_scopus, "openalex": read_openalex}


def read(spark: SparkSession, path: str, db: str) -> DataFrame:
    if db not in READERS:
        raise ValueError(f"no reader for {db!r}; there are {sorted(READERS)}")
    return READERS[db](spark, path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (t.ArrayType, t.MapType, t.StructType)) else F.col(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").options(header=True, escape='"').csv(path)
