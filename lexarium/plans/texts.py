"""Queries on texts, pages, references' tokens, and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexarium.functions import text as T
from lexarium.operators import corpus as C
from lexarium.operators import topics as P
from lexarium.plans._read import table


def _titles(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", "n_chars", F.split("text", "\n")[0].alias("title"))


def canonical_titles(spark, d):
    return _titles(spark, d).select("doc_id", T.canonical_title(F.col("title")).alias("title"))


def title_key_dedup(spark, d):
    t = _titles(spark, d)
    out = C.keep_first(t, T.title_key(F.col("title")), [F.desc("n_chars"), F.col("doc_id")])
    return out.select("doc_id", "n_chars")


def truncate_text(spark, d):
    docs = table(spark, d, "documents")
    cut = T.truncate(F.col("text"), 300)
    return docs.select("doc_id", F.length(cut).cast("bigint").alias("n"), F.md5(cut.cast("binary")).alias("h"))


def plausible_abstracts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.implausible_signals(F.col("text")).cast("bigint").alias("signals"), T.plausible_abstract(F.col("text")).alias("plausible"))


def token_heuristic(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(T.heuristic_tokens(F.col("text"))).alias("tokens"))
    return c


def token_strata(spark, d):
    """Eight length classes of equal count: rows, characters, tokens."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", T.heuristic_tokens(F.col("text")).alias("tokens"))
    s = C.strata(docs, "n_chars", "doc_id", 8)
    return s.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.sum("tokens").alias("tokens"))


def language_filter(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(F.col("lang").isin("en", "fr")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


def html_strip(spark, d):
    p = table(spark, d, "pages")
    t = T.html_text(F.col("html"))
    return p.select("page_id", F.length(t).cast("bigint").alias("n"), F.md5(t.cast("binary")).alias("h"))


def url_host(spark, d):
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    return table(spark, d, "pages").select(host.alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


def json_extract(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select("event_type", k.alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"), F.count("k").alias("n"))


def _tokens(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "lang", F.explode(T.words(F.col("text"))).alias("term"))


def document_tfidf(spark, d):
    """The heaviest term of each document."""
    w = P.heaviest(_tokens(spark, d), "doc_id", "term", 3, 0.4)
    return w.select("doc_id", F.round("top", 8).alias("top"), "terms")


def topic_terms(spark, d):
    """The ten heaviest terms of each language by class TF-IDF."""
    from lexarium.operators.ranking import top_k

    w = P.class_tfidf(_tokens(spark, d), "lang", "term").withColumn("w", F.round("weight", 9))
    return top_k(w, ["lang"], [F.desc("w"), F.col("term")], 10).select("lang", "term", F.col("rank"))


def merge_exact(spark, d):
    """Documents of even sources, then those of odd ones whose title is new."""
    t = _titles(spark, d).withColumn("even", F.expr("cast(substring(source, 4) as int) % 2 = 0"))
    key = F.col("k")
    t = t.select("doc_id", "even", T.title_key(F.col("title")).alias("k"))
    out, _ = C.merge_exact(t.where("even"), t.where("not even"), "doc_id", [key])
    return out.select("doc_id", "even")


def merge_aliases(spark, d):
    t = _titles(spark, d).withColumn("even", F.expr("cast(substring(source, 4) as int) % 2 = 0")).select("doc_id", "even", T.title_key(F.col("title")).alias("k"))
    return C.merge_exact(t.where("even"), t.where("not even"), "doc_id", [F.col("k")])[1]


def seed_match_ngrams(spark, d):
    """For each benchmark item the documents with most word 5-grams in common."""
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.canonical_title(F.col("text")).alias("t"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.canonical_title(F.col("text")).alias("t"))
    return C.shortlist(bench, docs, "id", F.col("t"), 5, 5).select("a", "b", "overlap", "rank")


def doi_normalise(spark, d):
    """Reference tokens made of parts: addresses, labels and bare DOIs."""
    p = table(spark, d, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/AB."), F.col("p_partkey"), F.lit("."))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Smith J, 2019, NATURE, V1, DOI 10.1000/ab."), F.col("p_partkey"))).otherwise(F.concat(F.lit("10.1000/ab."), F.col("p_partkey"), F.lit(";,")))
    p = p.select("p_partkey", raw.alias("raw"))
    return p.select("p_partkey", F.coalesce(T.embedded_doi(F.col("raw")), T.normalise_doi(F.col("raw"))).alias("doi"), T.clean_doi(F.col("raw")).alias("cleaned"))


def split_references(spark, d):
    """An order's references as one string, split again and counted."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("10.1000/x;2-"), F.col("l_partkey")).alias("r"))
    cell = li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("r")), "; ").alias("cell"))  # an order's own lines
    parts = T.split_references(F.col("cell"))
    return cell.select("l_orderkey", F.size(parts).cast("bigint").alias("n"), F.element_at(parts, 1).alias("first"))


def _names(spark, d):
    """Person and institution names made of a document's first words."""
    w = F.split(F.regexp_replace("text", r"[^a-zA-Zà-öø-ÿß]+", " "), " ")
    docs = table(spark, d, "documents").select("doc_id", F.filter(w, lambda x: x != "").alias("w")).where("size(w) >= 3")
    a, b, c, i = F.col("w")[0], F.col("w")[1], F.col("w")[2], F.col("doc_id") % 4
    person = F.when(i == 0, F.concat(a, F.lit(", "), b)).when(i == 1, F.concat(a, F.lit(" "), b)).when(i == 2, F.concat(a, F.lit(" "), b, F.lit(" X.Y."))).otherwise(F.concat(a, F.lit(", "), b, F.lit(" "), c, F.lit(" (Corresponding Author)")))
    place = F.concat(F.when(i == 0, "The ").otherwise(""), a, F.lit(" & "), b, F.lit(" (XYZ) "), c)
    return docs.select("doc_id", person.alias("person"), place.alias("place"))


def person_keys(spark, d):
    """Names in four forms as `surname initial`, in full, and as a key."""
    n, p = _names(spark, d), F.col("person")
    return n.select("doc_id", T.person_norm(p).alias("short"), T.person_norm(p, False).alias("whole"), T.author_name_key(p).alias("key"))


def institution_keys(spark, d):
    return _names(spark, d).select("doc_id", T.institution_name_key(F.col("place")).alias("key"))


def identity_keys(spark, d):
    """Keys of addresses of persons, institutions and works, made of customers."""
    c = table(spark, d, "customer")
    digits = F.col("c_custkey").cast("string")
    k = F.lpad(digits, 4, "0")  # of longer keys the first four digits
    whole = F.when(F.length(digits) > 4, digits).otherwise(k)  # five digits are no block of an ORCID
    orcid = F.concat(F.when(F.col("c_custkey") % 2 == 0, "https://orcid.org/").otherwise(" "), whole, F.lit("-0002-8333-72"), F.when(F.col("c_custkey") % 3 == 0, "3x").otherwise("3"))
    return c.select("c_custkey", T.orcid_key(orcid).alias("orcid"), T.ror_key(F.concat(F.lit("https://ror.org/0"), F.upper("c_name"))).alias("ror"), T.openalex_key(F.concat(F.lit("http://openalex.org/A"), k)).alias("openalex"))


def fuzzy_titles(spark, d):
    """For each benchmark item's first line the nearest title of a document."""
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.canonical_title(F.substring("text", 1, 200)).alias("t"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.canonical_title(F.substring("text", 1, 200)).alias("t"))
    return C.fuzzy_matches(bench, docs, "id", F.col("t"), 50.0).withColumn("score", F.round("score", 8))


QUERIES = {f.__name__: f for f in (person_keys, institution_keys, identity_keys, fuzzy_titles, canonical_titles, title_key_dedup, truncate_text, plausible_abstracts, token_heuristic, token_strata, language_filter, html_strip, url_host, json_extract, document_tfidf, topic_terms, merge_exact, merge_aliases, seed_match_ngrams, doi_normalise, split_references)}

_KEY = "nullif(substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 90), '')"
_T = f"t AS (SELECT doc_id, n_chars, CAST(substr(source, 4) AS INT) % 2 = 0 AS even, {_KEY} AS k FROM (SELECT *, string_split(text, chr(10))[1] AS title FROM documents))"
_PLAIN = r"regexp_replace(strip_accents(lower({})), '[^\x00-\x7F]+', '', 'g')"
_NORM = "trim(regexp_replace(" + _PLAIN + ", '[^a-z0-9]+', ' ', 'g'))"
_NAMES = """n AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^a-zA-Zà-öø-ÿß]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents)"""
_KNOWN = lambda words: "[" + ", ".join(f"'{x}'" for x in words) + "]"
_W = "list_filter(regexp_split_to_array(lower({}), '[^a-zà-öø-ÿß]+'), lambda x: x <> '')"
_TOK = f"tok AS (SELECT doc_id, lang, unnest({_W.format('text')}) AS term FROM documents)"

ORACLE = {
    "canonical_titles": f"SELECT doc_id, trim(regexp_replace({_PLAIN.format('string_split(text, chr(10))[1]')}, '[^a-z0-9]+', ' ', 'g')) AS title FROM documents",
    "title_key_dedup": f"WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n_chars DESC, doc_id) AS r FROM t) SELECT doc_id, n_chars FROM r WHERE k IS NULL OR r = 1",
    "truncate_text": """WITH x AS (SELECT doc_id, text, substr(text, 1, 300) AS h FROM documents),
y AS (SELECT *, 301 - least(coalesce(nullif(strpos(reverse(h), '.'), 0), 301), coalesce(nullif(strpos(reverse(h), '!'), 0), 301), coalesce(nullif(strpos(reverse(h), '?'), 0), 301)) AS e,
300 - coalesce(nullif(strpos(reverse(h), ' '), 0), 300) AS b FROM x),
z AS (SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(substr(text, 1, CASE WHEN e - 1 >= 225 THEN e WHEN b - 1 >= 225 THEN b ELSE 300 END), '\\s+$', '') END AS c FROM y)
SELECT doc_id, length(c) AS n, md5(c) AS h FROM z""".replace("\\\\", "\\"),
    "plausible_abstracts": f"""WITH x AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z''-]*'), lambda x: lower(x)) AS w FROM documents), s AS (SELECT doc_id, text,
CAST(NOT list_has_any(w, {_KNOWN(T.FUNCTION_WORDS)}) AS BIGINT) + CAST(NOT list_has_any(w, {_KNOWN(T.VERB_CUES)}) AS BIGINT) + CAST(len(w) >= 6 AND len(list_distinct(w)) > 0.85 * len(w) AS BIGINT)
+ CAST(NOT regexp_matches(text, '[.!?]') AS BIGINT) AS signals FROM x)
SELECT doc_id, signals, coalesce(regexp_matches(text, '\\S') AND signals < 2 AND lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' .,;:!?()[]{{}}"''')) NOT IN ({_KNOWN(T.KNOWN_GARBAGE)[1:-1]}), false) AS plausible FROM s""",
    "person_keys": f"""WITH {_NAMES}, p AS (SELECT doc_id, doc_id % 4 AS i, regexp_full_match(w[2], '[A-Z]{{1,4}}') AS s, {_NORM.format('w[1]')} AS a, {_NORM.format('w[2]')} AS b, {_NORM.format('w[3]')} AS c FROM n WHERE len(w) >= 3),
q AS (SELECT doc_id, CASE WHEN i = 0 OR i = 3 OR (i = 1 AND s) THEN a WHEN i = 1 THEN b ELSE trim(a || ' ' || b) END AS l, CASE WHEN i = 0 OR (i = 1 AND s) THEN b WHEN i = 1 THEN a WHEN i = 2 THEN 'x y' ELSE trim(b || ' ' || c) END AS f FROM p),
r AS (SELECT doc_id, CASE WHEN l <> '' THEN CASE WHEN f = '' THEN l ELSE l || ' ' || substr(f, 1, 1) END END AS short, CASE WHEN l <> '' THEN trim(l || ' ' || f) END AS whole FROM q)
SELECT doc_id, short, whole, 'name:' || short AS key FROM r""",
    "institution_keys": f"""WITH {_NAMES}, p AS (SELECT doc_id, {_NORM.format("CASE WHEN doc_id % 4 = 0 THEN 'The ' ELSE '' END || w[1] || ' and ' || w[2] || '  ' || w[3]")} AS t FROM n WHERE len(w) >= 3)
SELECT doc_id, 'name:' || nullif(regexp_replace(t, '^the ', ''), '') AS key FROM p""",
    "identity_keys": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey <= 9999 THEN 'orcid:' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') || '-0002-8333-723X' END AS orcid,
'ror:0' || lower(c_name) AS ror, 'openalex:A' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS openalex FROM customer""",
    "token_heuristic": "SELECT conv_id, CAST(sum(floor(length(text) / 3.7) + 12) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id",
    "token_strata": "WITH s AS (SELECT n_chars, CAST(floor(length(text) / 3.7) + 12 AS BIGINT) AS t, CAST(ntile(8) OVER (ORDER BY n_chars, doc_id) AS INT) AS stratum FROM documents) SELECT stratum, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(t) AS BIGINT) AS tokens FROM s GROUP BY stratum",
    "language_filter": "SELECT lang, source, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY ALL",
    "html_strip": r"""WITH x AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, length(t) AS n, md5(t) AS h FROM x""",
    "url_host": "SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY ALL",
    "json_extract": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY event_type",
    "document_tfidf": f"""WITH {_TOK}, n AS (SELECT count(DISTINCT doc_id) AS n FROM tok), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.4 * (SELECT n FROM n)),
w AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT n FROM n)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)), m AS (SELECT doc_id, sqrt(sum(w * w)) AS m FROM w GROUP BY doc_id)
SELECT doc_id, max(round(w / m, 8)) AS top, count(*) AS terms FROM w JOIN m USING (doc_id) GROUP BY doc_id""",
    "topic_terms": f"""WITH {_TOK}, n AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY ALL), s AS (SELECT lang, sum(n) AS s FROM n GROUP BY lang), a AS (SELECT term, sum(n) AS t FROM n GROUP BY term),
w AS (SELECT n.lang, n.term, round(n / s * ln(1 + (SELECT avg(s) FROM s) / t), 9) AS w FROM n JOIN s ON s.lang = n.lang JOIN a ON a.term = n.term),
r AS (SELECT lang, term, CAST(row_number() OVER (PARTITION BY lang ORDER BY w DESC, encode(term)) AS INT) AS rank FROM w) SELECT lang, term, rank FROM r WHERE rank <= 10""",
    "merge_exact": f"WITH {_T} SELECT doc_id, even FROM t WHERE even OR k IS NULL OR k NOT IN (SELECT k FROM t WHERE even AND k IS NOT NULL) OR doc_id NOT IN (SELECT min(doc_id) FROM t WHERE NOT even AND k IS NOT NULL GROUP BY k)",
    "merge_aliases": f"WITH {_T}, a AS (SELECT k, min(doc_id) AS kept FROM t WHERE even AND k IS NOT NULL GROUP BY k), b AS (SELECT k, min(doc_id) AS dropped FROM t WHERE NOT even AND k IS NOT NULL GROUP BY k) SELECT dropped, kept FROM a JOIN b USING (k)",
    "doi_normalise": """SELECT p_partkey, '10.1000/ab.' || p_partkey AS doi, CASE WHEN p_partkey % 3 = 0 THEN 'https://doi.org/10.1000/AB.' || p_partkey WHEN p_partkey % 3 = 1 THEN 'Smith' ELSE '10.1000/ab.' || p_partkey END AS cleaned FROM part""",
    "split_references": "SELECT l_orderkey, count(*) AS n, min('10.1000/x;2-' || l_partkey) AS first FROM lineitem GROUP BY l_orderkey",
}
