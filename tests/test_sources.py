import json

from lexarium.sources import bibliographic as B

WOS = """@article{ WOS:1,
Author = {Doe, Jane and Roe, J},
Title = {A long
   title},
Cited-References = {Smith J, 2019, NATURE, V1, DOI 10.1000/a;b.
   Other K, 2020, CELL},
Times-Cited = {7},
Year = {2021},
Type = {Article},
Unique-ID = {WOS:1},
}

@article{ WOS:2,
Title = {Second},
Title = {Second again},
Year = {soon},
Abstract = {[No abstract available]},
Unique-ID = {WOS:2},
}
"""
NBIB = """PMID- 11
TI  - A folded
      title
AU  - Doe J
AD  - Univ X
AU  - Roe K
AD  - Inst Y
LA  - eng
DP  - 2020 Mar
PT  - Journal Article
PT  - Review
LID - 10.1000/abc [doi]

PMID- 12
TI  - Other
"""


def test_wos(spark, tmp_path):
    (tmp_path / "a.bib").write_text(WOS)
    (tmp_path / "b.txt").write_text("@no")
    one, two = sorted(B.read_wos(spark, str(tmp_path)).collect(), key=lambda r: r.id)
    assert one.title == "A long title" and one.author == "Doe, Jane and Roe, J"
    assert one.references.split("; ")[1] == "Other K, 2020, CELL" and one.references.startswith("Smith J, 2019, NATURE, V1, DOI 10.1000/a,b")
    assert (one.cited_by, one.year, one.doi) == (7.0, 2021.0, None)
    assert (two.title, two.year, two.abstract) == ("Second again", None, None)


def test_medline(spark, tmp_path):
    (tmp_path / "a.nbib").write_text(NBIB)
    one, two = sorted(B.read(spark, str(tmp_path), "pubmed").collect(), key=lambda r: r.id)
    assert (one.title, one.author, one.affiliations, one.language) == ("A folded title", "Doe J and Roe K", "Univ X; Inst Y", "English")
    assert (one.year, one.document_type, one.doi) == (2020.0, "Journal Article", "10.1000/abc")
    assert (two.id, two.title, two.author, two.doi) == ("12", "Other", None, None)


def test_scopus(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('Authors,Title,Year,"Cited by",EID\n"Doe J.; Rüe K.","A ""b""\nc",2020,x,e1\n'.encode("cp1252"))
    (r,) = B.read_scopus(spark, str(tmp_path), "windows-1252").collect()
    assert (r.author, r.title, r.year, r.cited_by, r.id, r.references) == ("Doe J. and Rüe K.", 'A "b"\nc', 2020.0, None, "e1", None)


def test_openalex_and_csv(spark, tmp_path):
    work = {"id": "W1", "doi": "https://doi.org/10.1000/AB", "publication_year": 2020, "referenced_works": ["W2", "W3"], "keywords": [{"display_name": "k"}], "abstract_inverted_index": {"world": [1], "Hello": [0]}, "primary_location": {"source": {"display_name": "J"}}, "authorships": [{"author": {"display_name": "Jane"}, "raw_affiliation_strings": ["U, V"]}, {"author": {"display_name": "John"}}]}
    (tmp_path / "w.json").write_text(json.dumps(work) + "\n" + json.dumps({"id": "W9", "authorships": []}))
    df = B.read_openalex(spark, str(tmp_path / "w.json"))
    one, two = sorted(df.collect(), key=lambda r: r.id)
    assert (one.author, one.affiliations, one.abstract, one.references, one.doi, one.journal, one.year) == ("Jane; John", "U, V", "Hello world", "W2; W3", "10.1000/ab", "J", 2020.0)
    assert two.author is None and two.abstract is None
    B.write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_seeds(spark, tmp_path):
    (tmp_path / "s").write_text("﻿W1 the first\n\n# none\n 10.1000/a\n")
    assert [r.seed for r in B.read_seeds(spark, str(tmp_path / "s")).collect()] == ["W1", "10.1000/a"]
