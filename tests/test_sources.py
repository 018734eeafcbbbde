import datetime

import pytest
from pyspark.sql import functions as F

from grovemark.sources import articles, clusterer, vocabulary, words

MESH = """*NEWRECORD
RECTYPE = D
MH = Diabetes Mellitus
MN = C18.452.394.750
MN = C19.246
UI = D003920

*NEWRECORD
MH = Diabetic Foot
MN = C19.246.099.500.191
UI = D017719
"""

XML = """<PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">11</PMID>
<DateCompleted><Year>2019</Year><Month>03</Month><Day>07</Day></DateCompleted>
<Article><ArticleTitle>[A title].</ArticleTitle>
<Abstract><AbstractText Label="AIM">Gene <i>TCF7L2</i> and H<sub>2</sub>O p &lt; 1 here.</AbstractText><AbstractText>second</AbstractText></Abstract></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D003920">x</DescriptorName></MeshHeading>
<MeshHeading><DescriptorName UI="D000001">y</DescriptorName></MeshHeading></MeshHeadingList>
</MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID Version="1">12</PMID>
<DateRevised><Year>2020</Year><Month>04</Month><Day>08</Day></DateRevised>
<Article><ArticleTitle>No abstract</ArticleTitle></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D003920">x</DescriptorName></MeshHeading></MeshHeadingList>
</MedlineCitation></PubmedArticle>
</PubmedArticleSet>
"""


def test_vocabulary(spark, tmp_path):
    (tmp_path / "mesh.bin").write_text(MESH)
    got = sorted(map(tuple, vocabulary.read_class_paths(spark, str(tmp_path / "mesh.bin")).collect()))
    assert got == [
        ("D003920", "C18.452.394.750", "Diabetes Mellitus"),
        ("D003920", "C19.246", "Diabetes Mellitus"),
        ("D017719", "C19.246.099.500.191", "Diabetic Foot"),
    ]


def test_article_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    found = articles.read_article_xml(spark, str(tmp_path / "a.xml"))
    rows = sorted(map(tuple, found.collect()))
    assert rows[0] == ("11", datetime.date(2019, 3, 7), "A title", "Gene <i>TCF7L2</i> and H<sub>2</sub>O p < 1 here.", ["D003920", "D000001"])
    assert rows[1] == ("12", datetime.date(2020, 4, 8), "No abstract", None, ["D003920"])
    wanted = spark.createDataFrame([("D003920",)], "ui string")
    kept = articles.eligible_articles(found, wanted).collect()
    assert [(r.PMID, r.MeshList) for r in kept] == [("11", ["D003920"])]


def test_nodes_keep_their_position(spark, tmp_path):
    (tmp_path / "nodes.json").write_text('[{"children":[1],"filterValue":[0]},\n {"children":[],"filterValue":[7,8],"x":1}]')
    got = sorted(map(tuple, clusterer.read_nodes(spark, str(tmp_path / "nodes.json")).collect()))
    assert got == [(0, [1], [0]), (1, [], [7, 8])]


def test_phrases_and_predictions(spark, tmp_path):
    spark.createDataFrame([("1", ["a"], {1: {0: 1.0}}, 5)], "id string, tokens array<string>, index map<int, map<int, double>>, other int").write.parquet(str(tmp_path / "p"))
    assert clusterer.read_phrases(spark, str(tmp_path / "p")).columns == ["id", "tokens", "index"]
    spark.createDataFrame([(1, "D1", 3, 0.5)], "PMID long, mesh_ui_diab string, prediction int, x double").write.parquet(str(tmp_path / "f"))
    assert tuple(clusterer.read_predictions(spark, str(tmp_path / "f")).head()) == (1, "D1", 3)


def test_word_vectors_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("b", [1.5, -2.0]), ("a", [0.25, 1e-5])], "word string, vec array<float>")
    path = str(tmp_path / "vectors")
    words.write_word_vectors(table, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert "2 2" in lines and len(lines) == 3
    first = sorted(p for p in (tmp_path / "vectors").iterdir() if p.name.startswith("part"))[0]
    assert first.read_text().startswith("2 2\n")
    got = {r.word: r.vec for r in words.read_word_vectors(spark, path).collect()}
    assert got == {r.word: r.vec for r in table.collect()}


def test_word_list_round_trip(spark, tmp_path):
    words.write_words(spark.createDataFrame([(" the",), ("of",)], "word string"), str(tmp_path / "w"))
    assert sorted(r.word for r in words.read_words(spark, str(tmp_path / "w")).collect()) == ["of", "the"]


def test_table_and_text_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("t", "a\nb")], "title string, abstract string")
    for _ in range(2):
        articles.write_table(docs, str(tmp_path / "t"))
        articles.write_one_line_text(docs, F.concat_ws(" ", "title", "abstract"), str(tmp_path / "x"))
    assert articles.read_table(spark, str(tmp_path / "t"), ["title"]).count() == 1
    assert [r.value for r in spark.read.text(str(tmp_path / "x")).collect()] == ["t ab"]


def test_word_vectors_of_one_number(spark, tmp_path):
    for header in ("", "2 1\n"):
        path = tmp_path / f"one{len(header)}.txt"
        path.write_text(f"{header}a 0.5\nb 1.5\n")
        assert {r.word: r.vec for r in words.read_word_vectors(spark, str(path)).collect()} == {"a": [0.5], "b": [1.5]}
    (tmp_path / "bad.txt").write_text("a 0.5 1\nb 1.5 2\nc 1\n")
    with pytest.raises(Exception, match="not a word vector"):
        words.read_word_vectors(spark, str(tmp_path / "bad.txt")).collect()
