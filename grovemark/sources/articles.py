"""Articles: XML records, parquet tables and one-line text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemark.functions.labels import completion_date, is_eligible
from grovemark.functions.text import clean_title, first_part, one_line
from grovemark.operators.classes import restrict_headings

DATE = "struct<Year: string, Month: string, Day: string>"
ARTICLE_XML = f"""
  MedlineCitation struct<
    PMID: struct<_VALUE: string>,
    DateCompleted: {DATE},
    DateRevised: {DATE},
    Article: struct<
      ArticleTitle: string,
      Abstract: struct<AbstractText: array<string>>
    >,
    MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: struct<_UI: string>>>>
  >
"""


def read_article_xml(spark: SparkSession, path: str) -> DataFrame:
    """(PMID, DateCompleted, Title, Abstract, MeshList), one row per record, nothing filtered.

    Abstract is the first part only, with the inline markup it has in the record; MeshList holds the class identifiers in the order of the record.
    """
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE_XML).load(path)
    citation = raw.select("MedlineCitation.*")
    headings = F.col("MeshHeadingList.MeshHeading")
    return citation.select(
        F.col("PMID._VALUE").alias("PMID"),
        completion_date(F.col("DateCompleted"), F.col("DateRevised")).alias("DateCompleted"),
        clean_title(F.col("Article.ArticleTitle")).alias("Title"),
        first_part(F.col("Article.Abstract.AbstractText")).alias("Abstract"),
        F.transform(headings, lambda h: h["DescriptorName"]["_UI"]).alias("MeshList"),
    )


def eligible_articles(articles: DataFrame, class_paths: DataFrame) -> DataFrame:
    """Articles with an abstract and a heading of the wanted classes; MeshList keeps those headings only."""
    restricted = restrict_headings(articles, "PMID", "MeshList", class_paths)
    return restricted.filter(is_eligible(F.col("MeshList"), F.col("Abstract"), F.col("MeshList")))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A parquet table: labelled articles, clusters, merge trees or predictions; only the columns are read."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def write_table(df: DataFrame, path: str) -> None:
    """Overwrite a parquet table. The table must not be an input of df."""
    df.write.mode("overwrite").parquet(path)


def write_one_line_text(documents: DataFrame, text: Column, path: str) -> None:
    """One document per line without a header; line feeds inside the text are removed, null becomes empty."""
    documents.select(F.coalesce(one_line(text), F.lit("")).alias("value")).write.mode("overwrite").text(path)
