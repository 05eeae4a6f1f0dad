"""Landed source payloads → typed record frames (SRC-4 .. SRC-8).

Remote responses are landed as files (JSON lines, XML documents); each
flattener takes a DataFrame with the payload text in a column, parses it
with a fixed schema (``from_json`` / ``from_xml``), explodes the records and
applies the field fallbacks. Readers for landed files are thin wrappers.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.functions.scalars import date_from_parts, iso_ts, name_join, one_line

# ---------------------------------------------------------------------------
# Patent search JSON (SRC-4)
# ---------------------------------------------------------------------------
PATENT_JSON_SCHEMA = """results array<struct<
  applicationNumberText: string, patentNumber: string, inventionTitle: string, filingDate: string,
  inventors: array<struct<fullName: string>>, assigneeEntityName: string, applicantName: string,
  mainClassificationSymbol: string,
  classificationNationalCurrent: struct<classificationSymbolText: struct<text: string>>,
  referencedBy: array<struct<patentNumber: string>>>>"""


def flatten_patent_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per result; id / assignee / class fall back to the alternate
    keys; inventor_count = list length (missing → 1), citations = number of
    citing records (missing → 0)."""
    r = df.select(F.explode(F.from_json(F.col(payload), PATENT_JSON_SCHEMA)["results"]).alias("r"))
    inv = F.col("r.inventors")
    refs = F.col("r.referencedBy")
    return r.select(
        F.coalesce(F.col("r.applicationNumberText"), F.col("r.patentNumber")).alias("patent_id"),
        F.col("r.inventionTitle").alias("title"),
        F.col("r.filingDate").alias("filing_date"),
        F.transform(inv, lambda i: i["fullName"]).alias("inventors"),
        F.when(inv.isNull(), F.lit(1)).otherwise(F.size(inv)).alias("inventor_count"),
        F.coalesce(F.col("r.assigneeEntityName"), F.col("r.applicantName")).alias("assignee"),
        F.coalesce(F.col("r.mainClassificationSymbol"),
                   F.col("r.classificationNationalCurrent.classificationSymbolText.text")).alias("tech_class"),
        F.when(refs.isNull(), F.lit(0)).otherwise(F.size(refs)).alias("citations"),
        F.lit("USPTO").alias("source"))


# ---------------------------------------------------------------------------
# Funding rounds JSON (SRC-5)
# ---------------------------------------------------------------------------
FUNDING_JSON_SCHEMA = """entities array<struct<uuid: string, properties: struct<
  money_raised: struct<value_usd: double, currency: string>, announced_on: string,
  funded_organization_identifier: struct<uuid: string, value: string, name: string>,
  investment_type: string>>>, count long"""


def flatten_funding_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per entity with the validity flag of FLT-2 (value_usd present
    and non-zero, announcement date and organisation value present)."""
    e = df.select(F.explode(F.from_json(F.col(payload), FUNDING_JSON_SCHEMA)["entities"]).alias("e"))
    p = "e.properties"
    value = F.col(f"{p}.money_raised.value_usd")
    value = F.when(~F.isnan(value), value)  # a NaN amount is a missing one
    org = F.col(f"{p}.funded_organization_identifier.value")
    ann = F.col(f"{p}.announced_on")
    valid = (value.isNotNull() & (value != 0) & ann.isNotNull() & (ann != "") & org.isNotNull() & (org != ""))
    return e.select(
        org.alias("company_uuid"),
        F.coalesce(F.col(f"{p}.funded_organization_identifier.name"), F.lit("Unknown")).alias("company_name"),
        value.alias("amount_usd"),
        F.coalesce(F.col(f"{p}.money_raised.currency"), F.lit("USD")).alias("currency"),
        ann.alias("date"),
        F.coalesce(F.col(f"{p}.investment_type"), F.lit("Unknown")).alias("stage"),
        F.lit("Crunchbase").alias("source"),
        F.coalesce(valid, F.lit(False)).alias("is_valid"))


# ---------------------------------------------------------------------------
# Paper feed records (SRC-6)
# ---------------------------------------------------------------------------
PAPER_FEED_SCHEMA = """entry_id string, title string, authors array<struct<name: string>>, summary string,
  categories array<string>, published string, pdf_url string"""


def naive_wall_clock(text: Column) -> Column:
    """PRJ-2: ISO text with an optional zone suffix → timestamp_ntz keeping
    the wall clock (the offset text is cut, not applied)."""
    return iso_ts(F.regexp_replace(text, r"(?<=\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?)(Z|[+-]\d\d:?\d\d)$", ""))


def flatten_paper_feed(df: DataFrame, payload: str = "payload") -> DataFrame:
    r = df.select(F.from_json(F.col(payload), PAPER_FEED_SCHEMA).alias("r"))
    return r.select(
        F.col("r.entry_id").alias("paper_id"), F.col("r.title").alias("title"),
        F.transform(F.col("r.authors"), lambda a: a["name"]).alias("authors"),
        F.coalesce(one_line(F.col("r.summary")), F.lit("")).alias("abstract"),
        F.col("r.categories").alias("categories"),
        naive_wall_clock(F.col("r.published")).alias("published_date"),
        F.col("r.pdf_url").alias("pdf_url"), F.lit(0).alias("citation_count"), F.lit("arXiv").alias("source"))


def read_paper_feed(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed as JSON lines (one record per line)."""
    return flatten_paper_feed(spark.read.text(path).withColumnRenamed("value", "payload"))


# Text values are kept exactly (no trimming of surrounding whitespace).
XML_OPTIONS = {"ignoreSurroundingSpaces": "false"}

# ---------------------------------------------------------------------------
# Article XML (SRC-7)
# ---------------------------------------------------------------------------
_CITATION = """struct<PMID: string, Article: struct<ArticleTitle: string,
  Abstract: struct<AbstractText: array<string>>,
  AuthorList: struct<Author: array<struct<LastName: string, ForeName: string>>>,
  PubDate: struct<Year: string, Month: string, Day: string>,
  Journal: struct<JournalIssue: struct<PubDate: struct<Year: string, Month: string, Day: string>>>>>"""
ARTICLE_XML_SCHEMA = f"MedlineCitation {_CITATION}, PubmedArticle array<struct<MedlineCitation: {_CITATION}>>"


def flatten_article_xml(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per article of a ``PubmedArticleSet`` (or of a payload that is
    one ``PubmedArticle``): title 'N/A' when absent, first abstract text,
    authors 'LastName ForeName', date from the parts of the article's or its
    journal's ``PubDate`` (year 1900, month Jan, day 1 by default) plus whether
    a default was used."""
    x = df.select(F.from_xml(F.col(payload), ARTICLE_XML_SCHEMA, XML_OPTIONS).alias("x"))
    one = F.when(F.col("x.MedlineCitation").isNotNull(), F.array("x.MedlineCitation"))
    every = F.transform("x.PubmedArticle", lambda p: p["MedlineCitation"])
    a = x.select(F.explode(F.coalesce(every, one)).alias("c")).select("c.*")
    pub = F.coalesce(F.col("Article.PubDate"), F.col("Article.Journal.JournalIssue.PubDate"))
    year, month, day = pub["Year"], pub["Month"], pub["Day"]
    return a.select(
        F.col("PMID").alias("paper_id"),
        F.coalesce(F.col("Article.ArticleTitle"), F.lit("N/A")).alias("title"),
        F.transform(F.coalesce(F.col("Article.AuthorList.Author"), F.array()),
                    lambda au: name_join(au["LastName"], au["ForeName"])).alias("authors"),
        F.coalesce(F.try_element_at(F.col("Article.Abstract.AbstractText"), F.lit(1)), F.lit("N/A")).alias("abstract"),
        date_from_parts(year, month, day).cast("timestamp_ntz").alias("published_date"),
        (year.isNull() | month.isNull() | day.isNull()).alias("date_defaulted"),
        F.lit(0).alias("citation_count"), F.lit("PubMed").alias("source"))


# ---------------------------------------------------------------------------
# Patent-office XML (SRC-8)
# ---------------------------------------------------------------------------
OFFICE_XML_SCHEMA = """`biblio-search` struct<`_total-result-count`: string, `search-result`: struct<
  `_total-result-count`: string, `exchange-documents`: struct<`exchange-document`: array<struct<`bibliographic-data`: struct<
    `publication-reference`: struct<`document-id`: array<struct<`_document-id-type`: string,
                                                              `doc-number`: string, `date`: string>>>,
    `invention-title`: array<struct<`_lang`: string, `_VALUE`: string>>>>>>>>"""


def flatten_office_xml(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per exchange document of a response, with or without namespace
    prefixes; the count is the search result's or else the search's. Number and date of the 'epodoc'
    document id, English title else the first title else 'N/A'. A fault
    document has no search result and yields no rows."""
    p = df.select(F.from_xml(F.col(payload), OFFICE_XML_SCHEMA, XML_OPTIONS | {"ignoreNamespace": "true"}).alias("p"))
    counts = [F.col(f"p.`biblio-search`.{at}`_total-result-count`") for at in ("`search-result`.", "")]
    total = F.coalesce(*counts).try_cast("long")

    def record(d: Column) -> Column:
        ids = F.filter(d["bibliographic-data"]["publication-reference"]["document-id"],
                       lambda i: i["_document-id-type"] == "epodoc")
        titles = d["bibliographic-data"]["invention-title"]
        en = F.filter(titles, lambda t: t["_lang"] == "en")
        return F.struct(
            F.try_element_at(ids, F.lit(1))["doc-number"].alias("patent_id"),
            F.coalesce(F.try_element_at(en, F.lit(1))["_VALUE"], F.try_element_at(titles, F.lit(1))["_VALUE"],
                       F.lit("N/A")).alias("title"),
            F.try_element_at(ids, F.lit(1))["date"].alias("publication_date"),
            F.lit("EPO").alias("source"), total.alias("total_result_count"))
    # the records are built before they are exploded: a plain list is tested for null and size by a filter that parses the
    # payload anew, and a rule on a record would look its values up again at each mention
    docs = F.col("p.`biblio-search`.`search-result`.`exchange-documents`.`exchange-document`")
    return p.select(F.explode(F.transform(docs, record)).alias("r")).select("r.*")


# ---------------------------------------------------------------------------
# Payloads that cannot be flattened (SRC-4 .. SRC-8)
# ---------------------------------------------------------------------------
CORRUPT = "_corrupt_record"

# FIXED VALUES: why a payload is turned away.
NO_TEXT, NOT_JSON, NOT_XML, NO_RECORDS, FAULT = "no text", "not JSON", "not XML", "no records", "fault document"


def _json_reason(text: Column, path: str | None, name: str) -> Column:
    """``path``: the list that a response must have (None: the response is one
    record and must be an object with ``name``)."""
    doc = F.try_parse_json(text)
    if path is None:
        shape = F.when(F.try_variant_get(doc, f"$.{name}", "string").isNull(), f"no {name}")
    else:
        records = F.try_variant_get(doc, path, "array<variant>")
        shape = F.when(records.isNull(), f"no {name} list").when(F.size(records) == 0, NO_RECORDS)
    return F.when(text.isNull() | (F.trim(text) == ""), NO_TEXT).when(doc.isNull(), NOT_JSON).otherwise(shape)


def _xml_reason(text: Column, schema: str, options: dict, found, fault: str | None = None) -> Column:
    """``found``: the number of records in the parsed document."""
    doc = F.from_xml(text, f"{schema}, {CORRUPT} string", options | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    shape = F.when(F.coalesce(found(doc), F.lit(0)) == 0, NO_RECORDS)
    if fault:
        shape = F.when(text.rlike(fault), FAULT).otherwise(shape)
    return F.when(text.isNull() | (F.trim(text) == ""), NO_TEXT).when(doc[CORRUPT].isNotNull(), NOT_XML).otherwise(shape)


def _articles(doc: Column) -> Column:
    return F.coalesce(F.size(doc["PubmedArticle"]), F.when(doc["MedlineCitation"].isNotNull(), 1))


def _exchange_documents(doc: Column) -> Column:
    return F.size(doc["biblio-search"]["search-result"]["exchange-documents"]["exchange-document"])


def reject_reason(source: str, payload: str = "payload") -> Column:
    """Why a payload of the source cannot be flattened; null: it can, and has
    a record at least. ``source``: patent_json, funding_json, paper_feed,
    article_xml or office_xml."""
    text = F.col(payload)
    if source == "patent_json":
        return _json_reason(text, "$.results", "results")
    if source == "funding_json":
        return _json_reason(text, "$.entities", "entities")
    if source == "paper_feed":
        return _json_reason(text, None, "entry_id")
    if source == "article_xml":
        return _xml_reason(text, ARTICLE_XML_SCHEMA, XML_OPTIONS, _articles)
    if source == "office_xml":
        return _xml_reason(text, OFFICE_XML_SCHEMA, XML_OPTIONS | {"ignoreNamespace": "true"}, _exchange_documents, r"<(\w+:)?fault[\s>]")
    raise ValueError(f"no such source: {source}")


FLATTENERS = {"patent_json": flatten_patent_json, "funding_json": flatten_funding_json, "paper_feed": flatten_paper_feed,
              "article_xml": flatten_article_xml, "office_xml": flatten_office_xml}


def flatten_or_reject(df: DataFrame, source: str, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """The records of the payloads that can be flattened, and a row for each
    of the others: all its columns, its text whole, and ``reject_reason``. Every
    payload is in one of the two."""
    judged = df.withColumn("reject_reason", reject_reason(source, payload))
    good = judged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return FLATTENERS[source](good, payload), judged.where(F.col("reject_reason").isNotNull())
