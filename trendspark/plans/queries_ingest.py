"""Registered ingest queries: scans, payload flattening, validation, rejects,
unions, de-duplication and projections (SRC-*, FLT-*, SO-*, PRJ-*).

Landed payloads are derived from the bindings inside each query (JSON with
``to_json``, XML with string templates), so their size grows with the
tables; the oracle selects the original columns they were built from.
Payload shape variations (absent keys, bad dates) are derived from row
values; they make some records invalid for the validators, no rows are cut
to make a check cheaper.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark import bindings as B
from trendspark.operators import timeseries as ts
from trendspark.operators import validate as V
from trendspark.plans.registry import AS_OF_SQL as ASOF, finish_sql, present, register, with_views
from trendspark.sources import pages as PG
from trendspark.sources import payloads as PL
from trendspark.sources.conform import PATENT_SCHEMA, conform

K = ["sector_label"]


def _xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


# ---------------------------------------------------------------------------
# Payload builders (fixtures derived from the tables)
# ---------------------------------------------------------------------------
def _order_pages(spark, sf, columns: list[str]) -> DataFrame:
    """A row per order: ``lines``, the named columns of its patents. What a
    page says of them is built from the grouped rows, so that only these are
    shuffled and sorted."""
    return B.patent_lines(spark, sf).groupBy("order_key").agg(F.collect_list(F.struct(*columns)).alias("lines"))


def patent_json_pages(spark, sf) -> DataFrame:
    """One search-response page per order (its line items: at most 7)."""
    def item(p: Column) -> Column:
        odd = (p["forward_citations"] % 2) == 1
        return F.struct(
            F.when(odd, p["patent_id"]).alias("applicationNumberText"),
            F.when(~odd, p["patent_id"]).alias("patentNumber"),
            F.when(p["citations"] != 50, p["title"]).alias("inventionTitle"),
            F.when(p["forward_citations"] == 7, F.date_format(p["filing_date"], "yyyy/MM/dd"))
            .otherwise(F.date_format(p["filing_date"], "yyyy-MM-dd")).alias("filingDate"),
            F.when(p["forward_citations"] != 6,
                   F.transform(p["inventors"], lambda n: F.struct(n.alias("fullName")))).alias("inventors"),
            F.when(odd, p["assignee"]).alias("assigneeEntityName"),
            F.when(~odd, p["assignee"]).alias("applicantName"),
            F.when(odd, p["tech_class"]).alias("mainClassificationSymbol"),
            F.when(~odd, F.struct(F.struct(p["tech_class"].alias("text")).alias("classificationSymbolText")))
            .alias("classificationNationalCurrent"),
            F.array_repeat(F.struct(F.lit("X").alias("patentNumber")), p["citations"]).alias("referencedBy"))
    pages = _order_pages(spark, sf, ["patent_id", "title", "filing_date", "assignee", "inventors", "tech_class", "citations", "forward_citations"])
    return pages.select(F.to_json(F.struct(F.transform("lines", item).alias("results"))).alias("payload"))


def funding_json_pages(spark, sf) -> DataFrame:
    """Pages of at most 32 rounds (row_key div 32)."""
    f = B.funding(spark, sf)
    rk = F.col("row_key")
    ent = F.struct(
        rk.cast("string").alias("uuid"),
        F.struct(
            F.when(F.col("amount_usd") >= 5000, F.struct(F.col("amount_usd").alias("value_usd"),
                                          F.when(F.col("stage") != "series_c", F.col("currency")).alias("currency")))
            .alias("money_raised"),
            F.when(~((F.col("stage") == "series_b") & (F.dayofmonth("date") == 1)),
                   F.date_format("date", "yyyy-MM-dd")).alias("announced_on"),
            F.struct(F.col("company_uuid").alias("uuid"), F.col("company_uuid").alias("value"),
                     F.when(F.col("stage") != "series_b", F.col("company_name")).alias("name"))
            .alias("funded_organization_identifier"),
            F.when(F.col("stage") != "series_d", F.col("stage")).alias("investment_type")).alias("properties"))
    return (f.groupBy(F.floor(rk / 32).alias("page"))
            .agg(F.collect_list(ent).alias("entities"), F.count(F.lit(1)).alias("count"))
            .select("page", F.to_json(F.struct("entities", "count")).alias("payload")))


def paper_feed_lines(spark, sf) -> DataFrame:
    r = B.papers(spark, sf)
    rec = F.struct(
        F.col("paper_id").alias("entry_id"), "title",
        F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"),
        F.col("abstract").alias("summary"), "categories",
        F.concat(F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("published"),
        "pdf_url")
    return r.select(F.to_json(rec).alias("payload"))


def _month_text() -> Column:
    return (F.when(F.col("citation_count") < 4, F.date_format("published_date", "MMM"))
            .when(F.col("citation_count") < 8, F.date_format("published_date", "MMMM"))
            .otherwise(F.month("published_date").cast("string")))


def article_xml_docs(spark, sf) -> DataFrame:
    r = B.papers(spark, sf)
    no_title = F.coalesce(F.length("abstract") < 300, F.lit(True)) | F.col("title").isNull()
    no_abstract = F.col("abstract").isNull() | ((F.col("citation_count") == 0) & (F.col("source") == "feed_a"))
    no_authors = (F.col("citation_count") == 1) & (F.col("source") == "feed_b")
    no_day = F.col("citation_count").isin(2, 3)
    author = F.transform("authors", lambda a: F.concat(
        F.lit("<Author><LastName>"), _xml_escape(F.regexp_extract(a, r"^(.*)-[^-]*$", 1)),
        F.lit("</LastName><ForeName>"), _xml_escape(F.regexp_extract(a, r"-([^-]*)$", 1)),
        F.lit("</ForeName></Author>")))
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("paper_id"), F.lit("</PMID><Article>"),
        F.when(~no_title, F.concat(F.lit("<ArticleTitle>"), _xml_escape(F.col("title")),
                                               F.lit("</ArticleTitle>"))).otherwise(F.lit("")),
        F.when(~no_abstract, F.concat(F.lit("<Abstract><AbstractText>"), _xml_escape(F.col("abstract")),
                                               F.lit("</AbstractText><AbstractText>more</AbstractText></Abstract>")))
        .otherwise(F.lit("")),
        F.when(~no_authors, F.concat(F.lit("<AuthorList>"), F.array_join(author, ""),
                                               F.lit("</AuthorList>"))).otherwise(F.lit("")),
        F.lit("<Journal><JournalIssue><PubDate><Year>"), F.year("published_date").cast("string"),
        F.lit("</Year><Month>"), _month_text(), F.lit("</Month>"),
        F.when(~no_day, F.concat(F.lit("<Day>"), F.dayofmonth("published_date").cast("string"),
                                              F.lit("</Day>"))).otherwise(F.lit("")),
        F.lit("</PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>"))
    # sets of several articles, as the feed returns them
    sets = r.select(F.pmod(F.xxhash64("paper_id"), F.greatest(F.lit(1), F.lit(r.count() // 5))).alias("page"), xml.alias("x"))
    sets = sets.groupBy("page").agg(F.array_join(F.collect_list("x"), "").alias("x"))
    return sets.select(F.concat(F.lit("<PubmedArticleSet>"), F.col("x"), F.lit("</PubmedArticleSet>")).alias("payload"))


def office_xml_pages(spark, sf) -> DataFrame:
    """One response page per order (the fault-page path is covered by the
    unit tests' literal fault document)."""
    def doc(p: Column) -> Column:
        date_text = (F.when(p["forward_citations"] == 7, F.date_format(p["filing_date"], "yyyy-MM-dd"))
                     .otherwise(F.date_format(p["filing_date"], "yyyyMMdd")))
        return F.concat(
            F.lit("<exchange-document><bibliographic-data><publication-reference>"),
            F.lit('<document-id document-id-type="docdb"><doc-number>DB'), _xml_escape(p["patent_id"]),
            F.lit('</doc-number></document-id><document-id document-id-type="epodoc"><doc-number>'),
            _xml_escape(p["patent_id"]), F.lit("</doc-number><date>"), date_text,
            F.lit('</date></document-id></publication-reference><invention-title lang="de">DE '),
            _xml_escape(p["title"]), F.lit("</invention-title>"),
            F.when(p["source"] == "EPO", F.concat(F.lit('<invention-title lang="en">'), _xml_escape(p["title"]),
                                                  F.lit("</invention-title>"))).otherwise(F.lit("")),
            F.lit("</bibliographic-data></exchange-document>"))
    pages = _order_pages(spark, sf, ["patent_id", "title", "filing_date", "forward_citations", "source"])
    pages = pages.select(F.array_compact(F.transform("lines", doc)).alias("docs"))
    ok = F.concat(F.lit('<ops:world-patent-data xmlns:ops="http://ops.epo.org" xmlns="http://www.epo.org/exchange">'
                        '<ops:biblio-search><ops:search-result total-result-count="'), F.size("docs").cast("string"),
                  F.lit('"><exchange-documents>'), F.array_join("docs", ""),
                  F.lit("</exchange-documents></ops:search-result></ops:biblio-search></ops:world-patent-data>"))
    return pages.select(ok.alias("payload"))


# ---------------------------------------------------------------------------
# SRC-4 / FLT-1 / FLT-5 patents JSON
# ---------------------------------------------------------------------------
_PJ_BASE = """select patent_id, case when citations <> 50 then title end as title,
  case when forward_citations = 7 then strftime(filing_date, '%Y/%m/%d') else strftime(filing_date, '%Y-%m-%d') end as filing_date,
  case when forward_citations <> 6 then array_to_string(inventors, '|') end as inventors,
  case when forward_citations <> 6 then len(inventors) else 1 end as inventor_count,
  assignee, tech_class, citations, 'USPTO' as source from patents"""


@register("flatten_patent_json", finish_sql(with_views(["patents"], _PJ_BASE),
                                            ints=("inventor_count", "citations")))
def flatten_patent_json(spark, sf):
    return present(PL.flatten_patent_json(patent_json_pages(spark, sf)))


@register("validate_patents", finish_sql(with_views(["patents"], f"""
select patent_id, title, filing_date from ({_PJ_BASE}) p where title is not null and filing_date not like '%/%'""")))
def validate_patents(spark, sf):
    flat = PL.flatten_patent_json(patent_json_pages(spark, sf))
    return present(V.valid(V.patent_rules(flat)).select("patent_id", "title", "filing_date"))


@register("reject_reasons", finish_sql(with_views(["patents"], f"""
select patent_id, case when title is null then 'missing: title' else concat('bad date: ', filing_date) end as reject_reason
from ({_PJ_BASE}) p where title is null or filing_date like '%/%'""")))
def reject_reasons(spark, sf):
    flat = PL.flatten_patent_json(patent_json_pages(spark, sf))
    return present(V.rejects(V.patent_rules(flat)).select("patent_id", "reject_reason"))


# ---------------------------------------------------------------------------
# SRC-5 / FLT-2 funding JSON
# ---------------------------------------------------------------------------
_FJ_BASE = """select company_uuid,
  case when stage <> 'series_b' then company_name else 'Unknown' end as company_name,
  case when amount_usd >= 5000 then amount_usd end as amount_usd,
  case when stage = 'series_c' or amount_usd < 5000 then 'USD' else currency end as currency,
  case when not (stage = 'series_b' and day(date) = 1) then strftime(date, '%Y-%m-%d') end as date,
  case when stage <> 'series_d' then stage else 'Unknown' end as stage,
  'Crunchbase' as source, amount_usd >= 5000 and not (stage = 'series_b' and day(date) = 1) as is_valid
from funding"""


@register("flatten_funding_json", finish_sql(with_views(["funding"], _FJ_BASE), d6=("amount_usd",)))
def flatten_funding_json(spark, sf):
    return present(PL.flatten_funding_json(funding_json_pages(spark, sf)))


@register("validate_funding", finish_sql(with_views(["funding"], f"""
select * exclude (is_valid) from ({_FJ_BASE}) f where is_valid"""), d6=("amount_usd",)))
def validate_funding(spark, sf):
    flat = PL.flatten_funding_json(funding_json_pages(spark, sf))
    return present(V.valid(V.funding_rules(flat)).drop("is_valid"))


# ---------------------------------------------------------------------------
# SRC-6 paper feed, FLT-7 recency
# ---------------------------------------------------------------------------
@register("flatten_papers", finish_sql(with_views(["papers"], """
select paper_id, title, array_to_string(authors, '|') as authors, coalesce(replace(abstract, chr(10), ' '), '') as abstract,
       array_to_string(categories, '|') as categories, published_date, pdf_url, 0 as citation_count, 'arXiv' as source
from papers"""), ts=("published_date",), ints=("citation_count",)))
def flatten_papers(spark, sf):
    return present(PL.flatten_paper_feed(paper_feed_lines(spark, sf)))


@register("recent_papers", finish_sql(with_views(["papers"], f"""
select paper_id, sector_label, published_date from papers where published_date > {ASOF} - INTERVAL 30 DAY"""),
    ts=("published_date",)))
def recent_papers(spark, sf):
    r = B.papers(spark, sf)
    cutoff = B.ts_lit(B.AS_OF) - F.make_dt_interval(F.lit(30))
    return present(r.where(F.col("published_date") > cutoff).select("paper_id", "sector_label", "published_date"))


# ---------------------------------------------------------------------------
# SRC-7 article XML, FLT-3
# ---------------------------------------------------------------------------
_AX_BASE = """select paper_id,
  case when length(abstract) >= 300 then title else 'N/A' end as title,
  case when not (citation_count = 1 and source = 'feed_b')
       then array_to_string(list_transform(authors, lambda a: ltrim(regexp_replace(a, '-([^-]*)$', ' \\1'))), '|') else '' end as authors,
  case when not (citation_count = 0 and source = 'feed_a') then coalesce(abstract, 'N/A') else 'N/A' end as abstract,
  case when citation_count not in (2, 3) then published_date else date_trunc('month', published_date) end as published_date,
  citation_count in (2, 3) as date_defaulted, 0 as citation_count, 'PubMed' as source
from papers"""


@register("flatten_article_xml", finish_sql(with_views(["papers"], _AX_BASE), ts=("published_date",),
                                            ints=("citation_count",)))
def flatten_article_xml(spark, sf):
    return present(PL.flatten_article_xml(article_xml_docs(spark, sf)))


@register("validate_papers", finish_sql(with_views(["papers"], f"""
select paper_id, title, published_date from ({_AX_BASE}) a
where title <> 'N/A' and abstract <> 'N/A' and authors <> ''"""), ts=("published_date",)))
def validate_papers(spark, sf):
    flat = PL.flatten_article_xml(article_xml_docs(spark, sf))
    return present(V.valid(V.paper_rules(flat)).select("paper_id", "title", "published_date"))


# ---------------------------------------------------------------------------
# SRC-8 office XML, FLT-4, SRC-3 conform
# ---------------------------------------------------------------------------
_OX_BASE = """select patent_id,
  case when source = 'EPO' then title else concat('DE ', title) end as title,
  case when forward_citations = 7 then strftime(filing_date, '%Y-%m-%d') else strftime(filing_date, '%Y%m%d') end as publication_date,
  'EPO' as source, count(*) over (partition by split_part(patent_id, '-', 1)) as total_result_count
from patents"""


@register("flatten_office_xml", finish_sql(with_views(["patents"], _OX_BASE), ints=("total_result_count",)))
def flatten_office_xml(spark, sf):
    return present(PL.flatten_office_xml(office_xml_pages(spark, sf)))


@register("validate_office_patents", finish_sql(with_views(["patents"], f"""
select patent_id, title, publication_date from ({_OX_BASE}) o where publication_date not like '%-%'""")))
def validate_office_patents(spark, sf):
    flat = PL.flatten_office_xml(office_xml_pages(spark, sf))
    rules = V.patent_rules(flat, date_col="publication_date", pattern="yyyyMMdd",
                           fields=("patent_id", "title", "publication_date"))
    return present(V.valid(rules).select("patent_id", "title", "publication_date"))


# FIXED VALUES: label given to records of a multi-sector office query.
OFFICE_QUERY_LABEL = "AUTOMOBILE, BUILDING"


@register("conform_patents", finish_sql(with_views(["patents"], f"""
select patent_id, title, strptime(publication_date, '%Y%m%d') as filing_date, CAST(NULL AS VARCHAR) as assignee,
       CAST(NULL AS VARCHAR) as inventors, CAST(NULL AS VARCHAR) as tech_class, CAST(NULL AS VARCHAR) as abstract,
       CAST(NULL AS BIGINT) as citations, CAST(NULL AS BIGINT) as forward_citations, source, '{OFFICE_QUERY_LABEL}' as sector_label
from ({_OX_BASE}) o where publication_date not like '%-%'"""), ts=("filing_date",)))
def conform_patents(spark, sf):
    flat = PL.flatten_office_xml(office_xml_pages(spark, sf))
    ok = V.valid(V.patent_rules(flat, date_col="publication_date", pattern="yyyyMMdd",
                                fields=("patent_id", "title", "publication_date")))
    return present(conform(ok, PATENT_SCHEMA, renames={"publication_date": "filing_date"},
                           date_formats={"filing_date": "yyyyMMdd"}, defaults={"sector_label": OFFICE_QUERY_LABEL}))


# ---------------------------------------------------------------------------
# FLT-6 validation counts
# ---------------------------------------------------------------------------
@register("validation_counts", finish_sql(with_views(["patents", "funding", "papers"], f"""
select 'patents_json' as dataset, count_if(title is not null and filing_date not like '%/%') as n_valid, count(*) as n_total from ({_PJ_BASE}) a
union all select 'funding_json', count_if(is_valid), count(*) from ({_FJ_BASE}) b
union all select 'papers_xml', count_if(title <> 'N/A' and abstract <> 'N/A' and authors <> ''), count(*) from ({_AX_BASE}) c
union all select 'office_xml', count_if(publication_date not like '%-%'), count(*) from ({_OX_BASE}) d"""),
    ints=("n_valid", "n_total")))
def validation_counts(spark, sf):
    parts = [
        ("patents_json", V.patent_rules(PL.flatten_patent_json(patent_json_pages(spark, sf)))),
        ("funding_json", V.funding_rules(PL.flatten_funding_json(funding_json_pages(spark, sf)))),
        ("papers_xml", V.paper_rules(PL.flatten_article_xml(article_xml_docs(spark, sf)))),
        ("office_xml", V.patent_rules(PL.flatten_office_xml(office_xml_pages(spark, sf)), date_col="publication_date",
                                      pattern="yyyyMMdd", fields=("patent_id", "title", "publication_date"))),
    ]
    out = None
    for name, df in parts:
        c = V.counts(df).select(F.lit(name).alias("dataset"), "n_valid", "n_total")
        out = c if out is None else out.unionByName(c)
    return present(out)


# ---------------------------------------------------------------------------
# SRC-9 / TK-7 newest-first capped read, FLT-8 lower bound
# ---------------------------------------------------------------------------
@register("source_topn_recent", finish_sql(with_views(["funding"], """
select company_uuid, amount_usd, date, stage, row_key from funding
where date >= TIMESTAMP '2000-01-01 00:00:00' order by date desc, row_key desc limit 1000"""),
    d6=("amount_usd",), ts=("date",)))
def source_topn_recent(spark, sf):
    f = B.funding(spark, sf)
    # the request cap is the feature: TakeOrderedAndProject keeps a per-task top-k
    return present(f.select("company_uuid", "amount_usd", "date", "stage", "row_key")
                   .where(F.col("date") >= F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
                   .orderBy(F.col("date").desc(), F.col("row_key").desc()).limit(1000))


@register("funding_since", finish_sql(with_views(["funding"], """
select row_key, company_uuid, sector_label, date, amount_usd from funding where date >= TIMESTAMP '2001-01-01 00:00:00'"""),
    d6=("amount_usd",), ts=("date",)))
def funding_since(spark, sf):
    f = B.funding(spark, sf)
    return present(f.where(F.col("date") >= F.lit("2001-01-01 00:00:00").cast("timestamp_ntz"))
                   .select("row_key", "company_uuid", "sector_label", "date", "amount_usd"))


# ---------------------------------------------------------------------------
# FLT-9 date range + phrase search per sector
# ---------------------------------------------------------------------------
# FIXED VALUES: search phrases per requested sector (fixture vocabulary).
SEARCH_TERMS = {"AI": ("thatin", "hehely"), "Biotech": ("ononst",), "Energy": ("inoran orantion", "orantion")}
SEARCH_FROM, SEARCH_TO = dt.datetime(2000, 6, 1), dt.datetime(2001, 6, 30)


def _phrase_hit(phrases: tuple[str, ...]) -> Column:
    hit = None
    for ph in phrases:
        h = (F.instr(F.lower(F.col("title")), ph) > 0) | (F.instr(F.lower(F.col("abstract")), ph) > 0)
        hit = h if hit is None else hit | h
    return hit


def _search_sql() -> str:
    hits = " union all ".join(
        f"select paper_id, '{s}' as query_sector from papers where published_date between TIMESTAMP '2000-06-01 00:00:00' "
        f"and TIMESTAMP '2001-06-30 00:00:00' and ("
        + " or ".join(f"instr(lower(title), '{p}') > 0 or instr(lower(abstract), '{p}') > 0" for p in ph) + ")"
        for s, ph in SEARCH_TERMS.items())
    return with_views(["papers"], hits)


@register("search_documents", finish_sql(_search_sql()))
def search_documents(spark, sf):
    r = B.papers(spark, sf).where(F.col("published_date").between(B.ts_lit(SEARCH_FROM), B.ts_lit(SEARCH_TO)))
    # phrases are configuration (bounded): one OR expression per sector, no join
    matched = F.array_compact(F.array(*[F.when(_phrase_hit(ph), F.lit(s)) for s, ph in SEARCH_TERMS.items()]))
    return present(r.select("paper_id", F.explode(matched).alias("query_sector")))


# ---------------------------------------------------------------------------
# FLT-15 declared rules
# ---------------------------------------------------------------------------
@register("declared_quality_rules", finish_sql(with_views(["funding"], """
select rule, n_pass, n_total, n_pass / n_total as pass_ratio, coalesce(n_pass / n_total >= 0.85, false) as meets_threshold
from (select count(*) as n_total,
        count_if(amount_usd between 1000 and 10000000000) as r1,
        count_if(amount_usd >= 100000) as r2,
        count_if(company_uuid is not null and amount_usd is not null and date is not null) as r3
      from funding) s,
     lateral (select * from (values ('amount_range', r1), ('min_amount', r2), ('required_fields', r3)) v(rule, n_pass)) v"""),
    d6=("pass_ratio",), ints=("n_pass", "n_total")))
def declared_quality_rules(spark, sf):
    f = B.funding(spark, sf)
    rules = {"amount_range": F.col("amount_usd").between(1000, 10000000000),
             "min_amount": F.col("amount_usd") >= 100000,
             "required_fields": F.col("company_uuid").isNotNull() & F.col("amount_usd").isNotNull()
             & F.col("date").isNotNull()}
    return present(V.rule_pass_ratios(f, rules, 0.85))


# ---------------------------------------------------------------------------
# SO-1 union of sources, SO-2 union with different columns, SO-5 de-dup
# ---------------------------------------------------------------------------
@register("union_sources", finish_sql(with_views(["patents", "funding", "papers"], """
select source_set, sector_label, year, count(*) as n from (
  select 'patents' as source_set, sector_label, year(filing_date) as year from patents
  union all select 'funding', sector_label, year(date) from funding
  union all select 'papers', sector_label, year(published_date) from papers) u
group by 1, 2, 3"""), ints=("year", "n")))
def union_sources(spark, sf):
    u = (B.patents(spark, sf).select(F.lit("patents").alias("source_set"), "sector_label",
                                     F.year("filing_date").alias("year"))
         .unionByName(B.funding(spark, sf).select(F.lit("funding").alias("source_set"), "sector_label",
                                                  F.year("date").alias("year")))
         .unionByName(B.papers(spark, sf).select(F.lit("papers").alias("source_set"), "sector_label",
                                                 F.year("published_date").alias("year"))))
    return present(u.groupBy("source_set", "sector_label", "year").agg(F.count(F.lit(1)).alias("n")))


@register("union_papers", finish_sql(with_views(["papers"], f"""
select paper_id, source, array_to_string(categories, '|') as categories, pdf_url, published_date from (
  select paper_id, 'arXiv' as source, categories, pdf_url, published_date from papers
  union all select paper_id, source, NULL, NULL, published_date from ({_AX_BASE}) a) u"""), ts=("published_date",)))
def union_papers(spark, sf):
    feed = PL.flatten_paper_feed(paper_feed_lines(spark, sf))
    xml = PL.flatten_article_xml(article_xml_docs(spark, sf)).drop("date_defaulted")
    u = feed.unionByName(xml, allowMissingColumns=True)
    return present(u.select("paper_id", "source", "categories", "pdf_url", "published_date"))


@register("dedupe_funding", finish_sql(with_views(["funding"], """
select row_key, company_uuid, date, amount_usd from funding"""), d6=("amount_usd",), ts=("date",)))
def dedupe_funding(spark, sf):
    f = B.funding(spark, sf).select("row_key", "company_uuid", "date", "amount_usd")
    # the same rounds fetched once per category: N copies of every row
    copies = f.unionByName(f).unionByName(f)
    return present(copies.dropDuplicates(["row_key"]))


# ---------------------------------------------------------------------------
# PRJ-2, PRJ-5, PRJ-7, PRJ-8, PRJ-9
# ---------------------------------------------------------------------------
@register("naive_timestamps", finish_sql("""
select event_id, ts, ts as parsed from events""", ts=("ts", "parsed")))
def naive_timestamps(spark, sf):
    e = B.table(spark, sf, "events")
    zone = (F.when(F.col("event_id") % 3 == 0, F.lit("+05:30")).when(F.col("event_id") % 3 == 1, F.lit("Z"))
            .otherwise(F.lit("")))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone)
    return present(e.select("event_id", "ts", PL.naive_wall_clock(iso).alias("parsed")))


@register("numeric_only", finish_sql(with_views(["patents"], """
select patent_id, citations, forward_citations from patents"""), ints=("citations", "forward_citations")))
def numeric_only(spark, sf):
    p = B.patents(spark, sf)
    return present(p.select("patent_id", *ts.numeric_columns(p)))


@register("pick_date_column", finish_sql(with_views(["patents", "funding", "papers"], """
select 'patents' as source_set, 'filing_date' as date_column, min(filing_date) as min_ts, max(filing_date) as max_ts, count(*) as n from patents
union all select 'funding', 'date', min(date), max(date), count(*) from funding
union all select 'papers', 'published_date', min(published_date), max(published_date), count(*) from papers"""),
    ts=("min_ts", "max_ts"), ints=("n",)))
def pick_date_column(spark, sf):
    from trendspark.params import DATE_COLUMN_CANDIDATES
    out = None
    for name, df in (("patents", B.patents(spark, sf)), ("funding", B.funding(spark, sf)),
                     ("papers", B.papers(spark, sf))):
        col = next((c for c in DATE_COLUMN_CANDIDATES if c in df.columns), None)
        if col is None:
            continue  # no date column: the frame contributes nothing
        part = df.agg(F.lit(name).alias("source_set"), F.lit(col).alias("date_column"), F.min(col).alias("min_ts"),
                      F.max(col).alias("max_ts"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return present(out)


# FIXED VALUES: sector → category code lookup (exact key, then upper-case key, then the label itself).
CATEGORY_CODES = {"AUTOMOBILE": "AUTO", "BUILDING": "BLDG", "furniture": "FURN"}


@register("sector_category_lookup", finish_sql("""
select c_custkey, label, coalesce(m[label], m[upper(label)], label) as category_code
from (select c_custkey, case when c_custkey % 2 = 0 then c_mktsegment else lower(c_mktsegment) end as label,
             MAP {'AUTOMOBILE': 'AUTO', 'BUILDING': 'BLDG', 'furniture': 'FURN'} as m from customer) c"""))
def sector_category_lookup(spark, sf):
    c = B.table(spark, sf, "customer")
    m = F.create_map(*[x for k, v in CATEGORY_CODES.items() for x in (F.lit(k), F.lit(v))])
    label = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    lab = c.select("c_custkey", label.alias("label"))
    return present(lab.select("c_custkey", "label",
                              F.coalesce(F.element_at(m, F.col("label")), F.element_at(m, F.upper("label")),
                                         F.col("label")).alias("category_code")))


# FIXED VALUES: fixture taxonomy (class-code prefixes and title phrases).
TAXONOMY = {"Hardware": ("Brand#1", "bolt", "gear"), "Widgets": ("widget", "gizmo")}


@register("taxonomy_labels", finish_sql(with_views(["patents"], " union all ".join(
    f"select patent_id, '{lab}' as taxonomy_label from patents where "
    + " or ".join(f"starts_with(tech_class, '{t}') or instr(lower(title), lower('{t}')) > 0" for t in terms)
    for lab, terms in TAXONOMY.items()))))
def taxonomy_labels(spark, sf):
    p = B.patents(spark, sf)
    hits = []
    for lab, terms in TAXONOMY.items():
        cond = None
        for t in terms:
            c = F.col("tech_class").startswith(t) | (F.instr(F.lower("title"), t.lower()) > 0)
            cond = c if cond is None else cond | c
        hits.append(F.when(cond, F.lit(lab)))
    # the taxonomy is configuration (bounded): one expression per label, no join
    return present(p.select("patent_id", F.explode(F.array_compact(F.array(*hits))).alias("taxonomy_label")))


# ---------------------------------------------------------------------------
# SRC-5 payloads that cannot be flattened
# ---------------------------------------------------------------------------
@register("payload_rejects", finish_sql(with_views(["funding"], """
with pages as (select CAST(floor(row_key / 32) AS BIGINT) as page, count(*) as n from funding group by 1),
judged as (select *, case page % 9 when 0 then 'not JSON' when 1 then 'no entities list' when 2 then 'no records' when 3 then 'no text' end as reason from pages)
select coalesce(reason, 'flattened') as outcome, count(*) as n_payloads,
       CAST(coalesce(sum(case when reason is null then n end), 0) AS BIGINT) as n_records
from judged group by 1"""), ints=("n_payloads", "n_records")))
def payload_rejects(spark, sf):
    """Funding pages, some cut short, some of another shape: what was
    flattened, and one reject row for every other payload."""
    pages, kind = funding_json_pages(spark, sf), F.col("page") % 9
    text = F.col("payload")
    landed = pages.withColumn("payload", F.when(kind == 0, F.substring(text, F.lit(1), F.length(text) - 5))
                              .when(kind == 1, F.replace(text, F.lit('"entities"'), F.lit('"items"')))
                              .when(kind == 2, F.lit('{"entities": [], "count": 0}')).when(kind == 3, F.lit(" ")).otherwise(text))
    records, rejects = PL.flatten_or_reject(landed, "funding_json")
    good = landed.where(PL.reject_reason("funding_json").isNull()).agg(F.count(F.lit(1)).alias("n_payloads"))
    done = good.crossJoin(records.agg(F.count(F.lit(1)).alias("n_records"))).select(F.lit("flattened").alias("outcome"), "n_payloads", "n_records")
    turned = rejects.groupBy(F.col("reject_reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n_payloads")).withColumn("n_records", F.lit(0))
    return present(done.where("n_payloads > 0").unionByName(turned))


# ---------------------------------------------------------------------------
# SRC-9 at the source: landed pages with bounds, columns and cap
# ---------------------------------------------------------------------------
@register("source_pages_recent", finish_sql(with_views(["funding"], """
select company_uuid, amount_usd, date, stage, row_key from funding
where date >= TIMESTAMP '2000-01-01 00:00:00' and date <= TIMESTAMP '2000-12-31 00:00:00' order by date desc, row_key desc limit 1000"""),
    d6=("amount_usd",), ts=("date",)))
def source_pages_recent(spark, sf):
    """The newest 1000 rounds of a year (the request cap is the feature), from
    landed pages: other pages are not opened."""
    import uuid
    from trendspark.session import ensure_checkpoint_dir, ship_package
    ship_package(spark)
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trendspark-pages/{uuid.uuid4().hex}"
    PG.land_pages(B.funding(spark, sf), at, "date", 16)
    rows = PG.read_pages(spark, at, "date", ["company_uuid", "amount_usd", "date", "stage", "row_key"],
                         dt.datetime(2000, 1, 1), dt.datetime(2000, 12, 31), cap=1000)
    return present(rows.orderBy(F.col("date").desc(), F.col("row_key").desc()).limit(1000))
