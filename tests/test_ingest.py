"""Payload flattening and validation on literal payloads."""
import datetime as dt
import json

from pyspark.sql import functions as F

from trendspark.functions.scalars import date_from_parts
from trendspark.operators import validate as V
from trendspark.plans import queries_ingest as QI
from trendspark.sources import payloads as PL


def _payload(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


def test_patent_json_key_variants(spark):
    doc = {"results": [
        {"applicationNumberText": "A1", "inventionTitle": "T1", "filingDate": "2023-1-5",
         "inventors": [{"fullName": "x"}, {"fullName": "y"}], "assigneeEntityName": "Acme",
         "mainClassificationSymbol": "G06N", "referencedBy": [{}, {}, {}]},
        {"patentNumber": "P2", "inventionTitle": "T2", "filingDate": "2023/01/05", "applicantName": "Beta",
         "classificationNationalCurrent": {"classificationSymbolText": {"text": "C12N"}}}]}
    rows = {r.patent_id: r for r in PL.flatten_patent_json(_payload(spark, [json.dumps(doc)])).collect()}
    assert rows["A1"].assignee == "Acme" and rows["A1"].tech_class == "G06N"
    assert rows["A1"].inventor_count == 2 and rows["A1"].citations == 3
    assert rows["P2"].assignee == "Beta" and rows["P2"].tech_class == "C12N"
    assert rows["P2"].inventor_count == 1 and rows["P2"].citations == 0
    checked = {r.patent_id: r.reject_reason for r in V.patent_rules(PL.flatten_patent_json(
        _payload(spark, [json.dumps(doc)]))).collect()}
    assert checked["A1"] is None and checked["P2"] == "bad date: 2023/01/05"


def test_patent_json_empty_and_malformed(spark):
    df = _payload(spark, ['{"results": []}', '{"unexpected_key": 1}'])
    assert PL.flatten_patent_json(df).count() == 0


def test_funding_validity(spark):
    ents = [{"properties": {"money_raised": {"value_usd": 1000000}, "announced_on": "2023-01-01",
                            "funded_organization_identifier": {"value": "org1"}}},
            {"properties": {"money_raised": {"value_usd": 0}, "announced_on": "2023-01-01",
                            "funded_organization_identifier": {"value": "org2"}}},
            {"properties": {"money_raised": {"value_usd": 5}, "funded_organization_identifier": {"value": "org3"}}},
            {"properties": {"money_raised": {"value_usd": 5}, "announced_on": "2023-01-01"}}]
    flat = PL.flatten_funding_json(_payload(spark, [json.dumps({"entities": ents})]))
    valid = flat.where("is_valid").collect()
    assert len(valid) == 1 and valid[0].company_name == "Unknown" and valid[0].currency == "USD"
    assert valid[0].stage == "Unknown"


def test_article_xml_dates_and_defaults(spark):
    def art(pmid, date_xml, title=True):
        t = "<ArticleTitle>Title</ArticleTitle>" if title else ""
        return (f"<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><Article>{t}<Abstract><AbstractText>A1</AbstractText>"
                f"<AbstractText>A2</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>Jane"
                f"</ForeName></Author></AuthorList><Journal><JournalIssue><PubDate>{date_xml}</PubDate></JournalIssue>"
                f"</Journal></Article></MedlineCitation></PubmedArticle>")
    docs = [art(1, "<Year>2023</Year><Month>01</Month><Day>15</Day>"), art(2, "<Year>2022</Year><Month>Dec</Month>"),
            art(3, "<MedlineDate>2021 Spring</MedlineDate>", title=False), art(4, "<Year>2020</Year><Month>March</Month><Day>2</Day>")]
    got = {r.paper_id: r for r in PL.flatten_article_xml(_payload(spark, docs)).collect()}
    assert str(got["1"].published_date.date()) == "2023-01-15"
    assert str(got["2"].published_date.date()) == "2022-12-01" and got["2"].date_defaulted
    assert str(got["3"].published_date.date()) == "1900-01-01" and got["3"].title == "N/A"
    assert str(got["4"].published_date.date()) == "2020-03-02"
    assert got["1"].authors == ["Doe Jane"] and got["1"].abstract == "A1"
    rejected = {r.paper_id: r.reject_reason for r in V.paper_rules(PL.flatten_article_xml(_payload(spark, docs))).collect()}
    assert rejected["3"] == "missing: title" and rejected["1"] is None


def test_office_xml_fault_and_language_fallback(spark):
    ok = ('<world-patent-data><biblio-search total-result-count="1"><search-result><exchange-documents>'
          '<exchange-document><bibliographic-data><publication-reference>'
          '<document-id document-id-type="epodoc"><doc-number>EP1</doc-number><date>20230105</date></document-id>'
          '</publication-reference><invention-title lang="de">Titel</invention-title></bibliographic-data>'
          '</exchange-document></exchange-documents></search-result></biblio-search></world-patent-data>')
    fault = "<fault><code>CLIENT.InvalidQuery</code><message>bad</message></fault>"
    rows = PL.flatten_office_xml(_payload(spark, [ok, fault])).collect()
    assert len(rows) == 1 and rows[0].title == "Titel" and rows[0].publication_date == "20230105"


def test_date_from_parts_month_forms(spark):
    df = spark.createDataFrame([("2022", "Dec", None), ("2022", "December", "3"), ("2022", "7", "4"), (None, None, None)],
                               "y string, m string, d string")
    got = [str(r[0]) for r in df.select(date_from_parts("y", "m", "d")).collect()]
    assert got == ["2022-12-01", "2022-12-03", "2022-07-04", "1900-01-01"]


def test_office_xml_is_parsed_once_under_a_rule(spark):
    flat = PL.flatten_office_xml(spark.range(3).selectExpr("cast(id as string) as payload"))
    rules = V.patent_rules(flat, date_col="publication_date", pattern="yyyyMMdd", fields=("patent_id", "title", "publication_date"))
    for df in (V.valid(rules).select("patent_id", "title", "publication_date"), V.counts(rules), flat):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1


def test_pages_of_an_order_are_grouped_where_its_lines_are_joined(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    day = dt.datetime(2000, 1, 2)
    put("lineitem", [(o, 7, 3, n, 50.0 if n == 2 else 4.0, "A" if n == 1 else "N", day) for o in (1, 1, 2) for n in (1, 2, 7)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz")
    put("part", [(7, "a<b", "B#1")], "p_partkey long, p_name string, p_brand string")
    put("supplier", [(3, "S#3")], "s_suppkey long, s_name string")
    put("orders", [(1, 5), (2, 5), (3, 5)], "o_orderkey long, o_custkey long")
    put("customer", [(5, "BUILDING")], "c_custkey long, c_mktsegment string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for pages in (QI.patent_json_pages(spark, str(tmp_path)), QI.office_xml_pages(spark, str(tmp_path))):
            # two sides of each of four joins: none for the grouping
            assert pages._jdf.queryExecution().sparkPlan().toString().count("Join") == 4
            assert pages._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    docs = sorted((len(json.loads(r.payload)["results"]) for r in QI.patent_json_pages(spark, str(tmp_path)).collect()))
    assert docs == [3, 6]
    flat = PL.flatten_patent_json(QI.patent_json_pages(spark, str(tmp_path)))
    rows = sorted((r.patent_id, r.title, r.filing_date, r.inventor_count, r.citations) for r in flat.collect())
    assert rows[::2][:1] == [("1-1-7-3", "a<b", "2000-01-02", 2, 4)] and ("2-2-7-3", None, "2000-01-02", 2, 50) in rows
    assert ("2-7-7-3", "a<b", "2000/01/02", 2, 4) in rows and len(rows) == 9
    office = PL.flatten_office_xml(QI.office_xml_pages(spark, str(tmp_path))).collect()
    assert sorted((r.patent_id, r.title, r.publication_date, r.total_result_count) for r in office) == sorted(
        (f"{o}-{n}-7-3", "a<b" if n == 1 else "DE a<b", "2000-01-02" if n == 7 else "20000102", 3 if o == 2 else 6) for o in (1, 1, 2) for n in (1, 2, 7))
