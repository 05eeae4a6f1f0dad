"""Late events, real payload shapes, null keys and statuses, missing columns."""
import datetime as dt
import tempfile

from pyspark.sql import functions as F

from conftest import ts
from trendspark.functions import scalars
from trendspark.operators import features, monitor, timeseries
from trendspark.sources import payloads
from trendspark.streaming import jobs


def test_every_valid_event_lands_once_in_any_order(spark):
    rows = [(i, ts("2024-01-01") + dt.timedelta(hours=6 * i), i % 5, "click", float(i), None) for i in range(300)]
    rows += [(7, ts("2024-01-01") + dt.timedelta(hours=42), 2, "click", 7.0, None), (None, ts("2024-01-01"), 1, "click", 1.0, None),
             (900, ts("2024-01-05"), 1, "click", -1.0, None)]
    schema = "event_id long, ts timestamp_ntz, user_id int, event_type string, value double, props string"
    folder = tempfile.mkdtemp(prefix="trendspark-events-", dir="/tmp")
    for part in (rows[200:], rows[100:200], rows[:100]):  # the newest file first
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    df = spark.read.parquet(folder)
    out = jobs.land_events(jobs.event_stream(spark, folder, "*.parquet", df.schema, 1)).collect()
    assert sorted(r.event_id for r in out) == list(range(300))
    assert set(out[0].asDict()) == {"event_id", "ts", "user_id", "event_type", "value", "props"}


def test_article_sets_and_date_places(spark):
    one = ("<PubmedArticle><MedlineCitation><PMID>{0}</PMID><Article><ArticleTitle>T{0}</ArticleTitle>{1}</Article>"
           "</MedlineCitation></PubmedArticle>")
    date = "<PubDate><Year>2023</Year><Month>Mar</Month><Day>5</Day></PubDate>"
    docs = ["<PubmedArticleSet>" + one.format(1, date) + one.format(2, f"<Journal><JournalIssue>{date}</JournalIssue></Journal>")
            + "</PubmedArticleSet>", one.format(3, "")]
    got = {r.paper_id: r for r in payloads.flatten_article_xml(spark.createDataFrame([(d,) for d in docs], "payload string")).collect()}
    assert sorted(got) == ["1", "2", "3"]
    assert got["1"].published_date == got["2"].published_date == ts("2023-03-05") and not got["1"].date_defaulted
    assert got["3"].date_defaulted


def test_namespaced_office_response(spark):
    xml = ('<ops:world-patent-data xmlns:ops="http://ops.epo.org" xmlns="http://www.epo.org/exchange"><ops:biblio-search>'
           '<ops:search-result total-result-count="1"><exchange-documents><exchange-document><bibliographic-data>'
           '<publication-reference><document-id document-id-type="epodoc"><doc-number>EP1</doc-number><date>20230101</date></document-id>'
           '</publication-reference><invention-title lang="en">A</invention-title></bibliographic-data></exchange-document>'
           '</exchange-documents></ops:search-result></ops:biblio-search></ops:world-patent-data>')
    r = payloads.flatten_office_xml(spark.createDataFrame([(xml,)], "payload string")).collect()
    assert [(x.patent_id, x.title, x.total_result_count) for x in r] == [("EP1", "A", 1)]


def test_null_keys_align_and_null_status_fails(spark):
    a = spark.createDataFrame([(None, ts("2024-01-01"), 1), ("x", ts("2024-01-01"), 2)], "sector_label string, ts timestamp_ntz, a int")
    b = spark.createDataFrame([(None, ts("2024-01-01"), 3)], "sector_label string, ts timestamp_ntz, b int")
    got = {r.sector_label: (r.a, r.b) for r in timeseries.outer_align([a, b], ["sector_label"]).collect()}
    assert got == {None: (1, 3), "x": (2, None)}
    look = spark.createDataFrame([("p", 1, ts("2024-01-02"), None, None)],
                                 "pipeline_name string, max_delay_days int, last_run_timestamp timestamp_ntz, status string, details string")
    r = monitor.pipeline_health(look, ts("2024-01-02")).first()
    assert r.failed and not r.all_healthy


def test_wall_clock_ignores_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-10T02:30:00Z",), ("2024-03-10T02:30:00",), ("bad",), ("2024",)], "t string")
        got = df.select(payloads.naive_wall_clock(F.col("t")).alias("a"), scalars.iso_ts("t").alias("b")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r.a for r in got] == [ts("2024-03-10T02:30:00")] * 2 + [None, None]
    assert got[1].b == ts("2024-03-10T02:30:00") and got[3].b is None


def test_missing_columns_give_zero(spark):
    p = spark.createDataFrame([("s", ts("2024-01-01"))], "sector_label string, filing_date timestamp_ntz")
    r = features.patent_features(p, keys=["sector_label"], as_of=ts("2024-02-01")).first()
    assert r.citation_velocity_avg == 0 and r.forward_citation_rate_avg == 0 and r.unique_inventor_count == 0
    f = spark.createDataFrame([("s", ts("2024-01-01"), 5.0)], "sector_label string, date timestamp_ntz, amount_usd double")
    assert features.funding_features(f, keys=["sector_label"], as_of=ts("2024-02-01")).first().seed_ratio == 0
    none = monitor.drift_check(f, ["sector_label"], monitor.drift_baseline(f, []))
    assert none.columns[-1] == "drift_detected" and none.count() == 0


PATENT_OK = '{"results": [{"patentNumber": "p1", "inventionTitle": "t", "filingDate": "2020-01-01"}]}'
ARTICLE = "<PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>T</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
OFFICE = ("<world-patent-data><biblio-search><search-result><exchange-documents><exchange-document><bibliographic-data/></exchange-document>"
          "</exchange-documents></search-result></biblio-search></world-patent-data>")


def test_every_payload_is_flattened_or_rejected(spark):
    cases = {
        "patent_json": {PATENT_OK: None, PATENT_OK[:-4]: "not JSON", '{"items": []}': "no results list", '{"results": []}': "no records", '{"results": 5}': "no results list",
                        "": "no text", None: "no text", "[1]": "no results list"},
        "paper_feed": {'{"entry_id": "a", "title": "t"}': None, '{"title": "t"}': "no entry_id", "plain": "not JSON"},
        "article_xml": {ARTICLE: None, f"<PubmedArticleSet>{ARTICLE}{ARTICLE}</PubmedArticleSet>": None, ARTICLE[:-9]: "not XML", "<PubmedArticleSet></PubmedArticleSet>": "no records",
                        "no xml at all": "not XML", " ": "no text"},
        "office_xml": {OFFICE: None, OFFICE[:-10]: "not XML", "<fault><code>404</code></fault>": "fault document", "<ops:fault xmlns:ops='x'>gone</ops:fault>": "fault document",
                       "<world-patent-data/>": "no records"},
    }
    for source, want in cases.items():
        df = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "id int, payload string")
        good, bad = payloads.flatten_or_reject(df, source)
        got = {r.id: r.reject_reason for r in bad.collect()}
        assert got == {i: reason for i, reason in enumerate(want.values()) if reason}, source
        assert {r.id: r.payload for r in bad.collect()} == {i: t for i, (t, reason) in enumerate(want.items()) if reason}
        assert good.count() == sum(reason is None for reason in want.values()) + (source == "article_xml")
