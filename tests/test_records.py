import json

import pytest
from pyspark.sql import functions as F

from quillstone.operators import records

DOC = "document_type_code string, file_name string, abstract string, claims array<string>, claims_parse_ok boolean"
CLEAN = f"rec_id long, application_number string, invention_title string, primary_ipc string, ipcr_classification array<string>, published_documents array<struct<{DOC.replace(' string', ':string').replace(' array', ':array').replace(' boolean', ':boolean')}>>, doc_x string"


def raw(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rec_id long, application_number string, fetched_at string, response string")


def test_clean_records(spark):
    response = {
        "ipRightStatusCode": 7,
        "filedDate": None,
        "applicant": [{"legalEntityName": " Ab  Pty "}, {"legalEntityName": 3}, "x", {}],
        "inventors": "nobody",
        "bibliographicData": {
            "applicationNumber": "123",
            "inventionTitle": [{"title": None}, {"title": " T "}],
            "ipcrClassification": [{"classificationText": "G06N 3/08", "sequenceNumber": 2}, {"classificationText": " H04L 9/00 ", "sequenceNumber": "1"}, {"classificationText": "X", "sequenceNumber": True}],
        },
        "publishedDocuments": [{"documentTypeCode": "A1", "abstractText": 5, "claimsText": "1. A widget comprising a rotor and a stator."}, 4],
    }
    rows = {r.rec_id: r for r in records.clean_records(raw(spark, [(None, "t", json.dumps(response)), ("9", None, "[]"), ("8", "t", None), ("", "t", "{")])).collect()}
    r = rows[0]
    assert r.application_number == "123" and r.applicant == ["Ab  Pty"] and r.inventors == [] and r.invention_title == "T" and r.ip_right_status_code == "7" and r.filed_date == ""
    assert r.ipcr_classification == ["G06N 3/08", "H04L 9/00", "X"] and r.primary_ipc == "H04L 9/00"
    assert len(r.published_documents) == 1 and r.published_documents[0].abstract == "" and r.published_documents[0].claims_parse_ok
    assert rows[1].application_number == "9" and rows[1].published_documents == [] and rows[3].application_number == ""
    s = records.clean_summary(records.clean_records(raw(spark, [(None, "t", json.dumps(response)), ("", "t", "{")]))).first()
    assert (s.records_in, s.records_written, s.records_skipped, s.documents, s.claims_ok) == (2, 1, 1, 1, 1)


def test_primary_code_without_numbers_and_sequence_types(spark):
    items = [{"sequenceNumber": x} for x in (3, 3.0, 3.5, "-5", "x", True, None)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "i int, j string")
    got = {r.i: r.s for r in df.select("i", records.sequence_number(F.try_parse_json("j"), "$.sequenceNumber").alias("s")).collect()}
    assert [got[i] for i in range(7)] == [3, 3, None, -5, None, None, None]
    r = records.clean_records(raw(spark, [("1", "t", json.dumps({"bibliographicData": {"ipcrClassification": [{"classificationText": "A"}, {"classificationText": "B"}]}}))])).first()
    assert r.primary_ipc == "A"


@pytest.mark.parametrize(
    "docs,want",
    [
        ([("A1", "f0", "a", ["x"] * 10, True), ("B2", "f1", "", [], None)], "f1"),
        ([("B2", "f0", "a" * 10, [], None), ("B2", "f1", "a" * 12, [], None)], "f1"),
        ([("B2", "f0", "a", [], None), ("B2", "f1", "b", [], None)], "f0"),
        ([("Z9", "f0", None, None, None)], "f0"),
        ([], None),
        (None, None),
        ([None], None),
    ],
)
def test_primary_document(spark, docs, want):
    df = spark.createDataFrame([(1, "1", "t", "A", None, docs, "")], CLEAN)
    doc = df.select(records.primary_document(F.col("published_documents")).alias("d")).first().d
    assert (doc and doc.file_name) == want


def test_texts_and_exports(spark):
    ok = ("B2", "f", " abs ", ["", " c1 ", "c2"], None)
    rows = [
        (1, " 1 ", "t", "A", None, [ok], ""),
        (2, "2", None, None, None, [("B2", "f", "a", ["c"], False)], ""),
        (3, "3", "t", "", None, [("B2", "f", " ", ["c"], True)], ""),
        (4, "4", "t", "", None, None, ""),
        (5, None, "t", "", None, [ok], ""),
    ]
    df = spark.createDataFrame(rows, CLEAN)
    t = records.patent_texts(df).collect()
    assert len(t) == 1 and t[0].claims_text == "c1\n\nc2" and t[0].claim_1 == "c1" and t[0].abstract == "abs" and t[0].application_number == "1"
    e = records.text_exports(df)
    assert e["abstracts"].count() == 4 and e["first_claims"].count() == 4
    assert sorted((r.application_number, r.claim_no, r.claim) for r in e["claims"].collect()) == [("1", 2, "c1"), ("1", 3, "c2"), ("2", 1, "c"), ("3", 1, "c")]
    assert records.patent_texts(df.limit(0)).count() == 0
