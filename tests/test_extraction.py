"""The whole extraction check on literal documents."""

import pytest

from docevidence.plans import extraction

LABS = [("Iron", "12", "g/L", "5 - 9", False), ("zinc", "3", "", "", False), ("Gold", "7", "mg", "", True), ("Lead", "", "", "", False), ("Copper", "5", "", "1 - 4", True)]


@pytest.fixture(scope="module")
def result(spark):
    pages = [
        ("d", 1, "a.pdf", "Patient Name: Ann Lee\nDear Bob Stone,\nSerum Iron 12 g/L ref 5 - 9\ncough at night"), ("d", 2, "a.pdf", "Iron 12 again. Heart score low. BP 120"), ("d", 3, "a.pdf", " "),
        ("m", 1, "scan.pdf", "a text of the page, 41 years"), ("t", None, "note.txt", "fever since Monday"),
    ]
    tables = [("d", "1", "Zinc", "3", None, "1 - 2", None, 2, "a.pdf")]
    documents = [("d", False, ["a.pdf page 3: no extractable content."], "typed words"), ("m", True, None, None), ("n", True, [], None), ("t", False, None, None)]
    lab = [dict(zip(("name", "value", "unit", "normal_range", "is_abnormal"), x, strict=True)) for x in LABS]
    outputs = [
        ("d", "Jane Roe", 50.0, "female", lab, [" cough ", None, "", "fever"], ["aspirin"], ["typed"], [], [("BP", "120", "mmHg"), ("Pulse", "60", "")], [("Heart score", "low"), ("Heart score", "again"), ("Heart score", "high")], "coughing", ["x ray"], "story", ["blurred"]),
        ("m", "Max", 41.0, "", [lab[2]], ["cough"], None, None, None, None, None, None, None, "seen text", None),
        ("n", "Max", 41.4, "male", [lab[0] | {"normal_range": "5 - 9"}], ["cough"], None, None, None, None, None, "note", None, "all of it", None),
        ("t", None, None, None, None, ["fever", "chills", "a1", "b2", "c3", "d4", "e5"], None, None, None, None, None, None, None, None, None),
    ]
    schema = ", ".join(f"{c} {t}" for c, t in {"doc": "string", **extraction.OUTPUTS}.items())
    df = extraction.verify_extractions(
        spark.createDataFrame(outputs, schema), spark.createDataFrame(pages, "doc string, page int, filename string, text string"),
        spark.createDataFrame(tables, "doc string, item string, test string, result string, unit string, reference_range string, flag string, page int, filename string"),
        spark.createDataFrame(documents, "doc string, model_only boolean, notes array<string>, typed string"),
    )
    return {r["doc"]: r.asDict(recursive=True) for r in df.collect()}


def test_readable_document(result):
    d = result["d"]
    assert d["patient"] == {"name": "Ann Lee", "age": None, "gender": ""}
    got = [(x["name"], x["value"], x["normal_range"], x["flag"], x["is_abnormal"], x["flag_source"], x["source"], x["filename"], x["page"], x["pages"]) for x in d["labs"]]
    assert got == [("Zinc", "3", "1 - 2", "High", True, "printed_range", "table", "a.pdf", 2, None), ("Iron", "12", "5 - 9", "High", True, "printed_range", "text_match", "a.pdf", 1, None)]
    assert (d["symptoms"], d["medicines"], d["diagnoses"], d["dates"], d["notes"], d["imaging"]) == (["cough"], [], ["typed"], [], "coughing", ["x ray"])
    assert d["measurements"] == [{"name": "BP", "value": "120", "unit": "mmHg"}] and d["scores"] == [{"name": "Heart score", "result": "low"}, {"name": "Heart score", "result": "again"}]
    assert d["unverified"] == []
    assert d["limitations"] == [
        "a.pdf page 3: no extractable content.", 'Another name appears in the document ("Bob Stone", page 1); the patient name was taken from the "Patient Name" field.',
        "6 item(s) proposed by the AI were not found in the document text and were discarded (Lab: Gold 7 mg; Lab: Copper 5; Symptom: fever; Medicine: aspirin; Measurement: Pulse 60; …).", "blurred",
    ]
    assert d["raw_text"].startswith("typed words\n\n--- a.pdf · page 1 ---\nPatient Name") and d["raw_text"].endswith("--- a.pdf · page 2 ---\nIron 12 again. Heart score low. BP 120") and d["model_text"] == ""


def test_what_only_a_model_reads(result):
    m = result["m"]
    assert (m["labs"], m["symptoms"], m["patient"]) == ([], [], {"name": "", "age": 41, "gender": ""})
    assert m["unverified"] == ["Patient name: Max", "Lab: Gold 7 mg", "Symptom: cough"] and m["limitations"] == []
    assert m["model_text"] == "seen text" and m["raw_text"].endswith("--- Read by AI from images/scans (not verified against the text layer) ---\nseen text")


def test_nothing_to_check_against(result):
    n = result["n"]
    assert n["patient"] == {"name": "Max", "age": 41, "gender": "male"} and n["symptoms"] == ["cough"] and n["notes"] == "note"
    assert [(x["flag"], x["source"], x["page"]) for x in n["labs"]] == [("High", "model", None)] and (n["raw_text"], n["model_text"], n["unverified"]) == ("all of it", "all of it", [])


def test_text_without_pages(result):
    t = result["t"]
    assert t["symptoms"] == ["fever"] and t["raw_text"] == "--- note.txt ---\nfever since Monday" and t["patient"] == {"name": "", "age": None, "gender": ""}
    assert t["limitations"] == ["6 item(s) proposed by the AI were not found in the document text and were discarded (Symptom: chills; Symptom: a1; Symptom: b2; Symptom: c3; Symptom: d4; …)."]
