from docevidence.operators import layout


def test_page(spark):
    rows = [("Test", 0.0, 100.0, 20.0), ("Result", 60.0, 101.5, 30.0), ("Unit", 120.0, 100.0, 20.0), ("Sodium", 0.0, 90.0, 20.0), ("level", 23.0, 90.0, 18.0), ("140", 62.0, 90.0, 10.0), ("mmol", 118.0, 90.0, 20.0), ("end", 0.0, 80.0, 20.0), (" ", 5.0, 70.0, 2.0)]
    items = spark.createDataFrame([("d", 1, *r) for r in rows], "document_id string, page int, str string, x double, y double, width double")
    cells = layout.layout_cells(layout.layout_lines(items))
    assert layout.page_text(cells).first()["text"] == "Test | Result | Unit\nSodium level | 140 | mmol\nend"
    out = layout.layout_tables(cells).collect()
    assert [(r["table_id"], r["row_index"], r["test"], r["result"], r["unit"], r["numeric_result"]) for r in out] == [("p1-t0", 0, "Sodium level", "140", "mmol", 140.0)]
    seg = layout.table_segments(layout.layout_tables(cells), "document_id", "table_id", "row_index", "page").first()
    assert seg["page"] == 1 and seg["text"] == "Lab results table (p1-t0)\n\nSodium level:\nResult = 140 mmol\nPage = 1"
