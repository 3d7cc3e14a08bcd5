"""Lines of any length that stand in several texts."""

from aeolia.llm import units
from aeolia.llm.entry import ORACLES, QUERIES
from tests.comparing import of_duckdb, of_spark, tables

FOLDER = "/root/testdata/sf0.001"


def test_short_lines_repeat(spark, monkeypatch):
    docs = spark.createDataFrame([(2, "Menu\n\n a  b \nend"), (1, "menu\n\nA B"), (3, "menu\nmenu"), (4, None)], "doc_id long, text string")
    monkeypatch.setattr(units, "table", lambda *_: docs)
    got = {(r.doc_id, r.unit, r.start, r.end, r.kept_id, r.kept_start) for r in units.op7_all_lines(spark, "").collect()}
    assert got == {(2, 0, 0, 4, 1, 0), (2, 2, 6, 12, 1, 6), (3, 0, 0, 4, 1, 0), (3, 1, 5, 9, 1, 0)}
    monkeypatch.undo()
    assert of_spark(QUERIES["op7_all_lines"](spark, FOLDER)) == of_duckdb(tables(FOLDER), ORACLES["op7_all_lines"])
