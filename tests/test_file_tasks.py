"""Single files listed and read by tasks: the rows of Spark's own readers, without its listing in the driver."""

import json

import __spark_entry__ as entry
from ledgerloom.sources import files as fs

SMALL = "/root/testdata/sf0.001"
WORD = {"text": "Hi", "bbox": [1, 2, 3, 4], "top": 5.5, "bottom": 6.5}
PAGE = {"pdf": "é.pdf", "page_index": 0, "total_pages": 1, "used_ocr": False, "word_count": 1, "words": [WORD, WORD]}
WHOLE, OTHER = json.dumps(PAGE, indent=1), json.dumps({**PAGE, "word_count": "x"})
CONTENTS = {
    "whole": WHOLE, "array": f"[{WHOLE}, {OTHER}]", "none": "[]", "empty": "", "blank": " \n", "cut": WHOLE[:70], "type": OTHER, "null": "null",
    "number": "5", "tail": WHOLE + " x", "mixed": f"[{WHOLE}, 5]", "gap": f"[{WHOLE}, null]", "cut array": f"[{WHOLE}, ", "object": "{}",
    "wide": WHOLE.encode("utf-16"), "marked": json.dumps(PAGE, ensure_ascii=False).encode("utf-8-sig"), "bytes": b'{"pdf":"a\xff"}'}


def put(folder, name, content):
    target = folder / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content if isinstance(content, bytes) else content.encode())


def rows(frame):
    return sorted(repr(tuple(r)) for r in frame.collect())


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_pages_read_by_tasks_are_those_of_the_reader(spark, tmp_path, monkeypatch):
    for name, content in CONTENTS.items():
        put(tmp_path, f"st {name}%20/page_7_words.json", content)
    for name in ("_h/page_1_words.json", ".x/page_1_words.json", "y/page_words.json", "y/page__words.json", "y/z/page_3_words.json",
                 "_a=1/page_2_words.json", "page_9_words.json", "y/page_1_words.json.bak"):
        put(tmp_path, name, WHOLE)
    by_tasks = fs.read_pages(spark, str(tmp_path))
    assert "MapInArrow" in plan_of(by_tasks) and "FileScan" not in plan_of(by_tasks)
    monkeypatch.setattr(fs, "_own_folder", lambda *_: None)
    by_reader = fs.read_pages(spark, str(tmp_path))
    assert by_tasks.columns == by_reader.columns and rows(by_tasks) == rows(by_reader) and len(rows(by_tasks)) > 15


def test_files_listed_by_tasks_are_those_of_the_reader(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fs, "READ_BYTES", 10)
    for name in ("a.pdf", "p/b.PDF", "p/c.Pdf", "p/_d.pdf", "p/.e.pdf", "p/q/.pdf", "p/f.pdf._COPYING_", "p/é x%41+.pdf", "p/q/r/s.pdf"):
        put(tmp_path, name, "%PDF" + name)
    by_tasks = fs.list_statements(spark, str(tmp_path), content=True)
    assert "MapInArrow" in plan_of(by_tasks) and rows(by_tasks.drop("content")) == rows(fs.list_statements(spark, f"file:{tmp_path}"))
    monkeypatch.setattr(fs, "_own_folder", lambda *_: None)
    by_reader = fs.list_statements(spark, str(tmp_path), content=True)
    assert by_tasks.schema.simpleString() == by_reader.schema.simpleString() and rows(by_tasks) == rows(by_reader) and by_tasks.count() == 4


def test_listed_files_are_read_once(spark):
    """What is joined was read before and holds the first bytes only."""
    assert "binaryFile" not in (plan := plan_of(entry.queries()["src3_listed_files"](spark, SMALL))) and "MapInArrow" not in plan
