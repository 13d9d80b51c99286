"""Files of a mirror as tables."""

import json

import pytest

from pagewright.sources import files


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "name": "x", "n": 2}, indent=2))
    assert [tuple(r) for r in files.json_documents(spark, str(tmp_path), "version int, name string, n long", 1).collect()] == [(1, "x", 2)]
    with pytest.raises(Exception, match="unknown version 1"):
        files.json_documents(spark, str(tmp_path), "version int, name string", 2).collect()
    (tmp_path / "b.json").write_text('{"version": "no number"')
    with pytest.raises(Exception):
        files.json_documents(spark, str(tmp_path), "version int, name string", 1).collect()


def test_texts(spark, tmp_path):
    (tmp_path / "a.css").write_text("p{} é")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "c.js").write_text("x" * 200)
    found = {r["file"].rpartition("/")[2]: (r["text"], r["problem"]) for r in files.texts(spark, str(tmp_path), 100).collect()}
    assert found == {"a.css": ("p{} é", None), "b.bin": (None, "not_utf8"), "c.js": (None, "too_large")}


def test_manifest(spark, tmp_path):
    for n in (2, 3):
        files.write_manifest(spark.range(n), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 3
