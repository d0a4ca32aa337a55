"""JSON documents cut into blocks, against the json module and the reader of one task per document."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from test_csv_blocks import cut_every

from frameglass.sources import read_any, read_json, stage_json
from frameglass.sources.json_blocks import json_pieces

SIGNS = ["", "a", "{", "}", "[", "]", '"', "\\", "\\\\", '\\"', ",", "\n", "}]", '{"', "é", "x" * 25]


def random_items(seed, n):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choices(SIGNS, k=draw.randint(0, 6)))
    return [
        {"id": i, "t": text(), "deep": {"u": text(), "of": [{"v": text()} for _ in range(draw.randint(0, 3))]}, "l": [text(), [i]]}
        for i in range(n)
    ]


def records(spark, path, kind="item"):
    folders = stage_json(spark, path)
    return [json.loads(r.value) for r in spark.read.text(folders[kind]).collect()] if kind in folders else []


def by_id(items):
    return sorted(items, key=lambda x: x["id"])


@pytest.mark.parametrize("style", [{"separators": (",", ":")}, {"indent": 2}, {"ensure_ascii": False}])
@pytest.mark.parametrize("size, n", [(17, 5), (160, 25), (100_000, 60)])
def test_blocks_of_any_size_give_the_items_that_were_written(spark, tmp_path, size, n, style):
    items = random_items(size, n)
    (tmp_path / "t.json").write_text(json.dumps(items, **style))
    with cut_every(spark, size):
        assert by_id(records(spark, str(tmp_path / "t.json"))) == items


@pytest.mark.parametrize("size", [39, 200])
def test_documents_of_a_folder_are_told_apart(spark, tmp_path, size):
    items = random_items(5, 12)
    whole = {"id": -1, "rows": [{"a": "}]"}, {"a": "["}], "x": {"y": {}}}
    (tmp_path / "a.json").write_text("\n " + json.dumps(items[:8]) + "\n\n")
    (tmp_path / "b.json").write_text(json.dumps(items[8:], indent=1))
    (tmp_path / "c.json").write_text(json.dumps(whole))
    (tmp_path / "d.json").write_text(json.dumps(whole, indent=3) + "\n")
    (tmp_path / "e.json").write_text("[]")
    (tmp_path / "f.json").write_text(" [ \n ] \n")
    with cut_every(spark, size):
        folders = stage_json(spark, str(tmp_path))
        read = {k: [json.loads(r.value) for r in spark.read.text(p).collect()] for k, p in folders.items()}
    assert by_id(read["item"]) == items and read["document"] == [whole, whole]


def test_staged_rows_are_those_of_one_task_per_document(spark, tmp_path):
    folder = tmp_path / "mixed.json"
    folder.mkdir()
    texts = {
        "a": '{"n": 1, "rows": [{"a": 1}, {"a": 2}], "other": [{"b": 1}]}', "b": '\n {"n": 5, "a": 9}',
        "c": '{"other": [{"b": 7}], "rows": [{"a": 3}]}', "d": '[{"a": 11, "rows": [{"a": 0}]}, {"a": 12, "n": 2.5}]',
    }
    for name, text in texts.items():
        (folder / f"{name}.json").write_text(text)
    for names in ("abcd", "abc", "d", "b"):
        paths = [str(folder / f"{name}.json") for name in names]
        expected = read_json(spark, paths)
        with cut_every(spark, 11):
            got = read_json(spark, paths, staged=True)
        assert dict(got.dtypes) == dict(expected.dtypes)
        rows = lambda df: sorted((tuple(r) for r in df.select(*sorted(expected.columns)).collect()), key=repr)
        assert rows(got) == rows(expected)
    assert read_any(spark, str(folder), staged=True).count() == 6


def test_one_document_without_line_breaks_is_read_by_many_tasks(spark, tmp_path):
    items = [{"id": i, "note": f"of {i}"} for i in range(2000)]
    (tmp_path / "t.json").write_text(json.dumps(items))
    with cut_every(spark, 4000):
        assert json_pieces(spark, str(tmp_path / "t.json")).rdd.getNumPartitions() >= 8
        df = read_json(spark, str(tmp_path / "t.json"), staged=True)
    assert dict(df.dtypes) == {"id": "bigint", "note": "string"}
    assert sorted(tuple(r) for r in df.collect()) == [(x["id"], x["note"]) for x in items]


def test_empty_arrays_give_no_rows(spark, tmp_path):
    (tmp_path / "t.json").write_text("[]")
    assert stage_json(spark, str(tmp_path / "t.json")) == {}
    assert read_json(spark, str(tmp_path / "t.json"), staged=True).count() == 0


@pytest.mark.parametrize(
    "text",
    ["5", "", '"a"', '[{"a": 1}', '[{"a": 1', '[{"a": "x', '{"a": 1', '{"a": {"b": 1}', '[{"a": 1}, 2]', "[1, 2]",
     '[{"a": 1} {"a": 2}]', '[{"a": 1},]', '[[{"a": 1}]]', '[{"a": 1}]]', '{"a": 1}{"a": 2}', '{"a": 1} x'],
)
def test_other_texts_are_refused(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises((ValueError, PySparkException)):
        read_json(spark, str(tmp_path / "t.json"), staged=True).collect()
