import pytest

from frameglass.sources import (
    infer_column_kinds,
    null_safe,
    read_any,
    read_csv,
    read_json,
    read_jsonl,
    validate_source,
    write_clean,
)


def types(df):
    return dict(df.dtypes)


EDGES = '''id,name,value,group,flag,day
1,"Say ""hi""",inf,A,True,2024-01-02
2,"two
lines",-inf,,False,2024-01-03
3,C:\\path,12300000000.0,NULL,true,2024-01-04
4, padded ,-0.0001,B,false,
5,NaN,,n/a,,2024-01-06
6,1e10,7,"",TRUE,2024-01-07
'''


def test_csv_edges(spark, tmp_path):
    (tmp_path / "edges.csv").write_text(EDGES)
    df = read_csv(spark, str(tmp_path / "edges.csv"))
    assert types(df) == {
        "id": "bigint", "name": "string", "value": "double", "group": "string", "flag": "boolean", "day": "string",
    }
    rows = [tuple(r)[1:5] for r in df.orderBy("id").collect()]
    assert rows == [
        ('Say "hi"', float("inf"), "A", True),
        ("two\nlines", float("-inf"), None, False),
        ("C:\\path", 12300000000.0, None, True),
        (" padded ", -0.0001, "B", False),
        (None, None, None, None),
        ("1e10", 7.0, None, True),
    ]


def test_csv_texts_java_would_read_as_numbers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d,e\n1d,1,1.5,,true\n2f,2,NA,,FALSE\n")
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert types(df) == {"a": "string", "b": "bigint", "c": "double", "d": "double", "e": "boolean"}


def test_csv_schema_skips_inference(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,3\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "t.csv"), schema).collect()] == [(1, None), (2, 3.0)]


def test_jsonl_flattens_and_drops_empty(spark, tmp_path):
    lines = [
        '{"id": 1, "load": {"key": "a", "ms": 5}, "fault": {"code": 4, "msg": "bad"}, "gone": null}',
        '{"id": 2, "load": {"key": "b", "ms": 6}, "fault": null, "gone": null}',
    ]
    (tmp_path / "log.jsonl").write_text("\n\n".join(lines) + "\n")
    df = read_jsonl(spark, str(tmp_path / "log.jsonl"))
    assert set(df.columns) == {"id", "load.key", "load.ms", "fault.code", "fault.msg"}
    rows = df.orderBy("id").select("id", "`load.ms`", "`fault.code`").collect()
    assert [tuple(r) for r in rows] == [(1, 5, 4), (2, 6, None)]


def test_json_array(spark, tmp_path):
    (tmp_path / "people.json").write_text(
        '[\n {"id": "u1", "who": {"name": "A", "at": {"city": "X"}}, "tags": ["p", "q"]},\n'
        ' {"id": "u2", "who": {"name": "B", "at": {"city": "Y"}}, "tags": null}\n]'
    )
    df = read_json(spark, str(tmp_path / "people.json")).orderBy("id")
    assert [tuple(r) for r in df.select("id", "`who.name`", "`who.at.city`", "tags").collect()] == [
        ("u1", "A", "X", '["p", "q"]'),
        ("u2", "B", "Y", None),
    ]


@pytest.mark.parametrize(
    "text, rows",
    [
        ('{"meta": 1, "z": [{"a": 1}, {"a": 2}], "b": [{"q": 5}]}', [(1,), (2,)]),
        ('{"a": 7}', [(7,)]),
        ('[{"a": 1}]', [(1,)]),
    ],
)
def test_json_roots(spark, tmp_path, text, rows):
    (tmp_path / "d.json").write_text(text)
    assert [tuple(r) for r in read_json(spark, str(tmp_path / "d.json")).collect()] == rows


def test_json_documents_of_a_folder_decide_for_themselves(spark, tmp_path):
    folder = tmp_path / "mixed.json"
    folder.mkdir()
    (folder / "a.json").write_text('{"n": 1, "rows": [{"a": 1}, {"a": 2}], "other": [{"b": 1}]}')
    (folder / "b.json").write_text('\n {"n": 5, "a": 9}')
    (folder / "c.json").write_text('{"other": [{"b": 7}], "rows": [{"a": 3}]}')
    got = {(r.a, r.n, r.b) for r in read_json(spark, str(folder)).collect()}
    assert got == {(1, None, None), (2, None, None), (9, 5, None), (None, None, 7)}
    (folder / "d.json").write_text('[{"a": 11, "rows": [{"a": 0}]}]')
    assert read_json(spark, str(folder)).where("a = 11").count() == 1


def test_json_scalar_root(spark, tmp_path):
    (tmp_path / "d.json").write_text("5")
    with pytest.raises(ValueError, match="an array or an object"):
        read_json(spark, str(tmp_path / "d.json"))


def test_list_text_keeps_quotes_and_nulls(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"a": ["x\\"y", null], "b": [[1, 2], []], "c": []}\n\n{"a": null}\n')
    rows = [tuple(r) for r in read_jsonl(spark, str(tmp_path / "d.jsonl")).collect()]
    assert rows[0] == ('["x\\"y", null]', "[[1, 2], []]", "[]")


def test_unknown_extension(spark):
    with pytest.raises(ValueError, match="no reader"):
        read_any(spark, "table.xlsx")


def test_validate(spark, tmp_path):
    (tmp_path / "good.csv").write_text(EDGES)
    validate_source(spark, str(tmp_path / "good.csv"))
    (tmp_path / "bad.parquet").write_text("not parquet")
    with pytest.raises(ValueError, match="cannot read"):
        validate_source(spark, str(tmp_path / "bad.parquet"))
    spark.range(200_000).selectExpr("id", "md5(string(id)) AS s").coalesce(1).write.parquet(str(tmp_path / "late.parquet"))
    validate_source(spark, str(tmp_path / "late.parquet"))
    part = next((tmp_path / "late.parquet").glob("part-*"))
    data = bytearray(part.read_bytes())
    data[len(data) // 2 : len(data) // 2 + 2_000] = bytes(2_000)
    part.write_bytes(data)
    (tmp_path / "late.parquet" / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="cannot read"):
        validate_source(spark, str(tmp_path / "late.parquet"))
    (tmp_path / "bad.json").write_text('{"a": ')
    with pytest.raises(ValueError, match="cannot read"):
        validate_source(spark, str(tmp_path / "bad.json"))


def test_write_clean_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, "line\nbreak", 2.5)], "k bigint, s string, x double")
    path = write_clean(df, str(tmp_path), "dir/source.json")
    assert path.endswith("/source_preprocessed.csv")
    assert sorted(map(tuple, read_csv(spark, path).collect())) == sorted(map(tuple, df.collect()))


def test_null_safe(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "x double")
    assert [r[0] for r in null_safe(df).collect()] == [None, None, 1.0, None]


def test_column_kinds(spark):
    rows = [(i, str(i / 2), "2024-01-02 x" if i == 3 else "n/a", None, True) for i in range(30)]
    df = spark.createDataFrame(rows, "i bigint, t string, d string, u string, f boolean")
    assert dict(infer_column_kinds(df, ["i"]).collect()) == {
        "i": "numeric", "t": "numeric", "d": "datetime", "u": "unknown", "f": "categorical",
    }
