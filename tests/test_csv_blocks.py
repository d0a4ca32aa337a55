"""CSV files cut into blocks, against the csv module and Spark's reader of one task per file."""

import csv
import io
import random
from contextlib import contextmanager

import pytest

from frameglass.sources import read_csv, stage_csv
from frameglass.sources.csv_blocks import QuoteRules


@contextmanager
def cut_every(spark, size):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one_task(spark, path, **options):
    return rows_of(spark.read.options(header=True, multiLine=True, escape='"', **options).csv(path))


PIECES = ["", "a", "b c", ",", '"', '""', "\n", "\n\n", "\r\n", '",', ',"', '"\n', "é", "x" * 30]


def random_rows(seed, n):
    draw = random.Random(seed)
    return [(str(i), *["".join(draw.choices(PIECES, k=draw.randint(0, 6))) for _ in range(2)]) for i in range(n)]


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [23, 150])
def test_blocks_of_any_size_give_the_rows_that_were_written(spark, tmp_path, size, line_end):
    rows = random_rows(size, 40)
    text = io.StringIO()
    writer = csv.writer(text, lineterminator=line_end, quoting=csv.QUOTE_MINIMAL)
    writer.writerows([("id", "t.1", "u"), *rows])
    (tmp_path / "t.csv").write_bytes(text.getvalue().encode())
    with cut_every(spark, size):
        df = stage_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["id", "t.1", "u"]
    assert rows_of(df) == sorted([tuple(x or None for x in r) for r in rows], key=repr)


def test_files_with_their_own_headers_and_no_last_line_end(spark, tmp_path):
    texts = {
        "a.csv": 'k,v\n1,"x\n\ny"\n\n2,plain', "b.csv": '\n"k","v"\n3,"long ' + "\n".join("line" for _ in range(20)) + ' end"\n',
        "c.csv": 'k,"v"\n', "d.csv": 'k,v\n4,it"s\n5,"q""\n""r"\n6\n7,"a"b\n',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    expected = one_task(spark, str(tmp_path))
    for size in (16, 10_000):
        with cut_every(spark, size):
            df = stage_csv(spark, str(tmp_path))
        assert rows_of(df) == expected


def test_header_longer_than_a_block(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"k\nwith\nmany\nlines",v\n1,2\n"3\n4",5\n')
    with cut_every(spark, 6):
        df = stage_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["k\nwith\nmany\nlines", "v"] and rows_of(df) == [("1", "2"), ("3\n4", "5")]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    with (tmp_path / "t.csv").open("w") as out:
        out.write("k,v\n" + "".join(f'{i},"line\nof {i}"\n' for i in range(1000)))
    with cut_every(spark, 4000):
        lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "t.csv"))
        assert lines.rdd.getNumPartitions() >= 5
        texts = stage_csv(spark, str(tmp_path / "t.csv"))
    assert texts.count() == 1000
    df = read_csv(spark, str(tmp_path / "t.csv"), staged=True)
    assert dict(df.dtypes) == {"k": "bigint", "v": "string"}
    assert sorted(tuple(r) for r in df.collect()) == [(i, f"line\nof {i}") for i in range(1000)]


def test_empty_files_and_other_signs(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k;v\n'a;\nb';'it''s'\n")
    assert rows_of(stage_csv(spark, str(tmp_path / "t.csv"), sep=";", quote="'")) == [("a;\nb", "it's")]
    (tmp_path / "only.csv").write_text("k,v\n")
    assert rows_of(stage_csv(spark, str(tmp_path / "only.csv"))) == []
    with pytest.raises(ValueError, match="ASCII"):
        QuoteRules(",", ",")


@pytest.mark.parametrize(
    "line, from_out, from_in",
    [("", 0, 1), ("a,b", 0, 1), ('"a', 1, 0), ('a"b', 0, 0), ('"a"",b', 1, 0), ('"a"x,b', 0, 0), ('",', 1, 0), (',"', 1, 0), ('""', 0, 1), ('"",""', 0, 1)],
)
def test_ends_of_lines(line, from_out, from_in):
    rules = QuoteRules(",", '"')
    assert (rules.ends_inside(line, False), rules.ends_inside(line, True)) == (from_out, from_in)
