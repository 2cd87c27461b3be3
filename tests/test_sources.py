from __future__ import annotations

import csv
import io
import json
import random
import uuid
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orderloom.sources import DelimitedSource, ExtractionError, JsonPagesSource, Source
from orderloom.sources import json_splits
from orderloom.sources.delimited import DATE_FORMATS, MONTH_FIRST, NULL_TOKENS, _WITH_OFFSET, _moment
from tests.conftest import rows


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def read(spark, path, **options):
    df = DelimitedSource(spark, path, **options).extract()
    return df.drop("_loaded_at", "_source")


def test_reads_rows_and_adds_metadata(spark, tmp_path):
    path = write(tmp_path / "test.csv", "id,name,value\n1,test,100\n2,test2,200")
    df = DelimitedSource(spark, path).extract()
    assert df.columns == ["id", "name", "value", "_loaded_at", "_source"]
    assert {r["_source"] for r in df.collect()} == {"test"}
    assert df.count() == 2


def test_metadata_values(spark, tmp_path):
    path = write(tmp_path / "t.csv", "col1\nvalue1\nvalue2")
    moment = datetime(2024, 5, 1, 12, 30, 15, 123456)
    df = DelimitedSource(spark, path, source_name="test_source").extract(moment)
    assert rows(df) == [("value1", moment, "test_source"), ("value2", moment, "test_source")]
    assert dict(df.dtypes)["_loaded_at"] == "timestamp_ntz"


def test_load_time_is_taken_once(spark, tmp_path):
    path = write(tmp_path / "t.csv", "a\n" + "\n".join(map(str, range(1000))))
    df = DelimitedSource(spark, path).extract().repartition(7)
    first = {r[0] for r in df.select("_loaded_at").distinct().collect()}
    assert len(first) == 1
    assert {r[0] for r in df.select("_loaded_at").distinct().collect()} == first


def test_missing_file(spark, tmp_path):
    with pytest.raises(ExtractionError, match="PATH_NOT_FOUND|does not exist"):
        DelimitedSource(spark, str(tmp_path / "nope.csv")).extract()


def test_empty_file(spark, tmp_path):
    with pytest.raises(ExtractionError, match="no columns"):
        DelimitedSource(spark, write(tmp_path / "e.csv", "")).extract()


def test_unknown_encoding(spark, tmp_path):
    path = write(tmp_path / "e.csv", "a\n1\n")
    with pytest.raises(ExtractionError):
        DelimitedSource(spark, path, encoding="no-such").extract()


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252", "utf-16", "utf-8-sig"])
def test_python_encoding_names(spark, tmp_path, encoding):
    path = tmp_path / "e.csv"
    path.write_bytes("a,b\né,2\n".encode(encoding))
    assert rows(read(spark, str(path), encoding=encoding, multi_line=True)) == [("é", "2")]


def test_blank_and_repeated_header_fields(spark, tmp_path):
    df = read(spark, write(tmp_path / "h.csv", "id,id,,x y,a.b,id\n1,2,3,4,5,6\n7\n"))
    assert df.columns == ["id", "id.1", "Unnamed: 2", "x y", "a.b", "id.2"]
    assert rows(df) == [("1", "2", "3", "4", "5", "6"), ("7", None, None, None, None, None)]


def test_header_only(spark, tmp_path):
    df = read(spark, write(tmp_path / "h.csv", "a,b\n"))
    assert df.columns == ["a", "b"] and df.count() == 0


def test_missing_date_column(spark, tmp_path):
    path = write(tmp_path / "d.csv", "a\n1\n")
    with pytest.raises(ExtractionError, match="day"):
        DelimitedSource(spark, path, parse_dates=["day"]).extract()


def test_delimiter_and_encoding(spark, tmp_path):
    path = write(tmp_path / "s.csv", "a;b\né;1,5\n", "iso-8859-1")
    assert rows(read(spark, path, delimiter=";", encoding="iso-8859-1")) == [("é", "1,5")]


def test_null_tokens(spark, tmp_path):
    body = "\n".join(f'{i},"{t}"' for i, t in enumerate(NULL_TOKENS))
    df = read(spark, write(tmp_path / "n.csv", "id,v\n" + body + "\nx,na\ny,NAN\n"))
    values = {r["id"]: r["v"] for r in df.collect()}
    assert [values[str(i)] for i in range(len(NULL_TOKENS))] == [None] * len(NULL_TOKENS)
    assert values["x"] == "na" and values["y"] == "NAN"


def test_quotes_spaces_blank_lines(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a,b\n"say ""hi"", ok", x \n\n1,2\n')
    assert rows(read(spark, path)) == [("1", "2"), ('say "hi", ok', " x ")]


def test_line_break_in_quotes(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'a,b\n1,"x\ny"\n2,z\n')
    assert rows(read(spark, path, multi_line=True)) == [("1", "x\ny"), ("2", "z")]


BROKEN_ROWS = [
    '1,"x\ny",3', '1,2,"x\ny"', '"x\ny",2,3', '1,2,"x, ""q"" z\ny, w"', '1,2,"x\n\n\ny"',
    '1,2,"x ""\ny"', '1,2,"\ny"', '"\n",2,3', '1,"a,b\nc,d,e",3', '1,2,"a\nb,c"',
    '"a\nb","c\nd","e\nf"',
]


@pytest.mark.parametrize("row", BROKEN_ROWS)
def test_line_break_in_quotes_is_never_cut_silently(spark, tmp_path, row):
    path = write(tmp_path / "b.csv", f"a,b,c\n4,5,6\n{row}\n7,8,9\n")
    with pytest.raises(ExtractionError, match="multi_line|Expected 3 fields"):
        DelimitedSource(spark, path, multi_line=False).extract(verify=True)
    whole = list(csv.reader(io.StringIO(f"4,5,6\n{row}\n7,8,9\n")))
    for expected in (True, None):
        assert rows(read(spark, path, multi_line=expected)) == sorted((tuple(r) for r in whole), key=repr)


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of about a hundred bytes, several to a task."""
    settings = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def random_fields(generator, n, width, letters):
    return [
        ["".join(generator.choices(letters, k=generator.choice([0, 1, 3, 9, 60]))) for _ in range(width)] for _ in range(n)
    ]


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_files_with_line_breaks_are_read_in_splits(spark, tmp_path, small_splits, newline):
    """Several files whose records cross splits, some of them over several, against the csv module; rows are numbered."""
    generator, want = random.Random(3), []
    folder = tmp_path / "in"
    folder.mkdir()
    for name in "cab":
        data = random_fields(generator, 40, 3, [*'xyz,"\n\t é;', "line\n\n"])
        text = io.StringIO()
        csv.writer(text, lineterminator=newline).writerows([["f1", "f 2", "f3"], *data])
        (folder / f"{name}.csv").write_bytes(text.getvalue().encode())
        want.append((name, data))
    want = [row for _, data in sorted(want) for row in data]
    for expected in (None, True):
        source = DelimitedSource(spark, str(folder), multi_line=expected, number_rows=True)
        got = source.extract()
        assert got.select("f1").rdd.getNumPartitions() > 4
        found = sorted(got.select("_row", "f1", "f 2", "f3").collect())
        assert [r["_row"] for r in found] == list(range(len(want)))
        assert [tuple(r)[1:] for r in found] == [tuple(v if v not in NULL_TOKENS else None for v in row) for row in want]


def test_odd_quotes_in_unquoted_fields_are_text(spark, tmp_path, small_splits):
    lines = ['a,b', '5" pipe,x', 'y,"two\nlines"', '"done"later,6" more', 'z," ""q"" "'] * 1
    data = "\n".join(lines + [f'{i}" pipe,"a\n{i}"' for i in range(60)]) + "\n"
    got = read(spark, write(tmp_path / "q.csv", data), number_rows=True).orderBy("_row").collect()
    assert [tuple(r)[:2] for r in got[:2]] == [('5" pipe', "x"), ("y", "two\nlines")]
    assert [tuple(r) for r in got[4:]] == [(f'{i}" pipe', f"a\n{i}", 4 + i) for i in range(60)]


@pytest.mark.parametrize("body", ['a,b\n1,2\n3,"open\n5,6\n', 'a,b\n1,"x\ny"\n2,"z""\n', 'a\n"x\n', '"a,b\n1,2\n'])
@pytest.mark.parametrize("expected", [None, True])
def test_a_quote_that_is_never_closed_fails(spark, tmp_path, small_splits, body, expected):
    with pytest.raises(ExtractionError, match="never closed"):
        DelimitedSource(spark, write(tmp_path / "o.csv", body), multi_line=expected).extract()


def test_a_field_longer_than_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}" for i in range(300))
    path = write(tmp_path / "l.csv", f'a,b\n1,"{long}"\n2,"{long}x"\n3,y\n')
    got = read(spark, path, number_rows=True).orderBy("_row").collect()
    assert [tuple(r) for r in got] == [("1", long, 0), ("2", long + "x", 1), ("3", "y", 2)]


def test_records_with_line_breaks_fail_like_others(spark, tmp_path, small_splits):
    path = write(tmp_path / "l.csv", 'a,b\n1,"x\ny"\n1,2,"3\n4"\n')
    with pytest.raises(ExtractionError, match="Expected 2 fields"):
        DelimitedSource(spark, path).extract(verify=True)
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder / "p1.csv", 'a,b\n1,"2\n"\n')
    write(folder / "p2.csv", 'b,a\n3,"4\n"\n')
    with pytest.raises(ExtractionError, match="another header"):
        DelimitedSource(spark, str(folder)).extract(verify=True)


def test_rows_without_line_breaks_are_numbered(spark, tmp_path, small_splits):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, start in (("b", 100), ("a", 0), ("c", 200)):
        write(folder / f"{name}.csv", "n,v\n" + "".join(f"{i},x\n\n" for i in range(start, start + 100)))
    for expected in (False, None):
        df = read(spark, str(folder), multi_line=expected, number_rows=True)
        assert df.rdd.getNumPartitions() > 4
        assert [(int(r.n), r._row) for r in df.orderBy("_row").collect()] == [(i, i) for i in range(300)]


def test_numbers_are_refused_when_splits_changed(spark, tmp_path, small_splits):
    df = read(spark, write(tmp_path / "n.csv", "n\n" + "".join(f"{i}\n" for i in range(200))), multi_line=False, number_rows=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "411")
    spark.conf.set("spark.sql.files.openCostInBytes", "411")
    with pytest.raises(PySparkException, match="splits|split sizes"):
        df.collect()


def test_line_break_in_the_only_column(spark, tmp_path):
    path = write(tmp_path / "one.csv", 'a\n"x\ny"\nz\n')
    assert rows(read(spark, path)) == [("x\ny",), ("z",)]


def test_a_long_file_of_one_column_is_split(spark, tmp_path):
    path = write(tmp_path / "one.csv", "a\n" + "".join(f"value {i}\n" for i in range(60_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = read(spark, path)
        assert df.rdd.getNumPartitions() > 4 and df.distinct().count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_leading_zeros_stay(spark, tmp_path):
    assert rows(read(spark, write(tmp_path / "z.csv", "id\n001\n"))) == [("001",)]


def test_short_row_is_padded(spark, tmp_path):
    df = read(spark, write(tmp_path / "s.csv", 'a,b,c\n1,2,3\n4\n5,"x,""y"\n'))
    assert rows(df) == [("1", "2", "3"), ("4", None, None), ("5", 'x,"y', None)]


@pytest.mark.parametrize("line", ["1,2,3", "1,2,", '1,2,"x,y"', "1,2,3,4,5", ",,"])
def test_long_row_fails_the_read(spark, tmp_path, line):
    path = write(tmp_path / "l.csv", f"a,b\n1,2\n{line}\n")
    with pytest.raises(ExtractionError, match="Expected 2 fields"):
        DelimitedSource(spark, path).extract(verify=True)
    with pytest.raises(PySparkException, match="Expected 2 fields"):
        DelimitedSource(spark, path).extract().collect()


def test_later_filters_do_not_hide_a_long_row(spark, tmp_path):
    path = write(tmp_path / "l.csv", "a,b\n1,2\n,x,y\n")
    df = DelimitedSource(spark, path).extract().where("a is not null and b = '2'")
    with pytest.raises(PySparkException, match="Expected 2 fields"):
        df.collect()


def test_folder_of_files_with_one_header(spark, tmp_path):
    folder = tmp_path / "orders.csv"
    folder.mkdir()
    write(folder / "p1.csv", "a,b\n1,2\n")
    write(folder / "p2.csv", "a,b\n3,4\n")
    df = DelimitedSource(spark, str(folder)).extract()
    assert rows(df.select("a", "b", "_source")) == [("1", "2", "orders"), ("3", "4", "orders")]


def test_folder_with_another_header_fails(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder / "p1.csv", "a,b\n1,2\n")
    write(folder / "p2.csv", "b,a\n3,4\n")
    with pytest.raises(ExtractionError):
        DelimitedSource(spark, str(folder)).extract(verify=True)


def test_dates(spark, tmp_path):
    path = write(tmp_path / "d.csv", "id,day\n1,2024-01-05 10:30:00\n2,2024-01-06\n3,soon\n4,\n")
    df = read(spark, path, parse_dates=["day"])
    assert rows(df) == [
        ("1", datetime(2024, 1, 5, 10, 30), None),
        ("2", datetime(2024, 1, 6), None),
        ("3", None, "soon"),
        ("4", None, None),
    ]


DATES = {
    "2024-01-05": "2024-01-05 00:00:00",
    "2024-01-05 10:30:00": "2024-01-05 10:30:00",
    "2024-01-05T10:30:00+02:00": "2024-01-05 08:30:00",
    "2024-01-05T10:30:00Z": "2024-01-05 10:30:00",
    "2024/01/05": "2024-01-05 00:00:00",
    "2024/1/5 9:07": "2024-01-05 09:07:00",
    "20240105": "2024-01-05 00:00:00",
    "Jan 5 2024": "2024-01-05 00:00:00",
    "Jan 5, 2024": "2024-01-05 00:00:00",
    "5 January 2024": "2024-01-05 00:00:00",
    "13/01/2024": None,
    "2024-13-05": None,
    "soon": None,
}


@pytest.mark.parametrize("day_first", [False, True])
def test_date_formats(spark, tmp_path, day_first):
    """Numbers alone are read in one order for all rows, so 13/01 is no date if the month comes first."""
    want = dict(DATES) | {"01/05/2024": "2024-05-01 00:00:00" if day_first else "2024-01-05 00:00:00"}
    if day_first:
        want["13/01/2024"] = "2024-01-13 00:00:00"
    lines = "".join(f'"{d}","{d}"\n' for d in want)
    path = write(tmp_path / "d.csv", "k,d\n" + lines)
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            df = DelimitedSource(spark, path, parse_dates=["d"], day_first=day_first).extract()
            got = {r.k: (str(r.d) if r.d else None, r._unparsed_d) for r in df.collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == {k: (v, None if v else k) for k, v in want.items()}


def test_given_date_formats(spark, tmp_path):
    path = write(tmp_path / "d.csv", "d,e\n05.01.24,2024|01\n")
    formats = {"d": ["dd.MM.yy"], "e": ["yyyy|MM"]}
    row = DelimitedSource(spark, path, parse_dates=["d", "e"], date_formats=formats).extract().first()
    assert (str(row.d), str(row.e)) == ("2024-01-05 00:00:00", "2024-01-01 00:00:00")


def test_inferred_types(spark, tmp_path):
    path = write(
        tmp_path / "i.csv",
        "n,x,b,s,e,day\n1,1.5,True,a1,,2024-01-01\n-2,2,False,3,,2024-01-02\n,,,x,,\n",
    )
    df = DelimitedSource(spark, path, parse_dates=["day"], infer_types=True).extract()
    assert dict(df.dtypes) == {
        "n": "bigint", "x": "double", "b": "boolean", "s": "string", "e": "string",
        "day": "timestamp_ntz", "_unparsed_day": "string",
        "_loaded_at": "timestamp_ntz", "_source": "string",
    }


def test_required_columns(spark):
    class Own(Source):
        def extract(self):
            return self.add_metadata(spark.range(1))

    source, df = Own("own"), spark.createDataFrame([(1, 2)], "col1 int, col2 int")
    assert source.validate_schema(df, ["col1", "col2"]) is True
    with pytest.raises(ValueError, match="col3"):
        source.validate_schema(df, ["col1", "col3"])
    assert source.extract().columns == ["id", "_loaded_at", "_source"]
    with pytest.raises(TypeError):
        Source("no extract")


def pages(folder, *bodies):
    folder.mkdir()
    for i, body in enumerate(bodies):
        (folder / f"{i}.json").write_text(json.dumps(body, indent=1))
    return str(folder)


def records(df):
    return sorted(
        (json.dumps(r.asDict(), default=str) for r in df.drop("_loaded_at", "_source").collect())
    )


def test_pages_with_data_key(spark, tmp_path):
    path = pages(
        tmp_path / "p",
        {"data": [{"id": 1, "a": "x"}, {"id": 2}], "next": "u"},
        {"data": [{"id": 3, "b": 1.5}], "next": None},
        {"message": "no data here"},
        {"data": []},
    )
    df = JsonPagesSource(spark, path, "api", data_key="data").extract()
    assert set(df.columns) == {"id", "a", "b", "_loaded_at", "_source"}
    got = {r["id"]: (r["a"], r["b"], r["_source"]) for r in df.collect()}
    assert got == {1: ("x", None, "api"), 2: (None, None, "api"), 3: (None, 1.5, "api")}


def nested(generator, depth=0):
    kind = generator.choice(["text", "number", "list", "object", "null"] if depth < 3 else ["text", "number"])
    if kind == "text":
        return "".join(generator.choices([*'ab{}[]",:\\\n', "data", "é"], k=generator.randrange(12)))
    if kind == "list":
        return [nested(generator, depth + 1) for _ in range(generator.randrange(4))]
    if kind == "object":
        return {generator.choice(["data", "x}", '"y"', "z"]): nested(generator, depth + 1) for _ in range(generator.randrange(4))}
    return generator.randrange(1000) if kind == "number" else None


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("key", ["data", None])
def test_large_pages_are_read_in_splits(spark, tmp_path, small_splits, indent, key):
    """Records with braces, brackets, quotes and other lists in them, from several pages, as the json module reads them."""
    generator = random.Random(5)
    folder, want = tmp_path / "pages", []
    folder.mkdir()
    for page in range(4):
        records = [{"id": 100 * page + i, "body": json.dumps(nested(generator)), "more": {"data": [{"n": i}], "}": "]"}} for i in range(25)]
        body = records if key is None else {"before": [{"id": -1}], "data": records, "after": {"data": [{"id": -2}]}, "end": "}]"}
        (folder / f"{page}.json").write_text(json.dumps(body, indent=indent, ensure_ascii=page % 2 == 0) + ("\n" if page % 2 else ""))
        want += records
    (folder / "none.json").write_text('{"data": []}' if key else "[]")
    if key is None:
        (folder / "one.json").write_text('{"id": 999, "body": "alone", "more": {}}')
        want.append({"id": 999, "body": "alone", "more": {}})
    source = JsonPagesSource(spark, str(folder), "api", data_key=key, record_schema=StructType().add("id", "long").add("body", "string"))
    raw = spark.read.option("lineSep", "}").text(str(folder))
    assert raw.rdd.getNumPartitions() > 4
    got = source.extract().select("id", "body").collect()
    assert sorted(map(tuple, got)) == sorted((r["id"], r["body"]) for r in want)
    inferred = JsonPagesSource(spark, str(folder), "api", data_key=key, split_pages=True).extract()
    assert sorted(r.id for r in inferred.collect()) == sorted(r["id"] for r in want)


@pytest.mark.parametrize("body", ['{"data": [{"id": 1}, {"id": 2}', '{"data": [{"id": "1}]}', '[{"id": 1}}]', '{"data": [{"id": 1]}'])
def test_broken_pages_read_in_splits(spark, tmp_path, body):
    (tmp_path / "bad.json").write_text(body)
    with pytest.raises(ExtractionError, match="broken page"):
        JsonPagesSource(spark, str(tmp_path / "bad.json"), "api", data_key="data", split_pages=True).extract()


@pytest.mark.parametrize("body", [{"other": 1}, {"data": []}])
def test_no_records_in_splits(spark, tmp_path, body):
    df = JsonPagesSource(spark, pages(tmp_path / "p", body), "api", data_key="data", split_pages=True).extract()
    assert df.columns == ["_loaded_at", "_source"] and df.count() == 0


def test_pages_that_are_lists_or_objects(spark, tmp_path):
    path = pages(tmp_path / "p", [{"id": 1}, {"id": 2}], {"id": 3})
    df = JsonPagesSource(spark, path, "api").extract()
    assert sorted(r["id"] for r in df.collect()) == [1, 2, 3]


@pytest.mark.parametrize("body", [{"other": 1}, {"data": []}])
def test_no_records(spark, tmp_path, body):
    df = JsonPagesSource(spark, pages(tmp_path / "p", body), "api", data_key="data").extract()
    assert df.columns == ["_loaded_at", "_source"] and df.count() == 0


def test_pages_with_given_schema_and_page_per_line(spark, tmp_path):
    from pyspark.sql.types import StructType

    path = tmp_path / "lines.json"
    path.write_text('{"data": [{"id": 1}, {"id": 2}]}\n{"data": [{"id": 3, "more": 1}]}\n{}\n')
    schema = StructType().add("id", "integer").add("name", "string")
    df = JsonPagesSource(
        spark, str(path), "api", data_key="data", record_schema=schema, page_per_line=True
    ).extract()
    assert rows(df.select("id", "name")) == [(1, None), (2, None), (3, None)]


@pytest.mark.parametrize("body", [{"data": 5}, {"data": ["text"]}])
def test_pages_without_records_under_key(spark, tmp_path, body):
    with pytest.raises(ExtractionError):
        JsonPagesSource(spark, pages(tmp_path / "p", body), "api", data_key="data").extract()


def test_broken_or_missing_pages(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{ not json")
    with pytest.raises(ExtractionError):
        JsonPagesSource(spark, str(tmp_path / "bad.json"), "api").extract()
    with pytest.raises(ExtractionError):
        JsonPagesSource(spark, str(tmp_path / "none"), "api").extract()


def test_random_files_against_the_csv_module(spark, tmp_path):
    """Fields with quotes, delimiters, spaces and line breaks come back as they were written."""
    generator = random.Random(7)
    letters = [*'ab,"\n \t\\é#;0\'', "NA", "日"]
    for case in range(16):
        multi_line = case % 2 == 0
        usable = letters if multi_line else [c for c in letters if c != "\n"]
        width = generator.randint(2, 4)
        data = [
            ["".join(generator.choices(usable, k=generator.randint(0, 5))) for _ in range(width)]
            for _ in range(40)
        ]
        text = io.StringIO()
        quoting = csv.QUOTE_ALL if case % 4 < 2 else csv.QUOTE_MINIMAL
        writer = csv.writer(text, lineterminator="\n", quoting=quoting)
        writer.writerows([[f"c{i}" for i in range(width)], *data])
        path = write(tmp_path / f"{case}.csv", text.getvalue())
        expected = [tuple(None if v in NULL_TOKENS else v for v in row) for row in data]
        assert rows(read(spark, path, multi_line=multi_line)) == sorted(expected, key=repr)


def test_broken_page_with_given_schema_fails_on_verify(spark, tmp_path):
    schema = StructType().add("a", "string")
    (tmp_path / "p.json").write_text('{"data": [{"a": ')
    source = JsonPagesSource(spark, str(tmp_path / "p.json"), "api", data_key="data", record_schema=schema)
    source.extract()
    with pytest.raises(ExtractionError, match="cannot be read"):
        source.extract(verify=True)


def test_large_pages_are_cut_once(spark, tmp_path, monkeypatch):
    """One pass gives whole records and parts of those that cross splits."""
    page, seen = tmp_path / "pages", tmp_path / "seen"
    page.mkdir()
    seen.mkdir()
    records = [{"n": i, "t": "x" * (i % 300)} for i in range(4000)]
    (page / "one.json").write_text(json.dumps(records))
    cut = json_splits._records

    def noted(*args):
        def noting(batches):
            (seen / uuid.uuid4().hex).touch()
            yield from cut(*args)(batches)

        return noting

    monkeypatch.setattr(json_splits, "_records", noted)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        got = JsonPagesSource(spark, str(page), "s", split_pages=True).extract().select("n", "t").collect()
        splits = spark.read.text(str(page)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got)) == sorted((r["n"], r["t"]) for r in records)
    assert splits > 1 and len(list(seen.iterdir())) == splits


@pytest.mark.parametrize("key", [None, "data"])
def test_flat_pieces_change_nothing(key):
    pieces = [
        '[{"a": 1', ',{"a": "x", "b": 2', ',{"a": "x", "b": 3', ', {"a": "[", "b": 3', ',{"a": {"b": 1', "", '",{"a":"', ' "k": "v", {"x": 1',
        ',{"data": 1', ',{"a": "q\\"{"', ",{", "{{", ',{"a": "{"',
    ]
    found = json_splits.flat(pa.array(pieces), key).tolist()
    assert found[1:3] == [True, True] and found[10]
    for piece, is_flat in zip(pieces, found, strict=True):
        if is_flat:
            for inside in (False, True):
                at, ends = json_splits.tokens(piece, inside, key)
                assert (ends, [k for _, k in at]) == (inside, [] if inside else ["O"])


def test_offsets_are_searched_in_marked_moments_only(spark):
    """The look at the end of the text changes no moment, and comes before the search."""
    bodies = ["2024-01-05 10:30", "2024-01-05T1:30:00", "2024-01-05 10:30:00.123456", "2024-01-05", "5 10:30", "1/5/2024 10:30", "Jan 5, 2024", ""]
    ends = ["", "Z", " Z", "UTC", " UTC", "+1", "-1", "+01", "-05:30", " +0530", "+01:00:00", "C", "-", "\u00e9Z"]
    texts = [body + end + line for body in bodies for end in ends for line in ("", "\n", "\r\n")]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(2)
    text, formats = F.col("t"), (*DATE_FORMATS, *MONTH_FIRST)
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz"))
    iso = F.when(text.rlike(_WITH_OFFSET), utc).otherwise(text.try_cast("timestamp_ntz"))
    plain = F.coalesce(iso, *(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats))
    found = df.select("t", _moment(text, formats).alias("found"), plain.alias("plain"))
    assert found.where(text.rlike(_WITH_OFFSET)).count() > 50
    assert [r for r in found.collect() if r.found != r.plain] == []
    plan = found.select("found")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Contains(") < plan.index("RLIKE")
