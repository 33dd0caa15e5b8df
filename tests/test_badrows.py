import csv
from datetime import datetime

import pytest

from kinfold.operators.badrows import BadRecord, FIELDS, failed_records, parse_records, split_record, typed_record, valid_records

H = "0123456789abcdef0123456789abcdef01234567"
OK = f"r,n,a@b.c,{H},2020-01-01T00:00:00Z"

CASES = {
    OK: None, f'"r","n, ""x""",a@b.c,{H},2020-01-01T00:00:00Z': None, f" r , n , a@b.c , {H} , 2020-01-01T00:00:00.25+05:30 ": None,
    f'r,n"x",a@b.c,{H},t': "quoting", f'r,"n"x,a@b.c,{H},t': "quoting", f'r,"n,a@b.c,{H},t': "quoting", f'r, "n",a@b.c,{H},t': "quoting", '"': "quoting", '"a"b': "quoting",
    None: "columns", "": "columns", "a,b": "columns", OK + ",": "columns", '""': "columns", " ": "columns", ",,,": "columns",
    f"r,n,ab.c,{H},2020-01-01T00:00:00Z": "value", f"r, ,a@b.c,{H},2020-01-01T00:00:00Z": "value", f"r,n,a@b@c,{H},2020-01-01T00:00:00Z": "value",
    f"r,n,a b@c,{H},2020-01-01T00:00:00Z": "value", f"r,n,@c,{H},2020-01-01T00:00:00Z": "value", f"r,{'n' * 51},a@b.c,{H},2020-01-01T00:00:00Z": "value",
    f"r,{'é' * 50},a@b.c,{H},2020-01-01T00:00:00Z": None, f"r,n\ufffd,a@b.c,{H},2020-01-01T00:00:00Z": "value", f'r,"n\nx",a@b.c,{H},2020-01-01T00:00:00Z': "value",
    f"r,n\rx,a@b.c,{H},2020-01-01T00:00:00Z": "value", f"r,n\x7f,a@b.c,{H},2020-01-01T00:00:00Z": "value", f"r,n,a@b.c,{H.upper()},2020-01-01T00:00:00Z": "value",
    f"r,n,a@b.c,{H}0,2020-01-01T00:00:00Z": "value", f"r,n,a@b.c,{H},2020-02-30T00:00:00Z": "value", f"r,n,a@b.c,{H},2020-01-01 00:00:00Z": "value",
    f"r,n,a@b.c,{H},2020-01-01T00:00Z": "value", f"r,n,a@b.c,{H},2020-01-01T00:00:00": "value", f"r,n,a@b.c,{H},2020-01-01T24:00:00Z": "value",
    f"r,n,a@b.c,{H},2020-01-01T00:00:00+24:00": "value", f"r,n,a@b.c,{H},": "value", ",,,,": "value", f"r,n,a@b.c,{H},0001-01-01T00:00:00+01:00": "value",
}


@pytest.mark.parametrize("line", list(CASES), ids=range(len(CASES)))
def test_reason(line):
    try:
        typed_record(split_record(line))
        reason = None
    except BadRecord as e:
        reason = str(e)
    assert reason == CASES[line]


def letter_by_letter(line):
    """The rules without the reader: fields, or None where the quoting is wrong."""
    fields, field, state = [], "", "start"
    for c in line:
        if state == "quoted":
            field, state = (field, "closed") if c == '"' else (field + c, state)
        elif state == "closed" and c == '"':
            field, state = field + c, "quoted"
        elif c == ",":
            fields, field, state = [*fields, field], "", "start"
        elif state == "start" and c == '"':
            state = "quoted"
        elif state == "closed" or c == '"':
            return None
        else:
            field, state = field + c, "plain"
    return None if state == "quoted" else [*fields, field]


@pytest.mark.parametrize("line", [*[c for c in CASES if c], '"r\ue000\r",n\n\ue001,a,"b""\n",c', "".join(map(chr, range(0xE000, 0xF900))) + "\n,\r,c,d,e"])
def test_reader_agrees_with_the_rules_letter_by_letter(line):
    def split(f):
        try:
            return f(line)
        except BadRecord as e:
            return str(e)

    fast, slow = split(split_record), letter_by_letter(line)
    assert fast == ("quoting" if slow is None else slow if len(slow) == 5 else "columns")


@pytest.mark.parametrize("line", [OK, OK.replace("n,", "n\n,"), ",,,,"])
def test_records_without_quotes_go_through_the_reader(monkeypatch, line):
    read, reader = [], csv.reader
    monkeypatch.setattr(csv, "reader", lambda rows, strict: read.append(strict) or reader(rows, strict=strict))
    assert split_record(line) == line.split(",") and read == [True]


def test_private_characters_survive():
    assert split_record('"r\ue00a",n\n\ue00d,a,b,c')[:2] == ["r\ue00a", "n\n\ue00d"]


def test_frame(spark):
    rows = [(i, line, "clash", "clash") for i, line in enumerate([*CASES, OK, "x" * 300_000, OK.replace("r,", '"' + "y" * 200_000 + '",', 1)])]
    df = spark.createDataFrame(rows, "line_id long, raw_line string, reason string, commit_author_name string")
    got = {r.line_id: r.reason for r in parse_records(df).collect()}
    want = dict(enumerate([*CASES.values(), None, "columns", "value"]))
    assert got == want
    assert {r.line_id for r in failed_records(df).collect()} == {i for i, r in want.items() if r}
    valid = {r.line_id: r for r in valid_records(df).collect()}
    assert valid[0].commit_author_when == datetime(2020, 1, 1) and valid[1].commit_author_name == 'n, "x"'
    assert valid[2].commit_author_name == " n " and valid[2].commit_author_when == datetime(2019, 12, 31, 18, 30, 0, 250000)
    assert valid_records(df).columns == ["line_id", *FIELDS]


def test_empty(spark):
    df = spark.createDataFrame([], "line_id long, raw_line string")
    assert parse_records(df).collect() == []
