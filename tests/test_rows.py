"""Rows that fail to parse, against a state machine."""

from __future__ import annotations

import random

from conftest import rows

from loomtext.operators.rows import HEADER, parse_records, split_records


def machine(raw):
    """(reason or None, fields) by reading character by character."""
    if raw is None:
        return "column_count", None
    s = raw[:-1] if raw.endswith("\r") else raw
    fields, i = [], 0
    while True:
        if s[i : i + 1] == '"':
            i, held = i + 1, ""
            while True:
                j = s.find('"', i)
                if j < 0:
                    return "quoting", None
                held += s[i:j]
                if s[j + 1 : j + 2] == '"':
                    held, i = held + '"', j + 2
                else:
                    i = j + 1
                    break
            if i < len(s) and s[i] != ",":
                return "quoting", None
            fields.append(held)
        else:
            j = s.find(",", i)
            j = len(s) if j < 0 else j
            if '"' in s[i:j]:
                return "quoting", None
            fields.append(s[i:j] or None)
            i = j
        if i >= len(s):
            break
        i += 1
    if len(fields) != 6:
        return "column_count", fields
    bad = any(c == "�" or (c < " " and c not in "\t\n") or "\x7f" <= c <= "\x9f" for f in fields[2:4] if f for c in f)
    pmid, year = fields[0] or "", fields[5] or ""
    if not (pmid.isascii() and pmid.isdigit() and len(pmid) <= 8) or not (year.isascii() and year.isdigit() and len(year) == 4 and year[:2] in ("19", "20")) or bad:
        return "value", fields
    return None, fields


SOUND = '12,"a ""t""","x,y\nz",,J,1999'
CASES = [None, "", "\r", SOUND, SOUND + "\r", SOUND + "\r\r", '1,a,b,c,d,2001"', '1,"a,b,c,d,2001', '1,"a"b,c,d,e,2001', '1,a"b",c,d,e,2001', "1,a,b,c,d", "1,a,b,c,d,e,f", "x,a,b,c,d,2001", "1,a,b\x01\x03,c,d,2001",
         "1,a\x01\x02,b,c,d,2001", "1,a,b�,c,d,2001", "1,a,b,c\x85,d,2001", "1,a,b,c,d,2101", '"1","","","","","2001"', '""""', '"",""', "1,a,b,c,d,2001\n", "123456789,a,b,c,d,2001", '1,a,"' + "long " * 50000 + '",c,d,2001', '1,"' + '""' * 5000 + '",b,c,d,2001']


def test_against_machine(spark):
    rnd = random.Random(3)
    raws = CASES + ["".join(rnd.choice('",,""ab1\n\r') for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(raws)), "record_id long, raw string")
    got = {r.record_id: r for r in parse_records(df).collect()}
    for i, raw in enumerate(raws):
        reason, fields = machine(raw)
        assert (got[i].errors[0].reason if got[i].errors else None) == reason, (raw, got[i].errors, reason)
        if reason is None:
            assert list(got[i].fields) == fields, raw


def test_every_rule_that_fails_is_told(spark):
    raws = ["x,t,a\x01,b\ufffd,j,99", "+5,t,a,b,j,2001", "123456789,t,a,b,j,1850", '"',  "1,2", " 7,t,,,j,"]
    got = [[(e.field, e.rule) for e in r.errors] for r in parse_records(spark.createDataFrame(list(enumerate(raws)), "i int, raw string")).orderBy("i").collect()]
    form, year = "not 1 to 8 digits", "no year of 19.. or 20.."
    assert got == [
        [("pmid", "no long"), ("year", year), ("abstract", "broken characters"), ("specific aims", "broken characters")],
        [("pmid", form)], [("pmid", form), ("year", year)], [(None, "quotes out of place")], [(None, "not 6 fields")], [("pmid", form), ("year", "no int")],
    ]


def test_split_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "own", SOUND, 7), (2, None, "1,2", None)], "record_id long, title string, raw string, extra int")
    good, bad = split_records(df)
    assert rows(good) == [(1, "own", 7, 12, 'a "t"', "x,y\nz", None, "J", 1999)]
    assert good.columns == ["record_id", "title", "extra", "pmid", "field_title", "abstract", "specific_aims", "journal", "year"]
    assert rows(bad) == [(2, None, None, "1,2", "column_count", [("column_count", None, "not 6 fields")])]
    clash = df.withColumnRenamed("extra", "errors").withColumnRenamed("title", "Reason")
    assert parse_records(clash).columns == ["record_id", "Reason", "raw", "errors", "fields", "parsed_errors"]
    assert split_records(clash)[1].columns == ["record_id", "Reason", "errors", "raw", "row_reason", "row_errors"]
    good, bad = split_records(df.limit(0))
    assert good.count() == bad.count() == 0
    assert len(HEADER) == 6
