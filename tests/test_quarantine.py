import datetime
import random
import re
from decimal import Decimal, InvalidOperation

import pytest

from graphloom.operators.quarantine import loaded_lines, parse_edge_lines, rejected_lines


def brute(line):
    """(reason, fields) by a character scanner."""
    if line is None:
        return "columns", None
    if line.endswith("\r"):
        line = line[:-1]
    fields, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            at += 1
            text = ""
            while True:
                end = line.find('"', at)
                if end < 0:
                    return "quoting", None
                text += line[at:end]
                at = end + 1
                if line[at : at + 1] != '"':
                    break
                text += '"'
                at += 1
            if at < len(line) and line[at] != "\t":
                return "quoting", None
        else:
            end = line.find("\t", at)
            end = len(line) if end < 0 else end
            text = line[at:end]
            if '"' in text:
                return "quoting", None
            at = end
        fields.append(text.strip(" "))
        if at >= len(line):
            break
        at += 1
    if len(fields) != 4:
        return "columns", None
    ok = all(re.fullmatch(r"[A-Za-z]{3}[-:_.][0-9]{9}", f) for f in fields[:2])
    ok = ok and re.fullmatch(r"[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?", fields[2]) is not None
    try:
        ok = ok and Decimal(fields[2]) <= 1
    except InvalidOperation:
        ok = False
    try:
        ok = ok and re.fullmatch(r"\d{4}-\d{2}-\d{2}", fields[3], re.A) is not None
        datetime.date.fromisoformat(fields[3]) if ok else None
    except ValueError:
        ok = False
    return (None, fields) if ok else ("value", None)


V = "abc-123456789"
CASES = [
    None,
    "",
    "\r",
    "--",
    f"{V}\t{V}\t0.5\t2024-02-29",
    f"{V}\t{V}\t0.5\t2023-02-29",
    f"{V}\t{V}\t0.5\t0000-01-01",
    f"{V}\t{V}\t0.5\t2024-02-29\r",
    f"{V}\t{V}\t0.5\t2024-02-29\r\r",
    f"{V}\t{V}\t0.5\t2024-02-29\t",
    f'"{V}"\t" {V} "\t" 1e0 "\t2024-02-29 ',
    f'"{V}" \t{V}\t0.5\t2024-02-29',
    f' "{V}"\t{V}\t0.5\t2024-02-29',
    f'"{V}\t{V}\t0.5\t2024-02-29',
    f'"{V}\t{V}"\t{V}\t0.5\t2024-02-29',
    f'"{V}"x\t{V}\t0.5\t2024-02-29',
    f'{V}"\t{V}\t0.5\t2024-02-29',
    f'"""{V}"""\t{V}\t0.5\t2024-02-29',
    f'"\x01{V}\x01t"\t{V}\t0.5\t2024-02-29',
    f"\x01\t{V}\t0.5\t2024-02-29",
    '"\t"\t""\t""""\t"a""b"',
    *[f"{V}\t{V}\t{s}\t2024-01-01" for s in (
        "1", "0", "1.0", "1.", ".5", "-0", "+1", "1e-3", "10e-1", "1E+0", "2", "1e1", "inf", "nan", "5%", "0x1",
        "1.00000000000000000000001", "0.99999999999999999999999", "10.00000000000000000001e-1", "1e-999", "0e99", "1e99999",
    )],
    "x" * 100_000,
    '"' + '""' * 50_000 + '"',
    '"' * 99_999,
    "\t" * 50_000,
]


def check(spark, lines):
    df = spark.createDataFrame([(i, x, "a", 1.0) for i, x in enumerate(lines)], "id int, raw_line string, errors string, score double")
    parsed = parse_edge_lines(df)
    assert parsed.count() == len(lines)
    bad = {r.id: r.reason for r in rejected_lines(parsed).collect()}
    good = {r.id: (r.vertex1, r.vertex2, r.score, r.seen_on) for r in loaded_lines(parsed).collect()}
    for i, line in enumerate(lines):
        reason, fields = brute(line)
        assert bad.get(i) == reason, repr(line)[:200]
        if reason is None:
            want = (*fields[:2], float(fields[2]), datetime.date.fromisoformat(fields[3]))
            assert good[i] == want
    assert not set(bad) & set(good)


def test_cases(spark):
    check(spark, CASES)


def test_random_lines(spark):
    rng = random.Random(8)
    parts = [V, "\t", "\t", '"', '""', " ", "0.5", "2024-01-01", "\r", "x", "\x01", f'"{V}"', f"{V}\t{V}\t1\t2024-01-01"]
    check(spark, ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)])


def test_empty_table(spark):
    parsed = parse_edge_lines(spark.createDataFrame([], "raw_line string"))
    assert parsed.count() == 0
    with pytest.raises(Exception):
        parse_edge_lines(spark.createDataFrame([], "other string")).count()
