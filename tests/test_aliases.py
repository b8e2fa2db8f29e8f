"""Alias lookup against a search of every alias in every line."""

from __future__ import annotations

import random
import re

import pytest

from reliefgrid.functions.text import REPORT_STATE_ALIASES
from reliefgrid.operators.aliases import with_first_alias


def first_by_hand(line, aliases):
    for alias, name in aliases:
        if line is not None and re.search(rf"(?:^|\W){re.escape(alias)}(?:\W|$)", line, re.IGNORECASE | re.ASCII):
            return name
    return None


def check(spark, lines, aliases):
    table = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string").repartition(3)
    got = {r.line_no: r.found for r in with_first_alias(table, aliases, "found").collect()}
    want = {k: first_by_hand(x, aliases) for k, x in enumerate(lines)}
    assert got == {k: x for k, x in want.items() if x is not None}
    return len(got)


def test_report_states(spark):
    lines = [
        "PULAU PINANG 61.2", "Penang (Pulau  Pinang)", "kuala lumpur/PUTRAJAYA", "KUALA  LUMPUR", "JOHORE", "Johor,Kedah", "_SABAH", "SABAH_",
        "-Sabah-", "é SELANGORé", "", None, "total", "NEGERI SEMBILAN NEGERI", "NEGERI", "perak" * 3,
    ]
    assert check(spark, lines, REPORT_STATE_ALIASES) == 7


@pytest.mark.parametrize("count", [1, 40, 900])
def test_random_lines(spark, count):
    rng = random.Random(count)
    signs = ["a", "B", "b", "c", "1", "_", ".", " ", " ", "-", "(", "é"]

    def text(n):
        return "".join(rng.choice(signs) for _ in range(n))

    aliases = [("w.p. a", "first"), (".", "dot")][:count] + [(text(rng.randrange(1, 7)), f"n{k}") for k in range(count)]
    lines = [text(rng.randrange(0, 14)) for _ in range(400)] + ["W.P. A", "W.P. A.", "xW.P. A", "a " * 5_000 + "b"]
    check(spark, lines, aliases)


def test_no_lines_and_no_aliases(spark):
    table = spark.createDataFrame([], "line_no int, line string")
    assert with_first_alias(table, REPORT_STATE_ALIASES, "found").count() == 0
    lines = spark.createDataFrame([(1, "SABAH"), (1, "SABAH")], "line_no int, line string")
    assert with_first_alias(lines, [], "found").count() == 0
    assert with_first_alias(lines, REPORT_STATE_ALIASES, "found").count() == 1
    with pytest.raises(ValueError):
        with_first_alias(lines, [("", "x")], "found")
