"""Service months from table grids: headers, merged cells, repeats, texts as fallback."""

import datetime

from pyspark.sql import functions as F
from quillmark.operators import grids

GRID = "doc int, page int, table int, row int, cells array<string>"
HEAD = ["Ship", None, "Sign", "on"]


def months(spark, grid, pages):
    g = spark.createDataFrame(grid, GRID)
    p = spark.createDataFrame(pages, "doc int, page int, text string")
    return {r.doc: (r.n_periods, r.text_page, r.months) for r in grids.service_months(g, p, "doc", F.lit("2024-06-01").cast("date")).collect()}


def days(a, b):
    return (datetime.date(*b) - datetime.date(*a)).days // 30


def test_tables(spark):
    row = ["A", "01/02/2020", None, "01/08/2020"]
    grid = [(1, 0, 0, 0, HEAD), (1, 0, 0, 1, row), (1, 1, 0, 0, HEAD), (1, 1, 0, 1, row)]  # the table repeats
    grid += [(2, 0, 0, 0, ["Skill", "Level"]), (2, 0, 0, 1, row)]  # no service
    grid += [(3, 0, 0, 0, ["x 01/02/2020 01/08/2020 vessel"])]  # one row alone
    grid += [(4, 0, 0, 0, ["Skill"]), (4, 0, 0, 1, ["RANK 01/01/2019", "01/03/2019"]), (4, 0, 0, 2, ["31/02/2020 01/03/2020", "01/04/2020 01/05/2020 01/06/2020"]), (4, 0, 0, 3, None), (4, 0, 0, 4, ["01/01/2019 01/01/2024", "01/01/2004 01/01/2006"])]
    got = months(spark, grid, [(5, 0, None)])
    assert got == {1: (1, None, days((2020, 2, 1), (2020, 8, 1))), 2: (0, None, 0), 3: (0, None, 0), 4: (2, None, days((2019, 1, 1), (2019, 3, 1)) + days((2020, 4, 1), (2020, 5, 1))), 5: (0, None, 0)}


def test_text_counts_only_before_tables(spark):
    row = ["01/02/2020", "01/08/2020"]
    grid = [(1, 1, 0, 0, HEAD), (1, 1, 0, 1, row), (2, 0, 0, 0, HEAD), (2, 0, 0, 1, row), (3, 0, 0, 0, HEAD), (3, 0, 0, 1, ["none"])]
    pages = [(1, 0, "Mate 01/2010 - 01/2011"), (1, 1, "Mate 01/2012 - 01/2013"), (2, 0, "01/2010 - 01/2011"), (2, 1, "01/2010 - 01/2011"), (3, 0, "no dates"), (3, 1, "cdc 01/2015 - 01/2016\nonly 03/2015 and 01/2015"), (3, 2, "01/2010 - 01/2011")]
    pages += [(4, 0, "01/2022 – Present\n2020-01-01 - 2021-01-01"), (4, 1, "01/2000 - 01/2001")]
    got = months(spark, grid, pages)
    assert got[1] == (2, 0, days((2010, 1, 1), (2011, 1, 1)) + days((2020, 2, 1), (2020, 8, 1)))
    assert got[2] == (1, None, days((2020, 2, 1), (2020, 8, 1)))
    assert got[3] == (1, 1, days((2015, 3, 1), (2016, 1, 1)))  # no line of service: its dates two by two
    assert got[4] == (1, 0, days((2022, 1, 1), (2024, 6, 1)))
    assert months(spark, [], []) == {}
