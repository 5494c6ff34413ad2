from collections import Counter

import duckdb

from chronoweave.llm.line_dedup import drop_boilerplate
from chronoweave.llm.queries import SQL, op7_line_dedup


def brute(rows):
    """rows: (host, text). Line by line."""
    pages, seen = Counter(h or "" for h, _ in rows), Counter()
    for h, t in rows:
        seen.update({(h or "", x.strip(" \t\r")) for x in (t or "").split("\n") if x.strip(" \t\r")})
    gone = {k for k, n in seen.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h or "", x.strip(" \t\r")) not in gone) for h, t in rows]


ROWS = [("a", f"menu\nunique {i}\n  menu \t\n\nfooter") for i in range(20)] + [("b", "menu\nx"), (None, "menu"), ("a", None), ("a", ""), ("a", "menu"), ("", "menu")] + [(None, "menu\nq")] * 5


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(ROWS)], "id long, source string, text string")
    df = df.selectExpr("id", "source", "text", "1 as __h", "2 as __keys", "3 as __kept", "4 as `a.b`", "5 as host", "6 as keys", "7 as Lines_In", "8 as c0")
    out = drop_boilerplate(df)
    got = {r.id: r for r in out.collect()}
    assert [got[i].text for i in range(len(ROWS))] == brute(ROWS)
    assert out.columns == ["id", "source", "text", "__h", "__keys", "__kept", "a.b", "host", "keys", "c0", "lines_in", "lines_dropped"]
    assert (got[0]["a.b"], got[0].host, got[0].c0, got[0].lines_in, got[0].lines_dropped) == (4, 5, 8, 5, 3)
    assert drop_boilerplate(df.limit(0)).count() == 0


def test_sql(spark):
    """The query and its SQL on a whole table."""
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.execute(SQL["op7_line_dedup"]).fetchall()
    assert sorted(map(tuple, op7_line_dedup(spark, d).collect()), key=str) == sorted(want, key=str)
