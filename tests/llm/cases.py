"""Documents with every oddity that operators have to take: nulls, empty and long texts, ties, repeats, clashing names."""

import duckdb

LONG = "\n".join(f"word{i} and word{i * 7 % 1000} follow the line number {i} of it." for i in range(4000))
BASE = "The quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing about the coming rain today."
ROWS = [
    (1, BASE, "en", "a", 10), (2, BASE, "en", "a", 10), (3, None, "en", "b", None), (4, "", None, None, 0), (5, "", "en", None, 0), (6, LONG, "en", "b", len(LONG)), (7, "   \n\t\n ", "fr", "c", 5),
    (8, BASE.replace("seven", "eight").replace("rain", "snow"), "en", "a", 9), (None, BASE, "en", "a", 1), (None, None, None, None, None), (9, "Short.", "en", "a", 6), (9, "Short.", "en", "a", 6),
    (10, "Élan vital über straße 日本語 😀 emoji text", "fr", "c", 1), (11, BASE + "\n" + "Another line that is long enough to count as a passage here.", "en", "a", 1), (12, "Another line that is long enough to count as a passage here.\nUnique tail of twelve.", "en", "a", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that clash with names that operators use inside.
EXTRA = ("Keep", "score", "words", "rank", "key", "sig", "n", "place", "ids", "language", "toxic", "text_", "__g", "band")


def documents(spark, rows=None, extra=False):
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    for c in EXTRA if extra else ():
        df = df.selectExpr("*", f"'x' AS `{c}`")
    return df


def rows_of(df):
    """Rows as sorted tuples of text, columns in order of name."""
    cols = sorted(df.columns)
    return sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect())


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"t_{name}", df.toArrow())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM t_{name}")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    return sorted(tuple(str(v) for v in r) for r in con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({sql}) z").fetchall())
