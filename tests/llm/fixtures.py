"""Small tables with awkward rows."""

LONG = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. " * 3000
PROSE = [f"the quick brown fox number {i} jumps over the lazy dog while the sun sets on hill {i * 7} and people walk home slowly" for i in range(8)]
ROWS = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n ", None), (4, "one two three", "en"), (5, LONG, "en"), (6, PROSE[0], "en"), (7, PROSE[0], "en"), (7, PROSE[0], "en"),
    (8, PROSE[1] + " Ünïcödé ß 日本語 \U0001f600 é", None), (9, PROSE[2] + " extra words at the end", "de"), (10, PROSE[2] + " extra words at the very end", "de"), (None, PROSE[3], "en"),
]


def docs(spark, rows=ROWS):
    """Documents with extra columns whose names the operators use themselves."""
    data = [(i, t, lang, "src", len(t or ""), 0.5, "x", [1], 7) for i, t, lang in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, ids array<int>, n long")


def empty(spark):
    return docs(spark).limit(0)


def labels(spark, n=400, column="quality"):
    return spark.createDataFrame([(i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
