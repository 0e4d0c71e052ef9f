DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, texts, langs=None, sources=None, first=0):
    """Documents with ids from ``first``; a text may be None."""
    rows = [(first + i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def by_id(df):
    return {r["doc_id"]: r.asDict(recursive=True) for r in df.collect()}
