"""Small document tables with every awkward case."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, langs=None, ids=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t) if t else 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clash(df):
    """df with extra columns that have the names that operators use inside."""
    from pyspark.sql import functions as F

    for name in ("size", "h", "slice", "words", "pos", "seed", "node", "doc", "alt", "packed", "whole", "c", "rows", "n", "media", "signature", "start"):
        df = df.withColumn(name, F.lit("x"))
    return df
