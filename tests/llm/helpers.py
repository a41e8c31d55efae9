"""Small tables for the operators of the training-data subpackage."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS):
    """Rows of (doc_id, text, ...), filled up with nulls."""
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def clashing(df):
    """The table with extra columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    names = ["key", "body", "node", "token", "gram", "n", "words", "rank", "score", "spans", "base", "root", "hits"]
    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


def by(df, key, *columns):
    return {row[key]: tuple(row[c] for c in columns) if len(columns) > 1 else row[columns[0]] for row in df.collect()}
