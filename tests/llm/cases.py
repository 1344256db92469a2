"""Documents with everything that may go wrong, and extra columns with names that operators use themselves."""

from pyspark.sql import functions as F

CLASHING = ("id", "rid", "rep", "n", "size", "side", "text_", "terms", "copies", "taken", "members", "bands", "grade", "held", "host", "token", "_keep", "base", "component_id", "kept", "_text", "_spans", "_rid", "weight", "unit", "at", "file", "dir", "licence")
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a"),  # a copy
    (3, "Alpha  BETA gamma\tdelta epsilon\nzeta eta theta iota kappa", "en", "b"),  # the same words
    (4, "alpha beta gamma delta epsilon zeta eta theta iota lambda", "en", None),
    (5, "", "en", "b"),
    (6, None, "en", "b"),
    (7, " \t\n ", None, "b"),
    (8, "one two", "en", "c"),
    (9, "one two", "en", "c"),
    (10, LONG, "en", "c"),
    (11, LONG + " end", "en", "c"),
    (12, "a" * 200_000, "en", "c"),
    (13, "😀 ünï çödé 😀 Ünï", "fr", "é"),
    (13, "😀 ünï çödé 😀 Ünï", "fr", "é"),  # a repeated row
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a"),
    (None, None, None, None),
]


def documents(spark, tmp_path, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    if extra:
        df = df.withColumns({c: F.lit("x") for c in CLASHING})
    path = f"{tmp_path}/documents"
    df.repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def words(text):
    import re

    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", lower)
