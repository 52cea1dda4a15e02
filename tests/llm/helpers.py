"""Brute-force counterparts and fixtures that several tests share."""

import re
import string

import pandas as pd

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))


def shingles(text, n=5):
    w = words(text)
    return set(zip(*[w[k:] for k in range(n)])) if len(w) >= n else ({tuple(w)} if w else set())


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


# Rows that any operator must bear: nulls, no text, white space only, repeated rows, equal ids, a long word.
ODD_DOCUMENTS = [
    (None, "a text without an id that stands here alone", "en", 1),
    (1, None, None, None),
    (2, "", "en", 0),
    (3, " \t\n ", "xx", 3),
    (4, "one two three", "en", 13),
    (5, "the same row twice is still the same row", "en", 40),
    (5, "the same row twice is still the same row", "en", 40),
    (5, "another text under the same number as before", "en", 44),
    (6, "x" * 200_000, "en", 200_000),
    (7, "line one\n\nline three\n", "de", 20),
]
# Names that operators use themselves, to clash with.
ODD_SCHEMA = "doc_id long, text string, lang string, n_chars long"
CLASHES = "n_lines n_dropped kept score row start length hash bucket label set_id gram n block vec_id rank".split()


def odd_documents(spark):
    from pyspark.sql import functions as F

    return frame(spark, ODD_DOCUMENTS, ODD_SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})
