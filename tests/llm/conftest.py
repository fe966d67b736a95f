import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997} and{i % 31}" for i in range(6000))
BASE = " ".join(f"alpha{i} beta{i * 7 % 13}" for i in range(60))
#: Nulls, empty and very long texts, white space of all kinds, copies, near copies, ties.
TEXTS = [
    (1, "The quick brown fox, it's 12.5 kg!\nThe quick brown fox, it's 12.5 kg!\n\n  two  spaces\tand a tab\n", "en"),
    (2, None, "en"), (3, "", None), (4, "   \n \t ", "xx"), (5, LONG, "en"), (6, LONG, "en"),
    (7, BASE, "fr"), (8, BASE.replace("alpha30 ", "gamma "), "fr"), (9, BASE + " one more", "de"), (10, BASE.upper(), "es"),
    (10, BASE.upper(), "es"), (11, "Ünïcödé élève 👍🏽   x y <|endoftext|> z", "fr"), (12, "a a a a a a a a a a a a", "en"), (None, "no id here at all, but a text of its own", "en"),
    (13, "one\ntwo\nthree", "en"), (14, "### $$$ *** %%% &&& ||| <<< >>>", "en"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with columns whose names clash with those the operators use inside."""
    d = spark.createDataFrame([(*t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, extra int")
    return d.withColumns({c: F.lit(1) for c in ("id", "n", "root", "size", "shard", "slot", "item", "doc", "words", "_h", "_b", "k1", "t")}).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def spark():
    from tapeloom.session import local_session

    return local_session("8", 8)
