import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import ODD, SF  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, len(r[1] or ""), "clash", 1, 2, "t") for r in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                       "spans string, size int, sig int, _id string").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id = -1")


@pytest.fixture(scope="session")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture
def tables(spark, odd, tmp_path):
    """A folder with the odd rows as documents (repeated ids kept), and labels for some."""
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 1, 1), (3, None, None), (99, 0, 1)], "doc_id bigint, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, 0, "system", "be <|end|> kind"), (1, 1, "user", None), (1, 1, None, "tie"), (1, 2, "assistant", "a\\|b<"),
                           (None, None, None, None), (2, 5, "assistant", "only"), (2, 5, "assistant", "only")],
                          "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)
