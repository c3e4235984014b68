"""The registered queries run on the smallest tables, whole, with the columns that they promise."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from faultline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": {"doc_id", "fingerprint", "component_id"},
    "op2_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op3_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op4_ann": {"query_id", "rank", "vec_id", "score"},
    "op5_quality": {"doc_id", "perplexity", "threshold", "keep"},
    "op6_line_dedup": {"doc_id", "text", "n_lines", "n_removed"},
    "op7_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op8_langid": {"doc_id", "held_out", "lang_pred", "score"},
    "op9_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op10_decontamination": {"doc_id", "item_id", "score", "overlap"},
}
PER_DOCUMENT = {"op1_simhash", "op2_toxicity", "op5_quality", "op6_line_dedup", "op7_lm_scoring", "op8_langid", "op9_mixing"}
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the standard tables")


def plain(pdf):
    return sorted(tuple(map(str, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


def test_all_ten_and_the_pipeline_are_registered():
    assert set(QUERIES) == set(COLUMNS) and set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert COLUMNS[name] <= set(got.columns) and not got[sorted(COLUMNS[name] - {"text"})].isna().any().any()
    if name in PER_DOCUMENT:
        documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").toPandas()
        assert sorted(got.doc_id) == sorted(documents.doc_id)
    if name in ORACLES:
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        assert plain(got) == plain(con.sql(ORACLES[name]).df())
