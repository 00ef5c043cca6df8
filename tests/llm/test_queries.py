import os
import sys

import __spark_entry__ as entry
import pytest
from conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(entry.__file__), "tools"))
from oracle_check import compare, duck  # noqa: E402

from incognita.llm import queries  # noqa: E402

TYPES = {
    "op1_decontamination": ["doc_id bigint", "n_words bigint", "n_hit bigint", "n_items bigint", "items_sha256 string", "contaminated boolean"],
    "op4_language_id": ["doc_id bigint", "held_out boolean", "lang_pred string", "score double"],
    "op5_best_fit_packing": ["doc_id bigint", "piece int", "start bigint", "length bigint", "ids_crc32 bigint", "sequence_id bigint", "offset bigint"],
    "op6_simhash_near_dedup": ["doc_id bigint", "fingerprint string", "component_id bigint"],
    "op7_nearest_neighbours": ["query_id bigint", "rank int", "vec_id bigint", "score double"],
    "op10_sharding": ["doc_id bigint", "size bigint", "text_crc32 bigint", "law string", "shard int", "slot bigint", "grown_shard int"],
    "op11_secret_scan": ["doc_id bigint", "n_assign bigint", "n_access bigint", "n_hex bigint", "base_sha256 string", "spans string"],
    "op12_importance_resampling": ["doc_id bigint", "n_features bigint", "weight bigint", "score bigint", "rank bigint"],
    "op13_prefix_trie": ["conv_id bigint", "depth bigint", "parent_conv_id bigint", "n_convs bigint", "n_children bigint", "n_leaves bigint",
                         "saved_tokens bigint", "ends_sha256 string"],
}


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_and_has_the_contracts_columns(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    assert [" ".join(x) for x in df.dtypes][:len(TYPES.get(name, []))] == TYPES.get(name, [])
    rows, docs = df.count(), spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    group = name.split("_")[0]
    assert rows == docs if group not in ("op5", "op7", "op13") else rows >= (docs if group != "op13" else 1)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_its_sql(spark, name):
    assert compare(spark, duck(SF_SMALL), name, queries.QUERIES[name], queries.ORACLES[name], SF_SMALL)["ok"]
