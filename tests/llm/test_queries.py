import os

import duckdb
import pytest

from quire.llm.queries import LLM

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM.queries))
def test_runs_and_agrees(spark, name):
    df = LLM.queries[name](spark, FOLDER)
    rows = df.collect()
    assert rows or name == "p1_unmatched"
    if name in LLM.sql:
        con = duckdb.connect()
        for f in os.listdir(FOLDER):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
        answer = con.execute(LLM.sql[name])
        names = [c[0] for c in answer.description]
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(answer.fetchall())


def test_found_columns(spark):
    wanted = {
        "p1_found": ["field_id", "label_id"],
        "p3_found": ["sent_id_a", "sent_id_b"],
        "p4_found": ["block_id", "span_start", "span_end"],
        "p5_found": ["word_id", "turn_word_id", "speaker_no"],
        "p6_found": ["item_kind", "item_id", "has_unbroken"],
        "p9_found": ["doc_id", "pii_kind", "span_start", "span_end"],
    }
    for name, columns in wanted.items():
        assert LLM.queries[name](spark, FOLDER).columns == columns
