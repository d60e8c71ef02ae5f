"""Every training-text query against its SQL on the smallest tables."""

import os
import re
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tools.compare import canon
from verityloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLES:
        cur = con.sql(queries.ORACLES[name])
        want = pd.DataFrame(cur.fetchall(), columns=cur.columns)
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)
    else:
        assert len(got) > 0


def test_pieces_rebuild_every_chunk(spark):
    """p2_pieces against the chunks themselves: own parts without a gap make up the text, sizes and overlaps keep their limits."""
    rows = {}
    for r in spark.read.parquet(f"{SF}/document_chunks.parquet").select(
        "document_id", "chunk_index", "chunk_text"
    ).where("chunk_text is not null").collect():
        k = (r.document_id, r.chunk_index)
        rows[k] = max(rows.get(k, ""), r.chunk_text)
    got = {}
    for r in queries.p2_pieces(spark, SF).collect():
        got.setdefault((r.document_id, r.chunk_index), []).append(r)
    assert got.keys() == rows.keys()
    for k, parts in got.items():
        parts.sort(key=lambda r: r.piece_index)
        text = rows[k]
        assert [p.piece_index for p in parts] == list(range(len(parts)))
        assert all(
            p.piece_text == text[
                p.piece_start : p.piece_end
            ] and len(p.piece_text) <= 1200 and p.own_start - p.piece_start <= 120 for p in parts
        )
        assert [p.own_start for p in parts] == [
            0, *(p.piece_end for p in parts[:-1])
        ] and parts[-1].piece_end == len(text)
        assert all(p.piece_end - p.own_start >= 300 for p in parts) or len(text) <= 1200
        assert (parts[0].boundary == "whole") == (len(text) <= 1200)


def test_curriculum_reaches_the_reported_shares(spark):
    drawn, shares = queries.p7_curriculum(spark, SF).collect(), {
        r.source: r for r in queries.p7_shares(spark, SF).collect()
    }
    assert [r.position for r in drawn] == sorted(r.position for r in drawn)
    used = {}
    for r in drawn:
        used[r.source] = used.get(r.source, 0) + r.tokens
        assert r.copy < shares[r.source].max_repeats
    total = sum(used.values())
    for s, r in shares.items():
        assert r.used == used.get(s, 0) and abs(
            r.actual_share - used.get(s, 0) / total
        ) < 1e-12 and r.falls_short == (r.used < r.wanted)
    assert {r.source for r in queries.p7_found(spark, SF).collect()} == {s for s, r in shares.items() if r.falls_short}


def test_stuffed_pages_have_few_function_words(spark):
    """p8_found against a plain count: flagged pages hold few function words, pages that are nearly all prose are not flagged."""
    from verityloom.llm.stuffing import FUNCTION_WORDS

    common = {w for ws in FUNCTION_WORDS.values() for w in ws.split()}
    share = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\W_]+", (r.text or "").lower())
        share[r.doc_id] = (sum(w in common for w in words) / max(1, len(words)), len(words))
    found = {r.doc_id for r in queries.p8_found(spark, SF).collect()}
    scores = {r.id: r for r in queries.p8_scores(spark, SF).collect()}
    assert scores.keys() == share.keys() and {i for i, r in scores.items() if r.stuffed} == found
    assert all(scores[i].words == n for i, (_, n) in share.items())
    assert found and max(share[i][0] for i in found) < 0.3
    assert not any(i in found for i, (s, n) in share.items() if s > 0.3)
    low = {i for i, (s, n) in share.items() if s < 0.05 and n > 40}
    assert len(low & found) >= 0.8 * len(low)
