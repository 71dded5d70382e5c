"""Stage tables in a session that says nothing of a shared folder."""

from __future__ import annotations

from tests.test_sessions import run_plain


def test_a_plain_session_works_and_leaves_no_file(spark, data, tmp_path):
    assert run_plain(["op1_simhash_pivots", "op2_warc_index"], data, tmp_path) == []
