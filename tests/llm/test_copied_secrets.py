"""Copies of a text don't make its secrets widely copied; different texts and owners do."""

from __future__ import annotations

from chronofold.llm import secrets


def test_copies_of_a_text_are_one_repository(spark):
    generic, key = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr9St0c4", "token=Zx81kq9vBn2"
    rows = [(i, f"{key} {generic}", "a") for i in range(30)] + [(100 + i, f"token=Qw73hh1pLm5 {i}", "a") for i in range(21)] + [(200 + i, "token=Rt55kk2vXz9", f"s{i}") for i in range(2)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_live, r.n_copied) == ((2, 0) if r.doc_id < 100 else (0, 1)), r
