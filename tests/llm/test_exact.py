import hashlib
import re

import pytest

from lexframe.llm import exact

from .inputs import awkward, frame


@pytest.mark.parametrize("broadcast", [exact.BROADCAST_KEYS, 0])
def test_against_plain(spark, monkeypatch, broadcast):
    monkeypatch.setattr(exact, "BROADCAST_KEYS", broadcast)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in awkward():
        groups.setdefault(norm(r[1]), []).append(r[0])
    rows = exact.exact_digest(frame(spark)).collect()
    first = lambda ids: min((i for i in ids if i is not None), default=None)
    expected = sorted(((r[0], first(groups[norm(r[1])]), len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in awkward()), key=repr)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=repr) == expected
    kept = [r["text_sha256"] for r in rows if r["kept"]]
    assert sorted(kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_same_length_and_prefix_but_other_text(spark):
    rows = [(i, "a" * 400 + c, None, None, None, None, None, None) for i, c in enumerate("xyx")]
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_duplicates(frame(spark, rows)).collect()}
    assert found == {0: (0, 2), 1: (1, 1), 2: (0, 2)}


def test_each_stage_reads_what_the_one_before_left(spark, monkeypatch):
    """Of eight texts five share a length, four of them a prefix too, and only these are hashed whole."""
    counted = {}

    def cut(df, label, real=exact.cut):
        out = real(df, label)
        counted[label] = out.count()
        return out

    monkeypatch.setattr(exact, "cut", cut)
    long = "b" * 300
    texts = ["a", "aa", "aaa", long + "1", long + "1", long + "2", long + "2", "c" + long]
    rows = [(i, t, None, None, None, None, None, None) for i, t in enumerate(texts)]
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_duplicates(frame(spark, rows)).collect()}
    assert counted == {"exact-lengths": 1, "exact-prefixes": 1, "exact-survivors": 4}
    assert found == {0: (0, 1, True), 1: (1, 1, True), 2: (2, 1, True), 3: (3, 2, True), 4: (3, 2, False), 5: (5, 2, True), 6: (5, 2, False), 7: (7, 1, True)}


def test_empty(spark):
    assert exact.exact_digest(frame(spark, [])).count() == 0
