import hashlib
import random
import tracemalloc

from lexframe.llm import infill
from lexframe.llm.queries import ORACLES

from .inputs import awkward, frame


def plain(doc_id, text):
    """The contract, with all units in a list."""
    text = text or ""
    spaces = " \t\n\x0b\x0c\r"
    units, at = [], 0
    while at < len(text):
        stop = at
        while stop < len(text) and text[stop] in spaces:
            stop += 1
        while stop < len(text) and text[stop] not in spaces:
            stop += 1
        units.append(text[at:stop])
        at = stop
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 50:
        form, prefix, middle, out = "plain", None, None, text
    else:
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "spm" if h[3] % 100 < 80 else "psm"
        prefix, middle, out = len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, prefix, middle, sha(out), sha(text))


def test_whole_results_against_plain(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "é", " ", "\n", "\t", "x😀", "<", "P>", "S", ">", "\x0b", "\xa0"]) for _ in range(rng.randrange(40))) for _ in range(600)]
    rows = awkward() + [(1000 + i, t, None, None, None, None, None, None) for i, t in enumerate(texts)] + [(5, "<S> in it", None, None, None, None, None, None)]
    found = sorted(map(tuple, infill.infill_digest(frame(spark, rows)).collect()), key=repr)
    assert found == sorted((plain(r[0], r[1]) for r in rows), key=repr)
    assert {r[2] for r in found} == {"plain", "spm", "psm"}


def test_clashing_names_and_an_empty_table(spark):
    docs = frame(spark).selectExpr("doc_id as form", "text as output", "1 as n", "2 as doc_id", "'z' as text")
    found = infill.fill_in_middle(docs, "form", "output")
    back = sorted(map(tuple, infill.restored(found).collect()), key=repr)
    assert back == sorted(((r[0], r[1] or "") for r in awkward()), key=repr)
    assert infill.infill_digest(frame(spark, [])).collect() == []


def test_pieces_of_broken_marks_come_back():
    """Pieces that end or begin with part of a mark."""
    for a in ("<", "<P", "<S", "<M", ">", "S>"):
        for b in ("P>", "S>", "M>", "<", ">"):
            made = infill.Infill(2, "psm", a, b, a)
            assert infill.restore(made.output(), "psm") == a + b + a
            made = made._replace(form="spm")
            assert infill.restore(made.output(), "spm") == a + b + a


def test_no_list_of_units_is_stored():
    text = "ab " * 1_000_000
    tracemalloc.start()
    assert infill.count_units(text) == 1_000_001
    assert infill.unit_ends(text, 400_000, 900_000) == (3 * 400_000 - 1, 3 * 900_000 - 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000


def test_query_is_held_against_sql():
    assert "op13_fill_in_middle" in ORACLES
