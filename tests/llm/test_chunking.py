"""The chunker's invariants."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import chunking as C


def check(text, **o):
    pieces = C.split(text, **o)
    limit = o.get("limit", C.LIMIT)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, how), (c, d, _) in zip(pieces, pieces[1:]):
        assert 0 < b - a <= limit and c <= b < d
        if how in ("sentence", "paragraph", "space", "hard"):
            shared = o.get("overlap", C.OVERLAP)
            assert b - c == shared or b - c < shared and (d - c == limit or d == len(text))
    assert pieces[-1][1] - pieces[-1][0] <= limit
    return pieces


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("abc .!?\n。|😀é"), max_size=900))
def test_any_text(s):
    check(s, limit=120, overlap=20, minimum=50)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y.", "汐", "z|", "w,"]), st.integers(1, 90), st.sampled_from([" ", "\n", "。", "\n\n", ". "])), max_size=12))
def test_cuts_are_hard_just_where_a_run_exceeds_the_limit(parts):
    s = "".join(a * n + end for a, n, end in parts)
    pieces = check(s, limit=120, overlap=20, minimum=50)
    assert any(how == "hard" for _, _, how in pieces) == (len(s) > 120 and any(len(run) > 120 for run in re.findall(r"[^\s。！？]+", s)))


def test_the_nearest_boundary_wins_unless_a_stronger_one_is_about_as_near():
    r = random.Random(2)
    words = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(400))[:1800]
    plain, wins, places = C.split(words)[0][1], [], [i for i in range(460, 1190) if words[i] == " "]
    for at in places:
        s = words[: at - 1] + "." + words[at:]
        if C.split(s)[0][2] == "sentence":
            wins.append(at)
    assert 5 < len(wins) < len(places) and sum(abs(at - plain) < 300 for at in wins) > 0.9 * len(wins)


def test_natural_boundaries_are_used():
    r = random.Random(0)
    text = " ".join("word" * r.randint(1, 3) + r.choice(["", "", "", "."]) for _ in range(3000))
    assert all(how in ("sentence", "space", "end") for _, _, how in check(text))


def test_rows_are_not_cut_and_share_nothing():
    table = "\n".join(f"| row {i} | {'x' * 40} |" for i in range(100))
    pieces = check(table)
    assert all(table[a:b].startswith("| row") for a, b, _ in pieces)
    assert sum(b - a for a, b, _ in pieces) == len(table)


def test_unbroken_run_is_forced():
    assert {h for _, _, h in check("x" * 5000)} == {"hard", "end"}
    hard = lambda s: any(h == "hard" for _, _, h in check(s))
    assert hard("a " + "x" * 1201) and not hard("x" * 1200 + " y") and not hard("汐。" * 900)


def test_a_run_within_the_limit_is_never_cut():
    for size in (751, 900, 1064, 1100, 1199):
        for lead in (1, 20, 40, 90, 300):
            text = "word " * lead + "x" * size + " tail" * 400
            pieces = C.split(text)
            at = text.index("x")
            assert all(how != "hard" for _, _, how in pieces)
            assert not any(at < b < at + size for _, b, _ in pieces)
            assert all(b - a <= C.LIMIT for a, b, _ in pieces) and pieces[-1][1] == len(text)
            assert all(a < c <= b < d and b - c <= C.OVERLAP for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]))
    assert any(how == "hard" for _, _, how in C.split("word " * 40 + "x" * 1300 + " tail" * 400))


def test_an_edit_alters_only_neighbouring_pieces():
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) + ("." if r.random() < 0.1 else "") for _ in range(12000))
    i = len(text) // 2
    edited = text[:i] + " inserted words " + text[i:]
    before, after = {text[a:b] for a, b, _ in C.split(text)}, {edited[a:b] for a, b, _ in C.split(edited)}
    assert len(after - before) < len(after) / 4


def test_operator_defines_nulls_repeats_and_stale_positions(spark):
    units = [("u1", "p", 10, 10 + 2000, "a b. " * 400), ("u1", "p", 10, 10 + 2000, "a b. " * 400), ("u2", None, 5, 9, "c d. " * 400), ("u3", None, None, None, None), ("u4", None, 0, 5, "short")]
    df = spark.createDataFrame([(*u, None) for u in units], "id string, locator string, start_pos int, end_pos int, text string, arrived_at timestamp_ntz").selectExpr("*", "1 as piece")
    out = C.oversized_pieces(df).orderBy("id", "piece").collect()
    assert {r["id"] for r in out} == {"u1", "u2"}
    first = [r for r in out if r["id"] == "u1"]
    assert [r["piece"] for r in first] == list(range(len(first))) and first[0]["capture_start"] == 10 and first[-1]["capture_end"] == 2010
    assert all(r["capture_start"] is None for r in out if r["id"] == "u2")
    assert C.oversized_pieces(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.split("x", limit=100, overlap=90, minimum=50)
