"""The encoder against two public libraries, and exact round trips."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import tokenizing as T


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def ids(texts):
    off, flat = T.encoder().encode(texts)
    return [flat[a:b].tolist() for a, b in zip(off, off[1:])]


CASES = ["", " ", "  ", "a  b", "a \n b ", "\n\n", "x\x00y z", "it's  we'll", "<|endoftext|>", "日本語のテキスト。", "é́ ñ ﬁ", "😀👩‍👩‍👧", "1,234.5 — ½", "\u3000\u00a0x\u2003y", "end. \tnext", " a", "a ", "ab" * 3000, "\u200bword\ufeff"]


def test_cases(reference):
    assert ids(CASES) == [reference(s) for s in CASES]


@settings(max_examples=250, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=("Cs",)), st.sampled_from(" \n\t'sl.a0é")), max_size=60))
def test_any_text(reference, s):
    assert ids([s])[0] == reference(s)
    assert T.encoder().decode(ids([s])[0]) == s


def test_batches_do_not_change_ids():
    texts = [c * 3 for c in CASES]
    assert ids(texts) == [ids([t])[0] for t in texts]


def test_perfect_hash_is_minimal_and_perfect():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = T.PerfectHash(keys)
    assert h.index(keys).tolist() == list(range(5000))


def test_null_empty_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z")], "doc_id long, text string, ids string")
    out = sorted((r["doc_id"], r["ids"]) for r in T.encode(df, "doc_id", "text").collect())
    assert out == [(1, []), (2, []), (3, [64, 275]), (3, [64, 275])]
    assert T.encode(df.limit(0), "doc_id", "text").count() == 0
    assert sorted(r["n_tokens"] for r in T.count_tokens(df, "doc_id", "text").collect()) == [0, 0, 2, 2]
