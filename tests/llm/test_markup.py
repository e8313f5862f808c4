"""Markup: held-out accuracy of the trees, joint decoding, and what is kept."""

import itertools
import random

import numpy as np
import pytest

from cairn.llm import markup as M


@pytest.fixture(scope="module")
def trees():
    return M.trees()


def parts(trees, text, kind="paragraph", level=None):
    return M.clean_block(text, kind, level, trees)[0]


def test_held_out_accuracy(trees):
    x, y = M._written(seed=77, blocks=500)
    assert ((trees.logits(x) > 0) == (y > 0)).mean() > 0.99
    assert 0.1 < (y == 0).mean() < 0.9  # taking every candidate, or none, would be far off


def test_without_the_trees_precision_or_recall_is_lost(trees, sf):
    import duckdb

    class Always:
        def __init__(self, z):
            self.z = z

        def logits(self, x):
            return np.full(len(x), self.z)

    blocks = duckdb.sql(f"SELECT text, kind, level FROM '{sf}/blocks.parquet' WHERE text IS NOT NULL").fetchall()
    flags = lambda model: np.array([bool(M.clean_block(*b, model)[1]) for b in blocks])
    got, all_, none = flags(trees), flags(Always(5.0)), flags(Always(-5.0))
    assert got.any() and not none.any() and not (got & ~all_).any()
    assert all_.sum() > 1.2 * got.sum()


def test_labels_come_from_what_was_written():
    text, syntax = M._show("**" + M._hide("kite a.") + "** <")
    assert text == "**kite a.** <" and syntax.tolist() == [True] * 2 + [False] * 7 + [True] * 4


def test_a_doubtful_raw_parent_gives_way_to_sure_children():
    nodes = [M.Node("comment", 0, 90, raw=True, children=list(range(1, 9)))] + [M.Node("tag", i, i + 1, parent=0) for i in range(1, 9)]
    assert M.decode(nodes, np.array([-3.0] + [0.0] * 8)).tolist()[0] is False
    assert M.decode(nodes, np.array([3.0] + [2.0] * 8)).tolist() == [False] + [True] * 8


def test_decoding_is_the_best_consistent_choice():
    r = random.Random(0)
    for _ in range(30):
        nodes = []
        for i in range(7):
            parent = r.randint(-1, i - 1)
            nodes.append(M.Node("tag", i, i + 1, raw=r.random() < 0.5, parent=parent))
            if parent >= 0:
                nodes[parent].children.append(i)
        z = np.array([r.uniform(-3, 3) for _ in nodes])

        def shadowed(take, i):
            p = nodes[i].parent
            return p >= 0 and (shadowed(take, p) or (take[p] and nodes[p].raw))

        def value(take):
            if any(t and shadowed(take, i) for i, t in enumerate(take)):
                return -np.inf
            return sum(-np.logaddexp(0, -z[i] if take[i] else z[i]) for i in range(len(nodes)))

        best = max(itertools.product([False, True], repeat=len(nodes)), key=value)
        assert abs(value(tuple(M.decode(nodes, z))) - value(best)) < 1e-9


@pytest.mark.parametrize(
    "text",
    ["Less than <5 mm, or 29 % of the A&B shelf; C&D comes next.", "I <3 this, really :-)", "Here a < b and c > 15, so it holds.", "Rated 4/5* by the desk; * means provisional.", "It fetched $4 in May and $39 in June.", "Tagged #kite, by the '80s and '90s club, [illegible].", "Kept in ~/scans/kite and in kite_a.txt or kite_b.txt.", "It lies under D:\\ledger\\kite\\scans on the old disk.", "The spelling kite [sic] is theirs [28].", "The C++ and C# drafts (v6.0) are lost -> see below.", "A volume of 3 * 16 * 2 was noted.", "Write to the desk | second floor | bell 30.", "The rule kite == 6 was never used.", "Nearly ~9 sheets (100% rag), set {a, b}."],
)
def test_look_alikes_are_plain(trees, text):
    assert M.clean_block(text, "paragraph", None, trees) == ([("paragraph", None, text)], [])


@pytest.mark.parametrize(
    "text,kind,want",
    [
        ("<h2>Salt pan</h2>", "heading", [("heading", 2, "Salt pan")]),
        ("=== Salt pan ===", "heading", [("heading", 3, "Salt pan")]),
        ("\\subsection{Salt pan}", "heading", [("heading", 2, "Salt pan")]),
        ("Salt pan\n=======\n\nBody.", "paragraph", [("heading", 1, "Salt pan"), ("paragraph", None, "Body.")]),
        ("- one\n- two\nRest.", "paragraph", [("list_item", None, "one"), ("list_item", None, "two"), ("paragraph", None, "Rest.")]),
        ("<ul><li>one<li>two</ul>Rest.", "paragraph", [("list_item", None, "one"), ("list_item", None, "two"), ("paragraph", None, "Rest.")]),
        ("\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}", "paragraph", [("list_item", None, "one"), ("list_item", None, "two")]),
        ("```py\nload('*x*')\n```\nRest.", "paragraph", [("code", None, "load('*x*')"), ("paragraph", None, "Rest.")]),
        ("<pre><code>x = 1\ny()</code></pre> Rest.", "paragraph", [("code", None, "x = 1\ny()"), ("paragraph", None, "Rest.")]),
        ("\\begin{equation}\nE = m b^2\n\\end{equation}\nRest.", "paragraph", [("formula", None, "E = m b^2"), ("paragraph", None, "Rest.")]),
        ("Then $x_{k}^2 + y = 8$ holds.", "paragraph", [("paragraph", None, "Then x_{k}^2 + y = 8 holds.")]),
        ("| a | n |\n|---|---|\n| b | 4 |", "paragraph", [("table", None, "| a | n |\n| b | 4 |")]),
        ("<table><tr><td>a</td><td>b</td></tr></table>", "paragraph", [("table", None, "| a | b |")]),
        ("See [[kite|weather kite]] &amp; [link](https://x.example/a_b).", "paragraph", [("paragraph", None, "See weather kite & link.")]),
        ("The **salt pan** was __old__ and ''new''. ~~gone~~", "paragraph", [("paragraph", None, "The salt pan was old and new. gone")]),
        ("Caf\\'e, ``so'' costs 5\\% \\& more.", "paragraph", [("paragraph", None, "Café, so costs 5% & more.")]),
        ('It ends. <div class="vat', "paragraph", [("paragraph", None, "It ends.")]),
        ("文字**重点**文字，公式$x^2$成立。", "paragraph", [("paragraph", None, "文字重点文字，公式x^2成立。")]),
        ("| [[kite|weather kite]] and {{name|x}} | $a|b^2$ | 4 |\n| --- | --- | --- |", "table", [("table", None, "| weather kite and | a|b^2 | 4 |\n| --- | --- | --- |")]),
    ],
)
def test_structure_survives(trees, text, kind, want):
    assert parts(trees, text, kind) == want


def test_table_cells_and_code(trees):
    table = "| seed bank &times; 2 | n |\n| --- | --- |\n| kite | 4 |"
    assert parts(trees, table, "table") == [("table", None, "| seed bank × 2 | n |\n| --- | --- |\n| kite | 4 |")]
    plain = table.replace(" &times; 2", "")
    assert M.clean_block(plain, "table", None, trees) == ([("table", None, plain)], [])
    assert M.clean_block("<b>x</b> **y**", "code", None, trees)[1] == []


def test_texts_judged_together_or_alone(trees, sf):
    import duckdb

    texts = duckdb.sql(f"SELECT text, kind FROM '{sf}/blocks.parquet' WHERE text IS NOT NULL").fetchall() + [("", None)]
    for (nodes, take), (t, k) in zip(M.judge_all(texts, trees), texts):
        alone, own = M.judge(t, k, trees)
        assert [(n.start, n.end) for n in nodes] == [(n.start, n.end) for n in alone] and take.tolist() == own.tolist()
    assert M.judge_all([], trees) == []


def test_operator_defines_nulls_and_extremes(spark):
    rows = [(1, None, "paragraph", None), (2, "", "paragraph", None), (3, "<!-- only -->", "paragraph", None), (4, "**a** " * 5000, None, None), (5, "<" * 3000, "paragraph", None)]
    df = spark.createDataFrame(rows, "block_id long, text string, kind string, level int").selectExpr("*", "'x' as part")
    out = {r["block_id"]: r for r in M.clean(df).filter("part = 0").collect()}
    assert out[1]["text"] is None and not out[1]["residue"] and out[2]["text"] == ""
    assert out[3]["text"] == "" and out[3]["residue"] and out[4]["residue"] and out[4]["text"].count("a") == 5000 and not out[5]["residue"]
    assert M.clean(df.limit(0)).count() == 0
