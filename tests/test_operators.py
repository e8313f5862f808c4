"""Log folds, the graph fold, walks, lints, clustering and search on small hand-made inputs and against sequential models."""

import random

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import cluster, fold, graph, logfolds, search, units
from cairn.plans.vault import EDGE_TYPES


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merge_fold_equals_sequential_model(spark):
    r = random.Random(1)
    log = [(i, r.choice("abcd"), r.choice("abcd"), r.choice(["merge", "unmerge", "keep"])) for i in range(120)]
    log = [e for e in log if e[1] != e[2]]
    mapping, kept = {}, set()
    for _, d, c, action in log:
        pair = tuple(sorted((d, c)))
        if action == "merge":
            mapping[d] = c
            kept.discard(pair)
        elif action == "unmerge":
            mapping.pop(d, None)
        else:
            kept.add(pair)
            for x, y in (pair, pair[::-1]):
                if mapping.get(x) == y:
                    mapping.pop(x)
    m, k = logfolds.merges(spark.createDataFrame(log, "seq long, duplicate string, canonical string, action string"))
    assert rows(m) == sorted(mapping.items())
    assert rows(k) == sorted(kept)


def test_merge_chains_and_cycles(spark):
    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("p", "q")]
    out = logfolds.flatten_merges(spark.createDataFrame(pairs, "duplicate string, canonical string"))
    assert rows(out) == [("a", "c"), ("b", "c"), ("p", "q")]


def _fold(spark, assertions, claims=(), decisions=(), instances=(), merges=(), retired=(), notes=("n1", "n2")):
    df = lambda data, schema: spark.createDataFrame(list(data), schema)
    return fold.fold(
        df([(n, f"2024-01-0{i + 1}") for i, n in enumerate(notes)], "id string, created string"),
        df([(n, p, s, t) for n, p, s, t in instances], "note_id string, pos string, slug string, type string"),
        df([(i, n, s, t, ty, st, None, []) for i, n, s, t, ty, st in assertions], "id string, note_id string, source string, target string, type string, strength int, proposed_type string, text_unit_ids array<string>"),
        df([(i, n, s, "t", None, None, sup) for i, n, s, sup in claims], "id string, note_id string, subject string, text string, valid_from string, valid_to string, supersedes string"),
        df(decisions, "assertion string, action string"),
        df([], "kind string, proposed string, adopted string"),
        df(merges, "duplicate string, canonical string"),
        df([(s,) for s in retired], "slug string"),
        df(EDGE_TYPES, "type string, symmetric boolean, weight double"),
        ["paper", "tool"],
    )


def test_symmetric_pairs_merge_and_directed_do_not(spark):
    g = _fold(spark, [("x1", "n1", "b", "a", "relates_to", 3), ("x2", "n2", "a", "b", "relates_to", 5), ("x3", "n1", "b", "a", "cites", 1), ("x4", "n1", "a", "b", "cites", 1)], decisions=[("x1", "confirm"), ("x2", "confirm")])
    edges = {r["key"]: (r["weight"], r["mean_strength"]) for r in g.aggregates.collect()}
    assert edges == {"r:a|relates_to|b": (2, 4.0), "r:b|cites|a": (0, 0.0), "r:a|cites|b": (0, 0.0)}
    assert {r["slug"]: r["rank"] for r in g.entities.collect()} == {"a": 1, "b": 1}


def test_type_is_the_latest_declaration_and_dismissed_ends_vanish(spark):
    g = _fold(spark, [("x1", "n1", "a", "gone", "cites", 3)], decisions=[("x1", "dismiss")], instances=[("n1", "0", "a", "paper"), ("n2", "0", "a", None), ("n2", "1", "b", "tool"), ("n1", "1", "b", "paper")])
    assert {r["slug"]: r["type"] for r in g.entities.collect()} == {"a": "paper", "b": "tool"}


def test_merge_collapses_to_a_self_loop_that_counts_twice(spark):
    g = _fold(spark, [("x1", "n1", "a", "b", "cites", 3)], decisions=[("x1", "confirm")], merges=[("b", "a")])
    e = g.entities.collect()
    assert [(r["slug"], r["rank"]) for r in e] == [("a", 2)]
    assert rows(g.merged_from) == [("a", "b")] and rows(g.members) == [("r:a|cites|a", "x1")]


def test_supersession_reads_the_state_before(spark):
    claims = [("k1", "n1", "a", None), ("k2", "n1", "a", "k1"), ("k3", "n1", "a", "k2"), ("k4", "n1", "a", None), ("k5", "n1", "a", "k4")]
    g = _fold(spark, [], claims, decisions=[("k2", "confirm"), ("k3", "confirm")])
    assert {r["id"]: r["status"] for r in g.claims.collect()} == {"k1": "superseded", "k2": "superseded", "k3": "confirmed", "k4": "proposed", "k5": "proposed"}


def test_retired_and_revived(spark):
    g = _fold(spark, [("x1", "n1", "a", "b", "cites", 3)], instances=[("n1", "0", "c", "paper"), ("n1", "1", "d", "paper")], retired=["a", "c"])
    assert [r["slug"] for r in g.revived.collect()] == ["a"]
    assert sorted(r["slug"] for r in g.entities.collect()) == ["a", "b", "d"]


def test_fold_does_not_depend_on_order_or_partitions(spark):
    r = random.Random(2)
    a = [(f"x{i}", r.choice(["n1", "n2"]), r.choice("abcde"), r.choice("abcde"), r.choice(["cites", "relates_to", None]), r.randint(1, 10)) for i in range(40)]
    d = [(f"x{i}", r.choice(["confirm", "dismiss"])) for i in range(0, 40, 2)]
    one, two = _fold(spark, a, decisions=d), _fold(spark, a[::-1], decisions=d[::-1])
    assert rows(one.aggregates) == rows(two.aggregates) and rows(one.entities) == rows(two.entities)


def test_quarantine_equals_sequential_scan(spark):
    r = random.Random(4)
    notes = [(f"n{i:02d}", f"2024-01-{i + 1:02d}") for i in range(25)]
    items = [(n, f"x{r.randint(0, 18)}", r.choice(["cites", None, "cites", "odd"] if r.random() < 0.2 else ["cites"])) for n, _ in notes for _ in range(2)]
    used, rejected = set(), set()
    for n, _ in sorted(notes, key=lambda x: (x[1], x[0])):
        mine = [i for i in items if i[0] == n]
        ids = [i[1] for i in mine]
        if any(i[2] == "odd" for i in mine) or len(set(ids)) < len(ids) or used & set(ids):
            rejected.add(n)
        else:
            used |= set(ids)
    got = fold.quarantine(spark.createDataFrame(notes, "id string, created string"), spark.createDataFrame(items, "note_id string, id string, type string"), spark.createDataFrame(EDGE_TYPES, "type string, symmetric boolean, weight double"))
    assert {x["note_id"] for x in got.collect()} == rejected


def _edges(spark, pairs, kind="cites"):
    return spark.createDataFrame([(f"r:{a}|{kind}|{b}", a, kind, b, 1, True) for a, b in pairs], "key string, source string, type string, target string, weight long, traversable boolean")


def test_neighbours_first_seen_wins(spark):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("e", "a")])
    out = {r["slug"]: r["hop"] for r in graph.neighbours(e, spark.createDataFrame([("a",)], "slug string"), 2).collect()}
    assert out == {"b": 1, "c": 1, "e": 1, "d": 2}


def test_near_duplicate_guards(spark):
    slugs = spark.createDataFrame([(s,) for s in ["laws", "scaling", "scaling-laws", "tier-1", "tier-10", "peat", "peat-core", "canal", "canal-lock", "ai", "ai-lab"]], "slug string")
    e = _edges(spark, [("list", "canal"), ("list", "canal-lock")])
    assert rows(graph.near_duplicates(slugs, e)) == [("peat", "peat-core")]
    aliased = spark.createDataFrame([("peat-core", "peat")], "a string, b string")
    assert rows(graph.near_duplicates(slugs, e, aliased)) == []


def test_lineage_match_equals_greedy(spark):
    r = random.Random(6)
    make = lambda p: [(f"{p}{i}", 0, sorted(r.sample("abcdefghij", r.randint(1, 5)))) for i in range(8)]
    fresh, previous = make("f"), make("p")
    pairs = sorted((-len(set(a[2]) & set(b[2])) / len(set(a[2]) | set(b[2])), a[0], b[0]) for a in fresh for b in previous)
    used, want = set(), []
    for s, a, b in pairs:
        if -s >= 0.3 and a not in used and b not in used:
            want.append((a, b))
            used |= {a, b}
    schema = "id string, level int, members array<string>"
    got = graph.match_lineages(spark.createDataFrame(fresh, schema), spark.createDataFrame(previous, schema), 0.3)
    assert sorted((x["fresh"], x["previous"]) for x in got.collect()) == sorted(want)


def test_leiden_finds_planted_groups_and_is_stable(spark):
    r = np.random.default_rng(0)
    e = [(f"v{i:03d}", f"v{j:03d}", 1.0) for i in range(60) for j in range(i + 1, 60) if r.random() < (0.5 if i // 20 == j // 20 else 0.02)]
    df = spark.createDataFrame(e, "a string, b string, weight double")
    found = cluster.communities(df).collect()
    groups = {frozenset(c["members"]) for c in found if c["level"] == 0}
    assert groups == {frozenset(f"v{i:03d}" for i in range(k, k + 20)) for k in (0, 20, 40)}
    assert sorted(c["id"] for c in cluster.communities(df).collect()) == sorted(c["id"] for c in found)
    nested = cluster.communities(df, max_size=10).collect()
    top = {c["id"]: set(c["members"]) for c in nested}
    assert all(set(c["members"]) <= top[c["parent"]] for c in nested if c["parent"])


def test_components_above_the_bound_keep_every_vertex(spark):
    r = np.random.default_rng(1)
    star = [("hub", f"leaf{i:02d}", 1.0) for i in range(50)]
    planted = [(f"v{i:03d}", f"v{j:03d}", 1.0) for i in range(60) for j in range(i + 1, 60) if r.random() < (0.5 if i // 20 == j // 20 else 0.02)]
    df = spark.createDataFrame(star + planted, "a string, b string, weight double")
    whole = {v for e in star + planted for v in e[:2]}
    few, label = cluster.contract(df.withColumn("root", F.when(F.col("a") == "hub", "s").otherwise("p")), 20)
    assert few.filter("a <> b").groupBy("root").count().filter("count > 20").isEmpty()
    assert few.agg(F.sum("weight")).first()[0] == len(star + planted) and {x["slug"] for x in label.collect()} == whole
    found = cluster.communities(df, max_size=12, max_edges=40).collect()
    top = [v for c in found if c["level"] == 0 for v in c["members"]]
    assert sorted(top) == sorted(whole)
    by = {c["id"]: c for c in found}
    children = {}
    for c in found:
        if c["parent"]:
            assert c["level"] == by[c["parent"]]["level"] + 1
            children.setdefault(c["parent"], []).extend(c["members"])
    assert children and all(sorted(m) == by[p]["members"] for p, m in children.items())


def test_units_tile_the_text_and_respect_the_budget():
    texts = ["Short.", "\n\n".join(f"Paragraph {i}. " + "word " * 60 for i in range(8)), "A sentence here. " * 200, "x" * 5000, "こんにちは。" * 500, "a\r\n\r\nb\n\n\n\nc"]
    for t in texts:
        spans = units.of_text(t)
        assert spans[-1][1] == len(t)
        for (a, b), (c, _) in zip(spans, spans[1:]):
            assert b - a <= units.BUDGET + 4 and c <= b + 4 and c > a


def test_units_of_blocks_follow_the_rules():
    from cairn.sources import parsers

    at = parsers.locator("page", "1", 1)
    b = lambda kind, text, level=None: parsers.block(kind, text, level, at)
    table = "\n".join(f"| row {i} | {'x' * 40} |" for i in range(60))
    blocks = [b("paragraph", "p" * 500), b("heading", "One", 1), b("heading", "Two", 2), b("paragraph", "q" * 900), b("paragraph", "A sentence of it. " * 120), b("table", table), b("paragraph", "r" * 700), b("list_item", "s" * 400), b("heading", "Last", 2)]
    text, got = parsers.to_markdown(blocks), units.of_blocks(blocks)
    parts = [text[a:e] for a, e, _ in got]
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(loc == at for _, _, loc in got) and all(len(p) <= units.BUDGET + 1 for p in parts)
    assert parts[0].endswith("# One") and parts[1].startswith("## Two\n\nqqq")  # of two headings the last goes with its block
    prose = [p for p in parts if "sentence" in p]
    assert len(prose) > 1 and all(p.rstrip().endswith(".") for p in prose) and all(a[-units.OVERLAP :] == z[: units.OVERLAP] for a, z in zip(prose, prose[1:]))
    rows = [p for p in parts if p.startswith("| row")]
    assert "\n".join(rows) == table
    assert parts[-1].startswith("rrr") and parts[-1].endswith("## Last\n") and "sss" in parts[-1]
    assert units.of_blocks([]) == [] and units.of_text("") == [(0, 0)]


def test_long_texts_with_any_line_ends_are_split():
    plain = "\n\n".join(f"Paragraph {i}.\n" + "word " * 60 + f"\nend {i}." for i in range(12))
    many = len(units.of_text(plain))
    assert many > 3
    for end in ("\r\n", "\r", "\n"):
        t = plain.replace("\n", end)
        spans = units.of_text(t)
        assert len(spans) == many and spans[0][0] == 0 and spans[-1][1] == len(t)
        assert all(z - a <= units.BUDGET * 2 for a, z in spans) and all(t[a:].startswith("Paragraph") for a, _ in spans)
    assert units.paragraph_spans("\r\na\r\nb\r\n \r\n\rc\r\rd\n") == [(2, 6), (12, 13), (15, 16)]


def test_bm25_and_empty_query(spark):
    docs = spark.createDataFrame([(i, "note", f"title {i}", "peat core " * (i % 3) + "weather kite survey " + "filler " * i) for i in range(10)] + [(10, "note", None, None)], "doc_id long, kind string, title string, text string")
    hits = search.lexical(docs, "Péat peat").collect()
    assert {h["doc_id"] for h in hits} == {i for i in range(10) if i % 3} and all(h["bm25"] > 0 for h in hits)
    assert search.lexical(docs, "潮汐表").count() == 0


def test_cited_ids(spark):
    from cairn.functions import scalars as S

    texts = ["It is contested [Data: Entities (e_scaling-laws); Assertions (x_01ab)].", "One [Data: Entities (e_a)]. Two [Data: Assertions (x_b, k_c, e_a)].", "No support: e_a.", "[Data: Entities (e_a, e_b, +more)]", None]
    got = [r["c"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.cited_ids("t").alias("c")).orderBy("i").collect()]
    assert got == [["e_scaling-laws", "x_01ab"], ["e_a", "x_b", "k_c"], [], ["e_a", "e_b"], None]


def test_postings_give_the_same_and_read_only_their_terms(spark):
    docs = spark.createDataFrame([(i, ["note", "report"][i % 2], f"title {i}", "peat core " * (i % 3) + "weather kite survey " + "filler " * i) for i in range(30)] + [(30, "note", None, None)], "doc_id long, kind string, title string, text string")
    index = search.Index(spark).build(docs)
    for query, kinds in (("peat kite peat", None), ("core filler nowhere", ["report"])):
        want = [(r["doc_id"], round(r["bm25"], 9)) for r in search.lexical(docs, query, kinds).collect()]
        assert [(r["doc_id"], round(r["bm25"], 9)) for r in index.lexical(query, kinds).collect()] == want
    assert index.lexical("潮汐表").count() == 0 and index.lexical("nowhere").count() == 0
    plan = index.postings(["peat"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan, plan
    assert search.Index(spark).build(docs.limit(0)).lexical("peat").count() == 0


def test_reports_by_relevance_then_rank_then_id(spark):
    reports = spark.createDataFrame([("g1", "gates", "the sluice gate and the sluice", 1.0, False), ("g2", "kites", "weather kite", 9.0, True), ("g3", "silos", "grain silo", 3.0, False), ("g4", None, None, None, None)], "lineage_id string, title string, summary string, rank double, stale boolean").filter("lineage_id <> 'g4'")
    communities = spark.createDataFrame([(f"g{i}",) for i in range(1, 5)], "lineage_id string")
    got = [(r["lineage_id"], r["state"], round(r["relevance"], 9)) for r in search.global_search(reports, communities, "sluice gate").collect()]
    assert got == [("g1", "present", round(1 / 61 + 1e-6, 9)), ("g2", "stale", 9e-6), ("g3", "present", 3e-6), ("g4", "missing", 0.0)]
    assert [r["lineage_id"] for r in search.global_search(reports, communities, "潮汐表").collect()] == ["g2", "g3", "g1", "g4"]
    assert search.global_search(reports.limit(0), communities, "sluice").filter("state = 'missing'").count() == 4


def test_community_hashes_follow_their_members(spark):
    found = lambda rows: spark.createDataFrame(rows, "id string, level int, parent string, members array<string>")
    hashes = lambda rows: spark.createDataFrame(rows, "slug string, input_hash string")
    run = lambda f, h: {r["id"]: r["input_hash"] for r in cluster.community_hashes(found(f), hashes(h)).collect()}
    one = run([("g1", 0, None, ["a", "b"]), ("g2", 0, None, ["c"])], [("a", "1"), ("b", "2"), ("c", "3")])
    assert set(one) == {"g1", "g2"} and one["g1"] != one["g2"]
    assert run([("g1", 0, None, ["b", "a"]), ("g2", 0, None, ["c"])], [("c", "3"), ("b", "2"), ("a", "1")]) == one  # whatever the order
    changed = run([("g1", 0, None, ["a", "b"]), ("g2", 0, None, ["c"])], [("a", "1"), ("b", "changed"), ("c", "3")])
    assert changed["g1"] != one["g1"] and changed["g2"] == one["g2"]


def test_hits_without_evidence_are_withheld(spark):
    schema = "doc_id long, bm25 double, cosine double"
    weak, strong = spark.createDataFrame([(1, 1.9, None), (2, None, 0.34)], schema), spark.createDataFrame([(1, 0.1, None), (2, None, 0.35)], schema)
    assert search.shown(search.gate(weak)).count() == 0 and search.shown(search.gate(strong)).count() == 2
    assert [tuple(r) for r in search.signals(weak).collect()] == [(2, 1.9, 0.34, False, "no evidence above the floors")]
    assert search.signals(strong).first()["note"] is None and search.signals(weak.limit(0)).first()["hits"] == 0
