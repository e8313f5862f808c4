"""Commands in bulk: each refusal once, nulls, repeats and empty tables."""

from cairn.operators import commands as C
from cairn.operators import views as V


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_merges(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "slug string")
    m = spark.createDataFrame([("b", "a")], "duplicate string, canonical string")
    asked = spark.createDataFrame([("C", "a"), ("a", "b"), ("a", "a"), ("", "a"), (None, "a"), ("z", "a")], "duplicate string, canonical string")
    want = [("", "empty_slug"), ("a", "cycle"), ("a", "same_entity"), ("c", None), ("z", "no_such_entity"), (None, "empty_slug")]
    assert rows(C.merge(asked, e, m), "duplicate", "refusal") == sorted(want, key=repr)
    assert C.merge(asked.limit(0), e, m).count() == 0 and C.merge(asked, e.limit(0), m.limit(0)).count() == 6


def test_resolutions_and_captures(spark):
    asked = spark.createDataFrame([("x_1", "dismiss"), ("x_1", "confirm"), ("x_9", "reopen"), ("x_1", "drop"), ("x_1", None)], "id string, action string")
    ids = spark.createDataFrame([("x_1",), ("x_1",)], "id string")
    assert rows(C.resolve(asked, ids), "action", "refusal") == sorted([("dismiss", None), ("confirm", "needs_a_person"), ("reopen", "no_such_item"), ("drop", "bad_action"), (None, "bad_action")], key=repr)
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, " \n"), (5, "known")], "id long, text string")
    known = C.capture(spark.createDataFrame([(9, "known")], "id long, text string"), spark.createDataFrame([], "hash string")).select("hash")
    assert rows(C.capture(texts, known), "id", "refusal") == [(1, None), (2, "repeated"), (3, "empty"), (4, "empty"), (5, "captured")]


def test_repaired_signatures(spark):
    e = spark.createDataFrame([("p", "paper"), ("c", "concept"), ("t", "tool"), ("u", "unknown")], "slug string, type string")
    rules = spark.createDataFrame([("cites", ["paper"], ["concept"])], "type string, domain array<string>, range array<string>")
    a = spark.createDataFrame([("1", "p", "c", "cites"), ("2", "c", "p", "cites"), ("3", "t", "t2", "cites"), ("4", "u", "c", "cites"), ("5", "c", "p", "other"), ("6", "c", "p", None)], "id string, source string, target string, type string")
    got = rows(V.repair_signatures(a, e, rules), "id", "source", "target", "type", "direction_corrected", "drop")
    assert got == [("1", "p", "c", "cites", False, None), ("2", "p", "c", "cites", True, None), ("3", "t", "t2", None, False, "domain_mismatch"), ("4", "u", "c", "cites", False, None), ("5", "c", "p", "other", False, None), ("6", "c", "p", None, False, None)]


def test_documents_and_overlay(spark):
    units = spark.createDataFrame([("u1", "c1", None, "only\nunit"), ("u2", "c2", "Page 1", "a"), ("u3", "c2", None, "\nb")], "id string, capture_id string, locator string, text string")
    notes = spark.createDataFrame([("n1", "body", "body\nclaim")], "id string, body string, text string")
    others = spark.createDataFrame([("d_1", "report", "R", "r")], "doc_id string, kind string, title string, text string")
    assert rows(V.documents(units, notes, others), "doc_id", "kind", "title") == [("c1", "capture", "only"), ("d_1", "report", "R"), ("n1", "note", "body"), ("u2", "unit", "Page 1"), ("u3", "unit", "b")]
    items = spark.createDataFrame([("k1", "superseded", None), ("k2", "proposed", "k3"), ("k3", "confirmed", None), ("k4", "dismissed", None)], "id string, status string, supersedes string")
    over = spark.createDataFrame([("k1", "confirm"), ("k2", "confirm"), ("k4", "reopen")], "assertion string, action string")
    assert rows(V.supersede(V.restatus(items, over)), "id", "status") == [("k1", "superseded"), ("k2", "confirmed"), ("k3", "superseded"), ("k4", "proposed")]
