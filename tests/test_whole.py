"""Queries that list everything: against brute force too."""

import __spark_entry__ as entry
from cairn.functions import scalars as S


def run(spark, sf, name):
    return entry.queries()[name](spark, sf).collect()


def first_line(text, limit):
    return next((x.strip()[:limit] for x in text.splitlines() if x.strip()), "")


def test_first_lines_of_every_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").select("doc_id", "text").collect()
    got = sorted((r["doc_id"], r["line"]) for r in run(spark, sf, "P1_first_lines"))
    assert got == sorted((r["doc_id"], first_line(r["text"], 80)) for r in docs)
    assert any(not r["text"].isascii() for r in docs)
    texts = ["", " \n\u3000\u2028\xa0潮汐表\u2009\nx", "\x85\x1c a\x0bb", "\ufeffx", "it\u2019s\x1f\r\ny", "\u200b", "😀" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r["l"] for r in df.select("i", S.first_line("t", 80).alias("l")).orderBy("i").collect()] == [first_line(t, 80) for t in texts]


def test_catalog_lists_every_note_and_entity(spark, sf):
    e = sorted((-r["rank"], r["slug"], r["type"]) for r in run(spark, sf, "G1_entities"))
    first = {}
    for r in sorted(spark.read.parquet(f"{sf}/notes.parquet").collect(), key=lambda r: (r["arrived_at"], (r["created"] is not None, r["created"] or ""), (r["body"] is not None, r["body"] or ""))):
        first.setdefault(r["id"], r)
    n = sorted(first.values(), key=lambda r: (r["created"] is not None, r["created"] or "", r["id"]))
    captures = {r["capture_id"] for r in spark.read.parquet(f"{sf}/text_units.parquet").collect()} - {None}
    want = ["# Index", "", f"{len(captures)} captures · {len(n)} notes · {len(e)} entities", "", "## Notes", ""]
    want += [f"- `{r['id']}` {(r['created'] or '')[:10]} — {first_line(r['body'] or '', 120)}" for r in n]
    want += ["", "## Entities", ""] + [f"- [[{slug}]] — {kind}, rank {-rank}" for rank, slug, kind in e]
    assert len(e) > 200
    assert [r["line"] for r in sorted(run(spark, sf, "K11_catalog"), key=lambda r: (r["part"], r["place"]))] == want


def test_the_whole_queue_is_walked(spark, sf):
    pending = [r for r in run(spark, sf, "G1_assertions") if r["status"] == "proposed"]
    ids = [r["id"] for r in sorted(pending, key=lambda r: (r["strength"] is None, -(r["strength"] or 0), r["id"]))]
    assert len(ids) > 100
    assert sorted(map(tuple, run(spark, sf, "W7_next_in_queue"))) == sorted(zip(ids, [*ids[1:], ids[0]]))
