"""Parsers, logs, front-matter and writers."""

import io
import json
import zipfile

import pytest

from cairn.sources import config, embed, logs, parsers, vault

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_detection_by_extension_magic_and_text():
    assert parsers.detect("a.MD", b"") == "markdown"
    assert parsers.detect("x", b"%PDF-1.7") == "pdf"
    assert parsers.detect("x", archive({"word/document.xml": ""})) == "docx"
    assert parsers.detect("x", b"  <!DOCTYPE html><p>") == "html"
    assert parsers.detect("x.bin", b"plain") == "text"


def test_html_content_root_sections_and_tables():
    page = b"<html><head><title>T</title></head><body><nav>menu</nav><main><h1>Head</h1><p>One <b>two</b></p><ul><li>x<li>y</ul><table><tr><th>a</th></tr><tr><td>1</td></tr></table><script>no()</script></main></body></html>"
    title, _, blocks = parsers.parse_html(page)
    assert title == "T"
    assert [(b["kind"], b["text"]) for b in blocks] == [("heading", "Head"), ("paragraph", "One two"), ("list_item", "x"), ("list_item", "y"), ("table", "| a |\n| --- |\n| 1 |")]


def test_markdown_blocks():
    title, _, blocks = parsers.parse_markdown(b"# Top\n\npara\nmore\n\n- item\n1. first\n\n```py\ncode\n```\n")
    assert title == "Top"
    assert [b["kind"] for b in blocks] == ["heading", "paragraph", "list_item", "list_item", "code"]


def test_nested_blocks_come_once_with_the_outermost():
    page = b"<html><body><ul><li><p>alpha</p></li><li>outer<ul><li>inner</li></ul></li></ul><form><p>kept</p><button>Go</button></form></body></html>"
    assert [(b["kind"], b["text"]) for b in parsers.parse_html(page)[2]] == [("list_item", "alpha"), ("list_item", "outer inner"), ("paragraph", "kept"), ("paragraph", "Go")]


def test_closing_signs_of_a_heading_need_a_blank():
    heads = [b["text"] for b in parsers.parse_markdown(b"# C#\n\n## Sub ##\n\n### a # b\n")[2]]
    assert heads == ["C#", "Sub", "a # b"]


@pytest.mark.parametrize("text,encoding", [("中文测试内容，这是一段足够长的文本。", "gb18030"), ("這是一個中文的測試，我們來看看。", "big5"), ("これは日本語のテストです。漢字とかな。", "shift_jis"), ("これは日本語のテストです。漢字とかな。", "euc_jp"), ("이것은 한국어 시험입니다.", "euc_kr"), ("café über señor – naïve", "cp1252"), ("héllo", "utf-8"), ("汐 x", "utf-16")])
def test_encodings(text, encoding):
    assert parsers.decode_text(text.encode(encoding)) == text


def test_sheets_keep_blank_rows_and_say_where_they_come_from():
    _, meta, blocks = parsers.parse_delimited(b"a\tb\n\t\n1\t2|3\n", "\t", "folder/t.tsv")
    assert blocks == [parsers.block("table", "| a | b |\n| --- | --- |\n|  |  |\n| 1 | 2\\|3 |", None, {"kind": "sheet", "label": "t.tsv", "index": 1})] and meta == {}


def test_the_row_cap_is_a_parameter_and_none_reads_all():
    data = ("n\n" + "".join(f"{i}\n" for i in range(2050))).encode()
    capped, whole = parsers.parse_bytes("c.csv", data), parsers.parse_bytes("c.csv", data, None)
    assert capped["blocks"][0]["text"].count("\n") == 2001 and json.loads(capped["metadata"])["truncated_rows"] == {"c.csv": 50}
    assert whole["blocks"][0]["text"].count("\n") == 2051 and json.loads(whole["metadata"]) == {}


def test_rendering_repeats_no_place_and_a_format_can_be_added():
    page = lambda i: parsers.locator("page", str(i), i)
    blocks = [parsers.block("heading", "T", 2, page(1)), parsers.block("paragraph", "a", None, page(1)), parsers.block("list_item", "b", None, None), parsers.block("code", "c", None, page(2)), parsers.block("paragraph", "d", None, parsers.locator("section", "S", 1))]
    assert parsers.to_markdown(blocks) == "## Page 1\n\n## T\n\na\n\n- b\n\n## Page 2\n\n```\nc\n```\n\nd\n"
    assert parsers.to_markdown([]) == ""
    parsers.register("shout", lambda data: (None, {}, [parsers.block("paragraph", data.decode().upper())]), "shout")
    assert parsers.parse_bytes("x.shout", b"hi")["blocks"][0]["text"] == "HI"


def test_office_formats():
    doc = archive({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading9"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    _, _, blocks = parsers.parse_docx(doc)
    assert [(b["kind"], b["level"]) for b in blocks] == [("heading", 6), ("paragraph", None), ("table", None)]
    a = 'xmlns:a="http://a" xmlns:p="http://p"'
    slide = lambda t: f'<p:sld {a}><p:sp><p:ph type="title"/><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp></p:sld>'
    _, _, blocks = parsers.parse_pptx(archive({"ppt/presentation.xml": "<x/>", "ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two")}))
    assert [b["text"] for b in blocks] == ["two", "ten"]
    r = 'xmlns:r="http://r"'
    sheet = '<worksheet><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3.0</v></c></row></worksheet>'
    _, meta, blocks = parsers.parse_xlsx(archive({"xl/workbook.xml": f'<workbook {r}><sheet name="S" r:id="i1"/></workbook>', "xl/_rels/workbook.xml.rels": '<x><Relationship Id="i1" Target="worksheets/sheet1.xml"/></x>', "xl/sharedStrings.xml": "<sst><si><t>k</t></si></sst>", "xl/worksheets/sheet1.xml": sheet}))
    assert blocks[0]["text"].startswith("| k |  | 3 |") and meta == {"sheet_names": ["S"]}


def test_delimited_sniffs_and_bad_files_fall_back(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;2\n3;4\n")
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.txt").write_bytes("caf\xe9\n\nzwei".encode("cp1252"))
    out = {r["path"].rsplit("/", 1)[-1]: r for r in parsers.read_documents(spark, str(tmp_path)).collect()}
    assert out["a.csv"]["blocks"][0]["text"] == "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |"
    assert out["b.docx"]["parser_error"].startswith("docx: BadZipFile") and out["b.docx"]["blocks"][0]["text"] == "not a zip"
    assert out["c.txt"]["markdown"] == "café\n\nzwei\n"


def test_torn_last_line_is_skipped_and_interior_corruption_raises(spark, tmp_path):
    line = json.dumps({"op": "o1", "ts": "t", "assertion": "x_1", "action": "confirm", "via": "cli"})
    good = tmp_path / "good.jsonl"
    good.write_text(f'{line}\n\n{line.replace("o1", "o2")}\n{line[:20]}')
    assert [(r["seq"], r["op"]) for r in logs.read_log(spark, str(good), "decisions").orderBy("seq").collect()] == [(0, "o1"), (2, "o2")]
    bad = tmp_path / "bad.jsonl"
    bad.write_text(f"{line[:20]}\n{line}\n")
    with pytest.raises(Exception, match="corrupt log line"):
        logs.read_log(spark, str(bad), "decisions").collect()
    logs.append_line(str(good), {"b": "x y", "a": 1})
    assert good.read_text().endswith('{"a": 1, "b": "x\\u2028y"}\n')


def test_vault_scan_degrades_and_first_path_wins(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nid: n_1\ntitle: A\n---\nbody")
    (tmp_path / "b.md").write_text("---\nid: n_1\n---\nother")
    (tmp_path / "c.md").write_text("---\nid: [\n---\nbroken")
    rows = vault.scan(spark, str(tmp_path))
    kept, repeats = vault.split_repeats(rows)
    assert [r["body"] for r in kept.collect()] == ["body"] and repeats.count() == 1
    assert rows.filter("error is not null").first()["body"].endswith("broken")
    assert vault.scan(spark, str(tmp_path), mode="drop").count() == 2


def test_swap_write_and_user_fields(tmp_path):
    p = tmp_path / "page.md"
    vault.swap_write(p, "---\nuser: {aliases: [x]}\ntype: tool\n---\nold", None)
    with pytest.raises(vault.Conflict):
        vault.swap_write(p, "new", None)
    with pytest.raises(vault.Conflict):
        vault.swap_write(p, "new", vault.content_hash("something else"))
    vault.write_page(p, {"type": "paper"}, "new body")
    data, body = vault.parse_front_matter(p.read_text())
    assert data == {"type": "paper", "user": {"aliases": ["x"]}} and body == "new body"


def test_upsert_last_row_wins(spark):
    cur = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, seq int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, seq int")
    assert {(r["k"], r["v"]) for r in vault.upsert(cur, new, "k").collect()} == {("a", 1), ("b", 4), ("c", 5)}


def test_stub_embeddings_are_unit_and_stable(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, text string")
    v = [r["embedding"] for r in embed.embed(df, "text").orderBy("id").collect()]
    assert v[0] == v[1] != v[2] and abs(sum(x * x for x in v[0]) - 1) < 1e-5
    with pytest.raises(ValueError):
        embed.embedder("cloud")


CONFIG = """---
schema_version: 1
entity_types: [person, paper]
edge_types:
  cites: {directed: true, cluster_weight: 1, domain: [paper], range: [paper]}
  knows: {directed: false, cluster_weight: 0.5, domain: [person]}
thresholds: {cluster_activation_entities: 150, abstain_bm25_floor: 2.0, abstain_cosine_floor: 0.35, community_lineage_jaccard: 0.5}
embedder: {kind: stub}
---
## Extraction
"""


def test_configuration_tells_all_faults_at_once(spark):
    c = config.parse(CONFIG)
    assert c.thresholds["duplicate_cosine_floor"] == 0.92 and c.templates == "## Extraction\n"
    assert [tuple(r) for r in c.edges(spark).collect()] == [("cites", False, 1.0, ["paper"], ["paper"]), ("knows", True, 0.5, ["person"], None)]
    broken = CONFIG.replace("directed: true, cluster_weight: 1", "directed: 1, cluster_weight: heavy, colour: red").replace("domain: [person]", "domain: [robot], range: [paper]").replace("abstain_bm25_floor: 2.0, ", "odd: 1, ").replace("schema_version: 1", "schema_version: 7")
    with pytest.raises(config.ConfigError) as e:
        config.parse(broken)
    for part in ("directed is no boolean", "cluster_weight is no number", "unknown colour", "names unknown robot", "symmetric", "misses abstain_bm25_floor", "unknown odd", "schema_version 7"):
        assert part in str(e.value)


def test_typed_records_and_exported_graph(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.md").write_text("---\nid: n_1\nstrength: 3\ntags: [x, y]\n---\nbody")
    (tmp_path / "v" / "b.md").write_text("---\nid: [\n---\nbroken")
    rows = vault.typed(vault.scan(spark, str(tmp_path / "v")), "id string, strength int, tags array<string>, gone string").collect()
    assert [(r["id"], r["strength"], r["tags"], r["gone"], r["body"]) for r in rows] == [("n_1", 3, ["x", "y"], None, "body")]
    edges = spark.createDataFrame([("k1", "a", "b", "cites", 2, True), ("k2", "b", "c", "knows", 0, False)], "key string, source string, target string, type string, weight long, traversable boolean")
    vault.write_graph(edges, f"file://{tmp_path}/graph")
    assert sorted(r["key"] for r in vault.read_graph(spark, f"file://{tmp_path}/graph").collect()) == ["k1", "k2"]
    (tmp_path / "one.json").write_text(json.dumps({"version": 1, "edges": [{"key": "k1", "source": "a", "target": "b", "type": "cites", "weight": 1, "traversable": True, "assertions": [{"id": "x_1", "status": "confirmed"}]}]}))
    assert vault.read_graph(spark, str(tmp_path / "one.json")).first()["assertions"][0]["id"] == "x_1"
    (tmp_path / "two.json").write_text('{"version": 2, "edges": []}')
    with pytest.raises(Exception, match="unsupported graph version 2"):
        vault.read_graph(spark, str(tmp_path / "two.json")).collect()
