import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tripleloom.operators import rules
from tripleloom.operators.extraction import call, parse_replies, sections
from tripleloom.sources import files


def texts(spark, *rows):
    return spark.createDataFrame([(f"d{i}", t, p) for i, (t, p) in enumerate(rows)], "doc_id string, text string, relative_path string")


def facts(df):
    return [(r["predicate"], r["object"], r["target_kind"], r["confidence"]) for r in df.orderBy("subject", "place").collect()]


NOTE = """# Graph Sampling  
A note on [[Random Walks#intro|walks]] and [[Sampling]], [[Sampling]] again #graph-ml, see [paper](https://Example.ORG/x?q=1) and http://Other.example.com/a.
#nospace is a tag? a#b is none, ##no
## Second\u2028### Third
MAIN RESULTS OF-WORK
[local](notes/a.md) [](empty) [mail](mailto:x@y.z)
"""


def test_vault_rules(spark):
    got = facts(rules.extract(texts(spark, (NOTE, "n/a.md")), "vault"))
    assert got == [
        ("HAS_FILE_TYPE", "md", "file_type", 0.95), ("CONTAINS_HEADING", "Graph Sampling", "heading:h1", 0.90),
        ("LINKS_TO", "Random Walks", "vault_link", 0.86), ("LINKS_TO", "Sampling", "vault_link", 0.86), ("REFERENCES_URL_HOST", "example.org", "url_host", 0.82), ("HAS_TAG", "graph-ml", "tag", 0.82),
        ("CONTAINS_HEADING", "Second", "heading:h2", 0.90), ("CONTAINS_HEADING", "Third", "heading:h3", 0.90), ("LINKS_TO", "local", "local_link", 0.80),
    ]


def test_universal_rules_and_caps(spark):
    df = texts(spark, (NOTE, "n/a.md"))
    got = facts(rules.extract(df, "universal"))
    assert ("CONTAINS_HEADING", "Main Results Of-Work", "heading", 0.70) in got
    assert ("REFERENCES_URL", "example.org", "url_host", 0.82) in got and ("REFERENCES_URL", "Example.ORG", "url_host", 0.75) in got and ("REFERENCES_URL", "Other.example.com", "url_host", 0.75) in got
    assert not any(p == "LINKS_TO" and o == "local" for p, o, _, _ in got)
    assert facts(rules.extract(df, "universal", max_facts=3)) == got[:3]


def test_structured_rules(spark):
    csv = "Columns: name, size\nname: alpha | size: 3\n.path.to: 7\n- item: x\n\nafter: blank\n#tagged"
    got = facts(rules.extract(texts(spark, (csv, "a.csv")).withColumn("s", F.lit(True)), "universal", structured="s"))
    assert got[0][:2] == ("HAS_FILE_TYPE", "csv")
    assert [g[:2] for g in got[1:]] == [("HAS_COLUMN", "name"), ("HAS_COLUMN", "size"), ("CONTAINS_KEY", "name=alpha | size: 3"), ("CONTAINS_KEY", "path.to=7")]


def test_extract_edge_cases(spark):
    df = texts(spark, (None, "a.md"), ("", "b.md"), (" \n\t", "c.md"), ("word " * 100_000, "Makefile"), ("x", None))
    got = facts(rules.extract(df, "universal"))
    assert got == [("HAS_FILE_TYPE", "text", "file_type", 0.95)] or len(got) == 2
    assert rules.extract(df.limit(0), "universal").collect() == []
    long = rules.extract(texts(spark, ("# " + "h" * 1000, "a.md")), "universal").filter("predicate = 'CONTAINS_HEADING'").first()
    assert len(long["object"]) == 240 and len(long["evidence"]) == 700


def test_flatten():
    assert files.flatten({"a": {"b": 1, "c": None, "d": " "}, "l": [1, {"x": 2}], "n": 3}) == "a.b: 1\nl[0]: 1\nl[1].x: 2\nn: 3"
    deep = {"a": {"a": {"a": {"a": {"a": {"a": {"a": 1}}}}}}}
    assert files.flatten(deep) == ""
    assert len(files.flatten(list(range(80))).splitlines()) == 50


def test_text_formats():
    html = b"<html><head><style>p{}</style><script>var x</script></head><body><nav>menu</nav><h1>Top <b>x</b></h1><p>One <a href='/u'>link</a> two<p>Open<ul><li>item</ul><footer>f</footer></body></html>"
    assert files.file_text(".html", html).splitlines() == ["# Topx", "Onelinktwo", "[link](/u)", "Open", "item"]
    assert files.file_text(".csv", b"a,b\n1,2\n,3\n") == "Columns: a, b\na: 1 | b: 2\nb: 3"
    assert files.file_text(".csv", ("a\n" + "1\n" * 600).encode()).splitlines()[-1] == "... (501+ rows total)"
    assert files.file_text(".tsv", b"a\tb\n1\t2\n") == "Columns: a, b\na: 1 | b: 2"
    assert files.file_text(".jsonl", b'{"a": 1}\nbad\n{"b": [2]}\n') == "a: 1\nbad\nb[0]: 2"
    assert files.file_text(".json", b"{bad") == "{bad"
    assert files.file_text(".yaml", b"a:\n  b: 1\n") == "a.b: 1"
    assert files.file_text(".txt", b"\xff\xfeok").endswith("ok")
    assert files.file_text(".docx", b"no zip") == "" and files.file_text(".pdf", b"no pdf") == ""


def test_docx(tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    assert files.file_text(".docx", (tmp_path / "x.docx").read_bytes()) == "Hello\na | b"


def test_scan(spark, tmp_path):
    for name, body in {"a.md": "# A", "sub/b.txt": "b", "sub/c.bin": "x", "logs/d.md": "d", "Concepts/e.md": "e", "tmp-1/f.md": "f", "node_modules/g.md": "g", "h.csv": "a\n1", "empty.md": ""}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(body)
    u = {r["relative_path"]: r["doc_id"] for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(u) == {"a.md", "sub/b.txt", "Concepts/e.md", "h.csv", "tmp-1/f.md"}
    import hashlib

    assert u["sub/b.txt"] == "doc:" + hashlib.sha256(b"sub/b.txt").hexdigest()[:16]
    assert {r["relative_path"] for r in files.scan(spark, str(tmp_path), "vault").collect()} == {"a.md", "sub/b.txt", "Concepts/e.md"}
    assert {r["relative_path"] for r in files.scan(spark, str(tmp_path), "vault", include=["concepts"]).collect()} == {"a.md", "Concepts/e.md"}
    assert [r["relative_path"] for r in files.scan(spark, str(tmp_path / "a.md")).collect()] == ["a.md"]
    with pytest.raises(ValueError):
        files.scan(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        files.scan(spark, str(tmp_path / "a.md"), "vault")


def test_sections_and_replies(spark):
    long = "words " * 20
    df = texts(spark, (f"---\nt: 1\n---\n{long}\n# One\n{long}\n```py\n#### four {long}\n```\n## Two\nshort", "a.md"), (long, "b.md"), ("short", "c.md"), (None, "d.md"))
    got = [(r["doc_id"], r["section_no"], r["section"].split()[0]) for r in sections(df).orderBy("doc_id", "section_no").collect()]
    assert got == [("d0", 0, "words"), ("d0", 1, "#"), ("d1", 0, "words")]
    item = {"subject": "s", "predicate": "P", "object": "o"}
    replies = ["```json\n" + json.dumps({"triples": [item, {**item, "confidence": 0.75}, {**item, "confidence": 0.7}, {**item, "confidence": 7}, {**item, "confidence": "x"}, {"subject": "s"}]}) + "\n```", "no json", "[]", None, "{}"]
    out = parse_replies(spark.createDataFrame([(f"d{i}", r) for i, r in enumerate(replies)], "doc_id string, reply string")).collect()
    assert sorted((r["confidence"], r["layer"]) for r in out) == [(0.7, "llm_hypotheses"), (0.75, "source_facts"), (0.8, "source_facts"), (1.0, "source_facts")]

    def client(text, system):
        if text.startswith("#"):
            raise RuntimeError("down")
        return json.dumps({"triples": [item]})

    assert parse_replies(call(sections(df), client)).count() == 2
