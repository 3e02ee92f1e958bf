"""Folders of domains, pages, the command line and the pipelines that come with the library."""

import json

import pytest

from tripleforge import __main__ as cli
from tripleforge.clients import ClientConfig
from tripleforge.operators import constraints as C
from tripleforge.operators import graph as G
from tripleforge.plans import augment as A
from tripleforge.plans import pipeline
from tripleforge.plans.domains import DomainResourceError, read_domain
from tripleforge.sources import readers, writers

TRIPLE = "record_id string, seq int, head string, relation string, tail string, inference string, justification string"
ANSWER = '[{"head": "p", "relation": "q", "tail": "r"}]'


def _folder(root):
    (root / "extraction").mkdir(parents=True)
    (root / "augmentation" / "connectivity").mkdir(parents=True)
    (root / "extraction" / "prompt_open.md").write_text(" open {{record_json}} \n")
    (root / "extraction" / "prompt_constrained.md").write_text("closed {{record_json}}")
    (root / "extraction" / "examples.json").write_text('[{"text": "A owns B", "extractions": [{"char_start": 0, "attributes": {"head": "A", "relation": "owns", "tail": "B"}}]}]')
    (root / "augmentation" / "connectivity" / "prompt.md").write_text("join")
    (root / "schema.json").write_text('{"entity_types": ["Firm"], "relation_types": ["sells"]}')


def test_domain_of_a_folder(tmp_path):
    root = tmp_path / "trade"
    _folder(root)
    domain = read_domain(str(root))
    assert (domain.name, domain.strategies(), domain.prompt("extraction")) == ("trade", ["connectivity"], "open {{record_json}}")
    assert domain.full_prompt("extraction") == 'Example:\nA owns B\nAnswer:\n[{"head": "A", "relation": "owns", "tail": "B"}]\n\nopen {{record_json}}'
    assert not domain.constraints("extraction").enforce
    from dataclasses import replace

    closed = replace(domain, constrained=True)
    assert closed.prompt("extraction") == "closed {{record_json}}" and closed.constraints("extraction").relations == {"sells", "owns"}
    (tmp_path / "p.md").write_text("mine")
    assert read_domain(str(root), prompt=str(tmp_path / "p.md")).prompt("extraction") == "mine"
    with pytest.raises(DomainResourceError) as e:
        domain.prompt("enrichment")
    assert e.value.domain_name == "trade"
    (root / "schema.json").write_text("{")
    with pytest.raises(DomainResourceError):
        read_domain(str(root))
    with pytest.raises(DomainResourceError):
        read_domain(str(tmp_path / "none"))


def test_client_defaults():
    gemini, ollama = ClientConfig("gemini"), ClientConfig("ollama", max_workers=2)
    assert (gemini.model_id, gemini.max_workers, gemini.batch_length) == ("gemini-2.0-flash", 10, None)
    assert (ollama.model_id, ollama.base_url, ollama.max_workers, ollama.batch_length) == ("llama3.1", "http://localhost:11434", 2, 5)


def test_answers_in_other_forms(spark):
    texts = ['[{"attributes": {"head": "a"}}]', '[{"attributes": null, "extraction_text": " {\\"head\\": \\"b\\"} "}]', '{"facts": [{"head": "c"}]}']
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "record_id string, response string")
    assert {(r.record_id, r.head) for r in A.parse_triples(rows, any_key=True).collect()} == {("0", "a"), ("1", "b"), ("2", "c")}
    assert {r.head for r in A.parse_triples(rows).where("record_id = '2'").collect()} == {None}


def test_labels_that_are_strings_and_warning(spark):
    rows = spark.createDataFrame([("r", 0, "A", "owns", "B", " Firm ", ["Firm"]), ("r", 1, "A", "owns", "B", "Dog", None), ("r", 2, "A", "owns", "B", None, [" "])], "record_id string, seq int, head string, relation string, tail string, head_type string, tail_type array<string>")
    judged = C.judge(rows, C.Constraints(True, ("firm",), ("owns",)))
    assert [r.type_ok for r in judged.orderBy("seq").collect()] == [True, False, None]
    with pytest.warns(UserWarning, match="rejects 1 triples"):
        assert C.warn_of_rejects("extract", judged) == 1


def test_communities_and_their_links(spark):
    edges = spark.createDataFrame([("r", i, a, b, "x", "explicit") for i, (a, b) in enumerate(["ab", "bc", "ca", "de", "ef", "fd", "ad"])], "record_id string, edge_seq int, src string, dst string, relation string, inference string")
    nodes = spark.createDataFrame([("r", i, x) for i, x in enumerate("abcdefz")], "record_id string, node_seq int, node string")
    members = G.communities(edges)
    assert [tuple(r) for r in G.community_links(edges, members).collect()] == [("r", 0, 1, 1)]
    got = {r.id: r.community for r in G.node_elements(nodes, edges, members=members).collect()}
    assert got == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "f": 1, "z": 0}


def test_pages(spark):
    records = spark.createDataFrame([("a", "p likes <r>"), ("b", "nothing"), ("c", None), ("d", "zzz")], "record_id string, text string")
    triples = spark.createDataFrame([("a", 0, "p", "likes", "<r>", "explicit", None), ("d", 0, "x", "is", "y", "explicit", None)], TRIPLE)
    from tripleforge.operators.triples import entity_spans

    pages = {r.record_id: r.html for r in writers.text_pages(records, triples, entity_spans(triples, records)).collect()}
    assert set(pages) == {"a", "b", "c", "d"}
    assert "<span>2 entities</span><span>1 triples</span>" in pages["a"] and ">&lt;r&gt;</mark>" in pages["a"]
    assert "No text or no triples" in pages["b"] and "No text or no triples" in pages["c"] and "No entities found" in pages["d"]
    page = writers.network_pages(G.view(*G.graph(triples)), dark=True, layout="circle").where("record_id = 'a'").first().html
    data = json.loads(page.split('id="elements">')[1].split("</script>")[0])
    assert {n["full_label"] for n in data["nodes"]} == {"p", "<r>"} and data["edges"][0]["label"] == "likes"
    assert "<r>" not in page and "<option selected>circle" in page
    assert {r.record_id: r.json for r in writers.triples_json(triples, records).collect()}["b"] == "[]"


def test_line_of_bad_json_and_ocr(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id": 7, "text": "x"}\n\n{bad\n{"id": 8}\n')
    with pytest.raises(readers.DataLoadError) as e:
        readers.read_table(spark, str(tmp_path / "d.jsonl"))
    assert e.value.line_number == 3
    (tmp_path / "o.jsonl").write_text('{"id": 1, "text": "du ty", "title": "th e Cour t", "other": "du ty"}\n{"id": 2, "text": null}\n')
    out = readers.clean_ocr_jsonl(spark, str(tmp_path / "o.jsonl"))
    assert out == str(tmp_path / "o.cleaned.jsonl")
    got = {r.id: (r.text, r.title, r.other) for r in readers.read_table(spark, out).collect()}
    assert got == {1: ("duty", "the Court", "du ty"), 2: (None, None, None)}


def test_commands(spark, tmp_path, capsys):
    out, source = tmp_path / "out", tmp_path / "in.jsonl"
    source.write_text('{"id": "a", "text": "Alpha of beta and Gamma of delta"}\n{"id": "b", "text": "none"}\n')
    base = ["--input", str(source), "--domain", "default", "--client", "rule", "--output-dir", str(out)]
    assert cli.main(["extract", *base]) == 0
    assert len(json.loads((out / "json" / "a.json").read_text())) == 2 and json.loads((out / "json" / "b.json").read_text()) == []
    assert json.loads((out / "run.json").read_text())["client"]["client_type"] == "rule"
    assert cli.main(["augment", "connectivity", "--max-disconnected", "1", *base]) == 0
    assert {t["relation"] for t in json.loads((out / "json" / "a.json").read_text())} == {"of", "part_of_context"}
    assert cli.main(["convert", "--input", str(out / "json")]) == 0 and (out / "graphml" / "a.graphml").exists()
    assert cli.main(["visualize", "network", "--input", str(out / "graphml")]) == 0 and (out / "graphml" / "visualizations" / "a.html").exists()
    assert cli.main(["visualize", "extraction", "--input", str(source), "--triples", str(out / "json"), "--output-dir", str(out / "text")]) == 0
    assert (out / "text" / "a.html").exists() and (out / "text" / "b.html").exists()
    assert cli.main(["run", "--extract", "--convert", *base]) == 0
    with pytest.raises(SystemExit):
        cli.main(["run"])
    capsys.readouterr()
    assert cli.main(["list", "pipelines"]) == 0
    assert [x.split(":")[0] for x in capsys.readouterr().out.splitlines()] == ["legal-gemini", "legal-lmstudio", "legal-ollama"]


def test_records_without_triples_are_extracted_before_they_are_refined(spark):
    records = spark.createDataFrame([("a", "x"), ("b", "y")], "record_id string, text string")
    config = ClientConfig("replay", options={"a": ANSWER})
    state = pipeline.run(pipeline.start(records), ["augment"], pipeline.Settings(config))
    assert [r.record_id for r in state.triples.collect()] == ["a"]
    assert [(r.record_id, r.step) for r in pipeline.first_errors(state).collect()] == [("b", "extract")]


def test_facade():
    import tripleforge

    assert all(callable(getattr(tripleforge, name)) for name in tripleforge.__all__)
    with pytest.raises(AttributeError):
        tripleforge.nothing  # noqa: B018
