"""What a model is shown, and that it is shown all of it."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tripleforge.clients import ClientConfig
from tripleforge.plans import augment as A
from tripleforge.plans.domains import get_domain

TRIPLE = "record_id string, seq int, head string, relation string, tail string, inference string, justification string"


def shown(monkeypatch, answer="[]"):
    """The prompts that call_model gets, by iteration."""
    prompts = []

    def call(table, config, kind, iteration=0):
        rows = table.collect()
        prompts.append({r.record_id: r.prompt for r in rows})
        return table.sparkSession.createDataFrame([(r.record_id, answer, None) for r in rows], "record_id string, response string, error string")

    monkeypatch.setattr(A, "call_model", call)
    return prompts


def test_augmentation_prompts_hold_the_evidence(spark, monkeypatch):
    names = [f"n{i:02d}" for i in range(20)]
    rows = [(a, "to", b) for a, b in zip(names, names[1:])] + [("Component\n7: x", "is", "y"), ("z", "has", "z")]
    triples = spark.createDataFrame([("r", i, *row, "explicit", f"why {i}") for i, row in enumerate(rows)], TRIPLE)
    records = spark.createDataFrame([("r", "the text")], "record_id string, text string")
    prompts = shown(monkeypatch)
    A.connectivity(records, triples, ClientConfig("ollama"), get_domain("default"), max_disconnected=1, max_iterations=1)
    prompt = prompts[0]["r"]
    record = json.loads(prompt.split("Record:\n")[1].splitlines()[0])
    assert [(t["head"], t["relation"], t["tail"]) for t in record["current_triples"]] == rows and record["current_triples"][3]["justification"] == "why 3"
    parts = [json.loads(x.split(": ", 1)[1]) for x in prompt.splitlines() if x.startswith("Component ")]
    assert [p["name"] for p in parts] == ["Component\n7: x", "n00", "z"]
    assert parts[1]["entities"] == ", ".join(names[:15]) + " ... (+5 more)" and parts[1]["triples"].startswith("(n00) --[to]--> (n01); ") and parts[1]["triples"].endswith(" ... (+9 more)")
    A.entity_resolution(records, triples, ClientConfig("ollama"), get_domain("default"))
    record = json.loads(prompts[1]["r"].split("Record:\n")[1].splitlines()[0])
    edges = {e["name"]: e["edges"] for e in record["entities"]}
    assert len(edges) == 23 and edges["n01"] == ["(n00) --[to]--> (n01)", "(n01) --[to]--> (n02)"] and edges["z"] == ["(z) --[has]--> (z)"]


@pytest.fixture
def server():
    """A model server that finds each "Fact<n> is here" of a text once, in later passes also "late"; calls: the texts it was sent."""
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
            text = json.loads(prompt.split("Record:\n")[1].splitlines()[0])["text"]
            again = text in calls
            calls.append(text)
            self.send_response(500 if "broken" in text else 200)
            self.end_headers()
            found = [{"head": h, "relation": "is", "tail": "here", "justification": "again" if again else "first"} for h in re.findall(r"Fact\d+", text)]
            late = [{"head": "late", "relation": "is", "tail": "here"}] * again
            self.wfile.write(json.dumps({"response": json.dumps(late + found)}).encode())

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", calls
    http.shutdown()


def test_extraction_reads_all_of_a_text_in_chunks_and_passes(spark, server):
    url, calls = server
    text = " ".join(f"Fact{i} is here." for i in range(100)) + "x" * 150
    records = spark.createDataFrame([("r", text), ("e", ""), ("b", "Fact0 is here. " * 10 + "broken")], "record_id string, text string").coalesce(1)
    config = ClientConfig("ollama", base_url=url, max_char_buffer=100, extraction_passes=2, max_workers=1, batch_length=2)
    found, errors = A.extract(records, config, get_domain("default"))
    rows = [(r.record_id, r.head, r.justification) for r in found.orderBy("record_id", "seq").collect()]
    assert [r for r in rows if r[1] != "late"] == [("r", f"Fact{i}", "first") for i in range(100)]
    assert {r[0] for r in rows if r[1] == "late"} == {"e", "r"}
    assert [r.record_id for r in errors.collect()] == ["b"]
    assert max(map(len, calls)) <= 100 and len(calls) > 2 * len(text) // 100
    for size in (1, 7, 100, 10_000):
        assert "".join(A.chunks(text, size)) == text and max(map(len, A.chunks(text, size))) <= size
    with pytest.raises(ValueError):
        ClientConfig("ollama", extraction_passes=0)
