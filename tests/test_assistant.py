import json

import pytest
from helpers import FILE_TOKEN, PART_TOKEN, chunk, frame, graph, plant_graphml

from clauseweave import cli
from clauseweave.assistant.loop import ToolLoop, chunk_ids_in
from clauseweave.assistant.tools import SpecTools
from clauseweave.config import Settings
from clauseweave.operators.citations import unsupported_citations
from clauseweave.schema import ALIGNMENT


@pytest.fixture(scope="module")
def tools(spark):
    nodes, edges = graph(
        spark,
        {"boiler": {"entity_type": "Machine"}, "valve": {}, "tank": {}},
        [("f1", "boiler", "valve", {"keywords": "Feeds", "file_path": "24501-j20.md3"}), ("f2", "valve", "tank")],
    )
    chunks = frame(spark, [chunk("c1", "3.4.1", "Pipes", "Warm water reaches the valve. " * 100)])
    aligned = [
        {"graph_item_id": "boiler", "graph_item_type": "node", "chunk_id": c, "confidence": s, "confidence_label": label,
         "match_methods": [], "component_scores": {}, "review_status": "auto"}
        for c, s, label in (("c1", 0.9, "verified"), ("gone", 0.95, "high"), ("c1", 0.5, "candidate"))
    ]
    return SpecTools(nodes, edges, chunks, alignments=spark.createDataFrame(aligned, ALIGNMENT))


def test_tools(tools):
    hit = tools.call("search_spec", {"query": "reaches", "top_k": 99, "section_prefix": None})
    evidence = hit["result"]["hits"][0]
    assert evidence["chunk_id"] == "c1" and len(evidence["excerpt"]) == 1600
    assert evidence["section"] == "3.4.1" and evidence["retrieval_score"] > 0
    found = tools.call("resolve_entities", {"query": "BOILER", "limit": 3})["result"]["matches"]
    assert (found[0]["node_id"], found[0]["entity_type"], found[0]["score"]) == ("boiler", "Machine", 1.0)
    seen = tools.call("inspect_entity", {"node_id": "boiler"})["result"]
    assert [e["alignment_label"] for e in seen["aligned_evidence"]] == ["verified"]
    assert seen["entity"]["outgoing_count"] == 1
    edges = tools.call("expand_graph", {"node_id": "boiler", "direction": "both", "relation": None, "limit": 5})
    assert edges["result"]["edges"][0]["is_ts24501_provenance"] is True
    paths = tools.call("find_paths", {"source_node_id": "boiler", "target_node_id": "tank", "max_hops": 9, "limit": 9})
    assert [e["target_label"] for e in paths["result"]["paths"][0]] == ["valve", "tank"]
    assert tools.call("nope", {}) == {"ok": False, "error": "Unknown tool: nope"}
    assert tools.call("inspect_entity", {"node_id": "x"})["ok"] is False
    bad = {"node_id": "boiler", "direction": "up", "relation": None, "limit": 1}
    assert tools.call("expand_graph", bad)["ok"] is False
    assert {s["name"] for s in tools.schemas} == set(
        ["resolve_entities", "search_spec", "inspect_entity", "expand_graph", "find_paths"]
    )
    assert all(s["strict"] and s["parameters"]["additionalProperties"] is False for s in tools.schemas)


class Script:
    """A client that plays back responses and records requests."""

    def __init__(self, *steps):
        self.steps, self.requests = list(steps), []
        self.responses = self

    def create(self, **request):
        self.requests.append(request)
        step = self.steps.pop(0)
        if isinstance(step, Exception):
            raise step
        return step


def calls(*named, response_id="r1"):
    output = [
        {"type": "function_call", "name": n, "arguments": a if isinstance(a, str) else json.dumps(a), "call_id": f"k{i}"}
        for i, (n, a) in enumerate(named)
    ]
    return {"id": response_id, "output": output, "output_text": ""}


def final(text):
    return {"id": "done", "output": [], "output_text": text}


SEARCH = ("search_spec", {"query": "reaches", "top_k": 1, "section_prefix": None})


def test_loop_continues_and_accepts_observed_citations(tools):
    client = Script(calls(SEARCH), final("Registers. **chunk_id**: c1 and chunk_id: **c1**"))
    result = ToolLoop(client, "m", tools).ask("How?")
    assert result.cited_chunk_ids == ("c1",) and result.tool_calls == 1
    assert client.requests[1]["previous_response_id"] == "r1"
    assert result.to_dict()["trace"][0]["ok"] is True


def test_loop_repeats_calls_for_a_stateless_endpoint(tools):
    refused = RuntimeError("Response was created under a different project")
    client = Script(calls(SEARCH), refused, final("done"))
    assert ToolLoop(client, "m", tools).ask("How?").answer == "done"
    assert [i["type"] for i in client.requests[2]["input"]] == ["function_call", "function_call_output"]
    assert "previous_response_id" not in client.requests[2]
    with pytest.raises(RuntimeError, match="boom"):
        ToolLoop(Script(calls(SEARCH), RuntimeError("boom")), "m", tools).ask("How?")


def test_loop_limits_and_errors(tools):
    with pytest.raises(RuntimeError, match="maximum of 1"):
        ToolLoop(Script(calls(SEARCH, SEARCH)), "m", tools, max_tool_calls=1).ask("q")
    with pytest.raises(RuntimeError, match="zz"):
        ToolLoop(Script(final("see chunk_id: zz")), "m", tools).ask("q")
    with pytest.raises(RuntimeError):
        ToolLoop(Script(final("")), "m", tools).ask("q")
    with pytest.raises(ValueError):
        ToolLoop(Script(), "m", tools).ask("  ")
    with pytest.raises(ValueError):
        ToolLoop(Script(), "", tools)
    with pytest.raises(ValueError):
        ToolLoop(Script(), "m", tools, max_tool_calls=13)
    client = Script(calls(("search_spec", "{bad"), ("inspect_entity", "[]"), ("nope", {})), final("ok"))
    assert [t.ok for t in ToolLoop(client, "m", tools).ask("q").trace] == [False] * 3


def test_chunk_ids_are_found_at_any_depth():
    value = {"a": [{"chunk_id": "x"}, {"b": {"chunk_id": "y", "chunk_id2": 1}}], "chunk_id": 3}
    assert set(chunk_ids_in(value)) == {"x", "y"}


def test_citation_antijoin(spark):
    answers = spark.createDataFrame([(1, "chunk_id: a, chunk_id: b")], "answer_id int, answer string")
    observed = spark.createDataFrame([(1, "a"), (2, "b")], "answer_id int, chunk_id string")
    assert [r["chunk_id"] for r in unsupported_citations(answers, observed).collect()] == ["b"]


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_bytes(b"\xef\xbb\xbfOPENAI_API_KEY=k\nOPENAI_MODEL='m'\n# note\nCLAUSEWEAVE_MAX_TOOL_CALLS=4\n")
    loaded = Settings.load(env, {"OPENAI_MODEL": "other"})
    assert (loaded.api_key, loaded.model, loaded.base_url, loaded.max_tool_calls) == ("k", "other", None, 4)
    with pytest.raises(RuntimeError, match="OPENAI_API_KEY"):
        Settings.load(tmp_path / "none", {})


def run(spark, capsys, *argv):
    assert cli.main([str(a) for a in argv], spark) == 0
    return json.loads(capsys.readouterr().out)


def test_command_line(spark, tmp_path, capsys):
    corpus, built, kept = tmp_path / "c.jsonl", tmp_path / "g.graphml", tmp_path / "s.graphml"
    rows = [
        chunk("c1", "6.2.1", "Key refresh security", "Key refresh security is on. " * 40),
        chunk("c2", "7.5", "Drains", "See 3GPP TS 11.222."),
    ]
    corpus.write_text("".join(json.dumps({k: v for k, v in r.items() if k != "chunk_seq"}) + "\n" for r in rows))
    made = run(spark, capsys, "build-graph", "--chunks", corpus, "--output", built)
    assert made["chunks"] == 2 and made["nodes"] == 7 and built.is_dir()
    audit = run(spark, capsys, "audit-graph", "--graph", built, "--output", tmp_path / "a.json")
    assert audit["nodes"] == 7 and audit["relation_keywords"]["SUBCLAUSE_OF"] == 2
    assert json.loads((tmp_path / "a.json").read_text()) == audit
    hits = run(spark, capsys, "search-spec", "refresh", "--chunks", corpus, "--section", "6")
    assert hits[0]["chunk_id"] == "c1" and hits[0]["text"].endswith("...")
    best = run(spark, capsys, "resolve", "key refresh security", "--graph", built)
    assert best[0]["method"] == "exact"
    seen = run(spark, capsys, "inspect", "drains", "--graph", built)
    assert seen["outgoing_count"] == 2 and seen["resolution"]["method"] == "exact"
    near = run(spark, capsys, "neighbors", "drains", "--graph", built, "--relation", "references")
    assert near["edges"][0]["target_label"] == "3GPP TS 11.222"
    path = run(spark, capsys, "path", "drains", "7", "--graph", built)
    assert len(path["paths"]) >= 1
    aligned = run(spark, capsys, "align", "--graph", built, "--chunks", corpus, "--output", tmp_path / "al")
    assert aligned["alignments"] == aligned["candidate"] > 0 and aligned["graph_nodes"] == 7
    questions = tmp_path / "q.json"
    questions.write_text(json.dumps([{"id": "q", "question": "refresh", "required_sections": ["6.2"]}]))
    score = run(spark, capsys, "eval-retrieval", "--chunks", corpus, "--questions", questions)
    assert score["recall_at_k"] == 1.0 and score["results"][0]["passed"] is True
    source = tmp_path / "u.graphml"
    source.write_text(plant_graphml())
    exported = run(spark, capsys, "export-subgraph", "--graph", source, "--output", kept, "--spec-token", PART_TOKEN)
    assert exported["nodes"] == 2 and exported["contextual_edges"] == 0
    tokens = ("--spec-token", PART_TOKEN, "--source-token", FILE_TOKEN)
    again = run(spark, capsys, "audit-graph", "--graph", kept, *tokens)
    assert again["matching_spec_sections"] == ["3.2", "3.4"] and again["nodes"] == 2
