import json

import pytest

from tripleloom.cli import main
from tripleloom.clients import CommandClient, load_env
from tripleloom.engine import Engine
from tripleloom.serve import App


def vault(tmp_path):
    notes = {"concepts/sampling.md": "# Graph Sampling\nUses [[Random Walks]] and [[Node Embeddings]].\n## Why", "concepts/walks.md": "# Random Walks\nSee [[Graph Sampling]].", "people/ada.md": "# Ada\nWrote on [[Random Walks]] and [[Random-Walks]]."}
    for name, body in notes.items():
        p = tmp_path / "vault" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return str(tmp_path / "vault")


def test_end_to_end(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "kg"))
    source = vault(tmp_path)
    assert e.ingest(source, "vault", dry_run=True).scanned == 3
    r = e.ingest(source, "vault", timestamp="2024-01-01T00:00:00Z")
    assert (r.scanned, r.extracted, r.rejected, r.messages) == (3, 3, 0, []) and r.added == e.stats()["triples"]
    again = e.ingest(source, "vault", timestamp="2024-01-02T00:00:00Z")
    assert (again.added, again.skipped) == (0, r.added) and "Scanned:    3 documents" in again.summary()
    assert e.stats()["layers"] == {"source_facts": r.added}
    got = e.resolve()
    assert got["aliases"] >= 1 and "inferred_relations" in e.stats()["layers"]
    emb = e.embed(epochs=3)
    assert emb["entities"] == e.stats()["entities"] and len(emb["losses"]) == 3
    assert e.similar("Random Walks", 3).count() == 3
    c = e.communities(min_size=2)
    assert c["communities"] >= 1
    local = e.ask("How are random walks used in sampling?")
    assert local["subgraph_size"] > 0 and local["answer"]
    assert e.ask("walks", "drift")["mode"] == "drift" and e.ask("walks", "global")["mode"] == "global"
    a = e.query(predicate="LINKS_TO").filter("object = 'Random Walks'").first()["subject"]
    assert len(e.path_between(a, "Random Walks")) == 1 and e.provenance("Random Walks").count() >= 2


def test_cli(spark, tmp_path, capsys):
    kg = str(tmp_path / "kg")
    assert main(["--path", kg, "ingest", vault(tmp_path), "--adapter", "universal"], spark) == 0
    assert "Triples:" in capsys.readouterr().out
    assert main(["--path", kg, "stats"], spark) == 0
    assert json.loads(capsys.readouterr().out)["triples"] > 0
    assert main(["--path", kg, "path", "Random Walks", "Node Embeddings"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)) == 2
    assert main(["--path", kg, "query", "random walks"], spark) == 0
    assert json.loads(capsys.readouterr().out)["mode"] == "local"


def test_http_routes(spark, tmp_path):
    app = App(Engine(spark, str(tmp_path / "kg")), api_key="k", rate_limit=50)
    key = {"X-API-Key": "k", "X-Request-ID": "r1"}
    assert app.handle("GET", "/health")[0] == 200
    assert app.handle("GET", "/graph/stats")[0] == 401 and app.handle("GET", "/graph/stats", headers={"X-API-Key": "no"})[0] == 401
    status, data, headers = app.handle("POST", "/ingest", {"source": vault(tmp_path), "adapter": "vault"}, key)
    assert (status, data["documents_scanned"], headers["X-Request-ID"]) == (200, 3, "r1")
    assert app.handle("POST", "/ingest", {"source": "/nowhere"}, key)[0] == 400 and app.handle("POST", "/ingest", {"source": "x", "adapter": "odd"}, key)[0] == 400
    assert app.handle("GET", "/graph/node/Random%20Walks", headers=key)[1]["kind"] == "vault_link" and app.handle("GET", "/graph/node/none", headers=key)[0] == 404
    assert app.handle("GET", "/graph/provenance/Random%20Walks", headers=key)[0] == 200 and app.handle("GET", "/graph/provenance/none", headers=key)[0] == 404
    assert app.handle("GET", "/graph/path?from=Random%20Walks&to=Node%20Embeddings", headers=key)[1]["found"] and app.handle("GET", "/graph/path?from=a", headers=key)[0] == 422
    assert app.handle("POST", "/query", {"question": "random walks"}, key)[1]["mode"] == "local" and app.handle("POST", "/query", {"question": "x", "mode": "odd"}, key)[0] == 422 and app.handle("POST", "/query", {"question": "x", "hops": 9}, key)[0] == 422
    assert app.handle("GET", "/graph/community", headers=key)[1]["summaries"] == [] and app.handle("GET", "/similar/x", headers=key)[0] == 400 and app.handle("GET", "/none", headers=key)[0] == 404
    slow = App(app.engine, rate_limit=1)
    assert slow.handle("GET", "/none")[0] == 404 and slow.handle("GET", "/none")[0] == 429 and slow.handle("GET", "/health")[0] == 200


def test_command_client_and_env(tmp_path):
    assert CommandClient(("cat",))("p", "s").endswith("p")
    with pytest.raises(RuntimeError):
        CommandClient(("false",))("p", "s")
    (tmp_path / ".env").write_text("# c\nA=1\nB='two'\nbad\n")
    assert load_env(str(tmp_path / ".env"), {"A": "0"}) == {"A": "0", "B": "two"} and load_env("/none", {}) == {}


def test_llm_ingest(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "kg"))
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.md").write_text("# A\n" + "text about things " * 10)
    reply = json.dumps({"triples": [{"subject": "A", "subject_type": "Concept", "predicate": "EXTENDS", "object": "B", "object_type": "Concept", "confidence": 0.5}]})
    r = e.ingest(str(tmp_path / "n"), "llm", client=lambda text, system: reply)
    assert r.added == 1 and e.stats()["layers"] == {"llm_hypotheses": 1}
