"""The embedding clients against a service on this machine that fails, reorders and truncates."""

import io
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from brindle import cli, client, config, embed
from brindle.plans import enrich, history_index
from tests.test_store import found, prompt, put

SIZE = 4


class Service(BaseHTTPRequestHandler):
    def do_POST(self):
        own = self.server
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with own.lock:
            own.calls.append((self.path, body, self.headers.get("Authorization")))
            own.busy += 1
            own.most = max(own.most, own.busy)
            status, more, shape = own.script.pop(0) if own.script else (200, {}, "plain")
        if own.pause:
            threading.Event().wait(own.pause)
        texts = body["input"] if "input" in body else [body["prompt"]]
        vectors = [[float(len(t)), 1.0, 0.0, 0.0] for t in texts]
        if "input" in body:
            data = [{"index": k, "embedding": v} for k, v in enumerate(vectors)]
            data = {"reversed": data[::-1], "short": data[:-1], "twice": data[:-1] + data[:1], "size": [x | {"embedding": [1.0]} for x in data]}.get(shape, data)
            answer = json.dumps({"data": data}).encode()
        else:
            answer = json.dumps({"embedding": [1.0] if shape == "size" else vectors[0]}).encode()
        if shape == "html":
            answer = b"<html>"
        self.send_response(status)
        for k, v in more.items():
            self.send_header(k, v)
        self.send_header("Content-Length", str(len(answer) + (50 if shape == "truncated" else 0)))
        self.end_headers()
        self.wfile.write(answer)
        with own.lock:
            own.busy -= 1

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    server.lock, server.calls, server.script, server.busy, server.most, server.pause = threading.Lock(), [], [], 0, 0, 0
    server.url = f"http://127.0.0.1:{server.server_port}/v1"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def hosted(service, **more):
    waits = []
    own = client.HostedEmbedder("m", SIZE, "secret", service.url, sleep=waits.append, **more)
    return own, waits


def test_requests(service):
    own, _ = hosted(service, batch=3, instruction="find")
    assert [v[0] for v in own.embed(["a" * k for k in range(8)])] == [float(k) for k in range(8)]
    assert sorted(len(b["input"]) for _, b, _ in service.calls) == [2, 3, 3]
    path, body, key = service.calls[0]
    assert key == "Bearer secret" and {k: v for k, v in body.items() if k != "input"} == {"model": "m", "dimensions": SIZE, "encoding_format": "float", "input_type": "search_document", "provider": {"zdr": True}}
    own.embed_query("q")
    assert service.calls[-1][1]["input"] == ["Instruct: find\nQuery:q"] and service.calls[-1][1]["input_type"] == "search_query"
    assert own.embed([]) == []


def test_a_few_at_a_time_and_in_order(service):
    service.pause = 0.05
    own, _ = hosted(service, batch=1, in_flight=3)
    assert [v[0] for v in own.embed(["a" * k for k in range(12)])] == [float(k) for k in range(12)]
    assert 1 < service.most <= 3


def test_delay_puts_requests_in_a_row(service):
    service.pause = 0.02
    own, waits = hosted(service, batch=1, delay=0.5)
    own.embed(["a"] * 4)
    assert service.most == 1 and waits == [0.5] * 3


def test_another_try(service):
    own, waits = hosted(service)
    service.script = [(429, {"retry-after": "7"}, "plain"), (200, {}, "truncated"), (200, {}, "reversed")]
    assert [v[0] for v in own.embed(["a", "bb"])] == [1.0, 2.0]
    assert waits[0] == 7 and 0.5 <= waits[1] <= 0.6 and len(service.calls) == 3
    service.script = [(503, {}, "plain")] * 3
    with pytest.raises(RuntimeError, match="503"):
        own.embed(["a"])
    service.script = [(401, {}, "plain")]
    with pytest.raises(RuntimeError, match="401"):
        own.embed(["a"])


@pytest.mark.parametrize("shape, said", [("short", "expected"), ("twice", "expected"), ("size", "dimensions"), ("html", "no JSON")])
def test_wrong_answers(service, shape, said):
    own, _ = hosted(service)
    service.script = [(200, {}, shape)]
    with pytest.raises(ValueError, match=said):
        own.embed(["a", "bb", "ccc"])


def test_local(service):
    own = client.LocalEmbedder("m", SIZE, service.url)
    assert [v[0] for v in own.embed(["a", "bb"])] == [1.0, 2.0] and own.embed_query("ccc")[0] == 3.0
    assert service.calls[0][0] == "/v1/api/embeddings" and service.calls[0][1] == {"model": "m", "prompt": "a"}
    service.script = [(503, {}, "plain"), (200, {}, "size")]
    with pytest.raises(RuntimeError, match="503"):
        own.embed(["a"])
    with pytest.raises(ValueError, match="dimensions"):
        own.embed(["a"])


def test_the_store_through_a_service(service, spark, tmp_path):
    key = put(tmp_path / "key.toml", 'api_key = "secret"\n')
    profile = config.Embedding("hosted", "m", SIZE)
    make = client.factory(profile, key, service.url, batch=2)
    put(tmp_path / "r" / "a.jsonl", prompt("about bread"))
    store = str(tmp_path / "store")
    assert history_index.index(spark, found(tmp_path / "r"), store, make) == 1
    assert [r["text"] for r in history_index.search(spark, store, "bread", make()).collect()] == ["User: about bread"]
    for bad in ("", 'api_key = " "\n'):
        with pytest.raises(ValueError, match="api_key"):
            client.factory(profile, put(tmp_path / "bad.toml", bad), service.url)


def test_enrich_keeps_its_output(spark, tmp_path, monkeypatch, capsys):
    """Failures go to standard error; one failing group leaves the other; a switch turns history off."""
    store, kb = str(tmp_path / "store"), tmp_path / "kb"
    answer = json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": "an answer"}]}}) + "\n"
    put(tmp_path / "r" / "a.jsonl", prompt("about bread"), answer)
    put(kb / "note.md", "# other\nnothing here\n")
    make = lambda: embed.HashingEmbedder(16)
    history_index.index(spark, found(tmp_path / "r"), store, make)
    run = lambda **more: enrich.run(spark, "bread", store, make(), str(kb), str(tmp_path / "index"), **more)
    assert "about bread" in run() and "an answer" in run()
    assert run(enabled=False) == "{}"
    real = history_index.search_vector

    def fails(*a, kind=None, **k):
        if kind == "answer":
            raise RuntimeError("no answers")
        return real(*a, kind=kind, **k)

    with monkeypatch.context() as m:
        m.setattr(history_index, "paired", lambda *a, **k: 1 / 0)
        m.setattr(history_index, "search_vector", fails)
        capsys.readouterr()
        got = run()
    out, err = capsys.readouterr()
    assert out == "" and "no answers" in err and "about bread" in got and "an answer" not in got
    own = put(tmp_path / "config.toml", '[search]\nenabled = false\n[embedding]\nbackend = "hosted"\nmodel = "m"\nvector_size = 16\ncollection = "c"\n')
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps({"prompt": "bread"})))
    cli.main(["--store", store, "--config", own, "enrich", "--kb", str(kb), "--index", str(tmp_path / "index")], spark)
    assert capsys.readouterr().out == "{}\n"


def test_default_roots(spark, tmp_path, monkeypatch, capsys):
    from brindle.sources import files

    head = json.dumps({"type": "session"}) + "\n"
    put(tmp_path / ".claude/projects/p/a.jsonl", prompt("from a project"))
    put(tmp_path / ".claude/archive/b.jsonl", prompt("from an archive"))
    put(tmp_path / "conf/pi/agent/sessions/c.jsonl", head, prompt("with a header"))
    put(tmp_path / "conf/pi/agent/sessions/d.jsonl", prompt("without a header"))
    got = files.discover(files.default_rules(str(tmp_path), str(tmp_path / "conf")))
    assert sorted((f.source, f.header) for f in got) == [("archive", False), ("session", False), ("session", True), ("session", True)]
    monkeypatch.setattr(cli, "HOME", str(tmp_path))
    monkeypatch.setattr(cli, "CONFIG", str(tmp_path / "conf"))
    cli.main(["--store", str(tmp_path / "s"), "--config", "none", "index", "--batch-size", "3"], spark)
    cli.main(["transcript", "build", "--index", str(tmp_path / "t")], spark)
    assert capsys.readouterr().out.splitlines() == ["indexed 3 new chunks", "{'files': 2, 'sessions': 2, 'nodes': 2}"]
    with pytest.raises(ValueError, match="not found"):
        cli.main(["transcript", "content", "nope", "000001", "--index", str(tmp_path / "t")], spark)
