"""Model output, extraction, runs, prompts and providers."""

import importlib.util
import json
import time

import pytest
from pyspark.sql import functions as F

from spanmoor.functions import model_output as M
from spanmoor.functions.model_output import parse_decoded
from spanmoor.operators import infer as I
from spanmoor.operators import prompt as P
from spanmoor.plans.run import chunk_errors, extract, run, write_unreadable

yaml = pytest.mark.skipif(importlib.util.find_spec("yaml") is None, reason="no YAML reader")


def entries(content):
    return M.normalize_content(content)["extractions"]


@yaml
def test_dynamic_entry():
    raw = "extractions:\n- medical_condition: hypertension\n  medical_condition_attributes:\n    chronicity: chronic"
    assert entries(raw) == [{"class": "medical_condition", "text": "hypertension", "attributes": {"chronicity": "chronic"}}]
    assert entries('extractions:\n- html_attributes: "<b>bold</b>"') == [{"class": "html_attributes", "text": "<b>bold</b>", "attributes": {}}]
    assert entries("extractions:\n- drug: aspirin\n  dosage: 100mg\n- {}") == [{"drug": "aspirin", "dosage": "100mg"}, {}]


@yaml
@pytest.mark.parametrize(("scalar", "value"), [("yes", "yes"), ("2024-01-01", "2024-01-01"), ("12:30:45", "12:30:45"), ("010", 10), ("1_000", "1_000"), ("1e3", 1000.0), ("true", True), ("~", None), ("0x1f", 31)])
def test_core_schema(scalar, value):
    assert M.decode(f"a: {scalar}") == {"a": value}


def test_canonical_entry_is_left():
    entry = {"class": "a", "text": "b", "html_attributes": 1}
    assert entries(json.dumps({"extractions": [entry]})) == [entry]
    with pytest.raises(ValueError):
        entries('{"extractions": 1}')
    with pytest.raises(ValueError):
        entries("just plain text")


def test_strip(spark):
    cases = [
        ("<think>x</think>\n{}", "{}"),
        ("<think>x</think>a<think>y</think>b", "ab"),
        ("<think>never closed {}", ""),
        ("Sure:\n```json\n{}\n```\nbye", "{}"),
        ("```yaml\na: 1\n```", "a: 1"),
        ("```\na\n```", "a"),
        ("no fence", "no fence"),
        ("  x\t", "x"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "k int, raw string")
    rows = df.select("k", M.strip_fences(M.strip_think(F.col("raw"))).alias("s")).orderBy("k").collect()
    assert [r.s for r in rows] == [c[1] for c in cases]


SOFT = "But soft! What light through yonder window breaks?"
SOFT_RAW = '{"extractions":[{"quote":"soft","quote_attributes":{"tone":"gentle"}},{"class":"object","text":"window"}]}'


def test_extract(spark):
    df = spark.createDataFrame(
        [
            (1, SOFT, SOFT_RAW),
            (2, SOFT, "nothing here: ["),
            (3, SOFT, '{"extractions":[{"class":"a","text":42},{"class":"","text":"x"},{"text":"y"},"z",{"class":"q","text":"light"}]}'),
            (4, SOFT, '{"extractions":[]}'),
            (5, None, None),
        ],
        "doc_id int, text string, raw string",
    )
    rows = extract(df).orderBy("doc_id", "ext_idx").collect()
    assert [(r.doc_id, r["class"], r.ext_text, r.byte_start, r.status, r.error_kind, r.dropped) for r in rows] == [
        (1, "quote", "soft", 4, "exact", None, 0),
        (1, "object", "window", 36, "exact", None, 0),
        (2, None, None, None, None, "invalid_format", 0),
        (3, "text", "y", None, "not_found", None, 3),
        (3, "q", "light", 15, "exact", None, 3),
        (4, None, None, None, None, None, 0),
        (5, None, None, None, None, "invalid_format", 0),
    ]
    assert json.loads(rows[0].attributes) == {"tone": "gentle"} and rows[1].attributes == "{}"
    assert rows[2].error_detail == "nothing here: ["


def client(rule):
    return I.new_client(I.RuleProvider(rule))


def test_single_run(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "")], "doc_id int, text string")
    spans, errors = run(docs, client(lambda p: '{"extractions":[{"animal":"fox"},{"animal":"unicorn"}]}'), P.Template(""), max_chunk_chars=None)
    rows = spans.where("doc_id = 1").orderBy("ext_idx").collect()
    assert [(r.ext_text, r.byte_start, r.byte_end, r.status) for r in rows] == [("fox", 16, 19, "exact"), ("unicorn", None, None, "not_found")]
    assert errors.count() == 0


def test_chunked_run(spark):
    text = "Alpha came home. Beta left. Gamma stayed here. Delta"
    docs = spark.createDataFrame([(1, text), (2, "Fine. Broken now. Broken again."), (3, "")], "doc_id int, text string")

    def rule(prompt):
        chunk = prompt.rsplit("\n\n", 1)[-1]
        return "no output" if "Broken" in chunk else json.dumps({"extractions": [{"word": chunk.split()[0]}]})

    spans, errors = run(docs, client(rule), P.Template(""), max_chunk_chars=18)
    rows = spans.orderBy("chunk_idx").collect()
    assert [text.encode()[r.byte_start : r.byte_end].decode() for r in rows] == ["Alpha", "Beta", "Gamma", "Delta"]
    assert {r.doc_id for r in rows} == {1}
    assert [(r.doc_id, r.chunk_idx, r.error_kind, r.error_detail) for r in errors.collect()] == [(2, 0, "invalid_format", None)]
    assert chunk_errors(errors).first().raw == "no output"


def test_the_model_is_asked_once(spark, tmp_path):
    log = tmp_path / "asked"

    def rule(prompt):
        with log.open("a") as f:
            f.write("x")
        return '{"extractions":[{"word":"One"}]}'

    spans, errors = run(spark.createDataFrame([(1, "One. Two."), (2, "One.")], "doc_id int, text string"), client(rule), P.Template(""), max_chunk_chars=4)
    assert (spans.count(), spans.count(), errors.count()) == (3, 3, 0) and log.read_text() == "xxx"


def test_provider_errors_fail_the_document(spark):
    def crash(prompt):
        raise RuntimeError("down")

    docs = spark.createDataFrame([(1, "One. Two.")], "doc_id int, text string")
    spans, errors = run(docs, client(crash), P.Template(""), max_chunk_chars=4)
    assert spans.count() == 0 and errors.first().error_kind == "task_error"


def test_a_crash_fails_its_chunk_alone(spark):
    def rule(prompt):
        if "Bad" in prompt:
            raise RuntimeError("down")
        return '{"extractions":[]}'

    docs = spark.createDataFrame([(i, "Bad." if i % 7 == 0 else "Good.") for i in range(40)], "doc_id int, prompt string").coalesce(1)
    rows = I.infer(docs, client(rule)).collect()
    assert {r.doc_id for r in rows if r.infer_error == "task_error"} == {i for i in range(40) if i % 7 == 0}
    assert all("down" in r.infer_detail for r in rows if r.infer_error) and len(rows) == 40


def test_task_timeout():
    class Slow:
        def infer(self, prompts):
            if "slow" in prompts:
                time.sleep(30)
            return [(p, None, None) for p in prompts]

    began = time.time()
    assert I.ask(Slow(), ["a", "slow", "b"], 0.2) == [("a", None, None), (None, "task_error", "timeout"), ("b", None, None)]
    assert time.time() - began < 5

    class Short:
        def infer(self, prompts):
            return [("x", None, None)]

    assert I.ask(Short(), ["a", "b"]) == [("x", None, None)] * 2


def test_every_unreadable_chunk_is_told(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One. Two. Three."), (2, "Four.")], "doc_id int, text string")

    def rule(prompt):
        return '{"extractions":[]}' if "Two" in prompt.rsplit("\n\n", 1)[-1] else f"no: {prompt[-5:]}"

    seen = []
    run(docs, client(rule), P.Template(""), max_chunk_chars=6, on_chunk_error=lambda rows: seen.extend(rows.collect()))
    assert sorted((r.doc_id, r.chunk_idx, r.chunk_text, r.chunk_byte_start) for r in seen) == [(1, 0, "One.", 0), (1, 2, " Three.", 9), (2, 0, "Four.", 0)]
    assert all(r.raw.startswith("no: ") for r in seen)
    run(docs, client(rule), P.Template(""), max_chunk_chars=6, on_chunk_error=write_unreadable(str(tmp_path / "raw")))
    assert spark.read.json(str(tmp_path / "raw")).count() == 3


def test_missing_extractions(spark):
    df = spark.createDataFrame([('{"extractions":[{"class":"a","text":"b"},{"class":"","text":"b"}]}',), ('{"other":1}',), ('{"extractions":"x"}',), (None,)], "j string")
    rows = [r.p for r in df.coalesce(1).select(parse_decoded(F.col("j")).alias("p")).collect()]
    assert [(r.error, r.dropped, len(r.entries)) for r in rows] == [(None, 1, 1), *[("missing_extractions", 0, 0)] * 3]


def test_connections_stay_open():
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            body = self.rfile.read(int(self.headers["content-length"]))
            seen.append((self.client_address, self.path, dict(self.headers), json.loads(body)))
            answer = json.dumps({"choices": [{"message": {"content": "hi"}}]}).encode()
            self.send_response(200)
            self.send_header("content-length", str(len(answer)))
            self.end_headers()
            self.wfile.write(answer)
            self.close_connection = len(seen) == 3

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    o = I.Options(api_key="k", model="m", base_url=f"http://127.0.0.1:{server.server_port}", max_concurrency=1, headers={"x-more": "1"})
    told = I.HttpProvider("openai", o).infer(["a"] * 5)
    server.shutdown()
    assert told == [("hi", None, None)] * 5 and len({s[0] for s in seen}) == 2 and all(s[2]["x-more"] == "1" for s in seen)
    assert "k" not in repr(I.request("gemini", "", o)).replace("maxOutputTokens", "") and "x-more" not in repr(o)


def test_prompt(spark):
    template = P.Template("Find all.", [P.Example("Ann has diabetes.", [P.Extraction("condition", "diabetes")])])
    df = spark.createDataFrame([("now", None), ("now", "end of the block of text."), ("", "x👩‍👩‍👧é")], "c string, p string")
    rows = [r.x for r in df.select(P.prompt(template, F.col("c"), F.col("p")).alias("x")).collect()]
    head = "Find all.\n\nAnn has diabetes.\n```yaml\nextractions:\n  - condition: diabetes\n    condition_attributes: {}\n```"
    assert rows[0] == head + "\n\nnow"
    assert rows[1] == head + "\n\n[Previous text]: ...end of the block of text.\n\nnow"
    cut = [r.x for r in df.select(P.prompt(P.Template(""), F.col("c"), F.col("p"), 2).alias("x")).collect()]
    assert cut == ["now", "[Previous text]: ...t.\n\nnow", "[Previous text]: ...👩‍👩‍👧é\n\n"]


@yaml
def test_format_round_trip():
    found = [P.Extraction("a b", 'x: "y"\nz', {"n": 1, "deep": {"k": ["v", None]}}), P.Extraction("c", "true", None), P.Extraction("d", "- é")]
    text = P.format_extractions(found)
    assert text.startswith("```yaml\n") and text.endswith("\n```")
    told = entries(text[8:-4])
    assert [(e["class"], e["text"], e["attributes"]) for e in told] == [(f.class_, f.text, dict(f.attributes or {})) for f in found]
    assert entries(P.format_extractions([])[8:-4]) == []


def test_validate(spark):
    good = P.Template("", [P.Example("a b", [P.Extraction("x", "a"), P.Extraction("x", "a")])])
    assert P.validate(spark, good) == [] and P.validate(spark, P.Template("")) == []
    bad = P.Template("", [P.Example("a b", [P.Extraction("x", "a"), P.Extraction("y", "zz")]), P.Example("c", [P.Extraction("z", "")])])
    assert [(i.example_index, i.extraction_index, i.status) for i in P.validate(spark, bad)] == [(0, 1, "not_found"), (1, 0, "not_found")]
    with pytest.raises(P.ValidationError, match=r"2 alignment issue\(s\) found"):
        P.validate_or_raise(spark, bad)


@pytest.mark.parametrize(
    ("style", "body", "told"),
    [
        ("claude", {"content": [{"type": "thinking"}, {"type": "text", "text": "the actual response"}]}, "the actual response"),
        ("claude", {"content": []}, None),
        ("claude", {}, None),
        ("claude", "text", None),
        ("openai", {"choices": [{"message": {"content": "a"}}, {"message": {"content": "b"}}]}, "a"),
        ("openai", {"choices": []}, None),
        ("openai", {"choices": [{"message": {"content": None}}]}, None),
        ("gemini", {"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]}, "a"),
        ("gemini", {"candidates": []}, None),
        ("gemini", {"candidates": [{"finishReason": "SAFETY"}]}, None),
        ("gemini", {"candidates": [{"content": {"parts": []}}]}, None),
    ],
)
def test_responses(style, body, told):
    assert I.map_response(style, 200, body) == ((told, None, None) if told else (None, "empty_response", None))


@pytest.mark.parametrize(("status", "kind"), [(400, "bad_request"), (401, "unauthorized"), (429, "rate_limited"), (500, "server_error"), (503, "server_error"), (418, "api_error")])
def test_statuses(status, kind):
    assert I.map_response("openai", status, {"e": 1})[:2] == (None, kind)


def test_requests_and_clients(monkeypatch):
    seen = []

    def transport(request, timeout):
        seen.append(request)
        return 200, {"content": [{"type": "text", "text": "hi"}]}

    monkeypatch.setenv("ANTHROPIC_API_KEY", "from-env")
    c = I.new_client("claude", api_key="mine", transport=transport, max_tokens=7)
    assert "mine" not in repr(c) and c.provider.infer(["p"]) == [("hi", None, None)]
    assert seen[0].url.endswith("/v1/messages") and seen[0].headers["x-api-key"] == "mine"
    assert seen[0].body["max_tokens"] == 7 and seen[0].body["messages"] == [{"role": "user", "content": "p"}]
    assert I.new_client("claude").provider.options.api_key == "from-env"
    with pytest.raises(I.MissingApiKey):
        I.new_client("claude", api_key="")
    with pytest.raises(ValueError, match="unknown provider"):
        I.new_client("other")
    r = I.request("openai", "p", I.new_client("openai", api_key="k").provider.options)
    assert r.headers["authorization"] == "Bearer k" and r.body["response_format"] == {"type": "json_object"} and len(r.body["messages"]) == 2
    r = I.request("openai", "p", I.new_client("openai", api_key="k", json_mode=False).provider.options)
    assert "response_format" not in r.body and len(r.body["messages"]) == 1
    r = I.request("gemini", "p", I.new_client("gemini", api_key="k").provider.options)
    assert r.url.endswith(":generateContent?key=k") and r.body["generationConfig"]["responseMimeType"] == "application/json"

    def broken(request, timeout):
        raise OSError("no route")

    assert I.new_client("claude", api_key="k", transport=broken).provider.infer(["p"])[0][1] == "request_error"
