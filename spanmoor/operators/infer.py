"""Model calls: providers, request building, response and error mapping.

Request building and response mapping are pure functions. Calls happen in one
place, an Arrow batch at a time; results must be written before they are used
twice (see plans.run), as a retried task asks again.
"""

from __future__ import annotations

import http.client
import json
import os
import re
import threading
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Result = tuple[str | None, str | None, str | None]  # output, error kind, detail


class Provider(Protocol):
    def infer(self, prompts: Sequence[str]) -> list[Result]: ...


@dataclass(frozen=True)
class Request:
    """Its text shows the body alone: url and headers may hold the key."""

    url: str = field(repr=False)
    headers: dict[str, str] = field(repr=False)
    body: dict[str, Any]


@dataclass(frozen=True)
class Style:
    """Fixed values of an endpoint."""

    env_key: str
    base_url: str
    model: str


STYLES = {
    "claude": Style("ANTHROPIC_API_KEY", "https://api.anthropic.com", "claude-sonnet-4-20250514"),
    "openai": Style("OPENAI_API_KEY", "https://api.openai.com", "gpt-4o-mini"),
    "gemini": Style("GEMINI_API_KEY", "https://generativelanguage.googleapis.com", "gemini-2.0-flash"),
}
API_VERSION = "2023-06-01"


@dataclass(frozen=True)
class Options:
    api_key: str = field(repr=False, default="")
    model: str = ""
    max_tokens: int = 4096
    temperature: float = 0
    base_url: str = ""
    json_mode: bool = True
    max_concurrency: int = 3
    timeout: float | None = None
    headers: Mapping[str, str] = field(repr=False, default_factory=dict)


class MissingApiKey(ValueError):
    pass


def resolve_key(given: str | None, env_key: str) -> str:
    """The given key, else the environment's; an empty one counts as missing."""
    key = given if given is not None else os.environ.get(env_key)
    if not key:
        raise MissingApiKey("missing_api_key")
    return key


def request(style: str, prompt: str, o: Options) -> Request:
    """The HTTP request for a prompt."""
    plain = {"content-type": "application/json"}
    if style == "claude":
        body = {"model": o.model, "max_tokens": o.max_tokens, "temperature": o.temperature, "messages": [{"role": "user", "content": prompt}]}
        return Request(f"{o.base_url}/v1/messages", plain | {"x-api-key": o.api_key, "anthropic-version": API_VERSION}, body)
    if style == "openai":
        messages = [{"role": "user", "content": prompt}]
        body = {"model": o.model, "max_tokens": o.max_tokens, "temperature": o.temperature}
        if o.json_mode:
            messages = [{"role": "system", "content": "Respond with JSON."}, *messages]
            body["response_format"] = {"type": "json_object"}
        return Request(f"{o.base_url}/v1/chat/completions", plain | {"authorization": f"Bearer {o.api_key}"}, body | {"messages": messages})
    if style == "gemini":
        config = {"maxOutputTokens": o.max_tokens, "temperature": o.temperature, "responseMimeType": "application/json"}
        body = {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": config}
        return Request(f"{o.base_url}/v1beta/models/{o.model}:generateContent?key={o.api_key}", plain, body)
    raise ValueError(f"unknown provider {style!r}")


def response_text(style: str, body: Any) -> Result:
    """The text of a good response, or empty_response."""
    try:
        if style == "claude":
            text = next(b["text"] for b in body["content"] if b.get("type") == "text")
        elif style == "openai":
            text = body["choices"][0]["message"]["content"]
        else:
            text = body["candidates"][0]["content"]["parts"][0]["text"]
    except (KeyError, IndexError, TypeError, AttributeError, StopIteration):
        text = None
    return (text, None, None) if isinstance(text, str) else (None, "empty_response", None)


def map_response(style: str, status: int, body: Any) -> Result:
    if status == 200:
        return response_text(style, body)
    said = body if isinstance(body, str) else json.dumps(body, ensure_ascii=False)
    if status == 400:
        return None, "bad_request", said
    if status == 401:
        return None, "unauthorized", None
    if status == 429:
        return None, "rate_limited", None
    if status >= 500:
        return None, "server_error", None
    return None, "api_error", json.dumps({"status": status, "body": body}, ensure_ascii=False)


_OPEN = threading.local()


def _connection(scheme: str, place: str, timeout: float | None) -> tuple[http.client.HTTPConnection, bool]:
    """A thread's connection to a host, and whether it has been used before."""
    held = _OPEN.__dict__.setdefault("held", {})
    key = (scheme, place, timeout)
    if key in held:
        return held[key], True
    kind = http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection
    held[key] = kind(place, timeout=timeout) if timeout is not None else kind(place)
    return held[key], False


def post(r: Request, timeout: float | None) -> tuple[int, Any]:
    """Sends a request over the thread's connection, which stays open for the
    next; one that the server has closed meanwhile is opened again."""
    at = urlsplit(r.url)
    target = at.path + (f"?{at.query}" if at.query else "")
    while True:
        call, used = _connection(at.scheme, at.netloc, timeout)
        try:
            call.request("POST", target, json.dumps(r.body).encode(), r.headers)
            answer = call.getresponse()
            status, raw = answer.status, answer.read()
            break
        except BaseException as e:
            call.close()
            _OPEN.held.pop((at.scheme, at.netloc, timeout), None)
            if not (used and isinstance(e, (http.client.RemoteDisconnected, BrokenPipeError, ConnectionResetError))):
                raise
    try:
        return status, json.loads(raw)
    except ValueError:
        return status, raw.decode(errors="replace")


@dataclass(frozen=True)
class HttpProvider:
    style: str
    options: Options
    transport: Callable[[Request, float | None], tuple[int, Any]] = field(default=post, repr=False)

    def infer(self, prompts: Sequence[str]) -> list[Result]:
        def one(prompt: str) -> Result:
            try:
                r = request(self.style, prompt, self.options)
                return map_response(self.style, *self.transport(Request(r.url, r.headers | dict(self.options.headers), r.body), self.options.timeout))
            except Exception as e:  # the transport's own failures
                return None, "request_error", type(e).__name__

        with ThreadPoolExecutor(self.options.max_concurrency) as pool:
            return list(pool.map(one, prompts))


@dataclass(frozen=True)
class RuleProvider:
    """No network: ``rule`` maps a prompt to output. For tests and dry runs."""

    rule: Callable[[str], str]

    def infer(self, prompts: Sequence[str]) -> list[Result]:
        return [(self.rule(p), None, None) for p in prompts]


def last_part(prompt: str) -> str:
    """The chunk of a prompt without examples, for rules that look at it."""
    return re.split(r"\n\n(?=\[Previous text\]: )", prompt)[-1]


@dataclass(frozen=True)
class Client:
    provider: Provider


def new_client(provider: str | Provider, api_key: str | None = None, transport: Callable | None = None, **options: Any) -> Client:
    """A client for "claude", "openai", "gemini", or a provider of one's own."""
    if not isinstance(provider, str):
        return Client(provider)
    if provider not in STYLES:
        raise ValueError(f"unknown provider {provider!r}")
    style = STYLES[provider]
    o = Options(api_key=resolve_key(api_key, style.env_key), **({"model": style.model, "base_url": style.base_url} | options))
    return Client(HttpProvider(provider, o, transport or post))


def _within(ask: Callable[[], list[Result]], seconds: float | None) -> list[Result]:
    """What ``ask`` returns; TimeoutError once it has taken too long. It is then
    left to itself, in a thread that the worker's end does not wait for."""
    if seconds is None:
        return ask()
    told: Future = Future()

    def work() -> None:
        try:
            told.set_result(ask())
        except BaseException as e:
            told.set_exception(e)

    threading.Thread(target=work, daemon=True).start()
    return told.result(seconds)


def ask(provider: Provider, prompts: list[str], task_timeout: float | None = None) -> list[Result]:
    """The provider's answers. If it crashes, gives a wrong number of answers or
    takes longer than ``task_timeout`` seconds a prompt, its prompts are asked
    again one by one, and only those that fail alone are task errors."""

    def some(part: list[str], seconds: float | None) -> list[Result]:
        told = _within(lambda: provider.infer(part), seconds)
        if len(told) != len(part):
            raise ValueError(f"{len(told)} answers to {len(part)} prompts")
        return told

    try:
        return some(prompts, None if task_timeout is None else task_timeout * len(prompts))
    except Exception as e:
        if len(prompts) == 1:
            return [(None, "task_error", "timeout" if isinstance(e, TimeoutError) else f"{type(e).__name__}: {e}")]
    return [r for p in prompts for r in ask(provider, [p], task_timeout)]


def infer(df: DataFrame, client: Client, column: str = "prompt", task_timeout: float | None = None) -> DataFrame:
    """Adds raw, infer_error and infer_detail. Each partition asks for itself,
    as many at once as its provider's max_concurrency."""
    provider, at = client.provider, df.columns.index(column)

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                told = ask(provider, part.column(at).to_pylist(), task_timeout)
                new = [pa.array([t[i] for t in told], pa.string()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "raw", "infer_error", "infer_detail"])

    schema = StructType(list(df.schema.fields)).add("raw", "string").add("infer_error", "string").add("infer_detail", "string")
    return df.mapInArrow(run, schema)
