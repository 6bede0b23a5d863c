"""Providers of models over HTTP: what each is sent, and what its answer means.

:func:`completion` gives the callable that :mod:`.ai` asks.  It is built of plain data and a ``fetch``
function, so that it can be sent to the workers and tested without a network.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

#: ``fetch(url, headers, body, timeout in seconds)`` gives status and text.
Fetch = Callable[[str, dict[str, str], dict[str, Any], float], tuple[int, str]]


@dataclass(frozen=True)
class Provider:
    """``models``: a few that are known, the first by default; any other name is passed on as it is."""

    name: str
    url: str
    key_variable: str
    needs_key: bool
    timeout_ms: int
    models: tuple[str, ...]


PROVIDERS = {
    p.name: p
    for p in (
        Provider("anthropic", "https://api.anthropic.com", "ANTHROPIC_API_KEY", True, 20_000, ("claude-3-5-haiku-latest", "claude-3-7-sonnet-latest")),
        Provider("gemini", "https://generativelanguage.googleapis.com", "GEMINI_API_KEY", True, 20_000, ("gemini-flash-lite-latest", "gemini-flash-latest")),
        Provider("ollama", "http://localhost:11434", "OLLAMA_API_KEY", False, 120_000, ("llama3.2", "qwen2.5", "mistral")),
    )
}


def provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise LookupError(f"unknown provider {name!r}; known: {', '.join(PROVIDERS)}")
    return PROVIDERS[name]


def key_of(name: str, given: str | None = None, environment: Mapping[str, str] | None = None) -> str | None:
    """The key given, else that of the environment."""
    return given or (os.environ if environment is None else environment).get(provider(name).key_variable) or None


def without_additional(node: Any) -> Any:
    """A schema for providers that don't know ``additionalProperties``."""
    if isinstance(node, dict):
        return {k: without_additional(v) for k, v in node.items() if k != "additionalProperties"}
    return [without_additional(x) for x in node] if isinstance(node, list) else node


def fetch(url: str, headers: dict[str, str], body: dict[str, Any], timeout: float) -> tuple[int, str]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json"} | headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as why:
        return why.code, why.read().decode("utf-8", "replace")


def _anthropic(r: dict[str, Any]) -> tuple[str, dict[str, str], dict[str, Any]]:
    tool = {"name": "answer", "description": "Give the answer.", "input_schema": r["schema"]}
    body = {"model": r["model"], "max_tokens": r["max_tokens"], "system": r["system"], "messages": [{"role": "user", "content": r["text"]}], "tools": [tool], "tool_choice": {"type": "tool", "name": "answer"}}
    return "/v1/messages", {"x-api-key": r["key"] or "", "anthropic-version": "2023-06-01"}, body


def _gemini(r: dict[str, Any]) -> tuple[str, dict[str, str], dict[str, Any]]:
    config = {"responseMimeType": "application/json", "responseSchema": without_additional(r["schema"]), "maxOutputTokens": r["max_tokens"]}
    body = {"systemInstruction": {"parts": [{"text": r["system"]}]}, "contents": [{"role": "user", "parts": [{"text": r["text"]}]}], "generationConfig": config}
    return f"/v1beta/models/{r['model']}:generateContent", {"x-goog-api-key": r["key"] or ""}, body


def _ollama(r: dict[str, Any]) -> tuple[str, dict[str, str], dict[str, Any]]:
    body = {"model": r["model"], "stream": False, "format": r["schema"], "options": {"temperature": 0, "num_predict": r["max_tokens"]}, "messages": [{"role": "system", "content": r["system"]}, {"role": "user", "content": r["text"]}]}
    return "/api/chat", {"authorization": f"Bearer {r['key']}"} if r["key"] else {}, body


def _from_anthropic(a: dict[str, Any]) -> dict[str, Any]:
    if a.get("stop_reason") == "refusal":
        return {"refused": True, "refusal_reason": "declined by the provider", "model": a.get("model")}
    used = [p for p in a.get("content", []) if p.get("type") == "tool_use"]
    return {"json": json.dumps(used[0]["input"]) if used else None, "model": a.get("model")}


def _from_gemini(a: dict[str, Any]) -> dict[str, Any]:
    blocked = (a.get("promptFeedback") or {}).get("blockReason")
    first = (a.get("candidates") or [{}])[0]
    if blocked or first.get("finishReason") in ("SAFETY", "PROHIBITED_CONTENT", "BLOCKLIST", "SPII"):
        return {"refused": True, "refusal_reason": blocked or first["finishReason"], "model": a.get("modelVersion")}
    text = "".join(p.get("text", "") for p in (first.get("content") or {}).get("parts", []) if not p.get("thought"))
    return {"json": text or None, "model": a.get("modelVersion")}


def _from_ollama(a: dict[str, Any]) -> dict[str, Any]:
    return {"json": (a.get("message") or {}).get("content") or None, "model": a.get("model")}


_SPEAK = {"anthropic": (_anthropic, _from_anthropic), "gemini": (_gemini, _from_gemini), "ollama": (_ollama, _from_ollama)}


def completion(name: str, fetch: Fetch = fetch) -> Callable[[dict[str, Any]], dict[str, Any]]:
    """The callable that asks provider ``name``."""
    own, (build, parse) = provider(name), _SPEAK[name]

    def complete(request: dict[str, Any]) -> dict[str, Any]:
        path, headers, body = build(request)
        status, text = fetch((request.get("base_url") or own.url).rstrip("/") + path, headers, body, request["timeout_ms"] / 1000)
        if status == 404 and name == "ollama":
            raise RuntimeError(f"the model {request['model']!r} is not there: pull it first")
        if status >= 400:
            raise RuntimeError(f"{name} answered {status}: {text[:300]}")
        return parse(json.loads(text))

    return complete
