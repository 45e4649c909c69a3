"""Calls of language models, one a row, with errors as a column."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

# Endpoints, default models and header names of the public services.
DEFAULT_MODELS = {"groq": "llama-3.1-8b-instant", "openai": "gpt-4o-mini", "anthropic": "claude-haiku-4-5-20251001", "deepseek": "deepseek-chat", "gemini": "gemini-1.5-flash", "ollama": "llama3"}
CHAT_URLS = {"groq": "https://api.groq.com/openai/v1/chat/completions", "openai": "https://api.openai.com/v1/chat/completions", "deepseek": "https://api.deepseek.com/v1/chat/completions"}
ANTHROPIC_URL, ANTHROPIC_VERSION = "https://api.anthropic.com/v1/messages", "2023-06-01"
GEMINI_URL = "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent"
OLLAMA_URL = "http://localhost:11434"
TEMPERATURE, MOST_TOKENS = 0.1, 1000
#: How the user turn of a request begins.
LEAD = "Conversation to condense:\n\n"
REPLY = "text string, tokens_used long, error string"


@dataclass(frozen=True)
class Request:
    url: str
    headers: dict[str, str]
    body: dict


def request(provider: str, system: str, user: str, key: str | None, model: str | None) -> Request:
    """The HTTP request of a provider; keys only ever go into headers."""
    name = known(provider)
    model, user = model or DEFAULT_MODELS[name], LEAD + user
    if name in CHAT_URLS or name == "ollama":
        chat = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        if name == "ollama":
            return Request(f"{OLLAMA_URL}/api/chat", {}, chat | {"stream": False, "options": {"temperature": TEMPERATURE}})
        return Request(CHAT_URLS[name], {"Authorization": f"Bearer {key}"}, chat | {"temperature": TEMPERATURE, "max_tokens": MOST_TOKENS})
    if name == "anthropic":
        return Request(ANTHROPIC_URL, {"x-api-key": key or "", "anthropic-version": ANTHROPIC_VERSION}, {"model": model, "system": system, "messages": [{"role": "user", "content": user}], "temperature": TEMPERATURE, "max_tokens": MOST_TOKENS})
    body = {"system_instruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": [{"text": user}]}], "generationConfig": {"temperature": TEMPERATURE, "maxOutputTokens": MOST_TOKENS}}
    return Request(GEMINI_URL.format(model=model), {"x-goog-api-key": key or ""}, body)


def _at(data: object, *path: str | int) -> object:
    for p in path:
        try:
            data = data[p]  # type: ignore[index]
        except (KeyError, IndexError, TypeError):
            return None
    return data


def reply(provider: str, data: dict) -> tuple[str, int]:
    """Text and tokens of a provider's answer; what is missing is empty or 0."""
    name = known(provider)
    if name == "anthropic":
        return _at(data, "content", 0, "text") or "", (_at(data, "usage", "input_tokens") or 0) + (_at(data, "usage", "output_tokens") or 0)
    if name == "gemini":
        return _at(data, "candidates", 0, "content", "parts", 0, "text") or "", (_at(data, "usageMetadata", "promptTokenCount") or 0) + (_at(data, "usageMetadata", "candidatesTokenCount") or 0)
    if name == "ollama":
        return _at(data, "message", "content") or "", 0
    return _at(data, "choices", 0, "message", "content") or "", _at(data, "usage", "total_tokens") or 0


def known(provider: str) -> str:
    name = (provider or "").lower()
    if name not in DEFAULT_MODELS:
        raise ValueError(f"Unsupported provider: {provider}. Supported: {', '.join(DEFAULT_MODELS)}")
    return name


def send(provider: str, system: str, user: str, key: str | None, model: str | None, timeout: float = 120) -> tuple[str, int]:
    req = request(provider, system, user, key, model)
    http = urllib.request.Request(req.url, json.dumps(req.body).encode(), {"Content-Type": "application/json", **req.headers})
    try:
        with urllib.request.urlopen(http, timeout=timeout) as answer:
            return reply(provider, json.load(answer))
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"{provider} API error {e.code}: {e.read()[:300].decode(errors='replace')}") from None


def ollama_running(url: str = OLLAMA_URL) -> bool:
    try:
        with urllib.request.urlopen(f"{url}/api/tags", timeout=3):
            return True
    except OSError:
        return False


def key_of(provider: str, given: str | None = None) -> str | None:
    """The key given, else that of the environment variable <PROVIDER>_API_KEY."""
    return given or os.environ.get(f"{provider.upper()}_API_KEY")


def stub(system: str, user: str) -> tuple[str, int]:
    """A deterministic stand-in: repeats the longest line of the input as its only finished item."""
    lines = [x.strip() for x in user.split("\n") if x.strip()]
    longest = max(lines, key=lambda x: (len(x), x), default="")
    return json.dumps({"project": "stub", "completed": [longest[:100]]}), len(user) // 4


def call(rows: DataFrame, ask: Callable[[str, str], tuple[str, int]], *keys: str, at_once: int | None = None) -> DataFrame:
    """keys, text, tokens_used, error: one call of ask(system, user) a row of (keys, system, user).

    An exception of a call becomes its error. at_once bounds the calls made at a time (partitions)."""
    df = rows.select(*keys, "system", "user")
    df = df.repartition(at_once) if at_once else df
    kinds = dict(rows.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = []
            for system, user in zip(pdf["system"], pdf["user"], strict=True):
                try:
                    got.append((*ask(system, user), None))
                except Exception as e:  # noqa: BLE001  an error is a value of its row
                    got.append((None, 0, str(e) or type(e).__name__))
            out = pdf[list(keys)].copy()
            out["text"], out["tokens_used"], out["error"] = ([g[i] for g in got] for i in range(3))
            yield out

    return df.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), REPLY]))
