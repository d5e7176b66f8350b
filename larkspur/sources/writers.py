"""Writers of summaries that ask a model over HTTP. A writer takes a prompt and gives a text, or raises."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from typing import Any

#: What every writer is told ahead of the prompt.
RULES = "Write a short news brief in two or three paragraphs, the most important subject first. Say only what the items state, with their names and figures as given. No introduction, no lists."

#: Sends a request and gives the body of the answer; tests put their own in its place.
Opener = Callable[[urllib.request.Request, float], bytes]


def opened(request: urllib.request.Request, timeout: float) -> bytes:
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


def _asked(url: str, body: dict[str, Any], headers: dict[str, str], opener: Opener, timeout: float) -> Any:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    return json.loads(opener(request, timeout))


def local_model(url: str, model: str, opener: Opener = opened, timeout: float = 180, temperature: float = 0.2) -> Callable[[str], str | None]:
    """A model server on this host or network, by its generate interface."""

    def write(prompt: str) -> str | None:
        body = {"model": model, "system": RULES, "prompt": prompt, "stream": False, "options": {"temperature": temperature}}
        return (_asked(f"{url.rstrip('/')}/api/generate", body, {}, opener, timeout).get("response") or "").strip() or None

    return write


def hosted_model(key: str, model: str, url: str = "https://openrouter.ai/api/v1", opener: Opener = opened, timeout: float = 60, temperature: float = 0.2) -> Callable[[str], str | None]:
    """A hosted model, by the chat-completion interface."""

    def write(prompt: str) -> str | None:
        body = {"model": model, "temperature": temperature, "messages": [{"role": "system", "content": RULES}, {"role": "user", "content": prompt}]}
        choices = _asked(f"{url.rstrip('/')}/chat/completions", body, {"Authorization": f"Bearer {key}"}, opener, timeout).get("choices") or [{}]
        return ((choices[0].get("message") or {}).get("content") or "").strip() or None

    return write
