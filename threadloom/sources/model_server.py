"""A local model server as the generator of summaries: two HTTP calls with a limit on the whole request."""

from __future__ import annotations

import json
import urllib.request

GENERATE_S, STATUS_S = 60, 3


def _call(url: str, body: dict | None, seconds: float) -> dict:
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=seconds) as answer:
        return json.load(answer)


def generator(base: str, model: str, seconds: float = GENERATE_S):
    """A function from prompt to text, for operators.summarize; it raises where the server fails."""

    def generate(prompt: str) -> str:
        return _call(f"{base.rstrip('/')}/api/generate", {"model": model, "prompt": prompt, "stream": False}, seconds).get("response", "")

    return generate


def status(base: str, seconds: float = STATUS_S) -> dict:
    """reachable, models and error; never raises."""
    try:
        models = [m["name"] for m in _call(f"{base.rstrip('/')}/api/tags", None, seconds).get("models", []) if "name" in m]
        return {"reachable": True, "models": models, "error": None}
    except (OSError, ValueError) as e:
        return {"reachable": False, "models": [], "error": str(e)}
