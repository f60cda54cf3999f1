"""The client of a turn: from a raw prompt to the JSON that carries a context, and a record of the outcome.

    python -m lanternfish.service.client --config config.json [prompt ...] < request

A prompt on the command line wins over the request on standard input.
"""

from __future__ import annotations

import argparse
import json
import re
import sys
import time
import urllib.request
from collections.abc import Callable
from typing import TextIO

from ..functions import text as X
from ..operators.audit import append_line, client_line
from ..plans import config as settings


def extract(raw: str) -> str:
    """The prompt of a JSON request, or the raw text."""
    raw = raw.strip()
    try:
        parsed = json.loads(raw)
    except ValueError:
        return raw
    if not isinstance(parsed, dict):
        return ""
    return next((str(parsed[k]).strip() for k in X.PROMPT_KEYS if parsed.get(k)), "")


def trimmed(text: str) -> str:
    return text.strip(_SPACE)


#: The characters of X.WS one by one.
_SPACE = "".join(chr(c) for c in range(0x10000) if re.match(f"[{X.WS}]", chr(c)))


def normalize(prompt: str) -> str:
    """functions.text.normalize_prompt for one prompt on the driver: the same patterns in the same order."""
    t = trimmed(prompt)
    if m := re.search(X.python_pattern(X.CURRENT_MESSAGE), t):
        return trimmed(m[1])
    for pattern in X.ENVELOPE:
        t = trimmed(re.sub(X.python_pattern(pattern), "", t))
    return t


def substantive(prompt: str) -> bool:
    t = trimmed(prompt)
    if any(re.search(X.python_pattern(p), t) for p in X.ROUTINE):
        return False
    return len(t.encode("utf-16-le")) // 2 >= 12 or len(re.findall(X.LATIN_WORD, t)) >= 3


def run(raw: str, config: dict, emit: Callable[[str], None], log: Callable[[dict], None], fetch: Callable[[str, bytes, float], dict] | None = None) -> bool:
    """Ask the service for a context and emit it; whether there was one. Errors only reach the log."""
    prompt = normalize(extract(raw))
    if not config["enabled"] or not substantive(prompt):
        return False
    began, outcome = time.time(), "error"
    try:
        s = config["service"]
        reply = (fetch or _post)(f"http://{s['host']}:{s['port']}/retrieve", json.dumps({"query": prompt}).encode(), s["timeoutMs"] / 1000)
        outcome = "delivered" if reply.get("additionalContext") else "empty"
        if outcome == "delivered":
            emit(json.dumps({"hookSpecificOutput": {"hookEventName": "UserPromptSubmit", "additionalContext": reply["additionalContext"]}}, ensure_ascii=False))
    except TimeoutError:
        outcome = "timeout"
    except Exception as e:  # the edge of the client: a turn goes on without a context
        outcome = "timeout" if isinstance(getattr(e, "reason", None), TimeoutError) else "error"
    try:
        log(client_line(prompt, outcome, int((time.time() - began) * 1000)))
    except OSError as e:
        print(f"the outcome was not logged: {e}", file=sys.stderr)
    return outcome == "delivered"


def _post(url: str, body: bytes, timeout: float) -> dict:
    request = urllib.request.Request(url, body, {"content-type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def main(argv: list[str] | None = None, stdin: TextIO | None = None, stdout: TextIO | None = None) -> int:
    p = argparse.ArgumentParser(prog="lanternfish-client")
    p.add_argument("--config", default="config.json")
    p.add_argument("prompt", nargs="*")
    a = p.parse_args(argv)
    try:
        config = settings.load(a.config)
        said = trimmed(" ".join(a.prompt))
        raw = json.dumps({"prompt": said}) if said else (stdin or sys.stdin).read()
        run(raw, config, lambda text: print(text, end="", file=stdout or sys.stdout), lambda record: append_line(settings.log_path(config), record))
    except Exception as e:  # the edge of the client: a turn goes on without a context
        print(f"no context: {e}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
