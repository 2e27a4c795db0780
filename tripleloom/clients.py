"""Text-generation clients: anything that takes (prompt, system) and returns text will do."""

from __future__ import annotations

import json
import subprocess
import urllib.request
from dataclasses import dataclass


@dataclass(frozen=True)
class CommandClient:
    """Runs a command for each call: system and prompt on its standard input, the answer on its output.
    It can be sent to executors, so calls run where the sections are."""

    argv: tuple[str, ...]
    timeout: float = 120.0

    def __call__(self, prompt: str, system: str) -> str:
        r = subprocess.run(
            list(self.argv), input=f"<system>\n{system}\n</system>\n\n{prompt}", capture_output=True, text=True, encoding="utf-8", errors="replace",
            timeout=self.timeout, check=False,
        )
        if r.returncode:
            raise RuntimeError(f"command failed: {r.stderr[:200]}")
        return r.stdout.strip()


@dataclass(frozen=True)
class HttpClient:
    """Posts each call as JSON (model, max_tokens, system, messages) to a text-generation service and
    returns the text of the answer's first content block, or '' if that is no text. ``headers`` carry the
    key, e.g. (("x-api-key", key),). It can be sent to executors."""

    url: str
    model: str
    headers: tuple[tuple[str, str], ...] = ()
    max_tokens: int = 1024
    timeout: float = 120.0

    def __call__(self, prompt: str, system: str) -> str:
        body = {"model": self.model, "max_tokens": self.max_tokens, "system": system, "messages": [{"role": "user", "content": prompt}]}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"content-type": "application/json", **dict(self.headers)})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            blocks = json.load(r)["content"]
        return blocks[0]["text"].strip() if blocks and blocks[0].get("type") == "text" else ""


def load_env(path: str, environ: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE lines of a file into ``environ``, which keeps what it has; a missing file adds nothing."""
    try:
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                if line and not line.startswith("#") and "=" in line:
                    k, v = line.split("=", 1)
                    environ.setdefault(k.strip(), v.strip().strip("\"'"))
    except OSError:
        pass
    return environ
