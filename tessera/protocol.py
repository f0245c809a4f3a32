"""Requests and answers: payload validation, batches, envelopes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

#: The fields of each command. S: non-empty text, I: positive
#: whole number, B: truth value, words: one of them; ? may be left out.
COMMANDS: dict[str, dict[str, str]] = {
    "packages": {},
    "symbols": {"pattern": "S?", "kind": "S?", "file": "S?", "limit": "I?"},
    "info": {"symbol": "S"},
    "expand": {"symbol": "S"},
    "related": {"symbol": "S"},
    "search": {"query": "S", "pattern": "S?", "hasProperty": "S?", "extends": "S?", "limit": "I?"},
    "diagnostics": {"explain": "B?"},
    "at-position": {"file": "S", "line": "I", "column": "I"},
    "eval": {"expression": "S"},
    "explain": {"expression": "S"},
    "check-snippet": {"code": "S"},
    "file": {"file": "S", "symbol": "S?", "includePrivate": "B?"},
    "compatible": {"from": "S", "to": "S"},
    "graph": {"symbol": "S", "depth": "I?", "format": "mermaid|dot?"},
    "refactor-preview": {"symbol": "S", "to": "S"},
    "why-error": {"code": "I?", "message": "S?", "file": "S?", "line": "I?"},
    "transform-search": {
        "from": "S?", "to": "S?", "paramPosition": "I?", "unwrapReturn": "B?", "exportedOnly": "B?", "allowTypeErasure": "B?", "verifiedOnly": "B?",
        "minVerificationStatus": "unverified|assignable|verified?", "includeDiagnostics": "B?", "includeSyntheticCode": "B?", "includeFailedVerification": "B?", "limit": "I?",
    },
    "verify-contract": {"from": "S?", "to": "S?", "snippet": "S?", "symbol": "S?", "includeDiagnostics": "B?", "includeTransformEvidence": "B?", "transformLimit": "I?"},
    "doctor": {},
}
#: Commands of which at least one of some groups of fields is needed; those that can't come in batches.
NEEDED = {"why-error": (("code",), ("message",), ("file", "line")), "transform-search": (("from",), ("to",)), "verify-contract": (("from",), ("to",), ("snippet",))}
SINGLE = ("packages", "doctor")


def fits(value: Any, kind: str) -> bool:
    kind = kind.rstrip("?")
    if kind == "S":
        return isinstance(value, str) and bool(value.strip())
    if kind == "I":
        return isinstance(value, int) and not isinstance(value, bool) and value > 0
    return isinstance(value, bool) if kind == "B" else value in kind.split("|")


def issues(command: str, payload: Any, path: str = "") -> list[str]:
    """All that is wrong with a payload, by path."""
    if not isinstance(payload, dict):
        return [f"{path or 'payload'}: not an object"]
    fields = COMMANDS[command] | {"root": "S?"} | ({} if command in SINGLE else {"package": "S?"})
    dot = f"{path}." if path else ""
    found = [f"{dot}{k}: unknown" for k in payload if k not in fields]
    found += [f"{dot}{k}: missing" for k, kind in fields.items() if k not in payload and not kind.endswith("?")]
    found += [f"{dot}{k}: not valid" for k, kind in fields.items() if k in payload and not fits(payload[k], kind)]
    if command in NEEDED and not any(all(f in payload for f in group) for group in NEEDED[command]):
        found.append(f"{path or 'payload'}: needs one of {', '.join('+'.join(g) for g in NEEDED[command])}")
    return found


@dataclass
class Service:
    """Answers commands by handlers that take a payload and return what JSON can hold."""

    handlers: dict[str, Callable[[dict], Any]]

    def run(self, command: str, payload: Any) -> dict:
        """One envelope; a list of payloads is a batch, answered in order, each item with its own error."""
        if command not in COMMANDS:
            return {"ok": False, "command": command, "error": {"code": "UNKNOWN_COMMAND"}}
        if isinstance(payload, list) and command not in SINGLE:
            items = [self.one(command, p, f"items[{i}]") for i, p in enumerate(payload)]
            good = sum(x["ok"] for x in items)
            outcome = "succeeded" if good == len(items) else "partial_failure" if good else "failed"
            return {"ok": good == len(items), "command": command, "outcome": outcome, "items": items}
        return {"command": command} | self.one(command, payload, "")

    def one(self, command: str, payload: Any, path: str) -> dict:
        if found := issues(command, payload, path):
            return {"ok": False, "error": {"code": "INVALID_INPUT", "issues": found}}
        try:
            return {"ok": True, "data": self.handlers[command](payload)}
        except Exception as e:  # an item's failure is its answer
            return {"ok": False, "error": {"code": type(e).__name__, "message": str(e).split("\n")[0]}}


def envelope(answer: dict) -> str:
    return json.dumps(answer, ensure_ascii=False, sort_keys=True)
