"""Subject profiles: checking them, comparing them, and the two-step edit that replaces one."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable

from weftgraph.functions.jsontext import dumps

MOST_GUIDE = 100_000
#: Marks tokens of profiles, so that one of another step is none of theirs.
TOKEN = "profile"
NUMBER_FROM = ("order", "position", "description")
PARSE_KEYS = ("numberFrom", "containerEdge", "supportEdge", "progressionEdge", "dependencyEdge", "prune")


def checked(raw: object) -> dict:
    """{core, guide?} of a stored profile, which may be the flat form of old; ValueError names every fault."""
    core, guide = (raw.get("core"), raw.get("guide")) if isinstance(raw, dict) and "core" in raw else (raw, None)
    faults: list[str] = []
    if not isinstance(core, dict):
        raise ValueError("profile: not an object")
    core = {k: v for k, v in core.items() if k != "deliverables"}  # a key of old that no longer counts
    faults += [f"{k}: unknown" for k in core if k not in ("id", "capabilities", "parse")]
    if not isinstance(core.get("id"), str) or not core.get("id"):
        faults.append("id: a text is needed")
    capabilities = core.get("capabilities")
    if not isinstance(capabilities, dict) or set(capabilities) != {"exampleDomainRotation"} or not isinstance(capabilities["exampleDomainRotation"], bool):
        faults.append("capabilities: {exampleDomainRotation: true or false} is needed")
    rules = core.get("parse")
    if not isinstance(rules, dict):
        faults.append("parse: an object is needed")
    else:
        faults += [f"parse.{k}: unknown" for k in rules if k not in PARSE_KEYS]
        if rules.get("numberFrom", "order") not in NUMBER_FROM:
            faults.append(f"parse.numberFrom: one of {', '.join(NUMBER_FROM)}")
        for k in ("progressionEdge", "dependencyEdge"):
            if k in rules and not isinstance(rules[k], str):
                faults.append(f"parse.{k}: a text is needed")
    if guide is not None and not isinstance(guide, str):
        faults.append("guide: a text is needed")
    elif guide is not None and len(guide) > MOST_GUIDE:
        faults.append(f"guide: {len(guide)} characters, over {MOST_GUIDE}")
    if faults:
        raise ValueError("; ".join(faults))
    return {"core": core} | ({} if guide is None else {"guide": guide})


def config_hash(config: object) -> str:
    return hashlib.sha256(dumps(config).encode()).hexdigest()


def changed(before: object, after: object) -> bool:
    return config_hash(before) != config_hash(after)


#: Looks at a profile that has the right form and returns its errors, which block it, and warnings.
Validator = Callable[[dict], tuple[list[str], list[str]]]


def preview(now: object, proposed: object, validate: Validator | None = None) -> dict:
    """Whether a profile is good and what token confirms it; its token has no end of time."""
    try:
        record = checked(proposed)
    except ValueError as e:
        return {"status": "blocked", "errors": str(e).split("; "), "warnings": []}
    errors, warnings = validate(record) if validate else ([], [])
    if errors:
        return {"status": "blocked", "errors": errors, "warnings": warnings}
    token = {"t": TOKEN, "v": config_hash(now), "p": config_hash(record)}
    return {"status": "preview", "changed": changed(now, record), "warnings": warnings, "token": base64.urlsafe_b64encode(dumps(token).encode()).decode()}


def confirm(now: object, proposed: object, token: str, validate: Validator | None = None) -> tuple[str, dict | None]:
    """("applied", record), or why not."""
    try:
        t = json.loads(base64.urlsafe_b64decode(token))
        kind, version, digest = t["t"], t["v"], t["p"]
    except (ValueError, KeyError, TypeError):
        return "malformed token", None
    if kind != TOKEN:
        return "token of something else", None
    record = checked(proposed)
    if digest != config_hash(record):
        return "arguments differ", None
    if validate and validate(record)[0]:
        return "blocked", None
    return ("stale", None) if version != config_hash(now) else ("applied", record)
