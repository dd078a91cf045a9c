"""Reads rule tables and derives from each pattern what the plan needs besides: plain words and an example.

A rule table is text: one rule per line, tab-separated, ``#`` for remarks. Patterns are written once; the words a
line must contain for a pattern to match are read off its parse tree, so that a substring test can stand before it.
"""
from __future__ import annotations

import json
import re
from importlib import resources
from typing import Any

Rule = dict[str, Any]
VERSION = "v4.1-corpus"
# Events that an observation may still report.
TELEMETRY = ("api.telemetry", "runtime.hook_registered", "tool.completed", "search.query_started",
             "runtime.memory_telemetry", "platform.command_registered")
# One logger of each scope, for example lines.
LOGGERS = {"llm": "agent.conversation_loop", "platform": "gateway.platforms.discord", "tool": "agent.tool_executor", "": "agent.core"}


def portable(pattern: str) -> str:
    """A dot stands for anything but a newline; the engines differ on other line ends, so it is spelled out."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at:at + 2])
            at += 2
            continue
        inside = (inside or c == "[") and not (inside and c == "]")
        out.append(r"[^\n]" if c == "." and not inside else c)
        at += 1
    return "".join(out)


def _alternatives(tree) -> list[str] | None:
    """Lower-case words of which at least one is in every match; None if no such words are known."""
    found, run = [], ""
    for kind, value in [*tree, (None, None)]:
        name = str(kind)
        if name == "LITERAL":
            run += chr(value).lower()
            continue
        if run.strip():
            found.append([run])
        run = ""
        inner = None
        if name == "SUBPATTERN":
            inner = _alternatives(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            inner = _alternatives(value[2])
        elif name == "BRANCH":
            each = [_alternatives(branch) for branch in value[1]]
            inner = None if None in each else [word for words in each for word in words]
        if inner:
            found.append(inner)
    # long words are rare; a short one among the alternatives spoils the test
    return max(found, key=lambda words: (min(len(w.strip()) for w in words) / len(words) ** 0.3)) if found else None


def needles(pattern: str) -> list[str]:
    words = _alternatives(re._parser.parse(pattern, re.I)) or []
    return sorted(dict.fromkeys(w for w in words if not any(o != w and o in w for o in words)))


def any_of(words: list[str]) -> str:
    """A pattern whose first group is, at each place where one of the words begins, the longest of them.

    It takes no characters, so words inside others are found too. Common beginnings are written once, and many
    branches are told apart by classes of first characters, because engines try them one after another.
    """
    def tree(tails: list[str]) -> str:
        by_first: dict[str, list[str]] = {}
        for tail in tails:
            if tail:
                by_first.setdefault(tail[0], []).append(tail[1:])
        branches = [(first, re.escape(first) + tree(rest)) for first, rest in sorted(by_first.items())]
        size = max(1, round(len(branches) ** 0.5)) if len(branches) > 8 else 1
        some = [branches[at:at + size] for at in range(0, len(branches), size)]
        texts = [part[0][1] if len(part) == 1 else
                 f"(?=[{''.join(re.escape(first) for first, _ in part)}])(?:{'|'.join(text for _, text in part)})" for part in some]
        if not texts:
            return ""
        joined = texts[0] if len(texts) == 1 and "" not in tails else f"(?:{'|'.join(texts)})"
        return joined + ("?" if "" in tails else "")

    return f"(?=({tree(sorted(set(words)))}))"


def sample(pattern: str) -> str:
    """A short text that the pattern matches: first branches, fewest repeats."""
    def one(member) -> str:
        kind, value = member
        if str(kind) == "LITERAL":
            return chr(value)
        if str(kind) == "RANGE":
            return chr(value[0])
        return {"CATEGORY_DIGIT": "7", "CATEGORY_SPACE": " ", "CATEGORY_WORD": "w"}.get(str(value), "x")

    def text(tree) -> str:
        out = ""
        for kind, value in tree:
            name = str(kind)
            if name == "LITERAL":
                out += chr(value)
            elif name == "IN":
                out += "x" if str(value[0][0]) == "NEGATE" else one(value[0])
            elif name in ("NOT_LITERAL", "ANY"):
                out += "x"
            elif name == "SUBPATTERN":
                out += text(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                blank = value[0] == 0 and value[1] > 99  # a gap: room for a word boundary
                out += " " if blank else text(value[2]) * value[0]
            elif name == "BRANCH":
                out += text(value[1][0])
        return out

    return re.sub(" +", " ", text(re._parser.parse(pattern, re.I)))


def _rows(name: str) -> list[list[str]]:
    raw = resources.files("tracewell.resources").joinpath(name).read_text(encoding="utf-8")
    return [line.split("\t") for line in raw.splitlines() if line and not line.startswith("#")]


def _complete(rule: Rule, head: str, flags: str = "(?i)") -> Rule:
    rule["pattern"] = flags + portable(rule["pattern"])
    rule["needles"] = needles(rule["pattern"])
    anchored = rule["pattern"].startswith("(?i)^")
    rule["example"] = f"ERROR {head}: {sample(rule['pattern'])}" if head and not anchored else f"{head}: {sample(rule['pattern'])}" if head else sample(rule["pattern"])
    return rule


def shipped() -> dict[str, Any]:
    """The catalogue of the resources folder."""
    causes = [{"id": i, "scope": s, "pattern": p} for i, s, p in _rows("causes.tsv")]
    events = [{"id": i, "scope": s, "operation": o, "requires": r.split(), "pattern": p, "telemetry": i in TELEMETRY}
              for i, s, o, r, p in _rows("events.tsv")]
    system = json.loads(resources.files("tracewell.resources").joinpath("system.json").read_text(encoding="utf-8"))["rules"]
    by_cause = {c["id"]: c["pattern"] for c in reversed(causes)}
    for rule in causes:
        _complete(rule, LOGGERS[rule["scope"]])
    for rule in events:
        _complete(rule, LOGGERS[rule["scope"]])
        if rule["requires"]:  # the line must hold one of the causes as well
            needed = next(c for c in rule["requires"] if c in by_cause)
            rule["example"] += " " + sample(by_cause[needed])
    for rule in system:
        _complete(rule, "", "" if rule.get("exact_case") else "(?i)")
    return {"version": VERSION, "causes": causes, "events": events, "system": system}
