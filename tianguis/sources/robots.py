"""Robots rules: the longest matching rule decides, and of equally long ones the permission."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_robots(text: str, agent: str) -> list[tuple[bool, str]]:
    """The (allowed, pattern) rules for an agent: of the first group naming it, else of the first for all."""
    groups: list[dict] = []
    naming = False
    for line in text.splitlines():
        name, mark, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not mark:
            continue
        if name == "user-agent":
            if not naming:
                groups.append({"agents": [], "rules": []})
            groups[-1]["agents"].append(value.lower())
            naming = True
        elif name in ("allow", "disallow"):
            naming = False
            if groups and value:
                groups[-1]["rules"].append((name == "allow", value))
    own = [g for g in groups if any(a != "*" and a in agent.lower() for a in g["agents"])]
    every = [g for g in groups if "*" in g["agents"]]
    return (own or every or [{"rules": []}])[0]["rules"]


def _regex(pattern: str) -> str:
    anchored = pattern.endswith("$")
    parts = (pattern[:-1] if anchored else pattern).split("*")
    return "^" + ".*".join(re.escape(p) for p in parts) + ("$" if anchored else "")


def url_path(url: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    return F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)


def can_fetch(url: Column, rules: list[tuple[bool, str]]) -> Column:
    path = url_path(url)
    hits = [F.when(path.rlike(_regex(p)), F.struct(F.lit(len(p)).alias("long"), F.lit(int(ok)).alias("ok"))) for ok, p in rules]
    return F.coalesce(F.array_max(F.array_compact(F.array(*hits)))["ok"] == 1, F.lit(True)) if hits else F.lit(True)


# Marks of a page that asks for a human.
CHALLENGE_MARKS = ["just a moment...", "un momento…", "attention required! | cloudflare", "cf-chl-", "challenge-platform", "cf_chl_opt"]


def is_challenge(page: Column) -> Column:
    low = F.lower(page)
    out = F.lit(False)
    for mark in CHALLENGE_MARKS:
        out = out | low.contains(mark)
    return out
