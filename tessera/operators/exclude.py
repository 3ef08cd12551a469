"""Ordered exclude rules over paths: the last rule that matches decides.

Rules are compiled to regular expressions on the driver and folded into one boolean column, so excluding is a filter in
the scan's own stage. Excluded folders hide everything below them by an anti-join on ancestors.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ancestors, base_name


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool = False
    folders_only: bool = False

    @property
    def anchored(self) -> bool:
        """A slash inside ties a pattern to the whole path; one in front only is dropped and does not."""
        return "/" in self.pattern


def parse_rules(lines: Iterable[str]) -> list[Rule]:
    """Rules of an exclude file: blank lines and comments are skipped, "!" re-includes, a slash at the end means folders."""
    rules = []
    for line in map(str.strip, lines):
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[1:] if negated else line
        rules.append(Rule(body.removesuffix("/").removeprefix("/"), negated, body.endswith("/")))
    return rules


def _segment(glob: str) -> str | None:
    """A glob without "**" as a regular expression; None if it is malformed and so matches nothing."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(glob):
                return None
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "[":
            m = re.match(r"(\^?)((?:\\.|[^\]\\-])(?:-(?:\\.|[^\]\\-]))?(?:(?:\\.|[^\]\\-])(?:-(?:\\.|[^\]\\-]))?)*)\]", glob[i:])
            if not m:
                return None
            out.append("(?!/)[" + m[1] + re.sub(r"([\[&~^|])", r"\\\1", m[2]) + "]" if not m[1] else "[^/" + re.sub(r"([\[&~^|])", r"\\\1", m[2]) + "]")
            i += m.end()
        else:
            out.append(re.escape(c))
    return "".join(out)


def glob_regex(pattern: str) -> str | None:
    """A glob as a regular expression over the whole name. "**" stands for any number of whole segments, also none."""
    if "**" not in pattern:
        body = _segment(pattern)
        return None if body is None else f"^{body}$"
    first, *middle, last = pattern.split("**")
    first, last = first.removesuffix("/"), last.removeprefix("/")
    parts = [_segment(p) for p in (first, *[m.strip("/") for m in middle], last)]
    if any(p is None for p in parts):
        return None
    head, *inner, tail = parts
    inner = [p for p in inner if p]
    between = "".join(f"(?:[^/]*/)*{p}/" for p in inner)
    if not inner and not tail:
        return f"^{head}(?:/.*)?$" if head else "^.*$"
    if inner and not tail:
        return f"^{head + '/' if head else ''}{between[:-1]}(?:/.*)?$"
    rest = f"{between}(?:[^/]*/)*{tail}"
    # With nothing left after the first part, the last part is compared with the empty name.
    alone = f"|{head}" if head and not inner and re.fullmatch(tail, "") else ""
    return f"^(?:{head + '/' if head else ''}{rest}{alone})$"


def rule_matches(rule: Rule, path: Column) -> Column:
    regex = glob_regex(rule.pattern)
    if regex is None:
        return F.lit(False)
    whole = path.rlike("(?s)" + regex)
    return whole if rule.anchored else base_name(path).rlike("(?s)" + regex) | whole


def excluded(rules: Iterable[Rule], path: Column, is_folder: Column) -> Column:
    """Whether a path itself is excluded."""
    out = F.lit(False)
    for rule in rules:
        matches = rule_matches(rule, path)
        out = F.when((matches & is_folder) if rule.folders_only else matches, F.lit(not rule.negated)).otherwise(out)
    return out


def exclude(entries: DataFrame, rules: Iterable[Rule], path: str = "path", is_folder: str = "is_folder") -> DataFrame:
    """entries that neither a rule nor an excluded folder above them hides; nothing below such a folder can be re-included."""
    rules = list(rules)
    hidden = entries.where(F.col(is_folder) & excluded(rules, F.col(path), F.lit(True))).select(F.col(path).alias("_folder")).distinct()
    kept = entries.where(~excluded(rules, F.col(path), F.col(is_folder)))
    return kept.join(under(kept, hidden.withColumnRenamed("_folder", path), path).select(path).distinct(), path, "left_anti")


def under(entries: DataFrame, folders: DataFrame, path: str = "path") -> DataFrame:
    """entries below one of folders (a path column), however deep."""
    above = entries.select(path, F.explode(ancestors(F.col(path))).alias("_above"))
    below = above.join(folders.select(F.col(path).alias("_above")).distinct(), "_above", "left_semi").select(path).distinct()
    return entries.join(below, path, "left_semi")
