"""Moderation by a table of rules: rules are rows, compiled once in each task into an automaton over folded and squashed text."""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
import unicodedata
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import moderation as M
from corpusloom.functions import text as T

RULES = "priority int, category string, severity string, kind string, pattern string, exempt boolean"
#: Rules that may be sent to the tasks.
MOST_RULES = 20_000
_ZERO = re.compile("[​-‍﻿]")
_RUNS, _TWICE = re.compile(r"([^\n])\1{2,}"), re.compile(r"(.)\1+")
_LOOKS = str.maketrans(T.LOOKS, T.LETTERS)


def rule_table(spark: SparkSession, feedback: bool = False) -> DataFrame:
    """The library's own rules as a table (RULES). kind: a pattern of the folded text, a word of the squashed one, or a pattern of the text
    itself that marks a question about rules, in which exempt categories do not count."""
    rules = M.PATTERNS | (M.FEEDBACK if feedback else {})
    rows = [(n, c, M.SEVERITY.get(c, "LOW"), "pattern", p, c in M.EXEMPT) for n, (c, ps) in enumerate(rules.items()) for p in ps]
    first = next(iter(rules))
    rows += [(0, first, M.SEVERITY.get(first, "LOW"), "word", w, False) for w in M.SQUASHED]
    rows += [(len(rules), None, None, "policy", p, False) for p in M.POLICY]
    return spark.createDataFrame(rows, RULES)


def folded(text: str) -> str:
    """``T.evasion_folded`` in plain Python."""
    return _RUNS.sub(r"\1\1", _ZERO.sub("", unicodedata.normalize("NFKD", text).strip(" \t\n\x0b\f\r").lower()))


def squashed(fold: str) -> str:
    """``T.evasion_squashed`` of a folded text."""
    return _TWICE.sub(r"\1", "".join(c for c in fold.translate(_LOOKS) if c.isalnum() or c == "_" or "ऀ" <= c <= "ॿ"))


def needed(pattern: str, least: int = 2) -> set[str] | None:
    """Literals, in lower case, of which every text that fits a pattern has one; None if there is no such set of literals of
    ``least`` characters or more."""

    def of(items: Iterable) -> set[str] | None:
        best, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is C.LITERAL:
                run += chr(arg).lower()
                continue
            if run:
                best.append({run})
                run = ""
            if op is C.SUBPATTERN:
                best.append(of(arg[3]))
            elif op is C.BRANCH:
                each = [of(x) for x in arg[1]]
                best.append(None if None in each else set().union(*each))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
                best.append(of(arg[2]))
        usable = [b for b in best if b and min(map(len, b)) >= least]
        return max(usable, key=lambda b: (min(map(len, b)), -len(b))) if usable else None

    return of(parser.parse(pattern, re.IGNORECASE))


class Rules:
    """A rule table made ready: an automaton of the literals that patterns need and of the words, and patterns compiled when first tried."""

    def __init__(self, rows: list):
        ordered = sorted((r for r in rows if r["kind"] != "policy"), key=lambda r: r["priority"])
        self.rules = [(r["category"], r["severity"], r["pattern"], r["exempt"], r["kind"]) for r in ordered]
        self.policy = [re.compile(r["pattern"], re.IGNORECASE) for r in rows if r["kind"] == "policy"]
        self.tried: dict[int, re.Pattern] = {}
        self.always: list[int] = []
        parts: dict[str, dict[str, list[int]]] = {"pattern": {}, "word": {}}
        for i, (_, _, p, _, kind) in enumerate(self.rules):
            literals = {p} if kind == "word" else needed(p)
            if literals is None:
                self.always.append(i)
            for x in literals or ():
                parts[kind].setdefault(x, []).append(i)
        self.machines = {kind: self._machine(of) for kind, of in parts.items()}

    @staticmethod
    def _machine(of: dict[str, list[int]]):
        if not of:
            return None
        a = ahocorasick.Automaton()
        for word, rules in of.items():
            a.add_word(word, tuple(rules))
        a.make_automaton()
        return a

    def _met(self, kind: str, text: str) -> set[int]:
        machine = self.machines[kind]
        return {i for _, rules in machine.iter(text) for i in rules} if machine else set()

    def tag(self, text: str | None) -> tuple[str, str] | None:
        """Category and severity of the first rule that fits."""
        if not text:
            return None
        fold = folded(text)
        words = self._met("word", squashed(fold)) if self.machines["word"] else set()
        allowed = None
        for i in sorted({*self.always, *self._met("pattern", fold), *words}):
            category, severity, pattern, exempt, kind = self.rules[i]
            if kind == "pattern":
                if i not in self.tried:
                    self.tried[i] = re.compile(pattern, re.IGNORECASE)
                if not self.tried[i].search(fold):
                    continue
            if exempt:
                if allowed is None:
                    allowed = any(p.search(text) for p in self.policy)
                if allowed:
                    continue
            return category, severity
        return None


def tagged(texts: DataFrame, rules: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, category and severity of each row of texts by a table of rules (RULES), of which MOST_RULES may be sent to the tasks."""
    found = rules.select(*(c.split(" ")[0] for c in RULES.split(", "))).limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    sent = texts.sparkSession.sparkContext.broadcast([r.asDict() for r in found])

    def run(batches):
        ready = Rules(sent.value)
        for b in batches:
            tags = [ready.tag(t.as_py()) or (None, None) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t[0] for t in tags], pa.string()), pa.array([t[1] for t in tags], pa.string())], [key, "category", "severity"])

    return texts.select(key, F.col(text)).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, category string, severity string")
