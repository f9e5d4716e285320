"""Pipeline descriptions: ``source property=value ! operator ! sink``.

A value is a quoted string, a boolean, a number or a bare word. A word is read to its end before it is taken for
a boolean or a number, so ``name=northsrc`` and ``size=1080p`` are words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(r'\s*(?:(!)|([A-Za-z_][\w.-]*)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|\'((?:[^\'\\]|\\.)*)\'|([^\s!]+))|([A-Za-z_][\w.-]*))')


class PipelineError(ValueError):
    """A description that cannot be read, bound or linked."""


@dataclass
class Step:
    name: str
    properties: dict = field(default_factory=dict)


def value(word: str):
    """A bare word as what it says."""
    if word.lower() in ("true", "false"):
        return word.lower() == "true"
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            pass
    return word


def parse(description: str) -> list[Step]:
    """The steps of a description."""
    steps: list[Step] = []
    at, linked = 0, True
    text = description.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise PipelineError(f"cannot read {text[at:]!r}")
        at = m.end()
        bang, key, double, single, bare, name = m.groups()
        if bang:
            if linked:
                raise PipelineError("a link without an element before it")
            linked = True
        elif name:
            if not linked:
                raise PipelineError(f"no link before {name!r}")
            steps.append(Step(name))
            linked = False
        else:
            if linked:
                raise PipelineError(f"property {key!r} without an element")
            quoted = double if double is not None else single
            steps[-1].properties[key] = re.sub(r"\\(.)", r"\1", quoted) if quoted is not None else value(bare)
    if not steps or linked:
        raise PipelineError("a description ends with an element")
    return steps
