"""The facts of one file, and their table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SCHEMA = (
    "path string, rec string, sym int, parent int, kind string, name string, scope array<string>, line int, arity int, pos int, "
    "def_hash long, text string, source string, target string"
)


@dataclass
class Facts:
    """Rows under construction. ``rec`` is symbol, call, import, super, ref, succ, touch, flow or lflow.

    Symbols of a file are numbered. Ends of a flow are ``param:<sym>``, ``return:<sym>``, ``call:<n>`` or
    ``arg:<n>:<position>``, where n numbers the file's calls; of a flow from or to a local (lflow), with the lines of its definitions as
    text, also ``local:<sym>``. A touch is a block that defines or uses a local or parameter.
    """

    path: str
    rows: list[dict] = field(default_factory=list)
    symbols: int = 0
    calls: int = 0

    def add(self, rec: str, **values) -> None:
        self.rows.append({"path": self.path, "rec": rec} | values)

    def symbol(self, kind: str, name: str, scope: list[str], line: int, parent: int | None = None, text: str = "", **more) -> int:
        self.add("symbol", sym=self.symbols, kind=kind, name=name, scope=list(scope), line=line, parent=parent, text=re.sub(r"\s+", " ", text), **more)
        self.symbols += 1
        return self.symbols - 1

    def call(self, caller: int | None, name: str, receiver: str, line: int, args: int) -> int:
        self.add("call", sym=self.calls, parent=caller, name=name, text=receiver, line=line, pos=args)
        self.calls += 1
        return self.calls - 1
