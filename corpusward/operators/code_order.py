"""What surely happened before a division or a call, from the block tree of a function.

A test or call comes before another if it stands earlier in the same block or in a block around it, and
not in a branch that may be left out. Both branches of a condition together count, and so does the one that does not leave.
The functions run inside the tasks of ``code_facts``.
"""

from __future__ import annotations

import ast
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

INNER = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
LEAVES = (ast.Return, ast.Raise, ast.Continue, ast.Break)
LOOPS = (ast.For, ast.AsyncFor, ast.While)
WITHS = (ast.With, ast.AsyncWith)
DIVIDES = (ast.Div, ast.FloorDiv, ast.Mod)


def chain(node: ast.AST) -> str:
    """Dotted name of a chain of names, the names after anything else, or nothing."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(parts[::-1])


def tested(test: ast.expr) -> set[str]:
    return {f"test {chain(n)}" for n in ast.walk(test) if isinstance(n, (ast.Name, ast.Attribute)) and chain(n)}


def calls_in(statements: list[ast.stmt]) -> set[str]:
    """Last names of all calls below the statements, inner definitions left out."""
    found, todo = set(), list(statements)
    while todo:
        node = todo.pop()
        if isinstance(node, INNER):
            continue
        if isinstance(node, ast.Call):
            found.add(chain(node.func).rsplit(".", 1)[-1])
        todo += ast.iter_child_nodes(node)
    return found


class Order:
    """Walks a function body once, keeping what has surely happened; notes divisors and calls."""

    def __init__(self, watched):
        self.watched = watched  # whether a call, by its dotted name, is noted
        self.unguarded: set[str] = set()
        self.calls: list[dict] = []
        self.loops: list[set[str]] = []
        self.withs: list[str] = []

    def block(self, statements: list[ast.stmt], known: set[str]) -> set[str] | None:
        """What is known after the statements; None if they always leave the block."""
        for node in statements:
            known = self.statement(node, known)
            if known is None:
                return None
        return known

    def statement(self, node: ast.stmt, known: set[str]) -> set[str] | None:
        if isinstance(node, INNER):
            return known
        if isinstance(node, ast.If):
            known = self.expression(node.test, known) | tested(node.test)
            ends = [self.block(part, set(known)) for part in (node.body, node.orelse)]
            return self.either(ends)
        if isinstance(node, LOOPS):
            head = node.test if isinstance(node, ast.While) else node.iter
            known = self.expression(head, known)
            known = known | tested(head) if isinstance(node, ast.While) else known
            self.loops.append(calls_in(node.body))
            self.block(node.body, set(known))
            self.loops.pop()
            self.block(node.orelse, set(known))
            return known
        if isinstance(node, (ast.Try, ast.TryStar)):
            ends = [self.block(node.body + node.orelse, set(known))]
            ends += [self.block(h.body, set(known)) for h in node.handlers]
            last = self.block(node.finalbody, set(known))
            after = self.either(ends)
            return None if after is None or last is None else after | last
        if isinstance(node, WITHS):
            for item in node.items:
                known = self.expression(item.context_expr, known)
                entered = item.context_expr.func if isinstance(item.context_expr, ast.Call) else item.context_expr
                self.withs.append(chain(entered))
            after = self.block(node.body, set(known))
            del self.withs[len(self.withs) - len(node.items) :]
            return after
        if isinstance(node, ast.Match):
            known = self.expression(node.subject, known) | tested(node.subject)
            for case in node.cases:
                self.block(case.body, set(known))
            return known
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.expr):
                known = self.expression(child, known)
        if isinstance(node, ast.Assert):
            known = known | tested(node.test)
        return None if isinstance(node, LEAVES) else known

    @staticmethod
    def either(ends: list[set[str] | None]) -> set[str] | None:
        """What is known after one of several ways, of which some never come here."""
        here = [end for end in ends if end is not None]
        return set.intersection(*here) if here else None

    def expression(self, node: ast.expr, known: set[str]) -> set[str]:
        """What is known after the expression; its parts are taken in the order they are evaluated."""
        if isinstance(node, ast.Lambda):
            return known
        if isinstance(node, ast.BoolOp):
            after = self.expression(node.values[0], known)
            inner = after
            for left, right in zip(node.values, node.values[1:]):
                inner = self.expression(right, inner | tested(left))
            return after
        if isinstance(node, ast.IfExp):
            known = self.expression(node.test, known)
            for part in (node.body, node.orelse):
                self.expression(part, known | tested(node.test))
            return known
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.expr):
                known = self.expression(child, known)
            elif isinstance(child, ast.keyword):
                known = self.expression(child.value, known)
            elif isinstance(child, ast.comprehension):
                inner = self.expression(child.iter, known)
                for test in child.ifs:
                    inner = self.expression(test, inner)
        if isinstance(node, ast.BinOp) and isinstance(node.op, DIVIDES):
            divisor = chain(node.right)
            if divisor and f"test {divisor}" not in known:
                self.unguarded.add(divisor)
        if isinstance(node, ast.Call):
            name = chain(node.func)
            if self.watched(name):
                self.calls.append({
                    "line": node.lineno, "qualified": name, "short": name.rsplit(".", 1)[-1],
                    "before": sorted(k[5:] for k in known if k.startswith("call ")),
                    "loops": len(self.loops), "loop_calls": sorted(set().union(*self.loops)), "withs": sorted(set(self.withs)),
                })
            known = known | {f"call {name.rsplit('.', 1)[-1]}"}
        return known
