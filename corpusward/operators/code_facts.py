"""Code facts: one row per Python file with arrays of plain facts about its syntax.

The parser of the standard library runs once per file, inside Spark tasks; it only
records facts. Every rule is a column expression on these arrays (``code_rules``), so
all rules together need one pass and no shuffle.
"""

from __future__ import annotations

import ast
import io
import re
import sys
import tokenize
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusward.functions import text
from corpusward.operators.code_order import Order
from corpusward.sources.corpus import PYTHON, of_groups

# The functions below travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDERED_CALL = "line:int,qualified:string,short:string,before:array<string>,loops:int,loop_calls:array<string>,withs:array<string>"
FUNCTION = (
    "name:string,qualname:string,line:int,end_line:int,is_async:boolean,has_docstring:boolean,returns_annotated:boolean,"
    "sole_stmt:string,block_depths:array<int>,decorators:array<string>,"
    "params:array<struct<kind:string,name:string,annotated:boolean,default_kind:string>>,"
    "call_ids:array<int>,targets:array<string>,attrs:array<string>,withs:array<string>,"
    "returns:string,returns_none:boolean,reads:array<string>,tested:array<string>,unguarded:array<string>,"
    f"ordered_calls:array<struct<{ORDERED_CALL}>>,"
    "literals:array<struct<text:string,value:double,parent_kind:string,parent_call:string,upper_target:boolean>>"
)
CALL = (
    "line:int,qualified:string,short:string,func_kind:string,receiver:string,arg0_kind:string,"
    "arg0_value:string,kwargs:array<string>,kwarg_values:array<string>,loop_depth:int,inside_with:boolean,"
    "result_use:string,result_name:string,scope:string"
)
HANDLER = "line:int,type_kind:string,type_names:array<string>,sole_stmt:string,has_raise:boolean,has_log:boolean"
FACTS = (
    "repo string, path string, bad_bytes boolean, "
    "parse_error struct<line:int,message:string>, parse_failure string, token_failure string, "
    f"functions array<struct<{FUNCTION}>>, calls array<struct<{CALL}>>, "
    "assigns array<struct<line:int,targets:array<string>,value_call:string>>, "
    f"handlers array<struct<{HANDLER}>>, comments array<struct<line:int,text:string>>, "
    "imports array<struct<line:int,module:string,names:array<string>,aliases:array<string>>>, classes array<struct<line:int,name:string>>, "
    "spans array<struct<kind:string,first:int,last:int>>, words array<struct<kind:string,name:string>>"
)

DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPES = (*DEFS, ast.ClassDef, ast.Lambda)
LOOPS = (ast.For, ast.AsyncFor, ast.While)
WITHS = (ast.With, ast.AsyncWith)
CONTROL = (*LOOPS, *WITHS, ast.If, ast.Match, ast.Try)
IDENTIFIER = re.compile(r"[A-Za-z_]\w*")
SENDS = ("send_transaction", "send_raw_transaction")
REMOTE = ("requests.", "session.", "self.session.")
# A batch of facts is closed at so many characters of source, or files.
BATCH_CHARS, BATCH_FILES = 1 << 17, 256
LOG_METHODS = {"debug", "info", "warning", "error", "exception", "critical", "log"}


def dotted(node: ast.AST) -> str:
    """Dotted name of a call target; what is not a chain of names counts as nothing."""
    tail: list[str] = []
    while isinstance(node, ast.Attribute):
        tail.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        tail.append(node.id)
    return ".".join(reversed(tail))


def last_name(call: ast.AST) -> str:
    func = getattr(call, "func", None)
    return func.id if isinstance(func, ast.Name) else func.attr if isinstance(func, ast.Attribute) else ""


def literal_kind(node: ast.AST | None) -> str | None:
    if node is None:
        return None
    if isinstance(node, ast.BinOp):
        return "add" if isinstance(node.op, ast.Add) else "other"
    if isinstance(node, ast.Call):
        return "format" if dotted(node.func) in ("format", "str.format") else f"call:{last_name(node)}"
    if isinstance(node, ast.Constant):
        return "string" if isinstance(node.value, str) else "constant"
    return {ast.JoinedStr: "fstring", ast.List: "list", ast.Dict: "dict", ast.Set: "set"}.get(type(node), "other")


def result_of(node: ast.AST, parents: dict) -> dict:
    """What becomes of a value: its attribute or item is read, it gets a name, or anything else."""
    parent = parents.get(node)
    if isinstance(parent, ast.Await):
        node, parent = parent, parents.get(parent)
    use = name = None
    if isinstance(parent, (ast.Attribute, ast.Subscript)) and parent.value is node:
        use = type(parent).__name__.lower()
    elif isinstance(parent, ast.Assign) and len(parent.targets) == 1 and isinstance(parent.targets[0], ast.Name):
        use, name = "assigned", parent.targets[0].id
    return {"result_use": use, "result_name": name}


def qualified_name(node: ast.AST, parents: dict, own: bool = True) -> str:
    """Names of the definitions around a node, and its own."""
    names = [node.name] if own else []
    while node in parents:
        node = parents[node]
        if isinstance(node, (*DEFS, ast.ClassDef)):
            names.append(node.name)
    return ".".join(reversed(names))


def call_fact(node: ast.Call, loops: int, in_with: bool, parents: dict) -> dict:
    func, first = node.func, node.args[0] if node.args else None
    plain = isinstance(first, ast.Constant) and isinstance(first.value, str)
    return {
        "line": node.lineno,
        "qualified": dotted(func),
        "short": last_name(node),
        "func_kind": {ast.Name: "name", ast.Attribute: "attribute"}.get(type(func), "other"),
        "receiver": func.value.id if isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name) else None,
        "arg0_kind": literal_kind(first),
        "arg0_value": printable(first.value) if plain else None,
        "kwargs": [k.arg for k in node.keywords if k.arg],
        "kwarg_values": [dotted(k.value) for k in node.keywords if k.arg],
        "loop_depth": loops,
        "inside_with": in_with,
        **result_of(node, parents),
        "scope": qualified_name(node, parents, own=False),
    }


def printable(value: str) -> str:
    """Lone surrogates of an escaped literal cannot be stored as UTF-8."""
    return value.encode("utf-8", "replace").decode("utf-8")


def handler_fact(node: ast.ExceptHandler) -> dict:
    caught = node.type.elts if isinstance(node.type, ast.Tuple) else [node.type]
    inner = list(ast.walk(node))
    return {
        "line": node.lineno,
        "type_kind": None if node.type is None else type(node.type).__name__.lower(),
        "type_names": [c.id for c in caught if isinstance(c, ast.Name)],
        "sole_stmt": type(node.body[0]).__name__.lower() if len(node.body) == 1 else None,
        "has_raise": any(isinstance(n, ast.Raise) for n in inner),
        "has_log": any(isinstance(n, ast.Call) and last_name(n) in LOG_METHODS and "log" in dotted(n.func).lower() for n in inner),
    }


def names_of(targets: list[ast.expr]) -> list[str]:
    return [t.id for t in targets if isinstance(t, ast.Name)]


def block_depths(statements: list[ast.stmt]) -> list[int]:
    """Depth of each control statement. An ``elif`` nests; inner definitions count on."""
    found, todo = [], [(s, 0) for s in statements]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, CONTROL):
            depth += 1
            found.append(depth)
        holders = [node]
        if isinstance(node, ast.Try):
            holders += node.handlers
        elif isinstance(node, ast.Match):
            holders += node.cases
        for holder in holders:
            for field in ("body", "orelse", "finalbody"):
                todo += [(s, depth) for s in getattr(holder, field, None) or () if isinstance(s, ast.stmt)]
    return found


def own_nodes(body: list[ast.stmt]) -> Iterator[ast.AST]:
    """Nodes of a function body. Inner scopes are left out, but one that is itself a
    statement of the body is entered, one level deep."""
    todo: list[ast.AST] = list(body)
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in ast.iter_child_nodes(node) if not isinstance(c, SCOPES)]


def param_facts(args: ast.arguments) -> list[dict]:
    placed = [("posonly", a) for a in args.posonlyargs] + [("normal", a) for a in args.args]
    defaults = [None] * (len(placed) - len(args.defaults)) + list(args.defaults)
    rows = [(kind, a, d) for (kind, a), d in zip(placed, defaults)]
    rows += [("kwonly", a, d) for a, d in zip(args.kwonlyargs, args.kw_defaults)]
    rows += [(kind, a, None) for kind, a in (("vararg", args.vararg), ("kwarg", args.kwarg)) if a]
    return [
        {"kind": kind, "name": a.arg, "annotated": a.annotation is not None, "default_kind": literal_kind(d)}
        for kind, a, d in rows
    ]


def literal_fact(node: ast.Constant, parent: ast.AST) -> dict:
    targets = parent.targets if isinstance(parent, ast.Assign) else [parent.target] if isinstance(parent, ast.AnnAssign) else []
    try:
        value = float(node.value)
    except OverflowError:
        value = float("inf")
    return {
        "text": str(node.value),
        "value": value,
        "parent_kind": type(parent).__name__.lower(),
        "parent_call": last_name(parent) if isinstance(parent, ast.Call) else None,
        "upper_target": bool(targets) and all(isinstance(t, ast.Name) and t.id.isupper() for t in targets),
    }


def note_usage(node: ast.AST, seen: dict[str, set[str]]) -> None:
    """Names that a function reads as attributes or whose attributes it reads, enters and tests."""
    if isinstance(node, (ast.Attribute, ast.Subscript)) and isinstance(node.value, ast.Name):
        seen["reads"].add(node.value.id)
    if isinstance(node, ast.Attribute):
        seen["attrs"].add(node.attr)
    elif isinstance(node, WITHS):
        entered = [i.context_expr.func if isinstance(i.context_expr, ast.Call) else i.context_expr for i in node.items]
        seen["withs"].update(dotted(e) for e in entered)
    elif isinstance(node, (ast.If, ast.IfExp, ast.While, ast.Assert)):
        seen["tested"].update(dotted(n) for n in ast.walk(node.test) if isinstance(n, (ast.Name, ast.Attribute)))


def function_fact(node: ast.FunctionDef | ast.AsyncFunctionDef, parents: dict, call_ids: dict) -> dict:
    first = node.body[0]
    documented = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
    body = node.body[1:] if documented else node.body
    sole = None
    if len(body) == 1:
        sole = type(body[0]).__name__.lower()
        if sole == "return" and isinstance(body[0].value, ast.Constant) and body[0].value.value is None:
            sole = "return_none"
    calls, targets, literals = [], [], []
    seen: dict[str, set[str]] = {"attrs": set(), "withs": set(), "reads": set(), "tested": set()}
    for inner in own_nodes(body):
        note_usage(inner, seen)
        if isinstance(inner, ast.Call):
            calls.append(call_ids[inner])
        elif isinstance(inner, ast.Assign):
            targets += names_of(inner.targets)
        elif isinstance(inner, ast.AnnAssign):
            targets += names_of([inner.target])
        elif isinstance(inner, ast.Constant) and type(inner.value) in (int, float):
            literals.append(literal_fact(inner, parents[inner]))
    order = Order(lambda name: name.rsplit(".", 1)[-1] in SENDS or name.startswith(REMOTE))
    order.block(body, set())
    returned = [n.value for n in own_nodes([s for s in body if not isinstance(s, SCOPES)]) if isinstance(n, ast.Return)]
    empty = [v is None or (isinstance(v, ast.Constant) and v.value is None) for v in returned]
    return {
        "name": node.name,
        "qualname": qualified_name(node, parents),
        "line": node.lineno,
        "end_line": node.end_lineno or node.lineno,
        "is_async": isinstance(node, ast.AsyncFunctionDef),
        "has_docstring": bool(ast.get_docstring(node)),
        "returns_annotated": node.returns is not None,
        "sole_stmt": sole,
        "block_depths": block_depths(body),
        "decorators": [dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list],
        "params": param_facts(node.args),
        "call_ids": calls,
        "targets": targets,
        "literals": literals,
        "returns": printable(ast.unparse(node.returns)) if node.returns is not None else None,
        "returns_none": any(empty) and not all(empty),
        "unguarded": sorted(order.unguarded),
        "ordered_calls": order.calls,
        **{name: sorted(found) for name, found in seen.items()},
    }


def of_block(kind: str, statements: list[ast.stmt]) -> dict:
    return {"kind": kind, "first": statements[0].lineno, "last": statements[-1].end_lineno}


def of_node(kind: str, node: ast.stmt) -> dict:
    return {"kind": kind, "first": node.lineno, "last": node.end_lineno}


def span_facts(node: ast.AST) -> list[dict]:
    """Surroundings that a node makes for the lines in it."""
    found = []
    if isinstance(node, ast.If):
        names = {dotted(n) for n in ast.walk(node.test) if isinstance(n, (ast.Name, ast.Attribute))}
        if any(n.rsplit(".", 1)[-1] in ("DEBUG", "__debug__") for n in names):
            found.append(of_block("debug-branch", node.body))
        if "__name__" in names:
            found.append(of_block("main-guard", node.body))
    elif isinstance(node, ast.ClassDef):
        bases = {dotted(b.value if isinstance(b, ast.Subscript) else b).rsplit(".", 1)[-1] for b in node.bases}
        meta = {dotted(k.value).rsplit(".", 1)[-1] for k in node.keywords if k.arg == "metaclass"}
        marks = {dotted(d.func if isinstance(d, ast.Call) else d).rsplit(".", 1)[-1] for d in node.decorator_list}
        kinds = (("abstract-class", "ABC" in bases or "ABCMeta" in meta), ("protocol-class", "Protocol" in bases), ("dataclass", "dataclass" in marks))
        found += [of_node(kind, node) for kind, there in kinds if there]
    elif isinstance(node, (ast.Try, ast.TryStar)):
        found += [of_block("finally", node.finalbody)] if node.finalbody else []
        found += [of_block("handler", h.body) for h in node.handlers]
    elif isinstance(node, DEFS):
        marks = {dotted(d).rsplit(".", 1)[-1] for d in node.decorator_list}
        found += [of_node("async-function", node)] if isinstance(node, ast.AsyncFunctionDef) else []
        found += [of_node("abstract-method", node)] if "abstractmethod" in marks else []
    if isinstance(node, (*DEFS, ast.ClassDef, ast.Module)) and node.body:
        first = node.body[0]
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            found.append(of_node("docstring", first))
    return found


def tree_facts(tree: ast.Module) -> dict:
    calls, assigns, handlers, imports, functions, classes, spans = [], [], [], [], [], [], []
    parents: dict[ast.AST, ast.AST] = {}
    call_ids: dict[ast.AST, int] = {}
    todo: list[tuple[ast.AST, int, bool]] = [(tree, 0, False)]
    while todo:
        node, loops, in_with = todo.pop()
        if isinstance(node, ast.Call):
            call_ids[node] = len(calls)
            calls.append(call_fact(node, loops, in_with, parents))
        elif isinstance(node, ast.Assign):
            value = node.value
            assigns.append({"line": node.lineno, "targets": names_of(node.targets), "value_call": last_name(value) if isinstance(value, ast.Call) else None})
        elif isinstance(node, ast.ExceptHandler):
            handlers.append(handler_fact(node))
        elif isinstance(node, ast.Import):
            imports += [{"line": node.lineno, "module": a.name, "names": [], "aliases": [a.asname or ""]} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append({"line": node.lineno, "module": "." * node.level + (node.module or ""), "names": [a.name for a in node.names], "aliases": [a.asname or "" for a in node.names]})
        elif isinstance(node, DEFS):
            functions.append(node)
        elif isinstance(node, ast.ClassDef):
            classes.append({"line": node.lineno, "name": node.name})
        spans += span_facts(node)
        if isinstance(node, SCOPES):
            loops, in_with = 0, in_with and isinstance(node, ast.Lambda)
        elif isinstance(node, LOOPS):
            loops += 1
        elif isinstance(node, WITHS):
            in_with = True
        for child in ast.iter_child_nodes(node):
            parents[child] = node
            todo.append((child, loops, in_with))
    facts = {"calls": calls, "assigns": assigns, "handlers": handlers, "imports": imports, "classes": classes, "spans": spans}
    facts["functions"] = [function_fact(f, parents, call_ids) for f in functions]
    return facts


def token_facts(tokens: Iterable[tokenize.TokenInfo]) -> tuple[list[dict], list[dict]]:
    """The comments, and the different identifiers of a file by the kind of token they stand in."""
    kinds = {tokenize.NAME: "name", tokenize.STRING: "string", tokenize.FSTRING_MIDDLE: "string", tokenize.COMMENT: "comment"}
    comments, found = [], set()
    for token in tokens:
        kind = kinds.get(token.type)
        if kind == "comment":
            comments.append({"line": token.start[0], "text": token.string})
        if kind == "name":
            found.add((kind, token.string))
        elif kind:
            found.update((kind, word) for word in IDENTIFIER.findall(token.string))
    return comments, [{"kind": kind, "name": printable(name)} for kind, name in sorted(found)]


def file_facts(repo: str, path: str, source: str) -> dict:
    facts: dict = {"repo": repo, "path": path}
    try:
        facts.update(tree_facts(ast.parse(source, filename=path)))
    except SyntaxError as problem:
        facts["parse_error"] = {"line": problem.lineno or 1, "message": printable(str(problem))}
    except (ValueError, RecursionError, MemoryError) as problem:
        facts["parse_failure"] = type(problem).__name__
    try:
        facts["comments"], facts["words"] = token_facts(tokenize.generate_tokens(io.StringIO(source).readline))
    except (SyntaxError, tokenize.TokenError, ValueError, RecursionError, MemoryError) as problem:
        facts["token_failure"] = type(problem).__name__
    return facts


def fact_batches(batches: Iterator[pa.RecordBatch], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Facts in batches of few sources, whatever the number of files in the batches read.

    Facts take many times the room of their source, so only one file and one such batch are held as Python objects.
    """
    for batch in batches:
        rows, held = [], 0
        for repo, path, bad_bytes, source in zip(*batch.columns):
            text = source.as_py()
            rows.append({**file_facts(repo.as_py(), path.as_py(), text), "bad_bytes": bad_bytes.as_py()})
            held += len(text)
            if held >= BATCH_CHARS or len(rows) == BATCH_FILES:
                yield pa.RecordBatch.from_pylist(rows, schema=shape)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=shape)


def code_facts(files: DataFrame) -> DataFrame:
    """Facts of all files named ``*.py``; other files never reach Python."""
    source = text.unix_newlines(F.col("content"))
    bad = F.col("bad_bytes") if "bad_bytes" in files.columns else F.lit(False)
    python = of_groups(files, PYTHON).where(F.col("path").endswith(".py") & F.col("content").isNotNull()).select("repo", "path", bad.alias("bad_bytes"), source.alias("source"))
    shape = to_arrow_schema(StructType.fromDDL(FACTS))

    return python.mapInArrow(lambda batches: fact_batches(batches, shape), FACTS)
