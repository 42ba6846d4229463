"""Findings in Python source, for use inside Spark tasks."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from urllib.parse import urlsplit

# --- fixed values: calls that load untrusted data ---
LOADERS = {("pickle", "load"), ("pickle", "loads"), ("marshal", "load")}
SAFE_YAML_LOADERS = ("SafeLoader", "CSafeLoader")
NETWORK_MODULES = ("requests", "urllib", "httpx", "socket")


def _calls(text: str) -> Iterator[ast.Call]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            yield node


def _literal_first_argument(call: ast.Call) -> str | None:
    if call.args and isinstance(call.args[0], ast.Constant) and isinstance(call.args[0].value, str):
        return call.args[0].value
    return None


def _keyword(call: ast.Call, name: str) -> list[ast.expr]:
    return [k.value for k in call.keywords if k.arg == name]


def unsafe_calls(text: str) -> list[tuple[str, str, str, int, str]]:
    """(severity, label, title start, line, evidence) per unsafe call, in tree order."""
    found = []
    for call in _calls(text):
        func = call.func
        if isinstance(func, ast.Name) and func.id in ("eval", "exec"):
            if _literal_first_argument(call) is None:
                found.append(("CRITICAL", f"Dynamic {func.id}", f"{func.id}() on dynamic input", call.lineno,
                              f"{func.id}(...) at line {call.lineno}"))
        if not (isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name)):
            continue
        module, attribute = func.value.id, func.attr
        if module == "subprocess" and _literal_first_argument(call) is None:
            if any(isinstance(v, ast.Constant) and v.value is True for v in _keyword(call, "shell")):
                found.append(("HIGH", "Shell command injection", "shell=True with dynamic command", call.lineno,
                              f"subprocess.{attribute}(..., shell=True)"))
        elif (module, attribute) in LOADERS:
            name = f"{module}.{attribute}"
            found.append(("HIGH", "Insecure deserialization", name, call.lineno, f"{name}(...)"))
        elif (module, attribute) == ("yaml", "load"):
            loaders = [v.attr for v in _keyword(call, "Loader") if isinstance(v, ast.Attribute)]
            if not any(name in SAFE_YAML_LOADERS for name in loaders):
                found.append(("HIGH", "Insecure deserialization", "yaml.load without SafeLoader", call.lineno,
                              "yaml.load(...)"))
    return found


def _root_name(node: ast.expr) -> str | None:
    while isinstance(node, ast.Attribute):
        node = node.value
    return node.id if isinstance(node, ast.Name) else None


def outbound_hosts(text: str) -> list[tuple[str, int]]:
    """(host, line) per call of a network module whose target is a literal URL or address."""
    found = []
    for call in _calls(text):
        if not isinstance(call.func, ast.Attribute) or _root_name(call.func) not in NETWORK_MODULES:
            continue
        for argument in [*call.args, *[k.value for k in call.keywords]]:
            if isinstance(argument, ast.Tuple) and argument.elts:
                argument = argument.elts[0]
                is_address = True
            else:
                is_address = False
            if not (isinstance(argument, ast.Constant) and isinstance(argument.value, str)):
                continue
            try:
                host = argument.value if is_address else urlsplit(argument.value).hostname
            except ValueError:  # not a URL
                continue
            if host:
                found.append((host.lower(), call.lineno))
                break
    return found
