"""Symbols of source files: a small scanner that runs beside Spark's partitioned file rows.

Comments and strings are blanked, declarations are matched line by line, and a symbol ends
where its braces close or, in Python, where the indentation returns.
"""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.scalars import breadcrumb
from tarn.schemas import METADATA

_QUIET = {
    "python": r'("""|\'\'\')[\s\S]*?\1|#[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "": r'/\*[\s\S]*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`',
}
_EXPORT = r"^[ \t]*(?P<export>export\s+)?(?:default\s+)?(?:declare\s+)?"
_SCRIPT = [
    ("function", _EXPORT + r"(?P<async>async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^(]*>)?\((?P<params>[^{]*?)\)\s*(?::\s*(?P<returns>[^{;]+?))?\s*\{"),
    ("class", _EXPORT + r"(?:abstract\s+)?class\s+(?P<name>[\w$]+)(?P<heritage>[^{]*)\{"),
    ("interface", _EXPORT + r"interface\s+(?P<name>[\w$]+)(?P<heritage>[^{]*)\{"),
    ("type", _EXPORT + r"type\s+(?P<name>[\w$]+)[^=\n]*="),
    ("function", _EXPORT + r"(?:const|let|var)\s+(?P<name>[\w$]+)[^=\n]*=\s*(?P<async>async\s+)?(?P<arrow>\([^)]*\)[^=;{]*=>|[\w$]+\s*=>|function\b)"),
]
_SCRIPT_METHOD = r"^[ \t]*(?:(?:public|private|protected|static|override|get|set)\s+)*(?P<async>async\s+)?\*?[ \t]*(?P<name>[A-Za-z$][\w$]*)\s*(?:<[^(]*>)?\((?P<params>[^{};]*?)\)\s*(?::\s*(?P<returns>[^{;]+?))?\s*\{"
_JAVA = [
    ("class", r"^[ \t]*public\s+(?:(?:abstract|final|static)\s+)*class\s+(?P<name>\w+)(?P<heritage>[^{]*)\{"),
    ("interface", r"^[ \t]*public\s+(?:(?:abstract|static)\s+)*interface\s+(?P<name>\w+)(?P<heritage>[^{]*)\{"),
    ("type", r"^[ \t]*public\s+(?:static\s+)?enum\s+(?P<name>\w+)[^{]*\{"),
]
_JAVA_METHOD = r"^[ \t]*public\s+(?P<static>static\s+)?(?:(?:final|abstract|synchronized)\s+)*(?:<[^>]*>\s*)?(?P<returns>[\w.<>\[\], ?]+?)\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)[^{;]*[{;]"
_PYTHON = re.compile(
    r"^(?P<indent>[ \t]*)(?P<async>async\s+)?(?P<kind>def|class)\s+(?P<name>\w+)\s*(?:\((?P<params>[^:]*?(?::[^:()]*?)*?)\))?\s*(?:->\s*(?P<returns>[^:\n]+))?:",
    re.M,
)
_NOT_METHODS = frozenset("if for while switch catch return function new super throw with else do try".split())


def _blanked(language: str, text: str) -> str:
    pattern = _QUIET["python" if language == "python" else ""]
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _close(text: str, brace: int) -> int:
    depth = 0
    for m in re.finditer(r"[{}]", text[brace:]):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return brace + m.end()
    return len(text)


def _docstring(text: str, at: int) -> str | None:
    """The comment right above: a block back to its start, or one line."""
    above = text[:at].rstrip()
    if above.endswith("*/") and "/*" in above:
        block = above[above.rindex("/*") + 2 : -2]
        return "\n".join(x for x in (line.strip().lstrip("*").strip() for line in block.split("\n")) if x) or None
    line = above.rsplit("\n", 1)[-1].strip()
    return line[2:].strip() or None if line.startswith("//") else None


def _names(text: str | None) -> list[str]:
    depth, out, word = 0, [], ""
    for c in (text or "") + ",":
        depth += c in "<([{" and 1 or c in ">)]}" and -1 or 0
        if c == "," and depth <= 0:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return [w for w in out if w]


def _parameters(language: str, text: str | None) -> list[str]:
    if language == "java":
        return [re.split(r"\s+", p.strip())[-1] for p in _names(text)]
    found = [re.split(r"[:=?]", p)[0].strip() for p in _names(text)]
    return [p for p in found if p not in ("self", "cls")] if language == "python" else found


def _heritage(text: str | None, script: bool) -> tuple[list[str], list[str]]:
    text = text or ""
    parts = re.split(r"\b(extends|implements)\b", text)
    found = dict(zip(parts[1::2], parts[2::2]))
    strip = lambda x: re.sub(r"<.*", "", x, flags=re.S).strip()
    return [strip(x) for x in _names(found.get("extends"))], [strip(x) for x in _names(found.get("implements"))]


def _row(kind, name, text, start, end, **metadata) -> dict:
    return {
        "name": name, "chunk_type": kind, "start_line": text.count("\n", 0, start) + 1,
        "end_line": text.count("\n", 0, max(start, end - 1)) + 1, "content": text[start:end].strip("\n"),
        "metadata": {f.name: metadata.get(f.name) for f in METADATA.fields},
    }


def _summary(head: str, fields: list[str], methods: list[dict], close: str) -> str:
    """What stands for a class: its declaration, fields and method signatures, never the bodies."""
    lines = [f"  {f}" for f in fields] + [f"  // {m['metadata']['signature']}" for m in methods]
    return "\n".join([head.strip(), *lines, *([close] if close else [])])


def _signature(*parts: str | None) -> str:
    return re.sub(r"\s+", " ", "".join(p for p in parts if p)).strip()


def _braced(language: str, text: str) -> list[dict]:
    quiet, java = _blanked(language, text), language == "java"
    out = []
    for kind, pattern in _JAVA if java else _SCRIPT:
        for m in re.finditer(pattern, quiet, re.M):
            if quiet.count("{", 0, m.start()) != quiet.count("}", 0, m.start()):
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            g = {k: text[m.start(k) : m.end(k)] if v is not None else None for k, v in m.groupdict().items()}
            open_ = quiet.find("{", m.end() - 1)
            if kind == "type" and not java or g.get("arrow"):
                stop = re.compile(r";|\n(?=\s*\n|\s*(?:export|const|let|var|type|class|interface|function|import)\b)|\Z").search(quiet, m.end())
                line_end = quiet.find("\n", m.end())
                if 0 <= open_ < (line_end if line_end >= 0 else len(quiet)):
                    stop = None
                end = _close(quiet, open_) if stop is None else stop.end() if stop[0] == ";" else stop.start()
            else:
                end = _close(quiet, open_)
            exported = java or bool(g.get("export"))
            doc = _docstring(text, m.start())
            if kind != "class":
                sig = None
                if kind == "function" and not g.get("arrow"):
                    returns = g.get("returns")
                    sig = _signature(g["name"], f"({g['params']})", f": {returns}" if returns else None)
                heritage = _heritage(g.get("heritage"), not java)
                row = _row(
                    kind, g["name"], text, start, end, signature=sig, docstring=doc, isExported=exported,
                    isAsync=bool(g.get("async")), returnType=g.get("returns"), extendsNames=heritage[0] or None,
                    parameters=_parameters(language, g["params"]) if g.get("params") is not None else None,
                )
                out.append(row)
                continue
            methods = _methods(language, text, quiet, open_, end, g["name"])
            body = quiet[open_ + 1 : end - 1]
            flat = re.sub(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", body)
            fields = [x.strip() for x in flat.split("\n") if re.match(r"\s*(?:[\w@]+\s+)*[\w$#]+\s*[?!]?\s*(?:[:=;]|$)", x) and "(" not in x.split("=")[0] and x.strip()]
            extends, implements = _heritage(g.get("heritage"), not java)
            row = _row("class", g["name"], text, start, end, docstring=doc, isExported=exported, extendsNames=extends or None, implementsNames=implements or None)
            row["content"] = _summary(text[start : open_ + 1], fields, methods, "}")
            out += [row, *methods]
    return out


def _methods(language: str, text: str, quiet: str, open_: int, end: int, owner: str) -> list[dict]:
    out, java = [], language == "java"
    for m in re.compile(_JAVA_METHOD if java else _SCRIPT_METHOD, re.M).finditer(quiet, open_ + 1, end):
        if quiet.count("{", open_, m.start()) - quiet.count("}", open_, m.start()) != 1 or m["name"] in _NOT_METHODS:
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        stop = _close(quiet, m.end() - 1) if m[0].endswith("{") else m.end()
        params = text[m.start("params") : m.end("params")]
        returns = (m["returns"] or "").strip() or None
        if java:
            sig = _signature("public ", m["static"], f"{returns} ", m["name"], f"({params})")
        else:
            sig = _signature(f"{owner}.{m['name']}", f"({params})", f": {returns}" if returns else None)
        out.append(
            _row(
                "method", f"{owner}.{m['name']}", text, start, stop, signature=sig, parentName=owner, returnType=returns,
                docstring=_docstring(text, m.start()), isAsync=bool(m.groupdict().get("async")), isExported=java or None,
                parameters=_parameters(language, params),
            )
        )
    return out


def _python(text: str) -> list[dict]:
    quiet = _blanked("python", text)
    out, blocked, owner, owner_end = [], 0, None, 0
    for m in _PYTHON.finditer(quiet):
        indent, name = len(m["indent"].expandtabs(4)), m["name"]
        if m.start() >= owner_end:
            owner = None
        rest = re.compile(rf"^(?![ \t]{{{indent + 1},}}|\s*$)", re.M).search(quiet, m.end() + 1)
        end = rest.start() if rest else len(text)
        end = m.start() + len(text[m.start() : end].rstrip())
        if m.start() < blocked:
            continue
        if m["kind"] == "class" and owner is not None:
            blocked = end
            continue
        body = text[m.end() : end].lstrip()
        doc = re.match(r'[rRuUbB]*("""|\'\'\')([\s\S]*?)\1', body)
        g = {k: text[m.start(k) : m.end(k)] if v is not None else None for k, v in m.groupdict().items()}
        start = m.end("indent")
        head = text[: m.start()].rstrip("\n").rsplit("\n", 1)[-1]
        if re.match(r"\s*@", head):
            start = m.start() - len(head) - 1
        shared = {"docstring": textwrap.dedent(doc[2]).strip() if doc else None, "isExported": True}
        if m["kind"] == "class":
            row = _row("class", name, text, start, end, extendsNames=[x.strip() for x in (g["params"] or "").split(",") if x.strip()] or None, **shared)
            row["content"] = row["content"].split("\n")[0]
            out.append(row)
            owner, owner_end, class_row = name, end, row
            continue
        sig = _signature(name, f"({g['params'] or ''})", f" -> {g['returns']}" if g["returns"] else None)
        blocked = end
        if name.startswith("__") and name.endswith("__") or owner is not None and name.startswith("_"):
            continue
        more = {"signature": sig, "isAsync": bool(g["async"]), "returnType": g["returns"], "parameters": _parameters("python", g["params"])}
        if owner is None:
            out.append(_row("function", name, text, start, end, **shared, **more))
        else:
            out.append(_row("method", f"{owner}.{name}", text, start, end, parentName=owner, **shared, **more))
            class_row["content"] += f"\n  # {sig}"
    return out


_IMPORTS = {
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;",
    "": r"""(?:^|\n)\s*import\s+(?:[^'"\n]*\s+from\s+)?['"]([^'"]+)['"]|^(?:const|let|var)\s+[^=\n]+=\s*require\(\s*['"]([^'"]+)['"]""",
}


def parse(language: str, text: str) -> tuple[list[dict], list[str]]:
    """Symbols and imported modules of one file."""
    pattern = _IMPORTS[language if language in _IMPORTS else ""]
    imports = [next(filter(None, m.groups())) for m in re.finditer(pattern, text, re.M)]
    found = _python(text) if language == "python" else _braced(language, text)
    found.sort(key=lambda r: (r["start_line"], r["chunk_type"] == "method"))
    return found, list(dict.fromkeys(imports))


PARSED = f"""source_path string, language string, name string, chunk_type string, start_line int, end_line int,
content string, metadata {METADATA.simpleString()}, imports array<string>, error string"""


def parsed(files: DataFrame) -> DataFrame:
    """One row a symbol from (source_path, language, text), and one of null name for each file.

    A file that can't be read gives its error there and no symbols; others go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, text in zip(batch["source_path"], batch["language"], batch["text"]):
                base = {"source_path": path, "language": language}
                try:
                    found, imports = parse(language, text)
                    rows += [base | r for r in found]
                    rows.append(base | {"imports": imports})
                except (ValueError, IndexError, RecursionError) as broken:
                    rows.append(base | {"error": f"{type(broken).__name__}: {broken}"})
            names = ["source_path", "language", "name", "chunk_type", "start_line", "end_line", "content", "metadata", "imports", "error"]
            out = pd.DataFrame(rows, columns=names)
            for c in ("start_line", "end_line"):
                out[c] = out[c].astype("Int32")
            for c in ("name", "chunk_type", "content", "metadata", "imports", "error"):
                out[c] = out[c].astype(object).where(out[c].notna(), None)
            yield out

    return files.select("source_path", "language", "text").mapInPandas(run, PARSED)


def chunk_rows(symbols: DataFrame) -> DataFrame:
    """Chunks with content-addressed ids and breadcrumbs from parsed symbols."""
    m = F.col("metadata")
    key = F.concat_ws("\0", "source_path", "chunk_type", "name", F.col("start_line").cast("string"))
    return symbols.where(F.col("name").isNotNull()).select(
        F.sha2(key, 256).alias("chunk_id"),
        F.sha2("source_path", 256).alias("document_id"),
        "content",
        "chunk_type",
        "language",
        "name",
        "start_line",
        "end_line",
        "metadata",
        breadcrumb(F.col("source_path"), F.col("chunk_type"), F.col("name"), m["parentName"], m["signature"]).alias(
            "breadcrumb"
        ),
        F.current_timestamp().alias("created_at"),
    )
