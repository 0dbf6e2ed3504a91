"""Graphs and tables as text: mermaid, dot, JSON, HTML, Markdown. What is rendered is collected, up to a stated limit."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import DataFrame

#: Edges that a rendering takes at most; a larger graph is refused, not cut.
EDGES = 20_000


def _rows(edges: DataFrame) -> list:
    rows = edges.select("from", "to", "kind", "provenance").orderBy("from", "to", "kind", "provenance").limit(EDGES + 1).collect()
    if len(rows) > EDGES:
        raise ValueError(f"over {EDGES} edges: narrow the graph, or write it as a table")
    return rows


def _ids(names: list[str]) -> dict[str, str]:
    """Safe and distinct ids for names, readable where they can be."""
    out, used = {}, set()
    for n in sorted(set(names)):
        base = re.sub(r"\W+", "_", n) or "n"
        base = "n" + base if base[0].isdigit() else base
        k, i = base, 1
        while k in used:
            i += 1
            k = f"{base}_{i}"
        used.add(k)
        out[n] = k
    return out


def mermaid(edges: DataFrame) -> str:
    rows = _rows(edges)
    ids = _ids([n for r in rows for n in (r["from"], r["to"])])
    quote = lambda n: n.replace('"', "#quot;")
    return "\n".join(["graph LR", *(f'  {i}["{quote(n)}"]' for n, i in ids.items()), *(f"  {ids[r['from']]} {'-->' if r.kind == 'calls' else f'-. {r.kind} .->'} {ids[r['to']]}" for r in rows)]) + "\n"


def dot(edges: DataFrame) -> str:
    q = lambda n: json.dumps(n, ensure_ascii=False)
    body = [f"  {q(r['from'])} -> {q(r['to'])} [label={q(r.kind)}];" for r in _rows(edges)]
    return "\n".join(["digraph code {", "  rankdir=LR;", *body, "}"]) + "\n"


def to_json(nodes: DataFrame, edges: DataFrame) -> str:
    named = nodes.select("id", "kind", "qualified_name", "file_path").orderBy("qualified_name", "id").limit(EDGES + 1).collect()
    if len(named) > EDGES:
        raise ValueError(f"over {EDGES} nodes: narrow the graph, or write it as a table")
    return json.dumps({"nodes": [r.asDict() for r in named], "edges": [{"from": r["from"], "to": r["to"], "kind": r.kind, "provenance": r.provenance} for r in _rows(edges)]}, indent=1, ensure_ascii=False)


def page(edges: DataFrame, title: str = "code graph") -> str:
    """A page without scripts of others: the edges as a table one can search in the browser."""
    rows = "".join(f"<tr><td>{html.escape(r['from'])}</td><td>{html.escape(r.kind)}</td><td>{html.escape(r['to'])}</td><td>{html.escape(r.provenance or '')}</td></tr>" for r in _rows(edges))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><thead><tr><th>from</th><th>kind</th><th>to</th><th>provenance</th></tr></thead><tbody>{rows}</tbody></table></body></html>"


def table(df: DataFrame, title: str, limit: int = 200) -> str:
    """Markdown of a result's first rows; says so if there are more."""
    rows = df.limit(limit + 1).collect()
    if not rows:
        return f"## {title}\n\nNothing found.\n"

    def cell(v) -> str:
        v = ", ".join(map(str, v)) if isinstance(v, (list, tuple)) and not hasattr(v, "asDict") else "" if v is None else str(v)
        return v.replace("|", "\\|").replace("\n", " ")

    names = df.columns
    body = [f"| {' | '.join(cell(r[n]) for n in names)} |" for r in rows[:limit]]
    more = ["", f"... more than {limit}"] if len(rows) > limit else []
    return "\n".join([f"## {title}", "", f"| {' | '.join(names)} |", f"|{'---|' * len(names)}", *body, *more]) + "\n"


def write(edges: DataFrame, path: str, form: str = "json") -> None:
    """Any number of edges, as files that executors write."""
    out = edges.select("from", "to", "kind", "provenance")
    (out.write.mode("overwrite").json(path) if form == "json" else out.write.mode("overwrite").option("header", True).csv(path))
