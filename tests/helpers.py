"""Small graphs by hand."""

from codeloom.plans import schema as S
from codeloom.plans.graph import CodeGraph


def graph(spark, nodes, edges, refs=()):
    """nodes: dicts with at least id; edges: (source, target, kind[, extra dict])."""
    from pyspark.sql import types as T

    def rows(ddl, dicts):
        kind = T.StructType.fromDDL(ddl)
        meta = {f.name: f.dataType for f in kind.fields}

        def full(d):
            out = []
            for f in kind.fields:
                v = d.get(f.name)
                if isinstance(meta[f.name], T.StructType):
                    v = None if v is None else tuple(_inner(meta[f.name], v))
                out.append(v)
            return tuple(out)

        return spark.createDataFrame([full(d) for d in dicts], kind)

    def _inner(struct, d):
        for f in struct.fields:
            v = d.get(f.name)
            yield tuple(_inner(f.dataType, v)) if isinstance(f.dataType, T.StructType) and v is not None else v

    full_nodes = [{"kind": "function", "name": n["id"].split("::")[-1], "qualified_name": n["id"], "file_path": "lib/" + n["id"].split("::")[0] + ".pm", "visibility": "public", "is_exported": False, **n} for n in nodes]
    full_edges = [{"edge_ord": k, "source": e[0], "target": e[1], "kind": e[2], "provenance": "static", **(e[3] if len(e) > 3 else {})} for k, e in enumerate(edges)]
    full_refs = [{"ref_ord": k, "reference_kind": "method_call", **r} for k, r in enumerate(refs)]
    return CodeGraph(rows(S.NODES, full_nodes), rows(S.EDGES, full_edges), rows(S.REFS, full_refs))


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())
