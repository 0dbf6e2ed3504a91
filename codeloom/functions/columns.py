"""Column expressions over names and nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import vocabulary as V


def node_id(kind: Column, qualified_name: Column, name: Column, file_path: Column) -> Column:
    """A node's identity: SHA-1 of kind, qualified name (else name) and file. Lines are no part of it, so edits keep it."""
    zero = F.lit("\0")
    text = F.concat(F.coalesce(kind, F.lit("")), zero, F.coalesce(qualified_name, name, F.lit("")), zero, F.coalesce(file_path, F.lit("")))
    return F.sha1(text.cast("binary"))


def package_of(name: Column) -> Column:
    """A qualified name without its last part; 'main' where it has but one."""
    return F.when(F.instr(name, "::") == 0, "main").otherwise(F.regexp_replace(name, "::[^:]+$", ""))


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)


def shown_name(prefix: str = "") -> Column:
    """What a node is called: its qualified name, else its name, else ''."""
    return F.coalesce(F.col(f"{prefix}qualified_name"), F.col(f"{prefix}name"), F.lit(""))


def is_public(prefix: str = "") -> Column:
    """Exported, or not private; a null visibility is public."""
    return F.coalesce(F.col(f"{prefix}is_exported"), F.lit(False)) | (F.coalesce(F.col(f"{prefix}visibility"), F.lit("")) != "private")


def is_builtin(name: Column) -> Column:
    return name.isin(sorted(V.BUILTINS))


def is_universal(name: Column) -> Column:
    return name.isin(sorted(V.UNIVERSAL))


def is_external(name: Column) -> Column:
    starts = reduce(lambda a, b: a | b, (name.startswith(p + "::") for p in V.EXTERNAL_PREFIXES))
    return name.isin(sorted(V.EXTERNAL)) | starts


def sink_type(name: Column, is_method: Column) -> Column:
    return F.when(~is_method & name.isin(sorted(V.SINK_COMMANDS)), "command").when(is_method & name.isin(sorted(V.SINK_SQL)), "sql")


def provenance_rank(provenance: Column) -> Column:
    out = F.lit(0)
    for k, v in V.PROVENANCE_RANK.items():
        out = F.when(provenance == k, v).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Search tokens: lower case without diacritics, split at all that is neither letter nor digit."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{M}+", "")
    folded = F.translate(plain, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def has_phrase(text: Column, phrase: str | Column) -> Column:
    """Whether the phrase's tokens stand in text one after another. An empty phrase matches nothing."""
    joined = lambda c: F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    asked = joined(F.lit(phrase) if isinstance(phrase, str) else phrase)
    return F.contains(joined(text), asked) & (F.length(asked) > 2)


def top_level_parts(text: Column) -> Column:
    """Parts of a list at its commas outside of brackets, as an array. An unbalanced text is split as far as its depth goes."""
    step = F.aggregate(
        F.split(F.coalesce(text, F.lit("")), ""),
        F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts")),
        lambda a, c: F.struct(
            (a["depth"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)).alias("depth"),
            F.when((c == ",") & (a["depth"] == 0), F.lit("")).otherwise(F.concat(a["part"], c)).alias("part"),
            F.when((c == ",") & (a["depth"] == 0), F.concat(a["parts"], F.array(a["part"]))).otherwise(a["parts"]).alias("parts"),
        ),
        lambda a: F.when(F.length(a["part"]) > 0, F.concat(a["parts"], F.array(a["part"]))).otherwise(a["parts"]),
    )
    return step


def signature_body(signature: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(signature, F.lit("")), r"^\s*\(\s*", ""), r"\s*\)\s*$", "")


def signature_params(signature: Column) -> Column:
    """Names of a signature's parameters, defaults dropped; what isn't a plain variable is passed over."""
    parts = F.transform(top_level_parts(signature_body(signature)), lambda p: F.trim(F.regexp_replace(p, r"(?s)\s*=.*$", "")))
    return F.filter(parts, lambda p: p.rlike(r"^[$@%]\w+$"))


def signature_arity(signature: Column) -> Column:
    """struct(low, high): how many arguments fit; high is null behind a slurpy parameter, and low counts those before it."""
    parts = F.filter(F.transform(top_level_parts(signature_body(signature)), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    slurpy = F.transform(parts, lambda p: p.rlike(r"^[@%]"))
    first = F.array_position(slurpy, True)
    fixed = F.when(first > 0, F.slice(parts, F.lit(1), (first - 1).cast("int"))).otherwise(parts)
    low = F.size(F.filter(fixed, lambda p: ~F.contains(p, F.lit("="))))
    return F.struct(low.alias("low"), F.when(first == 0, F.size(fixed)).alias("high"))
