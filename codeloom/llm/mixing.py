"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A token budget goes down from the root: each node's budget is shared among its children
by weight, and what a child cannot fill (its subtree's tokens times the epochs allowed) is shared again among its siblings
before anything reaches the siblings of its ancestors, since a child's limit counts all that lies below it. A leaf's budget is
filled with whole epochs of its documents and then with a token-prefix of one further epoch; each epoch has an order of its
own, by a seeded digest.

The prefix is found by radix selection on the digest: sums of 256 groups a leaf, then only the group in which the budget
ends, three times over. So no leaf, however large, is sorted or summed in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mixture:
    """Weights are whole numbers of 1 or more; what has none weighs 1. per_mille of all tokens is the budget."""

    seed: str = "mix-1"
    per_mille: int = 600
    max_epochs: int = 2
    domains: int = 4
    domain_weights: dict[str, int] = field(default_factory=lambda: {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1})
    lang_weights: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 3, "fr": 3, "es": 2})
    source_weights: dict[str, int] = field(default_factory=dict)


PRODUCTION = Mixture()
#: In the pipeline no document is taken twice.
PIPELINE = Mixture(per_mille=900, max_epochs=1)


def _weight(name: Column, weights: dict[str, int]) -> Column:
    found = F.lit(1)
    for k, v in sorted(weights.items()):
        found = F.when(name == k, F.lit(v)).otherwise(found)
    return found.cast("long")


def _shared(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children: parent columns, name, budget (the parent's), w, c; adds share, what each child gets."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    order = Window.partitionBy(*parent).orderBy(F.col("c") / F.col("w"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    some = children.withColumn("c_before", F.coalesce(F.sum("c").over(before), F.lit(0)).cast("long")).withColumn("w_after", F.sum("w").over(after))
    some = some.withColumn("full", wide("c") * wide("w_after") <= (wide("budget") - wide("c_before")) * wide("w"))
    some = some.withColumn("c_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(whole), F.lit(0))).withColumn("w_open", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole))
    part = F.when(F.col("full"), F.col("c")).otherwise(F.expr("cast((cast(budget as decimal(38,0)) - c_full) * w div w_open as bigint)"))
    some = some.withColumn("part", part)
    given = F.least("budget", F.sum("c").over(whole))
    some = some.withColumn("over", given - F.sum("part").over(whole))
    nth = F.row_number().over(Window.partitionBy(*parent, "full").orderBy(name))
    return some.withColumn("share", F.col("part") + F.when(~F.col("full") & (nth <= F.col("over")), F.lit(1)).otherwise(F.lit(0)))


def leaf_budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """leaves (domain, lang, source, tokens) with tokens > 0; adds share: the leaf's budget in tokens."""
    caps = leaves.withColumn("c", F.col("tokens") * mixture.max_epochs)
    total = leaves.agg(F.expr(f"cast(floor(cast(sum(tokens) as decimal(38,0)) * {int(mixture.per_mille)} / 1000) as bigint)").alias("budget"))
    weights = dict(zip(LEVELS, (mixture.domain_weights, mixture.lang_weights, mixture.source_weights)))
    above = total.withColumn("root", F.lit(1))
    caps = caps.withColumn("root", F.lit(1))
    for k, level in enumerate(LEVELS):
        parent = ["root", *LEVELS[:k]]
        nodes = caps.groupBy(*parent, level).agg(F.sum("c").alias("c")).withColumn("w", _weight(F.col(level), weights[level]))
        shared = _shared(nodes.join(above, parent), parent, level)
        above = shared.select(*parent, level, F.col("share").alias("budget"))
    return leaves.join(above.select(*LEVELS, F.col("budget").alias("share")), list(LEVELS))


def units(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens of the rows that have tokens. Tokens are words; null lang and source are ''."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit("domain"), F.crc32(source.cast("binary")) % mixture.domains).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
    ).where("n_tokens > 0")


def mix(docs: DataFrame, mixture: Mixture = PRODUCTION, scratch: Scratch | None = None) -> DataFrame:
    """What is taken: doc_id, domain, lang, source, epoch (from 0), n_tokens, taken (tokens, n_tokens but for a prefix's last row).

    A row for each row of docs and epoch in which something of it is taken. Rows without words are never taken. Repeated rows
    count each. Rows of one doc_id follow by their tokens; a null doc_id orders as ''.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    unit = scratch.save(units(docs, mixture), "units")
    leaf = list(LEVELS)
    share = leaf_budgets(unit.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), mixture)
    share = share.select(*leaf, F.expr("share div tokens").cast("int").alias("epochs"), F.expr("share % tokens").alias("rest"))
    share = scratch.save(share, "shares")
    known = unit.join(share, leaf)
    whole = known.where("epochs > 0").select("doc_id", *leaf, F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"), "n_tokens", F.col("n_tokens").alias("taken"))
    key = F.md5(F.concat_ws(":", F.lit(mixture.seed), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    open_ = scratch.save(known.where("rest > 0").select("doc_id", *leaf, F.col("epochs").alias("epoch"), "n_tokens", "rest", key.alias("key")), "open-0")
    out, last = [whole], ["doc_id", *leaf, "epoch", "n_tokens", "taken"]
    for k in range(3):
        digit = F.substring("key", 2 * k + 1, 2)
        sums = open_.withColumn("digit", digit).groupBy(*leaf, "digit").agg(F.sum("n_tokens").alias("s"), F.min("rest").alias("r"))
        order = Window.partitionBy(*leaf).orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("done", F.coalesce(F.sum("s").over(order), F.lit(0))).where("done < r").select(*leaf, "digit", "s", "done")
        met = scratch.save(open_.withColumn("digit", digit).join(sums, [*leaf, "digit"]), f"met-{k}")
        out.append(met.where("done + s <= rest").withColumn("taken", F.col("n_tokens")).select(*last))
        open_ = met.where("done + s > rest").withColumn("rest", F.col("rest") - F.col("done")).drop("digit", "s", "done")
    order = Window.partitionBy(*leaf).orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    tail = open_.withColumn("done", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).where("done < rest")
    out.append(tail.withColumn("taken", F.least(F.col("n_tokens"), F.col("rest") - F.col("done"))).select(*last))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def select_mixture(docs: DataFrame, mixture: Mixture = PIPELINE) -> DataFrame:
    """The rows of docs of which something is taken, whole, with the columns of docs. With max_epochs 1 none comes twice."""
    from codeloom.llm.rows import without

    scratch = Scratch(docs.sparkSession, "mix")
    took = mix(docs, mixture, scratch).groupBy("doc_id", F.col("n_tokens").cast("string").alias("text_key")).agg(F.countDistinct("epoch").alias("e"), F.count("*").alias("n"))
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("string")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("text_key")).groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"))
    met = every.withColumnsRenamed({"doc_id": "i", "text_key": "t"}).join(took, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("text_key")), "left")
    decided = met.select(F.col("i").alias("doc_id"), F.col("t").alias("text_key"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("k"), (F.ceil(F.col("n") / F.col("e"))).alias("stay"))
    decided = decided.select("doc_id", "text_key", F.coalesce(F.col("k") <= F.col("stay"), F.lit(False)).alias("kept"))
    return without(docs, scratch.save(decided, "decided"), scratch, words)


def oracle_sql(mixture: Mixture = PRODUCTION) -> str:
    """The same in DuckDB's SQL, with plain windows over whole leaves."""
    def weight(col: str, weights: dict[str, int]) -> str:
        return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in sorted(weights.items())) + " ELSE 1 END" if weights else "1"

    def fill(name: str, level: str, parent: str, above: str, weights: dict[str, int]) -> str:
        keys = f"{parent}, {level}" if parent else level
        by = f"PARTITION BY {parent}" if parent else ""
        on = f"JOIN {above} USING ({parent})" if parent else f"CROSS JOIN {above}"
        two = f"PARTITION BY {parent + ', ' if parent else ''}f"
        return f"""
{name}0 AS (SELECT {keys}, sum(c)::HUGEINT AS c, any_value({weight(level, weights)})::HUGEINT AS w FROM leaves GROUP BY {keys}),
{name}1 AS (SELECT *, coalesce(sum(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS cb,
  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wa FROM {name}0 {on} WINDOW o AS ({by} ORDER BY c::DOUBLE / w::DOUBLE, {level})),
{name}2 AS (SELECT *, c * wa <= (budget - cb) * w AS f FROM {name}1),
{name}3 AS (SELECT *, coalesce(sum(CASE WHEN f THEN c END) OVER ({by}), 0)::HUGEINT AS cf, (sum(CASE WHEN NOT f THEN w END) OVER ({by}))::HUGEINT AS wo FROM {name}2),
{name}4 AS (SELECT *, CASE WHEN f THEN c ELSE ((budget - cf) * w) // wo END AS part FROM {name}3),
{name}5 AS (SELECT *, least(budget, sum(c) OVER ({by})) - sum(part) OVER ({by}) AS over_, row_number() OVER ({two} ORDER BY {level}) AS nth FROM {name}4),
{name} AS (SELECT {keys}, (part + CASE WHEN NOT f AND nth <= over_ THEN 1 ELSE 0 END)::HUGEINT AS budget FROM {name}5),"""

    # crc32 bit by bit, as DuckDB has none: the sources are few.
    crc = """
srcs AS (SELECT DISTINCT coalesce(source, '') AS source FROM documents),
crc(source, pos, c) AS (SELECT source, 0, 4294967295::BIGINT FROM srcs UNION ALL
  SELECT source, pos + 1, list_reduce([xor(c, ('0x' || substr(hex(encode(source)), pos * 2 + 1, 2))::BIGINT), 0, 1, 2, 3, 4, 5, 6, 7],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) FROM crc WHERE pos * 2 < length(hex(encode(source)))),
doms AS (SELECT source, 'domain' || (xor(arg_max(c, pos), 4294967295::BIGINT) % %d) AS domain FROM crc GROUP BY source),""".replace("%d)", f"{mixture.domains})")
    return f"""
WITH RECURSIVE {crc.strip()}
units AS (SELECT doc_id, domain, coalesce(lang, '') AS lang, source, n_tokens FROM (
  SELECT doc_id, lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents) JOIN doms USING (source) WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {mixture.max_epochs} AS c FROM units GROUP BY ALL),
root AS (SELECT (sum(tokens) * {mixture.per_mille} // 1000)::HUGEINT AS budget FROM leaves),{fill("dd", "domain", "", "root", mixture.domain_weights)}{fill("ll", "lang", "domain", "dd", mixture.lang_weights)}{fill("ss", "source", "domain, lang", "ll", mixture.source_weights)}
shares AS (SELECT domain, lang, source, (budget // tokens)::BIGINT AS epochs, (budget % tokens)::BIGINT AS rest FROM ss JOIN leaves USING (domain, lang, source)),
known AS (SELECT * FROM units JOIN shares USING (domain, lang, source)),
prefix AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{mixture.seed}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, n_tokens
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM known WHERE rest > 0)
SELECT doc_id, domain, lang, source, e::INTEGER AS epoch, n_tokens::BIGINT AS n_tokens, n_tokens::BIGINT AS taken FROM known, unnest(range(epochs)) AS t(e)
UNION ALL
SELECT doc_id, domain, lang, source, epochs::INTEGER, n_tokens::BIGINT, least(n_tokens, rest - done)::BIGINT FROM prefix WHERE done < rest
"""
