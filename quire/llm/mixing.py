"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions alone.

The tree is domain > language > source. A token budget runs down the tree: children share their parent's budget
by weight, a child never gets more than its subtree can supply (tokens times max_epochs), and what it can't take
goes to its siblings; only what the whole subtree can't take has already gone to the ancestor's siblings. A leaf
spends its budget on whole epochs, then on the token-prefix of one more epoch in a seeded order.

The prefix of a leaf is a threshold on the order's hash. It is found from token sums of 4096 ranges of the hash
and then inside a single range, so no task sorts a whole leaf, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.llm.common import spill

SEED = 42
LEAF = ("domain", "lang", "source")
# relative weights of the default recipe; what isn't listed has the weight "*"
WEIGHTS = {
    "domain": {"d0": 40, "d1": 30, "d2": 20, "d3": 10, "*": 5},
    "lang": {"en": 50, "de": 20, "fr": 20, "es": 10, "*": 5},
    "source": {"*": 1},
}
FRACTION = 0.5  # of all tokens
MAX_EPOCHS = 2
BROADCAST_LEAVES = 50_000  # about 100 bytes each; beyond it the plan is an ordinary join
SPACES = "\t\n\x0b\x0c\r "


def n_tokens(text: Column) -> Column:
    """Words between runs of white space (0x20, 0x09-0x0D); 0 for null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(bare, F.lit("")) == "", 0).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def domain_of(source: Column) -> Column:
    """The default recipe's domain: the source's trailing number modulo 4."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "[0-9]+$", 0).try_cast("int")
    return F.coalesce(F.concat(F.lit("d"), (number % 4).cast("string")), F.lit("other"))


def weight(level: str, weights: dict) -> Column:
    table = weights[level]
    found = F.lit(int(table.get("*", 0)))
    for k, v in table.items():
        if k != "*":
            found = F.when(F.col(level) == k, int(v)).otherwise(found)
    return found


def rows_of(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """docs with the tree's columns, tokens and order key added under names of their own."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("?"))
    return docs.select(
        "*",
        (domain if domain is not None else domain_of(F.col("source").cast("string"))).alias("__quire_domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("__quire_lang"),
        source.alias("__quire_source"),
        n_tokens(F.col("text").cast("string")).alias("__quire_tokens"),
    ).where("__quire_tokens > 0")


def order_key(epoch: Column, doc_id: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def fill(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """nodes(parent..., level, cap, w, total): total is the parent's budget; adds budget, by integer arithmetic, rounded down."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    turn = by.orderBy(F.col("cap").cast("double") / F.col("w"), level).rowsBetween(W.unboundedPreceding, -1)
    out = nodes.where("w > 0 AND cap > 0")
    out = out.withColumn("cap_before", F.coalesce(F.sum("cap").over(turn), F.lit(0)))
    out = out.withColumn("w_left", F.sum("w").over(by) - F.coalesce(F.sum("w").over(turn), F.lit(0)))
    out = out.withColumn("full", big("cap") * big("w_left") <= (big("total") - big("cap_before")) * big("w"))
    out = out.withColumn("cap_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0)))
    out = out.withColumn("w_open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(by), F.lit(0)))
    share = F.expr("CAST(CAST(total - cap_full AS DECIMAL(19,0)) * CAST(w AS DECIMAL(10,0)) DIV CAST(w_open AS DECIMAL(19,0)) AS LONG)")
    out = out.withColumn("budget", F.when(F.col("full"), F.col("cap")).when(F.col("w_open") > 0, share).otherwise(0))
    return out.drop("cap_before", "w_left", "full", "cap_full", "w_open")


def budgets(leaves: DataFrame, fraction: float, max_epochs: int, weights: dict) -> DataFrame:
    """leaves(domain, lang, source, supply) -> the same with budget (tokens), for the leaves that have weight and supply."""
    leaf = leaves.withColumn("cap", F.col("supply") * max_epochs).withColumn("w", weight("source", weights))
    leaf = leaf.where("w > 0 AND cap > 0").withColumnRenamed("w", "w_source")
    lang = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", weight("lang", weights)).where("w > 0")
    domain = lang.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", weight("domain", weights)).where("w > 0")
    wanted = leaves.agg(F.coalesce(F.floor(F.sum("supply") * F.lit(fraction)), F.lit(0)).alias("wanted"))
    top = domain.withColumn("can", F.sum("cap").over(W.partitionBy(F.lit(0)))).join(F.broadcast(wanted))  # one row
    top = fill(top.withColumn("total", F.least("wanted", "can").cast("long")), [], "domain").select("domain", F.col("budget").alias("total"))
    mid = fill(lang.join(top, "domain"), ["domain"], "lang").select("domain", "lang", F.col("budget").alias("total"))
    low = leaf.withColumnRenamed("w_source", "w").join(mid, ["domain", "lang"])
    return fill(low, ["domain", "lang"], "source").select(*LEAF, "supply", "budget")


def plan(rows: DataFrame, fraction: float, max_epochs: int, weights: dict, seed: int) -> DataFrame:
    """rows(doc_id, domain, lang, source, tokens) -> a row a leaf: epochs taken whole, and the threshold cut on the next epoch's key (key <= cut is in)."""
    leaves = rows.groupBy(*LEAF).agg(F.sum("tokens").alias("supply"))
    leaf = spill(
        budgets(leaves, fraction, max_epochs, weights).select(
            *LEAF, "budget", F.expr("budget DIV supply").alias("epochs"), F.expr("budget % supply").alias("rest")
        ),
        "leaves",
    )
    keyed = with_leaf(rows, leaf.where("rest > 0")).withColumn("key", order_key(F.col("epochs"), F.col("doc_id"), seed))
    keyed = keyed.withColumn("range", F.substring("key", 1, 3))
    sums = keyed.groupBy(*LEAF, "range").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = F.sum("tokens").over(W.partitionBy(*LEAF).orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = sums.withColumn("upto", upto).where("upto > rest AND upto - tokens <= rest")
    edge = edge.select(*LEAF, "range", (F.col("upto") - F.col("tokens")).alias("before"))
    # rows with equal keys, such as all without an id, are one row here
    inside = keyed.join(edge, [*LEAF, "range"]).groupBy(*LEAF, "range", "key").agg(F.sum("tokens").alias("tokens"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    run = F.sum("tokens").over(W.partitionBy(*LEAF, "range").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow))
    last = inside.withColumn("run", run + F.col("before")).where("run <= rest").groupBy(*LEAF).agg(F.max("key").alias("last"))
    cuts = edge.join(last, [*LEAF], "left").select(*LEAF, F.coalesce("last", "range").alias("cut"))
    return spill(leaf.join(cuts, [*LEAF], "left").select(*LEAF, "epochs", "rest", "cut"), "cuts")


def with_leaf(rows: DataFrame, leaf: DataFrame, on: tuple = LEAF) -> DataFrame:
    """rows with their leaf's columns; the leaves are broadcast only if they are few."""
    small = leaf.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(leaf) if small else leaf, list(on))


def mix(docs: DataFrame, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, weights: dict = WEIGHTS, seed: int = SEED, domain: Column | None = None) -> DataFrame:
    """docs' rows that the mixture takes, with the tree's columns, tokens and copies (how often) under names that start with __quire_.

    Tokens are words. Rows without a word, null texts among them, supply nothing and are never taken. A null lang or
    source is a branch of its own ("?"); rows that share a doc_id stand and fall together. An empty table gives an
    empty result. Only ids, branches and token counts are shuffled, never texts.
    """
    rows = rows_of(docs, domain)
    narrow = rows.select("doc_id", *(F.col(f"__quire_{c}").alias(c) for c in LEAF), F.col("__quire_tokens").alias("tokens"))
    cuts = plan(spill(narrow, "mix-rows"), fraction, max_epochs, weights, seed)
    marked = with_leaf(rows, cuts.toDF(*(f"__quire_{c}" for c in cuts.columns)), tuple(f"__quire_{c}" for c in LEAF))
    key = order_key(F.col("__quire_epochs"), F.col("doc_id"), seed)
    extra = F.when((F.col("__quire_rest") > 0) & (key <= F.col("__quire_cut")), 1).otherwise(0)
    return marked.withColumn("__quire_copies", F.col("__quire_epochs") + extra).where("__quire_copies > 0").drop("__quire_epochs", "__quire_rest", "__quire_cut")


def mix_sources(docs: DataFrame) -> DataFrame:
    taken = mix(docs.select("doc_id", "text", "lang", "source"))
    return taken.select("doc_id", *(F.col(f"__quire_{c}").alias(c) for c in LEAF), F.col("__quire_tokens").alias("n_tokens"), F.col("__quire_copies").alias("copies"))


def oracle(fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, weights: dict = WEIGHTS, seed: int = SEED) -> str:
    w = lambda level: "CASE " + level + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights[level].items() if k != "*") + f" ELSE {weights[level].get('*', 0)} END" if len(weights[level]) > 1 else str(weights[level]["*"])

    def fill_sql(name: str, parent: str, level: str) -> str:
        part = f"PARTITION BY {parent}" if parent else ""
        return f"""{name}_a AS (SELECT *, coalesce(sum(cap) OVER t, 0) AS cb, sum(w) OVER ({part}) - coalesce(sum(w) OVER t, 0) AS wl FROM {name}_n WHERE w > 0 AND cap > 0
  WINDOW t AS ({part} ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_b AS (SELECT *, CAST(cap AS HUGEINT) * wl <= (CAST(total AS HUGEINT) - cb) * w AS isfull FROM {name}_a),
{name} AS (SELECT *, CASE WHEN isfull THEN cap ELSE (total - coalesce(sum(cap) FILTER (isfull) OVER ({part}), 0)) * w // nullif(sum(w) FILTER (NOT isfull) OVER ({part}), 0) END AS budget FROM {name}_b)"""

    return f"""WITH r AS (SELECT doc_id, coalesce('d' || (TRY_CAST(regexp_extract(coalesce(source, ''), '[0-9]+$') AS INTEGER) % 4), 'other') AS domain,
  coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
rows_ AS (SELECT * FROM r WHERE tokens > 0),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS supply, CAST(sum(tokens) AS HUGEINT) * {max_epochs} AS cap, CAST({w('source')} AS HUGEINT) AS w FROM rows_ GROUP BY ALL),
lang_ AS (SELECT domain, lang, sum(cap) AS cap, CAST({w('lang')} AS HUGEINT) AS w FROM leaf WHERE w > 0 GROUP BY domain, lang),
dom_ AS (SELECT domain, sum(cap) AS cap, CAST({w('domain')} AS HUGEINT) AS w FROM lang_ WHERE w > 0 GROUP BY domain),
x_n AS (SELECT *, least((SELECT CAST(floor(CAST(sum(supply) AS DOUBLE) * {fraction}) AS HUGEINT) FROM leaf), (SELECT sum(cap) FROM dom_ WHERE w > 0)) AS total FROM dom_),
{fill_sql('x', '', 'domain')},
y_n AS (SELECT l.*, x.budget AS total FROM lang_ l JOIN x USING (domain)),
{fill_sql('y', 'domain', 'lang')},
z_n AS (SELECT l.*, y.budget AS total FROM leaf l JOIN y USING (domain, lang)),
{fill_sql('z', 'domain, lang', 'source')},
k AS (SELECT r.*, CAST(budget // supply AS BIGINT) AS epochs, budget % supply AS rest, md5('{seed}:' || CAST(budget // supply AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM rows_ r JOIN z USING (domain, lang, source)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM k)
SELECT doc_id, domain, lang, source, tokens AS n_tokens, epochs + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END AS copies FROM c
WHERE epochs + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END > 0"""
