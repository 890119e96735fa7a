"""Token budgets down a domain-language-source tree, and each leaf's seeded token-prefix. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written, unused

#: Target weights of children against their siblings; children that aren't named weigh 1.
DOMAINS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}
LANGS = {"en": 5.0, "fr": 2.0, "de": 2.0, "es": 1.0}
#: Budget as a share of all tokens, epochs that a leaf gives at most, and the seed of their orders.
SHARE, EPOCHS, SEED = 0.6, 2, "mix-1"
#: Leaves up to which their table is broadcast; beyond, Spark joins it by shuffle.
SMALL = 20_000
WORD = "[^ \\t\\n\\f\\r]+"


def domain_of(source: Column) -> Column:
    """d0 to d3 by the number that ends the source's name; d- if there is none."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.when(number == "", "-").otherwise((number.cast("long") % 4).cast("string")))


def _weight(name: str, given: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for key, weight in given.items():
        if weight <= 0:
            raise ValueError(f"the weight of {key} isn't positive")
        out = F.when(F.col(name) == key, float(weight)).otherwise(out)
    return out


def _divide(nodes: DataFrame, group: list[str], name: str) -> DataFrame:
    """Adds `given`: the group's budget dealt to its children in proportion to weight, none above its cap; what a
    full child leaves goes to its siblings. Children fill in the order of cap against weight, so the level that
    the others reach is the largest of (budget - caps of the fuller) / (weights from here on)."""
    by = Window.partitionBy(*group).orderBy(F.col("cap") / F.col("weight"), name)
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = nodes.withColumn("level", (F.col("budget") - before) / after)
    level = level.withColumn("level", F.max("level").over(Window.partitionBy(*group)))
    return level.withColumn("given", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).drop("level")


def leaf_budgets(leaves: DataFrame, budget: float, domains: dict[str, float], langs: dict[str, float], sources: dict[str, float]) -> DataFrame:
    """domain, lang, source, cap to the same with `quota`, whole tokens.

    A node can take what its leaves can, so a level's division settles shortages among siblings first; only
    what a whole family can't take has gone to the families beside it, a level above.
    """
    d = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumns({"weight": _weight("domain", domains), "budget": F.lit(float(budget)), "root": F.lit(0)})
    d = _divide(d, ["root"], "domain").select("domain", F.col("given").alias("budget"))
    g = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(d, "domain").withColumn("weight", _weight("lang", langs))
    g = _divide(g, ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    s = leaves.join(g, ["domain", "lang"]).withColumn("weight", _weight("source", sources))
    s = _divide(s, ["domain", "lang"], "source")
    return s.withColumn("quota", F.floor(F.col("given") + F.lit(1e-6)).cast("long")).drop("given", "weight", "budget")


def mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, domains: dict[str, float] | None = None,
        langs: dict[str, float] | None = None, sources: dict[str, float] | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epochs, tokens_taken of the rows that the mix takes.

    A leaf with quota q and t tokens gives q div t whole epochs of all its documents (`epochs`), then the first
    q mod t tokens of one more, in the order of a seeded hash of that epoch and the doc_id; tokens_taken counts all
    of them, the last document's part included. Tokens are runs other than ASCII white space. Null and empty texts have none and
    aren't taken; a null lang, source or doc_id counts as an empty one; repeated rows each count, in either order;
    an empty table gives no rows. Only the columns named here are read. Texts are read once, for their token
    counts; all else works on a table of counts.

    A leaf is cut by the first digits of the hash into buckets of a bounded count of rows, whose sums place each bucket; so no
    task orders a whole leaf.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select("doc_id", blank("lang"), blank("source"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_tokens"))
    rows = written(rows, "tokens").where("n_tokens > 0").withColumn("domain", domain_of(F.col("source")))
    tree = ["domain", "lang", "source"]
    leaves = rows.groupBy(*tree).agg(F.sum("n_tokens").alias("have"), F.count("*").alias("n")).withColumn("cap", F.col("have") * epochs)
    leaves = written(leaves, "leaves")
    total, count = leaves.agg(F.sum("have"), F.count("*")).first()
    budget = float(int((total or 0) * share))
    plan = leaf_budgets(leaves, budget, DOMAINS if domains is None else domains, LANGS if langs is None else langs, sources or {})
    digits = F.ceil(F.log(16.0, F.greatest(F.col("n") / 1000, F.lit(1.0)))).cast("int")
    plan = plan.select(*tree, F.floor(F.col("quota") / F.col("have")).cast("long").alias("epochs"), (F.col("quota") % F.col("have")).alias("rest"), digits.alias("digits"))
    dealt = rows.join(F.broadcast(plan) if count <= SMALL else plan, tree)
    dealt = dealt.withColumn("turn", F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    dealt = dealt.withColumn("bucket", F.substring(F.col("turn"), F.lit(1), F.col("digits")))
    sums = dealt.groupBy(*tree, "bucket").agg(F.sum("n_tokens").alias("size"))
    order = Window.partitionBy(*tree).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("size").over(order), F.lit(0))).drop("size")
    own = Window.partitionBy(*tree, "bucket").orderBy("turn", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(sums, [*tree, "bucket"]).withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    part = F.least(F.greatest(F.col("rest") - F.col("ahead"), F.lit(0)), F.col("n_tokens"))
    taken = placed.withColumn("tokens_taken", F.col("epochs") * F.col("n_tokens") + part).where("tokens_taken > 0")
    return taken.select("doc_id", *tree, "n_tokens", "epochs", "tokens_taken")


def first_tokens(text: Column, count: Column) -> Column:
    """The text up to the end of so many of its tokens, what lies between them as it is."""
    space = WORD.replace("[^", "[").rstrip("+")
    parts = F.split(text, f"(?<={space})(?={WORD.rstrip('+')})")  # each token with the white space after it
    lead = F.when(text.rlike(f"^{space}"), 1).otherwise(0)
    return F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), (count + lead).cast("int")), ""), f"{space}+$", "")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, with mix_epochs and mix_tokens: its whole epochs and all its tokens.

    A text that is taken in part alone, the last of its leaf, ends with the last token that is taken, and n_chars, if there is such a column, is its length
    then; others are whole. Rows of one doc_id share what the mix takes of them, each its average. Columns of docs named mix_epochs or mix_tokens are replaced."""
    taken = mix(docs, **options).groupBy("doc_id").agg(F.avg("epochs").cast("long").alias("mix_epochs"), F.avg("tokens_taken").cast("long").alias("mix_tokens"))
    names = [c for c in docs.columns if c not in ("mix_epochs", "mix_tokens")]
    joined = docs.select(*names).alias("d").join(taken.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id"))).select("d.*", "mix_epochs", "mix_tokens")
    part = (F.col("mix_epochs") == 0) & (F.col("mix_tokens") < F.regexp_count("text", F.lit(WORD)))
    (cut,) = unused(joined, "cut")
    joined = joined.withColumn(cut, F.coalesce(part, F.lit(False)))
    changed = {"text": F.when(F.col(cut), first_tokens(F.col("text"), F.col("mix_tokens"))).otherwise(F.col("text"))}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col(cut), F.length(changed["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.withColumns(changed).select(*names, "mix_epochs", "mix_tokens")


def _case(name: str, given: dict[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}::DOUBLE" for k, v in given.items()) + " ELSE 1.0::DOUBLE END"


def _level(source: str, group: str, name: str, budget: str, weight: str) -> str:
    over = f"PARTITION BY {group} ORDER BY cap / weight, {name}"
    return f"""SELECT *, least(cap::DOUBLE, max(level) OVER (PARTITION BY {group}) * weight) AS given FROM (
      SELECT *, ({budget} - coalesce(sum(cap) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(weight) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM (SELECT *, {weight} AS weight FROM {source}))"""


ORACLE = rf"""
WITH r AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(text, '[^ \t\n\f\r]+'))::BIGINT AS n_tokens,
    'd' || CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN '-'
      ELSE (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4)::VARCHAR END AS domain
  FROM documents),
rows_ AS (SELECT * FROM r WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS have, (sum(n_tokens) * {EPOCHS})::BIGINT AS cap FROM rows_ GROUP BY ALL),
b AS (SELECT floor(sum(have) * {SHARE}) AS total FROM leaves),
d0 AS (SELECT domain, sum(cap) AS cap FROM leaves GROUP BY 1),
d1 AS ({_level("d0", "1", "domain", "(SELECT total FROM b)", _case("domain", DOMAINS))}),
g0 AS (SELECT domain, lang, sum(l.cap) AS cap, any_value(d1.given) AS budget FROM leaves l JOIN d1 USING (domain) GROUP BY 1, 2),
g1 AS ({_level("g0", "domain", "lang", "budget", _case("lang", LANGS))}),
s0 AS (SELECT l.*, g1.given AS budget FROM leaves l JOIN g1 USING (domain, lang)),
s1 AS ({_level("s0", "domain, lang", "source", "budget", "1.0::DOUBLE")}),
plan AS (SELECT domain, lang, source, (floor(given + 1e-6)::BIGINT // have)::BIGINT AS epochs, floor(given + 1e-6)::BIGINT % have AS rest FROM s1),
p AS (
  SELECT rows_.*, epochs, rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{SEED}:' || epochs || ':' || doc_id), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM rows_ JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, epochs, (epochs * n_tokens + least(greatest(rest - ahead, 0), n_tokens))::BIGINT AS tokens_taken
FROM p WHERE epochs * n_tokens + least(greatest(rest - ahead, 0), n_tokens) > 0
"""
