"""Mixing sources to target weights by hierarchical budgets.

Sources form a tree (domain, language, source). A budget of tokens goes down the tree: each node's share is dealt to its
children by weight, but no child gets more than its own leaves hold in `epochs` passes. What a child cannot take goes to its siblings
by their weights; only what no child of a node can take is missing above, where the node's own cap already sends
it to the node's siblings. For one node that is water-filling: with children ordered by cap / weight, the level is the greatest
(budget - caps before) / (weights from here on), and a child gets min(cap, weight * level), rounded down; the tokens that
rounding leaves go, one each, to the first children by name that have room, so a node deals out all it has.

A leaf that gets A of its T tokens is read A div T times as a whole and once more for the A mod T tokens that are left, each
pass in the order of a seeded hash of its own; the last document of a prefix is cut at the budget. Prefixes come from
sums over ranges of the hash, refined `LEVELS` times, so no task orders more than a 256**LEVELS-th of a leaf; where that
still is more than `CELL` rows, as many rows share a doc_id, ranges of a hash of the rows' `tie` refine it further.

Edge cases: null values of the tree's columns are a leaf of their own, ''; nodes of weight 0 get nothing; documents
without tokens are never chosen; rows that repeat a doc_id are separate, in one place of each order, there by the hash
of their tie (the text, if nothing else is named; rows alike in that, too, in any order); null
doc_ids hash as ''; a budget above what the tree holds is cut to it; an empty table gives an empty result;
columns that are named as results are replaced, all others stay, whatever their names. Tokens are words, runs of characters other than space and 0x09-0x0D, where no column of counts is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WORD = "[^\\x20\\x09-\\x0D]+"
LEVELS = 3
#: Rows of the range in which a budget ends, up to which they are put in order.
CELL = 100_000
#: Leaves up to which the table of budgets is broadcast.
LEAVES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Deals `budget`, known to each child (name, cap, weight) of one parent, to the children."""
    part = Window.partitionBy(*parent) if parent else Window.partitionBy()
    order = part.orderBy(F.col("cap") / F.col("weight"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    num, den = F.greatest(F.col("budget") - before, F.lit(0)), F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = children.withColumns({"_num": num.cast("long"), "_den": den.cast("long")})
    top = F.max(F.struct((F.col("_num").cast("double") / F.col("_den").cast("double")).alias("level"), "_num", "_den")).over(part)
    whole = level.withColumn("_top", top).withColumn("_share", F.expr("least(cap, (cast(weight as decimal(19,0)) * cast(_top._num as decimal(19,0))) div cast(_top._den as decimal(19,0)))").cast("long"))
    left = F.least("budget", F.sum("cap").over(part)) - F.sum("_share").over(part)
    turn = F.row_number().over(part.orderBy(F.desc(F.col("cap") > F.col("_share")), name))
    more = (F.col("cap") > F.col("_share")) & (F.col("_turn") <= F.col("_left"))
    return whole.withColumns({"_left": left, "_turn": turn}).withColumn("share", F.col("_share") + more.cast("long")).select(*children.columns, "share")


def budgets(leaves: DataFrame, tree: list[str], weights: dict[str, dict[str, int]], budget: int | float, epochs: int) -> DataFrame:
    """`share` of tokens for each leaf (tree columns, tokens). A float budget is a share of all tokens. Weights are whole
    numbers, 1 where none is given."""
    nodes = leaves.withColumn("cap", F.col("tokens") * epochs)
    for c in tree:
        known = F.lit(1)
        for value, w in sorted(weights.get(c, {}).items()):
            known = F.when(F.col(c) == value, w).otherwise(known)
        nodes = nodes.withColumn(f"_w_{c}", known.cast("long"))
    nodes = nodes.where(" AND ".join(f"_w_{c} > 0" for c in tree))
    total = nodes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cap"), F.lit(0)).alias("cap")).first()
    all_tokens = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    want = min(int(budget * all_tokens) if isinstance(budget, float) else budget, total["cap"])
    done: DataFrame | None = None
    for i, c in enumerate(tree):
        keys = tree[: i + 1]
        level = nodes.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.first(f"_w_{c}").alias("weight"))
        level = level.withColumn("budget", F.lit(want).cast("long")) if done is None else level.join(done.select(*tree[:i], F.col("share").alias("budget")), tree[:i])
        done = fill(level, tree[:i], c)
    return leaves.join(done.select(*tree, "share"), tree)


def mix(docs: DataFrame, tree: dict[str, Column], weights: dict[str, dict[str, int]], budget: int | float, epochs: int = 4, seed: int = 17, tokens: str | None = None, tie: str = "text") -> DataFrame:
    """The chosen rows of docs with all their columns, and `mix_epoch`, `n_tokens`, `take_tokens`; `tree` names the
    levels and gives their values."""
    names = [f"mix_{c}" for c in tree]
    spark = docs.sparkSession
    shared.slim(spark)
    results = [*names, "mix_epoch", "n_tokens", "take_tokens"]
    # The rows travel as one struct, so that no name of theirs meets one of the plan's.
    values = {n: F.coalesce(v.cast("string"), F.lit("")) for n, v in zip(names, tree.values(), strict=True)}
    count = F.col(tokens).cast("long") if tokens else n_words(F.col("text").cast("string"))
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    leafed = docs.select(*[v.alias(n) for n, v in values.items()], doc_id.alias("_id"), F.md5(F.coalesce(F.col(tie).cast("string"), F.lit("")).cast("binary")).alias("_tie"), count.alias("n_tokens"), F.struct(*docs.columns).alias("_row"))
    # Words are counted once for all sums: the plan is made on a narrow table.
    thin = shared.kept(leafed.drop("_row").where("n_tokens > 0"), "thin")
    leaves = shared.kept(thin.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    planned = shared.kept(budgets(leaves, names, {f"mix_{k}": v for k, v in weights.items()}, budget, epochs), "budgets")
    plan = planned.select(*names, F.floor(F.col("share") / F.col("tokens")).cast("int").alias("_whole"), (F.col("share") % F.col("tokens")).alias("_rest"))
    few = planned.count() <= LEAVES

    def with_leaf(df: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
        return df.join(F.broadcast(table) if few else table, names, how)

    key = F.concat(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("_whole").cast("string"), "_id").cast("binary")), "_tie")
    narrow = with_leaf(thin, plan).where("_rest > 0").withColumn("_key", key).select(*names, "_key", "n_tokens", "_rest")
    placed = with_leaf(leafed, plan).withColumn("_key", key)
    cuts = plan.where("_rest > 0").select(*names, F.lit("").alias("_cut"), F.lit(0).cast("long").alias("_before"), "_rest")
    for level in range(2 * LEVELS):
        # First the hash of doc_id, 32 characters, then that of the tie.
        cell = F.substring("_key", 1, 2 * (level + 1) if level < LEVELS else 32 + 2 * (level - LEVELS + 1))
        inside = with_leaf(narrow.drop("_rest"), cuts).where(F.col("_key").startswith(F.col("_cut"))) if level else narrow.withColumn("_before", F.lit(0).cast("long"))
        sums = inside.groupBy(*names, cell.alias("_cell"), "_before", "_rest").agg(F.sum("n_tokens").alias("_n"), F.count("*").alias("_rows"))
        upto = F.sum("_n").over(Window.partitionBy(*names).orderBy("_cell"))
        ends = sums.withColumn("_upto", F.col("_before") + upto).where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_n") < F.col("_rest")))
        found = shared.kept(ends.select(*names, F.col("_cell").alias("_cut"), (F.col("_upto") - F.col("_n")).alias("_before"), "_rest", "_rows"), "cuts")
        cuts = found.drop("_rows")
        if level >= LEVELS - 1 and (found.agg(F.max("_rows")).first()[0] or 0) <= CELL:
            break
    # Rows of the cell in which the budget ends are put in order; there are few of them.
    last = with_leaf(placed.drop("_rest"), cuts).where(F.col("_key").startswith(F.col("_cut")))
    order = Window.partitionBy(*names).orderBy("_key")
    last = last.withColumn("_start", F.col("_before") + F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    ends = last.where("_start < _rest AND n_tokens > 0").withColumn("take_tokens", F.least("n_tokens", F.col("_rest") - F.col("_start"))).withColumn("mix_epoch", F.col("_whole"))
    first = with_leaf(placed, cuts.select(*names, "_cut"), "left").where("n_tokens > 0")
    passes = F.when(F.col("_whole") > 0, F.sequence(F.lit(0), F.col("_whole") - 1)).otherwise(F.array().cast("array<int>"))
    early = F.when((F.col("_rest") > 0) & (F.col("_key") < F.col("_cut")), F.array("_whole")).otherwise(F.array().cast("array<int>"))
    whole = first.withColumn("mix_epoch", F.explode(F.concat(passes, early))).withColumn("take_tokens", F.col("n_tokens"))
    columns = [*[F.col("_row")[c].alias(c) for c in docs.columns if c not in results], *results]
    return whole.select(*columns).unionAll(ends.select(*columns))


def cut_text(text: Column, take: Column, have: Column) -> Column:
    """The text's first `take` words, with what stands between them."""
    pieces = F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    return F.when(take < have, F.array_join(F.slice(pieces, F.lit(1), take.cast("int")), "")).otherwise(text)


# --- parameters of the query and of the pipeline's stage -------------------------------------------------------------

WEIGHTS = {"domain": {"group0": 4, "group1": 3, "group2": 2, "group3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def tree() -> dict[str, Column]:
    """A source's domain goes by the last character of its name, as the tables have no column for it."""
    return {"domain": F.expr("'group' || cast(ascii(right(coalesce(source, ''), 1)) % 4 AS string)"), "lang": F.col("lang"), "source": F.col("source")}


def _levels_sql() -> str:
    """The water-filling of `fill`, level by level."""
    names, out, above = ["mix_domain", "mix_lang", "mix_source"], [], None
    for i, c in enumerate(names):
        keys, parent = ", ".join(names[: i + 1]), ", ".join(names[:i])
        source = f"SELECT {keys}, sum(cap) AS cap, any_value(w{i}) AS weight FROM caps GROUP BY {keys}"
        if above:
            source = f"SELECT n.*, p.share AS budget FROM ({source}) n JOIN {above} p USING ({parent})"
        else:
            source = f"SELECT n.*, (SELECT least(floor(0.6::double * sum(tokens)), sum(cap))::bigint FROM caps) AS budget FROM ({source}) n"
        part = f"PARTITION BY {parent}" if parent else ""
        out.append(f"""ratios{i} AS (
  SELECT *, greatest(budget - coalesce(sum(cap) OVER ({part} ORDER BY cap::double / weight, {c} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::hugeint AS num,
    sum(weight) OVER ({part} ORDER BY cap::double / weight, {c} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::hugeint AS den FROM ({source})),
tops{i} AS (SELECT *, first_value(num) OVER w AS top_num, first_value(den) OVER w AS top_den FROM ratios{i} WINDOW w AS ({part} ORDER BY num::double / den::double DESC, num DESC, den DESC)),
floors{i} AS (SELECT *, least(cap, (weight::hugeint * top_num) // top_den)::bigint AS low FROM tops{i}),
rests{i} AS (SELECT *, least(budget, sum(cap) OVER ({part})) - sum(low) OVER ({part}) AS over_, row_number() OVER ({part} ORDER BY (cap > low) DESC, {c}) AS turn FROM floors{i}),
level{i} AS (SELECT *, low + CASE WHEN cap > low AND turn <= over_ THEN 1 ELSE 0 END AS share FROM rests{i})""")
        above = f"level{i}"
    return ",\n".join(out)


#: DuckDB's form of the query on `documents`, with the parameters above, budget 0.6, 4 epochs and seed 17.
ORACLE = f"""
WITH rows_ AS (
  SELECT doc_id, 'group' || (ascii(right(coalesce(source, ''), 1)) % 4)::varchar AS mix_domain, coalesce(lang, '') AS mix_lang, coalesce(source, '') AS mix_source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS n_tokens FROM documents),
leaves AS (SELECT mix_domain, mix_lang, mix_source, sum(n_tokens)::bigint AS tokens FROM rows_ GROUP BY ALL HAVING sum(n_tokens) > 0),
caps AS (SELECT *, tokens * 4 AS cap,
  CASE mix_domain WHEN 'group0' THEN 4 WHEN 'group1' THEN 3 WHEN 'group2' THEN 2 ELSE 1 END AS w0,
  CASE mix_lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w1, 1 AS w2 FROM leaves),
{_levels_sql()},
plan AS (SELECT mix_domain, mix_lang, mix_source, (share // tokens)::integer AS whole_, share % tokens AS rest FROM level2 JOIN leaves USING (mix_domain, mix_lang, mix_source)),
placed AS (SELECT *, md5('17|' || whole_::varchar || '|' || coalesce(doc_id::varchar, '')) AS key FROM rows_ JOIN plan USING (mix_domain, mix_lang, mix_source) WHERE n_tokens > 0),
ordered AS (SELECT *, sum(n_tokens) OVER (PARTITION BY mix_domain, mix_lang, mix_source ORDER BY key, doc_id) - n_tokens AS start FROM placed)
SELECT doc_id, mix_domain, mix_lang, mix_source, whole_ AS mix_epoch, n_tokens, least(n_tokens, rest - start)::bigint AS take_tokens FROM ordered WHERE start < rest
UNION ALL
SELECT doc_id, mix_domain, mix_lang, mix_source, unnest(range(whole_))::integer AS mix_epoch, n_tokens, n_tokens AS take_tokens FROM placed WHERE whole_ > 0
"""
