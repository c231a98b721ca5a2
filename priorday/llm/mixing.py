"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are summed to cells (source, language, topic) of token weight. Each
round rakes the cells to the source, language and topic targets in turn. A
cell's fitted over its own weight is its rate, the number of times that a document
is taken on average: drawn with probability min(1, rate), and where the rate
exceeds one, taken floor(rate) times and once more with the probability of the
rest. So the expected tokens of every cell are the fitted ones. The draw is a hash
of doc_id, so it is the same in every run, after a lost executor, and in SQL.

Targets are tempered shares by default (share ** TEMPER, scaled to one); explicit
ones can be passed per margin. The topic is a form class of the text by default;
any column expression can take its place.

Defined results: null source or language counts as the empty name. Null or
wordless texts have no tokens, fall into topic "empty" and are never drawn. Rows
that share doc_id and cell share the draw; a null doc_id draws as the empty name.
Texts of any length count whole, by one pass of a pattern. An empty table gives an empty result. Columns of `docs` that clash with names
used here are safe: each row is packed before anything is added."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

MARGINS = ("source", "lang", "topic")
ROUNDS = 10
TEMPER = 0.5
SHARE = 0.5  # tokens of the sample as a share of all tokens
BROADCAST_CELLS = 20_000  # cells beyond which their table is joined by shuffle, salted
STEP = 5  # rounds between written cells
WINDOW_CELLS = 1_000_000  # cells beyond which a margin is summed by grouping instead of in a window
SALTS = 16
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def form_topic(tokens: Column, text: str = "text") -> Column:
    """empty, marked (a symbol per 20 words or more), short, long or medium."""
    symbols = F.regexp_count(F.col(text), F.lit(r"[#*$%&|<>]"))
    return F.when(tokens == 0, "empty").when(symbols * 20 >= tokens, "marked").when(tokens < 100, "short").when(tokens >= 1000, "long").otherwise("medium")


def _with_cell(docs: DataFrame, topic: Column | None) -> DataFrame:
    """(row, id, source, lang, topic, tokens): each document, packed, with its cell and weight."""
    form = form_topic(n_tokens()) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), empty("source"), empty("lang"), form.alias("topic"), n_tokens().alias("tokens"))


def _targets(cells: DataFrame, margin: str, temper: float, given: Mapping[str, float] | None) -> DataFrame:
    """(margin, goal): shares that sum to one over the values that occur."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where("t > 0")
    if given is not None:
        rows = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{margin} string, g double")
        sums = sums.join(rows, margin, "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    else:
        sums = sums.withColumn("g", F.pow(F.col("t").cast("double"), F.lit(temper)))
    total = sums.agg(F.sum("g").alias("all_g"))
    return sums.crossJoin(F.broadcast(total)).select(margin, (F.col("g") / F.col("all_g")).alias("goal"))


def in_windows(cells: DataFrame, total: float) -> DataFrame:
    """One round: w scaled to the goals of every margin in turn, each sum taken in a window over the margin."""
    for m in MARGINS:
        s = F.sum("w").over(Window.partitionBy(m))
        cells = cells.withColumn("w", F.when(s > 0, F.col("w") * (F.col(f"{m}_goal") * F.lit(total) / s)).otherwise(0.0))
    return cells


def by_sums(cells: DataFrame, margin: str, total: float) -> DataFrame:
    """The same for one margin with sums combined before their shuffle, for margins with too many cells for one task."""
    sums = cells.groupBy(margin).agg(F.sum("w").alias("s"))
    factor = F.when(F.col("s") > 0, F.col(f"{margin}_goal") * F.lit(total) / F.col("s")).otherwise(0.0)
    return cells.join(sums, margin).select(*(c for c in cells.columns if c != "w"), (F.col("w") * factor).alias("w"))


def raked(docs: DataFrame, rounds: int = ROUNDS, temper: float = TEMPER, share: float = SHARE, topic: Column | None = None, targets: Mapping[str, Mapping[str, float]] | None = None, window_cells: int = WINDOW_CELLS) -> DataFrame:
    """(source, lang, topic, tokens, rate): every cell that has tokens, fitted to the targets.

    Goals are joined to the cells once. STEP rounds are one job over the written cells,
    three shuffles a round (three jobs a round where there are more than
    `window_cells`), so plans do not grow with the rounds."""
    cells = _with_cell(docs, topic).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    now = written(cells.withColumn("w", F.col("tokens").cast("double")), "cells")
    n, tokens = now.agg(F.count("*"), F.sum("tokens")).first()
    total = float((tokens or 0) * share)
    aimed = now
    for m in MARGINS:
        aimed = aimed.join(_targets(now, m, temper, (targets or {}).get(m)).withColumnRenamed("goal", f"{m}_goal"), m)
    now = _replaced(now, aimed)
    if n <= window_cells:
        for done in range(0, rounds, STEP):
            now = _replaced(now, reduce(lambda x, _: in_windows(x, total), range(min(STEP, rounds - done)), now))
    else:
        for m in MARGINS * rounds:
            now = _replaced(now, by_sums(now, m, total))
    return now.select(*MARGINS, "tokens", (F.col("w") / F.col("tokens")).alias("rate"))


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    out = written(new, "cells")
    forget(old)
    return out


def mixed(docs: DataFrame, **how) -> DataFrame:
    """(row, source, lang, topic, tokens, rate, probability, sampled, copies) for every document; `row` holds its columns.

    rate is null where the cell has no tokens; the probability is then zero. copies
    is how often the document is taken: zero where it is not sampled."""
    cells = raked(docs, **how).select(*MARGINS, "rate")
    made = _with_cell(docs, how.get("topic"))
    keys = list(MARGINS)
    if cells.count() <= BROADCAST_CELLS:
        joined = made.join(F.broadcast(cells), keys, "left")
    else:
        salted = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = made.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")
    probability = F.when(F.col("rate").isNull(), 0.0).otherwise(F.least(F.col("rate"), F.lit(1.0)))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.col("id"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    whole = F.floor(F.coalesce("rate", F.lit(0.0)))
    copies = whole + (draw < F.coalesce("rate", F.lit(0.0)) - whole).cast("long")
    return joined.withColumns({"probability": probability, "copies": copies}).withColumn("sampled", draw < F.col("probability")).drop("id")


def sampled(docs: DataFrame, **how) -> DataFrame:
    """The drawn rows of `docs`, each as often as it is taken, with its columns alone."""
    taken = mixed(docs, **how).where("sampled").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select("row.*")


def mixing_sql(rounds: int = ROUNDS, temper: float = TEMPER, share: float = SHARE) -> str:
    """The same in ANSI SQL, rounds written out."""
    parts = [
        r"""docs AS MATERIALIZED (SELECT doc_id, source, lang, CASE WHEN n_tokens = 0 THEN 'empty' WHEN n_symbols * 20 >= n_tokens THEN 'marked'
  WHEN n_tokens < 100 THEN 'short' WHEN n_tokens >= 1000 THEN 'long' ELSE 'medium' END AS topic, n_tokens
 FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
  len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols FROM documents))""",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS w FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0)",
        f"total AS MATERIALIZED (SELECT sum(tokens) * {share} AS t FROM c0)",
    ]
    for m in MARGINS:
        parts.append(f"g_{m} AS MATERIALIZED (SELECT {m}, g / sum(g) OVER () AS goal FROM (SELECT {m}, pow(CAST(sum(tokens) AS DOUBLE), {temper}) AS g FROM c0 GROUP BY {m}))")
    k = 0
    for _ in range(rounds):
        for m in MARGINS:
            parts.append(
                f"c{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, w * (goal * (SELECT t FROM total) / s) AS w FROM c{k} c "
                f"JOIN (SELECT {m}, sum(w) AS s FROM c{k} GROUP BY {m}) x ON c.{m} = x.{m} JOIN g_{m} g ON c.{m} = g.{m})"
            )
            k += 1
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS rate, round(least(rate, 1.0), 6) AS probability,
 CAST(floor(rate) AS BIGINT) + CAST(u < rate - floor(rate) AS BIGINT) AS copies, u < least(rate, 1.0) AS sampled FROM (
 SELECT doc_id, d.source, d.lang, d.topic, n_tokens, CASE WHEN w IS NULL THEN 0.0 ELSE w / tokens END AS rate,
  CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
 FROM docs d LEFT JOIN c{k} c ON d.source = c.source AND d.lang = c.lang AND d.topic = c.topic)"""
    )
