"""Questions against lines: terms, weights, ranking, search, and context under a budget."""

from __future__ import annotations

import re
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import QUESTION_STOP, TERM
from ..io import staged


def question_terms(question: str) -> list[str]:
    """Terms of a question without words that tell nothing; a repeated word counts again."""
    return [w for w in re.findall(TERM, question.lower()) if w not in QUESTION_STOP]


def research_terms(question: str, labels: list[str] = (), most: int = 12) -> list[str]:
    """Distinct words of a question and of theories' labels for a search, the first ones."""
    words = [w for w in re.findall(r"[A-Za-z][A-Za-z'-]{2,}", question.lower()) if w not in QUESTION_STOP]
    words += [w for x in labels for w in re.findall(r"[A-Za-z]{4,}", x.lower()) if w not in QUESTION_STOP]
    return list(dict.fromkeys(words))[:most]


def term_idf(records: DataFrame, terms: list[str], by: str | None = None, text: str = "text") -> DataFrame:
    """by, n, w0, w1, ...: weights of the distinct terms, ln(1 + n / (1 + df)), over all lines of each group (of all if by is None).

    A term is in a line as a substring; bookkeeping lines count as lines; a term that
    the question repeats counts in df as often as it stands there.
    """
    low = F.lower(text)
    times = [(t, terms.count(t)) for t in dict.fromkeys(terms)]
    sums = [F.sum(F.contains(low, F.lit(t)).cast("long") * n).alias(f"df{k}") for k, (t, n) in enumerate(times)]
    g = (records.groupBy(by) if by else records.groupBy(F.lit(0).alias("_all"))).agg(F.count("*").alias("n"), *sums)
    df = lambda k: F.coalesce(F.col(f"df{k}"), F.lit(0))
    return g.select(by or "_all", "n", *[F.round(F.log(1 + F.col("n") / (1 + df(k))), 8).alias(f"w{k}") for k in range(len(times))], *[df(k).alias(f"df{k}") for k in range(len(times))])


def idf_rows(records: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """term, df, n, idf over all lines."""
    uniq = list(dict.fromkeys(terms))
    x = term_idf(records, terms, None, text)
    return x.select("n", F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"df{k}").alias("df"), F.col(f"w{k}").alias("idf")) for k, t in enumerate(uniq)]))).select("term", "df", "n", "idf")


def score_lines(records: DataFrame, terms: list[str], by: str | None = None, name: str | None = None, text: str = "text", matter: str | None = None) -> DataFrame:
    """The records with score: the weights of the terms in a line, and of those in its file's name; bookkeeping lines have 0.

    by: group whose lines are counted (a case).  name: column of file names.  matter:
    only this matter's lines (column matter) are counted and kept.  Weights join as a
    small table, a row for each group; nothing runs while the plan is built.
    """
    x = records if matter is None else records.where(F.col("matter").cast("string") == matter)
    uniq = list(dict.fromkeys(terms))
    w = term_idf(x, terms, by, text).select(by or "_all", *[f"w{k}" for k in range(len(uniq))])
    j = x.join(w, by) if by else x.withColumn("_all", F.lit(0)).join(w, "_all").drop("_all")

    def weigh(c: Column) -> Column:
        low = F.lower(c)
        return sum((F.when(F.contains(low, F.lit(t)), F.col(f"w{k}") * terms.count(t)).otherwise(0.0) for k, t in enumerate(uniq)), F.lit(0.0))

    score = weigh(F.col(text)) + (weigh(F.coalesce(F.col(name), F.lit(""))) if name else F.lit(0.0))
    return j.withColumn("score", F.round(F.when(F.col("noise"), 0.0).otherwise(score), 8)).drop(*[f"w{k}" for k in range(len(uniq))])


def top_documents(scored: DataFrame, key: str, best: int = 5, limit: int = 20) -> DataFrame:
    """key, score, lines: documents by the sum of their best lines."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "line")
    x = scored.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best)
    g = x.groupBy(key).agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("lines"))
    return g.orderBy(F.desc("score"), key).limit(limit)


def search(lines: DataFrame, query: str, source: str, limit: int = 50) -> DataFrame:
    """source, line, text, score: lines by how often the query's words stand in them, overlaps not counted."""
    low = F.lower("text")
    words = [w.lower() for w in re.findall(r"[A-Za-z0-9§'’.-]+", query) if len(w) > 1]
    score = sum(((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0))
    x = lines.withColumn("score", score.cast("int")).where("score > 0")
    return x.select(source, "line", "text", "score").orderBy(F.desc("score"), source, "line").limit(max(1, min(limit, 200)))


REACH = 16  # lines by which the widening steps 1, 2, 3, 4 and 6 can go beyond a chosen one


def _choose(rows: list[dict], budget: int) -> list[int]:
    """Indexes of the lines that a context takes, for one case.

    rows: source, rank, pos (place in the source), cost, score, ruled (taken by its
    controlling document's share), strength (sum of the source's five best lines).
    Documents follow by strength, each line with its neighbours, a document up to its
    cap; what is left widens the neighbourhoods of what is taken.  Without any scored
    line, lines are read by rank and place.
    """
    cost = [r["cost"] for r in rows]
    at = {(r["source"], r["pos"]): k for k, r in enumerate(rows)}
    chosen: set[int] = set()
    spent = 0
    if not any(r["score"] > 0 for r in rows):
        for k in sorted(range(len(rows)), key=lambda k: (rows[k]["rank"], rows[k]["source"], rows[k]["pos"])):
            if spent + cost[k] <= budget:
                chosen.add(k)
                spent += cost[k]
        return sorted(chosen)
    by: dict[str, list[int]] = {}
    for k, r in enumerate(rows):
        by.setdefault(r["source"], []).append(k)
        if r["ruled"]:
            chosen.add(k)
            spent += cost[k]
    ranked = sorted((s for s, ks in by.items() if rows[ks[0]]["strength"] > 0), key=lambda s: (-rows[by[s][0]]["strength"], s))
    cap = max(1500, budget // max(4, min(len(ranked), 8)))

    def near(k: int, steps: tuple[int, ...]) -> list[int]:
        return [x for d in steps if (x := at.get((rows[k]["source"], rows[k]["pos"] + d))) is not None and x not in chosen]

    for s in ranked:
        used = 0  # what a controlling document's share has taken does not count against its cap
        for k in sorted((k for k in by[s] if rows[k]["score"] > 0), key=lambda k: (-rows[k]["score"], -rows[k]["pos"])):
            for x in near(k, (-1, 0, 1)):
                if used + cost[x] <= cap and spent + cost[x] <= budget:
                    chosen.add(x)
                    used += cost[x]
                    spent += cost[x]
    for reach in (2, 3, 4, 6):
        for k in sorted(chosen, key=lambda k: (rows[k]["source"], rows[k]["pos"])):
            for x in near(k, (-reach, reach)):
                if spent + cost[x] <= budget:
                    chosen.add(x)
                    spent += cost[x]
    return sorted(chosen)


def _taken(costs: Column, share: Column) -> Column:
    """Places of an array of (pos, cost) that fit a share, in order, skipping what does not fit."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("taken"))
    step = lambda a, x: F.when(a["used"] + x["cost"] <= share, F.struct((a["used"] + x["cost"]).alias("used"), F.array_append(a["taken"], x["pos"]).alias("taken"))).otherwise(a)
    return F.aggregate(costs, start, step)["taken"]


def context(scored: DataFrame, budget: int = 24_000) -> DataFrame:
    """case_id, source, line, text, chars: the lines of each case that fit a budget of characters.

    scored: case_id, source, rank, line, text, noise, score.  Documents are prepared by
    windows over their lines: controlling ones (rank 1 to 3) take lines in order from
    35 % of the budget in equal shares; of the scored lines those stay that a document's
    cap could hold, with what the widening can reach.  The fold over a case then sees
    places and costs of these only, of as many documents as the budget could hold a line
    of: its rows are bounded by the budget.  Texts join what is chosen.  Rows without
    case_id have no context.
    """
    least = 9  # cost of the shortest line
    most_lines, most_sources = max(1500, budget // 4) // least, budget // least
    doc = ["case_id", "source"]
    x = scored.where("case_id is not null").withColumn("pos", F.row_number().over(Window.partitionBy(*doc).orderBy("line")) - 1)
    x = staged(x.withColumn("cost", (F.length("text") + 8).cast("bigint")))
    order = Window.partitionBy(*doc).orderBy(F.desc("score"), F.desc("pos"))
    light = x.where("not noise").select(*doc, "rank", "pos", "cost", "score").withColumn("nth", F.when(F.col("score") > 0, F.row_number().over(order)))
    of_doc = light.groupBy(*doc).agg(F.min("rank").alias("rank"), F.sum(F.when(F.col("nth") <= 5, F.col("score")).otherwise(0.0)).alias("strength"))
    of_case = of_doc.groupBy("case_id").agg(F.sum((F.col("rank") <= 3).cast("int")).alias("ruling"), (F.max("strength") > 0).alias("found"))
    costs = F.transform(F.array_sort(F.collect_list(F.struct("pos", "cost"))), lambda s: s)
    shares = light.where("rank <= 3").groupBy(*doc).agg(costs.alias("costs")).join(of_case.where("found"), "case_id").select(*doc, F.explode(_taken(F.col("costs"), F.floor(F.lit(int(0.35 * budget)) / F.col("ruling")))).alias("pos"), F.lit(True).alias("ruled"))
    # The strongest documents of a case, in two steps, so that no task sees all documents of a large one.
    heads = of_doc.join(of_case, "case_id").where("(found and (strength > 0 or rank <= 3)) or not found").withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(64)))
    for part in (["case_id", "salt"], ["case_id"]):
        first = Window.partitionBy(*part).orderBy((F.col("found") & (F.col("rank") <= 3)).desc(), F.desc("strength"), "rank", "source")
        heads = heads.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most_sources)
    y = light.join(heads.select(*doc, "strength", "found"), doc).join(shares, [*doc, "pos"], "left").fillna(False, ["ruled"])
    near = Window.partitionBy(*doc).orderBy("pos").rangeBetween(-REACH, REACH)
    run = Window.partitionBy(*doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.col("nth") <= most_lines, F.lit(False))
    y = y.withColumn("top", top).withColumn("kept", F.max(F.col("top") | F.col("ruled")).over(near)).withColumn("before", F.coalesce(F.sum(F.when(F.col("cost") <= 208, F.col("cost"))).over(run), F.lit(0)))
    # Without any scored line a case is read in order: what stands behind twice the budget of a document's usual lines is out of reach.
    y = y.where("if(found, kept, before <= 2 * %d)" % budget).select(*doc, "rank", "pos", "cost", F.when(F.col("top"), F.col("score")).otherwise(0.0).alias("score"), "ruled", "strength")

    def one_case(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["source", "pos"])
        return f.iloc[_choose(f.to_dict("records"), budget)][["case_id", "source", "pos"]]

    chosen = y.groupBy("case_id").applyInPandas(one_case, "case_id string, source string, pos int")
    return x.join(chosen, [*doc, "pos"]).select(*doc, "line", "text", F.length("text").cast("bigint").alias("chars"))
