"""URL filters: rules first, then naive Bayes over the words that hosts and paths are made of."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, ascii_lower

#: Words up to so many letters are looked up whole, longer ones by their first letters.
STRETCH = 24
#: Log odds are whole numbers of this fraction.
UNIT = 1 << 32

#: Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones, the longer, come first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Splits a run of letters into words: the best path under unigram probabilities.

    A word never seen costs `unknown`, and two fifths of it again for each further letter, so its best start is a
    running minimum. Words of any length count: those above STRETCH letters are looked up by their first STRETCH.
    """

    def __init__(self, counts: Iterable[tuple[str, int]], total: int):
        self.cost, self.long = {}, {}
        for w, n in counts:
            self.cost[w] = -math.log(n / (total + 1))
            if len(w) > STRETCH:
                self.long.setdefault(w[:STRETCH], []).append(w)
        self.unknown = math.log(total + 1) + 2.0
        self.split = lru_cache(100_000)(self._split)

    def _split(self, name: str) -> tuple[str, ...]:
        n, step, cost = len(name), 0.4 * self.unknown, self.cost
        best, back = [math.inf] * (n + 1), [0] * (n + 1)
        best[0], start, low = 0.0, 0, 0.0  # low: the least of best[i] - step * i, at i = start
        for at in range(n + 1):
            if at:
                fresh = low + 0.6 * self.unknown + step * at
                if fresh < best[at]:
                    best[at], back[at] = fresh, start
                if best[at] - step * at < low:
                    low, start = best[at] - step * at, at
            for end in range(at + 1, min(n, at + STRETCH) + 1):
                known = cost.get(name[at:end])
                if known is not None and best[at] + known < best[end]:
                    best[end], back[end] = best[at] + known, at
            for w in self.long.get(name[at : at + STRETCH], ()):
                if name.startswith(w, at) and best[at] + cost[w] < best[at + len(w)]:
                    best[at + len(w)], back[at + len(w)] = best[at] + cost[w], at
        out, end = [], n
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(out))

    def tokens(self, host: Iterable[str], path: Iterable[str]) -> list[str]:
        """Words of the host's runs (h:...) and of the path's (p:...); digits stand as #."""
        out = []
        for kind, runs in (("h:", host), ("p:", path)):
            for run in runs:
                out += [kind + w for w in self.split(run)] if run[0].isalpha() else ["#" + kind]
        return out


def word_counts(pages: DataFrame) -> DataFrame:
    """(w, n) of every word of the pages' texts, for the segmenter. Urls give none: a name that many urls hold would be its own word."""
    text = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), r"<[^>]*>|[a-zA-Z]+://\S*", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    return words.groupBy("w").agg(F.count("*").alias("n"))


def segment(rows: DataFrame, words: DataFrame, scratch: Scratch) -> DataFrame:
    """(block, row, by_rule, tokens) for rows(block, row, by_rule, h array, p array), under the whole table words(w, n).

    Each block asks the table once for every stretch of letters that occurs in its runs, so that a stretch which
    all urls have is asked once a block; the words it gets back are its whole dictionary.
    """
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    runs = rows.select("block", F.explode(F.concat("h", "p")).alias("run")).where(r"run rlike '^\\p{L}'").distinct()
    at = runs.select("block", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(STRETCH), F.length("run") - F.col("at") + 1)))
    pieces = at.select("block", "run", "at", size.alias("size")).select("block", F.expr("substring(run, at, size)").alias("piece")).distinct()
    known = words.withColumn("piece", F.substring("w", 1, STRETCH)).join(pieces, "piece").select(F.col("block").alias("asker"), "w", "n")
    kinds = "block long, row long, by_rule string, tokens array<string>"

    def cut(rows, words):
        import pandas as pd

        by = Segmenter(zip(words["w"], words["n"].tolist()), total)
        return pd.DataFrame({"block": rows["block"], "row": rows["row"], "by_rule": rows["by_rule"], "tokens": [by.tokens(h, p) for h, p in zip(rows["h"], rows["p"])]})

    return scratch.save(rows.groupBy("block").cogroup(known.groupBy("asker")).applyInPandas(cut, kinds), "tokens")


def log_odds(tokens: DataFrame) -> tuple[DataFrame, int]:
    """((token, odds), unseen): log P(token | block) - log P(token | allow) in units of 1 / UNIT, with add-one smoothing.

    tokens(by_rule, tokens). In whole numbers a sum of odds is the same in any order. unseen is the odds of
    a token that no page with a rule has.
    """
    each = tokens.where("by_rule is not null").select("by_rule", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count_if(F.col("by_rule") == "allow").alias("a"), F.count_if(F.col("by_rule") == "block").alias("b"))
    one = counts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), (F.count("*") + 1).alias("size")).first()
    log = lambda n, total: F.ln(n.cast("double") + 1) - math.log(total + one["size"])
    odds = F.round((log(F.col("b"), one["b"]) - log(F.col("a"), one["a"])) * UNIT).cast("long")
    return counts.select("token", odds.alias("odds")), round((math.log(one["a"] + one["size"]) - math.log(one["b"] + one["size"])) * UNIT)


def judge_urls(spark: SparkSession, pages: DataFrame, rules=RULES, block: int = 10_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) for every row of pages(page_id, url, html, ...).

    A rule's verdict stands. Other urls are judged by multinomial naive Bayes with add-one smoothing
    over the segmented words of host and path: block if that is likelier, allow on a tie. It learns from
    all pages that a rule decides; the segmenter's words come from all pages. Neither table is cut: rows
    lie in blocks of about `block`, and each block gets what it needs of them by join, so neither is
    broadcast and the size of a block decides nothing. With pages of one verdict alone, or none, the prior
    decides. Null urls and such without `://` have an empty host and path and no rule; very long ones are
    read whole. Null page_ids and repeated rows come back as given; further columns are not read.
    """
    scratch = Scratch(spark, "urls")
    host, path = url_parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\p{Nd}+)"), 1)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), runs("host").alias("h"), runs("path").alias("p"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.save(rows, "rows")  # from here on a row's number stays
    prior = {r.by_rule: r.n for r in rows.groupBy("by_rule").agg(F.count("*").alias("n")).collect()}
    blocks = max(1, -(-sum(prior.values()) // block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    both = bool(prior.get("allow") and prior.get("block"))
    base = math.log((prior.get("block", 0) + 1) / (prior.get("allow", 0) + 1))
    out = ["page_id", "host", "path", "rule"]
    by_rule = rows.where("by_rule is not null").select(*out, F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    rest = rows.where("by_rule is null")
    if not both:
        p = 1 / (1 + math.exp(-base))
        return by_rule.unionByName(rest.select(*out, F.lit("block" if p > 0.5 else "allow").alias("verdict"), F.lit(p).alias("p_block")))
    words = scratch.save(word_counts(pages), "words")
    tokens = segment(rows.select("block", "row", "by_rule", "h", "p"), words, scratch)
    odds, unseen = log_odds(tokens)
    open_ = tokens.where("by_rule is null")
    known = open_.select("block", F.explode("tokens").alias("token")).distinct().join(odds, "token").select(F.col("block").alias("asker"), "token", "odds")

    def score(rows, odds):
        import pandas as pd

        by = dict(zip(odds["token"], odds["odds"].tolist()))
        z = [base + sum(by.get(t, unseen) for t in tokens) / UNIT for tokens in rows["tokens"]]
        return pd.DataFrame({"row": rows["row"], "z": z})

    scores = open_.select("block", "row", "tokens").groupBy("block").cogroup(known.groupBy("asker")).applyInPandas(score, "row long, z double")
    z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("z")))
    judged = rest.join(scores, "row").select(*out, F.when(F.col("z") > 0, "block").otherwise("allow").alias("verdict"), (1 / (1 + F.exp(-z))).alias("p_block"))
    return by_rule.unionByName(judged)
