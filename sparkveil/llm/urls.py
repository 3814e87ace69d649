"""URL filter (operator 3, DataFrame functions only): rules on host and path, and gradient-boosted trees on lexical features
for the URLs that no rule fits.

Suffix statistics are counts and block rates, among the training rows, of a URL's top domain, of its first path segment, and of that segment with the
first character of the next. Training rows get them from the rows of other hosts only (folds by a hash of the host), others from all; rates are drawn to
the mean of all labels, which is also what an unseen suffix gets, so that nothing counts as allowed for being unknown.

The trees are grown by histogram queries: per level of a tree, gradients and Hessians of the training rows are summed by node,
feature and bin, and each node takes the split of most gain; what it sends left and right are the values of its leaves. Only those sums, whose number the parameters bound, come
to the driver. A grown ensemble is one CASE expression a tree, so that scoring stays inside generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: (verdict, rule): host and path prefix. Of those that fit, the longest wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Labelled rows that the trees are fitted on at most; rounds, depth, bins a feature, rate, ridge; folds of hosts, rows that a suffix's rate is drawn to the mean with.
TRAIN_ROWS, ROUNDS, DEPTH, BINS, RATE, RIDGE, FOLDS, PRIOR_ROWS = 20_000, 12, 3, 16, 0.4, 1.0, 5, 4.0
LEXICAL = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens")
SUFFIXES = ("domain", "section", "stem")
FEATURES = (*LEXICAL, *(f"{k}_{v}" for k in SUFFIXES for v in ("count", "rate")))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and for no ://."""
    return F.translate(_part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group)), F.lit(""))


def fitting_rule(h: Column, p: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits. A rule fits its host and all subdomains, if the path starts with the rule's.
    Rules of equal length that fit the same URL: the one listed first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # later ones win, so the first listed of equal length comes last
        name, slash, rest = text.partition("/")
        fits = ((h == name) | h.endswith(f".{name}")) & p.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features of url, host and path that need no statistics."""
    u, h, p = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    # of the counts of each distinct character
    entropy = F.expr("aggregate(transform(array_distinct(split(coalesce(url, ''), '')), c -> (length(coalesce(url, '')) - length(replace(coalesce(url, ''), c, ''))) / cast(greatest(length(coalesce(url, '')), 1) AS double)), 0.0D, (s, q) -> s - CASE WHEN q > 0 THEN q * log2(q) ELSE 0.0D END)")
    cols = {
        "length": F.length(u), "host_length": F.length(h), "path_length": F.length(p), "depth": F.length(p) - F.length(F.translate(p, "/", "")), "labels": F.when(h == "", 0).otherwise(1 + F.length(h) - F.length(F.translate(h, ".", ""))),
        "digit_ratio": (F.length(u) - F.length(F.translate(u, "0123456789", ""))) / n, "entropy": F.round(entropy, 6), "parameters": F.when(query == "", 0).otherwise(1 + F.length(query) - F.length(F.translate(query, "&", ""))), "hyphens": F.length(h) - F.length(F.translate(h, "-", "")),
    }
    return df.withColumns({k: v.cast("double") for k, v in cols.items()})


def suffixes() -> dict[str, Column]:
    """Hashes of the URL's suffixes, by kind: top domain, first path segment, that and the character after it."""
    at = {"domain": F.substring_index("host", ".", -1), "section": F.regexp_extract("path", r"^/([^/]*)", 1), "stem": F.regexp_extract("path", r"^/([^/]*/?[^/]?)", 1)}
    return {k: F.xxhash64(F.lit(k), v) for k, v in at.items()}


@dataclass
class Model:
    edges: dict[str, list[float]] = field(default_factory=dict)
    #: (suffix, n, b): labelled rows and blocked ones of each suffix of the training rows, three times TRAIN_ROWS rows at most.
    suffixes: DataFrame | None = None
    mean: float = 0.0
    base: float = 0.0
    trees: list[dict] = field(default_factory=list)

    def rate(self, n: Column | str, b: Column | str) -> Column:
        return (F.col(b) + PRIOR_ROWS * self.mean) / (F.col(n) + PRIOR_ROWS)

    def with_suffixes(self, df: DataFrame) -> DataFrame:
        """Adds the suffix features, as rows that were not fitted have them."""
        for k, h in suffixes().items():
            if self.suffixes is None:
                df = df.withColumn(f"{k}_count", F.lit(0.0)).withColumn(f"{k}_rate", F.lit(float(self.mean)))
                continue
            side = F.broadcast(self.suffixes.select(F.col("suffix").alias(f"{k}_"), F.col("n").alias(f"{k}_n"), F.col("b").alias(f"{k}_b")))
            df = df.join(side, h == F.col(f"{k}_"), "left").fillna(0, [f"{k}_n", f"{k}_b"])
            df = df.withColumn(f"{k}_count", F.log1p(f"{k}_n")).withColumn(f"{k}_rate", self.rate(f"{k}_n", f"{k}_b")).drop(f"{k}_", f"{k}_n", f"{k}_b")
        return df

    def score(self) -> Column:
        """Probability of `block`."""
        z = F.lit(self.base)
        for tree in self.trees:
            z = z + _case(tree)
        return 1 / (1 + F.exp(-z))


def _case(node: dict) -> Column:
    if "value" in node:
        return F.lit(float(node["value"]))
    return F.when(F.col(node["feature"]) <= F.lit(node["edge"]), _case(node["left"])).otherwise(_case(node["right"]))


def fit(spark: SparkSession, labelled: DataFrame, rows: int = TRAIN_ROWS, rounds: int = ROUNDS, depth: int = DEPTH) -> Model:
    """Trees from (url, host, path, block): at most `rows` rows, those of the least URL hashes. No labelled rows: a model that allows all."""
    keep = labelled.withColumn("h_", F.xxhash64("url")).orderBy("h_", "url", "block").limit(rows)
    scratch = Scratch(spark, "urls")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "host"), F.lit(FOLDS)).alias("fold")
    train = scratch.table(lexical(keep).select("block", fold, F.array(*[F.struct(h.alias("suffix"), F.lit(k).alias("kind")) for k, h in suffixes().items()]).alias("s"), *LEXICAL, F.monotonically_increasing_id().alias("r")), "train")
    model = Model()
    total = train.agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("b")).first()
    if not total["n"]:
        model.base = -1.0
        return model
    p = min(max(total["b"] / total["n"], 1e-3), 1 - 1e-3)
    model.mean, model.base = p, math.log(p / (1 - p))
    each = train.select("r", "fold", "block", F.explode("s").alias("x")).select("r", "fold", "block", "x.*")
    by_fold = scratch.table(each.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("b")), "folds")
    model.suffixes = scratch.table(by_fold.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), "suffixes")
    # a training row does without the rows of its own host's fold
    others = by_fold.join(F.broadcast(model.suffixes.select("suffix", F.col("n").alias("n_"), F.col("b").alias("b_"))), "suffix").select("suffix", "fold", (F.col("n_") - F.col("n")).alias("n"), (F.col("b_") - F.col("b")).alias("b"))
    told = each.join(F.broadcast(others), ["suffix", "fold"]).groupBy("r").agg(*[F.max(F.when(F.col("kind") == k, v)).alias(f"{k}_{c}") for k in SUFFIXES for c, v in (("count", F.log1p("n")), ("rate", model.rate("n", "b")))])
    rows_ = scratch.table(train.drop("s", "fold").join(told, "r"), "rows")
    cuts = rows_.agg(*[F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 10_000).alias(f) for f in FEATURES]).first()
    model.edges = {f: sorted(set(cuts[f])) for f in FEATURES}
    # equal rows of bins are one row with a weight
    bins = [F.expr(f"size(filter(array({','.join(f'{e!r}D' for e in model.edges[f]) or 'cast(null as double)'}), e -> `{f}` > e))").alias(f"bin_{f}") for f in FEATURES]
    binned = rows_.select("block", *FEATURES, *bins).groupBy(*[f"bin_{f}" for f in FEATURES]).agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("b"), *[F.first(f).alias(f) for f in FEATURES])
    binned = scratch.table(binned, "binned")
    for _ in range(rounds):
        model.trees.append(_grow(binned, model.score(), model.edges, depth))
    scratch.drop(train, by_fold, rows_, binned)
    return model


def _grow(binned: DataFrame, score: Column, edges: dict[str, list[float]], depth: int) -> dict:
    """One tree. Leaves hold the rate times the Newton step."""
    root: dict = {"value": 0.0}
    open_ = [root]
    for _ in range(depth):
        if not open_:
            break
        number = {id(n): i for i, n in enumerate(open_)}

        def place(node: dict) -> Column:
            if "feature" not in node:
                return F.lit(number.get(id(node), -1))  # noqa: B023
            return F.when(F.col(node["feature"]) <= F.lit(node["edge"]), place(node["left"])).otherwise(place(node["right"]))  # noqa: B023

        g = binned.withColumn("p_", score).withColumn("node", place(root)).where("node >= 0")
        g = g.select("node", (F.col("b") - F.col("n") * F.col("p_")).alias("g"), (F.col("n") * F.col("p_") * (1 - F.col("p_"))).alias("h"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("bin")) for f in FEATURES])).alias("x"))
        sums = g.groupBy("node", "x.f", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # nodes x features x bins at most
        nxt = []
        for i, node in enumerate(open_):
            mine = sorted(((r["f"], r["bin"], r["g"], r["h"]) for r in sums if r["node"] == i))
            one = [r for r in mine if r[0] == FEATURES[0]]
            gt, ht = sum(r[2] for r in one), sum(r[3] for r in one)
            node["value"] = RATE * gt / (ht + RIDGE)
            best: tuple = (1e-6,)
            for f in FEATURES:
                gl = hl = 0.0
                for _, b, gg, hh in (r for r in mine if r[0] == f):
                    gl, hl = gl + gg, hl + hh
                    if b < len(edges[f]) and hl > 1e-3 and ht - hl > 1e-3:
                        gain = gl * gl / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt * gt / (ht + RIDGE)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, b, gl, hl)
            if len(best) > 1:
                _, f, b, gl, hl = best
                del node["value"]
                node |= {"feature": f, "edge": edges[f][b], "left": {"value": RATE * gl / (hl + RIDGE)}, "right": {"value": RATE * (gt - gl) / (ht - hl + RIDGE)}}
                nxt += [node["left"], node["right"]]
        open_ = nxt
    return root


def judge(spark: SparkSession, pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, model: Model | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row: the rule's verdict, else block where the trees give 0.5 or more.

    Without a model, the trees are fitted on the URLs that rules label. Nulls: a null url, or one without ://, has empty host and path,
    fits no rule and is scored by the trees; a null id is kept. Repeated rows are each judged. Empty tables give no rows."""
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("by_rule", verdict)
    if model is None:
        model = fit(spark, urls.where("by_rule IS NOT NULL").select("url", "host", "path", (F.col("by_rule") == "block").cast("int").alias("block")))
    scored = model.with_suffixes(lexical(urls)).withColumn("score", model.score())
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), F.round("score", 6).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, by_rule: what the rules alone say of every URL."""
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"))
    return urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))


RULES_ORACLE = r"""
WITH r(rule, by_rule, n, h, p) AS (SELECT rule, v, length(rule), split_part(rule, '/', 1), substr(rule, instr(rule, '/')) FROM (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')) t(rule, v)),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cut)
SELECT page_id, host, path, (SELECT max_by(rule, n) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule, (SELECT max_by(by_rule, n) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS by_rule
FROM u
"""
