"""URL filters: longest-match rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import lower_ascii, written


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and a path beginning, as in ``example.com/en/``; it also holds for the host's subdomains."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: The rules of the registered query.
RULES = (
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
)
#: Labelled URLs that the trees are fitted on at most: half of them of either kind, chosen by hash.
TRAINING_URLS = 200_000
#: Hosts are dealt to so many folds; a labelled URL's suffix rates come from the other folds.
FOLDS = 5
ROUNDS, DEPTH, SEED = 12, 4, 17
#: Labels that every suffix is given beforehand, in the proportion of all labels.
SMOOTHING = 20.0
FEATURES = (
    "url_length host_length path_length query_length host_depth path_depth digit_ratio letter_ratio symbol_ratio entropy "
    "parameters hyphens has_fragment secure top_rate domain_rate folder_rate"
).split()


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``ruled`` (its verdict): of the rules that fit, the longest."""
    pages = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ordered = sorted(rules, key=lambda r: -len(r.text))

    def fits(rule: Rule) -> Column:
        return ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)

    def first(value) -> Column:
        found = F.lit(None).cast("string")
        for rule in reversed(ordered):
            found = F.when(fits(rule), F.lit(value(rule))).otherwise(found)
        return found

    return pages.withColumns({"rule": first(lambda r: r.text), "ruled": first(lambda r: r.verdict)})


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character; the characters are bound once, so the text is split once."""

    def of(chars: Column) -> Column:
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))

    return F.transform(F.array(F.split(text, "")), of)[0]


def lexical_features(pages: DataFrame) -> DataFrame:
    """Lengths, depths, ratios, entropy and parameter counts of a URL, and the suffixes whose statistics are learnt."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return pages.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "query_length": F.length(query).cast("double"),
            "host_depth": _count(F.col("host"), r"\."),
            "path_depth": _count(F.col("path"), "/"),
            "digit_ratio": _count(url, "[0-9]") / n,
            "letter_ratio": _count(url, "[A-Za-z]") / n,
            "symbol_ratio": _count(url, "[^A-Za-z0-9]") / n,
            "entropy": _entropy(url),
            "parameters": _count(query, "[^&=]+="),
            "hyphens": _count(F.col("host"), "-"),
            "has_fragment": url.contains("#").cast("double"),
            "secure": url.startswith("https:").cast("double"),
            "top": F.substring_index("host", ".", -1),
            "domain": F.substring_index("host", ".", -2),
            "folder": F.regexp_extract("path", "^/([^/]*)/", 1),
            "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)),
        }
    )


def _with_rates(pages: DataFrame, labelled: DataFrame, suffix: str, prior: float) -> DataFrame:
    """Adds ``<suffix>_rate``: the share of blocked among the labelled URLs of a suffix on hosts of other folds, drawn towards the share of all.

    A URL's own label, and those of its host, are thus no part of its rate; an unlabelled URL's rate comes from all folds.
    """
    of = [F.sum("label").alias("blocked"), F.count("label").alias("seen")]
    by_fold = labelled.groupBy(suffix, "fold").agg(*of)
    whole = by_fold.groupBy(suffix).agg(F.sum("blocked").alias("_blocked"), F.sum("seen").alias("_seen"))
    own = by_fold.withColumn("_learnt", F.lit(True)).withColumnsRenamed({"blocked": "_own_blocked", "seen": "_own_seen"})
    rows = pages.join(whole, suffix, "left").join(own, [suffix, "fold", "_learnt"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocked, seen = zero("_blocked") - zero("_own_blocked"), zero("_seen") - zero("_own_seen")
    rate = (blocked + SMOOTHING * prior) / (seen + SMOOTHING)
    return rows.withColumn(f"{suffix}_rate", rate).drop("_blocked", "_seen", "_own_blocked", "_own_seen")


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", training_urls: int = TRAINING_URLS, learn_from: Column | None = None
) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict``, ``score``: the longest fitting rule's verdict, else that of the trees.

    The URLs that a rule fits are the labelled ones; with ``learn_from``, an expression over ``host``, ``path`` and ``url``, only those for which it is true
    are learnt from. The suffix statistics cover all of them, out of fold; the trees are fitted on
    about ``training_urls`` at most, taken by hash. With labels of one kind only there is nothing to learn: the
    others get that kind, and ``allow`` if there are no labels at all. A URL without ``://`` has an empty host and path, which no
    rule fits; null, empty and repeated URLs are judged like any other. ``score`` is null where no trees could be fitted.
    """
    rows = with_rules(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), rules)
    label = F.when(F.col("ruled") == "block", 1.0).when(F.col("ruled") == "allow", 0.0)
    rows = written(lexical_features(rows).withColumn("label", label), "urls")
    known = F.col("label").isNotNull() if learn_from is None else F.col("label").isNotNull() & F.coalesce(learn_from, F.lit(False))
    rows = rows.withColumn("_learnt", known)
    labelled = rows.where("_learnt")
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if blocked in (0, n):
        only = "block" if n and blocked else "allow"
        return rows.select("id", "host", "path", "rule", F.coalesce("ruled", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    for suffix in ("top", "domain", "folder"):
        rows = _with_rates(rows, labelled, suffix, blocked / n)
    rows = written(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).drop(*FEATURES), "url-features")
    scale = 1 << 20
    share = lambda kind: F.lit(int(scale * min(1.0, training_urls / 2 / kind)))
    part = F.when(F.col("label") == 1.0, share(blocked)).otherwise(share(n - blocked))
    # of a kind that is a thousand times too many, the first thousandth of the hashes; a kind has a URL in it unless it has very few
    chosen = rows.where(F.col("_learnt") & (F.pmod(F.xxhash64("url", "id"), F.lit(scale)) < F.greatest(part, F.lit(1))))
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, seed=SEED)
    model = trees.fit(chosen.select("features", "label"))
    scored = model.transform(rows)
    verdict = F.coalesce("ruled", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    return scored.select("id", "host", "path", "rule", verdict.alias("verdict"), vector_to_array("probability")[1].alias("score"))
