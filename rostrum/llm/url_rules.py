"""URL filtering by association rules, with DataFrame and SQL functions alone.

Listed rules (host, path, verdict) decide the URLs they fit and so label them. Spark's
FP-growth mines token combinations that go with a verdict; rules short of support or
confidence, and rules that a shorter one makes needless, go. What would multiply rules
without changing a verdict is not mined: a token that always goes with one verdict is a rule
by itself, and tokens that always occur together are mined as one. A URL that no listed rule
fits is judged by the mined rules it contains, which an inverted index from each rule's
rarest token finds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rostrum.llm.common import lower_ascii, table
from rostrum.llm.registry import query
from rostrum.session import materialize

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.7
DEFAULT = "allow"


def _before(text: Column, marks: str) -> Column:
    """The text up to the first of the marks, or all of it."""
    return F.regexp_extract(text, f"^([^{marks}]*)", 1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for a missing URL."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = _before(rest, "/?#")
    path = _before(F.substring(rest, F.length(host) + 1, F.length(rest)), "?#")
    return lower_ascii(host), path


def split_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``__url``, ``host`` and ``path``."""
    named = pages.withColumn("__url", F.col(f"`{url}`"))
    host, path = host_and_path(F.col("__url"))
    return named.withColumns({"host": host, "path": path})


def listed_rule(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest listed rule that fits ``host`` and ``path``, and its verdict; else NULL.

    A rule fits its host and all subdomains if the path starts with the rule's path. Of
    equally long rules the first in order of host and path counts.
    """
    name = verdict = None
    for host, path, said in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = (
            (F.col("host") == host) | F.col("host").endswith("." + host)
        ) & F.col("path").startswith(path)
        shown = F.lit(host + path)
        name = F.when(fits, shown) if name is None else name.when(fits, shown)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    missing = F.lit(None).cast("string")
    return (missing, missing) if name is None else (name, verdict)


def url_tokens() -> Column:
    """Tokens of a URL's outline, from ``__url``, ``host`` and ``path``.

    Scheme, top level and registered domain, first host label, first path segment, shape
    of the rest of the path (digits as one 0, letters as they are) and the kind of what
    follows the path. An empty host or path gives no token of its own.
    """
    labels = F.split("host", r"\.")
    segments = F.split("path", "/")
    first = F.coalesce(F.try_element_at(segments, F.lit(2)), F.lit(""))
    rest = F.array_join(F.slice(segments, 3, F.greatest(F.size(segments), F.lit(1))), "/")
    shape = F.regexp_replace(rest, "[0-9]+", "0")
    follows = F.regexp_extract(F.col("__url"), r"([?#][^=&]*)", 1)
    known = F.col("host") != ""
    return F.array_compact(
        F.array(
            F.when(known, F.concat(F.lit("scheme="), _before(F.col("__url"), ":"))),
            F.when(known, F.concat(F.lit("top="), F.element_at(labels, -1))),
            F.when(F.size(labels) > 1, F.concat(F.lit("domain="), F.array_join(F.slice(labels, -2, 2), "."))),
            F.when(F.size(labels) > 2, F.concat(F.lit("label="), F.element_at(labels, 1))),
            F.when(first != "", F.concat(F.lit("segment="), first)),
            F.when(F.size(segments) > 2, F.concat(F.lit("rest="), shape)),
            F.when(follows != "", F.concat(F.lit("tail="), follows)),
        )
    )


def part_tokens() -> Column:
    """A token of every host label but the top level, path segment and query key.

    The first path segment is told apart from later ones. Empty parts give no token.
    """
    labels = F.split("host", r"\.")
    segments = F.split("path", "/")
    asked = F.regexp_extract(F.col("__url"), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(asked, "&"), lambda pair: _before(pair, "="))
    later = F.slice(segments, 3, F.greatest(F.size(segments), F.lit(1)))

    def named(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda part: part != ""), lambda part: F.concat(F.lit(kind), part))

    return F.array_distinct(
        F.concat(
            named("label=", F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))),
            named("segment=", F.slice(segments, 2, 1)),
            named("later=", later),
            F.when(F.col("host") != "", named("key=", keys)).otherwise(F.array().cast("array<string>")),
        )
    )


def _token_classes(labelled: DataFrame, total: int, min_support: float) -> DataFrame:
    """Stored ``token, support, low, high, class`` of the tokens that have the support.

    ``low`` and ``high`` are the first and last verdict of the token's rows. Tokens of the
    same rows have the same class, the first of them.
    """
    row = F.monotonically_increasing_id()
    marked = labelled.select(row.alias("row"), "verdict", F.explode("tokens").alias("token"))
    found = marked.groupBy("token").agg(
        F.count("*").alias("n"),
        F.min("verdict").alias("low"),
        F.max("verdict").alias("high"),
        F.bit_xor(F.xxhash64("row")).alias("rows"),
        F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("others"),
    )
    frequent = materialize(found.filter(F.col("n") >= min_support * total), "tokens")
    classes = frequent.groupBy("n", "rows", "others").agg(F.min("token").alias("class"))
    return materialize(
        frequent.join(classes, ["n", "rows", "others"]).select(
            "token", (F.col("n") / max(1, total)).alias("support"), "low", "high", "class"
        ),
        "classes",
    )


def _of_tokens(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rules on classes as rules on tokens: one for every choice of a token of each class."""
    members = tokens.groupBy("class").agg(F.collect_list("token").alias("members"))
    named = rules.withColumn("rule", F.monotonically_increasing_id())
    listed = (
        named.select("rule", "verdict", "confidence", "support", F.explode("tokens").alias("class"))
        .join(members, "class")
        .groupBy("rule", "verdict", "confidence", "support")
        .agg(F.collect_list("members").alias("lists"))
    )
    choices = F.aggregate(
        "lists",
        F.array(F.array().cast("array<string>")),
        lambda chosen, own: F.flatten(
            F.transform(chosen, lambda some: F.transform(own, lambda one: F.array_append(some, one)))
        ),
    )
    return listed.withColumn("tokens", F.explode(choices)).select(
        F.array_sort("tokens").alias("tokens"), "verdict", "confidence", "support"
    )


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Rules from rows with ``tokens`` (distinct strings) and ``verdict``.

    Columns ``rule_id, tokens, verdict, confidence, support, rarest``. A rule goes if a
    rule on fewer of its tokens has the same verdict and no less confidence. No labelled
    row gives no rule.
    """
    total = labelled.count()
    tokens = _token_classes(labelled, total, min_support)
    # Rules of a token that always goes with one verdict: no longer rule can be surer.
    sure = tokens.filter("low = high").select(
        F.array("token").alias("tokens"), F.col("low").alias("verdict"), F.lit(1.0).alias("confidence"), "support"
    )
    mixed = tokens.filter("low != high")
    # At most (tokens of a row) / min_support tokens are frequent.
    baskets = (
        labelled.select(F.monotonically_increasing_id().alias("row"), "verdict", F.explode("tokens").alias("token"))
        .join(F.broadcast(mixed.select("token", "class")), "token")
        .groupBy("row", "verdict")
        .agg(F.collect_set("class").alias("tokens"))
    )
    said = F.concat(F.lit("verdict="), F.col("verdict"))
    baskets = materialize(baskets.select(F.array_append("tokens", said).alias("items")), "baskets")
    some = max(1, baskets.count())
    support = min(1.0, min_support * total / some)
    model = FPGrowth(minSupport=support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(
        F.element_at("consequent", 1).startswith("verdict=")
    ).select(
        F.array_sort("antecedent").alias("tokens"),
        F.substring_index(F.element_at("consequent", 1), "=", -1).alias("verdict"),
        "confidence",
        (F.col("support") * some / max(1, total)).alias("support"),
    )
    rules = materialize(rules, "rules")
    short = rules.select(
        F.col("tokens").alias("fewer"), F.col("verdict").alias("same"), F.col("confidence").alias("no_less")
    )

    def needed(some: DataFrame, parts: DataFrame) -> DataFrame:
        needless = (
            parts.join(short, "fewer")
            .filter((F.col("same") == F.col("verdict")) & (F.col("no_less") >= F.col("confidence")))
            .select("tokens", "verdict")
            .distinct()
        )
        return some.join(needless, ["tokens", "verdict"], "left_anti")

    # Parts of a rule's tokens are looked up by equality: first those without one token,
    # which most rules fall to, then every proper part of the rules that are left.
    longer = rules.filter(F.size("tokens") > 1)
    less_one = longer.withColumn("left_out", F.explode("tokens")).withColumn(
        "fewer", F.expr("filter(tokens, t -> t != left_out)")
    )
    left = materialize(needed(rules, less_one), "rules")
    parts = left.filter(F.size("tokens") > 2).withColumn(
        "subset",
        F.expr("explode(sequence(1L, shiftleft(1L, size(tokens)) - 2))"),
    )
    parts = parts.withColumn("fewer", F.expr("filter(tokens, (t, i) -> getbit(subset, i) = 1)"))
    kept = materialize(_of_tokens(needed(left, parts), mixed).unionByName(sure), "rules")
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count()
    rarest = (
        kept.select("tokens", F.explode("tokens").alias("token"))
        .join(counts, "token")
        .groupBy("tokens")
        .agg(F.min(F.struct("count", "token")).getField("token").alias("rarest"))
    )
    return kept.join(rarest, "tokens")


def apply_rules(tokens: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The verdict of the best mined rule for each distinct ``tokens`` array.

    The best rule has the highest confidence, then support, then verdict; without any
    rule the default holds.
    """
    index = rules.select("rarest", F.col("tokens").alias("wanted"), "verdict", "confidence", "support")
    found = (
        tokens.withColumn("rarest", F.explode("tokens"))
        .join(index, "rarest")
        .filter(F.size(F.array_except("wanted", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.max(F.struct("confidence", "support", "verdict")).alias("best"))
    )
    return tokens.join(found, "tokens", "left").select(
        "tokens", F.coalesce(F.col("best.verdict"), F.lit(default)).alias("mined")
    )


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    key: str = "page_id",
    url: str = "url",
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    default: str = DEFAULT,
) -> DataFrame:
    """Key, ``host``, ``path``, ``rule`` and ``verdict`` of every row.

    ``rule`` is the listed rule that decided, NULL where the mined rules did. Rows with a
    missing key, a missing or odd URL and repeated rows are judged like others. Without a
    URL that a listed rule fits nothing is mined and the default holds.
    """
    urls = split_urls(pages.select(F.col(f"`{key}`"), F.col(f"`{url}`").alias("__raw")), "__raw")
    rule, verdict = listed_rule(rules)
    known = urls.withColumns(
        {"rule": rule, "listed": verdict, "tokens": F.array_sort(F.array_union(url_tokens(), part_tokens()))}
    ).drop("__raw", "__url")
    known = materialize(known, "urls")
    labelled = known.filter("listed IS NOT NULL").withColumnRenamed("listed", "verdict")
    mined = mine_rules(labelled, min_support, min_confidence)
    open_tokens = known.filter("listed IS NULL").select("tokens").distinct()
    judged = apply_rules(open_tokens, mined, default)
    # Few distinct token sets may stand for many rows; the join splits by skew.
    decided = known.filter("listed IS NOT NULL").withColumn("verdict", F.col("listed"))
    rest = known.filter("listed IS NULL").join(judged, "tokens").withColumn("verdict", F.col("mined"))
    columns = [f"`{key}`", "host", "path", "rule", "verdict"]
    return decided.select(columns).unionByName(rest.select(columns))


@query("op6_url_rules")
def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's URL."""
    return filter_urls(table(spark, sf_dir, "pages"))
