"""URL filter: host and path rules over gradient-boosted trees on lexical features.

DataFrame and Spark ML only.  Features: lengths, depth, digit ratios, entropies, parameter counts, hyphens, and block rates of host
suffixes (the last label, the last two) as counted over labelled URLs; no words.  Rates of a training row come from the other
folds of hosts, so that trees do not see a row's own label.  The labelled URLs used by default are made here by a seeded rule from
shapes of hosts and paths; words are drawn from syllables, and their number is a parameter.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and
gets the trees' verdict on empty features.  Repeated rows are judged alike; an empty table gives
an empty result.  Only the id and url columns are read.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, start of path); the longest that fits a url decides.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# What names of labelled urls are made of, and what their hosts end in.
SYLLABLES = "ba co di fu ge ho ja ki lu mo na pe ri so tu va wo ze cra plo stri ther ling ward ton ber gen land mark field".split()
PLAIN_ENDS = "com com com org org net edu gov io co.uk org.uk de fr info".split()
BAD_ENDS = "com com com org net net info xyz top click biz win".split()
FEATURES = (
    "url_len host_len path_len depth digit_ratio host_digit_ratio entropy host_entropy n_params longest_param host_labels host_hyphens "
    "longest_label end_rate two_rate"
).split()
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(rules, host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(verdict, rule); null if none does."""
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    return F.coalesce(
        *(
            F.when(
                ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
                F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")),
            )
            for v, h, p in by_length
        )
    )


def labelled_urls(spark: SparkSession, n: int = 3000, seed: int = 11, syllables: list[str] = SYLLABLES) -> DataFrame:
    """``url, label`` (1: to block), by a seeded rule."""

    def draw(salt: int, of: int) -> Column:
        return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(of)).cast("int")

    def pick(some, salt: int) -> Column:
        return F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in some)), draw(salt, len(some)) + 1)

    def word(salt: int, most: int = 4) -> Column:
        parts = [F.when(draw(salt + k, 3) > 0, pick(syllables, salt + 10 + k)).otherwise("") for k in range(most - 1)]
        return F.concat(pick(syllables, salt + 20), *parts)

    def random_signs(salt: int, least: int, most: int) -> Column:
        return F.substring(F.sha2(F.concat_ws(":", F.col("id"), F.lit(seed), F.lit(salt)), 256), F.lit(1), draw(salt, most - least) + least)

    def segment(salt: int) -> Column:
        dashed = F.concat_ws("-", word(salt + 100, 3), word(salt + 130, 3), word(salt + 160, 3))
        return pick([word(salt + 190), word(salt + 220, 2), dashed, draw(salt, 100_000).cast("string"), draw(salt + 1, 999).cast("string"), (draw(salt + 2, 30) + 1995).cast("string")], salt + 3)

    def path(salt: int, most: int) -> Column:
        parts = F.array(*(F.concat(F.lit("/"), segment(salt + 300 * k)) for k in range(1, most + 1)))
        tail = pick(["", "", "", "/", ".html", ".php", ".pdf"], salt + 2)
        return F.concat(F.array_join(F.slice(parts, 1, draw(salt + 1, most) + 1), ""), tail)

    bad = draw(1, 2) == 1
    short = F.substring(word(2000), F.lit(1), draw(2040, 4) + 1)
    joined = F.concat_ws("-", word(2050, 3), word(2080, 3))
    plain_name = F.when(draw(2110, 14) == 0, joined).otherwise(pick([word(2120), word(2150), word(2180), short, F.concat(word(2210), word(2240, 2))], 2270))
    below = pick(["", "", "", "www.", "www.", "m.", "blog.", "docs.", "news.", F.concat(word(2300, 2), F.lit(".")), F.concat(F.lit("www."), word(2330, 2), F.lit(".")), F.concat(F.lit("m."), word(2360, 2), F.lit("."))], 2390)
    plain_host = F.concat(below, plain_name, F.lit("."), pick(PLAIN_ENDS, 2400))
    number = F.when(draw(3000, 3) == 0, draw(3001, 10000).cast("string")).otherwise("")
    farm = F.concat_ws("-", word(3010, 2), F.concat(word(3040, 2), number), F.when(draw(3070, 3) == 0, word(3080, 2)))
    drawn = F.concat(random_signs(3110, 10, 24), F.when(draw(3111, 2) == 0, word(3120, 2)).otherwise(""))
    deep = F.concat_ws(".", random_signs(3150, 3, 9), word(3160, 2), random_signs(3190, 4, 8), F.concat(word(3200, 2), draw(3230, 99).cast("string")))
    long_name = F.concat(*(word(3300 + 30 * k, 3) for k in range(4)), number)
    bad_name = pick([farm, farm, farm, farm, farm, drawn, deep, long_name], 3500)
    numbers = F.concat_ws(".", *(draw(3520 + k, 255).cast("string") for k in range(4)))
    bad_host = F.when(draw(3540, 14) == 0, F.concat(numbers, pick(["", ":8080", ":81"], 3541))).otherwise(
        F.concat(pick(["", "", "", "www.", "m.", "blog.", F.concat(word(3550, 2), F.lit("."))], 3580), bad_name, F.lit("."), pick(BAD_ENDS, 3581))
    )
    few = pick(["", "", "", "", "#top", "?page=2", "?id=17&lang=x", "?utm_source=feed", F.concat(F.lit("?q="), word(3600, 3))], 3630)
    many = F.concat(F.lit("?id="), draw(3640, 10**9).cast("string"), F.lit("&c="), random_signs(3641, 16, 40), F.lit("&a="), draw(3642, 10**6).cast("string"), pick(["&s=1", "", "&r=http%3A%2F%2F", "&z=9&y=8&x=7"], 3643))
    laden = F.concat(plain_host, F.lit("/"), word(3650, 2), many)
    by_path = draw(3700, 8) == 0  # a host like others, with what is passed on in its parameters
    whole = F.when(~bad, F.concat(plain_host, path(4000, 4), few)).when(by_path, laden)
    whole = whole.otherwise(F.concat(bad_host, path(8000, 3), F.when(draw(3710, 3) == 0, many).otherwise(few)))
    return spark.range(n).select(F.concat(pick(["http://", "https://"], 3720), whole).alias("url"), bad.cast("double").alias("label"))


def last_label(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def last_two(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def rates(labelled: DataFrame, part: Column, least: int = 8, most: int = 400) -> dict[str, float]:
    """Smoothed block rates of the parts of labelled hosts.

    Collected to the driver: bounded by ``most`` and by the labelled set itself.
    """
    rows = (
        labelled.select(F.explode(part).alias("part"), "label")
        .groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))
        .where(F.col("n") >= least)
        .orderBy(F.col("n").desc(), "part")
        .limit(most)
        .collect()
    )
    return {r["part"]: (r["bad"] + 1.0) / (r["n"] + 2.0) for r in rows}


def looked_up(table: dict[str, float], key: Column) -> Column:
    if not table:
        return F.lit(0.5)
    pairs = [F.lit(x) for item in sorted(table.items()) for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(0.5))


def entropy_of(text: Column) -> Column:
    """In bits a character; characters are counted as they stand."""
    length = F.greatest(F.char_length(text), F.lit(1))
    share = lambda c: (F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))) / length
    signs = F.filter(F.array_distinct(F.split(text, "")), lambda c: F.length(c) > 0)
    return F.aggregate(signs, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def with_features(urls: DataFrame, rates_of: list[tuple[Column, dict, dict]]) -> DataFrame:
    """The columns ``FEATURES``; the first of ``rates_of`` whose condition holds gives the rates of suffixes."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = F.col("host"), F.col("path")
    labels = F.split(host, r"\.")
    rate = lambda n, key: F.coalesce(*(F.when(c[0], looked_up(c[n], key)) for c in rates_of))
    return urls.withColumns(
        {
            "url_len": F.char_length(url).cast("double"),
            "host_len": F.char_length(host).cast("double"),
            "path_len": F.char_length(path).cast("double"),
            "depth": F.regexp_count(path, F.lit("/")).cast("double"),
            "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.char_length(url), F.lit(1)),
            "host_digit_ratio": F.regexp_count(host, F.lit("[0-9]")) / F.greatest(F.char_length(host), F.lit(1)),
            "entropy": entropy_of(url),
            "host_entropy": entropy_of(host),
            "n_params": F.regexp_count(url, F.lit("[?&]")).cast("double"),
            "longest_param": F.array_max(F.transform(F.split(F.regexp_extract(url, r"\?(.*)", 1), "[&=]"), F.char_length)).cast("double"),
            "host_labels": F.size(labels).cast("double"),
            "host_hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
            "longest_label": F.array_max(F.transform(labels, F.char_length)).cast("double"),
            "end_rate": rate(1, last_label(host)),
            "two_rate": rate(2, last_two(host)),
        }
    )


def parts(df: DataFrame) -> DataFrame:
    return df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})


class UrlFilter:
    """Trees and suffix statistics fitted to labelled urls (``url, label``)."""

    def __init__(self, labelled: DataFrame, rules=RULES, trees: int = 20, depth: int = 4):
        known = parts(labelled.select("url", F.col("label").cast("double").alias("label")).where("url is not null"))
        known = known.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS))).coalesce(1).cache()
        self.rules = rules
        counted = lambda rows: (rates(rows, F.array(last_label(F.col("host")))), rates(rows, F.array(last_two(F.col("host")))))
        folds = [(F.col("fold") == k, *counted(known.where(F.col("fold") != k))) for k in range(FOLDS)]
        self.rates = [(F.lit(True), *counted(known))]
        boosted = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, seed=5)
        stages = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), boosted])
        rows = with_features(known, folds).coalesce(1).cache()
        self.model: PipelineModel = stages.fit(rows)
        rows.unpersist()
        known.unpersist()

    def judge(self, pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
        """``page_id, host, path, rule, verdict, method_verdict, score`` for every row."""
        urls = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
        scored = self.model.transform(with_features(urls, self.rates))
        fits = first_rule(self.rules, F.col("host"), F.col("path"))
        method = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
        return scored.select(
            "page_id",
            "host",
            "path",
            fits.getField("rule").alias("rule"),
            F.coalesce(fits.getField("verdict"), method).alias("verdict"),
            method.alias("method_verdict"),
        )


_fitted: dict[str, UrlFilter] = {}


def default_filter(spark: SparkSession) -> UrlFilter:
    """Fitted once in an application."""
    key = spark.sparkContext.applicationId
    if key not in _fitted:
        _fitted.clear()
        _fitted[key] = UrlFilter(labelled_urls(spark))
    return _fitted[key]


def ruled(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row by the rules alone; rule and verdict are null where none fits."""
    urls = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    fits = first_rule(rules, F.col("host"), F.col("path"))
    return urls.select("page_id", "host", "path", fits.getField("rule").alias("rule"), fits.getField("verdict").alias("verdict"))
