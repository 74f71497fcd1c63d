"""URL filters: rules by host and path, then logistic regression on hashed character n-grams.

Everything runs in DataFrame and SQL functions. The model is fitted from a small
labelled URL table: full-batch gradient descent for logistic regression, kept in
its dual form (one coefficient a labelled row, margins through the Gram matrix of
the n-gram sets), so that one SQL expression runs all iterations over one row.
The weights of the hashed n-grams follow from the coefficients; there are ``dims``
of them whatever the input, and they reach the scan as one constant array.

Defined results: a null url, or one without ``://``, has empty host and path and
goes to the model (whose features are then the markers of empty strings); repeated
rows are judged each; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, stored

#: Fixed by the query's contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Rules up to this number are matched as constants inside the scan; more are joined by host suffix.
MAX_CONSTANT_RULES = 64
#: The most labelled rows that a model is fitted on (its Gram matrix has the square of it).
MAX_LABELLED = 512

#: Words of the labelled table's hosts, by kind. Every kind of site is made of the same modifiers, endings and plain paths, so that
#: neither the form of an address nor a common path tells its label.
_BLOCK_WORDS = {
    "gambling": ("casino", "poker", "bets", "slots", "jackpot", "lottery"),
    "adult": ("adult", "xxx", "porn", "cams", "escort"),
    "pharmacy": ("pills", "viagra", "pharmacy", "meds"),
    "adverts": ("ads", "banner", "track", "click", "popup"),
    "spam": ("spam", "backlinks", "linkfarm", "bulkmail"),
    "piracy": ("warez", "torrent", "crack", "keygen"),
    "loans": ("payday", "loans", "winner", "prize"),
}
_ALLOW_WORDS = {
    "reading": ("library", "journal", "novels", "poems", "letters", "stories", "grammar", "spelling", "history"),
    "public": ("museum", "university", "council", "station", "hospital", "school", "church", "bridge", "market"),
    "home": ("garden", "recipes", "kitchen", "weather", "mother", "father", "together", "morning", "winter"),
    "news": ("news", "northern", "thoughts", "nation", "herald", "country", "village", "another", "tonight"),
    "craft": ("pottery", "weaving", "timber", "leather", "painting", "theatre", "concert", "orchestra", "gallery"),
    "science": ("physics", "theory", "rivers", "mountains", "geology", "biology", "chemistry", "forest", "island"),
    "software": ("docs", "manual", "compiler", "notation", "research", "database", "threads", "network", "numbers"),
}
_MODIFIERS = ("free", "best", "cheap", "online", "hot", "top", "my", "the")
_PATHS = ("/", "/en/204", "/article/history.html", "/de/12/", "/guide/start", "/index.html", "/fr/7.html", "/es/391", "/2044/page/3")
_BLOCK_PATHS = ("/win/jackpot-now", "/porn/free-clips", "/download/keygen.exe", "/buy/viagra-online")
_ALLOW_PATHS = ("/library/maps", "/recipes/bread.html", "/docs/manual", "/weather/today")


def labelled_addresses() -> list[tuple[str, int, bool]]:
    """The small labelled table as (url, label, held out): 190 invented addresses, every fourth held out from fitting.

    Two in three are harmless: an address of unknown parts is one to allow.
    """
    out = []
    for kinds, telling, label in ((_BLOCK_WORDS, _BLOCK_PATHS, 1), (_ALLOW_WORDS, _ALLOW_PATHS, 0)):
        words = [(w, kind[(i + 1) % len(kind)]) for kind in kinds.values() for i, w in enumerate(kind)]
        for k, (w, other) in enumerate(words):
            m = _MODIFIERS[k % len(_MODIFIERS)]
            for j, name in enumerate((w, f"{m}-{w}") if k % 2 else (f"{w}-{other}", f"{w}{m}")):
                n = 2 * k + j
                path = telling[k % len(telling)] if n % 5 == 4 else _PATHS[n % len(_PATHS)]
                prefix = ("", "www.", "m.", "blog.")[(k // 2 + j) % 4]
                out.append((f"http://{prefix}{name}.example.{('com', 'org', 'net')[n % 3]}{path}", label, n % 4 == k // 2 % 4))
    return out


def labelled_urls(spark: SparkSession, held_out: bool = False) -> DataFrame:
    """The labelled table's rows to fit on, or those held out: url, label (1: block)."""
    return spark.createDataFrame([(u, y) for u, y, held in labelled_addresses() if held == held_out], "url string, label int")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(F.coalesce(found, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ngrams(host: Column, path: Column, dims: int, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """The set of hashed character n-grams, those of host and path kept apart."""

    # characters are split once and bound by the outer transform: substring() would scan a long address anew for every n-gram
    def of(text: Column, mark: str, n: int) -> Column:
        def hashed(chars: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(1)))
            return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.array_join(F.slice(chars, i, n), "")), F.lit(dims)).cast("int"))

        return F.element_at(F.transform(F.array(F.split(F.concat(F.lit("^"), text, F.lit("$")), "")), hashed), 1)

    return F.array_distinct(F.concat(*(of(text, mark, n) for text, mark in ((host, "h"), (path, "p")) for n in sizes)))


def fit(labelled: DataFrame, dims: int = 1024, iterations: int = 300, rate: float = 7.0, decay: float = 0.0005) -> list[float]:
    """Weights of the hashed n-grams; the last is the bias. From at most MAX_LABELLED rows, by hash order.

    Rows without a url or label are left out; with no rows left, or rows of one label, all weights are 0 but the bias.
    """
    rows = labelled.select(F.col("url").cast("string").alias("u"), F.col("label").cast("double").alias("y")).where("u is not null and y is not null")
    rows = rows.orderBy(F.xxhash64("u"), "u", "y").limit(MAX_LABELLED).select("y", ngrams(host_of(F.col("u")), path_of(F.col("u")), dims).alias("x"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("rows"))
    y, x = lambda r: r["y"], lambda r: r["x"]
    gram = F.transform("rows", lambda a: F.transform("rows", lambda b: F.size(F.array_intersect(x(a), x(b))) / F.sqrt((F.size(x(a)) * F.size(x(b))).cast("double")) + 1.0))

    def step(alpha: Column, _: Column) -> Column:
        def moved(row: Column, i: Column) -> Column:
            margin = F.aggregate(F.zip_with(F.element_at("gram", i + 1), alpha, lambda k, a: k * a), F.lit(0.0), lambda s, v: s + v)
            return F.element_at(alpha, i + 1) * (1 - rate * decay / 10) + rate / F.size("rows") * (y(row) - 1 / (1 + F.exp(-margin)))

        return F.transform("rows", moved)

    # written, so that the Gram matrix is made once and not inside every iteration
    fitted = stored(one.withColumn("gram", gram), "url-gram").withColumn("alpha", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), F.transform("rows", lambda r: F.lit(0.0)), step))
    each = stored(fitted.select("rows", "alpha"), "url-alpha").select(F.explode(F.arrays_zip("rows", "alpha")).alias("r")).select(F.col("r.alpha").alias("a"), F.col("r.rows.x").alias("x"))
    grams = each.select(F.explode(F.transform("x", lambda i: F.struct(i.alias("i"), (F.col("a") / F.sqrt(F.size("x").cast("double"))).alias("w")))).alias("g")).select("g.*")
    model = grams.groupBy("i").agg(F.sum("w").alias("w")).unionByName(each.agg(F.lit(dims).alias("i"), F.coalesce(F.sum("a"), F.lit(0.0)).alias("w")))
    weights = [0.0] * (dims + 1)
    for i, w in model.collect():  # dims + 1 rows at most
        weights[i] = round(w, 9)
    return weights


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """The probability that the address is one to block."""
    constant = F.array(*(F.lit(w) for w in weights))
    grams = ngrams(host, path, len(weights) - 1)
    margin = F.aggregate(grams, F.lit(0.0), lambda s, i: s + F.element_at(constant, i + 1)) / F.sqrt(F.size(grams).cast("double")) + F.lit(weights[-1])
    return 1 / (1 + F.exp(-margin))


def _constant_rules(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _joined_rules(pages: DataFrame, rules) -> DataFrame:
    """The same by joining each host's suffixes to the rules' hosts; for long lists. Repeated pages stay apart by the url."""
    spark = pages.sparkSession
    listed = spark.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in rules], "rule_host string, rule_path string, rule string, verdict string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    urls = pages.select("host", "path").distinct()
    hits = urls.withColumn("rule_host", F.explode(suffixes)).join(listed, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("hit"))
    return pages.join(best, ["host", "path"], "left")


def url_filter(pages: DataFrame, weights: list[float], rules=RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score. A rule's verdict goes before the model's."""
    url = F.col(url_col).cast("string")
    split = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    if len(rules) <= MAX_CONSTANT_RULES:
        split = split.withColumn("hit", _constant_rules(F.col("host"), F.col("path"), rules))
    else:
        split = _joined_rules(split, rules)
    scored = split.withColumn("score", F.round(score(F.col("host"), F.col("path"), weights), 6))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select(id_col, "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter(pages, fit(labelled_urls(spark)))
