"""URL filters: host and path rules, and logistic regression on hashed character n-grams.

The model is trained by Spark ML on a small labelled table of URLs kept below; scoring runs in
the JVM. Rules override the model.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import ascii_lower, table

FEATURES = 1 << 14
SIZES = (3, 4, 5)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Labelled URLs, host and path: the whole training table.
BLOCK = (
    "www.cheap-pills.example.com/en/12", "cheap-pills.example.org/buy/now", "best-casino.example.net/slots/777", "www.online-casino.example.com/bonus",
    "free-poker.example.org/play/bonus", "hot-singles.example.net/join/4", "adult-cams.example.com/live/3", "xxx-videos.example.org/watch/88",
    "replica-watches.example.com/sale", "discount-meds.example.net/order/viagra", "payday-loans.example.org/apply/fast", "win-prize.example.com/claim/free",
    "ads.tracker.example.net/click/88/redirect", "doubleads.example.org/banner/468x60", "pixel.tracker.example.com/track/9", "spam-links.example.net/link/farm",
    "www.cheap-viagra.example.org/de/3", "pills-online.example.com/fr/cheap", "casino-bonus.example.com/es/free-spins", "bet-now.example.net/casino/live",
    "torrent-crack.example.org/download/keygen", "warez.example.com/crack/serial", "get-rich-quick.example.net/money/fast", "sexy-chat.example.com/cams/free",
    "casino-slots.example.org/free-spins", "play-poker.example.net/casino/bonus", "online-slots.example.com/jackpot", "www.betting-tips.example.org/bet/live",
    "buy-viagra.example.net/cheap/pills", "online-meds.example.com/order/cheap", "diet-pills.example.org/buy/fast", "cheap-meds.example.net/de/pills",
    "adult-videos.example.org/xxx/9", "xxx-cams.example.net/live/free", "hot-cams.example.com/adult/join", "sexy-singles.example.org/chat/adult",
    "replica-bags.example.net/sale/cheap", "cheap-watches.example.org/replica/buy", "fast-loans.example.com/apply/now", "payday-cash.example.net/loans/fast",
    "free-prize.example.org/win/claim", "win-money.example.net/prize/now", "get-money-fast.example.com/free/cash", "claim-bonus.example.org/free/money",
    "ads.example-tracker.com/banner/728x90", "click.tracker.example.org/redirect/ads", "banner-ads.example.net/click/3", "track.pixel.example.org/click/7",
    "crack-keygen.example.net/download/serial", "free-warez.example.org/torrent/crack", "torrent-free.example.com/download/warez", "spam-farm.example.org/link/click",
)
ALLOW = (
    "www.example.com/news/2024/01/story", "blog.example.org/posts/spark-joins", "en.wiki.example.org/wiki/History", "docs.example.net/guide/install",
    "university.example.org/research/papers/17", "library.example.net/catalog/book/442", "www.museum.example.com/exhibits/art", "weather.example.org/forecast/berlin",
    "recipes.example.com/soup/lentil", "m.therin.example.net/en/770", "blog.onand.example.com/es/575", "www.thereou.example.org/de/252",
    "thention.example.net/fr/638", "m.erstion.example.com/fr/22", "blog.ingha.example.org/en/408", "www.hestth.example.net/es/439.html",
    "garden.example.com/plants/rose", "science.example.org/article/physics/9", "court.example.net/opinions/1999/4", "city.example.org/services/water",
    "school.example.com/lessons/math/3", "health.example.net/advice/sleep", "travel.example.org/fr/paris", "code.example.com/project/readme",
    "news.example.org/2023/05/election-report", "www.example.net/news/science/story", "blog.example.com/posts/garden-notes", "en.wiki.example.org/wiki/Physics",
    "docs.example.com/guide/reference", "university.example.net/research/history", "library.example.org/catalog/author/18", "museum.example.net/exhibits/sculpture",
    "weather.example.com/forecast/paris", "recipes.example.org/bread/rye", "www.ndthe.example.com/fr/104", "m.anerein.example.org/es/31",
    "blog.tionhe.example.net/de/907", "erthat.example.org/en/56", "www.onthand.example.net/fr/12.html", "m.ouresh.example.com/de/345",
    "science.example.net/article/biology/4", "court.example.com/opinions/2004/11", "city.example.net/services/parks", "school.example.org/lessons/history/8",
    "health.example.com/advice/exercise", "travel.example.net/de/berlin", "code.example.org/project/docs", "music.example.com/concerts/2022",
    "books.example.org/reviews/novel", "maps.example.net/city/lyon", "forum.example.com/topic/repair", "radio.example.org/program/evening",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where ``://`` is missing."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), pattern, k)
    return ascii_lower(part(1)), part(2)


def ngrams(host: Column, path: Column) -> Column:
    """All character n-grams of ``^host$`` and ``^path$``, marked by where they come from. Texts are cut into
    characters once and neighbours joined, so that the work grows with the length."""

    def of(mark: str, text: Column, n: int) -> Column:
        chars = F.split(text, "")
        many = F.greatest(F.length(text) - n + 1, F.lit(0))
        rows = F.arrays_zip(*[F.slice(chars, k + 1, many).alias(f"c{k}") for k in range(n)])
        return F.transform(rows, lambda r: F.concat(F.lit(mark), *[r[f"c{k}"] for k in range(n)]))

    marked = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$"))))
    return F.concat(*[of(mark, text, n) for mark, text in marked for n in SIZES])


def features(df: DataFrame) -> DataFrame:
    tf = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=FEATURES, binary=True)
    return tf.transform(df.withColumn("__grams", ngrams(F.col("host"), F.col("path"))))


def train(spark: SparkSession, block: tuple[str, ...] = BLOCK, allow: tuple[str, ...] = ALLOW) -> LogisticRegressionModel:
    """Logistic regression on the labelled table, in one partition so that sums have one order."""
    labelled = [F.struct(F.lit("http://" + u).alias("url"), F.lit(y).alias("label")) for y, urls in ((1.0, block), (0.0, allow)) for u in urls]
    rows = spark.range(1, numPartitions=1).select(F.inline(F.array(*labelled)))
    host, path = host_and_path(F.col("url"))
    rows = features(rows.select(host.alias("host"), path.alias("path"), "label"))
    return LogisticRegression(featuresCol="__features", labelCol="label", regParam=0.02, maxIter=60, standardization=False).fit(rows)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.5, model: LogisticRegressionModel | None = None) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, p_block``.

    ``verdict`` is the longest fitting rule's, else ``block`` where the model's probability is
    over ``threshold``, else ``allow``. Null urls and urls without ``://`` have an empty host and
    path; no rule fits them and the model judges the empty strings. Repeated rows each return.
    """
    model = model or train(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    scored = model.transform(features(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p_block = vector_to_array("probability")[1]
    judged = F.when(p_block > threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), F.round(p_block, 6).alias("p_block"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
