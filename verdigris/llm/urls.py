"""URL filters: host and path rules, and behind them a logistic regression on hashed character n-grams.

A rule names a host and the start of a path; it fits that host and its subdomains, and the longest
fitting rule decides. Urls that no rule fits are judged by the model: counts of hashed 3- to 5-grams of
host and path, weighted and summed as column expressions, so scoring is a projection over the pages
without shuffle. The model is fitted on the small labelled table below (or the caller's).

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is
allowed (nothing speaks against it); repeated rows are judged alike; no rows give no rows. Other columns are
kept; those called like an output (OUTPUTS) give way to it.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, lower_ascii, read, whole

BUCKETS, GRAMS, BLOCK_AT = 1 << 13, (3, 4, 5), 0.5
OUTPUTS = ("host", "path", "rule", "block_probability", "verdict")

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

# The labelled names of sites and paths, written down for this table (gambling, adult, pills and fakes, fraud, advert serving; and ordinary sites).
BLOCKED = """
royal-casino casinoroyale888 onlinecasino24 vegas-casino-club luckycasino pokerroom texaspoker poker-online slotsmania megaslots slot-machines jackpotcity
bigjackpot bingo-bonus roulette-royal blackjackpro betting-odds bettingtips sportsbetting bet-online livebets bestbets wager-now lottowinners
lottery-results-win winbig instant-win adultchat adult-friends adultvideos xxxmovies xxx-tube porntube pornstars sexcams sex-shop hotgirls livecams
nudepics escorts-city singles-dating-hot pillstore pills-online bestpills diet-pills-now viagra-shop cheapviagra cialis24 pharmacy-cheap cheapmeds
cheap-watches replica-rolex fakebags cheap-cigarettes weightloss-miracle payday-cash quickloans easyloans creditfix fastmoney getrichquick earn-cash-now
bitcoin-doubler crypto-giveaway freemoney free-prizes freegiftcards free-iphone-now free-spins prizewinner claim-prize spamlinks spammer-tools spam-king
linkfarm contentfarm articlefarm buybacklinks seo-links-cheap adserver ads-network adsclick adclicks popup-ads adtracker clicktrack tracking-pixel
trackers-hub bannerads malware-loader freecracks warez-zone keygen-crack torrentz phishing-login account-verify-now secure-update-login hackedaccounts
"""

BLOCKED_PATHS = """
/casino/bonus /online-casino /play/slots /poker/tables /free-spins /betting/tips /sports/bets /lottery/win /adult/videos /xxx/gallery /porn/latest /sex/chat
/buy/viagra /cheap-medication /order/cialis /replica/watches /payday-loans /fast-cash /free-money /claim/prize /winner/iphone /crack/keygen /warez/download
/ads/click /adserver/banner /track/click /popup/ads /spam/links /buy/backlinks /phishing/login
"""

ALLOWED = """
citylibrary nationalmuseum dailynews morningpost weatherservice gardeners-guide homecooking grandmothers-recipes universityofscience riverside-hospital
publicschool historytoday sciencejournal travelnotes worldmaps photoclub musicschool theatrecompany bookshop oldbakery mountainhikers birdwatching
openstreet freesoftware opendata linuxforum pythonlessons statistics-office parliament ministry-of-health fire-department postoffice railways airports
bicycles-repair carpentry knitting-patterns woodworking chess-club football-league athletics swimming running-shoes yoga-studio dentist-practice
veterinary-clinic animal-shelter botanical-garden zoo-friends aquarium observatory planetarium encyclopedia dictionary translations poetry-foundation
literature-review philosophy theology cathedral monastery village-council townhall neighborhood housing-association architecture engineering robotics
electronics chemistry biology geology mathematics physics-department education-portal kindergarten teachers-union students-association alumni
research-institute conference proceedings archives heritage preservation restoration painting sculpture gallery exhibition orchestra philharmonic
jazz-festival cinema film-institute television-guide radio-station newspaper magazine editorial letters opinion weather-station ocean-research
forestry agriculture fisheries beekeepers wine-region cheese-makers restaurants hotels youth-hostel camping tourism-board transport energy-agency
water-authority recycling environment climate-report earthquake-center astronomy mineral-collection stamp-collectors model-trains toys-and-games
children-stories parenting motherhood fatherhood grandparents retirement insurance-advice bank-of-the-north savings-cooperative accounting tax-office
law-library court-records notary employment-agency apprenticeship training-center community-center red-cross volunteers another-thing further-reading
northern-lights southern-cross western-union-station eastern-front leather-goods feather-craft brothers-in-arms heather-farm gathering-place
"""

ALLOWED_PATHS = """
/ /about /contact /news/2021/04/spring-weather /articles/history-of-printing /blog/how-to-bake-bread /docs/manual/index.html /library/catalogue /events/calendar
/team /research/papers/12 /en/12 /fr/345.html /de/618/ /es/41 /it/7 /category/gardening /recipes/apple-pie /help/faq /products/bicycles /tickets/concert
/weather/forecast /museum/opening-hours /download/report.pdf /photos/mountains /search /archive/1998 /school/timetable /sports/results /health/advice
/fr/actualites /fr/27/ /fr/culture/8 /de/artikel/61 /de/kontakt /es/noticias/3 /es/cultura /en/news/8 /en/853/ /en/press.html /it/notizie /pt/1 /nl/nieuws/4
"""

NEUTRAL_HOSTS = ("example.org", "www.mysite.info", "pages.hosting.net", "users.provider.com")
SITES = ("{}.com", "www.{}.org", "{}.net", "m.{}.info", "shop.{}.co")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def fitting_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = None
    for rule_host, rule_path, say in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def buckets(host: Column, path: Column) -> Column:
    """Bucket numbers of the 3- to 5-grams of ^host$ and of the path, marked apart."""

    def of(text: Column, n: int, mark: str) -> Column:
        def hashed(t):
            starts = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), t.substr(i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

        return bind(text, hashed)

    fenced, path = F.concat(F.lit("^"), host, F.lit("$")), F.regexp_replace(path, "[0-9]+", "0")
    return F.concat(*(of(fenced, n, "h") for n in GRAMS), *(of(path, n, "p") for n in GRAMS))


def labelled(spark: SparkSession, blocked: str = BLOCKED, allowed: str = ALLOWED) -> DataFrame:
    """The small labelled table: url, label (1: block). A name stands on two of SITES with ordinary paths, a path on two neutral hosts; which ones goes by turns, alike for both labels."""
    good_paths, rows = ALLOWED_PATHS.split(), []
    for label, names, paths in ((1.0, blocked, BLOCKED_PATHS), (0.0, allowed, ALLOWED_PATHS)):
        for i, name in enumerate(names.split()):
            rows += [(f"http://{SITES[(i + k) % len(SITES)].format(name)}{good_paths[(i * 7 + k) % len(good_paths)]}", label) for k in range(2)]
        for i, path in enumerate(paths.split()):
            rows += [(f"http://{NEUTRAL_HOSTS[(i + k) % len(NEUTRAL_HOSTS)]}{path}", label) for k in range(2)]
    urls = F.from_json(F.lit(json.dumps([{"url": u, "label": k} for u, k in rows])), "array<struct<url: string, label: double>>")
    return spark.range(1, numPartitions=1).select(F.inline(urls))


class UrlModel:
    """Fitted weights; probability() is a column expression."""

    def __init__(self, rows: DataFrame, regularisation: float = 0.002):
        host, path = split_url(F.col("url"))
        rows = rows.select("label", buckets(host, path).cast("array<string>").alias("buckets"))
        counts = CountVectorizerModel.from_vocabulary([str(k) for k in range(BUCKETS)], inputCol="buckets", outputCol="features")
        rows = counts.transform(rows).select("label", "features").coalesce(1).cache()
        model = LogisticRegression(regParam=regularisation, standardization=False, maxIter=60).fit(rows)
        rows.unpersist()
        self.weights, self.intercept = [float(w) for w in model.coefficients], float(model.intercept)

    def probability(self, host: Column, path: Column) -> Column:
        weights = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")
        margin = F.aggregate(buckets(host, path), F.lit(self.intercept), lambda total, b: total + F.get(weights, b))
        return 1 / (1 + F.exp(-margin))


def judge(pages: DataFrame, rules=RULES, model: UrlModel | None = None, *, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, block_probability (null where a rule decided) and verdict."""
    model = model or UrlModel(labelled(pages.sparkSession))
    host, path = split_url(F.col(url_col))
    rows = pages.select(whole(pages, OUTPUTS).alias("page"), host.alias("host"), path.alias("path"))
    name, said = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "said": said})
    open_to_model = F.col("rule").isNull() & (F.col("host") != "")
    rows = rows.withColumn("block_probability", F.when(open_to_model, model.probability(F.col("host"), F.col("path"))))
    verdict = F.coalesce(F.col("said"), F.when(F.col("block_probability") >= BLOCK_AT, "block").otherwise("allow"))
    return rows.withColumn("verdict", verdict).select("page.*", *OUTPUTS)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_probability")
