"""URL filters: allow and block rules for hosts and paths, and a classifier for all other addresses.

The classifier is a logistic regression on hashed character n-grams of host and path. It is trained on a small table
of labelled addresses, ``LABELLED`` unless the caller has one, of at most ``MAX_LABELLED`` rows, by Spark's own
classification; pages are scored with its coefficients by DataFrame functions where they are read, without a shuffle.

Null addresses and those without ``://`` have empty host and path; no rule fits them and the model judges by its
intercept alone. An n-gram table of very long addresses stays within their row. Repeated rows each
get their verdict; an empty table gives no rows. Other columns are kept out of the way and not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firstmonth.llm.common import let

SIZES = (3, 4, 5)
FEATURES = 1 << 14
MAX_LABELLED = 100_000

ALLOW, BLOCK = "allow", "block"

#: Small labelled table: whole addresses of either kind, told apart by words of the host, of the path, or of both.
LABELLED = {
    BLOCK: """
        https://www.cheap-meds-now.com/order/pills https://pills4less.net/buy/no-prescription http://buy-pills-online.org/en/12
        https://discount-pharmacy.co.uk/generic-pills https://m.rx-deals.biz/cheap/meds http://onlinepharmacy24.info/buy/cheap-pills
        https://best-casino-games.com/bonus http://casino-bonus-codes.net/free-spins https://www.onlinecasino777.org/slots/jackpot
        https://blog.poker-win-cash.com/de/4 http://mega-slots.net/casino/win https://roulette-king.info/play/roulette
        https://jackpot-party.biz/win/big http://win-big-money.com/lottery/winner https://lotto-winners.org/claim/prize
        https://freeprizes4u.net/claim-your-prize http://m.prize-giveaway.com/free/gift-card https://sports-betting-tips.com/odds/bet
        https://www.betnow365.net/free-bet http://bet-and-win.org/fr/88 https://livebets24.info/betting/odds
        https://hot-singles-nearby.com/chat http://adult-webcams-live.net/cams https://xxx-videos-free.org/watch/xxx
        https://freepornhub-mirror.biz/porn/videos http://m.sexy-cams.info/adult/live https://adult-dating-xxx.com/hookup
        https://nude-pics-daily.net/adult/gallery http://escort-girls-city.org/adult https://payday-loans-fast.com/apply/cash
        https://fast-cash-advance.net/loan/apply-now http://bad-credit-loans.org/instant-cash https://m.quickloans4you.biz/payday
        https://crypto-doubler.io/double-your-bitcoin http://free-bitcoin-miner.net/earn/btc https://elon-crypto-giveaway.com/btc
        https://forex-signals-profit.com/earn-money http://make-money-fast.net/work-from-home https://earn-cash-daily.org/get-rich
        https://cheap-followers.com/buy/likes http://buy-instagram-likes.net/followers https://get-views-cheap.org/buy/views
        https://seo-link-farm.com/buy-backlinks http://spam-links-directory.net/links/1 https://backlink-blast.org/seo/spam
        https://link-exchange-farm.info/add-link http://seo-spam-network.biz/links https://www.linkspam.net/de/77
        https://ads-click-network.com/ad/click http://popup-ads-server.net/banner/ad https://track-ads-click.org/adserver/click
        https://adtracker-pixel.info/track/click http://doubleads-banner.biz/ads/popunder https://click-tracker-ads.com/redirect
        https://replica-watches-shop.com/rolex http://cheap-replica-bags.net/buy/replica https://fake-rolex-outlet.org/cheap
        https://designer-outlet-cheap.info/discount http://warez-cracks.net/download/crack https://keygen-download.org/serial-keys
        https://free-cracks-serials.com/keygen http://torrent-warez-movies.biz/free-download https://nulled-scripts.net/warez
        https://secure-login-verify.info/account/verify http://paypal-account-update.biz/login/verify https://bank-login-confirm.net/update
        https://weight-loss-miracle.com/diet-pills http://lose-belly-fat.net/diet/pills https://keto-diet-pills.org/buy
        https://male-enhancement-pills.com/viagra http://viagra-cialis-cheap.net/order https://www.cialis-online.org/buy/cheap
        https://clickbait-news-daily.com/you-wont-believe http://shocking-celebs.net/click https://hosting.example.org/casino/free-spins
        https://blog.example.org/buy-cheap-viagra-online http://forum.example.org/xxx-porn-videos https://shop.example.org/payday-loan-cash
        https://m.winfreecash.net/es/9 http://spin-win-casino.com/fr/31 https://betting-bonus.example.org/en/5
        http://cheapdrugs.example.org/de/81 https://www.sexcams.example.org/fr/7 https://spamfarm.example.org/en/302
        https://lottery-prize.example.org/es/44 http://www.viagra-shop.example.org/en/19.html https://m.porn-tube.example.org/fr/230
        http://blog.betting-odds.example.org/de/7 https://payday-cash.example.org/en/91 https://www.keygen-cracks.example.org/es/650
        http://m.ad-banner.example.org/fr/3 https://buy-likes.example.org/de/402.html http://blog.diet-pills.example.org/en/8
        https://www.adult-chat.example.org/es/71 http://free-spins.example.org/fr/12 https://m.click-ads.example.org/en/33
        http://www.lottery-jackpot.example.net/en/17 https://m.pharmacy-pills.example.net/de/5 http://blog.casino-slots.example.net/en/88
        https://poker-cash.example.net/de/21.html http://www.adult-cams.example.net/en/6 https://m.seo-links.example.net/de/410
        http://cheap-meds.example.net/en/3 https://blog.ad-tracker.example.net/de/2 http://loan-cash.example.net/en/74
    """.split(),
    ALLOW: """
        https://en.encyclopedia.org/article/history https://www.citylibrary.org/catalogue/books http://museum-of-art.org/exhibitions/2024
        https://www.university.edu/departments/physics https://science-journal.org/articles/genetics http://newspaper.co.uk/world/europe
        https://weather.gov/forecast/london https://gardening.example.org/roses/pruning http://recipes.example.org/soup/tomato
        https://travel-guide.org/italy/rome https://www.astronomy.org/planets/saturn http://chemistry.edu/elements/carbon
        https://mathematics.org/theorems/fermat https://www.parliament.uk/bills/2023 http://hospital.org/patients/visiting
        https://railways.net/timetable/berlin https://theatre.org/season/hamlet http://orchestra.org/concerts/mozart
        https://painting.example.org/watercolour https://docs.software.org/en/install http://developers.net/api/reference
        https://engineering.edu/courses/bridges https://www.architecture.org/gothic http://geography.org/rivers/danube
        https://languages.org/grammar/latin https://philosophy.edu/plato http://kindergarten.org/enrolment
        https://football.org/results/saturday https://cycling.net/routes/alps http://running.org/training/plan
        https://photography.example.org/lenses https://carpentry.org/tools/saw http://bookshop.co.uk/novels/austen
        https://publishers.org/catalog/poetry https://radio.org/programmes/morning http://cinema.org/films/classics
        https://festival.org/tickets/info https://m.local-news.org/town/council http://blog.teachers.org/lessons/reading
        https://www.farmers.org/markets/apples https://birdwatching.org/species/heron http://geology.edu/minerals/quartz
        https://archives.gov/records/1900 https://genealogy.org/surnames http://lighthouses.org/coast/north
        https://sailing.org/knots https://mountain-huts.org/alps http://national-park.gov/trails
        https://botany.edu/herbarium https://zoology.edu/mammals/otter http://oceans.org/currents
        https://climate.gov/data/temperature https://statistics.gov/population http://law.edu/lectures/contracts
        https://court.gov/opinions/2021 https://city.gov/services/water http://schools.org/calendar
        https://choir.org/rehearsals https://chess.org/openings/sicilian http://opensource.org/licenses
        https://kernel.dev/docs/scheduler https://python.dev/tutorial/lists http://database.dev/manual/indexes
        https://physics.edu/lectures/optics https://medicine.edu/anatomy/heart http://nursing.edu/handbook
        https://bakery.example.org/bread/rye https://cheese.example.org/gouda http://vineyard.example.org/harvest
        https://www.harbour.example.org/en/14 https://m.woodland.example.org/de/231 http://blog.river.example.org/fr/5
        https://stone.example.org/es/770 https://meadow.example.org/en/91.html http://www.northern.example.org/de/12
        https://there.example.org/fr/604 https://m.nation.example.org/es/3 http://blog.station.example.org/en/48
        https://thesis.example.org/en/9 https://www.within.example.org/de/66 http://further.example.org/fr/410.html
        https://blog.weather.example.org/es/21 https://m.letters.example.org/en/555 http://other.example.org/de/8
        https://www.education.example.org/en/700 https://motion.example.org/fr/18 http://m.strength.example.org/es/92
        https://www.lantern.example.net/en/40 https://m.thermal.example.net/de/7 http://blog.then.example.net/en/312
        https://there.example.net/de/55.html https://www.thread.example.net/en/8 http://m.path.example.net/de/903
        https://harvest.example.net/en/26 https://blog.smith.example.net/de/64 http://tension.example.net/en/5
        https://village-hall.org/events/dance https://volunteers.org/help/gardens http://history.example.org/romans/roads
    """.split(),
}


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains if the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", ALLOW),
    Rule("example.com", "/en/", BLOCK),
    Rule("www.example.com", "/en/", ALLOW),
    Rule("net", "/es/", BLOCK),
    Rule("net", "/fr/", BLOCK),
)


def host_and_path(url: Column) -> Column:
    """Struct of ``host`` (A-Z in lower case) and ``path``; both empty without ``://``."""
    known = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(known, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(known, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.struct(lower.alias("host"), path.alias("path"))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct of ``rule`` and ``verdict`` of the longest rule that fits, null if none does."""

    def fits(rule: Rule) -> Column:
        return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)

    ordered = sorted(rules, key=lambda rule: (-len(rule.text), rule.text))
    found = [
        F.when(fits(rule), F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict")))
        for rule in ordered
    ]
    return F.coalesce(*found, F.lit(None).cast("struct<rule:string,verdict:string>"))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked by where they come from."""
    return F.concat(_grams(host, "h"), _grams(path, "p"))


def _grams(text: Column, mark: str) -> Column:
    def of(chars: Column) -> Column:
        def sized(n: int) -> Column:
            starts = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - n + 1))
            every = F.transform(starts, lambda at: F.concat(F.lit(mark), F.array_join(F.slice(chars, at, n), "")))
            return F.coalesce(every, F.array().cast("array<string>"))

        return F.concat(*[sized(n) for n in SIZES])

    return let(F.filter(F.split(text, ""), lambda c: c != ""), of)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url``, ``verdict``: the labelled table as rows."""
    rows = [F.struct(F.lit(url).alias("url"), F.lit(kind).alias("verdict")) for kind in LABELLED for url in LABELLED[kind]]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


@dataclass(frozen=True)
class Model:
    """Coefficients of the hashed n-grams, and the intercept."""

    coefficients: tuple[float, ...]
    intercept: float

    def score(self, buckets: Column) -> Column:
        """Probability of ``block`` for the distinct buckets of an address."""
        texts = ",".join(map(repr, self.coefficients))
        weights = F.split(F.lit(texts), ",").cast("array<double>")  # a constant of the plan
        margin = F.aggregate(buckets, F.lit(self.intercept), lambda total, at: total + F.get(weights, at))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def train(labelled: DataFrame) -> Model:
    """Fit the classifier on ``url`` and ``verdict`` of at most ``MAX_LABELLED`` rows; rows without both are left out.

    A table without rows of both kinds gives a model that allows or blocks everything. The fitted object of Spark's library keeps
    the session it was made in; only its numbers leave this function.
    """
    rows = labelled.where(F.col("url").isNotNull() & F.col("verdict").isin(ALLOW, BLOCK))
    if rows.limit(MAX_LABELLED + 1).count() > MAX_LABELLED:
        raise ValueError(f"The labelled table has more than {MAX_LABELLED} rows; pass a sample of it.")
    kinds = {row["verdict"] for row in rows.select("verdict").distinct().collect()}
    if len(kinds) < 2:
        return Model((0.0,) * FEATURES, 1.0 if kinds == {BLOCK} else -1.0)
    parts = host_and_path(F.col("url"))
    tokens = F.transform(hashed(parts["host"], parts["path"]), lambda at: at.cast("string"))
    rows = rows.select(tokens.alias("tokens"), (F.col("verdict") == BLOCK).cast("double").alias("label"))
    used = [row[0] for row in rows.select(F.explode("tokens")).distinct().orderBy("col").collect()]  # FEATURES at most
    vectors = CountVectorizerModel.from_vocabulary(used, "tokens", "features", binary=True)
    fitted = LogisticRegression(regParam=0.01, maxIter=50).fit(vectors.transform(rows))
    coefficients = [0.0] * FEATURES
    for at, weight in zip(used, fitted.coefficients.toArray().tolist()):
        coefficients[int(at)] = weight
    return Model(tuple(coefficients), float(fitted.intercept))


def hashed(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of an address, in ascending order."""
    return F.array_sort(F.array_distinct(F.transform(grams(host, path), lambda g: F.pmod(F.xxhash64(g), F.lit(FEATURES)).cast("int"))))


def judge(
    pages: DataFrame,
    model: Model | None = None,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the model's ``block_score`` for each of ``pages``."""
    model = model or train(labelled_urls(pages.sparkSession))
    parsed = pages.select("page_id", host_and_path(F.col("url")).alias("parts")).select("page_id", "parts.host", "parts.path")
    scored = parsed.select(
        "*",
        rule_of(F.col("host"), F.col("path"), rules).alias("fit"),
        model.score(hashed(F.col("host"), F.col("path"))).alias("block_score"),
    )
    learned = F.when(F.col("block_score") > 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), learned).alias("verdict"),
        "block_score",
    )


def allowed(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """The pages whose address is allowed, as they are."""
    kept = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page_id"), "url")
    return judge(kept, model).where(F.col("verdict") == ALLOW).select("page_id.*")
