"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from leafwork.llm.common import small_batches
from leafwork.llm.textbytes import BASE, BYTE, U, buffers, mix

#: A small labelled table: URLs to block and to allow.
BLOCK = """
http://ads.adserver.com/click?id=1
https://m.ads-track.com/en/banner
https://track.clickads.net/pixel.gif
http://adtracker.example/redirect
https://www.ad-banner.org/popup/win
https://doubleads.net/adserve/12
https://tracker.promo-mail.biz/open
http://stats.tracking-pixel.com/p.gif
https://best-casino-bonus.com/slots/free-spins
http://casino-online.biz/poker/bonus
https://www.megabet-casino.net/jackpot
http://online-poker-win.info/bet
https://betting-odds-win.ru/bonus
http://xxx-videos.com/porn/hot
https://www.free-porn-tube.net/xxx/1
http://hot-sex-cams.biz/live
https://adult-dating.xxx/girls
http://sexy-singles.click/nude
https://cheap-viagra-pills.com/buy
http://pharmacy-pills.biz/cialis/order
https://buy-cheap-meds.info/viagra
http://free-iphone-winner.top/claim
https://win-prize-now.click/lottery
http://you-won.biz/claim-prize
https://spam-links.info/seo/backlinks
http://buy-backlinks-seo.net/cheap
https://get-rich-quick.biz/earn-money-fast
http://crypto-doubler.top/invest
https://payday-loans-fast.com/apply-now
http://cheap-replica-watches.biz/rolex
https://warez-crack.net/keygen/download
http://torrent-crack.ru/serial/free
https://malware-download.top/setup.exe
http://free-download-crack.info/patch.exe
https://secure-login-verify.top/account/update
http://paypal-verify-account.click/login
https://phish-bank-login.biz/confirm
http://popunder-ads.com/serve
https://affiliate-track.net/click/99
http://spamblog.info/viagra-casino
""".split()
ALLOW = """
https://www.university.edu/research/papers
https://en.wiki.example/wiki/History
https://library.gov/catalogue/books/12
http://news.daily.com/2024/world/article.html
https://www.museum.org/exhibitions
https://docs.python.example/tutorial/index.html
http://blog.garden.net/en/1234
https://www.science.org/articles/88
https://m.recipes.com/en/soup.html
http://www.school.org/fr/5512
https://blog.travel.net/de/771/
https://forum.linux.org/topic/1001
http://www.weather.gov/forecast/today
https://www.history.net/es/2211
https://open.data.gov/datasets/census
http://encyclopedia.org/en/9001.html
https://www.nature-notes.com/birds/robin
https://m.city.gov/services/permits
http://letters.net/en/4410?page=2
https://www.chess.org/openings/sicilian
https://code.example/docs/api/reference
http://museum.example/fr/collection/33
https://www.theatre.com/season/plays
https://newspaper.com/en/politics/7781
http://www.farm.net/en/crops/wheat
https://clinic.org/health/advice
https://www.railway.com/timetable
http://math.university.edu/lectures/5
https://www.poetry.net/en/poems/412
http://m.mountain.org/trails/map
https://blog.kitchen.com/en/1231
https://www.court.gov/decisions/1999
http://www.music.org/scores/bach
https://astronomy.edu/stars/catalogue
http://garden.example/en/200/
https://www.bridge.net/de/815
https://harbour.com/en/ships?utm_source=feed
http://www.painting.org/es/gallery/9
https://language.edu/grammar/verbs
http://village.net/en/318#top
""".split()

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), F.regexp_extract(url, PATH, 1)


@dataclass(frozen=True)
class UrlRule:
    """Fits `host`, its subdomains, and paths that start with `path`; the rule's text is host + path."""

    host: str
    path: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def rule(text: str, verdict: str) -> UrlRule:
    host, _, path = text.partition("/")
    return UrlRule(host, "/" + path, verdict)


def grams(hosts: pa.Array, paths: pa.Array, bits: int, low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each row's different n-grams of bytes, of the host and of the lower-cased path between marks; the two have grams of their own."""
    rows, buckets = [], []
    for salt, column in ((U(0x68), hosts), (U(0x70), pc.utf8_lower(paths))):
        raw, offsets = buffers(pc.binary_join_element_wise("^", column, "$", ""))
        code, row = BYTE[raw], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        with np.errstate(over="ignore"):
            run = np.zeros(len(raw), U)
            for n in range(1, high + 1):
                run = run[: len(raw) - n + 1] * BASE + code[n - 1 :]
                if n >= low:
                    start = np.flatnonzero(row[: len(run)] == row[n - 1 :])  # all its bytes are of one row
                    rows.append(row[start])
                    buckets.append((mix(run[start] ^ (salt + U(256 * n))) >> U(64 - bits)).astype(np.int64))
    both = np.unique(np.concatenate(rows) << bits | np.concatenate(buckets)) if rows else np.zeros(0, np.int64)
    return both >> bits, both & ((1 << bits) - 1)


@dataclass
class UrlModel:
    bits: int
    bias: float
    weights: np.ndarray

    def scores(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """The probability of block for each url: the mean weight of its grams, scaled by the root of their number."""
        row, bucket = grams(hosts, paths, self.bits)
        n = np.bincount(row, minlength=len(hosts))
        z = self.bias + np.bincount(row, self.weights[bucket], len(hosts)) / np.sqrt(np.maximum(1, n))
        return 1 / (1 + np.exp(-z))


def _parts(url: str) -> tuple[str, str]:
    rest = url.split("://", 1)[1]
    host = rest.split("/")[0].split("?")[0].split("#")[0]
    return host.translate(str.maketrans(UPPER, LOWER)), rest[len(host) :].split("?")[0].split("#")[0]


def fit(block: list[str] = BLOCK, allow: list[str] = ALLOW, bits: int = 15, steps: int = 400, decay: float = 1e-2) -> UrlModel:
    """Logistic regression by gradient descent on the labelled table; 1 is block."""
    hosts, paths = zip(*(_parts(u) for u in (*block, *allow)))
    row, bucket = grams(pa.array(hosts), pa.array(paths), bits)
    y = np.array([1.0] * len(block) + [0.0] * len(allow))
    x = np.zeros((len(y), 1 << bits), np.float64)
    x[row, bucket] = 1 / np.sqrt(np.bincount(row, minlength=len(y)))[row]
    used = np.flatnonzero(x.any(0))
    x = x[:, used]
    w, b = np.zeros(len(used)), 0.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= 2.0 * (x.T @ r / len(y) * 4 + decay * w / 4)
        b -= 0.5 * r.mean()
    full = np.zeros(1 << bits)
    full[used] = w
    return UrlModel(bits, float(b), full)


def judge(pages: DataFrame, rules: list[UrlRule], model: UrlModel, cut: float = 0.5) -> DataFrame:
    """Adds host, path, rule, verdict, score to pages (url): the longest rule that fits decides, else the model.

    rule is null where none fits; a null or empty url has empty host and path and goes to the model. Columns of these
    names in pages are replaced.
    """
    small_batches(pages.sparkSession, 2000)
    names = ["host", "path", "rule", "verdict", "score"]
    host, path = host_path(F.col("url"))
    df = pages.drop(*names).withColumn("host", host).withColumn("path", path)
    longest = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path))
    found = F.coalesce(*(F.when(r.fits(F.col("host"), F.col("path")), F.lit(k)) for k, r in enumerate(longest)), F.lit(-1)) if longest else F.lit(-1)
    df = df.withColumn("_k", found)
    held = pages.sparkSession.sparkContext.broadcast(model)  # 2**bits weights
    texts, verdicts = (np.array([*x, ""], object) for x in ([r.host + r.path for r in longest], [r.verdict for r in longest]))

    def scored(batches):
        for batch in batches:
            k = batch.column("_k").to_numpy()
            open_ = k < 0
            score = np.zeros(len(k))
            score[open_] = held.value.scores(*(batch.column(c).filter(pa.array(open_)) for c in ("host", "path")))
            verdict = np.where(open_, np.where(score >= cut, "block", "allow"), verdicts[k])
            keep = [n for n in batch.schema.names if n != "_k"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), pa.array(texts[k], pa.string(), mask=open_), pa.array(verdict, pa.string()), pa.array(score, pa.float64(), mask=~open_)],
                [*keep, "rule", "verdict", "score"],
            )

    kind = ", ".join(f"`{n}` {t}" for n, t in df.drop("_k").dtypes)
    return df.mapInArrow(scored, f"{kind}, rule string, verdict string, score double")
