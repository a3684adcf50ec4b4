"""Batch jobs around the bars: summaries, exchange files, upserts, news, and sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bounded_batches, give_back
from ..functions.series import ordered

c = F.col
YEAR = 252

#: Words of company names that tag nothing.
STOP_WORDS = "limited ltd ltd. india indian company co corp corporation the and of for inc plc pvt private public group holdings enterprises industries services solutions technologies systems international global bank finance financial".split()


def price_summary(bars: DataFrame) -> DataFrame:
    """ticker, close and date of the last positive close, yr1_pct against the nearest positive close at or before 252 rows back; rounded half even."""
    rows = bars.withColumns({"_n": F.row_number().over(ordered()), "_all": F.count(F.lit(1)).over(Window.partitionBy("ticker"))})
    good = c("close") > 0
    old = good & (c("_n") <= c("_all") - YEAR)
    last = rows.groupBy("ticker").agg(F.max_by("close", F.when(good, c("_n"))).alias("close"), F.max(F.when(good, c("date"))).alias("date"), F.max_by("close", F.when(old, c("_n"))).alias("_old"))
    return last.where("date is not null").select("ticker", F.bround("close", 4).alias("close"), "date", F.bround(c("close") / F.when(c("_old") > 0, c("_old")) - 1, 4).alias("yr1_pct"))


def front_month(contracts: DataFrame, instruments: Sequence[str]) -> DataFrame:
    """One contract a symbol and date: of the wanted instruments with a positive close the earliest expiry, else the earliest at all.

    contracts: symbol, instrument, date, expiry, open, high, low, close, volume; texts are trimmed.
    """
    clean = contracts.withColumns({x: F.trim(x) for x in ("symbol", "instrument")}).where(c("instrument").isin(*instruments))
    best = Window.partitionBy("symbol", "date").orderBy((F.coalesce("close", F.lit(0.0)) > 0).desc(), "expiry", "open", "close", "volume")
    return clean.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def append_new(history: DataFrame, batch: DataFrame) -> DataFrame:
    """history and the rows of batch whose (ticker, date) it lacks; running it again changes nothing."""
    return history.unionByName(batch.join(history.select("ticker", "date"), ["ticker", "date"], "left_anti"))


def upsert_by_date(history: DataFrame, batch: DataFrame) -> DataFrame:
    """Of each (ticker, date) the batch's row if there is one, else the history's."""
    both = history.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy("ticker", "date").orderBy(F.desc("_new"), *[F.desc(x) for x in history.columns if x not in ("ticker", "date")])
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_new")


def business_days(spans: DataFrame, first: Column, last: Column) -> DataFrame:
    """date of each weekday from first to last of each row of spans."""
    days = spans.select(F.explode(F.sequence(first, last)).alias("date"))
    return days.where(F.weekday("date") < 5)


def missing_days(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """ticker, date of the calendar's days on which a ticker lacks a bar between its first and last."""
    spans = bars.groupBy("ticker").agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    wanted = spans.withColumn("date", F.explode(F.sequence("_from", "_to"))).join(calendar.select("date"), "date", "left_semi")
    return wanted.select("ticker", "date").join(bars.select("ticker", "date"), ["ticker", "date"], "left_anti")


def vendor_frame(frame: DataFrame) -> DataFrame:
    """Bars of a vendor's frame: rows without a full set of prices are left out, a missing volume is 0."""
    return frame.dropna(subset=["open", "high", "low", "close"]).withColumn("volume", F.coalesce("volume", F.lit(0.0)))


# News.


def news_clean(items: DataFrame) -> DataFrame:
    """title and url with white space collapsed; items without either are left out."""
    tidy = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    return items.withColumns({"title": tidy("title"), "url": tidy("url")}).where("title <> '' and url <> ''")


def news_patterns(stocks: DataFrame) -> DataFrame:
    """ticker, token (lower case): the ticker and the words of the name of four or more letters that are not stop words."""
    words = stocks.select("ticker", F.explode(F.split(F.lower("name"), r"[^a-z0-9]+")).alias("token"))
    words = words.where((F.length("token") >= 4) & ~c("token").isin(*STOP_WORDS))
    return stocks.select("ticker", F.lower("ticker").alias("token")).unionByName(words).distinct()


#: Tokens up to which an automaton of them is sent to all tasks.
MOST_TOKENS = 500_000


def _word_edge(text: str, at: int) -> bool:
    """Whether a word begins or ends before the character at this place; letters and digits of any script and the underscore make words."""
    inside = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    return inside(at - 1) != inside(at)


def found_tickers(automaton: ahocorasick.Automaton, text: str) -> list[str]:
    """Tickers, in order, of the automaton's tokens that stand in the text as whole words; one walk over the text."""
    found: set[str] = set()
    for end, (token, tickers) in automaton.iter(text):
        if not found.issuperset(tickers) and _word_edge(text, end + 1) and _word_edge(text, end + 1 - len(token)):
            found.update(tickers)
    return sorted(found)


def news_tag(items: DataFrame, patterns: DataFrame) -> DataFrame:
    """items with tickers: those with a token that stands in the title as a whole word, whatever the case; letters and digits of any script make words.

    Each title is walked once, in place, through an automaton of all tokens, which every task gets; more than
    MOST_TOKENS are joined with the titles' words instead.
    """
    listed = patterns.where("token <> ''").groupBy("token").agg(F.collect_set("ticker").alias("tickers")).limit(MOST_TOKENS + 1).collect()
    if len(listed) > MOST_TOKENS:
        return news_tag_by_join(items, patterns)
    bounded_batches(items.sparkSession)
    sent = items.sparkSession.sparkContext.broadcast([(r["token"], r["tickers"]) for r in listed])

    @F.arrow_udf("array<string>")
    def tag(titles: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for token, tickers in sent.value:
            automaton.add_word(token, (token, tickers))
        automaton.make_automaton()
        ready = len(automaton) > 0
        for batch in titles:
            yield pa.array([found_tickers(automaton, t.as_py() or "") if ready else [] for t in batch], pa.list_(pa.string()))
        give_back()

    return items.withColumn("tickers", tag(F.lower("title")))


def news_tag_by_join(items: DataFrame, patterns: DataFrame) -> DataFrame:
    """news_tag for any number of tokens: those of word characters are joined by equality with the title's words; only tokens with other characters need a pattern search."""
    keyed = items.withColumn("_key", F.sha2(F.concat_ws("\n", "url", "title"), 256))
    words = keyed.select("_key", F.explode(F.array_distinct(F.split(F.lower("title"), r"[^\p{L}\p{N}_]+"))).alias("token"))
    simple = c("token").rlike(r"^\w+$")
    exact = words.join(patterns.where(simple), "token").select("_key", "ticker")
    edge = F.concat(F.lit(r"(?U)\b\Q"), c("token"), F.lit(r"\E\b"))
    others = keyed.select("_key", F.lower("title").alias("_low")).join(patterns.where(~simple), F.regexp_like(c("_low"), edge)).select("_key", "ticker")
    tags = exact.unionByName(others).groupBy("_key").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    return keyed.join(tags, "_key", "left").withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>"))).drop("_key")


def news_dedupe_cap(items: DataFrame, most: int = 200) -> DataFrame:
    """The first item (by arrival) of each url, then the newest so many of each source."""
    first = Window.partitionBy("url").orderBy("arrival")
    newest = Window.partitionBy("source").orderBy(F.desc("published"), "arrival")
    return items.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("_n", F.row_number().over(newest)).where(c("_n") <= most).drop("_n")


def news_merge(items: DataFrame) -> DataFrame:
    """One item a url over all sources: the fields of the first by priority and arrival, with everyone's tickers, newest first."""
    order = F.struct("priority", "arrival")
    fields = [F.min_by(x, order).alias(x) for x in ("title", "source", "published")]
    tickers = F.array_sort(F.array_distinct(F.flatten(F.collect_list("tickers")))).alias("tickers")
    return items.groupBy("url").agg(*fields, tickers).orderBy(F.desc("published"), "url")


def news_filter(items: DataFrame, ticker: str, most: int = 20) -> DataFrame:
    return items.where(F.array_contains("tickers", ticker)).orderBy(F.desc("published"), "url").limit(most)


# Lists and sinks.


def sector_counts(dims: DataFrame, sectors: Sequence[str]) -> DataFrame:
    """sector, n in the given order, also of sectors without a member."""
    listed = dims.sparkSession.createDataFrame(list(enumerate(sectors)), "position int, sector string")
    counted = dims.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counted, "sector", "left").select("position", "sector", F.coalesce("n", F.lit(0)).alias("n")).orderBy("position")


def search(dims: DataFrame, text: str) -> DataFrame:
    """Members whose ticker or name holds the text, whatever the case; all for an empty text."""
    wanted = text.strip().lower()
    return dims.where(F.lower("ticker").contains(wanted) | F.lower("name").contains(wanted)) if wanted else dims


def csv_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """line: the names, then values joined by commas, texts with a comma in quotes; no line at all without rows."""
    kinds = dict(df.dtypes)
    quoted = lambda x: F.when(c(x).contains(","), F.concat(F.lit('"'), c(x), F.lit('"'))).otherwise(c(x)) if kinds[x] == "string" else c(x).cast("string")
    names = df.limit(1).select(F.lit(",".join(columns)).alias("line"))
    return names.union(df.select(F.concat_ws(",", *[F.coalesce(quoted(x), F.lit("")) for x in columns]).alias("line")))


def write_csv(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """The lines as text files; in the order of their names, the first line is that of the names."""
    csv_lines(df, columns).write.mode("overwrite").text(path)


def write_news(items: DataFrame, path: str, least: int = 20) -> None:
    """Merged items as JSON; fewer than least are taken for a failed fetch and refused, so that what is there stays."""
    if (n := items.limit(least).count()) < least:
        raise ValueError(f"{n} items are too few to write")
    write_json(items, path)


def write_json(df: DataFrame, path: str, *order: str) -> None:
    (df.sort(*order) if order else df).write.mode("overwrite").json(path)


def write_bars(bars: DataFrame, path: str, buckets: int = 64) -> None:
    """Bars as Parquet in folders by a hash of the ticker, so that a ticker's scan reads one folder."""
    keyed = bars.withColumn("bucket", F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int"))
    keyed.repartition("bucket").sortWithinPartitions("ticker", "date").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_price_files(bars: DataFrame, path: str) -> None:
    """One JSON file a ticker, as scan_prices_json reads them: aligned arrays, oldest first."""
    fields = ("date", "open", "high", "low", "close", "volume")
    rows = bars.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("r"))
    dates = F.transform(c("r.date"), lambda d: d.cast("string")).alias("dates")
    rows.select("ticker", dates, *[c(f"r.{x}").alias(x) for x in fields[1:]]).write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)
