"""Market tables: readers for landed files and deterministic views over the order, trade and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOLS = 4

CANDLES = T.StructType([T.StructField(n, T.StringType()) for n in "open_time open high low close volume close_time quote_volume trades taker_buy_base taker_buy_quote".split()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_defaults(df: DataFrame, **defaults: Column) -> DataFrame:
    """Adds columns that are absent and fills nulls of those that are there."""
    return df.withColumns({n: F.coalesce(F.col(n), d) if n in df.columns else d for n, d in defaults.items()})


def epoch_timestamp(ts: Column) -> Column:
    """Seconds, milliseconds or microseconds by magnitude, row by row."""
    n = ts.cast("long")
    return F.when(n > 10**15, F.timestamp_micros(n)).when(n > 10**12, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))


def read_candles(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Pages of arrays of arrays (JSON) as typed daily bars, once per time."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("c"))
    at = {f.name: F.get("c", i) for i, f in enumerate(CANDLES.fields)}
    number = {n: at[n].try_cast("double").alias(n) for n in at if n not in ("open_time", "close_time", "trades")}
    bars = raw.select(F.lit(symbol).alias("symbol"), F.timestamp_millis(at["open_time"].try_cast("long")).alias("ts"), *number.values(), at["trades"].try_cast("long").alias("trades"))
    return bars.dropDuplicates(["symbol", "ts"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Fear and greed index pages (JSON): date, value, class."""
    rows = spark.read.schema("data array<struct<value:string,value_classification:string,timestamp:string>>").json(path, multiLine=True).select(F.explode("data").alias("d"))
    return rows.select(F.to_date(F.timestamp_seconds(F.col("d.timestamp").try_cast("long"))).alias("date"), F.col("d.value").try_cast("int").alias("fear_greed_value"), F.col("d.value_classification").alias("fear_greed_class"))


def read_trades_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Trade files with a header (plain or gzip); names are trimmed and lower-cased, the clock unit is found row by row."""
    raw = spark.read.csv(path, header=True)
    raw = require_columns(raw.toDF(*[c.strip().lower() for c in raw.columns]), "timestamp", "price", "size", "side")
    return raw.select(epoch_timestamp(F.col("timestamp").try_cast("double")).alias("ts"), F.col("price").try_cast("double").alias("price"), F.col("size").try_cast("double").alias("size"), F.lower("side").alias("side"), F.col("_metadata.file_name").alias("file"))


def _csv(spark: SparkSession, path: str | list[str], *required: str) -> DataFrame:
    """CSV files with a header, plain or gzip; names trimmed and lower-cased, with the day that the file's name holds."""
    raw = spark.read.csv(path, header=True)
    raw = require_columns(raw.toDF(*[c.strip().lower() for c in raw.columns]), *required)
    return raw.withColumns({"file": F.col("_metadata.file_name"), "file_day": F.to_date(F.nullif(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")))})


def read_books_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Best bid and ask by time; a missing spread, mid, basis points, volume or imbalance is derived from what is there."""
    raw = _csv(spark, path, "timestamp", "bid", "ask")
    number = lambda c: F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")
    rows = raw.select(epoch_timestamp(F.col("timestamp").try_cast("double")).alias("ts"), *[number(c).alias(c) for c in ("bid", "ask", "bid_volume", "ask_volume", "spread", "spread_bps", "imbalance")], "file", "file_day")
    mid, b, a = (F.col("bid") + F.col("ask")) / 2, F.coalesce("bid_volume", F.lit(1.0)), F.coalesce("ask_volume", F.lit(1.0))
    rows = with_defaults(rows.withColumns({"mid": mid, "bid_volume": b, "ask_volume": a}), spread=F.col("ask") - F.col("bid"))
    return with_defaults(rows, spread_bps=F.try_divide("spread", "mid") * 10_000, imbalance=F.coalesce(F.try_divide(b - a, b + a), F.lit(0.0)))


def read_sentiment_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scores by time with defaults for uncertainties and a regime from the score where none is given."""
    raw = _csv(spark, path, "timestamp", "sentiment")
    number = lambda c: F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")
    rows = raw.select(epoch_timestamp(F.col("timestamp").try_cast("double")).alias("ts"), number("sentiment").alias("sentiment"), number("epistemic").alias("epistemic"), number("aleatoric").alias("aleatoric"), (F.col("regime") if "regime" in raw.columns else F.lit(None).cast("string")).alias("regime"))
    by_score = F.when(F.col("sentiment") > 0.2, "bullish").when(F.col("sentiment") < -0.2, "bearish").otherwise("neutral")
    return with_defaults(rows, epistemic=F.lit(0.1), aleatoric=F.lit(0.2), regime=by_score)


def read_trade_zips(spark: SparkSession, path: str) -> DataFrame:
    """Trade files without a header inside zip archives: a maker on the buy side means that the seller took the price.

    A zip can't be split, so each archive is one row that a task unpacks line by line, in batches of bounded size.
    """

    def unpack(batches):
        import csv
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            for name, body in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    for inner in z.namelist():
                        rows = []
                        for row in csv.reader(io.TextIOWrapper(z.open(inner), "utf-8")):
                            rows.append([name, *(row + [""] * 6)[:6]])
                            if len(rows) == 50_000:
                                yield pd.DataFrame(rows, columns=list(fields))
                                rows = []
                        yield pd.DataFrame(rows, columns=list(fields))

    fields = ("file", "trade_id", "price", "size", "quote", "time", "maker")
    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, ", ".join(f"{f} string" for f in fields))
    rows = raw.select("file", F.col("trade_id").try_cast("long").alias("trade_id"), epoch_timestamp(F.col("time").try_cast("double")).alias("ts"), F.col("price").try_cast("double").alias("price"), F.col("size").try_cast("double").alias("size"), F.when(F.lower("maker") == "true", "sell").otherwise("buy").alias("side"))
    return rows.where("trade_id is not null and price > 0 and size >= 0")


def every_kth_file(files: DataFrame, step: int, most: int | None = None, name: str = "path") -> DataFrame:
    """A systematic sample of a list of files, by name; the list is small beside the files."""
    kept = files.withColumn("_n", F.row_number().over(Window.orderBy(name))).where((F.col("_n") - 1) % step == 0).drop("_n")
    return kept if most is None else kept.orderBy(name).limit(most)


LEVEL = "array<array<string>>"


def parse_depth(messages: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(books, rejected messages): JSON depth updates whose levels are pairs of a positive price and a size that is not negative."""
    # keys differ by case alone, so the message is read as a map
    m = messages.withColumn("m", F.from_json(F.col(column), "map<string,string>"))
    m = m.withColumns({"_b": F.from_json(F.col("m")["b"], LEVEL), "_a": F.from_json(F.col("m")["a"], LEVEL)})
    number = lambda x, i: F.get(x, i).try_cast("double")
    fine = lambda side: side.isNotNull() & F.forall(side, lambda x: F.coalesce((F.size(x) == 2) & (number(x, 0) > 0) & (number(x, 1) >= 0), F.lit(False)))
    m = m.withColumn("_ok", F.coalesce(F.col("m")["s"].isNotNull() & fine(F.col("_b")) & fine(F.col("_a")), F.lit(False)))
    levels = lambda c: F.transform(c, lambda x: F.array(number(x, 0), number(x, 1)))
    long = lambda k: F.col("m")[k].try_cast("long")
    books = m.where("_ok").select(F.col("m")["s"].alias("symbol"), F.timestamp_millis(long("E")).alias("ts"), long("U").alias("first_id"), long("u").alias("last_id"), levels("_b").alias("bids"), levels("_a").alias("asks"))
    return books, m.where(~F.col("_ok")).drop("m", "_ok", "_a", "_b")


# Names under which a price may stand, the first readable one counts.
PRICE_FIELDS = ("price", "current_price", "yes_price", "probability", "prob", "last_price", "trade_price", "execution_price")


def market_price(json: Column) -> Column:
    """A market's price between 0 and 1: its own field, that of its first side (where there are two) or outcome, else the middle of its book."""
    at = lambda path: F.get_json_object(json, f"$.{path}").try_cast("double")
    named = lambda under: [at(f"{under}{f}") for f in PRICE_FIELDS]
    two = F.get_json_object(json, "$.side_a").isNotNull() & F.get_json_object(json, "$.side_b").isNotNull()
    own = F.coalesce(*named(""), F.when(two, F.coalesce(*named("side_a."))), *named("outcomes[0]."))
    best = lambda side: F.coalesce(at(f"{side}[0][0]"), at(f"{side}[0].price"))
    book = F.when((best("bids") > 0) & (best("asks") > 0), (best("bids") + best("asks")) / 2)
    return F.coalesce(F.when(own.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), own))), book)


def market_volume(json: Column) -> Column:
    """A day's volume; a seventh of the week's where neither field of a day has one."""
    at = lambda path: F.nullif(F.get_json_object(json, f"$.{path}").try_cast("double"), F.lit(0.0))
    return F.coalesce(at("volume_24h"), at("volume_1_day"), at("volume_1_week") / 7, F.lit(0.0))


def read_markets(spark: SparkSession, path: str) -> DataFrame:
    """Prediction markets, one JSON object a line: a market, or an answer whose ``markets`` are a list of them."""
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    listed = F.from_json(F.get_json_object("value", "$.markets"), "array<string>")
    one = raw.select(F.explode(F.coalesce(listed, F.array("value"))).alias("value"))
    name = F.coalesce(F.get_json_object("value", "$.market_slug"), F.get_json_object("value", "$.slug"))
    return one.select(name.alias("market"), F.coalesce(F.get_json_object("value", "$.title"), F.get_json_object("value", "$.question"), name).alias("question"), market_price(F.col("value")).alias("price"), market_volume(F.col("value")).alias("volume"))


def posts(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """One record of submissions (id, text, author, is_self, url) and comments (id, body, author, parent_id).

    A link post has no text, a text post no url; a lost author is '[deleted]'; further columns are left out.
    """
    author = F.coalesce("author", F.lit("[deleted]")).alias("author")
    own = F.coalesce("is_self", F.lit(True))
    first = submissions.select(
        F.col("id").alias("content_id"), F.lit("submission").alias("content_type"), F.when(own, F.coalesce("text", F.lit(""))).otherwise("").alias("text"), F.when(own, "").otherwise(F.coalesce("url", F.lit(""))).alias("url"), author,
    )
    rest = comments.select(F.col("id").alias("content_id"), F.lit("comment").alias("content_type"), F.coalesce("body", F.lit("")).alias("text"), author, "parent_id")
    return first.unionByName(rest, allowMissingColumns=True)


def macro_snapshot(series: DataFrame, fallback: dict[str, float]) -> DataFrame:
    """One row of the last value of each series (name, ts, value), or its fallback, and the share of series that were there."""
    last = [F.max_by("value", F.when((F.col("name") == n) & F.col("value").isNotNull(), F.col("ts"))).alias(n) for n in fallback]
    row = series.agg(*last)
    there = sum((F.col(n).isNotNull().cast("int") for n in fallback), F.lit(0)) / len(fallback)
    return row.withColumn("completeness", there).withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in fallback.items()})


def save_csv(df: DataFrame, path: str) -> None:
    """A result as CSV files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_json(df: DataFrame, path: str) -> None:
    """A result as JSON lines, nested fields as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_ohlc(spark: SparkSession, path: str) -> DataFrame:
    """Price history (JSON lists of time in ms, open, high, low, close), once per time."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<double>>")).alias("c"))
    return rows.select(F.timestamp_millis(F.get("c", 0).cast("long")).alias("ts"), *[F.get("c", i).alias(n) for i, n in enumerate(("open", "high", "low", "close"), 1)]).where("ts is not null").dropDuplicates(["ts"])


def read_snapshots(spark: SparkSession, path: str, currency: str = "usd") -> DataFrame:
    """Current price and social figures, one JSON object a file; what a file lacks is null."""
    market = "current_price:map<string,double>,total_volume:map<string,double>,price_change_percentage_24h:double"
    schema = f"market_data struct<{market}>, sentiment_votes_up_percentage double, sentiment_votes_down_percentage double, community_data struct<reddit_subscribers:bigint,twitter_followers:bigint>"
    d = spark.read.schema(schema).json(path, multiLine=True)
    return d.select(
        F.col("_metadata.file_name").alias("file"), F.col("market_data.current_price")[currency].alias("price"), F.col("market_data.price_change_percentage_24h").alias("change_24h"), F.col("market_data.total_volume")[currency].alias("volume_24h"),
        F.col("sentiment_votes_up_percentage").alias("up_pct"), F.col("sentiment_votes_down_percentage").alias("down_pct"), F.col("community_data.reddit_subscribers").alias("readers"), F.col("community_data.twitter_followers").alias("followers"),
    )


IMPLIED_LOW, IMPLIED_HIGH = 30.0, 150.0  # fixed values


def read_implied_volatility(spark: SparkSession, path: str) -> DataFrame:
    """Implied-volatility candles (JSON objects whose ``data`` or ``result.data`` holds time in ms, open, high, low, close): the close as level and between 0 and 1."""
    raw = spark.read.schema("data array<array<double>>, result struct<data:array<array<double>>>").json(path, multiLine=True)
    rows = raw.select(F.explode(F.coalesce("data", "result.data")).alias("c"))
    level = F.get("c", 4)
    scaled = F.when(level.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (level - IMPLIED_LOW) / (IMPLIED_HIGH - IMPLIED_LOW))))
    return rows.select(F.timestamp_millis(F.get("c", 0).cast("long")).alias("ts"), level.alias("dvol"), scaled.alias("dvol_normalized"), *[F.get("c", i).alias(n) for i, n in enumerate(("open", "high", "low"), 1)]).where("ts is not null").dropDuplicates(["ts"])


def read_by_name(spark: SparkSession, folder: str, symbols: list[str]) -> DataFrame:
    """All CSV files (plain or gzip) of the symbols' folders as one table, books and trades told apart by the file's name.

    A file whose name holds "orderbook" has best bid and ask, any other has trades; ``kind`` says which, and columns of the other kind are null.
    Symbols without such files give no rows."""
    out = None
    for symbol in symbols:
        for kind, read in (("book", read_books_csv), ("trade", read_trades_csv)):
            names = _files(spark, f"{folder.rstrip('/')}/{symbol.lower()}")
            own = [n for n in names if n.lower().endswith((".csv", ".csv.gz")) and ("orderbook" in n.rsplit("/", 1)[-1].lower()) == (kind == "book")]
            if own:
                rows = read(spark, own).select(F.lit(symbol).alias("symbol"), F.lit(kind).alias("kind"), "*")
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "symbol string, kind string, ts timestamp, file string")
    return out


def _files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder, by the file system that Spark reads it with; none if it is absent."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(f.getPath()) for f in system.listStatus(at)) if system.exists(at) else []


def recent_posts(posts: DataFrame, tie: str, most: int = 50, hours_back: int = 24, sort: str = "hot", source: str = "source") -> DataFrame:
    """Posts (created, score, title, body) of the last hours before the newest one, at most ``most`` by source: the newest, or those of the highest score.

    ``hot`` weighs score down by age; ``tie`` orders equal ones."""
    cutoff = posts.agg((F.max("created") - F.make_dt_interval(F.lit(0), F.lit(hours_back))).alias("cutoff")).scalar()
    rows = posts.where(F.col("created") >= cutoff)
    by = {"new": F.col("created"), "top": F.col("score"), "hot": F.ln(F.greatest(F.col("score"), F.lit(1))) + F.unix_timestamp("created") / 3600}[sort]
    rank = F.row_number().over(Window.partitionBy(source).orderBy(by.desc_nulls_last(), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def post_text(title: Column, body: Column, most: int = 500) -> Column:
    """Title and the first characters of the body, or the title alone."""
    return F.when(F.coalesce(body, F.lit("")) == "", title).otherwise(F.concat(title, F.lit(" "), F.substring(body, 1, most)))


def by_period(df: DataFrame, periods: dict[str, tuple[str, str]], date: str = "date") -> DataFrame:
    """Rows of the named periods (first day, day after the last); a row of several periods comes once in each."""
    inside = [F.when((F.col(date) >= F.lit(a).cast("date")) & (F.col(date) < F.lit(b).cast("date")), F.lit(n)) for n, (a, b) in periods.items()]
    return df.withColumn("period", F.explode(F.array_compact(F.array(*inside))))


def regime_mix(df: DataFrame, by: list[str]) -> DataFrame:
    """Days and the percentage of each regime."""
    from marketlens.functions.expressions import REGIMES

    share = lambda n: (100 * F.count(F.when(F.col("regime") == n, 1)) / F.count(F.lit(1))).alias(n)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), *map(share, REGIMES))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per (symbol, day) from orders."""
    o = table(spark, sf_dir, "orders")
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return o.groupBy((key % SYMBOLS).alias("symbol"), F.col("o_orderdate").cast("date").alias("date")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.sum(price).alias("volume"), F.count(F.lit(1)).alias("trades")
    )


def index_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 0-100 index per day from order priorities."""
    urgent = F.when(F.col("o_orderpriority") <= "3", 1).otherwise(0)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg((100 * F.avg(urgent)).alias("fg"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price ticks per user from events, in UTC."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_type").alias("source"), "event_id")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade tape from line items: price, size, side and day, with a total order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") % SYMBOLS).alias("symbol"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))).alias("price"), F.col("l_quantity").cast("double").alias("size"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
    )
