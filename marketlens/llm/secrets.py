"""Secrets in text: fixed patterns, and strings that a character Markov model finds random; DataFrame functions only.

Two first-order character models are trained from labelled samples: random strings (digests in base64 and upper-case
base32) and ordinary ones (joined programming words in the usual styles, numbers and codes such as dates, paths, UUIDs and
ruled lines, and words of the corpus).
A run of 20 or more token characters holds a secret if the log-likelihood ratio of its best segment passes a threshold:
names, paths and words round a secret take nothing from it.  The span is the whole run.  What a pattern's span covers is left
to the pattern and ends a run; what is left of the run on either side is scored.

Spans are (kind, start, end) in code points, end exclusive.  Nulls: a null text is empty and has no span.  Repeated rows
are scanned again; extra columns are kept by ``redact``, whatever their names, and ignored by ``scan``; an empty table gives no
rows.  Texts of any length are scanned whole; where spans of kinds overlap, each is reported and ``redact`` puts one mark.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order, each kind's pattern, the group to measure and its least length.
KINDS = ("assign", "access", "hex", "markov")
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "markov": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
}
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WORDS = (
    "account action address admin agent alert array async audit auth backup balance batch block buffer build button byte cache call "
    "change channel check child class clean click client clock close cloud cluster code collect color column commit common compare config connect "
    "content context copy core count create cursor data date debug default delete deploy detail device digest document domain draft driver edit element "
    "email enable encode engine entry error event export factory feature field file filter final find flag float flow folder format frame function "
    "gateway group handle hash header height hidden history host image import index init input insert integer issue item join key label language last layer "
    "length level library limit line link list load local lock login loop main manager map master match max memory menu merge message method metric "
    "model module monitor month name network node normal note number object offset open option order output owner package page panel parent parse path "
    "pattern payload permission pipeline pixel plan player point policy pool port position prefix price print priority process product profile program "
    "project property provider proxy public query queue random range rate read record region remote remove render report request reset resource response "
    "result retry return role root route row rule sample save scale schedule schema score screen script search section select sender sequence server service "
    "session setting shape share shift signal single size slice socket sort source space split stack start state status step storage store stream string style "
    "summary support switch symbol sync system table target task template test text thread time timeout title total trace train transaction transform tree "
    "trigger type unit update upload user valid value vector version view volume wait warning watch weight width window word worker write zone"
).split()
SAMPLES = 4000
CORPUS_DOCS = 2000
SMOOTHING = 0.5
LEAST_RATIO = 16.0
SPAN_BLOCK = 128


def _pick(*salt) -> Column:
    words = F.split(F.lit(" ".join(WORDS)), " ")
    return F.get(words, F.pmod(F.xxhash64(*salt), F.lit(len(WORDS))).cast("int"))


def _numbers_and_codes(parts: list[Column], digest: Column) -> list[Column]:
    """Ordinary strings that are no joined words: dates, paths and names with numbers, phone and book numbers, accounts, UUIDs, ruled
    lines, counts, letters of a small alphabet, alphabets in order, plain letters in any order, names with acronyms, articles and addresses of devices."""
    digits = F.translate(digest, "abcdef", "012345")
    at = lambda start, n: F.substring(digits, start, n)
    hexa = lambda start, n: F.substring(digest, start, n)
    join = lambda sep, *c: F.concat_ws(sep, *c)
    year = (F.col("id") % 80 + 1970).cast("string")
    month, day = F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")
    short = [F.upper(F.substring(p, 1, 3)) for p in parts]
    title = [F.initcap(p) for p in parts]
    uuid = join("-", hexa(1, 8), hexa(9, 4), hexa(13, 4), hexa(17, 4), hexa(21, 12))
    turn = (F.col("id") % 26).cast("int")
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    turned = F.concat(F.substring(alphabet, turn + 1, F.lit(26)), F.substring(alphabet, F.lit(1), turn))
    first = (F.col("id") % 20).cast("int")
    small = lambda letters: F.translate(hexa(1, 40), "0123456789abcdef", letters)
    letters = F.regexp_replace(F.lower(F.base64(F.unhex(digest))), "[^a-z]", "")
    return [
        join("-", year, month, day, at(1, 2), at(3, 2), at(5, 2), at(7, 3)), F.concat(short[0], F.lit("_"), year, month, day, F.lit("_"), at(10, 6), F.lit("_"), short[1]), join("/", *parts[:2], year, month, day, *parts[2:]),
        uuid, F.upper(uuid), F.concat(F.lit("+"), join("-", at(1, 2), at(3, 3), at(6, 7), at(13, 5))), join("-", F.lit("978"), at(18, 1), at(19, 2), at(21, 6), at(27, 1)), F.concat(F.upper(F.substring(parts[0], 1, 2)), at(28, 20)),
        F.array_join(F.transform(F.sequence(first + 1, first + 11), lambda i: i.cast("string")), "/"), F.repeat(F.substring(F.lit("-_/="), (F.col("id") % 4 + 1).cast("int"), F.lit(1)), F.lit(40)), at(1, 24),
        small("ACGTACGTACGTACGT"), small("acgtacgtacgtacgt"), small("MDCLXVIMDCLXVIMD"), letters, turned, F.lower(turned), join("-", parts[0], parts[1], at(5, 4), parts[2]), F.concat(title[0], year, title[1], at(9, 3)),
        F.concat(parts[0], F.upper(F.substring(parts[1], 1, 4)), title[2], title[3]), F.concat(title[0], short[1], title[2], at(12, 1)), join("-", short[0], at(13, 4), at(17, 8), F.substring(short[1], 1, 2), F.upper(parts[2])),
        F.concat(short[0], at(25, 10), F.lit("-"), short[1], at(35, 9)), F.regexp_replace(F.upper(hexa(33, 16)), "(..)(?=.)", "$1-"), join("-", parts[0], at(44, 1), at(45, 1), parts[1], F.concat(F.lit("x"), at(46, 2)), at(48, 2), parts[2]),
    ]


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(label, word): label 1 random strings, label 0 identifiers, numbers and codes; words of about ``CORPUS_DOCS`` documents are ordinary too.

    Lower-case hex is no random sample: the pattern for it has its own kind, and UUIDs are ordinary."""
    ids = docs.sparkSession.range(SAMPLES)
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    kinds = F.array(F.substring(base64, 1, 40), F.translate(F.upper(F.substring(base64, 1, 32)), "+/=018", "QXZ234"), F.translate(F.substring(base64, 3, 36), "+/", "-_"), F.substring(base64, 5, 24))
    random = ids.select(F.lit(1).alias("label"), F.explode(kinds).alias("word"))
    parts = [_pick("id", F.lit(k)) for k in range(4)]
    number = F.pmod(F.xxhash64("id"), F.lit(100)).cast("string")
    styles = [F.concat_ws("_", *parts), F.concat_ws("-", *parts[:3]), F.concat(parts[0], *[F.initcap(p) for p in parts[1:]]), F.concat(*[F.initcap(p) for p in parts]), F.upper(F.concat_ws("_", *parts[:3])), F.concat_ws("/", *parts), F.concat(parts[0], F.initcap(parts[1]), number)]
    other = F.sha2(F.concat(F.lit("ordinary-"), F.col("id").cast("string")), 256)
    named = ids.select(F.lit(0).alias("label"), F.explode(F.array(*styles, *_numbers_and_codes(parts, other))).alias("word"))
    share = min(1.0, CORPUS_DOCS / max(1, docs.count()))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2**30)) < F.lit(share * 2**30))
    words = drawn.select(F.lit(0).alias("label"), F.explode(F.split("text", r"[^A-Za-z]+")).alias("word")).where(F.length("word") >= 6)
    return random.unionByName(named).unionByName(words)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of letters, row by row, the first row for the first letter.

    The table has a fixed size of letters squared, so it may come to the driver.
    """
    k = len(LETTERS)
    chars = F.split("word", "")
    code = lambda c: F.instr(F.lit(LETTERS), c)
    pairs = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.struct(F.when(i > 0, code(F.get(chars, i - 1))).otherwise(0).alias("a"), code(F.get(chars, i)).alias("b")))
    counts = samples.where(F.length("word") > 0).select("label", F.explode(pairs).alias("p")).groupBy("label", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).where((F.col("b") > 0))
    seen = {(r.label, r.a, r.b): r.n for r in counts.collect()}
    out = []
    for a in range(k + 1):
        of = [sum(seen.get((label, a, b), 0) for b in range(1, k + 1)) for label in (0, 1)]
        for b in range(1, k + 1):
            p = [(seen.get((label, a, b), 0) + SMOOTHING) / (of[label] + SMOOTHING * k) for label in (0, 1)]
            out.append(math.log(p[1] / p[0]))
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """The highest log-likelihood ratio, random over ordinary, of any segment of a token; 0 at least."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(LETTERS), c))
    start = F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(acc: Column, c: Column) -> Column:
        run = F.greatest(F.lit(0.0), acc["sum"] + F.when(c > 0, F.get(table, acc["a"] * len(LETTERS) + c - 1)).otherwise(0.0))
        return F.struct(c.alias("a"), run.alias("sum"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(codes, start, step)["best"]


NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _matches(text: Column, kind: str, model: list[float] | None = None) -> Column:
    """Spans of one kind: positions from the lengths of the pieces between matches and of the matches."""
    pattern, group, least = PATTERNS[kind]
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    keep = lambda m: F.length(m) >= least
    if model is not None:
        keep = lambda m: ratio(m, model) >= LEAST_RATIO
    items = F.arrays_zip(between.alias("gap"), F.transform(whole, F.length).alias("n"), F.transform(measured, keep).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["n"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["ok"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def spans_from(items: Column, at: Column) -> Column:
        return F.aggregate(items, F.struct(at.cast("int").alias("at"), F.array().cast(NO_SPANS).alias("out")), step)["out"]

    # arrays grow by copying: many matches are gathered in blocks, each from where the blocks before it end
    block = lambda b: F.slice(items, b * SPAN_BLOCK + 1, SPAN_BLOCK)
    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / SPAN_BLOCK).cast("int"))
    reach = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda a, x: a + x["gap"] + F.coalesce(x["n"], F.lit(0))))
    starts = F.aggregate(reach, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    many = F.flatten(F.transform(blocks, lambda b: spans_from(block(b), F.get(starts, b))))
    found = F.when(F.size(items) > SPAN_BLOCK, many).otherwise(spans_from(items, F.lit(0)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(NO_SPANS))


def _text_of(spans: Column) -> Column:
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of sorted spans, so that positions stay."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        blank = F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(acc["at"], s["start"])))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, blank).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def with_spans(docs: DataFrame, model: list[float], text_col: str = "text", base: str = "base_spans", every: str = "all_spans") -> DataFrame:
    """Adds two columns, named by ``base`` and ``every``: the spans of the patterns, and all, each sorted by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn(base, F.array_sort(F.concat(*[_matches(text, k) for k in KINDS[:3]])))
    rest = F.when(F.size(base) > 0, _blanked(text, F.col(base))).otherwise(text)
    found = found.withColumn(f"{every}_rest", rest)
    markov = _matches(F.col(f"{every}_rest"), "markov", model)
    return found.withColumn(every, F.array_sort(F.concat(F.col(base), markov))).drop(f"{every}_rest")


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """doc_id, counts of each base kind, the base spans' digest, all spans as text."""
    model = train(labelled_samples(docs)) if model is None else model
    found = with_spans(docs.select("doc_id", "text"), model).select("doc_id", "base_spans", "all_spans")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(F.encode(_text_of(F.col("base_spans")), "UTF-8"), 256).alias("base_sha256"), _text_of(F.col("all_spans")).alias("spans"))


def redact(docs: DataFrame, model: list[float] | None = None, mark: str = "[REDACTED]", text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans become one mark, other rows stay as they are."""
    model = train(labelled_samples(docs)) if model is None else model
    base, every = "_redact_base", "_redact_all"
    found = with_spans(docs, model, text_col, base, every)
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(every, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rest = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return found.withColumn(text_col, F.when(F.size(every) > 0, rest).otherwise(text)).drop(base, every)
