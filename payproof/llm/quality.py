"""Quality rules: surface counts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Tokens are runs of letters and digits, or of other marks. Every single token and every pair of neighbours falls by its hash into
one of 65,536 buckets. Two multinomials over the buckets are counted over all documents: the raw corpus, and the trusted
part of it (texts of some length with few symbols and few capitals). A document's score is the mean over its n-grams
of log(trusted share / raw share); below THRESHOLD it is rejected.

Everything is a DataFrame function. The counts are one aggregate with map-side combine; the weights are BUCKETS numbers
whatever the size of the corpus, so they go into the second pass as one constant array. Nothing else is moved.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payproof.llm.steps import Steps

BUCKETS = 1 << 16            # a power of two
THRESHOLD = -0.25            # nats per n-gram
TRUSTED_CHARS = 300          # fewest characters of a trusted text
TRUSTED_SYMBOLS = 0.01       # most symbols per character
TRUSTED_CAPITALS = 0.2       # most capitals A to Z per character
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEWEST_WORDS = 10
MOST_REPEATED = 20           # percent of words in repeated windows
WINDOW = 5


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body's own loops use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chars_of(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _repeated(hashes: Column) -> Column:
    """Words that windows with a hash found twice or more cover, from the hashes of all windows."""
    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")))["n"]

    def close(s: Column) -> Column:
        """Windows, by hash and place, that agree with another in half of the hash: what is sorted whole are these few."""
        n = F.size(s) - 1
        beside = F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), lambda a, b: F.when(F.shiftright(a.bitwiseXOR(b), 32) == 0, F.array(a, b)))
        place = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        return F.transform(F.array_distinct(F.flatten(F.filter(beside, lambda x: x.isNotNull()))), lambda x: F.struct(F.get(hashes, place(x)).alias("h"), place(x).alias("i")))
    halves = F.transform(hashes, lambda h, i: F.shiftleft(h, 32).bitwiseOR(i.cast("long")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(F.sort_array(halves), lambda s: _let(F.sort_array(close(s)), covered)))


def _repeat_words(words: Column) -> Column:
    def joined(a: Column, b: Column, skip: int, n: Column) -> Column:
        """The hashes of neighbouring runs: the run at a place of `a` and the one `skip` words further on in `b`."""
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(skip + 1), n), lambda x, y: F.xxhash64(x, y))

    def windows(h: Column) -> Column:
        """Of each five words: every word is hashed once, pairs are joined to fours and fours to fives."""
        pairs = joined(h, h, 1, F.size(h) - 1)
        return _let(pairs, lambda p: joined(joined(p, p, 2, F.size(h) - 3), h, 4, F.size(h) - 4))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) < WINDOW, 0).otherwise(_let(windows(h), _repeated)))


def surface(text: Column) -> Column:
    """A struct of w (n_words, word_chars, n_repeat_words), n_symbols and n_dup_lines of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    long = lambda c, name: c.cast("long").alias(name)
    counted = _let(_words(text), lambda w: F.struct(long(F.size(w), "n_words"), long(F.char_length(F.array_join(w, "")), "word_chars"), long(_repeat_words(w), "n_repeat_words")))
    return F.struct(counted.alias("w"), long(_chars_of(text, SYMBOLS), "n_symbols"),
                    long(_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_dup_lines"))


def grams(text: Column) -> Column:
    """Hashes of a text's single tokens and pairs of neighbours: a token is hashed once, a pair is the hash of two hashes."""
    def both(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.concat(t, F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.xxhash64(a, b)))
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0))
    return _let(F.transform(tokens, lambda x: F.xxhash64(x)), both)


def _bucket(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def weights(docs: DataFrame, text: str = "text") -> list[float]:
    """The log ratio of each bucket: BUCKETS numbers, each share with one n-gram more than was counted."""
    steps = Steps(docs.sparkSession)
    chars = F.char_length(text)
    trusted = (chars >= TRUSTED_CHARS) & (_chars_of(F.col(text), SYMBOLS) <= chars * TRUSTED_SYMBOLS) & (_chars_of(F.col(text), "A-Z") <= chars * TRUSTED_CAPITALS)
    # mark and n-grams of a text are computed below the explode, and once: a plain explode would ask for the number of n-grams before it
    marked = docs.where(F.col(text).isNotNull()).select(trusted.cast("int").alias("good"), grams(F.col(text)).alias("grams"))
    found = marked.select("good", F.explode_outer("grams").alias("gram")).where("gram IS NOT NULL").groupBy((_bucket(F.col("gram")) * 2 + F.col("good")).alias("code")).agg(F.count("*").alias("n"))
    counts = found.groupBy(F.shiftright("code", 1).alias("bucket")).agg(F.sum("n").alias("raw"), F.sum(F.when(F.col("code") % 2 == 1, F.col("n")).otherwise(0)).alias("good"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = steps.write(every.join(counts, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "good")]))
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    ratio = F.log((F.col("good") + 1) / (total["good"] + BUCKETS)) - F.log((F.col("raw") + 1) / (total["raw"] + BUCKETS))
    out = [r["w"] for r in counts.select("bucket", ratio.alias("w")).orderBy("bucket").collect()]
    steps.drop(counts)
    return out


def score(text: Column, weight: list[float]) -> Column:
    """The mean weight of a text's n-grams; 0 without any."""
    table = F.split(F.lit(",".join(map(repr, weight))), ",").cast("array<double>")
    return _let(grams(text), lambda g: F.when(F.size(g) == 0, 0.0).otherwise(F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, _bucket(b))) / F.size(g)))


def judged(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """docs with a struct column `out`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    Counts: words (runs of anything but ASCII white space), code points in words, characters of #*$%&|<>, lines with a word
    that equal an earlier line, words in five-word windows found twice or more in the text. base_failed: under 10 words, or over
    20% of them in such windows. kept: not base_failed, and llr (see above) at least THRESHOLD. A null text is an empty
    one: no words, base_failed. Repeated rows each count and each get a verdict. An empty table gives an empty
    result. All other columns stay; one named like `out` is replaced."""
    weight = weights(docs, text)
    q = _let(surface(F.col(text)), lambda s: F.struct(
        s["w"]["n_words"].alias("n_words"), s["w"]["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"), s["n_dup_lines"].alias("n_dup_lines"),
        s["w"]["n_repeat_words"].alias("n_repeat_words"),
        ((s["w"]["n_words"] < FEWEST_WORDS) | (100 * s["w"]["n_repeat_words"] > MOST_REPEATED * s["w"]["n_words"])).alias("base_failed")))
    verdict = F.struct("__q.*", F.col("__llr").alias("llr"), (~F.col("__q.base_failed") & (F.col("__llr") >= THRESHOLD)).alias("kept"))
    others = [c for c in docs.columns if c != out]
    return docs.withColumns({"__q": q, "__llr": score(F.col(text), weight)}).select(*others, verdict.alias(out))
