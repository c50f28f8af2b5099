"""Secret scans: patterns, and a randomness test battery over long strings. DataFrame functions only.

Base kinds are patterns. The battery looks at every run of 20 or more characters that encodings use. It infers the
encoding (upper-case hexadecimal, base32, base36, alphanumeric, base64), then tests the run against uniform random symbols: a
chi-squared test of the alphabet, a runs test about the middle of the alphabet and a lag-one serial correlation, added up
to one chi-squared statistic with three degrees of freedom. Benjamini-Hochberg over these p-values, separately for each
length class, finds the runs that are not random; they are no secrets.

A short ordinary string may look random. So what is left is also measured against ordinary writing: its alphabet count
(equal pairs of symbols, which decide the chi-squared statistic; ordinary text has an index of coincidence of 6.5 % or more) and,
in the alphabets of one case, whose random symbols repeat nearly as often (hexadecimal: 1/16), its runs of digits and letters
and its letters that are all A to F or digits that are all 2 to 7, by Fisher's method. These p-values go through
Benjamini-Hochberg for each length class too, so the many short runs do not hide the long ones or pass by number.

Spans count code points, end exclusive. A text is read once: its spans and p-values are written, and the cutoffs come from
them. Folds over the matches of a text go by chunks of CHUNK, so that their cost grows with the matches and not with the square.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Kinds in the order of the result, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RANDOM = r"[A-Za-z0-9+/_-]{20,}"
#: Letter pairs of ordinary text that are equal.
REPEATS = 0.065
#: Neighbours in ordinary text of which one is a digit and one a letter; its letters that are A to F, its digits that are 2 to 7.
CHANGES = 0.05
HEX_LETTERS = 0.35
BASE32_DIGITS = 0.6
#: Shares of false discoveries: of random runs among those found not random, of ordinary runs among those found to be secrets.
FALSE_REJECTIONS = 0.001
FALSE_DISCOVERIES = 0.01
CHUNK = 256
#: Lower ends of the length classes.
LENGTHS = (20, 24, 32, 48, 64, 128)


def _let(value: Column, body) -> Column:
    """body(value) with value computed, and spelled out in the plan, once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chunks(items: Column) -> Column:
    """The numbers of the chunks of an array that is not empty."""
    return F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))


def _chunk(items: Column, number: Column) -> Column:
    return F.slice(items, number * CHUNK + 1, F.lit(CHUNK))


def _running(values: Column, combine) -> Column:
    """Of an array of whole numbers, what combine makes of 0 and all values before each."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda a, v: F.struct(combine(a["at"], v).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])


def _matches(text: Column, pattern: str, kind: int, value_group: bool = False) -> Column:
    """array<struct<start, kind, end, s>> of pattern's matches: positions are sums of the pieces before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("p"), found.alias("m")), lambda x: F.struct(F.length(x["p"]).alias("gap"), x["m"].alias("m")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,s:string>>")

    def add(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("s"))).alias("out"))

    def placed(all_: Column) -> Column:
        lengths = F.transform(_chunks(all_), lambda c: F.aggregate(_chunk(all_, c), F.lit(0), lambda a, x: a + x["gap"] + F.length(x["m"])))
        offsets = _running(lengths, lambda a, n: a + n)
        return F.flatten(F.transform(offsets, lambda at, c: F.aggregate(_chunk(all_, c), F.struct(at.alias("at"), empty.alias("out")), add, lambda acc: acc["out"])))

    spans = _let(pieces, placed)
    if value_group:
        spans = F.filter(spans, lambda x: F.length(F.regexp_extract(x["s"], pattern, 1)) >= 6)
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Spans of the kinds assign, access and hex, ordered by start, then kind."""
    found = F.concat(_matches(text, ASSIGN, 0, True), _matches(text, ACCESS, 1), _matches(text, HEX, 2))
    return F.array_sort(found)


def _normal_cdf(z: Column) -> Column:
    """Zelen and Severo's rational approximation; good to 8e-8 of the density for either sign."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z < 0, tail).otherwise(1 - tail)


#: The alphabets, in the order in which they are tried.
ALPHABETS = (("^[0-9A-F]+$", "0123456789ABCDEF"), ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
             ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"))


def battery(s: Column) -> Column:
    """struct<p_random, p_chance> of a string over an encoding's characters, null where it has letters of one case and no digit.

    p_random is small if the string is not uniformly random; p_chance is small if ordinary text would repeat more symbols.
    """
    alphabet = F.lit(ALPHABETS[-1][1])
    for pattern, letters in reversed(ALPHABETS[:-1]):
        alphabet = F.when(s.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]") | s.rlike("[a-z][A-Z]") & s.rlike("[A-Z]{2}|[A-Z][a-z][A-Z]")
    # base64 has 64 symbols, whichever pair of marks it uses
    known = _let(alphabet, lambda a: F.struct(a.alias("a"), F.least(F.length(a), F.lit(64)).cast("double").alias("k"), F.length(s).cast("double").alias("n"), F.split(s, "").alias("symbols")))
    return F.when(mixed, _let(known, lambda v: _let(_counted(s, v), lambda c: _let(_tested(c), _combined))))


def _counted(s: Column, v: Column) -> Column:
    """struct<k, n, squares, x, letters, changes>: sizes, the sum of squared symbol counts, the symbols' numbers about the middle, letters, and changes between digits and letters."""
    counts = F.transform(F.array_distinct(v["symbols"]), lambda c: v["n"] - F.length(F.replace(s, c, F.lit(""))))
    x = F.transform(v["symbols"], lambda c: F.least(F.call_function("instr", v["a"], c), v["k"]) - 1 - (v["k"] - 1) / 2)
    return F.struct(v["k"].alias("k"), v["n"].alias("n"), F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c).alias("squares"), x.alias("x"), F.length(F.translate(s, "0123456789", "")).cast("double").alias("letters"), (F.size(F.split(s, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")) - 1).cast("double").alias("changes"))


def _tested(c: Column) -> Column:
    """struct<q, equal, mean, ...>: the battery's sum of squares, equal pairs, and those of ordinary text; k, n, letters and changes as they are."""
    k, n = c["k"], c["n"]
    chi = (k / n * c["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    pairs = F.arrays_zip(F.slice(c["x"], F.lit(1), (n - 1).cast("int")).alias("a"), F.slice(c["x"], F.lit(2), (n - 1).cast("int")).alias("b"))
    start = F.struct(F.lit(0.0).alias("turns"), F.lit(0.0).alias("products"))
    sums = F.aggregate(pairs, start, lambda t, p: F.struct((t["turns"] + F.when((p["a"] < 0) != (p["b"] < 0), 1.0).otherwise(0.0)).alias("turns"), (t["products"] + p["a"] * p["b"]).alias("products")))
    q = _let(sums, lambda t: F.pow((t["turns"] - (n - 1) / 2) / F.sqrt((n - 1) / 4), F.lit(2)) + F.pow(t["products"] / ((k * k - 1) / 12) / F.sqrt(n - 1), F.lit(2)))
    return F.struct((q + F.pow(F.greatest(chi, F.lit(0.0)), F.lit(2))).alias("q"), ((c["squares"] - n) / 2).alias("equal"), (n * (n - 1) / 2 * REPEATS).alias("mean"), *(c[x].alias(x) for x in ("k", "n", "letters", "changes")))


def _combined(t: Column) -> Column:
    # survival function of chi-squared with three degrees of freedom
    p_random = 2 * _normal_cdf(-F.sqrt(t["q"])) + F.sqrt(2 * t["q"] / math.pi) * F.exp(-t["q"] / 2)
    chance = _let(2 * (F.sqrt(t["equal"] + 0.375) - F.sqrt(t["mean"] + 0.375)), _normal_cdf)
    return F.struct(p_random.alias("p_random"), _let(chance, lambda p: F.when(t["k"] <= 36, _of_one_case(t, p)).otherwise(p)).alias("p_chance"))


def _of_one_case(t: Column, repeats: Column) -> Column:
    """Fisher's combination of the p-values of repeats, of changes and, for the narrow alphabets, of symbols that all lie in them."""
    changes = _normal_cdf(-2 * (F.sqrt(F.greatest(t["changes"] - 0.125, F.lit(0.0))) - F.sqrt((t["n"] - 1) * CHANGES + 0.375)))
    narrow = F.when(t["k"] == 16, F.pow(F.lit(HEX_LETTERS), t["letters"])).when(t["k"] == 32, F.pow(F.lit(BASE32_DIGITS), t["n"] - t["letters"])).otherwise(F.lit(1.0))
    # survival functions of chi-squared with six and with four degrees of freedom
    less = lambda x: -F.log(F.greatest(x, F.lit(1e-300)))
    return _let(less(repeats) + less(changes) + less(narrow), lambda h: F.exp(-h) * (1 + h + F.when(t["k"] < 36, h * h / 2).otherwise(F.lit(0.0))))


def _replaced(text: Column, spans: Column, fill) -> Column:
    """text with fill(start of what is new, span) for every one of spans, which are in order and may overlap; null stays null."""

    def cut(part: Column, first: Column):
        """Folds the spans of a chunk; part is the text from code point first on."""

        def step(acc, x):
            kept = F.substring(part, acc["at"] - first + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], kept, fill(acc["at"], x)).alias("out"))

        return step

    def chunked(all_: Column) -> Column:
        ends = F.transform(_chunks(all_), lambda c: F.array_max(F.transform(_chunk(all_, c), lambda x: x["end"])))
        done = _running(ends, lambda a, e: F.greatest(a, e))

        def piece(at: Column, c: Column) -> Column:
            part = F.substring(text, at + 1, F.greatest(F.element_at(ends, c + 1) - at, F.lit(0)))
            return _let(part, lambda p: F.aggregate(_chunk(all_, c), F.struct(at.alias("at"), F.lit("").alias("out")), cut(p, at), lambda acc: acc["out"]))

        rest = F.substring(text, F.array_max(ends) + 1, F.length(text))
        return F.concat(F.array_join(F.transform(done, piece), ""), rest)

    return F.when(F.size(spans) > 0, _let(spans, chunked)).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    """text with a space for every character of spans, which are in order."""
    return _replaced(text, spans, lambda at, x: F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(at, x["start"]), F.lit(0))))


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, kind, end, p>> of the strings to judge, with their p-values: the parts of runs outside base spans."""
    free = _let(_blanked(text, base), lambda t: _matches(t, RANDOM, 3))
    tested = F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), battery(x["s"]).alias("p")))
    return F.filter(tested, lambda x: x["p"].isNotNull())


def _length_class(x: Column) -> Column:
    n = x["end"] - x["start"]
    return sum((F.when(n >= least, 1).otherwise(0) for least in LENGTHS[1:]), F.lit(0))


def _evidence(p: Column) -> Column:
    """-100 log10 of a p-value as a whole number, 0 to 3000; rounded down, which never adds a discovery."""
    return F.least(F.greatest(F.floor(-100 * F.log10(F.greatest(p, F.lit(1e-30)))), F.lit(0)), F.lit(3000)).cast("int")


#: The two families of p-values and their shares of false discoveries.
FAMILIES = (("p_random", FALSE_REJECTIONS), ("p_chance", FALSE_DISCOVERIES))


def cutoffs(tested: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Least evidence of a discovery by length class (none: no discovery), for both families, from the column found of tested.

    Counts per family, class and whole-number evidence: at most 2 x 6 x 3001 rows, whatever the input; the cutoffs are 12 at
    most. The second family holds what the first has not rejected.
    """
    out: list[dict[int, int]] = []
    for name, share in FAMILIES:
        at = tested.select(F.explode("found").alias("x")).select(_length_class(F.col("x")).alias("length_class"), _evidence(F.col("x.p.p_random")).alias("first"), _evidence(F.col(f"x.p.{name}")).alias("evidence"))
        if out:
            at = at.where(F.col("first") < _cutoff(out[0], F.col("length_class")))
        at = at.groupBy("length_class", "evidence").agg(F.count("*").alias("n"))
        falling = Window.partitionBy("length_class").orderBy(F.col("evidence").desc())
        at = at.withColumn("rank", F.sum("n").over(falling)).withColumn("all", F.sum("n").over(Window.partitionBy("length_class")))
        passed = F.pow(F.lit(10.0), -F.col("evidence") / 100) <= F.col("rank") / F.col("all") * share
        out.append({r[0]: r[1] for r in at.where(passed).groupBy("length_class").agg(F.min("evidence")).collect()})
    return out[0], out[1]


def _cutoff(least: dict[int, int], length_class: Column) -> Column:
    return F.element_at(F.array(*(F.lit(least.get(i, 10**6)) for i in range(len(LENGTHS)))), length_class + 1)


def scan(documents: DataFrame, text_col: str = "text", columns: tuple[str, ...] | None = None) -> DataFrame:
    """columns of documents (None: all), base and spans: arrays of struct<start, kind, end>, by start, then kind (an index into KINDS).

    Null text is empty and has no spans; a text may be of any length and have any number of matches; equal rows get equal
    spans; an empty table gives an empty result. A column base or spans of documents is left out for the operator's own;
    other columns do not matter, whatever their names. columns travel through the written table of spans.
    """
    names = {f"c{i}": c for i, c in enumerate(documents.columns if columns is None else columns) if c not in ("base", "spans")}
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    read = documents.select(*(F.col(c).alias(k) for k, c in names.items()), text.alias("text"))
    read = read.withColumn("base", plain(base_spans(F.col("text")))).withColumn("found", candidates(F.col("text"), F.col("base")))
    tested = written(read.drop("text"), "secrets")
    rejected, ordinary = cutoffs(tested)
    good = F.filter("found", lambda x: (_evidence(x["p"]["p_random"]) < _cutoff(rejected, _length_class(x))) & (_evidence(x["p"]["p_chance"]) >= _cutoff(ordinary, _length_class(x))))
    return tested.select(*(F.col(k).alias(c) for k, c in names.items()), "base", F.array_sort(F.concat("base", plain(good))).alias("spans"))


def spelled(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of every span, comma-joined."""
    kind = lambda x: F.element_at(F.array(*map(F.lit, kinds)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with every run of overlapping spans replaced by mark; null stays null."""
    return _replaced(text, spans, lambda at, x: F.when(x["start"] >= at, F.lit(mark)).otherwise(F.lit("")))
