"""Secret scans in DataFrame functions alone.

Three patterns of known shapes give the base spans. The method adds tokens that
pass a battery of randomness tests. A candidate is a run of 20 or more characters
of base64 or its URL form, with a digit and a letter; the narrowest encoding that
holds all its characters is inferred. A run that holds both + or / and - or _ fits
none: its parts of 20 or more between + and /, and those between - and _, are
candidates, which may overlap. Over that alphabet three p-values say how
well the token agrees with uniform random symbols: chi-squared of the symbol
counts, the number of runs in the lower and upper half of the alphabet, and the
serial correlation of neighbours. Fisher's method combines them.

False discoveries are controlled for each encoding and length class on its own,
as the tests have more power on longer tokens: random tokens have uniform
p-values and others small ones, so twice the number above 1/2 estimates how many
random ones there are. The least p-value that counts as random is the lowest at
which the estimated share of others among all above it is at most RATE.

Positions are code points, end exclusive. Split and the extraction of all matches
run the same leftmost search, so the pieces between matches give their positions.

Defined results: a null text is empty and has no spans. Repeated rows are scanned
each. Very long texts are scanned whole, in time linear in their length. An empty
table gives no rows. Extra columns are ignored. Spans of the method that equal a base span are left out; others may overlap one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind, expression, group that must have LEAST characters.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
ADDED = "random"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Of a run that fits no encoding, the parts without the signs of the one or the other.
PARTS = [r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9+/]{20,}"]
RATE, BINS = 0.1, 100

_LOWER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_UPPER = _LOWER.upper()
#: Encodings from narrow to wide: name and alphabet, in the order of its symbols' values.
ENCODINGS = [
    ("hex", _DIGIT + "abcdef"), ("HEX", _DIGIT + "ABCDEF"), ("base32", _UPPER + "234567"), ("base36", _DIGIT + _LOWER), ("BASE36", _DIGIT + _UPPER),
    ("base62", _DIGIT + _UPPER + _LOWER), ("base64", _UPPER + _LOWER + _DIGIT + "+/"), ("base64url", _UPPER + _LOWER + _DIGIT + "-_"),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(text: Column, pattern: str, group: int = 0, least: int = 1, block: int = 64) -> Column:
    """start, end and text of each match whose group is long enough; the text comes from the search, as cutting it out would walk to it from the text's start.

    Prefix sums go by blocks, so that a text of many matches takes no quadratic time.
    """

    def place(v: Column) -> Column:
        return let(
            F.struct(v["m"].alias("m"), v["g"].alias("g"), F.transform(v["m"], lambda x, i: F.length(F.get(v["p"], i))).alias("gap"), F.transform(v["m"], lambda x, i: F.length(F.get(v["p"], i)) + F.length(x)).alias("step")),
            lambda w: let(
                F.struct(w["m"].alias("m"), w["g"].alias("g"), w["gap"].alias("gap"), w["step"].alias("step"),
                         F.transform(F.sequence(F.lit(0), F.floor((F.size(w["m"]) - 1) / block).cast("int")), lambda b: total(F.slice(w["step"], b * block + 1, F.lit(block)))).alias("sums")),
                lambda y: let(
                    F.struct(y["m"].alias("m"), y["g"].alias("g"), y["gap"].alias("gap"), y["step"].alias("step"),
                             F.transform(y["sums"], lambda x, b: total(F.slice(y["sums"], F.lit(1), b))).alias("base")),
                    lambda z: F.filter(
                        F.transform(z["m"], lambda x, i: let(
                            F.get(z["base"], F.floor(i / block).cast("int")) + total(F.slice(z["step"], F.floor(i / block).cast("int") * block + 1, i % block)) + F.get(z["gap"], i),
                            lambda s: F.struct(s.alias("start"), (s + F.length(x)).alias("end"), x.alias("text"), (F.length(F.get(z["g"], i)) >= least).alias("ok")))),
                        lambda s: s["ok"]),
                ),
            ),
        )

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0), lambda a, x: a + x)

    none = F.array().cast("array<struct<start:int,end:int,text:string,ok:boolean>>")
    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("p"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m).alias("g")), place)),
    )
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))


def places(spans: Column) -> Column:
    """start and end alone."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def above(z: Column) -> Column:
    """Upper tail of the standard normal distribution, to 1e-7 (Abramowitz and Stegun 26.2.17)."""

    def tail(v: Column) -> Column:
        t = 1 / (1 + 0.2316419 * v)
        return let(t, lambda t: F.exp(-v * v / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))

    return let(F.least(F.abs(z), F.lit(37.0)), lambda v: let(tail(v), lambda p: F.when(z >= 0, p).otherwise(1 - p)))


def battery(token: Column, alphabet: str) -> Column:
    """Fisher's combination of the p-values of chi-squared, runs and serial correlation over this alphabet."""
    k = len(alphabet)
    n = F.length(token).cast("double")
    squares = F.aggregate(F.array(*(F.lit(c) for c in alphabet)), F.lit(0.0), lambda a, c: a + F.pow((F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"), F.lit(2.0)))
    # Wilson-Hilferty, with the variance that few draws have
    chi = let(((k / n) * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n), lambda z: above((F.pow(F.greatest(1 + z * (2 / (k - 1)) ** 0.5, F.lit(0.0)), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / (2 / (9 * (k - 1))) ** 0.5))
    half = F.translate(token, alphabet, "L" * (k // 2) + "H" * (k - k // 2))

    def runs(h: Column) -> Column:
        high = F.length(F.replace(h, F.lit("L"), F.lit(""))).cast("double")
        mean = 1 + 2 * high * (n - high) / n
        count = F.length(F.regexp_replace(h, "L+|H+", "x"))
        return let(mean, lambda m: F.when(m <= 2, F.lit(0.0)).otherwise(2 * above(F.abs(count - m) / F.sqrt((m - 1) * (m - 2) / (n - 1)))))

    values = F.transform(F.split(token, ""), lambda c: (F.instr(F.lit(alphabet), c) - 1 - (k - 1) / 2).cast("double"))

    def serial(x: Column) -> Column:
        dot = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y)
        mean = dot(x) / n
        return let(mean, lambda m: let(
            F.struct(dot(F.transform(x, lambda y: (y - m) * (y - m))).alias("all"), dot(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: (a - m) * (b - m))).alias("next")),
            lambda s: F.when(s["all"] <= 0, F.lit(0.0)).otherwise(2 * above(F.abs(s["next"] / s["all"] + 1 / n) * F.sqrt(n)))))

    def combined(p: Column) -> Column:
        x = -F.log(F.greatest(p["c"], F.lit(1e-300))) - F.log(F.greatest(p["r"], F.lit(1e-300))) - F.log(F.greatest(p["s"], F.lit(1e-300)))
        return let(x, lambda v: F.least(F.exp(-v) * (1 + v + v * v / 2), F.lit(1.0)))

    return let(F.struct(chi.alias("c"), let(half, runs).alias("r"), let(values, serial).alias("s")), combined)


def tested(text: Column) -> Column:
    """start, end, class and p of each candidate; class: encoding and length class."""

    def one(span: Column) -> Column:
        def judged(t: Column) -> Column:
            name, p = F.lit(None).cast("string"), F.lit(0.0)
            for own, alphabet in reversed(ENCODINGS):
                fits = t.rlike("^[" + alphabet.replace("-", "\\-") + "]+$")
                name, p = F.when(fits, F.lit(own)).otherwise(name), F.when(fits, battery(t, alphabet)).otherwise(p)
            keep = t.rlike("[0-9]") & t.rlike("[A-Za-z]")
            size = F.floor(2 * F.log2(F.length(t) / 20)).cast("int")
            return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.when(keep, F.concat_ws(":", name, size)).alias("class"), F.when(keep, p).otherwise(F.lit(0.0)).alias("p"))

        return let(span["text"], judged)

    def candidates(span: Column) -> Column:
        def parts(t: Column) -> Column:
            found = F.array_distinct(F.concat(*(positions(t, pattern) for pattern in PARTS)))
            moved = F.transform(found, lambda x: F.struct((span["start"] + x["start"]).alias("start"), (span["start"] + x["end"]).alias("end"), x["text"].alias("text")))
            return F.when(t.rlike("[+/]") & t.rlike("[_-]"), moved).otherwise(F.array(F.struct(span["start"].alias("start"), span["end"].alias("end"), t.alias("text"))))

        return let(span["text"], parts)

    return F.filter(F.transform(F.flatten(F.transform(positions(text, CANDIDATE), candidates)), one), lambda s: s["class"].contains(":") & s["p"].isNotNull())


def levels(docs: DataFrame, rate: float = RATE) -> dict[str, float]:
    """The least p-value that counts as random, for each class that has one. As many rows as classes, whatever the input."""
    seen = docs.select(F.explode(tested(F.coalesce(F.col("text"), F.lit("")))).alias("t")).select(F.col("t.class").alias("class"), F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).alias("bin"))
    by: dict[str, dict[int, int]] = {}
    for r in seen.groupBy("class", "bin").count().collect():
        by.setdefault(r["class"], {})[r["bin"]] = r["count"]
    out = {}
    for name, bins in by.items():
        random = 2 * sum(c for b, c in bins.items() if b >= BINS // 2)
        for low in range(1, BINS // 2 + 1):
            over = sum(c for b, c in bins.items() if b >= low)
            if over and 1 - random * (1 - low / BINS) / over <= rate:
                out[name] = low / BINS
                break
    return out


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id and spans, an array of kind, start and end by start, then kind: base kinds as listed, then the added one."""
    least = levels(docs, rate)
    text = F.coalesce(F.col("text"), F.lit(""))
    arrays = [places(positions(text, pattern, group, size)).alias(name) for name, pattern, group, size in KINDS]
    if least:
        table = F.create_map(*(x for k, v in sorted(least.items()) for x in (F.lit(k), F.lit(v))))
        random = F.transform(F.filter(tested(text), lambda s: s["p"] >= F.coalesce(F.element_at(table, s["class"]), F.lit(2.0))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    else:
        random = F.array().cast("array<struct<start:int,end:int>>")
    found = docs.select("doc_id", F.struct(*arrays, random.alias(ADDED)).alias("s"))

    def told(spans: Column, n: int, kind: str) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("n"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    def joined(s: Column) -> Column:
        base = F.concat(*(s[k] for k, *_ in KINDS))
        own = [told(s[k], n, k) for n, (k, *_) in enumerate(KINDS)]
        return F.array_sort(F.concat(*own, told(F.array_except(s[ADDED], base), len(KINDS), ADDED)))

    return found.select("doc_id", let(F.col("s"), joined).alias("spans"))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
