"""Secret scan by DataFrame functions alone: fixed patterns and a battery of randomness tests.

Base kinds, leftmost non-overlapping each: assign, access and hex. Kind ``random`` adds maximal runs
of encoded characters that pass for random. The encoding (hex, base32, alphanumeric, base64) is
inferred from the characters. Three questions are asked of a run:

* Can it be random? Three tests take uniform symbols of the encoding as the null hypothesis:
  chi-squared uniformity (Wilson-Hilferty), the runs test around the middle of the alphabet and lag-1
  serial correlation. A run whose joint p-value (Bonferroni) is under REJECTED is not random.
* Can it be ordinary text? Here names and words are the null hypothesis: their letters are uneven, so
  chi-squared has a noncentral mean of n * UNEVEN above its degrees of freedom, and their characters
  change class (upper, lower, digit) at a rate of CHANGES at most. Both deviations towards randomness
  are joined by Stouffer's sum to one p-value.

* Is it text in disguise? Base64 (in all four phases), base32 and hex runs are decoded; one of whose bytes at most
  JUNK lie outside well-formed printable UTF-8 holds text, and is not random. Of random runs of 24 characters
  about one in two thousand is lost by that, and fewer of longer ones.

A run is reported when the first question is not denied, it holds no text, and Benjamini-Hochberg control at LEVEL over
all candidates of the corpus with the same encoding and length class denies the second. So of what is
reported about LEVEL at most is ordinary text, as far as that model holds, and the level that a run
must reach follows its length. The p-value histogram that reaches the driver has a fixed number of
cells. Not tested: runs without a digit or without a letter, and runs shorter than their encoding's
least length.

Null text is empty: no spans. Offsets are code points, ends exclusive. Matches of one kind do not
overlap; of ties in start the kind listed first comes first. Texts of any length are scanned whole.
Repeated rows get equal results; empty tables give empty results; other columns stay, whatever their
names, but for one that has the name of the column added, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

#: The base patterns in their order of listing; assign needs 8 characters of value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
LEAST_VALUE = 8
#: Candidates of the battery: runs of encoded characters.
RUN = "[A-Za-z0-9+/_-]{24,}={0,2}"
#: Alphabets, tried in this order: (name, test, symbols, least length, ends of the classes in symbols,
#: UNEVEN: symbols times the sum of squared frequencies in ordinary text, less 1; CHANGES of class).
ENCODINGS = [
    ("hex", "^[0-9a-fA-F]+$", "0123456789abcdef", 32, (10,), 0.9, 0.25),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32, (26,), 0.8, 0.15),
    ("alnum", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 28, (10,), 1.0, 0.15),
    ("upper", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 28, (10,), 1.0, 0.15),
    ("base64", "^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 24, (26, 52, 62), 1.5, 0.4),
]
LEVEL, REJECTED = 0.05, 0.001
LENGTHS = (32, 40, 48, 64, 96)
#: Decoding: symbols of a group, hex digits that they make, phases that are tried.
GROUPS = {"hex": (2, 2, 1), "base32": (8, 10, 1), "base64": (4, 6, 4)}
#: One well-formed printable character of UTF-8, by bytes; the greatest share of bytes of a text outside such.
WELL = r"[\t\n\r\x20-\x7E]|[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}"
JUNK = 0.15
BINS = 200  # of -10 log10(p)
#: Matches that are placed one after another at once; a text's matches are placed chunk by chunk.
CHUNK = 128


ITEM = "struct<start:int,end:int,value:string>"


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once; a plain column would be computed at each mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of all matches."""
    none = F.array().cast(f"array<{ITEM}>")
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def steps(matches: Column) -> Column:
        return F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("m")))

    def chunks(step: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(step) - 1) / CHUNK).cast("int")), lambda k: in_chunk(F.slice(step, k * CHUNK + 1, CHUNK)))

    def in_chunk(chunk: Column) -> Column:
        return F.aggregate(
            chunk, start,
            lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end"), value(x["m"]).alias("value")))).alias("out")),
        )

    def moved(placed: Column) -> Column:
        whole = F.aggregate(
            placed, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, c: F.struct((a["at"] + c["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )
        return F.flatten(F.zip_with(placed, whole, lambda c, at: F.transform(c["out"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["value"].alias("value")))))

    placed = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: _let(_let(steps(m), chunks), moved))
    return F.when(text.rlike(pattern), placed).otherwise(none)


def _tail(z: Column) -> Column:
    """P(N > z) by the rational approximation of erf, absolute error under 2e-7."""

    def upper(x: Column) -> Column:
        poly = lambda t: t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        return F.greatest(F.lit(0.0), _let(1 / (1 + 0.3275911 * x), poly) * F.exp(-x * x)) / 2

    return _let(upper(F.abs(z) / 2**0.5), lambda p: F.when(z > 0, p).otherwise(1 - p))


def battery(value: Column) -> Column:
    """struct<encoding, n, random, text, junk>: p-values of uniform symbols and of ordinary text, and the share of
    decoded bytes that are not text (null where the encoding cannot be decoded); null where no encoding is inferred."""
    return _let(F.regexp_replace(value, "=+$", ""), lambda body: _let(_encoding(body), lambda e: F.when(e.isNotNull(), _let(_codes(e), lambda codes: _p(codes, e)))))


def _encoding(body: Column) -> Column:
    """struct<encoding, symbols, body, uneven, changes, classes> of a run; null where none fits."""
    out = F.lit(None).cast("struct<encoding:string,symbols:string,body:string,uneven:double,changes:double,classes:array<int>>")
    for name, test, symbols, least, classes, uneven, changes in reversed(ENCODINGS):
        s = {"hex": F.lower(body), "base64": F.translate(body, "-_", "+/")}.get(name, body)
        fits = body.rlike(test) & (F.length(body) >= least)
        if name == "base64":
            fits = fits & body.rlike("[A-Z]") & body.rlike("[a-z]")
        found = F.struct(F.lit(name).alias("encoding"), F.lit(symbols).alias("symbols"), s.alias("body"), F.lit(uneven).alias("uneven"), F.lit(changes).alias("changes"), F.array(*[F.lit(c) for c in classes]).alias("classes"))
        out = F.when(fits, found).otherwise(out)
    return F.when(body.rlike("[0-9]") & body.rlike("[A-Za-z]"), out)


def _codes(e: Column) -> Column:
    return F.transform(F.split(e["body"], ""), lambda c: (F.call_function("instr", e["symbols"], c) - 1).cast("double"))


def _junk(codes: Column, e: Column) -> Column:
    """The least share, over the phases, of decoded bytes that are not text; null where nothing is decoded."""
    group = F.lit(None).cast("struct<symbols:int,digits:int,phases:int>")
    for name, sizes in GROUPS.items():
        group = F.when(e["encoding"] == name, F.struct(*[F.lit(v).alias(k) for k, v in zip(("symbols", "digits", "phases"), sizes)])).otherwise(group)
    base = F.length(e["symbols"]).cast("long")

    def share(g: Column, phase: Column) -> Column:
        last = F.floor((F.size(codes) - phase) / g["symbols"]).cast("int") - 1
        number = lambda i: F.aggregate(F.slice(codes, i * g["symbols"] + phase + 1, g["symbols"]), F.lit(0).cast("long"), lambda a, x: a * base + x.cast("long"))
        made = F.transform(F.sequence(F.lit(0), last), lambda i: F.lpad(F.hex(number(i)), g["digits"], F.lit("0")))
        return _let(F.decode(F.unhex(F.array_join(made, "")), "ISO-8859-1"), lambda t: F.length(F.regexp_replace(t, WELL, "")) / F.length(t))

    return _let(group, lambda g: F.when(g.isNotNull(), F.array_min(F.transform(F.sequence(F.lit(0), g["phases"] - 1), lambda k: share(g, k)))))


def _p(codes: Column, e: Column) -> Column:
    length = F.size(codes)
    n, a = length.cast("double"), F.length(e["symbols"]).cast("double")
    counts = F.transform(F.sequence(F.lit(0), F.length(e["symbols"]) - 1), lambda k: F.size(F.filter(codes, lambda x: x == k)).cast("double"))
    chi = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c) * a / n - n
    pairs = lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda l, r: F.struct(l.alias("l"), r.alias("r")))  # noqa: E731,E741
    changed = lambda x: F.size(F.filter(pairs(x), lambda p: p["l"] != p["r"])).cast("double")
    up = F.transform(codes, lambda x: (x >= a / 2).cast("int"))
    of_class = F.transform(codes, lambda x: F.size(F.filter(e["classes"], lambda c: c <= x)))
    mean = F.aggregate(codes, F.lit(0.0), lambda s, x: s + x) / n
    dev = lambda m: F.aggregate(codes, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    lag = lambda m: F.aggregate(pairs(codes), F.lit(0.0), lambda s, x: s + (x["l"] - m) * (x["r"] - m))
    high = F.size(F.filter(codes, lambda x: x >= a / 2)).cast("double")
    sums = F.struct(chi.alias("chi"), high.alias("high"), (changed(up) + 1).alias("runs"), changed(of_class).alias("changes"), _let(mean, dev).alias("dev"), _let(mean, lag).alias("lag"))
    return _let(sums, lambda x: _let(_deviations(x, e, n, a), lambda z: F.struct(e["encoding"].alias("encoding"), length.alias("n"), _joint(z).alias("random"), _tail(z["text"]).alias("text"), _junk(codes, e).alias("junk"))))


def _deviations(x: Column, e: Column, n: Column, a: Column) -> Column:
    """struct of the standard normal deviations of the tests."""
    df = a - 1
    chi = (F.pow(F.greatest(x["chi"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    mu = 2 * x["high"] * (n - x["high"]) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    runs = F.when(var > 0, F.abs(x["runs"] - mu) / F.sqrt(var)).otherwise(F.lit(9.0))
    serial = F.when(x["dev"] > 0, F.abs(x["lag"] / x["dev"]) * F.sqrt(n)).otherwise(F.lit(9.0))
    even = (df + n * e["uneven"] - x["chi"]) / F.sqrt(2 * (df + 2 * n * e["uneven"]))
    often = (x["changes"] - (n - 1) * e["changes"]) / F.sqrt((n - 1) * e["changes"] * (1 - e["changes"]))
    return F.struct(chi.alias("chi"), F.greatest(runs, serial).alias("two_sided"), ((even + often) / 2**0.5).alias("text"))


def _joint(z: Column) -> Column:
    return F.least(F.lit(1.0), 3 * F.least(_tail(z["chi"]), 2 * _tail(z["two_sided"])))


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for k, edge in enumerate(LENGTHS):
        out = F.when(n >= edge, k + 1).otherwise(out)
    return out


def candidates(text: Column) -> Column:
    """array<struct<start, end, encoding, length class, p>> of the runs with an inferred encoding; p is that
    of ordinary text, and 1 where the run cannot be random or holds text."""
    tested = F.transform(_found(text, RUN), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["value"]).alias("b")))
    return F.transform(
        F.filter(tested, lambda x: x["b"].isNotNull()),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["b"]["encoding"].alias("encoding"), _length_class(x["b"]["n"]).alias("long"), F.when((x["b"]["random"] < REJECTED) | F.coalesce(x["b"]["junk"] <= JUNK, F.lit(False)), F.lit(1.0)).otherwise(x["b"]["text"]).alias("p")),
    )


def levels(docs: DataFrame, text: str = "text") -> dict[tuple[str, int], float]:
    """Benjamini-Hochberg levels by encoding and length class over all candidates of the corpus: runs of
    ordinary text are the null hypothesis, and p-values up to the level deny it."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.explode(candidates(body)).alias("c")).select("c.encoding", "c.long", F.least(F.lit(BINS), F.floor(-10 * F.log10(F.greatest(F.col("c.p"), F.lit(1e-30))))).cast("int").alias("bin"))
    counts: dict[tuple[str, int], dict[int, int]] = {}
    for r in rows.groupBy("encoding", "long", "bin").count().collect():
        counts.setdefault((r["encoding"], r["long"]), {})[r["bin"]] = r["count"]
    out = {}
    for k, bins in counts.items():
        m, below, level = sum(bins.values()), 0, 0.0
        for b in sorted(bins, reverse=True):  # from the smallest p-values up
            below += bins[b]
            edge = 10 ** (-b / 10)  # the largest p-value of the cell
            if edge <= below * LEVEL / m:
                level = edge
        out[k] = level
    return out


def _as(kind: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def of_kind(kind: int):
    return lambda x: x["kind"] == kind


def spans(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with array<struct<start, kind, end>> by start, then kind in the order of listing."""
    body = F.coalesce(F.col(text), F.lit(""))
    known = levels_column(levels(docs, text))
    base = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        got = _found(body, pattern, 2 if kind == "assign" else 0)
        if kind == "assign":
            got = F.filter(got, lambda x: F.length(x["value"]) >= LEAST_VALUE)
        base.append(F.transform(got, _as(k)))
    fixed, runs = unused(docs, "base"), unused(docs, "runs")
    withs = docs.withColumns({fixed: F.array_sort(F.concat(*base)), runs: candidates(body)}).drop(out)
    random = F.filter(runs, lambda x: x["p"] <= known(x))
    random = F.filter(random, lambda x: ~F.exists(fixed, lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))
    return withs.withColumn(out, F.array_sort(F.concat(fixed, F.transform(random, _as(len(KINDS)))))).drop(fixed, runs)


def levels_column(found: dict[tuple[str, int], float]):
    def of(x: Column) -> Column:
        c = F.lit(-1.0)
        for (name, long), p in sorted(found.items()):
            c = F.when((x["encoding"] == name) & (x["long"] == long), F.lit(p)).otherwise(c)
        return c

    return of


NAMES = [*KINDS, "random"]


def joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by the mask (overlapping spans by one); other rows unchanged."""
    held = unused(docs, "secrets")
    found = spans(docs, text, held)
    t, span = F.col(text), "struct<start:int,end:int>"
    merged = F.aggregate(  # spans by start; one that meets those before it widens the last
        held, F.struct(F.lit(-1).alias("end"), F.array().cast(f"array<{span}>").alias("out")),
        lambda a, x: F.when(x["start"] >= a["end"], F.struct(x["end"].alias("end"), F.concat(a["out"], F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))).alias("out")))
        .otherwise(F.struct(F.greatest(a["end"], x["end"]).alias("end"), F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(F.struct(F.element_at(a["out"], -1)["start"].alias("start"), F.greatest(a["end"], x["end"]).alias("end")))).alias("out"))),
        lambda a: a["out"],
    )

    def between(spans: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"]))
        starts = F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.length(t)))
        return F.array_join(F.zip_with(ends, starts, lambda a, z: F.substring(t, a + 1, z - a)), mask)

    return found.withColumn(text, F.when(F.size(held) > 0, _let(merged, between)).otherwise(t)).drop(held)
