"""Secrets: fixed patterns, and a randomness test battery for high-entropy tokens with false-discovery control.

Every run of 20 or more token characters is a candidate. Its encoding is inferred from its characters (hex, base32,
else base64) and three tests ask whether it looks drawn uniformly from that alphabet: chi-squared over the alphabet,
runs above and below the middle, and lag-1 serial correlation. Fisher's method combines their p-values.

False discoveries are ordinary tokens (words, paths, identifiers) that look random. Decoys say how many to expect: every
document without a candidate or base span lends a piece of its own words and numbers, joined by a token character, of a
length that its hash chooses. Per length class the share of decoys at or above a p-value, the decoy that might yet come
included, is an ordinary token's chance of passing there, and Benjamini and Hochberg's rule gives the lowest threshold
at which expected false discoveries stay within RATE of what passes. Classes with fewer than LEAST_DECOYS decoys also
take their neighbours'. Without enough decoys nothing is reported beyond the base kinds. The classes' histogram has at
most CLASSES * CELLS * 2 rows, whatever the input's size, and covers every document.

Native: one scan that writes spans and candidates' positions (never their text) to the shared folder, an aggregate over
them, and a map over them. Defined results: null or empty text has no spans; repeated rows are judged one by one; spans
of one start are ordered by kind; an empty table gives no rows; other columns are ignored; a very long text takes time
in proportion to its length and its spans'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import let, stored

ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++"
)
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
#: What ends an assignment: its value, of which group 2 in the contract is the last run of value characters.
VALUE = r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
KINDS = ("assign", "access", "hex", "random")
SHORTEST = 20

CLASSES, CELLS, RATE = 10, 72, 0.05
#: Decoys that a length class's estimate rests on, and the powers of ten of p-values that cells tell apart.
LEAST_DECOYS, DECADES = 200, 9
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
CHECKED = "array<struct<start:int,stop:int,class:int,p:double>>"
SEPARATORS = "-_/+"


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the logistic approximation, kept off 0 and 1."""
    return F.least(F.lit(0.999999), F.greatest(F.lit(1e-9), 1 / (1 + F.exp(F.least(F.lit(40.0), 1.5976 * z + 0.07056 * z * z * z)))))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b)


def encoding(value: Column) -> Column:
    return F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(value.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")


def battery(value: Column) -> Column:
    """Fisher-combined p-value of the three tests under 'uniform over the inferred alphabet'; small: not random."""

    def coded(x: Column) -> Column:
        kind = x["kind"]
        alphabet = F.when(kind == "hex", ALPHABETS["hex"]).when(kind == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
        text = F.when(kind == "hex", F.lower(x["value"])).otherwise(F.translate(x["value"], "-_", "+/"))
        codes = let(F.struct(alphabet.alias("a"), text.alias("t")), lambda y: F.transform(F.split(y["t"], ""), lambda c: (F.instr(y["a"], c) - 1).cast("double")))
        return let(F.struct(codes.alias("x"), text.alias("t"), F.length(x["value"]).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k")), tested)

    def tested(s: Column) -> Column:
        x, n, k = s["x"], s["n"], s["k"]
        times = lambda c: F.length(s["t"]) - F.length(F.replace(s["t"], c, F.lit("")))
        squares = _total(F.transform(F.array_distinct(F.split(s["t"], "")), lambda c: F.pow(times(c).cast("double"), F.lit(2.0))))
        chi = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        high = lambda v: v >= k / 2
        above = F.size(F.filter(x, high)).cast("double")
        turns = F.size(F.filter(F.transform(x, lambda v, i: (i > 0) & (high(v) != high(F.coalesce(F.get(x, i - 1), v)))), lambda b: b)).cast("double")
        mean = _total(x) / n
        both = let(
            F.struct(chi.alias("chi"), above.alias("above"), turns.alias("turns"), mean.alias("mean")),
            lambda t: F.struct(
                t["chi"].alias("chi"),
                let(2 * t["above"] * (n - t["above"]) / n, lambda m: F.when(m > 1, (t["turns"] - m) / F.sqrt(m * (m - 1) / (n - 1))).otherwise(F.lit(-6.0))).alias("runs"),
                let(
                    _total(F.transform(x, lambda v: (v - t["mean"]) * (v - t["mean"]))),
                    lambda v2: F.when(v2 > 0, (_total(F.transform(x, lambda v, i: F.when(i > 0, (v - t["mean"]) * (F.coalesce(F.get(x, i - 1), v) - t["mean"])).otherwise(0.0))) / v2 + 1 / n) * F.sqrt(n)).otherwise(F.lit(6.0)),
                ).alias("serial"),
            ),
        )
        return let(both, lambda z: fisher(_upper_tail(z["chi"]), F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z["runs"]))), F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z["serial"])))))

    def fisher(*p: Column) -> Column:
        return let(-(F.log(p[0]) + F.log(p[1]) + F.log(p[2])), lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return let(F.struct(value.alias("value"), encoding(value).alias("kind")), coded)


def length_class(n: Column) -> Column:
    return F.least(F.lit(CLASSES - 1), F.floor((n - SHORTEST) / 6)).cast("int")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base: spans of the fixed kinds; checked: candidates with length class, decoy or not, and p-value."""
    text = F.col("text")
    long_value = lambda v: F.length(F.regexp_extract(v, VALUE, 1)) >= 12
    base = S.merged(
        S.find(text, "assign", 0, ASSIGN, long_value),
        S.find(text, "access", 1, ACCESS, lambda _: F.lit(True), F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS)),
        S.find(text, "hex", 2, HEX, lambda _: F.lit(True)),
    )
    tokens = S.find(text, "random", 3, CANDIDATE, lambda v: v.rlike("[A-Za-z]"))
    judged = lambda v: F.struct(length_class(F.length(v)).alias("class"), battery(v).alias("p"))
    plain = lambda found: F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    rows = docs.select("doc_id", "text", plain(base).alias("base"), tokens.alias("tokens"))
    checked = F.transform("tokens", lambda s: let(judged(s["value"]), lambda j: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), j["class"].alias("class"), j["p"].alias("p"))))
    lent = F.when((F.size("base") == 0) & (F.size("tokens") == 0), decoy(F.col("text")))
    return rows.select("doc_id", "base", checked.cast(CHECKED).alias("checked"), let(lent, lambda v: F.when(F.length(v) >= SHORTEST, judged(v))).alias("decoy"))


def decoy(text: Column) -> Column:
    """A piece of the text's own words, joined to look like a token; null for a short text."""
    size = SHORTEST + F.pmod(F.xxhash64(text, F.lit(1)), F.lit(6 * CLASSES)).cast("int")
    start = F.pmod(F.xxhash64(text, F.lit(2)), F.greatest(F.lit(1), F.length(text) - 3 * size)).cast("int")
    joint = F.substr(F.lit(SEPARATORS), F.pmod(F.xxhash64(text, F.lit(3)), F.lit(len(SEPARATORS))).cast("int") + 1, F.lit(1))
    piece = F.regexp_replace(F.substr(text, start + 1, 3 * size), F.lit("[^A-Za-z0-9+/_-]+"), joint)
    return F.when(F.length(text) >= 3 * size, F.substr(piece, F.lit(1), size))


def cell_of(p: Column) -> Column:
    """Cells of equal width in log p."""
    return F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor((F.log10(p) / DECADES + 1) * CELLS))).cast("int")


def least_p(cell: int) -> float:
    return 10.0 ** ((cell / CELLS - 1) * DECADES) if cell else 0.0


def histogram(scanned: DataFrame) -> dict[tuple[int, int, bool], int]:
    """Candidates and decoys by length class and cell: CLASSES * CELLS * 2 numbers at most."""
    one = F.explode(F.concat(F.transform("checked", lambda c: F.struct(c["class"].alias("class"), c["p"].alias("p"), F.lit(False).alias("decoy"))), F.when(F.col("decoy").isNotNull(), F.array(F.struct(F.col("decoy.class").alias("class"), F.col("decoy.p").alias("p"), F.lit(True).alias("decoy")))).otherwise(F.array())))
    counts = scanned.where((F.size("checked") > 0) | F.col("decoy").isNotNull()).select(one.alias("c")).groupBy(F.col("c.class").alias("class"), cell_of(F.col("c.p")).alias("cell"), F.col("c.decoy").alias("decoy")).count()
    return {(r["class"], r["cell"], r["decoy"]): r["count"] for r in counts.collect()}


def thresholds(seen: dict[tuple[int, int, bool], int]) -> list[float]:
    """For each length class the least p-value that counts as random; above 1 where none keeps to RATE."""
    of = lambda c, cell, is_decoy: seen.get((c, cell, is_decoy), 0)
    total = lambda c, is_decoy: sum(of(c, i, is_decoy) for i in range(CELLS))
    out = []
    for c in range(CLASSES):
        pool = [c]
        for step in range(1, CLASSES):
            if sum(total(k, True) for k in pool) >= LEAST_DECOYS:
                break
            pool += [k for k in (c - step, c + step) if 0 <= k < CLASSES]
        decoys, tested = sum(total(k, True) for k in pool), total(c, False)
        least, passed, above = 2.0, 0, 0
        for cell in range(CELLS - 1, -1, -1):
            passed, above = passed + of(c, cell, False), above + sum(of(k, cell, True) for k in pool)
            if passed and tested * (above + 1) / (decoys + 1) <= RATE * passed:
                least = least_p(cell)
        out.append(least)
    return out


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of base spans, and all spans with the random tokens."""
    scanned = stored(scan(docs))
    least = F.array(*[F.lit(t) for t in thresholds(histogram(scanned))])
    random = F.transform(
        F.filter("checked", lambda c: c["p"] >= F.get(least, c["class"])),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("ord"), c["stop"].alias("stop"), F.lit("random").alias("kind")),
    )
    every = F.array_sort(F.concat("base", random))
    return scanned.select(
        "doc_id",
        *[S.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"),
        S.joined(every).alias("spans"),
    )
