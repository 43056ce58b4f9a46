r"""Secret scans (operator 3); DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three fixed patterns; matches that
are too short are dropped. The method adds stretches that look random: a first-order
character Markov model of random strings and one of ordinary identifiers are trained from
labelled samples. Along a token of MIN_TOKEN characters or more, each pair of characters adds
its log-likelihood ratio less ``offset``; a run from where the sum last was zero to where it
is highest is a secret if it reaches ``least`` and is MIN_TOKEN long. So a secret is found
within its token, whatever words it is glued to, and a token may hold several. Only what is
left when the base matches are cut out, one kind after another, is judged.

Positions are code points, the end exclusive. They come from cutting the text at the
pattern: pieces and matches alternate, so their running lengths are the positions. All folds
take time in proportion to the text (running sums to the power 1.5 of the spans).
Null and empty texts hold nothing. Every row is judged by itself, without a shuffle; rows
that are the same get the same spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed patterns and least lengths of the base kinds, in the order that breaks ties.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters with its head
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 6

# Alphabet of tokens; a token is a run of these, at least MIN_TOKEN long.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
MIN_TOKEN = 12
TOKEN = r"[A-Za-z0-9+/_=-]{12,}"
PAIR_RANGE = (-4.0, 3.0)  # of a pair's ratio: pairs that samples hardly hold say no more
CHUNK = 256

# How many leading characters of ALPHABET, and from where, the random samples draw from.
RANDOM_KINDS = {
    "hex": "0123456789abcdef", "upper hex": "0123456789ABCDEF", "base32": ALPHABET[26:52] + "234567",
    "letters and digits": ALPHABET[:62], "base64": ALPHABET[:64], "url base64": ALPHABET[:62] + "_-",
    "lower": ALPHABET[:26], "lower and digits": ALPHABET[:26] + ALPHABET[52:62], "upper and digits": ALPHABET[26:62], "letters": ALPHABET[:52],
}

# Fixed words of ordinary identifiers, for the labelled sample.
IDENTIFIER_WORDS = (
    "get set is has user name file path list item index count value key data type node tree "
    "string number config option default parse write read open close start stop begin end "
    "create delete update insert select order group filter map reduce table column row page "
    "request response server client session cookie header body content length status error "
    "message handler listener event queue stack buffer stream input output source target "
    "first last next previous parent child root left right width height size color image "
    "button window document element attribute class method function module package import "
    "export test check validate format convert encode decode hash random time date year month "
    "day hour minute second account customer product price total amount payment address city "
    "country language text title description author version release build manager service "
    "factory controller repository transaction connection database information international "
    "application environment development performance management registration authentication"
)


def labelled_samples(spark: SparkSession, n: int = 4000, salt: int = 0) -> DataFrame:
    """(text, label, kind) of ``n`` random strings (1) and ``n`` identifiers (0), the same for a salt.

    ``kind`` names what the random strings are drawn from, null for identifiers.
    """
    draw = lambda of, *more: F.pmod(F.xxhash64(F.col("id"), F.lit(salt), *[F.lit(m) for m in more]), F.lit(of))
    words = F.split(F.lit(IDENTIFIER_WORDS), " ")
    word = [F.element_at(words, (draw(len(IDENTIFIER_WORDS.split()), k) + 1).cast("int")) for k in range(4)]
    shape = draw(8, "shape")
    one = F.substring(F.lit(ALPHABET), (F.pmod(F.col("id"), F.lit(len(ALPHABET))) + 1).cast("int"), F.lit(1))
    day = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), draw(14000, "day").cast("int")), "yyyy-MM-dd")
    plain = (
        F.when(shape == 0, F.concat_ws("_", *word))
        .when(shape == 1, F.concat(word[0], *[F.initcap(w) for w in word[1:]]))
        .when(shape == 2, F.concat_ws("-", *word[:3]))
        .when(shape == 3, F.concat_ws("/", *word))
        .when(shape == 4, F.repeat(one, F.lit(24)))  # rulers and placeholders
        .when(shape == 5, F.concat(*word))
        .when(shape == 6, F.concat_ws("/", day, draw(10**6, "n").cast("string")))
        .otherwise(F.concat_ws("_", F.upper(word[0]), F.upper(word[1]), draw(100, "n").cast("string")))
    )
    names = list(RANDOM_KINDS)
    kind = F.element_at(F.array(*[F.lit(k) for k in names]), (F.pmod(F.col("id"), F.lit(len(names))) + 1).cast("int"))
    drawn = F.element_at(F.create_map(*[F.lit(x) for pair in RANDOM_KINDS.items() for x in pair]), F.col("kind"))
    letter = lambda k: F.substring(drawn, (F.pmod(F.xxhash64("id", F.lit(salt), k), F.length(drawn)) + 1).cast("int"), F.lit(1))
    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), letter), "")
    ids = spark.range(n)
    random = ids.withColumn("kind", kind).select(noise.alias("text"), F.lit(1).alias("label"), "kind")
    return random.unionByName(ids.select(plain.alias("text"), F.lit(0).alias("label"), F.lit(None).cast("string").alias("kind")))


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios of character pairs, by 68 * first + second; log base e.

    Characters outside the alphabet are skipped. The two models have as many parameters as
    pairs of the alphabet, so the driver gets at most 2 * 68 ** 2 counts.
    """
    size = len(ALPHABET) + 1
    chars = F.filter(F.transform(F.split("text", ""), lambda c: F.instr(F.lit(ALPHABET), c)), lambda i: i > 0)
    pairs = F.transform(F.sequence(F.lit(1), F.size("chars") - 1), lambda i: F.element_at("chars", i) * size + F.element_at("chars", i + 1))
    counts = (
        samples.where("text is not null and label in (0, 1)")
        .select("label", chars.alias("chars")).where(F.size("chars") > 1)
        .select("label", F.explode(pairs).alias("pair"))
        .groupBy("label", "pair").agg(F.count("*").alias("n")).collect()
    )
    table = [[smooth] * (size * size) for _ in range(2)]
    for r in counts:
        table[r.label][r.pair] += r.n
    import math

    rows = [[sum(t[a * size : (a + 1) * size]) for a in range(size)] for t in table]
    return [math.log(table[1][i] / rows[1][i // size]) - math.log(table[0][i] / rows[0][i // size]) for i in range(size * size)]


def random_runs(token: Column, model: Sequence[float], offset: float, least: float) -> Column:
    """Array of (start, end), within the token, of its stretches that look random."""
    size = len(ALPHABET) + 1
    low, high = PAIR_RANGE
    # one string literal, parsed once: an array literal of thousands of numbers bloats the plan
    table = F.from_json(F.lit("[" + ",".join(f"{min(high, max(low, x)) - offset:.6f}" for x in model) + "]"), "array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit(0.0).alias("best"), F.lit(0).alias("end"), none.alias("runs")
    )

    def closed(s: Column) -> Column:
        own = (s["best"] >= least) & (s["end"] - s["start"] >= MIN_TOKEN)
        return F.when(own, F.concat(s["runs"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["runs"])

    def step(s: Column, code: Column) -> Column:
        total = s["sum"] + F.when(s["i"] > 0, F.element_at(table, s["last"] * size + code + 1)).otherwise(0.0)
        i = s["i"] + 1
        over, higher = total <= 0, total > s["best"]
        pick = lambda a, b, c: F.when(over, a).when(higher, b).otherwise(c)
        return F.struct(
            i.alias("i"), code.alias("last"), F.greatest(total, F.lit(0.0)).alias("sum"), F.when(over, s["i"]).otherwise(s["start"]).alias("start"),
            pick(F.lit(0.0), total, s["best"]).alias("best"), pick(s["i"], i, s["end"]).alias("end"), F.when(over, closed(s)).otherwise(s["runs"]).alias("runs"),
        )

    return F.aggregate(codes, start, step, closed)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where a lambda refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine) -> Column:
    """Running sums (or maxima) of an array of ints, by chunks: arrays that grow are short."""
    none = F.array().cast("array<int>")

    def fold(array: Column) -> Column:
        start = F.struct(F.lit(0).alias("last"), none.alias("all"))

        def step(s: Column, x: Column) -> Column:
            last = combine(s["last"], x)
            return F.struct(last.alias("last"), F.concat(s["all"], F.array(last)).alias("all"))

        return F.aggregate(array, start, step, lambda s: s["all"])

    def chunks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: fold(F.slice(v, c * CHUNK + 1, CHUNK)))

    def joined(parts: Column, before: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p, i: let(F.coalesce(F.get(before, i - 1), F.lit(0)), lambda b: F.transform(p, lambda x: combine(x, b)))))

    whole = lambda v: let(chunks(v), lambda parts: let(fold(F.transform(parts, lambda p: F.element_at(p, -1))), lambda before: joined(parts, before)))
    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, piece, found): the pattern's matches, each with the text before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = let(found, lambda f: F.arrays_zip(F.slice(F.split(text, pattern), 1, F.size(f)).alias("piece"), f.alias("found")))

    def placed(pair: Column, end: Column) -> Column:
        return F.struct((end - F.length(pair["found"])).alias("start"), end.alias("end"), pair["piece"].alias("piece"), pair["found"].alias("found"))

    ends = lambda ps: running(F.transform(ps, lambda p: F.length(p["piece"]) + F.length(p["found"])), lambda a, b: a + b)
    spans = let(pairs, lambda ps: F.zip_with(ps, ends(ps), placed))
    none = F.array().cast("array<struct<start:int,end:int,piece:string,found:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def without(text: Column, spans: Column, drop) -> Column:
    """The text with blanks in place of those matches that ``drop`` takes; lengths stay."""
    cut = lambda m: F.transform(m, lambda s: F.concat(s["piece"], F.when(drop(s), F.repeat(F.lit(" "), F.length(s["found"]))).otherwise(s["found"])))
    rest = lambda m: F.substring(text, F.element_at(m, -1)["end"] + 1, F.length(text))
    return let(spans, lambda m: F.when(F.size(m) > 0, F.concat(F.array_join(cut(m), ""), rest(m))).otherwise(text))


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, model: Sequence[float], offset: float = 0.2, least: float = 12.0, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: an array of (start, kind, end), by start, then kind.

    ``kind`` counts KINDS from 0. A column ``secrets`` is replaced if there; other columns
    stay, whatever their names.
    """
    spare = lambda name: name if name not in docs.columns else spare(name + "_")
    names = {k: spare(k) for k in ("assign_spans", "access_spans", "hex_spans", "rest_1", "rest_2", "token_spans")}
    assign, access, hexes, rest_1, rest_2, tokens = (F.col(n) for n in names.values())
    body = F.coalesce(F.col(text), F.lit(""))
    long_enough = lambda s: F.length(F.regexp_extract(s["found"], r"^" + ASSIGN, 2)) >= ASSIGN_LEAST
    every = lambda s: F.lit(True)
    out = docs.withColumn(names["assign_spans"], matches(body, ASSIGN)).withColumn(names["access_spans"], matches(body, ACCESS)).withColumn(names["hex_spans"], matches(body, HEX))
    out = out.withColumn(names["rest_1"], without(body, assign, long_enough))
    out = out.withColumn(names["rest_2"], without(rest_1, matches(rest_1, ACCESS), every))
    out = out.withColumn(names["token_spans"], matches(without(rest_2, matches(rest_2, HEX), every), TOKEN))
    base = F.concat(_tagged(F.filter(assign, long_enough), 0), _tagged(access, 1), _tagged(hexes, 2))
    runs = F.transform(
        tokens,
        lambda t: F.transform(random_runs(t["found"], model, offset, least), lambda r: F.struct((t["start"] + r["start"]).alias("start"), F.lit(3).alias("kind"), (t["start"] + r["end"]).alias("end"))),
    )
    return out.withColumn("secrets", F.array_sort(F.concat(base, F.flatten(runs)))).drop(*names.values())


def described(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, secrets: str = "secrets", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with the spans of ``secrets`` replaced in the text; overlapping spans are one."""
    spans = F.col(secrets)

    def done(ends: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(ends, i - 1), F.lit(0))
            return F.when(s["start"] >= before, F.concat(F.substring(F.col(text), before + 1, s["start"] - before), F.lit(mark))).otherwise("")

        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(F.col(text), F.element_at(ends, -1) + 1, F.length(text)))

    hidden = let(running(F.transform(spans, lambda s: s["end"]), F.greatest), done)
    return docs.withColumn(text, F.when(F.size(spans) > 0, hidden).otherwise(F.col(text)))
