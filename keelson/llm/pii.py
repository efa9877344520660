"""Personal data, in DataFrame operations only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod-97 for IBANs, digit counts, number ranges)
and words nearby raise or lower the score. Positions come from cutting the text at the matches: the lengths of the pieces
between them and of the matches add up to every start, and the words nearby are those of the two pieces beside a match. So a
text costs in proportion to its length, however many matches it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty

#: kind, pattern, words that raise the score of a span they stand near. Possessive quantifiers match what greedy ones
#: would here, as nothing that follows could take back a character; Java runs them without recursion. The look-behinds
#: spare the runs that a match could only start in the midst of. An IBAN's end shows only in its checksum: its pattern takes
#: the first four characters and captures the run from there, with one character more if that goes on the last word.
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?+))[A-Z]{2}[0-9]{2}",
}
#: Characters of an IBAN by country; of several ends that pass the checksum, this one holds.
IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 "
        "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 "
        "MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 "
        "SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
#: The score of a confirmed span by how much its check says: that of a card lets one number of ten pass, that of an IBAN one
#: of 97, those of addresses and phone numbers only their form. Then whole words that speak for the kind, and against it.
SCORES = {"email": 0.75, "ip": 0.5, "card": 0.7, "phone": 0.55, "iban": 0.9}
FOR = {
    "email": "mail email e-mail contact write address reach",
    "ip": "ip ipv4 host hostname server address addr client gateway",
    "card": "card cards visa mastercard amex credit debit pay payment",
    "phone": "phone call tel telephone fax mobile cell ring dial",
    "iban": "iban account bank transfer bic swift",
}
AGAINST = {
    "email": "example noreply no-reply",
    "ip": "version release build section chapter",
    "card": "isbn order tracking serial invoice part",
    "phone": "isbn order tracking serial invoice part",
    "iban": "example sample specimen",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: The characters on either side of a span, up to the next match of its kind, that are looked through for such words, the part
#: of what a score lacks to 1 that a word for it adds, and what a word against it leaves of the score.
REACH, RAISED, LOWERED = 40, 0.6, 0.5
#: Prefix sums of long lists go in blocks, so a text with k matches costs k * BLOCK steps and not k * k.
BLOCK = 256


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: what stands in a lambda is computed for each of its elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _account(run: Column) -> Column:
    """The part of a run, from its start to the end of a word, that has 15 to 34 characters (A-Z, 0-9) and leaves 1 at division
    by 97, the first four moved to its end: that of the country's length, or else the longest; null without any."""

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(run, i, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    head = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.lit(0), step)
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    own = F.coalesce(F.try_element_at(lengths, F.substring(run, 1, 2)), F.lit(0))

    def end(s: Column, i: Column) -> Column:
        code = F.ascii(F.substring(run, i, F.lit(1)))
        rest, n = F.when(code == 32, s["rest"]).otherwise(step(s["rest"], i)), s["n"] + F.when(code == 32, 0).otherwise(1)
        last = code.between(48, 90) & F.substring(run, i + 1, F.lit(1)).isin("", " ")
        holds = last & n.between(15, 34) & ((rest * 1_000_000 + head) % 97 == 1)
        return F.struct(
            rest.alias("rest"),
            n.alias("n"),
            F.when(holds & ~s["sure"], i).otherwise(s["end"]).alias("end"),
            (s["sure"] | holds & (n == own)).alias("sure"),
        )

    zero = F.struct(F.lit(0).alias("rest"), F.lit(4).alias("n"), F.lit(0).alias("end"), F.lit(False).alias("sure"))
    found = F.aggregate(F.sequence(F.lit(5), F.length(run)), zero, end, lambda s: s["end"])
    return F.substring(run, F.lit(1), F.nullif(found, F.lit(0)))


def _apart(pairs: Column) -> Column:
    """pairs (value, start, ...), in order of start, without those that start before the last one left has ended."""

    def within(block: Column, free: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(free.alias("free"), F.array().cast("array<struct<value:string,start:bigint,before:string,after:string>>").alias("out")),
            lambda s, x: F.when(x["start"] < s["free"], s).otherwise(F.struct((x["start"] + F.length(x["value"])).alias("free"), F.concat(s["out"], F.array(x)).alias("out"))),
        )

    def add(s: Column, block: Column) -> Column:
        more = within(block, s["free"])
        return F.struct(more["free"].alias("free"), F.concat(s["out"], F.array(more["out"])).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("free"), F.array().cast("array<array<struct<value:string,start:bigint,before:string,after:string>>>").alias("out"))
    return F.flatten(F.aggregate(_blocks(pairs), zero, add)["out"])


def _blocks(values: Column) -> Column:
    """An array cut into arrays of BLOCK."""
    return _let(values, lambda all_: F.transform(F.sequence(F.lit(0), F.floor(F.size(all_) / BLOCK).cast("int")), lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK))))


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        small = F.transform(F.split(found, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(small, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return _let(_digits(found), lambda digits: F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _starts(between: Column, found: Column) -> Column:
    """Starts of the matches: the sums of all lengths before them."""
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, f: F.struct(F.length(b).alias("b"), F.length(f).alias("f")))
    def within(block: Column, first: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out")),
            lambda s, x: F.struct((s["at"] + x["b"] + x["f"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["b"])).alias("out")),
        )

    whole = F.aggregate(
        _blocks(steps),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("out")),
        lambda s, block: F.struct(
            (s["at"] + F.aggregate(block, F.lit(0).cast("bigint"), lambda t, x: t + x["b"] + x["f"])).alias("at"),
            F.concat(s["out"], F.array(within(block, s["at"])["out"])).alias("out"),
        ),
    )
    return F.flatten(whole["out"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """docs' id as doc_id and found: an array of (start, rank, kind, end, value, score) in order of start and kind.

    Code points, end exclusive. Null text counts as empty; a text without any has an empty array; repeated rows are
    treated alike; other columns of docs are not read. Each kind is matched leftmost without overlaps of its own kind,
    matches that fail their check are dropped and not tried again, but for IBANs, which are tried from every word and to
    the end of every word; spans of different kinds may overlap. The score of a confirmed span is its kind's, raised where a
    word of FOR and lowered where one of AGAINST stands within REACH characters and no other match of the kind between.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    for kind in kinds:
        pattern = PATTERNS[kind]
        tried = F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else F.col("text").rlike("[0-9]")
        none = F.array().cast("array<string>")
        rows = rows.withColumn(f"_{kind}", F.when(tried, F.regexp_extract_all("text", F.lit(pattern), F.lit(int(kind == "iban")))).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*[_spans_of(k) for k in kinds])).alias("found"))


def _words(words: str) -> str:
    return r"(?i)(?<![\w-])(?:" + "|".join(words.split()) + r")(?![\w-])"


def _spans_of(kind: str) -> Column:
    """The confirmed spans of one kind, from the columns text and _kind."""
    found = F.col(f"_{kind}")
    head = 4 if kind == "iban" else 0  # of an IBAN only so much is cut out, so the rest of it begins the next piece

    def span(x: Column) -> Column:
        value = x["value"]
        after = F.substring(x["after"], F.length(value) - head + 1, F.lit(REACH)) if head else F.substring(x["after"], 1, REACH)
        around = F.concat(F.substring(x["before"], -REACH, REACH), F.lit("\n"), after)
        score = F.lit(SCORES[kind])
        score = F.when(around.rlike(_words(FOR[kind])), score + (1 - score) * RAISED).otherwise(score)
        score = F.when(around.rlike(_words(AGAINST[kind])), score * LOWERED).otherwise(score)
        return F.struct(x["start"].alias("start"), F.lit(list(PATTERNS).index(kind)).alias("rank"), F.lit(kind).alias("kind"), (x["start"] + F.length(value)).alias("end"), value.alias("value"), score.alias("score"))

    def spans(pieces: Column) -> Column:
        starts = _starts(pieces, F.transform(found, lambda x: F.substring(x, 1, head)) if head else found)
        values = F.transform(found, _account) if head else found
        every = F.arrays_zip(values.alias("value"), starts.alias("start"), F.slice(pieces, F.lit(1), F.size(found)).alias("before"), F.slice(pieces, F.lit(2), F.size(found)).alias("after"))
        confirmed = F.filter(every, lambda x: x["value"].isNotNull() & _confirmed(kind, x["value"]))
        return F.transform(_apart(confirmed) if head else confirmed, span)

    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string,score:double>>")
    return F.when(F.size(found) > 0, _let(F.split("text", PATTERNS[kind], -1), spans)).otherwise(none)


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def digest_columns(found: DataFrame) -> DataFrame:
    def named(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [F.size(F.filter("found", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    scores = F.array_join(F.transform("found", lambda x: F.format_number(x["score"], 2)), ",")
    return found.select("doc_id", *counts, F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.col("found")).alias("spans"), scores.alias("scores"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(find_pii(documents(spark, sf_dir)))
